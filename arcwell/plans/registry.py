"""A registry of algorithms with typed parameters, and a cache of graph projections."""

from __future__ import annotations

import inspect
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Registry:
    """Algorithms by unique id; unknown or missing parameters are refused before anything runs."""

    algorithms: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str, function: Callable) -> None:
        if name in self.algorithms:
            raise ValueError(f"{name} is registered already")
        self.algorithms[name] = function

    def parameters(self, name: str) -> dict[str, inspect.Parameter]:
        return dict(inspect.signature(self.algorithms[name]).parameters)

    def describe(self) -> list[dict]:
        """For display: id, summary and parameters with their defaults."""
        out = []
        for name, function in sorted(self.algorithms.items()):
            params = {k: None if p.default is p.empty else p.default for k, p in self.parameters(name).items()}
            out.append({"id": name, "summary": (function.__doc__ or "").strip().split("\n")[0], "parameters": params})
        return out

    def run(self, name: str, *args, **options):
        """The result, and how it was run: id, options and seconds to build the plan."""
        if name not in self.algorithms:
            raise LookupError(f"no algorithm {name}")
        if unknown := set(options) - set(self.parameters(name)):
            raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
        began = time.monotonic()
        result = self.algorithms[name](*args, **options)
        return result, {"id": name, "options": options, "seconds": time.monotonic() - began}


def standard() -> Registry:
    from arcwell.operators import centrality, communities, flow, planning, routes, structure

    r = Registry()
    for name, function in {
        "centrality.degree": centrality.degree, "centrality.pagerank": centrality.pagerank, "centrality.betweenness": centrality.betweenness,
        "structure.connected-components": structure.weak_components, "structure.strong-components": structure.strong_components, "structure.cycles": structure.cycles,
        "routing.shortest-path": routes.shortest_path, "routing.astar": routes.a_star, "routing.k-shortest": routes.k_shortest, "routing.pareto": routes.pareto_routes, "routing.impact": routes.impact_reroute,
        "flow.maximum": flow.maximum_flow, "planning.critical-path": planning.critical_path, "community.leiden": communities.communities, "prediction.links": communities.predict_links,
    }.items():
        r.register(name, function)
    return r


class ProjectionCache:
    """Projections by key and version: a bounded number, each for a limited time."""

    def __init__(self, entries: int = 128, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.entries, self.seconds, self.clock = entries, seconds, clock
        self._held: OrderedDict = OrderedDict()

    def get(self, key: str, version: int, load: Callable[[], tuple]):
        """The (nodes, edges) held for a key, loaded and persisted where it is missing, old or of another version."""
        held = self._held.get(key)
        if held and held[0] == version and self.clock() - held[1] <= self.seconds:
            self._held.move_to_end(key)
            return held[2]
        self.drop(key)
        frames = tuple(f.persist() for f in load())
        self._held[key] = (version, self.clock(), frames)
        while len(self._held) > self.entries:
            self.drop(next(iter(self._held)))
        return frames

    def drop(self, key: str) -> None:
        for f in (self._held.pop(key, None) or (0, 0, ()))[2]:
            f.unpersist()
