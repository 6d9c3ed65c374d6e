"""Shortest, alternative and multi-criteria routes.

Searches between two nodes run on the driver over what such routes can use.  A graph of
up to ``LOCAL`` pairs of nodes goes there whole; of a larger one the least costs from the
start and to the goal are computed distributed, and only edges on routes up to a bound
are collected.  The bound rises until it holds the answer, so nothing is left out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwell.operators.centrality import MAX_KERNEL_EDGES, adjacency
from arcwell.scratch import cut

#: Pairs of nodes up to which a graph is searched on the driver as it is.
LOCAL = 1_000_000
#: A route as it is ordered: cost, edges, ids as text, ids.
Route = tuple[float, int, str, tuple[int, ...]]


def _costs(edges: DataFrame, weight: str | None) -> DataFrame:
    """(a, b, c): the cheapest edge of each pair; ValueError on a negative or infinite weight."""
    c = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = cut(edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), c.alias("c")).groupBy("a", "b").agg(F.min("c").alias("c")))
    if not e.filter((F.col("c") < 0) | F.isnan("c") | (F.col("c") == math.inf)).isEmpty():
        raise ValueError("a weight is negative or not finite")
    return e


def shortest_costs(edges: DataFrame, starts: DataFrame, weight: str | None = None, limit: int = 100_000) -> DataFrame:
    """(start, id, cost) of all nodes that the start ids reach; weights are finite and at least 0."""
    return _settled(_costs(edges, weight), starts, limit)


def _settled(e: DataFrame, starts: DataFrame, limit: int = 100_000) -> DataFrame:
    """Only nodes whose cost fell in a round go on in the next; what a round found is written once."""
    best = front = cut(starts.select(F.col("id").alias("start"), "id", F.lit(0.0).alias("cost")))
    fronts = [front]
    for _ in range(limit):
        new = front.join(e, F.col("id") == F.col("a")).groupBy("start", F.col("b").alias("id")).agg(F.min(F.col("cost") + F.col("c")).alias("cost"))
        front = cut(new.join(best.withColumnRenamed("cost", "had"), ["start", "id"], "left").filter("had is null or cost < had").select("start", "id", "cost"))
        if front.isEmpty():
            return best
        fronts.append(front)
        if len(fronts) == 8:  # so that no round reads more than a few tables
            fronts = [cut(_least(fronts))]
        best = _least(fronts)
    raise RuntimeError("costs did not settle")


def _least(fronts: list[DataFrame]) -> DataFrame:
    out = fronts[0]
    for f in fronts[1:]:
        out = out.unionByName(f)
    return out.groupBy("start", "id").agg(F.min("cost").alias("cost"))


def _adjacent(e: DataFrame) -> dict[int, dict[int, float]]:
    rows = e.select("a", "b", "c").limit(MAX_KERNEL_EDGES + 1).toArrow().to_pydict()
    if len(rows["a"]) > MAX_KERNEL_EDGES:
        raise ValueError("too many edges for a kernel")
    out: dict[int, dict[int, float]] = {}
    for a, b, c in zip(rows["a"], rows["b"], rows["c"], strict=True):
        out.setdefault(a, {})[b] = c
    return out


def _graphs(edges: DataFrame, start: int, goal: int, weight: str | None, local: int) -> Iterator[tuple[dict[int, dict[int, float]], float]]:
    """Adjacencies, and the cost up to which each holds all routes; the last one holds every route."""
    e = _costs(edges, weight)
    if e.limit(local + 1).count() <= local:
        yield _adjacent(e), math.inf
        return
    one = lambda v: e.sparkSession.createDataFrame([(v,)], "id long")
    there = _settled(e, one(start)).select(F.col("id").alias("a"), F.col("cost").alias("there"))
    back = _settled(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"), one(goal)).select(F.col("id").alias("b"), F.col("cost").alias("back"))
    through = cut(e.join(there, "a").join(back, "b").select("a", "b", "c", (F.col("there") + F.col("c") + F.col("back")).alias("total")))
    low, high = through.agg(F.min("total"), F.max("total")).first()
    bound = 0.0 if low is None else low * 1.1
    while low is not None and bound < high:
        yield _adjacent(through.filter(F.col("total") <= bound * (1 + 1e-9))), bound
        bound = max(bound * 1.5, through.filter(F.col("total") > bound).agg(F.min("total")).first()[0])
    yield _adjacent(through), math.inf


def _cheapest(adj: dict[int, dict[int, float]], start: int, goal: int, without: set[int] = frozenset(), not_first: set[int] = frozenset()) -> Route | None:
    """The first route in order that passes none of ``without`` and whose second node isn't in ``not_first``."""
    heap: list[Route] = [(0.0, 0, str(start), (start,))]
    done = set(without)
    while heap:
        cost, hops, text, path = heapq.heappop(heap)
        v = path[-1]
        if v == goal:
            return cost, hops, text, path
        if v in done:
            continue
        done.add(v)
        for w, c in adj.get(v, {}).items():
            if w not in done and not (hops == 0 and w in not_first):
                heapq.heappush(heap, (cost + c, hops + 1, f"{text},{w}", (*path, w)))
    return None


def _yen(adj: dict[int, dict[int, float]], start: int, goal: int, k: int) -> list[Route]:
    """The k first loopless routes in order: each new one leaves an earlier one at some node."""
    first = _cheapest(adj, start, goal)
    found, heap, seen = [first] if first else [], [], {first[3]} if first else set()
    while found and len(found) < k:
        path = found[-1][3]
        for i in range(len(path) - 1):
            root = path[: i + 1]
            taken = {p[i + 1] for *_, p in found if p[: i + 1] == root}
            spur = _cheapest(adj, path[i], goal, set(path[:i]), taken)
            if spur and (whole := (*root, *spur[3][1:])) not in seen:
                seen.add(whole)
                heapq.heappush(heap, (sum(adj[a][b] for a, b in zip(whole, whole[1:], strict=False)), len(whole) - 1, ",".join(map(str, whole)), whole))
        if not heap:
            break
        found.append(heapq.heappop(heap))
    return found


def _first_routes(edges: DataFrame, start: int, goal: int, k: int, weight: str | None, local: int) -> list[Route]:
    if start == goal:
        return [(0.0, 0, str(start), (start,))]
    found: list[Route] = []
    for adj, bound in _graphs(edges, start, goal, weight, local):
        found = _yen(adj, start, goal, k)
        if len(found) == k and found[-1][0] <= bound:
            break
    return found


def a_star(edges: DataFrame, start: int, goal: int, weight: str | None = None, heuristic: Callable[[int], float] = lambda n: 0.0) -> tuple[list[int] | None, float, int]:
    """Path, cost and number of nodes explored, on the driver; nodes may be opened again."""
    adj = adjacency(edges, weight)
    best, via, heap, explored = {start: 0.0}, {}, [(heuristic(start), 0.0, start)], 0
    while heap:
        _, cost, v = heapq.heappop(heap)
        if cost > best[v]:
            continue
        explored += 1
        if v == goal:
            path = [v]
            while path[-1] in via and path[-1] != start:
                path.append(via[path[-1]])
            return path[::-1], cost, explored
        for w, c in adj.get(v, ()):
            if c < 0 or not math.isfinite(c):
                raise ValueError("a weight is negative or not finite")
            if cost + c < best.get(w, math.inf):
                best[w], via[w] = cost + c, v
                if (h := heuristic(w)) < 0:
                    raise ValueError("an estimate is negative")
                heapq.heappush(heap, (cost + c + h, cost + c, w))
    return None, math.inf, explored


def shortest_path(edges: DataFrame, start: int, goal: int, weight: str | None = None, local: int = LOCAL) -> tuple[list[int] | None, float]:
    """The cheapest path and its cost; of equal ones that of fewest edges, then the first as text."""
    found = _first_routes(edges, start, goal, 1, weight, local)
    return (list(found[0][3]), found[0][0]) if found else (None, math.inf)


def k_shortest(edges: DataFrame, start: int, goal: int, k: int = 10, weight: str | None = None, local: int = LOCAL) -> DataFrame:
    """The k cheapest loopless paths of any length: rank, path, cost, exhausted.

    Ties go to fewer edges, then to the path as text; of parallel edges the cheapest
    counts.  ``exhausted`` says that there are fewer than k.
    """
    found = _first_routes(edges, start, goal, k, weight, local)
    rows = [(i, list(r[3]), r[0], len(found) < k) for i, r in enumerate(found, 1)]
    return edges.sparkSession.createDataFrame(rows, "rank int, path array<long>, cost double, exhausted boolean")


def _between(edges: DataFrame, start: int, goal: int) -> DataFrame:
    """The edges that lie on some way from the start to the goal."""
    one = lambda v: edges.sparkSession.createDataFrame([(v,)], "id long")
    turned = edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    there, back = shortest_costs(edges, one(start)).select(F.col("id").alias("from_id")), shortest_costs(turned, one(goal)).select(F.col("id").alias("to_id"))
    return edges.join(there, "from_id", "left_semi").join(back, "to_id", "left_semi")


def _labels(adj: dict[int, list[tuple[int, tuple[float, ...]]]], start: int, goal: int, n: int, most: int) -> tuple[list[tuple[tuple[float, ...], str]], bool]:
    """(criteria, path) that nothing beats, and whether ``most`` labels were not enough."""
    heap: list = [((0.0,) * n, str(start), (start,))]
    done: dict[int, list[tuple[float, ...]]] = {}
    beaten = lambda v, x: any(all(p <= q for p, q in zip(y, x, strict=True)) for y in done.get(v, ()))
    found, made = [], 0
    while heap:
        x, text, path = heapq.heappop(heap)
        v = path[-1]
        if beaten(v, x) or beaten(goal, x):
            continue
        done.setdefault(v, []).append(x)
        if v == goal:
            found.append((x, text))
            continue
        for w, y in adj.get(v, ()):
            z = tuple(p + q for p, q in zip(x, y, strict=True))
            if w not in path and not beaten(w, z) and not beaten(goal, z):
                heapq.heappush(heap, (z, f"{text},{w}", (*path, w)))
                made += 1
        if made > most:
            return found, True
    return found, False


def pareto_routes(
    edges: DataFrame, start: int, goal: int, criteria: tuple[str, ...], weights: dict[str, float] | None = None, limit: int | None = 20, max_labels: int = 1_000_000, local: int = LOCAL
) -> DataFrame:
    """Loopless paths that no other beats in all criteria (lower is better): rank, path, criteria, loss, truncated.

    Labels are settled in the order of their criteria, so what is settled is never beaten
    later.  Of paths with equal criteria the smallest as text counts.  Ranked by the
    weighted mean of what each criterion loses against the best, scaled to the worst.
    ``truncated`` says that ``max_labels`` labels were made before all was searched.
    """
    e = edges.select("from_id", "to_id", *[F.col(c).cast("double").alias(c) for c in criteria]).distinct()
    if e.limit(local + 1).count() > local:
        e = _between(e, start, goal)
    rows = e.limit(MAX_KERNEL_EDGES + 1).toArrow().to_pylist()
    if len(rows) > MAX_KERNEL_EDGES:
        raise ValueError("too many edges for a kernel")
    adj: dict[int, list[tuple[int, tuple[float, ...]]]] = {}
    for r in rows:
        x = tuple(r[c] for c in criteria)
        if not all(y is not None and 0 <= y < math.inf for y in x):
            raise ValueError("a criterion is negative or not finite")
        adj.setdefault(r["from_id"], []).append((r["to_id"], x))
    found, truncated = _labels(adj, start, goal, len(criteria), max_labels)
    low, high = ([f(x[i] for x, _ in found) for i in range(len(criteria))] if found else [] for f in (min, max))
    share = [(weights or {}).get(c, 1.0) for c in criteria]
    loss = lambda x: sum(w * (v - a) / (b - a) if b > a else 0.0 for v, w, a, b in zip(x, share, low, high, strict=True)) / sum(share)
    best = sorted((loss(x), text, x) for x, text in found)[:limit]
    schema = ", ".join(["rank int", "path string", *[f"{c} double" for c in criteria], "loss double", "truncated boolean"])
    return edges.sparkSession.createDataFrame([(i, text, *x, lost, truncated) for i, (lost, text, x) in enumerate(best, 1)], schema)


def impact_reroute(edges: DataFrame, start: int, goal: int, failed_nodes: list[int], failed_edges: list[int], k: int = 3, weight: str | None = None, local: int = LOCAL) -> DataFrame:
    """Alternatives without what failed, against the best path with it: rank, path, cost, exhausted, cost_delta, hop_delta."""
    path, cost = shortest_path(edges, start, goal, weight, local)
    rest = edges.filter(~F.col("from_id").isin(failed_nodes) & ~F.col("to_id").isin(failed_nodes)) if failed_nodes else edges
    rest = rest.filter(~F.col("id").isin(failed_edges)) if failed_edges else rest
    left = k_shortest(rest, start, goal, k, weight, local)
    lost = (F.col("cost") - cost, F.size("path") - len(path)) if path else (F.lit(None).cast("double"), F.lit(None).cast("int"))
    return left.select("rank", "path", "cost", "exhausted", lost[0].alias("cost_delta"), lost[1].alias("hop_delta"))
