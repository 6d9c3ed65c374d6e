"""Queries over a typed property graph, composed as DataFrame plans.

A query holds rows of one current entity (``node``, or ``edge`` at an edge root),
the edge last traversed, and, where a hop is guarded, the ids passed so far.  Every
step adds to the plan; nothing runs before a terminal operation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Guards of a hop.  The first forbids going straight back to the node before, the
#: second any node that the path has passed.
NO_IMMEDIATE_CYCLE, NO_REVISIT = 1, 2


class Entity:
    """Columns of a node or edge by attribute."""

    def __init__(self, name: str):
        self._name = name

    def __getattr__(self, prop: str) -> Column:
        return F.col(f"{self._name}.{prop}")

    __getitem__ = __getattr__


class Row:
    """Columns of a projected row by attribute."""

    def __getattr__(self, prop: str) -> Column:
        return F.col(prop)

    __getitem__ = __getattr__


@dataclass(frozen=True)
class Edges:
    df: DataFrame
    source: str
    target: str


class Graph:
    """Node DataFrames (id, properties) and edge DataFrames (id, from_id, to_id, properties) by type."""

    def __init__(self, nodes: dict[str, DataFrame], edges: dict[str, Edges]):
        self.nodes, self.edges = nodes, edges

    def set(self, node: str) -> Query:
        return Query(self, self.nodes[node].select(F.struct("*").alias("node")), node)

    def edge_set(self, edge: str) -> Query:
        return Query(self, self.edges[edge].df.select(F.struct("*").alias("edge")), None, edge, edge_root=True)


@dataclass(frozen=True)
class Query:
    graph: Graph
    df: DataFrame
    node: str | None
    edge: str | None = None
    edge_root: bool = False
    projected: bool = False
    distinct_done: bool = False
    orderings: tuple[tuple[str, bool], ...] = ()
    paged: bool = False

    @property
    def _entity(self) -> Entity | Row:
        return Row() if self.projected else Entity("edge" if self.edge_root else "node")

    def _name(self, column: str) -> str:
        return column if self.projected else f"{'edge' if self.edge_root else 'node'}.{column}"

    # Filters and lookups

    def where(self, predicate: Callable[[Entity], Column]) -> Query:
        return replace(self, df=self.df.filter(predicate(self._entity)))

    def where_id(self, value) -> Query:
        return self.where(lambda n: n.id == value)

    def where_ids(self, ids) -> Query:
        """Rows whose id is in a list or in the first column of a DataFrame (a semi join)."""
        if isinstance(ids, DataFrame):
            wanted = ids.select(F.col(ids.columns[0]).alias("__id"))
            return replace(self, df=self.df.join(wanted, F.col(self._name("id")) == F.col("__id"), "left_semi"))
        return self.where(lambda n: n.id.isin(list(dict.fromkeys(ids))))

    def where_key(self, key: str, value) -> Query:
        """By a configured key; the value is taken as the key's type."""
        return self.where(lambda n: n[key] == F.lit(value).cast(self.df.select(F.col(self._name(key))).schema[0].dataType))

    # Traversal

    def _hop(self, edge: str, outgoing: bool, where=None, guard: int = 0) -> Query:
        if self.projected:
            raise ValueError("a projected query can't be traversed")
        if self.edge_root:
            raise ValueError("from an edge go to one of its nodes first")
        e = self.graph.edges[edge]
        if self.node != (e.source if outgoing else e.target):
            raise ValueError(f"{edge} doesn't {'start' if outgoing else 'end'} at {self.node}")
        target = e.target if outgoing else e.source
        here, there = ("from_id", "to_id") if outgoing else ("to_id", "from_id")
        edges = e.df.select(F.struct("*").alias("edge"))
        if where is not None:
            edges = edges.filter(where(Entity("edge")))
        rows = self.df.select(F.col("node").alias("__source"), *[c for c in self.df.columns if c in ("__passed",)])
        passed = F.col("__passed") if "__passed" in rows.columns else F.array()
        key = F.concat(F.lit(f"{self.node}:"), F.col("__source.id").cast("string"))
        rows = rows.withColumn("__passed", F.concat(passed.cast("array<string>"), F.array(key)))
        nodes = self.graph.nodes[target].select(F.struct("*").alias("node"))
        out = rows.join(edges, F.col("__source.id") == F.col(f"edge.{here}")).join(nodes, F.col(f"edge.{there}") == F.col("node.id"))
        new = F.concat(F.lit(f"{target}:"), F.col("node.id").cast("string"))
        if guard & NO_REVISIT:
            out = out.filter(~F.array_contains("__passed", new))
        elif guard & NO_IMMEDIATE_CYCLE:
            out = out.filter((F.size("__passed") < 2) | (F.try_element_at("__passed", F.lit(-2)) != new))
        return replace(self, df=out.select("node", "edge", "__passed"), node=target, edge=edge)

    def outgoing(self, edge: str, where=None, guard: int = 0) -> Query:
        """From each row over its outgoing edges: one row for each path."""
        return self._hop(edge, True, where, guard)

    def incoming(self, edge: str, where=None, guard: int = 0) -> Query:
        return self._hop(edge, False, where, guard)

    then_outgoing, then_incoming = outgoing, incoming

    def outgoing_where(self, edge: str, where) -> Query:
        return self.outgoing(edge, where)

    def incoming_where(self, edge: str, where) -> Query:
        return self.incoming(edge, where)

    def _end(self, source: bool) -> Query:
        if not self.edge_root:
            raise ValueError("only an edge query has ends")
        e = self.graph.edges[self.edge]
        node = e.source if source else e.target
        nodes = self.graph.nodes[node].select(F.struct("*").alias("node"))
        out = self.df.join(nodes, F.col("edge.from_id" if source else "edge.to_id") == F.col("node.id"))
        return replace(self, df=out.select("node", "edge"), node=node, edge_root=False)

    def from_node(self) -> Query:
        return self._end(True)

    def to_node(self) -> Query:
        return self._end(False)

    def path(self, path: Path) -> Query:
        if path.root != self.node:
            raise ValueError(f"the path starts at {path.root}, not {self.node}")
        out = self
        for step in path.steps:
            out = out._hop(*step)
        return replace(out, df=out.df.dropDuplicates(["node"])) if path.distinct else out

    # Projection

    def select(self, **columns: Callable[[Entity], Column] | str) -> Query:
        """Properties by name, or expressions of the current entity."""
        if self.projected:
            raise ValueError("a query has one projection")
        cols = [(F.col(self._name(c)) if isinstance(c, str) else c(self._entity)).alias(name) for name, c in columns.items()]
        return replace(self, df=self.df.select(*cols), projected=True, orderings=()) if not self.orderings else self._ordered_select(cols)

    def _ordered_select(self, cols: list[Column]) -> Query:
        keys = [F.col(c).alias(f"__order{i}") for i, (c, _) in enumerate(self.orderings)]
        return replace(self, df=self.df.select(*cols, *keys), projected=True, orderings=tuple((f"__order{i}", d) for i, (_, d) in enumerate(self.orderings)))

    def select_with_edge(self, **columns: Callable[[Entity, Entity], Column]) -> Query:
        """Expressions of the current node and the edge last traversed."""
        if self.edge is None:
            raise ValueError("no edge was traversed")
        if self.projected:
            raise ValueError("a query has one projection")
        return replace(self, df=self.df.select(*[c(Entity("node"), Entity("edge")).alias(n) for n, c in columns.items()]), projected=True)

    # Order, paging, distinct

    def order_by(self, column: str, descending: bool = False) -> Query:
        """Adds a key; nulls come first ascending and last descending."""
        if self.distinct_done:
            raise ValueError("distinct rows can't be ordered")
        return replace(self, orderings=(*self.orderings, (self._name(column), descending)))

    then_by = order_by

    def _sorted(self, reverse: bool = False, default: bool = False) -> DataFrame:
        keys = self.orderings
        if not keys and default:
            keys = ((self.df.columns[0] if self.projected else self._name("id"), False),)
        return self.df.orderBy(*[F.col(c).desc() if d != reverse else F.col(c).asc() for c, d in keys]) if keys else self.df

    def skip(self, n: int) -> Query:
        """In the order given, or else by key (projected rows: by their first column)."""
        if n < 0:
            raise ValueError("skip is 0 or more")
        return replace(self, df=self._sorted(default=True).offset(n), paged=True)

    def take(self, n: int) -> Query:
        if n <= 0:
            raise ValueError("take is 1 or more")
        return replace(self, df=self._sorted().limit(n), paged=True)

    def distinct(self) -> Query:
        if self.orderings or self.distinct_done:
            raise ValueError("distinct comes once and not with an order")
        return replace(self, df=self.df.distinct() if self.projected else self.df.dropDuplicates(["edge" if self.edge_root else "node"]), distinct_done=True)

    # Terminals

    def to_df(self) -> DataFrame:
        """The rows: projected columns, or the current entity's."""
        df = self._sorted()
        return df.select(*[c for c in df.columns if not c.startswith("__")]) if self.projected else df.select(f"{'edge' if self.edge_root else 'node'}.*")

    def to_list(self) -> list:
        return self.to_df().collect()

    def to_set(self) -> set:
        return set(self.to_df().distinct().collect())

    def to_dict(self, key: str, value: str | None = None) -> dict:
        out = {}
        for r in self.to_list():
            if r[key] in out:
                raise ValueError(f"{r[key]!r} comes twice")
            out[r[key]] = r[value] if value else r
        return out

    def count(self, where=None) -> int:
        return (self.where(where) if where else self).df.count()

    def any(self, where=None) -> bool:
        return not (self.where(where) if where else self).df.isEmpty()

    def all(self, where) -> bool:
        """No row for which the predicate is false; null counts as satisfied."""
        return not self.any(lambda n: ~where(n))

    def contains_id(self, value) -> bool:
        return self.where_id(value).any()

    def first(self, where=None, default=LookupError):
        return self._at_most((self.where(where) if where else self), 1, default)

    def single(self, where=None, default=LookupError):
        q = self.where(where) if where else self
        rows = replace(q, df=q._sorted().limit(2), orderings=()).to_list()
        if len(rows) > 1:
            raise ValueError("more than one row")
        return rows[0] if rows else self._none(default)

    def last(self, where=None, default=LookupError):
        """The first in reverse order; without an order by key, the largest."""
        q = self.where(where) if where else self
        keys = q.orderings or ((q.df.columns[0] if q.projected else q._name("id"), False),)
        q = replace(q, orderings=tuple((c, not d) for c, d in keys))
        return self._at_most(q, 1, default)

    def last_df(self) -> DataFrame:
        keys = self.orderings or ((self.df.columns[0] if self.projected else self._name("id"), False),)
        q = replace(self, orderings=tuple((c, not d) for c, d in keys))
        return replace(q, df=q._sorted().limit(1)).to_df()

    def element_at(self, i: int, default=LookupError):
        return self._at_most(self.skip(i), 1, default)

    def _at_most(self, q: Query, n: int, default):
        rows = q.take(n).to_list()
        return rows[0] if rows else self._none(default)

    @staticmethod
    def _none(default):
        if default is LookupError:
            raise LookupError("no rows")
        return default

    def aggregate(self, column: str) -> DataFrame:
        """One row: sum (0 for none), average, min and max of a column."""
        c = F.col(self._name(column))
        return self.df.agg(F.coalesce(F.sum(c), F.lit(0)).alias("sum"), F.avg(c).alias("average"), F.min(c).alias("min"), F.max(c).alias("max"))

    def sum(self, column: str):
        return self.aggregate(column).first()["sum"]

    def _needed(self, column: str, what: str):
        found = self.aggregate(column).first()[what]
        if found is None:
            raise LookupError(f"no rows to take the {what} of")
        return found

    def average(self, column: str):
        return self._needed(column, "average")

    def min(self, column: str):
        return self._needed(column, "min")

    def max(self, column: str):
        return self._needed(column, "max")

    def explain(self) -> str:
        return self.to_df()._jdf.queryExecution().toString()


@dataclass(frozen=True)
class Path:
    """A reusable path of hops: (edge, outgoing, edge predicate, guard)."""

    root: str
    steps: tuple[tuple, ...] = ()
    distinct: bool = False

    def outgoing(self, edge: str, where=None) -> Path:
        return replace(self, steps=(*self.steps, (edge, True, where, 0)))

    def incoming(self, edge: str, where=None) -> Path:
        return replace(self, steps=(*self.steps, (edge, False, where, 0)))

    def repeat_outgoing(self, edge: str, times: int, where=None) -> Path:
        return self._repeat(edge, True, times, where)

    def repeat_incoming(self, edge: str, times: int, where=None) -> Path:
        return self._repeat(edge, False, times, where)

    def _repeat(self, edge: str, outgoing: bool, times: int, where) -> Path:
        if times < 1:
            raise ValueError("a hop is repeated once or more")
        return replace(self, steps=self.steps + ((edge, outgoing, where, 0),) * times)

    def guarded(self, guard: int) -> Path:
        """Guards the last hop."""
        if not self.steps:
            raise ValueError("an empty path has no hop to guard")
        *head, (edge, outgoing, where, had) = self.steps
        return replace(self, steps=(*head, (edge, outgoing, where, had | guard)))

    def distinct_results(self) -> Path:
        return replace(self, distinct=True)
