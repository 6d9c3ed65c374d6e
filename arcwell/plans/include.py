"""Loading related nodes with each root, as one plan bottom-up."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcwell.plans.model import GraphModel
from arcwell.plans.query import Entity, Graph


@dataclass(frozen=True)
class Include:
    """What to load over an edge type.

    Applied in this order: edge filter, edge order, related filter, related order,
    skip, take; the related order wins and the edge order breaks its ties.
    """

    name: str
    edge: str
    outgoing: bool = True
    where: object = None
    where_edge: object = None
    order: tuple[tuple[str, bool], ...] = ()
    edge_order: tuple[tuple[str, bool], ...] = ()
    skip: int = 0
    take: int | None = None
    with_edges: bool = False
    reference: bool = False
    then: tuple[Include, ...] = field(default=())


def of_relationship(model: GraphModel, owner: str, name: str, **options) -> Include:
    """An include over a relationship that the model declares for a node type."""
    r = model.relationships.get((owner, name))
    if r is None:
        raise ValueError(f"{owner} has no relationship {name}")
    return Include(r.name, r.edge, r.outgoing, reference=not r.many, **options)


def load_relationships(graph: Graph, model: GraphModel, roots: DataFrame, node: str, *names: str) -> DataFrame:
    """``roots`` with a column for each relationship, by name."""
    return load(graph, roots, node, tuple(of_relationship(model, node, n) for n in names))


def related_rows(graph: Graph, roots: DataFrame, node: str, inc: Include) -> DataFrame:
    """(owner, rank, node, edge): what an include finds, as rows instead of arrays, so an owner may have any number."""
    rows, here = _ranked(graph, roots, node, inc)
    last = 1 if inc.reference else inc.take
    if last is not None:
        rows = rows.filter(F.col("__rank") <= inc.skip + last)
    return rows.select(F.col(f"edge.{here}").alias("owner"), (F.col("__rank") - inc.skip).alias("rank"), "node", "edge")


def _ranked(graph: Graph, roots: DataFrame, node: str, inc: Include) -> tuple[DataFrame, str]:
    e = graph.edges[inc.edge]
    if node != (e.source if inc.outgoing else e.target):
        raise ValueError(f"{inc.edge} doesn't belong to {node}")
    here, there = ("from_id", "to_id") if inc.outgoing else ("to_id", "from_id")
    target = e.target if inc.outgoing else e.source
    edges = e.df.select(F.struct("*").alias("edge"))
    if inc.where_edge is not None:
        edges = edges.filter(inc.where_edge(Entity("edge")))
    related = load(graph, graph.nodes[target], target, inc.then).select(F.struct("*").alias("node"))
    if inc.where is not None:
        related = related.filter(inc.where(Entity("node")))
    rows = edges.join(related, F.col(f"edge.{there}") == F.col("node.id"))
    rows = rows.join(roots.select(F.col("id").alias("__owner")).distinct(), F.col(f"edge.{here}") == F.col("__owner"), "left_semi")
    keys = [F.col(f"node.{c}").desc() if d else F.col(f"node.{c}").asc() for c, d in inc.order]
    keys += [F.col(f"edge.{c}").desc() if d else F.col(f"edge.{c}").asc() for c, d in inc.edge_order]
    rank = F.row_number().over(Window.partitionBy(f"edge.{here}").orderBy(*keys, F.col("node.id"), F.col("edge.id")))
    rows = rows.withColumn("__rank", rank).filter(F.col("__rank") > inc.skip)
    return rows, here


def load(graph: Graph, roots: DataFrame, node: str, includes: tuple[Include, ...]) -> DataFrame:
    """``roots`` (id, ...) with a column for each include; roots without matches stay.

    A column is an array of related nodes (or of (node, edge) pairs), in order, or
    for a reference the first or null.
    """
    for inc in includes:
        rows, here = _ranked(graph, roots, node, inc)
        last = 1 if inc.reference else inc.take
        if last is not None:
            rows = rows.filter(F.col("__rank") <= inc.skip + last)
        item = F.struct("node", "edge") if inc.with_edges else F.col("node")
        lists = rows.groupBy(F.col(f"edge.{here}").alias("__owner")).agg(F.sort_array(F.collect_list(F.struct("__rank", item.alias("item")))).alias("__items"))
        lists = lists.select("__owner", F.transform("__items", lambda x: x["item"]).alias(inc.name))
        roots = roots.join(lists, F.col("id") == F.col("__owner"), "left").drop("__owner")
        if inc.reference:
            roots = roots.withColumn(inc.name, F.try_element_at(inc.name, F.lit(1)))
        else:
            kind = lists.schema[inc.name].dataType.simpleString()
            roots = roots.withColumn(inc.name, F.coalesce(inc.name, F.array().cast(kind)))
    return roots
