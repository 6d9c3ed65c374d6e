"""Statistics, components and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcwell.scratch import cut


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, isolated nodes, edges without an end."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    known = nodes.select("id").distinct()
    ends = edges.select("from_id").union(edges.select("to_id")).distinct()
    isolated = known.join(ends, F.col("id") == F.col("from_id"), "left_anti").agg(F.count(F.lit(1)).alias("isolated"))
    orphans = edges.join(known.select(F.col("id").alias("a")), F.col("from_id") == F.col("a"), "left").join(known.select(F.col("id").alias("b")), F.col("to_id") == F.col("b"), "left")
    e = orphans.agg(F.count(F.lit(1)).alias("all"), F.sum((F.col("a").isNull() | F.col("b").isNull()).cast("long")).alias("orphans"))
    both = n.crossJoin(F.broadcast(isolated)).crossJoin(F.broadcast(e))  # one row each
    kept = F.col("all") - F.coalesce("orphans", F.lit(0))
    density = F.when(F.col("nodes") < 2, 0.0).otherwise(kept / (F.col("nodes") * (F.col("nodes") - 1.0)))
    return both.select("nodes", kept.alias("edges"), density.alias("density"), "isolated", F.coalesce("orphans", F.lit(0)).alias("orphans"))


def _settle(labels: DataFrame, links: DataFrame, limit: int = 10_000) -> DataFrame:
    """(id, label, of labels (id, label)) with the least label that reaches each node over links (a, b).

    A label is a struct whose field ``id`` names the node it comes from.  What reaches that
    node reaches all that have its label, so a round takes the label's own label as well.
    """
    for _ in range(limit):
        told = links.join(labels, F.col("a") == F.col("id")).groupBy("b").agg(F.min("label").alias("heard"))
        near = labels.join(told, F.col("id") == F.col("b"), "left").select("id", F.least("label", F.coalesce("heard", "label")).alias("label"), F.col("label").alias("was"))
        near = cut(near)
        if near.filter("label < was").isEmpty():
            return near.select("id", "label")
        jump = near.select(F.col("id").alias("j"), F.col("label").alias("further"))
        labels = cut(near.join(jump, F.col("label.id") == F.col("j"), "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label")))
    raise RuntimeError("labels did not settle")


def weak_components(nodes: DataFrame, edges: DataFrame, limit: int = 10_000) -> DataFrame:
    """(id, component): the smallest id of each node's component.

    Each round tells labels to neighbours and then takes the label's own label, so
    long paths take few rounds.
    """
    links = edges.filter("from_id <> to_id").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    links = cut(links.union(links.select("b", "a")).distinct())
    labels = nodes.select("id", F.col("id").alias("label"))
    for _ in range(limit):
        told = links.join(labels, F.col("a") == F.col("id")).groupBy("b").agg(F.min("label").alias("heard"))
        near = cut(labels.join(told, F.col("id") == F.col("b"), "left").select("id", F.least("label", F.coalesce("heard", "label")).alias("label"), F.col("label").alias("was")))
        if near.filter("label < was").isEmpty():
            return near.select("id", F.col("label").alias("component"))
        jump = near.select(F.col("id").alias("j"), F.col("label").alias("further"))
        labels = cut(near.join(jump, F.col("label") == F.col("j"), "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label")))
    raise RuntimeError("components did not settle")


def component_sizes(members: DataFrame) -> DataFrame:
    """Components by falling size, then smallest id, numbered from 0: position, component, size."""
    from arcwell.operators.centrality import ranked

    sizes = members.groupBy(F.col("component").alias("id")).agg(F.count(F.lit(1)).alias("size"))
    return ranked(sizes, "size").select(F.col("id").alias("component"), "size", F.col("rank").alias("position"))


def strong_components(nodes: DataFrame, edges: DataFrame, limit: int = 200) -> DataFrame:
    """(id, component): the smallest id of each node's strongly connected component.

    A round draws an order of the nodes.  Each node takes the first node that reaches it and
    the first that it reaches; a pair of these is a class that no component crosses, and where
    both are one node, the class is a component.  What is left goes on with links inside classes
    only, without nodes that have no link in or out.  As the order is drawn anew, classes fall
    apart by halves: a path of n nodes takes about log2(n) rounds, not n.
    """
    left = cut(nodes.select("id").distinct())
    links = cut(edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).filter("a <> b").distinct())
    done: list[DataFrame] = []
    for turn in range(limit):
        for _ in range(2):
            inner = left.join(links.select(F.col("a").alias("id")), "id", "left_semi").join(links.select(F.col("b").alias("id")), "id", "left_semi")
            inner = cut(inner)
            done.append(left.join(inner, "id", "left_anti").select("id", F.col("id").alias("component")))
            left = inner
            links = cut(links.join(left.select(F.col("id").alias("a")), "a", "left_semi").join(left.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b"))
        if left.isEmpty():
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return out
        drawn = left.select("id", F.struct(F.xxhash64("id", F.lit(turn)).alias("order"), "id").alias("label"))
        from_, to = _settle(drawn, links), _settle(drawn, links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        classes = cut(from_.select("id", F.col("label.id").alias("f")).join(to.select("id", F.col("label.id").alias("t")), "id"))
        found = classes.filter("f = t")
        done.append(cut(found.join(found.groupBy("f").agg(F.min("id").alias("component")), "f").select("id", "component")))
        left = cut(classes.filter("f <> t").select("id"))
        ends = links.join(classes.select(F.col("id").alias("a"), F.struct("f", "t").alias("x")), "a").join(classes.select(F.col("id").alias("b"), F.struct("f", "t").alias("y")), "b")
        links = cut(ends.filter("x = y and x.f <> x.t").select("a", "b"))
    raise RuntimeError("components did not settle")


def _cycles_of(edges: DataFrame, longest: int, enough: int) -> tuple[DataFrame | None, bool]:
    """Cycles (start, path, edges) by length; stops at the length that passes ``enough``."""
    e = cut(edges.select(F.col("id").alias("e"), F.col("from_id").alias("a"), F.col("to_id").alias("b")))
    paths = e.select(F.col("a").alias("start"), F.col("b").alias("last"), F.array("a").alias("path"), F.array("e").alias("edges")).filter("last >= start")
    out, total = None, 0
    for length in range(1, longest + 1):
        paths = cut(paths)
        found = cut(paths.filter("last = start").select("start", "path", "edges"))
        total += found.count()
        out = found if out is None else out.unionByName(found)
        if total > enough or length == longest:
            return out, total > enough
        # A cycle starts at its smallest id, so a path never goes below its start.
        step = paths.filter("last > start").join(e, F.col("last") == F.col("a")).filter("b >= start").filter(~F.array_contains(F.slice("path", 2, longest), F.col("b")))
        paths = step.select("start", F.col("b").alias("last"), F.concat("path", F.array("a")).alias("path"), F.concat("edges", F.array("e")).alias("edges"))
        if step.isEmpty():
            return out, False
    return out, False


def cycles(nodes: DataFrame, edges: DataFrame, max_length: int = 100, max_cycles: int = 1000) -> tuple[DataFrame, bool]:
    """Simple directed cycles (start, path, edges) and whether there are more than returned.

    A cycle starts at its smallest id; parallel edges make different cycles, a self-loop
    is one of length 1.  They are found by length, shorter ones first, and the search ends with the
    length at which there are more than ``max_cycles``.
    """
    parts = strong_components(nodes, edges)
    a, b = parts.select(F.col("id").alias("from_id"), F.col("component").alias("x")), parts.select(F.col("id").alias("to_id"), F.col("component").alias("y"))
    inside = cut(edges.join(a, "from_id").join(b, "to_id").filter("x = y").select("id", "from_id", "to_id"))
    longest = min(max_length, max(1, inside.select("from_id").distinct().count()))
    found, more = _cycles_of(inside, longest, max_cycles)
    ordered = found.orderBy(F.size("path"), F.col("path").cast("string"), F.col("edges").cast("string")).limit(max_cycles)
    return ordered, more
