"""Communities, their measures, and link prediction."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcwell.operators import moving
from arcwell.scratch import cut

#: Edges, and nodes, that are moved one at a time on the driver.
DRIVER_EDGES = 250_000


def _move(adj: dict, out: dict, inn: dict, total: float, resolution: float, rng: random.Random) -> dict:
    """Moves single nodes to the neighbouring community of most gain until none gains."""
    home = {v: v for v in adj}
    c_out, c_in = dict(out), dict(inn)
    order = sorted(adj)
    rng.shuffle(order)
    moved = True
    while moved:
        moved = False
        for v in order:
            near: dict = defaultdict(float)
            for w, x in adj[v].items():
                if w != v:
                    near[home[w]] += x
            old = home[v]
            c_out[old] -= out[v]
            c_in[old] -= inn[v]
            gain = lambda c: near.get(c, 0.0) - resolution * (out[v] * c_in[c] + inn[v] * c_out[c]) / total  # noqa: E731, B023
            best = max(sorted({old, *near}), key=lambda c: (gain(c), c == old))
            if gain(best) <= gain(old) + 1e-12:
                best = old
            home[v] = best
            c_out[best] += out[v]
            c_in[best] += inn[v]
            moved |= best != old
    return home


def _connected(home: dict, adj: dict) -> dict:
    """Communities split into their connected parts, each named by its smallest node."""
    out: dict = {}
    for v in sorted(home):
        if v in out:
            continue
        stack = [v]
        out[v] = v
        while stack:
            u = stack.pop()
            for w in adj[u]:
                if w not in out and home[w] == home[v]:
                    out[w] = v
                    stack.append(w)
    return out


def _levels(names: list, arcs: list, resolution: float, seed: int, levels: int) -> dict:
    """The community of each name, by its first: moves, splitting and aggregation over arcs (a, b, weight)."""
    part = {v: v for v in names}
    total = sum(w for _, _, w in arcs)
    rng = random.Random(seed)
    for _ in range(levels if total else 0):
        names = sorted(set(part.values()))
        adj: dict = {v: defaultdict(float) for v in names}
        out, inn = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
        for a, b, w in arcs:
            a, b = part[a], part[b]
            adj[a][b] += w
            adj[b][a] += w
            out[a] += w
            inn[b] += w
        home = _connected(_move(adj, out, inn, total, resolution, rng), adj)
        if all(home[v] == v for v in names):
            break
        part = {v: home[c] for v, c in part.items()}
    return part


def communities(nodes: DataFrame, edges: DataFrame, weight: str | None = None, resolution: float = 1.0, seed: int = 42, levels: int = 20) -> DataFrame:
    """(id, community): local moves, splitting of what isn't connected, and aggregation, by level.

    Modularity is the directed one.  Deterministic for a seed; communities are
    connected and numbered by their first node.  Up to ``DRIVER_EDGES`` edges and as many
    nodes are moved one at a time on the driver; the levels of larger graphs before that move
    nodes in parallel (see ``moving``), with any number of edges.  Beyond ``moving.MAX_NODES``
    nodes, ValueError.
    """
    arcs = cut(edges.groupBy("from_id", "to_id").agg(F.sum(F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")))
    ids, arcs = moving.numbered(nodes, arcs)
    group, arcs, levels = moving.moved(arcs, len(ids), resolution, seed, levels, DRIVER_EDGES)
    if levels:
        rows = sorted(zip(*(c.to_pylist() for c in arcs.toArrow().columns), strict=True))
        part = _levels(list(range(int(group.max(initial=-1)) + 1)), rows, resolution, seed, levels)
        group = np.array([part[c] for c in range(len(part))], np.int32)[group]
    return moving.told_apart(nodes, ids, group)


def modularity(members: DataFrame, edges: DataFrame, weight: str | None = None, resolution: float = 1.0) -> DataFrame:
    """One row: the directed modularity of a partition (id, community)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = _labelled(members, edges, w)
    total = e.agg(F.sum("w").alias("total"))
    outs = e.groupBy(F.col("ca").alias("c")).agg(F.sum("w").alias("o"))
    ins = e.groupBy(F.col("cb").alias("c")).agg(F.sum("w").alias("i"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    by = outs.join(ins, "c", "full_outer").na.fill(0.0).crossJoin(F.broadcast(total))  # one row
    return by.agg(F.sum(F.col("inside") / F.col("total") - resolution * F.col("o") * F.col("i") / (F.col("total") * F.col("total"))).alias("modularity"))


def _labelled(members: DataFrame, edges: DataFrame, w) -> DataFrame:
    a = members.select(F.col("id").alias("a"), F.col("community").alias("ca"))
    b = members.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    return edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), w.alias("w")).join(a, "a").join(b, "b")


def community_metrics(members: DataFrame, edges: DataFrame, weight: str | None = None) -> DataFrame:
    """By community: size, internal and boundary weight, density, conductance, bridge nodes."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = _labelled(members, edges, w)
    total = e.agg(F.sum("w").alias("total"))
    ends = e.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("a").alias("v"), F.col("cb").alias("o"), F.lit(True).alias("out")), F.struct(F.col("cb").alias("c"), F.col("b").alias("v"), F.col("ca").alias("o"), F.lit(False).alias("out")))).alias("x"), "w").select("x.*", "w")
    crosses = F.col("c") != F.col("o")
    by = ends.groupBy("c").agg(
        F.sum(F.when(~crosses & F.col("out"), F.col("w")).otherwise(0.0)).alias("internal"), F.sum(F.when(crosses, F.col("w")).otherwise(0.0)).alias("boundary"),
        F.sum((~crosses & F.col("out") & F.lit(True)).cast("long")).alias("internal_edges"), F.count_distinct(F.when(crosses, F.col("v"))).alias("bridge_nodes"),
    )
    sizes = members.groupBy(F.col("community").alias("c")).agg(F.count(F.lit(1)).alias("size"))
    out = sizes.join(by, "c", "left").na.fill(0).crossJoin(F.broadcast(total))  # one row
    volume = 2 * F.col("internal") + F.col("boundary")
    rest = 2 * F.coalesce("total", F.lit(0.0)) - volume
    smaller = F.least(volume, rest)
    return out.select(
        F.col("c").alias("community"), "size", "internal", "boundary", F.when(F.col("size") > 1, F.col("internal_edges") / (F.col("size") * (F.col("size") - 1.0))).otherwise(0.0).alias("density"),
        F.when(smaller > 0, F.col("boundary") / smaller).otherwise(0.0).alias("conductance"), "bridge_nodes",
    )


class CandidateLimit(ValueError):
    """More candidate pairs than allowed."""


def _alike(links: DataFrame, members: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(v, r) of all v of links (v, u), and (r, d, size, second, community) of nodes that are alike.

    These have the same u, told apart by two hashes of 64 bits, and the same community; r and
    second are the smallest two.
    """
    each = links.groupBy("v").agg(F.count(F.lit(1)).alias("d"), F.bit_xor(F.xxhash64("u")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "u")).alias("y"))
    if members is None:
        each = each.withColumn("community", F.lit(None).cast("long"))
    else:
        each = each.join(members.select(F.col("id").alias("v"), "community"), "v", "left")
    key = ["d", "x", "y", "community"]
    least = each.groupBy(*key).agg(F.min("v").alias("r")).select(F.col("r"), *[F.col(k).alias(f"k_{k}") for k in key])
    named = cut(each.join(least, F.col("d").eqNullSafe(F.col("k_d")) & (F.col("x") == F.col("k_x")) & (F.col("y") == F.col("k_y")) & F.col("community").eqNullSafe(F.col("k_community"))).select("v", "r", "d", "community"))
    kinds = named.groupBy("r").agg(F.first("d").alias("d"), F.count(F.lit(1)).alias("size"), F.min(F.when(F.col("v") > F.col("r"), F.col("v"))).alias("second"), F.first("community").alias("community"))
    return named.select("v", "r"), cut(kinds)


def predict_links(
    nodes: DataFrame, edges: DataFrame, members: DataFrame | None = None, min_common: int = 1, limit: int = 100, weights: tuple[float, ...] = (1.0, 1.5, 1.5, 0.25, 1.0),
    directed: bool = False, scope: str = "all", max_pairs: int | None = None, min_confidence: float = 0.0,
) -> DataFrame:
    """The likeliest missing links (a, b): common neighbours, Jaccard, Adamic-Adar, attachment, affinity.

    Candidates have at least ``min_common`` (1 or more) common neighbours and no link; undirected
    ones a < b and no link either way, directed ones what a leads to and what leads to b in
    common.  With ``members`` (id, community), ``scope`` same or across keeps pairs within or
    between communities.  Beyond ``max_pairs`` candidates ``CandidateLimit`` is raised.
    Confidence is the weighted mean of the measures over their largest values; ties go to the
    smaller ids.  Nodes with the same neighbours (and community) have the same measures with any
    other, so pairs are made of such classes and only the first ``limit`` expanded.  Wedges at a
    hub are as many as the square of the classes it links: that is the work.
    """
    if min_common < 1:
        raise ValueError("candidates come from common neighbours; ask for at least one")
    if scope not in ("all", "same", "across") or (scope != "all" and members is None):
        raise ValueError("a scope is all, same or across, and needs communities")
    out = edges.select(F.col("from_id").alias("v"), F.col("to_id").alias("u")).distinct()
    into = out.select(F.col("u").alias("v"), F.col("v").alias("u"))
    if not directed:
        out = into = out.union(into).distinct()
    n_out, n_in = (x.groupBy("v").agg(F.count(F.lit(1)).alias("d")) for x in (out, into))
    # How many links a common neighbour has: those out of and into it, or just its links.
    evidence = n_out.union(n_in).groupBy("v").agg(F.sum("d").alias("d")) if directed else n_out
    like_a, kinds_a = _alike(out, members)
    like_b, kinds_b = _alike(into, members) if directed else (like_a, kinds_a)
    kind = lambda kinds, x: kinds.select(F.col("r").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("d", "size", "second", "community")])
    near = out.join(kinds_a.select(F.col("r").alias("v")), "v").select(F.col("u").alias("m"), F.col("v").alias("a")).join(evidence.select(F.col("v").alias("m"), F.col("d").alias("du")), "m")
    far = into.join(kinds_b.select(F.col("r").alias("v"), "size"), "v").select(F.col("u").alias("m"), F.col("v").alias("b"), "size")
    if directed:
        far = far.join(kinds_a.select(F.col("r").alias("b"), F.col("size").alias("also")), "b", "left")
        some = (F.col("a") != F.col("b")) | (F.col("size") > 1) | (F.col("also") > 1)
    else:
        some = (F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("size") > 1))
    pairs = near.join(far, "m").filter(some)
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.sum(F.when(F.col("du") > 1, 1 / F.log("du")).otherwise(0.0)).alias("adamic_adar")).filter(F.col("common") >= min_common)
    # All of a class are linked to all of another, or none.
    pairs = pairs.join(out.select(F.col("v").alias("a"), F.col("u").alias("b")), ["a", "b"], "left_anti")
    pairs = pairs.join(kind(kinds_a, "a"), "a").join(kind(kinds_b, "b"), "b")
    pairs = pairs.withColumns({"jaccard": F.col("common") / (F.col("d_a") + F.col("d_b") - F.col("common")), "attachment": (F.col("d_a") * F.col("d_b")).cast("double")})
    pairs = pairs.withColumn("affinity", F.coalesce((F.col("community_a") == F.col("community_b")).cast("double"), F.lit(0.0)))
    if scope != "all":
        pairs = pairs.filter(F.col("affinity") == (1.0 if scope == "same" else 0.0))
    pairs = cut(pairs)
    if max_pairs is not None:
        n = _candidates(pairs, like_a, like_b, directed)
        if n > max_pairs:
            raise CandidateLimit(f"{n} candidate pairs, {max_pairs} allowed")
    measures = ("common", "jaccard", "adamic_adar", "attachment", "affinity")
    tops = pairs.agg(*[F.max(m).alias(f"top_{m}") for m in measures])
    pairs = pairs.crossJoin(F.broadcast(tops))  # one row
    score = sum((F.when(F.col(f"top_{m}") > 0, F.col(m) / F.col(f"top_{m}")).otherwise(0.0) * w for m, w in zip(measures, weights, strict=True)), F.lit(0.0)) / sum(weights)
    pairs = pairs.withColumn("confidence", F.round(score, 12)).filter(F.col("confidence") >= min_confidence)
    # The first limit pairs come from the limit classes whose first pairs are first, and from the first members of these.
    same = F.col("a") == F.col("b")
    alone = same & F.col("second_b").isNull()
    first = pairs.withColumns({"least_a": F.when(alone, F.col("second_a")).otherwise(F.col("a")), "least_b": F.when(same & ~alone, F.col("second_b")).otherwise(F.col("b"))})
    first = cut(first.orderBy(F.desc("confidence"), "least_a", "least_b").limit(limit).select("a", "b", *measures, "confidence"))
    by = Window.partitionBy("r").orderBy("v")
    ranked = lambda like, x, v, i: like.join(first.select(F.col(x).alias("r")).distinct(), "r", "left_semi").withColumn(i, F.row_number().over(by)).filter(F.col(i) <= limit + 1).select(F.col("r").alias(x), F.col("v").alias(v), i)
    rows = first.join(ranked(like_a, "a", "p", "i"), "a").join(ranked(like_b, "b", "q", "j"), "b").filter(F.col("i").cast("long") * F.col("j") <= 2 * limit)
    if directed:
        rows = rows.filter("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b"), *measures, "confidence")
    else:
        rows = rows.filter("a <> b or p < q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), *measures, "confidence")
    return rows.orderBy(F.desc("confidence"), "a", "b").limit(limit)


def _candidates(pairs: DataFrame, like_a: DataFrame, like_b: DataFrame, directed: bool) -> int:
    """How many pairs of different nodes pairs (a, b, size_a, size_b) of classes stand for."""
    both = (F.col("size_a") * F.col("size_b")).cast("decimal(38,0)")
    if directed:
        met = like_a.select("v", F.col("r").alias("a")).join(like_b.select("v", F.col("r").alias("b")), "v").groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"))
        n = both - F.coalesce("met", F.lit(0))
        pairs = pairs.join(met, ["a", "b"], "left")
    else:
        n = F.when(F.col("a") == F.col("b"), both - F.col("size_a")).otherwise(2 * both) / 2
    return int(pairs.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0])
