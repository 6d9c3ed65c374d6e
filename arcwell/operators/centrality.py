"""Degree, PageRank and betweenness over nodes (id) and edges (id, from_id, to_id)."""

from __future__ import annotations

import heapq
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcwell.scratch import cut

def raw_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    counts = ends.groupBy(F.col("x.id").alias("id")).agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    return nodes.select("id").join(counts, "id", "left").na.fill(0, ["in_degree", "out_degree"])


def normalised(degrees: DataFrame, n_nodes: int) -> DataFrame:
    top = max(n_nodes - 1, 1)
    return degrees.select("id", "in_degree", "out_degree", (F.col("in_degree") / top).alias("in_score"), (F.col("out_degree") / top).alias("out_score"), ((F.col("in_degree") + F.col("out_degree")) / (2.0 * top)).alias("score"))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In, out and total degree, by the number of other nodes."""
    return normalised(raw_degrees(nodes, edges), nodes.count())


def incremental_degree(before: DataFrame, nodes: DataFrame, edges: DataFrame, affected: DataFrame) -> DataFrame:
    """Degrees after a change: counted anew for affected ids only, else taken from ``before``."""
    touched = affected.select("id").distinct()
    ends, ids = edges.select("from_id", "to_id"), touched.withColumnRenamed("id", "__id")
    by_from, by_to = F.col("from_id") == F.col("__id"), F.col("to_id") == F.col("__id")
    near = ends.join(ids, by_from, "left_semi").unionByName(ends.join(ids, by_from, "left_anti").join(ids, by_to, "left_semi"))
    new = raw_degrees(nodes.join(touched, "id", "left_semi"), near).select("id", "in_degree", "out_degree")
    old = before.select("id", "in_degree", "out_degree").join(touched, "id", "left_anti").join(nodes.select("id"), "id", "left_semi")
    return normalised(new.unionByName(old), nodes.count())


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-8, fixed: bool = False) -> DataFrame:
    """(id, score): parallel edges count, what dangling nodes hold is spread evenly.

    Stops at an L1 change of ``tolerance``, after ``iterations`` rounds at the
    latest; ``fixed`` runs them all without looking at the change.  The links are
    counted once by pair of nodes; a round is one join and one aggregation over a written
    table, so plans don't grow.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(None).cast("double").alias("score"))
    out = edges.groupBy("from_id").agg(F.count(F.lit(1)).alias("out"))
    links = cut(edges.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("k")).join(out, "from_id").select("from_id", "to_id", (F.col("k") / F.col("out")).alias("share")))
    nodes = cut(nodes.select("id").join(out, F.col("id") == F.col("from_id"), "left").select("id", F.col("out").isNull().alias("dangling")))
    ranks = nodes.withColumn("score", F.lit(1.0 / n))
    for _ in range(iterations):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("score"))), F.lit(0.0)).alias("lost"))
        given = links.join(ranks, F.col("from_id") == F.col("id")).groupBy("to_id").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        new = ranks.select("id", "dangling", F.col("score").alias("was")).join(given, F.col("id") == F.col("to_id"), "left").crossJoin(F.broadcast(lost))  # one row
        score = F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        new = cut(new.select("id", "dangling", score.alias("score"), "was"))
        ranks = new.drop("was")
        if not fixed and new.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] <= tolerance:
            break
    return ranks.select("id", "score")


def ranked(scores: DataFrame, column: str = "score") -> DataFrame:
    """Adds rank from 0 by falling score, then id, without bringing all rows to one task.

    Rows are range-partitioned by the order; a partition's ranks follow the rows before.
    """
    parts = scores.repartitionByRange(F.desc(column), F.asc("id")).withColumn("__part", F.spark_partition_id())
    parts = cut(parts)
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(F.desc(column), F.asc("id"))) - 1
    return parts.join(F.broadcast(before), "__part").withColumn("rank", F.col("before") + within).drop("__part", "before")


#: Edges that a kernel's broadcast adjacency may have.
MAX_KERNEL_EDGES = 10_000_000


def adjacency(edges: DataFrame, weight: str | None, both: bool = False) -> dict[int, list[tuple[int, float]]]:
    """The edges on the driver, by source; refused beyond ``MAX_KERNEL_EDGES``."""
    rows = edges.select("from_id", "to_id", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).limit(MAX_KERNEL_EDGES + 1).toPandas()
    if len(rows) > MAX_KERNEL_EDGES:
        raise ValueError("too many edges for a kernel")
    out: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in sorted(zip(rows["from_id"].tolist(), rows["to_id"].tolist(), rows["w"].tolist(), strict=True)):
        out.setdefault(a, []).append((b, w))
        if both:
            out.setdefault(b, []).append((a, w))
    return out


def _dependencies(start: int, adj: dict, weighted: bool) -> dict[int, float]:
    """How much of the shortest paths from a node passes others (Brandes)."""
    count, dist, before, done = {start: 1.0}, {start: 0.0}, {start: []}, []
    if weighted:
        heap, seen = [(0.0, start)], set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in seen:
                continue
            seen.add(v)
            done.append(v)
            for w, x in adj.get(v, ()):
                new = d + x
                if w not in dist or new < dist[w] - 1e-12 * max(1.0, abs(dist[w])):
                    dist[w], count[w], before[w] = new, count[v], [(v, count[v])]
                    heapq.heappush(heap, (new, w))
                elif w not in seen and abs(new - dist[w]) <= 1e-12 * max(1.0, abs(new)):
                    count[w] += count[v]
                    before[w].append((v, count[v]))
    else:
        queue = deque([start])
        while queue:
            v = queue.popleft()
            done.append(v)
            for w, _ in adj.get(v, ()):
                if w not in dist:
                    dist[w], count[w], before[w] = dist[v] + 1, 0.0, []
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    count[w] += count[v]
                    before[w].append((v, count[v]))
    part = dict.fromkeys(done, 0.0)
    for w in reversed(done):
        for v, c in before[w]:
            part[v] += c / count[w] * (1 + part[w])
    part.pop(start)
    return part


def betweenness(nodes: DataFrame, edges: DataFrame, weight: str | None = None, both: bool = False) -> DataFrame:
    """(id, score, normalised): exact; one source at a time, sources in parallel over a broadcast graph."""
    adj = nodes.sparkSession.sparkContext.broadcast(adjacency(edges, weight, both))
    n = nodes.count()

    def run(batches):
        for batch in batches:
            total: dict[int, float] = {}
            for s in batch.column(0).to_pylist():
                for v, x in _dependencies(s, adj.value, weight is not None).items():
                    total[v] = total.get(v, 0.0) + x
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.float64())], names=["id", "score"])

    sums = nodes.select("id").mapInArrow(run, "id long, score double").groupBy("id").agg(F.sum("score").alias("score"))
    out = nodes.select("id").join(sums, "id", "left").select("id", (F.coalesce("score", F.lit(0.0)) / (2.0 if both else 1.0)).alias("score"))
    pairs = (n - 1) * (n - 2) / (2.0 if both else 1.0)
    return out.withColumn("normalised", F.col("score") / pairs if n > 2 else F.lit(0.0))
