"""Embedding near-duplicates through an inverted multi-index.

Independent codebooks of a vector's two halves form a grid of cells.  A vector
lies in one cell and looks into others in the order of how far it is from them:
a multi-sequence traversal merges the halves' sorted distances and stops where no
link of the least cosine can cross that far, whatever its direction.  Pairs are
verified in double precision.

Copies are one vector with a count.  A cell's vectors and its visitors are dealt
out in blocks; a block returns counts and links that span its groups, never all
its pairs.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwell.llm.common import kept, table
from arcwell.llm.components import connected_components
from arcwell.llm.vectors import kmeans, matrix, of_one_length, sample, unit, valid, with_vectors

#: Vectors or visitors of a cell that one task compares at once.
BLOCK = 2048
#: Distinct vectors for each cell of the grid that the codebooks aim at.
_PER_CELL = 2048


class Grid:
    """Codebooks of both halves, and the traversal of their product."""

    def __init__(self, x: np.ndarray, rows: int, threshold: float):
        k = int(min(1024, max(2, round(math.sqrt(rows / _PER_CELL)))))
        self.half = max(1, x.shape[1] // 2)
        self.books = [kmeans(x[:, : self.half], k), kmeans(x[:, self.half :], k) if x.shape[1] > 1 else np.zeros((1, 0))]
        self.width = max(len(b) for b in self.books)
        # Unit vectors at cosine c are sqrt(2 - 2c) apart, which bounds what both halves cross together.
        self.radius = math.sqrt(2 - 2 * threshold) + 1e-9

    def _margins(self, part: np.ndarray, book: np.ndarray) -> np.ndarray:
        """How far each row is from each centroid's side of the border with its own."""
        d = (book * book).sum(axis=1) - 2 * part @ book.T
        own = d.argmin(axis=1)
        gap = np.sqrt(np.maximum(((book[:, None] - book[None]) ** 2).sum(axis=2), 1e-300))
        return (d - d[np.arange(len(d)), own][:, None]) / (2 * gap[own])

    def cells(self, x: np.ndarray) -> list[list[int]]:
        """For each unit row the cells it visits, its own first."""
        a, b = self._margins(x[:, : self.half], self.books[0]), self._margins(x[:, self.half :], self.books[1])
        a[a < 1e-12], b[b < 1e-12] = 0.0, 0.0
        order_a, order_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        a, b = np.take_along_axis(a, order_a, 1) ** 2, np.take_along_axis(b, order_b, 1) ** 2
        limit = self.radius**2
        near_a, near_b = (a <= limit).sum(axis=1), (b <= limit).sum(axis=1)
        out = []
        for i in range(len(x)):
            na, nb = int(near_a[i]), int(near_b[i])
            out.append([int(order_a[i, s]) * self.width + int(order_b[i, t]) for s, t in multi_sequence(a[i, :na].tolist(), b[i, :nb].tolist(), limit)])
        return out


def multi_sequence(a: list[float], b: list[float], limit: float):
    """Pairs of indexes into two ascending sequences by ascending sum, as far as ``limit``."""
    heap, seen = [(a[0] + b[0], 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > limit:
            return
        yield i, j
        for s, t in ((i + 1, j), (i, j + 1)):
            if s < len(a) and t < len(b) and (s, t) not in seen:
                seen.add((s, t))
                heapq.heappush(heap, (a[s] + b[t], s, t))


def spanning(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Of nodes 0 .. n-1 with links (left, right), each node's smallest connected node."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[left], label[right])
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _block_links(part: pa.Table, threshold: float) -> pa.Table:
    member = part.column("member").to_numpy(zero_copy_only=False).astype(bool)
    ids, counts, x = part.column("rep").to_numpy(), part.column("n").to_numpy(), matrix(part.column("embedding"))
    m, v = np.flatnonzero(member), np.flatnonzero(~member)
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
    if not len(m) or not len(v):
        return none
    norms = np.sqrt((x * x).sum(axis=1))
    found_v, found_m = [], []
    u = x / norms[:, None]
    for at in range(0, len(v), 512):
        rows = v[at : at + 512]
        i, j = np.nonzero(u[rows] @ u[m].T >= threshold - 1e-9)
        i, j = rows[i], m[j]
        for lo in range(0, len(i), 1 << 16):
            p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            good = (ids[p] != ids[q]) & ((x[p] * x[q]).sum(axis=1) / (norms[p] * norms[q]) >= threshold)
            found_v.append(p[good])
            found_m.append(q[good])
    i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_v, found_m))
    if not len(i):
        return none
    links = np.bincount(i, weights=counts[j], minlength=len(ids)).astype(np.int64)
    # A vector can be here as member and as visitor: the same node.
    names, node = np.unique(ids, return_inverse=True)
    root = spanning(node[i], node[j], len(names))
    moved = np.flatnonzero(root != np.arange(len(names)))
    told = np.flatnonzero(links)
    nothing = lambda n: pa.nulls(n, pa.int64())
    return pa.table({
        "a": pa.concat_arrays([pa.array(names[moved]), pa.array(ids[told])]),
        "b": pa.concat_arrays([pa.array(names[root[moved]]), nothing(len(told))]),
        "links": pa.concat_arrays([nothing(len(moved)), pa.array(links[told])]),
    })


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Vectors with the same label and a cosine of at least ``threshold`` are linked.
    Null labels, and vectors that are null, empty, zero or hold null or non-finite
    components, link with nothing, nor do those whose length isn't the commonest (the longer
    of equally common ones).  Rows that repeat a vec_id count as vectors;
    rows without one are returned as components of their own, with a null id.
    """
    rows = with_vectors(vectors, F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"))
    usable = of_one_length(rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid(F.col("embedding"))))
    classes = kept(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    total = classes.count()
    if total:
        grid = Grid(sample(classes, "embedding", "rep"), total, threshold)

        def visit(batches):
            for batch in batches:
                x = matrix(batch.column("embedding"))
                if not len(x):
                    continue
                cells = grid.cells(unit(x))
                take = pa.array(np.repeat(np.arange(len(x)), [len(c) for c in cells]))
                own = np.concatenate([np.arange(len(c)) == 0 for c in cells])
                arrays = [batch.column(n).take(take) for n in ("label", "rep", "n", "embedding")]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.concatenate(cells).astype(np.int32)), pa.array(own)], names=["label", "rep", "n", "embedding", "cell", "own"])

        kinds = dict(classes.dtypes)
        visits = kept(classes.select("label", "rep", "n", "embedding").mapInArrow(visit, f"label {kinds['label']}, rep long, n long, embedding {kinds['embedding']}, cell int, own boolean"), "visits")
        plan = visits.groupBy("label", "cell").agg(F.ceil(F.sum(F.col("own").cast("int")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("groups")).filter("blocks > 0")
        dealt = visits.join(plan, ["label", "cell"])
        cols = ["label", "cell", "rep", "n", "embedding"]
        members = dealt.filter("own").select(*cols, F.lit(True).alias("member"), F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
        visitors = dealt.select(*cols, F.lit(False).alias("member"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("groups")).cast("int").alias("group"))
        both = members.union(visitors.select(*members.columns))
        found = kept(both.groupBy("label", "cell", "block", "group").applyInArrow(lambda t: _block_links(t, threshold), "a long, b long, links long"), "found")
        links = found.filter("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
        # ids of classes are their smallest vec_id, so a component's root is its smallest vec_id
        roots = connected_components(found.filter("b is not null").select("a", "b"))
        result = classes.join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
        result = result.select(
            F.col("label").alias("c_label"), F.col("embedding").alias("c_embedding"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id")
        )
        result = kept(result, "result")
        joined = rows.join(result, (F.col("label") == F.col("c_label")) & (F.col("embedding") == F.col("c_embedding")), "left")
        whole = F.col("vec_id").isNotNull()
        alone = joined.select("vec_id", F.coalesce(F.when(whole, F.col("n_links")), F.lit(0)).alias("n_links"), F.coalesce(F.when(whole, F.col("component_id")), F.col("vec_id")).alias("component_id"))
    return alone.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, e -> e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, e -> e <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), r(vec_id, c) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id WHERE r.c < l.b
), m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN m USING (vec_id) LEFT JOIN n ON n.a = e.vec_id
"""
