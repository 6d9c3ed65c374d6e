"""Communities of graphs whose links don't fit the driver: nodes move in parallel.

The driver has numbers of each node (its community, the volumes), the links stay in tables of
the shared folder.  A round goes through the nodes in parts drawn by a seed: tasks propose each
node's best community as the labels are, the driver lets nodes in while they gain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwell.scratch import cut

#: Nodes that the driver may have numbers of.
MAX_NODES = 10_000_000
#: Parts of a round, rounds of a level at most, and the gain of modularity below which a level ends.
PARTS, ROUNDS, LEAST_GAIN = 4, 30, 1e-4
#: Links that a task takes at once, and that a partition has.
_CHUNK, _PARTITION = 1 << 19, 2_000_000


def _chunks(batches):
    """Arrays (v, u, o, i) of rows sorted by v, cut between nodes."""
    held, rows = [], 0

    def arrays(table):
        return [table.column(c).to_numpy() for c in ("v", "u", "o", "i")]

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _CHUNK:
            table = pa.Table.from_batches(held).combine_chunks()
            last = np.flatnonzero(np.diff(table.column("v").to_numpy()))
            if len(last):
                yield arrays(table.slice(0, last[-1] + 1))
                table = table.slice(last[-1] + 1)
            held, rows = table.to_batches(), table.num_rows
    if rows:
        yield arrays(pa.Table.from_batches(held).combine_chunks())


def _told(spark, rows: DataFrame, state: tuple, run, schema: str) -> pa.Table:
    """What ``run(state, chunk)`` finds in all rows, with state sent to the tasks once."""
    sent = spark.sparkContext.broadcast(state)

    def each(batches):
        for chunk in _chunks(batches):
            yield run(sent.value, chunk)

    try:
        return rows.select("v", "u", "o", "i").mapInArrow(each, schema).toArrow()
    finally:
        sent.destroy()


def _propose(state, chunk):
    """(v, c, k, k_old) of nodes that gain by moving to c, k being links to it; -1 has all links inside."""
    label, c_out, c_in, total, resolution = state
    v, u, o, i = chunk
    start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    node, out, inn = v[start], np.add.reduceat(o, start), np.add.reduceat(i, start)
    old = label[node]
    g = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(v))))
    other = u != v
    key = g[other] * len(label) + label[u[other]]
    order = np.argsort(key, kind="stable")
    key, weight = key[order], (o + i)[other][order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
    k = np.add.reduceat(weight, at) if len(at) else np.empty(0)
    g, c = key[at] // len(label), key[at] % len(label)
    mine = c == old[g]
    k_old = np.zeros(len(node))
    k_old[g[mine]] = k[mine]
    stay = k_old - resolution * (out * (c_in[old] - inn) + inn * (c_out[old] - out)) / total
    g, c, k = g[~mine], c[~mine], k[~mine]
    gain = k - resolution * (out[g] * c_in[c] + inn[g] * c_out[c]) / total
    best = np.lexsort((c, -gain, g))
    best = best[np.concatenate(([True], g[best][1:] != g[best][:-1]))[: len(best)]]
    best = best[gain[best] > stay[g[best]] + 1e-12]
    of = g[best]
    columns = [np.append(node[of], -1), np.append(c[best], 0), np.append(k[best], k_old.sum()), np.append(k_old[of], 0.0)]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(columns, ("i4", "i4", "f8", "f8"), strict=True)], names=["v", "c", "k", "k_old"])


def _admit(told: pa.Table, label, out, inn, c_out, c_in, total: float, resolution: float) -> int:
    """Moves the proposed nodes that still gain after all those before them; how many these are.

    Of two nodes that are alone the one with the larger number moves.  A node that two tasks have read stays.
    """
    v, c, k, k_old = (told.column(x).to_numpy() for x in ("v", "c", "k", "k_old"))
    seen, times = np.unique(v, return_counts=True)
    once = np.isin(v, seen[(times == 1) & (seen >= 0)])
    v, c, k, k_old = v[once], c[once], k[once], k_old[once]
    old, size = label[v], np.bincount(label, minlength=len(label))
    good = (size[old] > 1) | (size[c] > 1) | (c < old)
    v, c, k, k_old, old = v[good], c[good], k[good], k_old[good], old[good]
    gain = lambda before_in, before_out: k - resolution * (out[v] * (c_in[c] + before_in) + inn[v] * (c_out[c] + before_out)) / total
    order = np.lexsort((v, -gain(0.0, 0.0), c))
    v, c, k, k_old, old = v[order], c[order], k[order], k_old[order], old[order]
    if not len(v):
        return 0
    first = np.concatenate(([True], c[1:] != c[:-1]))

    def before(x):
        total_before = np.cumsum(x) - x
        return total_before - total_before[first][np.cumsum(first) - 1]

    stay = k_old - resolution * (out[v] * (c_in[old] - inn[v]) + inn[v] * (c_out[old] - out[v])) / total
    good = gain(before(inn[v]), before(out[v])) > stay + 1e-12
    v, c, old = v[good], c[good], old[good]
    for volume, x in ((c_out, out), (c_in, inn)):
        np.add.at(volume, c, x[v])
        np.subtract.at(volume, old, x[v])
    label[v] = c
    return len(v)


def _least(state, chunk):
    """(v, m) of nodes that a link within their community leads to a smaller part than theirs."""
    label, part = state
    v, u, _, _ = chunk
    start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    node = v[start]
    m = np.minimum.reduceat(np.where(label[v] == label[u], part[u], part[v]), start)
    less = m < part[node]
    return pa.RecordBatch.from_arrays([pa.array(node[less]), pa.array(m[less])], names=["v", "m"])


def _connected(spark, rows: DataFrame, label: np.ndarray) -> np.ndarray:
    """Each node's connected part of its community: the smallest number in it."""
    part = np.arange(len(label), dtype=np.int32)
    while True:
        told = _told(spark, rows, (label, part), _least, "v int, m int")
        if not told.num_rows:
            return part
        np.minimum.at(part, part[told.column("v").to_numpy()], told.column("m").to_numpy())
        while (part[part] != part).any():
            part = part[part]


def _links(edges: DataFrame) -> DataFrame:
    """(part, v, u, o, i) of edges (a, b, w): each with both ends as v, sorted by part and v."""
    ends = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u"), F.col("w").alias("o"), F.lit(0.0).alias("i")), F.struct(F.col("b").alias("v"), F.col("a").alias("u"), F.lit(0.0).alias("o"), F.col("w").alias("i")))
    return edges.select(F.explode(ends).alias("e")).select("e.*")


def _level(edges: DataFrame, count: int, n: int, resolution: float, seed: int) -> np.ndarray:
    """The community of each of n nodes after moves along edges (a, b, w), as connected parts."""
    spark = edges.sparkSession
    links = _links(edges).withColumn("part", F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(PARTS)).cast("int"))
    links = cut(links.repartition(max(16, 2 * count // _PARTITION), "v").sortWithinPartitions("part", "v"), "part")
    volumes = links.groupBy("v").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).toArrow()
    out, inn = np.zeros(n), np.zeros(n)
    out[volumes.column("v").to_numpy()], inn[volumes.column("v").to_numpy()] = volumes.column("o").to_numpy(), volumes.column("i").to_numpy()
    total = float(out.sum())
    label, c_out, c_in = np.arange(n, dtype=np.int32), out.copy(), inn.copy()
    if not total:
        return label
    before = -np.inf
    for _ in range(ROUNDS):
        moved, inside = 0, 0.0
        for part in range(PARTS):
            told = _told(spark, links.filter(F.col("part") == part), (label, c_out, c_in, total, resolution), _propose, "v int, c int, k double, k_old double")
            inside += float(told.column("k").to_numpy()[told.column("v").to_numpy() < 0].sum())
            moved += _admit(told, label, out, inn, c_out, c_in, total, resolution)
        quality = inside / 2 / total - resolution * float(c_out @ c_in) / total**2
        if not moved or quality < before + LEAST_GAIN:
            break
        before = quality
    return _connected(spark, links, label)


def numbered(nodes: DataFrame, edges: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """The ids, ascending, and edges (a, b, w) by their places in them, of edges (from_id, to_id, w)."""
    if nodes.select("id").distinct().count() > MAX_NODES:
        raise ValueError("too many nodes")
    ids = np.sort(nodes.select(F.col("id").cast("long")).distinct().toArrow().column(0).to_numpy())
    sent = nodes.sparkSession.sparkContext.broadcast(ids)

    def place(x):
        at = np.minimum(np.searchsorted(sent.value, x), len(sent.value) - 1)
        if (sent.value[at] != x).any():
            raise ValueError("an edge's end is no node")
        return pa.array(at.astype(np.int32))

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([place(b.column("from_id").to_numpy()), place(b.column("to_id").to_numpy()), b.column("w")], names=["a", "b", "w"])

    rows = edges.select(F.col("from_id").cast("long").alias("from_id"), F.col("to_id").cast("long").alias("to_id"), "w")
    placed = cut(rows.mapInArrow(run, "a int, b int, w double"))
    sent.destroy()
    return ids, placed


def _merged(edges: DataFrame, to: np.ndarray) -> DataFrame:
    """Edges (a, b, w) between the groups that nodes are in."""
    sent = edges.sparkSession.sparkContext.broadcast(to)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[b.column(c).to_numpy()]) for c in ("a", "b")] + [b.column("w")], names=["a", "b", "w"])

    merged = cut(edges.mapInArrow(run, "a int, b int, w double").groupBy("a", "b").agg(F.sum("w").alias("w")))
    sent.destroy()
    return merged


def moved(edges: DataFrame, n: int, resolution: float, seed: int, levels: int, few: int) -> tuple[np.ndarray, DataFrame, int]:
    """Each of n nodes' group, edges (a, b, w) between groups, and levels left.

    A level moves nodes, splits what isn't connected and merges.  It goes on until there are at
    most ``few`` groups and edges, or a level merges nothing; then no levels are left.
    """
    group = np.arange(n, dtype=np.int32)
    while levels and max(count := edges.count(), n) > few:
        part = _level(edges, count, n, resolution, seed)
        names, to = np.unique(part, return_inverse=True)
        levels -= 1
        if len(names) == n:
            return group, edges, 0
        to = to.astype(np.int32)
        edges, group, n = _merged(edges, to), to[group], len(names)
    return group, edges, levels


def told_apart(nodes: DataFrame, ids: np.ndarray, community: np.ndarray) -> DataFrame:
    """(id, community) of all nodes, communities numbered by their first node."""
    _, first, to = np.unique(community, return_index=True, return_inverse=True)
    number = np.empty(len(first), np.int64)
    number[np.argsort(first)] = np.arange(len(first))
    sent = nodes.sparkSession.sparkContext.broadcast((ids, number[to]))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sent.value[1][np.searchsorted(sent.value[0], b.column("id").to_numpy())])], names=["id", "community"])

    out = cut(nodes.select(F.col("id").cast("long").alias("id")).mapInArrow(run, "id long, community long"))
    sent.destroy()
    return out
