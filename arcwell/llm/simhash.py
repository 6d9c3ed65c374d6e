"""SimHash near-duplicates through a byte-position inverted index.

Two 64-bit fingerprints that differ in at most ``d`` bits agree in at least
``8 - d`` of their eight positional bytes.  The index posts every distinct
fingerprint under each choice of ``8 - d`` positions with the bytes found there,
so two fingerprints reach the guaranteed count of shared positional bytes exactly
if they meet under some posting; they are then verified bit by bit.  With d = 2 a
posting fixes six bytes, so it can never hold more than 2**16 fingerprints and
the work in it is linear: however many copies or near copies a corpus has, no
pair of them is ever enumerated.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwell.llm.common import kept, table
from arcwell.llm.components import connected_components

_ROWS = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned integer.

    A-Z are lower-cased.  A text with fewer words than a shingle has one, the
    whole sequence; one without words (or null) has fingerprint zero.  Shingles
    count as often as they occur; a bit is set if over half of them set it.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    shingle = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    total = len(words) - shingle + 1
    for at in range(0, total, _ROWS):
        upto = min(total, at + _ROWS)
        hashes = b"".join([digest(joined[i:j], seed) for i, j in zip(starts[at:upto].tolist(), ends[at + shingle - 1 : upto + shingle - 1].tolist(), strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            out = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _near(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what lies within ``max_bits``, at most one per value less one.

    Of few values the shared positional bytes are tallied pair by pair, and pairs that reach the
    guaranteed count are verified; of many, each value is looked up with every choice of at
    most ``max_bits`` of the differing bits flipped, which gives the same pairs.
    """
    n = len(values)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    links = []

    def link(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((int(values[i]), int(values[j])))

    if n <= 128:
        differ = values[:, None] ^ values[None, :]
        shared = (differ.view(np.uint8).reshape(n, n, 8) == 0).sum(axis=2)  # positional bytes
        close = (shared >= 8 - max_bits) & (np.bitwise_count(differ) <= max_bits)
        for i, j in zip(*np.nonzero(np.triu(close, 1)), strict=True):
            link(int(i), int(j))
        return links
    order = np.argsort(values)
    ranked = values[order]
    free = [b for b in range(64) if int(np.bitwise_or.reduce(values) ^ np.bitwise_and.reduce(values)) >> b & 1]
    for k in range(1, max_bits + 1):
        for bits in combinations(free, k):
            at = np.searchsorted(ranked, ranked ^ np.uint64(sum(1 << b for b in bits)))
            at[at == n] = 0
            hit = np.flatnonzero((ranked[at] == ranked ^ np.uint64(sum(1 << b for b in bits))) & (at > np.arange(n)))
            for i in hit.tolist():
                link(int(order[i]), int(order[at[i]]))
    return links


def near_links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) among the distinct fingerprints of column fp.

    They connect exactly what a chain of fingerprints, each within ``max_bits``
    of the next, connects.
    """
    positions = list(combinations(range(8), 8 - max_bits))
    masks = [sum(0xFF << (8 * p) for p in chosen) for chosen in positions]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(signed)])
    # By number: few bytes stand for many postings.
    dealt = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    postings = dealt.select("fp", F.explode(keys).alias("k")).groupBy("k.choice", "k.bytes").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)

    def run(batches):
        for batch in batches:
            a, b = [], []
            for row in batch.column(0):
                values = np.asarray(row.values).view(np.uint64)
                for x, y in _near(values, max_bits):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return postings.select("fps").mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``max_bits`` differing bits.  Null and empty texts have fingerprint zero and
    link like any other; rows with a null doc_id take part but give no id (a
    component with null ids only has a null component_id); repeated rows are
    returned as often as they occur.
    """
    prints = kept(fingerprints(docs, shingle, seed), "fingerprints")
    least = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = kept(connected_components(near_links(least.select("fp"), max_bits)), "roots")
    rooted = least.join(roots, least.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # Few classes have links, so hardly any row here shares its root with others.
    labels = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
