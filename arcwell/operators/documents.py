"""Generic graph documents: string ids and property maps, for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcwell.scratch import cut


def build(rows: DataFrame, kind: str, key: str, label: str | None = None) -> DataFrame:
    """(id, kind, label, properties) of entities."""
    props = [c for c in rows.columns if c != key]
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in props])
    return rows.select(F.col(key).cast("string").alias("id"), F.lit(kind).alias("kind"), (F.col(label).cast("string") if label else F.col(key).cast("string")).alias("label"), F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("properties"))


def focus(nodes: DataFrame, links: DataFrame, root: str, depth: int, incoming: bool = False) -> DataFrame:
    """(id, depth) of nodes within ``depth`` links (source, target) of a root; ids without regard to case."""
    key = lambda c: F.lower(F.col(c))
    e = links.select(key("source").alias("a"), key("target").alias("b"))
    if incoming:
        e = e.union(e.select("b", "a"))
    e = cut(e.distinct())
    known = cut(nodes.filter(key("id") == root.lower()).select(key("id").alias("k"), F.lit(0).alias("depth")).limit(1))
    front = known
    for d in range(1, depth + 1):
        front = cut(front.join(e, F.col("k") == F.col("a")).select(F.col("b").alias("k")).distinct().join(known, "k", "left_anti").select("k", F.lit(d).alias("depth")))
        if front.isEmpty():
            break
        known = cut(known.union(front))
    return nodes.join(known, key("id") == F.col("k")).select("id", "depth")


def merge(documents: list[DataFrame]) -> DataFrame:
    """Entities of several documents (id, ...): of equal ids the last document's."""
    rows = documents[0].withColumn("__order", F.lit(0))
    for i, d in enumerate(documents[1:], 1):
        rows = rows.unionByName(d.withColumn("__order", F.lit(i)))
    last = F.row_number().over(Window.partitionBy(F.lower("id")).orderBy(F.desc("__order")))
    return rows.withColumn("__rank", last).filter("__rank = 1").drop("__rank", "__order")
