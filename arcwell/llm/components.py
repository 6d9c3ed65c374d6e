"""Connected components of a link table by alternating star contraction.

Every round works on a link table that never has more rows than the input; the
smallest neighbour of a node comes from a map-side combined aggregate, so a node
with a third of all links costs no task more than its share, and the joins are
left to Spark's skew handling.  Rounds are cut with written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwell.llm.common import kept

#: Contraction takes about log2(longest path) rounds; far beyond any real graph.
MAX_ROUNDS = 200


def _both(links: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    return links.select(F.explode(ends).alias("e")).select("e.u", "e.v")


def _large_star(links: DataFrame) -> DataFrame:
    both = _both(links)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is its component's smallest node.

    Links of a node with itself, links with a null end and repeated links change
    nothing; a node that occurs in no proper link isn't returned.
    """
    links = links.select("a", "b").filter("a <> b").distinct()
    links = kept(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(links)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        links = kept(_small_star(_large_star(links)).filter("a <> b").distinct(), "links")
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct()).distinct()
