"""Critical path of an activity network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwell.scratch import cut

TOLERANCE = 1e-9


def _longest(times: DataFrame, links: DataFrame, limit: int) -> DataFrame:
    """(id, t): the largest of a node's own t and t + gain over links (a, b, gain); ValueError on a cycle."""
    front = times
    for _ in range(limit + 1):
        heard = front.join(links, F.col("id") == F.col("a")).groupBy("b").agg(F.max(F.col("t") + F.col("gain")).alias("heard"))
        new = cut(times.join(heard, F.col("id") == F.col("b"), "left").select("id", F.greatest("t", F.coalesce("heard", "t")).alias("t"), (F.col("heard") > F.col("t") + 1e-12).alias("moved")))
        times, front = new.select("id", "t"), new.filter("moved").select("id", "t")
        if front.isEmpty():
            return times
    stuck = sorted(r["id"] for r in front.limit(100).collect())
    raise ValueError(f"the network has a cycle; still moving: {stuck}")


def critical_path(nodes: DataFrame, edges: DataFrame, duration: str | None = None, lag: str | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, duration, earliest start and finish, latest start and finish, slack, critical).

    A duration is 0 and a lag 1 by default.  Times settle level by level from the
    starts, then from the end; a cycle keeps them moving beyond the number of nodes.
    """
    n = nodes.select("id", (F.col(duration).cast("double") if duration else F.lit(0.0)).alias("d"))
    e = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), (F.col(lag).cast("double") if lag else F.lit(1.0)).alias("lag"))
    n = cut(n)
    count = n.count()
    forward = cut(e.join(n.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").select("a", "b", (F.col("da") + F.col("lag")).alias("gain")))
    early = _longest(n.select("id", F.lit(0.0).alias("t")), forward, count)
    finish = early.join(n, "id").agg(F.max(F.col("t") + F.col("d")).alias("end"))
    # Backward: how long after a node's start the end must still be away.
    backward = cut(e.join(n.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("da") + F.col("lag")).alias("gain")))
    tail = _longest(n.select("id", F.col("d").alias("t")), backward, count)
    out = n.join(early.withColumnRenamed("t", "earliest_start"), "id").join(tail.withColumnRenamed("t", "tail"), "id").crossJoin(F.broadcast(finish))  # one row
    latest = F.col("end") - F.col("tail")
    return out.select(
        "id", F.col("d").alias("duration"), "earliest_start", (F.col("earliest_start") + F.col("d")).alias("earliest_finish"), latest.alias("latest_start"), (latest + F.col("d")).alias("latest_finish"),
        (latest - F.col("earliest_start")).alias("slack"), (F.abs(latest - F.col("earliest_start")) <= tolerance).alias("critical"),
    )
