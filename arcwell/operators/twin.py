"""What-if analysis: scenarios, simulation, decisions and twin operations."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterable
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcwell.operators.deltas import apply_delta
from arcwell.operators.structure import weak_components
from arcwell.scratch import cut

# Scenarios


def scenario(nodes: DataFrame, edges: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after a branch's mutations; the baseline stays as it is."""
    n, e, _ = apply_delta(nodes, edges, delta)
    return n, e


def event_chain(scenario_id: str, baseline: str, mutations: Iterable[dict]) -> list[dict]:
    """Mutations as events, each with a hash over itself and the event before."""
    out, last = [], hashlib.sha256(f"{scenario_id}|{baseline}".encode()).hexdigest()
    for i, m in enumerate(mutations, 1):
        last = hashlib.sha256(json.dumps([last, i, m], sort_keys=True, default=str).encode()).hexdigest()
        out.append({"sequence": i, "mutation": m, "hash": last})
    return out


def verify_chain(scenario_id: str, baseline: str, events: list[dict]) -> bool:
    return [e["sequence"] for e in events] == list(range(1, len(events) + 1)) and event_chain(scenario_id, baseline, [e["mutation"] for e in events]) == events


def compare_scenarios(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], custom: dict[str, Callable[[DataFrame, DataFrame], float]] | None = None) -> DataFrame:
    """(metric, before, after, delta) by name: nodes, edges, density, weak components and custom ones."""

    def measure(n: DataFrame, e: DataFrame) -> dict[str, float]:
        nodes, edges = n.count(), e.count()
        out = {"nodes": nodes, "edges": edges, "density": edges / (nodes * (nodes - 1)) if nodes > 1 else 0.0}
        out["weak_components"] = weak_components(n, e).select("component").distinct().count()
        return {k: float(v) for k, v in (out | {k: f(n, e) for k, f in (custom or {}).items()}).items()}

    a, b = measure(*before), measure(*after)
    return before[0].sparkSession.createDataFrame([(k, a[k], b[k], b[k] - a[k]) for k in sorted(a)], "metric string, before double, after double, delta double")


# Simulation


def order_events(events: DataFrame, max_duration: float) -> DataFrame:
    """Events (event_id, offset, priority) with their turn; those after the duration have none.

    Global order without one task holding all: ranks by range partition.
    """
    from arcwell.operators.centrality import ranked

    runs = events.filter(F.col("offset") <= max_duration).withColumn("id", F.struct("offset", "priority", "event_id"))
    turns = ranked(runs.withColumn("__same", F.lit(0)), "__same").select("event_id", (F.col("rank") + 1).alias("turn"))
    return events.join(turns, "event_id", "left")


def simulate(state, events: list[tuple], step: Callable, max_duration: float) -> tuple[object, int, int]:
    """Folds (offset, priority, event_id, payload) in order; returns the state, how many ran and how many came too late."""
    ran = [e for e in sorted(events, key=lambda e: e[:3]) if e[0] <= max_duration]
    for e in ran:
        state = step(state, e)
    return state, len(ran), len(events) - len(ran)


def cascade(nodes: DataFrame, edges: DataFrame, failed: DataFrame, protect_sources: bool = True, rounds: int = 1000, epsilon: float = 1e-9) -> DataFrame:
    """(id, round): when each node fails, 0 for those that start it.

    In each round the nodes whose capacity from active neighbours falls short of
    their demand fail together.  Nodes (id, demand), edges (from_id, to_id, capacity);
    nodes without incoming edges at the start don't fail, if protected.
    """
    e = cut(edges.groupBy("from_id", "to_id").agg(F.sum("capacity").alias("capacity")))
    fed = e.select(F.col("to_id").alias("id")).distinct()
    down = cut(failed.select("id", F.lit(0).alias("round")).distinct())
    at_risk = nodes.join(fed, "id", "left_semi") if protect_sources else nodes
    for i in range(1, rounds + 1):
        live = e.join(down.select(F.col("id").alias("from_id")), "from_id", "left_anti").groupBy(F.col("to_id").alias("id")).agg(F.sum("capacity").alias("got"))
        new = at_risk.join(down, "id", "left_anti").join(live, "id", "left").filter(F.coalesce("got", F.lit(0.0)) + epsilon < F.col("demand"))
        new = cut(new.select("id", F.lit(i).alias("round")))
        if new.isEmpty():
            return down
        down = cut(down.union(new))
    return down


_GOLDEN, _M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB  # SplitMix64's fixed values


def splitmix64(seed: np.ndarray, draws: int) -> np.ndarray:
    """``draws`` numbers in [0, 1) for each seed."""
    with np.errstate(over="ignore"):
        x = seed.astype(np.uint64)[:, None] + np.uint64(_GOLDEN) * np.arange(1, draws + 1, dtype=np.uint64)[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def monte_carlo(spark, runs: int, outcome: Callable[[np.ndarray], np.ndarray], draws: int, seed: int = 42) -> DataFrame:
    """(run, outcome): each run gets its own numbers, so results don't depend on how runs are dealt out."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            u = splitmix64(ids.astype(np.uint64) * np.uint64(_GOLDEN) ^ np.uint64(seed), draws)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(outcome(u), np.float64))], names=["run", "outcome"])

    return spark.range(runs).select(F.col("id").alias("run")).mapInArrow(run, "run long, outcome double")


def outcome_statistics(outcomes: DataFrame, column: str = "outcome", confidence: float = 0.95, percentiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row: mean, sample deviation, standard error, confidence interval, extremes, percentiles."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    c = F.col(column)
    s = outcomes.agg(F.count(c).alias("runs"), F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("deviation"), F.min(c).alias("least"), F.max(c).alias("most"), F.percentile(c, list(percentiles)).alias("p"))
    s = s.withColumn("error", F.col("deviation") / F.sqrt("runs"))
    return s.select("runs", "mean", "deviation", "error", (F.col("mean") - z * F.col("error")).alias("low"), (F.col("mean") + z * F.col("error")).alias("high"), "least", "most", *[F.col("p")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(percentiles)])


# Decisions


def rank_policies(scores: DataFrame, criteria: DataFrame) -> DataFrame:
    """(policy, utility, rank) from scores (policy, criterion, value) and criteria (criterion, weight, maximise)."""
    by = Window.partitionBy("criterion")
    rows = scores.join(F.broadcast(criteria), "criterion").withColumns({"low": F.min("value").over(by), "high": F.max("value").over(by)})  # criteria are a decision's few
    share = F.when(F.col("high") == F.col("low"), 1.0).otherwise((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")))
    utility = F.when(F.col("maximise") | (F.col("high") == F.col("low")), share).otherwise(1.0 - share)
    out = rows.groupBy("policy").agg((F.sum(utility * F.col("weight")) / F.sum("weight")).alias("utility"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("utility", 12)), "policy")))


def sensitivity(samples: DataFrame) -> DataFrame:
    """By parameter of samples (parameter, value, outcome): range, direction and mean elasticity.

    Elasticity is the outcome's relative change over the value's, between neighbours.
    """
    by = Window.partitionBy("parameter").orderBy("value")
    s = samples.withColumns({"v0": F.lag("value").over(by), "o0": F.lag("outcome").over(by)})
    change = F.col("outcome") - F.col("o0")
    elastic = F.when((F.col("v0") != 0) & (F.col("o0") != 0) & (F.col("value") != F.col("v0")), (change / F.abs("o0")) / ((F.col("value") - F.col("v0")) / F.abs("v0")))
    out = s.groupBy("parameter").agg((F.max("outcome") - F.min("outcome")).alias("range"), F.avg(elastic).alias("elasticity"), F.min(change).alias("least"), F.max(change).alias("most"))
    direction = F.when(F.col("least").isNull() | ((F.col("least") == 0) & (F.col("most") == 0)), "Flat").when(F.col("least") >= 0, "Increasing").when(F.col("most") <= 0, "Decreasing").otherwise("Mixed")
    impact = F.row_number().over(Window.orderBy(F.desc("range"), "parameter"))
    return out.select("parameter", "range", "elasticity", direction.alias("direction"), impact.alias("impact_rank"))


# Twin operations

#: Shares of changes from which drift is high, and critical (defaults).
HIGH, CRITICAL = 0.10, 0.30


def drift_level(changes: Column, larger: Column, topology: Column, high: float = HIGH, critical: float = CRITICAL) -> Column:
    share = changes / F.greatest(F.lit(1), larger)
    return F.when(changes == 0, "None").when(share >= critical, "Critical").when(topology | (share >= high), "High").otherwise("Low")


def drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row from two worlds (kind, id, fingerprint, ends): counts of changes and the level."""
    e = expected.select("kind", "id", F.col("fingerprint").alias("f0"), F.col("ends").alias("e0"), F.lit(1).alias("in0"))
    a = actual.select("kind", "id", F.col("fingerprint").alias("f1"), F.col("ends").alias("e1"), F.lit(1).alias("in1"))
    j = e.join(a, ["kind", "id"], "full_outer")
    added, removed = F.col("in0").isNull(), F.col("in1").isNull()
    moved = ~F.col("e0").eqNullSafe(F.col("e1"))
    modified = ~added & ~removed & (~F.col("f0").eqNullSafe(F.col("f1")) | moved)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    s = j.agg(n(added).alias("added"), n(removed).alias("removed"), n(modified).alias("modified"), n(added | removed | moved).alias("topology"), n(~added).alias("before"), n(~removed).alias("after"))
    changes = F.col("added") + F.col("removed") + F.col("modified")
    return s.select("added", "removed", "modified", (F.col("topology") > 0).alias("topology_changed"), drift_level(changes, F.greatest("before", "after"), F.col("topology") > 0).alias("level"))


def warnings(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Metrics (metric, value) that break rules (rule, metric, comparison, threshold, severity), worst first."""
    r = metrics.join(F.broadcast(rules), "metric")  # a system's rules are few
    v, t, c = F.col("value"), F.col("threshold"), F.col("comparison")
    hit = F.when(c == ">", v > t).when(c == ">=", v >= t).when(c == "<", v < t).when(c == "<=", v <= t)
    return r.filter(hit).orderBy(F.desc("severity"), "rule")


def predict_breach(samples: DataFrame, threshold: float, horizon_seconds: float) -> DataFrame:
    """By metric of samples (metric, at, value): fitted line, R2, and when it meets the threshold.

    Least squares over seconds since the first sample; R2 is 1 for a flat series; a
    breach counts only if the line runs towards the threshold and meets it after
    the last sample, and within the horizon.
    """
    first = F.min("at").over(Window.partitionBy("metric"))
    s = samples.withColumn("x", F.col("at").cast("double") - first.cast("double")).withColumn("began", first)
    g = s.groupBy("metric").agg(F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept"), F.regr_r2("value", "x").alias("r2"), F.max("x").alias("last"), F.min("began").alias("began"), F.var_pop("value").alias("spread"))
    at = (threshold - F.col("intercept")) / F.col("slope")
    meets = (F.col("slope") != 0) & (at > F.col("last"))
    g = g.withColumn("seconds", F.when(meets, at)).withColumn("r2", F.when(F.col("spread") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r2")))))
    return g.select("metric", "slope", "intercept", "r2", F.col("seconds").alias("breach_after"), F.coalesce(F.col("seconds") - F.col("last") <= horizon_seconds, F.lit(False)).alias("within_horizon"))


def evidence_report(changes: list[dict], warned: list[dict], predictions: list[dict], scenarios: list[dict]) -> str:
    """A report as JSON with a digest over its content; parts are in a fixed order."""
    content = {
        "drift": sorted(changes, key=lambda x: (x["kind"], str(x["id"]))), "warnings": sorted(warned, key=lambda x: (-x["severity"], x["rule"])),
        "predictions": sorted(predictions, key=lambda x: x["threshold"]), "scenarios": sorted(scenarios, key=lambda x: x["id"]),
    }
    body = json.dumps(content, sort_keys=True, default=str)
    return json.dumps({"content": content, "sha256": hashlib.sha256(body.encode()).hexdigest()}, sort_keys=True, default=str)


def read_report(text: str) -> dict:
    report = json.loads(text)
    if hashlib.sha256(json.dumps(report["content"], sort_keys=True).encode()).hexdigest() != report["sha256"]:
        raise ValueError("the report was changed")
    return report["content"]


def finite(x: float) -> bool:
    return math.isfinite(x)
