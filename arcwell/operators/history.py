"""History envelopes: as-of and range reads, temporal traversal, bitemporal projection, diffs.

Envelopes have entity_type, entity_id, operation_kind, captured_at, valid_from,
valid_to (null: open) and, for edges, from_id and to_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of operation (fixed values).
CREATED, UPDATED, DELETED, CONNECTED, DISCONNECTED = 1, 2, 3, 4, 5
ENTITY = ("entity_type", "entity_id")


def _latest(h: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    return h.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rank = 1").drop("__rank")


@dataclass(frozen=True)
class Ending:
    """Which operations end what they are about; others leave it active."""

    disconnected_edges: bool = True
    deleted_edges: bool = True
    deleted_nodes: bool = True


def _active(h: DataFrame, ending: Ending = Ending()) -> DataFrame:
    kind = F.col("operation_kind")
    edge = F.coalesce("is_edge", F.lit(False)) if "is_edge" in h.columns else F.lit(False)
    deleted = F.when(edge, F.lit(ending.deleted_edges)).otherwise(F.lit(ending.deleted_nodes))
    return h.filter(~((kind == DELETED) & deleted | (kind == DISCONNECTED) & F.lit(ending.disconnected_edges)))


def current(h: DataFrame, keys: tuple[str, ...] = ENTITY, ending: Ending = Ending()) -> DataFrame:
    """Each entity's latest envelope (open ones first among equals), unless that ended it."""
    return _active(_latest(h, keys, F.desc("captured_at"), F.col("valid_to").isNotNull(), F.desc("valid_from")), ending)


def as_of(h: DataFrame, instant, keys: tuple[str, ...] = ENTITY, ending: Ending = Ending()) -> DataFrame:
    """As ``current``, of what was captured until an instant, which is stamped on the rows."""
    instant = F.lit(instant).cast("timestamp")
    return current(h.filter(F.col("captured_at") <= instant), keys, ending).withColumn("query_as_of", instant)


def between(h: DataFrame, begin, end) -> DataFrame:
    """Envelopes captured from ``begin`` to ``end``, both included."""
    if end < begin:
        raise ValueError("the end comes before the begin")
    return h.filter(F.col("captured_at").between(F.lit(begin).cast("timestamp"), F.lit(end).cast("timestamp")))


def by_captured(h: DataFrame) -> DataFrame:
    return h.orderBy("captured_at", *ENTITY)


def by_validity(h: DataFrame) -> DataFrame:
    return h.orderBy("valid_from", "valid_to", *ENTITY)


def typed_snapshots(h: DataFrame, schema: str, column: str = "snapshot_json") -> DataFrame:
    """The envelopes' stored states (JSON text) as columns of a declared type; text that doesn't fit gives nulls."""
    return h.withColumn("snapshot", F.from_json(column, schema)).select(*ENTITY, "captured_at", "snapshot.*")


def envelopes_of_changes(changes: DataFrame, captured_at: Column) -> DataFrame:
    """Envelopes of a change table (op, entity_type, entity_id, valid_from of the state replaced).

    An update closes the old state and opens a new one; a deletion is valid for no time.
    """
    op = F.col("op")
    opened = F.struct(F.when(op.isin("add"), CREATED).when(op == "update", UPDATED).when(op == "connect", CONNECTED).when(op == "disconnect", DISCONNECTED).otherwise(DELETED).alias("operation_kind"), captured_at.alias("valid_from"), F.when(op.isin("remove", "disconnect"), captured_at).alias("valid_to"))
    closed = F.struct(F.lit(UPDATED).alias("operation_kind"), F.col("valid_from").alias("valid_from"), captured_at.alias("valid_to"))
    each = F.explode(F.when(op == "update", F.array(closed, opened)).otherwise(F.array(opened)))
    return changes.select("entity_type", "entity_id", captured_at.alias("captured_at"), each.alias("e")).select("entity_type", "entity_id", "captured_at", "e.*")


def _as_of_each(h: DataFrame, wanted: DataFrame, ending: Ending) -> DataFrame:
    """Of entities (entity_type, entity_id, instant) what was active at their instant, which is kept with it."""
    w = wanted.select(*[F.col(k).alias(f"w_{k}") for k in ENTITY], "instant").distinct()
    rows = h.join(w, (F.col("entity_type") == F.col("w_entity_type")) & (F.col("entity_id") == F.col("w_entity_id")) & (F.col("captured_at") <= F.col("instant")))
    latest = _latest(rows.drop("w_entity_type", "w_entity_id"), (*ENTITY, "instant"), F.desc("captured_at"), F.col("valid_to").isNotNull(), F.desc("valid_from"))
    return _active(latest, ending)


def temporal_hop(sources: DataFrame, edges: DataFrame, nodes: DataFrame, instant=None, outgoing: bool = True, ending: Ending = Ending()) -> DataFrame:
    """From source envelopes over the edges active at an instant to the nodes active then: source_id, edge, node.

    Without an instant each source has its own: ``query_as_of``, as reads stamp it.
    """
    here, there = ("from_id", "to_id") if outgoing else ("to_id", "from_id")
    if instant is not None:
        e = as_of(edges, instant, ending=ending).select(F.col(here).alias("__here"), F.col(there).alias("__there"), F.struct("*").alias("edge"))
        n = as_of(nodes, instant, ending=ending).select(F.struct("*").alias("node"))
        s = sources.select(F.col("entity_id").alias("source_id"))
        return s.join(e, F.col("source_id") == F.col("__here")).join(n, F.col("__there") == F.col("node.entity_id")).select("source_id", "edge", "node")
    s = sources.select(F.col("entity_id").alias("source_id"), F.col("query_as_of").alias("at"))
    near = edges.join(s.distinct(), (F.col(here) == F.col("source_id")) & (F.col("captured_at") <= F.col("at"))).select(*ENTITY, F.col("at").alias("instant"))
    # An edge that led from here once may lead from elsewhere by then.
    e = _as_of_each(edges, near, ending).select(F.col(here).alias("__here"), F.col(there).alias("__there"), F.col("instant").alias("__at"), F.struct("*").alias("edge"))
    found = s.join(e, (F.col("source_id") == F.col("__here")) & (F.col("at") == F.col("__at")))
    kinds = nodes.select("entity_type").distinct()
    ends = found.select(F.col("__there").alias("entity_id"), F.col("at").alias("instant")).distinct().join(kinds)  # a model's few types
    n = _as_of_each(nodes, ends, ending).select(F.col("instant").alias("__then"), F.struct("*").alias("node"))
    return found.join(n, (F.col("__there") == F.col("node.entity_id")) & (F.col("at") == F.col("__then"))).select("source_id", F.col("at").alias("query_as_of"), "edge", "node")


def project(h: DataFrame, recorded_at, valid_at, keys: tuple[str, ...] = ("is_edge", *ENTITY), check: bool = True) -> DataFrame:
    """The world valid at one time as known at another: half-open validity, closed envelopes first.

    Two envelopes of an entity captured at once and valid from the same time are
    ambiguous: ValueError, if ``check``.  Entities that the latest envelope ends are left out.
    """
    recorded, valid = F.lit(recorded_at).cast("timestamp"), F.lit(valid_at).cast("timestamp")
    known = h.filter((F.col("captured_at") <= recorded) & (F.col("valid_from") <= valid) & (F.col("valid_to").isNull() | (valid < F.col("valid_to"))))
    if check and not known.groupBy(*keys, "captured_at", "valid_from").count().filter("count > 1").isEmpty():
        raise ValueError("envelopes are ambiguous")
    return _active(_latest(known, keys, F.desc("captured_at"), F.desc("valid_from"), F.col("valid_to").isNull()))


def classify(before: DataFrame, after: DataFrame, same_recorded: bool, same_valid: bool) -> str:
    """What sets two projections apart: nothing, valid time, recorded knowledge, or both."""
    if diff(before, after).isEmpty():
        return "Same"
    if same_recorded:
        return "ValidTimeEvolution"
    return "RecordedKnowledgeCorrection" if same_valid else "Mixed"


def snapshot(rows: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """(id, fingerprint) of rows; the fingerprint is of their payload."""
    return rows.select(F.col(key).alias("id"), F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256).alias("fingerprint"))


def content_fingerprint(snap: DataFrame, parts: int = 1024) -> str:
    """One digest of a snapshot that doesn't depend on how its rows lie.

    Folded in two levels: rows by id within hash parts, then the parts.
    """
    by = snap.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(F.concat_ws(":", F.col("id").cast("string"), "fingerprint")))), 256).alias("digest"))
    return by.agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(F.concat_ws(":", "part", "digest")))), 256)).first()[0]


def diff(before: DataFrame, after: DataFrame, key: str = "id", value: str = "fingerprint") -> DataFrame:
    """(id, change) where two snapshots differ: Added, Removed or Modified."""
    b, a = before.select(F.col(key).alias("b_id"), F.col(value).alias("b_value")), after.select(F.col(key).alias("a_id"), F.col(value).alias("a_value"))
    both = b.join(a, F.col("b_id") == F.col("a_id"), "full_outer")
    change = F.when(F.col("b_id").isNull(), "Added").when(F.col("a_id").isNull(), "Removed").when(~F.col("b_value").eqNullSafe(F.col("a_value")), "Modified")
    return both.select(F.coalesce("a_id", "b_id").alias("id"), change.alias("change")).filter("change is not null")


def timeline(states: DataFrame) -> DataFrame:
    """Counts of changes from each version to the next of states (version, id, fingerprint).

    Versions increase strictly; a state that a version lacks was removed.  One
    shuffle: each id's versions are compared with their neighbours, instead of a
    join for each pair of versions.
    """
    versions = states.select("version").distinct()
    order = Window.orderBy("version")  # one row a version
    steps = versions.withColumns({"previous": F.lag("version").over(order), "next": F.lead("version").over(order)})
    rows = states.join(F.broadcast(steps), "version")
    by_id = Window.partitionBy("id").orderBy("version")
    rows = rows.withColumns({"had": F.lag("version").over(by_id), "old": F.lag("fingerprint").over(by_id), "has": F.lead("version").over(by_id)})
    came = F.when(F.col("previous").isNull(), None).when(~F.col("had").eqNullSafe(F.col("previous")), "Added").when(F.col("old") != F.col("fingerprint"), "Modified")
    left = F.when(F.col("next").isNotNull() & ~F.col("has").eqNullSafe(F.col("next")), "Removed")
    events = rows.select(F.explode(F.array(F.struct(F.col("version").alias("version"), came.alias("change")), F.struct(F.col("next").alias("version"), left.alias("change")))).alias("x")).select("x.*").filter("change is not null")
    n = events.groupBy("version").agg(*[F.sum((F.col("change") == c).cast("long")).alias(c.lower()) for c in ("Added", "Removed", "Modified")])
    return versions.filter("version is not null").join(n, "version", "left").na.fill(0, ["added", "removed", "modified"])
