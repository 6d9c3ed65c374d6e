"""Graph changes: deltas between versions, mutation plans, upserts and change tracking.

A delta is a table (op: add, update, remove; kind: node, edge; id, from_id, to_id) and the
properties that it sets.  Columns of the graph that a delta doesn't have stay as they are in an
update and are null in what is added; those that it has are set, to null as well.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_OWN = ("op", "kind", "id", "from_id", "to_id")


class Rejected(ValueError):
    """A delta or mutation that doesn't fit the graph."""


def _some(df: DataFrame) -> bool:
    return not df.isEmpty()


def problems(nodes: DataFrame, edges: DataFrame, delta: DataFrame) -> DataFrame:
    """(kind, id, problem) of a delta: what it adds again, misses, changes twice or leaves without an end."""
    n, e = nodes.select("id", F.lit("node").alias("kind")), edges.select("id", F.lit("edge").alias("kind"))
    known = n.union(e).distinct().withColumn("known", F.lit(True))
    d = delta.join(known, ["kind", "id"], "left")
    bad = F.col("id").isNull() | ~F.col("op").isin("add", "update", "remove") | ~F.col("kind").isin("node", "edge")
    what = F.when(F.coalesce(bad, F.lit(True)), "invalid").when((F.col("op") == "add") & F.col("known"), "exists").when((F.col("op") != "add") & F.col("known").isNull(), "missing")
    wrong = d.select("kind", "id", what.alias("problem")).filter("problem is not null")
    twice = delta.groupBy("kind", "id").count().filter("count > 1").select("kind", "id", F.lit("changed twice").alias("problem"))
    removed = delta.filter("kind = 'node' and op = 'remove'").select(F.col("id").alias("end"))
    added = delta.filter("kind = 'node' and op = 'add'").select(F.col("id").alias("end"))
    after = nodes.select(F.col("id").alias("end")).join(removed, "end", "left_anti").union(added).distinct()
    changed = delta.filter("kind = 'edge' and op in ('add', 'update')").select("id", "op", F.explode(F.array("from_id", "to_id")).alias("end"))
    # An update without an end keeps the edge's own, which goes with its node.
    changed = changed.filter("op = 'add' or end is not null")
    loose = changed.join(after, "end", "left_anti").select(F.lit("edge").alias("kind"), "id", F.lit("end missing").alias("problem"))
    return wrong.union(twice).union(loose).distinct()


def _changed(rows: DataFrame, changes: DataFrame, ends: tuple[str, ...]) -> DataFrame:
    """``rows`` after the changes of their kind, with all their columns."""
    carried = [c for c in rows.columns if c != "id" and (c in ends or (c in changes.columns and c not in _OWN))]
    new = changes.select(F.col("id").alias("__id"), F.col("op").alias("__op"), *[F.col(c).alias(f"__{c}") for c in carried])
    j = rows.join(new, F.col("id") == F.col("__id"), "full_outer").filter("__op is null or __op <> 'remove'")
    fresh = F.col("__op") == "add"
    value = lambda c: F.when(F.col("__op").isNull() | (F.lit(c in ends) & F.col(f"__{c}").isNull() & ~fresh), F.col(c)).otherwise(F.col(f"__{c}"))
    kinds = dict(rows.dtypes)
    return j.select(*[F.coalesce("id", "__id").alias("id") if c == "id" else value(c).cast(kinds[c]).alias(c) if c in carried else F.when(~F.coalesce(fresh, F.lit(False)), F.col(c)).alias(c) for c in rows.columns])


def apply_delta(nodes: DataFrame, edges: DataFrame, delta: DataFrame, check: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and affected node ids after a delta; nodes and edges keep all their columns.

    Removed nodes take their edges along; an updated edge may get other ends.  ``Rejected``
    if something is added that exists, updated or removed that doesn't, changed twice, or left
    without an end.
    """
    if check and _some(wrong := problems(nodes, edges, delta)):
        first = wrong.orderBy("kind", "id", "problem").first()
        raise Rejected(f"{first['kind']} {first['id']}: {first['problem']}")
    dn, de = delta.filter("kind = 'node'"), delta.filter("kind = 'edge'")
    gone = dn.filter("op = 'remove'").select(F.col("id").alias("gone"))
    by_from = edges.join(gone, F.col("from_id") == F.col("gone"), "left_semi")
    by_to = edges.join(gone, F.col("to_id") == F.col("gone"), "left_semi")
    left = _changed(edges, de, ("from_id", "to_id"))
    new_edges = left.join(gone, F.col("from_id") == F.col("gone"), "left_anti").join(gone, F.col("to_id") == F.col("gone"), "left_anti")
    old = edges.join(de.filter("op <> 'add'").select("id"), "id", "left_semi")
    touched = [x.select(F.explode(F.array("from_id", "to_id")).alias("id")) for x in (by_from, by_to, old, de.filter("op <> 'remove'"))]
    affected = dn.select("id")
    for x in touched:
        affected = affected.union(x)
    return _changed(nodes, dn, ()), new_edges, affected.filter("id is not null").distinct()


@dataclass(frozen=True)
class Projection:
    """A graph under a key, in a version."""

    key: str
    version: int
    nodes: DataFrame
    edges: DataFrame

    def apply(self, delta: DataFrame, key: str, base_version: int, version: int | None = None) -> tuple[Projection, DataFrame]:
        """The next version and the affected ids; ``Rejected`` if the delta is for another key or version, or goes back."""
        if key != self.key:
            raise Rejected(f"a delta of {key} for {self.key}")
        if base_version != self.version:
            raise Rejected(f"a delta on version {base_version} for {self.version}")
        if version is not None and version <= base_version:
            raise Rejected(f"version {version} isn't beyond {base_version}")
        nodes, edges, affected = apply_delta(self.nodes, self.edges, delta)
        return replace(self, version=base_version + 1 if version is None else version, nodes=nodes, edges=edges), affected


def apply_or_rebuild(nodes: DataFrame, edges: DataFrame, delta: DataFrame, rebuild) -> tuple[DataFrame, DataFrame, bool]:
    """The delta's result, or ``rebuild()``'s if it is rejected; and whether it was rebuilt."""
    try:
        n, e, _ = apply_delta(nodes, edges, delta)
        return n, e, False
    except Rejected:
        return *rebuild(), True


def plan_edge_mutations(mutations: DataFrame, nodes: DataFrame, edges: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(seq, action, problem) of mutations (seq, op: connect, reconnect, disconnect; id, from_id, to_id) of edges.

    Ends must be nodes; connect needs a new id or none, the others a known one; disconnect
    without an id goes by its ends and must not fit several edges.  ``targets`` are the nodes of
    the edges' other end where they are of another type.
    """
    known = edges.select(F.col("id").alias("k_id"), F.lit(True).alias("known")).distinct()
    pairs = edges.groupBy(F.col("from_id").alias("p_from"), F.col("to_id").alias("p_to")).agg(F.count(F.lit(1)).alias("fits"))
    m = mutations.join(known, F.col("id") == F.col("k_id"), "left")
    for end, among in (("from_id", nodes), ("to_id", nodes if targets is None else targets)):
        m = m.join(among.select(F.col("id").alias(f"has_{end}")).distinct(), F.col(end) == F.col(f"has_{end}"), "left")
    m = m.join(pairs, (F.col("from_id") == F.col("p_from")) & (F.col("to_id") == F.col("p_to")), "left")
    op, no_id = F.col("op"), F.col("id").isNull()
    loose = F.col("has_from_id").isNull() | F.col("has_to_id").isNull()
    again = ~no_id & (F.row_number().over(Window.partitionBy("id").orderBy("seq")) > 1)
    action = F.when(op == "connect", "Insert").when(op == "reconnect", "Update").when((op == "disconnect") & no_id & F.col("fits").isNull(), "NoOp").when(op == "disconnect", "Delete")
    problem = (
        F.when(action.isNull(), "unknown operation").when(op.isin("connect", "reconnect") & loose, "end missing").when((op == "reconnect") & no_id, "missing id").when(again, "duplicate id")
        .when((op == "connect") & F.col("known"), "duplicate key").when(~no_id & op.isin("reconnect", "disconnect") & F.col("known").isNull(), "unknown edge")
        .when((op == "disconnect") & no_id & (F.col("fits") > 1), "ambiguous ends")
    )
    return m.select("seq", "op", "id", action.alias("action"), problem.alias("problem"))


def apply_mutations(rows: DataFrame, plan: DataFrame, mutations: DataFrame) -> DataFrame:
    """``rows`` (id and properties) after the actions of a plan; ``Rejected`` if it has a problem, and nothing is applied.

    ``mutations`` (seq, id and properties) give the values; properties that they don't have
    stay.  What is inserted without an id gets one beyond the largest, in the order of seq.
    """
    if _some(wrong := plan.filter("problem is not null")):
        first = wrong.orderBy("seq").first()
        raise Rejected(f"mutation {first['seq']}: {first['problem']}")
    todo = plan.select("seq", "action").join(mutations.drop("op"), "seq")
    kinds = dict(rows.dtypes)
    if _some(todo.filter("action = 'Insert' and id is null")):
        top = rows.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        top = max(top, todo.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
        # One mutation set's new rows, not the table's.
        turn = F.row_number().over(Window.partitionBy(F.col("id").isNull()).orderBy("seq"))
        todo = todo.withColumn("id", F.coalesce("id", F.lit(top) + turn))
    op = F.when(F.col("action") == "Delete", "remove").when(F.col("action") == "Insert", "add").otherwise("update")
    changes = todo.filter("action in ('Insert', 'Update', 'Delete')").withColumn("op", op).withColumn("id", F.col("id").cast(kinds["id"]))
    return _changed(rows, changes, ("from_id", "to_id") if "from_id" in rows.columns else ())


def plan_mutations(mutations: DataFrame, existing: DataFrame) -> DataFrame:
    """(seq, action, problem) of mutations (seq, op, id) of a node type.

    add inserts; upsert inserts without an id and updates with one; attach, update
    and remove need an id.  An id that an earlier mutation has is a duplicate.  An update of
    a row that has the same payload does nothing.
    """
    op, known = F.col("op"), existing.select(F.col("id").alias("k_id"), F.col("payload").alias("k_payload"))
    m = mutations.join(known, F.col("id") == F.col("k_id"), "left")
    earlier = F.when(F.col("id").isNotNull(), F.row_number().over(Window.partitionBy("id").orderBy("seq")) > 1).otherwise(False)
    same = F.col("k_id").isNotNull() & F.col("payload").eqNullSafe(F.col("k_payload"))
    action = (
        F.when(op == "add", "Insert").when(op == "attach", "Attach").when(op == "remove", "Delete")
        .when((op == "upsert") & F.col("id").isNull(), "Insert").when(op.isin("update", "upsert"), F.when(same, "NoOp").otherwise("Update"))
    )
    problem = (
        F.when(action.isNull(), "unknown operation").when(op.isin("attach", "update", "remove") & F.col("id").isNull(), "missing id")
        .when(earlier, "duplicate id").when((op == "add") & F.col("k_id").isNotNull(), "duplicate key")
    )
    return m.select("seq", "op", "id", action.alias("action"), problem.alias("problem"))


def upsert(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with those of ``changes`` put in or in place of rows with their key."""
    return rows.join(changes.select(key), key, "left_anti").unionByName(changes)


def remove_cascading(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select(F.col("id").alias("gone"))
    left = edges.join(gone, F.col("from_id") == F.col("gone"), "left_anti").join(gone, F.col("to_id") == F.col("gone"), "left_anti")
    return nodes.join(gone, F.col("id") == F.col("gone"), "left_anti"), left


def remove_edge(edges: DataFrame, from_id: int, to_id: int) -> DataFrame:
    """By its ends: none is fine, several are ambiguous (ValueError)."""
    hit = (F.col("from_id") == from_id) & (F.col("to_id") == to_id)
    if edges.filter(hit).limit(2).count() > 1:
        raise Rejected("several edges have these ends")
    return edges.filter(~hit)


def changed_properties(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(key, changed: names of properties that differ, nulls being equal) of rows in both."""
    props = [c for c in after.columns if c != key]
    b = before.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in props])
    names = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in props]), lambda x: x.isNotNull())
    return after.join(b, key).select(key, names.alias("changed")).filter(F.size("changed") > 0)


def save_versioned(rows: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Updates with the version they expect; ``Rejected`` if a row is gone or has another; saved ones are one higher."""
    have = rows.select(key, F.col("version").alias("has"))
    if _some(updates.join(have, key, "left").filter("has is null or has <> version")):
        raise Rejected("a row was changed meanwhile")
    return upsert(rows, updates.withColumn("version", F.col("version") + 1), key)
