"""A live graph from a stream of changes, and what is computed at each update."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwell.operators.deltas import Rejected, apply_delta
from arcwell.operators.twin import drift
from arcwell.scratch import cut

CHANGE = "sequence long, op string, kind string, id long, from_id long, to_id long"
_STATE = "epoch long, sequence long, nodes string, edges string"


class OutOfOrder(ValueError):
    """A change whose sequence isn't beyond those applied, or isn't a sequence."""


class LiveGraph:
    """Nodes and edges, with any properties, that follow a change feed.

    Sequences are positive and increase strictly over the whole feed; changes with one
    sequence are one delta.  A micro-batch of at most ``max_changes`` changes is folded into its
    net change on the driver, each sequence checked against what the ones before left; then
    the graph is written once.  A batch that fails changes nothing and may come again; one that
    was applied (by its epoch) isn't applied twice.  With ``state``, a folder, a new
    ``LiveGraph`` goes on where the last one stopped.
    """

    def __init__(
        self, nodes: DataFrame, edges: DataFrame, resume_after: int = 0, max_changes: int = 100_000, on_update: Callable[[LiveGraph], None] | None = None, state: str | None = None
    ):
        self.sequence, self.epoch, self.state = resume_after, -1, state
        self.max_changes, self.on_update, self.updates = max_changes, on_update, []
        last = self._saved(nodes.sparkSession)
        if last is None:
            self.nodes, self.edges = cut(nodes), cut(edges)
        else:
            self.epoch, self.sequence = last["epoch"], last["sequence"]
            self.nodes, self.edges = (nodes.sparkSession.read.schema(df.schema).parquet(last[k]) for df, k in ((nodes, "nodes"), (edges, "edges")))

    def _saved(self, spark: SparkSession):
        if self.state is None:
            return None
        path = spark._jvm.org.apache.hadoop.fs.Path(self.state)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return spark.read.schema(_STATE).parquet(self.state).orderBy(F.desc("epoch")).first()

    def apply(self, batch: DataFrame, epoch: int | None = None) -> None:
        if epoch is not None and epoch <= self.epoch:
            return
        changes = batch.limit(self.max_changes + 1).toArrow().to_pylist()
        if not changes:
            return
        if len(changes) > self.max_changes:
            raise ValueError(f"more than {self.max_changes} changes at once")
        if any(c["sequence"] is None for c in changes):
            raise OutOfOrder("a change without a sequence")
        changes.sort(key=lambda c: (c["sequence"], c["kind"] != "node"))
        if changes[0]["sequence"] <= self.sequence:
            raise OutOfOrder(f"{changes[0]['sequence']} after {self.sequence}")
        fold = _Fold(self, changes)
        updates = [(s, fold.add(s)) for s in sorted({c["sequence"] for c in changes})]
        nodes, edges = fold.result(batch.schema)
        nodes, edges = cut(nodes), cut(edges)
        if self.state is not None:
            row = (self.epoch + 1 if epoch is None else epoch, updates[-1][0], nodes.inputFiles()[0].rpartition("/")[0], edges.inputFiles()[0].rpartition("/")[0])
            nodes.sparkSession.createDataFrame([row], _STATE).coalesce(1).write.mode("append").parquet(self.state)
        self.nodes, self.edges, self.sequence = nodes, edges, updates[-1][0]
        self.epoch = self.epoch + 1 if epoch is None else epoch
        self.updates += updates
        if self.on_update:
            self.on_update(self)


class _Fold:
    """The net change of a batch, sequence by sequence, over the rows that it names."""

    def __init__(self, graph: LiveGraph, changes: list[dict]):
        self.graph, self.by = graph, {}
        for c in changes:
            self.by.setdefault(c["sequence"], []).append(c)
        spark = graph.nodes.sparkSession
        ends = {c[k] for c in changes if c["kind"] == "edge" for k in ("from_id", "to_id")} - {None}
        ids = lambda kind: {c["id"] for c in changes if c["kind"] == kind} - {None}
        among = lambda df, v: df.join(spark.createDataFrame([(x,) for x in sorted(v)], "id long"), "id", "left_semi") if v else df.limit(0)
        self.nodes = {r["id"] for r in among(graph.nodes.select("id"), ids("node") | ends).collect()}
        #: Known edges that are named: their ends as they are by now.
        self.edges = {r["id"]: (r["from_id"], r["to_id"]) for r in among(graph.edges.select("id", "from_id", "to_id"), ids("edge")).collect()}
        self.base = (set(self.nodes), set(self.edges))
        self.last: dict[tuple[str, int], dict] = {}
        self.removed: set[int] = set()

    def add(self, sequence: int) -> int:
        """Checks and takes in the changes of a sequence; returns how many ids it touches."""
        wrong = lambda c, what: Rejected(f"{c['kind']} {c['id']} at {sequence}: {what}")
        delta, seen, gone = self.by[sequence], set(), set()
        before = (set(self.nodes), set(self.edges))
        for c in delta:
            known = before[0] if c["kind"] == "node" else before[1] if c["kind"] == "edge" else None
            if known is None or c["id"] is None or c["op"] not in ("add", "update", "remove"):
                raise wrong(c, "invalid")
            if (c["kind"], c["id"]) in seen:
                raise wrong(c, "changed twice")
            seen.add((c["kind"], c["id"]))
            if (c["id"] in known) != (c["op"] != "add"):
                raise wrong(c, "exists" if c["op"] == "add" else "missing")
            if c["kind"] == "node":
                (self.nodes.discard if c["op"] == "remove" else self.nodes.add)(c["id"])
                gone |= {c["id"]} if c["op"] == "remove" else set()
            elif c["op"] == "remove":
                self.edges.pop(c["id"])
            else:
                old = self.edges.get(c["id"], (None, None))
                new = tuple(c[k] if c[k] is not None or c["op"] == "add" else o for k, o in zip(("from_id", "to_id"), old, strict=True))
                if any(e not in self.nodes for e in new if c["op"] == "add" or e not in old):
                    raise wrong(c, "end missing")
                self.edges[c["id"]] = new
        touched = {i for c in delta for i in ((c["id"],) if c["kind"] == "node" else (c["from_id"], c["to_id"]))} - {None}
        for c in delta:
            self.last[c["kind"], c["id"]] = self._merged(c)
        self.removed |= gone
        for i in [i for i, ends in self.edges.items() if gone & set(ends)]:  # edges go with their ends
            self.edges.pop(i)
            self.last["edge", i] = {"op": "remove", "kind": "edge", "id": i}
        return len(touched | gone)

    def _merged(self, c: dict) -> dict:
        """A change on top of those before: an update of what the batch added is part of the addition."""
        had = self.last.get((c["kind"], c["id"]))
        if had is None or had["op"] == "remove" or c["op"] != "update":
            return dict(c)
        ends = {k: c[k] if c[k] is not None else had.get(k) for k in ("from_id", "to_id")}
        return {**c, **ends, "op": had["op"]}

    def result(self, schema) -> tuple[DataFrame, DataFrame]:
        rows = []
        for (kind, i), c in self.last.items():
            in_base = i in self.base[kind == "edge"]
            if c["op"] == "remove" and not in_base:
                continue
            rows.append(c if c["op"] == "remove" or in_base == (c["op"] == "update") else {**c, "op": "update" if in_base else "add"})
        spark = self.graph.nodes.sparkSession
        delta = spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
        # A node that went and came back lost its edges in between.
        back = sorted(i for i in self.removed if i in self.nodes)
        edges = self.graph.edges
        if back:
            lost = spark.createDataFrame([(i,) for i in back], "lost long")
            named = spark.createDataFrame([(i,) for kind, i in self.last if kind == "edge"], "id long")
            free = edges.join(lost, F.col("from_id") == F.col("lost"), "left_anti").join(lost, F.col("to_id") == F.col("lost"), "left_anti")
            edges = free.unionByName(edges.join(named, "id", "left_semi").join(free.select("id"), "id", "left_anti"))
        nodes, edges, _ = apply_delta(self.graph.nodes, edges, delta, check=False)
        return nodes, edges


def follow(spark: SparkSession, path: str, graph: LiveGraph, checkpoint: str, schema: str = CHANGE, files_per_batch: int = 1000) -> LiveGraph:
    """Applies all change files (JSON lines) of a folder and returns when there are no more.

    Files are taken in the order of their times; sequences must follow it.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
    query = stream.writeStream.foreachBatch(graph.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return graph


class TwinSynchronizer:
    """Drift of (expected, actual) worlds in order: sequences strictly increase, times don't fall."""

    def __init__(self) -> None:
        self.sequence, self.at, self.reports = 0, None, []

    def observe(self, sequence: int, at, expected: DataFrame, actual: DataFrame):
        if sequence <= self.sequence or (self.at is not None and at < self.at):
            raise OutOfOrder(f"{sequence} at {at} after {self.sequence} at {self.at}")
        self.sequence, self.at = sequence, at
        self.reports.append((sequence, drift(expected, actual).first().asDict()))
        return self.reports[-1]
