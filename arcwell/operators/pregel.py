"""Vertex programs: supersteps of messages and updates, as joins and aggregations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwell.scratch import cut


def run(
    nodes: DataFrame,
    edges: DataFrame,
    initial: Column,
    message: Callable[[Column, Column], Column],
    reduce: Callable[[Column], Column],
    update: Callable[[Column, Column], Column],
    direction: str = "out",
    supersteps: int = 100,
    max_messages: int | None = 1_000_000,
    send_to: Callable[[Column], Column] | None = None,
    halt: Callable[[Column, Column], Column] | None = None,
) -> tuple[DataFrame, int]:
    """(id, state) and the supersteps run.

    ``initial`` is each node's state from its columns.  An active node sends
    ``message(state, edge weight)`` over its out, in or both edges (null: nothing), and what
    ``send_to(state)`` says, an array of structs (id, message), to any nodes.  Messages are reduced
    by target and ``update(state, reduced)`` gives the new state.  A node halts where
    ``halt(old state, new state)`` is true, by default if its state stays the same, until a
    message wakes it; the program ends when none is sent and all have halted.  ValueError
    beyond ``max_messages`` in a superstep.
    """
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1)
    ways = {"out": edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), weight.alias("w")), "in": edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"), weight.alias("w"))}
    links = cut(ways["out"].union(ways["in"]) if direction == "both" else ways[direction])
    state = cut(nodes.select("id", initial.alias("state"), F.lit(True).alias("active")))
    for step in range(supersteps):
        active = state.filter("active")
        sent = active.join(links, F.col("id") == F.col("a")).select(F.col("b").alias("to"), message(F.col("state"), F.col("w")).alias("m"))
        if send_to is not None:
            sent = sent.union(active.select(F.explode(send_to(F.col("state"))).alias("x")).select("x.*"))
        got = cut(sent.filter("m is not null").groupBy("to").agg(reduce(F.col("m")).alias("m"), F.count(F.lit(1)).alias("n")))
        n = got.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if max_messages is not None and n > max_messages:
            raise ValueError(f"{n} messages in a superstep")
        old = F.col("state")
        new = F.when(F.col("to").isNull(), old).otherwise(update(old, F.col("m")))
        stays = new.eqNullSafe(old) if halt is None else F.coalesce(halt(old, new), F.lit(False))
        if halt is not None:  # what has halted stays so without a message
            stays = F.when(F.col("to").isNull() & ~F.col("active"), F.lit(True)).otherwise(stays)
        state = cut(state.join(got, F.col("id") == F.col("to"), "left").select("id", new.alias("state"), (~stays).alias("active")))
        if state.filter("active").isEmpty():
            return state.select("id", "state"), step + 1
    return state.select("id", "state"), step + 1
    return state.select("id", "state"), supersteps
