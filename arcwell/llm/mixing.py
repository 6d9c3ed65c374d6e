"""Mixing sources to target weights, with DataFrame expressions only.

The words of each source, document after document, are packed into blocks of a
fixed number of words.  Every source gets as many output slots as its target
needs.  A seeded draw gives each output shard its counts of sources: multinomial
ones, conditioned on the exact totals, as every slot falls to a shard at random.
A shard's slots of a source follow on those of the shards before; the i-th slot of a
source is mapped through a pseudorandom permutation of the source's block indexes (a
new one each epoch), and slots and blocks are joined by index.  A whole epoch takes
each block once, so no document is taken more often than ``max_repeat`` times and a
source meets its target to a block and a half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcwell.llm.common import WORD, kept, table

#: Documents of a source that one task lays end to end.
_RUN = 8192
#: Slots that one row stands for before the last explode and before the one that comes first, and slots for each task.
_CHUNK, _FAR, _TASK = 1 << 16, 1 << 28, 1 << 20


def _primes(above: int, count: int) -> list[int]:
    out = []
    while len(out) < count:
        above += 1
        if all(above % d for d in range(2, int(above**0.5) + 1)):
            out.append(above)
    return out


#: Multipliers of the permutations.  Four primes over 2**20 can't all divide a
#: number below 2**63, and a multiplier times a block index below 2**42 fits a long.
_MULTIPLIERS = _primes(1 << 20, 16)


def source_targets(sized: DataFrame, weights: tuple[float, ...], max_repeat: int) -> DataFrame:
    """One row per source: sid, source, source_size, n_docs, weight, target.

    Sources by code point, null last, take the weights in turn.  The common
    level is found by filling up: sources in order of the level at which they
    reach ``max_repeat`` times their size, the rest sharing what is left; it is
    the largest of the levels so found.  Windows run over sources, not rows.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("sid", F.row_number().over(by_name).cast("long"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(everything) - before) / left)
    per = per.withColumn("level", F.max("level").over(everything))
    return per.select("sid", "source", "source_size", "n_docs", "weight", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def _plan(targets: DataFrame, block: int, max_repeat: int) -> DataFrame:
    """Adds n_blocks and n_slots: whole epochs, then as many blocks as come nearest."""
    t = targets.withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block)))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-9), F.lit(max_repeat))).otherwise(F.lit(0)).cast("long")
    t = t.withColumn("epochs", epochs)
    rest = F.round((F.col("target") - F.col("epochs") * F.col("source_size")) / F.lit(block)).cast("long")
    rest = F.when(F.col("epochs") >= max_repeat, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(rest, F.col("n_blocks"))))
    return t.withColumn("n_slots", F.col("epochs") * F.col("n_blocks") + rest).drop("epochs")


def _permuted(i: Column, n: Column, sid: Column, epoch: Column, seed: int) -> Column:
    """A permutation of 0 .. n-1 for each source and epoch: i times a prime that doesn't divide n, shifted."""
    draw = F.xxhash64(sid, epoch, F.lit(seed))
    turn = F.pmod(draw, F.lit(len(_MULTIPLIERS) - 4)).cast("int")
    # One of any four of the primes doesn't divide n.
    primes = F.array(*[F.lit(p).cast("long") for p in _MULTIPLIERS])
    factor = F.lit(None).cast("long")
    for k in range(4):
        p = F.element_at(primes, turn + k + 1)
        factor = F.coalesce(factor, F.when(n % p != 0, p))
    return F.pmod(i * factor + F.pmod(F.xxhash64(draw), n), n)


def shard_counts(plan: DataFrame, shard_slots: int, seed: int, tasks: int) -> DataFrame:
    """The draw: (sid, shard, count, before, n_blocks), before being the source's slots in earlier shards."""
    # A hot source is as many rows as it has chunks, dealt out before its slots are drawn.
    far = plan.withColumn("far", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slots") - 1, F.lit(_FAR).cast("long"))))
    chunks = far.withColumn("first", F.explode(F.sequence(F.col("far"), F.least(F.col("far") + _FAR, F.col("n_slots")) - 1, F.lit(_CHUNK).cast("long")))).repartition(tasks, "sid", "first")
    each = chunks.select("sid", "n_blocks", "n_shards", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + _CHUNK, F.col("n_slots")) - 1)).alias("k"))
    drawn = each.groupBy("sid", "n_blocks", F.pmod(F.xxhash64("sid", "k", F.lit(seed)), F.col("n_shards")).alias("shard")).agg(F.count(F.lit(1)).alias("count"))
    # As many rows a source as there are shards.
    before = F.sum("count").over(Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return drawn.withColumn("before", F.coalesce(before, F.lit(0).cast("long")))


def slots(targets: DataFrame, block: int = 32, shard_slots: int = 65536, max_repeat: int = 3, seed: int = 42) -> DataFrame:
    """The mix itself: one row per output slot: shard, sid, epoch, block."""
    plan = _plan(targets, block, max_repeat).filter("n_slots > 0").select("sid", "n_blocks", "n_slots")
    total = plan.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // _TASK))
    plan = plan.withColumn("n_shards", F.lit(max(1, -(-total // shard_slots))).cast("long"))
    counts = shard_counts(plan, shard_slots, seed, tasks).repartition(tasks, "sid", "shard")
    each = counts.withColumn("k", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("count") - 1)))
    epoch = F.floor(F.col("k") / F.col("n_blocks")).cast("long")
    return each.select("shard", "sid", epoch.alias("epoch"), _permuted(F.col("k") % F.col("n_blocks"), F.col("n_blocks"), F.col("sid"), epoch, seed).alias("block"))


def _placed(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds begin, each document's first word in its source's stream.

    A source's documents are laid out in runs, chosen by hash so that a hot
    source has as many as it needs; a running sum within runs, then over runs.
    """
    runs = targets.select("sid", F.col("source").alias("t_source"), "source_size", "target", F.ceil(F.col("n_docs") / F.lit(_RUN)).alias("n_runs"))
    rows = sized.join(runs, sized.source.eqNullSafe(runs.t_source)).drop("t_source")
    rows = rows.withColumn("run", F.pmod(F.xxhash64("id", "nth"), F.col("n_runs")))
    within = Window.partitionBy("sid", "run").orderBy("id", "nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    sums = rows.groupBy("sid", "run").agg(F.sum("size").alias("n"))
    base = sums.select("sid", "run", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(base.hint("merge"), ["sid", "run"]).withColumn("begin", F.col("base") + F.col("within")).drop("base", "within", "run", "n_runs")


def document_blocks(placed: DataFrame, block: int) -> DataFrame:
    """(id, nth, sid, block, first, words): which of its words each document gives to which blocks."""
    last = F.floor((F.col("begin") + F.col("size") - 1) / block)
    each = placed.filter("size > 0").select("id", "nth", "sid", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / block), last)).alias("block"))
    words = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("begin"), F.col("block") * block)
    first = F.greatest(F.lit(0), F.col("block") * block - F.col("begin"))
    return each.select("id", "nth", "sid", "block", first.cast("long").alias("first"), words.cast("long").alias("words"))


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), block: int = 32, shard_slots: int = 65536, max_repeat: int = 3, seed: int = 42
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    ``taken`` counts the words that the mix takes of the document, repeats
    included.  A null or empty text has size 0 and is never taken; null is a
    source of its own, the last; rows with equal or null doc_id are documents of
    their own.  No rows give no rows.  The same rows and seed give the same mix.
    """
    sized = kept(_numbered(_sized(docs)).select("doc_id", "source", "size", "id", "nth"), "sized")
    targets = kept(source_targets(sized, weights, max_repeat), "targets")
    taken = _taken_blocks(sized, targets, block, shard_slots, max_repeat, seed).groupBy("id", "nth").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = sized.join(targets.select(F.col("source").alias("t_source"), "source_size", "target"), sized.source.eqNullSafe(F.col("t_source")))
    out = out.join(taken.hint("merge"), ["id", "nth"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _sized(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, source, text and the columns ``carry``, whatever else ``docs`` has, with size."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"), *carry, size.alias("size"))


def _numbered(sized: DataFrame) -> DataFrame:
    """Adds a key (id, nth) that tells rows with the same or no doc_id apart, alike in every run.

    Without such rows nothing needs to be brought together.
    """
    repeated = not sized.groupBy("doc_id").count().filter("count > 1").isEmpty()
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("source", "size", F.xxhash64("text"))) if repeated else F.lit(1)
    sized = sized.withColumn("nth", nth)
    return sized.withColumn("nth", F.when(F.col("doc_id").isNull(), -F.col("nth")).otherwise(F.col("nth"))).withColumn("id", F.coalesce("doc_id", F.lit(0).cast("long")))


def _taken_blocks(sized: DataFrame, targets: DataFrame, block: int, shard_slots: int, max_repeat: int, seed: int, how: str = "inner") -> DataFrame:
    """(id, nth, sid, block, first, words, times): what the mix takes, by document and block, and how often.

    With ``how`` left, blocks that it doesn't take are there with null times.
    """
    times = slots(targets, block, shard_slots, max_repeat, seed).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    return document_blocks(_placed(sized, targets), block).join(times.hint("merge"), ["sid", "block"], how)


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), block: int = 32, shard_slots: int = 65536, max_repeat: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) as the mix takes them.

    A document is returned once for each epoch that takes words of it, with these
    words: its text unchanged if it is taken whole, else its words of the blocks taken, with
    single blanks between.  What the mix doesn't take is not returned.
    """
    numbered = _numbered(_sized(docs, "lang"))
    sized = kept(numbered.select("doc_id", "source", "size", "id", "nth"), "sized")
    targets = kept(source_targets(sized, weights, max_repeat), "targets")
    blocks = _taken_blocks(sized, targets, block, shard_slots, max_repeat, seed, "left").withColumn("times", F.coalesce("times", F.lit(0).cast("long")))
    # As many as a document has blocks.
    lists = blocks.groupBy("id", "nth").agg(F.max("times").alias("most"), F.min("times").alias("least"), F.sort_array(F.collect_list(F.struct("first", "words", "times"))).alias("blocks")).filter("most > 0")
    rows = numbered.join(lists.hint("merge"), ["id", "nth"])
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most"))))
    # Arrays side by side: each is made once for a row, not once for a block.
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    taken = F.flatten(F.transform("blocks", lambda b: F.array_repeat(b["times"] >= F.col("epoch"), b["words"].cast("int"))))
    some = F.array_join(F.filter(F.zip_with(words, taken, lambda w, t: F.when(t, w)), lambda w: w.isNotNull()), " ")
    whole = F.col("least") >= F.col("epoch")
    out = rows.withColumn("taken_text", F.when(whole, F.col("text")).otherwise(some))
    return out.select("doc_id", F.col("taken_text").alias("text"), "lang", "source", F.length("taken_text").cast("long").alias("n_chars"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_sources(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")
