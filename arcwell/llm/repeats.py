"""Finding what a corpus says twice: the plan that two operators share.

1. Every document is cut into stretches (see ``anchors``): runs of windows with a
   common anchor, 1 for about 40 bytes or 15 words.
2. Stretches meet by anchor.  Equal stretches are one class, represented by its
   first place; only classes whose anchor has other classes need a comparison.
   Anchors that a bounded sample of documents has often go another way with the same
   result: their classes are aggregated before they are shuffled, and joined back.
3. Representatives are read from their documents and compared in collections: all
   of an anchor's, several anchors to a collection.  An anchor with too many classes
   for a collection gives its single windows instead, which are aggregated by content, so
   memory is bounded whatever the corpus repeats.
4. What copies and comparisons mark is gathered by document and taken out.

A place is a document's id and a long: in its high half a hash of the text where
ids repeat, else 0; in its low half the position.  Rows with the same id and text
are one document, which isn't its own copy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcwell.llm.anchors import Spans, byte_codes, stretches
from arcwell.llm.common import kept, small_batches

#: Texts cut at once.
_TEXTS = 256
#: Symbols of a collection, and classes of an anchor beyond which its windows are aggregated.
COLLECTION, MOST_CLASSES = 1 << 21, 1 << 12
#: Documents of the sample that shows which anchors are hot, and how often these are in it.
SAMPLED, HOT = 20_000, 64
_LOW = 1 << 32


@dataclass(frozen=True)
class Symbols:
    """What a text is a sequence of: bytes, or words known by their hashes."""

    words: bool

    def codes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts, and where each text begins and the last ends."""
        if self.words:
            parts = [t.split() for t in texts]
            digest = xxhash.xxh64_intdigest
            flat = np.fromiter((digest(w) for p in parts for w in p), np.uint64)
        else:
            parts = texts
            flat = byte_codes()[np.frombuffer(b"".join(texts), np.uint8)]
        return flat, np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)

    def pack(self, text: bytes) -> np.ndarray:
        """The symbols as they travel: bytes themselves, words as 64-bit codes."""
        return self.codes([text])[0] if self.words else np.frombuffer(text, np.uint8)


def _texts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry]).alias("carried"))
    repeated = not texts.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty()
    return texts.select("doc_id", (F.hash("text") if repeated else F.lit(0)).cast("int").alias("version"), "text", "carried")


def _cut(texts: DataFrame, symbols: Symbols, window: int, gram: int) -> DataFrame:
    """(anchor, class, doc_id, at) of every stretch; a class's low byte is its number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(lo, _TEXTS)
                codes, bounds = symbols.codes([(t or "").encode() for t in part.column("text").to_pylist()])
                doc, start, n, anchor, content = stretches(codes, bounds, window, gram)
                version = part.column("version").to_numpy().astype(np.int64)[doc]
                classes = (content & ~np.uint64(0xFF)) | n.astype(np.uint64)
                # 48 bits of an anchor: others that share them are only compared in vain.
                arrays = [(anchor >> np.uint64(16)).astype(np.int64), classes.view(np.int64), part.column("doc_id").to_numpy()[doc], version * _LOW + start]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["anchor", "class", "doc_id", "at"])

    if window - gram + 1 > 255:
        raise ValueError("a stretch may have 255 windows at most")
    return texts.select("doc_id", "version", "text").mapInArrow(run, "anchor long, class long, doc_id long, at long")


def _hot(texts: DataFrame, symbols: Symbols, window: int, gram: int) -> DataFrame:
    """(anchor) of those that the sample has often: as few as it has stretches for, whatever the corpus.

    It only says which way an anchor's stretches go, not what comes of it.
    """
    share = F.lit(max(1, texts.count() // SAMPLED))
    sample = texts.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), share) == 0)
    return _cut(sample, symbols, window, gram).groupBy("anchor").count().filter(F.col("count") >= HOT).select("anchor")


def _marked(cuts: DataFrame, hot: DataFrame, all_copies: bool) -> DataFrame:
    """(doc_id, at, n, copy, anchor): stretches that are copies, and representatives to compare (with their anchor).

    Copies are all places of a class that has several, or all but the first.
    """
    hot = F.broadcast(hot)  # bounded by the sample
    often = kept(cuts.join(hot, "anchor"), "hot")
    rows = _by_window(cuts.join(hot, "anchor", "left_anti"), all_copies).unionByName(_by_aggregate(often, all_copies))
    compare = F.col("is_first") & F.col("several")
    rows = rows.filter(F.col("copy") | compare)
    return rows.select("doc_id", "at", F.col("class").bitwiseAND(F.lit(0xFF)).cast("int").alias("n"), "copy", F.when(compare, F.col("anchor")).alias("anchor"))


def _by_window(cuts: DataFrame, all_copies: bool) -> DataFrame:
    by_anchor = Window.partitionBy("anchor").orderBy("class", "doc_id", "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_class = Window.partitionBy("anchor", "class").orderBy("doc_id", "at")
    place = F.struct("doc_id", "at")
    first = F.first(place).over(by_class)
    copy = first != place
    if all_copies:
        copy = first != F.last(place).over(by_class.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    several = F.first("class").over(by_anchor) != F.last("class").over(by_anchor)
    return cuts.select("*", copy.alias("copy"), (first == place).alias("is_first"), several.alias("several"))


def _by_aggregate(cuts: DataFrame, all_copies: bool) -> DataFrame:
    """The same, with what is aggregated on the map side and joins that Spark can split."""
    classes = kept(cuts.groupBy("anchor", "class").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("places")), "classes")
    several = classes.groupBy("anchor").agg((F.count(F.lit(1)) > 1).alias("several"))
    classes = classes.join(F.broadcast(several), "anchor")  # as many anchors as the sample shows to be hot
    rows = cuts.join(classes, ["anchor", "class"])
    is_first = F.col("first") == F.struct("doc_id", "at")
    copy = F.col("places") > 1 if all_copies else ~is_first
    return rows.select(*cuts.columns, copy.alias("copy"), is_first.alias("is_first"), "several")


def _with_text(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """(doc_id, version, text, reps) of documents that have representatives."""
    wanted = reps.select("doc_id", F.shiftright("at", 32).cast("int").alias("version"), F.struct("anchor", F.col("at").bitwiseAND(F.lit(_LOW - 1)).alias("start"), "n", "copy").alias("rep"))
    by_doc = wanted.groupBy("doc_id", "version").agg(F.collect_list("rep").alias("reps"))  # as many as a document has stretches at most
    return texts.join(by_doc, ["doc_id", "version"]).select("doc_id", "version", "text", "reps")


def _reps_of(batch: pa.RecordBatch, i: int, symbols: Symbols) -> tuple[int, int, np.ndarray, list[np.ndarray]]:
    doc_id, version, text = (batch.column(k)[i].as_py() for k in range(3))
    reps = batch.column(3)[i].values
    return doc_id, version, symbols.pack(text.encode()), [reps.field(k).to_numpy(zero_copy_only=False) for k in range(4)]


def _read(texts: DataFrame, reps: DataFrame, symbols: Symbols, window: int) -> DataFrame:
    """(key, doc_id, at, copy, symbols) of representatives; the key is the anchor."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, version, own, (anchor, start, n, copy) = _reps_of(batch, i, symbols)
                pieces = [own[a : a + k + window - 1].tobytes() for a, k in zip(start.tolist(), n.tolist(), strict=True)]
                arrays = [pa.array(anchor), pa.array(np.full(len(start), doc_id)), pa.array(version * _LOW + start), pa.array(copy.astype(bool)), pa.array(pieces, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "doc_id", "at", "copy", "symbols"])

    return _with_text(texts, reps).mapInArrow(run, "key long, doc_id long, at long, copy boolean, symbols binary")


def _repeated_windows(texts: DataFrame, reps: DataFrame, symbols: Symbols, window: int, all_copies: bool) -> DataFrame:
    """(doc_id, at, length) of representatives' windows that occur again, aggregated by content."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, version, own, (anchor, start, n, _) = _reps_of(batch, i, symbols)
                at = np.repeat(start, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                content = Spans(own if symbols.words else byte_codes()[own])(at, at + window)
                arrays = [pa.array(np.repeat(anchor, n)), pa.array(content.view(np.int64)), pa.array(np.full(len(at), doc_id)), pa.array(version * _LOW + at)]
                yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "content", "doc_id", "at"])

    rows = kept(_with_text(texts, reps).mapInArrow(run, "anchor long, content long, doc_id long, at long"), "windows")
    again = rows.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("places")).filter("places > 1")
    found = rows.join(again, ["anchor", "content"])
    if not all_copies:
        found = found.filter(F.col("first") != F.struct("doc_id", "at"))
    return found.select("doc_id", "at", F.lit(window).alias("length"))


@dataclass
class Collection:
    """Strings to compare: their places, whether they are marked already, and their symbols."""

    doc_id: np.ndarray
    at: np.ndarray
    copy: np.ndarray
    strings: list[bytes]


def _collections(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Collection]:
    """Consecutive keys as collections; a key has ``MOST_CLASSES`` strings at most and isn't divided."""
    held: list[tuple] = []
    size, last = 0, None
    for batch in batches:
        for key, doc_id, at, copy, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if key != last and size >= COLLECTION:
                yield _collection(held)
                held, size = [], 0
            last = key
            held.append((doc_id, at, copy, data))
            size += len(data) // width
    if held:
        yield _collection(held)


def _collection(rows: list[tuple]) -> Collection:
    doc_id, at, copy, strings = zip(*rows, strict=True)
    return Collection(np.array(doc_id, np.int64), np.array(at, np.int64), np.array(copy, bool), list(strings))


def repeated_spans(
    texts: DataFrame, symbols: Symbols, window: int, gram: int, compare: Callable[[Collection], tuple[np.ndarray, np.ndarray, np.ndarray]], all_copies: bool
) -> DataFrame:
    """(doc_id, version, spans) of documents with something to take out; a span is start * 65536 + length.

    ``compare`` gets a collection and returns string index, start and length (in
    symbols, from the string's begin) of what it marks.
    """
    hot = kept(_hot(texts, symbols, window, gram), "anchors")
    marks = kept(_marked(_cut(texts, symbols, window, gram), hot, all_copies), "marks")
    copies = marks.filter("copy").select("doc_id", "at", (F.col("n") + window - 1).alias("length"))
    reps = marks.filter("anchor is not null").select("doc_id", "at", "n", "copy", "anchor")
    many = kept(reps.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes")).filter(F.col("classes") > MOST_CLASSES).select("anchor"), "many")
    found = _read(texts, reps.join(many, "anchor", "left_anti"), symbols, window).repartition("key").sortWithinPartitions("key", "doc_id", "at")

    def run(batches):
        for c in _collections(batches, 8 if symbols.words else 1):
            which, start, length = compare(c)
            yield pa.RecordBatch.from_arrays([pa.array(c.doc_id[which]), pa.array(c.at[which] + start), pa.array(length.astype(np.int32))], names=["doc_id", "at", "length"])

    compared = found.mapInArrow(run, "doc_id long, at long, length int")
    spans = copies.union(compared).union(_repeated_windows(texts, reps.join(many, "anchor"), symbols, window, all_copies))
    start = F.col("at").bitwiseAND(F.lit(_LOW - 1))
    return spans.groupBy("doc_id", F.shiftright("at", 32).cast("int").alias("version")).agg(F.collect_list(start * 65536 + F.col("length")).alias("spans"))


def covered(spans: pa.ListScalar | None, size: int) -> np.ndarray:
    """Which of ``size`` symbols the spans cover."""
    if spans is None or spans.values is None:
        return np.zeros(size, bool)
    x = spans.values.to_numpy()
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, x >> 16, 1)
    np.add.at(steps, (x >> 16) + (x & 0xFFFF), -1)
    return np.cumsum(steps[:-1]) > 0


def with_spans(docs: DataFrame, symbols: Symbols, window: int, gram: int, compare, all_copies: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, spans) and the columns ``carry`` for every row of ``docs``; rows without an id have no spans."""
    small_batches(docs.sparkSession)
    texts = _texts(docs, carry)
    known = texts.filter("doc_id is not null")
    spans = repeated_spans(known, symbols, window, gram, compare, all_copies)
    # The same exchange of the texts serves this join and the reading of representatives.
    found = known.join(spans, ["doc_id", "version"], "left").select("doc_id", "text", "spans", "carried")
    found = found.union(texts.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<bigint>"), "carried"))
    return found.select("doc_id", "text", "spans", *[F.col("carried")[c].alias(c) for c in carry])
