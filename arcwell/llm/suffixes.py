"""Suffix-array deduplication by column-wise construction over many strings.

The Burrows-Wheeler transform of a collection and its common prefixes are built
a column at a time: each round puts one more symbol before every string's last
suffix.  Where the new suffixes go follows from the transform alone (they are the
occurrences of their first symbol, in order), and a new common prefix is one more
than the least between the occurrences before it.  Both sequences are kept in
files of the shared folder that every round reads and writes from end to end, in pieces.

Equal windows are then neighbours: groups of suffixes whose common prefixes are
at least a window.  The first place of a group stays, the others are taken out.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwell.llm.anchors import Spans, byte_codes
from arcwell.llm.common import scratch_path, store, table
from arcwell.llm.repeats import Collection, Symbols, covered, with_spans

WINDOW, GRAM = 100, 32
#: Bytes of a file that are read or written at once.
_PIECE = 1 << 20


class _Files:
    """Two sequences of bytes in a file; a round reads one from end to end and writes the next.

    In a folder of its own below the shared one, so attempts of a task don't meet; without a
    folder the sequences stay in memory.
    """

    def __init__(self, folder: str | None):
        self.store, self.root, self.turn, self.held = None, "", 0, None
        if folder is not None:
            self.store, self.root = store(f"{folder}/{uuid.uuid4().hex}")
            self.store.create_dir(self.root, recursive=True)

    def put(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        if self.store is None:
            self.held = (bwt, lcp)
            return
        self.turn += 1
        with self.store.open_output_stream(f"{self.root}/{self.turn % 2}", compression=None) as out:
            for sequence in (bwt, lcp):
                for at in range(0, len(sequence), _PIECE):
                    out.write(sequence[at : at + _PIECE])

    def get(self) -> tuple[np.ndarray, np.ndarray]:
        if self.store is None:
            return self.held
        with self.store.open_input_stream(f"{self.root}/{self.turn % 2}", compression=None) as file:
            data = bytearray()
            while piece := file.read(_PIECE):
                data += piece
        both = np.frombuffer(data, np.uint8)
        return both[: len(both) // 2], both[len(both) // 2 :]

    def close(self) -> None:
        if self.store is not None:
            self.store.delete_dir(self.root)


def _least(lcp: np.ndarray, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """The least of lcp[after + 1 .. upto] for pairs of positions."""
    order = np.argsort(-after)
    index = np.empty(2 * len(after), np.int64)
    index[0::2], index[1::2] = after[order] + 1, upto[order] + 1
    # Descending, so that what reduceat takes between two pairs is a single element.
    out = np.empty(len(after), lcp.dtype)
    out[order] = np.minimum.reduceat(np.append(lcp, lcp.dtype.type(0)), index)[0::2]
    return out


def collection_bwt(strings: list[np.ndarray], folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Transform and common prefixes of all suffixes of byte strings of 254 bytes at most.

    A string's end sorts before every symbol, ends in the order of the strings.
    The transform has dense codes from 1 (0: a string's begin); common prefixes
    are in symbols.  Each string has an empty suffix; they come first.
    """
    n = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    if sizes.max(initial=0) > 254:
        raise ValueError("a string is too long for the files' bytes")
    ends = np.cumsum(sizes)
    flat = np.concatenate([*strings, np.empty(0, np.uint8)])
    used, dense = np.unique(flat, return_inverse=True)
    if len(used) > 255:
        raise ValueError("a collection may have 255 different bytes at most")
    flat = (dense + 1).astype(np.uint8)
    files = _Files(folder)
    try:
        files.put(np.zeros(n, np.uint8), np.zeros(n, np.uint8))
        place = np.arange(n)  # where each string's last suffix is
        live = np.arange(n)
        for column in range(1, int(sizes.max(initial=0)) + 1):
            live = live[sizes[live] >= column]
            bwt, lcp = files.get()
            bwt = bwt.copy()
            new = np.zeros(len(bwt), bool)
            bwt[place[live]] = flat[ends[live] - column]
            new[place[live]] = True
            order = np.argsort(bwt, kind="stable")
            order = order[len(bwt) - np.count_nonzero(bwt) :]
            fresh = new[order]
            at = np.flatnonzero(fresh)
            # New suffixes are in the order of their first symbols, then of what follows these.
            place[live[np.lexsort((place[live], bwt[place[live]]))]] = n + at
            out_bwt, out_lcp = np.zeros(n + len(order), np.uint8), np.zeros(n + len(order), np.uint8)
            out_bwt[:n] = bwt[:n]
            old = ~fresh
            out_bwt[n:][old], out_lcp[n:][old] = bwt[n:], lcp[n:]
            again = np.union1d(at, at + 1)
            again = again[(again > 0) & (again < len(order))]
            symbol = bwt[order[again]]
            same = symbol == bwt[order[again - 1]]
            out_lcp[n + again[~same]] = 0
            again = again[same]
            out_lcp[n + again] = _least(lcp, order[again - 1], order[again]) + 1
            if len(at) and at[0] == 0:
                out_lcp[n] = 0
            files.put(out_bwt, out_lcp)
        return files.get()
    finally:
        files.close()


def suffix_places(bwt: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every suffix in order: its string and its length, by following the transform."""
    n = len(sizes)
    order = np.argsort(bwt, kind="stable")
    order = order[len(bwt) - np.count_nonzero(bwt) :]
    follow = np.empty(len(bwt), np.int64)
    follow[order] = n + np.arange(len(order))
    string, length = np.empty(len(bwt), np.int64), np.zeros(len(bwt), np.int64)
    at, live = np.arange(n), np.arange(n)
    string[:n] = live
    for column in range(1, int(sizes.max(initial=0)) + 1):
        keep = sizes[live] >= column
        live, at = live[keep], follow[at[keep]]
        string[at], length[at] = live, column
    return string, length


def sharing(strings: list[bytes], window: int) -> np.ndarray:
    """The strings of which a window's hash occurs in others too; the rest have no equal windows to find."""
    sizes = np.array([len(s) for s in strings], np.int64)
    n = np.maximum(sizes - window + 1, 0)
    owner = np.repeat(np.arange(len(strings)), n)
    start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(sizes) - sizes, n)
    hashes = Spans(byte_codes()[np.frombuffer(b"".join(strings), np.uint8)])(start, start + window)
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    found = np.zeros(len(strings), bool)
    found[owner[order[1:][same]]] = True
    found[owner[order[:-1][same]]] = True
    return np.flatnonzero(found)


def later_windows(c: Collection, window: int = WINDOW, folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What of a collection's strings is covered by windows that also start earlier: string, start and length."""
    some = sharing(c.strings, window)
    if not len(some):
        return some, some, some
    which, start, length = _later(Collection(c.doc_id[some], c.at[some], c.copy[some], [c.strings[i] for i in some]), window, folder)
    return some[which], start, length


def _later(c: Collection, window: int, folder: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    strings = [np.frombuffer(s, np.uint8) for s in c.strings]
    if len(np.unique(np.concatenate(strings))) > 255:
        return _halves(c, window)
    sizes = np.array([len(s) for s in strings], np.int64)
    bwt, lcp = collection_bwt(strings, folder)
    string, length = suffix_places(bwt, sizes)
    group = np.cumsum(lcp < window)
    good = np.flatnonzero(length >= window)
    string, group, start = string[good], group[good], sizes[string[good]] - length[good]
    order = np.lexsort((c.at[string] + start, c.doc_id[string], group))
    string, group, start = string[order], group[order], start[order]
    head = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.empty(0, bool)
    first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    later = (c.doc_id[string] != c.doc_id[string[first]]) | (c.at[string] + start != c.at[string[first]] + start[first])
    return _runs(string[later], start[later], window)


def _runs(string: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows of a string as one stretch: string, start and length."""
    order = np.lexsort((start, string))
    string, start = string[order], start[order]
    if not len(string):
        return string, start, start
    new = np.concatenate(([True], (string[1:] != string[:-1]) | (start[1:] != start[:-1] + 1)))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(string)) - 1
    return string[at], start[at], start[last] - start[at] + window


def _halves(c: Collection, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A collection with all 256 bytes: UTF-8 never has them, other input is compared window by window."""
    seen: dict[bytes, tuple[int, int]] = {}
    order = sorted((int(c.doc_id[i]), int(c.at[i]) + k, i, k) for i, s in enumerate(c.strings) for k in range(len(s) - window + 1))
    string, start = [], []
    for doc_id, at, i, k in order:
        if seen.setdefault(c.strings[i][k : k + window], (doc_id, at)) != (doc_id, at):
            string.append(i)
            start.append(k)
    return _runs(np.array(string, np.int64), np.array(start, np.int64), window)


def later_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, spans, carried columns): what byte windows of each text also start earlier."""
    folder = scratch_path(docs.sparkSession, "transforms")
    return with_spans(docs, Symbols(False), window, gram, lambda c: later_windows(c, window, folder), all_copies=False, carry=carry)


def kept_bytes(text: str | None, spans) -> tuple[bytes, np.ndarray]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    gone = covered(spans, len(data))
    return data[~gone].tobytes(), gone


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: doc_id, text without repeated passages, and counts.

    A byte goes if a ``window``-byte string that covers it also starts earlier: in
    a document with a smaller doc_id, or before in the same.  Null texts are as
    empty ones; rows without a doc_id are neither compared nor cut; rows with equal
    doc_id and text count as one document, rows with equal doc_id and other texts
    as documents in the order of a hash.  A character that is cut in two is decoded
    with U+FFFD in ``text``; the digest is of the bytes.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                rest, gone = kept_bytes(batch.column(1)[i].as_py(), batch.column(2)[i])
                n_spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
                rows.append((batch.column(0)[i].as_py(), rest.decode("utf-8", "replace"), len(gone), int(gone.sum()), n_spans, hashlib.sha256(rest).hexdigest()))
                if len(rows) == 256 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)
                    rows = []

    return later_spans(docs, window, gram).mapInArrow(run, "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) without repeated passages.

    As ``suffix_dedup``; characters of which a byte goes go whole, and documents
    that had words and have none left go.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                before = [t.as_py() for t in part.column(1)]
                after = [None if t is None else kept_bytes(t, part.column(2)[i])[0].decode("utf-8", "ignore") for i, t in enumerate(before)]
                stays = pa.array([not (t or "").split() or bool((x or "").split()) for t, x in zip(before, after, strict=True)])
                text, n = pa.array(after, pa.string()), pa.array([None if x is None else len(x) for x in after], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), text, part.column(3), part.column(4), n], names=["doc_id", "text", "lang", "source", "n_chars"]).filter(stays)

    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return later_spans(rows, window, gram, ("lang", "source")).mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long")


_NAMES = ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 200)) AS k
  FROM d, unnest(range(0, greatest(n - 99, 0))) AS t(i)
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS later FROM w
), s AS (
  SELECT doc_id, i, i + 100 AS e, max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM f WHERE later
), r AS (
  SELECT doc_id, i, e, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s
), runs AS (
  SELECT doc_id, run, min(i) AS a, max(e) AS b FROM r GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM runs
  UNION ALL SELECT doc_id, 0, min(a) FROM runs GROUP BY doc_id
), rest AS (
  SELECT g.doc_id, string_agg(substr(d.x, 2 * g.a + 1, 2 * (coalesce(g.b, d.n) - g.a)), '' ORDER BY g.a) AS x
  FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id
), c AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(c.gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(c.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest.x, d.x))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN rest USING (doc_id)
"""
