"""Substring deduplication by relative Lempel-Ziv parsing.

Collections of stretches of the corpus are reference blocks.  A block is indexed
by a suffix array over its words, built by doubling; every string is factored
greedily into the longest parts that also occur at another place of the block.
Factors of at least a window are duplicate.  A window that occurs elsewhere and
isn't within a factor crosses a factor's end, so the starts before each end are
looked up as well.  Anchors send whatever could share a window to one block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from arcwell.llm.common import table
from arcwell.llm.repeats import Collection, Symbols, covered, with_spans

WINDOW, GRAM = 35, 8


class Block:
    """A reference block: strings of codes, indexed by a suffix array."""

    def __init__(self, strings: list[np.ndarray]):
        sizes = np.array([len(s) for s in strings], np.int64)
        ends = np.cumsum(sizes + 1)
        self.begins = ends - sizes - 1
        self.sizes = sizes
        n = int(ends[-1]) if len(ends) else 0
        first = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        _, codes = np.unique(np.concatenate([*strings, np.empty(0, np.uint64)]), return_inverse=True)
        first[inside] = codes + len(strings)
        first[ends - 1] = np.arange(len(strings))  # each string ends in a symbol of its own
        #: Ranks by the next 1, 2, 4, ... symbols.
        self.ranks = [first]
        length = 1
        while length < sizes.max(initial=0):
            rank = self.ranks[-1]
            follow = np.zeros(n, np.int64)
            follow[:-length] = rank[length:] + 1
            key = rank * (n + len(strings) + 2) + follow
            _, new = np.unique(key, return_inverse=True)
            self.ranks.append(new)
            length *= 2
        self.array = np.argsort(self.ranks[-1], kind="stable")

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at positions i and j have in common."""
        i, j, n = i.copy(), j.copy(), len(self.array)
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            fits = (i < n) & (j < n)
            fits[fits] = rank[i[fits]] == rank[j[fits]]
            out[fits] += 1 << level
            i[fits] += 1 << level
            j[fits] += 1 << level
        return out

    def longest(self) -> np.ndarray:
        """At every position the length of the longest match at another."""
        out = np.zeros(len(self.array), np.int64)
        if len(self.array) > 1:
            common = self.common(self.array[:-1], self.array[1:])
            out[self.array[:-1]] = common
            out[self.array[1:]] = np.maximum(out[self.array[1:]], common)
        return out


def factor_ends(longest: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the greedy factors of all strings, parsed side by side."""
    at, upto = begins.copy(), begins + sizes
    from_, to = [], []
    live = np.flatnonzero(at < upto)
    while len(live):
        here = at[live]
        end = here + np.maximum(longest[here], 1)
        from_.append(here)
        to.append(end)
        at[live] = end
        live = live[end < upto[live]]
    return np.concatenate([*from_, np.empty(0, np.int64)]), np.concatenate([*to, np.empty(0, np.int64)])


def duplicate_spans(c: Collection, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, start and length of what repeats elsewhere in a collection."""
    block = Block([np.frombuffer(s, np.uint64) for s in c.strings])
    longest = block.longest()
    # Strings whose stretch has copies are marked whole already; they only serve as reference.
    asked = np.flatnonzero(~c.copy)
    from_, to = factor_ends(longest, block.begins[asked], block.sizes[asked])
    steps = np.zeros(len(longest) + 2, np.int64)
    long = to - from_ >= window
    np.add.at(steps, from_[long], 1)
    np.add.at(steps, to[long], -1)
    # Starts in the last window - 1 places before each factor's end.
    zone = np.zeros(len(longest) + 2, np.int64)
    begin_of = np.repeat(block.begins, block.sizes + 1)
    np.add.at(zone, np.maximum(to - window + 1, begin_of[np.minimum(from_, len(longest) - 1)]), 1)
    np.add.at(zone, to, -1)
    crossing = np.flatnonzero((np.cumsum(zone)[: len(longest)] > 0) & (longest >= window))
    np.add.at(steps, crossing, 1)
    np.add.at(steps, crossing + longest[crossing], -1)
    gone = np.cumsum(steps)[: len(longest)] > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    first, last = edges[0::2], edges[1::2]
    string = np.searchsorted(block.begins, first, side="right") - 1
    return string, first - block.begins[string], last - first


def repeated_word_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text, spans): which words lie in windows that also start elsewhere."""
    return with_spans(docs, Symbols(True), window, gram, lambda c: duplicate_spans(c, window), all_copies=True)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: doc_id, kept words, counts and digest.

    A word goes if one of the ``window``-word sequences that cover it starts at
    another place too, in the same document or another; all places lose it.  Null
    texts have no words; rows without a doc_id are neither compared nor cut; rows
    with equal doc_id and text count as one document.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                words = (batch.column(1)[i].as_py() or "").encode().split()
                gone = covered(batch.column(2)[i], len(words))
                rest = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                rows.append((batch.column(0)[i].as_py(), rest.decode(), len(words), int(gone.sum()), hashlib.sha256(rest).hexdigest()))
                if len(rows) == 256 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)
                    rows = []

    return repeated_word_spans(docs, window, gram).mapInArrow(run, "doc_id long, text string, n_words long, n_removed long, kept_sha256 string")


_NAMES = ["doc_id", "text", "n_words", "n_removed", "kept_sha256"]
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t
), k AS (
  SELECT doc_id, i, word,
         CASE WHEN i + 34 <= max(i) OVER (PARTITION BY doc_id)
              THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS h
  FROM w
), c AS (
  SELECT doc_id, i, word, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS dup FROM k
), g AS (
  SELECT doc_id, i, word, coalesce(bool_or(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone FROM c
), a AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM g GROUP BY doc_id
)
SELECT d.doc_id, coalesce(a.n, 0) AS n_words, coalesce(a.r, 0) AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN a USING (doc_id)
"""
