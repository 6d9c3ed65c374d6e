"""Byte-level BPE encoding by tree concatenation, and decoding.

A text longer than a leaf is halved until the parts are leaves; the leaves are
encoded independently.  Going up the tree, two neighbours are joined by encoding
anew a window around the cut that starts and ends at token starts of theirs.  The
window grows until its first tokens are the left part's own and its last tokens
the right part's own.  As a BPE encoding is right exactly if every two adjacent
tokens are what their joined text encodes to, the parts outside then stand.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwell.llm.common import table

#: Characters of a text that are encoded in one piece.
LEAF = 8192
#: Tokens on either side of a cut that the first window takes.  A special token's
#: text spans at most as many byte tokens as it has bytes, which is fewer.
WINDOW = 16
#: Tokens at each end of a window that must be those of the parts.
AGREE = 2
#: The regular expression by which byte-level BPE of this kind splits text (fixed).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """A byte-level BPE vocabulary from a ``tokenizer.json`` file.

    Strings of special tokens in a text become these tokens, as by default in the
    tokenizers library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        lengths = {i: len(t) for t, i in ranks.items()} | {i: len(t.encode()) for t, i in special.items()}
        self.lengths = np.zeros(max(lengths) + 1, np.int64)
        self.lengths[list(lengths)] = list(lengths.values())

    def _leaf(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text, allowed_special="all"), np.uint32)

    def encode(self, text: str | None, leaf: int = LEAF, window: int = WINDOW) -> np.ndarray:
        """The ids of a text (null: none), as unsigned 32-bit integers."""
        if not text:
            return np.empty(0, np.uint32)
        if len(text) <= leaf:
            return self._leaf(text)
        level = [text]
        while len(level[0]) > leaf:
            level = [half for part in level for half in (part[: len(part) // 2], part[len(part) // 2 :])]
        nodes = [(part.encode(), self._leaf(part)) for part in level]
        while len(nodes) > 1:
            nodes = [self._join(*nodes[i], *nodes[i + 1], window) for i in range(0, len(nodes), 2)]
        return nodes[0][1]

    def _join(self, left: bytes, a: np.ndarray, right: bytes, b: np.ndarray, window: int) -> tuple[bytes, np.ndarray]:
        whole = left + right
        ends_a, ends_b = np.cumsum(self.lengths[a]), np.cumsum(self.lengths[b])
        while True:
            i, j = max(0, len(a) - window), min(len(b), window)
            # A window may not cut a character in two.
            while i and left[at := int(ends_a[i - 1])] & 0xC0 == 0x80:
                i -= 1
            while j < len(b) and right[int(ends_b[j - 1])] & 0xC0 == 0x80:
                j += 1
            at = int(ends_a[i - 1]) if i else 0
            to = len(left) + (int(ends_b[j - 1]) if j else 0)
            mid = self._leaf(whole[at:to].decode())
            fits = i == 0 or (len(mid) >= AGREE and np.array_equal(mid[:AGREE], a[i : i + AGREE]))
            fits = fits and (j == len(b) or (len(mid) >= AGREE and np.array_equal(mid[-AGREE:], b[j - AGREE : j])))
            if fits:
                return whole, np.concatenate((a[:i], mid, b[j:]))
            window *= 2

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, specials included; bytes that are no UTF-8 become U+FFFD."""
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def bpe_round_trip(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decodes) for every row of ``rows`` (row: a struct of the first three, text).

    ``decodes`` says whether the ids decode to the text again.  A null text is as
    an empty one: no ids.  Repeated rows are encoded each.  ``path`` is a
    vocabulary file that every executor can open.
    """

    def run(batches):
        c = codec(path)
        for batch in batches:
            # A few rows at a time: what is in memory doesn't grow with the batch.
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [c.encode(t) for t in texts]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = pa.array(np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int32))
                decodes = pa.array([c.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(offsets, flat), decodes], names=["row", "n_tokens", "ids", "decodes"])

    out = rows.select("row", F.col("text").cast("string").alias("text")).mapInArrow(run, f"row {dict(rows.dtypes)['row']}, n_tokens long, ids array<int>, decodes boolean")
    return out.select("row.*", "n_tokens", "ids", "decodes")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``bpe_round_trip``, with digests of ids and text in place of these; nothing long leaves the worker."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for value in batch.column(1):
                ids = c.encode(value.as_py())
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary of this name is; found on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary_path())
