"""Toxicity scores after noisy-channel deobfuscation.

Spans that look disguised (letters mixed with look-alike digits and signs, words
spaced out letter by letter, letters repeated) become lattices: each sign may
stand for one of several letters or for itself, a repeated letter for one or two,
a separator for nothing.  Viterbi decoding under a character trigram model of the
whole corpus restores them, and the text is scored with what was restored.

A text's score is the largest, over its words, of the probability that a document
with such a word or word beginning is toxic, learnt from labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwell.llm.common import table
from arcwell.llm.langid import sample_rate, sampled

#: The most labelled documents that the word model is learnt from.
MAX_TRAIN = 20_000
#: Lengths of word beginnings that are evidence, besides whole words.
BEGINNINGS = (4, 5, 6)
#: How many documents' worth of the overall rate a word's evidence is mixed with.
_PRIOR = 8.0
#: Runs of characters remembered by a worker; when there are more it forgets all and goes on.
_REMEMBER = 400_000

#: What a sign may stand for, with the log-probability of writing it so (fixed look-alikes).
LOOKALIKES: dict[str, tuple[tuple[str, float], ...]] = {
    "0": (("o", -1.0),),
    "1": (("i", -1.2), ("l", -1.4)),
    "2": (("z", -2.0),),
    "3": (("e", -1.0),),
    "4": (("a", -1.0),),
    "5": (("s", -1.0),),
    "6": (("g", -1.5), ("b", -2.0)),
    "7": (("t", -1.0),),
    "8": (("b", -1.2),),
    "9": (("g", -1.5),),
    "@": (("a", -1.0),),
    "$": (("s", -1.0),),
    "!": (("i", -1.2), ("l", -1.6)),
    "|": (("i", -1.4), ("l", -1.4)),
    "+": (("t", -1.2),),
    "(": (("c", -1.5),),
    "<": (("c", -1.5),),
    "€": (("e", -1.0),),
    "£": (("l", -1.5),),
    "*": (("a", -3.0), ("e", -3.0), ("i", -3.0), ("o", -3.0), ("u", -3.0)),
}
_SIGNS = re.escape("".join(LOOKALIKES))
_DROPPED, _ONCE, _TWICE = -1.0, -0.5, -0.5
_LETTER = r"[^\W\d_]"
#: Words spaced out: one letter or sign after another, at least three, with white space between.
SPACED = re.compile(rf"(?<!\S)(?:{_LETTER}|[{_SIGNS}])(?:\s++(?:{_LETTER}|[{_SIGNS}])){{2,}}(?![^\s.,;:!?])")
#: In a run without white space: letters with other separators between, letters and
#: signs mixed, a sign before two letters, a letter three times, or nothing but letters and
#: signs, a digit or sign that isn't punctuation among them.
DISGUISED = re.compile(
    rf"(?:{_LETTER}|[{_SIGNS}])(?:[._\-*](?:{_LETTER}|[{_SIGNS}])){{2,}}(?![^.,;:!?])"
    rf"|(?<![\w{_SIGNS}])[{_SIGNS}]*+{_LETTER}++[{_SIGNS}]++{_LETTER}[^.,;:?]*"
    rf"|^[$@!|(<€£013457]{_LETTER}{{2}}.*"
    rf"|(?<!\w){_LETTER}*?({_LETTER})\1\1.*"
    rf"|(?<![\w{_SIGNS}])(?=[{_SIGNS}]*{_LETTER})(?=(?:{_LETTER}|[!|+(<*])*[0-9@$€£])(?:{_LETTER}|[{_SIGNS}]){{3,}}"
)
_WORD = re.compile(rf"{_LETTER}+")

# The trigram model's alphabet: 0 a word's border, a-z, the letters of Latin-1, others.
_CLASSES = 62


def _class_table() -> np.ndarray:
    out = np.zeros(1 << 16, np.uint8)
    for i in range(26):
        out[ord("a") + i] = 1 + i
    for c in range(0xDF, 0x100):
        if chr(c).isalpha():
            out[c] = 27 + c - 0xDF
    for c in range(0x100, 1 << 16):
        if chr(c).isalpha():
            out[c] = _CLASSES - 1
    return out


_CLASS = _class_table()


def char_classes(text: str) -> np.ndarray:
    """Each character's class, with a border before and after the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(points) + 2, np.uint8)
    out[1:-1] = _CLASS[np.minimum(points, 0xFFFF)]
    return out


def char_trigrams(docs: DataFrame) -> np.ndarray:
    """Log-probability of a character's class after two others, counted over all texts.

    Counts are summed where the texts are; the model has 62**3 entries whatever
    the corpus.
    """

    def count(batches):
        total = np.zeros(_CLASSES**3, np.int64)
        for batch in batches:
            for value in batch.column(0):
                text = (value.as_py() or "").lower()
                for at in range(0, len(text), 1 << 18):
                    c = char_classes(text[at : at + (1 << 18)]).astype(np.int32)
                    total += np.bincount((c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:], minlength=_CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(_CLASSES**3)
    counts[found["code"]] = found["n"]
    counts = counts.reshape(_CLASSES, _CLASSES, _CLASSES)
    two = counts.sum(axis=0) + 0.5
    back = two / two.sum(axis=1, keepdims=True)
    smooth = (counts + 5 * back[None]) / (counts.sum(axis=2, keepdims=True) + 5)
    return np.log(smooth).astype(np.float32)


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each run of a disguised span, the strings it may stand for and their log-probabilities."""
    span = " ".join(span.split())
    spaced = re.fullmatch(r"\S(?:[ ._\-*]\S){2,}", span) is not None
    units = span[::2] if spaced else re.sub(r"[._\-]", "", span)
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(units):
        j = i
        while j < len(units) and units[j] == units[i]:
            j += 1
        c, k = units[i], j - i
        means = LOOKALIKES.get(c, ((c, 0.0),) if c.isalpha() else (("", 0.0),))
        arcs: list[tuple[str, float]] = []
        for letter, p in means:
            arcs.append((letter, p + (_ONCE if k > 2 else _DROPPED if k == 2 else 0.0)))
            if k > 1 and letter:
                arcs.append((letter * 2, p + (_TWICE if k > 2 else 0.0)))
        if c in "!*+|(<" and i == 0 or c in "!*+|(<$" and j == len(units):
            arcs.append(("", _DROPPED))  # it may be punctuation
        out.append(arcs)
        i = j
    return out


def decode(span: str, model: np.ndarray) -> str:
    """The likeliest letters of a disguised span, by Viterbi over the last two classes."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}

    def step(a: int, b: int, score: float, letters: str) -> tuple[tuple[int, int], float]:
        for ch in letters:
            c = int(_CLASS[min(ord(ch), 0xFFFF)])
            score += float(model[a, b, c])
            a, b = b, c
        return (a, b), score

    for arcs in lattice(span):
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, done) in states.items():
            for letters, p in arcs:
                key, s = step(a, b, score + p, letters)
                if key not in new or new[key][0] < s:
                    new[key] = (s, done + letters)
        states = new
    return max((s + float(model[a, b, 0]), text) for (a, b), (s, text) in states.items())[1]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text))


def features(word: str) -> list[str]:
    """A word and its beginnings; a beginning is marked with a tilde."""
    return [word, *(word[:n] + "~" for n in BEGINNINGS if len(word) >= n)]


class Scorer:
    """Scores texts; remembers what runs of characters scored, in bounded memory."""

    def __init__(self, rate: float, weights: dict[str, float], trigrams: np.ndarray):
        self.rate, self.weights, self.trigrams = rate, weights, trigrams
        self.plain: set[str] = set()
        self.telling: dict[str, float] = {}

    def __getstate__(self):
        return self.rate, self.weights, self.trigrams

    def __setstate__(self, state):
        self.__init__(*state)

    def words(self, text: str) -> float:
        """The largest weight of the words of a lower-cased text, taken as written."""
        return max((self.weights.get(f, 0.0) for word in _WORD.findall(text) for f in features(word)), default=0.0)

    def restored(self, text: str) -> list[str]:
        """What the disguised spans of a lower-cased text stand for."""
        spans = [m[0] for run in set(text.split()) for m in DISGUISED.finditer(run)] + [m[0] for m in SPACED.finditer(text)]
        return [decode(x, self.trigrams) for x in spans]

    def _run(self, run: str) -> float:
        found = self.words(run)
        for m in DISGUISED.finditer(run):
            found = max(found, self.words(decode(m[0], self.trigrams)))
        if len(self.plain) + len(self.telling) > _REMEMBER:
            self.plain.clear()
            self.telling.clear()
        if found:
            self.telling[run] = found
        else:
            self.plain.add(run)
        return found

    def score(self, text: str | None) -> float:
        """0 to 1; a text without telling words scores half the overall rate."""
        text = (text or "").lower()
        runs = text.split()
        best = max((self.telling.get(run) or self._run(run) for run in set(runs) - self.plain), default=0.0)
        if sum(len(run) == 1 for run in runs) > 2:
            for m in SPACED.finditer(text):
                best = max(best, self.words(decode(m[0], self.trigrams)))
        return best if best > 0 else self.rate / 2


def train_words(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[float, dict[str, float]]:
    """The rate of toxic documents and the probability each telling word gives.

    From at most about ``max_train`` labelled rows (doc_id, toxic), chosen by a
    hash of doc_id.  Rows without a label of 0 or 1 are left out.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    labels = labels.filter(sampled(F.col("doc_id"), sample_rate(labels, max_train))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    tally = labels.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n, toxic = tally["n"], tally["t"]
    rate = (toxic + 0.5) / (n + 1)
    keys = labels.withColumnRenamed("doc_id", "l_doc")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(sampled(F.col("doc_id"), min(1.0, max_train / max(1, n)) if n > max_train else 1.0))
    rows = texts.join(keys, texts.doc_id == keys.l_doc).select("text", "toxic")

    def count(batches):
        seen = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                seen[label.as_py()].update({f for w in words_of((text.as_py() or "").lower()) for f in features(w)})
        for label in (0, 1):
            # Only what occurs in toxic documents can tell of them; a clean count goes along where any task saw it.
            yield pa.RecordBatch.from_arrays([pa.array(list(seen[label]), pa.string()), pa.array([label] * len(seen[label]), pa.int32()), pa.array(list(seen[label].values()), pa.int64())], names=["feature", "label", "n"])

    counts = rows.mapInArrow(count, "feature string, label int, n long").groupBy("feature").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum("n").alias("n"))
    p = (F.col("t") + _PRIOR * rate) / (F.col("n") + _PRIOR)
    telling = counts.filter("t >= 3").select("feature", p.alias("p"), "t").filter(F.col("p") > 2 * rate)  # as many as the sample's documents have, at most
    return rate, {r["feature"]: r["p"] for r in telling.collect()}


def toxicity_scores(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score) for every row; a null text scores as an empty one, half the overall rate."""

    def run(batches):
        for batch in batches:
            out = np.fromiter((scorer.score(t.as_py()) for t in batch.column(1)), np.float64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id) :
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    rate, weights = train_words(docs, labels)
    return Scorer(rate, weights, char_trigrams(docs))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scorer = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    out = toxicity_scores(docs, scorer)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
