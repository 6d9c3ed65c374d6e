"""Language identification by Bayesian fusion of evidence.

The posterior of a language multiplies the text's likelihood (byte trigrams,
learnt from labelled documents), the likelihood of the declared markup language,
that of the address suffix, and a prior from the host.  The prior is smoothed
hierarchically: all rows, then the host's domain, then the host, each level
counted by grouped aggregation over all rows.  A further class, ``und``, gives
every trigram the same probability; what it explains best is no known language.
"""

from __future__ import annotations

import html as html_lib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwell.llm.common import kept, table

UNKNOWN = "und"
BINS = 1 << 16
#: The most labelled documents that the trigram model is learnt from.
MAX_TRAIN = 20_000
#: Trigrams overlap, so a text counts as if it had a third of them, and at most so many.
_WEIGHT, _MOST = 1 / 3, 300
#: Pseudo-counts of a level's parent in the level's prior, and of declarations and suffixes.
_STRENGTH, _SMOOTH = 20.0, 1.0
_HIDDEN = re.compile(r"(?is)<(script|style|nav|noscript|template)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"(?s)<[^>]*>")
_DECLARED = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})""")


def visible_text(page: str | None) -> str:
    """The text of a page without markup, scripts, styles and navigation."""
    return html_lib.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page or "")))


def declared_language(page: str | None) -> str | None:
    found = _DECLARED.search(page or "")
    return found[1].lower() if found else None


#: Digits and signs tell no language; numbers, addresses and keys aren't held against a text.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigram_bins(text: str | None) -> np.ndarray:
    """The bin of each byte trigram of a text's letters, A-Z lower-cased, one blank for what lies between."""
    letters = b" ".join((text or "").encode().lower().translate(_LETTERS).split())
    b = np.frombuffer(letters, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint32)
    h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(16)


def sample_rate(rows: DataFrame, most: int) -> float:
    """The share of ``rows`` that comes to about ``most`` of them, 1 if there are fewer."""
    return min(1.0, most / max(1, rows.count()))


def sampled(key: Column, rate: float) -> Column:
    """Whether a row is in the sample; a function of its key alone."""
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1_000_000)) < F.lit(int(rate * 1_000_000))


class TextModel:
    """Log-probabilities of trigram bins by language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.5
        self.table = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)) if langs else np.zeros((BINS, 0), np.float32)

    def scores(self, text: str | None) -> np.ndarray:
        """Log-likelihood of a text under each language and, last, under none."""
        bins = trigram_bins(text)
        out = np.zeros(len(self.langs) + 1)
        for at in range(0, len(bins), 1 << 16):
            out[:-1] += self.table[bins[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        out[-1] = -np.log(BINS) * len(bins)
        n = len(bins)
        return out / n * min(_MOST, n * _WEIGHT) if n else out


def train_text_model(docs: DataFrame, max_train: int = MAX_TRAIN) -> TextModel:
    """Learnt from (text, lang) of a sample of at most about ``max_train`` labelled rows.

    Rows with a null or empty label are left out.  The counts that come to the
    driver are at most 65,536 for each language label.
    """
    labelled = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and lang <> '' and text is not null")
    rows = labelled.filter(sampled(F.col("doc_id"), sample_rate(docs.filter("lang is not null"), max_train))).select("text", "lang")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                if (lang := lang.as_py()) not in total:
                    total[lang] = np.zeros(BINS, np.int64)
                bins = trigram_bins(text.as_py())
                for at in range(0, len(bins), 1 << 20):
                    total[lang] += np.bincount(bins[at : at + (1 << 20)], minlength=BINS)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bin", "n"])

    found = rows.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), BINS))
    counts[np.searchsorted(langs, found["lang"]), found["bin"]] = found["n"]
    return TextModel(langs, counts)


def _scored(rows: DataFrame, model: TextModel, markup: bool) -> DataFrame:
    """rows (key, text, ...) with scores and, from markup, declared; the text is dropped."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            scores, declared = [], []
            for value in texts:
                value = value.as_py()
                scores.append(model.scores(visible_text(value) if markup else value).tolist())
                declared.append(declared_language(value) if markup else None)
            arrays = [batch.column(n) for n in names] + [pa.array(scores, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(declared, pa.string())] * markup, names=[*names, "scores"] + ["declared"] * markup)

    schema = ", ".join([f"{n} {dict(rows.dtypes)[n]}" for n in names] + ["scores array<double>"] + ["declared string"] * markup)
    return rows.mapInArrow(run, schema)


def _given(rows: DataFrame, name: str, n: int) -> DataFrame:
    """(name, log-probabilities by language of seeing this value), smoothed over the values."""
    per = rows.groupBy(name, "guess").agg(F.count(F.lit(1)).alias("n"))
    values = per.select(name).distinct().count()
    whole = per.groupBy("guess").agg(F.sum("n").alias("of"))
    per = per.join(whole, "guess").select(name, "guess", F.log((F.col("n") + _SMOOTH) / (F.col("of") + _SMOOTH * (values + 1))).alias("p"))
    base = {r["guess"]: float(np.log(_SMOOTH / (r["of"] + _SMOOTH * (values + 1)))) for r in whole.collect()}  # one row a language
    unseen = F.array(*[F.lit(base.get(i, 0.0)) for i in range(n)])
    return per.groupBy(name).agg(F.map_from_entries(F.collect_list(F.struct("guess", "p"))).alias("m")).select(
        name, F.transform(unseen, lambda u, i: F.coalesce(F.try_element_at(F.col("m"), i), u)).alias(f"{name}_given")
    )


def _level(rows: DataFrame, name: str, n: int) -> DataFrame:
    per = rows.groupBy(name).agg(*[F.sum((F.col("guess") == i).cast("double")).alias(f"n{i}") for i in range(n)])
    return per.select(name, F.array(*[F.col(f"n{i}") for i in range(n)]).alias(f"{name}_n"))


def _smoothed(counts: Column, parent: Column) -> Column:
    """The counts as probabilities, with the parent's for ``_STRENGTH`` rows."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, parent, lambda c, p: (c + p * _STRENGTH) / (total + _STRENGTH))


def identify(rows: DataFrame, model: TextModel, markup: bool = False) -> DataFrame:
    """One row per row of ``rows`` (key, text, host, suffix; declared unless ``markup``).

    Returns key, lang, posterior, text_lang, declared, host, rejected.  The text is
    page markup if ``markup``.  Missing evidence (null declaration, suffix or host)
    counts as a value of its own.  A row is rejected if its likeliest class is
    ``und``: its text has no trigram, or is likelier under equal odds.
    """
    langs = [*model.langs, UNKNOWN]
    n = len(langs)
    # Nulls stand as a value that no address or language tag can have.
    keys = [F.coalesce(F.col(c), F.lit("?")).alias(c) for c in (["host", "suffix"] if markup else ["host", "suffix", "declared"])]
    scored = _scored(rows.select("key", "text", *keys), model, markup)
    best = F.array_position(F.col("scores"), F.array_max("scores")).cast("int") - 1
    scored = scored.withColumns({"declared": F.coalesce("declared", F.lit("?")), "empty": F.element_at("scores", n) == 0.0})
    scored = scored.withColumn("guess", F.when(F.col("empty"), F.lit(n - 1)).otherwise(best))
    scored = kept(scored.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 0)), "scored")
    domain = _level(scored, "domain", n)
    top = scored.agg(*[F.sum((F.col("guess") == i).cast("double")).alias(f"n{i}") for i in range(n)]).first()  # one row
    whole = np.array([float(x or 0) for x in top]) + 1.0
    everywhere = F.array(*[F.lit(float(x)) for x in whole / whole.sum()])
    host = _level(scored.select("host", "domain", "guess"), "host", n).withColumn("of", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 0))
    priors = host.join(domain, host["of"] == domain["domain"]).select("host", _smoothed(F.col("host_n"), _smoothed(F.col("domain_n"), everywhere)).alias("prior"))
    out = scored.join(priors, "host").join(_given(scored, "declared", n), "declared").join(_given(scored, "suffix", n), "suffix")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = add(add(F.col("scores"), F.col("declared_given")), add(F.col("suffix_given"), F.transform("prior", lambda p: F.log(p))))
    out = out.withColumn("fused", F.when(F.col("empty"), F.transform(F.col("scores"), lambda x, i: F.when(i == n - 1, F.lit(0.0)).otherwise(F.lit(-50.0)))).otherwise(fused))
    out = out.withColumn("top", F.array_max("fused"))
    names = F.array(*[F.lit(x) for x in langs])
    lang = F.element_at(names, F.array_position("fused", F.col("top")).cast("int"))
    posterior = F.lit(1.0) / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return out.select("key", lang.alias("lang"), posterior.alias("posterior"), F.element_at(names, F.col("guess") + 1).alias("text_lang"), F.nullif("declared", F.lit("?")).alias("declared"), F.nullif("host", F.lit("?")).alias("host"), (lang == UNKNOWN).alias("rejected"))


def page_languages(pages: DataFrame, model: TextModel) -> DataFrame:
    """Identify ``pages`` (page_id, url, html); a page without html or address is one without that evidence."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("key"), F.col("html").cast("string").alias("text"), F.nullif(host, F.lit("")).alias("host"))
    rows = rows.withColumn("suffix", F.nullif(F.regexp_extract("host", r"\.([^.]+)$", 1), F.lit("")))
    return identify(rows, model, markup=True).withColumnRenamed("key", "page_id")


def document_languages(docs: DataFrame, model: TextModel, key: Column | None = None) -> DataFrame:
    """Identify ``docs`` (doc_id, text, lang, source): lang is the declared language, source the host."""
    rows = docs.select(
        (F.col("doc_id").cast("long") if key is None else key).alias("key"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"), F.col("lang").cast("string").alias("declared")
    )
    return identify(rows, model).withColumnRenamed("key", "doc_id")


def in_known_languages(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their columns; the model is learnt from their own labels.

    Few rows are rejected, so these are taken away by an anti join; a row is known
    by its id and a hash of its text.
    """
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    rejected = kept(document_languages(docs, train_text_model(docs), key).filter("rejected").select("doc_id.id", "doc_id.text_hash").distinct(), "rejected")
    marked = docs.select("*", key.alias("__key"))
    same = (marked["__key"]["id"] == rejected["id"]) & (marked["__key"]["text_hash"] == rejected["text_hash"])
    return marked.join(rejected, same, "left_anti").drop("__key")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train_text_model(table(spark, sf_dir, "documents"))
    found = page_languages(table(spark, sf_dir, "pages"), model)
    return found.withColumn("posterior", F.round("posterior", 6))
