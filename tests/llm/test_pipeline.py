"""The pipeline's stages one by one and together, on a small corpus with planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from arcwell.llm.common import kept

COLS = "doc_id long, text string, lang string, source string, n_chars long"


def planted(spark):
    rng = random.Random(9)
    words = {"en": "the of and to in is that for with was on are as by this from be or an at".split(), "de": "der die das und ist nicht ein eine mit von zu den dem auf für sich auch als im so".split()}
    rows = []
    for i in range(80):
        lang = "en" if i % 2 else "de"
        text = " ".join(rng.choice(words[lang]) + rng.choice(["", "er", "en", "ing"]) for _ in range(120))
        rows.append((i, text, lang, f"src{i % 3}", len(text)))
    passage = rows[2][1][40:300]
    rows += [(100, rows[4][1], "de", "src1", 1), (101, rows[6][1].replace("der", "xyz", 1), "de", "src0", 1), (102, "0x00 #### 99 @@ {} 7f;; ~~ 0x00 #### 99 @@ {} 7f;; ~~", None, "src0", 1), (103, None, None, "src0", None), (104, rows[9][1] + " " + passage, "en", None, 1)]
    return spark.createDataFrame([r + ("clash",) for r in rows], COLS + ", blocks string")


def test_stages(spark):
    docs = planted(spark)
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = kept(stage(spark, docs, "unused"), "stage")
        seen[name] = docs
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert set(range(80)) <= ids["language id"] and {102, 103}.isdisjoint(ids["language id"])
    # An exact copy and one with a word changed go; one that is 0.7 like another stays.
    assert set(range(80)) <= ids["simhash near-dedup"] and {100, 101}.isdisjoint(ids["simhash near-dedup"]) and 104 in ids["simhash near-dedup"]
    for n in list(seen)[:-1]:
        assert seen[n].columns == pipeline.COLUMNS
    whole = {r["doc_id"]: r["text"] for r in seen["suffix-array dedup"].collect()}
    assert whole[2] == planted(spark).filter("doc_id = 2").first()["text"]
    size = lambda d: d.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert abs(size(seen["source mix"]) - size(seen["suffix-array dedup"])) < 120
    assert seen["bpe"].filter("not decodes").isEmpty() and seen["bpe"].columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decodes"]


def test_every_stage_on_an_empty_table(spark):
    empty = spark.createDataFrame([], COLS)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, "unused").count() == 0, name


def test_run_and_an_empty_table(spark, tmp_path):
    planted(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() > 0
    spark.createDataFrame([], COLS).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0
