"""Operators on texts against brute force, with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arcwell.llm import anchors, bpe, components, langid, lempel_ziv, mixing, near_texts, repeats, simhash, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, spans string, size string, anchor string, id string"


def documents(spark, texts, ids=None, sources=None, langs=None):
    """A table with columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, langs[k] if langs else "en", sources[k] if sources else "s", None, "x", "x", "x", "x", "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, line = say(60), say(36) + "\n"
    texts = []
    for _ in range(n):
        t = say(rng.randint(0, 120))
        if rng.random() < 0.4:
            t += " " + passage[rng.randint(0, 40) :] + " " + say(5)
        if rng.random() < 0.3:
            t = line * rng.randint(1, 4) + t
        texts.append(t)
    return [*texts, texts[0], texts[0], texts[3] + " and more", "", None, "   \n", "a", say(4000) + passage, "x" * 700, "x" * 701, "ab" * 300]


def test_substring_dedup_is_brute_force(spark):
    texts = corpus()
    where = Counter()
    words = [(t or "").encode().split() for t in texts]
    for w in words:
        where.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    got = {r["doc_id"]: r for r in lempel_ziv.substring_dedup(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for d, w in enumerate(words):
        gone = {j for i in range(len(w) - 34) if where[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        rest = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(rest).hexdigest()), d


def first_come(texts, window=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = set()
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            if w in seen:
                gone |= set(range(i, i + window))
            seen.add(w)
        out.append((b, gone))
    return out


def check_suffixes(spark, texts, frame):
    got = {r["doc_id"]: r for r in suffixes.suffix_dedup(frame).collect()}
    for d, (b, gone) in enumerate(first_come(texts)):
        rest = bytes(x for j, x in enumerate(b) if j not in gone)
        runs = sum(1 for j in gone if j - 1 not in gone)
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"], got[d]["kept_sha256"]) == (len(b), len(gone), runs, hashlib.sha256(rest).hexdigest()), d


def test_suffix_dedup_is_brute_force(spark):
    texts = corpus(2)
    check_suffixes(spark, texts, documents(spark, texts))


def test_suffix_dedup_splits_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MOST_CLASSES", 3)
    texts = corpus(3)
    check_suffixes(spark, texts, documents(spark, texts).repartition(5))


def test_repeated_rows_and_ids_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(80))
    same = documents(spark, [t, t, None], ids=[1, 1, None])
    assert [r["n_removed"] for r in lempel_ziv.substring_dedup(same).collect()] == [0, 0, 0]
    assert [r["n_removed"] for r in suffixes.suffix_dedup(same).collect()] == [0, 0, 0]
    other = documents(spark, [t, "x " + t, t], ids=[1, 1, None])
    assert sorted(r["n_removed"] for r in lempel_ziv.substring_dedup(other).collect()) == [0, 80, 80]
    assert sorted(r["n_removed"] for r in suffixes.suffix_dedup(other).collect()) == [0, 0, len(t)]


def test_deduplicated_documents_keep_their_columns_and_whole_characters(spark):
    t = "é" * 120
    rows = suffixes.deduplicated(documents(spark, [t, t, "ü" + t, None, ""])).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [0, 2, 3, 4] and rows[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}
    assert "�" not in "".join(r["text"] or "" for r in rows)


@pytest.mark.parametrize("operator", [lempel_ziv.substring_dedup, suffixes.suffix_dedup, simhash.simhash_groups, mixing.mix_sources, mixing.mixed_documents, suffixes.deduplicated, near_texts.near_text_groups])
def test_empty_tables_give_no_rows(spark, operator):
    assert operator(documents(spark, []).filter("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=18).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=9))
def test_transform_and_common_prefixes(strings):
    bwt, lcp = suffixes.collection_bwt([np.frombuffer(s, np.uint8) for s in strings])
    order = sorted((tuple(s[k:]) + (i - 1000,), i, k) for i, s in enumerate(strings) for k in range(len(s) + 1))
    common = [0]
    for (a, *_), (b, *_) in zip(order, order[1:]):
        common.append(next(i for i, (x, y) in enumerate(zip(a, b)) if x != y))
    assert lcp.tolist() == common
    used = sorted({x for s in strings for x in s})
    assert bwt.tolist() == [used.index(strings[i][k - 1]) + 1 if k else 0 for _, i, k in order]
    string, length = suffixes.suffix_places(bwt, np.array([len(s) for s in strings]))
    assert list(zip(string.tolist(), length.tolist())) == [(i, len(strings[i]) - k) for _, i, k in order]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=5, max_size=12), min_size=1, max_size=8))
def test_parsing_marks_what_repeats(strings):
    c = repeats.Collection(np.arange(len(strings)), np.zeros(len(strings), np.int64), np.zeros(len(strings), bool), [np.array(s, np.uint64).tobytes() for s in strings])
    got = {(int(i), j) for i, s, n in zip(*lempel_ziv.duplicate_spans(c, 5)) for j in range(s, s + n)}
    n = Counter(tuple(s[k : k + 5]) for s in strings for k in range(len(s) - 4))
    assert got == {(i, j) for i, s in enumerate(strings) for k in range(len(s) - 4) if n[tuple(s[k : k + 5])] > 1 for j in range(k, k + 5)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=300), st.lists(st.integers(0, 3), min_size=20, max_size=60))
def test_equal_windows_share_an_anchor(noise, shared):
    docs = [noise + shared, shared + noise, shared]
    codes = anchors.byte_codes()[np.array(sum(docs, []), np.int64)]
    bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    doc, start, n, anchor, _ = anchors.stretches(codes, bounds, 20, 6)
    at = {}
    for d, s, k, a in zip(doc.tolist(), start.tolist(), n.tolist(), anchor.tolist()):
        for i in range(s, s + k):
            assert (d, i) not in at
            at[d, i] = a
    assert set(at) == {(d, i) for d, x in enumerate(docs) for i in range(len(x) - 19)}
    by = {}
    for (d, i), a in at.items():
        assert by.setdefault(tuple(docs[d][i : i + 20]), a) == a


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_are_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(60)]
    base = [f"v{i}" for i in range(300)]
    for _ in range(40):
        b = list(base)
        b[rng.randrange(300)] = "Edited"
        texts.append(" ".join(b))
    texts += [None, "", " \t", texts[5], texts[5].upper(), "a b", "A  b"]
    fps = [plain_fingerprint(t) for t in texts]
    label = list(range(len(texts)))
    while True:
        new = [min(label[j] for j in range(len(texts)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(texts))]
        if new == label:
            break
        label = new
    got = {r["doc_id"]: r for r in simhash.simhash_groups(documents(spark, texts)).collect()}
    assert [got[i]["fp"] % (1 << 64) for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == label


def test_many_near_fingerprints_in_a_posting():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 16, 700).astype(np.uint64) << np.uint64(8) | np.uint64(5))
    links = simhash._near(values, 2)
    root = {int(v): int(v) for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert (a ^ b).bit_count() <= 2
        root[max(find(a), find(b))] = min(find(a), find(b))
    for i, a in enumerate(values.tolist()):
        for b in values.tolist()[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                assert find(a) == find(b)


def test_near_text_groups_find_copies_and_leave_others(spark):
    rng = random.Random(6)
    texts = [" ".join(f"t{rng.randrange(4000)}" for _ in range(200)) for _ in range(40)]
    near = [t.split() for t in texts[:20]]
    for t in near:
        t[100] = "edited"
    got = {r["doc_id"]: r["component_id"] for r in near_texts.near_text_groups(documents(spark, [*texts, *map(" ".join, near), texts[30]])).collect()}
    assert sum(got[40 + i] == i for i in range(20)) >= 19 and got[60] == 30 and all(got[i] == i for i in range(40))


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def plain_near_groups(texts):
    sets = [plain_shingles(t) for t in texts]
    near = [[j for j, y in enumerate(sets) if 5 * len(x & y) >= 4 * len(x | y)] for x in sets]
    label = list(range(len(texts)))
    while True:
        new = [min(label[j] for j in js) for js in near]
        if new == label:
            return label
        label = new


def test_near_text_groups_are_brute_force(spark):
    rng = random.Random(8)
    line = [f"c{i}" for i in range(12)]
    texts = []
    for i in range(120):
        words = line * (i % 3 == 0) + [f"t{rng.randrange(3000)}" for _ in range(rng.randint(20, 300))]
        texts.append(" ".join(words))
        for _ in range(1 + 20 * (i % 40 == 0)):
            edited = list(words)
            for _ in range(max(1, int(len(words) * rng.uniform(0.005, 0.06)))):
                edited[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(edited))
    rng.shuffle(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_texts.near_text_groups(documents(spark, texts)).collect()}
    want = plain_near_groups(texts)
    assert [got[i] for i in range(len(texts))] == want and 30 < sum(i != c for i, c in enumerate(want)) < 150


def test_near_text_groups_of_frequent_shingles_are_brute_force(spark, monkeypatch):
    """Salted keys, star rounds and blocks of pairs; copies that differ from their first but not from each other."""
    monkeypatch.setattr(near_texts, "_SALT", 4)
    monkeypatch.setattr(near_texts, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(words[: rng.choice([120, 110, 95])]))
    got = {r["doc_id"]: r["component_id"] for r in near_texts.near_text_groups(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_near_groups(texts)


@pytest.mark.parametrize("block", [2048, 40])
def test_rows_of_a_key_give_no_more_links_than_join_them(spark, monkeypatch, block):
    """All pairs of a group are alike or may be; what is returned doesn't grow with its square."""
    monkeypatch.setattr(near_texts, "FEW", 0)
    monkeypatch.setattr(near_texts, "BLOCK", block)
    rng = random.Random(9)
    texts = []
    for i in range(90):
        words = [f"g{i % 3}w{j}" if i % 3 else f"w{j}" for j in range(200)]
        for _ in range(rng.randint(2, 4)):
            words[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = near_texts._versioned(documents(spark, texts)).cache()
    none, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    classes = near_texts._classes(near_texts._sets(rows, 5, none, counts, 0.8)).cache()
    apart = classes.selectExpr("1L as key", "node as id", "n", "0 as pos", "node as root", "90L as size", "17640L as volume")
    got = [(r["a"], r["b"]) for r in near_texts._within(apart, classes, rows, 5, 0.8).collect()]
    assert len(got) < (90 if block > 90 else 6 * 90)
    roots = {r["node"]: r["root"] for r in near_texts.connected_components(spark.createDataFrame(got, "a long, b long")).collect()}
    assert [roots.get(i, i) for i in range(90)] == plain_near_groups(texts)


def test_near_text_groups_with_all_keys_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_texts, "FEW", 0)
    monkeypatch.setattr(near_texts, "BLOCK", 16)
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for _ in range(200):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(words[: rng.choice([120, 110, 95])]))
    got = {r["doc_id"]: r["component_id"] for r in near_texts.near_text_groups(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_near_groups(texts)


def test_one_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 2), (1, b, "de", "s", 3), (2, b + " more", "en", "s", 4), (2, c, None, None, None), (None, a, "en", "s", 5), (3, None, "en", "s", 0), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"], r["lang"]) for r in near_texts.without_near_texts(docs).collect()), key=str)
    assert got == sorted([(1, a, "en"), (1, b, "de"), (2, c, None), (None, a, "en"), (3, None, "en")], key=str)


def test_near_text_groups_link_only_what_is_similar(spark):
    words = [f"w{i}" for i in range(304)]  # 300 shingles
    apart = [list(words) for _ in range(8)]
    for i, t in enumerate(apart):
        for at in range(10 + i, 300, 33):  # nine words, 45 shingles: 255 of 345 are shared
            t[at] = f"x{i}"
    texts = [" ".join(words), *map(" ".join, apart), None, "", " \n", *(f"six{i} words are{i} in this{i} text" for i in range(3000))]
    got = {r["doc_id"]: r["component_id"] for r in near_texts.near_text_groups(documents(spark, texts)).collect()}
    assert got == {i: i for i in range(len(texts))} | {10: 9, 11: 9}


def test_components_of_a_path_and_a_star(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 1000 for i in range(1000, 1100)}


# Encoding


@pytest.fixture(scope="module")
def codecs():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path()), bpe.Codec(bpe.vocabulary_path())


PIECES = ["a", "the", "ing", " ", "  ", "\n", "\t", " \n", "'s", "'", "'ll", "ll", "!", "!!", "1", "23", "é", "漢", "🙂", "́", "<|endoftext|>", "<|", "endoftext", "|>", "\xa0", "x" * 7, "ab" * 5]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=120), st.sampled_from([3, 8, 40]))
def test_encoding_is_the_librarys(codecs, parts, leaf):
    library, own = codecs
    text = "".join(parts)
    want = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text, leaf=leaf).tolist() == want
    assert own.decode(np.array(want, np.uint32)) == library.decode(want, skip_special_tokens=False)


def test_long_unsplit_text(codecs):
    library, own = codecs
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    assert own.encode(text, leaf=512).tolist() == library.encode(text, add_special_tokens=False).ids


def test_digests_of_odd_rows(spark, codecs):
    texts = [None, "", "hello world", "hello world", "<|endoftext|>", "ü" * 9000]
    rows = bpe.bpe_digests(documents(spark, texts), bpe.vocabulary_path()).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        ids = codecs[0].encode(t or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


# Mixing


def water_level(sizes, weights, most=3):
    target, free = {}, set(sizes)
    total = sum(sizes.values())
    while True:
        left = total - sum(target.values())
        level = left / sum(weights[s] for s in free) if free else 0
        over = {s for s in free if level * weights[s] > most * sizes[s] + 1e-9}
        if not over:
            return target | {s: level * weights[s] for s in free}
        target |= {s: most * sizes[s] for s in over}
        free -= over


def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    names = ["b", "a", None, "ä", "Z"]
    share = [3, 1, 8, 2, 40]
    sources = [rng.choices(names, share)[0] for _ in range(400)]
    texts = [None if rng.random() < 0.02 else " ".join(["w"] * rng.randint(0, 300)) for _ in sources]
    docs = documents(spark, texts + ["a b", "a b"], ids=[*range(400), 7, None], sources=[*sources, "b", "b"])
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 402 and sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(3)).collect()))
    sizes = Counter()
    for t, s in zip([*texts, "a b", "a b"], [*sources, "b", "b"], strict=True):
        sizes[s] += len((t or "").split())
    order = ["Z", "a", "b", "ä", None]
    want = water_level(sizes, {s: [1, 2, 3][i % 3] for i, s in enumerate(order)})
    rows = mixing.mix_sources(docs.select("doc_id", "text", "source")).toPandas()
    assert (rows["taken"] <= 3 * rows["size"]).all()
    by = rows.groupby("target").agg(size=("source_size", "first"), taken=("taken", "sum"))
    assert sorted(by.index.round(6)) == sorted(round(x, 6) for x in want.values())
    # Half a block from rounding, and the source's last block may be short.
    assert all(abs(t - row["taken"]) <= 48 for t, row in by.iterrows())


def test_permutations_are_permutations(spark):
    for n in (1, 2, 7, 1000, 1048583):
        some = min(n, 5000)
        x = spark.range(some).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(1), 42).alias("p"))
        r = x.agg(F.count_distinct("p"), F.min("p"), F.max("p")).first()
        assert r[0] == some and r[1] >= 0 and r[2] < n


def test_mixed_documents_have_the_words_taken(spark):
    texts = [" ".join(f"d{i}w{j}" for j in range(50 + 13 * i)) for i in range(12)]
    docs = documents(spark, texts, sources=["a", "b", "c"] * 4)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs).collect()}
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        words = r["text"].split()
        assert all(w.startswith(f"d{r['doc_id']}w") for w in words) and r["n_chars"] == len(r["text"])
        got[r["doc_id"]] += len(words)
    assert {k: v for k, v in taken.items() if v} == dict(got)


# Languages


def test_language_posteriors(spark):
    en, de = "the cat and the dog in the house with that thing ", "der hund und die katze in dem haus mit dem ding "
    rng = random.Random(5)
    shuffled = lambda t: " ".join(rng.sample(t.split(), 8))
    train = documents(spark, [shuffled(x) for _ in range(40) for x in (en, de)] + [None, "x"], langs=["en", "de"] * 40 + ["en", None])
    model = langid.train_text_model(train)
    assert model.langs == ["de", "en"]
    pages = spark.createDataFrame(
        [(1, "http://a.example.com/x", f"<html lang='en'><script>der die das</script><p>{shuffled(en)}"), (2, "https://b.example.de", f"<p>{shuffled(de)}</p>"), (3, None, None), (4, "nonsense", "<html lang=de>"),
         (5, "http://a.example.com/y", "<p>qzx 0x7f 9931 kjw vvv zzq ###"), (6, "http://b.example.de", f"<html lang=en>{shuffled(de)}")] * 2, "page_id long, url string, html string",
    )
    got = langid.page_languages(pages.withColumn("scores", F.lit(1)), model).collect()
    assert len(got) == 12
    by = {r["page_id"]: r for r in got}
    assert [by[i]["lang"] for i in range(1, 7)] == ["en", "de", "und", "und", "und", "de"] and by[3]["rejected"] and not by[1]["rejected"]
    assert all(0 < r["posterior"] <= 1 for r in got)
    kept = langid.in_known_languages(train.union(documents(spark, ["#!? 123 0x00 ~~", None, ""], ids=[900, 901, 902], langs=[None] * 3)))
    assert {900, 901, 902}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.count() >= 79
    assert langid.page_languages(pages.filter("false"), model).count() == 0


def test_ambiguous_text_follows_the_other_evidence(spark):
    """Texts that tell nothing (a bin as likely under all) take the language that is declared where others are."""
    flat = langid.TextModel(["de", "en"], np.ones((2, langid.BINS)))
    told = langid.trigram_bins("der hund")
    counts = np.ones((2, langid.BINS))
    counts[0, told] += 500
    counts[1, langid.trigram_bins("the house")] += 500
    model = langid.TextModel(["de", "en"], counts)
    rows = [(i, "der hund", "h.example.com", "com", "de") for i in range(30)] + [(i, "the house", "i.example.org", "org", "en") for i in range(30, 60)]
    rows += [(100, "xyz", "h.example.com", "com", "de"), (101, "xyz", "i.example.org", "org", "en")]
    df = spark.createDataFrame(rows, "key long, text string, host string, suffix string, declared string")
    got = {r["key"]: r["lang"] for r in langid.identify(df, model).collect()}
    assert all(got[i] == ("de" if i < 30 else "en") for i in range(60)) and got[101] == "en"
    assert flat.scores("xyz")[0] == flat.scores("xyz")[1]


def plain_posteriors(rows, model):
    """The fusion once more with dictionaries, from (text, host, suffix, declared)."""
    n = len(model.langs) + 1
    scores = [model.scores(langid.visible_text(t)) for t, *_ in rows]
    guess = [n - 1 if s[-1] == 0 else int(np.argmax(s)) for s in scores]
    domain = lambda h: ".".join(h.split(".")[-2:]) if h.count(".") else ""
    hosts, suffixes, declared = ([r[k] or "?" for r in rows] for k in (1, 2, 3))

    def counts(keys):
        out = {}
        for k, g in zip(keys, guess):
            out.setdefault(k, np.zeros(n))[g] += 1
        return out

    whole = np.bincount(guess, minlength=n) + 1.0
    smooth = lambda c, parent: (c + 20 * parent) / (c.sum() + 20)
    by_domain, by_host = counts([domain(h) for h in hosts]), counts(hosts)

    def given(keys):
        by = counts(keys)
        totals = np.bincount(guess, minlength=n)
        # A language that no row was guessed to be has no likelihood to go by.
        return {k: np.where(totals > 0, np.log((c + 1) / (totals + len(by) + 1)), 0.0) for k, c in by.items()}

    of_declared, of_suffix = given(declared), given(suffixes)
    out = []
    for i, s in enumerate(scores):
        prior = smooth(by_host[hosts[i]], smooth(by_domain[domain(hosts[i])], whole / whole.sum()))
        fused = s + of_declared[declared[i]] + of_suffix[suffixes[i]] + np.log(prior)
        if s[-1] == 0:
            fused = np.where(np.arange(n) == n - 1, 0.0, -50.0)
        out.append(([*model.langs, "und"][int(np.argmax(fused))], 1 / np.exp(fused - fused.max()).sum()))
    return out


def test_posteriors_are_those_of_the_plain_formula(spark):
    rng = random.Random(12)
    words = {"en": "the cat and dog in house with that thing".split(), "de": "der hund und die katze in dem haus mit".split(), "xx": "qzx kjw vvv zzq 123 ###".split()}
    train = documents(spark, [" ".join(rng.choices(words[x], k=9)) for _ in range(30) for x in ("en", "de")], langs=["en", "de"] * 30)
    model = langid.train_text_model(train)
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "de", "de", "xx"])
        text = rng.choice([" ".join(rng.choices(words[lang], k=rng.choice([1, 2, 9, 3000]))), " ".join(rng.choices(words["en"] + words["de"], k=4)), "", "12 ##"])
        rows.append((text, rng.choice(["a.example.com", "b.example.com", "c.test.de", "localhost", None]), rng.choice(["com", "de", None]), rng.choice(["en", "de", "fr", None])))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "key long, text string, host string, suffix string, declared string")
    got = {r["key"]: (r["lang"], r["posterior"]) for r in langid.identify(df, model).collect()}
    for i, (lang, p) in enumerate(plain_posteriors(rows, model)):
        assert got[i][0] == lang and got[i][1] == pytest.approx(p, rel=1e-9)


# Toxicity


def test_disguised_words_are_restored_and_scored(spark):
    clean = ["the weather is fine today and the garden is green", "we met the clown fish in the sea", "numbers 123 and prices $5 or 10% off!!!"]
    toxic = [f"you are such a {w} really" for w in ("grumbler", "stinker")]
    texts = clean * 40 + toxic * 40
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i >= 120)) for i in range(200)] + [(500, None), (None, 1)], "doc_id long, toxic int")
    scorer = toxicity.train(docs, labels)
    for disguise in ("gr0mbl3r", "g r u m b l e r", "g.r.u.m.b.l.e.r", "grummmmbler", "$tink3r", "st1nk3r", "s-t-i-n-k-e-r"):
        restored = scorer.restored(f"hello {disguise} you")
        assert restored, disguise
    for disguise in ("st1nk3r", "5tinker", "stink3r5", "s  t  i  n  k  e  r", "s\tt\ti\tn\tk\te\tr"):
        assert scorer.restored(f"hello {disguise} you"), disguise
    for disguise in ("s  t  i  n  k  e  r", "s\nt\ni\nn\nk\ne\nr", "grumb1er", "s t i n k e r", "s.t.i.n.k.e.r", "stinkkker", "$tinker", "st1nk3r"):
        assert scorer.score(f"the garden is {disguise} today") >= 0.5, disguise
    assert all(scorer.score(t) < 0.5 for t in [*clean, "", None, "?", "x" * 50_000])
    got = toxicity.toxicity_scores(documents(spark, [*texts, None, ""]), scorer).collect()
    assert len(got) == 202 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity_scores(docs.filter("false"), scorer).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abelost013$@!*.| ", min_size=1, max_size=7), st.integers(0, 5))
def test_decoding_is_the_best_way_through_the_lattice(span, seed):
    model = np.log(np.random.default_rng(seed).dirichlet(np.ones(toxicity._CLASSES), size=(toxicity._CLASSES, toxicity._CLASSES))).astype(np.float32)

    def total(letters):
        c = [0, 0, *(int(toxicity._CLASS[ord(x)]) for x in letters), 0]
        return sum(float(model[c[i], c[i + 1], c[i + 2]]) for i in range(len(c) - 2))

    ways = [("", 0.0)]
    for arcs in toxicity.lattice(span):
        ways = [(done + letters, p + q) for done, p in ways for letters, q in arcs]
    best = {}
    for text, p in ways:
        best[text] = max(best.get(text, -math.inf), p + total(text))
    found = toxicity.decode(span, model)
    assert best[found] == pytest.approx(max(best.values()), abs=1e-4)


def test_toxic_words_are_caught_in_held_out_rows_whatever_else_a_row_has(spark):
    """Labels of held-out rows are not learnt from; repeated rows and columns of the same names change nothing."""
    rng = random.Random(4)
    words = [f"word{c}" for c in "abcdefghijklmnop"]
    texts = [" ".join(rng.choices(words, k=30) + (["stinker"] if i % 4 == 0 else [])) for i in range(400)]
    docs = documents(spark, texts).withColumns({"score": F.lit("x"), "toxic": F.lit("y"), "feature": F.lit(1)})
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 0) for i in range(400)], "doc_id long, toxic int, score int")
    scorer = toxicity.train(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    twice = docs.union(docs)
    got = toxicity.toxicity_scores(twice, scorer).groupBy("doc_id").agg(F.count_distinct("score").alias("n"), F.max("score").alias("s")).collect()
    assert len(got) == 400 and all(r["n"] == 1 and (r["s"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in got)


def test_training_without_labels(spark):
    docs = documents(spark, ["some text", None])
    scorer = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert 0 <= scorer.score("some text") <= 1
