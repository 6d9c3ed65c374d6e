"""Embedding operators and WARC against brute force, with degenerate rows."""

import gzip
import hashlib
import io
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arcwell.llm import ann, neardup_vectors, vectors, warc


def embeddings(spark, x, labels, ids=None):
    rows = [(i if ids is None else ids[i], None if v is None else [None if c is None else float(c) for c in v], labels[i], "e", 1.5) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, n double")


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    near = np.repeat(base[:5], 40, axis=0) + rng.normal(scale=0.12, size=(200, 16))
    x = [*np.concatenate([base, near, base[:30]]).astype(np.float32)]
    odd = [None, [0.0] * 16, [math.nan] * 16, [math.inf] + [1.0] * 15, [None] + [1.0] * 15]
    labels = [int(v) for v in rng.integers(0, 3, len(x))]
    labels[300:500] = [7] * 200
    return x + odd + [base[0].astype(np.float32)], labels + [1] * 5 + [None]


def test_links_are_brute_force(spark, points):
    x, labels = points
    got = {r["vec_id"]: r for r in neardup_vectors.near_duplicate_vectors(embeddings(spark, x, labels)).collect()}
    assert len(got) == len(x)
    good = [i for i, v in enumerate(x) if v is not None and None not in list(v) and np.isfinite(v).all() and np.any(v) and labels[i] is not None]
    m = np.array([x[i] for i in good], np.float64)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    lab = np.array([labels[i] for i in good])
    linked = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(linked, False)
    label = np.array(good)
    while True:
        new = np.array([min([label[i], *label[linked[i]]]) for i in range(len(good))])
        if np.array_equal(new, label):
            break
        label = new
    want = {i: (int(n), int(c)) for i, n, c in zip(good, linked.sum(axis=1), label, strict=True)}
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"]) == want.get(i, (0, i)), i
        assert got[i]["kept"] == (got[i]["component_id"] == i)
    assert neardup_vectors.near_duplicate_vectors(embeddings(spark, x, labels).filter("false")).count() == 0


def test_links_across_cells_of_vectors_with_few_effective_dimensions():
    rng = np.random.default_rng(11)
    plane = rng.normal(size=(8, 128))
    x = rng.normal(size=(3000, 8))
    y = x + rng.normal(scale=0.3, size=x.shape)
    x, y = (vectors.unit(v @ plane) for v in (x, y))
    near = (x * y).sum(axis=1) >= 0.93
    grid = neardup_vectors.Grid(x, 400 * neardup_vectors._PER_CELL, 0.93)  # 20 centroids a half
    seen, own = grid.cells(x[near]), [c[0] for c in grid.cells(y[near])]
    assert near.sum() > 500 and all(c in s for c, s in zip(own, seen, strict=True))


def test_copies_and_rows_without_id(spark):
    df = embeddings(spark, [[1.0, 2.0]] * 5 + [[1.0, 2.0]], [1] * 6, ids=[4, 3, 3, 9, 8, None])
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in neardup_vectors.near_duplicate_vectors(df).collect())
    assert got == [("3", 4, 3), ("3", 4, 3), ("4", 4, 3), ("8", 4, 3), ("9", 4, 3), ("None", 0, None)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0, 9), min_size=1, max_size=9).map(sorted), st.lists(st.floats(0, 9), min_size=1, max_size=9).map(sorted), st.floats(0, 12))
def test_multi_sequence_visits_all_in_order(a, b, limit):
    got = list(neardup_vectors.multi_sequence(a, b, limit))
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums) and sorted(got) == sorted((i, j) for i in range(len(a)) for j in range(len(b)) if a[i] + b[j] <= limit)


def test_spanning_joins_what_is_linked():
    left, right = np.array([0, 2, 5, 4]), np.array([2, 4, 6, 0])
    assert neardup_vectors.spanning(left, right, 7).tolist() == [0, 1, 0, 3, 0, 5, 5]


def test_neighbours_reach_the_recall_and_keep_ties(spark, points):
    x, labels = points
    df = embeddings(spark, [*x, *[x[7]] * 30], [*labels, *[0] * 30])
    got = ann.nearest_neighbours(df, F.col("vec_id") % 10 == 0).collect()
    x = [*x, *[x[7]] * 30]
    good = [i for i, v in enumerate(x) if v is not None and None not in list(v) and np.isfinite(v).all() and np.any(v)]
    m = np.array([x[i] for i in good], np.float64)
    ids = np.array(good)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in [i for i in good if i % 10 == 0]:
        s = vectors.cosines(m[good.index(q)], m)
        s[good.index(q)] = -9
        want = np.lexsort((ids, -s))[:5]
        found = sorted(by[q])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        for _, v, score in found:
            assert score == pytest.approx(s[good.index(v)], abs=1e-12)
        hit += len({int(ids[w]) for w in want} & {f[1] for f in found})
        total += 5
    assert set(by) == {i for i in good if i % 10 == 0} and hit >= 0.9 * total
    twins = sorted(i for i in good if np.array_equal(x[i], x[7]))
    q = next(i for i in twins if i % 10 == 0)
    assert [v for _, v, _ in sorted(by[q])] == [i for i in twins if i != q][:5]


def test_few_vectors(spark):
    assert ann.nearest_neighbours(embeddings(spark, [[1.0, 0.0]], [1]), F.lit(True)).count() == 0
    assert ann.nearest_neighbours(embeddings(spark, [], []), F.lit(True)).count() == 0
    got = ann.nearest_neighbours(embeddings(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]], [1, 1, 1]), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 2), (2, 1)]


# WARC


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", 1) for r in rows], "page_id long, url string, html string, digest string, type string, number int")


def test_archives_give_the_pages_back(spark):
    long = "".join(chr(97 + i % 26) + "é\r\n" for i in range(40_000))
    rows = [(3, "http://a/", "x" * 200), (1, "http://b/ c\r\nd", "x" * 200), (2, None, "x" * 200), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", long), (9, "u", long), (9, "u", "y" * 150), (None, "u", "x" * 200)]
    got = warc.warc_round_trip(pages(spark, rows), segment=5000, keep_payload=True).collect()
    assert len(got) == len(rows)
    found = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"]) for r in got)
    first = {"x" * 200: 1, long: 8}
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = first.get(h) if i is not None and h in first and i > first[h] else None
        want.append((str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if to else "response", to, h or ""))
    assert found == sorted(want, key=lambda r: tuple(map(str, r))) or sorted(map(str, found)) == sorted(map(str, want))
    assert warc.warc_round_trip(pages(spark, rows).filter("false")).count() == 0


def test_records_cross_archives(spark, monkeypatch):
    to = warc.scratch_path(spark, "test-warc")
    p = warc.with_revisits(pages(spark, [(i, "u", chr(97 + i) * 40_000) for i in range(4)]))
    archives = warc.write_archives(p, to, segment=3000, archive_bytes=200)
    assert archives.count() > 8
    got = warc.read_archives(archives, to).collect()
    assert sorted((int(r["page_id"]), r["payload_bytes"]) for r in got) == [(i, 40_000) for i in range(4)]
    with pytest.raises(Exception, match="segments|total length"):
        warc.read_archives(archives.orderBy("path").limit(archives.count() - 1), to).collect()


def test_revisits_name_a_record_that_is_there(spark):
    to = warc.scratch_path(spark, "test-warc")
    rows = [(i, "u", "same payload " * 20) for i in (5, 2, 2, 9)] + [(1, "u", "other")]
    archives = warc.write_archives(warc.with_revisits(pages(spark, rows)), to).collect()
    files, _ = warc.store(to)
    found = [f for a in archives for f, _ in warc.read_records(io.BufferedReader(warc._Inflated(files.open_input_stream(a["path"], compression=None))))]
    ids = {f["warc-record-id"]: f["warc-type"] for f in found}
    assert len(ids) == len(found) == 5 and sum(a["records"] for a in archives) == 5
    assert [ids[f["warc-refers-to"]] for f in found if f["warc-type"] == "revisit"] == ["response"] * 2


def test_vectors_of_other_lengths_take_no_part(spark):
    df = embeddings(spark, [[1.0, 0.0], [1.0, 0.01], [1.0], [1.0, 0.0, 0.0], [0.9, 0.0]], [1] * 5)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup_vectors.near_duplicate_vectors(df).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (0, 2), 3: (0, 3), 4: (2, 0)}
    found = ann.nearest_neighbours(df, F.col("vec_id") >= 0).collect()
    assert {r["query_id"] for r in found} == {r["vec_id"] for r in found} == {0, 1, 4}
    with pytest.raises(ValueError):
        vectors.matrix(pa.array([[1.0], [2.0, 3.0], [4.0, 5.0, 6.0]]))


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 40))
def test_chunked_framing(payload, size):
    assert warc.unchunked(warc.chunked(payload, size)) == payload


def test_broken_archives_raise():
    rec = b"".join(warc.page_records("1", "t", "u", b"z" * 50, None))
    fields, block = next(warc.read_records(io.BytesIO(rec)))
    assert fields["warc-type"] == "response" and warc.http_payload(block) == b"z" * 50
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(rec[:-60])))
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    members = io.BufferedReader(warc._Inflated(io.BytesIO(gzip.compress(rec) + gzip.compress(rec))))
    assert len(list(warc.read_records(members))) == 2
