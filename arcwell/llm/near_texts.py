"""Near copies among the documents of a corpus: SimHash candidates, and an exact way for the rest.

Documents with the same set of word shingles are one class.  Candidates are

1. classes whose SimHash fingerprints the byte-position index links (see ``simhash``);
2. classes that share one of their first shingles in an order of all (prefix filter).

No fingerprint distance is certain at a similarity of 0.8, the second kind is: sets that
similar are bound to share a first shingle.  Candidates that share too few of their smallest
hashes go (see ``sketched``); every other one is verified by the whole sets.

A key that many share is compared by stars before anything else: its rows with one of them.
What is linked so needs no more pairs; only rows still in different components are compared
each with each, in blocks, once stars have made these few: where a block's texts are together,
so that it returns no more links than join them.  Keys that a sample shows to be
frequent are salted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwell.llm.common import kept, small_batches
from arcwell.llm.components import connected_components
from arcwell.llm.simhash import near_links

#: Documents that a sample for common shingles has, and how many of those it tells.
SAMPLED, COMMON = 20_000, 200_000
#: Occurrences in the sample for each salt of a frequent shingle.
_SALT = 64
#: Rows of a key, and shingles of these, that one block holds when all its pairs are compared; pairs a
#: row from which another star round comes first, how many there may be, and rows a link from which one isn't worth it; and pairs
#: a row of a block up to which these are given themselves.
BLOCK, VOLUME, MANY_PAIRS, STARS, IDLE, FEW = 2048, 2_000_000, 1000, 8, 50, 2
#: Smallest hashes of a set that are kept with it, and how many of them similar sets share.
SKETCH, SHARED = 32, 9
#: Texts taken apart at once.
_TEXTS = 256


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The ascending 64-bit hashes of a text's different word shingles, words as in ``simhash.fingerprint``."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    shingle = min(shingle, len(words))
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    total = len(words) - shingle + 1
    found = np.full(total, shingle, np.uint64)  # fewer words are never the same shingle as more
    for i in range(shingle):
        found = found * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + total]
    return np.unique(_mix(found))


def set_fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes: a bit is set if over half of them set it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        part = found[at : at + (1 << 16)]
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(found)).tobytes(), "big")


def least_overlap(similarity: float, sizes):
    """What two sets with this sum of sizes share at least at that Jaccard similarity."""
    return np.ceil(similarity / (1 + similarity) * sizes - 1e-9)


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles in an order of all, rare ones first: similar sets share one of these.

    Sets with a Jaccard similarity of at least s share ceil(s * n) of the n elements of either, so
    not all of the first n - ceil(s * n) + 1 in any order that both keep can be missing in the other.
    """
    n = len(found)
    if not n:
        return found
    if len(common):
        found = found[np.argsort(_frequency(found, common, counts), kind="stable")]
    return found[: n - int(np.ceil(similarity * n - 1e-9)) + 1]


def _frequency(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(common):
        return np.zeros(len(found), np.int64)
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    return np.where(common[at] == found, counts[at], 0)


def possible(n_a, pos_a, n_b, pos_b, similarity: float) -> np.ndarray:
    """Whether sets can be similar by their sizes and what is left after a shingle both have.

    That is certain at the first shingle that both have, so no similar pair is refused at each of its shingles.
    """
    return np.minimum(n_a - pos_a, n_b - pos_b) >= least_overlap(similarity, n_a + n_b)


def sketch(found: np.ndarray) -> bytes:
    """The low halves of the ``SKETCH`` smallest hashes; missing ones are zero."""
    out = np.zeros(SKETCH, np.uint32)
    least = found[:SKETCH].astype(np.uint32)
    out[: len(least)] = least
    return out.tobytes()


def sketched(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets may be similar by how many of their smallest hashes (rows of x and y) they share.

    The smallest ``SKETCH`` hashes of both together are a random sample of the union, and those of
    the sample that both sets have are in both sketches: 25.6 of 32 on average at a Jaccard
    similarity of 0.8, and fewer than 9 with a probability below 1e-10, as rare as equal hashes.
    """
    both = np.sort(np.concatenate((x, y), axis=1), axis=1)
    shared = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != 0)).sum(axis=1)
    least = np.minimum(SHARED * similarity / 0.8, least_overlap(similarity, n_x + n_y))
    return shared >= np.floor(least)


def _sets(rows: DataFrame, shingle: int, common: np.ndarray, counts: np.ndarray, similarity: float) -> DataFrame:
    """(doc_id, version, high, low, fp, n, sketch, first): each row's class, fingerprint, size, smallest hashes and first shingles."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                sets = [shingle_set(t.as_py(), shingle) for t in part.column("text")]
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").astype(np.int64).reshape(-1, 2)
                prints = np.array([set_fingerprint(s) for s in sets], np.uint64).view(np.int64)
                first = [prefix(s, common, counts, similarity).view(np.int64) for s in sets]
                arrays = [part.column("doc_id"), part.column("version"), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(prints), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array(first, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "version", "high", "low", "fp", "n", "sketch", "first"])

    return rows.mapInArrow(run, "doc_id long, version long, high long, low long, fp long, n int, sketch binary, first array<long>")


def _common(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a bounded sample has often, ascending, and how often.

    They only say in what order a set's shingles are taken and which keys are salted; any
    order that is the same for all gives the same links.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                found = [shingle_set(t.as_py(), shingle) for t in batch.column("text").slice(at, _TEXTS)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows.count() // SAMPLED))) == 0)
    often = sample.select("text").mapInArrow(run, "h long").groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    common, counts = often.column(0).to_numpy().view(np.uint64), often.column(1).to_numpy()
    order = np.argsort(common)
    return common[order], counts[order]


def _postings(firsts: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(k, hot, id, n, pos) of every first shingle; a frequent one's k is salted and hot is the shingle."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part.column("first")
                k = lists.flatten().to_numpy().view(np.uint64)
                each = np.diff(lists.offsets.to_numpy())
                ids, n = np.repeat(part.column("node").to_numpy(), each), np.repeat(part.column("n").to_numpy(), each)
                pos = np.arange(len(k)) - np.repeat(np.cumsum(each) - each, each)
                salts = (_frequency(k, common, counts) // _SALT + 1).astype(np.uint64)
                key = np.where(salts > 1, _mix(k ^ _mix(_mix(ids.view(np.uint64)) % salts + np.uint64(1))), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(k.view(np.int64), mask=salts == 1), pa.array(ids), pa.array(n), pa.array(pos.astype(np.int32))],
                    names=["k", "hot", "id", "n", "pos"],
                )

    return firsts.mapInArrow(run, "k long, hot long, id long, n int, pos int")


def _meeting(postings: DataFrame, similarity: float) -> DataFrame:
    """(k, hot, id, n, pos, center, near): rows whose key another row has too, or that are salted.

    ``center`` is the smallest id of the key; ``near`` says whether the row may be similar to it.
    The rows of a key pass by in order, none but the last is held.
    """
    names = ["k", "hot", "id", "n", "pos", "center", "near"]

    def run(batches):
        held, before, first = None, False, (0, 0, 0)  # the last row, whether the one before had its key, and its key's first row
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            k, ids, n, pos = (rows.column(c).to_numpy() for c in ("k", "id", "n", "pos"))
            same = k[1:] == k[:-1]
            prev = np.concatenate(([before], same))
            start = np.maximum.accumulate(np.where(prev, -1, np.arange(len(k))))  # -1: the key goes on from the rows before
            center, c_n, c_pos = (np.where(start < 0, f, x[np.maximum(start, 0)]) for f, x in zip(first, (ids, n, pos), strict=True))
            yield _met(rows, prev, np.concatenate((same, [False])), center, c_n, c_pos, len(k) - 1)
            held, before, first = rows.slice(len(k) - 1).to_batches()[0], bool(prev[-1]), (int(center[-1]), int(c_n[-1]), int(c_pos[-1]))
        if held is not None:
            one = lambda x: np.array([x])
            yield _met(pa.Table.from_batches([held]), one(before), one(False), one(first[0]), one(first[1]), one(first[2]), 1)

    def _met(rows, prev, following, center, c_n, c_pos, upto) -> pa.RecordBatch:
        rows = rows.slice(0, upto)
        good = (prev | following)[:upto] | rows.column("hot").is_valid().to_numpy()
        n, pos = rows.column("n").to_numpy(), rows.column("pos").to_numpy()
        near = possible(n, pos, c_n[:upto], c_pos[:upto], similarity) & (rows.column("id").to_numpy() != center[:upto])
        out = pa.table([*(rows.column(c) for c in names[:5]), pa.array(center[:upto]), pa.array(near)], names=names).filter(pa.array(good)).combine_chunks()
        return out.to_batches()[0] if out.num_rows else pa.RecordBatch.from_pylist([], schema=out.schema)

    return postings.repartition("k").sortWithinPartitions("k", "id").mapInArrow(run, "k long, hot long, id long, n int, pos int, center long, near boolean")


def _pairs(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose sets have that Jaccard similarity.

    Both texts of a pair come to it; the texts themselves are moved once for all pairs.
    """
    each = classes.select("node", "n", "sketch", F.struct("doc_id", "version").alias("place"))
    p = pairs.filter("a <> b").distinct()
    p = p.join(each.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("x"), F.col("place").alias("p")), "a")
    p = p.join(each.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("y"), F.col("place").alias("q")), "b")
    p = p.filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similarity - 1e-9).select("a", "b", "n_a", "n_b", "x", "y", "p", "q")

    def may_be(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SKETCH) for c in ("x", "y"))
            good = sketched(x, y, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), similarity)
            yield batch.select(["a", "b", "p", "q"]).filter(pa.array(good))

    place = "struct<doc_id: bigint, version: bigint>"
    p = p.mapInArrow(may_be, f"a long, b long, p {place}, q {place}")
    side = lambda c, second: F.struct(f"{c}.doc_id", f"{c}.version", F.lit(second).alias("second"))
    p = kept(p.select("a", "b", F.explode(F.array(side("p", False), side("q", True))).alias("side")).select("a", "b", "side.*"), "pairs")
    wanted = p.select("doc_id", "version").distinct()
    texts = rows.join(wanted, ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"])
    both = p.join(texts, ["doc_id", "version"]).select("a", "b", "second", "text")

    def run(batches):
        held = None
        for batch in batches:
            keep = []
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for i, (pair, text) in enumerate(zip(zip(a, b, strict=True), batch.column("text"), strict=True)):
                found = shingle_set(text.as_py(), shingle)
                if held is None or held[0] != pair:
                    held = (pair, found)
                    continue
                shared = len(np.intersect1d(held[1], found, assume_unique=True))
                if shared >= least_overlap(similarity, len(held[1]) + len(found)):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.repartition("a", "b").sortWithinPartitions("a", "b", "second").select("a", "b", "text").mapInArrow(run, "a long, b long")


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after more links: only what these join is worked on again, by its roots."""
    if roots is None:
        return kept(connected_components(links), "roots")
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    new = kept(connected_components(between), "roots").select(F.col("node").alias("old"), F.col("root").alias("top"))
    known = roots.unionByName(new.join(roots, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("old").alias("root")))
    return kept(known.join(new, F.col("root") == F.col("old"), "left").select("node", F.coalesce("top", "root").alias("root")), "roots")


def _apart(meets: DataFrame, roots: DataFrame, seed: int) -> DataFrame:
    """(key, id, n, pos, root; size, volume and center of the key) of keys whose rows are in different components."""
    rows = meets.join(roots, F.col("id") == F.col("node"), "left").select(F.coalesce("hot", "k").alias("key"), "id", "n", "pos", F.coalesce("root", "id").alias("root"))
    by = F.xxhash64("id", F.lit(seed))
    keys = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("volume"), *[F.min_by(c, by).alias(f"c_{c}") for c in ("id", "n", "pos", "root")])
    return kept(rows.join(keys.filter("least < most").drop("least", "most"), "key"), "apart")


def _dealt(apart: DataFrame) -> DataFrame:
    """(g, key, id, n, pos, root): the rows of each key, in blocks where they are many or long."""
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("volume") / VOLUME)).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = apart.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "key", "id", "n", "pos", "root")


def _steps(r: dict, similarity: float):
    """Places (i, j) of possible pairs of a key's rows in different components, some at a time."""
    order = np.lexsort((r["n"], r["key"], r["g"]))
    g, key, n, pos, root = (r[c][order] for c in ("g", "key", "n", "pos", "root"))
    at, step = np.arange(len(order)), 0
    while len(at):
        step += 1
        at = at[at + step < len(order)]
        # sizes ascend: what is too large for a row is so from there on
        at = at[(g[at] == g[at + step]) & (key[at] == key[at + step]) & (n[at] >= similarity * n[at + step] - 1e-9)]
        good = at[(root[at] != root[at + step]) & possible(n[at], pos[at], n[at + step], pos[at + step], similarity)]
        if len(good):
            yield order[good], order[good + step]


def _paired(blocks: DataFrame, similarity: float) -> DataFrame:
    """The rows of blocks that may be similar to another one of theirs by sizes and positions."""
    names = ["g", "key", "id", "n", "pos", "root"]

    def run(batches):
        for r in _groups(batches, names):
            paired = np.zeros(len(r["g"]), bool)
            for i, j in _steps(r, similarity):
                paired[i] = paired[j] = True
            yield pa.RecordBatch.from_arrays([pa.array(r[c][paired]) for c in names], names=names)

    return blocks.repartition("g").sortWithinPartitions("g").mapInArrow(run, "g long, key long, id long, n int, pos int, root long")


def _sparse_and_dense(blocks: DataFrame, similarity: float) -> DataFrame:
    """(g, id, n, root, mate) of rows (g, key, id, n, pos, root, sketch) whose sketches are alike as well.

    A key that has at most ``FEW`` such pairs a row in a block gives these, as id and mate.  Of
    others all rows that have a pair are given, without mate; g then is a hash of their ids.
    """
    names, most = ["g", "id", "n", "root", "mate"], FEW

    def run(batches):
        for r in _groups(batches, ["g", "key", "id", "n", "pos", "root", "sketch"]):
            sketches = np.frombuffer(b"".join(r["sketch"]), np.uint32).reshape(-1, SKETCH)
            _, of, size = np.unique(np.stack((r["g"], r["key"])), axis=1, return_inverse=True, return_counts=True)
            of = of.reshape(-1)
            count, paired, pairs = np.zeros(len(size), np.int64), np.zeros(len(of), bool), []
            for i, j in _steps(r, similarity):
                new = ~(paired[i] & paired[j]) | (count[of[i]] <= most * size[of[i]])
                i, j = i[new], j[new]
                good = sketched(sketches[i], sketches[j], r["n"][i], r["n"][j], similarity)
                i, j = i[good], j[good]
                paired[i] = paired[j] = True
                count += np.bincount(of[i], minlength=len(size))
                some = count[of[i]] <= most * size[of[i]]
                pairs.append(np.stack((i[some], j[some])))
            i, j = np.concatenate([np.empty((2, 0), np.int64), *pairs], axis=1)
            few = count <= most * size
            i, j = i[few[of[i]]], j[few[of[i]]]
            rest = np.flatnonzero(paired & ~few[of])
            rest = rest[np.lexsort((r["id"][rest], of[rest]))]
            g = [np.full(len(x), xxhash.xxh3_64_intdigest(r["id"][x].tobytes()), np.uint64) for x in np.split(rest, np.flatnonzero(np.diff(of[rest])) + 1)]
            zero, both = np.zeros(len(i), np.int64), np.concatenate((i, rest))
            mate = pa.array(np.concatenate((r["id"][j], np.zeros(len(rest), np.int64))), mask=np.arange(len(both)) >= len(i))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((zero, np.concatenate(g).view(np.int64)))), *(pa.array(r[c][both]) for c in ("id", "n", "root")), mate], names=names)

    return blocks.repartition("g").sortWithinPartitions("g").mapInArrow(run, "g long, id long, n int, root long, mate long")


def _within(apart: DataFrame, classes: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) that join what all links between each key's rows in different components join.

    Where a key has few pairs, each is verified.  Otherwise sets are compared where all rows of
    a block are together, so it gives fewer links than it has rows, however many are alike; rows
    that meet under many keys do so once.  Only rows that may be similar to another of their
    block by sizes and positions get their sketches, and only those still so their texts.
    """
    near = kept(_paired(_dealt(apart), similarity), "paired")
    each = classes.select(F.col("node").alias("id"), "sketch", "doc_id", "version")
    found = kept(_sparse_and_dense(near.join(each.select("id", "sketch"), "id"), similarity), "paired")
    few = _verified(found.filter("mate is not null").select(*_pairs("id", "mate")), classes, rows, shingle, similarity)
    dense = found.filter("mate is null").dropDuplicates(["g", "id"]).select("g", F.col("g").alias("key"), "id", "n", F.lit(0).alias("pos"), "root")
    places = each.drop("sketch").join(dense.select("id").distinct(), "id", "left_semi")
    texts = rows.select("doc_id", "version", "text").join(places, ["doc_id", "version"]).dropDuplicates(["id"]).select("id", "text")
    blocks = dense.join(each.select("id", "sketch"), "id").join(texts, "id")
    names = ["g", "key", "id", "n", "pos", "root", "sketch", "text"]

    def run(batches):
        for r in _groups(batches, names):
            sketches = np.frombuffer(b"".join(r["sketch"]), np.uint32).reshape(-1, SKETCH)
            above: dict[int, int] = {}

            def top(x):
                while (y := above.get(x, x)) != x:
                    above[x] = x = above.get(y, y)
                return x

            sets: dict[int, np.ndarray] = {}

            def found(i):
                if (x := int(r["id"][i])) not in sets:
                    sets[x] = shingle_set(r["text"][i], shingle)
                return sets[x]

            a, b = [], []
            for i, j in _steps(r, similarity):
                good = sketched(sketches[i], sketches[j], r["n"][i], r["n"][j], similarity)
                for x, y in zip(i[good].tolist(), j[good].tolist(), strict=True):
                    p, q = top(int(r["root"][x])), top(int(r["root"][y]))
                    if p == q:
                        continue
                    shared = len(np.intersect1d(found(x), found(y), assume_unique=True))
                    if shared >= least_overlap(similarity, len(found(x)) + len(found(y))):
                        above[p] = q
                        a.append(int(r["id"][x]))
                        b.append(int(r["id"][y]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return few.union(blocks.select(names).repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long"))


def _groups(batches, names: list[str]):
    """Arrays by name of rows that are sorted by g, cut between groups only; a group is a block or two."""
    held: list[pa.RecordBatch] = []
    values = lambda b, c: b.column(c).to_numpy(zero_copy_only=False)
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column("g").to_numpy()
        if held and held[0].column("g")[0].as_py() == g[-1] or not held and g[0] == g[-1]:
            held.append(batch)
            continue
        upto = int(np.searchsorted(g, g[-1]))
        yield {c: np.concatenate([*(values(h, c) for h in held), values(batch, c)[:upto]]) for c in names}
        held = [batch.slice(upto)]
    if held:
        yield {c: np.concatenate([values(h, c) for h in held]) for c in names}


def _classes(prints: DataFrame) -> DataFrame:
    """One row per set: high, low, fp, n, sketch, its first place (doc_id, version) and node, an id of its own.

    The node is the place's doc_id, unless that has several texts.
    """
    classes = prints.groupBy("high", "low").agg(F.min(F.struct("doc_id", "version")).alias("place"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).select("high", "low", "place.*", "fp", "n", "sketch")
    several = classes.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("s_id"))
    node = F.when(F.col("s_id").isNull(), F.col("doc_id")).otherwise(F.xxhash64("high", "low"))
    return kept(classes.join(several, F.col("doc_id") == F.col("s_id"), "left").withColumn("node", node).drop("s_id"), "classes")


def near_text_classes(rows: DataFrame, shingle: int = 5, similarity: float = 0.8, max_bits: int = 2) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id, version, text): each row's class (doc_id, version, high, low), and the classes with their component.

    The second has high, low, doc_id and version of the class's first place, and those of
    its component's (first_id, first_version).
    """
    small_batches(rows.sparkSession)
    common, counts = _common(rows, shingle)
    prints = kept(_sets(rows, shingle, common, counts, similarity), "prints")
    classes = _classes(prints)
    here = classes.select("high", "low", "node", F.struct("doc_id", "version").alias("place"))
    firsts = prints.join(here, ["high", "low"]).filter(F.struct("doc_id", "version") == F.col("place")).select("node", "n", "first")
    meets = kept(_meeting(_postings(firsts, common, counts), similarity), "postings")

    by_print = classes.groupBy("fp").agg(F.min("node").alias("least"))
    simhash = classes.join(by_print, "fp").select(*_pairs("least", "node"))
    linked = near_links(by_print.select("fp"), max_bits)
    linked = linked.join(by_print.select(F.col("fp").alias("a"), F.col("least").alias("p")), "a").join(by_print.select(F.col("fp").alias("b"), F.col("least").alias("q")), "b")
    stars = meets.filter("near").select(*_pairs("id", "center"))
    salted = meets.filter("hot is not null and id = center")
    tops = salted.join(salted.groupBy("hot").agg(F.min("id").alias("top")), "hot").select(*_pairs("id", "top"))
    links = kept(_verified(simhash.union(linked.select(*_pairs("p", "q"))).union(stars).union(tops), classes, rows, shingle, similarity), "links")
    roots = _joined(None, links)
    apart = _apart(meets, roots, 0)
    for turn in range(1, STARS):
        rows_of, pairs_of = apart.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("size") - 1) / 2), F.lit(0.0))).first()
        if pairs_of <= MANY_PAIRS * rows_of:
            break
        left = F.least(F.col("n") - F.col("pos"), F.col("c_n") - F.col("c_pos"))
        near = (F.col("root") != F.col("c_root")) & (left >= F.ceil(similarity / (1 + similarity) * (F.col("n") + F.col("c_n")) - 1e-9))
        found = kept(_verified(apart.filter(near).select(*_pairs("id", "c_id")), classes, rows, shingle, similarity), "links")
        roots = _joined(roots, found)
        apart = _apart(meets, roots, turn)
        if found.count() * IDLE < rows_of:
            break
    roots = _joined(roots, kept(_within(apart, classes, rows, shingle, similarity), "links"))
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "version")).alias("first"))
    labels = rooted.join(first.hint("merge"), "root").select("high", "low", "doc_id", "version", F.col("first.doc_id").alias("first_id"), F.col("first.version").alias("first_version"))
    return prints.select("doc_id", "version", "high", "low"), kept(labels, "labels")


def _versioned(docs: DataFrame, *carry: str) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"), *carry)


def near_text_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of documents whose sets of word shingles are alike.

    Documents are linked exactly if their sets have a Jaccard similarity of at least
    ``similarity``; a component is what links connect, its id the smallest doc_id in it.
    Shingles are told apart by hashes of 64 bits, sets of equal documents by 128.
    Texts without words (null, empty, blank) are alike; rows without an id aren't returned;
    rows with one id and different texts are documents of their own, repeated rows are
    returned as often as they occur.
    """
    rows = _versioned(docs).filter("doc_id is not null")
    prints, labels = near_text_classes(rows, shingle, similarity)
    return prints.join(labels.select("high", "low", F.col("first_id").alias("component_id")).hint("merge"), ["high", "low"]).select("doc_id", "component_id")


def without_near_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars), one document of each group of near copies.

    The one with the smallest doc_id stays; of several texts with that id the first by a
    hash.  Of rows with equal id and text one stays, the least by the other columns.
    Rows without an id stay.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    all_rows = _versioned(docs, "lang", "source", "n_chars")
    rows = all_rows.filter("doc_id is not null")
    prints, labels = near_text_classes(rows.select("doc_id", "version", "text"), shingle, similarity)
    first = labels.filter("doc_id = first_id and version = first_version").select("high", "low", "first_id", "first_version")
    places = prints.join(first.hint("merge"), ["high", "low"], "left")
    gone = kept(places.filter("first_id is null or doc_id <> first_id or version <> first_version").select("doc_id", "version").distinct(), "gone")
    stays = rows.join(gone, ["doc_id", "version"], "left_anti").select("version", *columns)
    if prints.count() > prints.select("doc_id", "version").distinct().count():
        stays = stays.groupBy("doc_id", "version").agg(F.min(F.struct(*columns)).alias("r")).select("version", "r.*")
    return stays.select(*columns).union(all_rows.filter("doc_id is null").select(*columns))
