"""Whitening, sharding and ranked search against brute force, on fixtures with odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dispute_engine.llm import lexical, queries, shared, sharding, whitening
from test_operators import SCHEMA, make_rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return shared.stored(spark.createDataFrame(rows, SCHEMA).repartition(3), "test-docs")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- 11

VECTORS = "vec_id long, embedding array<float>, label int, x string, n int"


def vector_rows(seed, n=200, d=24):
    rng = np.random.default_rng(seed)
    data = (rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) * 0.2).astype(np.float32)
    rows = [(i, v.tolist(), 0, "x", 1) for i, v in enumerate(data)]
    hole, nan, inf = data[0].tolist(), data[1].tolist(), data[2].tolist()
    hole[3], nan[4], inf[5] = None, float("nan"), float("inf")
    odd = [(900, None), (901, hole), (902, nan), (903, inf), (904, []), (905, [1.0, 2.0])]
    return rows + [(i, v, 0, "x", 1) for i, v in odd] + [(3, *rows[3][1:])] * 40 + [(None, *rows[7][1:])]


def brute_whitening(rows, k=16):
    d = Counter(len(r[1]) for r in rows if r[1]).most_common(1)[0][0]
    usable = [(r[0], [math.floor(64 * float(np.float32(c))) + 1000000 for c in r[1]]) for r in rows
              if r[1] and len(r[1]) == d and all(c is not None and math.isfinite(c) for c in r[1])]
    fit = sorted({tuple(v) for _, v in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    trace = (y ** 2).sum() / n
    out = [(i, n, sum((n * c - s) ** 2 for c, s in zip(v, sums)),
            np.array([(n * c - s) / n for c, s in zip(v, sums)]) @ vectors / np.sqrt(values)) for i, v in usable]
    return out, values / trace


def test_whitening_equals_eigh(spark):
    rows = vector_rows(1)
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    want, explained = brute_whitening(rows)
    assert len(got) == 16 * len(want)
    by = defaultdict(lambda: [None] * 16)
    for r in got:
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        assert r["identity_error"] < 1e-9
        by[(r["vec_id"], r["n"], r["deviation"])][r["component"] - 1] = r["whitened"]
    wanted = {(i, n, dev): z for i, n, dev, z in want}
    assert by.keys() == wanted.keys()
    ours, theirs = (np.array([m[k] for k in wanted], dtype=float) for m in (by, wanted))
    sign = np.sign((ours * theirs).sum(axis=0))
    assert np.abs(ours * sign - theirs).max() < 1e-8


def test_whitening_of_little(spark):
    def rows_of(*vectors):
        return whitening.whiten(spark.createDataFrame([(i, v, 0, "x", 1) for i, v in enumerate(vectors)], VECTORS))

    assert rows_of().count() == 0 and rows_of(None, []).count() == 0
    assert rows_of([1.0, 2.0], [1.0, 2.0]).count() == 0            # nothing varies
    two = rows_of([0.0, 0.0], [1.0, 0.0], [0.0, 0.0]).collect()     # one direction of variance
    assert {r["component"] for r in two} == {1} and len(two) == 3
    assert sorted(abs(round(r["whitened"], 9)) for r in two) == [1.0, 1.0, 1.0]
    large = rows_of([3e16, 1.0], [1e15, 5.0], [2e16, 9.0], [float(1 << 70), 1.0]).collect()
    assert len({r["vec_id"] for r in large}) == 3 and all(r["deviation"] is None for r in large)


@pytest.mark.parametrize("kind", ["random", "clustered", "repeated", "rank5", "one", "wide"])
def test_jacobi_davidson_pairs(kind):
    rng = np.random.default_rng(3)
    d = {"one": 1, "wide": 150}.get(kind, 40)
    values = {"random": rng.random(d), "clustered": 1 + 1e-6 * np.arange(d), "repeated": np.repeat([4.0, 1.0], d // 2),
              "rank5": np.where(np.arange(d) < 5, 2.0 + np.arange(d), 0.0)}.get(kind, rng.random(d) + 1)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    theta, u, residual = whitening.leading_pairs(lambda m: v @ m, d, 16)
    want = np.sort(values)[::-1][:16]
    assert residual <= whitening.TOLERANCE * d ** 0.5
    assert np.abs(theta - want).max() < 1e-12 * want[0]
    assert np.abs(u.T @ u - np.eye(len(theta))).max() < 1e-12


# ---------------------------------------------------------------- 12

def mix(word, seed):
    """64-bit xxHash of one 8-byte word."""
    p1, p2, p3, p4, p5 = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579,
                          2870177450012600261)
    m = (1 << 64) - 1

    def turn(v, n):
        return (v << n | v >> 64 - n) & m

    h = (seed + p5 + 8) & m ^ turn(word * p2 & m, 31) * p1 & m
    h = turn(h, 27) * p1 + p4 & m
    h = (h ^ h >> 33) * p2 & m
    h = (h ^ h >> 29) * p3 & m
    return h ^ h >> 32


def descend(tree, key):
    node = ""
    for level in range(3):
        best = None
        for path, weight in sharding.children(tree, level)[node].items():
            seed = mix(sharding.node_hash(path), 42)
            h = seed if key is None else mix(key & (1 << 64) - 1, seed)
            draw = -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight
            best = min(best, (draw, path)) if best else (draw, path)
        node = best[1]
    return int(node.rsplit("/", 1)[1])


def test_sharding_equals_brute_force(docs, rows, none):
    tree = sharding.layout(16)
    more = sharding.grown(tree)
    got = sharding.shard_documents(docs, tree, more).collect()
    want = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        want[(r[0], len(raw) + 1, zlib.crc32(raw), "key", descend(tree, r[0]), descend(more, r[0]))] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_documents(none, tree, more).count() == 0


def test_shares_follow_weights_and_movement_stays_in_the_subtree(spark):
    ids = spark.range(40_000).withColumnRenamed("id", "k")
    tree = [sharding.Shard(i, f"r{i // 4}", f"k{i // 2 % 2}", 1.0 + i % 2) for i in range(8)]
    heavier = [sharding.Shard(s.number, s.region, s.rack, 5.0 if s.number == 3 else s.weight) for s in tree]
    placed = sharding.place(sharding.place(ids, tree, F.col("k"), "a"), heavier, F.col("k"), "b").toPandas()
    share = placed["a"].value_counts(normalize=True)
    for s in tree:
        assert share[s.number] == pytest.approx(s.weight / 12, abs=0.01)
    moved = placed[placed["a"] != placed["b"]]
    assert set(moved["b"]) <= {0, 1, 2, 3} and len(moved)
    inside = moved[moved["a"].isin([2, 3])]            # the same rack: only into the heavier shard
    assert set(inside["b"]) == {3}
    assert set(moved[moved["a"].isin([0, 1])]["b"]) <= {2, 3}


def test_one_hot_key_still_gets_gapless_slots(spark):
    hot = spark.range(0, 5000, 1, 7).select(F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")).alias("doc_id"),
                                            F.lit("same").alias("text"))
    got = sharding.shard_documents(hot, sharding.layout(4)).toPandas()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert got["grown_shard"].isna().all()


def test_written_shards_hold_every_row(spark, docs, rows):
    path = shared.scratch(spark, "test-shards")
    sharding.write_shards(docs, sharding.layout(4), path)
    back = spark.read.parquet(path)
    assert Counter(tuple(r) for r in back.select(*docs.columns).collect()) == Counter(rows)


def test_sharding_sql(spark, tmp_path):
    data = [(i * 7 - 30, t) for i, t in enumerate(["", None, "x", "ä ö", "😀", "same", "same", "a" * 300])]
    docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    con = duckdb.connect()
    pdf = docs.toPandas()
    con.register("documents", pdf)
    tree = queries.TREE
    got = sharding.shard_documents(docs, tree, sharding.grown(tree)).collect()
    assert Counter(tuple(r) for r in got) == Counter(con.execute(queries.ORACLES["op12_sharding"]).fetchall())


# ---------------------------------------------------------------- 13

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(rows, items, top=20):
    held = [(r[0], Counter(TERM.findall((r[1] or "").translate(AZ)))) for r in rows]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(AZ)))
        scores = []
        for d, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scores)[:top], 1):
            out[(item, rank, d, -s)] += 1
    return out


ITEMS = "item_id long, text string, doc_id long, term string, score int"


def item_rows(rows):
    texts = [r[1] for r in rows if r[1]]
    items = [(i, " ".join(t.split()[:30]), 1, "t", 0) for i, t in enumerate(texts[:25])]
    return items + [(100, None, 1, "t", 0), (101, "", 1, "t", 0), (102, "?!", 1, "t", 0), (103, "nowhere", 1, "t", 0),
                    (104, "the the THE river", 1, "t", 0), (105, "ONE", 1, "t", 0), (5, "one two", 1, "t", 0),
                    (None, "the green hills", 1, "t", 0), (106, "über straße 日本 the", 1, "t", 0)]


@pytest.mark.parametrize("block", [3, 16, 4096])
@pytest.mark.parametrize("top", [1, 4, 20])
def test_ranked_search_equals_brute_force(spark, docs, rows, monkeypatch, block, top):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    items = item_rows(rows)
    got = lexical.ranked_search(docs, spark.createDataFrame(items, ITEMS).repartition(2), top).collect()
    assert Counter(tuple(r) for r in got) == brute_search(rows, [i[:2] for i in items], top)


def test_ranked_search_in_rounds(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(lexical, "ROUND_BYTES", 1500)
    items = item_rows(rows)
    got = lexical.ranked_search(docs, spark.createDataFrame(items, ITEMS)).collect()
    assert Counter(tuple(r) for r in got) == brute_search(rows, [i[:2] for i in items])


def test_ranked_search_of_nothing(spark, docs, none):
    items = spark.createDataFrame([], ITEMS)
    assert lexical.ranked_search(docs, items).count() == 0
    assert lexical.ranked_search(none, spark.createDataFrame([(1, "the", 1, "t", 0)], ITEMS)).count() == 0


def test_pair_bounds_are_tighter_than_single_maxima():
    """Two rare terms of different documents: single maxima add up, the pair's bound does not."""
    lists = lexical._Postings([1, 2], np.array([1, 1]), np.array([0, 1]), np.array([900_000, 800_000]))
    items = lexical.pair_items([(7, Counter({1: 1, 2: 1}))], np.array([-1, 9000, 8000]))
    a, _, b, _ = items.pairs[0]
    assert (a, b) == (1, 2)
    pair = max(9000 * 900_000, 8000 * 800_000)
    acc = np.zeros(2, np.int64)
    docs, score = lexical.score_block(lists, np.array([pair]), items.unit, items, acc, 1)
    assert dict(zip(docs.tolist(), score.tolist())) == {0: 9000 * 900_000, 1: 8000 * 800_000} and not acc.any()
    assert score.max() <= pair < 9000 * 900_000 + 8000 * 800_000
    docs, _ = lexical.score_block(lists, np.array([pair]), items.unit, items, acc, pair + 1)
    assert not len(docs)


def test_weights_and_norms_beyond_63_bits():
    n = np.array([10 ** 9, 3], dtype=np.int64)
    assert lexical.length_norm(n, 10 ** 11, 10 ** 14).tolist() == [75 + 25 * 10 ** 9 * 10 ** 11 // 10 ** 14, 75]
    assert lexical.terms("Ä1-b_C\x00d\u2003e".encode()) == ["Ä1".encode(), b"b", b"c", "d\u2003e".encode()]
