"""Every operator against brute force, on fixtures with NULLs, empty and long texts, ties, copies and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dispute_engine.llm import (binary_output, bpe, exact, jaccard, langid, lm_scoring, packing, quality, queries, rans,
                                shared, tokens, toxicity, urls)
from dispute_engine.sources.io import path_exists

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string, key int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make_rows(n=60, seed=3):
    """Random prose with copies, near copies, shared passages and edge cases; the last columns clash on purpose."""
    rng = random.Random(seed)
    vocab = {"en": ["the", "house", "river", "stone", "walks", "over", "green", "hills", "and", "sings"],
             "de": ["das", "haus", "über", "grün", "fluss", "wandert", "und", "singt", "schön", "straße"]}
    base = "the shared passage that many documents hold word for word in the very same order".split()
    texts = []
    for i in range(n):
        lang = "de" if i % 3 == 0 else "en"
        w = [rng.choice(vocab[lang]) + str(rng.randint(0, 400)) for _ in range(rng.randint(3, 120))]
        if i % 7 == 0:
            w += base
        texts.append((" ".join(w), lang))
    big = " ".join(rng.choice(vocab["en"]) + str(rng.randint(0, 10 ** 6)) for _ in range(6000))
    near = texts[5][0].split()
    texts += [(None, "en"), ("", "en"), ("  \n\t ", None), ("one two", "en"), ("one two", "en"), ("ONE two", "de"),
              ("Ein<|endoftext|>Wort\x1c \u2003 ½² \x85日本 😀\n\n\n  x", "de"), (big, "en"),
              ("same line\nsame line\nother\n" * 3, "en"), ("#*$%& " * 30, "en"), ("12345 678", "en")]
    texts += [texts[2]] * 4 + [(" ".join(near[:-1] + ["changed"]), "en"), (" ".join(near + ["more"]), "en")]
    rows = [(i, t, lang, f"src{i % 2}", None, "r", "d", i % 5) for i, (t, lang) in enumerate(texts)]
    return rows + [(None, "a row without an id", "en", None, 1, None, None, None), rows[4], rows[4]]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return shared.stored(spark.createDataFrame(rows, SCHEMA).repartition(3), "test-docs")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    data = [(i, i % 2, i % 5 == 0 and 1 or 0, "x") for i in range(len(rows))] + [(3, None, None, "y"), (5, 1, 1, "z")]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def library():
    return tokens.library(tokens.default_vocab())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def raw(ids):
    return np.array(ids, dtype="<u4").tobytes()


# ---------------------------------------------------------------- 1, 2, 7: ids

def test_bpe_round_trip(spark, docs, rows, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 4000)  # several blocks
    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"])
                  for r in bpe.encode_decode(docs).collect())
    want = Counter()
    for r in rows:
        ids = ids_of(library, r[1])
        want[(r[0], len(ids), raw(ids), library.decode(ids, skip_special_tokens=False))] += 1
    assert got == want


def test_bpe_empty(none):
    assert bpe.encode_decode(none).count() == 0


def test_words_split_like_the_library(library):
    for text in ("x\x1cy \x1c z", "I'm  we've\tIT'S 12a½", "a\u2003b ²", "  \n\n x ", "<|endoftext|><|endoftext|>a"):
        assert sum((ids_of(library, w) for w in tokens.words(text)), []) == ids_of(library, text)
        assert tokens.encoder(tokens.default_vocab())(text) == ids_of(library, text)


def test_long_white_space_goes_to_the_library(library):
    text = " " * 30_000 + "x"
    assert tokens.encoder(tokens.default_vocab())(text) == ids_of(library, text)


@pytest.mark.parametrize("window", [16, 1024])
def test_packing_is_whole_and_gapless(spark, docs, rows, library, window):
    got = packing.pack_documents(docs, window, with_ids=True).collect()
    held = defaultdict(list)
    sequences = defaultdict(list)
    for r in got:
        held[(r["doc_id"], r["doc_tokens"])].append(r)
        sequences[r["sequence_id"]].append(r)
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    want = Counter()
    for r in rows:
        ids = [*ids_of(library, r[1]), 0]
        for start in range(0, len(ids), window):
            want[(r[0], start, raw(ids[start:start + window]), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], bytes(r["ids"]), r["doc_tokens"]) for r in got) == want
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window


def test_packing_empty(none):
    assert packing.pack_documents(none).count() == 0


def best_fill(counts, window):
    """Every reachable sum that holds the longest length, by brute force."""
    longest = max(counts)
    sums = {longest}
    for length, n in counts.items():
        for _ in range(n - (length == longest)):
            sums |= {s + length for s in sums if s + length <= window}
    if window in sums:
        return {window}
    powers = [s for s in sums if s & (s - 1) == 0]
    return {max(powers)} if powers else {max(sums)}


@pytest.mark.parametrize("seed", range(40))
def test_fill_window_has_minimum_slack(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 64): rng.randint(1, 4) for _ in range(rng.randint(1, 9))}
    chosen = packing.fill_window(counts, 64)
    assert all(n <= counts[k] for k, n in chosen.items()) and chosen[max(counts)] >= 1
    assert sum(k * n for k, n in chosen.items()) in best_fill(counts, 64)
    used = Counter()
    for c, times in packing.patterns(counts, 64):
        for k, n in c.items():
            used[k] += n * times
    assert used == Counter(counts)


def test_range_coder_round_trip_and_checkpoints():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 33, 5000, 300_000):
        ids = (rng.zipf(1.3, n) % 50_000).astype(np.uint32)
        data = rans.encode_segment(np.array([n] * bool(n), dtype=np.uint32), ids)
        lengths, back = rans.decode_segment(data)
        assert back.tolist() == ids.tolist() and lengths.sum() == n
    symbols, freq = rans.frequencies(ids)
    assert freq.sum() == 1 << rans.SCALE and freq.min() >= 1
    f, c = np.ones(50_000, np.uint64), np.zeros(50_000, np.uint64)
    f[symbols], c[symbols] = freq, np.cumsum(freq) - freq
    block, table = rans.encode_block(ids, f, c), rans.decode_table(symbols, freq)
    for k in (0, 2):
        tail, _ = rans.decode_block(memoryview(block), table, k)
        assert tail.tolist() == ids[-len(tail):].tolist() and 0 < len(tail) < len(ids)
    with pytest.raises(ValueError):
        rans.decode_segment(data[:-9] + bytes([data[-9] ^ 1]) + data[-8:])


def test_binary_output(spark, docs, rows, library, monkeypatch):
    monkeypatch.setattr(binary_output, "SEGMENT", 2000)
    path = shared.scratch(spark, "test-ids")
    binary_output.write_ids(docs, path)
    got = sorted(binary_output.read_ids(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    at = 0
    for r, want in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = [*ids_of(library, want[1]), 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) == (want[0], at, len(ids), raw(ids))
        assert r["ids_crc32"] == zlib.crc32(raw(ids))
        at += len(ids)


def test_binary_output_empty(spark, none):
    path = shared.scratch(spark, "test-ids")
    binary_output.write_ids(none, path)
    assert binary_output.read_ids(spark, path).count() == 0


# ---------------------------------------------------------------- 3, 4, 8: models

def test_training_rows_of_repeated_ids(spark):
    """Two texts under one labelled id are two training rows, equal texts one, repeated rows one."""
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    a, b, c, d = ids[:4]
    docs = spark.createDataFrame([(a, "x one"), (a, "y two"), (b, "x one"), (c, "z"), (c, "z"), (d, None), (d, None)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in (a, b, c, d)], "doc_id long, toxic int")
    got = Counter((r["text"], r["label"]) for r in toxicity._training_rows(docs, labels).collect())
    assert got == Counter([("x one", 1), ("y two", 1), ("z", 1), (None, 1)])


def test_word_counts_do_not_depend_on_the_flush(spark, monkeypatch):
    texts = [(f"w{i % 7} w{i % 11} common w{i}", i % 2) for i in range(200)]
    frame = spark.createDataFrame(texts, "text string, label int").repartition(3)
    found = []
    for flush in (1, 5, 50_000):
        monkeypatch.setattr(toxicity, "FLUSH", flush)
        found.append(toxicity._word_scores(frame))
    want = Counter(w for t, y in texts if not y for w in set(t.split()))
    assert found[0] == found[1] == found[2] and found[0][2] == sum(want.values())
    assert all(want[w] == n for w, n in found[0][1].items())


def brute_segments(v):
    """Maximal scoring segments by their definition: the best one, then left and right of it."""
    out = []

    def best(a, b):
        total = np.concatenate([[0], np.cumsum(v[a:b])])
        top = max(((total[j] - total[i], -i, -j) for i in range(len(total)) for j in range(i + 1, len(total))),
                  default=(0, 0, 0))
        if top[0] > 1e-12:
            i, j = a - top[1], a - top[2]
            out.append((i, j, round(float(top[0]), 6)))
            best(a, i)
            best(j, b)

    best(0, len(v))
    return sorted(out)


@pytest.mark.parametrize("seed", range(30))
def test_segments(seed):
    rng = random.Random(seed)
    v = [rng.choice([-3, -1, -0.5, 2, 1.3, 0.7]) + rng.random() * 0.01 for _ in range(rng.randint(0, 30))]
    assert sorted((a, b, round(s, 6)) for a, b, s in toxicity.segments(v)) == brute_segments(v)


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(1)
    plain = [f"word{i}" for i in range(200)]
    data = []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            at = rng.randint(0, len(w))
            w[at:at] = rng.choices(["Vile!", "rotten,", "scoundrel"], k=3)
        data.append((i, " ".join(w), int(toxic)))
    return data


def test_toxicity_held_out(spark, insults):
    docs = spark.createDataFrame([(i, t) for i, t, _ in insults], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y in insults], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, lab).collect()}
    assert len(got) == len(insults)
    for i, text, y in insults:
        assert got[i]["held_out"] == (crc(i) % 5 == 0)
        assert got[i]["predicted"] == y and 0 <= got[i]["score"] <= 1
        if y:
            p = got[i]["passages"][0]
            assert any(w in ("vile", "rotten", "scoundrel") for w in toxicity.tokens(text)[p["first"]:p["end"]])


def test_toxicity_ignores_held_out_labels(spark, insults):
    docs = spark.createDataFrame([(i, t) for i, t, _ in insults], "doc_id long, text string")
    frames = [spark.createDataFrame([(i, (1 - y) if flip and crc(i) % 5 == 0 else y) for i, _, y in insults],
                                    "doc_id long, toxic int") for flip in (False, True)]
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, f).collect()} for f in frames)
    assert a == b


@pytest.mark.parametrize("times", [1, 10])
def test_toxic_words_without_clean_texts_are_kept_at_every_size(spark, times):
    rng = random.Random(times)
    data = [(" ".join(f"plain{rng.randint(0, 300)}" for _ in range(30)) + (" vile" if i < 6 else ""), int(i < 60 * times))
            for i in range(600 * times)]
    found, _, _ = toxicity._word_scores(spark.createDataFrame(data, "text string, label int").repartition(4))
    assert found["vile"] > 1 and len(found) < 10


def test_toxicity_edge_rows(spark, docs, none, rows, labels):
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert toxicity.toxicity(none, labels).count() == 0
    unlabelled = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {r["score"] for r in unlabelled} == {0.0}
    kept = toxicity.keep_clean(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_language_id(spark, docs, rows, none):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    right = total = 0
    for r in rows:
        p = got[r[0]]
        if r[0] is not None:
            assert p["held_out"] == (crc(r[0]) % 3 == 1)
        if not r[1] or not re.search(r"[^\W\d_]", r[1]):
            assert (p["lang_pred"], p["score"]) == ("und", 0.0)
        elif r[0] is not None and r[0] < 60 and p["held_out"]:
            total += 1
            right += p["lang_pred"] == r[2]
        assert 0 <= p["score"] <= 1
    assert total > 10 and right / total >= 0.9
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} \
        == {"und"}


def test_forward_sums_all_segmentations():
    vocab = tokens.default_vocab()
    known = {p: i for i, p in enumerate(tokens.pieces(vocab)) if 0 < len(p) <= langid.CHUNK}
    p = np.random.default_rng(2).random((len(tokens.pieces(vocab)), 2))
    p /= p.sum(axis=0)

    def total(c):
        return 1.0 if not c else sum(p[known[c[:k]], 0] * total(c[k:]) for k in range(1, len(c) + 1) if c[:k] in known)

    chunks = [b" the", b" ing", b"zq", b" h\xc3\xa4us"]
    got = langid.log_probabilities(chunks, langid.PieceTable(vocab), p)
    assert np.allclose(np.exp(got[:, 0]), [total(c) for c in chunks])


LONG_WORDS = [" internationalizationcommunications", " " + "x" * 60, " " + "日本語の文章には空白がありません" * 4,
              " https://example.com/a/very/long/path?with=parameters&and=more#fragment", " " + "straßenbahnhaltestelle" * 9,
              " ================================================================ah"]


@pytest.mark.parametrize("word", LONG_WORDS)
def test_long_words_sum_all_segmentations(word):
    """Forward sums and expected counts of words of 30 to 200 bytes against plain sums in exact fractions."""
    from fractions import Fraction
    vocab = tokens.default_vocab()
    listed = tokens.pieces(vocab)
    known = {p: i for i, p in enumerate(listed) if p}
    longest, data = max(map(len, known)), word.encode()
    p = np.random.default_rng(4).random((len(listed), 2)) * 1e-4 + 1e-9
    n = len(data)
    edges = [(i, j, known[data[i:j]]) for i in range(n) for j in range(i + 1, min(n, i + longest) + 1) if data[i:j] in known]
    into = defaultdict(list)
    for i, j, piece in edges:
        into[j].append((i, piece))
    table = langid.PieceTable(vocab)
    got = langid.log_probabilities([data], table, p)[0]
    for lang in (0, 1):
        forward = [Fraction(1)] + [Fraction(0)] * n
        for j in range(1, n + 1):
            forward[j] = sum((forward[i] * Fraction(float(p[piece, lang])) for i, piece in into[j]), Fraction(0))
        f = forward[n]
        want = math.log(f.numerator >> max(0, f.numerator.bit_length() - 900)) + max(0, f.numerator.bit_length() - 900) \
            * math.log(2) - (math.log(f.denominator >> max(0, f.denominator.bit_length() - 900))
                             + max(0, f.denominator.bit_length() - 900) * math.log(2))
        assert got[lang] == pytest.approx(want, rel=1e-9)
    # expected counts with equally likely pieces
    q = Fraction(1, table.size)
    forward, backward = [Fraction(1)] + [Fraction(0)] * n, [Fraction(0)] * n + [Fraction(1)]
    for i, j, _ in edges:
        forward[j] += forward[i] * q
    for i, j, _ in reversed(edges):
        backward[i] += backward[j] * q
    want = np.zeros(table.size)
    for i, j, piece in edges:
        want[piece] += float(3 * forward[i] * q * backward[j] / forward[n])
    assert np.allclose(langid.expected_counts({data: 3}, table), want, rtol=1e-9, atol=1e-15)


def test_expected_counts_of_short_words():
    vocab = tokens.default_vocab()
    known = {p: i for i, p in enumerate(tokens.pieces(vocab)) if p}
    table = langid.PieceTable(vocab)
    q, want, weights = 1.0 / table.size, np.zeros(table.size), {b" the": 2, b" ing": 1, b" h\xc3\xa4us": 5}

    def paths(c):
        return [[]] if not c else [[c[:k], *r] for k in range(1, len(c) + 1) if c[:k] in known for r in paths(c[k:])]

    for word, n in weights.items():
        found = paths(word)
        mass = sum(q ** len(s) for s in found)
        for s in found:
            for piece in s:
                want[known[piece]] += n * q ** len(s) / mass
    assert np.allclose(langid.expected_counts(weights, table), want)


def test_lm_scores(spark, docs, rows, labels, none, library):
    got = lm_scoring.lm_scores(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r["score"] - (r["background_loss"] - r["target_loss"])) < 1e-9
        if r["n_tokens"] == 0:
            assert (r["target_loss"], r["background_loss"]) == (0.0, 0.0)
    # counts are those of the texts themselves
    total = lm_scoring.counts(docs, labels, tokens.default_vocab())
    want = Counter(i for r in rows for i in ids_of(library, r[1]))
    assert {i: n for i, n in enumerate(total[0].tolist()) if n} == dict(want)
    good = Counter(i for r in rows if r[0] is not None and (r[0] % 2 == 1 or r[0] == 5) for i in ids_of(library, r[1]))
    assert {i: n for i, n in enumerate(total[1].tolist()) if n} == dict(good)
    assert lm_scoring.lm_scores(none, labels).count() == 0


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_lm_losses_follow_exact_pair_counts(spark, docs, rows, labels, library, monkeypatch, block):
    monkeypatch.setattr(lm_scoring, "BLOCK", block, raising=False)  # 300: many blocks
    size = len(tokens.pieces(tokens.default_vocab()))
    data = [(r[0], ids_of(library, r[1]), r[0] is not None and (r[0] % 2 == 1 or r[0] == 5)) for r in rows]
    pair, context, single = ([Counter(), Counter()] for _ in range(3))
    for _, ids, good in data:
        for row in (0, 1) if good else (0,):
            pair[row].update(zip([None, *ids], ids))
            context[row].update([None, *ids][:len(ids)])
            single[row].update(ids)
    n = [sum(c.values()) for c in single]
    scale = [n[1] / n[0], 1.0]
    prior = {i: (k + 1) / (n[0] + size) for i, k in single[0].items()}
    want = defaultdict(list)
    for doc_id, ids, good in data:
        own = Counter(zip([None, *ids], ids)) if good else Counter()     # a target text is scored without its own counts
        before = Counter([None, *ids][:len(ids)]) if good else Counter()
        p = [[(scale[row] * (pair[row][a, b] - row * own[a, b]) + lm_scoring.STRENGTH * prior[b])
              / (scale[row] * (context[row][a] - row * before[a]) + lm_scoring.STRENGTH)
              for a, b in zip([None, *ids], ids)] for row in (0, 1)]
        assert all(0 < x < 1 for row in p for x in row)
        background, target = (-np.log(x).mean() if x else 0.0 for x in p)
        want[doc_id].append((len(ids), target, background))
    got = defaultdict(list)
    for r in lm_scoring.lm_scores(docs, labels).collect():
        got[r["doc_id"]].append((r["n_tokens"], r["target_loss"], r["background_loss"]))
    assert got.keys() == want.keys()
    for doc_id in want:
        assert np.allclose(sorted(got[doc_id]), sorted(want[doc_id]), rtol=1e-9)


# ---------------------------------------------------------------- 5, 6, 9, 10

def brute_rule(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0] if rest[len(host):].startswith("/") else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("limit", [100_000, 0])
def test_url_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST_RULES", limit)  # 0: the salted shuffle
    rules = [*urls.RULES, ("b.example.com", "/en/x", "block"), ("org", "/a", "block"), ("org", "/a/b/", "allow"),
             ("deep.org", "/1/2/3/4", "block"), ("", "/", "block"), ("com", "", "block")]
    listed = [None, "", "no scheme", "http://", "http://Example.COM/en/1?q=/fr/", "https://www.example.com/en/",
              "https://www.example.com", "http://a.b.example.com/en/xyz", "http://net/es/", "http://x.net/fr#/es/",
              "http://xnet/es/", "ftp://q.org/abc", "ftp://q.org/a/b/c", "http://deep.org/1/2/3/45/6", "http://com/",
              "http://example.com?x", "http://..com/a", "a://b://c.net/es/", "http://ÄÖ.net/es/ü\nx", "://net/es/"]
    data = [(i, u, "host", "rule") for i, u in enumerate(listed)] + [(3, listed[4], "h", "r"), (4, listed[4], "h", "r")]
    pages = spark.createDataFrame(data, "page_id long, url string, host string, verdict string")
    got = Counter(tuple(r) for r in urls.judge_urls(pages, urls.rules_frame(spark, rules)).collect())
    assert got == Counter((i, *brute_rule(u, [r for r in rules if r[0]])) for i, u, *_ in data)
    assert urls.judge_urls(pages.limit(0), urls.rules_frame(spark)).count() == 0


def test_exact_dedup(spark, docs, rows, none):
    got = exact.dedup(spark, docs).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = Counter()
    for text, members in groups.items():
        keep = max((m for m in members if m is not None), default=None)
        for m in members:
            want[(m, keep, len(members), m == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want
    assert exact.dedup(spark, none).count() == 0
    kept = exact.keep_first(spark, docs)
    assert kept.columns == docs.columns
    assert Counter(r["text"] or "" for r in kept.collect()) == Counter(groups.keys())


def test_exact_index_persists(spark, docs, rows):
    index = exact.fresh_index(spark)
    first = docs.where("doc_id < 40")
    exact.dedup(spark, first, index).count()
    later = {r["doc_id"]: r for r in exact.dedup(spark, docs.where("doc_id is not null"), index).collect()}
    texts = {r[0]: r[1] or "" for r in rows}
    old = {}
    for r in rows:
        if r[0] is not None and r[0] < 40:
            old[r[1] or ""] = max(old.get(r[1] or "", -1), r[0])
    for doc_id, r in later.items():
        assert r["kept"] == (texts[doc_id] not in old and r["keep_id"] == doc_id)
        if texts[doc_id] in old:
            assert r["keep_id"] == old[texts[doc_id]]
    assert spark.table(index).count() == len({t for i, t in texts.items() if i is not None})
    spark.sql(f"DROP TABLE {index}")


def test_exact_counts_add_up_over_batches(spark):
    index, sizes = exact.fresh_index(spark), []
    for k, copies in enumerate((2, 3, 1)):
        batch = spark.createDataFrame([(10 * k + i, "same") for i in range(copies)] + [(10 * k + 9, f"new {k}")],
                                      "doc_id long, text string")
        got = exact.dedup(spark, batch, index).collect()
        sizes.append({r["group_size"] for r in got if r["doc_id"] % 10 < 9})
        assert {r["keep_id"] for r in got if r["doc_id"] % 10 < 9} == {1}
        assert {r["doc_id"] for r in got if r["kept"]} == ({1, 9} if not k else {10 * k + 9})
    assert sizes == [{2}, {5}, {6}]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact.dedup(spark, empty, index).count() == 0
    assert {r["n"] for r in exact.read_index(spark, index).collect()} == {6, 1}
    plan = exact.read_index(spark, index)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan                       # bucket to bucket
    exact.drop_index(spark, index)
    before = {t.name for t in spark.catalog.listTables()}
    exact.dedup(spark, empty).count()
    assert {t.name for t in spark.catalog.listTables()} == before  # a throwaway index leaves nothing


def brute_components(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(lower))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    comp = list(range(len(rows)))
    changed = True
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(comp[i], comp[j])
            changed |= comp[i] != comp[j]
            comp[i] = comp[j] = low
    smallest = {}
    for k, c in enumerate(comp):
        if rows[k][0] is not None:
            smallest[c] = min(smallest.get(c, rows[k][0]), rows[k][0])
    return Counter((r[0], len(sets[k]), smallest.get(comp[k]) if sets[k] else r[0]) for k, r in enumerate(rows))


def family(seed, n, families=6):
    """Near copies of a few texts, some chained, some only sharing a passage."""
    rng = random.Random(seed)
    out = []
    for f in range(families):
        words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 99)}" for _ in range(rng.randint(12, 80))]
        for _ in range(n):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
            if rng.random() < 0.3:
                w = w[rng.randint(0, 4):]
            out.append(" ".join(w))
            if rng.random() < 0.3:
                words = w  # the next ones derive from this one
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed,block", [(1, 500), (2, 7)])
def test_jaccard_components(spark, seed, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # 7: large groups are compared by blocks
    data = family(seed, 25)
    got = Counter(tuple(r) for r in jaccard.similar_components(
        spark, spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == brute_components(data)


def test_long_words_with_equal_polynomials_stay_apart(spark):
    """A word over a and b and its complement (each 1,024 letters) agree in every polynomial hash modulo 2 ** 64."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"one two {one} three four"), (2, f"one two {two} three four")],
                                 "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.similar_components(spark, docs).collect()} == {1: 1, 2: 2}
    assert jaccard.keep_one(spark, docs).count() == 2


def test_jaccard_leaves_the_tables_of_its_result_alone(spark, monkeypatch):
    written = []
    monkeypatch.setattr(shared, "scratch", lambda spark, name, make=shared.scratch: (written.append(make(spark, name)),
                                                                                    written[-1])[1])
    data = family(3, 12)
    found = jaccard.similar_components(spark, spark.createDataFrame(data, "doc_id long, text string"))
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in written if path_exists(spark, p)]
    assert sorted(left) == ["jaccard-components", "jaccard-features"] and len(written) > 8
    assert Counter(tuple(r) for r in found.collect()) == brute_components(data)


def test_jaccard_sql_equals_brute_force():
    data = family(1, 25) + [(900, "One TWO\tthree"), (901, "one two three"), (902, "\u00a0 x"), (903, " \n"), (904, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in data])
    assert Counter(con.execute(queries.JACCARD_SQL).fetchall()) == brute_components(data)


def test_jaccard_edge_rows(spark, docs, rows, none):
    assert Counter(tuple(r) for r in jaccard.similar_components(spark, docs).collect()) == brute_components(rows)
    assert jaccard.similar_components(spark, none).count() == 0


@pytest.mark.parametrize("block", [500, 7])
def test_jaccard_rows_without_id_link_and_bridge(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(9)

    def words(n):
        return [f"w{rng.randint(0, 10 ** 6)}" for _ in range(n)]

    a, b, c, d = words(100), words(60), words(60), words(60)
    # 0 and 1 share too little to link, the row without an id between them links to both; its copies are one class
    data = [(0, a), (None, a[8:] + words(8)), (None, b), (1, b[:-1] + words(1)), (None, c), (None, c[:-1] + words(1)),
            (None, d), (3, a[:5] + words(80))]
    left, right = words(10), words(10)
    data += [(10, left + a), (None, a + words(3)), (11, a + right), (None, d)]
    data = [(i, " ".join(w)) for i, w in data]
    # many near copies without an id, so that round 2 and blocks take part
    data += [(i if i is None or i % 3 else None, t) for i, t in family(5, 20, 3)]
    data = [(i if i is None or k < 12 else i + 100, t) for k, (i, t) in enumerate(data)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    want = brute_components(data)
    assert Counter(tuple(r) for r in jaccard.similar_components(spark, docs).collect()) == want
    component = {}
    for k, (doc_id, text) in enumerate(data):  # a marker id of its own tells the row's component
        marked = [(10 ** 6 if j == k else i, t) for j, (i, t) in enumerate(data)] if doc_id is None else data
        component[k] = next(x[2] for x in brute_components(marked) if x[0] == (10 ** 6 if doc_id is None else doc_id))
    stay = Counter(r for k, r in enumerate(data) if component[k] == (10 ** 6 if r[0] is None else r[0]))
    assert Counter(map(tuple, jaccard.keep_one(spark, docs).collect())) == stay


def test_count_tree_loses_no_pair():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 2 ** 64, n, dtype=np.uint64)) for n in rng.integers(1, 60, 300)]
    sets += [np.unique(np.concatenate([s[2:], rng.integers(0, 2 ** 64, 2, dtype=np.uint64)])) for s in sets if len(s) > 20]
    points = np.stack([jaccard._point(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = jaccard.CountTree(points, sizes)
    linked = 0
    for i, s in enumerate(sets):
        found = set(tree.search(points[i], len(s)).tolist())
        for j, t in enumerate(sets):
            if jaccard._links(s, t):
                linked += i != j
                assert j in found
        assert len(found) < len(sets) or len(s) < 5
    assert linked > 50


def test_finer_points_part_long_sets_and_lose_no_pair():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2 ** 64, n, dtype=np.uint64)) for n in (200, 900, 1000, 1023, 1024, 4000, 6000) * 3]
    sets += [np.unique(np.concatenate([s[len(s) // 8:], rng.integers(0, 2 ** 64, len(s) // 16, dtype=np.uint64)]))
             for s in sets]
    assert {len(jaccard._point(s)) for s in sets} == {256, 1024, 4096}
    assert all(jaccard._fold(p, 256).sum() == len(s) for s in sets for p in [jaccard._point(s)])
    points, sizes = [jaccard._point(s) for s in sets], np.array([len(s) for s in sets])
    tree = jaccard.CountTree(points, sizes)
    for i, s in enumerate(sets):
        found = set(tree.search(points[i], len(s)).tolist())
        linked = {j for j, t in enumerate(sets) if jaccard._links(s, t)}
        assert len(linked) == 2 and linked <= found
        assert found == linked or len(s) < 1024


def brute_quality(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for p in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered))


def brute_kept(rows):
    """Ids of the rows that pass the base rule and every fence, by exact quantiles."""
    passed = []
    for r in rows:
        m = brute_quality(r[1])
        if m[0] >= 10 and 100 * m[4] <= 20 * m[0]:
            passed.append((r[0], r[2], r[3], (m[2] / m[0], m[3] / m[0] * 10, m[4] / m[0], m[1] / m[0])))

    def rank(values, p):
        return sorted(values)[max(0, math.ceil(round(len(values) * p, 9)) - 1)]

    def fence(k, group, language):
        q1, q3 = rank(group, 0.25), rank(group, 0.75)
        lower = k == 3
        if q3 > q1:
            return q1 - quality.FENCE * (q3 - q1) if lower else -1, q3 + quality.FENCE * (q3 - q1)
        grid = [rank(language, i / 100) for i in range(1, 100)]
        far = sum(abs(q - grid[49]) for q in grid) / 99
        above = [v for v in group if v > 0]
        pool = above if len(above) >= quality.ENOUGH else [v for v in language if v > 0]
        least = q1 - quality.FENCE * far if lower else -1
        if pool and len(above) >= quality.RARE * len(group) and rank(pool, 0.75) > rank(pool, 0.25):
            return least, rank(pool, 0.75) + quality.FENCE * (rank(pool, 0.75) - rank(pool, 0.25))
        return least, q3 + quality.FENCE * far

    kept = set()
    for doc_id, lang, source, mine in passed:
        good = True
        for k in range(4):
            low, high = fence(k, [x[3][k] for x in passed if x[1:3] == (lang, source)],
                              [x[3][k] for x in passed if x[1] == lang])
            good &= low <= mine[k] <= high
        if good:
            kept.add(doc_id)
    return kept


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fences_of_rates_that_are_mostly_zero(spark, seed):
    """Groups with few, some and many texts above 0, one group alone in its language, NULL groups: against exact quantiles."""
    rng, rows = random.Random(seed), []
    for lang, source, n, share in (("en", "a", 60, 0.5), ("en", "b", 60, 0.02), ("en", "c", 12, 0.3), ("de", "a", 40, 0.0),
                                   ("de", None, 40, 0.9), (None, "x", 30, 0.2)):
        for _ in range(n):
            w = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 9))) + str(rng.randint(0, 999))
                 for _ in range(rng.randint(40, 90))]
            text = " ".join(w)
            if rng.random() < share:
                text += " " + "#" * rng.choice([1, 2, 3, 4, 60])
            if rng.random() < share / 2:
                text += "\none line\none line" + "\none line" * rng.choice([0, 0, 0, 9])
            rows.append((len(rows), text, lang, source))
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    kept = {r["doc_id"] for r in got.collect() if r["kept"]}
    assert kept == brute_kept(rows) and 0 < len(kept) < len(rows)


def test_quality_measures_and_fences(spark, docs, rows, none):
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(rows)
    want = Counter()
    for r in rows:
        m = brute_quality(r[1])
        want[(r[0], *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    assert Counter(tuple(r)[:-1] for r in got) == want
    assert all(not (r["kept"] and r["base_failed"]) for r in got)
    kept = brute_kept(rows)
    assert {r["doc_id"] for r in got if r["kept"]} == kept
    assert quality.quality_rules(none).count() == 0
    frame = quality.keep_good(docs)
    assert frame.columns == docs.columns and {r["doc_id"] for r in frame.collect()} == kept


def test_quality_fences_follow_their_group(spark):
    rng = random.Random(4)

    def text(letters, marks=0, copies=0):
        w = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=letters)) for _ in range(100)]
        return " ".join([*w, *"#" * marks]) + "\nthe same line" * copies

    # source a has words of 5 letters and no marks, source b words of 9 and 10 to 20 marks
    data = [(i, text(5), "en", "a") for i in range(60)] + [(100 + i, text(9, 10 + i % 11), "en", "b") for i in range(60)]
    odd = [(200, text(30), "en", "a"), (201, text(30), "en", "b"),
           (203, text(5, 90), "en", "a"), (204, text(9, 20), "en", "b"), (205, text(5, 0, 4), "en", "a")]
    docs = spark.createDataFrame(data + odd, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs).collect()}
    assert all(got[r[0]] for r in data)
    assert {r[0]: got[r[0]] for r in odd} == {200: False, 201: False, 203: False, 204: True, 205: False}


def test_hot_groups_are_joined_whole(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(3000)], "key string, v int")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    got = shared.join_groups(rows, groups, "key", "n")
    assert got.count() == 3000 and got.where("top is null").count() == 0
