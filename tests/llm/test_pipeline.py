"""The corpus pipeline: run() and each stage against brute force, on rows with NULLs, copies, ties and clashing names."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from dispute_engine.llm import toxicity
from test_operators import brute_components, brute_kept, ids_of, raw
from dispute_engine.llm import tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string"
BAD = [f"schimpf{i}" for i in range(12)]


def make_docs():
    rng = random.Random(7)
    vocab = [f"{a}{b}" for a in ("the", "river", "stone", "green", "over", "hill") for b in range(60)]
    texts = []
    for i in range(220):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 60))]
        if i % 6 == 0:
            words[5:5] = [rng.choice(BAD) for _ in range(8)]
        texts.append(" ".join(words))
    texts += [texts[1]] * 5 + [texts[2] + " tail"] * 2 + ["too short", None, "", "again and again " * 30,
                                                         " ".join(texts[3].split()[:-1] + ["other"])]
    rows = [(i, t, "en", f"s{i % 2}", None, "r", "d") for i, t in enumerate(texts)]
    return rows + [(None, "a row without any id but with enough words to pass the rule of ten words", "en", None, 1, None, None),
                   rows[4], rows[4]]


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, int(any(w.startswith("schimpf") for w in r[1].split()))) for r in rows
              if r[0] is not None and r[1] and r[0] < 220]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def clean_rows(rows):
    return [r for r in rows if not (r[1] and any(w.startswith("schimpf") for w in r[1].split()))]


def after_exact(rows):
    best = {}
    for r in rows:
        k = r[1] or ""
        best[k] = max((best[k], r) if k in best else (r,), key=lambda x: -1 if x[0] is None else x[0])
    return list(best.values())


def after_near(rows):
    # the rows of one component hold one row: that of its smallest doc_id
    found = defaultdict(list)
    for doc_id, _, comp in brute_components(rows).elements():
        found[comp].append(doc_id)
    return [r for r in rows if r[0] is None or r[0] in found]


def test_stages_are_the_five_and_keep_the_columns(spark, folder, rows):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "exact_dedup", "jaccard_join", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert not Counter(map(tuple, out.collect())) - Counter(rows), name  # only rows of its input
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_toxicity_stage(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = Counter(map(tuple, corpus_pipeline.drop_toxic(spark, docs, folder).collect()))
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert any(model.scores[w] > 0 for w in BAD if w in model.scores)
    want = Counter(clean_rows(rows))
    assert kept == want


def test_quality_stage(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = Counter(map(tuple, corpus_pipeline.drop_low_quality(spark, docs, folder).collect()))
    ids = brute_kept(rows)
    assert kept == Counter(r for r in rows if r[0] in ids)


def test_exact_stage(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = Counter(map(tuple, corpus_pipeline.drop_exact_copies(spark, docs, folder).collect()))
    assert kept == Counter(after_exact(rows))


def test_near_stage(spark, folder, rows):
    single = after_exact(rows)
    docs = spark.createDataFrame(single, SCHEMA)
    kept = Counter(map(tuple, corpus_pipeline.drop_near_copies(spark, docs, folder).collect()))
    assert kept == Counter(after_near(single))


def test_whole_run(spark, folder, rows):
    left = clean_rows(rows)
    ids = brute_kept(left)
    left = after_near(after_exact([r for r in left if r[0] in ids]))
    library, want = tokens.library(tokens.default_vocab()), Counter()
    for r in left:
        every = [*ids_of(library, r[1]), 0]
        for start in range(0, len(every), 1024):
            part = raw(every[start:start + 1024])
            want[(r[0], start, len(part) // 4, zlib.crc32(part), len(every))] += 1
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    at = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 1024 and 20 < len(left) < len(rows)
