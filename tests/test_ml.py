"""Split, preprocessing statistics, metrics, training invariants, inference."""

import json
import statistics
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dispute_engine import config as C
from dispute_engine.operators import infer, logistic, metrics, ml, split
from dispute_engine.plans.pipeline import plan_for

SF = "/root/testdata/sf0.001"


def test_split_null_id_and_long_min(spark):
    df = spark.createDataFrame([(None,), ("D0000000001",)], "dispute_id string")
    got = [r.split for r in split.hash_split(df).collect()]
    assert got[0] == "TRAIN"  # xxhash64(NULL) is the seed 42
    # the guard itself: Long.MIN maps to bucket 0
    one = spark.range(1).select(F.lit(split.LONG_MIN).alias("h"))
    b = one.select((F.when(F.col("h") == F.lit(split.LONG_MIN), F.lit(0)).otherwise(F.abs("h")) % 100).alias("b"))
    assert b.first().b == 0


def test_split_matches_abs_mod_not_pmod(spark):
    df = spark.range(2000).select(F.format_string("D%010d", "id").alias("dispute_id"))
    s = split.hash_split(df).withColumn("h", F.xxhash64("dispute_id"))
    neg = s.where("h < 0").collect()
    assert neg, "expected negative hashes"
    for r in neg[:50]:
        assert r.split == ("TRAIN" if abs(r.h) % 100 < 80 else "TEST")


def test_md5_split_is_deterministic(spark):
    df = spark.range(500).select(F.format_string("D%010d", "id").alias("dispute_id"))
    a = split.hash_split(df, algo="md5").collect()
    b = split.hash_split(df, algo="md5").collect()
    assert a == b and 300 < sum(r.split == "TRAIN" for r in a) < 500


def test_exact_median_and_mode(spark):
    vals = [1.0, 2.0, 4.0, 10.0, None]
    df = spark.createDataFrame([(v, c) for v, c in zip(vals, ["b", "a", "b", "a", None])], "x double, c string")
    med = ml.fit_median(df, ["x"]).first()
    assert med.median == statistics.median([v for v in vals if v is not None])
    mode = ml.fit_mode(df, ["c"]).first()
    assert mode.mode == "a"  # tie 2-2, smallest wins


def test_scaler_population_std(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    r = ml.fit_scaler(df, ["x"], {"x": 2.0}).first()
    assert r.mean == pytest.approx(2.0) and r.std == pytest.approx(statistics.pstdev([1.0, 3.0, 2.0]))


def test_label_mapping_and_weights(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("c",), (None,)], "y string")
    m = [(r.class_index, r.class_name) for r in ml.label_mapping(df, "y").orderBy("class_index").collect()]
    assert m == [(0, "a"), (1, "b"), (2, "c")]
    w = {r.class_name: r.weight for r in ml.class_weights(df, "y").collect()}
    assert w["a"] == pytest.approx(4 / (3 * 2)) and w["b"] == pytest.approx(4 / 3)
    dec = ml.decode_labels(spark.createDataFrame([(0,), (7,)], "i int"), ml.label_mapping(df, "y"), "i", "name")
    assert sorted(r.name for r in dec.collect()) == ["UNKNOWN", "a"]


def test_classification_report_by_hand(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("a", "a")]
    df = spark.createDataFrame(pairs, "y string, p string")
    rep = {r["class"]: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert rep["a"].precision == 1.0 and rep["a"].recall == pytest.approx(2 / 3)
    assert rep["b"].precision == pytest.approx(1 / 3) and rep["b"].recall == 1.0
    assert rep["c"].f1_score == 0.0 and rep["c"].support == 1  # zero division -> 0
    assert rep["accuracy"].f1_score == pytest.approx(3 / 5) and rep["accuracy"].precision is None
    f1s = [rep[c].f1_score for c in "abc"]
    assert rep["macro avg"].f1_score == pytest.approx(sum(f1s) / 3)
    assert metrics.f1_macro(df, "y", "p").first().f1_macro == pytest.approx(sum(f1s) / 3)
    cm = {r.true_label: r for r in metrics.confusion(df, "y", "p", ["a", "b", "c", "d"]).collect()}
    assert (cm["a"].a, cm["a"].b, cm["c"].b, cm["d"].a) == (2, 1, 1, 0)  # unseen label row zero-filled


@pytest.fixture(scope="module")
def small_train(spark):
    p = plan_for(spark, SF)
    s = split.hash_split(p.gold_v2)
    return split.take_split(s, "TRAIN").cache(), split.take_split(s, "TEST")


def test_lr_invariants(spark, small_train):
    train, test = small_train
    model = ml.train_lr(train, C.SPEC_V2, C.LR_BALANCED)
    labels = ml.model_labels(model)
    assert labels == sorted(labels)
    out = ml.predict(model, test.select("dispute_id", *C.SPEC_V2.features), "pred", "conf")
    rows = out.select("pred", "conf", vector_to_array("probability").alias("p")).collect()
    assert rows and all(abs(sum(r.p) - 1.0) < 1e-9 for r in rows)
    assert {r.pred for r in rows} <= set(labels)
    assert all(0 < r.conf <= 1 for r in rows)


def test_boosted_small_invariants(spark, small_train):
    train, test = small_train
    model = ml.train_boosted(train, C.SPEC_V2, C.BoostedParams(n_estimators=3, max_depth=3))
    out = ml.predict(model, test.select("dispute_id", *C.SPEC_V2.features), "pred", "conf").collect()
    labels = set(ml.model_labels(model))
    assert {r.pred for r in out} <= labels
    assert all(1 / len(labels) - 1e-9 <= r.conf <= 1 for r in out)


def test_unseen_category_is_all_zeros(spark, small_train):
    train, _ = small_train
    prep = ml.fit_prep(train, C.SPEC_V2, scale=False)
    from pyspark.ml import Pipeline
    model = Pipeline(stages=ml.feature_stages(C.SPEC_V2, prep)[:3]).fit(train)
    row = train.limit(1).withColumn("payer", F.lit("NEVER SEEN"))
    v = model.transform(row).select(vector_to_array("_o_payer").alias("v")).first().v
    assert sum(v) == 0.0


def test_batch_infer_null_prompt(spark):
    df = spark.createDataFrame([("a", "- priority: P1\n- predicted_reason: X\nEvidence:\ne\n\nRules:"),
                                ("b", None)], "dispute_id string, llm_prompt string")
    out = {r.dispute_id: r.llm_response for r in
           infer.batch_infer(df, "llm_prompt", infer.field_echo_model, batch_size=1, keep=["dispute_id"]).collect()}
    assert out["b"] is None and json.loads(out["a"])["risk_level"] == "high"


def test_exact_median_refinement_matches_numpy(spark):
    import random

    import numpy as np
    rnd = random.Random(7)
    xs = [rnd.lognormvariate(3, 2) for _ in range(3001)] + [None, float("nan")]
    ys = [float(rnd.randint(0, 5)) for _ in range(3003)]
    zs = [1e300, -1e-300] + [rnd.random() for _ in range(3000)] + [0.5]
    df = spark.createDataFrame(list(zip(xs, ys, zs)), "x double, y double, z double")
    got = {r.feature: r.median for r in ml.fit_median(df, ["x", "y", "z"], bins=8).collect()}
    for c, v in (("x", xs), ("y", ys), ("z", zs)):
        clean = [a for a in v if a is not None and a == a]
        assert got[c] == float(np.median(clean)), c
    approx = {r.feature: r.median for r in ml.fit_median(df, ["y"], exact=False).collect()}
    assert approx["y"] in set(ys)


def test_respond_computes_its_rows_once_and_keeps_them(spark):
    from dispute_engine.operators import infer
    from dispute_engine.plans.pipeline import ensure_database
    db, seen = ensure_database(spark, "dispute_engine_unit"), spark.sparkContext.accumulator(0)

    def touched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(f"d{i}", f"- priority: P{i % 3}\n") for i in range(40)] + [("d0", "- priority: P0\n"), (None, "x"), ("n", None)]
    spark.sql(f"DROP TABLE IF EXISTS {db}.once")
    src = spark.createDataFrame(rows, "id string, prompt string").mapInArrow(touched, "id string, prompt string")
    got = infer.respond(src, "prompt", infer.field_echo_model, db, "once", "echo", keep=["id"]).collect()
    assert seen.value == len(rows)
    answers = {p: infer.field_echo_model()([p])[0] for _, p in rows if p is not None}
    assert sorted(map(str, got)) == sorted(str(type(got[0])(id=k, llm_response=answers.get(p))) for k, p in rows)
    assert spark.table(f"{db}.once").count() == 4


def test_lr_reaches_the_optimum_of_raw_features_in_few_passes(spark, monkeypatch):
    """Columns of very different scale, two of them nearly equal: plain L-BFGS needs hundreds of passes here."""
    rng = np.random.default_rng(3)
    n = 400
    big = rng.gamma(2.0, 20_000.0, n)
    data = [(f"i{i}", float(b), float(b + rng.standard_normal()), float(i % 2), "abc"[i % 3],
             "xyz"[int(b > 40_000) + int(rng.random() < 0.2)]) for i, b in enumerate(big)]
    train = spark.createDataFrame(data, "id string, u double, v double, f double, c string, y string")
    passes, whole = [], logistic.Loss.__call__
    monkeypatch.setattr(logistic.Loss, "__call__", lambda self, *a: passes.append(1) or whole(self, *a))
    spec, params = C.FeatureSpec(("u", "v", "f"), ("c",), "y", "id"), C.LRParams(max_iter=2000, tol=1e-6)
    model = ml.train_lr(train, spec, params)
    at_fit, at_zero = ml.lr_gradient(model, train, spec, params)
    assert at_fit <= 0.01 * at_zero and len(passes) <= 60
    unseen = ml.predict(model, train.limit(3).withColumn("c", F.lit("new")), "pred", "conf").select("conf").collect()
    assert all(0 < r.conf <= 1 for r in unseen)


def test_packed_columns_come_back_exactly():
    shape = logistic.Shape(3, [300], 2, np.zeros(3), np.ones(3))
    rows = [np.array([0.1, -2.5, 1e300]), np.array([1.0, 0.0, -3.0]), np.array([0.5, 7.0, 70_000.0])]
    codes, y, w = np.array([0.0, 299.0, 300.0]), np.array([0.0, 1.0, 1.0]), np.array([0.1, 1.0, 2.0])
    batch = pa.RecordBatch.from_arrays([pa.array(v) for v in (*rows, codes, y, w)], list("abcdef"))
    record = next(logistic._pack(shape)([batch]))
    x, classes, weights = next(logistic._chunks(shape, 3, memoryview(record.column(1)[0].as_buffer())))
    assert (x[:3] == np.stack(rows)).all() and (x[-1] == 1).all()
    assert x[3].tolist() == [1, 0, 0] and x[302].tolist() == [0, 1, 0] and x[3:303, 2].sum() == 0  # unseen: zeros
    assert classes.tolist() == [0, 1, 1] and (weights == w).all()


def test_task_sums_add_up_the_same_on_the_driver_and_by_spark(spark, monkeypatch):
    rng = np.random.default_rng(8)
    shape = logistic.Shape(2, [3], 3, np.zeros(2), np.ones(2))
    blocks = []
    for _ in range(5):
        columns = [*rng.standard_normal((2, 40)), rng.integers(0, 4, 40).astype(float), rng.integers(0, 3, 40).astype(float),
                   rng.random(40)]
        batch = pa.RecordBatch.from_arrays([pa.array(v) for v in columns], list("abcde"))
        record = next(logistic._pack(shape)([batch]))
        blocks.append((40, record.column(1)[0].as_py()))
    loss = logistic.Loss(spark.sparkContext.parallelize(blocks, 4), shape, 0.1)
    theta = rng.standard_normal((3, shape.width))
    plain, scaled = loss(theta), loss(theta, True)
    monkeypatch.setattr(logistic, "HELD", 0)
    for a, b in ((plain, loss(theta)), (scaled, loss(theta, True))):
        assert a[0] == pytest.approx(b[0]) and np.allclose(a[1], b[1]) and (a[2] is None) == (b[2] is None)
    assert np.allclose(scaled[2], loss(theta, True)[2])


def test_a_bracket_of_one_value_is_the_median_without_another_pass(spark, monkeypatch):
    rows = [(float(i % 4 == 0), 7, None if i % 5 else float(i), -0.0) for i in range(101)]
    df = spark.createDataFrame(rows, "flag double, same int, few double, zero double")
    seen, plain = [], ml._middle
    monkeypatch.setattr(ml, "_middle", lambda counted, first, ranges, *a: seen.extend(ranges) or plain(counted, first, ranges, *a))
    got = ml.exact_medians(df, df.columns, accuracy=50)
    assert got == {"flag": 0.0, "same": 7.0, "few": statistics.median(range(0, 101, 5)), "zero": 0.0}
    assert seen == ["c2"]
    assert ml.exact_medians(df, ["same"]) == {"same": 7.0} and ml.exact_medians(df.where("false"), ["same"]) == {}


def test_optimum_certificate_hands_its_rows_to_the_fits(spark, monkeypatch):
    """TRAIN is computed once for the fits of the same labels and their certificates."""
    from dispute_engine.plans import catalog_ml
    split_calls, fitted, fit, splits = [], [], catalog_ml._fit, catalog_ml._splits
    monkeypatch.setattr(catalog_ml, "_MODELS", {})
    monkeypatch.setattr(catalog_ml, "_fingerprint", lambda *a, once=uuid.uuid4().hex: once)  # no saved model
    monkeypatch.setattr(catalog_ml, "_splits", lambda *a, **k: split_calls.append(k) or splits(*a, **k))
    monkeypatch.setattr(catalog_ml, "_fit", lambda s, d, name, path, train=None: (
        fitted.append((name, train is not None and train.storageLevel.useMemory)), fit(s, d, name, path, train))[1])
    got = {r["model"]: r["optimal"] for r in catalog_ml._train_lr_optimum(spark, SF).collect()}
    assert got == {"lr_v1": True, "lr_balanced": True, "lr_collapsed": True}
    assert len(split_calls) == 2 and fitted == [(n, True) for n in ("lr_v1", "lr_balanced", "lr_collapsed")]
