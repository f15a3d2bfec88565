"""Catalog I/O (sinks, append, fallback, optional tables) and run-log reports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dispute_engine.operators import runs
from dispute_engine.plans.pipeline import ensure_database
from dispute_engine.sources import io

DB = "dispute_engine_unit"


@pytest.fixture(scope="module")
def db(spark):
    return ensure_database(spark, DB)


def _events(spark, n=3):
    ts = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(f"d{i}", "CREATED", None, "OPEN", "system", "note", ts) for i in range(n)],
                                 io.EVENTS_SCHEMA)


def test_append_is_not_idempotent_by_default(spark, db):
    spark.sql(f"DROP TABLE IF EXISTS {db}.ev_plain")
    io.ensure_table(spark, db, "ev_plain", io.EVENTS_SCHEMA)
    io.append_events(_events(spark), db, "ev_plain")
    io.append_events(_events(spark), db, "ev_plain")
    assert spark.table(f"{db}.ev_plain").count() == 6


def test_idempotent_append(spark, db):
    spark.sql(f"DROP TABLE IF EXISTS {db}.ev_idem")
    io.ensure_table(spark, db, "ev_idem", io.EVENTS_SCHEMA)
    for _ in range(3):
        io.append_events(_events(spark), db, "ev_idem", idempotent=True)
    assert spark.table(f"{db}.ev_idem").count() == 3
    assert spark.table(f"{db}.ev_idem").schema == io.EVENTS_SCHEMA


def test_overwrite_replaces(spark, db):
    df = spark.range(5).withColumnRenamed("id", "x")
    io.write_table(df, db, "ow")
    io.write_table(df, db, "ow")
    assert spark.table(f"{db}.ow").count() == 5


def test_resolve_source_and_optional(spark, db):
    spark.sql(f"DROP TABLE IF EXISTS {db}.routed_x")
    io.write_table(spark.range(1), db, "scored_x")
    assert io.resolve_source(spark, db, ["routed_x", "scored_x"]) == f"{db}.scored_x"
    io.write_table(spark.range(1), db, "routed_x")
    assert io.resolve_source(spark, db, ["routed_x", "scored_x"]) == f"{db}.routed_x"
    assert io.optional_table(spark, db, "missing_table_x") is None
    with pytest.raises(ValueError):
        io.resolve_source(spark, db, ["missing_a", "missing_b"])


def test_require_columns_lists_sorted_missing(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match=r"\['a', 'b'\]"):
        io.require_columns(df, ["id", "b", "a"], "t")


def test_label_mapping_roundtrip(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("class_index,class_name\n0,A\n1,B\n")
    rows = io.load_label_mapping(spark, str(p)).collect()
    assert [(r.class_index, r.class_name) for r in rows] == [(0, "A"), (1, "B")]


def test_bucketed_write_avoids_shuffle_in_join(spark, db):
    a = spark.range(1000).withColumn("dispute_id", F.col("id").cast("string"))
    io.write_table(a, db, "bk_a", bucket_by=(4, ["dispute_id"]))
    io.write_table(a, db, "bk_b", bucket_by=(4, ["dispute_id"]))
    j = spark.table(f"{db}.bk_a").join(spark.table(f"{db}.bk_b"), "dispute_id", "left")
    with_conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = j._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_conf)
    assert "Exchange" not in plan


def _runs(spark):
    rows = [
        ("E0", "exp", "R1", "reason_classifier_lr_saga", "FINISHED", dt.datetime(2024, 1, 2, 0, 0, 0, 5), 0.5),
        ("E0", "exp", "R2", "reason_classifier_lr_saga", "FINISHED", dt.datetime(2024, 1, 3), None),
        ("E0", "exp", "R3", "reason_classifier_lr_saga", "FINISHED", None, 0.9),
        ("E1", "exp1", "R4", "other", "FAILED", dt.datetime(2024, 1, 4), 0.1),
    ]
    df = spark.createDataFrame(rows, "experiment_id string, experiment_name string, run_id string, run_name string, "
                                     "status string, start_time timestamp_ntz, f1_macro double")
    return runs.runs_from_flat(df.withColumn("params_json", F.lit('{"k": 1}')))


def test_run_metrics_latest(spark):
    out = runs.run_metrics(_runs(spark)).collect()
    assert len(out) == 1
    r = out[0]
    assert r.run_id == "R2" and r.f1_macro is None and r.roc_auc is None and r.avg_precision is None
    assert r.start_time_utc == "2024-01-03T00:00:00+00:00" and r.end_time_utc is None
    assert r.params == '{"k":"1"}' and r.tags == '{"mlflow.runName":"reason_classifier_lr_saga"}'


def test_iso_microseconds(spark):
    got = {r.run_id: r.s for r in _runs(spark).select("run_id", runs.iso_utc("start_time").alias("s")).collect()}
    assert got["R1"] == "2024-01-02T00:00:00.000005+00:00" and got["R3"] is None


def test_recent_runs_missing_start_last(spark):
    got = [r.run_id for r in runs.recent_runs(_runs(spark), k=2).where("experiment_id = 'E0'").collect()]
    assert sorted(got) == ["R1", "R2"]
    top = [r.run_id for r in runs.model_metrics(_runs(spark), k=5).collect()]
    assert top == ["R4", "R2", "R1", "R3"]


def test_run_name_from_tags(spark):
    df = spark.createDataFrame([({"mlflow.run_name": "x"},), ({"mlflow.runName": "y", "mlflow.run_name": "z"},)],
                               "tags map<string,string>")
    assert [r.n for r in df.select(runs.run_name_expr().alias("n")).collect()] == ["x", "y"]


def test_require_rows(spark):
    with pytest.raises(RuntimeError):
        io.require_rows(spark.range(0), "empty")


def test_artifact_texts(spark):
    from dispute_engine.operators import metrics
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "y string, p string")
    rep = metrics.classification_report(df, "y", "p").orderBy("class").collect()
    txt = runs.report_text([r for r in rep if r["class"] in ("a", "b")] +
                           [r for r in rep if r["class"] not in ("a", "b")])
    assert "precision" in txt and "\n\n    accuracy" in txt and txt.endswith("\n")
    cm = metrics.confusion(df, "y", "p", ["a", "b"]).collect()
    assert runs.confusion_csv(cm, ["a", "b"]) == ",a,b\na,1,1\nb,0,1\n"


def test_iso_from_epoch_millis_matches_python(spark):
    from datetime import datetime, timezone
    ms = [1704067207179, 1704067200000, 0, None]
    df = spark.createDataFrame([(m,) for m in ms], "ms long")
    got = [r.s for r in df.select(runs.iso_utc_from_millis("ms").alias("s")).collect()]
    want = [datetime.fromtimestamp(m / 1000, tz=timezone.utc).isoformat() if m is not None else None for m in ms]
    assert got == want


def test_the_duplicate_guard_never_broadcasts_the_log(spark, db, monkeypatch):
    frame, plans = type(spark.range(1)), []
    real = frame.join

    def join(self, other, *args, **kw):
        out = real(self, other, *args, **kw)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(frame, "join", join)
    for name in ("guarded", "guarded_keyed"):
        spark.sql(f"DROP TABLE IF EXISTS {db}.{name}")
    io.ensure_event_log(spark, db, "guarded")
    rows = spark.createDataFrame([("a", "CREATED", None, "OPEN", "s", "n", dt.datetime(2024, 1, 1))], io.EVENTS_SCHEMA)
    for _ in range(2):
        io.append_events(rows, db, "guarded", idempotent=True)
        io.append_keyed(rows, db, "guarded_keyed", ["dispute_id"])
    assert len(plans) >= 3 and not any("BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p for p in plans)
    assert io.read_events(spark, db, "guarded").count() == spark.table(f"{db}.guarded_keyed").count() == 1
