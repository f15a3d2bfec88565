"""Split tables, the event log by date, keyed appends, responses by digest, heavy keys, optimality certificate."""

import datetime as dt
import re
import uuid

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dispute_engine import config as C
from dispute_engine.functions import joins
from dispute_engine.operators import infer, ml, runs, split
from dispute_engine.plans.pipeline import ensure_database, plan_for
from dispute_engine.sources import io

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db(spark):
    return ensure_database(spark, "dispute_tables_test")


def unique(name):
    return f"{name}_{uuid.uuid4().hex[:8]}"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_train_and_test_read_one_partition_each(spark, db):
    names = [unique(n) for n in ("split", "train", "test")]
    rows = spark.range(500).select(F.format_string("D%010d", "id").alias("dispute_id"), F.col("id").alias("v"))
    whole, train, test = split.write_split_tables(rows, db, *names)
    want = {r["dispute_id"]: r["split"] for r in split.hash_split(rows).collect()}
    assert {r["dispute_id"] for r in train.collect()} == {k for k, s in want.items() if s == "TRAIN"}
    assert {r["dispute_id"] for r in test.collect()} == {k for k, s in want.items() if s == "TEST"}
    assert whole.count() == 500
    for side, frame in (("TRAIN", train), ("TEST", test)):
        assert f"PartitionFilters: [isnotnull(split" in plan_of(frame) and f"= {side})]" in plan_of(frame)
        assert len(frame.inputFiles()) == len(whole.where(f"split = '{side}'").inputFiles()) < len(whole.inputFiles())


def events(spark, rows):
    data = [(i, "CREATED", None, "NEW", "system", "n", t) for i, t in rows]
    return spark.createDataFrame(data, io.EVENTS_SCHEMA)


def test_event_guard_reads_only_the_dates_of_the_batch(spark, db):
    name = unique("events")
    io.ensure_event_log(spark, db, name)
    days = [dt.datetime(2024, 1, d, 10) for d in range(1, 11)]
    io.append_events(events(spark, [(f"a{d.day}", d) for d in days] + [("none", None)]), db, name, idempotent=True)
    batch = events(spark, [("a3", days[2]), ("new", days[2])])
    pruned = io.logged_on_dates_of(batch, spark.table(io.qualified(db, name)))
    assert len(pruned.inputFiles()) < len(spark.table(io.qualified(db, name)).inputFiles())
    assert re.search(r"PartitionFilters: \[[^]]*event_date", plan_of(pruned))
    io.append_events(batch, db, name, idempotent=True)
    io.append_events(batch, db, name, idempotent=True)
    log = io.read_events(spark, db, name)
    assert log.columns == [f.name for f in io.EVENTS_SCHEMA.fields] and log.count() == 12
    io.append_events(batch, db, name)  # a plain append still duplicates
    assert io.read_events(spark, db, name).count() == 14


def test_keyed_append_is_safe_to_repeat(spark, db):
    name = unique("runs")
    first = spark.createDataFrame([("r1", 1), ("r1", 1), ("r2", 2), (None, 3)], "run_id string, v int")
    assert io.append_keyed(first, db, name, ["run_id"]) == 3
    assert io.append_keyed(first, db, name, ["run_id"]) == 0
    assert io.append_keyed(spark.createDataFrame([("r2", 9), ("r3", 4)], "run_id string, v int"), db, name, ["run_id"]) == 1
    got = sorted((str(r["run_id"]), r["v"]) for r in io.read_table(spark, db, name).collect())
    assert got == [("None", 3), ("r1", 1), ("r2", 2), ("r3", 4)]
    assert not [t for t in spark.catalog.listTables(db) if "_stage_" in t.name]


def counting_model(calls, fail_on=None):
    def factory():
        def answer(prompts):
            out = []
            for p in prompts:
                if fail_on is not None and fail_on in p:
                    raise RuntimeError("model down")
                calls.add(1)
                out.append(None if p == "silent" else p.upper())
            return out
        return answer
    return factory


def test_only_unseen_prompts_reach_the_model(spark, db):
    name, calls = unique("responses"), spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "silent"), (6, "")], "id int, p string")
    got = infer.respond(df, "p", counting_model(calls), db, name, "m", keep=["id"])
    assert {r["id"]: r["llm_response"] for r in got.collect()} == {1: "A", 2: "B", 3: "A", 4: None, 5: None, 6: ""}
    assert calls.value == 4  # distinct prompts
    infer.respond(df, "p", counting_model(calls), db, name, "m").count()
    assert calls.value == 4  # a rerun sends none
    infer.respond(df.where("id = 1"), "p", counting_model(calls), db, name, "another model").count()
    assert calls.value == 5


def test_finished_waves_survive_a_failure(spark, db):
    name, calls = unique("responses"), spark.sparkContext.accumulator(0)
    df = spark.range(60).select("id", F.concat(F.lit("prompt "), "id").alias("p"))
    with pytest.raises(Exception, match="model down"):
        infer.respond(df, "p", counting_model(calls, "prompt 17"), db, name, "m", waves=6)
    kept = io.read_table(spark, db, name).count()
    calls = spark.sparkContext.accumulator(0)
    got = infer.respond(df, "p", counting_model(calls), db, name, "m", waves=6)
    assert got.where("llm_response = upper(p)").count() == 60
    assert calls.value == 60 - kept and io.read_table(spark, db, name).count() == 60


def test_heavy_keys_are_found_salted_and_joined_whole(spark):
    left = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "HOT").when(F.col("id") % 10 == 1, F.lit(None)).otherwise(
            F.concat(F.lit("k"), (F.col("id") % 2000).cast("string"))).alias("payer"),
        F.lit("p").alias("program"), F.col("id").cast("string").alias("dispute_id"))
    rules = left.select("payer", "program").distinct().where("payer IS NOT NULL").withColumn("days", F.length("payer")) \
                .union(spark.createDataFrame([("HOT", "p", 99)], "payer string, program string, days int"))
    heavy = joins.heavy_keys(left, ["payer", "program"])
    assert heavy == [spark.range(1).select(F.xxhash64(F.lit("HOT"), F.lit("p"))).first()[0]]
    got = joins.lookup_join(left, rules, ["payer", "program"], max_bytes=0)
    assert got.columns == ["payer", "program", "dispute_id", "days"]
    want = left.join(rules, ["payer", "program"], "left").select(got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0  # the duplicate rule fans out alike
    parts = left.withColumn("s", F.pmod(F.xxhash64("dispute_id", F.lit("salt")), F.lit(joins.SALTS))) \
                .where("payer = 'HOT'").groupBy("s").count().agg(F.count("*"), F.max("count")).first()
    assert parts[0] == joins.SALTS and parts[1] < 2 * 10_000 / joins.SALTS  # dealt evenly
    assert joins.heavy_keys(left.limit(0), ["payer"]) == []


def test_certificate_equals_a_numerical_gradient(spark):
    rng = np.random.default_rng(1)
    data = [(f"i{i}", float(x), "ab"[i % 2], "xyz"[int(abs(x) * 2) % 3]) for i, x in enumerate(rng.standard_normal(120))]
    train = spark.createDataFrame(data, "id string, v double, c string, y string")
    spec, params = C.FeatureSpec(("v",), ("c",), "y", "id"), C.LRParams(max_iter=300, scale=True, balanced=True, tol=1e-9)
    model = ml.train_lr(train, spec, params)
    at_fit, at_zero = ml.lr_gradient(model, train, spec, params)
    assert at_fit < 1e-5 < at_zero
    lr, n = model.stages[-1], train.count()
    rows = model.transform(ml.with_balanced_weights(train, "y")).select(vector_to_array("features"), "label", "weight").collect()
    x, y, w = np.array([r[0] for r in rows]), np.array([int(r[1]) for r in rows]), np.array([r[2] for r in rows])
    shape = lr.coefficientMatrix.toArray().shape

    def loss(theta):
        m, b = theta[:-shape[0]].reshape(shape), theta[-shape[0]:]
        z = x @ m.T + b
        z = z - z.max(axis=1, keepdims=True)
        return (w * (np.log(np.exp(z).sum(axis=1)) - z[np.arange(n), y])).sum() / w.sum() + (m ** 2).sum() / (2 * n)

    theta = np.append(lr.coefficientMatrix.toArray().ravel(), lr.interceptVector.toArray())
    for at, want in ((theta, at_fit), (np.zeros_like(theta), at_zero)):
        g = [(loss(at + e) - loss(at - e)) / 2e-5 for e in np.eye(len(at)) * 1e-5]
        assert np.linalg.norm(g) == pytest.approx(want, abs=1e-5)


def test_local_rows_become_a_table(spark, db):
    p = plan_for(spark, SF)
    picked = p.runs.limit(3).collect()
    table = runs.rows_to_table(spark, picked, db, unique("local_runs"))
    assert table.schema.simpleString() == runs.RUN_LOG_SCHEMA.simpleString()
    assert sorted(map(str, table.collect())) == sorted(map(str, picked))
    assert runs.rows_to_table(spark, [], db, unique("local_runs")).count() == 0
