"""Physical-plan properties the scale design relies on (checked with explain)."""

from dispute_engine.functions.joins import broadcast_if_small, estimated_size_bytes
from dispute_engine.operators import queue
from dispute_engine.plans.pipeline import plan_for

SF = "/root/testdata/sf0.01"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return physical(df).count("Exchange hashpartitioning")


def test_evidence_stages_add_no_shuffle(spark):
    p = plan_for(spark, SF)
    # explode, top-k window and per-dispute aggregation reuse the base's dispute_id partitioning
    assert shuffles(p.evidence_agg) == shuffles(p.evidence_base)
    plan = physical(p.evidence_agg)
    assert "WindowGroupLimit" in plan and "Generate" in plan


def test_kpis_aggregate_partially_before_the_shuffle(spark):
    p = plan_for(spark, SF)
    plan = physical(queue.queue_kpis(p.queue))
    assert "partial_count" in plan and "partial_sum" in plan and "partial_avg" in plan


def test_lookups_broadcast_only_under_the_size_bound(spark):
    p = plan_for(spark, SF)
    plan = p.t.plan_reference
    assert estimated_size_bytes(plan) is not None
    assert broadcast_if_small(plan) is not plan
    assert broadcast_if_small(plan, max_bytes=0) is plan
    assert "BroadcastHashJoin" in physical(p.gold)


def test_scans_are_pruned(spark):
    p = plan_for(spark, SF)
    plan = physical(queue.payer_kpis(p.queue))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_extendedprice:double>" in plan


def test_null_key_third_spreads_over_partitions(spark):
    from pyspark.sql import functions as F

    from dispute_engine.functions.joins import lookup_join
    left = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise((F.col("id") % 1000).cast("string")).alias("k"),
        F.col("id"))
    right = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.lit("v").alias("v"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
            "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)

        def spread(df):
            sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(
                F.count(F.lit(1)).alias("n")).collect()]
            return max(sizes) / (sum(sizes) / len(sizes))

        plain = left.join(right, ["k"], "left")
        salted = lookup_join(left, right, ["k"], max_bytes=0)
        assert salted.count() == plain.count() == 30000
        assert spread(plain) > 2.0  # the NULL third lands in one partition
        assert spread(salted) < 1.5
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_hot_dispute_top3_is_bounded(spark):
    from pyspark.sql import functions as F

    from dispute_engine.operators import evidence
    n = 30000
    cand = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.format_string("D%d", F.col("id") % 5000))
        .alias("dispute_id"),
        F.format_string("T%d", F.col("id") % 12).alias("evidence_type"),
        F.format_string("t%d", F.col("id")).alias("evidence_text"),
        (F.col("id") % 97).cast("double").alias("evidence_score"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("evidence_ts"))
    top = evidence.top_evidence(cand)
    plan = physical(top)
    lines = plan.splitlines()
    shuffle_at = next(i for i, ln in enumerate(lines) if "Exchange hashpartitioning" in ln)
    limits = [i for i, ln in enumerate(lines) if "WindowGroupLimit" in ln]
    assert any(i > shuffle_at for i in limits) and any(i < shuffle_at for i in limits)  # partial below, final above
    hot = top.where(F.col("dispute_id") == "HOT").orderBy(F.desc("evidence_score"), "evidence_type", "evidence_text")
    got = [r.evidence_score for r in hot.collect()]
    assert got == [96.0, 96.0, 96.0]
    assert evidence.aggregate_evidence(top).where("dispute_id = 'HOT'").first().evidence_list[0].endswith("(score=96)")
