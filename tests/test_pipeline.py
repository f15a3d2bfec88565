"""The table DAG written end to end, read back, equal to the lazy plans."""

from dispute_engine import config as C
from dispute_engine.plans.pipeline import plan_for, run_pipeline

SF = "/root/testdata/sf0.001"
TS = "2024-01-01 00:00:00"


def test_run_pipeline_writes_every_table(spark):
    out = run_pipeline(spark, SF, db="dispute_ai_test", ts=TS, buckets=4)
    for name in ("silver_clean_disputes", "silver_policy_snippets", "gold_features_disputes",
                 "gold_features_disputes_v2", "predictions_disputes_scored", "predictions_disputes_scored_routed",
                 "dispute_work_queue", "dispute_queue_kpis", "dispute_queue_kpis_payer", "dispute_work_events",
                 "dispute_evidence_candidates", "dispute_evidence_top3", "dispute_work_queue_enriched",
                 "dispute_work_queue_actionable", "llm_explanation_prompts", "v_queue_dashboard"):
        assert spark.catalog.tableExists(out[name]), name
    p = plan_for(spark, SF)
    written = spark.table(out["dispute_work_queue_enriched"])
    assert written.exceptAll(p.enriched).count() == 0 and p.enriched.exceptAll(written).count() == 0
    prompts = spark.table(out["llm_explanation_prompts"])
    assert prompts.exceptAll(p.prompts).count() == 0
    view = spark.table(out["v_queue_dashboard"])
    assert view.count() == p.queue.count() == spark.table(out["dispute_work_events"]).count()


def test_bucketed_queue_join_has_no_exchange_on_buckets(spark):
    out = run_pipeline(spark, SF, db="dispute_ai_test2", ts=TS, buckets=4)
    q = spark.table(out["dispute_work_queue"])
    g = spark.table(out["gold_features_disputes_v2"])
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = q.join(g.select("dispute_id", "plan_id"), "dispute_id", "left")._jdf.queryExecution() \
            .executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_rerun_overwrites_tables_and_appends_events(spark):
    out = run_pipeline(spark, SF, db="dispute_ai_rerun", ts=TS, buckets=4)
    n_queue = spark.table(out["dispute_work_queue"]).count()
    n_events = spark.table(out["dispute_work_events"]).count()
    out2 = run_pipeline(spark, SF, db="dispute_ai_rerun", ts=TS, buckets=4)
    assert spark.table(out2["dispute_work_queue"]).count() == n_queue  # overwrite
    assert spark.table(out2["dispute_evidence_top3"]).count() == spark.table(out["dispute_evidence_top3"]).count()
    assert spark.table(out2["dispute_work_events"]).count() == 2 * n_events  # plain append duplicates (D6)


def test_run_pipeline_trains_logs_and_scores(spark):
    small = C.BoostedParams(n_estimators=3, max_depth=4)
    out = run_pipeline(spark, SF, db="dispute_ai_train", ts=TS, buckets=4, train=small)
    p = plan_for(spark, SF)
    for v in ("", "_v2"):
        whole = spark.table(out[f"gold_features_split{v}"])
        assert whole.count() == p.gold.count()
        assert spark.table(out[f"train_disputes{v}"]).count() == whole.where("split = 'TRAIN'").count() > 0
        assert spark.table(out[f"test_disputes{v}"]).count() == whole.where("split = 'TEST'").count() > 0
    scored = spark.table(out["predictions_disputes_scored"])
    assert scored.count() == p.gold.count() and scored.where("conf_xgb IS NULL OR conf_lr IS NULL").count() == 0
    fixture = p.t.scored.select("dispute_id", "conf_xgb")
    assert scored.select("dispute_id", "conf_xgb").exceptAll(fixture).count() > 0  # not the input's predictions
    assert {r["uri"] for r in scored.selectExpr("xgb_model_uri AS uri").distinct().collect()} == {
        "models/reason_classifier_xgboost_v2"}
    runs = {r["run_name"]: r for r in spark.table(out["mlflow_run_metrics"]).collect()}
    assert set(runs) == {C.RUN_LR_COLLAPSED, C.RUN_BOOSTED} and all(0 < r["f1_macro"] <= 1 for r in runs.values())
    assert spark.table(out["model_metrics_reason_classifier"]).count() == 2
    queue = spark.table(out["dispute_work_queue"])
    joined = queue.join(scored.selectExpr("dispute_id", "pred_reason_xgb AS want"), "dispute_id")
    assert joined.where("pred_reason_xgb <> want").count() == 0 and joined.count() > 0
