"""Routing, queue, evidence ranking, actions and prompts: rule edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dispute_engine import config as C
from dispute_engine.operators import actions, evidence, queue, routing
from dispute_engine.plans.pipeline import plan_for
from dispute_engine.sources import io

SF = "/root/testdata/sf0.001"
TS = C.FIXED_RUN_TS


def test_route_bands_null_and_nan(spark):
    df = spark.createDataFrame([(1, 0.75), (2, 0.5), (3, 0.49), (4, None), (5, float("nan"))],
                               "id int, conf_xgb double")
    got = {r.id: (r.route_decision, r.route_reason) for r in routing.route(df, ts=TS).collect()}
    assert got[1] == ("AUTO_ROUTE", "high_confidence")
    assert got[2] == ("REVIEW", "medium_confidence")
    assert got[3] == ("REQUEST_INFO", "low_confidence")
    assert got[4] == ("REQUEST_INFO", "missing_confidence")
    assert got[5] == ("REQUEST_INFO", "missing_confidence")  # NaN treated as missing, not >= 0.75


def _queue(spark, rows):
    s = spark.createDataFrame(rows, "dispute_id string, pred_reason_xgb string, conf_xgb double, "
                                    "pred_reason_lr string, conf_lr double")
    g = spark.createDataFrame(
        [(r[0], "P", "Medicaid Ffs", "S01", "340B", "n1", e, p, 0.1, 5, 1) for r, (e, p) in
         zip(rows, [(6000.0, 0.0), (1000.0, 0.0), (10.0, 20.0), (None, 1.0), (5.0, 5.0)])],
        "dispute_id string, payer string, program string, state string, channel string, ndc11 string, "
        "expected_amount double, paid_amount double, delta_pct double, days_to_submit int, timely_flag int")
    return {r.dispute_id: r for r in queue.build_queue(s, g, ts=TS).collect()}


def test_queue_priority_owner_direction(spark):
    q = _queue(spark, [("a", "DUPLICATE_DISCOUNT_340B", 0.85, None, None),
                       ("b", "STEP_THERAPY", 0.75, None, None),
                       ("c", None, 0.99, None, None),
                       ("d", "PRIOR_AUTH", None, None, None),
                       ("e", "TIMELY_FILING", 0.2, None, None)])
    assert (q["a"].priority, q["a"].sla_days, q["a"].owner_queue) == ("P1", 2, "340B Team")
    assert (q["b"].priority, q["b"].sla_days, q["b"].owner_queue) == ("P2", 5, "Policy Ops Team")
    assert (q["c"].priority, q["c"].owner_queue, q["c"].variance_direction) == ("P3", "Pricing/Admin Team",
                                                                                "OVERPAID_VERIFY")
    assert q["d"].variance_direction == "MATCH" and q["d"].recoverable_amount is None  # NULL -> MATCH
    assert q["e"].variance_direction == "MATCH" and q["e"].owner_queue == "Timely Filing Team"
    assert q["a"].work_status == "OPEN" and q["a"].created_at == dt.datetime(2024, 1, 1)
    assert list(q["a"].asDict()) == list(queue.QUEUE_COLUMNS)


def test_kpis_sum_positive_recoverable_and_skip_null_conf(spark):
    df = spark.createDataFrame(
        [("T", "P1", "X", 0.9, 10.0, 10.0, "A"), ("T", "P1", "X", None, 5.0, -5.0, "A"),
         ("T", "P1", "X", 0.5, None, None, "B")],
        "owner_queue string, priority string, pred_reason_xgb string, conf_xgb double, "
        "dispute_variance_amount double, recoverable_amount double, payer string")
    k = queue.queue_kpis(df).first()
    assert (k.open_cases, k.avg_confidence, k.total_variance_amount, k.total_recoverable_amount) == (
        3, pytest.approx(0.7), 15.0, 10.0)
    pk = {r.payer: r for r in queue.payer_kpis(df).collect()}
    assert pk["B"].total_recoverable_amount == 0.0 and pk["B"].total_variance_amount is None


def test_one_pass_equals_union_on_fixture(spark):
    p = plan_for(spark, SF)
    a = p.candidates.exceptAll(evidence.evidence_candidates_union(p.evidence_base, ts=TS))
    b = evidence.evidence_candidates_union(p.evidence_base, ts=TS).exceptAll(p.candidates)
    assert a.count() == 0 and b.count() == 0


def test_one_pass_reads_base_once(spark):
    p = plan_for(spark, SF)

    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Relation ")

    one, union = p.candidates, evidence.evidence_candidates_union(p.evidence_base, ts=TS)
    assert scans(one) == scans(p.evidence_base)
    assert scans(union) >= 10 * scans(p.evidence_base)
    assert "Generate" in one._jdf.queryExecution().executedPlan().toString()


def _ev(spark, rows):
    return spark.createDataFrame(rows, "dispute_id string, evidence_type string, evidence_text string, "
                                       "evidence_score double, evidence_ts timestamp")


def test_top3_ties_are_deterministic(spark):
    ts = dt.datetime(2024, 1, 1)
    rows = [("d", "KW_TIMELY", "t", 80.0, ts), ("d", "KW_PA", "p", 80.0, ts), ("d", "KW_NDC", "n", 75.0, ts),
            ("d", "KW_ELIGIBILITY", "e", 75.0, ts), ("d", "MODEL_CONFIDENCE", None, None, ts)]
    top = evidence.top_evidence(_ev(spark, rows))
    assert sorted(r.evidence_type for r in top.collect()) == ["KW_ELIGIBILITY", "KW_PA", "KW_TIMELY"]
    agg = evidence.aggregate_evidence(top).first()
    assert agg.evidence_list == ["[KW_PA] p (score=80)", "[KW_TIMELY] t (score=80)",
                                 "[KW_ELIGIBILITY] e (score=75)"]


def test_null_text_takes_a_slot_and_block_is_empty_string(spark):
    ts = dt.datetime(2024, 1, 1)
    rows = [("d", "MODEL_CONFIDENCE", None, None, ts), ("d", "AMOUNT_VARIANCE", None, 40.0, ts)]
    agg = evidence.aggregate_evidence(evidence.top_evidence(_ev(spark, rows))).first()
    assert agg.evidence_list == [] and agg.evidence_text_block == ""


def test_top3_plan_uses_group_limit(spark):
    p = plan_for(spark, SF)
    assert "WindowGroupLimit" in p.top3._jdf.queryExecution().executedPlan().toString()


def _actionable(spark, pred, conf, days, flag, block):
    df = spark.createDataFrame([(pred, conf, days, flag, block)],
                               "pred_reason_xgb string, conf_xgb double, days_to_submit int, timely_flag int, "
                               "evidence_text_block string")
    return actions.build_actions(df, ts=TS).first()


def test_actions(spark):
    a = _actionable(spark, "TIMELY_FILING", 0.8, 40, 0, "x")
    assert a.recommended_action == C.ACTION_TIMELY_LATE and a.requires_human_review is False
    assert a.action_reason == "Predicted=TIMELY_FILING; confidence=0.800; top evidence:\nx"
    b = _actionable(spark, "TIMELY_FILING", None, 40, None, None)
    assert b.recommended_action == C.ACTION_DEFAULT  # NULL timely_flag falls to the pricing text
    assert b.next_action_owner == "Timely Filing Team" and b.requires_human_review is True
    assert b.action_reason is None
    c = _actionable(spark, "PRIOR_AUTH", 0.5, 1, 1, None)
    assert c.action_reason == "Predicted=PRIOR_AUTH; confidence=0.500"


def _prompt_row(spark, **kw):
    vals = dict(dispute_id="d", pred_reason_xgb="PRIOR_AUTH", conf_xgb=0.9, priority="P1", owner_queue="PA Team",
                next_action_owner="PA Team", expected_amount=12345678.9, paid_amount=1.0,
                recoverable_amount=12345677.9, dispute_variance_amount=12345677.9, days_to_submit=3,
                timely_flag=1, recommended_action="act", evidence_text_block=None)
    vals.update(kw)
    schema = ("dispute_id string, pred_reason_xgb string, conf_xgb double, priority string, owner_queue string, "
              "next_action_owner string, expected_amount double, paid_amount double, recoverable_amount double, "
              "dispute_variance_amount double, days_to_submit int, timely_flag int, recommended_action string, "
              "evidence_text_block string")
    return spark.createDataFrame([tuple(vals.values())], schema)


def test_prompt_text_and_null_propagation(spark):
    p = actions.build_prompts(_prompt_row(spark), ts=TS).first().llm_prompt
    assert "- expected_amount: 1.23456789E7\n" in p  # double text form kept
    assert "Evidence:\nNo evidence available." in p
    assert actions.build_prompts(_prompt_row(spark, timely_flag=None), ts=TS).first().llm_prompt is None
    filled = actions.build_prompts(_prompt_row(spark, timely_flag=None), ts=TS, null_text="n/a",
                                   money_format=True).first().llm_prompt
    assert "- timely_flag: n/a\n" in filled and "- expected_amount: 12,345,678.90\n" in filled


def test_dashboard_projection_equals_join(spark):
    p = plan_for(spark, SF)
    a, b = io.dashboard(p.actionable), io.dashboard(p.actionable, p.enriched)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_duplicate_ids_fan_out_in_join_form(spark):
    act = spark.createDataFrame([("d", 1.0)] * 2, "dispute_id string, conf_xgb double")
    cols = {c: F.lit(None).cast("string") for c in io.DASHBOARD_COLUMNS if c not in ("dispute_id", "conf_xgb")}
    act = act.withColumns(cols).withColumn("evidence_text_block", F.lit("x"))
    assert io.dashboard(act).count() == 2
    assert io.dashboard(act, act).count() == 4


def test_created_events(spark):
    p = plan_for(spark, SF)
    ev = queue.created_events(p.queue)
    r = ev.first()
    assert (r.event_type, r.old_status, r.new_status, r.actor) == ("CREATED", None, "OPEN", "system")
    assert ev.count() == p.queue.count()


def test_tie_at_90_variance_vs_kw_340b(spark):
    ts = dt.datetime(2024, 1, 1)
    rows = [("d", "KW_340B", "k", 90.0, ts), ("d", "AMOUNT_VARIANCE", "v", 90.0, ts),
            ("d", "CHANNEL_340B", "c", 88.0, ts), ("d", "KW_DUPLICATE", "u", 85.0, ts)]
    agg = evidence.aggregate_evidence(evidence.top_evidence(_ev(spark, rows))).first()
    assert agg.evidence_list == ["[AMOUNT_VARIANCE] v (score=90)", "[KW_340B] k (score=90)",
                                 "[CHANNEL_340B] c (score=88)"]
    assert agg.evidence_text_block == "\n".join(agg.evidence_list)


def test_best_of_a_row_equals_the_top_of_all_its_candidates(spark):
    p = plan_for(spark, SF)
    base = p.evidence_base
    twice = base.unionByName(base.where("kw_340b = 1 OR conf_xgb IS NULL"))  # ids that come twice
    few = evidence.evidence_candidates(twice, ts=TS, best=2)
    assert few.groupBy("dispute_id").count().agg(F.max("count")).first()[0] == 4
    a, b = (evidence.top_evidence(c, 2) for c in (few, evidence.evidence_candidates(twice, ts=TS)))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() > 0


def test_evidence_reads_gold_and_queue_as_written_and_merges(spark):
    plan = plan_for(spark, SF).enriched._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan and plan.count("SortMergeJoin [dispute_id") >= 2
