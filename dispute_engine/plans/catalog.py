"""Registered queries: one Spark plan per operator key, with its SQL oracle.

Each entry is ``key -> (fn(spark, sf_dir) -> DataFrame, oracle SQL | None)``.
Every plan reads the whole benchmark tables through the fixture views; the
oracle is hand-written DuckDB SQL over the same tables (``plans.oracle``).
Aggregated doubles are rounded on both sides (summation order differs
between engines); everything else is compared as computed.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import actions, evidence, gold, quality, queue, runs, silver, split
from ..sources import io
from . import oracle as O
from ..session import checkpoint_dir
from .pipeline import ensure_database, plan_for

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}

CHECK_DB = "dispute_engine_checks"


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = (fn, sql)
        return fn
    return deco


def rounded(df: DataFrame, scale: int, cols: list[str] | None = None) -> DataFrame:
    """Round double columns (all, or ``cols``) for cross-engine comparison."""
    names = cols or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(F.col(c), scale) for c in names})


def slug(sf_dir: str) -> str:
    return re.sub(r"[^0-9a-zA-Z]+", "_", sf_dir.rstrip("/").split("/")[-1]).strip("_").lower() or "data"


def P(spark, sf_dir):
    return plan_for(spark, sf_dir)


def sel(src: str, cols: str, where: str = "") -> str:
    return O.with_ctes(f"SELECT {cols} FROM {src} {where}")


SILVER_COLS = ("dispute_id, service_date, submitted_date, days_to_submit, payer, program, state, channel, plan_id, "
               "ndc11, brand_generic, therapeutic_class, manufacturer, outcome, reason_code, dispute_notes, "
               "rejection_code_text, units, billed_amount, paid_amount, expected_amount")

# ---------------------------------------------------------------- 2.A scans, sinks, catalog


@register("scan_table", sel("raw_disputes", "*"))
def _scan_table(spark, d):
    return P(spark, d).t.raw_disputes


@register("scan_project_alias", sel("ndc_reference", "ndc11, therapeutic_class AS ndc_therapeutic_class, "
                                                      "manufacturer AS ndc_manufacturer"))
def _scan_project_alias(spark, d):
    return io.lookup(P(spark, d).t.ndc_reference, gold.NDC_COLS, gold.NDC_RENAMES)


@register("sink_overwrite", sel("silver", "*"))
def _sink_overwrite(spark, d):
    db = ensure_database(spark, CHECK_DB)
    name = f"silver_clean_disputes_{slug(d)}"
    io.write_table(P(spark, d).silver, db, name)
    io.write_table(P(spark, d).silver, db, name)  # a rerun replaces, never duplicates
    return io.read_table(spark, db, name)


EVENTS_SQL = O.with_ctes(f"""
SELECT dispute_id, 'CREATED' AS event_type, CAST(NULL AS VARCHAR) AS old_status, work_status AS new_status,
  'system' AS actor, 'Work queue item created from batch scoring' AS notes, created_at AS event_ts FROM queue""")


@register("sink_append_events", EVENTS_SQL)
def _sink_append_events(spark, d):
    """Idempotent append run twice into the log partitioned by date: it holds each CREATED event once."""
    db = ensure_database(spark, CHECK_DB)
    name = f"dispute_work_events_idem_{slug(d)}"
    spark.sql(f"DROP TABLE IF EXISTS {db}.{name}")
    io.ensure_event_log(spark, db, name)
    ev = queue.created_events(P(spark, d).queue)
    io.append_events(ev, db, name, idempotent=True)
    io.append_events(ev, db, name, idempotent=True)
    return io.read_events(spark, db, name)


@register("create_events_table", EVENTS_SQL)
def _create_events_table(spark, d):
    """Create-if-absent with the explicit schema, then the plain append."""
    db = ensure_database(spark, CHECK_DB)
    name = f"dispute_work_events_{slug(d)}"
    spark.sql(f"DROP TABLE IF EXISTS {db}.{name}")
    io.ensure_table(spark, db, name, io.EVENTS_SCHEMA)
    io.ensure_table(spark, db, name, io.EVENTS_SCHEMA)  # second call is a no-op
    io.append_events(queue.created_events(P(spark, d).queue), db, name)
    return io.read_table(spark, db, name)


@register("source_fallback", sel("scored_fixture", "*"))
def _source_fallback(spark, d):
    db = ensure_database(spark, CHECK_DB)
    scored, routed = f"scored_{slug(d)}", f"scored_routed_{slug(d)}"
    spark.sql(f"DROP TABLE IF EXISTS {db}.{routed}")
    io.write_table(P(spark, d).t.scored, db, scored)
    return spark.table(io.resolve_source(spark, db, [routed, scored]))


NO_RULES_CANDIDATES = O.with_ctes(
    "\nUNION ALL\n".join(O.candidate_branches("ev_base", with_rules=False)))


@register("optional_lookup", NO_RULES_CANDIDATES)
def _optional_lookup(spark, d):
    """payer_rules absent: its join and its evidence rule are skipped."""
    p = P(spark, d)
    db = ensure_database(spark, CHECK_DB)
    spark.sql(f"DROP TABLE IF EXISTS {db}.payer_rules_absent_{slug(d)}")
    rules = io.optional_table(spark, db, f"payer_rules_absent_{slug(d)}",
                              ["payer", "program", "timely_filing_days"])
    base = evidence.evidence_base(p.queue, p.gold_v2, rules, p.t.plan_reference, p.t.ndc_reference)
    return evidence.evidence_candidates(base, ts=p.ts)


DASHBOARD_SQL = O.with_ctes("""
SELECT q.dispute_id, q.created_at, q.priority, q.owner_queue, q.work_status, q.pred_reason_xgb, q.conf_xgb,
  q.recommended_action, q.next_action_owner, q.requires_human_review, q.dispute_variance_amount,
  q.recoverable_amount, e.evidence_text_block
FROM actionable q LEFT JOIN enriched e ON q.dispute_id = e.dispute_id""")


@register("dashboard_view", DASHBOARD_SQL)
def _dashboard_view(spark, d):
    """The view over the written actionable and enriched tables, as a user reads it."""
    p, db, s = P(spark, d), ensure_database(spark, CHECK_DB), slug(d)
    actionable, enriched, view = (f"{n}_{s}" for n in ("dash_actionable", "dash_enriched", "v_queue_dashboard"))
    io.write_table(p.enriched, db, enriched)
    io.write_table(actions.build_actions(io.read_table(spark, db, enriched), ts=p.ts), db, actionable)
    io.create_dashboard_view(spark, db, view, actionable, enriched, exact_join=True)
    return spark.table(io.qualified(db, view))


RUN_METRICS_SQL_COLS = (f"experiment_id, experiment_name, run_id, run_name, status, "
                        f"{O.iso_sql('start_time')} AS start_time_utc, CAST(NULL AS VARCHAR) AS end_time_utc, "
                        f"f1_macro, roc_auc, avg_precision, params, tags")


@register("adhoc_select", O.with_ctes(f"""
SELECT experiment_id, experiment_name, run_id, run_name, status, start_time_utc, end_time_utc, f1_macro, params, tags
FROM (SELECT {RUN_METRICS_SQL_COLS} FROM runs_latest) t"""))
def _adhoc_select(spark, d):
    p = P(spark, d)
    db = ensure_database(spark, CHECK_DB)
    name = f"mlflow_run_metrics_{slug(d)}"
    io.write_table(runs.run_metrics(p.runs), db, name)
    return spark.sql(f"SELECT experiment_id, experiment_name, run_id, run_name, status, start_time_utc, "
                     f"end_time_utc, f1_macro, params, tags FROM {db}.{name}")


@register("preview_plan_reference", sel("plan_reference", "*", "ORDER BY plan_id LIMIT 100"))
def _preview_plan_reference(spark, d):
    return io.preview(P(spark, d).t.plan_reference, 100, ["plan_id"])


ROWS_TO_TABLE_SQL = O.with_ctes("""
SELECT run_id, 'metric' AS kind, 'f1_macro' AS key, printf('%.4f', f1_macro) AS value FROM runs_latest
WHERE f1_macro IS NOT NULL
UNION ALL SELECT run_id, 'metric', 'roc_auc', printf('%.4f', roc_auc) FROM runs_latest WHERE roc_auc IS NOT NULL
UNION ALL SELECT run_id, 'param', k, json_extract_string(params, '$.' || k)
  FROM (SELECT run_id, params, unnest(json_keys(params)) AS k FROM runs_latest WHERE params IS NOT NULL) t
UNION ALL SELECT run_id, 'tag', 'mlflow.runName', run_name FROM runs_latest""")


@register("rows_to_table", ROWS_TO_TABLE_SQL)
def _rows_to_table(spark, d):
    """The latest run of each tracked name (at most 3 local rows) as a table with the explicit schema, its maps exploded."""
    p, db = P(spark, d), ensure_database(spark, CHECK_DB)
    picked = runs.latest_runs(runs.dedup_runs(runs.runs_named(runs.recent_runs(p.runs)))).collect()
    table = runs.rows_to_table(spark, picked, db, f"mlflow_runs_local_{slug(d)}")
    return runs.exploded_maps(table).withColumn("value", F.when(
        F.col("kind") == "metric", F.format_string("%.4f", F.col("value").cast("double"))).otherwise(F.col("value")))


@register("load_label_mapping", O.with_ctes("""
SELECT CAST(dense_rank() OVER (ORDER BY reason_code_v2) - 1 AS INTEGER) AS class_index, reason_code_v2 AS class_name
FROM (SELECT DISTINCT reason_code_v2 FROM train_v2) t"""))
def _load_label_mapping(spark, d):
    from ..operators import ml
    path = f"{checkpoint_dir(spark).rstrip('/')}/artifacts/label_mapping_{slug(d)}.csv"
    train = split.take_split(split.hash_split(P(spark, d).gold_v2), "TRAIN")
    ml.label_mapping(train, "reason_code_v2").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return io.load_label_mapping(spark, path)


@register("require_columns", sel("gold_v2", "dispute_id, " + ", ".join(C.SPEC_V2.features)))
def _require_columns(spark, d):
    g = P(spark, d).gold_v2
    need = (C.SPEC_V2.id_col, *C.SPEC_V2.features)
    io.require_columns(g, need, "gold_features_disputes_v2")
    return g.select(*need)


# ---------------------------------------------------------------- 2.B projections and cleaning

@register("parse_dates", sel("silver", "dispute_id, service_date, submitted_date"))
def _parse_dates(spark, d):
    return silver.parse_dates(P(spark, d).t.raw_disputes).select("dispute_id", *silver.DATE_COLS)


@register("days_to_submit_fallback", sel("silver", "dispute_id, days_to_submit"))
def _days_to_submit(spark, d):
    return silver.days_to_submit(silver.parse_dates(P(spark, d).t.raw_disputes)).select("dispute_id", "days_to_submit")


@register("norm_program", sel("silver", "dispute_id, program"))
def _norm_program(spark, d):
    from ..functions import norm_title
    return P(spark, d).t.raw_disputes.select("dispute_id", norm_title("program").alias("program"))


@register("norm_channel", sel("silver", "dispute_id, channel"))
def _norm_channel(spark, d):
    from ..functions import norm_channel
    return P(spark, d).t.raw_disputes.select("dispute_id", norm_channel("channel").alias("channel"))


@register("norm_code", sel("silver", "dispute_id, outcome, reason_code"))
def _norm_code(spark, d):
    from ..functions import norm_code
    return P(spark, d).t.raw_disputes.select("dispute_id", norm_code("outcome").alias("outcome"),
                                             norm_code("reason_code").alias("reason_code"))


@register("safe_numeric_cast", sel("silver", "dispute_id, units, billed_amount, paid_amount, expected_amount"))
def _safe_numeric_cast(spark, d):
    return silver.to_doubles(P(spark, d).t.raw_disputes).select("dispute_id", *silver.AMOUNT_COLS)


SNIPPETS_SQL = sel("policy_snippets", f"snippet_id, {O.initcap('program')} AS program, upper(trim(state)) AS state, "
                                      "upper(trim(payer)) AS payer, upper(trim(reason_code)) AS reason_code, "
                                      "trim(snippet_text) AS snippet_text")


@register("trim_text", sel("policy_snippets", "snippet_id, trim(snippet_text) AS snippet_text"))
def _trim_text(spark, d):
    return P(spark, d).snippets.select("snippet_id", "snippet_text")


@register("silver_clean_disputes", sel("silver", SILVER_COLS))
def _silver(spark, d):
    return P(spark, d).silver


@register("silver_policy_snippets", SNIPPETS_SQL)
def _silver_snippets(spark, d):
    return P(spark, d).snippets


QUEUE_COLS_SQL = ", ".join(queue.QUEUE_COLUMNS)


@register("queue_projection", sel("queue", QUEUE_COLS_SQL))
def _queue_projection(spark, d):
    return P(spark, d).queue.select(*queue.QUEUE_COLUMNS)


PROMPT_COLS = ("dispute_id, pred_reason_xgb, conf_xgb, priority, owner_queue, next_action_owner, expected_amount, "
               "paid_amount, recoverable_amount, dispute_variance_amount, days_to_submit, timely_flag, "
               "recommended_action, evidence_text_block")


@register("prompt_projection", sel("actionable", PROMPT_COLS))
def _prompt_projection(spark, d):
    from ..operators.actions import PROMPT_COLUMNS
    return P(spark, d).actionable.select(*PROMPT_COLUMNS)


@register("queue_constants", sel("queue", "dispute_id, work_status"))
def _queue_constants(spark, d):
    return P(spark, d).queue.select("dispute_id", "work_status")


@register("select_features_label", sel("gold_v2", "dispute_id, " + ", ".join(C.SPEC_V2.features)
                                       + ", CAST(reason_code_v2 AS VARCHAR) AS reason_code_v2"))
def _select_features_label(spark, d):
    from ..operators import ml
    return ml.select_training(P(spark, d).gold_v2, C.SPEC_V2)


KW_COLS = "kw_340b, kw_duplicate, kw_timely, kw_pa, kw_ndc, kw_eligibility"


@register("drop_helpers", sel("gold", f"dispute_id, {KW_COLS}"))
def _drop_helpers(spark, d):
    """Keyword flags computed without materialised helper columns."""
    g = P(spark, d).gold
    assert "notes_lc" not in g.columns and "rej_lc" not in g.columns
    return g.select("dispute_id", *[r[0] for r in C.KEYWORD_RULES])


# ---------------------------------------------------------------- 2.C features and labels

def _gold_col(key: str, cols: str):
    @register(key, sel("gold", f"dispute_id, {cols}"))
    def _fn(spark, d, _cols=cols):
        return P(spark, d).gold.select("dispute_id", *[c.strip() for c in _cols.split(",")])
    return _fn


for _k, _c in [("delta_amount", "delta_amount"), ("delta_pct", "delta_pct"), ("is_340b_flag", "is_340b_flag"),
               ("timely_flag", "timely_flag"), ("kw_340b", "kw_340b"), ("kw_duplicate", "kw_duplicate"),
               ("kw_timely", "kw_timely"), ("kw_pa", "kw_pa"), ("kw_ndc", "kw_ndc"),
               ("kw_eligibility", "kw_eligibility")]:
    _gold_col(_k, _c)


@register("text_lower_coalesce", sel("raw_disputes", f"dispute_id, {O.lc('dispute_notes')} AS notes_lc, "
                                                     f"{O.lc('rejection_code_text')} AS rej_lc"))
def _text_lower_coalesce(spark, d):
    from ..functions import lower_coalesce
    return P(spark, d).t.raw_disputes.select("dispute_id", lower_coalesce("dispute_notes").alias("notes_lc"),
                                             lower_coalesce("rejection_code_text").alias("rej_lc"))


@register("gold_features_disputes", sel("gold", "*"))
def _gold(spark, d):
    return P(spark, d).gold


@register("collapse_labels", sel("gold_v2", "*"))
def _collapse(spark, d):
    return P(spark, d).gold_v2


# ---------------------------------------------------------------- 2.D joins

@register("join_payer_rules", sel("gold", "dispute_id, payer, program, timely_filing_days, pa_strictness, "
                                          "appeal_success_bias"))
def _join_payer(spark, d):
    p = P(spark, d)
    return gold.enrich_payer(p.silver, p.t.payer_rules).select(
        "dispute_id", "payer", "program", "timely_filing_days", "pa_strictness", "appeal_success_bias")


@register("join_ndc", sel("gold", "dispute_id, ndc11, ndc_therapeutic_class, ndc_manufacturer"))
def _join_ndc(spark, d):
    p = P(spark, d)
    return gold.enrich_ndc(p.silver, p.t.ndc_reference).select(
        "dispute_id", "ndc11", "ndc_therapeutic_class", "ndc_manufacturer")


@register("join_plan", sel("gold", "dispute_id, plan_id, coverage_generosity"))
def _join_plan(spark, d):
    p = P(spark, d)
    return gold.enrich_plan(p.silver, p.t.plan_reference).select("dispute_id", "plan_id", "coverage_generosity")


@register("join_scored_gold", O.with_ctes("""
SELECT s.dispute_id, s.pred_reason_xgb, s.conf_xgb, s.pred_reason_lr, s.conf_lr, g.payer, g.program, g.state,
  g.channel, g.ndc11, g.expected_amount, g.paid_amount, g.delta_pct, g.days_to_submit, g.timely_flag
FROM routed s LEFT JOIN gold_v2 g ON s.dispute_id = g.dispute_id"""))
def _join_scored_gold(spark, d):
    p = P(spark, d)
    j = queue.join_scored_gold(p.routed, p.gold_v2)
    return j.select("dispute_id", *[F.col(f"s.{c}").alias(c) for c in ("pred_reason_xgb", "conf_xgb",
                                                                      "pred_reason_lr", "conf_lr")],
                    *[F.col(f"g.{c}").alias(c) for c in queue.GOLD_QUEUE_COLS[1:]])


@register("join_queue_gold", sel("ev_base_core", "*"))
def _join_queue_gold(spark, d):
    p = P(spark, d)
    return evidence.evidence_base(p.queue, p.gold_v2)


@register("join_optional_refs", sel("ev_base", "*"))
def _join_optional_refs(spark, d):
    return P(spark, d).evidence_base


@register("join_queue_evidence", sel("enriched", "*"))
def _join_queue_evidence(spark, d):
    return P(spark, d).enriched


@register("join_view", DASHBOARD_SQL)
def _join_view(spark, d):
    """The LEFT JOIN form of the dashboard view, as written."""
    p = P(spark, d)
    return io.dashboard(p.actionable, p.enriched)


DECODE_SQL = O.with_ctes("""
SELECT s.dispute_id, s.pred_index, coalesce(m.class_name, 'UNKNOWN') AS pred_reason
FROM (SELECT dispute_id, CAST(CAST(substr(dispute_id, 2) AS BIGINT) % 9 AS INTEGER) AS pred_index FROM gold_v2) s
LEFT JOIN (SELECT CAST(dense_rank() OVER (ORDER BY reason_code_v2) - 1 AS INTEGER) AS class_index,
                  reason_code_v2 AS class_name FROM (SELECT DISTINCT reason_code_v2 FROM train_v2) t) m
  ON s.pred_index = m.class_index""")


@register("decode_labels", DECODE_SQL)
def _decode_labels(spark, d):
    """Index predictions (derived from the id) decoded through the label mapping;
    index 8 has no class and decodes to UNKNOWN."""
    from ..operators import ml
    g = P(spark, d).gold_v2
    mapping = ml.label_mapping(split.take_split(split.hash_split(g), "TRAIN"), "reason_code_v2")
    idx = g.select("dispute_id", (F.substring("dispute_id", 2, 100).cast("bigint") % 9).cast("int")
                   .alias("pred_index"))
    return ml.decode_labels(idx, mapping, "pred_index", "pred_reason")


# ---------------------------------------------------------------- 2.E filters

@register("filter_split", sel("split_v2", "dispute_id, reason_code_v2, split", "WHERE split = 'TRAIN'"))
def _filter_split(spark, d):
    s = split.hash_split(P(spark, d).gold_v2)
    return split.take_split(s, "TRAIN").select("dispute_id", "reason_code_v2", "split")


@register("filter_keyword", sel("ev_base", "dispute_id, kw_pa", "WHERE kw_pa = 1"))
def _filter_keyword(spark, d):
    return P(spark, d).evidence_base.where(F.col("kw_pa") == 1).select("dispute_id", "kw_pa")


@register("filter_channel_or_flag", sel("ev_base", "dispute_id, channel, is_340b_flag",
                                        "WHERE channel = '340B' OR is_340b_flag = 1"))
def _filter_channel_or_flag(spark, d):
    b = P(spark, d).evidence_base
    return b.where((F.col("channel") == "340B") | (F.col("is_340b_flag") == 1)).select(
        "dispute_id", "channel", "is_340b_flag")


@register("filter_not_null", sel("ev_base", "dispute_id, coverage_generosity, therapeutic_class, timely_filing_days",
                                 "WHERE coverage_generosity IS NOT NULL AND therapeutic_class IS NOT NULL "
                                 "AND timely_filing_days IS NOT NULL"))
def _filter_not_null(spark, d):
    b = P(spark, d).evidence_base
    return b.where(F.col("coverage_generosity").isNotNull() & F.col("therapeutic_class").isNotNull()
                   & F.col("timely_filing_days").isNotNull()).select(
        "dispute_id", "coverage_generosity", "therapeutic_class", "timely_filing_days")


@register("filter_run_names", sel("runs", "run_id, run_name",
                                  "WHERE run_name IN ('reason_classifier_lr_saga', "
                                  "'reason_classifier_lr_after_collapse', 'reason_classifier_xgboost_v2')"))
def _filter_run_names(spark, d):
    return runs.runs_named(P(spark, d).runs).select("run_id", "run_name")


@register("fail_if_empty", O.with_ctes(f"SELECT {RUN_METRICS_SQL_COLS} FROM runs_latest"))
def _fail_if_empty(spark, d):
    return io.require_rows(runs.run_metrics(P(spark, d).runs), "No matching runs found.")


# ---------------------------------------------------------------- 2.F aggregations

@register("dq_profile", sel("silver", "count(*) AS rows, count(DISTINCT dispute_id) AS distinct_dispute_id, "
                                      "CAST(sum(CAST(reason_code IS NULL AS INTEGER)) AS BIGINT) AS null_reason_code"))
def _dq_profile(spark, d):
    return quality.profile(P(spark, d).silver)


NULL_AUDIT = {"delta_amount": "null_delta_amount", "delta_pct": "null_delta_pct", "is_340b_flag": "null_is_340b",
              "timely_flag": "null_timely_flag"}


@register("dq_null_audit", sel("gold", ", ".join(f"CAST(sum(CAST({c} IS NULL AS INTEGER)) AS BIGINT) AS {n}"
                                                 for c, n in NULL_AUDIT.items())))
def _dq_null_audit(spark, d):
    return quality.null_audit(P(spark, d).gold, list(NULL_AUDIT), NULL_AUDIT)


DESCRIBE_COLS = ["delta_pct", "is_340b_flag", "timely_flag", "kw_pa", "kw_ndc"]


def _describe_sql() -> str:
    parts = []
    for stat, fn in [("count", "CAST(count({c}) AS DOUBLE)"), ("mean", "avg({c})"), ("stddev", "stddev_samp({c})"),
                     ("min", "min({c})"), ("max", "max({c})")]:
        cols = ", ".join(f"round(CAST({fn.format(c=f'CAST({c} AS DOUBLE)')} AS DOUBLE), 6) AS {c}"
                         for c in DESCRIBE_COLS)
        parts.append(f"SELECT '{stat}' AS summary, {cols} FROM gold")
    return O.with_ctes("\nUNION ALL\n".join(parts))


@register("dq_describe", _describe_sql())
def _dq_describe(spark, d):
    return rounded(quality.describe_features(P(spark, d).gold, DESCRIBE_COLS), 6)


def _dist(key: str, src: str, cols: list[str], attr: str):
    @register(key, sel(src, f"{', '.join(cols)}, count(*) AS count", f"GROUP BY {', '.join(cols)}"))
    def _fn(spark, d):
        return quality.distribution(getattr(P(spark, d), attr), cols)
    return _fn


_dist("dist_reason_code", "gold", ["reason_code"], "gold")
_dist("dist_outcome", "gold", ["outcome"], "gold")
_dist("dist_reason_v2", "gold_v2", ["reason_code_v2"], "gold_v2")
_dist("dist_route", "routed", ["route_decision"], "routed")
_dist("dist_queue", "queue", ["priority", "owner_queue"], "queue")
_dist("sort_counts_desc", "gold_v2", ["state"], "gold_v2")

KPI_SUMS = ("round(sum(dispute_variance_amount), 2) AS total_variance_amount, "
            "round(sum(CASE WHEN recoverable_amount > 0 THEN recoverable_amount ELSE 0e0 END), 2) "
            "AS total_recoverable_amount")


@register("kpi_queue", sel("queue", f"owner_queue, priority, pred_reason_xgb, count(*) AS open_cases, "
                                    f"round(avg(conf_xgb), 6) AS avg_confidence, {KPI_SUMS}",
                           "GROUP BY owner_queue, priority, pred_reason_xgb"))
def _kpi_queue(spark, d):
    k = queue.queue_kpis(P(spark, d).queue)
    return k.withColumns({"avg_confidence": F.round("avg_confidence", 6),
                          "total_variance_amount": F.round("total_variance_amount", 2),
                          "total_recoverable_amount": F.round("total_recoverable_amount", 2)})


def _payer_kpis(spark, d):
    k = queue.payer_kpis(P(spark, d).queue)
    return rounded(k, 2)


PAYER_KPI_SQL = sel("queue", f"payer, count(*) AS open_cases, {KPI_SUMS}", "GROUP BY payer")
register("kpi_payer", PAYER_KPI_SQL)(_payer_kpis)
register("sort_kpi_desc", PAYER_KPI_SQL + "\nORDER BY total_recoverable_amount DESC")(_payer_kpis)


@register("evidence_agg", sel("ev_agg", "dispute_id, evidence_list, evidence_text_block"))
def _evidence_agg(spark, d):
    return P(spark, d).evidence_agg


# ---------------------------------------------------------------- 2.G windows

@register("evidence_top3", sel("top3", "*"))
def _top3(spark, d):
    return P(spark, d).top3


@register("latest_run_per_name", O.with_ctes("""
SELECT run_name, run_id, start_time FROM (
  SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY start_time DESC NULLS LAST, run_id) AS rn FROM runs) t
WHERE rn = 1"""))
def _latest_runs(spark, d):
    return runs.latest_runs(P(spark, d).runs).select("run_name", "run_id", "start_time")


@register("recent_runs_per_experiment", sel("runs_recent", "experiment_id, run_id, start_time"))
def _recent_runs(spark, d):
    return runs.recent_runs(P(spark, d).runs).select("experiment_id", "run_id", "start_time")


@register("dedup_runs", sel("runs", "DISTINCT run_id, run_name"))
def _dedup_runs(spark, d):
    return runs.dedup_runs(P(spark, d).runs).select("run_id", "run_name")


# ---------------------------------------------------------------- 2.H sorts and limits

@register("preview_scored", sel("routed", "dispute_id, pred_reason_lr, conf_lr, pred_reason_xgb, conf_xgb, "
                                          "scored_at_utc", "ORDER BY scored_at_utc DESC, dispute_id LIMIT 20"))
def _preview_scored(spark, d):
    r = P(spark, d).routed.select("dispute_id", "pred_reason_lr", "conf_lr", "pred_reason_xgb", "conf_xgb",
                                  "scored_at_utc")
    return io.preview(r, 20, [F.desc("scored_at_utc"), F.asc("dispute_id")])


@register("top_recent_runs", sel("runs", "run_id, run_name, status, start_time",
                                 "ORDER BY start_time DESC NULLS LAST, run_id LIMIT 5"))
def _top_recent_runs(spark, d):
    r = P(spark, d).runs
    return io.preview(r, 5, [F.desc_nulls_last("start_time"), F.asc("run_id")]).select(
        "run_id", "run_name", "status", "start_time")


@register("preview_n", sel("queue", QUEUE_COLS_SQL, "ORDER BY dispute_id LIMIT 10"))
def _preview_n(spark, d):
    return io.preview(P(spark, d).queue, 10, ["dispute_id"])


@register("limit_prompts", sel("prompts", "dispute_id, llm_prompt", "ORDER BY dispute_id LIMIT 1"))
def _limit_prompts(spark, d):
    return io.preview(P(spark, d).prompts.select("dispute_id", "llm_prompt"), 1, ["dispute_id"])


@register("sample_head", sel("train_v2", "dispute_id, " + ", ".join(C.SPEC_V2.features),
                             "ORDER BY dispute_id LIMIT 50"))
def _sample_head(spark, d):
    t = split.take_split(split.hash_split(P(spark, d).gold_v2), "TRAIN")
    return io.preview(t.select("dispute_id", *C.SPEC_V2.features), 50, ["dispute_id"])


# ---------------------------------------------------------------- 2.I set operations

CANDIDATES_SQL = sel("candidates", "*")


@register("evidence_union", CANDIDATES_SQL)
def _evidence_union(spark, d):
    p = P(spark, d)
    return evidence.evidence_candidates_union(p.evidence_base, ts=p.ts)


# ---------------------------------------------------------------- 2.J routing, queue, actions, prompts

def _col_of(key: str, src: str, attr: str, col: str):
    @register(key, sel(src, f"dispute_id, {col}"))
    def _fn(spark, d):
        return getattr(P(spark, d), attr).select("dispute_id", col)
    return _fn


for _k, _src, _attr, _col in [
    ("route_decision", "routed", "routed", "route_decision"),
    ("route_reason", "routed", "routed", "route_reason"),
    ("run_stamp", "routed", "routed", "routed_at_utc"),
    ("recoverable_amount", "queue", "queue", "recoverable_amount"),
    ("dispute_variance_amount", "queue", "queue", "dispute_variance_amount"),
    ("variance_direction", "queue", "queue", "variance_direction"),
    ("priority", "queue", "queue", "priority"),
    ("sla_days", "queue", "queue", "sla_days"),
    ("owner_queue", "queue", "queue", "owner_queue"),
    ("requires_human_review", "actionable", "actionable", "requires_human_review"),
    ("recommended_action", "actionable", "actionable", "recommended_action"),
    ("action_reason", "actionable", "actionable", "action_reason"),
    ("next_action_owner", "actionable", "actionable", "next_action_owner"),
]:
    _col_of(_k, _src, _attr, _col)


@register("routed_disputes", sel("routed", "*"))
def _routed(spark, d):
    return P(spark, d).routed


@register("work_queue", sel("queue", "*"))
def _work_queue(spark, d):
    return P(spark, d).queue


@register("created_events", EVENTS_SQL)
def _created_events(spark, d):
    return queue.created_events(P(spark, d).queue)


@register("actionable_queue", sel("actionable", "*"))
def _actionable(spark, d):
    return P(spark, d).actionable


@register("llm_prompts", sel("prompts", "*"))
def _prompts(spark, d):
    return P(spark, d).prompts


# ---------------------------------------------------------------- 2.K evidence rules

@register("ev_shape", sel("candidates", "dispute_id, evidence_type, evidence_text, evidence_score, evidence_ts"))
def _ev_shape(spark, d):
    return P(spark, d).candidates.select(*evidence.CANDIDATE_COLUMNS)


def _ev_rule(key: str, etype: str):
    @register(key, sel("candidates", "*", f"WHERE evidence_type = '{etype}'"))
    def _fn(spark, d):
        return P(spark, d).candidates.where(F.col("evidence_type") == etype)
    return _fn


for _k, _t in [("ev_model_confidence", C.EV_MODEL_CONFIDENCE), ("ev_amount_variance", C.EV_AMOUNT_VARIANCE),
               ("ev_timely_filing", C.EV_TIMELY_FILING), ("ev_kw_340b", "KW_340B"),
               ("ev_kw_duplicate", "KW_DUPLICATE"), ("ev_kw_timely", "KW_TIMELY"), ("ev_kw_pa", "KW_PA"),
               ("ev_kw_ndc", "KW_NDC"), ("ev_kw_eligibility", "KW_ELIGIBILITY"),
               ("ev_channel_340b", C.EV_CHANNEL_340B), ("ev_plan_context", C.EV_PLAN_CONTEXT),
               ("ev_ndc_context", C.EV_NDC_CONTEXT)]:
    _ev_rule(_k, _t)


@register("evidence_candidates", CANDIDATES_SQL)
def _candidates(spark, d):
    return P(spark, d).candidates


@register("enriched_queue", sel("enriched", "*"))
def _enriched(spark, d):
    return P(spark, d).enriched


# ---------------------------------------------------------------- 2.L run log reports (SQL-checkable)

@register("model_metrics", sel("runs", "run_id, run_name, f1_macro, start_time",
                               "WHERE experiment_id = 'E0' ORDER BY start_time DESC NULLS LAST, run_id LIMIT 5"))
def _model_metrics(spark, d):
    return runs.model_metrics(P(spark, d).runs, experiment_id="E0")


@register("run_time_iso", sel("(SELECT *, date_trunc('milliseconds', start_time) AS start_ms FROM runs) r",
                              f"run_id, {O.iso_sql('start_time')} AS start_time_utc, "
                              f"{O.iso_sql('start_ms')} AS start_time_ms_utc"))
def _run_time_iso(spark, d):
    """ISO text of the start time, and of the epoch milliseconds that a tracking server gives."""
    millis = F.unix_millis(F.col("start_time").cast("timestamp"))
    return P(spark, d).runs.select("run_id", runs.iso_utc("start_time").alias("start_time_utc"),
                                   runs.iso_utc_from_millis(millis).alias("start_time_ms_utc"))


@register("metric_or_null", sel("runs", "run_id, f1_macro, roc_auc, avg_precision"))
def _metric_or_null(spark, d):
    return P(spark, d).runs.select("run_id", runs.metric("f1_macro").alias("f1_macro"),
                                   runs.metric("roc_auc").alias("roc_auc"),
                                   runs.metric("avg_precision").alias("avg_precision"))


@register("params_text", sel("runs", "run_id, params, tags"))
def _params_text(spark, d):
    return P(spark, d).runs.select("run_id", F.to_json("params").alias("params"), F.to_json("tags").alias("tags"))


@register("run_metrics_latest", O.with_ctes(f"SELECT {RUN_METRICS_SQL_COLS} FROM runs_latest"))
def _run_metrics_latest(spark, d):
    return runs.run_metrics(P(spark, d).runs)


def queries() -> dict[str, QueryFn]:
    from . import catalog_ml  # noqa: F401  (registers the ML keys)
    return {k: fn for k, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    from . import catalog_ml  # noqa: F401
    return {k: sql for k, (_, sql) in REGISTRY.items() if sql is not None}
