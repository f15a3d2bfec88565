"""Work queue, queue KPIs and the CREATED event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import nan_to_null, owner_for, run_ts

GOLD_QUEUE_COLS = ("dispute_id", "payer", "program", "state", "channel", "ndc11", "expected_amount",
                   "paid_amount", "delta_pct", "days_to_submit", "timely_flag")

QUEUE_COLUMNS = (
    "dispute_id", "work_status", "owner_queue", "priority", "sla_days",
    "pred_reason_xgb", "conf_xgb", "pred_reason_lr", "conf_lr",
    "payer", "program", "state", "channel", "ndc11", "expected_amount", "paid_amount",
    "recoverable_amount", "dispute_variance_amount", "variance_direction",
    "delta_pct", "days_to_submit", "timely_flag", "created_at",
)


def join_scored_gold(scored: DataFrame, gold: DataFrame) -> DataFrame:
    """scored s LEFT JOIN gold g USING (dispute_id); g projected to business context.

    Both sides are large, however small their files: a sort-merge join on dispute_id (no shuffle when
    both tables are bucketed by dispute_id with equal bucket counts).
    """
    s = scored.alias("s")
    g = gold.select(*GOLD_QUEUE_COLS).alias("g").hint("merge")
    return s.join(g, on="dispute_id", how="left")


def priority_expr(conf, variance):
    return (F.when((conf >= C.P1_CONF) & (variance >= C.P1_VARIANCE), F.lit("P1"))
            .when((conf >= C.P2_CONF) & (variance >= C.P2_VARIANCE), F.lit("P2"))
            .otherwise(F.lit("P3")))


def sla_expr(priority):
    out = None
    for p, days in C.SLA_DAYS.items():
        out = F.when(priority == p, F.lit(days)) if out is None else out.when(priority == p, F.lit(days))
    return out.otherwise(F.lit(C.SLA_DEFAULT))


def variance_direction_expr(rec):
    return (F.when(rec > 0, F.lit("UNDERPAID_RECOVER"))
            .when(rec < 0, F.lit("OVERPAID_VERIFY"))
            .otherwise(F.lit("MATCH")))


def build_queue(scored: DataFrame, gold: DataFrame, ts=None) -> DataFrame:
    """Prioritised work queue: 23 columns, one row per scored dispute."""
    df = join_scored_gold(scored, gold)
    rec = (F.col("g.expected_amount") - F.col("g.paid_amount")).cast("double")
    var = F.abs(rec).cast("double")
    conf = nan_to_null(F.col("s.conf_xgb"))
    pred = F.col("s.pred_reason_xgb")
    prio = priority_expr(conf, var)
    return df.select(
        "dispute_id",
        F.lit("OPEN").alias("work_status"),
        owner_for(pred).alias("owner_queue"),
        prio.alias("priority"),
        sla_expr(prio).alias("sla_days"),
        pred.alias("pred_reason_xgb"),
        conf.alias("conf_xgb"),
        F.col("s.pred_reason_lr").alias("pred_reason_lr"),
        F.col("s.conf_lr").alias("conf_lr"),
        *[F.col(f"g.{c}").alias(c) for c in ("payer", "program", "state", "channel", "ndc11",
                                            "expected_amount", "paid_amount")],
        rec.alias("recoverable_amount"),
        var.alias("dispute_variance_amount"),
        variance_direction_expr(rec).alias("variance_direction"),
        *[F.col(f"g.{c}").alias(c) for c in ("delta_pct", "days_to_submit", "timely_flag")],
        run_ts(ts).alias("created_at"),
    )


def _positive_recoverable():
    rec = F.col("recoverable_amount")
    return F.sum(F.when(rec > 0, rec).otherwise(F.lit(0.0)))


def queue_kpis(q: DataFrame) -> DataFrame:
    """Per (owner_queue, priority, pred_reason_xgb): open cases, mean confidence
    (NULLs skipped), total variance, total positive recoverable; largest first."""
    return (q.groupBy("owner_queue", "priority", "pred_reason_xgb")
            .agg(F.count(F.lit(1)).alias("open_cases"),
                 F.avg("conf_xgb").alias("avg_confidence"),
                 F.sum("dispute_variance_amount").alias("total_variance_amount"),
                 _positive_recoverable().alias("total_recoverable_amount"))
            .orderBy(F.desc("total_recoverable_amount")))


def payer_kpis(q: DataFrame) -> DataFrame:
    """Per payer: open cases, total variance, total positive recoverable; largest first."""
    return (q.groupBy("payer")
            .agg(F.count(F.lit(1)).alias("open_cases"),
                 F.sum("dispute_variance_amount").alias("total_variance_amount"),
                 _positive_recoverable().alias("total_recoverable_amount"))
            .orderBy(F.desc("total_recoverable_amount")))


def created_events(q: DataFrame) -> DataFrame:
    """One CREATED event per queue row (narrow projection)."""
    return q.select(
        "dispute_id",
        F.lit(C.EVENT_CREATED).alias("event_type"),
        F.lit(None).cast("string").alias("old_status"),
        F.col("work_status").alias("new_status"),
        F.lit(C.EVENT_ACTOR).alias("actor"),
        F.lit(C.EVENT_CREATED_NOTE).alias("notes"),
        F.col("created_at").alias("event_ts"),
    )
