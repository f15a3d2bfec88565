"""Gold layer: reference lookups, amount deltas, flags, keyword features, labels.

The three lookups are LEFT joins. Reference tables are broadcast only when
Catalyst's size estimate is under the broadcast threshold; otherwise the
join is sort-merge and AQE splits skewed key partitions (including the
partition holding NULL keys, which can never match).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import contains_any, lower_coalesce, norm_code
from ..functions.joins import lookup_join
from ..sources.io import lookup

RULE_COLS = ("payer", "program", "timely_filing_days", "pa_strictness", "appeal_success_bias")
NDC_COLS = ("ndc11", "therapeutic_class", "manufacturer")
NDC_RENAMES = {"therapeutic_class": "ndc_therapeutic_class", "manufacturer": "ndc_manufacturer"}
PLAN_COLS = ("plan_id", "coverage_generosity")


def enrich_payer(df: DataFrame, rules: DataFrame, normalize_keys: bool = False) -> DataFrame:
    """LEFT JOIN payer rules USING (payer, program).

    Keys are matched as stored (payer is not normalised on either side), so
    a case or spacing difference is a silent miss; ``normalize_keys`` joins
    on upper(trim(payer)) instead. Duplicate rules fan out.
    """
    r = lookup(rules, RULE_COLS)
    if normalize_keys:
        r = r.withColumn("payer", norm_code("payer"))
        df = df.withColumn("_payer_key", norm_code("payer"))
        r = r.withColumnRenamed("payer", "_payer_key")
        return lookup_join(df, r, ["_payer_key", "program"]).drop("_payer_key")
    return lookup_join(df, r, ["payer", "program"])


def enrich_ndc(df: DataFrame, ndc: DataFrame) -> DataFrame:
    """LEFT JOIN drug reference USING (ndc11), attributes renamed ndc_*."""
    return lookup_join(df, lookup(ndc, NDC_COLS, NDC_RENAMES), ["ndc11"])


def enrich_plan(df: DataFrame, plan: DataFrame) -> DataFrame:
    """LEFT JOIN plan reference USING (plan_id)."""
    return lookup_join(df, lookup(plan, PLAN_COLS), ["plan_id"])


def delta_exprs() -> dict:
    exp, paid = F.col("expected_amount"), F.col("paid_amount")
    delta = exp - paid
    return {
        "delta_amount": delta,
        # the guard also avoids ANSI division by zero; NULL expected -> NULL,
        # negative expected -> negative ratio
        "delta_pct": F.when(exp == 0, F.lit(0.0)).otherwise(F.abs(delta) / exp),
    }


def add_deltas(df: DataFrame) -> DataFrame:
    return df.withColumns(delta_exprs())


def flag_exprs() -> dict:
    tfd = F.col("timely_filing_days")
    return {
        "is_340b_flag": (F.col("channel") == "340B").cast("int"),
        # NULL without a payer rule; NULL days -> NULL
        "timely_flag": F.when(tfd.isNull(), F.lit(None).cast("int"))
                        .otherwise((F.col("days_to_submit") <= tfd).cast("int")),
    }


def add_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(flag_exprs())


def keyword_exprs(rules: Sequence[tuple[str, Sequence[str], Sequence[str]]] = C.KEYWORD_RULES) -> dict:
    """Substring flags (0/1, never NULL) over lower-cased notes and rejection text."""
    notes = lower_coalesce("dispute_notes")
    rej = lower_coalesce("rejection_code_text")
    return {
        name: (contains_any([notes, rej], both) | contains_any([rej], rej_only)).cast("int")
        for name, both, rej_only in rules
    }


def add_keywords(df: DataFrame, rules=C.KEYWORD_RULES) -> DataFrame:
    return df.withColumns(keyword_exprs(rules))


def build_features(silver: DataFrame, rules: DataFrame | None, ndc: DataFrame | None,
                   plan: DataFrame | None, normalize_keys: bool = False) -> DataFrame:
    """silver + lookups + all features -> gold_features_disputes."""
    df = silver
    if rules is not None:
        df = enrich_payer(df, rules, normalize_keys)
    else:
        df = df.withColumns({c: F.lit(None).cast("string") for c in RULE_COLS[2:]}) \
               .withColumn("timely_filing_days", F.lit(None).cast("int"))
    df = enrich_ndc(df, ndc) if ndc is not None else df.withColumns(
        {v: F.lit(None).cast("string") for v in NDC_RENAMES.values()})
    df = enrich_plan(df, plan) if plan is not None else df.withColumn(
        "coverage_generosity", F.lit(None).cast("string"))
    # deltas first: delta_pct reads delta_amount's expression, flags read the rule columns
    return df.withColumns({**delta_exprs(), **flag_exprs(), **keyword_exprs()})


def collapse_labels(gold: DataFrame, keep: Sequence[str] = C.KEEP_REASON_CODES,
                    other: str = C.OTHER_REASON_CODE) -> DataFrame:
    """Re-normalise reason_code and keep it if listed, else ``other`` (also for NULL)."""
    rc = norm_code("reason_code")
    return gold.withColumns({
        "reason_code": rc,
        "reason_code_v2": F.when(rc.isin(*keep), rc).otherwise(F.lit(other)),
    })
