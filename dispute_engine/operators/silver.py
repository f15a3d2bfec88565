"""Silver layer: typed, normalised dispute records and policy snippets.

Narrow transformations only (no shuffle): each is one projection that
Catalyst fuses into the scan's whole-stage-codegen span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import norm_channel, norm_code, norm_title, parse_date, to_double, to_int

DATE_COLS = ("service_date", "submitted_date")
AMOUNT_COLS = ("units", "billed_amount", "paid_amount", "expected_amount")


def parse_dates(df: DataFrame, cols: Sequence[str] = DATE_COLS, strict: bool = False) -> DataFrame:
    """String -> date; malformed text -> NULL (``strict`` raises instead)."""
    return df.withColumns({c: parse_date(c, strict) for c in cols})


def days_to_submit_expr(strict: bool = False):
    """The given day count when present, else submitted - service (may be negative).

    Expects service_date and submitted_date already parsed.
    """
    return (F.when(F.col("days_to_submit").isNotNull(), to_int("days_to_submit", strict))
            .otherwise(F.datediff(F.col("submitted_date"), F.col("service_date"))))


def days_to_submit(df: DataFrame, strict: bool = False) -> DataFrame:
    return df.withColumn("days_to_submit", days_to_submit_expr(strict))


def to_doubles(df: DataFrame, cols: Sequence[str] = AMOUNT_COLS, strict: bool = False) -> DataFrame:
    """Numeric casts; malformed text -> NULL unless ``strict``."""
    return df.withColumns({c: to_double(c, strict) for c in cols})


def clean_disputes(raw: DataFrame, strict: bool = False) -> DataFrame:
    """raw_disputes -> silver_clean_disputes.

    Every raw column passes through in place; dates, days_to_submit and
    amounts are retyped, program/channel/outcome/reason_code normalised.
    """
    dated = parse_dates(raw, DATE_COLS, strict)
    return dated.withColumns({
        "days_to_submit": days_to_submit_expr(strict),
        "program": norm_title("program"),
        "channel": norm_channel("channel"),
        "outcome": norm_code("outcome"),
        "reason_code": norm_code("reason_code"),
        **{c: to_double(c, strict) for c in AMOUNT_COLS},
    })


def clean_snippets(snips: DataFrame) -> DataFrame:
    """policy_snippets -> silver_policy_snippets."""
    return snips.withColumns({
        "program": norm_title("program"),
        "state": norm_code("state"),
        "payer": norm_code("payer"),
        "reason_code": norm_code("reason_code"),
        "snippet_text": F.trim(F.col("snippet_text")),
    })
