"""Data-quality profiles and distributions.

All are single aggregations: partial aggregation on the map side, so a hot
key costs one partial row per task, not one row per record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, id_col: str = "dispute_id", null_cols: Sequence[str] = ("reason_code",)) -> DataFrame:
    """rows, distinct ids (NULL not counted) and NULL counts, one row."""
    return df.select(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(id_col).alias(f"distinct_{id_col}"),
        *[F.sum(F.col(c).isNull().cast("int")).alias(f"null_{c}") for c in null_cols],
    )


def null_audit(df: DataFrame, cols: Sequence[str], names: dict[str, str] | None = None) -> DataFrame:
    """NULL count per column in one pass (NULL sum over empty input)."""
    names = names or {}
    return df.select(*[F.sum(F.col(c).isNull().cast("int")).alias(names.get(c, f"null_{c}")) for c in cols])


DESCRIBE_STATS = ("count", "mean", "stddev", "min", "max")


def describe_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count / mean / sample stddev / min / max per column, typed (double).

    One aggregation pass, then ``stack`` turns the single row into one row
    per statistic (the layout of ``DataFrame.describe``, without its
    conversion to strings).
    """
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).cast("double").alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__stddev"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    one = df.select(*aggs)
    rows = ", ".join(
        f"'{s}', " + ", ".join(f"`{c}__{s}`" for c in cols) for s in DESCRIBE_STATS)
    return one.selectExpr(f"stack({len(DESCRIBE_STATS)}, {rows}) AS (summary, {', '.join(cols)})")


def distribution(df: DataFrame, cols: Sequence[str] | str) -> DataFrame:
    """Row count per key, largest first (ties by key for a repeatable order)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.groupBy(*cols).count().orderBy(F.desc("count"), *[F.asc_nulls_first(c) for c in cols])
