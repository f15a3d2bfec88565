"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_title(c: str | Column) -> Column:
    """initcap(trim(x)): every word capitalised, the rest lower-cased."""
    return F.initcap(F.trim(col(c)))


def norm_code(c: str | Column) -> Column:
    """upper(trim(x))."""
    return F.upper(F.trim(col(c)))


def norm_channel(c: str | Column) -> Column:
    """'340B' when the text contains 340b (any case), 'Unknown' for NULL, else 'Non-340B'.

    Not idempotent by design: the text 'Non-340B' contains '340b'.
    """
    x = col(c)
    return (F.when(F.lower(x).contains("340b"), F.lit("340B"))
            .when(x.isNull(), F.lit("Unknown"))
            .otherwise(F.lit("Non-340B")))


def to_double(c: str | Column, strict: bool = False) -> Column:
    """Cast to double; malformed text gives NULL unless ``strict`` (then it raises)."""
    x = col(c)
    return x.cast("double") if strict else x.try_cast("double")


def to_int(c: str | Column, strict: bool = False) -> Column:
    x = col(c)
    return x.cast("int") if strict else x.try_cast("int")


def parse_date(c: str | Column, strict: bool = False) -> Column:
    """String (or date) to date; malformed text gives NULL unless ``strict``."""
    x = col(c)
    return F.to_date(x) if strict else F.try_to_date(x)


def lower_coalesce(c: str | Column) -> Column:
    """lower(coalesce(x, '')): NULL text searches as empty."""
    return F.lower(F.coalesce(col(c), F.lit("")))


def contains_any(texts: Sequence[Column], needles: Sequence[str]) -> Column:
    """OR of ``text.contains(needle)`` over all pairs (FALSE for no pairs)."""
    terms = [t.contains(n) for t in texts for n in needles]
    out = F.lit(False)
    for t in terms:
        out = out | t
    return out


def owner_for(c: str | Column) -> Column:
    """Owner team for a predicted reason; NULL and unknown go to the default team."""
    x = col(c)
    expr = None
    for reasons, team in C.OWNER_RULES:
        cond = x == reasons[0] if len(reasons) == 1 else x.isin(*reasons)
        expr = F.when(cond, F.lit(team)) if expr is None else expr.when(cond, F.lit(team))
    return expr.otherwise(F.lit(C.OWNER_DEFAULT))


def nan_to_null(c: str | Column) -> Column:
    """NaN -> NULL (Spark orders NaN above every number, so NaN >= 0.75 is true)."""
    x = col(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def run_ts(ts: str | Column | None) -> Column:
    """The run timestamp: a literal string parsed in the session time zone,
    a Column as given, or ``current_timestamp()`` (one value per query)."""
    if ts is None:
        return F.current_timestamp()
    if isinstance(ts, Column):
        return ts
    return F.to_timestamp(F.lit(ts))
