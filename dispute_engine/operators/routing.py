"""Confidence routing of scored disputes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import nan_to_null, run_ts


def route(scored: DataFrame, hi: float = C.ROUTE_HIGH, mid: float = C.ROUTE_MID, ts=None,
          conf_col: str = "conf_xgb") -> DataFrame:
    """scored.* + route_decision, route_reason, routed_at_utc.

    NaN confidence is turned into NULL first (a NaN compares above every
    number in Spark and would otherwise auto-route), so it routes as missing.
    """
    conf = F.col(conf_col)
    decision = (F.when(conf.isNull(), F.lit("REQUEST_INFO"))
                .when(conf >= F.lit(hi), F.lit("AUTO_ROUTE"))
                .when(conf >= F.lit(mid), F.lit("REVIEW"))
                .otherwise(F.lit("REQUEST_INFO")))
    reason = (F.when(conf.isNull(), F.lit("missing_confidence"))
              .when(conf >= F.lit(hi), F.lit("high_confidence"))
              .when(conf >= F.lit(mid), F.lit("medium_confidence"))
              .otherwise(F.lit("low_confidence")))
    return (scored.withColumn(conf_col, nan_to_null(conf_col))
            .withColumns({"route_decision": decision, "route_reason": reason, "routed_at_utc": run_ts(ts)}))
