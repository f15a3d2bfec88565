"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


HEAVY_SHARE = 64    # a key above 1/HEAVY_SHARE of the rows is heavy
SALTS = 64          # parts a heavy key is dealt over


def estimated_size_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of df's optimized plan (an upper bound for scans
    and filters), or None when the estimate is unavailable."""
    try:
        v = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    except Exception:  # noqa: BLE001 - e.g. Spark Connect has no JVM handle
        return None
    return v if isinstance(v, int) else int(v.toString())  # py4j converts Scala BigInt to int


def broadcast_threshold(df: DataFrame) -> int:
    v = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    try:
        return int(v)
    except ValueError:
        # size strings such as "10MB"
        units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
        s = v.strip().lower().rstrip("b") or "0"
        mult = units.get(s[-1], 1)
        return int(float(s[:-1] if s[-1] in units else s) * mult)


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Hint a broadcast when the estimated size is at most ``max_bytes``.

    Above the bound (or with no estimate) the side is left alone: Spark plans
    a sort-merge join, and AQE may still switch to a broadcast at runtime
    from the measured shuffle size. The bound defaults to the session's
    ``spark.sql.autoBroadcastJoinThreshold``; a negative value disables it.
    """
    limit = broadcast_threshold(df) if max_bytes is None else max_bytes
    if limit < 0:
        return df
    size = estimated_size_bytes(df)
    if size is not None and size <= limit:
        return F.broadcast(df)
    return df


def lookup_join(df: DataFrame, lookup: DataFrame, keys: list[str], max_bytes: int | None = None,
                salt_from: str = "dispute_id") -> DataFrame:
    """LEFT JOIN ``lookup`` USING ``keys`` (join keys appear once, left's values kept).

    A lookup under the size bound is broadcast: no shuffle of ``df``. Above
    it the join is sort-merge, and rows of ``df`` with a NULL key (which can
    never match) would all hash to one shuffle partition; their first key is
    replaced by a deterministic salt of ``salt_from`` (all columns where it
    is absent) that cannot match a lookup key, so they spread over all
    partitions. Heavy keys (``heavy_keys``) are salted ``SALTS``-fold, and only their lookup rows
    are replicated.
    """
    small = broadcast_if_small(lookup, max_bytes)
    k = keys[0]
    if small is not lookup or not _is_string(df, k) or not _is_string(lookup, k):
        return df.join(small, keys, "left")
    salt_cols = [salt_from] if salt_from in df.columns else df.columns
    salt = F.concat(F.lit("\u0000null:"), F.xxhash64(*salt_cols).cast("string"))
    no_match = reduce(or_, [F.col(c).isNull() for c in keys])
    heavy = heavy_keys(df, keys)

    def is_heavy(cols):
        return F.xxhash64(*cols).isin(heavy) if heavy else F.lit(False)

    left = df.withColumns({
        "_jk": F.when(no_match, salt).otherwise(F.col(k)),
        "_js": F.when(is_heavy(keys), F.pmod(F.xxhash64(*salt_cols, F.lit("salt")), F.lit(SALTS)).cast("int"))
                .otherwise(F.lit(0))})
    copies = F.when(is_heavy(keys), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.withColumn("_rs", F.explode(copies)).withColumnsRenamed({c: f"_rk_{c}" for c in keys})
    on = reduce(and_, [F.col("_jk" if c == k else c) == F.col(f"_rk_{c}") for c in keys])
    out = left.join(right, on & (F.col("_js") == F.col("_rs")), "left")
    return out.select(*keys, *[c for c in out.columns if c not in keys and c not in ("_jk", "_js", "_rs")
                               and not c.startswith("_rk_")])


def heavy_keys(df: DataFrame, keys: list[str], share: int = HEAVY_SHARE) -> list[int]:
    """Hashes of the keys (all non-NULL) that may hold more than 1/``share`` of the rows.

    One pass of a frequent-items summary (mergeable, 64 x ``share`` counters). Its estimates err on the high side
    only, by less than a tenth of the share: every key above the share is found, and at most 2 x ``share`` are returned."""
    code = F.xxhash64(*keys).alias("code")
    present = reduce(and_, [F.col(c).isNotNull() for c in keys])
    size = 64 * share
    found = df.where(present).select(code).agg(F.expr(f"approx_top_k(code, {2 * share}, {size})").alias("top"),
                                               F.count(F.lit(1)).alias("n")).first()
    return [r["item"] for r in found["top"] or [] if r["count"] * share > found["n"]]


def _is_string(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() == "string"
