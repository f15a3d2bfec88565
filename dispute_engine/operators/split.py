"""Deterministic hash split into TRAIN / TEST (narrow, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..sources.io import qualified, write_table

LONG_MIN = -(1 << 63)


def split_bucket(id_col: str = "dispute_id", algo: str = "xxhash64") -> Column:
    """Bucket 0..99 of the id.

    ``xxhash64``: abs(xxhash64(id)) % 100. abs(Long.MIN) overflows under ANSI;
    it is mapped to 0, which lands on the same side as the non-ANSI result
    (-8). A NULL id hashes to the seed, 42. Not ``pmod``: that moves rows
    with a negative hash to the other side.
    ``md5``: first 32 bits of md5(id) as an unsigned number % 100 (portable to
    SQL engines without xxhash64); a NULL id maps to 42 as well.
    """
    x = F.col(id_col)
    if algo == "xxhash64":
        h = F.xxhash64(x)
        return F.when(h == F.lit(LONG_MIN), F.lit(0)).otherwise(F.abs(h)) % 100
    if algo == "md5":
        return F.coalesce(F.conv(F.substring(F.md5(x.cast("string")), 1, 8), 16, 10).cast("bigint") % 100,
                          F.lit(42).cast("bigint"))
    raise ValueError(f"unknown split algorithm {algo!r}")


def hash_split(df: DataFrame, id_col: str = "dispute_id", pct: int = C.SPLIT_TRAIN_PCT,
               algo: str = "xxhash64") -> DataFrame:
    """df + split ('TRAIN' when bucket < pct, else 'TEST')."""
    return df.withColumn("split", F.when(split_bucket(id_col, algo) < pct, F.lit("TRAIN")).otherwise(F.lit("TEST")))


def take_split(df: DataFrame, name: str) -> DataFrame:
    """Rows of one side; the predicate is pushed into the scan of a written split table."""
    return df.filter(F.col("split") == F.lit(name))


def write_split_tables(df: DataFrame, db: str | None, name: str, train: str, test: str, id_col: str = "dispute_id",
                       pct: int = C.SPLIT_TRAIN_PCT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Writes ``name`` partitioned by ``split`` and publishes ``train`` and ``test`` over its two partitions.

    The features are computed and stored once: train and test are views whose filter on the
    partition column prunes the other side's files. Returns (split, train, test) as read back."""
    spark = df.sparkSession
    write_table(hash_split(df, id_col, pct), db, name, partition_by=["split"])
    for view, side in ((train, "TRAIN"), (test, "TEST")):
        spark.sql(f"CREATE OR REPLACE VIEW {qualified(db, view)} AS SELECT * FROM {qualified(db, name)} "
                  f"WHERE split = '{side}'")
    return tuple(spark.table(qualified(db, n)) for n in (name, train, test))


def split_tables(df: DataFrame, id_col: str = "dispute_id", pct: int = C.SPLIT_TRAIN_PCT,
                 algo: str = "xxhash64") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(split, train, test), lazily. Write ``split`` first and read train/test
    back from it so the features are computed once."""
    s = hash_split(df, id_col, pct, algo)
    return s, take_split(s, "TRAIN"), take_split(s, "TEST")
