"""Helpers the operators of this package share: scratch tables and hot-group joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources.io import remove_path

#: At most this many groups can each hold more than 1/HOT_GROUPS of all rows.
HOT_GROUPS = 10_000

#: Spark's setting that removes the shuffle files of a finished query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder the cluster names in ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: later plans
    read a table that survives lost executors, not the lineage. The shuffle files
    of the finished write are of no more use and are removed with it."""
    path = scratch(df.sparkSession, name)
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None) if CLEANUP in spark.conf.getAll else None
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class StageTables:
    """Tables between the steps of one operator run: written like :func:`stored`, deleted together once a
    later written table has taken their place, or when the run fails."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        self.paths.append(path)
        _write(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str | None = None) -> None:
        """Deletes the table at ``path``, or all that are left."""
        for p in [path] if path else list(self.paths):
            remove_path(self.spark, p)
            self.paths.remove(p)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Left join of ``rows`` to one row per group, whatever the group sizes.

    ``groups[size]`` counts the rows of each key. Groups holding more than
    1/``HOT_GROUPS`` of all rows are fewer than ``HOT_GROUPS`` by arithmetic, so
    they are broadcast and their rows never move; all other groups are small
    and join by a shuffle."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = total // HOT_GROUPS
    extra = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > limit).withColumn("_hot", F.lit(True))
    tagged = rows.join(F.broadcast(hot), key, "left")
    rest = tagged.where(F.col("_hot").isNull()).drop("_hot", *extra) \
                 .join(groups.where(F.col(size) <= limit), key, "left")
    return tagged.where(F.col("_hot")).drop("_hot").unionByName(rest)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))
