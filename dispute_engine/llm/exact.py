"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by SHA-256 digest, one row per distinct text: the row that stays and the rows
its first batch held. Every batch goes the same way. It is reduced to its own groups (map-side partial
aggregation, so a text that holds a third of all rows moves as one row per task); a sort-merge anti-join with the index,
which its buckets serve without a shuffle of the index, leaves the new texts, and they are appended. Texts the
index knows get their row from it, and how often this batch held them is appended to a second table, bucketed alike
(``<index>_seen``); counts are summed when the index is read, so neither table is ever rewritten.
An index that does not exist yet is created empty. A caller that names none gets a throwaway
one in the shared folder, dropped once the batch's groups are stored.

Defined results: NULL text counts as empty; of equal texts the row with the
largest doc_id stays (a NULL doc_id only if all are NULL); a text the index
holds already keeps the index's row, and group_size counts its rows over all batches. An empty batch appends nothing.
Repeated (doc_id, text) rows each get a result row with the same values; extra columns
are ignored by :func:`dedup` and kept by :func:`keep_first`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import join_groups, scratch, stored, text_or_empty

def fresh_index(spark: SparkSession) -> str:
    """A name for an index table that does not exist yet."""
    return f"digest_index_{uuid.uuid4().hex}"


def _tables(index: str) -> dict[str, str]:
    return {index: "digest binary, keep_id long, n long", f"{index}_seen": "digest binary, n long"}


def create_index(spark: SparkSession, index: str, path: str | None = None) -> None:
    """An empty index, bucketed and sorted by digest, in the warehouse or under ``path`` (no change where it exists)."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k, (table, columns) in enumerate(_tables(index).items()):
        if not spark.catalog.tableExists(table):
            place = f"LOCATION '{path}/{k}'" if path else ""
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
                      f"INTO {n} BUCKETS {place}")


def drop_index(spark: SparkSession, index: str) -> None:
    for table in _tables(index):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """digest, keep_id and rows seen over all batches of every text in the index; joins bucket to bucket."""
    again = spark.table(f"{index}_seen").groupBy("digest").agg(F.sum("n").alias("again")).hint("merge")
    return spark.table(index).join(again, "digest", "left") \
                .select("digest", "keep_id", (F.col("n") + F.coalesce("again", F.lit(0))).alias("n"))


def _append(rows: DataFrame, table: str) -> None:
    spark = rows.sparkSession
    width = int(spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()["data_type"])
    rows.repartition(width, "digest").sortWithinPartitions("digest").write.mode("append") \
        .bucketBy(width, "digest").sortBy("digest").saveAsTable(table)
    spark.catalog.refreshTable(table)


def _batch(docs: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    rows = stored(docs.select("doc_id", F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("digest")), "digests")
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return rows, groups


def append_new(spark: SparkSession, groups: DataFrame, index: str) -> DataFrame:
    """Appends the batch's groups to ``index``; returns them with the index's row and count where it knew the text.

    Columns: digest, keep_id, n (over all batches), batch_n, known."""
    create_index(spark, index)
    held = read_index(spark, index).withColumnsRenamed({"keep_id": "old_keep", "n": "old_n"}).hint("merge")
    new = groups.join(held, "digest", "left_anti") \
                .select("digest", "keep_id", "n", F.col("n").alias("batch_n"), F.lit(False).alias("known"))
    old = groups.join(held, "digest").select("digest", F.col("old_keep").alias("keep_id"),
                                             (F.col("n") + F.col("old_n")).alias("n"), F.col("n").alias("batch_n"),
                                             F.lit(True).alias("known"))
    merged = stored(new.unionByName(old), "digest-batch")
    _append(merged.where("NOT known").select("digest", "keep_id", "n"), index)
    _append(merged.where("known").select("digest", F.col("batch_n").alias("n")), f"{index}_seen")
    return merged


def _through_index(spark: SparkSession, groups: DataFrame, index: str | None) -> DataFrame:
    """:func:`append_new`, with an index that is created for the call and dropped after it if None is named."""
    if index is not None:
        return append_new(spark, groups, index)
    name = fresh_index(spark)
    create_index(spark, name, scratch(spark, "digest-index"))
    merged = append_new(spark, groups, name)
    drop_index(spark, name)
    return merged


def dedup(spark: SparkSession, docs: DataFrame, index: str | None = None, text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of ``docs``;
    the batch is appended to ``index`` (a throwaway one if None)."""
    rows, groups = _batch(docs, text_col)
    merged = _through_index(spark, groups, index)
    per_group = merged.select("digest", "keep_id", F.col("n").alias("group_size"), "known", F.col("batch_n").alias("rows"))
    joined = join_groups(rows, per_group, "digest", "rows")
    return joined.select("doc_id", "keep_id", "group_size",
                         (~F.col("known") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
                         F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(spark: SparkSession, docs: DataFrame, index: str | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; of repeated (doc_id, text) rows one.

    The kept row is found by an equi-join on (digest, doc_id), which spreads
    the copies of a hot text over all partitions."""
    _, groups = _batch(docs, text_col)
    fresh = _through_index(spark, groups, index).where(~F.col("known"))
    names = docs.columns
    whole = docs.select(F.struct(*[docs[c] for c in names]).alias("row"),
                        F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("digest"), F.col("doc_id").alias("id"))
    stay = fresh.select(F.col("digest").alias("k_digest"), F.col("keep_id").alias("k_id"))
    kept = whole.join(stay, (F.col("digest") == F.col("k_digest")) & F.col("id").eqNullSafe(F.col("k_id")),
                      "left_semi")
    return kept.dropDuplicates(["digest", "id"]).select("row.*")
