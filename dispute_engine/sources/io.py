"""Catalog reads and writes: scans, sinks, optional tables, the event log.

All writes are full-refresh ``saveAsTable`` except the event log, which is
appended. Writes are the durable barriers of the pipeline: a later stage
reads the written table instead of re-running its lineage, so a lost
executor re-runs at most one stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_FORMAT
from ..session import checkpoint_dir

EVENTS_SCHEMA = T.StructType([
    T.StructField("dispute_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("old_status", T.StringType()),
    T.StructField("new_status", T.StringType()),
    T.StructField("actor", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("event_ts", T.TimestampType()),
])

LABEL_MAPPING_SCHEMA = T.StructType([
    T.StructField("class_index", T.IntegerType()),
    T.StructField("class_name", T.StringType()),
])


def qualified(db: str | None, name: str) -> str:
    return f"{db}.{name}" if db else name


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    files, target = _folder(spark, path)
    return files.exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of files that nothing reads any more, on whatever file system it lies."""
    files, target = _folder(spark, path)
    files.delete(target, True)


def stored(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """``df`` written as Parquet to a fresh path of the shared folder and read back: a step computed once."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stored/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, db: str | None, name: str) -> DataFrame:
    return spark.table(qualified(db, name))


def lookup(df: DataFrame, cols: Sequence[str], renames: dict[str, str] | None = None) -> DataFrame:
    """Project a lookup to the columns a join needs, renaming collisions."""
    renames = renames or {}
    return df.select(*[F.col(c).alias(renames.get(c, c)) for c in cols])


def write_table(df: DataFrame, db: str | None, name: str, mode: str = "overwrite",
                fmt: str = DEFAULT_FORMAT, partition_by: Sequence[str] | None = None,
                bucket_by: tuple[int, Sequence[str]] | None = None) -> None:
    """Full-refresh (or append) a managed table.

    ``bucket_by=(n, cols)`` writes the table bucketed (and sorted) by cols,
    so later joins and groupings on those columns read co-located buckets
    without a shuffle.
    """
    w = df.write.format(fmt).mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        n, cols = bucket_by
        w = w.bucketBy(n, *cols).sortBy(*cols)
    w.saveAsTable(qualified(db, name))


def ensure_table(spark: SparkSession, db: str | None, name: str, schema: T.StructType,
                 fmt: str = DEFAULT_FORMAT) -> None:
    """CREATE TABLE IF NOT EXISTS with an explicit schema."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString().upper()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {qualified(db, name)} ({cols}) USING {fmt}")


EVENT_DATE = "event_date"


def ensure_event_log(spark: SparkSession, db: str | None, name: str, fmt: str = DEFAULT_FORMAT) -> None:
    """The event log as a table partitioned by the date of the event (read it with ``read_events``)."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString().upper()}" for f in EVENTS_SCHEMA.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {qualified(db, name)} ({cols}, {EVENT_DATE} DATE) USING {fmt} "
              f"PARTITIONED BY ({EVENT_DATE})")


def read_events(spark: SparkSession, db: str | None, name: str) -> DataFrame:
    """The log's event columns, whether or not it is partitioned by date."""
    return read_table(spark, db, name).select([f.name for f in EVENTS_SCHEMA.fields])


def logged_on_dates_of(batch: DataFrame, log: DataFrame, ts_col: str = "event_ts") -> DataFrame:
    """The rows of a date-partitioned ``log`` on the dates that ``batch`` holds; other partitions are not read.

    The dates of one batch are collected (one value per day) and become partition filters."""
    days = [r["day"] for r in batch.select(F.to_date(ts_col).alias("day")).distinct().collect()]
    known = [F.lit(d) for d in days if d is not None]
    wanted = F.col(EVENT_DATE).isin(known) if known else F.lit(False)
    return log.where(wanted | F.col(EVENT_DATE).isNull() if None in days else wanted)


def append_events(df: DataFrame, db: str | None, name: str,
                  key_cols: Sequence[str] = ("dispute_id", "event_type", "event_ts"),
                  idempotent: bool = False) -> None:
    """Append event rows; ``idempotent`` skips rows whose key is already logged.

    The default keeps the plain append (a rerun duplicates events). The
    idempotent path is a left-anti join on the key columns, always sort-merge: a log compresses so well that its
    file size passes for a broadcast while its keys would fill the driver. In a log
    partitioned by date it reads only the dates of the batch (the key must then hold the event's time).
    """
    spark = df.sparkSession
    target = qualified(db, name)
    by_date = spark.catalog.tableExists(target) and EVENT_DATE in spark.table(target).columns
    if idempotent and spark.catalog.tableExists(target):
        existing = spark.table(target)
        if by_date and "event_ts" in key_cols:
            existing = logged_on_dates_of(df, existing)
        df = df.join(existing.select(*key_cols).hint("merge"), on=list(key_cols), how="left_anti")
    out = df.select([f.name for f in EVENTS_SCHEMA.fields])
    if by_date:
        out = out.withColumn(EVENT_DATE, F.to_date("event_ts"))
        out.write.mode("append").partitionBy(EVENT_DATE).saveAsTable(target)
    else:
        out.write.mode("append").insertInto(target)


def append_keyed(df: DataFrame, db: str | None, name: str, keys: Sequence[str], fmt: str = DEFAULT_FORMAT) -> int:
    """Append the rows whose key the table lacks, safe to repeat; returns how many were new.

    The rows are staged in a table of their own first, so they are computed once, and the publish is one
    insert of the staged rows that a left-anti join on the keys lets through. A call that failed
    after its publish adds nothing when repeated; one that failed before leaves the target as it was.
    """
    spark = df.sparkSession
    target, stage = qualified(db, name), qualified(db, f"{name}_stage_{uuid.uuid4().hex}")
    df.dropDuplicates(list(keys)).write.format(fmt).saveAsTable(stage)
    try:
        fresh = spark.table(stage)
        if spark.catalog.tableExists(target):
            same = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
            fresh = fresh.alias("s").join(spark.table(target).select(*keys).alias("t").hint("merge"), same, "left_anti")
        count = fresh.count()
        if count or not spark.catalog.tableExists(target):
            fresh.write.format(fmt).mode("append").saveAsTable(target)
        return count
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {stage}")


def resolve_source(spark: SparkSession, db: str | None, candidates: Iterable[str]) -> str:
    """First existing table among candidates (catalog lookup, no job)."""
    names = list(candidates)
    for n in names:
        if spark.catalog.tableExists(qualified(db, n)):
            return qualified(db, n)
    raise ValueError(f"none of the tables exist: {names}")


def optional_table(spark: SparkSession, db: str | None, name: str,
                   cols: Sequence[str] | None = None) -> DataFrame | None:
    """The table projected to ``cols`` if it exists, else None."""
    t = qualified(db, name)
    if not spark.catalog.tableExists(t):
        return None
    df = spark.table(t)
    return df.select(*cols) if cols else df


def load_label_mapping(spark: SparkSession, path: str) -> DataFrame:
    """class_index,class_name CSV with a header, typed int/string."""
    return spark.read.schema(LABEL_MAPPING_SCHEMA).option("header", True).csv(path)


def require_columns(df: DataFrame, cols: Iterable[str], name: str = "input") -> None:
    """Raise before any job runs when required columns are absent."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns in {name}: {missing}")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Raise when df is empty (one limited job); returns df unchanged."""
    if df.isEmpty():
        raise RuntimeError(message)
    return df


def preview(df: DataFrame, n: int, order_by: Sequence | None = None) -> DataFrame:
    """First n rows; with ``order_by`` the rows are repeatable (TakeOrdered)."""
    if order_by:
        df = df.orderBy(*order_by)
    return df.limit(n)


DASHBOARD_COLUMNS = (
    "dispute_id", "created_at", "priority", "owner_queue", "work_status", "pred_reason_xgb",
    "conf_xgb", "recommended_action", "next_action_owner", "requires_human_review",
    "dispute_variance_amount", "recoverable_amount",
)


def dashboard(actionable: DataFrame, enriched: DataFrame | None = None) -> DataFrame:
    """Dashboard rows: 12 actionable columns plus the evidence block.

    ``actionable`` already carries ``evidence_text_block`` (it is derived
    from the enriched queue), so the default is a projection. Passing
    ``enriched`` reproduces the LEFT JOIN form exactly, including its
    fan-out when dispute ids repeat.
    """
    if enriched is None:
        return actionable.select(*DASHBOARD_COLUMNS, "evidence_text_block")
    q = actionable.alias("q")
    e = enriched.select("dispute_id", "evidence_text_block").alias("e")
    return q.join(e, F.col("q.dispute_id") == F.col("e.dispute_id"), "left").select(
        *[F.col(f"q.{c}") for c in DASHBOARD_COLUMNS], F.col("e.evidence_text_block"))


def create_dashboard_view(spark: SparkSession, db: str | None, view: str = "v_queue_dashboard",
                          actionable: str = "dispute_work_queue_actionable",
                          enriched: str = "dispute_work_queue_enriched", exact_join: bool = False) -> None:
    """CREATE OR REPLACE VIEW over the actionable (and enriched) tables."""
    cols = ",\n  ".join(f"q.{c}" for c in DASHBOARD_COLUMNS)
    if exact_join:
        body = (f"SELECT /*+ MERGE(e) */ {cols},\n  e.evidence_text_block\nFROM {qualified(db, actionable)} q\n"
                f"LEFT JOIN {qualified(db, enriched)} e ON q.dispute_id = e.dispute_id")
    else:
        body = f"SELECT {cols},\n  q.evidence_text_block\nFROM {qualified(db, actionable)} q"
    spark.sql(f"CREATE OR REPLACE VIEW {qualified(db, view)} AS\n{body}")
