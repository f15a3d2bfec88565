"""The run log: training runs as a table, and the reports read from it.

Canonical schema (``RUN_LOG_SCHEMA``): experiment, run id and name, status,
start/end time, and metrics/params/tags/artifacts as maps. Reports are
window and filter plans over it; nothing is collected. Artifact texts are
rendered from K-row reports and K x K matrices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..sources.io import qualified, write_table

RUN_LOG_SCHEMA = T.StructType([
    T.StructField("experiment_id", T.StringType()),
    T.StructField("experiment_name", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("run_name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("start_time", T.TimestampNTZType()),
    T.StructField("end_time", T.TimestampNTZType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("artifacts", T.MapType(T.StringType(), T.StringType())),
])

RUN_METRICS_COLUMNS = ("experiment_id", "experiment_name", "run_id", "run_name", "status", "start_time_utc",
                       "end_time_utc", "f1_macro", "roc_auc", "avg_precision", "params", "tags")


def runs_from_flat(df: DataFrame) -> DataFrame:
    """Flat run rows (metric columns, params as JSON text) -> canonical run log."""
    metric_cols = [c for c in ("f1_macro", "roc_auc", "avg_precision") if c in df.columns]
    kv = []
    for c in metric_cols:
        kv += [F.lit(c), F.col(c).cast("double")]
    metrics = F.map_filter(F.create_map(*kv), lambda k, v: v.isNotNull()) if kv else \
        F.create_map().cast("map<string,double>")
    params = F.from_json(F.col("params_json"), "map<string,string>") if "params_json" in df.columns else \
        F.create_map().cast("map<string,string>")
    artifacts = F.create_map().cast("map<string,string>")
    tags = F.when(F.col("run_name").isNotNull(), F.create_map(F.lit("mlflow.runName"), F.col("run_name"))) \
            .otherwise(F.create_map().cast("map<string,string>"))
    end = F.col("end_time") if "end_time" in df.columns else F.lit(None).cast("timestamp_ntz")
    return df.select("experiment_id", "experiment_name", "run_id", "run_name", "status",
                     F.col("start_time").cast("timestamp_ntz").alias("start_time"), end.alias("end_time"),
                     metrics.alias("metrics"), params.alias("params"), tags.alias("tags"),
                     artifacts.alias("artifacts"))


def run_name_expr(tags: str = "tags") -> Column:
    """Run name from tags: mlflow.runName, else mlflow.run_name."""
    t = F.col(tags)
    return F.coalesce(F.try_element_at(t, F.lit("mlflow.runName")), F.try_element_at(t, F.lit("mlflow.run_name")))


def metric(name: str, metrics: str = "metrics") -> Column:
    """A metric as double, NULL when the run lacks it (stable schema)."""
    return F.try_element_at(F.col(metrics), F.lit(name)).cast("double")


def iso_utc(c: str | Column) -> Column:
    """Timestamp -> ISO-8601 text with a +00:00 offset; microseconds only when
    non-zero (Python ``isoformat`` layout); NULL stays NULL. Wall-clock fields
    are read in the session time zone, UTC in our sessions."""
    x = F.col(c) if isinstance(c, str) else c
    frac = F.date_format(x, "SSSSSS")
    return F.concat(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")),
                    F.lit("+00:00"))


def iso_utc_from_millis(c: str | Column) -> Column:
    """Epoch milliseconds -> ISO-8601 UTC text (NULL stays NULL), independent
    of the session time zone: the UTC wall clock is built as a TIMESTAMP_NTZ
    (epoch + interval) and formatted like ``iso_utc``."""
    x = F.col(c) if isinstance(c, str) else c
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    wall = epoch + F.make_dt_interval(secs=(x / 1000).cast("decimal(20,6)"))
    return F.when(x.isNull(), F.lit(None).cast("string")).otherwise(iso_utc(wall))


def _newest_first(*extra: str):
    return [F.desc_nulls_last("start_time"), *[F.asc(c) for c in extra]]


def runs_named(runs: DataFrame, names: Sequence[str] = C.TARGET_RUN_NAMES) -> DataFrame:
    """Runs whose name (from tags) is in ``names``."""
    return runs.withColumn("run_name", run_name_expr()).where(F.col("run_name").isin(*names))


def recent_runs(runs: DataFrame, k: int = C.RECENT_RUNS_PER_EXPERIMENT, by: str = "experiment_id") -> DataFrame:
    """At most k newest runs per experiment (missing start last, run_id breaks ties)."""
    w = Window.partitionBy(by).orderBy(*_newest_first("run_id"))
    return runs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def dedup_runs(runs: DataFrame, keys: Sequence[str] = ("run_id", "run_name")) -> DataFrame:
    """One row per key (the newest)."""
    w = Window.partitionBy(*keys).orderBy(*_newest_first())
    return runs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def latest_runs(runs: DataFrame, by: str = "run_name") -> DataFrame:
    """Newest run per name (missing start last, run_id breaks ties)."""
    w = Window.partitionBy(by).orderBy(*_newest_first("run_id"))
    return runs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def run_metrics(runs: DataFrame, names: Sequence[str] = C.TARGET_RUN_NAMES,
                k: int = C.RECENT_RUNS_PER_EXPERIMENT) -> DataFrame:
    """Latest run per target name among each experiment's k newest runs:
    12 columns, metrics NULL when absent, ISO UTC times, maps as JSON text."""
    picked = latest_runs(dedup_runs(runs_named(recent_runs(runs, k), names)))
    return picked.select(
        "experiment_id", "experiment_name", "run_id", "run_name", "status",
        iso_utc("start_time").alias("start_time_utc"), iso_utc("end_time").alias("end_time_utc"),
        metric("f1_macro").alias("f1_macro"), metric("roc_auc").alias("roc_auc"),
        metric("avg_precision").alias("avg_precision"),
        F.to_json("params").alias("params"), F.to_json("tags").alias("tags"))


def model_metrics(runs: DataFrame, experiment_id: str | None = None, k: int = C.MODEL_METRICS_TOP) -> DataFrame:
    """The k newest runs (of one experiment): run_id, run_name, f1_macro, start_time."""
    if experiment_id is not None:
        runs = runs.where(F.col("experiment_id") == experiment_id)
    return (runs.orderBy(*_newest_first("run_id")).limit(k)
            .select("run_id", run_name_expr().alias("run_name"), metric("f1_macro").alias("f1_macro"),
                    "start_time"))


def run_log_row(spark, *, experiment_id: str, experiment_name: str, run_id: str, run_name: str,
                status: str, start_time, end_time, metrics: dict, params: dict,
                artifacts: dict | None = None) -> DataFrame:
    """One run-log row with an explicit schema (the only driver-built rows)."""
    return spark.createDataFrame(
        [(experiment_id, experiment_name, run_id, run_name, status, start_time, end_time,
          {k: float(v) for k, v in metrics.items()}, {k: str(v) for k, v in params.items()},
          {"mlflow.runName": run_name}, dict(artifacts or {}))],
        RUN_LOG_SCHEMA)


def rows_to_table(spark, rows: Sequence, db: str | None, name: str) -> DataFrame:
    """Run records held on the driver (one per run of a report) as a table with the explicit schema."""
    frame = spark.createDataFrame([tuple(r[f.name] for f in RUN_LOG_SCHEMA.fields) for r in rows], RUN_LOG_SCHEMA)
    write_table(frame, db, name)
    return spark.table(qualified(db, name))


def exploded_maps(runs: DataFrame) -> DataFrame:
    """run_id, kind, key and value (text) of every metric, parameter and tag of a run log."""
    parts = [runs.select("run_id", F.lit(kind).alias("kind"), F.explode(column).alias("key", "v"))
             .select("run_id", "kind", "key", (F.round("v", 6) if column == "metrics" else F.col("v"))
                     .cast("string").alias("value"))
             for kind, column in (("metric", "metrics"), ("param", "params"), ("tag", "tags"))]
    return parts[0].union(parts[1]).union(parts[2])


def report_text(report_rows) -> str:
    """Fixed-width text of classification-report rows (class, precision,
    recall, f1_score, support); the accuracy row shows only f1 and support."""
    width = max([12] + [len(str(r["class"])) for r in report_rows])
    lines = [f"{'':>{width}} {'precision':>9} {'recall':>9} {'f1-score':>9} {'support':>9}", ""]
    def f(v):
        return f"{v:9.2f}" if v is not None else " " * 9

    for r in report_rows:
        if r["class"] == "accuracy":
            lines.append("")
        lines.append(f"{r['class']:>{width}} {f(r['precision'])} {f(r['recall'])} {f(r['f1_score'])} "
                     f"{r['support']:9d}")
    return "\n".join(lines) + "\n"


def confusion_csv(rows, labels) -> str:
    """Confusion-matrix rows (true_label + one column per label) as CSV text
    with the label index, the layout of a labelled matrix written to CSV."""
    out = ["," + ",".join(labels)]
    by_label = {r["true_label"]: r for r in rows}
    for lbl in labels:
        r = by_label.get(lbl)
        out.append(lbl + "," + ",".join(str(r[c] if r is not None else 0) for c in labels))
    return "\n".join(out) + "\n"
