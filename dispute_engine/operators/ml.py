"""Classifiers as Spark ML jobs: preprocessing statistics, training, scoring.

Training rows never leave the executors. Fitted statistics (one median,
mode, mean and std per feature, histogram buckets on the way to them; class
list and weights) are the only values brought to the driver. For logistic regression they are embedded in a
``SQLTransformer``, so preprocessing + model is one saveable ``PipelineModel``.

Preprocessing mirrors the notebook's scikit-learn pipelines: numeric NULL ->
training median (then optional standard scaling with population std),
categorical NULL -> most frequent training value, one-hot with unseen
categories encoded as all zeros, classes indexed in sorted order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import (IndexToString, OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark import SparkContext, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import BoostedParams, FeatureSpec, LRParams
from ..functions import nan_to_null, run_ts
from ..sources.io import require_columns
from . import boosting, logistic


def select_training(df: DataFrame, spec: FeatureSpec, label_as_string: bool = True) -> DataFrame:
    """id + features + label (label cast to string as the boosted path does)."""
    label = F.col(spec.label).cast("string") if label_as_string else F.col(spec.label)
    return df.select(spec.id_col, *spec.features, label.alias(spec.label))


# ---------------------------------------------------------------- statistics

def _long(df: DataFrame, cols: Sequence[str], cast: str) -> DataFrame:
    """One (feature, value) row per input row and column, via explode of a struct array."""
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(cast).alias("value")) for c in cols])
    return df.select(F.explode(arr).alias("kv")).select("kv.feature", "kv.value")


def fit_median(train: DataFrame, cols: Sequence[str], exact: bool = True, accuracy: int = 10_000,
               bins: int = 1024) -> DataFrame:
    """Median per numeric column over non-NULL, non-NaN values: (feature, median).

    ``exact`` is numpy's median, the mean of the two middle values (see ``exact_medians``);
    ``exact=False`` is one pass of ``percentile_approx`` (rank error 1/accuracy).
    """
    spark = train.sparkSession
    if not exact:
        one = train.select(*[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).cast("double").alias(c)
                             for c in cols])
        return _long(one, cols, "double").withColumnRenamed("value", "median")
    medians = exact_medians(train, list(cols), accuracy, bins)
    return spark.createDataFrame([(c, medians.get(c)) for c in cols], "feature string, median double")


def exact_medians(train: DataFrame, cols: list[str], accuracy: int = 10_000, bins: int = 1024) -> dict:
    """{feature: median}: two passes over the numeric columns, whatever the number of rows.

    Pass 1, one mergeable quantile summary per column, brackets the middle ranks: the summary's rank error is at
    most n/accuracy, so values two such errors to either side of the middle hold them for certain. A bracket of one
    value is that column's median. Pass 2 counts the values under each other bracket and groups those inside (about
    4/accuracy of the rows) by value. The ranks are then found among the grouped values alone: by ``bins`` buckets of each bracket (the only rows that
    reach the driver) and a running count inside the chosen bucket.
    """
    if not cols:
        return {}
    step = 2.0 / accuracy
    names = [f"c{i}" for i in range(len(cols))]
    values = train.select(*[nan_to_null(F.col(c).cast("double")).alias(n) for n, c in zip(names, cols)])
    first = values.agg(*[F.count(n).alias(f"n_{n}") for n in names], *[
        F.percentile_approx(n, [max(0.0, 0.5 - step), min(1.0, 0.5 + step)], accuracy).alias(n)
        for n in names]).first()
    ranges = {n: (first[n][0], first[n][1]) for n in names if first[f"n_{n}"]}
    of = dict(zip(names, cols))
    known = {of[n]: lo + 0.0 for n, (lo, hi) in ranges.items() if lo == hi}   # 0.0 for -0.0, as the grouping below has it
    ranges = {n: (lo, hi) for n, (lo, hi) in ranges.items() if lo != hi}
    if not ranges:
        return known
    inside = F.array(*[F.when(F.col(n) <= hi, F.struct(F.lit(n).alias("c"), F.when(F.col(n) >= lo, F.col(n)).alias("v")))
                       for n, (lo, hi) in ranges.items()])
    counted = values.select(F.explode(inside).alias("s")).where("s IS NOT NULL").select("s.c", "s.v") \
        .groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return known | _middle(counted, first, ranges, of, bins)
    finally:
        counted.unpersist()


def _middle(counted: DataFrame, first, ranges: dict, of: dict, bins: int) -> dict:
    """The middle values from (column, value or NULL for all below the bracket, count) rows."""
    width = F.create_map(*[x for n, (lo, hi) in ranges.items() for x in (F.lit(n), F.lit((hi - lo) / bins))])
    low = F.create_map(*[x for n, (lo, _) in ranges.items() for x in (F.lit(n), F.lit(lo))])
    at = F.when(F.col("v").isNull(), F.lit(-1)).when(width[F.col("c")] > 0, F.least(
        F.floor((F.col("v") - low[F.col("c")]) / width[F.col("c")]), F.lit(bins - 1))).otherwise(F.lit(0))
    bucketed = counted.withColumn("b", at.cast("int"))
    sums = bucketed.groupBy("c", "b").agg(F.sum("n").alias("n")).collect()  # at most bins + 1 rows a column
    chosen, wanted = [], {}
    for n in ranges:
        total, below = first[f"n_{n}"], 0
        ranks = sorted({(total - 1) // 2, total // 2})
        for r in sorted((r for r in sums if r["c"] == n), key=lambda r: r["b"]):
            for k in ranks:
                if below <= k < below + r["n"]:
                    wanted[(n, k)] = (r["b"], below)
            below += r["n"]
        chosen += sorted({(n, wanted[(n, k)][0]) for k in ranks})
    pick = None
    for n, b in chosen:
        cond = (F.col("c") == n) & (F.col("b") == b)
        pick = cond if pick is None else pick | cond
    run = Window.partitionBy("c", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = bucketed.where(pick).withColumn("upto", F.sum("n").over(run))
    hit = None
    for (n, k), (b, below) in wanted.items():
        cond = (F.col("c") == n) & (F.col("b") == b) & (F.col("upto") > k - below) & (F.col("upto") - F.col("n") <= k - below)
        hit = cond if hit is None else hit | cond
    found: dict[str, list[float]] = {}
    for r in upto.where(hit).select("c", "v").distinct().collect():  # one or two rows a column
        found.setdefault(r["c"], []).append(r["v"])
    return {of[n]: v[0] if len(v) == 1 else (v[0] + v[1]) / 2.0 for n, v in found.items()}


def fit_mode(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent non-NULL value per categorical column, ties to the smallest: (feature, mode).

    One grouping over (feature, value) for all columns together; partial
    aggregation keeps it proportional to the number of distinct values.
    """
    counts = _long(train, cols, "string").where(F.col("value").isNotNull()) \
        .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("feature").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1") \
                 .select("feature", F.col("value").alias("mode"))


def fit_scaler(train: DataFrame, cols: Sequence[str], medians: dict[str, float] | None = None) -> DataFrame:
    """Mean and population std per column (after median imputation when given)."""
    def x(c):
        v = nan_to_null(F.col(c).cast("double"))
        return F.coalesce(v, F.lit(medians[c])) if medians and medians.get(c) is not None else v
    one = train.select(*[F.struct(F.avg(x(c)).alias("mean"), F.stddev_pop(x(c)).alias("std")).alias(c)
                         for c in cols])
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.mean").alias("mean"),
                             F.col(f"{c}.std").alias("std")) for c in cols])
    return one.select(F.explode(arr).alias("s")).select("s.*")


def label_mapping(train: DataFrame, label: str) -> DataFrame:
    """Sorted distinct classes -> 0..K-1: (class_index, class_name).

    The global window runs over the distinct classes only.
    """
    classes = train.select(F.col(label).cast("string").alias("class_name")).where("class_name IS NOT NULL").distinct()
    return classes.select((F.dense_rank().over(Window.orderBy("class_name")) - 1).cast("int").alias("class_index"),
                          "class_name")


def decode_labels(df: DataFrame, mapping: DataFrame, index_col: str, out_col: str) -> DataFrame:
    """Class index -> name through the mapping; unknown index -> 'UNKNOWN'."""
    names = {r["class_index"]: r["class_name"] for r in mapping.collect()}  # one row per class
    return df.withColumn(out_col, F.coalesce(_by_class(F.col(index_col), names), F.lit("UNKNOWN")))


def _by_class(key: Column, values: dict) -> Column:
    """The value of a class as a literal map: no join, so no shuffle on a handful of keys."""
    if not values:
        return F.lit(None)
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """'balanced' weights n / (K * n_c): (class_name, n, weight)."""
    counts = train.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("class_name")) \
        .agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # over the K class rows only
    return counts.withColumn(
        "weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))


# ---------------------------------------------------------------- pipeline

@dataclass
class Prep:
    """Fitted preprocessing constants (one value per feature)."""

    medians: dict[str, float | None]
    modes: dict[str, str | None]
    means: dict[str, float] | None = None
    stds: dict[str, float] | None = None


def fit_prep(train: DataFrame, spec: FeatureSpec, scale: bool, exact_median: bool = True) -> Prep:
    med = {r["feature"]: r["median"] for r in fit_median(train, spec.numeric, exact_median).collect()}
    modes = {r["feature"]: r["mode"] for r in fit_mode(train, spec.categorical).collect()}
    prep = Prep(med, {c: modes.get(c) for c in spec.categorical})
    if scale:
        rows = fit_scaler(train, spec.numeric, med).collect()
        prep.means = {r["feature"]: r["mean"] for r in rows}
        prep.stds = {r["feature"]: r["std"] for r in rows}
    return prep


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(float(v)) + "D"


def prep_transformer(spec: FeatureSpec, prep: Prep) -> SQLTransformer:
    """The fitted imputation (+ scaling) as one SQL projection."""
    parts = []
    for c in spec.numeric:
        x = f"coalesce(nullif(CAST(`{c}` AS DOUBLE), double('NaN')), CAST({_sql_literal(prep.medians.get(c))} AS DOUBLE))"
        if prep.means is not None:
            std = prep.stds.get(c) or 0.0
            x = f"(({x}) - {_sql_literal(prep.means.get(c) or 0.0)}) / {_sql_literal(std if std > 0 else 1.0)}"
        parts.append(f"{x} AS `_n_{c}`")
    for c in spec.categorical:
        parts.append(f"coalesce(CAST(`{c}` AS STRING), {_sql_literal(prep.modes.get(c))}) AS `_c_{c}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def feature_stages(spec: FeatureSpec, prep: Prep) -> list:
    cats = [f"_c_{c}" for c in spec.categorical]
    idx = StringIndexer(inputCols=cats, outputCols=[f"_i_{c}" for c in spec.categorical],
                        handleInvalid="keep", stringOrderType="alphabetAsc")
    # the indexer's last slot is '__unknown'; dropLast removes it: unseen -> all zeros
    ohe = OneHotEncoder(inputCols=[f"_i_{c}" for c in spec.categorical],
                        outputCols=[f"_o_{c}" for c in spec.categorical], dropLast=True)
    asm = VectorAssembler(inputCols=[f"_n_{c}" for c in spec.numeric] + [f"_o_{c}" for c in spec.categorical],
                          outputCol="features")
    return [prep_transformer(spec, prep), idx, ohe, asm]


def label_stage(spec: FeatureSpec) -> StringIndexer:
    return StringIndexer(inputCol=spec.label, outputCol="label", stringOrderType="alphabetAsc",
                         handleInvalid="error")


def with_balanced_weights(train: DataFrame, label: str) -> DataFrame:
    weights = {r["class_name"]: r["weight"] for r in class_weights(train, label).collect()}  # one row per class
    return train.withColumn("weight", _by_class(F.col(label).cast("string"), weights))


def _training_frame(train: DataFrame, spec: FeatureSpec, drop_unlabelled: bool) -> DataFrame:
    """The projected training columns, persisted (memory, spilling to disk) for
    the statistics passes and the fit; lost blocks recompute from lineage.
    Rows without a label cannot be learned from: ``drop_unlabelled`` leaves
    them out, else the label indexer raises on the first one."""
    require_columns(train, [spec.label, *spec.features], "TRAIN")
    cols = [c for c in dict.fromkeys([spec.id_col, *spec.features, spec.label]) if c in train.columns]
    df = train.where(F.col(spec.label).isNotNull()) if drop_unlabelled else train
    df = df.select(*cols)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _logistic_model(coefficients: np.ndarray, intercepts: np.ndarray) -> LogisticRegressionModel:
    """Spark's multinomial model with the given weights; its columns have the default names."""
    k, d = coefficients.shape
    sc = SparkContext._active_spark_context
    own = LogisticRegressionModel._new_java_obj(
        "org.apache.spark.ml.classification.LogisticRegressionModel", LogisticRegression().uid,
        _py2java(sc, DenseMatrix(k, d, coefficients.ravel(order="F"))), _py2java(sc, DenseVector(intercepts)), k, True)
    return LogisticRegressionModel._from_java(own)


def train_lr(train: DataFrame, spec: FeatureSpec, params: LRParams = C.LR_V1,
             exact_median: bool = True, drop_unlabelled: bool = True) -> PipelineModel:
    """Multinomial logistic regression, L2 with strength 1/n (scikit-learn's C=1), fitted by ``operators/logistic.py``."""
    train = _training_frame(train, spec, drop_unlabelled)
    try:
        prep = fit_prep(train, spec, params.scale, exact_median)
        data = with_balanced_weights(train, spec.label) if params.balanced else train.withColumn("weight", F.lit(1.0))
        prepared = Pipeline(stages=feature_stages(spec, prep) + [label_stage(spec)]).fit(data)
        sizes = [len(x) for x in prepared.stages[1].labelsArray]
        n, classes = train.count(), len(prepared.stages[-1].labels)
        coefficients, intercepts = logistic.fit(
            prepared.transform(data), [f"_n_{c}" for c in spec.numeric], [f"_i_{c}" for c in spec.categorical], sizes,
            classes, "label", "weight", 1.0 / max(n, 1), params.max_iter, params.tol)
        return PipelineModel(stages=prepared.stages + [_logistic_model(coefficients, intercepts)])
    finally:
        train.unpersist()


def train_boosted(train: DataFrame, spec: FeatureSpec, params: BoostedParams = BoostedParams(),
                  path: str | None = None, exact_median: bool = True) -> boosting.BoostedModel:
    """Multi-class softmax trees on histograms (``operators/boosting.py``); with ``path`` a cut-off fit continues."""
    return boosting.fit(train, spec, params, path, exact_median=exact_median)


def model_labels(model: PipelineModel | boosting.BoostedModel) -> list[str]:
    """Class names in index order."""
    if isinstance(model, boosting.BoostedModel):
        return list(model.labels)
    for st in model.stages:
        if isinstance(st, StringIndexerModel) and st.isSet(st.outputCol) and st.getOutputCol() == "label":
            return list(st.labels)
    raise ValueError("no label indexer in model")


def confidence() -> Column:
    """Largest class probability of a logistic model."""
    return nan_to_null(F.array_max(vector_to_array(F.col("probability"))))


def lr_gradient(model: PipelineModel, train: DataFrame, spec: FeatureSpec, params: LRParams) -> tuple[float, float]:
    """(norm of the gradient of the penalised loss at the fitted weights, the same at zero weights).

    The loss is strictly convex in the coefficients, so a norm near 0 certifies the optimum.
    Loss: the weighted mean of the cross-entropies plus half the L2 strength times the squared
    coefficients (intercepts free). One aggregation over the training rows: tasks add up (p - y) x'
    per class, and only the class x feature sums reach the driver."""
    train = train.where(F.col(spec.label).isNotNull())
    rows = with_balanced_weights(train, spec.label) if params.balanced else train.withColumn("weight", F.lit(1.0))
    k = len(model_labels(model))
    scored = model.transform(rows).select(vector_to_array("features").alias("x"), vector_to_array("probability").alias("p"),
                                          F.col("label").cast("int").alias("y"), "weight")

    def add(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, p = (batch.column(i).flatten().to_numpy().reshape(batch.num_rows, -1) for i in (0, 1))
            y, w = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            one = np.hstack([x, np.ones((len(x), 1))])
            hot = np.eye(k)[y]
            part = np.stack([((p - hot) * w[:, None]).T @ one, ((1 / k - hot) * w[:, None]).T @ one])
            total = (part, w.sum()) if total is None else (total[0] + part, total[1] + w.sum())
        if total is not None:
            flat = total[0].ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) + 1)), pa.array(np.append(flat, total[1]))],
                                             ["at", "v"])

    sums = scored.mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    values = np.array([r["v"] for r in sums])
    at_fit, at_zero = values[:-1].reshape(2, k, -1) / values[-1]
    n = train.count()
    coefficients = model.stages[-1].coefficientMatrix.toArray()
    at_fit[:, :-1] += coefficients / max(n, 1)
    return float(np.linalg.norm(at_fit)), float(np.linalg.norm(at_zero))


def predict(model: PipelineModel | boosting.BoostedModel, df: DataFrame, pred_col: str, conf_col: str,
            label_col: str | None = None) -> DataFrame:
    """``df`` with the predicted class name and its probability.

    A truth column ``label_col`` is carried through untouched (renamed around
    the transform so the label indexer does not see it).
    """
    if isinstance(model, boosting.BoostedModel):
        return model.predict(df, pred_col, conf_col)
    if label_col and label_col in df.columns:
        df = df.withColumnRenamed(label_col, "_truth")
    out = model.transform(df)
    labels = model_labels(model)
    dec = IndexToString(inputCol="prediction", outputCol=pred_col, labels=labels)
    out = dec.transform(out).withColumn(conf_col, confidence())
    return out.withColumnRenamed("_truth", label_col) if label_col and "_truth" in out.columns else out


def score(df: DataFrame, spec: FeatureSpec, lr_model: PipelineModel, boosted_model: boosting.BoostedModel,
          lr_uri: str = "", boosted_uri: str = "", ts=None) -> DataFrame:
    """Scored table: id + features + both models' label and confidence + metadata."""
    keep = [spec.id_col, *spec.features]
    require_columns(df, keep, "scoring input")
    base = df.select(*keep)
    a = predict(lr_model, base, "pred_reason_lr", "conf_lr") \
        .select(*keep, "pred_reason_lr", "conf_lr")
    b = predict(boosted_model, a, "pred_reason_xgb", "conf_xgb")
    return with_score_metadata(b.select(*keep, "pred_reason_lr", "conf_lr", "conf_xgb", "pred_reason_xgb"),
                               lr_uri, boosted_uri, ts)


def with_score_metadata(df: DataFrame, lr_uri: str, boosted_uri: str, ts=None) -> DataFrame:
    """``df`` with the time of scoring (UTC wall time and a fixed offset, whatever the session's zone) and model URIs."""
    stamp = F.concat(F.date_format(F.to_utc_timestamp(run_ts(ts), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
                     F.lit("+00:00"))
    return df.withColumns({"scored_at_utc": stamp, "lr_model_uri": F.lit(lr_uri), "xgb_model_uri": F.lit(boosted_uri)})
