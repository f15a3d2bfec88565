"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Fit. Labelled training rows, equal texts counted once, give the number of
toxic and of other texts each token occurs in (a text copied or a word repeated
many times is one piece of evidence). A token is kept where the likelihood
ratio of its two counts departs from equal shares by Z normal deviations (the
signed root of G), a test that holds at a count of 0 too. Its score is the log-odds
ratio with WORD_PRIOR pseudo-texts per token, split as the classes' tokens are, so
the prior weighs the same in a corpus of any size, less a drift that makes
ordinary text lose score. Model size is a parameter: the MODEL_WORDS tokens with
the largest |z|.

Score. One linear pass (all maximal scoring segments, Ruzzo and Tompa) finds
every high-scoring passage of a whole text. Segment scores are put on the
extreme-value scale of Karlin and Altschul: lambda solves
sum p(w) exp(lambda s(w)) = 1 over clean text and ln K comes from the mean of
the clean texts' best scores, so a score does not grow with text length alone. The
passages' normalised scores add up, and a one-variable logistic fit on the
training rows turns the sum into a probability.

Rows whose crc32(doc_id as text) mod 5 is 0 are held out. Defined results:
NULL or empty text has no passage and the score of a text without evidence; a
NULL doc_id is never trained on and counts as not held out; without training
rows of both classes every score is 0.0; several labels of one doc_id count as
toxic if one is; repeated rows score alike; extra columns pass through untouched.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored

FOLDS = 5
WORD_PRIOR = 1.0            # pseudo-texts of every token, over both classes
Z = 3.0                     # normal deviations a token's likelihood ratio must reach
DRIFT = 0.4                 # score every token loses
MODEL_WORDS = 50_000        # size bound of the broadcast model
FLUSH = 50_000              # distinct tokens a task counts before it hands them on; the sums behind it merge them
SLICE = 256                 # texts whose passages a task holds before it hands them on
BIN = 0.25                  # calibration histogram
SPAN = (-60.0, 400.0)

_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


@dataclass
class ToxicityModel:
    scores: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0       # lambda
    log_k: float = 0.0
    slope: float = 0.0
    bias: float | None = None   # None: no calibration, every score is 0.0


def segments(values: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of ``values`` as (first, last + 1, score), in linear time.

    Each candidate keeps a link to the nearest earlier one that starts from a
    lower total, so the search for a candidate to join skips all between."""
    kept: list[tuple[int, int, float, float, int]] = []  # first, end, total before, total after, link
    total = 0.0
    for i, v in enumerate(values):
        before, total = total, total + v
        if v <= 0:
            continue
        first, low = i, before
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((first, i + 1, low, total, j))
    return [(c[0], c[1], c[3] - c[2]) for c in kept]


def _count(batches):
    seen: dict[str, list[int]] = {}

    def flush():
        rows = [pa.array(list(seen)), pa.array([v[1] for v in seen.values()], pa.int64()),
                pa.array([v[0] for v in seen.values()], pa.int64())]
        seen.clear()
        return pa.RecordBatch.from_arrays(rows, ["word", "toxic", "clean"])

    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            for w in set(tokens(text.as_py())):
                n = seen.get(w)
                if n is None:
                    n = seen[w] = [0, 0]
                n[label] += 1
            if len(seen) >= FLUSH:
                yield flush()
    if seen:
        yield flush()


def _training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id") \
                  .agg(F.max(F.col("toxic").cast("int")).alias("label"))
    # the fold is cut before the join, so held-out texts do not move
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # of equal labelled texts one row trains; only ids and digests move to find it
    digests = (F.xxhash64("text").alias("h1"), F.coalesce(F.crc32("text"), F.lit(-1)).alias("h2"))
    chosen = texts.select("doc_id", *digests).join(known, "doc_id") \
                  .groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))
    # a doc_id may stand for several texts: its text is found by the digests as well, and once if rows repeat
    found = texts.select("doc_id", "text", *digests).join(chosen, ["doc_id", "h1", "h2"])
    return stored(found.dropDuplicates(["doc_id", "h1", "h2"]).select("text", "label"), "toxic-training")


def _word_scores(train: DataFrame) -> tuple[dict[str, float], dict[str, int], int]:
    """(log-odds scores, clean counts of the scored words, all clean tokens)."""
    counts = stored(train.mapInArrow(_count, "word string, toxic long, clean long").groupBy("word")
                    .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-counts")
    n_toxic, n_clean = (x or 0 for x in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    if not n_toxic or not n_clean:
        return {}, {}, n_clean
    share = n_toxic / (n_toxic + n_clean)
    a, b = F.col("toxic") + WORD_PRIOR * share, F.col("clean") + WORD_PRIOR * (1 - share)
    odds = F.log(a / (n_toxic + WORD_PRIOR - a)) - F.log(b / (n_clean + WORD_PRIOR - b))
    both = F.col("toxic") + F.col("clean")

    def cell(found: Column, expected: Column) -> Column:
        return F.when(found > 0, found * F.log(found / expected)).otherwise(F.lit(0.0))

    ratio = 2 * (cell(F.col("toxic"), both * share) + cell(F.col("clean"), both * (1 - share))
                 + cell(n_toxic - F.col("toxic"), (n_toxic + n_clean - both) * share)
                 + cell(n_clean - F.col("clean"), (n_toxic + n_clean - both) * (1 - share)))
    z = F.signum(F.col("toxic") - both * share) * F.sqrt(F.greatest(ratio, F.lit(0.0)))
    scored = counts.select("word", "clean", odds.alias("odds"), z.alias("z"))
    top = scored.where(F.abs("z") >= Z).orderBy(F.abs("z").desc(), "word").limit(MODEL_WORDS).collect()
    return {r["word"]: r["odds"] - DRIFT for r in top}, {r["word"]: r["clean"] for r in top}, n_clean


def _lambda(scores: dict[str, float], clean: dict[str, int], n_clean: int) -> float:
    """The positive root of sum p(w) exp(x s(w)) = 1 over clean text."""
    if not any(v > 0 for v in scores.values()):
        return 1.0
    s = np.array([scores[w] for w in scores] + [-DRIFT])
    known = np.array([clean[w] + 0.5 for w in scores])
    p = np.append(known, max(n_clean - known.sum(), 1.0))
    p = p / p.sum()
    low, high = 1e-6, 1.0
    while np.sum(p * np.exp(np.minimum(high * s, 500))) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.sum(p * np.exp(np.minimum(mid * s, 500))) < 1 else (low, mid)
    return (low + high) / 2


_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("best", T.DoubleType()),
    T.StructField("passages", T.ArrayType(T.StructType([
        T.StructField("first", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("score", T.DoubleType())])))])


def find_passages(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` as struct column ``row`` with n_words, best and every maximal scoring passage (word positions)."""
    scores = model.scores
    frame = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(text_col).alias("_text"))

    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def search(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):  # the passages of a slice are held as Python objects
                batch, n, best, spans = whole.slice(at, SLICE), [], [], []
                for text in batch.column(1):
                    found = tokens(text.as_py())
                    values = [scores.get(w, -DRIFT) for w in found]
                    parts = segments(values)
                    n.append(len(found))
                    best.append(max((p[2] for p in parts), default=0.0))
                    spans.append([{"first": a, "end": b, "score": s} for a, b, s in parts])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(spans, kind)],
                    ["row", "n_words", "best", "passages"])

    return frame.mapInArrow(search, T.StructType([frame.schema["row"], *_FOUND.fields]))


def _evidence(model: ToxicityModel) -> Column:
    """The normalised best score, or the sum of all normalised scores above 0 if larger."""
    base = F.lit(model.log_k) + F.log(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    best = F.lit(model.scale) * F.col("best") - base
    total = F.aggregate("passages", F.lit(0.0), lambda acc, p: acc + F.greatest(
        F.lit(0.0), F.lit(model.scale) * p["score"] - base))
    return F.greatest(best, total)


def _logistic(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """(slope, bias) of a logistic fit on (x, label, count) rows, lightly regularised."""
    x, y, w = (np.array(v, dtype=float) for v in zip(*bins))
    centre, spread = np.average(x, weights=w), math.sqrt(np.cov(x, aweights=w)) if len(x) > 1 else 1.0
    spread = spread if spread > 0 else 1.0
    u, theta = (x - centre) / spread, np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(theta[0] * u + theta[1], -30, 30)))
        g = np.array([np.sum(w * (y - p) * u) - 1e-2 * theta[0], np.sum(w * (y - p))])
        h = w * p * (1 - p)
        step = np.linalg.solve(np.array([[np.sum(h * u * u) + 1e-2, np.sum(h * u)],
                                         [np.sum(h * u), np.sum(h) + 1e-9]]), g)
        step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        theta += step
        if np.abs(step).max() < 1e-9:
            break
    slope = max(theta[0] / spread, 0.0)
    return slope, theta[1] - slope * centre


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from the labelled rows of the training folds."""
    train = _training_rows(docs, labels)
    scores, clean, n_clean = _word_scores(train)
    if not scores:
        return ToxicityModel()
    model = ToxicityModel(scores, _lambda(scores, clean, n_clean))
    found = stored(find_passages(train, model).select("row.label", "n_words", "best", "passages"), "toxic-passages")
    mean = found.where(F.col("label") == 0).agg(F.avg(
        F.lit(model.scale) * F.col("best") - F.log(F.greatest(F.col("n_words"), F.lit(1)).cast("double")))).first()[0]
    model.log_k = (mean or 0.0) - 0.5772156649015329  # mean of the standard extreme-value law
    x = F.least(F.greatest(_evidence(model), F.lit(SPAN[0])), F.lit(SPAN[1]))
    rows = found.groupBy(F.floor(x / BIN).alias("bin"), "label").agg(F.count("*").alias("n")).collect()
    if len({r["label"] for r in rows}) == 2:
        model.slope, model.bias = _logistic([((r["bin"] + 0.5) * BIN, r["label"], r["n"]) for r in rows])
    return model


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``row`` (the input row), n_words, passages with evidence, score and predicted."""
    x = F.least(F.greatest(_evidence(model), F.lit(SPAN[0])), F.lit(SPAN[1]))
    base = F.lit(model.log_k) + F.log(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    probability = F.lit(0.0)
    if model.bias is not None:
        logit = F.greatest(F.least(F.lit(model.slope) * x + F.lit(model.bias), F.lit(700.0)), F.lit(-700.0))
        probability = F.lit(1.0) / (1 + F.exp(-logit))
    found = find_passages(docs, model, text_col).withColumn("score", probability)
    return found.select("row", "n_words", F.filter("passages", lambda p: F.lit(model.scale) * p["score"] > base)
                        .alias("passages"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words and the passages of every row of ``docs``."""
    found = score(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted",
                        "n_words", "passages")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` not predicted toxic, all columns unchanged."""
    return score(docs, fit(docs, labels)).where(F.col("predicted") == 0).select("row.*")
