"""Quality rules: base measures per text and adaptive thresholds per language and source.

Native: DataFrame functions only. A word is a run of characters other than
the six ASCII white-space characters.

Method. Each text gets its measures (one projection). Mergeable quantile
summaries (``approx_percentile``: partial summaries per task, merged after the
shuffle) give quartiles of each rate per (lang, source), over all its texts and over those where the rate is above 0.
A text fails a rate that lies FENCE spreads above its group's upper quartile, and the word length also FENCE spreads
below the lower one. The spread is the distance of the quartiles. Where they coincide, as for rates that most texts have
at 0, fence and spread come from the texts above 0: the group's, or its language's where the group
has fewer than ENOUGH of them. Where less than RARE of a group has the rate at all, or those quartiles coincide too, the
spread is the mean deviation of the language's percentiles from their median. No constant stands beside the
fences: what a group may have, its texts decide.

Defined results: NULL or empty text has zero words and fails the base rule;
NULL lang or source is a group of its own; a repeated row is measured like any
other; an empty table gives an empty result. Input columns are kept apart
from the measures by a struct, so clashing names cannot collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

# Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20

#: Adaptive rule: FENCE spreads from the quartile ("far out" in the usual box plot).
FENCE = 3.0
RARE = 0.02             # a rate that a smaller share of the group has at all is unusual there
ENOUGH = 25             # texts above 0 that a group needs for quartiles of its own
RATES = ("symbol_rate", "dup_line_rate", "repeat_rate", "word_length")
LOWER = ("word_length",)  # rates that have a lower fence as well
GRID = [i / 100 for i in range(1, 100)]
QUANTILE_ACCURACY = 10_000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_starts(windows: Column) -> Column:
    """Sorted start positions of the windows whose hash occurs twice or more.

    Sorting (hash, position) pairs brings equal windows together; each pair is
    then compared with its two neighbours, so the work is n log n."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    hashes = F.transform(pairs, lambda p: p["h"])
    none, n = F.array(F.lit(None).cast("long")), F.size(windows)
    zipped = F.arrays_zip(pairs.alias("pair"), F.concat(none, F.slice(hashes, F.lit(1), n - 1)).alias("before"),
                          F.concat(F.slice(hashes, F.lit(2), n), none).alias("after"))
    repeated = F.filter(zipped, lambda z: F.coalesce(z["pair"]["h"] == z["before"], F.lit(False))
                        | F.coalesce(z["pair"]["h"] == z["after"], F.lit(False)))
    return F.array_sort(F.transform(repeated, lambda z: z["pair"]["i"]))


def measure(docs: DataFrame, text_col: str = "text", row: str = "row") -> DataFrame:
    """``docs`` as struct column ``row`` plus the measures (longs)."""
    text = F.coalesce(F.col(f"{row}.{text_col}"), F.lit(""))
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(row)).select(
        row,
        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"))
    n = F.size("words")
    at = F.col("words")
    out = out.select(
        row, "word_chars", "n_symbols", n.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.xxhash64(*[F.get(at, i + k) for k in range(WINDOW)])))
         .otherwise(F.array().cast("array<bigint>")).alias("windows"))
    out = out.select(
        row, *MEASURES[:1], "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _repeat_starts(F.col("windows")))
         .otherwise(F.array().cast("array<int>")).alias("at"))
    m = F.size("at")
    # the last repeated window covers WINDOW words, each earlier one the gap to the next, WINDOW at most
    covered = F.when(m == 0, F.lit(0)).otherwise(
        F.aggregate(F.zip_with(F.slice("at", F.lit(2), F.greatest(m, F.lit(1))),
                               F.slice("at", F.lit(1), F.greatest(m - 1, F.lit(0))),
                               lambda b, a: F.least(b - a, F.lit(WINDOW))),
                    F.lit(WINDOW), lambda acc, x: acc + x))
    return out.select(row, *MEASURES[:4], covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | \
        (F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_PERCENT) * F.col("n_words"))


def rates() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_rate": F.col("n_symbols") / words,
        "dup_line_rate": F.col("n_dup_lines") / words * 10,
        "repeat_rate": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def _deviation(grid: Column) -> Column:
    """Mean distance of the percentiles in ``grid`` from the median."""
    median = F.element_at(grid, len(GRID) // 2 + 1)
    return F.aggregate(grid, F.lit(0.0), lambda acc, q: acc + F.abs(q - median)) / len(GRID)


def thresholds(measured: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Fences of each rate per group (``max_`` and, for LOWER, ``min_``), from quantile summaries over every row
    that passes the base rule; ``by[0]`` is the language."""
    frame = measured.where(~base_failed()).select(*by, *[c.alias(k) for k, c in rates().items()])

    def summaries(prefix: str, whole: list[float]):
        for k in RATES:
            above = F.when(F.col(k) > 0, F.col(k))
            yield F.percentile_approx(k, whole, QUANTILE_ACCURACY).alias(f"{prefix}{k}")
            yield F.percentile_approx(above, [0.25, 0.75], QUANTILE_ACCURACY).alias(f"{prefix}above_{k}")
            yield F.count(above).alias(f"{prefix}n_{k}")

    agg = frame.groupBy(*by).agg(F.count("*").alias("n"), *summaries("", [0.25, 0.75]))
    wide = frame.groupBy(F.col(by[0]).alias("_lang")).agg(*summaries("_", GRID))
    agg = agg.join(wide, F.col(by[0]).eqNullSafe(F.col("_lang")))
    out = []
    for k in RATES:
        low, high = F.col(k)[0], F.col(k)[1]
        own = F.col(f"n_{k}") >= ENOUGH
        above = F.when(own, F.col(f"above_{k}")).otherwise(F.col(f"_above_{k}"))
        usual = (F.col(f"n_{k}") >= RARE * F.col("n")) & (above[1] > above[0])
        far = _deviation(F.col(f"_{k}"))
        out.append(F.when(high > low, high + FENCE * (high - low))
                    .when(usual, above[1] + FENCE * (above[1] - above[0]))
                    .otherwise(high + FENCE * far).alias(f"max_{k}"))
        if k in LOWER:
            out.append(F.when(high > low, low - FENCE * (high - low)).otherwise(low - FENCE * far).alias(f"min_{k}"))
    return agg.select(*by, *out)


def judge(measured: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Adds ``base_failed`` and ``kept``.

    One threshold row per group joins back. Sources are few next to rows, but
    unbounded in principle, so the fence table is shared by size: Spark
    broadcasts it while it is under its own limit, and beyond it the rows of a
    group are salted over SALTS copies of the group's fence row."""
    fences = stored(thresholds(measured, by), "quality-fences")
    names = [f"max_{k}" for k in RATES] + [f"min_{k}" for k in LOWER]
    salt = F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols", "doc_key"), F.lit(SALTS)).cast("int")
    left = measured.withColumn("_salt", salt)
    right = fences.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    cond = [left[c].eqNullSafe(right[c]) for c in by] + [left["_salt"] == right["_salt"]]
    joined = left.join(right.select(*[right[c] for c in by], right["_salt"],
                                    *names), cond, "left") \
                 .select(*[left[c] for c in measured.columns], *[right[c] for c in names])
    failed = F.lit(False)
    for k, c in rates().items():
        failed = failed | F.coalesce(c > F.col(f"max_{k}"), F.lit(False))
        if k in LOWER:
            failed = failed | F.coalesce(c < F.col(f"min_{k}"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~failed) \
                 .drop(*names)


#: Copies of each fence row when the fence table is joined by a shuffle.
SALTS = 32


def quality_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, the measures, ``base_failed`` and ``kept`` for every row of ``docs``
    (columns doc_id, text, lang, source)."""
    m = measure(docs, text_col)
    flat = m.select(F.col("row.doc_id").alias("doc_id"), F.col("row.lang").alias("lang"),
                    F.col("row.source").alias("source"), F.col("row.doc_id").alias("doc_key"), *MEASURES)
    return judge(stored(flat, "quality-measures")).select("doc_id", *MEASURES, "base_failed", "kept")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, all columns unchanged."""
    flat = measure(docs, text_col).select("row", F.col("row.lang").alias("lang"), F.col("row.source").alias("source"),
                                          F.col("row.doc_id").alias("doc_key"), *MEASURES)
    return judge(stored(flat, "quality-rows")).where("kept").select("row.*")
