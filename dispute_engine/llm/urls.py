"""URL filters: rules matched by host-suffix and path-prefix expressions.

Native: DataFrame functions only. A rule (host, path, verdict) fits its host
and all subdomains when the URL's path starts with the rule's path. A rule's
key is its host and its path up to the last ``/``; a URL is expanded into every
host suffix (cut at dots) and every path prefix (cut after slashes) no deeper
than the deepest rule. Expressions equi-join rules on a 4-byte hash prefix;
full SHA-256 digests and the path's remainder then confirm, and the longest
rule wins (longer host, then block, on equal length).

Defined results: a NULL URL or one without ``://`` has empty host and path and
no rule; no fitting rule gives ``default``; repeated rows each get a result;
empty pages or rules give an empty result or the default everywhere. Only the
named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed rule list of the registered query: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Rule tables up to this many rows are broadcast; larger ones join by a salted shuffle.
BROADCAST_RULES = 100_000
SALTS = 32
_A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _A_Z, _A_Z.lower())
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, F.lit("\n"), path), 256))


def _key_path(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*/)?", 1)


def _prepared(rules: DataFrame) -> DataFrame:
    r = rules.where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("path").isNotNull()
                    & F.col("verdict").isNotNull()).select(
        F.translate("host", _A_Z, _A_Z.lower()).alias("r_host"), F.col("path").alias("r_path"),
        F.col("verdict").alias("r_verdict")).distinct()
    key = _key_path(F.col("r_path"))
    return r.withColumn("r_digest", _digest(F.col("r_host"), key)) \
            .withColumn("prefix", F.substring("r_digest", 1, 4)) \
            .withColumn("r_labels", F.size(F.split("r_host", r"\."))) \
            .withColumn("r_slashes", F.length("r_path") - F.length(F.translate("r_path", "/", "")))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages``."""
    prepared = _prepared(rules)
    # two numbers bound the expansion without losing a match: no rule is deeper
    n_rules, labels, slashes = prepared.agg(F.count("*"), F.coalesce(F.max("r_labels"), F.lit(0)),
                                            F.coalesce(F.max("r_slashes"), F.lit(0))).first()
    host, path = host_path(F.col("url"))
    # equal rows are judged once and counted, so that copies of a URL move as one row
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")) \
                .groupBy("page_id", "url").agg(F.count("*").alias("copies")) \
                .withColumn("host", host).withColumn("path", path)
    parts = F.split("host", r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max(labels, 1)))),
                           lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    cuts = F.split("path", "/")
    # prefix k is the path through its k-th slash; k = 0 serves rules whose path holds no slash
    depth = F.least(F.size(cuts) - 1, F.lit(slashes))
    prefixes = F.transform(F.sequence(F.lit(0), depth), lambda k: F.when(k == 0, F.lit("")).otherwise(
        F.concat(F.array_join(F.slice(cuts, F.lit(1), k), "/"), F.lit("/"))))
    exprs = rows.withColumn("e_host", F.explode(suffixes)).withColumn("e_path", F.explode(prefixes)) \
                .where(F.col("e_host") != "") \
                .withColumn("digest", _digest(F.col("e_host"), F.col("e_path"))) \
                .withColumn("prefix", F.substring("digest", 1, 4))
    right = prepared.drop("r_labels", "r_slashes")
    if n_rules <= BROADCAST_RULES:
        hits = exprs.join(F.broadcast(right), "prefix")
    else:
        salted = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        hits = exprs.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")) \
                    .join(salted, ["prefix", "_salt"])
    fits = (F.col("digest") == F.col("r_digest")) & (F.col("e_host") == F.col("r_host")) \
        & F.startswith(F.col("path"), F.col("r_path"))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("l"), F.length("r_host").alias("h"),
                    (F.col("r_verdict") == "block").alias("b"), F.concat("r_host", "r_path").alias("rule"),
                    F.col("r_verdict").alias("verdict"))
    best = hits.where(fits).groupBy("page_id", "url").agg(F.max(rank).alias("best"))
    out = rows.join(best.withColumnsRenamed({"page_id": "b_id", "url": "b_url"}),
                    F.col("page_id").eqNullSafe(F.col("b_id")) & F.col("url").eqNullSafe(F.col("b_url")), "left")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
