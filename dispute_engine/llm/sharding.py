"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A key descends the tree: at each level every child draws -ln(u) / weight, u in (0, 1) from
a hash of the child's path and the key, and the smallest draw wins, so a child gets its share by
weight. A child's draw depends on nothing but its path, its weight and the key. When a
weight changes, the draws at that level change for the one child alone: keys enter it if it
grew and leave it if it shrank, and no key moves between two others. Movement stays inside subtrees
whose weights change. A shard that comes as a region of its own therefore
takes keys only into itself (``grown``); one added to an existing rack draws keys into
that rack, some of which settle on the rack's other shards.

Everything is a column expression; the text is read once, for its size and checksum, and never
moves. Slots are gapless without sorting a whole shard: rows keep the input partition and position
they were written with, are numbered within (shard, input partition) and follow the counts of the partitions
before. A group is thus at most one input partition, even if a third of all
rows share a key, a text or a shard.

Law ``key``: the key (doc_id) and the tree decide, nothing else. Rows of equal text with different
keys may part; name the text's digest as the key to keep them together.

Defined results: NULL text has size 1 and the checksum of no bytes (0); all rows
with a NULL key share one shard; repeated rows get a slot each; an empty table gives no
rows; only the key and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, text_or_empty

RACK, REGION = 4, 2     # shards of a rack and racks of a region in the plain layout


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0

    @property
    def path(self) -> tuple[str, str, str]:
        return self.region, f"{self.region}/{self.rack}", f"{self.region}/{self.rack}/{self.number}"


def layout(shards: int) -> list[Shard]:
    """Shards of equal weight, filling racks and regions in order."""
    return [Shard(i, f"region{i // (RACK * REGION)}", f"rack{i // RACK % REGION}") for i in range(shards)]


def grown(tree: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """``tree`` with one more shard in a region of its own."""
    number = max(s.number for s in tree) + 1
    return [*tree, Shard(number, f"region-of-{number}", "rack0", weight)]


def children(tree: Sequence[Shard], level: int) -> dict[str, dict[str, float]]:
    """For every node above ``level`` its children's paths and weights (the sum of their shards)."""
    out: dict[str, dict[str, float]] = {}
    for s in tree:
        if not s.weight > 0:
            continue
        parent, path = ("" if level == 0 else s.path[level - 1]), s.path[level]
        below = out.setdefault(parent, {})
        below[path] = below.get(path, 0.0) + s.weight
    return out


def node_hash(path: str) -> int:
    """A node's fixed number, hashed together with the key."""
    return zlib.crc32(path.encode())


def draw(path: str, weight: float, key: Column) -> Column:
    """-ln(u) / weight with 53 bits of the hash of (node, key)."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(node_hash(path)).cast("long"), key), 11)
    return -F.log((h + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(weight)


def _winner(below: dict[str, float], key: Column) -> Column:
    if len(below) == 1:
        return F.lit(next(iter(below)))
    return F.array_min(F.array(*[F.struct(draw(p, w, key).alias("draw"), F.lit(p).alias("path"))
                                 for p, w in sorted(below.items())]))["path"]


def place(df: DataFrame, tree: Sequence[Shard], key: Column, name: str = "shard") -> DataFrame:
    """``df`` with the number of the shard that ``key`` descends to."""
    node = f"_{name}_node"
    df = df.withColumn(node, F.lit(""))
    for level in range(3):
        step = None
        for parent, below in children(tree, level).items():
            at = F.col(node) == parent
            step = F.when(at, _winner(below, key)) if step is None else step.when(at, _winner(below, key))
        df = df.withColumn(node, step)
    number = F.create_map(*[x for s in tree for x in (F.lit(s.path[2]), F.lit(s.number))])
    return df.withColumn(name, F.element_at(number, F.col(node)).cast("int")).drop(node)


def slots(placed: DataFrame, shard: str = "shard", at: str = "at") -> DataFrame:
    """``placed`` with ``slot``: 0, 1, 2 ... within each shard.

    ``at`` is a stored monotonically_increasing_id: its upper bits name the input partition."""
    part = placed.withColumn("_part", F.shiftright(at, 33))
    sizes = part.groupBy(shard, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(shard, "_part").orderBy(at)
    return part.withColumn("_inner", F.row_number().over(inside) - 1).join(starts, [shard, "_part"]) \
               .withColumn("slot", F.col("_first") + F.col("_inner")).drop("_part", "_n", "_first", "_inner")


def shard_documents(docs: DataFrame, tree: Sequence[Shard], more: Sequence[Shard] | None = None,
                    key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (the shard under ``more``) of every row."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.monotonically_increasing_id().alias("at"))
    rows = place(rows, tree, F.col("doc_id"))
    rows = place(rows, more, F.col("doc_id"), "grown_shard") if more else \
        rows.withColumn("grown_shard", F.lit(None).cast("int"))
    return slots(stored(rows, "shards")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                                                "slot", "grown_shard")


def write_shards(docs: DataFrame, tree: Sequence[Shard], path: str, key: str = "doc_id") -> None:
    """The whole rows of ``docs`` as Parquet folders ``_shard=0`` and so on; rows do not shuffle."""
    frame = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(key).alias("_key"))
    place(frame, tree, F.col("_key"), "_shard").select("row.*", "_shard") \
        .write.mode("overwrite").partitionBy("_shard").option("compression", "zstd").parquet(path)


# ------------------------------------------------------------------ SQL of the same law

def _hash_steps(word: str, seed: str) -> list[str]:
    """64-bit xxHash of one 8-byte word, each step an expression over the last (h)."""
    # FIXED VALUES - the hash's five primes
    p1, p2, p3, p4, p5 = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579,
                          2870177450012600261)
    whole = f"{1 << 64}::UHUGEINT"

    def times(x, p):
        return f"((({x})::UHUGEINT * {p}::UHUGEINT) % {whole})"

    def turn(n):
        return f"(((h * {1 << n}::UHUGEINT) % {whole}) + (h // {1 << (64 - n)}::UHUGEINT))"

    def mixed(n):
        return f"xor(h::UBIGINT, (h // {1 << n}::UHUGEINT)::UBIGINT)::UHUGEINT"

    return [times(word, p2), times(turn(31), p1),
            f"xor(h::UBIGINT, ((({seed})::UHUGEINT + {(p5 + 8) % (1 << 64)}::UHUGEINT) % {whole})::UBIGINT)::UHUGEINT",
            f"(({times(turn(27), p1)}) + {p4}::UHUGEINT) % {whole}",
            times(mixed(33), p2), times(mixed(29), p3), mixed(32)]


def _hashed(source: str, word: str, seed: str) -> str:
    steps = _hash_steps(word, seed)
    body = f"SELECT *, ({steps[0]})::UHUGEINT AS h FROM {source}"
    for step in steps[1:]:
        body = f"SELECT * REPLACE (({step})::UHUGEINT AS h) FROM ({body}) t"
    return body


def sql_of(tree: Sequence[Shard], more: Sequence[Shard]) -> str:
    """DuckDB SQL of :func:`shard_documents` for a table written in ascending order of unique doc_ids."""
    rows = []
    for which, shards in (("shard", tree), ("grown_shard", more)):
        for level in range(3):
            rows += [f"('{which}', {level}, '{parent}', '{path}', {node_hash(path)}, {weight!r}::DOUBLE)"
                     for parent, below in children(shards, level).items() for path, weight in below.items()]
    numbers = ", ".join(f"('{s.path[2]}', {s.number})" for s in more)
    return f"""
WITH nodes(tree, level, parent, path, word, weight) AS (VALUES {", ".join(rows)}),
seeded AS (SELECT * RENAME (h AS seed) FROM ({_hashed("nodes", "word", "42")})),
ids AS (SELECT DISTINCT doc_id FROM documents),
crossed AS (SELECT doc_id, tree, level, parent, path, weight, seed,
    CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + {1 << 64}::HUGEINT ELSE doc_id::HUGEINT END AS word
  FROM ids, seeded WHERE doc_id IS NOT NULL),
draws AS (SELECT *, -ln(((h // 2048::UHUGEINT)::DOUBLE + 0.5) / {1 << 53}::DOUBLE) / weight AS draw
  FROM ({_hashed("crossed", "word", "seed")})),
best AS (SELECT doc_id, tree, level, parent, arg_min(path, draw) AS path FROM draws GROUP BY ALL),
leaves AS (SELECT a.doc_id, a.tree, c.path FROM best a
  JOIN best b ON b.doc_id = a.doc_id AND b.tree = a.tree AND b.level = 1 AND b.parent = a.path
  JOIN best c ON c.doc_id = a.doc_id AND c.tree = a.tree AND c.level = 2 AND c.parent = b.path
  WHERE a.level = 0 AND a.parent = ''),
numbers(path, number) AS (VALUES {numbers}),
placed AS (SELECT doc_id, max(number) FILTER (tree = 'shard') AS shard,
    max(number) FILTER (tree = 'grown_shard') AS grown_shard FROM leaves JOIN numbers USING (path) GROUP BY doc_id),
polynomial(i, c) AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) FROM range(256) r(i)),
bytes AS (SELECT list(c ORDER BY i) AS t FROM polynomial),
sums AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      range(octet_length(encode(coalesce(text, '')))), lambda i:
      ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT)),
      lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]))) AS text_crc32
  FROM documents, bytes)
SELECT s.doc_id, s.size::BIGINT AS size, s.text_crc32::BIGINT AS text_crc32, 'key' AS law, p.shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY p.shard ORDER BY s.doc_id) - 1 AS slot, p.grown_shard::INTEGER AS grown_shard
FROM sums s JOIN placed p USING (doc_id)"""
