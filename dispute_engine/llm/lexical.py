"""Ranked lexical search: MaxScore over blocks of documents with term-pair bounds, exact top k.

Index. Texts are read once and stay where they are: a task cuts its documents into blocks and
writes, for every term that an item asks for, the documents of the block that hold it and how often. Global counts (N, L and
each term's document frequency) are aggregations over the blocks, weights follow from them.

Pairs. The terms of an item are paired by falling weight (rare with rare). For every pair and block the
intersection of the two lists is stored with each document's joint impact and the joint
maximum J. The sum of a document's joint impacts over an item's pairs is a lower bound of its score, so the k-th
largest of these sums, over all documents, is a threshold that no top-k document falls below.

Search. Within a block a pair can add at most max(J, A, B), A and B the single maxima, because a document holds
both terms (at most J) or one (at most its maximum), where independent maxima would allow A + B.
Blocks whose summed bounds stay below the threshold are skipped for the item. In the others the units
(pairs) of smallest bound whose sum stays below the threshold are not essential: a document that holds no other term cannot
reach it. Documents of the essential units are scored, the rest adds to them from the
largest bound down, and documents that cannot reach the threshold any more drop out. The threshold rises
as a task finds scores. A document is dropped only while its bound is strictly below the threshold, so ties stay and the result is exact.

Each task hands on its k best per item; a window over these rows (cut to k per item before its
shuffle) gives the ranks. Items are taken in rounds of about ROUND_BYTES of text, so the broadcast terms
are bounded however many items there are; a block holds at most BLOCK_DOCS documents and is closed early at BLOCK_POSTINGS.

Defined results: NULL or empty text, of documents and items alike, has no terms: such a document never ranks, such an
item gives no rows. Repeated document rows rank each on their own, a NULL doc_id last among
equal scores. Repeated or NULL item ids: every row of ``items`` gets its own k results under its id.
An empty table on either side gives no rows. Only ids and texts are read, other columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

TOP = 20
BLOCK_DOCS = 4096
BLOCK_POSTINGS = 1 << 21
ROUND_BYTES = 1 << 24

#: Every byte as the term byte it stands for, or a blank: ASCII letters (lower-cased) and digits, all bytes from 128 on.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return text.translate(_TERM_BYTES).split()


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(1000000000 tf) div (1000 tf + 12 m)."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 25 + (25 n N) div L of every document, exact beyond 63 bits as well."""
    if 25 * int(n.max(initial=0)) * n_docs < 1 << 63:
        return 75 + 25 * n * n_docs // n_terms
    return np.array([75 + 25 * int(v) * n_docs // n_terms for v in n], dtype=np.int64)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# ------------------------------------------------------------------ index

# the long lists are compressed: a task's input then stays as small in memory as its file, one block apart
_BLOCK = "block long, doc_ids array<long>, n array<long>, term array<int>, df array<int>, at binary, tf binary"


def _pack(x: np.ndarray, kind) -> pa.Array:
    return pa.array([zstandard.compress(x.astype(kind).tobytes(), 1)], pa.binary())


def _unpack(column: pa.Array, row: int, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(column[row].as_buffer()), kind)


def _list(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def build_index(docs: DataFrame, numbers: dict[bytes, int], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per block: its documents with a term, and the postings of the terms in ``numbers`` (from 1)."""
    names = [f.split()[0] for f in _BLOCK.split(", ")]

    def close(block: int, ids: list, n: list, hits: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(h) for h in hits])
        key = np.concatenate(hits).astype(np.int64) << 32 | np.repeat(np.arange(len(hits)), sizes)
        key, tf = np.unique(key, return_counts=True)      # by term, then document
        term, df = np.unique(key >> 32, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.array([ids], pa.list_(pa.int64())), _lists([np.array(n)], pa.int64()),
             *[_lists([x.astype(np.int32)], pa.int32()) for x in (term, df)], _pack(key & 0xFFFFFFFF, "<i4"),
             _pack(tf, "<i4")], names)

    def index(batches):
        block, ids, n, hits, held = TaskContext.get().partitionId() << 32, [], [], [], 0
        known = numbers.get
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms(text.as_buffer().to_pybytes()) if text.is_valid else []
                if not found:
                    continue
                asked = np.array(list(filter(None, map(known, found))), dtype=np.int32)
                ids.append(doc_id)
                n.append(len(found))
                hits.append(asked)
                held += len(asked)
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_POSTINGS:
                    yield close(block, ids, n, hits)
                    block, ids, n, hits, held = block + 1, [], [], [], 0
        if ids:
            yield close(block, ids, n, hits)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary")
                       .alias("text")).mapInArrow(index, _BLOCK)


# ------------------------------------------------------------------ items of a round

@dataclass
class Items:
    """Items as arrays: units are pairs or single terms (second term 0), by item, with their multiplicities."""

    ids: list[int | None]
    starts: np.ndarray                       # first unit of each item
    number: np.ndarray                       # item number of each such run
    unit: np.ndarray                         # pair number of every unit
    pairs: np.ndarray                        # distinct units: term, times, term, times
    weights: np.ndarray = field(default=None)  # by term number


def pair_items(texts: list[tuple[int | None, Counter]], weights: np.ndarray) -> Items:
    """Pairs the terms of every item by falling weight; a term that no document holds has none."""
    numbers: dict[tuple[int, int, int, int], int] = {}
    starts, number, unit = [], [], []
    for i, (_, counted) in enumerate(texts):
        held = sorted((t for t in counted if weights[t] >= 0), key=lambda t: (-weights[t], t))
        if not held:
            continue
        starts.append(len(unit))
        number.append(i)
        for j in range(0, len(held), 2):
            a, b = held[j], held[j + 1] if j + 1 < len(held) else 0
            unit.append(numbers.setdefault((a, counted[a], b, counted[b] if b else 0), len(numbers)))
    return Items([t[0] for t in texts], np.array(starts, np.int64), np.array(number, np.int64), np.array(unit, np.int64),
                 np.array(list(numbers), np.int64).reshape(-1, 4), weights)


# ------------------------------------------------------------------ pair lists

_READY = ("block long, doc_ids array<long>, term array<int>, df array<int>, at binary, sat binary, "
          "pair array<int>, joint_max array<long>, n_joint array<int>, joint_at binary, joint binary")


class _Postings:
    """The lists of one block: documents and saturations by term number."""

    def __init__(self, term, df, at, sat):
        self.ends = np.cumsum(df)
        self.place = {int(t): i for i, t in enumerate(term)}
        self.df, self.at, self.sat = df, at, sat

    def get(self, term: int):
        i = self.place.get(term)
        if i is None:
            return None
        part = slice(self.ends[i] - self.df[i], self.ends[i])
        return self.at[part], self.sat[part]


def add_pairs(index: DataFrame, items: Items, n_docs: int, n_terms: int) -> DataFrame:
    """The index with saturations in place of counts, and the intersection list of every pair."""
    names = [f.split()[0] for f in _READY.split(", ")]
    both = [(p, *items.pairs[p].tolist()) for p in range(len(items.pairs)) if items.pairs[p, 2]]
    w = items.weights

    def add(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                n, term, df = (_list(batch.column(c), row) for c in (2, 3, 4))
                at, tf = (_unpack(batch.column(c), row, "<i4") for c in (5, 6))
                m = length_norm(n.astype(np.int64), n_docs, n_terms)
                sat = saturation(tf.astype(np.int64), m[at])
                lists = _Postings(term, df, at, sat)
                pair, top, size, found, joint = [], [], [], [], []
                flag, place = np.zeros(len(n), bool), np.zeros(len(n), np.int64)
                for p, a, times_a, b, times_b in both:
                    one, two = lists.get(a), lists.get(b)
                    if one is None or two is None:
                        continue
                    flag[two[0]], place[two[0]] = True, np.arange(len(two[0]))
                    held = flag[one[0]]
                    flag[two[0]] = False
                    if not held.any():
                        continue
                    where = one[0][held]
                    value = times_a * w[a] * one[1][held] + times_b * w[b] * two[1][place[where]]
                    pair.append(p)
                    top.append(value.max())
                    size.append(len(where))
                    found.append(where)
                    joint.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, 1), batch.column(1).slice(row, 1),
                     *[batch.column(c).slice(row, 1) for c in (3, 4, 5)], _pack(sat, "<i4"),
                     _lists([np.array(pair, np.int32)], pa.int32()), _lists([np.array(top, np.int64)], pa.int64()),
                     _lists([np.array(size, np.int32)], pa.int32()),
                     _pack(np.concatenate(found) if found else np.zeros(0), "<i4"),
                     _pack(np.concatenate(joint) if joint else np.zeros(0), "<i8")], names)

    return index.mapInArrow(add, _READY)


def _units_of(items: Items) -> list[np.ndarray]:
    return np.split(items.unit, items.starts[1:]) if len(items.starts) else []


def thresholds(ready: DataFrame, items: Items, top: int) -> dict[int, int]:
    """For each item a score that its ``top``-th best document reaches, from the joint impacts alone."""
    units = _units_of(items)

    def bounds(batches):
        best = [np.zeros(0, np.int64) for _ in units]
        for batch in batches:
            for row in range(batch.num_rows):
                size = len(batch.column(0)[row])
                pair, n = (_list(batch.column(c), row) for c in (1, 2))
                at, joint = _unpack(batch.column(3), row, "<i4"), _unpack(batch.column(4), row, "<i8")
                ends = np.cumsum(n)
                place = {int(p): i for i, p in enumerate(pair)}
                low = np.zeros(size, np.int64)
                for i, mine in enumerate(units):
                    low[:] = 0
                    for p in mine.tolist():
                        k = place.get(p)
                        if k is not None:
                            part = slice(ends[k] - n[k], ends[k])
                            low[at[part]] += joint[part]
                    both = np.concatenate([best[i], low[low > 0]])
                    best[i] = np.partition(both, len(both) - top)[-top:] if len(both) > top else both
        for i, found in enumerate(best):
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), items.number[i])), pa.array(found)],
                                                 ["item", "low"])

    rows = ready.select("doc_ids", "pair", "n_joint", "joint_at", "joint").mapInArrow(bounds, "item long, low long")
    order = Window.partitionBy("item").orderBy(F.desc("low"))
    kth = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top).where(F.col("k") == top)
    return {r["item"]: r["low"] for r in kth.select("item", "low").collect()}


# ------------------------------------------------------------------ search

_FOUND = "item long, item_id long, doc_id long, score long"


class _Best:
    """The best documents of one item that a task has seen: higher scores first, then smaller ids, NULL last."""

    def __init__(self, top: int, least: int):
        self.top, self.least, self.rows = top, least, []

    def add(self, scores: np.ndarray, ids: list):
        self.rows += [(-int(s), d is None, d if d is not None else 0) for s, d in zip(scores, ids)]
        self.rows.sort()
        del self.rows[self.top:]
        if len(self.rows) == self.top:
            self.least = max(self.least, -self.rows[-1][0])


def score_block(lists: _Postings, bound: np.ndarray, units: np.ndarray, items: Items, acc: np.ndarray,
                least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a block that may belong to an item's best: all with a score of at least ``least``."""
    w, order = items.weights, np.argsort(bound, kind="stable")
    below = np.cumsum(bound[order])
    split = int(np.searchsorted(below, least, side="left"))  # units before it sum to less than the threshold
    rest = int(below[split - 1]) if split else 0
    touched = []
    for u in order[split:]:
        a, times_a, b, times_b = items.pairs[units[u]].tolist()
        for t, times in ((a, times_a), (b, times_b)):
            found = lists.get(t) if t else None
            if found is not None:
                acc[found[0]] += times * w[t] * found[1]
                touched.append(found[0])
    if not touched:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.concatenate(touched)
    docs = np.flatnonzero(acc)
    score = acc[docs]
    acc[seen] = 0
    live = score + rest >= least
    docs, score = docs[live], score[live]
    for u in order[:split][::-1]:
        if not len(docs):
            break
        a, times_a, b, times_b = items.pairs[units[u]].tolist()
        for t, times in ((a, times_a), (b, times_b)):
            found = lists.get(t) if t else None
            if found is not None:
                place = np.minimum(np.searchsorted(found[0], docs), len(found[0]) - 1)
                score = score + np.where(found[0][place] == docs, times * w[t] * found[1][place], 0)
        rest -= int(bound[u])
        live = score + rest >= least
        docs, score = docs[live], score[live]
    return docs, score


def search_blocks(ready: DataFrame, items: Items, least: dict[int, int], top: int) -> DataFrame:
    """Each task's best documents of every item."""
    units = _units_of(items)
    names = [f.split()[0] for f in _FOUND.split(", ")]
    ids = items.ids

    def search(batches):
        best = [_Best(top, least.get(int(i), 0)) for i in items.number]
        a, times_a, b, times_b = items.pairs.T
        w, size = items.weights, len(items.weights)
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids = batch.column(0)[row].values
                term, df, pair, joint_max = (_list(batch.column(c), row) for c in (1, 2, 5, 6))
                at, sat = (_unpack(batch.column(c), row, "<i4") for c in (3, 4))
                if not len(term) or not len(units):
                    continue
                lists = _Postings(term, df, at, sat.astype(np.int64))
                single = np.zeros(size, np.int64)
                single[term] = np.maximum.reduceat(sat, lists.ends - df)
                unit = np.maximum(times_a * w[a] * single[a], times_b * np.where(b > 0, w[b], 0) * single[b])
                unit[pair] = np.maximum(unit[pair], joint_max)
                bound = unit[items.unit]
                whole = np.add.reduceat(bound, items.starts)
                acc = np.zeros(len(doc_ids), np.int64)
                for i in np.flatnonzero(whole > 0):
                    if whole[i] < best[i].least:
                        continue
                    mine = slice(items.starts[i], items.starts[i] + len(units[i]))
                    docs, score = score_block(lists, bound[mine], units[i], items, acc, max(best[i].least, 1))
                    if len(docs) > top:
                        keep = score >= np.partition(score, len(score) - top)[-top]
                        docs, score = docs[keep], score[keep]
                    if len(docs):
                        best[i].add(score, doc_ids.take(pa.array(docs)).to_pylist())
        for i, found in enumerate(best):
            if found.rows:
                k, item = len(found.rows), int(items.number[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * k, pa.int64()), pa.array([ids[item]] * k, pa.int64()),
                     pa.array([None if r[1] else r[2] for r in found.rows], pa.int64()),
                     pa.array([-r[0] for r in found.rows], pa.int64())], names)

    return ready.select("doc_ids", "term", "df", "at", "sat", "pair", "joint_max").mapInArrow(search, _FOUND)


def _round(docs: DataFrame, texts: list[tuple[int | None, bytes]], top: int) -> DataFrame | None:
    """The best documents of the items of one round."""
    numbers: dict[bytes, int] = {}
    counted = [(i, Counter(numbers.setdefault(t, len(numbers) + 1) for t in terms(text))) for i, text in texts]
    if not numbers:
        return None
    index = stored(build_index(docs, numbers), "lexical-index")
    n_docs, n_terms = index.agg(F.sum(F.size("n").cast("long")), F.sum(F.aggregate(
        "n", F.lit(0).cast("long"), lambda acc, v: acc + v))).first()
    if not n_docs:
        return None
    df = index.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term") \
              .agg(F.sum(F.col("x.df").cast("long")).alias("df")).collect()  # at most one row per term of the round
    weights = np.full(len(numbers) + 1, -1, np.int64)
    for r in df:
        weights[r["term"]] = weight(r["df"], n_docs)
    items = pair_items(counted, weights)
    ready = stored(add_pairs(index, items, n_docs, n_terms), "lexical-pairs")
    found = search_blocks(ready, items, thresholds(ready, items, top), top)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top) \
                .select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of every row of ``items``."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary")
                        .alias("text")).where(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = size // ROUND_BYTES + 1
    which = F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds))
    out = None
    for k in range(rounds):
        texts = [(r["item_id"], bytes(r["text"])) for r in rows.where(which == k).collect()]
        found = _round(docs, texts, top) if texts else None
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame(
        [], "item_id long, rank int, doc_id long, score long")


#: DuckDB SQL of the same ranking for top 20 and unique item ids.
SQL = r"""
WITH items AS (SELECT item_id, lower_az.t AS term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t FROM benchmark) lower_az GROUP BY ALL),
words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, total GROUP BY term, n_docs),
norms AS (SELECT doc_id, 75 + (25 * n * n_docs) // n_terms AS m FROM lengths, total),
scores AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM items JOIN tf USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id),
ranks AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranks WHERE rank <= 20"""
