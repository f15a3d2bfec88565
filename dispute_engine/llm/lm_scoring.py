"""Language-model scoring: cross-entropy difference of matched target and background models.

Both models are interpolated bigram models over the ids of one fixed public
vocabulary. Target: texts labelled as good; background: all texts. Every pair
(previous id, id) is counted under its own exact key, so the number of counts
grows with the input. The first id of a text follows a start context of its
own, outside the vocabulary and counted once per text. The
background's counts are scaled to the target's number of tokens, so both
models carry the same weight of evidence against their shared unigram prior,
which has one number per vocabulary id.

Counting and scoring stay distributed. Texts are encoded once and held in blocks of
about BLOCK tokens; a block hands on each of its distinct pairs once, as a
row with its counts. A groupBy on (previous id, id) adds them up, a join on the
same key gives every block its pairs' totals, and those meet the block's ids to
be scored. However often a pair occurs, it has one row per block, so no key
holds more than one in the number of distinct pairs of a block.

A text that the target was learned from is scored without its own share of it: its own pair and context counts are
taken out of the target's (exactly, they are integers), so what moves its score is its text and not
its label. The background holds every text, the scored one too.

A text's losses are mean negative log probabilities per token (natural log);
score = background_loss - target_loss, higher for texts like the target.

Defined results: NULL or empty text has no tokens, zero losses and score 0.0;
a NULL doc_id belongs to the background only; without target rows both losses
are equal to the shared prior's and the score is 0.0 up to scaling; repeated
rows count and score like any other; an empty table gives an empty result; only
doc_id and text (quality of labels) are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .tokens import default_vocab, encoder, pieces

BLOCK = 1 << 20         # tokens of the texts whose pairs are handed on together
STRENGTH = 200.0        # pseudo-counts of the unigram prior after each id

_HELD = "block long, doc_id long, ids binary, previous int, id int, background long, target long"
_FOUND = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _keys(ids: np.ndarray, start: int) -> np.ndarray:
    """previous id * (start + 1) + id of every id; the first follows ``start``, the number behind the vocabulary's ids."""
    return np.concatenate([[start], ids[:-1]]) * (start + 1) + ids


def _own(values: np.ndarray) -> np.ndarray:
    """How often each value occurs among ``values``."""
    _, at, n = np.unique(values, return_inverse=True, return_counts=True)
    return n[at]


def _hold(vocab: str, most: int):
    """Texts as ids by block, and each block's distinct pairs with their counts."""
    names = [f.split()[0] for f in _HELD.split(", ")]

    room = len(pieces(vocab)) + 1

    def pairs(block: int, keys: list[np.ndarray]) -> pa.RecordBatch:
        both, n = np.unique(np.concatenate(keys), return_counts=True)  # 2 * key + good
        key, at = np.unique(both >> 1, return_inverse=True)
        background, target = (np.bincount(at, w, len(key)).astype(np.int64) for w in (n, n * (both & 1)))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(key), block)), pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.binary()),
             pa.array((key // room).astype(np.int32)), pa.array((key % room).astype(np.int32)),
             pa.array(background), pa.array(target)], names)

    def hold(batches):
        encode, start = encoder(vocab), len(pieces(vocab))
        block, keys, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            of, held = [], []
            for text, good in zip(batch.column(1), batch.column(2).to_pylist()):
                ids = np.array(encode(text.as_py() or ""), dtype=np.int64)
                of.append(block)
                held.append(zstandard.compress(ids.astype("<u4").tobytes(), 1))
                if not len(ids):
                    continue
                keys.append(2 * _keys(ids, start) + int(good))
                size += len(ids)
                if size >= most:
                    yield pairs(block, keys)
                    block, keys, size = block + 1, [], 0
            n = len(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(of, pa.int64()), batch.column(0), pa.array(held, pa.binary()),
                 *[pa.nulls(n, pa.int32())] * 2, pa.nulls(n, pa.int64()), batch.column(2).cast(pa.int64())], names)
        if keys:
            yield pairs(block, keys)

    return hold


def _held(docs: DataFrame, labels: DataFrame, vocab: str) -> tuple[DataFrame, DataFrame]:
    """(block, doc_id, ids and target (1 or 0) of every row of ``docs``; every block's pairs with their counts)."""
    good = labels.where(F.col("quality") == 1).select("doc_id").distinct().withColumn("good", F.lit(True))
    # always a sort-merge join: a broadcast that only small label tables get would change the plan with the size
    rows = docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left") \
               .select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("good", F.lit(False)).alias("good"))
    held = stored(rows.mapInArrow(_hold(vocab, BLOCK), _HELD), "lm-held")
    return (held.where(F.col("ids").isNotNull()).select("block", "doc_id", "ids", "target"),
            held.where(F.col("ids").isNull()).select("block", "previous", "id", "background", "target"))


def _totals(pairs: DataFrame) -> DataFrame:
    """Background and target counts of every (previous, id)."""
    return stored(pairs.groupBy("previous", "id").agg(F.sum("background").alias("background"),
                                                      F.sum("target").alias("target")), "lm-pairs")


def _by(totals: DataFrame, key: str, size: int) -> np.ndarray:
    """Counts (2 x ids and start context) by one side of the pairs: one row per vocabulary id reaches the driver."""
    out = np.zeros((2, size + 1), np.int64)
    for r in totals.groupBy(key).agg(F.sum("background").alias("b"), F.sum("target").alias("t")).collect():
        out[:, r[key]] = r["b"], r["t"]
    return out


def counts(docs: DataFrame, labels: DataFrame, vocab: str) -> np.ndarray:
    """Counts of the ids (and, last, the start context: 0), background and target."""
    return _by(_totals(_held(docs, labels, vocab)[1]), "id", len(pieces(vocab)))


def _score(start: int, prior: np.ndarray, after: np.ndarray, scale: float):
    """Rows sorted by block, its pairs' totals before its texts."""

    def score(batches):
        current, parts, keys, known = None, [], None, None
        for batch in batches:
            block, kind = (batch.column(i).to_numpy() for i in (0, 1))
            ends = np.flatnonzero(np.diff(block) | np.diff(kind)) + 1
            for a, b in zip([0, *ends], [*ends, len(block)]):
                if block[a] != current:
                    current, parts, keys = block[a], [], None
                run = batch.slice(a, b - a)
                if not kind[a]:
                    previous, i, *n = (run.column(c).to_numpy().astype(np.int64) for c in range(4, 8))
                    parts.append((previous * (start + 1) + i, np.stack([n[0] * scale, n[1].astype(np.float64)])))
                    continue
                if keys is None:
                    keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
                    known = np.concatenate([p[1] for p in parts], axis=1) if parts else None
                    order = np.argsort(keys)
                    keys, known = keys[order], known[:, order] if parts else None
                n_tokens, losses = [], ([], [])
                for blob, good in zip(run.column(3).to_pylist(), run.column(7).to_pylist()):
                    ids = np.frombuffer(zstandard.decompress(blob), "<u4").astype(np.int64)
                    n_tokens.append(len(ids))
                    if not len(ids):
                        losses[0].append(0.0)
                        losses[1].append(0.0)
                        continue
                    key = _keys(ids, start)
                    at, base = np.searchsorted(keys, key), STRENGTH * prior[ids]
                    before = key // (start + 1)
                    for row in (0, 1):
                        pair, context = known[row, at], after[row, before]
                        if row and good:
                            pair, context = pair - _own(key), context - _own(before)
                        p = (pair + base) / (context + STRENGTH)
                        losses[row].append(float(-np.log(p).mean()))
                background, target = (np.array(x) for x in losses)
                yield pa.RecordBatch.from_arrays(
                    [run.column(2), pa.array(n_tokens, pa.int64()), pa.array(target, pa.float64()),
                     pa.array(background, pa.float64()), pa.array(background - target, pa.float64())],
                    [f.split()[0] for f in _FOUND.split(", ")])

    return score


def lm_scores(docs: DataFrame, labels: DataFrame, vocab: str | None = None) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score for every row of ``docs``."""
    vocab = vocab or default_vocab()
    texts, pairs = _held(docs, labels, vocab)
    totals = _totals(pairs)
    size = len(pieces(vocab))
    unigrams, after = _by(totals, "id", size), _by(totals, "previous", size).astype(np.float64)
    n_background, n_target = unigrams.sum(axis=1).tolist()
    prior = (unigrams[0, :size] + 1.0) / (n_background + size)
    scale = n_target / n_background if n_background else 0.0
    after[0] *= scale
    # sort-merge at every size, as above
    replies = pairs.select("block", "previous", "id").join(totals.hint("merge"), ["previous", "id"])
    nothing = F.lit(None)
    both = replies.select("block", F.lit(0).alias("kind"), nothing.cast("long").alias("doc_id"),
                          nothing.cast("binary").alias("ids"), "previous", "id", "background", "target").unionByName(
        texts.select("block", F.lit(1).alias("kind"), "doc_id", "ids", nothing.cast("int").alias("previous"),
                     nothing.cast("int").alias("id"), nothing.cast("long").alias("background"), "target"))
    return both.repartition("block").sortWithinPartitions("block", "kind") \
               .mapInArrow(_score(size, prior, after, scale), _FOUND)
