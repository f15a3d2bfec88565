"""Language identification: unigram piece models summed over all segmentations.

The pieces are those of a fixed public byte-level vocabulary (a parameter; it
holds every single byte, so every text has a segmentation). Each language has
a probability for each piece, learned by one expectation step over all
segmentations of its training words (uniform start) and one maximisation step with
pooled smoothing. A word's probability is the sum over all its segmentations, by the
forward algorithm; a text's score adds the words' logs and the log prior.
The model has at most (pieces x languages) numbers, which is its broadcast bound.

Rows whose crc32(doc_id as text) mod 3 is 1 are held out. Words are
lower-cased runs without white space, marked by a leading space, and whole: each distinct word of a task is
scored once, words of equal length up to SHORT bytes together (numpy), longer ones (and texts of scripts without spaces) one by
one with a rolling, rescaled forward sum that is linear in their length and holds as many rows as the longest
piece has bytes.

Defined results: ``und`` with score 0.0 for NULL text or text without a
letter, and for every text when no training row exists; equal scores go to the
language first in alphabetical order; a NULL doc_id counts as not held out
and is trained on; repeated rows score alike; an empty table gives an empty
result; only doc_id, text and lang are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import default_vocab, pieces

FOLDS, HELD_OUT = 3, 1
CHUNK = SHORT = 24      # bytes up to which words of equal length are scored together
RESCALE = 8             # positions of a longer word between two rescalings
GROUP = 8_192           # words of one length scored together
FLUSH = 300_000         # distinct words a task holds
SMOOTHING = 2_000.0     # pseudo-counts of the pooled distribution in each language
MAX_LANGUAGES = 512     # bound of the broadcast model

_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


class PieceTable:
    """Ids of byte strings, looked up for whole arrays of them by a 64-bit hash.

    Each table holds the pieces that found a slot of their own; the few that
    did not go to the next one. A hit is confirmed by the full hash."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, vocab: str):
        every = [(i, p) for i, p in enumerate(pieces(vocab)) if p]
        listed = [(i, p) for i, p in every if len(p) <= SHORT]  # a longer piece cannot occur in a short word
        self.size = len(pieces(vocab))
        # for long words: all pieces by their bytes, and the lengths of those that share two leading bytes
        self.ids = {p: i for i, p in every}
        self.longest = max((len(p) for _, p in every), default=1)
        lengths = defaultdict(set)
        for _, p in every:
            lengths[p[:2]].add(len(p))
        self.lengths = {k: sorted(v) for k, v in lengths.items()}
        self.keys = np.zeros(self.size, np.uint64)
        by_length = defaultdict(list)
        for i, p in listed:
            by_length[len(p)].append((i, p))
        for n, group in by_length.items():
            raw = np.frombuffer(b"".join(p for _, p in group), np.uint8).reshape(-1, n)
            self.keys[[i for i, _ in group]] = self.hashes(raw)(0, n)
        left, self.tables = np.array([i for i, _ in listed]), []
        for bits in (20, 16, 16, 16):
            table = np.zeros(1 << bits, np.int32)
            slot = self._slot(self.keys[left], len(self.tables), bits)
            _, first = np.unique(slot, return_index=True)
            table[slot[first]] = left[first]
            self.tables.append((bits, table))
            left = np.delete(left, first)
            if not len(left):
                break
        if len(left):
            raise ValueError("pieces without a slot")

    @staticmethod
    def _slot(keys: np.ndarray, k: int, bits: int) -> np.ndarray:
        return (keys * np.uint64((0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F)[k])
                >> np.uint64(64 - bits)).astype(np.int64)

    @classmethod
    def hashes(cls, raw: np.ndarray):
        """A function of (start, end): the hash of that part of every row of ``raw``."""
        n = raw.shape[1]
        up = np.array([pow(cls.BASE, i, 1 << 64) for i in range(n)], dtype=np.uint64)
        down = np.array([pow(cls.BASE, -i, 1 << 64) for i in range(n)], dtype=np.uint64)
        total = np.zeros((n + 1, len(raw)), np.uint64)
        np.cumsum((raw.T.astype(np.uint64) + np.uint64(1)) * up[:, None], axis=0, out=total[1:])

        def part(i: int, j: int) -> np.ndarray:
            x = (total[j] - total[i]) * down[i] + np.uint64(j - i)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            return x ^ (x >> np.uint64(27))

        return part

    def starting(self, data: bytes, i: int) -> list[tuple[int, int]]:
        """(length, id) of every piece that ``data`` has at position i."""
        out = [(1, self.ids[data[i:i + 1]])] if data[i:i + 1] in self.ids else []
        for n in self.lengths.get(data[i:i + 2], ()):
            if n > 1 and (piece := self.ids.get(data[i:i + n])) is not None and i + n <= len(data):
                out.append((n, piece))
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the keys that are pieces, their ids)."""
        where, ids = [], []
        for k, (bits, table) in enumerate(self.tables):
            piece = table[self._slot(keys, k, bits)]
            hit = np.flatnonzero(self.keys[piece] == keys)
            where.append(hit)
            ids.append(piece[hit])
        return np.concatenate(where), np.concatenate(ids)


@lru_cache(maxsize=2)
def _piece_table(vocab: str) -> PieceTable:
    return PieceTable(vocab)


def _marked(word: str) -> bytes:
    return b" " + word.encode()


def _groups(words: list[bytes]):
    """(length, positions) of short words of equal length, GROUP at most at a time."""
    by_length = defaultdict(list)
    for k, c in enumerate(words):
        if len(c) <= SHORT:
            by_length[len(c)].append(k)
    for n, where in by_length.items():
        for i in range(0, len(where), GROUP):
            yield n, where[i:i + GROUP]


def _edges(chunks: list[bytes], n: int, table: PieceTable):
    """For every start and end: which of the chunks have a piece there, and its id."""
    part = table.hashes(np.frombuffer(b"".join(chunks), np.uint8).reshape(-1, n))
    for i in range(n):
        for j in range(i + 1, n + 1):
            k, piece = table.find(part(i, j))
            if len(k):
                yield i, j, k, piece


def expected_counts(weights: dict[bytes, float], table: PieceTable) -> np.ndarray:
    """Expected piece counts of weighted words over all segmentations, every piece equally likely."""
    out, listed, p = np.zeros(table.size), list(weights), 1.0 / table.size
    for n, where in _groups(listed):
        group = [listed[k] for k in where]
        edges = list(_edges(group, n, table))
        forward, backward = np.zeros((n + 1, len(group))), np.zeros((n + 1, len(group)))
        forward[0], backward[n] = 1.0, 1.0
        for i, j, k, _ in edges:
            forward[j, k] += forward[i, k] * p
        for i, j, k, _ in reversed(edges):
            backward[i, k] += backward[j, k] * p
        share = np.array([weights[c] for c in group]) / forward[n]
        for i, j, k, piece in edges:
            np.add.at(out, piece, forward[i, k] * backward[j, k] * p * share[k])
    for word in listed:
        if len(word) > SHORT:
            _long_counts(word, weights[word], table, math.log(p), out)
    return out


def _long_counts(word: bytes, weight: float, table: PieceTable, log_p: float, out: np.ndarray) -> None:
    """Adds a long word's expected piece counts: log sums of the paths to and from every position, then every edge."""
    n = len(word)
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0.0
    for i in range(n):
        for length, _ in table.starting(word, i):
            forward[i + length] = np.logaddexp(forward[i + length], forward[i] + log_p)
    for i in range(n - 1, -1, -1):
        for length, _ in table.starting(word, i):
            backward[i] = np.logaddexp(backward[i], backward[i + length] + log_p)
    for i in range(n):
        for length, piece in table.starting(word, i):
            out[piece] += weight * math.exp(forward[i] + log_p + backward[i + length] - forward[n])


def _long_log_probability(word: bytes, table: PieceTable, p: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations of a long word, for each language."""
    rows = table.longest + 1
    forward, scale = np.zeros((rows, p.shape[1])), np.zeros(p.shape[1])
    forward[0] = 1.0
    for i in range(len(word)):
        here = forward[i % rows].copy()
        forward[i % rows] = 0.0
        for length, piece in table.starting(word, i):
            forward[(i + length) % rows] += here * p[piece]
        if i % RESCALE == RESCALE - 1:
            most = forward.max(axis=0)
            forward /= most
            scale += np.log(most)
    return np.log(forward[len(word) % rows]) + scale


def log_probabilities(chunks: list[bytes], table: PieceTable, p: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations, for each word and language; ``p``: piece x language."""
    out = np.zeros((len(chunks), p.shape[1]))
    for k, word in enumerate(chunks):
        if len(word) > SHORT:
            out[k] = _long_log_probability(word, table, p)
    for n, where in _groups(chunks):
        group = [chunks[k] for k in where]
        forward = np.zeros((n + 1, len(group), p.shape[1]))
        forward[0] = 1.0
        for i, j, k, piece in _edges(group, n, table):
            forward[j, k] += forward[i, k] * p[piece]
        out[where] = np.log(forward[n])
    return out


def fit(docs: DataFrame, vocab: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, piece x language probabilities) from the training rows."""
    size = len(pieces(vocab))

    def expect(batches):
        found = _piece_table(vocab)
        words: dict[str, Counter] = defaultdict(Counter)
        n_docs: Counter = Counter()

        def flush():
            for lang, counted in words.items():
                counts = expected_counts({_marked(w): n for w, n in counted.items()}, found)
                where = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(where) + 1)), pa.array(np.append(where, -1), pa.int64()),
                     pa.array(np.append(counts[where], n_docs[lang]))], ["lang", "piece", "n"])
            words.clear()
            n_docs.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words[lang].update((text.as_py() or "").lower().split())
                n_docs[lang] += 1
                if sum(map(len, words.values())) >= FLUSH:
                    yield from flush()
        yield from flush()

    train = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    summed = train.mapInArrow(expect, "lang string, piece long, n double").groupBy("lang", "piece") \
                  .agg(F.sum("n").alias("n"))
    rows = summed.toArrow().to_pydict()  # at most pieces x languages
    langs = sorted(set(rows["lang"]))
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the model holds {MAX_LANGUAGES}")
    counts, n_docs = np.zeros((size, len(langs))), np.zeros(len(langs))
    at = {lang: k for k, lang in enumerate(langs)}
    for lang, piece, n in zip(rows["lang"], rows["piece"], rows["n"]):
        if piece < 0:
            n_docs[at[lang]] = n
        else:
            counts[piece, at[lang]] = n
    pooled = counts.sum(axis=1)
    pooled = 0.99 * pooled / max(pooled.sum(), 1e-12) + 0.01 / size
    table = (counts + SMOOTHING * pooled[:, None]) / (counts.sum(axis=0) + SMOOTHING)
    return langs, np.log(np.maximum(n_docs, 1) / max(n_docs.sum(), 1)), table


def identify(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the posterior) for every row of ``docs``."""
    vocab = vocab or default_vocab()
    langs, prior, table = fit(docs, vocab)

    def predict(batches):
        known = _piece_table(vocab)
        at: dict[str, int] = {}
        logs = np.zeros((0, len(langs)))

        def learn(new: list[str]):
            nonlocal logs
            logs = np.concatenate([logs, log_probabilities([_marked(w) for w in new], known, table)])
            at.update(zip(new, range(len(at), len(at) + len(new))))

        for batch in batches:
            out_lang, out_score = [], []
            for text in batch.column(1):
                text = text.as_py()
                if not langs or not text or not _LETTER.search(text):
                    out_lang.append("und")
                    out_score.append(0.0)
                    continue
                found = Counter(text.lower().split())
                if len(at) > FLUSH:
                    at.clear()
                    logs = logs[:0]
                pending.append((len(out_lang), found))
                out_lang.append(None)
                out_score.append(None)
                if sum(len(f) for _, f in pending) > FLUSH:
                    settle(pending, at, learn, lambda: logs, out_lang, out_score)
            settle(pending, at, learn, lambda: logs, out_lang, out_score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(out_lang, pa.string()), pa.array(out_score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    pending: list = []

    def settle(pending, at, learn, logs, out_lang, out_score):
        """Scores the texts that wait, after learning their new words together."""
        new = list(dict.fromkeys(w for _, f in pending for w in f if w not in at))
        if new:
            learn(new)
        for k, found in pending:
            rows = np.fromiter(map(at.__getitem__, found), np.int64, len(found))
            total = np.fromiter(found.values(), float, len(found)) @ logs()[rows] + prior
            best = int(np.argmax(total))
            out_lang[k], out_score[k] = langs[best], float(1 / np.exp(total - total[best]).sum())
        pending.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       held_out(F.col("doc_id")).alias("held_out")) \
               .mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
