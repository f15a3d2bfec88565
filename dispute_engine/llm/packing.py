"""Packing token pieces into fixed windows by minimum bin slack.

Documents are cut every ``window`` ids; the pieces (mostly the remainders) are
packed so that windows carry as little padding as possible. A sequence is
padded to ``window`` unless its length is a power of two.

Method. The multiset of piece lengths is a histogram of at most ``window``
counts, whatever the data size; it is the only thing the driver sees. A
minimum-bin-slack search fills windows from it: the longest remaining length
must go in, a bitset subset-sum dynamic programme (one bit for each reachable
sum, binary-split counts) finds the sum closest to the window, and
backtracking gives the counts of each length. The chosen pattern is applied as
often as the counts allow, so the number of patterns depends on the window,
not on the data. Spark then ranks the pieces of each length (salted, so that
one length may hold any share of them) and a rank decides its sequence and
offset by a binary search in the pattern table.

Defined results: NULL or empty text is one piece holding the end id alone; a
NULL doc_id is packed like any other; repeated rows each get their own pieces;
an empty table gives an empty result; only the doc_id and text columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored
from .tokens import default_vocab, encoder

WINDOW = 1024
END_ID = 0
#: Pieces per (length, salt) group that one task ranks, on average at most.
RANK_GROUP = 20_000

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, window: int = WINDOW, vocab: str | None = None, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (and the
    piece's ids as little-endian unsigned 32-bit integers if ``with_ids``)."""
    vocab = vocab or default_vocab()

    def cut(batches):
        encode = encoder(vocab)
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, text in zip(ids_of, texts):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                data = ids.tobytes()
                for start in range(0, len(ids), window):
                    piece = data[4 * start:4 * (start + window)]
                    for column, value in zip(out, (doc_id, start, len(piece) // 4, zlib.crc32(piece), len(ids),
                                                   piece if with_ids else None)):
                        column.append(value)
            cols = [pa.array(c, pa.int64()) for c in out[:5]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols.append(pa.array(out[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def fill_window(counts: dict[int, int], window: int) -> dict[int, int]:
    """Counts of the lengths that share one window, the longest remaining length among them.

    Bit s of ``reach`` says that sum s can be made. A full window is best; a
    sum that is a power of two needs no padding either; else the largest sum."""
    longest = max(counts)
    reach, mask, steps = 1 << longest, (1 << (window + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), (window - longest) // length)
        take = 1
        while left > 0 and not reach >> window & 1:
            take = min(take, left)
            grown = (reach | reach << length * take) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            take *= 2
        if reach >> window & 1:
            break
    if reach >> window & 1:
        target = window
    else:
        powers = [1 << k for k in range(window.bit_length()) if reach >> (1 << k) & 1]
        target = powers[-1] if powers else reach.bit_length() - 1
    chosen = {longest: 1}
    for length, take, before in reversed(steps):
        if not before >> target & 1:
            chosen[length] = chosen.get(length, 0) + take
            target -= length * take
    return chosen


def patterns(histogram: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """(counts of lengths in one window, number of such windows), using every piece once."""
    left, found = {k: v for k, v in histogram.items() if v > 0}, []
    while left:
        chosen = fill_window(left, window)
        times = min(left[length] // need for length, need in chosen.items())
        found.append((chosen, times))
        for length, need in chosen.items():
            left[length] -= need * times
            if not left[length]:
                del left[length]
    return found


def _rank_table(found: list[tuple[dict[int, int], int]], window: int):
    """For each length: first ranks, pieces per window, first sequence and first offset of its patterns."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for chosen, times in found:
        offset = 0
        for length in sorted(chosen, reverse=True):
            need = chosen[length]
            rows.setdefault(length, []).append((used.get(length, 0), need, sequence, offset))
            used[length] = used.get(length, 0) + need * times
            offset += length * need
        sequence += times
    return {length: np.array(r, dtype=np.int64).T for length, r in rows.items()}


def ranked(parts: DataFrame, total: int) -> DataFrame:
    """``parts`` with ``rank``: 0, 1, 2 ... within each length, in no particular order.

    A length may hold any share of the pieces, so each is split by a salt;
    ranks within a salt start at the number of pieces in earlier salts."""
    salts = total // RANK_GROUP + 1
    rows = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    return rows.withColumn("inner", F.row_number().over(inside) - 1).join(starts, ["length", "salt"]) \
               .withColumn("rank", F.col("first") + F.col("inner")).drop("salt", "inner", "first")


def pack(parts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces (read more than once: pass a stored one)."""
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = _rank_table(patterns(histogram, window), window)
    placed = ranked(parts, sum(histogram.values()))
    at, names = {n: i for i, n in enumerate(placed.columns)}, [c for c in placed.columns if c != "rank"]

    def place(batches):
        for batch in batches:
            length = batch.column(at["length"]).to_numpy(zero_copy_only=False)
            rank = batch.column(at["rank"]).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                first, need, base, start = table[int(length[rows[0]])]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                j = rank[rows] - first[k]
                sequence[rows] = base[k] + j // need[k]
                offset[rows] = start[k] + j % need[k] * length[rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(at[n]) for n in names] + [pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema if f.name != "rank")
    return placed.mapInArrow(place, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, window: int = WINDOW, vocab: str | None = None,
                   with_ids: bool = False) -> DataFrame:
    """Pieces of every document with their place in the packed sequences."""
    return pack(stored(pieces(docs, window, vocab, with_ids=with_ids), "pieces"), window)
