"""BPE encoding and decoding through a distinct-word table.

Four steps, three of them on Spark tasks joined by two shuffles:

1. Split. Texts are split into pre-tokenised words. Documents are taken in
   blocks of about BLOCK_CHARS characters; a block keeps one row of word
   positions (each document as numbers into the block's own word list) and
   sends each distinct word once, grouped by hash bucket.
2. Encode. Rows of a bucket meet in one task (shuffle by bucket): each
   distinct word of the corpus lies in one bucket and is encoded once, by the
   tokenizers library, for all blocks that hold it. A word in every text costs
   one entry for each block, so frequent words cannot make a task hot.
3. Join back by position (shuffle by block): a block's rows return to its word
   positions, which turns every document into its ids.
4. Decode. Ids join the id-to-piece table (fixed by the vocabulary) per
   distinct word of the block; a document is its words' bytes in order.

Words and ids travel as compressed arrays instead of one row for each word and
block. Memory is bounded by a block or a bucket; buckets follow the session's
shuffle partitions. Blocks are numbered by input partition, so the input
should be a table scan or a stored table (a retried task then sees the same rows).

Defined results: NULL or empty text has no ids and decodes to ``''``; NULL
doc_ids and repeated rows are kept; a single text longer than a block is a
block; an empty table gives an empty result; only doc_id and text are read, so
other columns cannot clash. Bytes that are no UTF-8 cannot occur in a text.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty
from .tokens import default_vocab, library, pieces, words

BLOCK_CHARS = 16 << 20
_ROW = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])
_ROW_SQL = "key long, block long, bucket int, blob binary"


def _planes(values: np.ndarray) -> bytes:
    """32-bit integers as four byte planes: high bytes, mostly zero, then cost next to nothing."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(data: bytes, at: int, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").reshape(-1)


def _pack_strings(items: list[bytes]) -> bytes:
    sizes = np.array([len(x) for x in items], dtype=np.uint32)
    return zstandard.compress(len(items).to_bytes(4, "little") + _planes(sizes) + b"".join(items), 3)


def _unpack_strings(blob: bytes) -> list[bytes]:
    data = zstandard.decompress(blob)
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(_unplanes(data, 4, n), dtype=np.int64) + 4 + 4 * n
    starts = np.concatenate([[4 + 4 * n], ends[:-1]]) if n else ends
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _pack_arrays(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(len(a).to_bytes(4, "little") + _planes(a) for a in arrays), 3)


def _unpack_arrays(blob: bytes, k: int) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(blob), 0, []
    for _ in range(k):
        n = int.from_bytes(data[at:at + 4], "little")
        out.append(_unplanes(data, at + 4, n))
        at += 4 + 4 * n
    return out


def _split(n_buckets: int):
    """Step 1: documents to one position row and up to ``n_buckets`` word rows for each block."""

    def rows(block: int, doc_ids: list, slots: list, listed: list[str]):
        flat = np.concatenate(slots)
        # frequent words get small numbers, whose high byte planes then compress away
        by_count = np.argsort(-np.bincount(flat, minlength=len(listed)), kind="stable")
        number = np.empty(len(listed), np.uint32)
        number[by_count] = np.arange(len(listed), dtype=np.uint32)
        raw = [listed[i].encode() for i in by_count]
        bucket = np.fromiter((zlib.crc32(w) % n_buckets for w in raw), np.int64, len(raw))
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        null = np.array([d is None for d in doc_ids], dtype=np.uint32)
        ids = np.array([d or 0 for d in doc_ids], dtype=np.int64)
        position = _pack_arrays(null, (ids & 0xFFFFFFFF).astype(np.uint32), (ids >> 32 & 0xFFFFFFFF).astype(np.uint32),
                                np.array([len(s) for s in slots], dtype=np.uint32), bucket.astype(np.uint32),
                                number[flat])
        out = [(zlib.crc32(block.to_bytes(8, "little")), block, -1, position)]
        for b in range(n_buckets):
            if cuts[b] < cuts[b + 1]:
                out.append((b, block, b, _pack_strings([raw[i] for i in order[cuts[b]:cuts[b + 1]]])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ROW.types)], schema=_ROW)

    def split(batches):
        block, size = TaskContext.get().partitionId() << 32, 0
        doc_ids: list = []
        slots: list = []
        listed: defaultdict = defaultdict(count().__next__)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                found = words(text)
                slots.append(np.fromiter(map(listed.__getitem__, found), np.uint32, len(found)))
                doc_ids.append(doc_id)
                size += len(text) + 1
                if size >= BLOCK_CHARS:
                    yield rows(block, doc_ids, slots, list(listed))
                    block, size, doc_ids, slots = block + 1, 0, [], []
                    listed = defaultdict(count().__next__)
        if doc_ids:
            yield rows(block, doc_ids, slots, list(listed))

    return split


def _encode(vocab: str):
    """Step 2: rows sorted by bucket; word rows become id rows, position rows pass."""

    def encode(batches):
        encoder, current = library(vocab), None
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, block, bucket, blob = row
                if bucket >= 0:
                    if bucket != current:
                        current, known = bucket, {}
                    listed = _unpack_strings(blob)
                    new = [w for w in listed if w not in known]
                    for w, e in zip(new, encoder.encode_batch([w.decode() for w in new], add_special_tokens=False)):
                        known[w] = e.ids
                    ids = [known[w] for w in listed]
                    blob = _pack_arrays(np.array([len(i) for i in ids], dtype=np.uint32),
                                        np.array([x for i in ids for x in i], dtype=np.uint32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip((key, block, bucket, blob), _ROW.types)], schema=_ROW)

    return encode


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + sizes[i] - 1 for all i, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _join_back(vocab: str):
    """Steps 3 and 4: a block's position row, then its id rows by bucket, to ids and decoded texts."""

    def documents(position: bytes, by_bucket: dict[int, bytes]):
        null, low, high, sizes, bucket, slots = _unpack_arrays(position, 6)
        table = pieces(vocab)
        counts, flat, words_ = [], [], []
        for b in sorted(by_bucket):
            n, ids = _unpack_arrays(by_bucket[b], 2)
            counts.append(n)
            flat.append(ids)
            ends = np.cumsum(n)
            listed = ids.tolist()
            words_ += [b"".join(map(table.__getitem__, listed[e - k:e])) for e, k in zip(ends.tolist(), n.tolist())]
        none = np.zeros(0, np.uint32)
        per, ids = np.concatenate(counts or [none]).astype(np.int64), np.concatenate(flat or [none])
        if len(per) != len(bucket):
            raise ValueError("a block misses words of its list")
        # word rows hold a block's words by bucket, in the order of their numbers
        order = np.argsort(bucket, kind="stable")
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        first = np.cumsum(per) - per
        places = at[slots]
        doc_ids, n_tokens, raw, texts, pos = [], [], [], [], 0
        ids_low = low.astype(np.int64) | high.astype(np.int32).astype(np.int64) << 32
        for k, n in enumerate(sizes.tolist()):
            here = places[pos:pos + n]
            pos += n
            own = ids[_ragged(first[here], per[here])]
            doc_ids.append(None if null[k] else int(ids_low[k]))
            n_tokens.append(len(own))
            raw.append(own.astype("<u4").tobytes())
            texts.append(b"".join([words_[i] for i in here.tolist()]).decode("utf-8", "replace"))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(raw, pa.binary()),
             pa.array(texts, pa.large_string()).cast(pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    def join(batches):
        block, position, by_bucket = None, b"", {}
        for batch in batches:
            for b, bucket, blob in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if bucket < 0:
                    if block is not None:
                        yield documents(position, by_bucket)
                    block, position, by_bucket = b, blob, {}
                elif b == block:
                    by_bucket[bucket] = blob
                else:
                    raise ValueError("id rows without their block")
        if block is not None:
            yield documents(position, by_bucket)

    return join


def encode_decode(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the text decoded from them."""
    vocab = vocab or default_vocab()
    buckets = max(64, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
                .mapInArrow(_split(buckets), _ROW_SQL)
    encoded = split.repartition("key").sortWithinPartitions("bucket", "block").mapInArrow(_encode(vocab), _ROW_SQL)
    return encoded.repartition("block").sortWithinPartitions("block", "bucket").select("block", "bucket", "blob") \
                  .mapInArrow(_join_back(vocab), "doc_id long, n_tokens long, ids binary, decoded string")
