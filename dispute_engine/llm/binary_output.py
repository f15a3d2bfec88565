"""Token-id output: range asymmetric numeral system segments in ascending doc_id order.

Write: the texts are range-partitioned and sorted by doc_id; each task encodes
its documents once and writes segments of about SEGMENT ids (format in
``rans.py``: a frequency table shared by independent interleaved blocks, with
checkpoints and checksums) as rows of a Parquet table, the container any
store Spark reaches can hold. Read: every segment decodes on its own; only one
total per range partition reaches the driver to place partitions one after
the other.

Defined results: NULL or empty text is the end id alone; NULL doc_ids come
first; rows with equal doc_id stay side by side, ordered by text; an empty
table gives an empty result; only doc_id and text are read, so further columns
cannot clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .shared import text_or_empty
from .tokens import default_vocab, encoder

END_ID = 2
SEGMENT = 1 << 21

_SEGMENT = pa.schema([("part", pa.int64()), ("segment", pa.int64()), ("start_in_part", pa.int64()),
                      ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])


def write_ids(docs: DataFrame, path: str, vocab: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of every document, each ended by ``end_id``, to ``path``."""
    vocab = vocab or default_vocab()

    def encode(batches):
        to_ids, part = encoder(vocab), TaskContext.get().partitionId()
        segment, start, held, size = 0, 0, [], 0
        doc_ids: list = []

        def flush():
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            lengths = np.array([len(x) for x in held], dtype=np.uint32)
            row = {"part": part, "segment": segment, "start_in_part": start, "n_ids": len(ids),
                   "doc_ids": list(doc_ids), "payload": rans.encode_segment(lengths, ids)}
            return pa.RecordBatch.from_pylist([row], schema=_SEGMENT)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(np.array([*to_ids(text.as_py()), end_id], dtype=np.uint32))
                doc_ids.append(doc_id)
                size += len(held[-1])
                if size >= SEGMENT:
                    yield flush()
                    segment, start = segment + 1, start + size
                    held.clear()
                    doc_ids.clear()
                    size = 0
        if held:
            yield flush()

    schema = "part long, segment long, start_in_part long, n_ids long, doc_ids array<long>, payload binary"
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text") \
        .mapInArrow(encode, schema) \
        .write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids as little-endian unsigned
    32-bit integers if ``with_ids``), decoded from the segments under ``path``."""
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row per range partition
    base, first = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        base[r["part"]] = first
        first += r["n"]

    def decode(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part, start, doc_ids, payload = (batch.column(c)[k].as_py() for c in range(4))
                lengths, ids = rans.decode_segment(payload)
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                chunks = [raw[4 * (e - n):4 * e] for n, e in zip(lengths.tolist(), ends.tolist())]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(base[part] + start + ends - lengths),
                        pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(c) for c in chunks], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(chunks, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return files.select("part", "start_in_part", "doc_ids", "payload").mapInArrow(decode, schema)
