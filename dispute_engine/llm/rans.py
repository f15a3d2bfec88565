"""Static range asymmetric numeral system over token ids (numpy, vectorised over lanes).

A segment holds the ids of consecutive documents: one frequency table, shared
by its blocks, and blocks that decode independently. Inside a block ``lanes``
coder states are interleaved (id i belongs to lane i mod lanes), so every step
is a few array operations; checkpoints repeat the lane states and the stream
position every CHECKPOINT steps, so a block can also be entered in its middle.
Every block carries a CRC-32 of its ids, and the segment one of its bytes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20                  # frequencies sum to 2 ** SCALE
LOW = 1 << 31               # states stay in [LOW, LOW << 32)
BLOCK = 1 << 18             # ids in a block
LANES = 512
CHECKPOINT = 128            # steps between checkpoints
MAGIC = b"RANSIDS1"

_HEAD = struct.Struct("<8sQIII")     # magic, ids, documents, symbols, blocks
_BLOCK = struct.Struct("<IIIII")     # ids, lanes, words, checkpoints, crc32 of the ids


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, scaled frequencies): every symbol that occurs keeps 1 or more, the sum is 2 ** SCALE."""
    if not len(ids):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    if len(symbols) > 1 << SCALE:
        raise ValueError("more symbols than the scale can hold")
    exact = counts[symbols] * (float(1 << SCALE) / len(ids))
    freq = np.maximum(1, np.floor(exact)).astype(np.int64)
    spare = (1 << SCALE) - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if spare > 0:
        freq[order[0]] += spare
    while spare < 0:  # rounding up rare symbols took too much: give it back from the frequent ones
        cut = np.minimum(freq[order] - 1, np.maximum(1, freq[order] >> 4))
        kept = np.minimum(np.cumsum(cut), -spare)
        cut = np.diff(kept, prepend=0)
        freq[order] -= cut
        spare += int(cut.sum())
    return symbols.astype(np.uint32), freq.astype(np.uint32)


def _lanes(n: int) -> int:
    return max(1, min(LANES, n // 32))


def encode_block(ids: np.ndarray, freq_of: np.ndarray, start_of: np.ndarray) -> bytes:
    n, lanes = len(ids), _lanes(len(ids))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
    marks: list[tuple[int, np.ndarray]] = []
    for s in range(steps - 1, -1, -1):
        part = ids[s * lanes:(s + 1) * lanes]
        x = state[:len(part)]
        f, c = freq_of[part], start_of[part]
        full = x >= f << np.uint64(63 - SCALE)
        if full.any():
            words[s] = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[:len(part)] = (q << np.uint64(SCALE)) + (x - q * f) + c
        if s and s % CHECKPOINT == 0:
            marks.append((s, state.copy()))
    at = np.cumsum([0] + [len(w) for w in words])
    stream = np.concatenate(words).astype("<u4") if steps else np.zeros(0, "<u4")
    out = [_BLOCK.pack(n, lanes, len(stream), len(marks), zlib.crc32(ids.astype("<u4").tobytes())),
           state.astype("<u8").tobytes()]
    for s, x in reversed(marks):
        out += [struct.pack("<II", s, int(at[s])), x.astype("<u8").tobytes()]
    return b"".join([*out, stream.tobytes()])


def decode_block(data: memoryview, table: tuple, checkpoint: int = -1) -> tuple[np.ndarray, int]:
    """(ids, bytes used). With ``checkpoint`` k, only the ids from the k-th checkpoint on."""
    symbol_at, freq_at, start_at = table
    n, lanes, n_words, n_marks, crc = _BLOCK.unpack_from(data)
    pos = _BLOCK.size
    state = np.frombuffer(data, "<u8", lanes, pos).astype(np.uint64)
    pos += 8 * lanes
    first, at = 0, 0
    for k in range(n_marks):
        s, word = struct.unpack_from("<II", data, pos)
        if k == checkpoint:
            first, at, state = s, word, np.frombuffer(data, "<u8", lanes, pos + 8).astype(np.uint64)
        pos += 8 + 8 * lanes
    stream = np.frombuffer(data, "<u4", n_words, pos)
    steps = -(-n // lanes)
    out = np.empty(n, np.uint32)
    low, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for s in range(first, steps):
        k = min(lanes, n - s * lanes)
        x = state[:k]
        slot = (x & low).astype(np.int64)
        out[s * lanes:s * lanes + k] = symbol_at[slot]
        x = freq_at[slot] * (x >> shift) + start_at[slot]
        need = np.flatnonzero(x < LOW)
        if len(need):
            x[need] = (x[need] << np.uint64(32)) | stream[at:at + len(need)]
            at += len(need)
        state[:k] = x
    if first:
        return out[first * lanes:], pos + 4 * n_words
    if zlib.crc32(out.tobytes()) != crc:
        raise ValueError("block checksum does not match its ids")
    return out, pos + 4 * n_words


def encode_segment(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The file bytes of consecutive documents: their lengths and all their ids."""
    symbols, freq = frequencies(ids)
    size = int(symbols.max()) + 1 if len(symbols) else 0
    freq_of, start_of = np.ones(size, np.uint64), np.zeros(size, np.uint64)
    freq_of[symbols] = freq
    start_of[symbols] = np.cumsum(freq, dtype=np.uint64) - freq
    blocks = [encode_block(ids[i:i + BLOCK], freq_of, start_of) for i in range(0, len(ids), BLOCK)]
    body = b"".join([_HEAD.pack(MAGIC, len(ids), len(lengths), len(symbols), len(blocks)),
                     lengths.astype("<u4").tobytes(), symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(),
                     *blocks])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_table(symbols: np.ndarray, freq: np.ndarray) -> tuple:
    """By slot: symbol, frequency, and slot minus the symbol's start."""
    reps = freq.astype(np.int64)
    start = np.cumsum(reps) - reps
    slots = np.arange(1 << SCALE, dtype=np.int64) if len(reps) else np.zeros(0, np.int64)
    return (np.repeat(symbols, reps).astype(np.uint32), np.repeat(freq.astype(np.uint64), reps),
            (slots - np.repeat(start, reps)).astype(np.uint64))


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of the documents, all their ids); raises on a wrong checksum."""
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("segment checksum does not match its bytes")
    view = memoryview(data)
    magic, n, n_docs, n_symbols, n_blocks = _HEAD.unpack_from(view)
    if magic != MAGIC:
        raise ValueError("not a segment file")
    pos = _HEAD.size
    lengths = np.frombuffer(view, "<u4", n_docs, pos)
    pos += 4 * n_docs
    symbols = np.frombuffer(view, "<u4", n_symbols, pos)
    freq = np.frombuffer(view, "<u4", n_symbols, pos + 4 * n_symbols)
    pos += 8 * n_symbols
    table, out = decode_table(symbols, freq), []
    for _ in range(n_blocks):
        ids, used = decode_block(view[pos:], table)
        out.append(ids)
        pos += used
    ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
    if len(ids) != n:
        raise ValueError("segment holds another number of ids than it names")
    return lengths, ids
