"""N-gram Jaccard join: documents whose 5-word shingle sets have similarity 0.75 or more, and their components.

Sets. A-Z are lower-cased; words are runs without the six ASCII white-space
characters; a document's set holds its distinct 5-word shingles (fewer words: the
whole sequence as one), hashed to 64 bits. Equal sets form a class with one
representative, so copies never become pairs.

Candidates. Two sets that link must share a shingle among the rarest
n - ceil(0.75 n) + 1 of each, in any fixed order of shingles. The order is by
a count sketch of all shingles (mergeable, fixed size), rare first, so that
passages shared by many documents seldom bring documents together. Prefix
shingles travel as compressed arrays by hash bucket; classes that meet there form a group,
and equal groups are kept once.

Verification, in two rounds, each on whole sets:

1. Stars: each group's first class against its other members (star edges are
   distinct over all groups; a star is split by a salt). Families of near
   copies are linked here, in a number of comparisons linear in their size.
2. Count-vector R-tree: only groups whose members still lie in several
   components remain. Set elements are hashed into GROUPS groups, the group
   counts are points of an R-tree, and the overlap of a set with a box or a
   point is at most the sum of the coordinate minima; boxes and points below the
   needed overlap are skipped, sets already connected too. Longer sets have finer
   points (a coordinate holds about four elements), which fold to the tree's; two
   points that pass the tree are compared at the finest level both have. Members without a
   surviving partner leave before any text moves; the surviving pairs are compared
   exactly, unless earlier links of their list have connected them. Groups of over BLOCK members are split into all pairs of blocks, so
   every pair still meets.

No link between different texts is lost: both rounds together compare every
candidate pair that is not connected already.

An R-tree over all documents' count vectors alone would not do: vectors of
unrelated long texts are alike in every coordinate, so boxes prune next to nothing and
the join turns quadratic; the tree therefore works inside candidate groups.

Defined results: a text without words (NULL and empty too) has n_shingles 0
and its own doc_id as component; a NULL doc_id takes part through its text, which a
second hash of the text then names in place of the id (``t_doc``), and
its component is the smallest doc_id reached (NULL if there is none); rows
that repeat a doc_id with other texts are separate documents; an empty table gives
an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import StageTables, join_groups, stored, text_or_empty

WORDS = 5
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 75
SKETCH_BITS = 20
SLICES = 64
FLUSH = 1_000_000       # prefix shingles a task holds before it hands them on
GROUPS = 256            # coordinates of a count vector in the tree
FINER = (1024, 4096)    # coordinates of the vectors of sets with at least as many elements
LEAF = 16               # points of an R-tree leaf, and boxes of a node
LONG_WORD = 32          # bytes beyond which a word is hashed by a digest
BLOCK = 500             # members of a group compared in one piece

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CHUNK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _CHUNK + 1)
        tables = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, b, dtype=_U)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[b], [True]])))
    first, end = edges[0::2], edges[1::2]
    up, down = _power_tables(len(b))
    total = np.concatenate([np.zeros(1, _U), np.cumsum((b.astype(_U) + _U(1)) * up[:len(b)])])
    found = _mix((total[end] - total[first]) * down[first] + (end - first).astype(_U))
    # a polynomial modulo 2 ** 64 has known collisions in long words, whatever its base: those get a digest
    for i in np.flatnonzero(end - first > LONG_WORD).tolist():
        found[i] = int.from_bytes(hashlib.blake2b(data[first[i]:end[i]], digest_size=8).digest(), "little")
    return found


def _distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct elements (a sort is quicker than np.unique's hashing here)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingles(text: str) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    data, parts, at = text.encode().translate(_LOWER), [], 0
    while at < len(data):
        cut = at + _CHUNK
        while cut < len(data) and not _SPACE[data[cut]]:
            cut += 1
        parts.append(_word_hashes(data[at:cut]))
        at = cut
    w = np.concatenate(parts) if parts else np.zeros(0, _U)
    if not len(w):
        return w
    k = min(WORDS, len(w))
    s = np.full(len(w) - k + 1, k, dtype=_U)
    for i in range(k):
        s = s * _U(_BASE) + w[i:len(w) - k + 1 + i]
    return _distinct(_mix(s))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _cell(s: np.ndarray) -> np.ndarray:
    return (s * _U(0xD6E8FEB86659FD93) >> _U(64 - SKETCH_BITS)).astype(np.int64)


# ---------------------------------------------------------------- features and sketch

_FEATURES = "doc_id long, t_doc long, t_hash long, n long, digest binary, vec binary, slice int, counts binary"


def _point(s: np.ndarray) -> np.ndarray:
    """Counts of the elements by their leading bits; the number of coordinates follows the set's size."""
    d = max([GROUPS] + [f for f in FINER if len(s) >= f])
    return np.bincount((s >> _U(65 - d.bit_length())).astype(np.int64), minlength=d).astype(np.int32)


def _fold(point: np.ndarray, d: int) -> np.ndarray:
    """The point with ``d`` coordinates: leading bits make neighbours one coordinate."""
    return point.reshape(d, -1).sum(axis=1)


def _unpack_point(vec: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(vec), "<u4").astype(np.int32)


def _features(batches):
    sketch, seen = np.zeros(1 << SKETCH_BITS, np.int64), False
    names = [f.split()[0] for f in _FEATURES.split(", ")]
    for batch in batches:
        n, digests, vecs = [], [], []
        for text in batch.column(3):
            s = shingles(text.as_py())
            if len(s):
                np.add.at(sketch, _cell(s), 1)
                seen = True
            n.append(len(s))
            digests.append(_digest(s))
            vecs.append(zlib.compress(_point(s).astype("<u4").tobytes(), 1))
        nothing = [None] * len(n)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
             pa.array(vecs, pa.binary()), pa.array(nothing, pa.int32()), pa.array(nothing, pa.binary())], names)
    if seen:
        blobs = [zlib.compress(p.tobytes(), 1) for p in np.split(sketch, SLICES)]
        nothing = [None] * SLICES
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(nothing, pa.int64())] * 4, pa.array(nothing, pa.binary()),
             pa.array(nothing, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], names)


def _add_up(batches):
    current, total = None, None
    for batch in batches:
        for s, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(zlib.decompress(blob.as_py()), np.int64)
            if s != current and current is not None:
                yield pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([total.tobytes()])],
                                                 ["slice", "counts"])
            current, total = s, part if s != current else total + part
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([total.tobytes()])],
                                         ["slice", "counts"])


def _sketch(features: DataFrame) -> np.ndarray:
    rows = features.where(F.col("slice").isNotNull()).select("slice", "counts").repartition("slice") \
                   .sortWithinPartitions("slice").mapInArrow(_add_up, "slice int, counts binary").collect()
    parts = [np.zeros((1 << SKETCH_BITS) // SLICES, np.int64) for _ in range(SLICES)]
    for r in rows:  # SLICES rows of a fixed size
        parts[r["slice"]] += np.frombuffer(r["counts"], np.int64)
    return np.minimum(np.concatenate(parts), (1 << 32) - 1).astype(np.uint32)


# ---------------------------------------------------------------- candidate groups

def _prefixes(sketch: np.ndarray, n_buckets: int):
    """Each document's prefix shingles with its class, by bucket."""

    def flush(held: list[np.ndarray], classes: list[int]):
        of = np.repeat(np.arange(len(held)), [len(h) for h in held])
        h, table = np.concatenate(held), np.array(classes, dtype=_U)
        bucket = (h % _U(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        out = []
        for b in range(n_buckets):
            rows = order[cuts[b]:cuts[b + 1]]
            if not len(rows):
                continue
            own, index = np.unique(of[rows], return_inverse=True)
            # 48 bits of the hash beside the bucket: a false meeting is only one more comparison
            short = (h[rows] >> _U(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            index = index.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            out.append((b, zstandard.compress(len(rows).to_bytes(4, "little") + index + short
                                              + table[own].tobytes(), 1)))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()),
                                           pa.array([x[1] for x in out], pa.binary())], ["bucket", "blob"])

    def prefixes(batches):
        held, classes, size = [], [], 0
        for batch in batches:
            for text in batch.column(0):
                s = shingles(text.as_py())
                n = len(s)
                if not n:
                    continue
                k = n - -(-PERCENT * n // 100) + 1
                held.append(s[np.argsort(sketch[_cell(s)], kind="stable")[:k]])
                classes.append(int.from_bytes(_digest(s)[:8], "little"))
                size += k
                if size >= FLUSH:
                    yield flush(held, classes)
                    held, classes, size = [], [], 0
        if held:
            yield flush(held, classes)

    return prefixes


def _meet(batches):
    """Rows sorted by bucket; classes that share a shingle, as sorted lists, each list once for a bucket."""

    def groups(blobs: list[bytes]):
        keys, classes = [], []
        for blob in blobs:
            data = zstandard.decompress(blob)
            n = int.from_bytes(data[:4], "little")
            index = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, 4).reshape(4, n).T).view("<u4").ravel()
            key = np.zeros((n, 8), np.uint8)
            key[:, :6] = np.frombuffer(data, np.uint8, 6 * n, 4 + 4 * n).reshape(n, 6)
            keys.append(key.view(_U).ravel())
            classes.append(np.frombuffer(data, _U, offset=4 + 10 * n)[index])
        k, c = np.concatenate(keys), np.concatenate(classes)
        order = np.lexsort((c, k))
        k, c = k[order], c[order]
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])  # copies of a class once
        k, c = k[fresh], c[fresh].view(np.int64)
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sizes = np.diff(np.append(first, len(k)))
        pairs = first[sizes == 2]
        lists = np.unique(np.stack([c[pairs], c[pairs + 1]], axis=1), axis=0).tolist() if len(pairs) else []
        big = np.flatnonzero(sizes > 2)
        seen = {c[first[i]:first[i] + sizes[i]].tobytes() for i in big}
        lists += [np.frombuffer(m, np.int64).tolist() for m in sorted(seen)]
        for i in range(0, len(lists), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(lists[i:i + 10_000], pa.list_(pa.int64()))], ["members"])

    current, blobs = None, []
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if b != current and blobs:
                yield from groups(blobs)
                blobs = []
            current = b
            blobs.append(blob.as_py())
    if blobs:
        yield from groups(blobs)


# ---------------------------------------------------------------- verification

def _links(a: np.ndarray, b: np.ndarray) -> bool:
    if PERCENT * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _unpack(z: bytes) -> np.ndarray:
    return shingles(zstandard.decompress(z).decode())


def _ship(batches):
    """(t_doc, hash of the text, compressed text) of every document."""
    for batch in batches:
        z = [zstandard.compress(text.as_py().encode(), 3) for text in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())],
                                         ["t_doc", "t_hash", "z"])


def _pair_batch(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()),
                                       pa.array([x[1] for x in found], pa.binary())], ["a", "b"])


def _stars(batches):
    """Rows sorted by star, its centre first: links of the centre."""
    star, centre = None, None
    for batch in batches:
        found = []
        for key, salt, role, digest, z in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if role == 0:
                if (key, salt) != star:
                    star, centre = (key, salt), _unpack(z)
            elif (key, salt) == star and _links(centre, _unpack(z)):
                found.append((key, digest))
        yield _pair_batch(found)


class CountTree:
    """A packed R-tree over count vectors: boxes hold the largest coordinates and the smallest size below them."""

    def __init__(self, points: list[np.ndarray], sizes: np.ndarray):
        # the rows of the points that have a finer form, by its number of coordinates
        self.sizes, self.finer = sizes, []
        for d in FINER:
            has = np.array([len(p) >= d for p in points])
            if has.any():
                self.finer.append((d, np.where(has, np.cumsum(has) - 1, -1),
                                   np.stack([_fold(p, d) for p in points if len(p) >= d])))
        points = np.stack([_fold(p, GROUPS) for p in points])
        # neighbours in a leaf should be alike: sort by size, then by the heaviest coordinate within a tile
        order = np.argsort(sizes, kind="stable")
        tile = LEAF * LEAF
        order = np.concatenate([t[np.argsort(points[t].argmax(axis=1), kind="stable")]
                                for t in np.split(order, range(tile, len(order), tile))])
        self.order, self.levels = order, [(points[order], sizes[order])]
        while len(self.levels[-1][1]) > LEAF:
            high, small = self.levels[-1]
            starts = np.arange(0, len(small), LEAF)
            self.levels.append((np.maximum.reduceat(high, starts, axis=0), np.minimum.reduceat(small, starts)))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Positions of the points whose overlap with ``point`` can suffice."""
        rows, folded = np.arange(len(self.levels[-1][1])), _fold(point, GROUPS)
        for level in range(len(self.levels) - 1, -1, -1):
            high, small = self.levels[level]
            bound = np.minimum(high[rows], folded).sum(axis=1)
            # overlap / (sizes - overlap) >= p  <=>  (100 + p) * overlap >= p * (sum of sizes)
            rows = rows[(100 + PERCENT) * bound >= PERCENT * (size + small[rows])]
            if level:
                width = len(self.levels[level - 1][1])
                rows = (rows[:, None] * LEAF + np.arange(LEAF)).ravel()
                rows = rows[rows < width]
        found = self.order[rows]
        for d, at, matrix in self.finer:
            if len(point) >= d and len(found):
                bound = np.minimum(matrix[at[found]], _fold(point, d)).sum(axis=1)
                found = found[(at[found] < 0) | ((100 + PERCENT) * bound >= PERCENT * (size + self.sizes[found]))]
        return found


def _root(parent: dict, c):
    while parent.get(c, c) != c:
        parent[c] = parent.get(parent[c], parent[c])
        c = parent[c]
    return c


def _runs(batches, width: int):
    """Lists of rows (tuples without their key) of consecutive equal first columns."""
    current, rows = None, []
    for batch in batches:
        for key, *row in zip(*(batch.column(i).to_pylist() for i in range(width))):
            if key != current and rows:
                yield rows
                rows = []
            current = key
            rows.append(row)
    if rows:
        yield rows


_SURVIVORS = ("members array<struct<digest: binary, comp: binary, doc: bigint, t_hash: bigint>>, "
              "pairs array<struct<a: int, b: int>>")


def _prune(batches):
    """Rows sorted by group: the members that the count vectors cannot part, in lists that hang together.

    Only points move here, not texts. A list holds at least two members of
    different components, sorted by digest, and the pairs of places that the vectors
    cannot part; no other pair can link. Whether they part a pair depends on its two vectors alone, so equal
    lists have equal pairs."""
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("comp", pa.binary()), ("doc", pa.int64()),
                               ("t_hash", pa.int64())]))
    for rows in _runs(batches, 7):
        rows.sort(key=lambda r: r[0])
        comps = [r[1] for r in rows]
        points, sizes = [_unpack_point(r[5]) for r in rows], np.array([r[4] for r in rows])
        tree, parent, found = CountTree(points, sizes), {}, []
        for i in range(len(rows)):
            for j in tree.search(points[i], int(sizes[i])).tolist():
                if j < i and comps[i] != comps[j]:
                    found.append((j, i))
                    parent[_root(parent, i)] = _root(parent, j)
        lists: dict[int, list] = {}
        place: dict[int, int] = {}
        for i in sorted({i for pair in found for i in pair}):
            mine = lists.setdefault(_root(parent, i), [])
            place[i] = len(mine)
            mine.append({"digest": rows[i][0], "comp": comps[i], "doc": rows[i][2], "t_hash": rows[i][3]})
        pairs: dict[int, list] = {}
        for a, b in sorted(found):
            pairs.setdefault(_root(parent, a), []).append({"a": place[a], "b": place[b]})
        if lists:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(lists.values()), kind),
                 pa.array([pairs[k] for k in lists], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
                ["members", "pairs"])


def _groups_join(batches):
    """Rows sorted by list and place, the list's pairs in its first row: the components that its links connect.

    A text is cut into shingles only when a pair needs it that earlier links have not connected."""
    for rows in _runs(batches, 5):
        member, sets, parent, found = {r[0]: r for r in rows}, {}, {}, []  # repeated rows of a text count once
        for pair in next(r[3] for r in rows if r[3] is not None):
            i, j = pair["a"], pair["b"]
            a, b = _root(parent, member[i][1]), _root(parent, member[j][1])
            if a == b:
                continue
            for k in (i, j):
                if k not in sets:
                    sets[k] = _unpack(member[k][2])
            if _links(sets[i], sets[j]):
                parent[a] = b
                found.append((member[i][1], member[j][1]))
        yield _pair_batch(found)


# ---------------------------------------------------------------- components

def components(links: DataFrame, tables: StageTables) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the smallest node reachable.

    Each round takes the smallest label among the neighbours and then the
    label's own label (pointer jumping), and is written before the next, which replaces its table."""
    edges = tables.stored(links.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).union(
        links.where("a <> b").select("b", "a")).distinct(), "jaccard-edges")
    labels = tables.stored(edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m"))
                    .select("node", F.least("node", "m").alias("comp")), "jaccard-labels")
    while True:
        near = edges.join(labels.withColumnsRenamed({"node": "dst", "comp": "c"}), "dst") \
                    .groupBy(F.col("src").alias("node")).agg(F.min("c").alias("c"))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "c").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("comp").alias("cc"))
        before = tables.paths[-1]
        after = tables.stored(step.join(jump, "c", "left").select(
            "node", F.least("c", "cc").alias("comp"), (F.least("c", "cc") != F.col("comp")).alias("moved")),
            "jaccard-labels")
        moved = after.where("moved").limit(1).count()
        labels = after.select("node", "comp")
        tables.drop(before)
        if not moved:
            return labels


# ---------------------------------------------------------------- the operator

def _texts(docs: DataFrame) -> DataFrame:
    text, doc_id = text_or_empty(), F.col("doc_id").cast("long")
    # (t_doc, t_hash) finds a stored text; without an id both are hashes of the text, 128 bits together
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(F.lit("no id"), text)).alias("t_doc"),
                       F.xxhash64(text).alias("t_hash"), text.alias("text"))


def similar_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``."""
    return _linked(spark, docs).select("doc_id", "n_shingles", "component_id")


def _linked(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """:func:`similar_components` with t_doc and t_hash.

    The result reads two written tables, the features of all rows and the classes' components; all others are
    deleted once these stand."""
    tables = StageTables(spark)
    try:
        return _components_of(spark, docs, tables)
    finally:
        tables.drop()


def _components_of(spark: SparkSession, docs: DataFrame, tables: StageTables) -> DataFrame:
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(64, 2 * partitions)
    texts = _texts(docs)
    features = stored(texts.mapInArrow(_features, _FEATURES), "jaccard-features")
    rows = features.where(F.col("digest").isNotNull()).select("doc_id", "t_doc", "t_hash", "n", "digest", "vec")
    classes = tables.stored(rows.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull(), "t_doc", "t_hash")).alias("at"),
        F.first("n").alias("n"), F.first("vec").alias("vec"), F.count("*").alias("copies"))
        .select("digest", "rep", "at.t_doc", "at.t_hash", "n", "vec", "copies"), "jaccard-classes")
    known = _with_key(classes)

    sketch = _sketch(features)
    groups = tables.stored(texts.select("text").mapInArrow(_prefixes(sketch, buckets), "bucket int, blob binary")
                    .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "members array<long>")
                    .groupBy("members").agg(F.count("*").alias("times")).drop("times"), "jaccard-groups")

    # round 1: the first member of each group against the others
    side = known.select("key", "digest", "t_doc", "t_hash", "n")
    pairs = groups.select(F.col("members")[0].alias("p"), F.explode(F.slice("members", F.lit(2), F.size("members")))
                          .alias("q")).distinct()
    a = side.withColumnsRenamed({"key": "p", "digest": "a", "t_doc": "a_doc", "t_hash": "a_hash", "n": "a_n"})
    b = side.withColumnsRenamed({"key": "q", "digest": "b", "t_doc": "b_doc", "t_hash": "b_hash", "n": "b_n"})
    stars = tables.stored(pairs.join(a, "p").join(b, "q")
                   .where(F.lit(PERCENT) * F.greatest("a_n", "b_n") <= 100 * F.least("a_n", "b_n"))
                   .select("a", "a_doc", "a_hash", "b", "b_doc", "b_hash",
                           F.pmod(F.xxhash64("b"), F.lit(max(16, partitions))).cast("int").alias("salt")),
                   "jaccard-stars")
    members = stars.select(F.col("a").alias("star"), "salt", F.lit(1).alias("role"), F.col("b").alias("t_digest"),
                           F.col("b_doc").alias("t_doc"), F.col("b_hash").alias("t_hash"))
    centres = stars.select(F.col("a").alias("star"), "salt", F.lit(0).alias("role"), F.col("a").alias("t_digest"),
                           F.col("a_doc").alias("t_doc"), F.col("a_hash").alias("t_hash")).distinct()
    # of equal texts without an id one is enough; they share their t_doc
    nameless = texts.where(F.col("doc_id").isNull()).dropDuplicates(["t_doc", "t_hash"])
    shipped = texts.where(F.col("doc_id").isNotNull()).union(nameless).select("t_doc", "t_hash", "text") \
                   .mapInArrow(_ship, "t_doc long, t_hash long, z binary")
    # sort-merge at every size: a broadcast that only few candidates get would change the plan as data grows
    on_star = members.union(centres).hint("merge").join(shipped, ["t_doc", "t_hash"]) \
                     .select("star", "salt", "role", "t_digest", "z") \
                     .repartition("star", "salt").sortWithinPartitions("star", "salt", "role")
    links = tables.stored(on_star.mapInArrow(_stars, "a binary, b binary"), "jaccard-links")
    labels = components(links, tables)

    # round 2: groups whose members lie in several components
    # classes get their component once, and points travel only with the rows of groups that are still open
    placed_side = side.join(labels.withColumnRenamed("node", "digest").hint("merge"), "digest", "left") \
                      .withColumn("comp", F.coalesce("comp", "digest"))
    listed = groups.where(F.size("members") > 2).select(
        F.xxhash64("members").alias("g1"), F.hash("members").alias("g2"), F.explode("members").alias("key")) \
        .join(placed_side.hint("merge"), "key")
    open_groups = listed.groupBy("g1", "g2").agg(F.min("comp").alias("low"), F.max("comp").alias("high"),
                                                 F.count("*").alias("size")).where("low <> high")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    block = F.pmod(F.xxhash64("digest"), blocks).cast("int")
    placed = listed.join(open_groups.select("g1", "g2", "size"), ["g1", "g2"]) \
                   .withColumn("block", block) \
                   .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))) \
                   .select("g1", "g2", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                           "digest", "comp", "t_doc", "t_hash", "n") \
                   .join(classes.select("digest", "vec").hint("merge"), "digest")
    # points first: most groups fall apart without a text being moved, and the rest into few distinct lists
    lists = placed.select(F.format_string("%d %d %d %d", "g1", "g2", "i", "j").alias("gid"), "digest", "comp", "t_doc",
                          "t_hash", "n", "vec").repartition("gid").sortWithinPartitions("gid") \
                  .mapInArrow(_prune, _SURVIVORS).groupBy("members").agg(F.first("pairs").alias("pairs"))
    listed = tables.stored(lists.select(F.xxhash64("members").alias("g1"), F.hash("members").alias("g2"), "pairs",
                                 F.posexplode("members").alias("at", "m"))
                    .withColumn("pairs", F.when(F.col("at") == 0, F.col("pairs"))), "jaccard-lists")
    in_list = listed.select(F.format_string("%d %d", "g1", "g2").alias("gid"), "at", "pairs",
                            F.col("m.comp").alias("comp"), F.col("m.doc").alias("t_doc"),
                            F.col("m.t_hash").alias("t_hash")) \
                    .join(shipped.hint("merge"), ["t_doc", "t_hash"]).select("gid", "at", "comp", "z", "pairs") \
                    .repartition("gid").sortWithinPartitions("gid")
    joined = components(tables.stored(in_list.mapInArrow(_groups_join, "a binary, b binary"), "jaccard-links"), tables)

    # the second round joins components of the first
    placed_classes = classes.join(labels.withColumnRenamed("node", "digest"), "digest", "left") \
                            .withColumn("comp", F.coalesce("comp", "digest")) \
                            .join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("after")), "comp", "left") \
                            .withColumn("comp", F.coalesce("after", "comp")).drop("after")
    lowest = placed_classes.groupBy("comp").agg(F.min("rep").alias("component_id"))
    final = stored(placed_classes.join(lowest, "comp").select("digest", "component_id", "copies"), "jaccard-components")
    joined = join_groups(rows.where("n > 0"), final, "digest", "copies")
    return joined.select("doc_id", "t_doc", "t_hash", F.col("n").alias("n_shingles"), "component_id").union(
        rows.where("n = 0").select("doc_id", "t_doc", "t_hash", "n", "doc_id"))


def _with_key(classes: DataFrame) -> DataFrame:
    """Adds ``key``: the digest's first eight bytes as a signed little-endian number, as candidate lists carry it."""

    def add(batches):
        for batch in batches:
            keys = [int.from_bytes(d[:8], "little", signed=True) for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())],
                                             [*batch.schema.names, "key"])

    return classes.mapInArrow(add, "digest binary, rep long, t_doc long, t_hash long, n long, vec binary, "
                                   "copies long, key long")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest doc_id, all columns.

    Rows with a NULL doc_id stay where no row with a doc_id is linked to them."""
    found = _linked(spark, docs)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))) \
                .select("doc_id", "t_doc", "t_hash").distinct()
    # rows with an id stay by it, rows without one by their text: their ids do not tell them apart
    by_id = stay.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("k_id")).distinct()
    by_text = stay.where(F.col("doc_id").isNull()).select(F.col("t_doc").alias("k_doc"), F.col("t_hash").alias("k_hash"))
    text = text_or_empty()
    return docs.join(by_id, F.col("doc_id") == F.col("k_id"), "left_semi").unionByName(
        docs.where(F.col("doc_id").isNull()).join(
            by_text, (F.xxhash64(F.lit("no id"), text) == F.col("k_doc")) & (F.xxhash64(text) == F.col("k_hash")),
            "left_semi"))
