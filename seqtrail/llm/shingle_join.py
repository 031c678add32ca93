"""Jaccard join of word shingle sets by count vectors in R-trees.

The way of a pair: documents with equal sets are one node. Every node hands out keys such
that two nodes that link share one (``node_keys``); nodes of one key form a bucket. Each
node has a point, the counts of its shingles in 64 hash groups. In a bucket the points are
bulk-loaded into an R-tree, which is joined with itself: the sum of coordinate minima
bounds the overlap, of two boxes as of two points. Pairs of points within the bound are held
against a sharper one, from parities of the shingles in as many slots as the set has
shingles (``sketch``). Pairs that survive both are verified on their whole sets.

Pairs are looked at in three steps, and each time nodes that verified links connect already
are not compared again, so that a group of many near copies costs no pair of each two:
every node with one node of each of its buckets, every node with the nearest point of its
bucket, and at last every node with all points of its buckets within the bound. Near copies
share dozens of buckets; a pair is handed on by the one of the smallest key alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from seqtrail.llm.common import connected, cut, runs, slices

WIDTH = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Coordinates of a point.
GROUPS = 64
#: Slots of the longest sketch; larger sets share slots, which only makes the bound wider.
MOST_SLOTS = 1 << 14
#: Sets below SMALL shingles hand out prefixes, others whole groups of shingles.
SMALL = 64
#: Points of a leaf and children of an inner box of the R-tree.
FANOUT = 24
#: Buckets beyond this many nodes are cut into blocks that are joined two by two.
BLOCK = 2048
KEY_BITS = 48
#: Smaller keys that a node brings along into a bucket, to tell pairs that have met before.
EARLIER = 64
#: Places of the bitmap of wanted texts, which has an eighth of as many bytes however many are wanted.
PLACES = 1 << 25
#: The key that marks loose nodes; other keys are not negative.
LOOSE = -1

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_STEPS = [U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)]
#: A-Z become lower case, blanks become zero and the zero byte takes the free place of the space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[32, *range(9, 14)]] = 0
_FOLD[0] = 32
_TABLE = _FOLD.tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * _STEPS[0]
    x = (x ^ (x >> U(27))) * _STEPS[1]
    return x ^ (x >> U(31))


def _hash_ranges(b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each word ``b[first:last]``.

    The sum of its pieces of eight bytes, each scrambled with the key of its place in the word:
    unlike a polynomial modulo 2^64, no arrangement of two letters makes it vanish.
    """
    if not len(first):
        return np.zeros(0, U)
    size = last - first
    pieces = (size + 7) // 8
    ends = np.cumsum(pieces)
    place = np.arange(ends[-1]) - np.repeat(ends - pieces, pieces)
    at = np.repeat(first, pieces) + 8 * place
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((b, np.zeros(8, np.uint8))), 8)[at]
    left = np.minimum(np.repeat(last, pieces) - at, 8).astype(U)
    lane = np.ascontiguousarray(eight).view("<u8")[:, 0] & (~U(0) >> (U(64) - U(8) * left))
    scrambled = mix(lane ^ mix((place.astype(U) + U(1)) * _STEPS[3]))
    return mix(np.add.reduceat(scrambled, ends - pieces) + size.astype(U) * _STEPS[2])


def hash_words(data: np.ndarray, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each blank-separated word of UTF-8 bytes, A-Z lower-cased.

    Works through chunks that end at blanks; only a single longer word makes one longer.
    """
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + chunk)
        b = np.frombuffer(data[at:end].tobytes().translate(_TABLE), np.uint8)
        if end < len(data):
            blank = np.flatnonzero(b == 0)
            if len(blank):
                b = b[: int(blank[-1]) + 1]
            else:
                rest = np.frombuffer(data[at:].tobytes().translate(_TABLE), np.uint8)
                later = np.flatnonzero(rest == 0)
                b = rest[: int(later[0]) + 1] if len(later) else rest
        n = len(b)
        word = np.zeros(n + 2, bool)
        np.not_equal(b, 0, out=word[1:-1])
        edge = np.flatnonzero(word[1:] != word[:-1])
        first, last = edge[::2], edge[1::2]
        hashes.append(_hash_ranges(b, first, last))
        starts.append(first + at)
        at += n
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes."""
    n = len(words)
    if n == 0:
        return np.zeros(0, U)
    if n < WIDTH:
        h = np.full(1, U(n))
        for w in words:
            h = mix(h * _STEPS[3] + w)
        return h
    total = np.zeros(n - WIDTH + 1, U)
    for i in range(WIDTH):
        total += words[i : n - WIDTH + 1 + i] * _STEPS[i]
    total = mix(total)
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def set_of(text: str | None) -> np.ndarray:
    return shingle_set(hash_words(np.frombuffer((text or "").encode(), np.uint8))[1])


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The set of each text of an Arrow column, whose bytes are read in place."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    for i in range(len(column)):
        # Null texts have no bytes.
        yield shingle_set(hash_words(data[offsets[i] : offsets[i + 1]])[1])


def point(items: np.ndarray) -> np.ndarray:
    return np.bincount((items & U(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def packed(counts: np.ndarray) -> bytes:
    """The bytes of a point, of as many bytes a coordinate as its largest one needs."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def sketch(items: np.ndarray) -> bytes:
    """A bit per slot that tells if it holds an odd number of the set's shingles.

    The slots are as many as the shingles, rounded up to a power of two. Where the sketches of two
    sets differ a shingle is in only one of them, so they have at least as many shingles apart.
    """
    slots = min(max(64, 1 << (len(items) - 1).bit_length()), MOST_SLOTS)
    held = np.bincount(((items >> U(8)) & U(slots - 1)).astype(np.int64), minlength=slots)
    return np.packbits((held & 1).astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches of sets of several sizes; of two, the longer one is folded to the shorter one's slots."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        self.parts = column.to_pylist()
        self.width = np.array([len(part) for part in self.parts], np.int64)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _of(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The sketches of this width and of twice it, folded, and the place of each among them."""
        if width not in self.folded:
            place, found = np.zeros(len(self.parts), np.int64), []
            at = 0
            for times in (1, 2):
                rows = np.flatnonzero(self.width == times * width)
                place[rows] = at + np.arange(len(rows))
                at += len(rows)
                bits = np.frombuffer(b"".join([self.parts[i] for i in rows.tolist()]), U)
                found.append(np.bitwise_xor.reduce(bits.reshape(-1, times, width // 8), axis=1))
            self.folded[width] = np.concatenate(found), place
        return self.folded[width]

    def within(
        self, x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray, inside: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs of places may link, none of them twice the other's size, and the sharper bound of the overlap of each pair."""
        width = np.minimum(self.width[x], self.width[y])
        apart = np.zeros(len(x), np.int64)
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            bits, place = self._of(w)
            apart[at] = np.bitwise_count(bits[place[x[at]]] ^ bits[place[y[at]]]).sum(1)
        inside = np.minimum(inside, (size_x + size_y - apart) // 2)
        return overlap_reaches(inside, size_x, size_y), inside


def identity(items: np.ndarray) -> int | None:
    """64-bit name of a set; None for the empty one."""
    if not len(items):
        return None
    total = np.add.reduce(mix(items + _STEPS[4]), keepdims=True) + np.full(1, len(items), U) * _BASE
    return int(mix(total).astype(np.int64)[0])


@lru_cache(maxsize=1)
def size_classes() -> list[tuple[int, int, int]]:
    """(first size, next first size, number of groups) of the size classes.

    Let A be the smaller of two linked sets. They differ in at most |A| / 4 shingles, each of
    which disturbs one group. With more groups than that and than A's empty ones taken
    together, one group is filled and equal in both. The groups allow for six standard
    deviations more empty ones than expected; sets that have still more are *loose*.
    """
    out, low = [], SMALL
    while low < 2**40:
        high = low * 8 // 5
        differing, spare = (high - 1) // 4, 0
        for _ in range(20):
            count = differing + 1 + spare
            empty = count * np.exp(-(high - 1) / count)
            spare = int(np.ceil(empty + 6 * np.sqrt(empty) + 2))
        out.append((low, high, differing + 1 + spare))
        low = high
    return out


def prefix_keys(items: np.ndarray) -> np.ndarray:
    """The smallest hashes, one more than can be missing from a linked set."""
    return mix(items[: len(items) - -(-len(items) * PERCENT // 100) + 1])


def node_keys(items: np.ndarray) -> tuple[np.ndarray, bool]:
    """Keys of a set, and whether it is loose.

    Small sets hand out their prefix. Others hand out, for their own size class and that of
    the smallest set they can link with, a hash of each filled group's whole content. Groups
    are ranges of the hash, so they lie side by side in the sorted set.
    """
    n, keys, loose = len(items), [], False
    least = -(-n * PERCENT // 100)
    if least < SMALL:
        keys.append(prefix_keys(items))
    if n >= SMALL:
        mixed = mix(items ^ _BASE)
        for k, (low, high, count) in enumerate(size_classes()):
            if high <= least:
                continue
            if low > n:
                break
            group = ((items >> U(32)) * U(count)) >> U(32)
            first, _ = runs(group)
            if low <= n:
                loose |= low <= n < high and count - len(first) > count - 1 - n // 4
            content = np.add.reduceat(mixed, first)
            keys.append(mix(content + group[first] * _STEPS[3] + mix(np.full(1, k + 1, U))))
    found = np.concatenate(keys) if keys else np.zeros(0, U)
    return (found >> U(64 - KEY_BITS)).astype(np.int64), bool(loose)


def overlap_reaches(inside: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Can sets of these sizes with at most this overlap link?"""
    return (100 + PERCENT) * inside >= PERCENT * (size_a + size_b)


class RTree:
    """Points bulk-loaded by size and then by their widest coordinate; boxes keep maxima."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, owner: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        wide = int(np.argmax(points.std(0))) if len(points) else 0
        tile = FANOUT * FANOUT
        order = np.concatenate(
            [t[np.argsort(points[t, wide], kind="stable")] for t in (order[i : i + tile] for i in range(0, len(order), tile))]
        )
        self.order, self.points, self.sizes, self.owner = order, points[order], sizes[order], owner[order]
        self.levels = []
        top, small, large = self.points, self.sizes, self.sizes
        one, same = self.owner, np.ones(len(order), bool)
        while True:
            cuts = np.arange(0, len(top), FANOUT)
            top = np.maximum.reduceat(top, cuts)
            small, large = np.minimum.reduceat(small, cuts), np.maximum.reduceat(large, cuts)
            low, high = np.minimum.reduceat(one, cuts), np.maximum.reduceat(one, cuts)
            same = np.logical_and.reduceat(same, cuts) & (low == high)
            one = low
            self.levels.append((top, small, large, one, same))
            if len(top) <= 1:
                return


def _far(a, i: int, b, j: int) -> bool:
    """Can no point of box i of one level link with a point of another owner in box j?"""
    (top_a, small_a, large_a, one_a, same_a), (top_b, small_b, large_b, one_b, same_b) = a, b
    if same_a[i] and same_b[j] and one_a[i] == one_b[j]:
        return True
    if 100 * large_a[i] < PERCENT * small_b[j] or 100 * large_b[j] < PERCENT * small_a[i]:
        return True
    inside = int(np.minimum(top_a[i], top_b[j]).sum())
    return not overlap_reaches(inside, small_a[i], small_b[j])


def tree_join(a: RTree, b: RTree | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of different owners that may link: positions (as given at loading) and bound of the overlap."""
    other, itself = (a, True) if b is None else (b, False)
    stack = [(len(a.levels) - 1, 0, len(other.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        if _far(a.levels[la], i, other.levels[lb], j):
            continue
        if la or lb:
            if la >= lb:
                below = len(a.levels[la - 1][0])
                stack += [(la - 1, k, lb, j) for k in range(i * FANOUT, min(below, (i + 1) * FANOUT))]
            else:
                below = len(other.levels[lb - 1][0])
                stack += [(la, i, lb - 1, k) for k in range(j * FANOUT, min(below, (j + 1) * FANOUT))]
            continue
        if itself and j < i:
            continue
        x, y = slice(i * FANOUT, (i + 1) * FANOUT), slice(j * FANOUT, (j + 1) * FANOUT)
        inside = np.minimum(a.points[x][:, None], other.points[y][None]).sum(2)
        size_a, size_b = a.sizes[x][:, None], other.sizes[y][None]
        good = overlap_reaches(inside, size_a, size_b) & (a.owner[x][:, None] != other.owner[y][None])
        good &= 100 * np.minimum(size_a, size_b) >= PERCENT * np.maximum(size_a, size_b)
        if itself and i == j:
            good &= np.tri(*good.shape, -1, dtype=bool).T
        p, q = np.nonzero(good)
        if len(p):
            yield a.order[p + i * FANOUT], other.order[q + j * FANOUT], inside[p, q]


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _members(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, node and size of each document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            nodes, sizes = [], []
            for items in sets_of(batch.column("text")):
                nodes.append(identity(items))
                sizes.append(len(items))
            yield _batch(
                ["doc_id", "digest", "node", "size"],
                batch.column("doc_id"), batch.column("digest"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
            )

    return docs.mapInArrow(find, f"doc_id {dict(docs.dtypes)['doc_id']}, digest long, node long, size long")


def _keyed(docs: DataFrame, *, prefixes: bool = False) -> DataFrame:
    """Rows (key, node); each task hands out a set's keys once, however many copies it sees.

    A loose node is marked by the key LOOSE, twice, so that it makes a bucket. With
    ``prefixes`` every node hands out its prefix.
    """

    def hand_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, 256):
            keys, nodes = [], []
            for items in sets_of(batch.column("text")):
                node = identity(items)
                if node is None or node in seen:
                    continue
                seen.add(node)
                if prefixes:
                    found = (prefix_keys(items) >> U(64 - KEY_BITS)).astype(np.int64)
                else:
                    found, loose = node_keys(items)
                    if loose:
                        keys.append(np.array([LOOSE, LOOSE]))
                        nodes.append(np.array([node, 0]))
                keys.append(found)
                nodes.append(np.full(len(found), node, np.int64))
            if keys:
                yield _batch(["key", "node"], np.concatenate(keys), np.concatenate(nodes))

    return docs.mapInArrow(hand_out, "key long, node long")


def _buckets(keyed: DataFrame) -> DataFrame:
    """Rows (key, node, first) of keys with two nodes or more; ``first`` is one node of the key.

    Keys are dealt and sorted by Spark and read as a stream, so a key that a third of all
    nodes have needs no more memory than another. Nodes that several tasks saw are told once
    a batch.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the run that the last batch ended in: key, first node, is the first told?
        key, first, told = None, None, True
        for batch in batches:
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((nodes, keys))
            keys, nodes = keys[order], nodes[order]
            fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])))
            if key is not None and keys[0] == key:
                # The run goes on; its first node is known already.
                fresh[: np.searchsorted(keys, key, "right")] &= nodes[: np.searchsorted(keys, key, "right")] != first
            keys, nodes = keys[fresh], nodes[fresh]
            if not len(keys):
                continue
            at, count = runs(keys)
            firsts, tell, head = nodes[at], count > 1, []
            if keys[0] == key:
                firsts[0], tell[0] = first, True
                head = [] if told else [first]
            rows = np.flatnonzero(np.repeat(tell, count))
            if len(rows):
                before = np.array(head, np.int64)
                yield _batch(
                    ["key", "node", "first"],
                    np.concatenate((np.full(len(head), keys[0]), keys[rows])),
                    np.concatenate((before, nodes[rows])),
                    np.concatenate((before, np.repeat(firsts[tell], count[tell]))),
                )
            key, first, told = keys[-1], firsts[-1], bool(tell[-1])

    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(stream, "key long, node long, first long")


def _single(buckets: DataFrame) -> DataFrame:
    """Of buckets with the same nodes the one of the smallest key: copies share hundreds of keys.

    Sets of nodes are told apart by their number and by sums and the exclusive or of their hashes.
    """
    h = F.xxhash64("node")
    told = [F.count(F.lit(1)), F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_xor(h)]
    sets = buckets.groupBy("key").agg(*[x.alias(f"s{i}") for i, x in enumerate(told)])
    kept = sets.groupBy("s0", "s1", "s2", "s3").agg(F.min("key").alias("key"))
    return buckets.join(kept.select("key"), "key", "left_semi")


def _bitmap(digests: DataFrame) -> np.ndarray:
    """The places of ``digests`` among PLACES, a bit each."""
    place = F.pmod("digest", F.lit(PLACES)) + 1  # Spark's bitmaps begin with place 1.
    parts = digests.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    out = np.zeros((PLACES // 32768, 4096), np.uint8)
    for row in parts.collect():
        out[row["part"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _texts(docs: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, size, point, sketch and text of the given nodes, one row each."""
    wanted = members.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("digest").alias("digest"))
    wanted = cut(wanted.select("digest").distinct())
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Most texts that are not wanted are left out here; the join below leaves out the others.
        seen: set[int] = set()
        for batch in batches:
            new, digests = [], batch.column("digest").to_numpy()
            place = digests % PLACES
            likely = np.flatnonzero(bitmap.value[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            for i, digest in zip(likely.tolist(), digests[likely].tolist(), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    new.append(i)
            yield batch.take(pa.array(new, pa.int64()))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = list(sets_of(batch.column("text")))
            yield _batch(
                ["node", "size", "point", "sketch", "text"],
                pa.array([identity(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()),
                pa.array([packed(point(x)) for x in found], pa.binary()), pa.array([sketch(x) for x in found], pa.binary()),
                batch.column("text"),
            )

    texts = docs.select("digest", "text").mapInArrow(once, "digest long, text string")
    kept = texts.join(wanted, "digest", "left_semi").dropDuplicates(["digest"])
    return kept.mapInArrow(describe, "node long, size long, point binary, sketch binary, text string")


def _bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (a, b) whose points and sketches allow a link."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            x, y = _points(batch.column("point_a")), _points(batch.column("point_b"))
            n, m = batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy()
            inside = np.minimum(x, y).sum(1)
            good = overlap_reaches(inside, n, m) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
            at = np.flatnonzero(good)
            sketches = Sketches(pa.chunked_array([batch.column("sketch_a"), batch.column("sketch_b")]))
            may, _ = sketches.within(at, at + len(good), n[at], m[at], inside[at])
            yield _batch(["a", "b"], batch.column("a"), batch.column("b")).take(pa.array(at[may]))

    def end(name: str) -> DataFrame:
        return points.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("size", "point", "sketch")])

    return pairs.join(end("a"), "a").join(end("b"), "b").mapInArrow(keep, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, common, link: each pair with the size of its intersection on the whole sets."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def items(node: int, text: str) -> np.ndarray:
            if node not in kept:
                if len(kept) >= 256:
                    kept.pop(next(iter(kept)))
                kept[node] = set_of(text)
            return kept[node]

        for batch in slices(batches, 128):
            common, link = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "b", "text_b")), strict=True)
            for a, text_a, b, text_b in rows:
                x, y = items(a, text_a), items(b, text_b)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                common.append(shared)
                link.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
            yield _batch(["a", "b", "common", "link"], batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), link)

    # Stored, so that Spark knows the sizes: few nodes are broadcast, and only their texts travel.
    pairs = cut(pairs)
    needed = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    used = texts.select("node", "text").join(needed, "node", "left_semi")
    one = used.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = used.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(verify, "a long, b long, common long, link boolean")


def _points(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    parts = column.to_pylist()
    length = np.array([len(part) for part in parts], np.int64)
    out = np.empty((len(parts), GROUPS), np.int32)
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        out[at] = np.frombuffer(b"".join([parts[i] for i in at.tolist()]), f"u{n // GROUPS}").reshape(-1, GROUPS)
    return out


def _pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return _batch(["a", "b"], np.minimum(x, y), np.maximum(x, y))


class Met:
    """Tells pairs of rows that share a key smaller than that of the bucket they are in.

    Rows bring along their smallest such keys, EARLIER at most. A pair that shares only others
    is told again by each bucket, which repeats it and loses nothing.
    """

    COLUMNS = 4096

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.rows = len(column)
        keys, code, count = np.unique(column.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
        # The keys of most rows come first, as they tell most pairs; those of one row tell none.
        rank = np.empty(len(keys), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(keys))
        row = np.repeat(np.arange(self.rows), column.value_lengths().to_numpy(zero_copy_only=False))
        used = count[code] > 1
        place, row = rank[code[used]], row[used]
        order = np.argsort(place, kind="stable")
        self.place, self.row = place[order], row[order]
        self.bits: list[np.ndarray] = []

    def _part(self, i: int) -> np.ndarray:
        if i == len(self.bits):
            low, high = np.searchsorted(self.place, (i * self.COLUMNS, (i + 1) * self.COLUMNS))
            place, row = self.place[low:high] - i * self.COLUMNS, self.row[low:high]
            bits = np.zeros((self.rows, self.COLUMNS // 64), U)
            np.bitwise_or.at(bits, (row, place >> 6), U(1) << (place & 63).astype(U))
            self.bits.append(bits)
        return self.bits[i]

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of rows have met in a bucket of a smaller key."""
        out = np.zeros(len(x), bool)
        for i in range(-(-(int(self.place[-1]) + 1) // self.COLUMNS) if len(self.place) else 0):
            bits = self._part(i)
            for at in np.array_split(np.flatnonzero(~out), -(-len(out) // 16384) or 1):
                out[at] = (bits[x[at]] & bits[y[at]]).any(1)
        return out


class Nearest:
    """The partner with the greatest bound for each of some points."""

    def __init__(self, count: int):
        self.inside, self.partner = np.full(count, -1), np.zeros(count, np.int64)

    def offer(self, at: np.ndarray, partner: np.ndarray, inside: np.ndarray) -> None:
        order = np.argsort(inside, kind="stable")
        order = order[inside[order] > self.inside[at[order]]]
        # Of repeated places the last assignment stays, which is the greatest.
        self.inside[at[order]], self.partner[at[order]] = inside[order], partner[order]

    def pairs(self, own: np.ndarray, nodes: np.ndarray, met: Met) -> Iterator[pa.RecordBatch]:
        """The pairs found, each once; ``own`` and the partners are places of ``nodes``."""
        found = self.inside >= 0
        x, y = own[found], self.partner[found]
        once = np.unique(np.minimum(x, y) * len(nodes) + np.maximum(x, y))
        x, y = once // len(nodes), once % len(nodes)
        new = ~met.before(x, y)
        if new.any():
            yield _pairs(nodes[x[new]], nodes[y[new]])


def _leaves(rows: pa.RecordBatch, nearest: bool) -> Iterator[pa.RecordBatch]:
    """The joins of many buckets at once whose tree is a single leaf."""
    node, root, size = (rows.column(c).to_numpy() for c in ("node", "root", "size"))
    vectors, best = None, Nearest(len(node))
    at, count = runs(rows.column("key").to_numpy())
    for n in np.unique(count):
        i, j = np.triu_indices(n, 1)
        first = at[count == n][:, None]
        x, y = (first + i).ravel(), (first + j).ravel()
        fits = (root[x] != root[y]) & (100 * np.minimum(size[x], size[y]) >= PERCENT * np.maximum(size[x], size[y]))
        x, y = x[fits], y[fits]
        if len(x) and vectors is None:
            vectors, sketches, met = _points(rows.column("point")), Sketches(rows.column("sketch")), Met(rows.column("earlier"))
        for part in range(0, len(x), 1 << 16):
            a, b = x[part : part + (1 << 16)], y[part : part + (1 << 16)]
            inside = np.minimum(vectors[a], vectors[b]).sum(1)
            good = overlap_reaches(inside, size[a], size[b])
            a, b, inside = a[good], b[good], inside[good]
            good, inside = sketches.within(a, b, size[a], size[b], inside)
            a, b, inside = a[good], b[good], inside[good]
            if nearest:
                best.offer(a, b, inside)
                best.offer(b, a, inside)
            elif len(a):
                new = ~met.before(a, b)
                yield _pairs(node[a[new]], node[b[new]])
    if vectors is not None:
        yield from best.pairs(np.arange(len(node)), node, met)


def _searched(buckets: DataFrame, roots: DataFrame, points: DataFrame, *, nearest: bool) -> DataFrame:
    """Pairs (a, b) of nodes of one bucket, not yet connected, whose points and sketches allow a link.

    With ``nearest`` only the nearest such point of each node in each block of a bucket. A pair
    that shares several buckets is told by that of the smallest key, as far as ``Met`` knows.
    """
    rooted = buckets.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    open_keys = (
        rooted.groupBy("key")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
        .filter("low <> high")
        .select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least(j, F.col("mine")).alias("p"), F.greatest(j, F.col("mine")).alias("q")),
    )
    listed = rooted.join(open_keys, "key").groupBy("node", "root").agg(F.array_sort(F.collect_list(F.struct("key", "blocks"))).alias("keys"))
    earlier = F.slice(F.col("keys.key"), F.lit(1), F.least("i", F.lit(EARLIER)))
    described = ["node", "root", "size", "point", "sketch"]
    placed = (
        listed.join(points.select("node", "size", "point", "sketch"), "node")
        .select(*described, "keys", F.posexplode("keys").alias("i", "of"))
        .select("of.key", "of.blocks", *described, earlier.alias("earlier"))
        .withColumn("mine", mine)
        .select("key", "mine", *described, "earlier", F.explode(others).alias("at"))
        .select("key", "at.p", "at.q", "mine", *described, "earlier")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def joined(rows: pa.RecordBatch | pa.Table) -> Iterator[pa.RecordBatch]:
            node, root, size, block, p, q = (rows.column(c).to_numpy() for c in ("node", "root", "size", "mine", "p", "q"))
            vectors, sketches, met = _points(rows.column("point")), Sketches(rows.column("sketch")), Met(rows.column("earlier"))
            trees = [(RTree(vectors[s], size[s], root[s]), np.flatnonzero(s)) for s in (block == p, block != p) if s.any()]
            if len(trees) == 1 and p[0] != q[0]:
                return
            (a, at_a), (b, at_b) = trees[0], trees[-1]
            best_a = Nearest(len(at_a))
            best_b = Nearest(len(at_b)) if b is not a else best_a
            for x, y, inside in tree_join(a, b if b is not a else None):
                good, inside = sketches.within(at_a[x], at_b[y], size[at_a[x]], size[at_b[y]], inside)
                x, y, inside = x[good], y[good], inside[good]
                if nearest:
                    best_a.offer(x, at_b[y], inside)
                    best_b.offer(y, at_a[x], inside)
                elif len(x):
                    new = ~met.before(at_a[x], at_b[y])
                    yield _pairs(node[at_a[x[new]]], node[at_b[y[new]]])
            yield from best_a.pairs(at_a, node, met)
            if b is not a:
                yield from best_b.pairs(at_b, node, met)

        current = None
        for batch in batches:
            k, p, q = (batch.column(c).to_numpy() for c in ("key", "p", "q"))
            changed = np.concatenate(([True], (k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])))
            at = np.flatnonzero(changed)
            count = np.diff(np.append(at, len(k)))
            small = np.zeros(len(k), bool)
            for i, (first, n) in enumerate(zip(at.tolist(), count.tolist(), strict=True)):
                name = (k[first], p[first], q[first])
                if name != current and held:
                    yield from joined(pa.Table.from_batches(held).combine_chunks())
                    held.clear()
                current = name
                whole = i < len(at) - 1 and not held
                if whole and n <= FANOUT and p[first] == q[first]:
                    small[first : first + n] = True
                elif whole:
                    yield from joined(batch.slice(first, n))
                else:
                    held.append(batch.slice(first, n))
            if small.any():
                yield from _leaves(batch.filter(pa.array(small)), nearest)
        if held:
            yield from joined(pa.Table.from_batches(held).combine_chunks())

    sorted_rows = placed.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "node")
    return sorted_rows.mapInArrow(search, "a long, b long")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, node, size) and links (a, b, common) between nodes of ``docs`` (doc_id, text, digest).

    The links connect what belongs together; of nodes that other links connect already,
    not every pair is looked at.
    """
    members = cut(_members(docs))
    buckets = cut(_buckets(_keyed(docs)), free_shuffles=True)
    loose = buckets.filter((F.col("key") == LOOSE) & (F.col("node") != 0)).select("node").distinct()
    if not loose.isEmpty():
        # Exact way for loose sets: whatever shares a prefix shingle with one of them.
        keyed = cut(_keyed(docs, prefixes=True))
        wanted = keyed.join(loose, "node", "left_semi").select("key").distinct()
        more = _buckets(keyed.join(wanted, "key", "left_semi"))
        buckets = cut(buckets.filter(F.col("key") != LOOSE).unionByName(more), free_shuffles=True)
    buckets = cut(_single(buckets), free_shuffles=True)
    texts = cut(_texts(docs, members, buckets.select("node").distinct()), free_shuffles=True)
    stars = buckets.filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    checked = cut(_verified(_bounded(stars, texts), texts), free_shuffles=True)
    for nearest in (True, False):
        roots = cut(connected(checked.filter("link")))
        tried = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = cut(_searched(buckets, roots, texts, nearest=nearest).distinct(), free_shuffles=True)
        untried = found.join(tried, ["a", "b"], "left_anti")
        checked = cut(checked.unionByName(_verified(untried, texts)), free_shuffles=True)
        # A node without a near enough point of another root has none later either, as roots only merge.
        buckets = buckets.join(found.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    return members, checked.filter("link").select("a", "b", "common")


def components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    A set holds the distinct 5-word shingles of the whole lower-cased (A-Z) text, or the
    whole sequence of a shorter one. component_id is the smallest doc_id that links reach,
    the row's own included. Null, empty and blank texts have an empty set and are linked
    with nothing. Rows of equal id count one by one; a row of null id links others but is
    never a component's name, and stands for itself alone with a null component_id. No
    rows give no rows; other columns are ignored. Ids are numbers or strings. Sets and shingles are told apart by 64-bit hashes.
    """
    name = F.col(doc_id) if isinstance(docs.select(doc_id).schema[0].dataType, StringType) else F.col(doc_id).cast("long")
    rows = docs.select(name.alias("doc_id"), F.col(text).alias("text")).withColumn("digest", F.xxhash64("text"))
    members, found = links(rows)
    roots = connected(found)
    rooted = members.join(roots, "node", "left").select("doc_id", "size", F.coalesce("root", "node").alias("root"))
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(least, "root", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")
    )
