"""Best-fit packing of texts into sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtrail.llm.common import runs

#: Permitted sequence lengths and what a sequence costs besides its tokens.
CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16
#: Pieces that one best-fit run sees on average; with this many the open rest is negligible.
GROUP_PIECES = 20_000

PLACED = "doc_id long, piece int, start long, n_tokens long, sequence_id string, offset int, capacity int"


class Bins:
    """Open bins of one group, found by what is left in them."""

    def __init__(self, lengths: np.ndarray, capacities: Sequence[int], overhead: int):
        self.capacities, self.overhead = sorted(capacities), overhead
        counts = np.bincount(lengths, minlength=self.capacities[-1] + 1)
        self.mass = np.cumsum(counts * np.arange(len(counts)))  # tokens in pieces up to a length
        self.left: dict[int, list[int]] = {}
        self.room = np.zeros(self.capacities[-1] + 1, bool)
        self.opened: list[int] = []
        self.filled: list[int] = []

    def _cheapest(self, length: int) -> int:
        """The size to open: least cost per token that it can be expected to hold.

        What later pieces can add is the room left, or all their tokens if these are fewer.
        """

        def price(size: int) -> tuple[float, int]:
            room = size - length
            rest = self.mass[min(room, length)] - (length if length <= room else 0)
            return (size + self.overhead) / (length + min(room, max(0, int(rest)))), size

        return min((size for size in self.capacities if size >= length), key=price)

    def put(self, length: int) -> tuple[int, int]:
        """The bin of a piece and its offset; pieces come by falling length."""
        fits = np.argmax(self.room[length:]) + length
        if self.room[fits]:
            left = int(fits)
            stack = self.left[left]
            at = stack.pop()
            if not stack:
                self.room[left] = False
        else:
            at, left = len(self.opened), self._cheapest(length)
            self.opened.append(left)
            self.filled.append(0)
        offset = self.filled[at]
        self.filled[at] += length
        self.mass[length:] -= length
        if left > length:
            self.left.setdefault(left - length, []).append(at)
            self.room[left - length] = True
        return at, offset

    def final(self, at: int) -> int:
        """The smallest permitted size that holds what the bin came to hold."""
        return next(size for size in self.capacities if size >= self.filled[at])


def pieces(docs: DataFrame, doc_id: str, length: Column, largest: int) -> DataFrame:
    """doc_id, piece, start, n_tokens: texts longer than ``largest`` are cut, the rest is one piece."""
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n"))
    last = F.greatest(F.ceil(F.col("n") / largest) - 1, F.lit(0)).cast("int")
    cut_up = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * largest
    return cut_up.select("doc_id", "piece", start.alias("start"), F.least(F.lit(largest), F.col("n") - start).alias("n_tokens"))


def pack(
    docs: DataFrame,
    length: Column,
    *,
    doc_id: str = "doc_id",
    capacities: Sequence[int] = CAPACITIES,
    overhead: int = OVERHEAD,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Where each piece of each text goes: columns of ``PLACED``.

    Pieces are dealt to groups by a hash, as many as ``group_pieces`` asks for; in each
    group the pieces come by falling length and each goes to the open bin in which least
    room is left over, or opens the bin size that costs least per expected token. At the
    end every bin shrinks to the smallest permitted size that holds its content. More
    data means more groups, so no task holds more than its groups of a few numbers a piece.

    Texts without tokens (null or zero length) keep a row with null sequence_id. Rows with
    equal ids are placed one by one; null ids too. Equal lengths go by id and piece. No
    rows give no rows; other columns are ignored. ``length`` is not negative.
    """
    parts = pieces(docs, doc_id, length, max(capacities))
    filled, empty = parts.filter("n_tokens > 0"), parts.filter("n_tokens <= 0")
    groups = max(1, round(filled.count() / group_pieces))
    key = F.pmod(F.xxhash64("doc_id", "piece", F.lit(7)), F.lit(groups)).cast("int")
    dealt = (
        filled.withColumn("g", key)
        .repartition("g")
        .sortWithinPartitions("g", F.desc("n_tokens"), "doc_id", "piece", "start")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            group = pa.Table.from_batches(held).combine_chunks()
            lengths = group.column("n_tokens").to_numpy()
            bins = Bins(lengths, capacities, overhead)
            placed = [bins.put(n) for n in lengths.tolist()]
            g = group.column("g")[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    *(group.column(c).combine_chunks() for c in ("doc_id", "piece", "start", "n_tokens")),
                    pa.array([f"{g}-{at}" for at, _ in placed]),
                    pa.array([offset for _, offset in placed], pa.int32()),
                    pa.array([bins.final(at) for at, _ in placed], pa.int32()),
                ],
                ["doc_id", "piece", "start", "n_tokens", "sequence_id", "offset", "capacity"],
            )
            held.clear()

        current = None
        for batch in batches:
            keys = batch.column("g").to_numpy()
            for first, n in zip(*runs(keys), strict=True):
                if keys[first] != current:
                    yield from flush()
                    current = keys[first]
                held.append(batch.slice(first, n))
        yield from flush()

    nowhere = empty.select(
        "doc_id", "piece", "start", "n_tokens",
        F.lit(None).cast("string").alias("sequence_id"), F.lit(None).cast("int").alias("offset"),
        F.lit(None).cast("int").alias("capacity"),
    )
    return dealt.mapInArrow(place, PLACED).unionByName(nowhere)
