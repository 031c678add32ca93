"""Token sequences in a keyed random order, as shards of fixed-stride records."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqtrail.llm.common import cut, new_folder, slices

ROUNDS = 6
U = np.uint64


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _round_keys(key: str) -> list[np.uint64]:
    return [U(int.from_bytes(hashlib.sha256(f"{key}|{r}".encode()).digest()[:8])) for r in range(ROUNDS)]


def permute(index: np.ndarray, n: int, key: str, *, back: bool = False) -> np.ndarray:
    """Places 0..n-1 of a keyed permutation, or with ``back`` the numbers at these places.

    A balanced Feistel network permutes the smallest domain of an even number of bits that
    holds n numbers; what falls outside 0..n-1 is sent through again until it falls
    inside (cycle-walking), which at most quadruples the work on average.
    """
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask, keys = U((1 << half) - 1), _round_keys(key)
    x = np.array(index, U)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> U(half), x[todo] & mask
        for k in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (_scramble(left ^ k) & mask), left
            else:
                left, right = right, left ^ (_scramble(right ^ k) & mask)
        x[todo] = (left << U(half)) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


#: Where the parts of texts lie in a sequence.
PARTS = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int32()), ("at", pa.int32())]))


def sequences(
    docs: DataFrame, encode: Callable[[], Callable[[list[str]], list[list[int]]]], length: int, filler: int, dtype: str, *, doc_id: str, text: str
) -> DataFrame:
    """ids, parts, part, row: the encoded texts of each task, one after the other, in sequences of ``length``.

    ``encode`` makes the encoder inside a task. A filler id stands between two texts; the
    last sequence of a task is filled up. ``parts`` tells which tokens of which document
    lie where. (part, row) numbers the sequences; the table is stored, which fixes them.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, row = encode(), TaskContext.get().partitionId(), 0
        current, fill = np.full(length, filler, dtype), 0
        members: list[dict] = []
        done: list[tuple[bytes, list[dict]]] = []

        def close() -> None:
            nonlocal current, fill, members
            done.append((current.tobytes(), members))
            current, fill, members = np.full(length, filler, dtype), 0, []

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal row
            n = len(done)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x for x, _ in done], pa.binary()), pa.array([m for _, m in done], PARTS),
                        pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()),
                    ],
                    ["ids", "parts", "part", "row"],
                )
            row += n
            done.clear()

        for batch in slices(batches, 64):
            encoded = encoder([x or "" for x in batch.column(1).to_pylist()])
            for name, tokens in zip(batch.column(0).to_pylist(), encoded, strict=True):
                at, ids = 0, np.array(tokens, dtype)
                while at < len(ids):
                    n = min(length - fill, len(ids) - at)
                    current[fill : fill + n] = ids[at : at + n]
                    members.append({"doc_id": name, "start": at, "n_tokens": n, "at": fill})
                    at, fill = at + n, fill + n
                    if fill == length:
                        close()
                if fill:
                    fill += 1
                    if fill == length:
                        close()
            yield from rows()
        if fill:
            close()
        yield from rows()

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text))
    schema = "ids binary, parts array<struct<doc_id: long, start: long, n_tokens: int, at: int>>, part int, row long"
    path = new_folder(docs.sparkSession, "sequences")
    source.mapInArrow(cut_up, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def with_slots(rows: DataFrame, key: str, per_shard: int) -> DataFrame:
    """``rows`` with slot and shard: number the rows densely by (part, row), then permute."""
    per_part = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task of the stage that made the rows.
    bases = per_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    total = rows.count()

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(), total, key))

    return (
        rows.join(F.broadcast(bases), "part")
        .withColumn("slot", slot(F.col("base") + F.col("row")))
        .withColumn("shard", F.expr(f"slot div {per_shard}"))
        .drop("part", "row", "base")
    )


def stride(length: int, dtype: str) -> int:
    """Bytes from one record to the next: the ids and one closing filler id."""
    return (length + 1) * np.dtype(dtype).itemsize


def write_shards(rows: DataFrame, folder: str, shards: int, filler: int, dtype: str, *, rounds: int = 4) -> None:
    """Write ``rows`` (ids, slot, shard) as one raw file per shard, in the order of the slots.

    Slots are dense, so record k of shard s is slot s * per_shard + k and starts at byte
    k * stride. Spark's writer commits whole tasks, so a shard is never half there. The
    shards are made in ``rounds`` ranges, one after the other, so that only a part of the
    sequences is in the shuffle at a time.
    """
    closing = np.array([filler], dtype).tobytes().decode("latin-1")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for r in range(rounds):
        first, last = shards * r // rounds, shards * (r + 1) // rounds
        if first == last:
            continue
        # The writer takes strings but writes their bytes as they are.
        (
            rows.filter((F.col("shard") >= first) & (F.col("shard") < last))
            .select(F.col("ids").cast("string").alias("value"), "shard", "slot")
            .repartitionByRange(parts, "shard")
            .sortWithinPartitions("shard", "slot")
            .drop("slot")
            .write.mode("append")
            .partitionBy("shard")
            .option("lineSep", closing)
            .option("encoding", "ISO-8859-1")
            .text(folder)
        )


def read_shards(
    spark: SparkSession, folder: str, per_shard: int, length: int, filler: int, dtype: str, *, first_slot: int = 0, total: int | None = None
) -> DataFrame:
    """slot, shard, byte_start, n_tokens, ids from ``first_slot`` on; fillers at the end are left out.

    Reading can stop anywhere and go on from the next slot: earlier shards are not opened.
    A shard whose size is no whole number of records is an error. With ``total``, the number
    of sequences that were written, so is a shard that lacks records or has too many, and a
    shard that is missing, twice there or none of theirs; without it these cannot be told.
    """
    size = stride(length, dtype)
    schema = "slot long, shard long, byte_start long, n_tokens int, ids binary"
    if total == 0:
        return spark.createDataFrame([], schema)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            shard, data = batch.column("shard")[0].as_py(), batch.column("content")[0].as_py()
            if len(data) % size:
                raise ValueError(f"shard {shard} has {len(data)} bytes, no multiple of {size}")
            table = np.frombuffer(data, dtype).reshape(-1, length + 1)
            if total is not None and len(table) != min(per_shard, total - shard * per_shard):
                raise ValueError(f"shard {shard} has {len(table)} records, not {min(per_shard, total - shard * per_shard)}")
            skip = max(0, first_slot - shard * per_shard)
            for at in range(skip, len(table), 1024):
                ids = table[at : at + 1024, :length]
                n = len(ids)
                counts = length - np.argmax(ids[:, ::-1] != filler, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(at, at + n) + shard * per_shard, pa.int64()), pa.array([shard] * n, pa.int64()),
                        pa.array(np.arange(at, at + n) * size, pa.int64()), pa.array(counts, pa.int32()),
                        pa.array([r[:c].tobytes() for r, c in zip(ids, counts, strict=True)], pa.binary()),
                    ],
                    ["slot", "shard", "byte_start", "n_tokens", "ids"],
                )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    of_path = F.regexp_extract("path", r"/shard=(\d+)/", 1).cast("long")
    wanted = files.select(of_path.alias("shard"), "content").filter(F.col("shard") >= first_slot // per_shard)
    if total is not None:
        # Only paths are read here, not contents.
        there = wanted.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        due = spark.range(first_slot // per_shard, max(first_slot // per_shard, -(-total // per_shard))).select(F.col("id").alias("shard"), F.lit(1).alias("due"))
        wrong = there.join(due, "shard", "full").filter("n is null or due is null or n > 1").select("shard").limit(5).collect()
        if wrong:
            raise ValueError(f"shards missing, repeated or not of these {total} sequences: {sorted(r.shard for r in wrong)}")
    return wanted.mapInArrow(records, schema)


def materialise_counted(
    docs: DataFrame,
    encode: Callable[[], Callable[[list[str]], list[list[int]]]],
    *,
    key: str,
    filler: int,
    length: int = 512,
    per_shard: int = 4096,
    dtype: str = "<u2",
    doc_id: str = "doc_id",
    text: str = "text",
    folder: str | None = None,
) -> tuple[DataFrame, str, int]:
    """Write all sequences of ``docs`` in training order; the index of slots, the folder and how many there are.

    The index has slot, shard and, for each part of a text in a sequence, doc_id, start
    (its first token in the text), n_tokens and at (its place in the sequence). Each
    sequence has one slot of 0..n-1, by a keyed permutation of the stored sequences' numbers.
    ``filler`` must be an id that ``encode`` never gives. Null and empty texts are in
    no sequence. Repeated rows are kept one by one; null doc_ids stay null; other columns
    are ignored. Without any sequence no shard is written.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "shards")
    rows = sequences(docs, encode, length, filler, dtype, doc_id=doc_id, text=text)
    placed = with_slots(rows, key, per_shard)
    total = rows.count()
    write_shards(placed, folder, -(-total // per_shard), filler, dtype)
    return placed.select("slot", "shard", F.inline("parts")), folder, total


def materialise(
    docs: DataFrame, encode: Callable[[], Callable[[list[str]], list[list[int]]]], **options
) -> tuple[DataFrame, str]:
    """The index and the folder of ``materialise_counted``."""
    return materialise_counted(docs, encode, **options)[:2]
