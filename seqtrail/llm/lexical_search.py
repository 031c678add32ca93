"""Ranked lexical search by the Best Position Algorithm, in integers.

The documents stay where they are stored. Each task goes over its own in portions, sorts a
portion's postings into impact lists, and answers every item on it: lists are read downwards
side by side, each document met is looked up in all lists (direct access to its own postings),
and both ways of access mark positions as seen. A list's best position ends the marked run from
its top. No unseen document can score more than the sum of the impacts at the best positions;
once that is strictly below the k-th best score so far, ties included, the rest is not read.
The k-th score is carried from portion to portion, so later portions stop sooner.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqtrail.functions.numbers import int_div
from seqtrail.functions.ordered import order_rows, running_total
from seqtrail.llm.common import cut

#: Distinct terms of the items that are answered in one pass over the documents (one item more may exceed it).
BLOCK_TERMS = 200_000
#: Postings and documents of a portion, which bound what a task holds.
PORTION, PORTION_DOCS = 1_000_000, 32_768
#: Rows read from each list in the first step; every further step reads twice as many.
FIRST_STEP = 16

# Letters and digits, and all bytes of characters beyond ASCII, make up terms; A-Z are lower-cased.
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order; none for null."""
    return text.translate(TABLE).split() if text else []


@dataclass(frozen=True)
class Asked:
    """One item: its number, the columns of its distinct terms, and how often it holds each."""

    number: int
    columns: np.ndarray
    repeats: np.ndarray


# Postings --------------------------------------------------------------------------------


def postings(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ``n`` terms of the whole text, and its postings in the vocabulary: ``columns`` and their counts ``tf``.

    Texts without a term have no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            keep, lengths, found, counts, ends = [], [], [], [], [0]
            for at, text in enumerate(texts):
                words = terms_of(text.as_py())
                if not words:
                    continue
                for term, tf in Counter(words).items():
                    column = known.get(term)
                    if column is not None:
                        found.append(column)
                        counts.append(tf)
                keep.append(at)
                lengths.append(len(words))
                ends.append(len(found))
            listed = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((found, pa.int32()), (counts, pa.int64()))]
            ids = batch.column("doc_id").take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(lengths, pa.int64()), *listed], names=["doc_id", "n", "columns", "tf"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, columns array<int>, tf array<long>")


def weights(frequencies: dict[int, int], n_docs: int, size: int) -> np.ndarray:
    """The weight of each vocabulary column: floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequencies.get(c, 0) + 1))) for c in range(size)], np.int64)


# Search in a portion -----------------------------------------------------------------------


class Portion:
    """Some documents as impact lists (by term, best first) and as rows (by document)."""

    def __init__(self, ids: pa.Array, n: np.ndarray, ends: np.ndarray, columns: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, total: int):
        self.given = np.asarray(ids.is_valid())
        self.ids = np.asarray(ids.fill_null(0))
        sizes = np.diff(ends)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        m = (75 + 25 * n * n_docs // total)[doc]
        impact = weight[columns] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
        held = impact > 0
        doc, self.columns, self.impact = doc[held], columns[held], impact[held]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(sizes)))))
        order = np.lexsort((-self.impact, self.columns))
        self.list_docs, self.list_impact = doc[order], self.impact[order]
        self.lists = np.searchsorted(self.columns[order], np.arange(len(weight) + 1))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order)) - self.lists[self.columns[order]]

    def rows(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all postings of ``docs``, one document after the other, and where each begins."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        begins = np.cumsum(sizes) - sizes
        return np.repeat(self.starts[docs] - begins, sizes) + np.arange(sizes.sum()), begins

    def search(self, item: Asked, slots: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents, and their scores, among which are all that can stand among the best ``k``.

        ``floor`` is a score that ``k`` documents of other portions reach already. ``slots``
        is -1 for every column, and is so again afterwards.
        """
        low, high = self.lists[item.columns], self.lists[item.columns + 1]
        filled = high > low
        columns, repeats, low, sizes = item.columns[filled], item.repeats[filled], low[filled], (high - low)[filled]
        slots[columns] = np.arange(len(columns))
        offsets = np.cumsum(sizes) - sizes
        seen = np.zeros(sizes.sum(), bool)
        met = np.zeros(len(self.ids), bool)
        best = np.zeros(len(columns), np.int64)  # How many positions from the top of each list are seen without a gap.
        found, scores, depth, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, FIRST_STEP
        while depth < (longest := sizes.max(initial=0)):
            until = min(depth + step, longest)
            read = [self.list_docs[a + depth : a + min(until, s)] for a, s in zip(low, sizes, strict=True) if s > depth]
            new = np.concatenate(read)
            new = np.unique(new[~met[new]])
            met[new] = True
            if len(new):
                rows, begins = self.rows(new)
                slot = slots[self.columns[rows]]
                asked = slot >= 0
                value = np.where(asked, self.impact[rows] * repeats[slot], 0)
                found.append(new)
                scores.append(np.add.reduceat(value, begins))
                slot = slot[asked]
                seen[offsets[slot] + self.place[rows[asked]]] = True
            threshold = 0
            for i, (a, o, s, r) in enumerate(zip(low, offsets, sizes, repeats, strict=True)):
                if best[i] < s:
                    rest = seen[o + best[i] : o + s]
                    gap = int(rest.argmin())
                    best[i] = s if rest[gap] else best[i] + gap
                if best[i] < s:  # Documents that are not in a list that is wholly seen get nothing from it.
                    threshold += int(r) * int(self.list_impact[a + best[i] - 1])
            depth, step = until, step * 2
            so_far = np.concatenate(scores)
            kth = max(floor, int(np.partition(so_far, -k)[-k]) if len(so_far) >= k else 0)
            if threshold < kth:
                break
        slots[columns] = -1
        return np.concatenate(found), np.concatenate(scores)


class Leaders:
    """The best ``k`` documents of one item so far: higher score first, then smaller id, null ids last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.given = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores: np.ndarray, ids: np.ndarray, given: np.ndarray) -> None:
        scores, ids, given = np.append(self.scores, scores), np.append(self.ids, ids), np.append(self.given, given)
        order = np.lexsort((ids, ~given, -scores))[: self.k]
        self.scores, self.ids, self.given = scores[order], ids[order], given[order]


def _portions(batches: Iterator[pa.RecordBatch], make: Callable[..., Portion]) -> Iterator[Portion]:
    held, docs, size = [], 0, 0

    def made() -> Portion:
        table = pa.Table.from_batches(held).combine_chunks()
        columns, tf = table["columns"].combine_chunks(), table["tf"].combine_chunks()
        sizes = np.asarray(columns.value_lengths())
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return make(table["doc_id"].combine_chunks(), np.asarray(table["n"]), ends, np.asarray(columns.flatten()), np.asarray(tf.flatten()))

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            held.append(part)
            docs, size = docs + part.num_rows, size + len(part.column("columns").flatten())
            if size >= PORTION or docs >= PORTION_DOCS:
                yield made()
                held, docs, size = [], 0, 0
    if held:
        yield made()


def best_of_tasks(index: DataFrame, items: list[Asked], weight: np.ndarray, n_docs: int, total: int, k: int) -> DataFrame:
    """item, doc_id, score: the best ``k`` of every item among the documents of each task."""
    shared = index.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        slots = np.full(len(weight), -1, np.int64)
        leaders = [Leaders(k) for _ in asked]
        for portion in _portions(batches, lambda *columns: Portion(*columns, weight, n_docs, total)):
            for item, best in zip(asked, leaders, strict=True):
                docs, scores = portion.search(item, slots, k, best.floor)
                docs, scores = docs[scores > 0], scores[scores > 0]
                best.add(scores, portion.ids[docs], portion.given[docs])
        for item, best in zip(asked, leaders, strict=True):
            number = np.full(len(best.scores), item.number, np.int64)
            ids = pa.array(best.ids, pa.int64(), mask=~best.given)
            yield pa.RecordBatch.from_arrays([pa.array(number), ids, pa.array(best.scores)], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


# Search --------------------------------------------------------------------------------------


def _item_terms(items: DataFrame, item_id: str) -> DataFrame:
    """item (number), item_id, its distinct ``terms`` with ``repeats``, and ``block``, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms_of(t)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            columns = [
                batch.column("item"), batch.column("item_id"),
                pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "terms", "repeats"])

    rows = items.select(F.col(item_id).alias("item_id"), F.col("text").cast("string").alias("text"))
    numbered = order_rows(rows, [], ["item_id", "text"], pos="item").select("item", "item_id", "text")
    kind = rows.schema["item_id"].dataType.simpleString()
    told = numbered.mapInArrow(run, f"item long, item_id {kind}, terms array<binary>, repeats array<long>")
    sized = running_total(told.filter(F.size("terms") > 0), [], ["item"], F.size("terms"), "so_far")
    return cut(sized.withColumn("block", int_div(F.col("so_far") - 1, BLOCK_TERMS)).drop("so_far"))


def search(docs: DataFrame, items: DataFrame, k: int = 20, *, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of each item, all if fewer score above 0.

    Items are answered in blocks of about ``BLOCK_TERMS`` distinct terms, which bounds what is
    sent to the tasks and what the driver holds; the documents are read once a block, and their
    postings in the block's terms are stored. Nothing of the documents is shuffled but counts
    per term, and ``k`` rows per item and task.

    Null and empty texts have no terms: such documents count nowhere, such items have no rows.
    Equal scores go by ascending doc_id, null ids last. Each row is a document or an item of its
    own, so repeated rows stand in the result several times. Other columns are ignored.
    """
    spark = docs.sparkSession
    asked = _item_terms(items, item_id)
    out = spark.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    last = asked.agg(F.max("block")).first()[0]
    for block in range(0 if last is None else last + 1):
        mine = asked.filter(F.col("block") == block)
        rows = mine.select("item", "terms", "repeats").collect()
        vocabulary: dict[bytes, int] = {}
        listed = []
        for row in rows:
            columns = [vocabulary.setdefault(bytes(t), len(vocabulary)) for t in row.terms]
            listed.append(Asked(row.item, np.array(columns, np.int64), np.array(row.repeats, np.int64)))
        index = cut(postings(docs, vocabulary, doc_id))
        n_docs, total = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            return out
        counted = index.select(F.explode("columns").alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("df"))
        weight = weights({r.column: r.df for r in counted.collect()}, n_docs, len(vocabulary))
        found = best_of_tasks(index, listed, weight, n_docs, total, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        out = out.unionByName(best.join(mine.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"))
    return out
