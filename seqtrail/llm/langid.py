"""Language identification by the nearest of several TF-IDF centroids per language."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtrail.llm.common import fit_in_task, slices

#: Hash buckets of the n-grams of one to three bytes.
DIMENSIONS = 4096
#: Bounds of the fitting sample: documents per language and in all.
PER_LANGUAGE = 400
SAMPLE = 3000
CENTROIDS = 4
#: Windows of fitting texts, in characters, that show how similar short texts are.
WINDOWS = (16, 40, 100, 250, 600)
#: A text is rejected below this share of the least similarity seen at its length.
SLACK = 0.6
UNKNOWN = "und"

LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _code in range(128):
    if not (97 <= _FOLD[_code] <= 122):
        _FOLD[_code] = 32


def gram_counts(text: str) -> np.ndarray:
    """Hashed counts of the 1- to 3-byte grams; runs of other ASCII than letters are one blank."""
    data = np.frombuffer(f" {text} ".lower().encode(), np.uint8)
    counts = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(data), 1 << 20):
        b = _FOLD[data[at : at + (1 << 20) + 2]]
        b = b[~((b == 32) & (np.concatenate(([0], b[:-1])) == 32))].astype(np.uint32)
        grams = [b, b[:-1] * 256 + b[1:] + 70_000, b[:-2] * 65536 + b[1:-1] * 256 + b[2:] + 7_000_000]
        for g in grams:
            g = (g * np.uint32(2654435761)) >> np.uint32(20)
            counts += np.bincount(g, minlength=DIMENSIONS)
    return counts


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    #: Least similarity seen, by the binary logarithm of the number of grams.
    floor: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts).astype(np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, cosine with its nearest centroid, and whether that is too far off."""
        near = self.vectors(counts) @ self.centroids.T
        best = near.argmax(1)
        similarity = np.clip(near[np.arange(len(near)), best], 0.0, 1.0)
        return self.owner[best], similarity, similarity < SLACK * self.floor[_size(counts)]


def _size(counts: np.ndarray) -> np.ndarray:
    return np.log2(counts.sum(1) + 1).astype(np.int64).clip(0, 40)


def _clusters(points: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first starts."""
    centres = [points.mean(0)]
    for _ in range(k - 1):
        near = np.max(points @ np.array(centres).T / np.maximum(np.linalg.norm(centres, axis=1), 1e-9), axis=1)
        centres.append(points[int(near.argmin())])
    c = np.array(centres)
    for _ in range(12):
        of = (points @ (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)).T).argmax(1)
        c = np.array([points[of == j].mean(0) if (of == j).any() else c[j] for j in range(len(c))])
    return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on a bounded sample of ``docs``: the first PER_LANGUAGE of each language by hash, SAMPLE at most.

    The sample's sparse counts are fitted in one task; only the model comes to the driver. Rows with null text, language or id
    are left out, as are texts without a letter. Without any, the model knows no language.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    usable = rows.filter("doc_id is not null and lang is not null and text is not null")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ranked = usable.select("doc_id", "lang", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).alias("rank"))
    # At most SAMPLE rows of an id and a language.
    sample = ranked.filter(F.col("rank") <= PER_LANGUAGE).orderBy("rank", *order).limit(SAMPLE).select("doc_id", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out = []
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not LETTER.search(body):
                    continue
                at = len(body) // 3
                for part in (body, *(body[at : at + w] for w in WINDOWS if at + w < len(body))):
                    if LETTER.search(part):
                        c = gram_counts(part)
                        i = np.flatnonzero(c)
                        out.append((name, part is body, i.astype(np.uint16).tobytes(), c[i].astype(np.uint32).tobytes()))
            names = ["lang", "whole", "grams", "counts"]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.string(), pa.bool_(), pa.binary(), pa.binary()))], names)

    def fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("lang", "whole", "grams", "counts")), strict=True)]
        # In an order of their own, whatever order the tasks ended in.
        made = fit_counts(sorted(rows))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["model"])

    counted = usable.join(F.broadcast(sample), ["doc_id", "lang"], "left_semi").mapInArrow(
        count, "lang string, whole boolean, grams binary, counts binary"
    )
    return fit_in_task(counted, fit_sample)


def _dense(rows: list[tuple]) -> np.ndarray:
    counts = np.zeros((len(rows), DIMENSIONS), np.float32)
    for at, (_, _, grams, n) in enumerate(rows):
        counts[at, np.frombuffer(grams, np.uint16)] = np.frombuffer(n, np.uint32)
    return counts


def fit_counts(rows: list[tuple]) -> Model:
    """The model of (language, whole text?, grams, counts) rows, grams and counts as packed arrays.

    Centroids come from whole texts, the similarity floor also from windows of them.
    """
    whole = [r for r in rows if r[1]]
    languages = sorted({r[0] for r in whole})
    counts = _dense(whole)
    idf = (np.log((1 + len(whole)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    model = Model(languages, np.zeros(0, np.int64), np.zeros((0, DIMENSIONS), np.float32), idf, np.zeros(41, np.float32))
    if not languages:
        return model
    vectors = model.vectors(counts)
    names = np.array([r[0] for r in whole], object)
    centroids, owner = [], []
    for at, language in enumerate(languages):
        own = vectors[names == language]
        found = _clusters(own, max(1, min(CENTROIDS, len(own) // 20)))
        centroids.append(found)
        owner += [at] * len(found)
    model.centroids, model.owner = np.concatenate(centroids), np.array(owner)
    least = np.full(41, np.inf, np.float32)
    for at in range(0, len(rows), 512):
        counts = _dense(rows[at : at + 512])
        np.minimum.at(least, _size(counts), (model.vectors(counts) @ model.centroids.T).max(1))
    # Lengths that the sample lacks take the floor of the next shorter one, or none.
    floor, last = np.zeros(41, np.float32), np.float32(0)
    for i in range(41):
        last = least[i] if np.isfinite(least[i]) else last
        floor[i] = last
    model.floor = floor
    return model


def predict(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of ``docs``.

    lang_pred is the language of the centroid with the greatest cosine, ties to the first
    by name; score is that cosine. ``rejected`` says that the text is farther from all
    centroids than fitting texts of its length are. Null, empty and letterless texts get
    ``und``, score 0 and are rejected, and so does every text if no language is known.
    Repeated rows and null ids stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, 128):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            names, scores, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            some = [i for i, x in enumerate(texts) if m.languages and LETTER.search(x)]
            if some:
                best, similarity, off = m.predict(np.array([gram_counts(texts[i]) for i in some]))
                scores[some], far[some] = similarity, off
                for i, b in zip(some, best.tolist(), strict=True):
                    names[i] = m.languages[b]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names), pa.array(scores), pa.array(far)], ["doc_id", "lang_pred", "score", "rejected"]
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text))
    return rows.mapInArrow(judge, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Does the CRC-32 of the id as text fall into this fold?"""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


def without_rejected(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``predict`` does not reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, 128):
            texts = [x or "" for x in batch.column(at).to_pylist()]
            good = np.zeros(len(texts), bool)
            some = [i for i, x in enumerate(texts) if m.languages and LETTER.search(x)]
            if some:
                good[some] = ~m.predict(np.array([gram_counts(texts[i]) for i in some]))[2]
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
