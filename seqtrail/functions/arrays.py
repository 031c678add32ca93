"""Bounded arrays: suffixes, padding, masks and shifted labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100  # fixed value: label of a position that is not scored


def last_k(array: Column, k: int) -> Column:
    """the last ``k`` items; shorter arrays stay whole."""
    return F.slice(array, F.greatest(F.size(array) - k + 1, F.lit(1)), k)


def pad_to(array: Column, length: int | Column, fill: int) -> Column:
    """Fill an array up to ``length`` items."""
    length = length if isinstance(length, Column) else F.lit(length)
    missing = F.greatest(length - F.size(array), F.lit(0))
    return F.concat(array, F.array_repeat(F.lit(fill), missing))


def attention_mask(size: Column, length: int | Column) -> Column:
    length = length if isinstance(length, Column) else F.lit(length)
    return F.concat(F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), length - size))


def next_labels(ids: Column, ignored_ids: list[int]) -> Column:
    """labels of a padded id array, one to the left, with ignored ids masked."""
    masked = F.transform(ids, lambda i: F.when(i.isin(ignored_ids), IGNORED).otherwise(i))
    return F.concat(F.slice(masked, 2, F.greatest(F.size(ids) - 1, F.lit(0))), F.array(F.lit(IGNORED)))


def label_out_of_range(labels: Column, vocabulary_size: int | Column) -> Column:
    """does any label, other than the ignored mark, fall outside 0..size-1?"""
    return F.exists(
        labels, lambda x: (x != IGNORED) & ((x < 0) | (x >= vocabulary_size))
    )


def prepend(prefix: list[int], ids: Column, mask: Column, labels: Column) -> list[Column]:
    """Put a fixed instruction before a sequence; the instruction is not scored."""
    n = len(prefix)
    fixed = F.array(*[F.lit(i) for i in prefix])
    return [
        F.concat(fixed, ids),
        F.concat(F.array_repeat(F.lit(1), n), mask),
        F.concat(F.array_repeat(F.lit(IGNORED), n), labels),
    ]


def text(array: Column) -> Column:
    """An array of numbers as comma-separated text."""
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")
