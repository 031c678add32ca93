"""Text normalisation, character n-grams and report cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(text: Column) -> Column:
    """lower case, no outer white space, inner white space as single blanks."""
    trimmed = F.regexp_replace(F.regexp_replace(F.lower(text), r"^\s+", ""), r"\s+$", "")
    return F.regexp_replace(trimmed, r"\s+", " ")


#: Gram starts to a piece of text: finding a character in a text means walking to it.
PIECE = 64


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """all character n-grams of ``low`` to ``high`` characters, repeats kept.

    Grams are cut from overlapping pieces, so that the work is linear in long texts.
    """

    def of_size(piece: Column, n: int) -> Column:
        last = F.least(F.lit(PIECE), F.length(piece) - n + 1)
        grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda at: F.substring(piece, at, F.lit(n)))
        return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))

    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(PIECE))
    pieces = F.transform(starts, lambda at: F.substring(text, at, F.lit(PIECE + high - 1)))
    return F.flatten(F.transform(pieces, lambda p: F.concat(*[of_size(p, n) for n in range(low, high + 1)])))


def mean_sd_cell(mean: Column, sd: Column, digits: int = 4) -> Column:
    """``mean (SD)`` as one report cell."""
    return F.format_string(f"%.{digits}f (%.{digits}f)", mean, sd)
