"""Deterministic randomness: values depend on keys only, never on partitions.

Keyed hashes (``hash32``) come from md5 and give sampling orders and splits; the draws of
bootstraps are made by ``functions/draws.py``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqtrail.functions.draws import PRIME

TWO32 = 4294967296.0


def key_text(*parts) -> Column:
    """Join literals and columns with ``|`` as the text to hash."""
    return F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def hash_text(*parts) -> Column:
    return F.md5(key_text(*parts))


def hash32(*parts) -> Column:
    """Unsigned 32-bit hash of the parts as a long."""
    return F.conv(F.substring(hash_text(*parts), 1, 8), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """Hash of the parts as a double in [0, 1)."""
    return hash32(*parts) / F.lit(TWO32)


def hash_points(*parts) -> list[Column]:
    """Two points below the prime for a key, 62 bits together, as ``functions/draws.py`` has them."""
    digest = hash_text(*parts)
    return [
        F.pmod(F.conv(F.substring(digest, start, 8), 16, 10).cast("long"), F.lit(PRIME)) for start in (1, 9)
    ]
