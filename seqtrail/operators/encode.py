"""Tokens of sequences, truncated, encoded, padded and labelled; corpus packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqtrail.functions.arrays import IGNORED, attention_mask, next_labels, pad_to
from seqtrail.functions.numbers import int_div
from seqtrail.functions.ordered import lookup, order_rows, running_total
from seqtrail.functions.storage import cut
from seqtrail.functions.timing import DELTA_LABELS, FIRST_ROW
from seqtrail.operators.sequences import ROW
from seqtrail.operators.vocab import RARE

PAD = "<PAD>"
SPECIAL_TOKENS = [PAD, ROW, FIRST_ROW, *DELTA_LABELS, RARE]
PAD_ID, ROW_ID = SPECIAL_TOKENS.index(PAD), SPECIAL_TOKENS.index(ROW)


def token_ids(spark, tokens: DataFrame) -> DataFrame:
    """Ids of all tokens: the special ones first, then the actions by rank."""
    special = spark.createDataFrame(
        list(enumerate(SPECIAL_TOKENS)), "token_id int, token string"
    ).select("token", "token_id")
    actions = tokens.select("token", (F.col("rank") + len(SPECIAL_TOKENS)).cast("int").alias("token_id"))
    return special.unionByName(actions)


def with_delimiters(sequences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long token table of sequences: each action token is followed by ``<ROW>``."""
    pair = F.array(
        F.struct((F.col("pos") * 2).alias("pos"), F.col("token").alias("token")),
        F.struct((F.col("pos") * 2 + 1).alias("pos"), F.lit(ROW).alias("token")),
    )
    return sequences.select(*keys, F.explode(pair).alias("_t")).select(*keys, "_t.pos", "_t.token")


def suffix(tokens: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The last ``k`` positions of each sequence.

    Spark limits the ranked rows before and after the shuffle, so a huge sequence sends
    at most ``k`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(F.desc("pos"))
    return (
        tokens.withColumn("_from_end", F.row_number().over(window))
        .filter(F.col("_from_end") <= k)
        .drop("_from_end")
    )


def truncation_stats(lengths: DataFrame, k: int, *, by: Sequence[str] = ()) -> DataFrame:
    """How many of the sequences (``n`` tokens each) are longer than ``k``."""
    counts = lengths.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.sum((F.col("n") > k).cast("long")).alias("n_truncated"),
    )
    return counts.withColumn(
        "pct_truncated", F.col("n_truncated") * 100.0 / F.greatest(F.col("n_sequences"), F.lit(1))
    )


def encode(
    tokens: DataFrame,
    ids: DataFrame,
    keys: Sequence[str],
    *,
    length: int,
    ignored_ids: Sequence[int] = (PAD_ID, ROW_ID),
) -> DataFrame:
    """Id, mask and label arrays of exactly ``length`` items per sequence.

    ``tokens`` is long; it is cut to the last ``length`` positions before anything is
    collected, so no array exceeds ``length``.
    """
    cut_off = lookup(suffix(tokens, keys, length), ids, ["token"], "inner")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "token_id")))
    arrays = cut_off.groupBy(*keys).agg(ordered.alias("_t")).select(*keys, F.col("_t.token_id").alias("_ids"))
    padded = arrays.select(
        *keys,
        F.size("_ids").alias("n_tokens"),
        pad_to(F.col("_ids"), length, PAD_ID).alias("input_ids"),
        attention_mask(F.size("_ids"), length).alias("attention_mask"),
    )
    return padded.withColumn("labels", next_labels(F.col("input_ids"), list(ignored_ids)))


def pad_batches(encoded: DataFrame) -> DataFrame:
    """pad each sequence of a batch to the longest one of that batch.

    Needs ``batch_id`` and unpadded ``input_ids``; a batch is bounded by its size.
    """
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("batch_id"))
    return (
        encoded.withColumn("_n", F.size("input_ids"))
        .withColumn("batch_len", longest)
        .select(
            *[c for c in encoded.columns if c not in ("input_ids", "attention_mask", "labels")],
            "batch_len",
            pad_to(F.col("input_ids"), F.col("batch_len"), PAD_ID).alias("input_ids"),
            attention_mask(F.col("_n"), F.col("batch_len")).alias("attention_mask"),
            pad_to(F.col("labels"), F.col("batch_len"), IGNORED).alias("labels"),
        )
    )


def corpus_tokens(corpus: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The white-space tokens of each text, in order."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    return corpus.select(key, F.posexplode(words).alias("pos", "token"))


def pack_blocks(
    corpus: DataFrame, key: str, *, block_length: int, text: str = "text", separator: str | None = None
) -> DataFrame:
    """All texts in key order as one token stream, cut into full blocks.

    Only the sizes of the texts are summed up in order; each text then knows its offset
    and hands every block it touches the slice that falls into it. A block never gathers
    more than ``block_length`` tokens. The short last block is dropped.
    """
    size = F.regexp_count(F.col(text), F.lit(r"\S+")) + (0 if separator is None else 1)
    sized = cut(corpus.select(key, size.cast("long").alias("_size")).filter(F.col("_size") > 0))
    offsets = running_total(sized, [], [key], F.col("_size"), "_end").select(
        key, (F.col("_end") - F.col("_size")).alias("_start"), "_end"
    )
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    if separator is not None:
        words = F.concat(words, F.array(F.lit(separator)))
    first, last = int_div(F.col("_start"), block_length), int_div(F.col("_end") - 1, block_length)
    placed = (
        corpus.select(key, words.alias("_words"))
        .join(offsets, key)
        .withColumn("block_id", F.explode(F.sequence(first, last)))
    )
    low = F.greatest(F.col("block_id") * block_length - F.col("_start"), F.lit(0))
    high = F.least((F.col("block_id") + 1) * block_length, F.col("_end")) - F.col("_start")
    piece = F.slice("_words", (low + 1).cast("int"), (high - low).cast("int"))
    pieces = placed.select("block_id", F.struct(F.col("_start"), piece.alias("tokens")).alias("_p"))
    return (
        pieces.groupBy("block_id")
        .agg(F.array_sort(F.collect_list("_p")).alias("_l"))
        .select("block_id", F.flatten("_l.tokens").alias("tokens"))
        .filter(F.size("tokens") == block_length)
    )


def renumber(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positions 0, 1, 2, ... after rows were dropped."""
    return order_rows(tokens.withColumnRenamed("pos", "_pos"), keys, ["_pos"]).drop("_pos")
