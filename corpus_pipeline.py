"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtrail.llm import bpe, langid, line_crf, packing, shingle_join
from seqtrail.llm.common import cut, words
from seqtrail.llm.queries import TOKENIZER

#: Greedy packing and fitted models are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near a centroid of some language."""
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"), 4, 2)))
    return langid.without_rejected(docs, model)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are mostly good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~langid.held_out(F.col("doc_id"), 5, 0))
    return line_crf.without_rejected(docs, line_crf.fit(docs, labels))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row: that of the smallest id, or else one without an id.

    Rows are named by 128 bits of a SHA-256 of id and text, so an id on different texts stands
    for several rows, and equal rows count once. Blank texts are like nothing: those without an
    id all stay. Columns may have any names.
    """
    (row,) = _free_names(docs, "row")
    told_apart = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.concat(F.lit(":"), "text"), F.lit("")))
    keyed = docs.withColumn(row, F.substring(F.sha2(told_apart, 256), 1, 32))
    blank = F.col("doc_id").isNull() & (F.size(words(F.col("text"))) == 0)
    told = keyed.filter(~blank)
    found = shingle_join.components(told.select(row, "text"), doc_id=row)
    named = found.select(F.col("doc_id").alias(row), "component_id").join(told.select(row, "doc_id").distinct(), row)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))
    kept = named.groupBy("component_id").agg(first.alias("first")).select(f"first.{row}")
    one_each = told.join(kept, row, "left_semi").dropDuplicates([row])
    return one_each.unionByName(keyed.filter(blank)).select(*docs.columns)


def _free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as make them differ from all columns."""
    taken = {c.lower() for c in docs.columns}
    mark = "_"
    while any(mark + name in taken for name in names):
        mark += "_"
    return [mark + name for name in names]


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces go in sequences of several lengths, in tokens of byte-level BPE."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path(TOKENIZER))
    # Stored, because packing reads the lengths twice.
    counts = cut(bpe.token_counts(docs, ranks, public_tokenizers.PATTERN))
    return packing.pack(counts, F.col("n_tokens"))


STAGES = [
    ("language", language),
    ("quality", quality),
    ("deduplicated", deduplicated),
    ("packed", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``; each stage's result is stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
