"""The registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtrail.llm import bpe, chat, langid, lexical_search, line_crf, merkle, packing, prefix_trie, quality_rules, shingle_join, training_order, url_filter, warc
from seqtrail.llm.common import cut
from seqtrail.llm.oracles import ORACLES

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Rules of the query on urls: action, host, path.
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: An id that the tokenizer leaves free; it fills up and closes training sequences.
FILLER = 50_256


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_archives(_table(spark, folder, "pages"))
    return warc.page_digests(warc.read_archives(spark, archives, payloads=False))


def op2_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_join.components(_table(spark, folder, "documents"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.filter_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.compare_with_next(_table(spark, folder, "documents"))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(_table(spark, folder, "pages"), url_filter.rule_table(spark, URL_RULES))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path(TOKENIZER))
    # Stored, because packing reads the lengths twice.
    counts = cut(bpe.token_counts(_table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN))
    return packing.pack(counts, F.col("n_tokens"))


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    # Smaller batches on the way to Python bound what a task holds outside Spark's memory.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    ranks = bpe.read_ranks(public_tokenizers.path(TOKENIZER))
    rows = bpe.text_rows(_table(spark, folder, "documents"))
    made = bpe.encode_texts(rows.select("digest", "text"), ranks, public_tokenizers.PATTERN, decoded=True)
    digests = made.select(
        "digest",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ).dropDuplicates(["digest"])
    return rows.select("doc_id", "digest").join(digests, "digest").drop("digest")


def op8_training_order(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = frozenset(bpe.read_ranks(public_tokenizers.path(TOKENIZER)).items())
    pattern = public_tokenizers.PATTERN
    shared = spark.sparkContext.broadcast(ranks)

    def encoder():
        one = bpe.encoding(pattern, shared.value)
        # Arrays of ids, never lists of Python numbers; without special tokens the two agree.
        return lambda texts: [one.encode_to_numpy(x) for x in texts]

    length, per_shard = 512, 4096
    index, shards, total = training_order.materialise_counted(
        _table(spark, folder, "documents"), encoder, key="training-order", filler=FILLER, length=length, per_shard=per_shard
    )
    read = training_order.read_shards(spark, shards, per_shard, length, FILLER, "<u2", total=total)
    found = read.select("slot", "shard", "byte_start", F.sha2("ids", 256).alias("ids_sha256"))
    return index.select("doc_id", "start", "n_tokens", "at", "slot").join(found, "slot")


def op9_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"), 4, 2)))
    found = langid.predict(docs, model)
    return found.select("doc_id", F.coalesce(langid.held_out(F.col("doc_id"), 4, 2), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op10_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    labels = _table(spark, folder, "labels").filter(~langid.held_out(F.col("doc_id"), 5, 0))
    found = line_crf.score(docs, line_crf.fit(docs, labels))
    return found.select("doc_id", F.coalesce(langid.held_out(F.col("doc_id"), 5, 0), F.lit(False)).alias("held_out"), "score", "predicted")


def op11_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = chat.with_control_texts(spark, _table(spark, folder, "conversations"))
    # Stored as a user would store it; the digests are read from the stored texts.
    return chat.digests(cut(chat.format_conversations(rows)))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations")
    conv = F.col("conv_id")
    turns = cut(prefix_trie.numbered_turns(rows))
    rebuilt = prefix_trie.spliced(turns, F.crc32(conv.cast("string")) % 9, conv - conv % 5, most=8)
    return prefix_trie.prefix_trie(rebuilt, rows.select("conv_id"))


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_shingle_join": op2_shingle_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_merkle": op4_merkle,
    "op5_url_filter": op5_url_filter,
    "op6_packing": op6_packing,
    "op7_bpe": op7_bpe,
    "op8_training_order": op8_training_order,
    "op9_langid": op9_langid,
    "op10_line_crf": op10_line_crf,
    "op11_chat": op11_chat,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_lexical_search": op13_lexical_search,
}

__all__ = ["ORACLES", "QUERIES"]
