import pytest
from helpers import rows
from pyspark.sql import functions as F

from seqtrail.functions import arrays, text, timing
from seqtrail.operators import encode, sequences, split, vocab


def test_delta_categories_and_buckets(spark):
    df = spark.createDataFrame([(x,) for x in (None, 0.0, 2.0, 2.5, 10.0, 10.5, 60.0, 61.0)], "d double")
    got = df.select("d", timing.delta_category(F.col("d")).alias("c"), timing.delta_bucket(F.col("d")).alias("b"))
    want = {None: ("<FIRST_ROW>", None), 0.0: ("[TD_0]", 0), 2.0: ("[TD_0]", 2), 2.5: ("[TD_10]", 2),
            10.0: ("[TD_10]", 10), 10.5: ("[TD_60]", 10), 60.0: ("[TD_60]", 60), 61.0: ("[TD_>60]", 64)}
    assert {r["d"]: (r["c"], r["b"]) for r in got.collect()} == want


def test_cutoff_keeps_first_row_and_equality(spark):
    df = spark.createDataFrame([(None,), (4.9,), (5.0,), (6.0,)], "delta double")
    assert sequences.drop_automatic(df, 5.0).count() == 3
    assert sequences.drop_automatic(df, None).count() == 4


def test_first_delta_of_each_window_is_null(spark):
    data = [(1, "control", c, us, us) for c, start in ((1, 0), (2, 5)) for us in range(start, start + 3)]
    df = spark.createDataFrame(data, "idx long, kind string, control_idx long, us long, event_id long")
    got = sequences.order_windows(df)
    assert got.filter("delta is null").count() == 2
    assert rows(got.filter("pos = 0"), "control_idx", "us") == [(1, 0), (2, 5)]


def test_session_strings_in_parts(spark):
    df = spark.createDataFrame([(1, i, f"a{i}") for i in range(5)], "idx long, pos long, action string")
    whole = sequences.session_strings(df, keys=["idx"]).first()
    assert whole["sequence"] == "a0<ROW>a1<ROW>a2<ROW>a3<ROW>a4<ROW>"
    parts = sequences.session_strings(df, keys=["idx"], max_part_rows=2).orderBy("part").collect()
    assert "".join(p["sequence"] for p in parts) == whole["sequence"]


def test_vocabulary_ties_nulls_and_rare(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "action string")
    tokens = vocab.action_tokens(vocab.action_counts(df), 2)
    assert rows(tokens, "action", "token") == [("a", "[ACT_1]"), ("c", "[ACT_0]")]
    coded = vocab.tokenize_actions(df, tokens)
    assert rows(coded, "action", "token") == sorted(
        [("a", "[ACT_1]"), ("b", "[ACT_RARE]"), ("c", "[ACT_0]"), ("c", "[ACT_0]"), (None, "[ACT_RARE]")], key=repr
    )
    assert vocab.valid_actions(coded).count() == 5


def test_truncation(spark):
    data = [(n, i) for n in (1, 3, 4, 5) for i in range(n)]
    df = spark.createDataFrame(data, "s long, pos long")
    kept = encode.suffix(df, ["s"], 4)
    assert rows(kept.filter("s = 5"), "pos") == [(1,), (2,), (3,), (4,)]
    assert kept.filter("s < 5").count() == 8
    lengths = df.groupBy("s").agg(F.count("*").alias("n"))
    assert rows(encode.truncation_stats(lengths, 4), "n_sequences", "n_truncated", "pct_truncated") == [(4, 1, 25.0)]
    arr = spark.createDataFrame([([],), ([1, 2],), ([1, 2, 3],)], "a array<int>")
    assert [r[0] for r in arr.select(arrays.last_k(F.col("a"), 2)).collect()] == [[], [1, 2], [2, 3]]


def test_encoding_and_labels(spark):
    ids = spark.createDataFrame([("<PAD>", 0), ("<ROW>", 1), ("x", 5), ("y", 6)], "token string, token_id int")
    data = [("s", i, t) for i, t in enumerate(["x", "<ROW>", "y", "<ROW>"])] + [("one", 0, "y")]
    tokens = spark.createDataFrame(data, "s string, pos long, token string")
    got = {r["s"]: r for r in encode.encode(tokens, ids, ["s"], length=6).collect()}
    assert got["s"]["input_ids"] == [5, 1, 6, 1, 0, 0]
    assert got["s"]["attention_mask"] == [1, 1, 1, 1, 0, 0]
    assert got["s"]["labels"] == [-100, 6, -100, -100, -100, -100]
    assert got["one"]["labels"] == [-100] * 6
    df = spark.createDataFrame([([-100, 3],), ([4],), ([-1],)], "l array<int>")
    bad = [r[0] for r in df.select(arrays.label_out_of_range(F.col("l"), 4)).collect()]
    assert bad == [False, True, True]


def test_prefix_and_batches(spark):
    df = spark.createDataFrame([([1], [1], [2])], "i array<int>, m array<int>, l array<int>")
    got = df.select(*arrays.prepend([8, 9], F.col("i"), F.col("m"), F.col("l"))).first()
    assert [list(c) for c in got] == [[8, 9, 1], [1, 1, 1], [-100, -100, 2]]
    enc = spark.createDataFrame([(0, [1, 2, 3]), (0, [1]), (1, [4])], "batch_id long, input_ids array<int>")
    enc = enc.withColumn("labels", F.col("input_ids")).withColumn("attention_mask", F.col("input_ids"))
    padded = encode.pad_batches(enc)
    assert rows(padded, "batch_id", "input_ids", "labels", "attention_mask") == sorted(
        [(0, [1, 2, 3], [1, 2, 3], [1, 1, 1]), (0, [1, 0, 0], [1, -100, -100], [1, 0, 0]), (1, [4], [4], [1])], key=repr
    )
    batches = split.assign_batches(spark.range(10).withColumnRenamed("id", "s"), "s", batch_size=4)
    assert sorted(r["count"] for r in batches.groupBy("batch_id").count().collect()) == [2, 4, 4]


@pytest.mark.parametrize("length", [1, 2, 3, 7, 100])
def test_packing_keeps_the_stream(spark, length):
    texts = ["a b c", "", " d\te\n", "f g h i j k l m n", "   ", "o"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stream = " ".join(texts).split()
    want = [tuple(stream[i : i + length]) for i in range(0, len(stream), length)]
    want = [b for b in want if len(b) == length]
    got = encode.pack_blocks(df, "doc_id", block_length=length).orderBy("block_id").collect()
    assert [tuple(r["tokens"]) for r in got] == want
    assert [r["block_id"] for r in got] == list(range(len(want)))


def test_packing_with_separator(spark):
    df = spark.createDataFrame([(0, "a b"), (1, "c")], "doc_id long, text string")
    got = encode.pack_blocks(df, "doc_id", block_length=5, separator="<END>").first()
    assert got["tokens"] == ["a", "b", "<END>", "c", "<END>"]


def test_field_codes_round_trip(spark):
    df = spark.createDataFrame([(1, "x", "b"), (2, "y", None), (3, "x", "a")], "id long, u string, p string")
    codes = vocab.field_codes(df, ["u", "p"])
    got = vocab.encode_fields(df, codes, ["u", "p"])
    assert rows(got, "id", "u", "p") == [(1, 0, 1), (2, 1, None), (3, 0, 0)]


def test_run_sessions(spark):
    data = [(1, i, i, v) for i, v in enumerate("aabba")]
    df = spark.createDataFrame(data, "u long, us long, event_id long, v string")
    got = sequences.run_sessions(df, ["u"], "v")
    assert rows(got, "event_id", "session") == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]


def test_normalise_and_grams(spark):
    df = spark.createDataFrame([(" \tAb  C\n",), ("ab",), ("abc",), ("abcde",), ("abcdef",)], "t string")
    got = df.select(text.normalise(F.col("t")).alias("n"), F.sort_array(text.char_ngrams(F.col("t"))).alias("g")).collect()
    assert got[0]["n"] == "ab c"
    assert got[1]["g"] == [] and got[2]["g"] == ["abc"]
    assert got[3]["g"] == ["abc", "abcd", "abcde", "bcd", "bcde", "cde"]
    assert len(got[4]["g"]) == 4 + 3 + 2


def test_epoch_seconds(spark):
    df = spark.createDataFrame([("1970-01-02 00:00:01.9",)], "t string")
    assert df.select(timing.epoch_seconds(F.col("t"))).first()[0] == 86401
