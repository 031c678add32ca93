import math
from collections import Counter

import numpy as np
import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from seqtrail.functions.numbers import erfc
from seqtrail.operators import bootstrap, chunks, compare, markov, metrics, posthoc, retrieval

SCORES = "model string, seq_id long, pos long, correct int, topk_correct int, ce double, entropy double, confidence double"


def positions(spark, sequences):
    data = [(i, p, t, 100.0 * p) for i, s in enumerate(sequences) for p, t in enumerate(s)]
    tokens = spark.createDataFrame(data, "seq_id long, pos long, token string, delta double")
    return markov.with_previous(tokens, ["seq_id"])


def train_sequences():
    """a has 6 successors, b 5, c 4, d 1; z is only ever last."""
    pairs = ["a" + x for x in "bcdefg"] + ["b" + x for x in "cdefg"] + ["c" + x for x in "defg"] + ["de", "de", "ez"]
    return [list(p) for p in pairs] + [list("ab"), list("ab")]


def test_transition_table(spark):
    model = markov.fit(positions(spark, train_sequences()))
    sums = model.table.groupBy("prev").agg(F.sum("prob").alias("p")).collect()
    assert all(math.isclose(r["p"], 1.0) for r in sums)
    got = {(r["prev"], r["next"]): (r["n"], r["prob"]) for r in model.table.collect()}
    assert got[("a", "b")] == (3, 3 / 8) and got[("d", "e")] == (2, 1.0)
    assert model.size == 8


def test_predictions_of_every_branch(spark):
    model = markov.fit(positions(spark, train_sequences()), seed=4)
    asked = spark.createDataFrame([(x,) for x in "abcdz?"], "prev string")
    got = {r["prev"]: r for r in markov.predict(model, asked).collect()}
    assert all(len(set(r["top_tokens"])) == 5 for r in got.values())
    assert got["a"]["top_tokens"] == ["b", "c", "d", "e", "f"]
    assert got["b"]["top_tokens"] == ["c", "d", "e", "f", "g"]
    assert got["c"]["top_tokens"][:4] == ["d", "e", "f", "g"]
    assert got["d"]["top_tokens"][0] == "e" and got["d"]["entropy"] == pytest.approx(0.0, abs=1e-9)
    assert (got["z"]["confidence"], got["z"]["entropy"]) == (0.0, 0.0)
    assert got["?"]["confidence"] == 1 / 8 and got["?"]["entropy"] == pytest.approx(math.log(8))
    assert not got["?"]["prev_seen"] and got["z"]["prev_seen"]


def test_fewer_tokens_than_places(spark):
    model = markov.fit(positions(spark, [list("ab"), list("ba")]))
    got = markov.predict(model, spark.createDataFrame([("a",), ("?",)], "prev string")).collect()
    assert all(sorted(r["top_tokens"]) == ["a", "b"] for r in got)


def test_scoring_and_warm_up(spark):
    model = markov.fit(positions(spark, train_sequences()))
    test = positions(spark, [list("abc"), list("abcd"), list("abcda"), list("abczz?")])
    scored = markov.score(model, test, skip_n=2)
    assert rows(scored, "seq_id", "pos") == [(1, 3), (2, 3), (2, 4), (3, 3), (3, 4), (3, 5)]
    ce = {(r["seq_id"], r["pos"]): r["ce"] for r in scored.collect()}
    assert ce[(1, 3)] == pytest.approx(-math.log(0.25))
    assert ce[(2, 4)] is None and ce[(3, 4)] is None and ce[(3, 5)] is None
    slow = markov.score(model, test, skip_n=2, delta_cutoff=300.0)
    assert rows(slow, "seq_id", "pos") == [(2, 4), (3, 4), (3, 5)]
    assert "CartesianProduct" not in plan(scored)


def test_empty_test_set(spark):
    model = markov.fit(positions(spark, train_sequences()))
    assert markov.score(model, positions(spark, [list("ab")]), skip_n=10).count() == 0


def test_stationary_distribution(spark):
    # a -> b always; b -> a or b alike: two thirds of the time in b.
    model = markov.fit(positions(spark, [list("ab"), list("ba"), list("bb")]))
    pi, rate = markov.entropy_rate(model)
    assert {r["token"]: round(r["p"], 6) for r in pi.collect()} == {"a": 0.333333, "b": 0.666667}
    assert rate.first()["entropy_rate"] == pytest.approx(2 / 3 * math.log(2), abs=1e-6)


def test_stationary_distribution_with_dead_end(spark):
    model = markov.fit(positions(spark, [list("ab"), list("ac"), list("ba")]))
    p = np.array([[0, 0.5, 0.5], [1, 0, 0], [1 / 3, 1 / 3, 1 / 3]])
    pi = np.ones(3) / 3
    for _ in range(500):
        pi = 0.5 * pi + 0.5 * pi @ p
    got, _ = markov.entropy_rate(model)
    values = {r["token"]: r["p"] for r in got.collect()}
    assert [values[t] for t in "abc"] == pytest.approx(list(pi), abs=1e-6)


def test_calibration_edges(spark):
    data = [("m", 0.0, 1), ("m", 0.1, 0), ("m", 0.30000000000000004, 1), ("m", 0.3, 0), ("m", 1.0, 1)]
    df = spark.createDataFrame(data, "model string, confidence double, correct int")
    bins = [r[0] for r in df.select(metrics.calibration_bin(F.col("confidence"))).collect()]
    assert bins == [None, 1, 3, 3, 10]
    ece = metrics.calibration_error(df).first()
    assert ece["n_positions"] == 5
    assert ece["ece"] == pytest.approx((abs(0.1 - 0) + abs(0.6 - 1) + abs(1.0 - 1)) / 5)


def test_valid_vocabulary(spark):
    probs = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.2), (1, "x", 0.6)], "k long, token string, p double")
    valid = spark.createDataFrame([("a",), ("b",)], "token string")
    assert rows(metrics.restrict_to_valid(probs, valid, ["k"], prob="p"), "token", "p") == [("a", 0.5), ("b", 0.5)]


def test_chunks(spark):
    sequences = {1: ["R", "a", "b", "R", "R", "c", "R", "d"], 2: ["a", "b"], 3: ["a", "R"]}
    data = [
        (s, p, "<ROW>" if t == "R" else t, "a", int(t == "a"), 1, 0.5, 1.0, 0.25)
        for s, ts in sequences.items()
        for p, t in enumerate(ts)
    ]
    df = spark.createDataFrame(
        data, "seq_id long, pos long, label string, pred string, correct int, topk_correct int, ce double, entropy double, confidence double"
    )
    got = chunks.chunk_metrics(df, ["seq_id"])
    assert rows(got, "seq_id", "chunk_id", "label_text", "pred_text", "correct") == [
        (1, 1, "a b", "a a", 0), (1, 3, "c", "a", 0), (3, 0, "a", "a", 1)
    ]
    ids = spark.createDataFrame([(1,), (2,), (3,)], "seq_id long")
    counts = posthoc.chunk_counts(ids, chunks.number_chunks(df, ["seq_id"]))
    assert rows(counts, "seq_id", "n") == [(1, 2), (2, 0), (3, 1)]


def test_nearest_against_brute_force(spark):
    texts = ["review chart", "sign order", "sign note", "open chart", "close chart", "abc", "xy"]
    queries = ["sign ordr", "chart review", "zzz", "xy", "open", "sign order"]

    def grams(t):
        return Counter(t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1))

    df_counts = Counter(g for t in texts for g in grams(t))
    idf = {g: math.log((1 + len(texts)) / (1 + d)) + 1 for g, d in df_counts.items()}

    def vector(t):
        v = {g: c * idf[g] for g, c in grams(t).items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()} if norm else {}

    want = []
    for q in queries:
        sims = [(-round(sum(x * vector(t).get(g, 0.0) for g, x in vector(q).items()), 6), t) for t in texts]
        want += [(q, slot, t, -s) for slot, (s, t) in enumerate(sorted(sims)[:3])]
    catalogue = retrieval.fit_catalogue(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = retrieval.nearest(spark.createDataFrame([(q,) for q in queries * 2], "query string"), catalogue, k=3)
    found = rows(got, "query", "slot", "match", "similarity")
    assert [r[:3] for r in found] == [r[:3] for r in sorted(want, key=repr)]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in sorted(want, key=repr)], abs=2e-6)


def scored(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    data = []
    for i in range(n):
        for model, p in (("one", 0.6), ("two", 0.4)):
            hit = int(rng.random() < p)
            ce = None if rng.random() < 0.1 else float(rng.exponential())
            data.append((model, i // 7, i % 7, hit, 1, ce, float(rng.random()), float(rng.random())))
    return spark.createDataFrame(data, SCORES)


def test_bootstrap_spread_matches_theory(spark):
    df = scored(spark, 2000)
    report = bootstrap.bootstrap_report(df, ["seq_id", "pos"], n_replicates=400, seed=1)
    got = {(r["model"], r["metric"]): r for r in report.collect()}
    acc = got[("one", "accuracy")]
    half = 1.96 * math.sqrt(acc["raw"] * (1 - acc["raw"]) / 2000)
    assert acc["bootstrap_mean"] == pytest.approx(acc["raw"], abs=half / 4)
    assert (acc["ci_high"] - acc["ci_low"]) / (2 * half) == pytest.approx(1.0, abs=0.15)
    assert got[("one", "topk_accuracy")]["ci_low"] == 1.0
    assert got[("one", "nn_accuracy")]["raw"] is None and got[("one", "nn_accuracy")]["ci_low"] is None


def test_paired_difference_of_a_model_with_itself(spark):
    df = scored(spark, 200).filter("model = 'one'")
    both = df.unionByName(df.withColumn("model", F.lit("copy")))
    got = bootstrap.paired_difference(both, ["seq_id", "pos"], "one", "copy", n_replicates=50)
    for r in got.collect():
        assert (r["mean_diff"], r["sd_diff"]) == pytest.approx((0.0, 0.0), abs=1e-12)


def test_cluster_bootstrap(spark):
    data = [(i, i % 3, 3) for i in range(300)]
    df = spark.createDataFrame(data, "seq_id long, hits long, n long")
    got = bootstrap.cluster_bootstrap(df, "seq_id", ["hits"], "n", n_replicates=400, seed=2).first()
    spread = 1.96 * np.std([h / 3 for _, h, _ in data]) / math.sqrt(300)
    assert got["bootstrap_mean"] == pytest.approx(1 / 3, abs=spread / 4)
    assert (got["ci_high"] - got["ci_low"]) / (2 * spread) == pytest.approx(1.0, abs=0.15)
    same = bootstrap.cluster_bootstrap(
        df.repartition(9), "seq_id", ["hits"], "n", n_replicates=400, seed=2
    ).first()
    assert same["ci_low"] == pytest.approx(got["ci_low"])


def pairs(spark, one, two, value="entropy"):
    data = [(m, 0, i, int(v), int(v), 0.0, float(v), 0.5) for m, vs in (("one", one), ("two", two)) for i, v in enumerate(vs)]
    df = spark.createDataFrame(data, SCORES)
    return compare.align(df, "one", "two", ["seq_id", "pos"], ["correct", "topk_correct", "entropy"])


def test_mcnemar(spark):
    a = [1] * 30 + [1] * 12 + [0] * 5 + [0] * 20
    b = [1] * 30 + [0] * 12 + [1] * 5 + [0] * 20
    got = compare.mcnemar(pairs(spark, a, b)).first()
    assert (got["both"], got["only_1"], got["only_2"], got["neither"]) == (30, 12, 5, 20)
    chi2 = (abs(12 - 5) - 1) ** 2 / 17
    assert got["chi2"] == pytest.approx(chi2)
    assert got["p_value"] == pytest.approx(math.erfc(math.sqrt(chi2 / 2)))
    assert got["odds_ratio"] == pytest.approx(2.4)
    assert got["or_low"] == pytest.approx(math.exp(math.log(2.4) - 1.96 * math.sqrt(1 / 12 + 1 / 5)))


def test_mcnemar_without_discordant_pairs(spark):
    got = compare.mcnemar(pairs(spark, [1, 0], [1, 0])).first()
    assert got["chi2"] is None and got["odds_ratio"] is None and got["p_value"] is None


def test_wilcoxon_with_zeros_and_ties(spark):
    one, two = [5, 3, 8, 1, 4, 4, 9, 2], [3, 3, 5, 3, 4, 2, 1, 3]
    diff = np.array(one) - np.array(two)

    def ranks(x):
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    nz = diff[diff != 0]
    r = ranks(np.abs(nz))
    plus, minus = r[nz > 0].sum(), r[nz < 0].sum()
    n = len(nz)
    ties = sum(c**3 - c for c in Counter(np.abs(nz)).values())
    z = (min(plus, minus) - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    ra = ranks(np.abs(diff))
    p, m = ra[diff > 0].sum(), ra[diff < 0].sum()
    got = compare.wilcoxon(pairs(spark, one, two)).first()
    assert (got["n_pairs"], got["n_zero"]) == (6, 2)
    assert (got["w_plus"], got["w_minus"]) == (plus, minus)
    assert got["z"] == pytest.approx(z) and got["effect_size"] == pytest.approx((p - m) / (p + m))
    assert got["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_alignment_is_checked(spark):
    with pytest.raises(compare.NotAligned):
        compare.require_aligned(pairs(spark, [1, 0, 1], [1, 0]))
    assert compare.require_aligned(pairs(spark, [1, 0], [1, 0])).count() == 2


def tails(spark):
    wb = [(s, i, 1) for s, k in ((1, 2), (2, 3), (3, 4), (4, 0)) for i in range(k)]
    fb = [(s, i, int(i == f - 1)) for s, f in ((1, 3), (2, 3), (3, 2), (4, 2)) for i in range(f)]
    schema = "seq_id long, pos long, correct int"
    wb, fb = (posthoc.number_from_end(spark.createDataFrame(d, schema)) for d in (wb, fb))
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "seq_id long")
    counts = [
        ids.join(posthoc.sequence_sums(d, ["correct"]), "seq_id", "left").select("seq_id", F.coalesce("n", F.lit(0)).alias("n"))
        for d in (wb, fb)
    ]
    return wb, fb, counts


def test_common_tail(spark):
    wb, fb, (k, f) = tails(spark)
    counts = posthoc.match_counts(k, f, policy="common_tail")
    assert rows(counts, "seq_id", "keep") == [(1, 2), (2, 3), (3, 2), (4, 0)]
    matched = posthoc.matched_sums({"wb": (wb, ["correct"]), "fb": (fb, ["correct"])}, counts)
    assert rows(matched, "seq_id", "wb__correct", "fb__correct") == [(1, 2, 1), (2, 3, 1), (3, 2, 1), (4, 0, 0)]
    pooled = {r["series"]: r["accuracy"] for r in posthoc.pooled_accuracy(matched).collect()}
    assert pooled == {"wb__correct": 1.0, "fb__correct": pytest.approx(3 / 7)}
    record = posthoc.validation_record(counts).first().asDict()
    assert record == {
        "n_sequences": 4, "sum_wb": 9, "sum_fb": 10, "n_wb_above_fb": 1, "max_wb_minus_fb": 2, "n_not_in_common_tail": 2
    }


def test_strict_policy_fails_on_excess(spark):
    _, _, (k, f) = tails(spark)
    counts = posthoc.match_counts(k, f, policy="strict_wb")
    with pytest.raises(posthoc.CountMismatch):
        posthoc.require_strict(counts)
    posthoc.require_strict(counts.filter("seq_id <> 3"))


def test_action_counts_leave_out_other_tokens(spark):
    ids = spark.createDataFrame([(1,), (2,)], "seq_id long")
    labels = [(1, t) for t in ("[ACT_1]", "<ROW>", "[TD_10]", "<FIRST_ROW>", "[ACT_RARE]", "<PAD>")]
    df = spark.createDataFrame(labels, "seq_id long, label string")
    assert rows(posthoc.action_counts(ids, df), "seq_id", "n") == [(1, 2), (2, 0)]


def test_compared_models_and_lengths(spark):
    report = spark.createDataFrame([("wb__c",), ("fb__c",), ("markov__c",)], "series string")
    assert posthoc.compared_models(report, "full").count() == 3
    assert rows(posthoc.compared_models(report, "wb_markov"), "series") == [("markov__c",), ("wb__c",)]
    got = spark.createDataFrame([("p", "m")] * 3, "period string, model string")
    want = spark.createDataFrame([("p", "m", 3), ("p", "n", 1)], "period string, model string, expected long")
    assert rows(posthoc.reconcile_lengths(got, want), "model", "actual", "matches") == [("m", 3, True), ("n", 0, False)]


def test_erfc_as_plain_arithmetic(spark):
    points = [i / 16 for i in range(0, 30 * 16)]
    df = spark.createDataFrame([(x,) for x in points], "x double").select("x", erfc(F.col("x")).alias("y"))
    for r in df.collect():
        assert r["y"] == pytest.approx(math.erfc(r["x"]), rel=1e-11, abs=0)


def test_power_iteration_tells_its_residual(spark):
    model = markov.fit(positions(spark, [list("ab"), list("ba"), list("bb")]))
    _, rate = markov.entropy_rate(model, tolerance=1e-12)
    assert rate.first()["residual"] <= 1e-12
    with pytest.raises(markov.NotConverged):
        markov.entropy_rate(model, tolerance=1e-12, max_steps=2)


def test_chunks_cover_whole_sequences(spark):
    from seqtrail.plans import inputs

    models = inputs.line_models(spark, "/root/testdata/sf0.001")
    words = inputs.word_tokens(models.part("test")).filter(F.col("pos") > inputs.SKIP_N)
    assert models.wb.count() == words.count()
    closed = chunks.closed_chunks(chunks.number_chunks(models.wb, ["seq_id"]), ["seq_id"])
    # Every action but the first two, whose words are skipped.
    assert closed.count() == models.part("test").filter(F.col("pos") >= 2).count()


def test_bootstrap_copies_stay_within_their_task(spark):
    df = spark.createDataFrame([(i, i % 3, 3) for i in range(50)], "seq_id long, hits long, n long")
    drawn = bootstrap.cluster_bootstrap(df, "seq_id", ["hits"], "n", n_replicates=20)
    text = plan(drawn)
    copies = text.index("FlatMapGroupsInArrow")
    assert "partial_sum" in text[:copies].rsplit("Exchange", 1)[1]


def test_words_look_back_without_an_order_of_their_own(spark):
    from seqtrail.plans import inputs

    rows = [(1, "train", 0, "a b"), (1, "train", 1, "a b"), (1, "train", 2, "c"), (2, "train", 0, "c"), (2, "train", 1, "a b")]
    actions = spark.createDataFrame(rows, "seq_id long, split string, pos long, token string")
    words = inputs.word_tokens(actions)
    got = [(r.seq_id, r.pos, r.prev, r.token) for r in words.orderBy("seq_id", "pos").collect()]
    want = []
    for seq, texts in ((1, ["a b", "a b", "c"]), (2, ["c", "a b"])):
        stream = [w for t in texts for w in [*t.split(" "), "<ROW>"]]
        want += [(seq, i, stream[i - 1] if i else None, w) for i, w in enumerate(stream)]
    assert got == want
    pairs = {}
    for r in inputs.word_pairs(actions).collect():
        pairs[r.prev, r.token] = pairs.get((r.prev, r.token), 0) + r.n
    assert pairs == {p: sum(w[2:] == p for w in want) for p in {w[2:] for w in want}}


def test_training_words_are_counted_without_a_row_each(spark, folder):
    from seqtrail.plans import inputs

    models = inputs.line_models(spark, folder)
    text = plan(inputs.word_pairs(models.part("train")))
    assert text.index("Generate") < text.index("HashAggregate") and "Window" not in text


def test_chunks_by_kind_of_action_are_those_of_all_words(spark):
    """Also with delimiters among the words, missing and one-word actions, and any number of skipped words."""
    from seqtrail.plans import inputs

    texts = ["a b", "c", "A <ROW> b", None, "", "b  a", "a b c d e f"]
    parts = [(s, "train" if s % 3 else "test", i, texts[(s * 5 + i * i + s * i // 2) % 7]) for s in range(30) for i in range(s % 9)]
    actions = spark.createDataFrame(parts, "seq_id long, split string, pos long, token string")
    model = markov.fit(inputs.word_pairs(actions.filter("split = 'train' and token is not null")), seed=3, count="n")
    tests = actions.filter("split = 'test'")
    names = ["seq_id", "chunk_id", "n_tokens", "correct", "topk_correct", "topk_frac", "ce", "entropy", "confidence", "label_text", "pred_text"]

    def told(found):
        return rows(found.select([F.round(c, 9).alias(c) if c in names[5:9] else c for c in names]), *names)

    for skip in (0, 1, 4, 9):
        words = markov.score(model, inputs.word_tokens(tests), skip_n=skip)
        want = told(chunks.chunk_metrics(words, ["seq_id"]))
        assert want and told(inputs.action_chunks(model, inputs.closed_actions(tests, skip_n=skip))) == want


def test_chunks_of_the_given_tables_make_no_row_per_word(spark, folder):
    from seqtrail.plans import inputs

    models = inputs.line_models(spark, folder)
    text = plan(inputs.action_chunks(models.words, models.closed_actions))
    assert "Generate" not in text and "Window" not in text
    assert rows(models.chunks, "seq_id", "chunk_id", "label_text") == rows(
        chunks.chunk_metrics(models.wb, ["seq_id"]), "seq_id", "chunk_id", "label_text"
    )
