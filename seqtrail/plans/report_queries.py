"""Queries over bootstrap intervals, model comparisons and post-hoc analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqtrail.functions.numbers import erfc_sql
from seqtrail.functions.ordered import running_total
from seqtrail.functions.storage import cut
from seqtrail.operators import bootstrap, compare, posthoc
from seqtrail.plans import inputs as I
from seqtrail.plans.markov_queries import rounded
from seqtrail.plans.registry import query
from seqtrail.plans.retrieval_queries import FLAGGED, flagged_chunks
from seqtrail.plans.sql import (
    CHUNKS,
    LINE_MODELS,
    bin_sql,
    points_sql,
    poisson_sql,
    polynomial_sql,
    r6,
    replicates_sql,
)

BOOT_SEED = 3
N = I.REPLICATES
POSITION = ["seq_id", "pos"]

DRAWS = f"""{LINE_MODELS}, {replicates_sql(N, BOOT_SEED)},
units as materialized (
  select model, {bin_sql("confidence")} as bin, correct, topk_correct, ce, entropy, confidence,
    {points_sql(f"'{BOOT_SEED}|' || seq_id || '|' || pos")} from both_models),
weighted as materialized (
  select model, b, bin, sum(w) as n, sum(w * correct) as hits, sum(w * topk_correct) as topk, sum(w * ce) as ce,
    sum(w * cast(ce is not null as int)) as n_ce, sum(w * entropy) as entropy, sum(w * confidence) as conf
  from (select *, {poisson_sql("u")} as w from (
    select k.*, r.b, {polynomial_sql("p1", "p2")} as u from units k cross join reps r)) group by all),
stats as materialized (
  select model, b, sum(hits) / sum(n) as accuracy, sum(topk) / sum(n) as topk_accuracy,
    sum(entropy) / sum(n) as entropy, exp(sum(ce) / sum(n_ce)) as perplexity,
    sum(case when bin is null then 0 else abs(conf - hits) end) / sum(n) as ece
  from weighted group by model, b)"""

LONG_STATS = " union all ".join(
    f"select model, b, '{m}' as metric, {m} as value from stats"
    for m in ("accuracy", "topk_accuracy", "entropy", "perplexity", "ece")
)


@query(
    "bootstrap_ci",
    f"""with {DRAWS}, long as ({LONG_STATS}),
    raw_bins as (select model, {bin_sql("confidence")} as bin, count(*) as n, sum(confidence) as conf,
      sum(correct) as hits from both_models group by all),
    raw as (
      select model, 'accuracy' as metric, avg(correct) as raw from both_models group by model
      union all select model, 'topk_accuracy', avg(topk_correct) from both_models group by model
      union all select model, 'entropy', avg(entropy) from both_models group by model
      union all select model, 'perplexity', exp(avg(ce)) from both_models group by model
      union all select model, 'ece', sum(case when bin is null then 0 else abs(conf - hits) end) / sum(n)
        from raw_bins group by model
      union all select distinct model, m, cast(null as double) from both_models, (values ('nn_accuracy'), ('nn_topk_accuracy')) t(m))
    select model, metric, {r6("any_value(raw)")} as raw, {r6("avg(value)")} as bootstrap_mean,
      {r6("quantile_cont(value, 0.025)")} as ci_low, {r6("quantile_cont(value, 0.975)")} as ci_high
    from raw left join long using (model, metric) group by model, metric""",
)
def bootstrap_ci(spark, folder):
    scored = I.both_models(I.line_models(spark, folder))
    report = bootstrap.bootstrap_report(scored, POSITION, n_replicates=N, seed=BOOT_SEED)
    return rounded(report, "raw", "bootstrap_mean", "ci_low", "ci_high")


@query(
    "paired_bootstrap_diff",
    f"""with {DRAWS}, diffs as (
      select m.b, m.ece - f.ece as ece, m.perplexity - f.perplexity as perplexity
      from stats m join stats f on f.b = m.b and f.model = 'fb' where m.model = 'markov'),
    long as (select 'ece' as metric, ece as diff from diffs union all select 'perplexity', perplexity from diffs)
    select metric, {r6("avg(diff)")} as mean_diff, {r6("stddev_pop(diff)")} as sd_diff,
      {r6("median(diff)")} as median_diff, {r6("quantile_cont(diff, 0.025)")} as ci_low,
      {r6("quantile_cont(diff, 0.975)")} as ci_high from long group by metric""",
)
def paired_bootstrap_diff(spark, folder):
    scored = I.both_models(I.line_models(spark, folder))
    report = bootstrap.paired_difference(
        scored, POSITION, "markov", "fb", n_replicates=N, seed=BOOT_SEED
    )
    return rounded(report, "mean_diff", "sd_diff", "median_diff", "ci_low", "ci_high")


#: Levels of the resampling tree that the check SQL unrolls; enough for 4,096 sequences.
TREE_LEVELS = 13


def multinomial_sql(clusters):
    """How often each row of ``clusters(seq_id, ...)`` is drawn per replicate, as drawn(b, place, w)."""
    size, block = "(hi - lo)", bootstrap.BLOCK
    half = f"lo + case when {size} > {block} then {block} * ((({size} + {block - 1}) // {block} + 1) // 2) else ({size} + 1) // 2 end"
    levels = []
    for i in range(TREE_LEVELS):
        levels.append(f"""
split_{i} as materialized (
  select *, {polynomial_sql("p1", "p2")} as u from (
    select b, a0, a1, a2, a3, lo, hi, m, {half} as half, {points_sql(f"'{BOOT_SEED}|' || lo || '|' || hi")} from node_{i} where hi - lo > 1)),
binomial_{i} as materialized (
  select m, part, whole, k, sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * ln(part / whole)
    + (m - k) * ln(1 - part / whole))) over (partition by m, part, whole order by k) as below
  from (select m, part, whole, unnest(range(0, m + 1)) as k from (
    select distinct m, cast(half - lo as double) as part, cast(hi - lo as double) as whole from split_{i}))),
halved_{i} as materialized (
  select s.*, least(coalesce(t.k + 1, 0), s.m) as l
  from split_{i} s asof left join binomial_{i} t on t.m = s.m and t.part = s.half - s.lo and t.whole = s.hi - s.lo and s.u >= t.below),
node_{i + 1} as materialized (
  select b, a0, a1, a2, a3, lo, half as hi, l as m from halved_{i}
  union all select b, a0, a1, a2, a3, half, hi, m - l from halved_{i}
  union all select * from node_{i} where hi - lo = 1)""")
    return f"""
placed as materialized (
  select *, row_number() over (order by md5('{BOOT_SEED}|' || seq_id), cast(seq_id as varchar)) - 1 as place from {clusters}),
node_0 as materialized (select b, a0, a1, a2, a3, 0 as lo, (select count(*) from placed) as hi, (select count(*) from placed) as m from reps),
{",".join(levels)},
drawn as (select b, lo as place, m as w from node_{TREE_LEVELS})"""


def cluster_sql(clusters, sums, count):
    """Interval of each series of ``clusters(seq_id, <sums>, <count>)``, as cluster_ci."""
    means = ", ".join(f"sum(w * {s}) / sum(w * {count}) as {s}" for s in sums)
    rows = " union all ".join(f"select '{s}' as metric, {s} as value from means" for s in sums)
    return f"""
{replicates_sql(N, BOOT_SEED)},
{multinomial_sql(clusters)},
means as materialized (select b, {means} from drawn join placed using (place) group by b),
cluster_ci as materialized (
  select metric, avg(value) as bootstrap_mean, quantile_cont(value, 0.025) as ci_low,
    quantile_cont(value, 0.975) as ci_high from ({rows}) group by metric)"""


@query(
    "sequence_sums",
    f"""with {LINE_MODELS} select model, seq_id, count(*) as n, cast(sum(correct) as bigint) as correct,
      cast(sum(topk_correct) as bigint) as topk_correct from both_models group by model, seq_id""",
)
def sequence_sums(spark, folder):
    models = I.line_models(spark, folder)
    flags = ["correct", "topk_correct"]
    sums = [
        posthoc.sequence_sums(df, flags).withColumn("model", F.lit(name))
        for name, df in (("markov", models.markov), ("fb", models.fb))
    ]
    return sums[0].unionByName(sums[1])


@query(
    "cluster_bootstrap",
    f"""with {LINE_MODELS}, sums as materialized (select seq_id, count(*) as n, sum(correct) as correct,
      sum(topk_correct) as topk_correct from mk_metrics group by seq_id),
    {cluster_sql("sums", ["correct", "topk_correct"], "n")}
    select metric, {r6("bootstrap_mean")} as bootstrap_mean, {r6("ci_low")} as ci_low, {r6("ci_high")} as ci_high
    from cluster_ci""",
)
def cluster_bootstrap(spark, folder):
    sums = posthoc.sequence_sums(I.line_models(spark, folder).markov, ["correct", "topk_correct"])
    report = bootstrap.cluster_bootstrap(
        cut(sums), "seq_id", ["correct", "topk_correct"], "n", n_replicates=N, seed=BOOT_SEED
    )
    return rounded(report, "bootstrap_mean", "ci_low", "ci_high")


PAIRED = f"""{LINE_MODELS}, pairs as materialized (
  select m.seq_id, m.pos, m.correct as c1, f.correct as c2, m.topk_correct as t1, f.topk_correct as t2,
    round(m.entropy - f.entropy, 12) as d
  from mk_metrics m join fb_metrics f using (seq_id, pos))"""


def aligned_models(spark, folder):
    scored = I.both_models(I.line_models(spark, folder))
    return compare.align(scored, "markov", "fb", POSITION, ["correct", "topk_correct", "entropy"])


def mcnemar_sql(flag, one, two):
    b, c = "cast(b as double)", "cast(c as double)"
    se = f"1.96 * sqrt(1.0 / nullif({b}, 0) + 1.0 / nullif({c}, 0))"
    return f"""select '{flag}' as metric, a as both, b as only_1, c as only_2, d as neither,
      {r6(f"power(abs({b} - {c}) - 1, 2) / ({b} + {c})")} as chi2, {r6(f"{b} / nullif({c}, 0)")} as odds_ratio,
      {r6(f"exp(ln({b} / nullif({c}, 0)) - {se})")} as or_low, {r6(f"exp(ln({b} / nullif({c}, 0)) + {se})")} as or_high,
      {r6(erfc_sql("x"))} as p_value
    from (select *, sqrt(power(abs({b} - {c}) - 1, 2) / ({b} + {c}) / 2) as x from (select count(*) filter ({one} = 1 and {two} = 1) as a, count(*) filter ({one} = 1 and {two} = 0) as b,
      count(*) filter ({one} = 0 and {two} = 1) as c, count(*) filter ({one} = 0 and {two} = 0) as d from pairs))"""


@query(
    "mcnemar",
    f"with {PAIRED} {mcnemar_sql('correct', 'c1', 'c2')} union all {mcnemar_sql('topk_correct', 't1', 't2')}",
)
def mcnemar(spark, folder):
    aligned = cut(aligned_models(spark, folder))
    tests = [compare.mcnemar(aligned, flag) for flag in ("correct", "topk_correct")]
    return rounded(tests[0].unionByName(tests[1]), "chi2", "odds_ratio", "or_low", "or_high", "p_value")


@query(
    "alignment_report",
    f"""with {LINE_MODELS}, a as (select seq_id, pos from mk_metrics), b as (select seq_id, pos from fb_metrics)
    select (select count(*) from a join b using (seq_id, pos)) as n_both,
      (select count(*) from (select * from a except select * from b)) as n_only_1,
      (select count(*) from (select * from b except select * from a)) as n_only_2""",
)
def alignment_report(spark, folder):
    return compare.alignment_report(aligned_models(spark, folder))


RANKED = f"""{PAIRED}, counts as (
  select abs(d) as abs_d, count(*) filter (d > 0) as n_plus, count(*) filter (d < 0) as n_minus, count(*) as n
  from pairs group by abs(d)),
ranks as materialized (
  select *, sum(n) over (order by abs_d) - n + (n + 1) / 2.0 as rank,
    coalesce((select sum(n) from counts where abs_d = 0), 0) as n_zero
  from counts where abs_d > 0)"""


@query(
    "difference_ranks",
    f"with {RANKED} select round(abs_d, 9) as abs_d, n_plus, n_minus, n, cast(rank as double) as rank,"
    " cast(n_zero as bigint) as n_zero from ranks",
)
def difference_ranks(spark, folder):
    ranks = compare.ranked_differences(aligned_models(spark, folder), "entropy")
    return ranks.withColumn("abs_d", F.round("abs_d", 9))


WILCOXON = f"""select 'entropy' as metric, cast(n as bigint) as n_pairs, cast(nz as bigint) as n_zero, wp as w_plus,
    wm as w_minus, {r6("z")} as z, {r6("(wp + nz * np - wm - nz * nm) / (wp + nz * np + wm + nz * nm)")} as effect_size,
    {r6(erfc_sql("x"))} as p_value
  from (select *, abs(z) / sqrt(2e0) as x from (
    select *, (least(wp, wm) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - t / 48.0) as z from (
      select cast(sum(n) as double) as n, sum(n_plus) as np, sum(n_minus) as nm, max(n_zero) as nz,
        cast(sum(rank * n_plus) as double) as wp, cast(sum(rank * n_minus) as double) as wm,
        sum(cast(n as double) * n * n - n) as t from ranks)))"""


@query("wilcoxon", f"with {RANKED} {WILCOXON}")
def wilcoxon(spark, folder):
    test = compare.wilcoxon(aligned_models(spark, folder), "entropy")
    return rounded(test, "z", "effect_size", "p_value")


@query(
    "baseline_comparison",
    f"""with {RANKED}, tests as (
      select metric, odds_ratio as effect_size, p_value from ({mcnemar_sql("correct", "c1", "c2")})
      union all select metric, odds_ratio, p_value from ({mcnemar_sql("topk_correct", "t1", "t2")})
      union all select metric, effect_size, p_value from ({WILCOXON}))
    select metric, effect_size, p_value from tests""",
)
def baseline_comparison(spark, folder):
    """Effect sizes and p-values of all paired tests."""
    aligned = compare.require_aligned(cut(aligned_models(spark, folder)))
    rows = [
        compare.mcnemar(aligned, flag).select(
            "metric", F.col("odds_ratio").alias("effect_size"), "p_value"
        )
        for flag in ("correct", "topk_correct")
    ]
    paired = compare.wilcoxon(aligned, "entropy").select("metric", "effect_size", "p_value")
    return rounded(rows[0].unionByName(rows[1]).unionByName(paired), "effect_size", "p_value")


@query(
    "model_pairs",
    f"""with {LINE_MODELS}, m as (select distinct model from both_models union select 'wb')
    select a.model as model_1, b.model as model_2 from m a join m b on a.model <> b.model""",
)
def model_pairs(spark, folder):
    models = I.line_models(spark, folder)
    # The word model has positions where an action has a scored word.
    listed = I.both_models(models).select("model").unionByName(models.closed_actions.select(F.lit("wb").alias("model")))
    return compare.model_pairs(listed)


COUNTS = f"""{CHUNKS},
test_ids as materialized (select seq_id from customer_splits where split = 'test'),
k_wb as materialized (select t.seq_id, count(c.chunk_id) as n from test_ids t left join chunks c using (seq_id) group by t.seq_id),
k_fb as materialized (select t.seq_id, count(m.pos) as n from test_ids t left join mk_metrics m using (seq_id) group by t.seq_id),
matched_counts as materialized (
  select w.seq_id, w.n as k_wb, f.n as k_fb, least(w.n, f.n) as keep from k_wb w join k_fb f using (seq_id))"""


def test_sequences(models):
    return models.splits.filter(F.col("split") == "test").select("seq_id")


def chunk_counts(models):
    """H1: scored chunks of every test sequence, zeros kept."""
    counted = test_sequences(models).join(posthoc.sequence_sums(models.chunks, []), "seq_id", "left")
    return counted.select("seq_id", F.coalesce("n", F.lit(0)).alias("n"))


def sequence_counts(models):
    """H1, H2: scored chunks and scored actions of every test sequence."""
    return chunk_counts(models), posthoc.action_counts(test_sequences(models), models.markov)


@query("scored_counts", f"with {COUNTS} select seq_id, k_wb, k_fb from matched_counts")
def scored_counts(spark, folder):
    wb, fb = sequence_counts(I.line_models(spark, folder))
    return posthoc.match_counts(wb, fb, policy="common_tail").drop("keep")


@query(
    "validation_record",
    f"""with {COUNTS} select count(*) as n_sequences, cast(sum(k_wb) as bigint) as sum_wb, cast(sum(k_fb) as bigint) as sum_fb,
      count(*) filter (k_wb > k_fb) as n_wb_above_fb, max(k_wb - k_fb) as max_wb_minus_fb,
      cast(sum(greatest(k_wb - k_fb, 0)) as bigint) as n_not_in_common_tail from matched_counts""",
)
def validation_record(spark, folder):
    wb, fb = sequence_counts(I.line_models(spark, folder))
    return posthoc.validation_record(posthoc.match_counts(wb, fb, policy="common_tail"))


def tail_sql(name, source, order, flags):
    sums = ", ".join(f"sum({f}) as {name}__{f}" for f in flags)
    return f"""tail_{name} as materialized (
  select seq_id, {sums} from (
    select s.*, row_number() over (partition by seq_id order by {order} desc) - 1 as from_end from {source} s)
  join matched_counts using (seq_id) where from_end < keep group by seq_id)"""


SERIES = ["wb__correct", "wb__nn_correct", "markov__correct", "fb__correct"]
MATCHED = f"""{FLAGGED},
{COUNTS.split(CHUNKS + ",")[1]},
{tail_sql("wb", "flagged", "chunk_id", ["correct", "nn_correct"])},
{tail_sql("markov", "mk_metrics", "pos", ["correct"])},
{tail_sql("fb", "fb_metrics", "pos", ["correct"])},
matched as materialized (
  select seq_id, keep, {", ".join(f"coalesce({s}, 0) as {s}" for s in SERIES)}
  from matched_counts left join tail_wb using (seq_id) left join tail_markov using (seq_id)
  left join tail_fb using (seq_id))"""


def matched_tails(spark, folder):
    models = I.line_models(spark, folder)
    flagged = cut(flagged_chunks(spark, folder, models))
    wb, fb = sequence_counts(models)
    counts = cut(posthoc.match_counts(wb, fb, policy="common_tail"))
    scored = {
        "wb": (posthoc.number_from_end(flagged, order="chunk_id"), ["correct", "nn_correct"]),
        "markov": (posthoc.number_from_end(models.markov), ["correct"]),
        "fb": (posthoc.number_from_end(models.fb), ["correct"]),
    }
    return posthoc.matched_sums(scored, counts)


POOLED = " union all ".join(
    f"select '{s}' as series, count(*) as n_sequences, cast(sum(keep) as bigint) as n_actions,"
    f" sum({s}) / sum(keep) as accuracy from matched"
    for s in SERIES
)


@query(
    "matched_tail",
    f"with {MATCHED} select series, n_sequences, n_actions, {r6('accuracy')} as accuracy from ({POOLED})",
)
def matched_tail(spark, folder):
    return rounded(posthoc.pooled_accuracy(matched_tails(spark, folder)), "accuracy")


@query(
    "posthoc_ci",
    f"""with {MATCHED}, {cluster_sql("matched", SERIES, "keep")}
    select series, n_sequences, n_actions, {r6("accuracy")} as accuracy, {r6("bootstrap_mean")} as bootstrap_mean,
      {r6("ci_low")} as ci_low, {r6("ci_high")} as ci_high
    from ({POOLED}) join cluster_ci on metric = series where series not like 'fb%'""",
)
def posthoc_ci(spark, folder):
    matched = cut(matched_tails(spark, folder))
    report = posthoc.matched_intervals(matched, n_replicates=N, seed=BOOT_SEED)
    kept = posthoc.compared_models(report, "wb_markov")
    return rounded(kept, "accuracy", "bootstrap_mean", "ci_low", "ci_high")


def expected_lengths(models):
    """Expected rows per period and model, counted on the line items and never on scored rows.

    An action is scored word by word if its last word lies behind the skipped ones, and as
    a whole if it does itself. One total (test2, wb) is stated too high by one on purpose.
    """
    tests = models.part("test").select("seq_id", "pos", (F.size(F.split("token", " ")) + 1).alias("length"))
    ended = running_total(tests, ["seq_id"], ["pos"], F.col("length"), "ended")
    named = F.element_at(F.array(*[F.lit(n) for n in PERIODS]), (F.pmod("seq_id", F.lit(3)) + 1).cast("int"))
    counts = ended.groupBy(named.alias("period")).agg(
        F.count_if(F.col("ended") - 2 > I.SKIP_N).alias("wb"), F.count_if(F.col("pos") > I.SKIP_N).alias("markov")
    )
    long = counts.unpivot(["period"], ["wb", "markov"], "model", "n")
    off = F.when((F.col("period") == "test2") & (F.col("model") == "wb"), 1).otherwise(0)
    return long.select("period", "model", (F.col("n") + off).alias("expected"))


PERIODS = ("in_sample", "test1", "test2")
PERIOD_OF = "case when seq_id % 3 = 0 then 'in_sample' when seq_id % 3 = 1 then 'test1' else 'test2' end"


@query(
    "length_reconciliation",
    f"""with {CHUNKS}, rows as (
      select {PERIOD_OF} as period, 'wb' as model from chunks union all select {PERIOD_OF}, 'markov' from mk_metrics),
    a as (select period, model, count(*) as actual from rows group by all),
    lengths as (select seq_id, pos, sum(len(string_split(token, ' ')) + 1) over (partition by seq_id order by pos) as ended
      from act_rows where split = 'test'),
    counted as (
      select {PERIOD_OF} as period, 'wb' as model, count(*) filter (ended - 2 > {I.SKIP_N}) as n from lengths group by 1, 2
      union all select {PERIOD_OF}, 'markov', count(*) filter (pos > {I.SKIP_N}) from lengths group by 1, 2),
    e as (select period, model, n + case when period = 'test2' and model = 'wb' then 1 else 0 end as expected from counted)
    select period, model, expected, actual, expected = actual as matches from e join a using (period, model)""",
)
def length_reconciliation(spark, folder):
    models = I.line_models(spark, folder)
    rows = models.chunks.select("seq_id", "model").unionByName(
        models.markov.select("seq_id", "model")
    )
    # The periods of the three test sets stand in for folders of results.
    parts = {
        name: rows.filter(F.pmod("seq_id", F.lit(3)) == i).select("model")
        for i, name in enumerate(PERIODS)
    }
    return posthoc.reconcile_lengths(posthoc.by_period(parts), expected_lengths(models))
