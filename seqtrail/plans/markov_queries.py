"""Queries over transition models and position metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqtrail.operators import markov, metrics
from seqtrail.plans import inputs as I
from seqtrail.plans.registry import query
from seqtrail.plans.sql import (
    LINE_MODELS,
    SKIP_N,
    bin_sql,
    r6,
    token_markov_sql,
    tokens_sql,
)

KEYS = I.SEQUENCE_KEYS


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def train_model(spark, folder, *, fine=False):
    tokens = I.stored_token_sequences(spark, folder, fine=fine)
    return markov.fit(tokens.filter(F.col("split") == "train"), seed=I.MODEL_SEED)


@query(
    "transition_probs",
    f"with {token_markov_sql()} select prev, next, n, {r6('prob')} as prob from mk_trans",
)
def transition_probs(spark, folder):
    return rounded(train_model(spark, folder).table, "prob")


@query(
    "transition_probs_fine",
    f"with {token_markov_sql(fine=True)} select prev, next, n, {r6('prob')} as prob from mk_trans",
)
def transition_probs_fine(spark, folder):
    return rounded(train_model(spark, folder, fine=True).table, "prob")


def _predictions(spark, folder, fine):
    tokens = I.stored_token_sequences(spark, folder, fine=fine)
    model = markov.fit(tokens.filter(F.col("split") == "train"), seed=I.MODEL_SEED)
    wanted = markov.scored_positions(tokens.filter(F.col("split") == "test"), skip_n=I.SKIP_N)
    return markov.predict(model, wanted)


def _top5_sql(fine):
    return f"""with {token_markov_sql(fine=fine)} select prev, {r6('confidence')} as confidence,
      n_have as n_successors, (select string_agg(token, ' ' order by slot) from mk_top t where t.prev = i.prev) as top_tokens
    from mk_info i"""


def _top5(spark, folder, fine):
    return rounded(_predictions(spark, folder, fine), "confidence").select(
        "prev", "confidence", "n_successors", F.array_join("top_tokens", " ").alias("top_tokens")
    )


@query("markov_top5", _top5_sql(False))
def markov_top5(spark, folder):
    return _top5(spark, folder, False)


@query("markov_top5_fine", _top5_sql(True))
def markov_top5_fine(spark, folder):
    return _top5(spark, folder, True)


@query(
    "prediction_entropy",
    f"with {token_markov_sql(fine=True)} select prev, {r6('entropy')} as entropy from mk_info",
)
def prediction_entropy(spark, folder):
    return rounded(_predictions(spark, folder, True).select("prev", "entropy"), "entropy")


def _positions_sql(fine):
    return f"""with {token_markov_sql(fine=fine)}
    select idx, kind, control_idx, pos, prev, token as label, pred, correct, topk_correct, {r6('ce')} as ce,
      {r6('entropy')} as entropy, {r6('confidence')} as confidence from mk_metrics"""


def _positions(spark, folder, fine):
    _, scored = I.train_and_score(I.stored_token_sequences(spark, folder, fine=fine))
    return rounded(scored, "ce", "entropy", "confidence").select(
        *KEYS, "pos", "prev", "label", "pred", "correct", "topk_correct", "ce", "entropy", "confidence"
    )


@query("markov_positions", _positions_sql(False))
def markov_positions(spark, folder):
    return _positions(spark, folder, False)


@query("markov_positions_fine", _positions_sql(True))
def markov_positions_fine(spark, folder):
    return _positions(spark, folder, True)


@query(
    "scored_positions",
    f"""with {tokens_sql()} select split, count(*) as n_scored, count(*) filter (delta > 3600) as n_user_made,
      count(distinct token) as n_labels from tok where pos > {SKIP_N} group by split""",
)
def scored_positions(spark, folder):
    tokens = I.token_sequences(spark, folder)
    scored = markov.scored_positions(tokens, skip_n=I.SKIP_N).filter(metrics.scorable(F.col("token")))
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_scored"),
        F.sum((F.col("delta") > 3600).cast("long")).alias("n_user_made"),
        F.countDistinct("token").alias("n_labels"),
    )


@query(
    "markov_user_made",
    f"""with {token_markov_sql()} select idx, kind, control_idx, pos, correct, topk_correct
    from mk_metrics where delta > 3600""",
)
def markov_user_made(spark, folder):
    tokens = I.stored_token_sequences(spark, folder)
    model = markov.fit(tokens.filter(F.col("split") == "train"), seed=I.MODEL_SEED)
    scored = markov.score(
        model,
        tokens.filter(F.col("split") == "test"),
        skip_n=I.SKIP_N,
        delta_cutoff=3600,
    )
    return scored.select(*KEYS, "pos", "correct", "topk_correct")


@query(
    "transition_lookup",
    f"""with {token_markov_sql(fine=True)} select prev, label, {r6("prob")} as prob, {r6("0.0 - ln(prob)")} as ce
    from (select distinct prev, token as label from mk_test) t
    left join mk_trans r using (prev) where r.next = t.label
    union all select prev, label, null, null from (select distinct prev, token as label from mk_test) t
    where not exists (select 1 from mk_trans r where r.prev = t.prev and r.next = t.label)""",
)
def transition_lookup(spark, folder):
    tokens = I.stored_token_sequences(spark, folder, fine=True)
    model = markov.fit(tokens.filter(F.col("split") == "train"), seed=I.MODEL_SEED)
    test = markov.scored_positions(tokens.filter(F.col("split") == "test"), skip_n=I.SKIP_N)
    pairs = test.select("prev", F.col("token").alias("label")).distinct()
    probabilities = model.table.select("prev", F.col("next").alias("label"), "prob")
    found = pairs.join(probabilities, ["prev", "label"], "left")
    return rounded(found.withColumn("ce", 0.0 - F.log("prob")), "prob", "ce")


@query(
    "topk_hit",
    f"""with {token_markov_sql()} select token as label, count(*) as n, cast(sum(correct) as bigint) as n_top1,
      cast(sum(topk_correct) as bigint) as n_topk from mk_metrics group by token""",
)
def topk_hit(spark, folder):
    _, scored = I.train_and_score(I.stored_token_sequences(spark, folder))
    return scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("correct").alias("n_top1"),
        F.sum("topk_correct").alias("n_topk"),
    )


SUMMARY_SQL = f"""select 'markov' as model, count(*) as n_positions, count(ce) as n_ce,
  {r6('avg(correct)')} as top1, {r6('stddev_pop(correct)')} as top1_sd,
  {r6('avg(topk_correct)')} as topk, {r6('stddev_pop(topk_correct)')} as topk_sd,
  {r6('avg(ce)')} as ce, {r6('stddev_pop(ce)')} as ce_sd,
  {r6('avg(entropy)')} as entropy, {r6('stddev_pop(entropy)')} as entropy_sd,
  {r6('exp(avg(ce))')} as perplexity, count(*) - count(ce) as n_unseen,
  {r6('(count(*) - count(ce)) / count(*)')} as prop_unseen from mk_metrics"""
MEASURES = ["top1", "top1_sd", "topk", "topk_sd", "ce", "ce_sd", "entropy", "entropy_sd", "perplexity", "prop_unseen"]


def _summary(spark, folder, fine):
    _, scored = I.train_and_score(I.stored_token_sequences(spark, folder, fine=fine))
    return metrics.summarise(scored.withColumn("model", F.lit("markov")))


@query("markov_summary", f"with {token_markov_sql()} {SUMMARY_SQL}")
def markov_summary(spark, folder):
    return rounded(_summary(spark, folder, False), *MEASURES)


@query("markov_summary_fine", f"with {token_markov_sql(fine=True)} {SUMMARY_SQL}")
def markov_summary_fine(spark, folder):
    return rounded(_summary(spark, folder, True), *MEASURES)


def _cell(mean, sd):
    return f"printf('%.4f (%.4f)', {mean}, {sd})"


@query(
    "report_cells",
    f"""with {token_markov_sql()} select 'markov' as model,
      {_cell('avg(correct)', 'stddev_pop(correct)')} as top1_cell,
      {_cell('avg(topk_correct)', 'stddev_pop(topk_correct)')} as topk_cell,
      {_cell('avg(entropy)', 'stddev_pop(entropy)')} as entropy_cell,
      {_cell('avg(ce)', 'stddev_pop(ce)')} as ce_cell, {r6('exp(avg(ce))')} as perplexity from mk_metrics""",
)
def report_cells(spark, folder):
    return rounded(metrics.report_cells(_summary(spark, folder, False)), "perplexity")


ECE_SQL = f"""bins as (select model, {bin_sql('confidence')} as bin, count(*) as n, sum(confidence) as conf,
    sum(correct) as hits from both_models group by all),
  eces as (select model, sum(n) as n, sum(case when bin is null then 0 else abs(conf - hits) end) / sum(n) as ece
    from bins group by model)"""


@query(
    "calibration_error",
    f"with {LINE_MODELS}, {ECE_SQL} select model, cast(n as bigint) as n_positions, {r6('ece')} as ece from eces",
)
def calibration_error(spark, folder):
    scored = I.both_models(I.line_models(spark, folder))
    return rounded(metrics.calibration_error(scored), "ece")


@query(
    "prediction_scoring",
    f"""with {LINE_MODELS} select model, seq_id, pos, label, pred, correct, topk_correct, {r6('ce')} as ce,
      {r6('entropy')} as entropy, {r6('confidence')} as confidence from both_models""",
)
def prediction_scoring(spark, folder):
    return rounded(I.both_models(I.line_models(spark, folder)), "ce", "entropy", "confidence")


@query(
    "metric_medians",
    f"""with {LINE_MODELS} select model, {r6('median(entropy)')} as entropy, {r6('median(confidence)')} as confidence
    from both_models group by model""",
)
def metric_medians(spark, folder):
    scored = I.both_models(I.line_models(spark, folder)).select("model", "entropy", "confidence")
    medians = [
        metrics.exact_quantiles(scored, c, [0.5], ["model"]).select("model", F.col("value").alias(c))
        for c in ("entropy", "confidence")
    ]
    return rounded(medians[0].join(medians[1], "model"), "entropy", "confidence")


@query(
    "valid_vocab_renorm",
    f"""with {LINE_MODELS} select prev, next, {r6("prob / sum(prob) over (partition by prev)")} as prob
    from wb_trans where next <> '<ROW>'""",
)
def valid_vocab_renorm(spark, folder):
    model = I.line_models(spark, folder).words
    valid = model.tokens.filter(metrics.scorable(F.col("token"))).select(F.col("token").alias("next"))
    table = model.table.select("prev", "next", "prob")
    return rounded(metrics.restrict_to_valid(table, valid, ["prev"], token="next"), "prob")


def _entropy_rate_sql(steps):
    """Power iteration over the lazy chain, one table per step."""
    parts = [
        f"""moves as materialized (
          select prev, next, prob from mk_trans
          union all select token, '{markov.NOWHERE}', 1.0 from mk_tokens where token not in (select prev from mk_trans)
          union all select '{markov.NOWHERE}', token, 1.0 / cast(total as double) from mk_tokens),
        chain as materialized (
          select prev, next, 0.5 * prob as prob from moves
          union all select prev, prev, 0.5 from (select distinct prev from moves)),
        pi0 as materialized (select token, 1.0 / cast(total as double) as p from mk_tokens)"""
    ]
    for i in range(1, steps + 1):
        parts.append(
            f"pi{i} as materialized (select next as token, sum(p * prob) as p"
            f" from pi{i - 1} join chain on prev = token group by next)"
        )
    parts.append(
        f"pi as materialized (select token, p / sum(p) over () as p from pi{steps} where token <> '{markov.NOWHERE}')"
    )
    return ", ".join(parts)


#: The check SQL cannot test for convergence; by then a step changes less than 1e-12.
STEPS = 80
TOLERANCE = 1e-10


@query(
    "stationary_distribution",
    f"with {token_markov_sql()}, {_entropy_rate_sql(STEPS)} select token, {r6('p')} as p from pi",
)
def stationary_distribution(spark, folder):
    pi, _ = markov.entropy_rate(train_model(spark, folder), tolerance=TOLERANCE)
    return rounded(pi, "p")


@query(
    "entropy_rate",
    f"""with {token_markov_sql()}, {_entropy_rate_sql(STEPS)}
    select {r6('h')} as entropy_rate, {r6('exp(h)')} as perplexity, true as converged from (
      select sum(-p * prob * ln(prob + 1e-12)) as h from pi join mk_trans on prev = token)""",
)
def entropy_rate(spark, folder):
    _, rate = markov.entropy_rate(train_model(spark, folder), tolerance=TOLERANCE)
    return rounded(rate, "entropy_rate", "perplexity").select(
        "entropy_rate", "perplexity", (F.col("residual") <= TOLERANCE).alias("converged")
    )
