"""Queries in which the filters of the reference's steps do change rows.

The tables have no blank action, no stray token and no open chunk, so these inputs are made
from them: blanked actions, streams in which time deltas, delimiters and padding stand
between the actions, and word streams with delimiters taken out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seqtrail.functions.storage import cut
from seqtrail.functions.timing import delta_category
from seqtrail.operators import chunks, cohort, markov, metrics, posthoc, sequences, vocab
from seqtrail.operators.sequences import ROW
from seqtrail.plans import inputs as I
from seqtrail.plans.markov_queries import rounded
from seqtrail.plans.registry import query
from seqtrail.plans.report_queries import COUNTS, chunk_counts, sequence_counts, tail_sql, test_sequences
from seqtrail.plans.sql import CHUNKS, WINDOWS, category_sql, markov_sql, r6, tokens_sql

#: Of the actions of a case window those with a smaller number are blanked.
LEAST_K = 80


@query(
    "nonblank_sequences",
    f"""with {WINDOWS}, made as (
      select idx, count(*) as n_actions, string_agg(case when k >= {LEAST_K} then action else ' ' end, chr(10) order by pos) || chr(10) as sequence
      from ordered where kind = 'case' group by idx)
    select * from made where regexp_matches(sequence, '[^\\s]')""",
)
def nonblank_sequences(spark, folder):
    """Case windows all of whose actions are blank are left out."""
    orders, log = I.orders_and_log(spark, folder)
    rows = cohort.case_windows(orders, log.select("event_id", "user_id", "us", "k", "action"), look_back=I.LOOK_BACK)
    blanked = rows.withColumn("action", F.when(F.col("k") >= LEAST_K, F.col("action")).otherwise(" "))
    strings = sequences.session_strings(sequences.order_windows(blanked), row_separator="\n")
    return sequences.non_blank(strings).select("idx", F.col("n_actions").cast("long").alias("n_actions"), "sequence")


#: A stream of labels with a time delta before, and a delimiter, padding and a gap after each action.
MIXED = f"""{tokens_sql()},
stream as materialized (
  select idx, kind, control_idx, pos, unnest([{category_sql("delta")}, token, '<ROW>', '<PAD>', null]) as label from tok)"""


def mixed_stream(spark, folder):
    tokens = I.token_sequences(spark, folder)
    labels = F.array(delta_category(F.col("delta")), F.col("token"), F.lit(ROW), F.lit("<PAD>"), F.lit(None).cast("string"))
    return tokens.select(*I.SEQUENCE_KEYS, "pos", F.explode(labels).alias("label"))


@query(
    "mixed_valid_actions",
    f"""with {MIXED} select idx, kind, control_idx, count(*) as n_valid, count(distinct label) as n_distinct
    from stream where label like '[ACT\\_%' escape '\\' group by idx, kind, control_idx""",
)
def mixed_valid_actions(spark, folder):
    """P10: only action tokens of a stream count."""
    valid = vocab.valid_actions(mixed_stream(spark, folder), "label")
    return valid.groupBy(*I.SEQUENCE_KEYS).agg(F.count(F.lit(1)).alias("n_valid"), F.countDistinct("label").alias("n_distinct"))


@query(
    "mixed_scorable",
    f"""with {MIXED} select label, count(*) as n from stream
    where label is not null and label not in ('<ROW>', '<PAD>') group by label""",
)
def mixed_scorable(spark, folder):
    """Padding, delimiters and missing labels are no targets."""
    stream = mixed_stream(spark, folder)
    return stream.filter(metrics.scorable(F.col("label"))).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "mixed_action_counts",
    f"""with {MIXED}, kept as (
      select idx, count(*) as n from stream where label like '[ACT%' group by idx)
    select idx, coalesce(n, 0) as n from ord left join kept using (idx)""",
)
def mixed_action_counts(spark, folder):
    """H2: delimiters, padding and time deltas are no actions; orders without any count 0."""
    orders, _ = I.orders_and_log(spark, folder)
    return posthoc.action_counts(orders, mixed_stream(spark, folder).filter(F.col("label").isNotNull()), "idx")


#: Words and delimiters left out of the word model's positions: chunks run together, some are empty, some open.
KEPT_WORDS = "not (label = '<ROW>' and pos % 7 = 0) and not (label <> '<ROW>' and pos % 11 < 5)"
RAGGED = CHUNKS.replace("from wb_metrics)", f"from wb_metrics where {KEPT_WORDS.replace('label', 'token')})")


@query(
    "ragged_chunks",
    f"""with {RAGGED} select seq_id, chunk_id, n_tokens, correct, topk_correct, {r6("topk_frac")} as topk_frac,
      {r6("ce")} as ce, {r6("confidence")} as confidence, label_text, pred_text from chunks""",
)
def ragged_chunks(spark, folder):
    """Empty and open chunks are dropped, chunk numbers go on counting them."""
    kept = I.line_models(spark, folder).wb.filter(KEPT_WORDS)
    measured = chunks.chunk_metrics(kept, ["model", "seq_id"])
    return rounded(measured.drop("model", "entropy"), "topk_frac", "ce", "confidence")


@query(
    "checked_sums",
    f"""with {COUNTS} select seq_id, k_fb as n, cast(coalesce(correct, 0) as bigint) as correct,
      cast(coalesce(topk_correct, 0) as bigint) as topk_correct
    from matched_counts left join (select seq_id, sum(correct) as correct, sum(topk_correct) as topk_correct
      from mk_metrics group by seq_id) using (seq_id)""",
)
def checked_sums(spark, folder):
    """Sums whose number of rows must equal the counted actions."""
    models = I.line_models(spark, folder)
    actions = posthoc.action_counts(test_sequences(models), models.markov)
    return posthoc.checked_sums(models.markov, actions, ["correct", "topk_correct"])


@query(
    "strict_failures",
    f"with {COUNTS} select seq_id, k_wb, k_fb, k_wb - k_fb as excess from matched_counts where k_wb > k_fb",
)
def strict_failures(spark, folder):
    """H3: the sequences for which strict matching with the warmed-up action model is impossible."""
    wb, fb = sequence_counts(I.line_models(spark, folder))
    return posthoc.strict_failures(posthoc.match_counts(wb, fb, policy="strict_wb").drop("keep"))


@query(
    "strict_tail",
    f"""with {CHUNKS},
    {markov_sql("first", "select * from act_rows where split = 'train'", "select * from act_rows where split = 'test'", skip=0)},
    early as materialized (select seq_id, pos, correct from first_metrics),
    test_ids as materialized (select seq_id from customer_splits where split = 'test'),
    matched_counts as materialized (
      select t.seq_id, coalesce(w.n, 0) as keep from test_ids t
      left join (select seq_id, count(*) as n from chunks group by seq_id) w using (seq_id)),
    {tail_sql("wb", "chunks", "chunk_id", ["correct"])},
    {tail_sql("early", "early", "pos", ["correct"])},
    matched as (
      select seq_id, keep, coalesce(wb__correct, 0) as wb, coalesce(early__correct, 0) as early
      from matched_counts left join tail_wb using (seq_id) left join tail_early using (seq_id))
    select 'wb__correct' as series, count(*) as n_sequences, cast(sum(keep) as bigint) as n_actions, {r6("sum(wb) / sum(keep)")} as accuracy from matched
    union all select 'early__correct', count(*), cast(sum(keep) as bigint), {r6("sum(early) / sum(keep)")} from matched""",
)
def strict_tail(spark, folder):
    """H3: strict matching, all word-based chunks against as many last actions of each sequence.

    The action model is scored from its first transition on, so it has at least as many rows
    of each sequence as the word model has chunks.
    """
    models = I.line_models(spark, folder)
    early = cut(markov.score(models.actions, models.part("test"), skip_n=0).select("seq_id", "pos", "label", "correct"))
    measured = models.chunks.select("seq_id", "chunk_id", "correct")
    tests = test_sequences(models)
    per_wb = chunk_counts(models)
    counts = cut(posthoc.match_counts(per_wb, posthoc.action_counts(tests, early), policy="strict_wb"))
    posthoc.require_strict(counts)
    scored = {
        "wb": (posthoc.number_from_end(measured, order="chunk_id"), ["correct"]),
        "early": (posthoc.number_from_end(early), ["correct"]),
    }
    return rounded(posthoc.pooled_accuracy(posthoc.matched_sums(scored, counts)), "accuracy")
