"""Queries over catalogues of known texts, nearest matches and chunk metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtrail.functions.storage import cut
from seqtrail.functions.text import normalise
from seqtrail.operators import chunks, posthoc, retrieval
from seqtrail.plans import inputs as I
from seqtrail.plans.markov_queries import rounded
from seqtrail.plans.registry import query
from seqtrail.plans.sql import CHUNKS, bin_sql, catalogue_sql, nearest_sql, normal_sql, r6

MIXED = f"""mixed as materialized (
  select '  ' || upper(p_name) || chr(9) || p_type || '  ' as name from part
  union all select p_name from part union all select ' ' || chr(10) || ' ' from part)"""


def mixed_names(spark, folder):
    part = I.table(spark, folder, "part")
    shouted = F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t"), F.col("p_type"), F.lit("  "))
    columns = [shouted, F.col("p_name"), F.lit(" \n ")]
    return reduce(DataFrame.unionByName, [part.select(c.alias("name")) for c in columns])


@query(
    "valid_texts",
    f"with {MIXED} select distinct {normal_sql('name')} as text from mixed where {normal_sql('name')} <> ''",
)
def valid_texts(spark, folder):
    return retrieval.valid_texts(mixed_names(spark, folder), "name")


MIXED_TEXTS = f"select {normal_sql('name')} as text from mixed where {normal_sql('name')} <> ''"


@query(
    "char_ngram_idf",
    f"with {MIXED}, {catalogue_sql(MIXED_TEXTS)} select gram, df, {r6('idf')} as idf from idf",
)
def char_ngram_idf(spark, folder):
    texts = retrieval.valid_texts(mixed_names(spark, folder), "name")
    return rounded(retrieval.inverse_frequencies(retrieval.gram_counts(texts), texts), "idf")


@query(
    "catalogue_vectors",
    f"with {MIXED}, {catalogue_sql(MIXED_TEXTS)} select text, gram, {r6('w')} as w from cat_vec",
)
def catalogue_vectors(spark, folder):
    texts = retrieval.valid_texts(mixed_names(spark, folder), "name")
    catalogue = retrieval.fit_catalogue(texts)
    named = catalogue.vectors.join(catalogue.texts.select("id", "text"), "id")
    return rounded(named.select("text", "gram", "w"), "w")


PART_NAMES = f"select {normal_sql('p_name')} as text from part"
DAMAGED = f"""damaged as materialized (
  select {normal_sql("d")} as text from (
    select substr(p_name, 1, length(p_name) - 1) as d from part
    union all select split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) from part
    union all select '  ' || replace(upper(p_name), ' ', '  ') from part
    union all select lower(p_type) from part union all select 'qz' from part))"""


def damaged_names(spark, folder):
    part = I.table(spark, folder, "part")
    name, words = F.col("p_name"), F.split("p_name", " ")
    columns = [
        F.substring(name, F.lit(1), F.length(name) - 1),
        F.concat_ws(" ", F.get(words, F.lit(1)), F.get(words, F.lit(0))),
        F.concat(F.lit("  "), F.regexp_replace(F.upper(name), " ", "  ")),
        F.lower("p_type"),
        F.lit("qz"),
    ]
    texts = reduce(DataFrame.unionByName, [part.select(c.alias("d")) for c in columns])
    return texts.select(normalise(F.col("d")).alias("query"))


@query(
    "nearest_action",
    f"""with {catalogue_sql(PART_NAMES)}, {DAMAGED}, {nearest_sql("select text from damaged", 5)}
    select query, slot, match, {r6("similarity")} as similarity from near""",
)
def nearest_action(spark, folder):
    catalogue = retrieval.fit_catalogue(
        retrieval.valid_texts(I.table(spark, folder, "part"), "p_name")
    )
    return retrieval.nearest(damaged_names(spark, folder), catalogue, k=5)


@query(
    "nearest_passage",
    f"""with {catalogue_sql(f"select {normal_sql('text')} as text from benchmark")},
    asked as materialized (select {normal_sql('text')} as text from conversations),
    {nearest_sql("select text from asked", 1)}
    select query, slot, match, {r6("similarity")} as similarity from near""",
)
def nearest_passage(spark, folder):
    catalogue = retrieval.fit_catalogue(
        retrieval.valid_texts(I.table(spark, folder, "benchmark"), "text")
    )
    asked = I.table(spark, folder, "conversations").select(normalise(F.col("text")).alias("query"))
    return retrieval.nearest(asked, catalogue, k=1)


FLAGGED = f"""{CHUNKS}, {catalogue_sql(PART_NAMES)}, {nearest_sql("select pred_text as text from chunks", 5)},
flagged as materialized (
  select c.*, coalesce(cast(n0.match = c.label_text as int), 0) as nn_correct,
    case when nk.match is null then 0 else 1 end as nn_topk_correct
  from chunks c left join near n0 on n0.query = c.pred_text and n0.slot = 0
  left join near nk on nk.query = c.pred_text and nk.match = c.label_text)"""


def flagged_chunks(spark, folder, models=None):
    """Chunks of the word-based model with nearest-neighbour flags."""
    models = models or I.line_models(spark, folder)
    catalogue = retrieval.fit_catalogue(
        retrieval.valid_texts(I.table(spark, folder, "part"), "p_name")
    )
    return retrieval.nearest_flags(models.chunks, catalogue)


@query(
    "chunk_metrics",
    f"""with {CHUNKS} select seq_id, chunk_id, n_tokens, correct, topk_correct, {r6("topk_frac")} as topk_frac,
      {r6("ce")} as ce, {r6("entropy")} as entropy, {r6("confidence")} as confidence, label_text, pred_text from chunks""",
)
def chunk_metrics(spark, folder):
    measured = I.line_models(spark, folder).chunks
    return rounded(measured.drop("model"), "topk_frac", "ce", "entropy", "confidence")


@query(
    "chunk_summary",
    f"""with {FLAGGED}, cbins as (select {bin_sql("confidence")} as bin, count(*) as n, sum(confidence) as conf,
        sum(correct) as hits from flagged group by all)
    select 'wb' as model, count(*) as n_chunks, {r6("avg(correct)")} as chunk_accuracy,
      {r6("avg(topk_frac)")} as topk_frac, {r6("avg(topk_correct)")} as topk_all, {r6("avg(ce)")} as ce,
      {r6("exp(avg(ce))")} as perplexity, {r6("avg(entropy)")} as entropy,
      {r6("avg(nn_correct)")} as nn_correct, {r6("avg(nn_topk_correct)")} as nn_topk_correct,
      (select {r6("sum(case when bin is null then 0 else abs(conf - hits) end) / sum(n)")} from cbins) as ece
    from flagged""",
)
def chunk_summary(spark, folder):
    summary = chunks.chunk_summary(cut(flagged_chunks(spark, folder)))
    return rounded(summary, *[c for c in summary.columns if c not in ("model", "n_chunks")])


@query(
    "mapping_rescue",
    f"""with {FLAGGED}, w as (select count(*) as n, avg(correct) as a, avg(nn_correct) as b,
        avg(case when correct = 0 and nn_correct = 1 then 1 else 0 end) as c from flagged)
    select 'wb' as model, n as n_actions, 'exact_match_accuracy_pre_mapping' as metric, {r6("a")} as value from w
    union all select 'wb', n, 'semantic_nn_mapped_accuracy', {r6("b")} from w
    union all select 'wb', n, 'nn_mapping_rescued_accuracy', {r6("c")} from w""",
)
def mapping_rescue(spark, folder):
    return rounded(posthoc.mapping_rescue(flagged_chunks(spark, folder)), "value")
