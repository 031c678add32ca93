"""Queries over action sequences, vocabularies, encoding and corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqtrail.functions import arrays
from seqtrail.functions.ordered import order_rows
from seqtrail.functions.timing import delta_bucket, delta_category, epoch_seconds
from seqtrail.operators import cohort, encode, sequences, split, vocab
from seqtrail.operators.metrics import exact_quantiles
from seqtrail.plans import inputs as I
from seqtrail.plans.cohort_queries import PERIODS, PERIODS_SQL
from seqtrail.plans.registry import query
from seqtrail.plans.sql import (
    LOG,
    WINDOWS,
    category_sql,
    r6,
    token_ids_sql,
    tokens_sql,
)

LENGTH = 24  # positions of an encoded sequence: context of 32 less 8 reserved
BATCH = 16
BLOCK = 256
INSTRUCTION = [3, 5, 7]

DAYS = f"""{LOG}, daily as materialized (
  select event_id, day, user_id, action, us, row_number() over w - 1 as pos, (us - lag(us) over w) / 1e6 as delta
  from ev window w as (partition by day order by us, event_id))"""


def daily_sequences(spark, folder):
    """The whole log, one sequence per day."""
    log = I.audit_log(spark, folder)
    dated = log.withColumn("day", F.to_date(F.timestamp_micros("us")))
    return sequences.order_windows(dated.select("event_id", "day", "user_id", "action", "us"), keys=["day"])


def case_rows(spark, folder):
    orders, log = I.orders_and_log(spark, folder)
    return sequences.order_windows(cohort.case_windows(orders, log, look_back=I.LOOK_BACK))


@query(
    "case_sequences",
    f"""with {WINDOWS} select idx, pos // 100000 as part, count(*) as n_actions,
      string_agg(action, '<ROW>' order by pos) || '<ROW>' as sequence
    from ordered where kind = 'case' group by idx, pos // 100000""",
)
def case_sequences(spark, folder):
    strings = sequences.session_strings(case_rows(spark, folder), keys=["idx"])
    return strings.select("idx", "part", F.col("n_actions").cast("long").alias("n_actions"), "sequence")


@query(
    "multi_field_rows",
    f"""with {WINDOWS} select idx, kind, control_idx, pos // 10 as part, count(*) as n_actions,
      string_agg(user_id || ',' || coalesce(pat_id, 'NULL') || ',' || action || ',' || {category_sql("delta")},
        chr(10) order by pos) || chr(10) as sequence
    from ordered group by idx, kind, control_idx, pos // 10""",
)
def multi_field_rows(spark, folder):
    ordered = sequences.order_windows(I.all_windows(spark, folder))
    strings = sequences.session_strings(
        ordered,
        fields=["user_id", "pat_id", "action", "delta"],
        field_separator=",",
        row_separator="\n",
        max_part_rows=10,
    )
    return strings.withColumn("n_actions", F.col("n_actions").cast("long"))


@query(
    "time_deltas",
    f"""with {DAYS} select event_id, {r6("delta")} as delta, {category_sql("delta")} as category,
      case when delta <= 60 then cast(trunc(delta) as int) else cast(trunc(ln(1 + delta)) as int) + 60 end as bucket
    from daily""",
)
def time_deltas(spark, folder):
    delta = F.col("delta")
    return daily_sequences(spark, folder).select(
        "event_id",
        F.round(delta, 6).alias("delta"),
        delta_category(delta).alias("category"),
        delta_bucket(delta).alias("bucket"),
    )


@query("auto_action_filter", f"with {DAYS} select event_id, pos from daily where delta is null or delta >= 60")
def auto_action_filter(spark, folder):
    return sequences.drop_automatic(daily_sequences(spark, folder), 60).select("event_id", "pos")


@query(
    "next_prev_action",
    f"""with {LOG} select event_id, lag(action) over w as prev_action, lead(action) over w as next_action
    from ev window w as (partition by user_id order by us, event_id)""",
)
def next_prev_action(spark, folder):
    log = I.audit_log(spark, folder).select("event_id", "user_id", "us", "action")
    return order_rows(
        log,
        ["user_id"],
        ["us", "event_id"],
        previous={"prev_action": "action"},
        following={"next_action": "action"},
    ).select("event_id", "prev_action", "next_action")


@query(
    "run_sessions",
    f"""with {LOG}, marked as (select event_id, user_id, us,
        case when lag(metric) over w is distinct from metric and row_number() over w > 1 then 1 else 0 end as starts
      from ev window w as (partition by user_id order by us, event_id))
    select event_id, cast(sum(starts) over (partition by user_id order by us, event_id) as bigint) as session from marked""",
)
def run_sessions(spark, folder):
    log = I.audit_log(spark, folder).select("event_id", "user_id", "us", "metric")
    return sequences.run_sessions(log, ["user_id"], "metric").select("event_id", "session")


@query(
    "epoch_seconds",
    "select event_id, cast(epoch_us(ts) // 1000000 as bigint) as seconds from events",
)
def epoch_second_values(spark, folder):
    events = I.table(spark, folder, "events").select("event_id", F.col("ts").cast("string").alias("text"))
    return events.select("event_id", epoch_seconds(F.col("text")).alias("seconds"))


@query(
    "action_projection",
    f"with {WINDOWS} select idx, event_id, action as action_name, coalesce(pat_id, 'NULL') as pat_id"
    " from cases where trim(action) <> ''",
)
def action_projection(spark, folder):
    orders, log = I.orders_and_log(spark, folder)
    rows = cohort.case_windows(orders, log, look_back=I.LOOK_BACK).filter(F.trim("action") != "")
    return rows.select(
        "idx",
        "event_id",
        F.col("action").alias("action_name"),
        F.coalesce("pat_id", F.lit("NULL")).alias("pat_id"),
    )


@query("action_vocab", f"with {tokens_sql()} select action, n, rank, '[ACT_' || rank || ']' as token from vocab")
def action_vocab(spark, folder):
    return vocab.action_tokens(vocab.action_counts(I.all_windows(spark, folder)), I.TOP_K)


@query("action_counts", f"with {WINDOWS} select action_fine as action, count(*) as n from windows group by 1")
def action_counts(spark, folder):
    return vocab.action_counts(I.all_windows(spark, folder), "action_fine")


TOKEN_KEYS = ["idx", "kind", "control_idx"]


@query(
    "tokenized_actions",
    f"with {tokens_sql()} select idx, kind, control_idx, pos, event_id, token, prev, split from tok",
)
def tokenized_actions(spark, folder):
    tokens = I.token_sequences(spark, folder)
    return tokens.select(*TOKEN_KEYS, "pos", "event_id", "token", "prev", "split")


@query(
    "valid_token_sequences",
    f"""with {tokens_sql()} select idx, kind, control_idx, count(*) as n_valid,
      count(*) filter (token <> '[ACT_RARE]') as n_known from tok group by idx, kind, control_idx""",
)
def valid_token_sequences(spark, folder):
    tokens = vocab.valid_actions(I.token_sequences(spark, folder))
    return tokens.groupBy(*TOKEN_KEYS).agg(
        F.count(F.lit(1)).alias("n_valid"),
        F.sum((F.col("token") != vocab.RARE).cast("long")).alias("n_known"),
    )


@query(
    "field_codes",
    f"""with {LOG}, u as (select distinct cast(user_id as varchar) as v from ev),
      a as (select distinct action as v from ev), p as (select distinct pat_id as v from ev where pat_id is not null)
    select event_id, uc.code as user_id, ac.code as action, pc.code as pat_id from ev
    join (select v, row_number() over (order by v) - 1 as code from u) uc on uc.v = cast(user_id as varchar)
    join (select v, row_number() over (order by v) - 1 as code from a) ac on ac.v = action
    left join (select v, row_number() over (order by v) - 1 as code from p) pc on pc.v = pat_id""",
)
def field_codes(spark, folder):
    rows = I.audit_log(spark, folder).select("event_id", "user_id", "action", "pat_id")
    columns = ["user_id", "action", "pat_id"]
    return vocab.encode_fields(rows, vocab.field_codes(rows, columns), columns)


@query(
    "token_index",
    f"""with {tokens_sql(fine=True)} select token, row_number() over (order by token) - 1 as token_idx
    from (select distinct token from tok where split = 'train')""",
)
def token_index(spark, folder):
    tokens = I.token_sequences(spark, folder, fine=True)
    return vocab.dense_index(tokens.filter(F.col("split") == "train"), "token")


@query(
    "token_difference",
    f"""with {tokens_sql(fine=True)} select distinct token from tok where split = 'train'
    except select distinct token from tok where split = 'val'""",
)
def token_difference(spark, folder):
    tokens = I.token_sequences(spark, folder, fine=True).select("split", "token").distinct()
    train = tokens.filter(F.col("split") == "train").select("token")
    val = tokens.filter(F.col("split") == "val").select("token")
    return train.join(val, "token", "left_anti")


@query(
    "seq_len_quartiles",
    f"""with {tokens_sql()}, lens as (select split, idx, kind, control_idx,
        len(regexp_extract_all(string_agg(token, '<ROW>'), '\\[ACT_\\d+\\]')) as n
      from tok group by split, idx, kind, control_idx)
    select split, p as probability, {r6("v")} as value from (
      select split, unnest([0.25, 0.5, 0.75]) as p, unnest(quantile_cont(n, [0.25, 0.5, 0.75])) as v
      from lens group by split)""",
)
def seq_len_quartiles(spark, folder):
    # F6 over rows: a token is one action, so the matches are summed, not searched in one long text.
    matches = F.regexp_count("token", F.lit(r"\[ACT_\d+\]"))
    lengths = I.token_sequences(spark, folder).groupBy("split", *TOKEN_KEYS).agg(F.sum(matches).alias("n"))
    return exact_quantiles(lengths, "n", [0.25, 0.5, 0.75], ["split"]).withColumn(
        "value", F.round("value", 6)
    )


DELIMITED = f"""{tokens_sql()}, delimited as materialized (
  select idx, kind, control_idx, split, pos * 2 as pos, token from tok
  union all select idx, kind, control_idx, split, pos * 2 + 1, '<ROW>' from tok)"""

TRUNCATED = f"""{DELIMITED}, kept as materialized (
  select * from delimited
  qualify row_number() over (partition by idx, kind, control_idx order by pos desc) <= {LENGTH})"""


@query(
    "truncate_last_k",
    f"""with {TRUNCATED} select idx, kind, control_idx, count(*) as n_tokens,
      string_agg(token, ' ' order by pos) as tokens from kept group by idx, kind, control_idx""",
)
def truncate_last_k(spark, folder):
    tokens = encode.with_delimiters(I.token_sequences(spark, folder), TOKEN_KEYS)
    kept = encode.suffix(tokens, TOKEN_KEYS, LENGTH)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "token")))
    return kept.groupBy(*TOKEN_KEYS).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.array_join(ordered["token"], " ").alias("tokens")
    )


@query(
    "truncation_stats",
    f"""with {DELIMITED}, lens as (select split, count(*) as n from delimited group by split, idx, kind, control_idx)
    select split, count(*) as n_sequences, count(*) filter (n > {LENGTH}) as n_truncated,
      {r6(f"count(*) filter (n > {LENGTH}) * 100.0 / count(*)")} as pct_truncated from lens group by split""",
)
def truncation_stats(spark, folder):
    lengths = I.token_sequences(spark, folder).groupBy("split", *TOKEN_KEYS).agg(
        (F.count(F.lit(1)) * 2).alias("n")
    )
    return encode.truncation_stats(lengths, LENGTH, by=["split"]).withColumn(
        "pct_truncated", F.round("pct_truncated", 6)
    )


ENCODED = f"""{TRUNCATED}, {token_ids_sql()}, id_lists as materialized (
  select idx, kind, control_idx, list(token_id order by pos) as l, count(*) as n
  from kept join ids using (token) group by idx, kind, control_idx),
encoded as materialized (
  select idx, kind, control_idx, n,
    list_concat(l, [0 for x in range(n, {LENGTH})]) as input_ids,
    [case when x < n then 1 else 0 end for x in range(0, {LENGTH})] as mask,
    [case when x >= n or l[x + 1] = 1 then -100 else l[x + 1] end for x in range(1, {LENGTH} + 1)] as labels
  from id_lists)"""


def as_text(column: str) -> str:
    return f"array_to_string({column}, ',')"


def encoded_sequences(spark, folder):
    rows, tokens = I.token_sequences_and_vocabulary(spark, folder)
    return encode.encode(
        encode.with_delimiters(rows, TOKEN_KEYS),
        encode.token_ids(spark, tokens),
        TOKEN_KEYS,
        length=LENGTH,
    )


@query(
    "encode_pad_labels",
    f"""with {ENCODED} select idx, kind, control_idx, {as_text("input_ids")} as input_ids,
      {as_text("mask")} as attention_mask, {as_text("labels")} as labels from encoded""",
)
def encode_pad_labels(spark, folder):
    return encoded_sequences(spark, folder).select(
        *TOKEN_KEYS, *[arrays.text(F.col(c)).alias(c) for c in ("input_ids", "attention_mask", "labels")]
    )


@query(
    "label_range_check",
    f"""with {ENCODED} select count(*) as n_sequences, count(*) filter (
        len([x for x in labels if x <> -100 and (x < 0 or x >= n_ids)]) > 0) as n_bad,
      count(*) filter (len([x for x in labels if x <> -100 and (x < 0 or x >= 20)]) > 0) as n_beyond_20
    from encoded, (select count(*) as n_ids from ids)""",
)
def label_range_check(spark, folder):
    size = I.TOP_K + len(encode.SPECIAL_TOKENS)
    return encoded_sequences(spark, folder).agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.sum(arrays.label_out_of_range(F.col("labels"), size).cast("long")).alias("n_bad"),
        F.sum(arrays.label_out_of_range(F.col("labels"), 20).cast("long")).alias("n_beyond_20"),
    )


@query(
    "instruction_prefix",
    f"""with {ENCODED} select idx, kind, control_idx, '3,5,7,' || {as_text("input_ids")} as input_ids,
      '1,1,1,' || {as_text("mask")} as attention_mask, '-100,-100,-100,' || {as_text("labels")} as labels from encoded""",
)
def instruction_prefix(spark, folder):
    columns = ["input_ids", "attention_mask", "labels"]
    prefixed = arrays.prepend(INSTRUCTION, *[F.col(c) for c in columns])
    return encoded_sequences(spark, folder).select(
        *TOKEN_KEYS, *[arrays.text(c).alias(name) for name, c in zip(columns, prefixed)]
    )


@query(
    "batch_pad",
    f"""with {ENCODED}, ranked as (
      select *, idx || ':' || kind || ':' || control_idx as seq_id from encoded),
    numbered as (select *, row_number() over (order by md5('7|' || seq_id), seq_id) - 1 as rnk from ranked),
    batched as (select *, rnk // {BATCH} as batch_id, max(n) over (partition by rnk // {BATCH}) as batch_len from numbered)
    select seq_id, batch_id, batch_len, {as_text("input_ids[1:batch_len]")} as input_ids,
      {as_text("mask[1:batch_len]")} as attention_mask, {as_text("labels[1:batch_len]")} as labels from batched""",
)
def batch_pad(spark, folder):
    encoded = encoded_sequences(spark, folder)
    unpadded = encoded.select(
        sequences.sequence_id().alias("seq_id"),
        *[F.slice(c, F.lit(1), F.col("n_tokens")).alias(c) for c in ("input_ids", "attention_mask", "labels")],
    )
    batched = split.assign_batches(unpadded, "seq_id", batch_size=BATCH, seed=I.SEED)
    return encode.pad_batches(batched).select(
        "seq_id",
        "batch_id",
        F.col("batch_len").cast("long").alias("batch_len"),
        *[arrays.text(F.col(c)).alias(c) for c in ("input_ids", "attention_mask", "labels")],
    )


WORDS = """words as materialized (
  select doc_id, [x for x in regexp_split_to_array(text, '\\s+') if x <> ''] as ws from documents)"""


@query("corpus_text", "select doc_id, text from documents")
def corpus_text(spark, folder):
    return I.table(spark, folder, "documents").select("doc_id", "text")


@query(
    "corpus_tokens",
    f"with {WORDS} select doc_id, unnest(range(0, len(ws))) as pos, unnest(ws) as token from words",
)
def corpus_tokens(spark, folder):
    tokens = encode.corpus_tokens(I.table(spark, folder, "documents"), "doc_id")
    return tokens.withColumn("pos", F.col("pos").cast("long"))


@query(
    "pack_blocks",
    f"""with {WORDS}, flat as materialized (
      select row_number() over (order by doc_id, i) - 1 as off, token from (
        select doc_id, unnest(range(0, len(ws))) as i, unnest(ws) as token from words))
    select off // {BLOCK} as block_id, string_agg(token, ' ' order by off) as tokens
    from flat group by off // {BLOCK} having count(*) = {BLOCK}""",
)
def pack_blocks(spark, folder):
    blocks = encode.pack_blocks(I.table(spark, folder, "documents"), "doc_id", block_length=BLOCK)
    return blocks.select("block_id", F.array_join("tokens", " ").alias("tokens"))


@query(
    "oos_sequences",
    f"""with {tokens_sql()}, per as (select idx, case {PERIODS_SQL.format(c="order_us")} end as period from ord),
    cut_off as (select o.idx, o.kind, o.control_idx, o.pos, coalesce('[ACT_' || v.rank || ']', '[ACT_RARE]') as token
      from ordered o join paired using (idx) left join vocab v on v.action = o.action
      qualify row_number() over (partition by o.idx, o.kind, o.control_idx order by o.pos desc) <= {LENGTH})
    select period, idx, kind, control_idx, count(*) as n_tokens, string_agg(token, ' ' order by pos) as tokens
    from cut_off join per using (idx) where period in ('test1', 'test2')
    group by period, idx, kind, control_idx""",
)
def oos_sequences(spark, folder):
    orders, _ = I.orders_and_log(spark, folder)
    later = {name: span for name, span in PERIODS.items() if name != "in_sample"}
    periods = split.period_orders(orders, later).select("idx", "period")
    coded = I.token_sequences(spark, folder, routes=periods.withColumnRenamed("period", "split"))
    kept = encode.suffix(coded.withColumnRenamed("split", "period"), TOKEN_KEYS, LENGTH)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "token")))
    return kept.groupBy("period", *TOKEN_KEYS).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.array_join(ordered["token"], " ").alias("tokens")
    )
