"""Building blocks of the check SQL (DuckDB), over the whole test tables."""

from __future__ import annotations

from seqtrail.functions.draws import PRIME, poisson_cdf
from seqtrail.operators.encode import SPECIAL_TOKENS
from seqtrail.operators.metrics import CALIBRATION_EDGES
from seqtrail.plans.inputs import (
    ANCHOR_METRIC,
    BUFFER,
    FINE_TOP_K,
    LOOK_BACK,
    MODEL_SEED,
    SEED,
    SKIP_N,
    TOLERANCE,
    TOP_K,
)


def h32(text: str) -> str:
    return f"cast('0x' || substr(md5({text}), 1, 8) as bigint)"


def r6(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


def f64(value: float) -> str:
    return f"cast('{value!r}' as double)"


def poisson_sql(u: str) -> str:
    steps = " ".join(f"when {u} < {f64(edge)} then {k}" for k, edge in enumerate(poisson_cdf()))
    return f"(case {steps} else {len(poisson_cdf())} end)"


def points_sql(text: str) -> str:
    """The two points of a key's text."""
    low = f"cast('0x' || substr(md5({text}), 9, 8) as bigint)"
    return f"{h32(text)} % {PRIME} as p1, {low} % {PRIME} as p2"


def polynomial_sql(point: str, second: str) -> str:
    """Uniform value of a replicate row with coefficients a0..a3 at a pair of points."""
    p = PRIME
    value = f"((((a3 * {point} + a2) % {p}) * {point} + a1) % {p} * {point} + a0) % {p}"
    return f"(cast(({value} + a2 * {second} % {p}) % {p} as double) / {float(p)})"


def replicates_sql(n: int, seed: int) -> str:
    terms = ", ".join(
        f"{h32(f"'{seed}|' || cast(b as varchar) || '|{j}'")} % {PRIME} as a{j}" for j in range(4)
    )
    return f"reps as materialized (select b, {terms} from (select unnest(range(0, {n})) as b))"


def bin_sql(confidence: str) -> str:
    steps = " ".join(
        f"when {confidence} <= {f64(CALIBRATION_EDGES[i])} then {i}" for i in range(1, 11)
    )
    return f"(case when {confidence} > 0 then case {steps} end end)"


def category_sql(delta: str) -> str:
    return (
        f"(case when {delta} is null then '<FIRST_ROW>' when {delta} <= 2 then '[TD_0]'"
        f" when {delta} <= 10 then '[TD_10]' when {delta} <= 60 then '[TD_60]' else '[TD_>60]' end)"
    )


LOG = f"""
ev as materialized (
  select event_id, user_id, epoch_us(ts) as us, event_type as metric, k, value,
    event_type || '_' || cast(k // 10 as varchar) as action,
    event_type || '_' || cast(k as varchar) as action_fine,
    case when k >= 10 then 'P' || cast(k as varchar) end as pat_id, cast(ts as date) as day
  from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)),
ord as materialized (
  select event_id as idx, user_id, us as order_us,
    case when user_id % 2 = 0 then 'Attending' else 'APP' end as prov_type
  from ev where metric = '{ANCHOR_METRIC}' and k >= 90)"""

WINDOWS = f"""{LOG},
cases as materialized (
  select o.idx, 'case' as kind, 0 as control_idx, e.*
  from ord o join ev e on e.user_id = o.user_id
    and e.us >= o.order_us - {LOOK_BACK} and e.us < o.order_us),
anchors as materialized (
  select o.idx, o.user_id, e.event_id as anchor_id, e.us as anchor_us
  from ord o join ev e on e.user_id = o.user_id and e.metric = '{ANCHOR_METRIC}'
    and e.us < o.order_us - {BUFFER}
  where not exists (select 1 from ord x where x.user_id = o.user_id and x.idx <> o.idx
    and abs(e.us - x.order_us) <= {TOLERANCE})),
filled as materialized (
  select a.* from anchors a where exists (select 1 from ev e where e.user_id = a.user_id
    and e.us >= a.anchor_us - {LOOK_BACK} and e.us < a.anchor_us)),
controls as materialized (
  select *, row_number() over (partition by idx order by anchor_us, anchor_id) as control_idx
  from filled),
control_rows as materialized (
  select c.idx, 'control' as kind, c.control_idx, e.*
  from controls c join ev e on e.user_id = c.user_id
    and e.us >= c.anchor_us - {LOOK_BACK} and e.us < c.anchor_us),
windows as materialized (select * from cases union all select * from control_rows),
ordered as materialized (
  select *, row_number() over w - 1 as pos, (us - lag(us) over w) / 1e6 as delta
  from windows window w as (partition by idx, kind, control_idx order by us, event_id))"""

SPLITS = f"""
ranked_orders as materialized (
  select idx, row_number() over (order by md5('{SEED}|' || idx), cast(idx as varchar)) - 1 as rnk,
    count(*) over () as total from (select distinct idx from ord)),
splits as materialized (
  select idx, case when rnk < floor(total * cast(0.7 as double)) then 'train'
    when rnk < floor(total * cast(0.7 as double)) + floor(total * cast(0.1 as double)) then 'val'
    else 'test' end as split from ranked_orders)"""


def tokens_sql(*, fine: bool = False) -> str:
    column, top_k = ("action_fine", FINE_TOP_K) if fine else ("action", TOP_K)
    return f"""{WINDOWS},{SPLITS},
vocab as materialized (
  select action, n, row_number() over (order by n desc, action) - 1 as rank from (
    select {column} as action, count(*) as n from windows where {column} is not null group by 1)
  qualify rank < {top_k}),
paired as materialized (select idx from cases intersect select idx from control_rows),
tok as materialized (
  select o.idx, o.kind, o.control_idx, o.pos, o.delta, o.event_id, s.split,
    coalesce('[ACT_' || v.rank || ']', '[ACT_RARE]') as token,
    lag(coalesce('[ACT_' || v.rank || ']', '[ACT_RARE]')) over (
      partition by o.idx, o.kind, o.control_idx order by o.pos) as prev
  from ordered o join paired p using (idx) join splits s using (idx)
  left join vocab v on v.action = o.{column})"""


def token_ids_sql() -> str:
    special = ", ".join(f"({i}, '{t}')" for i, t in enumerate(SPECIAL_TOKENS))
    return f"""
ids as materialized (
  select token_id, token from (values {special}) t(token_id, token)
  union all select rank + {len(SPECIAL_TOKENS)}, '[ACT_' || rank || ']' from vocab)"""


def markov_sql(prefix: str, train: str, test: str, *, k: int = 5, skip: int = SKIP_N) -> str:
    """Fit on ``train(prev, token)`` and score ``test(..., pos, prev, token)``.

    Defines <prefix>_trans, _tokens, _top and _metrics.
    """
    x, reach = prefix, 2 * k - 1
    return f"""
{x}_trans as materialized (
  select prev, token as next, count(*) as n,
    count(*) / sum(count(*)) over (partition by prev) as prob
  from ({train}) where prev is not null group by prev, token),
{x}_tokens as materialized (
  select token, n, row_number() over (order by md5('{MODEL_SEED}|' || token), token) - 1 as rank,
    count(*) over () as total
  from (select token, count(*) as n from ({train}) group by token)),
{x}_test as materialized (select * from ({test}) where pos > {skip}),
{x}_prevs as materialized (select distinct prev from {x}_test),
{x}_desc as materialized (
  select prev, sum(-prob * ln(prob + 1e-12)) as entropy, max(prob) as confidence, count(*) as n_succ
  from {x}_trans group by prev),
{x}_n as materialized (select count(*) as n from {x}_tokens),
{x}_info as materialized (
  select p.prev, coalesce(d.n_succ, 0) as n_have,
    case when t.token is null then 1.0 / cast(m.n as double) else coalesce(d.confidence, 0) end as confidence,
    case when t.token is null then -ln(1.0 / cast(m.n as double) + 1e-12) else coalesce(d.entropy, 0) end as entropy
  from {x}_prevs p left join {x}_tokens t on t.token = p.prev
  left join {x}_desc d on d.prev = p.prev cross join {x}_n m),
{x}_best as materialized (
  select prev, next as token, row_number() over (partition by prev order by prob desc, next) - 1 as slot
  from {x}_trans where prev in (select prev from {x}_prevs) qualify slot < {k}),
{x}_fill as materialized (
  select prev, token, n_have + row_number() over (partition by prev order by step) - 1 as slot
  from (select i.prev, i.n_have, s.step, t.token
    from {x}_info i join (select unnest(range(0, {reach})) as step) s on i.n_have < {k}
    cross join {x}_n m
    join {x}_tokens t on t.rank = ({h32(f"'{MODEL_SEED}|' || i.prev")} % m.n + s.step) % m.n
    where s.step < m.n
      and not exists (select 1 from {x}_best b where b.prev = i.prev and b.token = t.token))
  qualify slot < {k}),
{x}_top as materialized (select * from {x}_best union all select prev, token, slot from {x}_fill),
{x}_metrics as materialized (
  select t.*, i.entropy, i.confidence, t0.token as pred,
    coalesce(cast(t0.token = t.token as int), 0) as correct,
    case when h.slot is null then 0 else 1 end as topk_correct,
    0.0 - ln(r.prob) as ce
  from {x}_test t join {x}_info i using (prev)
  left join {x}_top t0 on t0.prev = t.prev and t0.slot = 0
  left join {x}_top h on h.prev = t.prev and h.token = t.token
  left join {x}_trans r on r.prev = t.prev and r.next = t.token)"""


def test_tokens(split: str) -> str:
    return f"select * from tok where split = '{split}'"


def token_markov_sql(*, fine: bool = False) -> str:
    return f"{tokens_sql(fine=fine)},{markov_sql('mk', test_tokens('train'), test_tokens('test'))}"


LINES = f"""
acts as materialized (
  select o_custkey as seq_id, p_name as token, row_number() over w - 1 as pos, lag(p_name) over w as prev
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
  window w as (partition by o_custkey order by o_orderdate, o_orderkey, l_linenumber, l_partkey, l_suppkey)),
ranked_customers as materialized (
  select seq_id, row_number() over (order by md5('{SEED}|' || seq_id), cast(seq_id as varchar)) - 1 as rnk,
    count(*) over () as total from (select distinct seq_id from acts)),
customer_splits as materialized (
  select seq_id, case when rnk < floor(total * cast(0.7 as double)) then 'train'
    when rnk < floor(total * cast(0.7 as double)) + floor(total * cast(0.1 as double)) then 'val'
    else 'test' end as split from ranked_customers),
act_rows as materialized (select a.*, s.split from acts a join customer_splits s using (seq_id)),
word_rows as materialized (
  select seq_id, split, row_number() over (partition by seq_id order by pos, i) - 1 as pos, token
  from (select seq_id, split, pos, unnest(range(0, len(words))) as i, unnest(words) as token
    from (select *, list_append(string_split(token, ' '), '<ROW>') as words from act_rows))),
word_test as materialized (
  select *, lag(token) over (partition by seq_id order by pos) as prev from word_rows where split = 'test'),
word_train as materialized (
  select *, lag(token) over (partition by seq_id order by pos) as prev from word_rows where split = 'train')"""

LINE_MODELS = f"""{LINES},
{markov_sql("mk", "select * from act_rows where split = 'train'", "select * from act_rows where split = 'test'")},
{markov_sql("wb", "select * from word_train", "select * from word_test")},
fq as materialized (
  select token, n / sum(n) over () as prob,
    row_number() over (order by n desc, token) - 1 as slot from mk_tokens),
fb_metrics as materialized (
  select t.seq_id, t.pos, t.token, f0.token as pred, f0.prob as confidence,
    coalesce(cast(f0.token = t.token as int), 0) as correct,
    case when f.slot < 5 then 1 else 0 end as topk_correct,
    0.0 - ln(f.prob) as ce, (select sum(-prob * ln(prob + 1e-12)) from fq) as entropy
  from mk_test t left join fq f on f.token = t.token join fq f0 on f0.slot = 0),
both_models as materialized (
  select 'markov' as model, seq_id, pos, token as label, pred, correct, topk_correct, ce, entropy, confidence
  from mk_metrics
  union all
  select 'fb', seq_id, pos, token, pred, correct, topk_correct, ce, entropy, confidence from fb_metrics)"""

CHUNKS = f"""{LINE_MODELS},
wb_marked as materialized (
  select *, cast(token = '<ROW>' as int) as is_row,
    sum(cast(token = '<ROW>' as int)) over (partition by seq_id order by pos) - cast(token = '<ROW>' as int) as chunk_id
  from wb_metrics),
chunks as materialized (
  select seq_id, chunk_id, count(*) filter (is_row = 0) as n_tokens,
    min(correct) filter (is_row = 0) as correct, min(topk_correct) filter (is_row = 0) as topk_correct,
    avg(topk_correct) filter (is_row = 0) as topk_frac, avg(ce) filter (is_row = 0) as ce,
    avg(entropy) filter (is_row = 0) as entropy, avg(confidence) filter (is_row = 0) as confidence,
    trim(regexp_replace(lower(string_agg(token, ' ' order by pos) filter (is_row = 0)), '\\s+', ' ', 'g')) as label_text,
    trim(regexp_replace(lower(string_agg(pred, ' ' order by pos) filter (is_row = 0)), '\\s+', ' ', 'g')) as pred_text
  from wb_marked group by seq_id, chunk_id
  having max(is_row) = 1 and count(*) filter (is_row = 0) > 0)"""


def normal_sql(text: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower({text}), '^\\s+', ''), '\\s+$', ''), '\\s+', ' ', 'g')"


def grams_sql(name: str, source: str) -> str:
    """Gram counts of ``source(text)``."""
    parts = " union all ".join(
        f"select text, substr(text, cast(unnest(range(1, length(text) - {n - 2})) as int), {n}) as gram"
        f" from ({source}) where length(text) >= {n}"
        for n in (3, 4, 5)
    )
    return f"{name} as materialized (select text, gram, count(*) as tf from ({parts}) group by text, gram)"


def catalogue_sql(source: str) -> str:
    """Catalogue of the distinct texts of ``source(text)``."""
    return f"""
cat as materialized (
  select text, row_number() over (order by text) - 1 as rank, count(*) over () as total
  from (select distinct text from ({source}))),
{grams_sql("cat_grams", "select text from cat")},
idf as materialized (
  select gram, count(*) as df,
    ln((1.0 + (select count(*) from cat)) / (1.0 + count(*))) + 1.0 as idf from cat_grams group by gram),
cat_vec as materialized (
  select text, gram, w / sqrt(sum(w * w) over (partition by text)) as w
  from (select text, gram, tf * idf as w from cat_grams join idf using (gram)))"""


def nearest_sql(source: str, k: int) -> str:
    """The k nearest catalogue texts of the distinct texts of ``source(text)``, as near."""
    return f"""
qry as materialized (select distinct text from ({source}) where text is not null),
{grams_sql("qry_grams", "select text from qry")},
qry_vec as materialized (
  select text, gram, w / sqrt(sum(w * w) over (partition by text)) as w
  from (select text, gram, tf * idf as w from qry_grams join idf using (gram))),
sims as materialized (
  select q.text as query, c.text as match, round(sum(q.w * c.w), 6) as similarity
  from qry_vec q join cat_vec c using (gram) group by q.text, c.text),
near as materialized (
  select query, match, similarity,
    row_number() over (partition by query order by similarity desc, match) - 1 as slot
  from (select q.text as query, c.text as match, coalesce(s.similarity, 0.0) as similarity
    from qry q cross join cat c left join sims s on s.query = q.text and s.match = c.text)
  qualify slot < {k})"""
