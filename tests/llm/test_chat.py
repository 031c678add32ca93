"""Chat formatting against a plain version, and its defined edge cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from seqtrail.llm import chat

ROWS = "conv_id long, turn long, role string, text string"
T = chat.Template()


def escape(text):
    text = text.replace("\\", "\\\\")
    for control in T.controls:
        text = text.replace(control, control[0] + "\\" + control[1:])
    return text


def plain(rows):
    """{conv_id: (formatted, spans)} of (conv_id, turn, role, text) rows."""
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out, openings = {}, dict(T.openings)
    for c, turns in groups.items():
        made, spans, last = T.begin, [], None
        for _, _, role, text in sorted(turns):
            if role != last:
                made += (T.end if last is not None else "") + openings.get(role, T.role_open + escape(role) + T.role_close)
            else:
                made += T.joint
            last = role
            if role in T.trained:
                spans.append((len(made), len(escape(text))))
            made += escape(text)
        out[c] = (made + T.end, spans)
    return out


def formatted(spark, rows):
    made = chat.format_conversations(spark.createDataFrame(rows, ROWS).repartition(3))
    return {r.conv_id: (r.formatted, [tuple(s) for s in r.loss_spans]) for r in made.collect()}


def random_rows():
    rng = random.Random(11)
    parts = ["a", "é", "𝒳", "\\", "\n", " ", *T.controls, "<", "[", "s>", "/s>", "INST]", "<\\/s>", "\\[INST]"]
    roles = ["user", "assistant", "system", "tool", "", None, "[/ROLE]x", "a\\b"]
    rows = []
    for c in [*range(25), None]:
        for turn in range(rng.randint(1, 9)):
            text = None if rng.random() < 0.05 else "".join(rng.choices(parts, k=rng.randint(0, 8)))
            rows.append((c, rng.choice([turn, turn, None, 1]), rng.choice(roles), text))
            if rng.random() < 0.2:
                rows.append(rows[-1])
    return rows


def test_formatting_equals_the_plain_version(spark):
    rows = random_rows()
    assert formatted(spark, rows) == plain(rows)


def test_reading_back_gives_every_turn_and_the_training_text(spark):
    rows = random_rows()
    made = chat.format_conversations(spark.createDataFrame(rows, ROWS))
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        told = "".join(f"{role}\n{t}\n" for *_, role, t in turns)
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].formatted_chars == len(plain(rows)[c][0])


def test_conversations_longer_than_a_step(spark):
    rng = random.Random(3)
    rows = [(7, i, rng.choice(["user", "assistant"]), "x" * rng.randint(0, 5) + "</s>") for i in range(3 * chat.STEP + 5)]
    rows += [(8, 0, "assistant", "y " * 200_000)]
    assert formatted(spark, rows) == plain(rows)
    made = chat.format_conversations(spark.createDataFrame(rows, ROWS))
    loss = {r.conv_id: r.loss_chars for r in chat.digests(made).collect()}
    assert loss == {7: sum(len(t) for c, _, r, t in rows if c == 7 and r == "assistant"), 8: 400_000}


def test_empty_table_and_clashing_columns(spark):
    assert chat.format_conversations(spark.createDataFrame([], ROWS)).count() == 0
    clash = ["turns", "formatted", "pieces", "firsts", "ends", "loss_spans"]
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    frame = spark.createDataFrame(rows, ROWS).select("*", *[F.lit(1).alias(c) for c in clash])
    made = chat.format_conversations(frame)
    assert made.columns == ["conv_id", "formatted", "loss_spans"]
    assert [tuple(r)[:2] for r in made.collect()] == [(1, "<s>[INST]a</s>[/INST]b</s>")]


def test_adjacent_turns_of_one_role_are_one_block(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "")]
    assert formatted(spark, rows) == {1: ("<s>[INST]a[TURN]b</s>[/INST]c[TURN]</s>", [(28, 1), (35, 0)])}


@pytest.mark.parametrize("bad", ["<", "a\\b", "[INST]", "<s", "s>x", "]["])
def test_templates_with_ambiguous_marks_are_refused(bad):
    with pytest.raises(ValueError, match="control strings"):
        chat.Template(joint=bad)


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame(random_rows(), ROWS)
    plan = chat.digests(chat.format_conversations(frame))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
