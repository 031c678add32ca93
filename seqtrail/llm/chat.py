"""Chat formatting in Spark expressions alone: sorted turns, merged roles, marked blocks, a loss mask.

A formatted conversation is ``begin``, then a block for each run of turns of one role: the
role's opening, the run's texts with ``joint`` between them, and ``end``. Roles without an
opening of their own are written between ``role_open`` and ``role_close``. Control strings
inside texts and roles get a backslash after their first character, and backslashes are
doubled, so that no text holds a control string and ``parse`` gives back every turn.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Items of an array that one expression adds up or cuts in a step; longer arrays go in several steps.
STEP = 512


@dataclass(frozen=True)
class Template:
    """Control strings: at least two characters, without backslash, none within or overlapping another."""

    begin: str = "<s>"
    end: str = "</s>"
    joint: str = "[TURN]"
    role_open: str = "[ROLE]"
    role_close: str = "[/ROLE]"
    openings: tuple[tuple[str, str], ...] = (("system", "<<SYS>>"), ("user", "[INST]"), ("assistant", "[/INST]"))
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        found = self.controls
        if len(set(found)) < len(found) or any(len(c) < 2 or "\\" in c for c in found):
            raise ValueError("control strings must differ and have two characters at least, none a backslash")
        for a in found:
            for b in found:
                if (a != b and a in b) or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)))):
                    raise ValueError(f"control strings {a!r} and {b!r} overlap")

    @property
    def controls(self) -> list[str]:
        return [self.begin, self.end, self.joint, self.role_open, self.role_close, *(o for _, o in self.openings)]


def escape(text: Column, template: Template) -> Column:
    """``text`` without any control string, reversibly."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in template.controls:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def steps_of(array: Column) -> Column:
    """``array`` as an array of arrays of at most ``STEP`` items."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(array), F.lit(1)), F.lit(STEP))
    return F.transform(starts, lambda at: F.slice(array, at, STEP))


def running_sums(lengths: Column) -> Column:
    """Inclusive sums of an array of longs, in steps, so that long arrays cost little more than their size."""

    def within(items: Column) -> Column:
        start = F.array().cast("array<bigint>")
        return F.aggregate(
            items, start, lambda sums, x: F.array_append(sums, F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0)) + x)
        )

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x)

    steps = steps_of(lengths)
    before = within(F.concat(F.array(F.lit(0).cast("long")), F.transform(steps, total)))
    return F.flatten(F.zip_with(steps, F.slice(before, 1, F.size(steps)), lambda items, base: F.transform(within(items), lambda x: x + base)))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and ``turns``, the sorted array of its turns' structs."""
    one = F.struct(
        F.col("turn").isNotNull().alias("given"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))


def merged(turns: Column, firsts: Column, template: Template) -> Column:
    """Runs of adjacent turns of one role as structs of role and escaped texts."""

    def run(first: Column, at: Column) -> Column:
        after = F.coalesce(F.get(firsts, at + 1), F.size(turns) + 1)
        texts = F.transform(F.slice(turns, first, after - first), lambda t: escape(t["text"], template))
        return F.struct(F.get(turns, first - 1)["role"].alias("role"), texts.alias("texts"))

    return F.transform(firsts, run)


def _opening(role: Column, template: Template) -> Column:
    out = F.concat(F.lit(template.role_open), escape(role, template), F.lit(template.role_close))
    for name, opening in template.openings:
        out = F.when(role == name, F.lit(opening)).otherwise(out)
    return out


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, ``formatted``, and ``loss_spans``, the loss mask.

    ``loss_spans`` lists (start, size) in code points of each text of a trained role as it
    stands, escaped, in ``formatted``; marks are never under the mask, an empty text has
    size 0. Turns are sorted by turn (null first), then role and text, so repeated rows and
    ties have one result. A null role or text is empty; rows without conv_id are one
    conversation, whose conv_id is null. Other columns are ignored, whatever their names.
    An empty table gives an empty one.

    A conversation is one row, as a training example must be: its formatted text, at most
    Spark's 2 GB a value, bounds what a task collects. All array work is linear in it but
    for a factor of ``STEP``.
    """
    sorted_turns = ordered_turns(conversations)
    places = F.sequence(F.lit(1), F.size("turns"))
    changes = F.filter(
        places, lambda i: (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", F.greatest(i - 2, F.lit(0)))["role"])
    )

    def pieces_of(block: Column) -> Column:
        opening = _opening(block["role"], template)
        return F.transform(
            block["texts"],
            lambda text, i: F.struct(
                F.when(i == 0, opening).otherwise(F.lit(template.joint)).alias("mark"),
                text.alias("text"),
                F.when(i == F.size(block["texts"]) - 1, F.lit(template.end)).otherwise(F.lit("")).alias("close"),
                block["role"].isin(*template.trained).alias("trained"),
            ),
        )

    pieces = (
        sorted_turns.withColumn("firsts", changes)
        .select("conv_id", merged(F.col("turns"), F.col("firsts"), template).alias("blocks"))
        .select("conv_id", F.flatten(F.transform("blocks", pieces_of)).alias("pieces"))
    )
    size = lambda p: (F.length(p["mark"]) + F.length(p["text"]) + F.length(p["close"])).cast("long")
    placed = pieces.withColumn("sizes", F.transform("pieces", size)).withColumn("ends", running_sums(F.col("sizes")))

    def span(piece: Column, end: Column) -> Column:
        start = end - F.length(piece["close"]) - F.length(piece["text"]) + len(template.begin)
        found = F.struct(start.cast("long").alias("start"), F.length(piece["text"]).cast("long").alias("size"))
        return F.when(piece["trained"], found)

    texts = F.transform("pieces", lambda p: F.concat(p["mark"], p["text"], p["close"]))
    return placed.select(
        "conv_id",
        F.concat(F.lit(template.begin), F.array_join(texts, "")).alias("formatted"),
        F.filter(F.zip_with("pieces", "ends", span), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parse(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation, as an array of structs of role and text."""
    body = F.substring(formatted, F.lit(len(template.begin) + 1), F.length(formatted) - len(template.begin) - len(template.end))
    named = [(F.lit(role), opening) for role, opening in template.openings]

    def read(block: Column) -> Column:
        parts = F.split(block, re.escape(template.role_close), 2)
        role = unescape(F.substring(F.get(parts, F.lit(0)), F.lit(len(template.role_open) + 1), F.length(block)))
        rest = F.get(parts, F.lit(1))
        for name, opening in named:
            fits = F.startswith(block, F.lit(opening))
            role = F.when(fits, name).otherwise(role)
            rest = F.when(fits, F.substring(block, F.lit(len(opening) + 1), F.length(block))).otherwise(rest)
        return F.transform(
            F.split(rest, re.escape(template.joint), -1), lambda text: F.struct(role.alias("role"), unescape(text).alias("text"))
        )

    return F.flatten(F.transform(F.split(body, re.escape(template.end), -1), read))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask as they stand, cut from ``formatted`` by place."""

    def cut(text: Column, span: Column, base: Column) -> Column:
        # A span's size and place are below 2^31, as a string's length is.
        return F.substring(text, (span["start"] - base + 1).cast("int"), span["size"].cast("int"))

    def region(items: Column) -> Column:
        """The part of the text that a step's spans cover; looking places up in it is cheap."""
        first, last = F.get(items, F.lit(0)), F.get(items, F.size(items) - 1)
        whole = F.struct(first["start"].alias("start"), (last["start"] + last["size"] - first["start"]).alias("size"))
        return F.struct(items.alias("items"), cut(formatted, whole, F.lit(0)).alias("part"), first["start"].alias("base"))

    regions = F.transform(F.filter(steps_of(spans), lambda s: F.size(s) > 0), region)
    return F.flatten(F.transform(regions, lambda r: F.transform(r["items"], lambda s: cut(r["part"], s, r["base"]))))


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What ``format_conversations`` made, read back: turns from the text, training text by the mask."""
    read = formatted.select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted"), template).alias("turns"),
        F.array_join(F.transform(under_mask(F.col("formatted"), F.col("loss_spans")), unescape), "").alias("loss"),
    )
    listed = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(listed, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_control_texts(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The table's turns and conversation -1, whose texts are made of control strings."""
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
