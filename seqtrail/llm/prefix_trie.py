"""A trie of conversations by their leading turns, found block by block.

Conversations are cut into blocks of ``BLOCK`` turns, and a block is named by a digest
chained over all earlier ones, so conversations with equal names share everything up to
there. They are grouped by these names first. Where all members of a group go on with the
same block, the block's turns are a chain that needs no more grouping; only where members
go on with different blocks are those (each distinct one once) opened and grouped turn by turn.

A node is known by its smallest member and its depth: it *belongs* to that member. What
belongs to a member is a run of its path, from where it leaves all smaller members down to
its end. So sums over subtrees need no walk over the trie: each member is told what the
members before it have of its path already, and these numbers are added up per node along
the same two-step grouping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtrail.functions.numbers import int_div
from seqtrail.functions.ordered import order_rows
from seqtrail.llm.common import cut

#: Turns to a block.
BLOCK = 4
#: Hexadecimal digits of SHA-256 that name a turn or a prefix: 128 bits.
DIGITS = 32
ROOT = "0" * DIGITS

CHAINED = "conv_id long, prev string, key string, digests string, sizes array<long>, first long, base long, last boolean"


def name_of(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, DIGITS)


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, ``digest`` of role and text, and ``size``, the text's UTF-8 bytes.

    Null role and text are empty; rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", name_of(content).alias("digest"), F.octet_length(text).cast("long").alias("size")
    )


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``turn_digests`` with ``pos``, from 0 by turn (null first, ties by digest), however long a conversation is."""
    return order_rows(turn_digests(conversations), ["conv_id"], ["turn", "digest"]).drop("turn")


def spliced(turns: DataFrame, heads: Column, base: Column, most: int) -> DataFrame:
    """Each conversation with its first ``heads`` turns replaced by those of the conversation ``base``.

    ``heads`` (at most ``most``) and ``base`` are expressions of ``conv_id``. A conversation
    that is its own base stays as it is. An absent base gives no turns, a shorter one all it
    has; the conversation's own later turns follow without a gap. Stored, as is ``turns`` best.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size_of"))
    ids = sizes.select("conv_id", heads.cast("long").alias("heads"), base.alias("base"))
    found = ids.filter("base <> conv_id").join(sizes.select(F.col("conv_id").alias("base"), "size_of"), "base", "left")
    found = cut(found.select("conv_id", "base", "heads", F.least("heads", F.coalesce("size_of", F.lit(0))).alias("given")))
    whole = turns.join(found.select("conv_id"), "conv_id", "left_anti")
    own = turns.join(found, "conv_id").filter("pos >= heads").withColumn("pos", F.expr("pos - heads + given"))
    lent = turns.filter(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    given = lent.join(found, "base").filter("pos < given")
    columns = ["conv_id", "pos", "digest", "size"]
    return cut(whole.select(*columns).unionByName(own.select(*columns)).unionByName(given.select(*columns)))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by conversation and number: their chained names, what lies before them, and if they are the last."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("prev", pa.string()), ("key", pa.string()), ("digests", pa.string()),
        ("sizes", pa.list_(pa.int64())), ("first", pa.int64()), ("base", pa.int64()), ("last", pa.bool_()),
    ])
    held = None  # The row before, until it is known whether its conversation goes on.
    for batch in batches:
        rows = []
        for conv, digests, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digests", "sizes")), strict=True):
            prev, first, base = ROOT, 0, 0
            if held:
                goes_on = held[0] == conv
                rows.append((*held, not goes_on))
                if goes_on:
                    prev, first, base = held[2], held[5] + len(held[4]), held[6] + sum(held[4])
            key = hashlib.sha256((prev + digests).encode()).hexdigest()[:DIGITS]
            held = (conv, prev, key, digests, sizes, first, base)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*held, True), schema, strict=True)], schema=schema)


def chained_blocks(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each conversation and block, with the names of the prefixes before and after it.

    A block has at most ``block`` turns. The chain reads a conversation's blocks in order, one
    at a time; turns were brought together into blocks before, in parallel.
    """
    items = F.array_sort(F.collect_list(F.struct("pos", "digest", "size")))
    blocks = (
        turns.withColumn("block", int_div(F.col("pos"), block))
        .groupBy("conv_id", "block")
        .agg(items.alias("items"))
        .select("conv_id", "block", F.array_join("items.digest", "").alias("digests"), F.col("items.size").alias("sizes"))
    )
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_chain, CHAINED)


def _siblings(blocks: DataFrame) -> DataFrame:
    """Distinct blocks with their members counted; ``diverging`` where other blocks follow the same prefix."""
    same = cut(
        blocks.groupBy("prev", "key").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("last").alias("ends"),
            F.min("conv_id").alias("owner"),
            *[F.first(c).alias(c) for c in ("digests", "sizes", "first", "base")],
        )
    )
    several = same.groupBy("prev").agg(F.count(F.lit(1)).alias("ways")).filter("ways > 1")
    return cut(same.join(several, "prev", "left").withColumn("diverging", F.col("ways").isNotNull()).drop("ways"))


def _opened(siblings: DataFrame) -> DataFrame:
    """A row for each turn of each block: its name, its parent's, depth, and the bytes before it."""

    def name(at: Column) -> Column:
        return name_of(F.concat("prev", F.substring(F.col("digests"), F.lit(1), at * DIGITS)))

    at, length = F.col("at"), F.size("sizes")
    earlier = F.aggregate(F.slice("sizes", F.lit(1), at - 1), F.lit(0).cast("long"), lambda a, x: a + x)
    return siblings.withColumn("at", F.explode(F.sequence(F.lit(1), length))).select(
        "*",
        F.when(at == length, F.col("key")).otherwise(name(at)).alias("node"),
        F.when(at == 1, F.col("prev")).otherwise(name(at - 1)).alias("parent"),
        (F.col("first") + at).alias("depth"),
        (F.col("base") + earlier).alias("before"),
        F.when(at == length, F.col("ends")).otherwise(0).alias("ends_here"),
    )


def _nodes(siblings: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """The nodes below the root. Turns are grouped inside diverging blocks only."""
    columns = ["node", "parent", "depth", "before"]
    opened = _opened(siblings).withColumnsRenamed({"ends": "ends_of_block"}).withColumnRenamed("ends_here", "ends")
    grouped = opened.filter("diverging").groupBy("node").agg(*[F.first(c).alias(c) for c in columns[1:]], *[s.alias(c) for c, s in sums.items()])
    return opened.filter("not diverging").select(*columns, *sums).unionByName(grouped.select(*columns, *sums))


def _facts(siblings: DataFrame, ends: DataFrame) -> DataFrame:
    """For each member: from which depth nodes belong to it, the bytes of its path before, is its end a leaf of its own."""
    low, high = F.struct("depth", "before"), F.struct("depth", (F.col("n") == F.col("ends")).alias("closed"))
    single = _nodes(siblings.filter("diverging"), {"n": F.sum("n"), "ends": F.sum("ends"), "owner": F.min("owner")})
    spans = single.select("owner", low.alias("low"), high.alias("high"))
    chains = siblings.filter("not diverging").select(
        "owner",
        F.struct((F.col("first") + 1).alias("depth"), F.col("base").alias("before")).alias("low"),
        F.struct((F.col("first") + F.size("sizes")).alias("depth"), (F.col("n") == F.col("ends")).alias("closed")).alias("high"),
    )
    zero = F.lit(0).cast("long")
    root = ends.groupBy().agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("depth") == 0).alias("ends"))
    root = root.filter("n > 0").select(
        "owner",
        F.struct(zero.alias("depth"), zero.alias("before")).alias("low"),
        F.struct(zero.alias("depth"), (F.col("n") == F.col("ends")).alias("closed")).alias("high"),
    )
    owned = (
        spans.unionByName(chains).unionByName(root)
        .groupBy(F.col("owner").alias("conv_id"))
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
    )
    return ends.join(owned, "conv_id", "left").select(
        "conv_id",
        F.col("node").alias("end"),
        "depth",
        F.col("low.depth").alias("start"),
        F.coalesce("low.before", "total").alias("shared"),
        F.coalesce(F.col("high.closed"), F.lit(False)).cast("long").alias("leaf"),
    )


def _end_lists(ends: DataFrame) -> DataFrame:
    """conv_ids of each ``node`` in ascending order, joined by commas.

    They are joined within slices of their order first, so a node where most conversations
    end is worked on by many tasks; only its text, which is asked for, comes together in one.
    """
    slices = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = (
        ends.repartitionByRange(slices, "node", "conv_id")
        .groupBy("node", F.spark_partition_id().alias("slice"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("piece"))
    )
    whole = F.array_sort(F.collect_list(F.struct("slice", "piece")))
    return pieces.groupBy("node").agg(F.sha2(F.array_join(whole["piece"], ","), 256).alias("listed"))


def prefix_trie(turns: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie, one row each.

    ``turns`` has conv_id, pos (0, 1, ... in each conversation), digest and size;
    ``members`` has the conv_ids, also of conversations without turns, which end at the
    root. Returns conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves (childless nodes in the subtree), saved_tokens (bytes of
    last texts times members less one, summed over the subtree) and ends_sha256 (of the
    joined ids of the members that end here). Without members there are no nodes, not even
    the root. Null conv_ids are left out and repeated ones count once; other columns are ignored.
    """
    blocks = cut(chained_blocks(turns, block))
    last = blocks.filter("last").select(
        "conv_id", F.col("key").alias("node"), (F.col("first") + F.size("sizes")).alias("depth"),
        (F.col("base") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"),
    )
    zero = F.lit(0).cast("long")
    without = members.select("conv_id").filter("conv_id is not null").distinct().join(last, "conv_id", "left_anti")
    ends = cut(last.unionByName(without.select("conv_id", F.lit(ROOT).alias("node"), zero.alias("depth"), zero.alias("total"))))
    siblings = _siblings(blocks)
    facts = cut(_facts(siblings, ends))

    top = F.struct("conv_id", "shared", "start", F.col("depth").alias("end_depth"))
    told = [F.min(top).alias("top"), F.sum("shared").alias("shared"), F.sum("leaf").alias("leaves")]
    by_block = blocks.select("conv_id", "key").join(facts, "conv_id").groupBy("key").agg(*told)
    sums = {"n": F.sum("n"), "ends": F.sum("ends"), "top": F.min("top"), "shared": F.sum("shared"), "leaves": F.sum("leaves")}
    below = _nodes(siblings.join(by_block, "key"), sums)
    root = facts.groupBy().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("depth") == 0).alias("ends"), *told).filter("n > 0")
    root = root.select(
        F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), zero.alias("depth"), zero.alias("before"), *sums
    )
    nodes = cut(
        below.unionByName(root).select(
            "node", "parent", "depth", "n", "ends", "leaves", "top.conv_id", "top.start", "top.end_depth",
            F.expr("shared - top.shared - (n - 1) * before").alias("saved_tokens"),
        )
    )

    # Nodes of one member: all that follows from the member alone. Others: look up what branches off and ends.
    goes_on = (F.col("end_depth") > F.col("depth")).cast("long")
    lone = nodes.filter("n = 1").select(
        "*", goes_on.alias("n_children"), F.sha2(F.when(F.col("ends") == 1, F.col("conv_id").cast("string")).otherwise(""), 256).alias("ends_sha256")
    )
    starts = nodes.filter("depth = start and depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("starts"))
    several = nodes.filter("n > 1")
    ending = facts.select("conv_id", F.col("end").alias("node")).join(several.filter("ends > 0").select("node"), "node", "left_semi")
    shared = several.join(starts, "node", "left").join(_end_lists(ending), "node", "left").select(
        *nodes.columns,
        (goes_on + F.coalesce("starts", zero)).alias("n_children"),
        F.coalesce("listed", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    every = lone.unionByName(shared)
    # A node belongs to its parent's member, unless its member's run of nodes starts here.
    begun = F.expr("depth = start and depth > 0")
    branches = every.filter(begun).join(
        several.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent"
    )
    rest = every.filter(~begun).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    return rest.unionByName(branches).select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), "saved_tokens", "ends_sha256",
    )
