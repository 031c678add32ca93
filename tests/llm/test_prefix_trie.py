"""The conversation trie against a plain one, and its defined edge cases."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from seqtrail.llm import prefix_trie as trie

ROWS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(paths):
    """Sorted node rows of {conv_id: [(role, text), ...]}."""
    members = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        size = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * size + sum(saved[x] for x in below)
    rows = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        rows.append((min(ids), len(node), parent, len(ids), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def table(spark, paths):
    rows = [(c, i, role, text) for c, turns in paths.items() for i, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, ROWS).repartition(3)


def result(spark, paths, block=trie.BLOCK):
    members = spark.createDataFrame([(c,) for c in paths], "conv_id long")
    found = trie.prefix_trie(trie.numbered_turns(table(spark, paths)), members, block)
    return sorted([tuple(r[c] for c in COLUMNS) for r in found.collect()], key=repr)


def branching(seed, n=60, deep=23):
    """Conversations that leave earlier ones at any depth, copies and prefixes among them."""
    rng = random.Random(seed)
    paths = {}
    for c in rng.sample(range(1000), n):
        old = list(rng.choice(list(paths.values()))) if paths and rng.random() < 0.85 else []
        old = old[: rng.randint(0, len(old))]
        more = rng.choice([0, 0, 1, 2, rng.randint(0, deep)])
        paths[c] = old + [(rng.choice(["user", "assistant"]), rng.choice("abcé") * rng.randint(0, 3)) for _ in range(more)]
    return paths


@pytest.mark.parametrize("seed, block", [(1, 1), (2, 3), (3, 4), (4, 8)])
def test_trie_equals_the_plain_one(spark, seed, block):
    paths = branching(seed)
    assert result(spark, paths, block) == plain(paths)


def test_many_copies_and_one_long_conversation(spark):
    turns = [("user", f"t{i}") for i in range(3000)]
    paths = {c: turns[:6] for c in range(300)} | {500: turns, 501: [*turns[:2999], ("user", "x")], 502: turns[:2000]}
    paths |= {600 + i: [("user", f"own {i}")] for i in range(40)}
    assert result(spark, paths) == plain(paths)


def test_members_without_turns_and_empty_tables(spark):
    assert result(spark, {3: [], 1: []}) == plain({3: [], 1: []})
    assert result(spark, {3: [], 1: [("user", "")], 7: [("user", "")]}) == plain({3: [], 1: [("user", "")], 7: [("user", "")]})
    assert result(spark, {5: [("user", "a")]}) == plain({5: [("user", "a")]})
    assert result(spark, {}) == []


def test_nulls_ties_repeats_and_other_columns(spark):
    rows = [(1, None, None, "first"), (1, 0, "user", None), (1, 0, "user", None), (None, 0, "user", "lost"), (2, 5, "", "first"), (2, 6, "user", "")]
    frame = spark.createDataFrame(rows, ROWS).select("*", *[F.lit("x").alias(c) for c in ("pos", "digest", "size", "key", "node", "block", "prev", "last")])
    found = trie.prefix_trie(trie.numbered_turns(frame), frame.select("conv_id"))
    got = sorted([tuple(r[c] for c in COLUMNS) for r in found.collect()], key=repr)
    assert got == plain({1: [("", "first"), ("user", ""), ("user", "")], 2: [("", "first"), ("user", "")]})


def test_role_and_text_are_kept_apart(spark):
    paths = {1: [("ab", "c")], 2: [("a", "bc")], 3: [("1:a", "")], 4: [("", "1:a")]}
    assert result(spark, paths) == plain(paths)


def test_splicing_equals_the_plain_version(spark):
    paths = branching(9, n=80) | {1000: [("user", "a")], 1001: [("user", "b")] * 12, 1004: [], 1009: [("user", "c")] * 9}
    paths = {c: t for c, t in paths.items() if t}
    turns = trie.numbered_turns(table(spark, paths))
    conv = F.col("conv_id")
    made = trie.spliced(turns, F.crc32(conv.cast("string")) % 9, conv - conv % 5, most=8)
    want = {}
    for c, own in paths.items():
        h = zlib.crc32(str(c).encode()) % 9
        want[c] = paths.get(c - c % 5, [])[:h] + own[h:]
    found = trie.prefix_trie(made, spark.createDataFrame([(c,) for c in paths], "conv_id long"))
    assert sorted([tuple(r[c] for c in COLUMNS) for r in found.collect()], key=repr) == plain(want)
