"""The operators against brute force, and their defined edge cases."""

import gzip
import hashlib
import os
import random
import tracemalloc

import brute
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from seqtrail.llm import bpe, common, langid, line_crf, merkle, packing, quality_rules, shingle_join, training_order, url_filter, warc
from seqtrail.llm.oracles import ORACLES

TEXTS = "doc_id long, text string"
#: A column of each name that the operators use inside.
CLASH = ["node", "key", "slice", "words", "place", "part", "ahead", "size", "digest", "stratum", "root", "score"]


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Exact and near copies, a shared passage, short, empty, null and very long texts."""
    rng = random.Random(5)
    vocab = vocabulary(rng)
    passage = [rng.choice(vocab) for _ in range(60)]
    out = {}
    for i in range(160):
        body = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 9, 30, 70, 90, 200, 500]))]
        if i % 4 == 0:
            body[:0] = passage
        out[i] = " ".join(body)
    for i in range(160, 320):
        body = out[rng.randrange(160)].split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8, 16])):
            body[rng.randrange(len(body))] = rng.choice(vocab)
        out[i] = " ".join(body)
    base = [rng.choice(vocab) for _ in range(300)]
    for i in range(320, 380):  # a chain of near copies whose ends differ
        base[(i * 5) % 300] = rng.choice(vocab)
        out[i] = " ".join(base)
    out[380], out[381], out[382], out[383] = None, "", " \n\t ", " ".join(rng.choice(vocab) for _ in range(30000))
    out[384] = out[383].upper()
    out[385], out[386] = "Ünï ©ode\x1cword\x85x", "ünï ©ode\x1cword\x85x"
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, *[f"x{i}"] * len(CLASH)) for i, t in texts.items()]
    return spark.createDataFrame(rows, TEXTS + "".join(f", {c} string" for c in CLASH)).repartition(3)


def no_rows(spark):
    return spark.createDataFrame([], TEXTS)


# 1 ---------------------------------------------------------------------------------------


def archive_of(records, zipped=True):
    return b"".join(gzip.compress(r, mtime=0) + warc.EMPTY_MEMBER if zipped else r for r in records)


def some_records():
    rng = random.Random(1)
    out = []
    for i in range(8):
        payload = rng.randbytes(rng.randint(0, 400))
        out.append(warc.record(i, f"http://a.example/{i}", payload, hashlib.sha256(payload).hexdigest(), None, "2024-01-01T00:00:00Z"))
    return out


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("damage", ["flip", "cut", "head", "insert", "none"])
def test_salvage_recovers_all_other_records(zipped, damage):
    records = some_records()
    parts = [archive_of([r], zipped) for r in records]
    hurt = bytearray(parts[3])
    if damage == "flip":
        at = len(hurt) // 2 if zipped else hurt.index(b"Content-Length: ", 300) + 16
        hurt[at] ^= 0x55 if zipped else 0x08
    elif damage == "cut":
        del hurt[len(hurt) // 2 :]
    elif damage == "head":
        hurt[:3] = b"xxx"
    elif damage == "insert":
        hurt[10:10] = b"??"
    data = b"".join([*parts[:3], bytes(hurt), *parts[4:]])
    found = list(warc.salvage(data))
    good = [x for x in found if x["kind"] == "record"]
    gaps = [x for x in found if x["kind"] == "gap"]
    ids = [int(x["record_id"][10:-1]) for x in good]
    assert ids == [i for i in range(8) if i != 3 or damage == "none"]
    assert bool(gaps) == (damage != "none")
    start, end = sum(map(len, parts[:3])), sum(map(len, parts[:3])) + len(hurt)
    assert all(start <= g["offset"] and g["offset"] + g["length"] <= end and g["reason"] for g in gaps)


def test_wrong_digest_is_a_gap_of_its_own():
    records = some_records()
    plain = records[2].replace(b"WARC-Block-Digest: sha256:", b"WARC-Block-Digest: sha256:0")
    found = list(warc.salvage(archive_of([records[1], plain, records[4]], zipped=False)))
    assert [x["kind"] for x in found] == ["record", "gap", "record"]
    assert found[1]["reason"] == "block digest" and found[1]["length"] == len(plain)
    assert list(warc.salvage(b"")) == [] and [x["kind"] for x in warc.salvage(b"junk")] == ["gap"]


def test_pages_round_trip(spark):
    big = "é" * 80
    rows = [
        (5, "http://x/\n1", big, "a"), (2, None, big, "b"), (9, "u", big, "c"), (3, "u", None, "d"), (4, "u", "", "e"),
        (6, "u", "short", "f"), (7, "u", "short", "g"), (2, "again", big, "h"), (None, "n", big, "i"), (None, "n", "z" * 200, "j"),
        (8, "u", "WARC/1.1\r\n\r\n" * 30, "k"), (10, "u", "q" * 500_000, "l"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = warc.page_digests(warc.read_archives(spark, warc.write_archives(pages))).collect()
    found = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    expected = []
    for page, _, html, _ in rows:
        revisit = html == big and page != 2
        expected.append((page if page is not None else -1, "revisit" if revisit else "response", 2 if revisit else None, len((html or "").encode()), sha(html)))
    assert sorted(expected, key=repr) == sorted(found, key=repr)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.page_digests(warc.read_archives(spark, warc.write_archives(empty))).count() == 0


def test_pages_with_very_long_urls(spark):
    urls = {1: "http://x/" + "a" * 100_000, 2: "http://x/" + " \n" * 50_000, 3: "http://x/"}
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in urls.items()], "page_id long, url string, html string")
    entries = warc.read_archives(spark, warc.write_archives(pages)).collect()
    assert {r.kind for r in entries} == {"record"}
    expected = {f"<urn:page:{i}>": u.replace(" ", "%20").replace("\n", "%0A") for i, u in urls.items()}
    assert {r.record_id: r.target_uri for r in entries} == expected


@pytest.mark.parametrize("zipped", [True, False])
def test_long_header_is_read_and_a_cut_one_is_not(zipped):
    records = [warc.record(i, "u" * n, b"x", hashlib.sha256(b"x").hexdigest(), None, "2024-01-01T00:00:00Z") for i, n in enumerate((5, 200_000, 7))]
    found = list(warc.salvage(archive_of(records, zipped)))
    assert [(x["kind"], len(x["target_uri"])) for x in found] == [("record", 5), ("record", 200_000), ("record", 7)]
    parts = [records[0], records[1][:100_000], records[2]]
    found = list(warc.salvage(archive_of(parts, zipped)))
    assert [x["kind"] for x in found] == ["record", "gap", "record"]


# 2 ---------------------------------------------------------------------------------------


def test_components_equal_brute_force(spark, docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.components(docs).collect()}
    assert got == brute.components(texts)


def test_components_without_groups_of_one_key(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK", 8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.components(docs).collect()}
    assert got == brute.components(texts)


def test_component_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(90))
    rows = [(7, long), (3, long + " x"), (3, "other"), (None, long), (None, "alone here"), (5, "other")]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in shingle_join.components(spark.createDataFrame(rows, TEXTS)).collect()]
    assert sorted(got, key=repr) == sorted(
        [(7, 86, 3), (3, 87, 3), (3, 1, 3), (None, 86, 3), (None, 1, None), (5, 1, 3)], key=repr
    )
    assert shingle_join.components(no_rows(spark)).count() == 0


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    for n in (4, 5, 10, 63, 64, 70, 79, 80, 101, 102, 300, 2000):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            drop = rng.integers(0, n // 5 + 1)
            extra = int(rng.integers(0, max(1, n // 4)))
            b = np.unique(np.concatenate((a[rng.permutation(len(a))[drop:]], rng.integers(0, 2**63, extra, dtype=np.uint64))))
            inside = len(np.intersect1d(a, b))
            if 100 * inside < 80 * (len(a) + len(b) - inside):
                continue
            (x, loose_a), (y, loose_b) = shingle_join.node_keys(a), shingle_join.node_keys(b)
            assert set(x) & set(y) or (loose_a and loose_b)


def test_tree_join_finds_what_all_pairs_find():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (6, 200), dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[i % 6][rng.random(200) < 0.95], rng.integers(0, 2**63, rng.integers(0, 30), dtype=np.uint64)))) for i in range(300)]
    points = np.array([shingle_join.point(s) for s in sets])
    sizes, owner = np.array([len(s) for s in sets]), np.arange(300) // 2
    tree = shingle_join.RTree(points, sizes, owner)
    got = {tuple(sorted(map(int, p))) for x, y, _ in shingle_join.tree_join(tree, None) for p in zip(x, y, strict=True)}
    inside = np.minimum(points[:, None], points[None]).sum(2)
    good = (180 * inside >= 80 * (sizes[:, None] + sizes)) & (100 * np.minimum.outer(sizes, sizes) >= 80 * np.maximum.outer(sizes, sizes))
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if good[i, j] and owner[i] != owner[j]}


def test_words_are_hashed_alike_in_any_chunk():
    data = np.frombuffer(("Ab cd\n\t" * 500 + "x" * 3000 + " Ab").encode(), np.uint8)
    whole, parts = shingle_join.hash_words(data), shingle_join.hash_words(data, 64)
    assert (whole[1] == parts[1]).all() and (whole[0] == parts[0]).all()
    assert whole[1][0] == whole[1][-1] != whole[1][1]


# 3 ---------------------------------------------------------------------------------------


def test_quality_counts_equal_brute_force(spark, docs, texts):
    more = {1000: "a b c a b c\n\nx\nx\n x\n#*$%&|<>", 1001: "a a a a a", 1002: "one two", 1003: "p q r s p q r s p q"}
    all_docs = docs.select("doc_id", "text").union(spark.createDataFrame(list(more.items()), TEXTS))
    for r in quality_rules.base(all_docs).collect():
        expected = brute.quality_counts((texts | more)[r.doc_id])
        assert {k: r[k] for k in expected} == expected
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_allowed_rejections_are_the_exact_bound(spark):
    sizes = [(str(n), n) for n in (0, 1, 5, 15, 16, 17, 150, 400, 1000, 5000, 100_000)]
    got = quality_rules.most_rejections(spark.createDataFrame(sizes, "stratum string, n long"), 0.02, 0.001).collect()
    assert {r.n: r.allowed for r in got} == {n: brute.binomial_allowed(n, 0.02, 0.001) for _, n in sizes}


def test_cutoffs_reject_no_more_than_proven(spark):
    rows = [(i, "s", 100, 500, int(i % 50 == 0) * 90 if i < 3000 else 80, 0, 0, 0, False) for i in range(3300)]
    names = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_shouts long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    counts = spark.createDataFrame(rows, names)
    labels = spark.createDataFrame([(i, int(i < 3000)) for i in range(3300)] + [(0, 0), (None, 1)], "doc_id long, quality int")
    rules = {"symbols": ("n_symbols / n_words", (0.5, 0.85))}
    # 60 of 3000 good texts have many symbols: too many for 2 %, few enough for 4 %.
    assert quality_rules.choose_cutoffs(counts, labels, rules, risk=0.02).count() == 0
    (best,) = quality_rules.choose_cutoffs(counts, labels, rules, risk=0.04).collect()
    assert (best.cutoff, best.n_good, best.rejected) == (0.5, 3000, 60)
    assert best.allowed == brute.binomial_allowed(3000, 0.04, 0.05 / 2)
    kept = quality_rules.apply_cutoffs(counts, quality_rules.choose_cutoffs(counts, labels, rules, risk=0.04), rules)
    assert kept.filter("kept").count() == 3000 - 60
    empty = quality_rules.filter_quality(
        spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int")
    )
    assert empty.count() == 0


def many_good_texts(spark, n):
    """n good texts and 20 unlabelled texts of a kind that no good text is like."""
    good = [(i, " ".join(f"w{i}a{k:02d}"[-5:] for k in range(60)), "en") for i in range(n)]
    bad = [(n + i, " ".join(f"#{k:02d}#" for k in range(60)), "en") for i in range(20)]
    docs = spark.createDataFrame(good + bad, TEXTS + ", lang string")
    return docs, spark.createDataFrame([(i, 1) for i in range(n)], "doc_id long, quality int")


def equal_to_sql(docs, labels, rows):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("labels", labels.toArrow())
    expected = con.sql(ORACLES["op3_quality_rules"])
    return sorted(tuple(r[c] for c in expected.columns) for r in rows) == sorted(expected.fetchall())


def test_selected_cutoffs_equal_sql(spark):
    docs, labels = many_good_texts(spark, 2600)
    rows = quality_rules.filter_quality(docs, labels).collect()
    assert equal_to_sql(docs, labels, rows)
    assert {r.doc_id for r in rows if not r.kept} == set(range(2600, 2620)) and not any(r.base_failed for r in rows)
    apart = quality_rules.filter_quality(docs, labels, joint=False).collect()
    assert {r.doc_id for r in apart if not r.kept} == set(range(2600, 2620))


def test_smallest_holdout_of_the_joint_path(spark):
    for n, rejected in ((148, set()), (149, set(range(149, 169)))):
        docs, labels = many_good_texts(spark, n)
        rows = quality_rules.filter_quality(docs, labels).collect()
        assert equal_to_sql(docs, labels, rows)
        assert {r.doc_id for r in rows if not r.kept} == rejected


def test_joint_path_stops_where_good_texts_fall(spark):
    """Of 1,000 good texts those with k of 100 words as symbols grow in number from level to level."""
    rng = random.Random(11)
    share = [rng.choice([0, 0, 0, 0, 1, 2, 4, 6, 9, 15, 25, 40, 60, 90]) if rng.random() < 0.06 else 0 for _ in range(1000)]
    rows = [(i, "s", 100, 500, k, 0, 0, 0, False) for i, k in enumerate(share)]
    names = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_shouts long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    counts = spark.createDataFrame(rows, names)
    labels = spark.createDataFrame([(i, 1) for i in range(1000)], "doc_id long, quality int")
    rules = {"symbols": quality_rules.RULES["symbols"], "shouts": quality_rules.RULES["shouts"]}
    levels = quality_rules.path_levels(rules)
    assert all(a[r] >= b[r] for a, b in zip(levels, levels[1:], strict=False) for r in rules)
    assert (levels[0], levels[-1]) == ({"symbols": 0.8, "shouts": 0.8}, {"symbols": 0.02, "shouts": 0.02})
    allowed = brute.binomial_allowed(1000, 0.02, 0.05)
    falls = [sum(k / 100 > level["symbols"] for k in share) for level in levels]
    due = max(at for at, n in enumerate(falls) if n <= allowed)
    assert falls[-1] > allowed
    for r in quality_rules.joint_cutoffs(counts, labels, rules).collect():
        assert (r.level, r.cutoff, r.rejected, r.allowed, r.n_good) == (due, levels[due][r.rule], falls[due], allowed, 1000)


def test_cutoffs_in_sequence_need_a_smaller_holdout(spark):
    docs, labels = many_good_texts(spark, 1600)
    assert all(r.kept for r in quality_rules.filter_quality(docs, labels, joint=False).collect())
    rows = quality_rules.filter_quality(docs, labels, joint=False, sequence=True).collect()
    assert {r.doc_id for r in rows if not r.kept} == set(range(1600, 1620))
    counts = quality_rules.base(docs, stratum=F.col("lang"))
    best = {r.rule: r for r in quality_rules.choose_cutoffs(counts, labels, sequence=True).collect()}
    assert best["symbols"].cutoff == 0.02
    assert {r.allowed for r in best.values()} == {brute.binomial_allowed(1600, 0.02 / 6, 0.05 / 6)}


def test_quality_edge_rows(spark, texts):
    rows = [(i, t, ["en", None][i % 2]) for i, t in texts.items()] + [(None, "null id", "en"), (0, texts[0], "en")]
    docs = spark.createDataFrame(rows, TEXTS + ", lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    got = quality_rules.filter_quality(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r.base_failed and not r.kept for r in got if r.n_words == 0)


# 4 ---------------------------------------------------------------------------------------


def test_trees_and_edited_texts(spark, docs, texts):
    got = {r.doc_id: r for r in merkle.compare_with_next(docs).collect()}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == brute.edited(texts)
    assert all(r.fingerprint == merkle.fingerprint(texts[i]) for i, r in got.items())
    for a in range(0, 40):
        for b in range(160, 200):
            assert (got[a].fingerprint == got[b].fingerprint) == ((texts[a] or "") == (texts[b] or ""))
    long = [r for r in got.values() if r.n_chars > 800]
    assert np.mean([r.near_edited for r in long]) > 0.6 and all(0 <= r.near_next <= 1 for r in got.values())


def test_trees_edge_rows(spark):
    rows = [(None, "null id"), (1, "a"), (1, "b"), (2, None), (5, "last one here")]
    got = sorted((r.doc_id or 0, r.edited_sha256, r.n_chars) for r in merkle.compare_with_next(spark.createDataFrame(rows, TEXTS)).collect())
    order = ["null id", "a", "b", "", "last one here"]
    sha = lambda a, b: hashlib.sha256(merkle.edited(a, b).encode()).hexdigest()
    expected = [((None, 1, 1, 2, 5)[i] or 0, sha(t, order[(i + 1) % 5]), len(t)) for i, t in enumerate(order)]
    assert got == sorted(expected)
    (one,) = merkle.compare_with_next(spark.createDataFrame([(4, "only")], TEXTS)).collect()
    assert one.near_next == 1.0
    assert merkle.compare_with_next(no_rows(spark)).count() == 0


def test_moves_repeats_and_line_ends_are_located():
    lines = [f"paragraph {i} tells something of its own, number {i * i}" for i in range(40)]
    tree = merkle.fingerprint("\n".join(lines))
    swapped, repeated = lines[:], lines[:20] + [lines[5]] + lines[20:]
    swapped[3], swapped[30] = lines[30], lines[3]
    for other in ("\n".join(swapped), "\n".join(repeated), "\n".join(lines) + "\n", "\n".join(lines).replace("\n", "", 1)):
        changed = merkle.fingerprint(other)
        mine, theirs = merkle.differences(tree, changed)
        assert mine or theirs
        assert 0.8 < merkle.likeness(tree, changed) < 1
    sections = merkle.branches(tree)[1]
    flat = [(i, j) for i, s in enumerate(sections) for j in range(len(s))]
    moved = {at[:2] for at in merkle.locate(tree, merkle.fingerprint("\n".join(swapped)))}
    assert moved == {flat[3], flat[30]}
    mine, theirs = merkle.differences(tree, merkle.fingerprint("\n".join(repeated)))
    assert not mine and len({at[:2] for at in theirs}) == 1


def test_edits_of_texts_without_blanks_stay_local():
    rng = random.Random(3)
    text = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(20_000))
    tree = merkle.fingerprint(text)
    assert merkle.likeness(tree, merkle.fingerprint("x" + text)) > 0.98
    assert merkle.likeness(tree, merkle.fingerprint(text[:9_000] + text[9_001:])) > 0.98
    assert len(merkle.branches(merkle.fingerprint("a" * 50_000))[1][0][0]) > 1


def test_likeness_against_longest_common_sequences():
    rng = random.Random(8)
    for _ in range(60):
        x = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 14))]
        y = x[:]
        for _ in range(rng.randint(0, 4)):
            y.insert(rng.randint(0, len(y)), rng.choice("abcdefgh"))
        pairs = merkle._aligned(x, y)
        assert all(x[i] == y[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if p == q else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) <= best[-1][-1]
        if len(set(x)) == len(x) and len(set(y)) == len(y):
            assert len(pairs) == best[-1][-1]


def test_edits_are_located_by_branch():
    rng = random.Random(2)
    lines = [" ".join(vocabulary(rng, 40)) for _ in range(30)]
    a = "\n".join(lines)
    changed = lines[:10] + ["new words " + lines[10][:50]] + lines[11:]
    b = "\n".join(changed)
    one, two = merkle.fingerprint(a), merkle.fingerprint(b)
    assert merkle.locate(one, one) == []
    sections = merkle.branches(one)[1]
    start = {}
    for i, s in enumerate(sections):
        for j in range(len(s)):
            start[i, j] = len(start)
    assert {start[i, j] for i, j, _ in merkle.locate(one, two)} == {10}
    assert merkle.likeness(one, two) > 0.9 and merkle.likeness(one, merkle.fingerprint("zz")) == 0
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint(None)) == 1


# 5 ---------------------------------------------------------------------------------------

RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "a.example.net", "/en/x"), ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"), ("block", "org", ""), ("allow", "b.org", "/"),
]


def judged(url):
    rest = (url or "").partition("://")[2]
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])]
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    host = host.translate(brute.UPPER)
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, verdict = max(fits, default=(0, 0, None, "allow"))
    return host, path, rule, verdict


@pytest.mark.parametrize("parts", ["1", "4"])
def test_urls_equal_brute_force(spark, parts):
    rng = random.Random(8)
    hosts = ["net", "a.net", "example.net", "a.example.net", "b.a.example.net", "xexample.net", "example.com", "Sub.EXAMPLE.com", "org", "b.org", "c.b.org", "borg", "", "a..org", "net:80", "ö.org", "~.net"]
    paths = ["", "/", "/en", "/en/", "/en/x1", "/de/a", "/fr/", "/fr/?q=/en/", "#/fr/", "?x", "/FR/"]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "nothing", "a://b://net/", "http://x.org/\n/fr/"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(None, "http://q.net/", "n"), (0, urls[0], "again")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, key string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = url_filter.judge(pages, url_filter.rule_table(spark, RULES)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted([tuple(r) for r in got], key=repr) == sorted([(i, *judged(u)) for i, u, _ in rows], key=repr)
    none = url_filter.judge(pages, url_filter.rule_table(spark, RULES).limit(0))
    assert none.filter("rule is null and verdict = 'allow'").count() == len(rows)
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark, RULES)).count() == 0


# 6 ---------------------------------------------------------------------------------------


def test_packing_places_every_token_once(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 7, 100, 511, 512, 513, 900, 5000])) for i in range(400)] + [(None, 30), (3, None), (3, 12), (3, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, n int").withColumn("piece", F.lit("clash"))
    got = packing.pack(docs, F.col("n"), group_pieces=150).collect()
    assert sum(r.n_tokens for r in got) == sum(n or 0 for _, n in rows)
    empty = [r for r in got if r.sequence_id is None]
    assert len(empty) == sum(not n for _, n in rows)
    bins = {}
    for r in got:
        if r.sequence_id is not None:
            bins.setdefault(r.sequence_id, []).append(r)
    for content in bins.values():
        content.sort(key=lambda r: r.offset)
        at = 0
        for r in content:
            assert r.offset == at and r.n_tokens > 0
            at += r.n_tokens
        capacity = {r.capacity for r in content}
        assert capacity == {min(c for c in packing.CAPACITIES if c >= at)}
    assert packing.pack(docs.limit(0), F.col("n")).count() == 0


def test_texts_without_blanks_are_packed_by_their_tokens(spark):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    one = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "漢字仮名" * 2000), (2, "x1y2" * 5000), (None, "a b"), (3, ""), (4, None), (3, "two words")]
    docs = spark.createDataFrame(rows, TEXTS).withColumn("n_tokens", F.lit("clash"))
    counts = bpe.token_counts(docs, ranks, public_tokenizers.PATTERN)
    expected = [(i, len(one.encode_ordinary(t or ""))) for i, t in rows]
    assert sorted(map(tuple, counts.collect()), key=repr) == sorted(expected, key=repr)
    got = packing.pack(counts, F.col("n_tokens")).collect()
    for i in (1, 2):
        cut_up = sorted((r.start, r.n_tokens) for r in got if r.doc_id == i)
        assert len(cut_up) > 1 and sum(n for _, n in cut_up) == dict(expected)[i]
    assert bpe.token_counts(no_rows(spark), ranks, public_tokenizers.PATTERN).count() == 0


def test_best_fit_wastes_little_and_takes_the_tightest_bin():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 4097, 3000))[::-1]
    bins = packing.Bins(lengths, packing.CAPACITIES, packing.OVERHEAD)
    for n in lengths.tolist():
        room = {at: bins.opened[at] - bins.filled[at] for at in range(len(bins.opened))}
        fitting = [r for r in room.values() if r >= n]
        known = len(bins.opened)
        at, _ = bins.put(n)
        assert (at < known) == bool(fitting)
        if fitting:
            assert room[at] == min(fitting)
    paid = sum(bins.final(at) for at in range(len(bins.opened)))
    one_size = packing.Bins(lengths, (4096,), packing.OVERHEAD)
    for n in lengths.tolist():
        one_size.put(n)
    assert lengths.sum() / paid > 0.97
    assert paid <= 4096 * len(one_size.opened)


# 7 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows", ["40", "10000"])
def test_ids_equal_tiktoken(spark, docs, texts, rows, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_TOKENS", 5000)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = bpe.read_ranks(path)
    reference = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    odd = "aB1 '\n\t\u00a0\u2003é中ñ🙂\u0301\u1c89\u0378,.!<|endoftext|>\x1c\x85\u3000²Ⅷ"
    more = {2000 + i: "".join(rng.choice(odd) for _ in range(rng.randint(0, 60))) for i in range(200)}
    more |= {3000: "don't we'll 's'S  x   y\n\n z", 3001: "a" * 3000, 3002: " " * 500 + "b", 3003: more[2005]}
    all_texts = texts | more
    both = docs.select("doc_id", "text", F.lit("x").alias("ids")).union(spark.createDataFrame([(i, t, "y") for i, t in more.items()], TEXTS + ", ids string"))
    both = common.cut(both)
    texts_of = bpe.text_rows(both)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        made = bpe.decode_texts(bpe.encode_texts(texts_of.select("digest", "text"), ranks, pattern), ranks).dropDuplicates(["digest"])
        got = {r.doc_id: r for r in texts_of.select("doc_id", "digest").join(made, "digest").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(all_texts)
    for i, r in got.items():
        text = all_texts[i] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(text), repr(text[:80])
        assert bytes(r.decoded) == text.encode()


def test_encoding_edge_rows(spark):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], TEXTS)
    got = bpe.encode(rows, ranks, public_tokenizers.PATTERN).collect()
    assert sorted([(r.doc_id, len(r.ids)) for r in got], key=repr) == sorted([(None, 8), (1, 8), (1, 8), (2, 0)], key=repr)
    assert bpe.encode(no_rows(spark), ranks, public_tokenizers.PATTERN).count() == 0
    bad = spark.createDataFrame([(bytearray(b"x"), bytearray(b"\xff\xff\xff\x7f"))], "digest binary, ids binary")
    assert bpe.decode_texts(bad, ranks).first().decoded is None


def test_ids_decoded_at_hand_and_texts_that_change_between_readings(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = bpe.read_ranks(path)
    texts = {1: "one two one", 2: "", 3: "three\u0378 three", 4: "x" * 5000 + " two"}
    rows = common.cut(bpe.text_rows(spark.createDataFrame(list(texts.items()), TEXTS)))
    got = rows.join(bpe.encode_texts(rows.select("digest", "text"), ranks, pattern, decoded=True), "digest").collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in got} == texts

    words = ["a", "b", "c"]
    marks, numbers = bpe._marks(words), np.arange(3)
    total = int(bpe._numbering(marks, numbers).sum(dtype=np.uint64)) - (1 << 63)
    swapped = int(bpe._numbering(marks, np.array([1, 0, 2])).sum(dtype=np.uint64)) - (1 << 63)
    ids = [bpe.pack_numbers(numbers), bpe.pack_numbers(np.ones(3, np.int64)), np.arange(3, dtype="<u4").tobytes()]
    part = pa.RecordBatch.from_pydict({"mark": [swapped], "numbers": [ids[0]], "sizes": [ids[1]], "ids": [ids[2]]})
    assert bpe._Spelling([part], 3, swapped).ids(bpe.pack_numbers(np.array([2, 0]))).tolist() == [2, 0]
    for n, mark in ((3, total), (2, swapped)):
        with pytest.raises(RuntimeError, match="different blocks"):
            bpe._Spelling([part], n, mark)


def test_packed_numbers_come_back():
    values = np.array([0, 1, 127, 128, 129, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 5])
    assert bpe.unpack_numbers(bpe.pack_numbers(values)).tolist() == values.tolist()
    assert bpe.unpack_numbers(b"").tolist() == []


# 8 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_one_to_one_and_keyed(n):
    there = training_order.permute(np.arange(n), n, "k")
    assert sorted(there.tolist()) == list(range(n))
    assert training_order.permute(there, n, "k", back=True).tolist() == list(range(n))
    if n > 100:
        assert (training_order.permute(np.arange(n), n, "other") != there).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), there)[0, 1]) < 0.15


def test_shards_hold_every_sequence_at_its_slot(spark, docs, texts, tmp_path):
    def encoder():
        return lambda many: [[ord(c) % 60_000 for c in t] for t in many]

    folder = str(tmp_path / "shards")
    index, _ = training_order.materialise(docs, encoder, key="k", filler=65_535, length=64, per_shard=100, folder=folder)
    members = {}
    for r in index.collect():
        members.setdefault(r.slot, []).append(r)
    read = training_order.read_shards(spark, folder, 100, 64, 65_535, "<u2").collect()
    assert sorted(r.slot for r in read) == sorted(members) == list(range(len(read)))
    seen = {}
    for r in read:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert (r.shard, r.byte_start) == (r.slot // 100, r.slot % 100 * 65 * 2)
        assert len(ids) == r.n_tokens == max(m.at + m.n_tokens for m in members[r.slot])
        for m in members[r.slot]:
            assert m.shard == r.shard
            body = texts[m.doc_id][m.start : m.start + m.n_tokens]
            assert ids[m.at : m.at + m.n_tokens] == [ord(c) % 60_000 for c in body]
            seen[m.doc_id] = seen.get(m.doc_id, 0) + m.n_tokens
    assert seen == {i: len(t) for i, t in texts.items() if t}
    index = members
    for shard in range(len(index) // 100 + 1):
        files = [f for f in os.listdir(f"{folder}/shard={shard}") if f.startswith("part-")]
        assert len(files) == 1
    later = training_order.read_shards(spark, folder, 100, 64, 65_535, "<u2", first_slot=250)
    assert sorted(r.slot for r in later.select("slot").collect()) == list(range(250, len(index)))
    none, _ = training_order.materialise(no_rows(spark), encoder, key="k", filler=65_535)
    assert none.count() == 0


def test_lacking_records_and_shards_are_errors(spark, docs, tmp_path):
    def encoder():
        return lambda many: [[ord(c) % 60_000 for c in t] for t in many]

    def damaged(name, change):
        folder = str(tmp_path / name)
        _, _, total = training_order.materialise_counted(docs, encoder, key="k", filler=65_535, length=64, per_shard=100, folder=folder)
        if change:
            place = f"{folder}/shard=1"
            (part,) = [f"{place}/{f}" for f in os.listdir(place) if f.startswith("part-")]
            # Read without checksums, as from a store that has none.
            for f in os.listdir(place):
                if f.endswith(".crc"):
                    os.remove(f"{place}/{f}")
            change(part)
        return total, lambda: training_order.read_shards(spark, folder, 100, 64, 65_535, "<u2", total=total).count()

    total, read = damaged("whole", None)
    assert read() == total > 200
    _, read = damaged("cut", lambda part: os.truncate(part, 99 * training_order.stride(64, "<u2")))
    with pytest.raises(Exception, match="shard 1 has 99 records, not 100"):
        read()
    _, read = damaged("gone", os.remove)
    with pytest.raises(ValueError, match=r"\[1\]"):
        read()
    none, folder, total = training_order.materialise_counted(no_rows(spark), encoder, key="k", filler=65_535)
    assert training_order.read_shards(spark, folder, 4096, 512, 65_535, "<u2", total=total).count() == none.count() == 0


# 9 and 10 --------------------------------------------------------------------------------


def test_language_of_held_out_texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"), 4, 2)))
    found = langid.predict(docs, model).join(docs, "doc_id").filter(langid.held_out(F.col("doc_id"), 4, 2))
    assert found.filter("lang_pred = lang").count() >= 0.98 * found.count() > 0
    assert found.filter("rejected").count() <= 0.01 * found.count()


def test_language_edge_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.fit(docs)
    far = "".join(chr(0x4E00 + i * 7 % 5000) for i in range(3000))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the"), (None, "the and of"), (5, far), (6, "the and " * 200_000)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, TEXTS), model).collect()}
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0, True) for i in (1, 2, 3))
    assert got[5].rejected and got[4].lang_pred in model.languages and len(got) == 7
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.without_rejected(spark.createDataFrame(rows, TEXTS), model)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.rejected}
    nothing = langid.fit(no_rows(spark).withColumn("lang", F.lit("en")))
    assert {(r.lang_pred, r.rejected) for r in langid.predict(spark.createDataFrame(rows, TEXTS), nothing).collect()} == {("und", True)}


def test_grams_of_long_texts_are_all_counted():
    text = "abc déf " * 300_000
    assert langid.gram_counts(text).sum() > 3 * 300_000 * 8


def test_quality_of_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = langid.held_out(F.col("doc_id"), 5, 0)
    model = line_crf.fit(docs, labels.filter(~held))
    found = line_crf.score(docs, model).join(labels.filter(held), "doc_id").collect()
    good = [r.score for r in found if r.quality == 1]
    bad = [r.score for r in found if r.quality == 0]
    assert good and bad and np.mean([r.predicted == r.quality for r in found]) > 0.95
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_line_quality_edge_rows(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 300)] + [(1, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = line_crf.fit(docs, labels)
    rows = [(1, None), (2, ""), (3, " \n \n"), (None, "a line"), (4, "word\n" * 20_000), (4, "x" * 300_000)]
    got = line_crf.score(spark.createDataFrame(rows, TEXTS), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    one = line_crf.fit(docs, labels.filter("quality = 1"))
    assert {r.predicted for r in line_crf.score(docs, one).collect()} == {1}
    assert line_crf.score(no_rows(spark), line_crf.fit(docs, labels.limit(0))).count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(7)
    unary, moves = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    lengths = [5, 3, 1]
    mask = np.arange(5)[None] < np.array(lengths)[:, None]
    weight = np.array([1.0, 2.0, 3.0])
    good, moved = line_crf.marginals(unary, mask, moves, weight)
    expected = np.zeros((2, 2))
    for c, n in enumerate(lengths):
        total, marginal, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> t) & 1 for t in range(n)]
            p = np.exp(sum(unary[c, t] * y[t] for t in range(n)) + sum(moves[y[t - 1], y[t]] for t in range(1, n)))
            total += p
            marginal += p * np.array(y)
            for t in range(1, n):
                pairs[y[t - 1], y[t]] += p
        assert np.allclose(good[c, :n], marginal / total)
        expected += weight[c] * pairs / total
    assert np.allclose(moved, expected)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 50, 1_000])
def test_long_chains_equal_whole_ones(n):
    rng = np.random.default_rng(n)
    unary, moves = 3 * rng.normal(size=n), rng.normal(size=(2, 2))
    whole, _ = line_crf.marginals(unary[None], np.ones((1, n), bool), moves)
    assert np.allclose(line_crf.long_marginals(unary, moves), whole[0])


def test_score_is_the_calibrated_mean_of_enumerated_marginals(monkeypatch):
    rng = np.random.default_rng(11)
    width = 3 * line_crf.FEATURES
    model = line_crf.Model(rng.normal(size=width), rng.normal(size=(2, 2)), rng.normal(size=width), rng.uniform(0.5, 2, width), 0.8, 0.3)
    texts = ["", "One line.", "First line of words\n\nsecond, another line!\nfirst line of words\n", "a b c\n" * 7, "x\n y z\n# | #"]

    def expected(text):
        features, weights = line_crf.line_features(text)
        unary = ((line_crf.with_neighbours(features) - model.centre) / model.scale) @ model.weights
        n, total, good = len(unary), 0.0, np.zeros(len(unary))
        for code in range(2**n):
            y = [(code >> t) & 1 for t in range(n)]
            p = np.exp(sum(unary[t] * y[t] for t in range(n)) + sum(model.moves[y[t - 1], y[t]] for t in range(1, n)))
            total, good = total + p, good + p * np.array(y)
        mean = (good / total * weights).sum() / weights.sum()
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(model.slope * np.log(mean / (1 - mean)) + model.offset)))

    want = [expected(t) for t in texts]
    assert np.allclose(model.quality(line_crf.line_pieces(t) for t in texts), want, atol=1e-6)
    monkeypatch.setattr(line_crf, "PIECE", 2)
    monkeypatch.setattr(line_crf, "CELLS", 8)
    assert np.allclose(model.quality(line_crf.line_pieces(t) for t in texts), want, atol=1e-6)


def test_sampled_lines_are_bounded_and_in_order():
    text = "\n".join(f"line {'w ' * (i % 50)}{i}" for i in range(5_000))
    features, weights = line_crf.sampled_lines(3, text)
    assert len(features) == len(weights) == line_crf.CHAIN * line_crf.CHAINS
    short = "\n".join(text.split("\n")[:100])
    assert np.array_equal(line_crf.sampled_lines(3, short)[0], line_crf.line_features(short)[0])


def test_scoring_many_lines_holds_little():
    model = line_crf.Model(np.ones(3 * line_crf.FEATURES), np.zeros((2, 2)), np.zeros(3 * line_crf.FEATURES), np.ones(3 * line_crf.FEATURES))
    tracemalloc.start()
    model.quality(line_crf.line_pieces("a b\n" * 20_000) for _ in range(32))
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


# Shared ----------------------------------------------------------------------------------


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000), (None, 4), (7000, 7001), (7001, 7000)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1200)} | {7000: 7000, 7001: 7000}
