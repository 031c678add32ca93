"""Merkle trees over the pieces, paragraphs and sections of a text."""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtrail.llm.common import slices

#: Characters of the base-64 name of a piece (48 bits).
NAME = 8
#: Pieces end at blanks that a hash of the bytes before picks; above so many bytes, at any byte so picked.
LONGEST = 512
#: Pieces in which a hash picks no byte either end after so many.
UNPICKED = 4096


def _sha(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _picks(b: np.ndarray, at: np.ndarray, share: int) -> np.ndarray:
    """The places of ``at`` that a hash of the four bytes before picks, one in ``share``; not over a line end."""
    mix = np.full(len(at), 17, np.uint32)
    sound = np.ones(len(at), bool)
    for back in range(1, 5):
        near = b[at - back]
        sound &= near != 10
        mix = (mix ^ near) * np.uint32(16777619)
    mix ^= mix >> 15
    mix *= np.uint32(2246822519)
    return at[sound & ((mix >> 13) & (share - 1) == 0)]


def _cuts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and paragraph of the pieces of a text.

    Pieces end at line ends and after one blank in eight, picked by the four bytes before
    it. Where that gives more than ``LONGEST`` bytes, as in texts without blanks, one byte in 128
    is picked in the same way. A cut so depends on the bytes next to it, and an edit moves cuts
    only in the piece it touches; but where nothing is picked for ``UNPICKED`` bytes, as in one
    character repeated, there is a cut after so many. Empty pieces are left out.
    """
    b = np.frombuffer(data, np.uint8)
    lines = np.flatnonzero(b == 10)
    picked = _picks(b, np.flatnonzero(b[4:] == 32) + 4, 8) + 1
    starts = np.sort(np.concatenate(([0], picked, lines + 1)))
    ends = np.sort(np.concatenate((picked, lines, [len(b)])))
    wide = ends - starts > LONGEST
    if wide.any():
        more = np.concatenate([_picks(b, np.arange(x + 4, y), 128) for x, y in zip(starts[wide], ends[wide], strict=True)])
        starts, ends = np.sort(np.append(starts, more)), np.sort(np.append(ends, more))
    wide = ends - starts > UNPICKED
    if wide.any():
        more = np.concatenate([np.arange(x + UNPICKED, y, UNPICKED) for x, y in zip(starts[wide], ends[wide], strict=True)])
        starts, ends = np.sort(np.append(starts, more)), np.sort(np.append(ends, more))
    some = ends > starts
    starts, ends = starts[some], ends[some]
    return starts, ends, np.searchsorted(lines, starts, "right")


def fingerprint(text: str | None) -> str:
    """The tree of a text as ``root:section/section/...``, a section being ``paragraph,paragraph``.

    Paragraphs are lines. A paragraph is written as the names of its pieces, 8 characters of
    base 64 each, so the string is the whole tree. The hash of a paragraph is that of its
    pieces' hashes, and so on up to the root. A section ends with a paragraph whose hash is a
    multiple of four, so edits move no other section's bounds. Equal texts have
    equal fingerprints; null counts as empty.
    """
    data = (text or "").encode()
    starts, ends, lines = _cuts(data)
    paragraphs: list[tuple[list[bytes], list[bytes]]] = [([], []) for _ in range(data.count(b"\n") + 1)]
    for start, end, line in zip(starts.tolist(), ends.tolist(), lines.tolist(), strict=True):
        digest = _sha(data[start:end])
        names, digests = paragraphs[line]
        names.append(base64.b64encode(digest[:6], b"-_"))
        digests.append(digest)
    sections, top, body, below = [], [], [], []
    for names, digests in paragraphs:
        digest = _sha(b"".join(digests))
        body.append(b"".join(names))
        below.append(digest)
        if digest[0] % 4 == 0:
            sections.append(b",".join(body))
            top.append(_sha(b"".join(below)))
            body, below = [], []
    if body:
        sections.append(b",".join(body))
        top.append(_sha(b"".join(below)))
    return f"{_sha(b''.join(top)).hex()[:32]}:{b'/'.join(sections).decode()}"


def branches(tree: str) -> tuple[str, list[list[list[str]]]]:
    """Root and piece names by section and paragraph."""
    root, _, body = tree.partition(":")
    names = lambda p: [p[i : i + NAME] for i in range(0, len(p), NAME)]
    return root, [[names(p) for p in s.split(",")] for s in body.split("/")]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of ``pairs``, which rise in the first number, that rises in the second too."""
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for at, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        before[at] = last[k - 1] if k else -1
        tops[k:k + 1], last[k:k + 1] = [j], [at]
    out, at = [], last[-1] if last else -1
    while at >= 0:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


def _aligned(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of equal items in the same order in both lists.

    Common ends are taken first, then items that stand once in either list, as many as keep
    their order, and the same again in the gaps between them. Where all are repeated, the
    n-th of one list goes with the n-th of the other.
    """
    found, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        mine, theirs = Counter(x[a:b]), Counter(y[c:d])
        once = {y[j]: j for j in range(c, d) if theirs[y[j]] == 1}
        anchors = _rising([(i, once[x[i]]) for i in range(a, b) if mine[x[i]] == 1 and x[i] in once])
        if anchors:
            for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
                todo.append((i + 1, k, j + 1, m))
        else:
            where = defaultdict(deque)
            for j in range(c, d):
                where[y[j]].append(j)
            anchors = _rising([(i, where[x[i]].popleft()) for i in range(a, b) if where.get(x[i])])
        found += anchors
    return sorted(found)


Place = tuple[int, ...]


def _gaps(x: list[tuple[Place, str]], y: list[tuple[Place, str]]) -> Iterator[tuple[list, list]]:
    """What is left of both lists between the items that are equal and in the same order."""
    i = j = 0
    for k, m in [*_aligned([key for _, key in x], [key for _, key in y]), (len(x), len(y))]:
        if k > i or m > j:
            yield x[i:k], y[j:m]
        i, j = k + 1, m + 1


def _paragraphs(sections: list[tuple[Place, str]]) -> list[tuple[Place, str]]:
    return [((*at, j), p) for at, body in sections for j, p in enumerate(body.split(","))]


def _pieces(paragraphs: list[tuple[Place, str]]) -> list[tuple[Place, str]]:
    """The pieces of paragraphs, with the end of each as a piece without a name."""
    return [((*at, k), p[i : i + NAME]) for at, p in paragraphs for k, i in enumerate(range(0, len(p) + 1, NAME))]


def differences(a: str, b: str) -> tuple[list[Place], list[Place]]:
    """Places (section, paragraph, piece) of each tree that have no equal in order in the other.

    The trees are descended in step. Equal roots end the search at once; sections that are equal
    and in the same order are passed over, and of those between them only the paragraphs, and
    between equal ones of these the pieces, are compared. A moved, repeated or left-out part so
    differs, as does a line end: the place after a paragraph's last piece.
    """
    mine, theirs = _different(a, b)
    return [at for at, _ in mine], [at for at, _ in theirs]


def _different(a: str, b: str) -> tuple[list[tuple[Place, str]], list[tuple[Place, str]]]:
    mine: list[tuple[Place, str]] = []
    theirs: list[tuple[Place, str]] = []
    if a[:32] == b[:32]:
        return mine, theirs
    tops = ([((i,), s) for i, s in enumerate(tree[33:].split("/"))] for tree in (a, b))
    for sections in _gaps(*tops):
        for paragraphs in _gaps(*map(_paragraphs, sections)):
            for one, two in _gaps(*map(_pieces, paragraphs)):
                mine += one
                theirs += two
    return mine, theirs


def _likeness(a: str, b: str, differing: tuple[list, list]) -> float:
    if a[:32] == b[:32]:
        return 1.0
    total = sum((len(s) - s.count("/") - s.count(",")) // NAME for s in (a[33:], b[33:]))
    other = sum(name != "" for side in differing for _, name in side)
    return min((total - other) / total, total / (total + 1)) if total else 0.0


def likeness(a: str, b: str) -> float:
    """Share of the pieces of both trees that are equal and in order, found by descending in step.

    1 only for equal roots: with n pieces in both trees, others are n / (n + 1) alike at most.
    """
    return _likeness(a, b, _different(a, b))


def locate(a: str, b: str) -> list[Place]:
    """Places (section, paragraph, piece) of ``a`` that ``b`` does not have there; see ``differences``."""
    return differences(a, b)[0]


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the first characters of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row; null text counts as empty, other columns are ignored."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            made = [fingerprint(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], ["doc_id", "fingerprint"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        make, "doc_id long, fingerprint string"
    )


COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, "
    "edits array<string>"
)


def compare_with_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's tree against its edited form's and the next text's, by ascending doc_id.

    Texts are shuffled once: into ranges of doc_id, each sorted and read in order by one
    task. The first document of a range is also given to the range before it (the first of
    all to the last range), so that every row meets its next one. Ranges come from
    approximate quantiles of the ids; as many as there are shuffle partitions.

    ``edits`` lists the places (section/paragraph/piece) of a text that its edited form does not
    have. Null text counts as empty. Rows of equal id go by text; of a null id, first. A single
    row is its own next. No rows give no rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Bounded: one number per range.
    bounds = rows.agg(
        F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("b")
    ).first()["b"]
    bounds = np.array(sorted(set(bounds or [])), np.int64)

    def part_of(ids: pd.Series) -> np.ndarray:
        return np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0).astype("int64"), "right"))

    @F.pandas_udf("int")
    def own(ids: pd.Series) -> pd.Series:
        return pd.Series(part_of(ids), dtype="int32")

    # One row per range, as above.
    firsts = (
        rows.select("doc_id", own("doc_id").alias("part"))
        .groupBy("part")
        .agg(F.min("doc_id").alias("doc_id"), F.bool_or(F.col("doc_id").isNull()).alias("nulls"))
        .orderBy("part")
        .collect()
    )
    wanted: dict[int | None, list[int]] = {}
    for i, first in enumerate(firsts):
        wanted.setdefault(None if first["nulls"] else first["doc_id"], []).append(firsts[i - 1]["part"])

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        """Twice the row's own range, and twice plus one each range that looks ahead to it."""
        found = part_of(ids)
        keys = [None if null else int(x) for x, null in zip(ids.fillna(0), ids.isna(), strict=True)]
        return pd.Series([[2 * p, *(2 * q + 1 for q in wanted.get(k, ()))] for p, k in zip(found.tolist(), keys, strict=True)])

    both = rows.select("doc_id", "text", F.explode(places("doc_id")).alias("place")).select(
        "doc_id", "text", F.shiftright("place", 1).alias("part"), (F.col("place") % 2).alias("ahead")
    )
    ordered = both.repartition(parts, "part").sortWithinPartitions("part", "ahead", "doc_id", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        # The row not yet compared, its tree and its part; whether the part's look-ahead row was used.
        last, done = None, None
        for batch in slices(batches, 128):
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "ahead")]
            for row_id, body, part, is_ahead in zip(*columns, strict=True):
                if is_ahead and done == part:
                    continue
                tree = fingerprint(body)
                if last is not None and last[3] == part:
                    here, mine, its_tree, _ = last
                    new = edited(mine, body)
                    its_edit = fingerprint(new)
                    differing = _different(its_tree, its_edit)
                    out.append(
                        (
                            here, len(mine), hashlib.sha256(new.encode()).hexdigest(), its_tree, its_edit,
                            _likeness(its_tree, its_edit, differing), likeness(its_tree, tree),
                            ["/".join(map(str, at)) for at, _ in differing[0]],
                        )
                    )
                if is_ahead:
                    last, done = None, part
                else:
                    last = (row_id, body, tree, part)
            if out:
                names = [c.split()[0] for c in COMPARED.split(", ")]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=SCHEMA)
                out = []

    return ordered.mapInArrow(compare, COMPARED)


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ("edits", pa.list_(pa.string())),
    ]
)
