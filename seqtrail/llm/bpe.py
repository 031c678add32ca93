"""Byte-level BPE: every distinct word is encoded once and its ids joined back."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtrail.llm.common import runs, slices

#: The characters that Unicode calls white space, as members of a regex class.
WHITE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

#: A place: the task's partition, the block's number in it and the word's number in the block.
BATCH_BITS, NUMBER_BITS = 14, 26
#: A block is closed when it has so many pre-tokens: larger ones repeat fewer words.
BLOCK_TOKENS = 6_000_000
#: Words or ids of a text that are looked up at a time.
PIECE = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: base 64 and a number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def java_pattern(pattern: str) -> str:
    """The pre-token pattern with white space spelled out, which Java's ``\\s`` takes more narrowly."""
    spelled = re.sub(r"(\[\^?)\\s", lambda m: m[1] + WHITE, pattern)
    return spelled.replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")


@lru_cache(maxsize=2)
def encoding(pattern: str, ranks: frozenset) -> tiktoken.Encoding:
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=dict(ranks), special_tokens={})


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers below 2**28 in one to four bytes, small ones short; a set top bit says that more follow."""
    size = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in (1, 2, 3))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        has = size > k
        out[at[has] + k] = ((values[has] >> 7 * k) & 127) | ((size[has] > k + 1) << 7)
    return out.tobytes()


def unpack_numbers(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], b[:-1] < 128))) if len(b) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(b)))
    values = b[at] & 127
    for k in (1, 2, 3):
        has = size > k
        values[has] |= (b[at[has] + k] & 127) << 7 * k
    return values


def pre_tokens(texts: DataFrame, pattern: str) -> DataFrame:
    """digest and ``words``, the pre-tokens of each text in order, in one reading of the texts.

    Java splits them. Of texts with characters newer than Java's tables ``words`` is null and
    ``text`` is given instead, for Python to split.
    """
    told = texts.select("digest", "text", F.col("text").rlike(r"\p{Cn}").alias("odd"))
    return told.select(
        "digest",
        F.when(~F.col("odd"), F.regexp_extract_all("text", F.lit(java_pattern(pattern)), F.lit(0))).alias("words"),
        F.when(F.col("odd"), F.col("text")).alias("text"),
    )


def _word_lists(batch: pa.RecordBatch, find: Callable[[str], list[str]]) -> pa.ListArray:
    """The pre-tokens of the batch's texts, those that Java left being split here."""
    lists = batch.column("words")
    if not lists.null_count:
        return lists
    left = lists.is_null().to_numpy(zero_copy_only=False)
    found = pa.array([find(x) for x in batch.column("text").filter(pa.array(left)).to_pylist()], lists.type)
    rows = np.arange(len(lists))
    rows[left] = len(lists) + np.arange(len(found))
    return pa.concat_arrays([lists, found]).take(pa.array(rows))


def _marks(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def _numbering(marks: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Per word a summand of the fingerprint that tells which word has which number in a block."""
    return marks * (2 * numbers.astype(np.uint64) + 1)


def _blocks(
    batches: Iterator[pa.RecordBatch], pattern: str
) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, pa.Array]]:
    """Blocks of a task's texts, each text once: number, digests, text ends, word numbers, words.

    A block gathers Arrow batches until it has BLOCK_TOKENS pre-tokens; only their places in
    the block's word list are held. The distinct words are numbered by falling count, so
    that common ones get small numbers.
    """
    part, seen, at = TaskContext.get().partitionId(), set(), 0
    find = regex.compile(java_pattern(pattern)).findall
    digests: list[bytes] = []
    sizes: list[np.ndarray] = []
    coded: list[pa.DictionaryArray] = []

    def block() -> tuple[int, list[bytes], np.ndarray, np.ndarray, pa.Array]:
        chunks = pa.chunked_array(coded).unify_dictionaries().chunks
        words = chunks[0].dictionary
        index = np.concatenate([x.indices.to_numpy() for x in chunks])
        order = np.argsort(-np.bincount(index, minlength=len(words)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        if at >> BATCH_BITS or part >> 63 - BATCH_BITS - NUMBER_BITS or len(words) >> NUMBER_BITS:
            raise ValueError("too many blocks in a partition, or words in a block: use smaller partitions")
        found = (part << BATCH_BITS) | at, list(digests), np.cumsum(np.concatenate(sizes)), rank[index], words.take(pa.array(order))
        for held in (digests, sizes, coded):
            held.clear()
        return found

    for batch in batches:
        names, new = batch.column("digest").to_pylist(), []
        for i, digest in enumerate(names):
            if digest not in seen:
                seen.add(digest)
                new.append(i)
        if not new:
            continue
        if len(new) < len(names):
            batch = batch.take(pa.array(new, pa.int64()))
        lists = _word_lists(batch, find)
        digests += [names[i] for i in new]
        sizes.append(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        coded.append(lists.flatten().dictionary_encode())
        # The pre-tokens themselves are not needed any more.
        del batch, lists
        if sum(map(len, coded)) >= BLOCK_TOKENS:
            pa.default_memory_pool().release_unused()
            yield block()
            at += 1
    if digests:
        yield block()


def distinct_words(tokens: DataFrame, pattern: str) -> DataFrame:
    """Rows (word, place): the words of each block, exploded from its texts.

    A place is the block's number in the upper bits and the word's number in the block below.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, _, words in _blocks(batches, pattern):
            for at in range(0, len(words), 50_000):
                some = words.slice(at, 50_000)
                places = np.arange(at, at + len(some)) | (block << NUMBER_BITS)
                yield pa.RecordBatch.from_arrays([some, pa.array(places, pa.int64())], ["word", "place"])

    return tokens.mapInArrow(tell, "word string, place long")


def numbered_texts(tokens: DataFrame, pattern: str) -> DataFrame:
    """Rows (block, mark, n_words, digest, numbers): each text as the numbers of its words, in order.

    ``mark`` is the fingerprint of the block's numbering.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, digests, ends, numbers, words in _blocks(batches, pattern):
            mark = sum(
                int(_numbering(_marks(words.slice(at, 50_000).to_pylist()), np.arange(at, min(at + 50_000, len(words)))).sum(dtype=np.uint64))
                for at in range(0, len(words), 50_000)
            )
            mark = (mark & (1 << 64) - 1) - (1 << 63)
            starts = [0, *ends.tolist()]
            for at in range(0, len(digests), 256):
                some = digests[at : at + 256]
                packed = [pack_numbers(numbers[starts[i] : starts[i + 1]]) for i in range(at, at + len(some))]
                same = [pa.array(np.full(len(some), v, np.int64)) for v in (block, mark, len(words))]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(some, pa.binary()), pa.array(packed, pa.binary())],
                    ["block", "mark", "n_words", "digest", "numbers"],
                )

    return tokens.mapInArrow(tell, "block long, mark long, n_words long, digest binary, numbers binary")


def with_ids(words: DataFrame, pattern: str, ranks: Broadcast, *, gathered: int = 100_000) -> DataFrame:
    """block, mark, numbers, sizes, ids: each distinct word encoded once, for all blocks that hold it.

    Blocks give a word once, so no word has more rows than there are blocks; equal words
    lie side by side after the shuffle. What goes back to a block is gathered: the words'
    numbers and numbers of ids, packed, the ids one after the other, and the words' part of
    the fingerprint of the block's numbering.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoding(pattern, ranks.value).encode_ordinary
        places: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        found: list[pa.Array] = []

        def gather() -> Iterator[pa.RecordBatch]:
            if not places:
                return
            place = np.concatenate(places)
            order = np.argsort(place)
            place, ids = place[order], pa.concat_arrays(found).take(pa.array(order))
            starts = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1] // 4
            pool = np.frombuffer(ids.buffers()[2], "<u4")
            block, number = place >> NUMBER_BITS, place & ((1 << NUMBER_BITS) - 1)
            told = _numbering(np.concatenate(marks)[order], number)
            first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            rows = [
                (
                    int(block[a]),
                    int(told[a:b].sum(dtype=np.uint64)) - (1 << 63),
                    pack_numbers(number[a:b]),
                    pack_numbers(np.diff(starts[a : b + 1]).astype(np.int64)),
                    pool[starts[a] : starts[b]].tobytes(),
                )
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(block)], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                ["block", "mark", "numbers", "sizes", "ids"],
            )
            for held in (places, marks, found):
                held.clear()

        for batch in batches:
            coded = batch.column("word").dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            ids = pa.array([np.array(one(w), "<u4").tobytes() for w in distinct], pa.binary())
            places.append(batch.column("place").to_numpy())
            marks.append(_marks(distinct)[coded.indices.to_numpy()])
            found.append(ids.take(coded.indices))
            if sum(map(len, places)) >= gathered or sum(x.nbytes for x in found) > 1 << 24:
                yield from gather()
        yield from gather()

    dealt = words.repartition("word").sortWithinPartitions("word")
    return dealt.mapInArrow(encode, "block long, mark long, numbers binary, sizes binary, ids binary")


class _Spelling:
    """The ids of a block's words, by their numbers: all that is held of a block while its texts pass by."""

    def __init__(self, parts: list[pa.RecordBatch], n_words: int, mark: int) -> None:
        told = {c: [x for part in parts for x in part.column(c).to_pylist()] for c in ("mark", "numbers", "sizes", "ids")}
        number = np.concatenate([np.zeros(0, np.int64), *map(unpack_numbers, told["numbers"])])
        size = np.concatenate([np.zeros(0, np.int64), *map(unpack_numbers, told["sizes"])])
        self.pool = np.frombuffer(b"".join(told["ids"]), "<u4")
        found = (sum(x + (1 << 63) for x in told["mark"]) & (1 << 64) - 1) - (1 << 63)
        if len(number) != n_words or found != mark or len(np.unique(number)) != n_words:
            raise RuntimeError("the two passes found different blocks: the texts must not change between them")
        self.start, self.size = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
        self.start[number], self.size[number] = np.cumsum(size) - size, size

    def ids(self, packed: bytes) -> np.ndarray:
        numbers = unpack_numbers(packed)
        pieces = [_gathered(self.pool, self.start[x], self.size[x]) for x in (numbers[at : at + PIECE] for at in range(0, len(numbers), PIECE))]
        return np.concatenate([np.zeros(0, "<u4"), *pieces])


def _gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that begin at ``start`` and are ``size`` long, one after the other."""
    return pool[np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)]


class _TokenBytes:
    """The token-byte table as one string of bytes, each id's place in it and its length (-1: no such id)."""

    def __init__(self, ranks: frozenset) -> None:
        known = sorted((i, token) for token, i in ranks)
        self.size = np.full(max((i for i, _ in known), default=-1) + 1, -1, np.int64)
        self.start = np.zeros(len(self.size), np.int64)
        ids, sizes = np.array([i for i, _ in known], np.int64), np.array([len(token) for _, token in known], np.int64)
        self.size[ids], self.start[ids] = sizes, np.cumsum(sizes) - sizes
        self.pool = np.frombuffer(b"".join(token for _, token in known), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes | None:
        if len(ids) and (int(ids.max()) >= len(self.size) or (self.size[ids] < 0).any()):
            return None
        pieces = (ids[at : at + PIECE] for at in range(0, len(ids), PIECE))
        return b"".join(_gathered(self.pool, self.start[x], self.size[x]).tobytes() for x in pieces)


@lru_cache(maxsize=1)
def _token_bytes(ranks: frozenset) -> _TokenBytes:
    return _TokenBytes(ranks)


def encode_texts(texts: DataFrame, ranks: dict[bytes, int], pattern: str, *, decoded: bool = False) -> DataFrame:
    """digest and ids (little-endian unsigned 32-bit) of the texts of ``texts`` (digest, text).

    Texts are split into pre-tokens block by block. The distinct words of all blocks meet in
    one shuffle by word, where each is encoded once; the ids go back to their blocks,
    where they are put at the positions of their words: the rows of a block are sorted, its
    words first, so that only these are held while its texts pass by. Word counts within a
    block take the place of repeated rows, so no word is hot. A task works a text once, however
    many copies it sees; copies seen by several tasks give equal rows. ``texts`` is read
    twice and must be stored, so that both readings find the same; a fingerprint of every
    block's numbering tells if they did not, which is an error. Empty texts have no
    ids; null digests or texts give no row. With ``decoded`` the ids are decoded again while
    they are at hand, as ``decode_texts`` does it.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frozenset(ranks.items()))
    tokens = pre_tokens(texts.filter("digest is not null and text is not null"), pattern)
    words = with_ids(distinct_words(tokens, pattern), pattern, shared)
    rows = numbered_texts(tokens, pattern).unionByName(words, allowMissingColumns=True)
    # The words of a block have no digest and come first.
    sorted_blocks = rows.repartition("block").sortWithinPartitions("block", F.col("digest").isNotNull())

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(shared.value) if decoded else None
        block, parts, spelling = None, [], None
        for batch in slices(batches, 64):
            first, length = runs(batch.column("block").to_numpy())
            for a, n in zip(first.tolist(), length.tolist(), strict=True):
                part = batch.slice(a, n)
                if part.column("block")[0].as_py() != block:
                    block, parts, spelling = part.column("block")[0].as_py(), [], None
                is_text = part.column("digest").is_valid()
                parts.append(part.filter(pc.invert(is_text)))
                held = part.filter(is_text)
                if not held.num_rows:
                    continue
                if spelling is None:
                    spelling = _Spelling(parts, held.column("n_words")[0].as_py(), held.column("mark")[0].as_py())
                parts = []
                ids = [spelling.ids(x) for x in held.column("numbers").to_pylist()]
                made = [held.column("digest"), pa.array([x.tobytes() for x in ids], pa.binary())]
                if table:
                    made.append(pa.array([table.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(made, ["digest", "ids", "decoded"][: len(made)])

    return sorted_blocks.mapInArrow(put_together, "digest binary, ids binary" + (", decoded binary" if decoded else ""))


def decode_texts(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The rows of ``encoded`` (digest, ids) with ``decoded``, the tokens' bytes one after the other.

    The token-byte table has a row per id of the vocabulary, whatever the data, so each
    task looks the ids up in its own copy. Ids outside the table make ``decoded`` null.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(frozenset(ranks.items()))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(shared.value)
        for batch in slices(batches, 256):
            out = [table.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("ids"), pa.array(out, pa.binary())], ["digest", "ids", "decoded"]
            )

    return encoded.select("digest", "ids").mapInArrow(decode, "digest binary, ids binary, decoded binary")


def token_counts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row: how many ids its whole text is encoded to.

    For uses that need no ids: nothing is shuffled, and only the counts are kept. Null
    and empty texts have 0 tokens. Repeated rows and null ids stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(ranks.items()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoding(pattern, shared.value)
        for batch in slices(batches, 64):
            counts = [len(one.encode_to_numpy(x)) if x else 0 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text))
    return source.mapInArrow(count, "doc_id long, n_tokens long")


def text_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (null counts as empty) and the MD5 digest that names the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.unhex(F.md5(body)).alias("digest"))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of every row. Repeated rows and null ids stay; other columns are ignored."""
    rows = text_rows(docs, doc_id, text)
    made = encode_texts(rows.select("digest", "text"), ranks, pattern).dropDuplicates(["digest"])
    return rows.select("doc_id", "digest").join(made, "digest", "left").select("doc_id", "ids")
