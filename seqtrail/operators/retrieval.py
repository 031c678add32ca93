"""Nearest known action of a free text, by character n-gram TF-IDF cosine.

Both are exact: ``nearest`` leaves the queries where they are stored and sends the catalogue to them, block
by block. A task counts the grams of its queries, adds up their similarities with the block over the
block's posting lists and hands on only the best, so no row per gram or pair of the queries is ever stored or
shuffled. ``search`` gives the pairs as tables and does not add up whole
vectors for most of them. Grams are put into
levels by falling rarity. Per query, the rarest grams are added up over their posting lists
until only ``REST`` of the query's squared length is left: the most frequent grams, whose
lists are the longest, are not joined at all. The k-th partial sum is a floor that k texts
reach already; what the grams left out can add to a text is bounded level by level, by the
largest weight that any text has in them and by the lengths of both vectors there. Only pairs
whose bound reaches the floor are added up to the end. A query for which even an unmet text
might reach the floor is added up over all lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtrail.functions.ordered import lookup
from seqtrail.functions.storage import cut, remove_table
from seqtrail.functions.text import char_ngrams, normalise

SIMILARITY_DIGITS = 6  # similarities this close count as ties, which the text decides
#: A text this far below the floor cannot tie with it once similarities are rounded.
SLACK = 2.0 * 10**-SIMILARITY_DIGITS
#: Sizes of grams.
LOW, HIGH = 3, 5
#: Rows of the catalogue's vectors to a block, which the driver and every task hold.
TILE_ROWS = 1_000_000
#: Grams that one text in so many of a block has are added up as whole rows, not by posting lists.
OFTEN = 8
#: Characters of queries that a task works on at once.
PORTION = 100_000
#: Largest table of characters after a gram's first ones; larger sets of grams are searched.
TABLE = 4_000_000
#: The catalogue texts found for a query so far, and the sum of both vectors' products.
FOUND = "array<struct<match: bigint, text: string, similarity: double>>"
#: Levels of rarity, of about equal shares of the catalogue's squared weights.
LEVELS = 32
#: Share of a query's squared length that is left to the bounds.
REST = 0.05


@dataclass(frozen=True)
class Catalogue:
    """Known texts with their gram weights; all tables are stored."""

    texts: DataFrame  # (id, text, norms): length of the vector's part in each level
    idf: DataFrame  # (gram, df, idf, level, top): top is the largest weight of any text
    vectors: DataFrame  # (id, gram, w), each text of length 1


def valid_texts(rows: DataFrame, column: str = "action") -> DataFrame:
    """The distinct normalised, non-blank texts of a column."""
    return (
        rows.select(normalise(F.col(column)).alias("text"))
        .filter(F.length("text") > 0)
        .distinct()
    )


def with_ids(texts: DataFrame, text: str) -> DataFrame:
    """The distinct texts with a number ``id`` each, stored: joins and sums go by numbers, not by long texts."""
    return cut(texts.select(text).distinct().withColumn("id", F.monotonically_increasing_id()))


def gram_counts(texts: DataFrame, text: str = "text", key: str = "text") -> DataFrame:
    """how often each gram occurs in each distinct text, told by ``key``."""
    return (
        texts.select(key, F.explode(char_ngrams(F.col(text), LOW, HIGH)).alias("gram"))
        .groupBy(key, "gram")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def smoothed_idf(texts: DataFrame) -> Column:
    n = texts.agg(F.count(F.lit(1))).scalar()
    return F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0


def inverse_frequencies(counts: DataFrame, texts: DataFrame) -> DataFrame:
    """document frequency and smoothed idf of each gram."""
    return counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", smoothed_idf(texts))


def unit_vectors(counts: DataFrame, idf: DataFrame, key: str = "text") -> DataFrame:
    """TF-IDF weights scaled to length 1 per text; unknown grams drop out."""
    weighted = lookup(counts, idf, ["gram"], "inner").withColumn("_w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return weighted.select(key, "gram", (F.col("_w") / length).alias("w"))


def _per_level(rows: DataFrame, key: str, **values: Column) -> DataFrame:
    """For each ``key`` arrays of the sums of ``values`` in each level."""
    sums = rows.groupBy(key, "level").agg(*[F.sum(v).alias(name) for name, v in values.items()])
    listed = F.map_from_entries(F.collect_list(F.struct("level", F.struct(*values.keys()))))

    def array_of(name: str) -> Column:
        levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
        return F.transform(levels, lambda i: F.coalesce(F.col("_sums")[i][name], F.lit(0.0))).alias(name)

    return sums.groupBy(key).agg(listed.alias("_sums")).select(key, *[array_of(name) for name in values])


def gram_levels(vectors: DataFrame, texts: DataFrame) -> DataFrame:
    """gram, df, idf, and each gram's largest weight ``top`` and its ``level``, 0 for the rarest.

    Levels follow document frequency, of which there are few values, and share the squared
    weights of all vectors about evenly.
    """
    tops = vectors.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.max("w").alias("top"), F.sum(F.col("w") * F.col("w")).alias("weight"))
    earlier = Window.orderBy("df").rowsBetween(Window.unboundedPreceding, -1)
    by_df = tops.groupBy("df").agg(F.sum("weight").alias("weight"))
    share = F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)) / F.sum("weight").over(Window.partitionBy())
    levels = by_df.select("df", F.least(F.floor(share * LEVELS), F.lit(LEVELS - 1)).cast("int").alias("level"))
    return tops.join(levels, "df").select("gram", "df", smoothed_idf(texts).alias("idf"), "level", "top")


def fit_catalogue(texts: DataFrame) -> Catalogue:
    """Store the texts, the idf table and the unit vectors of a catalogue."""
    known = with_ids(texts, "text")
    counts = gram_counts(known, key="id")
    vectors = cut(unit_vectors(counts, inverse_frequencies(counts, known), "id"))
    idf = cut(gram_levels(vectors, known))
    norms = _per_level(vectors.join(idf, "gram"), "id", squares=F.col("w") * F.col("w"))
    described = known.join(norms, "id", "left").select("id", "text", F.transform("squares", F.sqrt).alias("norms"))
    return Catalogue(cut(described), idf, vectors)


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


@dataclass(frozen=True)
class Search:
    """A search after its first step; all tables are stored. Queries and matches are told by their ids."""

    vectors: DataFrame  # (query, gram, w, level): vectors of the queries
    partial: DataFrame  # (query, match, similarity): sums over each query's rarer grams
    plans: DataFrame  # (query, cutoff, reach, lengths, floor, safe): what is left out of them, and the floor
    catalogue: Catalogue

    def survivors(self) -> DataFrame:
        """Pairs, among those of safe queries, that may still be among the k best, with ``similarity`` so far."""
        bound = F.zip_with(
            F.zip_with("lengths", "norms", lambda a, b: a * b), "reach", lambda both, most: F.least(both, most)
        )
        left_out = _sum(F.slice(bound, F.col("cutoff") + 1, F.lit(LEVELS)))
        return (
            self.partial.join(self.plans.filter("safe"), "query")
            .join(self.catalogue.texts.select(F.col("id").alias("match"), "norms"), "match")
            .filter(F.col("similarity") + left_out >= F.col("floor") - SLACK)
            .select("query", "match", "similarity")
        )

    def similarities(self) -> DataFrame:
        """(query, match, similarity) of all pairs that may be among the k best, added up to the end."""
        known = self.catalogue.vectors.select(F.col("id").alias("match"), "gram", F.col("w").alias("other"))
        rest = self.vectors.join(self.plans.select("query", "cutoff", "safe"), "query").filter("level >= cutoff")
        kept = self.survivors()
        added = kept.select("query", "match").join(rest.select("query", "gram", "w"), "query").join(known, ["match", "gram"])
        whole = lookup(rest.filter("not safe"), known, ["gram"], "inner")
        open_queries = self.partial.join(self.plans.filter("not safe"), "query", "left_semi")
        gained = added.unionByName(whole.select(*added.columns)).select("query", "match", (F.col("w") * F.col("other")).alias("similarity"))
        summed = kept.unionByName(open_queries).unionByName(gained).groupBy("query", "match").agg(F.sum("similarity").alias("similarity"))
        return summed.withColumn("similarity", F.round("similarity", SIMILARITY_DIGITS)).filter("similarity > 0")


def search(wanted: DataFrame, catalogue: Catalogue, k: int) -> Search:
    """The first step of a search: rarer grams added up, the floor of each query of ``wanted(id, query)``."""
    told = catalogue.idf.select("gram", "level", "top")
    vectors = cut(
        unit_vectors(gram_counts(wanted, "query", "id"), catalogue.idf, "id")
        .join(told, "gram")
        .select(F.col("id").alias("query"), "gram", "w", "level", "top")
    )
    # The first level from which on at most REST of the squared length is left.
    after = lambda squares, i: _sum(F.slice(squares, i + 1, F.lit(LEVELS)))
    places = F.sequence(F.lit(0), F.lit(LEVELS))
    sums = _per_level(vectors, "query", squares=F.col("w") * F.col("w"), reach=F.col("w") * F.col("top"))
    cutoff = F.array_min(F.filter(places, lambda i: after(F.col("squares"), i) <= REST))
    profiles = sums.select("query", "reach", F.transform("squares", F.sqrt).alias("lengths"), cutoff.alias("cutoff"))
    known = catalogue.vectors.select(F.col("id").alias("match"), "gram", F.col("w").alias("other"))
    rare = vectors.join(profiles.select("query", "cutoff"), "query").filter("level < cutoff")
    partial = cut(
        lookup(rare, known, ["gram"], "inner")
        .groupBy("query", "match")
        .agg(F.sum(F.col("w") * F.col("other")).alias("similarity"))
    )
    best = Window.partitionBy("query").orderBy(F.desc("similarity"))
    kth = partial.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k).groupBy("query").agg(
        F.when(F.count(F.lit(1)) == k, F.min("similarity")).otherwise(0.0).alias("floor")
    )
    floor = F.coalesce("floor", F.lit(0.0))
    unmet = _sum(F.slice("reach", F.col("cutoff") + 1, F.lit(LEVELS)))
    plans = profiles.join(kth, "query", "left").select(
        "query", "cutoff", "reach", "lengths", floor.alias("floor"), (unmet < floor - SLACK).alias("safe")
    )
    return Search(vectors.drop("top"), partial, cut(plans), catalogue)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts in a row, and the place after the last one of each text."""
    listed = texts.to_pylist()
    lengths = np.fromiter(map(len, listed), np.int64, len(listed))
    return np.frombuffer("".join(listed).encode("utf-32-le"), np.uint32), np.cumsum(lengths)


class Block:
    """Some texts of the catalogue with their posting lists, and the grams in them as a tree of characters.

    ``held(id, gram, w, idf, first)`` has the vectors of the texts; a gram's squared weight in a query
    is added to the query's squared length by the ``first`` block alone that holds the gram.
    """

    def __init__(self, held: pa.Table, texts: pa.Table, number: int, top_idf: float | None):
        self.top_idf = top_idf  # the largest idf of the catalogue, or None if the block is all of it
        self.grams = pc.unique(held["gram"].cast(pa.string()))
        of_gram = pc.index_in(held["gram"].cast(pa.string()), value_set=self.grams).to_numpy()
        self.matches, place = np.unique(held["id"].to_numpy(), return_inverse=True)
        at = pc.index_in(pa.array(self.matches), value_set=texts["id"].combine_chunks())
        self.texts = texts["text"].combine_chunks().cast(pa.string()).take(at)
        # Posting lists: those of gram g lie from starts[g] up to starts[g + 1].
        order = np.lexsort((place, of_gram))
        self.place, self.other = place[order], held["w"].to_numpy()[order]
        self.starts = np.searchsorted(of_gram[order], np.arange(len(self.grams) + 1))
        some = order[self.starts[:-1]]
        self.idf = held["idf"].to_numpy()[some]
        self.counted = np.where(held["first"].to_numpy()[some] == number, self.idf, 0.0)
        self._grow()

    def _grow(self) -> None:
        # A node is told by the node one character shorter and the last character, which is exact for all characters.
        points, ends = code_points(self.grams)
        lengths = np.diff(ends, prepend=0)
        begin, letters = ends - lengths, np.unique(points)
        self.letters = np.zeros(int(letters[-1]) + 2 if len(letters) else 1, np.int64)
        self.letters[letters] = np.arange(1, len(letters) + 1)  # 0 is any other character
        self.base, letter, self.levels = len(letters) + 1, self.letters[points], []
        node = np.zeros(len(lengths), np.int64)
        for n in range(1, HIGH + 1):
            reach = np.flatnonzero(lengths >= n)
            node[reach] = node[reach] * self.base + letter[begin[reach] + n - 1]
            if n >= LOW:
                space = (len(keys) if n > LOW else self.base ** (n - 1)) * self.base
                keys, node[reach] = np.unique(node[reach], return_inverse=True)
                gram = np.full(len(keys), -1)
                whole = reach[lengths[reach] == n]
                gram[node[whole]] = whole
                places = None
                if space <= TABLE:
                    places = np.full(space, -1, np.int32)
                    places[keys] = np.arange(len(keys))
                # The last key is never met, so that every search ends at a key.
                self.levels.append((np.append(keys, np.iinfo(np.int64).max), places, gram))

    @cached_property
    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """The row of each gram in a table of weights by text, -1 for those of few texts, and the table."""
        length = np.diff(self.starts)
        often = np.flatnonzero(length * OFTEN >= len(self.matches))
        places = np.full(len(length), -1)
        places[often] = np.arange(len(often))
        table, row = np.zeros((len(often), len(self.matches))), np.repeat(places, length)
        table[row[row >= 0], self.place[row >= 0]] = self.other[row >= 0]
        return places, table

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, gram, tf) of all grams of the block in ``texts``, by row and gram."""
        points, ends = code_points(texts)
        letter = self.letters[np.minimum(points, len(self.letters) - 1)]
        size = max(len(self.grams), 1)
        found, times = [], []
        for first in range(0, len(points), 2 * PORTION):
            at = np.arange(first, min(first + 2 * PORTION, len(points)))
            row = np.searchsorted(ends, at, "right")
            node = np.zeros(len(at), np.int64)
            keys = []
            for n in range(1, HIGH + 1):
                inside = at + n <= ends[row]
                at, row, node = at[inside], row[inside], node[inside]
                node = node * self.base + letter[at + n - 1]
                if n >= LOW:
                    known, places, gram = self.levels[n - LOW]
                    if places is None:
                        place = np.searchsorted(known, node)
                        place[known[place] != node] = -1
                    else:
                        place = places[node]
                    hit = np.flatnonzero(place >= 0)
                    at, row, node = at[hit], row[hit], place[hit].astype(np.int64)
                    told = gram[node]
                    keys.append((row * size + told)[told >= 0])
            key, tf = np.unique(np.concatenate(keys), return_counts=True)
            found.append(key)
            times.append(tf)
        if not found:
            return (np.zeros(0, np.int64),) * 3
        if len(found) == 1:
            key, tf = found[0], times[0]
        else:
            key, place = np.unique(np.concatenate(found), return_inverse=True)
            tf = np.bincount(place, np.concatenate(times), len(key))
        return key // size, key % size, tf

    def best(self, ends: np.ndarray, gram: np.ndarray, w: np.ndarray, slack: np.ndarray, k: int, before: pa.Array) -> pa.Array:
        """For each query the ``k`` best texts of the block and of ``before``, and those at most ``slack`` below them.

        The grams of query i and their weights ``w`` lie up to ``ends[i]``.
        """
        earlier = before.flatten()
        borders = np.concatenate(([0], np.cumsum(pc.list_value_length(before).to_numpy())))
        all_earlier = earlier.field("similarity").to_numpy()
        picked, sums, sizes, begin = [], [], [], 0
        places, table = self.frequent
        for i, end in enumerate(ends):
            own, weight, row = gram[begin:end], w[begin:end], places[gram[begin:end]]
            rare, often = np.flatnonzero(row < 0), np.flatnonzero(row >= 0)
            at = self.starts[own[rare]]
            length = self.starts[own[rare] + 1] - at
            lists = np.repeat(at - (np.cumsum(length) - length), length) + np.arange(length.sum())
            few = np.bincount(self.place[lists], np.repeat(weight[rare], length) * self.other[lists], len(self.matches))
            here = few + weight[often] @ table[row[often]]
            old = all_earlier[borders[i] : borders[i + 1]]
            floor = max([np.partition(x, -k)[-k] for x in (here, old) if len(x) >= k], default=0.0) - slack[i]
            kept, new = np.flatnonzero(old >= floor), np.flatnonzero((here >= floor) & (here > 0))
            picked += [borders[i] + kept, len(earlier) + new]
            sums += [old[kept], here[new]]
            sizes.append(len(kept) + len(new))
            begin = end
        picked = np.concatenate(picked) if picked else np.zeros(0, np.int64)
        match = np.concatenate((earlier.field("match").to_numpy(), self.matches))[picked]
        text = pa.concat_arrays([earlier.field("text").cast(pa.string()), self.texts]).take(pa.array(picked))
        found = pa.StructArray.from_arrays([pa.array(match), text, pa.array(np.concatenate(sums) if sums else [], pa.float64())], ["match", "text", "similarity"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), found)


#: (row, gram, w) of a batch of queries by row and gram, their squared lengths so far, and the most that their lengths can be.
Weighed = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def weigh_texts(batch: pa.RecordBatch, block: Block) -> Weighed:
    """The grams of the texts ``query``, weighted by tf and idf; not scaled before all blocks have added to the squares."""
    row, gram, tf = block.counts(batch["query"].cast(pa.string()))
    squares = batch["squares"].to_numpy() + np.bincount(row, (tf * block.counted[gram]) ** 2, batch.num_rows)
    grams = (HIGH - LOW + 1) * pc.utf8_length(batch["query"]).to_numpy()
    return row, gram, tf * block.idf[gram], squares, np.sqrt(squares) if block.top_idf is None else block.top_idf * grams


def weigh_vectors(batch: pa.RecordBatch, block: Block) -> Weighed:
    """The grams of the unit vectors ``vector(gram, w)``, as they are."""
    entries = batch["vector"].flatten()
    gram = pc.fill_null(pc.index_in(entries.field("gram").cast(pa.string()), value_set=block.grams), -1).to_numpy()
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch["vector"]).to_numpy())
    order = np.lexsort((gram, row))
    order = order[gram[order] >= 0]
    ones = np.ones(batch.num_rows)
    return row[order], gram[order], entries.field("w").to_numpy()[order], ones, ones


def best_of_blocks(
    asked: DataFrame, catalogue: Catalogue, k: int, weigh: Callable[[pa.RecordBatch, Block], Weighed], size: Column, tile_rows: int
) -> DataFrame:
    """Add to each row of ``asked``, a query, its squared length ``squares`` and ``best``: the ``k`` texts
    with the largest sums of products and those that may tie with them once similarities are rounded.

    The queries stay where they are; ``weigh`` reads them there. Every block of about ``tile_rows`` rows of the
    catalogue's vectors goes to all tasks, one block at a time, and what was found before is carried along.
    Tasks work on queries of ``PORTION`` characters, by ``size``, at once.
    """
    blocks = max(1, -(-catalogue.vectors.count() // tile_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    held = lookup(catalogue.vectors, catalogue.idf.select("gram", "idf"), ["gram"], "inner").withColumn("block", block)
    if blocks == 1:
        held, top_idf = held.withColumn("first", F.lit(0)), None
    else:
        firsts = held.groupBy("gram").agg(F.min("block").alias("first"))
        held, top_idf = cut(lookup(held, firsts, ["gram"], "inner").orderBy("block")), catalogue.idf.agg(F.max("idf")).first()[0]

    def meet(done: DataFrame, number: int) -> tuple[DataFrame, Broadcast]:
        texts = catalogue.texts.filter(block == number).select("id", "text").toArrow()
        rows = held.filter(F.col("block") == number).toArrow()
        shared = done.sparkSession.sparkContext.broadcast(Block(rows, texts, number, top_idf))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                portion = np.cumsum(batch["_size"].to_numpy()) // PORTION
                borders = np.flatnonzero(np.diff(portion, prepend=-1, append=portion[-1] + 1 if len(portion) else -1))
                for first, last in pairwise(borders.tolist()):
                    some = batch.slice(first, last - first)
                    row, gram, w, squares, most = weigh(some, shared.value)
                    ends = np.searchsorted(row, np.arange(some.num_rows), "right")
                    best = shared.value.best(ends, gram, w, SLACK * most, k, some["best"])
                    some = some.set_column(some.schema.get_field_index("squares"), "squares", pa.array(squares))
                    yield some.set_column(some.schema.get_field_index("best"), "best", best)

        return done.mapInArrow(run, done.schema), shared

    done = asked.withColumns({"_size": size.cast("long"), "squares": F.lit(0.0), "best": F.array().cast(FOUND)})
    for number in range(blocks - 1):
        found, shared = meet(done, number)
        stored = cut(found)
        shared.destroy()
        if number:
            remove_table(done)
        done = stored
    return meet(done, blocks - 1)[0].drop("_size")


def best_of_tiles(vectors: DataFrame, catalogue: Catalogue, k: int, *, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(query, match, similarity) of all pairs that may be among a query's ``k`` best, as sums over all grams,
    for queries given as unit vectors ``vectors(query, gram, w)``."""
    packed = vectors.groupBy("query").agg(F.collect_list(F.struct("gram", "w")).alias("vector"))
    best = best_of_blocks(packed, catalogue, k, weigh_vectors, F.size("vector"), tile_rows)
    pairs = best.select("query", F.explode("best").alias("_m"))
    similarity = F.round("_m.similarity", SIMILARITY_DIGITS).alias("similarity")
    return pairs.select("query", "_m.match", similarity).filter("similarity > 0")


def nearest(queries: DataFrame, catalogue: Catalogue, *, k: int = 1, text: str = "query", tile_rows: int = TILE_ROWS) -> DataFrame:
    """The ``k`` catalogue texts most similar to each distinct query text.

    Returns (query, slot, match, similarity). Texts that share no gram with the query
    have similarity 0 and fill the places left, in alphabetical order: at most k - 1 of the
    first 2k - 1 texts are taken already, so these are always enough.

    Only the distinct texts are shuffled and stored.
    """
    wanted = cut(queries.select(F.col(text).alias("query")).filter(F.col("query").isNotNull()).distinct(), free_shuffles=True)
    tasks = wanted.sparkSession.sparkContext.defaultParallelism
    if wanted.rdd.getNumPartitions() < tasks:  # The table is small then: Spark cuts larger ones for all tasks.
        wanted = wanted.repartition(2 * tasks)
    found = best_of_blocks(wanted, catalogue, k, weigh_texts, F.length("query"), tile_rows)
    first = catalogue.texts.select("text").orderBy("text").limit(2 * k - 1)
    head = first.agg(F.array_sort(F.collect_list("text"))).scalar()
    rounded = lambda m: F.round(m["similarity"] / F.sqrt("squares"), SIMILARITY_DIGITS)
    similar = F.transform("best", lambda m: F.struct((-rounded(m)).alias("order"), m["text"].alias("match"), rounded(m).alias("similarity")))
    taken = F.slice(F.array_sort(F.filter(similar, lambda m: m["similarity"] > 0)), F.lit(1), F.lit(k))
    free = F.slice(F.array_except("_head", "_taken.match"), F.lit(1), k - F.size("_taken"))
    filler = F.transform(free, lambda t: F.struct(F.lit(0.0).alias("order"), t.alias("match"), F.lit(0.0).alias("similarity")))
    return (
        found.select("query", taken.alias("_taken"), head.alias("_head"))
        .select("query", F.posexplode(F.concat("_taken", filler)).alias("slot", "_m"))
        .select("query", F.col("slot").cast("long").alias("slot"), "_m.match", "_m.similarity")
    )


def nearest_flags(chunks: DataFrame, catalogue: Catalogue, *, k: int = 5) -> DataFrame:
    """Add ``nn_correct`` and ``nn_topk_correct``: is the label text among the nearest
    known actions of the predicted text? Each distinct predicted text is searched once."""
    listed = (
        nearest(chunks, catalogue, k=k, text="pred_text")
        .groupBy(F.col("query").alias("pred_text"))
        .agg(F.array_sort(F.collect_list(F.struct("slot", "match"))).alias("_l"))
        .select("pred_text", F.col("_l.match").alias("_matches"))
    )
    flagged = lookup(chunks, listed, ["pred_text"])
    gold = F.col("label_text")
    return flagged.select(
        *chunks.columns,
        F.coalesce(F.get("_matches", F.lit(0)) == gold, F.lit(False)).cast("int").alias("nn_correct"),
        F.coalesce(F.array_contains("_matches", gold), F.lit(False)).cast("int").alias("nn_topk_correct"),
    )
