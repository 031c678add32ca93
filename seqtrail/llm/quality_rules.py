"""Quality rules whose cutoffs bound, with confidence, how many good texts they reject."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtrail.llm.common import BLANKS, cut

#: Largest share of good texts that all rules together may reject in a stratum, and the
#: probability that this is exceeded in any stratum.
RISK = 0.02
ERROR = 0.05
MIN_WORDS = 50

#: Rules: a score that is higher for worse texts, from the base counts, and its cutoffs.
RULES: dict[str, tuple[str, Sequence[float]]] = {
    "symbols": ("n_symbols / nullif(n_words, 0)", (0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5, 0.8)),
    "repeats": ("n_repeat_words / nullif(n_words, 0)", (0.05, 0.08, 0.12, 0.16, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45)),
    "lines": ("n_dup_lines / (n_dup_lines + 5)", (0.16, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)),
    "long_words": ("word_chars / nullif(n_words, 0)", (5.0, 5.5, 6.0, 6.5, 7.0, 8.0, 9.0, 11.0, 15.0)),
    "short_words": ("-word_chars / nullif(n_words, 0)", (-5.0, -4.5, -4.0, -3.5, -3.0, -2.5, -2.0)),
    "shouts": ("n_shouts / nullif(n_words, 0)", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8)),
}


def base_counts(text: Column) -> dict[str, Column]:
    """The counts that need no list of words."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def count_of(chars: str) -> Column:
        return (F.length(body) - F.length(F.regexp_replace(body, chars, ""))).cast("long")

    return {
        "word_chars": F.length(F.regexp_replace(body, BLANKS, "")).cast("long"),
        "n_symbols": count_of(r"[#*$%&|<>]"),
        "n_shouts": count_of("!"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def repeat_words(words: str) -> Column:
    """Words inside 3-word windows that occur twice or more, from an array column of words.

    Windows are told apart by a 64-bit hash. Most texts repeat none, which the number of
    distinct hashes shows; else (hash, place) pairs are sorted so that equal windows lie side
    by side, and the places of those that have an equal neighbour cover their words.
    """
    return F.expr(
        f"""
        CASE WHEN size({words}) < 3 THEN 0L ELSE
          aggregate(
            array(transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2]))),
            0L,
            (none, h) -> CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
              aggregate(
                array(sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))),
                0L,
                (nothing, s) -> aggregate(
                  sort_array(transform(
                    filter(s, (e, k) -> (k > 0 AND s[greatest(k - 1, 0)].x = e.x)
                      OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].x = e.x)),
                    e -> e.i)),
                  struct(0L AS n, -3 AS last),
                  (acc, at) -> struct(acc.n + least(3, at - acc.last) AS n, at AS last),
                  acc -> acc.n))
            END)
        END
        """
    )


def base(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: Column | None = None) -> DataFrame:
    """doc_id, stratum and the base counts of every row, with base_failed.

    Null text counts as empty; repeated rows and null ids stay; other columns are ignored.
    """
    strata = F.coalesce(stratum.cast("string"), F.lit("")) if stratum is not None else F.lit("")
    split = docs.select(
        F.col(doc_id).alias("doc_id"),
        strata.alias("stratum"),
        F.col(text).alias("text"),
        F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BLANKS), "").alias("words"),
    )
    counted = split.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        *[c.alias(name) for name, c in base_counts(F.col("text")).items()],
        repeat_words("words").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series from 16 on, below that from the factorials themselves."""
    x = n.cast("double")
    series = (
        x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    )
    return F.when(n < 16, F.log(F.factorial(F.least(n, F.lit(16)).cast("int")).cast("double"))).otherwise(series)


def most_rejections(sizes: DataFrame, risk: float, error: Column | float) -> DataFrame:
    """``sizes`` (stratum, n) with ``allowed``: the most rejections among n that still prove the risk.

    With so many or fewer, the exact one-sided (Clopper-Pearson) upper bound at the given error
    probability is at most ``risk``: P(Binomial(n, risk) <= allowed) <= error. Null if
    even none would not do. Terms farther than 14 standard deviations below the mean are
    beyond the precision of a double and are left out.
    """
    mean = F.col("n") * risk
    low = F.greatest(F.lit(0), F.floor(mean - 14 * F.sqrt(mean * (1 - risk)) - 14)).cast("long")
    term = F.exp(
        log_factorial(F.col("n")) - log_factorial(F.col("k")) - log_factorial(F.col("n") - F.col("k"))
        + F.col("k") * F.log(F.lit(risk)) + (F.col("n") - F.col("k")) * F.log(F.lit(1 - risk))
    )
    up_to = Window.partitionBy("stratum").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    proven = (
        sizes.select("stratum", "n", F.explode(F.sequence(low, F.floor(mean).cast("long"))).alias("k"))
        .withColumn("below", F.sum(term).over(up_to))
        .filter(F.col("below") <= error)
        .groupBy("stratum")
        .agg(F.max("k").alias("allowed"))
    )
    return sizes.join(proven, "stratum", "left")


def scored(counts: DataFrame, rules: Mapping[str, tuple[str, Sequence[float]]]) -> DataFrame:
    return counts.withColumns({f"score_{name}": F.expr(f"coalesce({score}, 0D)") for name, (score, _) in rules.items()})


def choose_cutoffs(
    counts: DataFrame,
    labels: DataFrame,
    rules: Mapping[str, tuple[str, Sequence[float]]] = RULES,
    *,
    risk: float = RISK,
    error: float = ERROR,
    label: str = "quality",
    sequence: bool = False,
) -> DataFrame:
    """stratum, rule, cutoff, n_good, rejected, allowed: the strictest proven cutoff of each rule.

    The holdout of a stratum are its labelled good texts (label 1) that pass the base
    checks. The risk is shared evenly among the rules and the error probability among all
    tests, that is strata x rules x cutoffs (Bonferroni), so with probability 1 - error no
    stratum loses more than ``risk`` of its good texts to all rules together. Rules without
    a proven cutoff do not apply in that stratum. With n good texts no cutoff can be proven if
    (1 - risk / rules) ** n is above the error of a test: by default below 2,490 texts in
    each of four strata.

    With ``sequence`` the cutoffs of a rule are tested from the laxest to the strictest, up to
    the first that is not proven. They are nested, so this needs no correction over cutoffs:
    the error is shared among strata x rules, and 1,850 texts can do. ``labels`` has doc_id and the label; an id
    labelled twice counts once, as good if one label says so.
    """
    good = labels.groupBy("doc_id").agg(F.max(label).alias("good")).filter("good = 1").select("doc_id")
    holdout = scored(counts.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi"), rules)
    sizes = holdout.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    pairs = [(name, float(c)) for name, (_, cutoffs) in rules.items() for c in cutoffs]
    # A laxer cutoff rejects no more, so the strictest proven one ends the sequence.
    tests = len(rules) if sequence else sum(len(c) for _, c in rules.values())
    # One pass: a column of rejections for each rule and cutoff.
    found = holdout.groupBy("stratum").agg(
        *[F.count_if(F.col(f"score_{name}") > c).alias(f"r{i}") for i, (name, c) in enumerate(pairs)]
    )
    rejected = found.select(
        "stratum",
        F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"r{i}").alias("rejected")) for i, (n, c) in enumerate(pairs)])),
    )
    strata = sizes.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("strata"))
    # The error per test depends on the number of strata, a single row.
    allowed = most_rejections(sizes.crossJoin(F.broadcast(strata)).select("stratum", "n", "strata"), risk / len(rules), error / tests / F.col("strata"))
    return (
        rejected.join(allowed, "stratum")
        .filter(F.col("rejected") <= F.col("allowed"))
        .groupBy("stratum", "rule")
        .agg(F.min(F.struct("cutoff", "rejected", "n", "allowed")).alias("best"))
        .select("stratum", "rule", "best.cutoff", F.col("best.n").alias("n_good"), "best.rejected", "best.allowed")
    )


def path_levels(rules: Mapping[str, tuple[str, Sequence[float]]] = RULES) -> list[dict[str, float]]:
    """The cutoffs of all rules side by side, from the laxest level to the strictest.

    There are as many levels as the longest list has cutoffs; shorter lists stay at a cutoff for
    several levels. A level rejects all that the levels before it reject.
    """
    lists = {name: sorted(map(float, cutoffs), reverse=True) for name, (_, cutoffs) in rules.items()}
    levels = max(map(len, lists.values()), default=0)
    return [{name: c[len(c) * at // levels] for name, c in lists.items() if c} for at in range(levels)]


def joint_cutoffs(
    counts: DataFrame,
    labels: DataFrame,
    rules: Mapping[str, tuple[str, Sequence[float]]] = RULES,
    *,
    risk: float = RISK,
    error: float = ERROR,
    label: str = "quality",
) -> DataFrame:
    """stratum, rule, cutoff, level, n_good, rejected, allowed: the strictest proven level of all rules.

    The holdout is that of ``choose_cutoffs``. A level is proven if the good texts that any of
    its cutoffs rejects are few enough for the whole ``risk``. Levels are tested from the
    laxest on, up to the first that is not proven; each rejects what the one before it rejects,
    so this fixed sequence needs no correction over levels or rules. The error probability
    is shared among the strata (Bonferroni), so with probability 1 - error no stratum loses
    more than ``risk`` of its good texts. With n good texts no level can be proven if
    (1 - risk) ** n is above error / strata: by default below 217 texts in each of four strata,
    149 in a single one. No rule applies in a stratum without a proven level.
    """
    levels = path_levels(rules)
    good = labels.groupBy("doc_id").agg(F.max(label).alias("good")).filter("good = 1").select("doc_id")
    holdout = scored(counts.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi"), rules)

    def over(cutoffs: Mapping[str, float]) -> Column:
        return F.greatest(*[(F.col(f"score_{name}") > c).cast("int") for name, c in cutoffs.items()], F.lit(0)) > 0

    # One pass: a column of rejections for each level.
    found = holdout.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(over(c)) for c in levels]).alias("rejected")
    )
    strata = found.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("strata"))
    # The error per test depends on the number of strata, a single row.
    allowed = most_rejections(found.crossJoin(F.broadcast(strata)).select("stratum", "n", "strata"), risk, error / F.col("strata"))
    # Rejections never fall along the path, so the last proven level ends the sequence.
    proven = found.join(allowed.select("stratum", "allowed"), "stratum").withColumn(
        "level", F.size(F.filter("rejected", lambda x: x <= F.col("allowed"))) - 1
    ).filter("level >= 0")
    by_level = F.array(
        *[F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(c).alias("cutoff")) for n, c in level.items()]) for level in levels]
    )
    return proven.select(
        "stratum", "n", F.col("rejected")[F.col("level")].alias("rejected"), "allowed", "level", F.inline(by_level[F.col("level")])
    ).select("stratum", "rule", "cutoff", "level", F.col("n").alias("n_good"), "rejected", "allowed")


def apply_cutoffs(
    counts: DataFrame, cutoffs: DataFrame, rules: Mapping[str, tuple[str, Sequence[float]]] = RULES
) -> DataFrame:
    """``counts`` with ``kept``: passes the base checks and exceeds no cutoff of its stratum."""
    # Stored, so that Spark knows its size: it is broadcast if small, or else a large stratum is split.
    wide = cut(
        cutoffs.groupBy("stratum").agg(
            *[F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"cut_{name}") for name in rules]
        )
    )
    met = scored(counts, rules).join(wide, "stratum", "left")
    over = F.lit(False)
    for name in rules:
        over = over | F.coalesce(F.col(f"score_{name}") > F.col(f"cut_{name}"), F.lit(False))
    return met.select(*counts.columns, (~F.col("base_failed") & ~over).alias("kept"))


def filter_quality(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", joint: bool = True, **options
) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed and kept of every row of ``docs``.

    The cutoffs are those of ``joint_cutoffs``, or without ``joint`` those of ``choose_cutoffs``. Strata are the values of ``lang`` (null is one). Null text counts as empty and fails the
    base checks; repeated rows and null ids stay (a null id is never labelled).
    """
    counts = cut(base(docs, doc_id=doc_id, text=text, stratum=F.col(lang)))
    own = labels.select(F.col(doc_id).alias("doc_id"), *[c for c in labels.columns if c != doc_id and c != "doc_id"])
    cutoffs = (joint_cutoffs if joint else choose_cutoffs)(counts, own, **options)
    kept = apply_cutoffs(counts, cutoffs)
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


__all__ = ["filter_quality", "joint_cutoffs", "choose_cutoffs", "path_levels", "apply_cutoffs", "base", "most_rejections"]
