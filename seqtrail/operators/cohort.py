"""Index orders, matched control anchors and the log windows before both.

Tables: ``orders(idx, user_id, order_us, ...)``; ``log(event_id, user_id, us, metric,
action, ...)``; ``controls(idx, user_id, anchor_id, anchor_us[, control_idx])``;
``windows(idx, kind, control_idx, end_us, <log columns>)``. Times are epoch microseconds.
A case window has ``control_idx`` 0, control windows 1..M.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtrail.functions.hashing import hash_text
from seqtrail.functions.numbers import int_div
from seqtrail.functions.ordered import order_rows, running_total
from seqtrail.functions.storage import cut
from seqtrail.functions.timing import DAY, MINUTE

DEFAULT_LOOK_BACK = 30 * MINUTE
DEFAULT_BUFFER = 60 * MINUTE
DEFAULT_TOLERANCE = 1 * MINUTE
#: Places of a user that are looked through at a time for anchors that can be drawn.
SAMPLE_BLOCK = 4096


def exclude_orders(orders: DataFrame, excluded: Sequence[int]) -> DataFrame:
    """Drop listed orders."""
    return orders.filter(~F.col("idx").isin(list(excluded))) if excluded else orders


def keep_provider_type(orders: DataFrame, provider_type: str | None) -> DataFrame:
    """Orders of one provider type; None or 'All' keeps every order."""
    if provider_type in (None, "All"):
        return orders
    return orders.filter(F.col("prov_type") == provider_type)


#: Log rows to a block, the unit in which windows meet the log.
BLOCK_ROWS = 256


def sweep(windows: DataFrame, log: DataFrame, look_back: int) -> tuple[DataFrame, DataFrame]:
    """Place each user's log rows, and the windows ``[end_us - look_back, end_us)``, on one axis.

    The edges of the windows are sorted into the log, each before the rows of its instant, and
    the rows are counted along the way, in slices of (user, time) that may end anywhere. Returns
    the log rows with their place ``_at`` (0, 1, ... per user) and the non-empty windows with
    the places they hold, ``_low`` up to but not ``_high``. Windows must be distinct.
    """
    others = [c for c in windows.columns if c != "user_id"]
    edges = windows.select(
        "user_id", F.struct(*others).alias("_w"), F.explode(F.array(F.col("end_us") - look_back, F.col("end_us"))).alias("_us"),
        F.lit(0).alias("_n"),
    )
    rows = log.select("user_id", F.struct(*[c for c in log.columns if c != "user_id"]).alias("_row"), F.col("us").alias("_us"), F.lit(1).alias("_n"))
    placed = running_total(
        rows.unionByName(edges, allowMissingColumns=True), ["user_id"], ["_us", "_n"], F.col("_n"), "_seen"
    )
    held = placed.filter("_n = 0").groupBy("user_id", "_w").agg(F.min("_seen").alias("_low"), F.max("_seen").alias("_high"))
    return (
        placed.filter("_n = 1").select("user_id", "_row.*", (F.col("_seen") - 1).alias("_at")),
        held.filter("_low < _high").select("user_id", "_w.*", "_low", "_high"),
    )


def window_rows(
    windows: DataFrame, log: DataFrame, *, look_back: int = DEFAULT_LOOK_BACK, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Log rows of each window's user in ``[end_us - look_back, end_us)``.

    A user's log may be huge, so user alone is no join key. After a sweep over both, a window
    is a run of places in its user's log, and meets it on (user, block of ``block_rows``
    places): every block holds as many rows, however busy an instant is, every row lies in one
    block, and a window is repeated no more than once for each block that it holds rows of.
    """
    rows, held = sweep(windows, log, look_back)
    blocks = F.sequence(int_div(F.col("_low"), block_rows), int_div(F.col("_high") - 1, block_rows))
    return (
        held.withColumn("_block", F.explode(blocks))
        .join(rows.withColumn("_block", int_div(F.col("_at"), block_rows)), ["user_id", "_block"])
        .filter("_at >= _low and _at < _high")
        .drop("_block", "_low", "_high", "_at")
    )


def case_windows(
    orders: DataFrame, log: DataFrame, *, look_back: int = DEFAULT_LOOK_BACK, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The log rows before each index order."""
    return window_rows(_case_ends(orders), log, look_back=look_back, block_rows=block_rows)


def _case_ends(orders: DataFrame) -> DataFrame:
    return orders.select(
        "idx",
        "user_id",
        F.lit("case").alias("kind"),
        F.lit(0).cast("long").alias("control_idx"),
        F.col("order_us").alias("end_us"),
    )


def first_and_last(log: DataFrame, look_back: int) -> DataFrame:
    """Per user and time bin of ``look_back``: earliest row of the bin, latest row of the bin before.

    A window reaches from its own bin into the one before, so these two tell whether it holds
    a row at all.
    """
    bins = log.groupBy("user_id", int_div(F.col("us"), look_back).alias("_bin")).agg(
        F.min("us").alias("low"), F.max("us").alias("high")
    )
    none = F.lit(None).cast("long")
    told = F.array(
        F.struct(F.col("_bin").alias("bin"), F.col("low").alias("low"), none.alias("high")),
        F.struct((F.col("_bin") + 1).alias("bin"), none.alias("low"), F.col("high").alias("high")),
    )
    return (
        bins.select("user_id", F.explode(told).alias("r"))
        .groupBy("user_id", F.col("r.bin").alias("_bin"))
        .agg(F.min("r.low").alias("low"), F.max("r.high").alias("high"))
    )


def with_rows_flag(ends: DataFrame, end: str, log: DataFrame, look_back: int) -> DataFrame:
    """Add ``has_rows``: does the look-back window before the time ``end`` hold any log row?"""
    filled = F.coalesce(F.col("low") < F.col(end), F.lit(False)) | F.coalesce(
        F.col("high") >= F.col(end) - look_back, F.lit(False)
    )
    met = ends.withColumn("_bin", int_div(F.col(end), look_back)).join(first_and_last(log, look_back), ["user_id", "_bin"], "left")
    return met.select(*ends.columns, filled.alias("has_rows"))


def orders_with_rows(orders: DataFrame, log: DataFrame, *, look_back: int = DEFAULT_LOOK_BACK) -> DataFrame:
    """The ``idx`` of the orders whose case window holds a row, found without joining rows."""
    return with_rows_flag(orders.select("idx", "user_id", "order_us"), "order_us", log, look_back).filter("has_rows").select("idx")


def describe_anchors(
    orders: DataFrame,
    log: DataFrame,
    *,
    anchor_metric: str | int,
    look_back: int = DEFAULT_LOOK_BACK,
    tolerance: int = DEFAULT_TOLERANCE,
) -> DataFrame:
    """All anchor events with what later steps ask about each of them, found once.

    ``near_first`` and ``near_last`` are the smallest and largest ``idx`` of the user's
    orders within ``tolerance``; ``has_rows`` tells whether the look-back window before
    the anchor holds any log row. Both come from small per-bin tables.
    """
    anchors = log.filter(F.col("metric") == anchor_metric).select(
        "user_id", F.col("event_id").alias("anchor_id"), F.col("us").alias("anchor_us")
    )

    near_width = 2 * tolerance + 1
    order_us = F.col("order_us")
    near_orders = orders.select(
        "user_id",
        F.col("idx").alias("near_idx"),
        "order_us",
        F.explode(
            F.sequence(
                int_div(order_us - tolerance, near_width), int_div(order_us + tolerance, near_width)
            )
        ).alias("_bin"),
    )
    near = (
        anchors.withColumn("_bin", int_div(F.col("anchor_us"), near_width))
        .join(near_orders, ["user_id", "_bin"])
        .filter(F.abs(F.col("anchor_us") - order_us) <= tolerance)
        .groupBy("anchor_id")
        .agg(F.min("near_idx").alias("near_first"), F.max("near_idx").alias("near_last"))
    )

    return with_rows_flag(anchors.join(near, "anchor_id", "left"), "anchor_us", log, look_back).select(
        "user_id", "anchor_id", "anchor_us", "near_first", "near_last", "has_rows"
    )


def control_anchors(
    orders: DataFrame,
    log: DataFrame,
    *,
    anchor_metric: str | int,
    look_back: int = DEFAULT_LOOK_BACK,
    buffer: int = DEFAULT_BUFFER,
    tolerance: int = DEFAULT_TOLERANCE,
    bin_width: int = DAY,
) -> DataFrame:
    """For each order the user's earlier anchors that are no other order of theirs.

    An anchor counts if it lies before ``order_us - buffer`` and no *other* order of the
    user lies within ``tolerance`` of it. Orders meet anchors on (user, day), so a busy
    user is spread over as many tasks as their log has days.
    """
    anchors = describe_anchors(
        orders, log, anchor_metric=anchor_metric, look_back=look_back, tolerance=tolerance
    )
    first = (
        log.filter(F.col("metric") == anchor_metric)
        .groupBy("user_id")
        .agg(F.min("us").alias("first_us"))
    )
    limit = F.col("order_us") - buffer
    reaching = (
        orders.select("idx", "user_id", "order_us")
        .join(first, "user_id")
        .filter(F.col("first_us") < limit)
        .withColumn(
            "_bin",
            F.explode(F.sequence(int_div(F.col("first_us"), bin_width), int_div(limit - 1, bin_width))),
        )
        .drop("first_us")
    )
    other_near = F.coalesce(
        (F.col("near_first") != F.col("idx")) | (F.col("near_last") != F.col("idx")), F.lit(False)
    )
    return (
        reaching.join(
            anchors.withColumn("_bin", int_div(F.col("anchor_us"), bin_width)), ["user_id", "_bin"]
        )
        .filter((F.col("anchor_us") < limit) & ~other_near)
        .select("idx", "user_id", "anchor_id", "anchor_us", "has_rows")
    )


def anchor_draw(seed: int) -> Column:
    """The place of an anchor in the drawing order; it depends on the anchor alone."""
    return hash_text(seed, F.col("anchor_id").cast("string"))


def sample_anchors(controls: DataFrame, n: int | None, *, seed: int, apart: bool = False) -> DataFrame:
    """R2: at most ``n`` of the given anchors per order, the first ones in the drawing order.

    Each order's sample is uniform. With ``apart`` every order draws for itself, by a hash of
    order and anchor; without, orders that share anchors tend to share drawn ones too.
    """
    if n is None:
        return controls
    own = hash_text(seed, F.col("idx").cast("string"), F.col("anchor_id").cast("string"))
    return _first_drawn(controls.withColumn("_draw", own if apart else anchor_draw(seed)), n)


def _first_drawn(candidates: DataFrame, n: int) -> DataFrame:
    window = Window.partitionBy("idx").orderBy("_draw", "anchor_id")
    return candidates.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_draw", "_rank")


def _free_and_own(anchors: DataFrame, orders: DataFrame, buffer: int) -> tuple[DataFrame, DataFrame]:
    """Anchors near no order, which count for all later orders of the user, and those near a
    single order, with that order if it is late enough. An anchor is in at most one row."""
    own = (
        anchors.filter("near_first = near_last")
        .join(orders.select(F.col("idx").alias("near_first"), "order_us"), "near_first")
        .filter(F.col("anchor_us") < F.col("order_us") - buffer)
        .withColumnRenamed("near_first", "idx")
    )
    columns = ["user_id", "anchor_id", "anchor_us", "has_rows"]
    return anchors.filter("near_first is null and user_id is not null").select(*columns), own.select("idx", *columns)


def _ever_among_first(numbered: DataFrame, n: int, width: int) -> DataFrame:
    """Rows that are among the ``n`` first drawn of their block's rows up to them, by ``pos``.

    A block are ``width`` places of a user; what fails this fails it among all rows of the user, too.
    """
    names = [*numbered.columns, "_block"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, []
        for batch in batches:
            stays = np.zeros(batch.num_rows, bool)
            columns = [batch.column(names.index(c)).to_pylist() for c in ("user_id", "_block", "_draw", "anchor_id")]
            for i, (user, block, draw, anchor) in enumerate(zip(*columns, strict=True)):
                if (user, block) != at:
                    at, first = (user, block), []
                if len(first) < n or (draw, anchor) < first[-1]:
                    insort(first, (draw, anchor))
                    del first[n:]
                    stays[i] = True
            yield batch.filter(pa.array(stays))

    blocks = numbered.withColumn("_block", int_div(F.col("pos"), width)).repartition("user_id", "_block")
    kept = blocks.sortWithinPartitions("user_id", "_block", "pos")
    return kept.mapInArrow(keep, kept.schema).drop("_block")


def drawable(free: DataFrame, n: int, *, block_rows: int = SAMPLE_BLOCK) -> DataFrame:
    """The anchors that any order can draw: those among the user's ``n`` first drawn when they come.

    Whatever an order's limit, the ``n`` first drawn of the anchors before it were among the
    ``n`` first drawn at their own time. Of m anchors about n (1 + ln(m / n)) are, however
    many m is. They are found in blocks of ``block_rows`` places, then in ``block_rows``
    times larger blocks of what is left, until a block holds a whole user.
    """
    longest = free.groupBy("user_id").count().agg(F.max("count")).first()[0] or 0
    left = order_rows(free, ["user_id"], ["anchor_us", "anchor_id"])
    step = width = max(block_rows, 2 * n)
    while True:
        left = _ever_among_first(left, n, width)
        if width >= longest:
            return left
        width *= step


def sampled_anchors(
    orders: DataFrame,
    log: DataFrame,
    n: int,
    *,
    seed: int,
    anchor_metric: str | int,
    look_back: int = DEFAULT_LOOK_BACK,
    buffer: int = DEFAULT_BUFFER,
    tolerance: int = DEFAULT_TOLERANCE,
    block_rows: int = SAMPLE_BLOCK,
) -> DataFrame:
    """``sample_anchors`` of ``control_anchors``, without making all pairs of them.

    Only for draws by the anchor alone. An order meets only the ``drawable`` anchors of its user, whose number grows with the
    logarithm of the user's anchors, and the anchors near itself.
    """
    anchors = cut(describe_anchors(orders, log, anchor_metric=anchor_metric, look_back=look_back, tolerance=tolerance))
    free, own = _free_and_own(anchors, orders, buffer)
    limits = orders.select("idx", "user_id", (F.col("order_us") - buffer).alias("_limit"))
    few = drawable(free.withColumn("_draw", anchor_draw(seed)), n, block_rows=block_rows)
    columns = ["idx", "user_id", "anchor_id", "anchor_us", "has_rows", "_draw"]
    met = limits.join(few, "user_id").filter(F.col("anchor_us") < F.col("_limit")).select(*columns)
    return _first_drawn(met.unionByName(own.withColumn("_draw", anchor_draw(seed)).select(*columns)), n)


def latest_controls(
    orders: DataFrame,
    log: DataFrame,
    n: int,
    *,
    anchor_metric: str | int,
    look_back: int = DEFAULT_LOOK_BACK,
    buffer: int = DEFAULT_BUFFER,
    tolerance: int = DEFAULT_TOLERANCE,
) -> DataFrame:
    """``recent_controls`` of all numbered controls, without making all of them.

    The user's anchors with a window and the orders' limits are sorted into each other. The
    anchors passed on the way number the controls, and an order meets only the ``n`` places
    before its limit, by equality, and the anchors near itself.
    """
    anchors = cut(describe_anchors(orders, log, anchor_metric=anchor_metric, look_back=look_back, tolerance=tolerance))
    free, own = (x.filter("has_rows") for x in _free_and_own(anchors, orders, buffer))
    found = free.select("user_id", F.col("anchor_us").alias("us"), F.lit(1).alias("is_anchor"), "anchor_id")
    limits = orders.filter("user_id is not null").select("user_id", (F.col("order_us") - buffer).alias("us"), F.lit(0).alias("is_anchor"), "idx")
    # At its limit an order comes before the anchors, which must lie before it.
    passed = running_total(
        found.unionByName(limits, allowMissingColumns=True), ["user_id"], ["us", "is_anchor", "anchor_id", "idx"], F.col("is_anchor"), "_seen"
    )
    places = passed.filter("is_anchor = 1").select("user_id", "anchor_id", F.col("us").alias("anchor_us"), (F.col("_seen") - 1).alias("_place"))
    before = passed.filter("is_anchor = 0").select("idx", "user_id", F.col("_seen").alias("_free"))
    last = F.explode(F.sequence(F.greatest(F.col("_free") - n, F.lit(0)), F.col("_free") - 1))
    met = before.filter("_free > 0").withColumn("_place", last).join(places, ["user_id", "_place"])
    by_time = Window.partitionBy("idx").orderBy(F.desc("anchor_us"), F.desc("anchor_id"))
    columns = ["idx", "user_id", "anchor_id", "anchor_us"]
    latest_own = own.withColumn("_rank", F.row_number().over(by_time)).filter(F.col("_rank") <= n)
    ranked = (
        met.select(*columns)
        .unionByName(latest_own.select(*columns))
        .withColumn("_rank", F.row_number().over(by_time))
        .filter(F.col("_rank") <= n)
    )
    totals = before.select("idx", "_free").join(own.groupBy("idx").agg(F.count(F.lit(1)).alias("_own")), "idx", "left")
    number = (F.col("_free") + F.coalesce("_own", F.lit(0)) - F.col("_rank") + 1).alias("control_idx")
    return ranked.join(totals, "idx").select(*columns, number)


def number_controls(controls: DataFrame) -> DataFrame:
    """Number the anchors with a non-empty window 1..M per order, in time order."""
    filled = controls.filter("has_rows").drop("has_rows")
    numbered = order_rows(
        filled, ["idx"], ["anchor_us", "anchor_id"], pos="control_idx"
    )
    return numbered.withColumn("control_idx", F.col("control_idx") + 1)


def recent_controls(controls: DataFrame, n: int | None) -> DataFrame:
    """The ``n`` latest numbered controls of each order."""
    if n is None:
        return controls
    window = Window.partitionBy("idx").orderBy(F.desc("control_idx"))
    return (
        controls.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )


def _anchor_ends(controls: DataFrame) -> DataFrame:
    return controls.select("anchor_id", "user_id", F.col("anchor_us").alias("end_us")).distinct()


def control_windows(
    controls: DataFrame, log: DataFrame, *, look_back: int = DEFAULT_LOOK_BACK, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The log rows before each numbered control anchor.

    A window's rows depend on the anchor alone, so each distinct anchor meets the log
    once; the orders that it is a control of are joined to its rows by equality.
    """
    rows = window_rows(_anchor_ends(controls), log, look_back=look_back, block_rows=block_rows)
    owners = controls.select("anchor_id", "idx", F.lit("control").alias("kind"), "control_idx")
    return owners.join(rows, "anchor_id").drop("anchor_id")


def paired_orders(cases: DataFrame, controls: DataFrame) -> DataFrame:
    """Orders with at least one case row and one control row."""
    return cases.select("idx").distinct().join(controls.select("idx").distinct(), "idx", "left_semi")


def extract_cohort(
    orders: DataFrame,
    log: DataFrame,
    *,
    anchor_metric: str | int,
    look_back: int = DEFAULT_LOOK_BACK,
    buffer: int = DEFAULT_BUFFER,
    tolerance: int = DEFAULT_TOLERANCE,
    sample_n: int | None = None,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """All windows (U1: cases and controls in one table) and the numbered controls."""
    matching = {"anchor_metric": anchor_metric, "look_back": look_back, "buffer": buffer, "tolerance": tolerance}
    anchors = sample_anchors(control_anchors(orders, log, **matching), sample_n, seed=seed, apart=True)
    # Stored, as they are read for the windows' ends, their owners and the caller.
    controls = cut(number_controls(anchors))
    # Both kinds of windows meet the log in one sweep; who owns a window is joined after.
    case, control = F.lit("case"), F.lit("control")
    cases = _case_ends(orders)
    ends = cases.select("user_id", "end_us", case.alias("_of"), F.col("idx").alias("_id")).unionByName(
        _anchor_ends(controls).select("user_id", "end_us", control.alias("_of"), F.col("anchor_id").alias("_id"))
    )
    owners = cases.select(case.alias("_of"), F.col("idx").alias("_id"), "idx", "kind", "control_idx").unionByName(
        controls.select(control.alias("_of"), F.col("anchor_id").alias("_id"), "idx", control.alias("kind"), "control_idx")
    )
    rows = window_rows(ends, log, look_back=look_back)
    return owners.join(rows, ["_of", "_id"]).drop("_of", "_id"), controls


def cohort_report(orders: DataFrame, log: DataFrame, cases: DataFrame, controls: DataFrame) -> DataFrame:
    """One row of coverage counts of an extraction."""
    users = log.select("user_id").distinct().withColumn("found", F.lit(1))
    with_case = cases.select("idx").distinct().withColumn("has_case", F.lit(1))
    per_order = controls.groupBy("idx").agg(F.count(F.lit(1)).alias("n_controls"))
    per_user = orders.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_user_orders"))
    return (
        orders.join(users, "user_id", "left")
        .join(per_user, "user_id")
        .join(with_case, "idx", "left")
        .join(per_order, "idx", "left")
        .agg(
            F.count(F.lit(1)).alias("n_orders"),
            F.count("found").alias("n_with_logs"),
            F.sum(F.col("found").isNull().cast("long")).alias("n_without_logs"),
            F.count("has_case").alias("n_with_case_rows"),
            F.sum((F.col("n_user_orders") > 1).cast("long")).alias("n_of_repeat_users"),
            F.sum(F.coalesce("n_controls", F.lit(0))).alias("n_controls"),
        )
    )
