"""Second-level order-book states from full-book anchors and level changes.

An anchor replaces the whole book, so everything between two anchors is an
independent run. Best prices under deletions come from the lifetimes of levels
(`_fold`), not from a walk over the changes. Runs, gaps and continuity segments
follow from the anchors and gaps alone; changes look them up.

A *unit* is one product and UTC day; units do not influence each other. Neither
a unit nor a run is ever held by one task: changes are dealt by time slices,
levels by their pieces and events by short blocks, so that a task's rows are
bounded however dense a day is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import scan
from tickloom.functions.exprs import MICROS, ts_micros
from tickloom.operators.intervals import continuity_islands
from tickloom.plans.lineage import stage

UNIT = ("product_id", "source_date")
CHUNK_US = 3_600 * MICROS
#: Changes are numbered in slices of this length.
SLICE_US = 300 * MICROS
#: Rows dealt to one task, at most and (where that leaves fewer tasks than the session shuffles into) at least.
TASK_ROWS, LEAST_ROWS = 100_000, 5_000
#: A level's changes are scanned in pieces of 2**PIECE events, books are looked up in blocks of 2**BLOCK events.
PIECE, BLOCK = 12, 3

# fixed values: what marks a metadata window as unusable
GAP_STATUSES = ("gap", "excluded", "incomplete", "missing", "error")

LEVELS = "array<struct<side:string,price:decimal(18,8),quantity:decimal(18,8)>>"


def unusable_window() -> Column:
    """Whether a replay-metadata row describes a gap."""
    return F.lower(F.coalesce("status", F.lit(""))).isin(*GAP_STATUSES) | (
        F.coalesce("gap_count", F.lit(0)) > 0
    )


def gap_intervals(metadata: DataFrame) -> DataFrame:
    """Gap rows as `[start, end)` timestamps."""
    return metadata.where(unusable_window()).select(
        *[name for name in UNIT if name in metadata.columns],
        F.col("window_start").alias("start"),
        F.col("window_end").alias("end"),
    )


def load_replay_rows(
    days: DataFrame, anchors: DataFrame, checkpoints: DataFrame, deltas: DataFrame, metadata: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What each requested product-day needs: its anchors, its deltas, its overlapping metadata.

    `days` has product_id and source_date. The opening anchor is the latest one at
    or before midnight; anchors and hourly checkpoints inside the day follow, and
    of several in one second only the highest sequence is kept.
    """
    bounds = days.select(
        "product_id", F.col("source_date").cast("string").alias("source_date")
    ).distinct().withColumns(
        {
            "day_start": F.col("source_date").cast("date").cast("timestamp"),
            "day_end": F.col("source_date").cast("date").cast("timestamp")
            + F.expr("INTERVAL '23:59:59' HOUR TO SECOND"),
        }
    )
    day_of = lambda name: F.date_format(name, "yyyy-MM-dd")
    fields = ["anchor_second", "source_sequence_num", "best_bid", "best_ask", "bid_book", "ask_book"]
    unit = list(UNIT)

    def in_day(df: DataFrame, at: str) -> DataFrame:
        dated = df.withColumn("source_date", day_of(at))
        return dated.join(bounds, unit, "left_semi").where(
            F.date_trunc("day", at) + F.expr("INTERVAL '23:59:59' HOUR TO SECOND") >= F.col(at)
        )

    daily = in_day(anchors, "anchor_second").select(*unit, *fields)
    hourly = in_day(
        checkpoints.withColumnRenamed("checkpoint_hour", "anchor_second"), "anchor_second"
    ).select(*unit, *fields)
    # opening anchor: an as-of join on time, ties to the highest sequence
    opening = (
        scan.asof_backward(
            bounds,
            anchors,
            ["product_id"],
            F.unix_micros("day_start"),
            F.unix_micros("anchor_second"),
            {name: F.col(name) for name in fields},
            24 * CHUNK_US,
            right_tie=F.col("source_sequence_num"),
        )
        .where(F.col("anchor_second").isNotNull())
        .select(*unit, *fields)
    )
    everything = opening.unionByName(daily).unionByName(hourly)
    kept = (
        everything.groupBy(*unit, "anchor_second")
        .agg(F.max_by(F.struct(*fields), F.col("source_sequence_num")).alias("row"))
        .select(*unit, "row.*")
    )
    day_deltas = in_day(deltas, "changed_second")
    # a window overlapping several days is copied to each of them
    covered = metadata.withColumn(
        "source_date",
        F.explode(
            F.transform(
                F.sequence(F.to_date("window_start"), F.greatest(F.to_date("window_end"), F.to_date("window_start"))),
                lambda day: F.date_format(day, "yyyy-MM-dd"),
            )
        ),
    ).join(bounds, unit, "left_semi")
    return kept, day_deltas, covered


def _whole_seconds(at: Column) -> Column:
    return F.ceil(at / F.lit(MICROS)) * F.lit(MICROS)


_ANCHOR, _DELTA, _GAP = 0, 1, -1


def _dealt(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """Deal by `columns` to as many tasks as `rows` need; sizes in bytes would not tell, as rows multiply after it."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(max(min(usual, -(-rows // LEAST_ROWS)), -(-rows // TASK_ROWS), 1), *columns)


def _timeline(anchors: DataFrame, deltas: DataFrame, metadata: DataFrame, days: DataFrame) -> DataFrame:
    """All events of each unit on one timeline, placed in runs and segments.

    Anchors and gaps are placed by running aggregates over a unit's marks. What a change takes from them never falls
    in time, so it is the greatest value of the marks up to it: those of its time slice and of the slices before.
    """
    unit = list(UNIT)
    entries = lambda book, side: F.transform(
        F.map_entries(book),
        lambda e: F.struct(F.lit(side).alias("side"), e["key"].alias("price"), e["value"].alias("quantity")),
    )
    no_book = [
        F.lit(None).cast("decimal(18,8)").alias("best_bid"), F.lit(None).cast("decimal(18,8)").alias("best_ask"),
        F.lit(None).cast(LEVELS).alias("levels"),
    ]
    anchor_rows = anchors.select(
        *unit, ts_micros("anchor_second").alias("at_us"), F.lit(_ANCHOR).alias("kind"),
        F.col("source_sequence_num").alias("sequence_start"), F.col("source_sequence_num").alias("sequence_end"),
        "best_bid", "best_ask",
        F.concat(entries("bid_book", "bid"), entries("ask_book", "offer")).cast(LEVELS).alias("levels"),
        F.lit(None).cast("bigint").alias("until_us"),
    )
    delta_rows = deltas.select(
        *unit, ts_micros("changed_second").alias("at_us"), F.lit(_DELTA).alias("kind"),
        F.col("source_sequence_num_start").alias("sequence_start"),
        F.col("source_sequence_num_end").alias("sequence_end"),
        "best_bid", "best_ask", F.col("changes").cast(LEVELS).alias("levels"),
        F.lit(None).cast("bigint").alias("until_us"),
    )
    nothing = F.lit(None).cast("bigint")
    gap_rows = metadata.where(unusable_window()).select(
        *unit, ts_micros("window_start").alias("at_us"), F.lit(_GAP).alias("kind"),
        nothing.alias("sequence_start"), nothing.alias("sequence_end"), *no_book,
        ts_micros("window_end").alias("until_us"),
    )
    span = days.select(
        *unit, ts_micros("day_start").alias("start_us"), ts_micros("day_end").alias("final_us")
    )
    # a unit without any event still has to report its missing anchor
    bounds = span.select(
        *unit, F.col("start_us").alias("at_us"), F.lit(_GAP).alias("kind"), nothing.alias("sequence_start"),
        nothing.alias("sequence_end"), *no_book, nothing.alias("until_us"),
    )
    rows = anchor_rows.unionByName(gap_rows).unionByName(bounds).join(span, unit)

    whole = Window.partitionBy(*unit)
    is_anchor, is_gap = (F.col("kind") == k for k in (_ANCHOR, _GAP))
    rows = rows.withColumns(
        {
            "open_us": F.max(F.when(is_anchor & (F.col("at_us") <= F.col("start_us")), F.col("at_us"))).over(whole),
            "regressed": is_gap & (F.col("until_us") < F.col("at_us")),
        }
    )
    open_us, final_us = F.col("open_us"), F.col("final_us")
    # gaps act on whole seconds between the opening anchor and the end of the day
    rows = rows.withColumns(
        {
            "at_us": F.when(
                is_gap & F.col("until_us").isNotNull() & ~F.col("regressed"),
                _whole_seconds(F.greatest("at_us", "open_us")),
            ).otherwise(F.col("at_us")),
            "until_us": F.when(
                F.col("until_us").isNotNull(), _whole_seconds(F.least(F.col("until_us"), final_us + MICROS))
            ),
        }
    )
    missing = open_us.isNull() & is_gap & F.col("until_us").isNull()
    rows = rows.withColumn(
        "incident",
        F.when(missing, F.lit("missing_anchor")).when(F.col("regressed"), F.lit("gap_window_regressed")),
    )
    useful = F.col("incident").isNotNull() | (
        (is_anchor & (F.col("at_us") >= open_us) & (F.col("at_us") <= final_us))
        | (is_gap & (F.col("until_us") > F.col("at_us")))
    )
    rows = rows.where(F.coalesce(useful, F.lit(False)))
    in_order = Window.partitionBy(*unit).orderBy("at_us", "kind", "sequence_start", "sequence_end")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    real_gap = is_gap & F.col("incident").isNull()
    rows = rows.withColumns(
        {
            "gap_us": F.max(F.when(real_gap, F.col("at_us"))).over(so_far),
            "covered_us": F.max(F.when(real_gap, F.col("until_us"))).over(so_far),
            # of several anchors in one second the highest sequence counts
            "next_kind": F.lead("kind").over(in_order),
            "next_at": F.lead("at_us").over(in_order),
        }
    )
    outside = F.col("covered_us").isNull() | (F.col("covered_us") <= F.col("at_us"))
    superseded = F.coalesce((F.col("next_kind") == _ANCHOR) & (F.col("next_at") == F.col("at_us")), F.lit(False))
    rows = rows.withColumn("placed", is_anchor & outside & ~superseded)
    anchor_at = F.when(F.col("placed"), F.col("at_us"))
    rows = rows.withColumns(
        {"run_us": F.max(anchor_at).over(so_far), "previous_run_us": F.max(anchor_at).over(earlier)}
    )
    opens = F.col("placed") & F.col("gap_us").isNotNull() & (
        F.col("previous_run_us").isNull() | (F.col("gap_us") > F.col("previous_run_us"))
    )
    rows = rows.withColumn("segment_id", F.sum(F.when(opens, 1).otherwise(0)).over(so_far).cast("bigint"))
    fields = [
        *unit, "at_us", "kind", "sequence_start", "sequence_end", "best_bid", "best_ask", "levels", "run_us",
        "segment_id", "incident", "start_us", "final_us",
    ]
    marks = stage(rows)
    placed = marks.where(F.col("placed") | is_gap).select(*fields)

    state = ["open_us", "gap_us", "covered_us", "run_us", "segment_id", "start_us", "final_us"]
    seen = marks.select(*unit, "at_us", F.lit(_GAP).alias("kind"), *state)
    timed = delta_rows.drop("until_us").unionByName(seen, allowMissingColumns=True).withColumn(
        "slice", F.floor(F.col("at_us") / F.lit(SLICE_US))
    )
    slices = timed.groupBy(*unit, "slice").agg(F.count(F.lit(1)).alias("n"), *[F.max(name).alias(name) for name in state])
    slices = stage(slices)
    total = slices.agg(F.sum("n")).first()[0] or 0
    before = Window.partitionBy(*unit).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # written, as the window's partitions by unit would draw the rows of the join to them
    carried = stage(slices.select(*unit, "slice", *[F.max(name).over(before).alias(f"__{name}") for name in state]))
    up_to = (
        Window.partitionBy(*unit, "slice").orderBy("at_us", "kind")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    timed = _dealt(timed, total, *unit, "slice").join(carried, [*unit, "slice"])
    timed = timed.withColumns({name: F.greatest(F.max(name).over(up_to), F.col(f"__{name}")) for name in state})
    applies = (
        (F.col("kind") == _DELTA) & (F.col("at_us") > open_us) & (F.col("at_us") <= final_us) & outside
        & F.col("run_us").isNotNull() & (F.col("gap_us").isNull() | (F.col("gap_us") < F.col("run_us")))
    )
    applied = timed.where(applies).withColumn("incident", F.lit(None).cast("string"))
    return placed.unionByName(applied.select(*fields))


def _fold(timeline: DataFrame) -> DataFrame:
    """States after every second that changed a book; incidents carry a code and no book.

    No row is folded after another. Events are numbered within their run. A level's lifetime runs from one change of its
    price to the next; its ends lie in one or two blocks of 2**BLOCK events and tell every event there, and the whole
    blocks between them are cut into spans of 2**k blocks, at most two of each size. A block asks the one span of each
    size that it lies in. The best level after an event is the best of both.
    """
    run = ["run_us", *UNIT]  # the number first: sorts compare it before the texts
    fields = ["at_us", "kind", "sequence_start", "sequence_end", "best_bid", "best_ask", "segment_id", "start_us", "final_us"]
    order = ["at_us", "kind", "sequence_start", "sequence_end"]
    lowest = F.when(F.col("kind") == _DELTA, F.lit(0)).otherwise(F.lit("1e-8").cast("decimal(18,8)"))  # an anchor lists existing levels only
    sound = lambda level: F.coalesce(
        level["side"].isin("bid", "offer") & (level["price"] > 0) & (level["quantity"] >= lowest), F.lit(False)
    )
    events = timeline.where(F.col("kind") != _GAP).drop("incident").withColumns(
        {"slice": F.floor(F.col("at_us") / F.lit(SLICE_US)), "levels": F.coalesce("levels", F.array().cast(LEVELS))}
    )
    total = timeline.count()
    place = [*run, "slice"]
    parts = _dealt(events.select(*place, *order), total, *place).groupBy(*place).agg(
        F.count(F.lit(1)).alias("c"), F.max_by("sequence_end", F.struct(*order)).alias("tail")
    )
    in_run = Window.partitionBy(*run)
    by_slice = in_run.orderBy("slice")
    carried = stage(
        parts.select(
            *place, F.coalesce(F.sum("c").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
            F.lag("tail").over(by_slice).alias("carry"), F.sum("c").over(in_run).alias("n"),
        )
    )
    within = Window.partitionBy(*place).orderBy(*order)
    events = _dealt(events, total, *place).join(carried, place).withColumn("at", F.row_number().over(within).cast("bigint") - 1)
    events = events.withColumns(
        {
            "idx": F.col("offset") + F.col("at"),
            "before": F.when(F.col("at") == 0, F.col("carry")).otherwise(F.lag("sequence_end").over(within)),
        }
    )
    regressed = (F.col("kind") == _DELTA) & (
        (F.col("sequence_start") > F.col("sequence_end")) | (F.col("sequence_start") <= F.col("before"))
    )
    events = stage(
        events.select(
            *run, "idx", "n", *fields, F.coalesce(regressed, F.lit(False)).alias("regressed"),
            (~F.forall("levels", sound)).alias("invalid"), F.filter("levels", sound).alias("levels"),
        )
    )

    # lifetimes of levels, each level scanned in pieces
    shift = lambda value, bits: F.call_function("shiftright", value, bits if isinstance(bits, Column) else F.lit(bits))
    up = lambda value, bits: F.call_function("shiftleft", value, bits if isinstance(bits, Column) else F.lit(bits))
    changed = events.agg(F.sum(F.size("levels"))).first()[0] or 0
    changes = events.select(*run, "idx", "n", F.posexplode("levels").alias("pos", "x")).select(*run, "idx", "n", "pos", "x.*")
    piece = ["price", "side", *run, "piece"]
    changes = changes.withColumn("piece", shift(F.col("idx"), PIECE))
    heads = changes.groupBy(*piece).agg(F.min("idx").alias("head"))
    of_level = Window.partitionBy("price", "side", *run).orderBy("piece")
    heads = stage(heads.select(*piece, F.lead("head").over(of_level).alias("following")))
    changes = _dealt(changes, changed, *piece).join(heads, piece)
    after = F.lead("idx").over(Window.partitionBy(*piece).orderBy("idx", "pos"))
    own = lambda sign: F.struct((sign * F.col("price")).cast("decimal(18,8)").alias("price"), "quantity")
    lives = changes.withColumn("until", F.coalesce(after, F.col("following"), F.col("n")))
    lives = stage(
        lives.where((F.col("quantity") > 0) & (F.col("idx") < F.col("until"))).select(
            *run, "n", "idx", "until", F.when(F.col("side") == "bid", own(F.lit(1))).alias("bid"),
            F.when(F.col("side") == "offer", own(F.lit(-1))).alias("ask"),
        )
    )
    head, tail = shift(F.col("idx"), BLOCK), shift(F.col("until"), BLOCK)
    part = lambda block, low, high: F.struct(block.alias("block"), low.alias("low"), high.alias("high"))
    ends = F.when(head == tail, F.array(part(head, F.col("idx"), F.col("until")))).otherwise(
        F.array(part(head, F.col("idx"), up(head + 1, BLOCK)), part(tail, up(tail, BLOCK), F.col("until")))
    )
    short = lives.select(*run, F.explode(ends).alias("p"), "bid", "ask").select(*run, "p.*", "bid", "ask").where("low < high")

    # whole blocks of a lifetime: the odd span at either end in every size; a block asks for the span it lies in
    bits = F.ceil(F.log2((shift(F.col("n"), BLOCK) + 1).cast("double"))).cast("int")
    wide = lives.select(*run, "n", (head + 1).alias("low"), tail.alias("high"), "bid", "ask").where("low < high")
    wide = wide.withColumn("step", F.explode(F.sequence(F.lit(0), 2 * bits + 1))).withColumn("k", F.floor(F.col("step") / 2).cast("int"))
    k = F.col("k")
    first, last = shift(F.col("low") + up(F.lit(1).cast("bigint"), k) - 1, k), shift(F.col("high"), k)
    left, right = (F.col("step") % 2 == 0) & (first % 2 == 1), (F.col("step") % 2 == 1) & (last % 2 == 1)
    wide = wide.where((first < last) & (left | right)).withColumn("j", F.when(left, first).otherwise(last - 1))
    wide = wide.groupBy(*run, "k", "j").agg(F.max("bid").alias("bid"), F.max("ask").alias("ask"))
    blocks = events.where(F.col("idx") % (1 << BLOCK) == 0).select(*run, shift(F.col("idx"), BLOCK).alias("block"), bits.alias("bits"))
    asked = blocks.select(*run, "block", F.explode(F.sequence(F.lit(0), F.col("bits"))).alias("k")).withColumn("j", shift(F.col("block"), F.col("k")))
    through = _dealt(asked, 2 * total, *run, "k", "j").join(wide, [*run, "k", "j"])
    through = through.select(
        *run, "block", up(F.col("block"), BLOCK).alias("low"), up(F.col("block") + 1, BLOCK).alias("high"), "bid", "ask"
    )

    event = F.struct(*fields, "regressed", "invalid")
    itself = events.select(
        *run, shift(F.col("idx"), BLOCK).alias("block"), F.col("idx").alias("low"), (F.col("idx") + 1).alias("high"), event.alias("ev")
    )
    rows = _dealt(short.unionByName(through).unionByName(itself, allowMissingColumns=True), 2 * (total + changed), *run, "block")
    rows = rows.withColumn("idx", F.explode(F.sequence(F.col("low"), F.col("high") - 1)))
    states = rows.groupBy(*run, "block", "idx").agg(F.max("bid").alias("bid"), F.max("ask").alias("ask"), F.max("ev").alias("ev"))
    states = states.where(F.col("ev").isNotNull())
    states = states.select(
        *run, "idx", *[F.col(f"ev.{name}") for name in fields], "ev.regressed", "ev.invalid", F.col("bid.price").alias("bid"),
        F.col("bid.quantity").alias("bid_size"), (-F.col("ask.price")).alias("ask"), F.col("ask.quantity").alias("ask_size"),
    )
    stated = F.col("bid").eqNullSafe(F.col("best_bid")) & F.col("ask").eqNullSafe(F.col("best_ask"))
    states = states.withColumn(
        "incident",
        F.when(F.col("regressed"), "sequence_regression").when(F.col("invalid"), "invalid_change")
        .when(F.col("bid").isNull() | F.col("ask").isNull(), "empty_side").when(F.col("bid") >= F.col("ask"), "crossed_book")
        .when(~stated, "bbo_mismatch"),
    )
    # the first incident ends its run; of the events of a second the last one counts
    states = stage(states)
    failed = states.where(F.col("incident").isNotNull()).groupBy(*run).agg(F.min("idx").alias("failed"))
    states = states.join(failed, run, "left").where(F.col("failed").isNull() | (F.col("idx") <= F.col("failed")))
    sound_book = lambda name, value: F.when(F.col("incident").isNull(), F.col(value)).cast("decimal(18,8)").alias(name)
    last = F.struct(
        "idx", "sequence_start", "sequence_end", sound_book("best_bid", "bid"), sound_book("bid_size", "bid_size"),
        sound_book("best_ask", "ask"), sound_book("ask_size", "ask_size"), "segment_id", "start_us", "final_us", "incident",
    )
    folded = _dealt(states, total, *run, "at_us").groupBy(*run, "at_us").agg(F.max_by(last, "idx").alias("s")).select(*run, "at_us", "s.*").drop("idx")
    early = timeline.where(F.col("incident").isNotNull()).select(
        *UNIT, "at_us", "incident", "start_us", "final_us", F.lit(0).cast("bigint").alias("segment_id")
    )
    return folded.unionByName(early, allowMissingColumns=True)


def replay_events(
    anchors: DataFrame, deltas: DataFrame, metadata: DataFrame, days: DataFrame
) -> DataFrame:
    """State after each second that changed the book, with its segment; incidents carry a code."""
    return _fold(stage(_timeline(anchors, deltas, metadata, days)))


def replay_incidents(
    anchors: DataFrame, deltas: DataFrame, metadata: DataFrame, days: DataFrame
) -> DataFrame:
    """Why a unit cannot be trusted: unit, second, code."""
    return (
        replay_events(anchors, deltas, metadata, days)
        .where(F.col("incident").isNotNull())
        .select(*UNIT, F.timestamp_micros("at_us").alias("at"), "incident")
    )


def replay_book(
    anchors: DataFrame,
    deltas: DataFrame,
    metadata: DataFrame,
    days: DataFrame,
    strict: bool = True,
) -> DataFrame:
    """One end-of-second state per second a trustworthy book exists.

    `days` gives every unit its day_start and day_end (inclusive last second).
    States are carried forward inside a unit until the next change, gap or day
    end; nothing is carried across a gap. With `strict` any incident fails the
    job, otherwise the unit ends at its first incident.
    """
    unit = list(UNIT)
    timeline = stage(_timeline(anchors, deltas, metadata, days))
    marks = timeline.where((F.col("kind") == _GAP) & F.col("incident").isNull()).select(
        *unit, "at_us", F.lit(True).alias("is_gap")
    )
    states = _fold(timeline).unionByName(marks, allowMissingColumns=True)
    in_order = Window.partitionBy(*unit).orderBy("at_us", F.col("incident").isNotNull().desc())
    failed = F.concat_ws(" ", F.lit("replay incident"), "incident", *unit)
    at = F.col("at_us")
    if strict:
        at = F.when(F.col("incident").isNull(), at).otherwise(F.raise_error(failed).cast("bigint"))
    timed = states.withColumns(
        {
            "next_us": F.lead("at_us").over(in_order),
            "stop_us": F.min(F.when(F.col("incident").isNotNull(), F.col("at_us"))).over(
                Window.partitionBy(*unit)
            ),
            "at_us": at,
        }
    )
    if not strict:
        timed = timed.where(F.col("stop_us").isNull() | (F.col("at_us") < F.col("stop_us")))
    until = F.least("next_us", F.col("final_us") + MICROS)
    since = F.greatest("at_us", "start_us")
    filled = timed.where(F.col("is_gap").isNull() & (since < until)).withColumn(
        "observed_us", F.explode(F.sequence(since, until - MICROS, F.lit(MICROS).cast("bigint")))
    )
    return filled.select(
        "product_id", "source_date", F.timestamp_micros("observed_us").alias("observed_through"),
        "sequence_start", "sequence_end", "best_bid", "bid_size", "best_ask", "ask_size", "segment_id",
    )


def state_intervals(states: DataFrame, keys: Sequence[str] = UNIT) -> DataFrame:
    """Continuous observation intervals of each segment."""
    return continuity_islands(
        states.select(*keys, "segment_id", ts_micros("observed_through").alias("ts_us")), [*keys, "segment_id"]
    )


