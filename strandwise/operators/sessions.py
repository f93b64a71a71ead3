"""Timed state records: gaps, sessions, durations, folded clock times, minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import attach, blocked, null_safe_join, with_stats

HOUR_US = 3_600_000_000
#: State of the minutes inside a sequence that no record covers.
MISSING = "missing"
MINUTE_US = 60_000_000
DAY_US = 24 * HOUR_US


def sessionize(
    df: DataFrame, keys: list[str], start: str, end: str, tie: str, gap_hours: float = 0.0
) -> DataFrame:
    """Add ``gap_hours`` (to the previous record's end, first 0) and ``session_id``.

    ``start`` and ``end`` are epoch microseconds. The id counts gaps above the
    threshold, from 0. A hot key is worked on in time slices; only one summary
    row per slice passes the gap and the count on to the next slice.
    """
    cut, is_hot = blocked(df, keys, F.col(start))
    w = Window.partitionBy(*keys, "_block").orderBy(start, tie)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumn("_prev", F.lag(end).over(w))
    hours = (F.col(start) - F.col("_prev")) / F.lit(float(HOUR_US))
    local = local.withColumn("_brk", F.when(hours > gap_hours, 1).otherwise(0)).withColumn(
        "_cum", F.sum("_brk").over(run)
    )
    if not is_hot:
        return local.select(
            *df.columns,
            F.coalesce(hours, F.lit(0.0)).alias("gap_hours"),
            F.col("_cum").cast("long").alias("session_id"),
        )
    order = F.struct(F.col(start), F.col(tie))
    slices = local.groupBy(*keys, "_block").agg(
        F.min(start).alias("_first"),
        F.max_by(end, order).alias("_last"),
        F.sum("_brk").alias("_inner"),
    )
    by_block = Window.partitionBy(*keys).orderBy("_block")  # at most a few slices per hot key part
    slices = slices.withColumn("_before", F.lag("_last").over(by_block)).withColumn(
        "_edge", (F.col("_first") - F.col("_before")) / F.lit(float(HOUR_US))
    )
    slices = slices.withColumn("_edge_brk", F.when(F.col("_edge") > gap_hours, 1).otherwise(0))
    carried = slices.select(
        *keys,
        "_block",
        "_edge",
        (
            F.coalesce(
                F.sum(F.col("_inner") + F.col("_edge_brk")).over(
                    by_block.rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            )
            + F.col("_edge_brk")
        ).alias("_carry"),
    )
    out = null_safe_join(local, carried, [*keys, "_block"])
    return out.select(
        *df.columns,
        F.coalesce(hours, F.when(F.col("_prev").isNull(), F.col("_edge")), F.lit(0.0)).alias("gap_hours"),
        (F.col("_cum") + F.coalesce("_carry", F.lit(0))).cast("long").alias("session_id"),
    )


def parse_clock(text: Column, zone: str, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch microseconds of a written wall-clock time in ``zone``; null where it does not parse."""
    local = F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz")
    return F.unix_micros(F.convert_timezone(F.lit(zone), F.current_timezone(), local).cast("timestamp"))


def started_within(us: Column, zone: str, first: str, last: str) -> Column:
    """Start at or after the first and at or before the last local time; both ends belong to it."""
    local = local_time(us, zone)
    return local.between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"))


def hours_between(start: str, end: str) -> Column:
    return (F.col(end) - F.col(start)) / F.lit(float(HOUR_US))


def local_time(us: Column, zone: str) -> Column:
    """Wall-clock time in ``zone`` of an epoch-microsecond column."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_clock(us))


def utc_clock(us: Column) -> Column:
    """Epoch microseconds as a UTC wall-clock value, whatever the session zone is."""
    return F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")
    )


def session_durations(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    state: str,
    states: list[str],
    zone: str = "UTC",
) -> DataFrame:
    """Hours per state in one row per session, missing states 0, plus month and total.

    The month is that of the session's first start in ``zone``, so a night that
    crosses a month end stays one row. All parts combine on the map side.
    """
    hours = hours_between(start, end)
    cols = [
        F.coalesce(F.sum(F.when(F.col(state) == s, hours)), F.lit(0.0)).alias(s.lower().replace(" ", "_"))
        for s in states
    ]
    names = [s.lower().replace(" ", "_") for s in states]
    out = df.groupBy(*keys).agg(F.min(start).alias("_start"), *cols)
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return out.select(
        *keys, F.month(local_time(F.col("_start"), zone)).cast("long").alias("month"), *names, total.alias("total")
    )


def without_sessions(df: DataFrame, keys: list[str], excluded: DataFrame) -> DataFrame:
    """Drop sessions named in ``excluded`` (a list, or sessions with an unwanted state)."""
    return attach(df, excluded.select(*keys).distinct(), keys, "left_anti")


def offset_from_start(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Add the distance of ``value`` from its smallest value in the group."""
    return with_stats(df, keys, _low=F.min(value)).withColumn(name, F.col(value) - F.col("_low")).drop("_low")


def fold_to_day(df: DataFrame, keys: list[str], start: str, end: str, zone: str = "UTC") -> DataFrame:
    """Place each record on one reference day, keeping the day offset in its session.

    Adds ``xmin`` and ``xmax`` in seconds from the reference midnight; the end
    uses its own date, so a record over midnight keeps ``xmax`` after ``xmin``.
    """
    day0 = F.to_date(local_time(F.col("_low"), zone))

    def seconds(us: str) -> Column:
        t = local_time(F.col(us), zone)
        clock = F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t))
        return (F.datediff(F.to_date(t), day0) * 86400 + clock).cast("long")

    return with_stats(df, keys, _low=F.min(start)).withColumns({"xmin": seconds(start), "xmax": seconds(end)}).drop("_low")


def minute_states(
    df: DataFrame, keys: list[str], start: str, end: str, state: str, tie: str, step_minutes: int = 1
) -> DataFrame:
    """Long state sequence ``(keys, pos, state)``: one row per session and minute.

    Each record gives the instants start, start + 1 step, ... up to its end; the
    position is the whole number of steps since the session's first start, and the
    earliest record wins a shared minute. The first-record choice combines on the
    map side and groups by (session, minute), so no session gathers in one task.
    """
    step = step_minutes * MINUTE_US
    rows = with_stats(df, keys, _low=F.min(start))
    steps = ((F.col(end) - F.col(start)) / F.lit(step)).cast("long")  # whole steps; a sequence to -1 would run backwards
    ticks = F.sequence(F.lit(0).cast("long"), steps)
    rows = rows.where(steps >= 0).select(
        *keys,
        F.col(state).alias("_state"),
        F.struct(F.col(start), F.col(tie)).alias("_order"),
        (F.col(start) - F.col("_low")).alias("_from"),
        F.explode(ticks).alias("_tick"),
    )
    pos = F.floor((F.col("_from") + F.col("_tick") * F.lit(step)) / F.lit(step)).cast("long")
    return (
        rows.withColumn("pos", pos)
        .groupBy(*keys, "pos")
        .agg(F.min_by("_state", "_order").alias("state"))
    )


def record_spells(df: DataFrame, keys: list[str], start: str, end: str, state: str, tie: str) -> DataFrame:
    """The runs of ``minute_states`` as (keys, start, state, length), without a row for each minute.

    A record covers the minutes from its start to its end, and earlier records win. Sorted by
    start, what is left of a record begins behind the farthest end before it. Records of one session
    that cover the same minutes are first reduced to the earliest, so a session has no more rows
    than its calendar allows. Minutes that no record covers are runs of the state ``missing``.
    """
    rows = with_stats(df, keys, _low=F.min(start))
    first = F.floor((F.col(start) - F.col("_low")) / MINUTE_US)
    last = first + ((F.col(end) - F.col(start)) / MINUTE_US).cast("long")
    held = rows.groupBy(*keys, first.cast("long").alias("_p"), last.cast("long").alias("_q")).agg(
        F.min(F.struct(F.col(start).alias("s"), F.col(tie).alias("t"), F.col(state).alias("state"))).alias("_r")
    ).where("_q >= _p")
    w = Window.partitionBy(*keys).orderBy("_p", "_r.s", "_r.t", "_q")
    reach = F.coalesce(F.max("_q").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1).cast("long"))
    cut = held.withColumn("_at", F.greatest("_p", reach + 1)).where(F.col("_at") <= F.col("_q"))
    state_of = F.col("_r.state")  # _at rises in the order of w, so no further sort is needed
    joined = cut.withColumn("_gap", F.col("_at") - F.coalesce(F.lag("_q").over(w) + 1, F.lit(0).cast("long"))).withColumn(
        "_new", F.lag("_r.state").over(w).isNull() | (F.lag("_r.state").over(w) != state_of) | (F.col("_gap") > 0)
    )
    firsts = joined.withColumn("_end", F.max("_q").over(Window.partitionBy(*keys)) + 1).where("_new")
    until = F.coalesce(F.lead(F.col("_at") - F.col("_gap")).over(w), F.col("_end"))
    held = firsts.withColumn("_until", until)
    hole = F.struct((F.col("_at") - F.col("_gap")).alias("start"), F.lit(MISSING).alias("state"), F.col("_gap").alias("length"))
    spell = F.struct(F.col("_at").alias("start"), state_of.alias("state"), (F.col("_until") - F.col("_at")).alias("length"))
    return held.select(*keys, F.inline(F.array(hole, spell))).where("length > 0")
