"""A dense daily series packed into one row per cell, and constant-time sums over any span of its days.

``pack`` turns ``(cell, date, value)`` into arrays that start on the cell's first day. A prefix array makes the
sum of any span two look-ups, so readings need one equi-join on the cell instead of one row per day. A cell's
array is as long as its calendar, whatever the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import dates


def calendar_gaps(daily: DataFrame, cell: str = "cell", date: str = "date") -> DataFrame:
    """Per cell: days, span and missing days. A dense, repeat-free record has ``missing = 0``."""
    return daily.groupBy(cell).agg(
        F.count(F.lit(1)).alias("days"),
        (F.datediff(F.max(date), F.min(date)) + 1).alias("span"),
        (F.datediff(F.max(date), F.min(date)) + 1 - F.countDistinct(date)).alias("missing"))


def dense_calendar(sparse: DataFrame, cells: DataFrame, first: str | Column, last: str | Column, value: str, fill: float | None = 0.0,
                   unit: str = "day", cell: str = "cell", date: str = "date") -> DataFrame:
    """One row per cell and day (or month), ``fill`` where the record has none; the ends are days or scalar columns."""
    ends = [F.to_date(F.lit(e)) if isinstance(e, str) else e for e in (first, last)]
    calendar = cells.select(cell, ends[0].alias("_first"), ends[1].alias("_last")).distinct()
    calendar = calendar.select(cell, F.explode(F.sequence("_first", "_last", F.expr(f"interval 1 {unit}"))).alias(date))
    joined = calendar.join(sparse.select(cell, date, value), [cell, date], "left")
    return joined if fill is None else joined.withColumn(value, F.coalesce(value, F.lit(float(fill))))


def pack(daily: DataFrame, values: dict[str, Column], prefixes: dict[str, Column], cell: str = "cell",
         date: str = "date") -> DataFrame:
    """Arrays per cell, oldest day first: ``values`` as they are, ``prefixes`` as running totals from 0."""
    frame = W.partitionBy(cell).orderBy(date).rowsBetween(W.unboundedPreceding, W.currentRow)
    columns = {**values, **{n: F.sum(c).over(frame) for n, c in prefixes.items()}}
    rows = daily.select(cell, date, *[c.cast("double").alias(n) for n, c in columns.items()])
    packed = rows.groupBy(cell).agg(
        F.min(date).alias("first_day"), F.count(F.lit(1)).alias("days"),
        F.array_sort(F.collect_list(F.struct(date, *columns))).alias("_d"))

    def column(n: str) -> Column:
        series = F.transform("_d", lambda d: d[n])
        return F.concat(F.array(F.lit(0.0)), series) if n in prefixes else series

    return packed.select(cell, "first_day", F.col("days").cast("int").alias("days"),
                         *[column(n).alias(n) for n in columns])


def days_until(date: Column) -> Column:
    """How many days of the packed record lie on or before ``date`` (0 before it starts)."""
    return F.least(F.greatest(F.datediff(date, F.col("first_day")) + 1, F.lit(0)), F.col("days"))


def span_sum(prefix: str, after: Column, until: Column) -> Column:
    """Sum over the days ``(after, until]``."""
    return F.get(F.col(prefix), days_until(until)) - F.get(F.col(prefix), days_until(after))


def trailing_sum(prefix: str, date: Column, d: int) -> Column:
    """Sum over the ``d`` days ending on ``date``, null if they start before the record."""
    end = days_until(date)
    return F.when(end >= d, F.get(F.col(prefix), end) - F.get(F.col(prefix), F.greatest(end - d, F.lit(0))))


def range_maxima(values: Column) -> Column:
    """Maxima of every run of 1, 2, 4, ... values, one array per length: entry ``i`` of level ``k`` covers ``i .. i + 2**k - 1``.

    A level comes from the one before it. Runs that leave the record at its end cover what is left of it; unknown
    values count for nothing. A record of n days has about ``n * log2(n)`` entries.
    """
    levels = F.greatest(F.length(F.bin(F.size(values))) - 1, F.lit(0)).cast("int")

    def doubled(table: Column, k: Column) -> Column:
        last = F.element_at(table, -1)
        ahead = F.slice(last, F.call_function("shiftleft", F.lit(1), k - 1) + 1, F.size(last))
        return F.concat(table, F.array(F.zip_with(last, ahead, lambda a, b: F.greatest(a, b))))

    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(values), doubled)


def span_max(peaks: str, after: Column, until: Column) -> Column:
    """Largest value of the days ``(after, until]``, from two runs of :func:`range_maxima` that overlap; null for no day."""
    start, end = days_until(after), days_until(until)
    days = end - start
    level = (F.length(F.bin(days)) - 1).cast("int")
    runs = F.get(F.col(peaks), level)
    return F.when(days > 0, F.greatest(F.get(runs, start), F.get(runs, end - F.call_function("shiftleft", F.lit(1), level))))


def monsoon_sum(prefix: str, date: Column) -> Column:
    """Sum over 1 June to 30 September of the last completed season."""
    year = dates.monsoon_year(date)
    return span_sum(prefix, F.make_date(year, F.lit(5), F.lit(31)), F.make_date(year, F.lit(9), F.lit(30)))


def interval_sums_by_join(intervals: DataFrame, daily: DataFrame, value: str, name: str, cell: str = "cell",
                          date: str = "date", previous: str = "prev_date") -> DataFrame:
    """The same interval sum on long tables: a running total and two equi-joins on ``(cell, date)``.

    Either end may lie outside the record: before it the running total is 0, after it the last total.
    """
    frame = W.partitionBy(cell).orderBy(date).rowsBetween(W.unboundedPreceding, W.currentRow)
    cum = daily.select(cell, F.col(date).alias("_day"), F.sum(value).over(frame).alias("_cum"))
    bounds = daily.groupBy(cell).agg(F.min(date).alias("_first"), F.max(date).alias("_last"))
    known = intervals.join(bounds, cell)

    def look_up(df: DataFrame, at: str, out: str) -> DataFrame:
        day = F.least(F.col(at), F.col("_last"))
        return (df.withColumn("_day", day).join(cum.withColumnRenamed("_cum", out), [cell, "_day"], "left")
                .withColumn(out, F.when(F.col(at) < F.col("_first"), F.lit(0.0)).otherwise(F.col(out))).drop("_day"))

    found = look_up(look_up(known, date, "_now"), previous, "_then")
    return found.withColumn(name, F.col("_now") - F.col("_then")).drop("_now", "_then", "_first", "_last")


def latest_at_or_before(queries: DataFrame, events: DataFrame, key: list[str], at: str, event_date: str,
                        columns: list[str], segment_days: int = 64) -> DataFrame:
    """As-of look-up on sparse events: the columns of the last event on or before each query day.

    Both sides are stacked and the last known event is carried forward along the key's days, so no range
    join is needed. Queries of one key and day are looked up once and joined back, and ``events`` must be unique on
    ``(key, event_date)``. The carry has two levels: inside segments of ``segment_days`` days, and from the last event
    of each segment to the ones after it. So a hot key, or no key at all, is spread over as many tasks as it has
    segments, and only one row a segment is ever put in line.
    """
    stacked = queries.select(*key, F.col(at).alias("_day"), F.lit(1).alias("_kind"),
                             F.lit(None).alias("_event")).distinct()
    payload = F.struct(F.col(event_date).alias("event_date"), *columns)
    stacked = events.select(*key, F.col(event_date).alias("_day"), F.lit(0).alias("_kind"),
                            payload.alias("_event")).unionByName(stacked)
    segment = F.floor(F.unix_date("_day") / F.lit(segment_days)).alias("_segment")
    stacked = stacked.select("*", segment)
    inside = W.partitionBy(*key, "_segment").orderBy("_day", "_kind")
    carried = stacked.withColumn("_event", F.last("_event", ignorenulls=True).over(inside)).where("_kind = 1")
    ends = stacked.groupBy(*key, "_segment").agg(F.max_by("_event", F.when(F.col("_kind") == 0, F.col("_day"))).alias("_end"))
    line = (W.partitionBy(*key) if key else W.partitionBy(F.lit(0))).orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)
    before = ends.select(*key, "_segment", F.last("_end", ignorenulls=True).over(line).alias("_before"))
    carried = carried.join(before, [*key, "_segment"], "left").withColumn("_event", F.coalesce("_event", "_before"))
    found = carried.select(*key, F.col("_day").alias(at), "_event.event_date",
                           *[F.col(f"_event.{c}").alias(c) for c in columns])
    return queries.join(found, [*key, at], "left")
