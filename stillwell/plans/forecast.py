"""Step table, replay ensembles and chained backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import dates
from ..functions.constants import SEASONS, SHIFTS_PCT, SKILL_YEARS
from ..operators import series, windows
from ..session import cut_lineage
from . import features, scoring
from .scenario import with_step_facts


def season_array() -> Column:
    return F.array(*[F.lit(s) for s in SEASONS])


def regular_intervals(packed: DataFrame, first_year: int, last_year: int, also: list[str] | None = None) -> DataFrame:
    """Interval driver of every cell at every regular reading of the years: ``(cell, year, season, date, interval_mm)``.

    A reading whose interval starts before the record is left out. ``also`` names further driver features, or ``gap``.
    """
    days = F.flatten(F.transform(F.sequence(F.lit(first_year), F.lit(last_year)),
                                 lambda y: F.transform(season_array(), lambda s: dates.reading_date(y, s))))
    rows = with_step_facts(packed.withColumn("date", F.explode(days)))          # four rows a year and cell
    total = series.span_sum("cum", F.col("prev_date"), F.col("date"))
    gap = F.datediff("date", "prev_date")
    made = features.driver_features(F.col("date"), F.col("prev_date"), gap)
    more = [(gap if c == "gap" else made[c]()).alias(c) for c in also or () if c != "interval_mm"]
    return rows.where(F.col("prev_date") >= F.date_sub("first_day", 1)).select(
        "cell", "year", "season", "date", "prev_date", total.alias("interval_mm"), *more)


def step_table(intervals: DataFrame, model, shifts: list[int] | None = None) -> DataFrame:
    """Expected change per cell, year and season at each driver shift in percent.

    The model (one of ``scoring`` or a table of season lines) reads nothing of an entity but its cell, so entities of
    a cell share their rows.
    """
    model = scoring.as_model(model)
    each = intervals.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts or SHIFTS_PCT])))
    factor = 1 + F.col("shift") / F.lit(100.0)
    return model.score(each, "step", scoring.scaled(model, factor)).select("cell", "year", "season", "shift", "step")


def at_shift(table: DataFrame, pct: float, shifts: list[int] | None = None) -> DataFrame:
    """Steps at any shift, linear between the two grid shifts around it and held at the ends of the grid."""
    grid = sorted(shifts or SHIFTS_PCT)
    pct = min(max(pct, grid[0]), grid[-1])
    low = max([s for s in grid[:-1] if s <= pct])
    high = grid[grid.index(low) + 1]
    t = (pct - low) / (high - low)
    weight = F.when(F.col("shift") == low, F.lit(1 - t)).otherwise(F.lit(t))
    return (table.where(F.col("shift").isin(low, high)).groupBy("cell", "year", "season")
            .agg(F.sum(F.col("step") * weight).alias("step")))


def starts(readings: DataFrame, table: DataFrame, entities: DataFrame, last_year: int,
           rate: DataFrame | None = None) -> DataFrame:
    """Depth each entity starts from: its last reading moved up to the end of ``last_year``.

    The steps of ``last_year`` after the last reading are added (all four if that was in an earlier year; years
    in between are not). ``base_trend`` also adds the group's rate for those steps.
    """
    last = windows.last_reading(readings, ["value", "season", "season_year"]).join(entities, "entity")
    done = F.when(F.col("last_season_year") == last_year, dates.season_index(F.col("last_season")) + 1).otherwise(0)
    todo = last.withColumn("season", F.explode_outer(F.slice(season_array(), done + 1, 4 - done)))
    final = table.where(F.col("year") == last_year).select("cell", "season", "step")
    joined = todo.join(final, ["cell", "season"], "left")
    trend = F.lit(0.0)
    if rate is not None:
        joined = joined.join(rate, ["grp", "state", "season"], "left")
        trend = F.coalesce(F.col("rate"), F.lit(0.0))
    step = F.coalesce("step", F.lit(0.0))
    return joined.groupBy("entity", "cell", "grp", "state").agg(
        F.first("last_value").alias("depth"), (F.first("last_value") + F.sum(step)).alias("base"),
        (F.first("last_value") + F.sum(step + F.when(F.col("season").isNotNull(), trend).otherwise(0.0)))
        .alias("base_trend"))


def future_steps(spark, first_year: int, last_year: int, to_year: int, members: int | None = None) -> DataFrame:
    """Steps after the record with the replay year of each member: members x years x 4 rows."""
    ring = last_year - first_year + 1
    base = spark.range(members or ring).select(F.col("id").cast("int").alias("member"))
    rows = base.withColumn("year", F.explode(F.sequence(F.lit(last_year + 1), F.lit(to_year))))
    rows = rows.select("*", F.posexplode(season_array()).alias("_s", "season"))
    return rows.select("member", "year", "season",
                       ((F.col("year") - last_year - 1) * 4 + F.col("_s") + 1).cast("int").alias("step_no"),
                       dates.replay_year(F.col("member"), F.col("year"), first_year, last_year).alias("replay"))


def mean_paths(start: DataFrame, table: DataFrame, future: DataFrame, rate: DataFrame | None = None) -> DataFrame:
    """Mean depth over entities along each member's path: ``(member, step_no, year, season, rain, rain_trend)``.

    Means over entities are taken before the running total; the two commute, and only one row per replay step
    is left to chain instead of one per entity.
    """
    # what the paths need of the starts is one row per cell and group; it is read three times below
    weights = cut_lineage(start.groupBy("cell", "grp", "state").agg(
        F.count(F.lit(1)).alias("_w"), F.sum("base").alias("_b"), F.sum("base_trend").alias("_t")))
    by_cell = weights.groupBy("cell").agg(F.sum("_w").alias("_w"))
    mean_step = table.join(by_cell, "cell").groupBy(F.col("year").alias("replay"), "season").agg(
        (F.sum(F.col("step") * F.col("_w")) / F.sum("_w")).alias("_step"))
    if rate is None:
        steps = future.join(mean_step, ["replay", "season"]).withColumn("_rate", F.lit(0.0))
    else:
        mean_rate = rate.join(weights, ["grp", "state"]).groupBy("season").agg(
            (F.sum(F.col("rate") * F.col("_w")) / F.sum("_w")).alias("_rate"))
        steps = future.join(mean_step, ["replay", "season"]).join(mean_rate, "season")
    levels = weights.agg((F.sum("_b") / F.sum("_w")).alias("b"), (F.sum("_t") / F.sum("_w")).alias("t"))
    along = W.partitionBy("member").orderBy("step_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    return steps.select(
        "member", "step_no", "year", "season",
        (levels.select("b").scalar() + F.sum("_step").over(along)).alias("rain"),
        (levels.select("t").scalar() + F.sum(F.col("_step") + F.col("_rate")).over(along)).alias("rain_trend"))


def bands(paths: DataFrame, skill_years: int = SKILL_YEARS) -> DataFrame:
    """10/50/90 % over members at each step, and whether the step lies beyond the tested lead."""
    def q(c: str) -> Column:
        return F.percentile(c, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))

    table = paths.groupBy("step_no", "year", "season").agg(q("rain").alias("_r"), q("rain_trend").alias("_t"))
    return table.select(
        "step_no", dates.reading_date(F.col("year"), F.col("season")).alias("date"),
        *[F.col(c)[i].alias(f"{n}_{p}") for c, n in (("_r", "rain"), ("_t", "trend"))
          for i, p in enumerate(("p10", "p50", "p90"))],
        (F.col("step_no") / 4 > skill_years).alias("beyond_tested_skill"))


def entity_changes(start: DataFrame, table: DataFrame, future: DataFrame) -> DataFrame:
    """Median over members of each entity's change from its last reading to the end of the horizon.

    Path ends depend on the cell alone, so they are summed per cell and member before entities join.
    """
    ends = future.join(table.withColumnRenamed("year", "replay"), ["replay", "season"]).groupBy("cell", "member").agg(
        F.sum("step").alias("_end"))
    middle = ends.groupBy("cell").agg(F.percentile("_end", F.lit(0.5)).alias("_m"))
    return start.join(middle, "cell").select("entity", (F.col("base") + F.col("_m") - F.col("depth")).alias("change"))


def history_means(readings: DataFrame, keys: list[str], from_year: int, share: float = 0.5) -> DataFrame:
    """Mean observed value per campaign, without campaigns that read less than ``share`` of the fullest one."""
    table = readings.where(F.col("season_year") >= from_year).groupBy(*keys, "season_year", "season").agg(
        F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("entities"))
    fullest = F.max("entities").over(W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0)))
    return table.withColumn("_f", fullest).where(F.col("entities") >= share * F.col("_f")).drop("_f")


def campaign_readings(readings: DataFrame) -> DataFrame:
    """One reading per entity and campaign: the last of the season."""
    return readings.groupBy("entity", "season_year", "season").agg(
        F.max("date").alias("date"), F.max_by("value", "date").alias("value"))


def regular_changes(campaigns: DataFrame) -> DataFrame:
    """Change from the previous reading where that was exactly one season earlier."""
    number = dates.season_number(F.col("season_year"), dates.season_index(F.col("season")))
    order = W.partitionBy("entity").orderBy("date")
    return campaigns.select("*", windows.regular_step(number).alias("_regular"),
                            (F.col("value") - F.lag("value", 1).over(order)).alias("delta")).where(
        "_regular").drop("_regular")


def backtest(campaigns: DataFrame, entities: DataFrame, table: DataFrame, start_year: int, end_year: int,
             rate: DataFrame | None = None, rate_years: tuple[int, int] | None = None) -> DataFrame:
    """Chain the steps from each entity's last reading of ``start_year`` and compare with what was observed.

    Errors by whole years ahead for the driver alone, the driver with the group trend, no change, and the
    entity's own linear trend over the four years before (at least six readings, else flat). ``rate_years`` are the
    years the group trend was fitted on; a trend that saw a year after the start is refused.
    """
    if rate is not None and (rate_years is None or rate_years[1] > start_year):
        raise ValueError(f"the rates must come from years up to {start_year}, not from {rate_years}")
    when = F.col("season_year") + dates.season_index(F.col("season")) / F.lit(4.0)
    known = campaigns.join(entities.select("entity", "cell", "grp", "state"), "entity")
    start = known.where((F.col("season_year") == start_year) & (F.col("season") == "NOV")).select(
        "entity", F.col("value").alias("_h0"))
    past = known.where((F.col("season_year") > start_year - 4) & (F.col("season_year") <= start_year))
    own = past.groupBy("entity").agg(F.when(F.count(F.lit(1)) >= 6, F.regr_slope(F.col("value"), when))
                                     .otherwise(0.0).alias("_own"))
    later = table.where(F.col("year").between(start_year + 1, end_year)).withColumn("_i", dates.season_index(F.col("season")))
    along = W.partitionBy("cell").orderBy("year", "_i").rowsBetween(W.unboundedPreceding, W.currentRow)
    chain = later.select("cell", F.col("year").alias("season_year"), "season", F.sum("step").over(along).alias("_rain"))
    seen = known.where(F.col("season_year").between(start_year + 1, end_year))
    rows = seen.join(start, "entity").join(own, "entity", "left").join(chain, ["cell", "season_year", "season"])
    t = when - (start_year + 0.75)
    if rate is None:
        trend = F.lit(None).cast("double")
    else:
        order = W.partitionBy("grp", "state").orderBy("season_year", "_i").rowsBetween(
            W.unboundedPreceding, W.currentRow)
        yearly = rate.withColumn("season_year", F.explode(F.sequence(F.lit(start_year + 1), F.lit(end_year))))
        drift = yearly.withColumn("_i", dates.season_index(F.col("season"))).select(
            "grp", "state", "season_year", "season", F.sum("rate").over(order).alias("_drift"))
        rows = rows.join(drift, ["grp", "state", "season_year", "season"])
        trend = F.col("_h0") + F.col("_rain") + F.col("_drift")
    predictors = {"rain_only": F.col("_h0") + F.col("_rain"), "rain_trend": trend, "persistence": F.col("_h0"),
                  "own_trend": F.col("_h0") + F.coalesce("_own", F.lit(0.0)) * t}
    errors = rows.select(F.ceil(t).cast("int").alias("years_ahead"),
                         *[(p - F.col("value")).alias(n) for n, p in predictors.items()])
    return errors.groupBy("years_ahead").agg(
        F.count(F.lit(1)).alias("n"), *[f(n) for n in predictors for f in (
            lambda n: F.avg(F.abs(n)).alias(f"{n}_mae"), lambda n: F.avg(n).alias(f"{n}_bias"))])


def parity(rebuilt: DataFrame, stored: DataFrame, keys: list[str], a: str, b: str, ranges: int | None = None) -> DataFrame:
    """Median and 99th percentile of the absolute difference of two predictions of the same rows."""
    from ..operators.ranking import exact_percentiles
    both = rebuilt.join(stored, keys).select(F.abs(F.col(a) - F.col(b)).alias("difference"))
    return exact_percentiles(both, [], "difference", {"median": 0.5, "p99": 0.99}, ranges)
