"""Feature pipeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..functions.constants import HEAVY_MM, TRAILING_DAYS, WET_MM, CHANNELS
from ..operators import aggregates, cleaning, encode, joins, quality, series, splits, windows
from ..plans import features, sequences
from . import analog
from .analog import sql
from .registry import R, query, r, rounded


@query("delta_target", sql(["changes"], f"""
SELECT entity, date, prev_date, prev_season, gap, {R('delta')} AS delta, split FROM changes"""))
def delta_target(spark, sf):
    rows = features.changes(analog.readings(spark, sf)).withColumn(
        "split", cleaning.year_split(F.col("season_year"), analog.TRAIN, analog.VALID))
    return rows.select("entity", "date", "prev_date", "prev_season", "gap", r("delta").alias("delta"), "split")


@query("outlier_filter", sql(["changes"], f"""
SELECT entity, date, {R('delta')} AS delta FROM changes WHERE abs(delta) <= 100"""))
def outlier_filter(spark, sf):
    return features.changes(analog.readings(spark, sf), largest=100.0).select("entity", "date", r("delta").alias("delta"))


@query("interval_sum", sql(["with_driver"], "SELECT entity, date, cell, interval_mm FROM with_driver"))
def interval_sum(spark, sf):
    return analog.with_driver(spark, sf, "interval_mm").select("entity", "date", "cell", "interval_mm")


@query("interval_sum_join", sql(["with_driver"], "SELECT entity, date, interval_mm FROM with_driver"))
def interval_sum_join(spark, sf):
    rows = series.interval_sums_by_join(analog.intervals(spark, sf), analog.driver(spark, sf), "mm", "interval_mm")
    return rows.select("entity", "date", "interval_mm")


_TRAIL = ", ".join(f"CASE WHEN date - DATE '1995-01-01' + 1 >= {d} THEN sum(mm) OVER (PARTITION BY cell ORDER BY date "
                   f"RANGE BETWEEN INTERVAL {d - 1} DAYS PRECEDING AND CURRENT ROW) END AS mm_{d}d" for d in TRAILING_DAYS)


@query("trailing_window", sql(["driver"], f"SELECT cell, date, {_TRAIL} FROM driver"))
def trailing_window(spark, sf):
    return windows.trailing_days(analog.driver(spark, sf), "mm", TRAILING_DAYS).drop("mm")


analog.define("trails", ("driver",), f"SELECT cell, date, {_TRAIL} FROM driver")


@query("trailing_sums", sql(["intervals", "trails"], "SELECT entity, i.date, " + ", ".join(
    f"mm_{d}d" for d in TRAILING_DAYS) + " FROM intervals i JOIN trails t ON t.cell = i.cell AND t.date = i.date"))
def trailing_sums(spark, sf):
    names = [f"mm_{d}d" for d in TRAILING_DAYS]
    return analog.with_driver(spark, sf, *names).select("entity", "date", *names)


analog.define("intensity", ("intervals", "driver"), """SELECT i.entity, i.date,
    count(*) FILTER (WHERE d.mm >= 2.5) AS wet_days, count(*) FILTER (WHERE d.mm >= 35) AS heavy_days,
    max(d.mm) AS max_day_mm, sum(d.mm) AS interval_mm
    FROM intervals i JOIN driver d ON d.cell = i.cell AND d.date > i.prev_date AND d.date <= i.date GROUP BY 1, 2""")


@query("interval_intensity", sql(["intensity"], f"""SELECT entity, date, wet_days, heavy_days, max_day_mm,
{R('interval_mm / greatest(wet_days, 1)')} AS per_wet_day FROM intensity"""))
def interval_intensity(spark, sf):
    return rounded(analog.with_driver(spark, sf, "wet_days", "heavy_days", "max_day_mm", "per_wet_day").select(
        "entity", "date", "wet_days", "heavy_days", "max_day_mm", "per_wet_day"))


@query("interval_days_join", sql(["intensity"], "SELECT entity, date, wet_days, heavy_days, max_day_mm FROM intensity"))
def interval_days_join(spark, sf):
    days = joins.days_of_intervals(analog.intervals(spark, sf), analog.driver(spark, sf), ["entity", "date"])
    return days.groupBy("entity", "date").agg(
        F.count_if(F.col("mm") >= WET_MM).alias("wet_days"), F.count_if(F.col("mm") >= HEAVY_MM).alias("heavy_days"),
        F.max("mm").alias("max_day_mm"))


@query("season_total", sql(["intervals", "driver"], """SELECT i.entity, i.date, coalesce(m.total, 0) AS monsoon_mm
FROM intervals i LEFT JOIN (SELECT cell, year(date) AS y, sum(mm) AS total FROM driver WHERE month(date) BETWEEN 6 AND 9
GROUP BY 1, 2) m ON m.cell = i.cell AND m.y = year(i.date) - CASE WHEN month(i.date) >= 10 THEN 0 ELSE 1 END"""))
def season_total(spark, sf):
    return analog.with_driver(spark, sf, "monsoon_mm").select("entity", "date", "monsoon_mm")


@query("row_lags", sql(["with_driver"], """SELECT entity, date, lag(interval_mm, 1) OVER w AS interval_mm_lag1,
lag(interval_mm, 2) OVER w AS interval_mm_lag2, lag(interval_mm, 3) OVER w AS interval_mm_lag3
FROM with_driver WINDOW w AS (PARTITION BY entity ORDER BY date)"""))
def row_lags(spark, sf):
    rows = analog.with_driver(spark, sf, "interval_mm").select("entity", "date", "interval_mm")
    return windows.row_lags(rows, "interval_mm", [1, 2, 3]).drop("interval_mm")


@query("prior_k_sums", sql(["with_driver"], "SELECT entity, date, " + ", ".join(
    f"CASE WHEN count(interval_mm) OVER w{k} = {k} THEN sum(interval_mm) OVER w{k} END AS interval_mm_prior{k}"
    for k in (4, 8, 12)) + " FROM with_driver WINDOW " + ", ".join(
    f"w{k} AS (PARTITION BY entity ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (4, 8, 12))))
def prior_k_sums(spark, sf):
    rows = analog.with_driver(spark, sf, "interval_mm").select("entity", "date", "interval_mm")
    return windows.prior_sums(rows, "interval_mm", [4, 8, 12]).drop("interval_mm")


analog.define("season_normals", ("with_driver",), """SELECT entity, season, avg(interval_mm) AS normal_season_mm
    FROM with_driver WHERE split = 'train' GROUP BY 1, 2""")


@query("train_normals", sql(["season_normals"], f"""SELECT entity, season, {R('normal_season_mm')} AS normal_season_mm
FROM season_normals"""))
def train_normals(spark, sf):
    rows = analog.with_driver(spark, sf, "interval_mm")
    return rounded(aggregates.train_mean(rows, ["entity", "season"], "interval_mm", "normal_season_mm",
                                         analog.is_train()))


@query("anomalies", sql(["with_driver", "season_normals"], f"""SELECT entity, date,
{R('interval_mm - normal_season_mm')} AS anom_season_mm,
{R('interval_mm / nullif(normal_season_mm, 0)')} AS anom_season_ratio
FROM with_driver LEFT JOIN season_normals USING (entity, season)"""))
def anomalies(spark, sf):
    rows = analog.with_driver(spark, sf, "interval_mm")
    normal = aggregates.train_mean(rows, ["entity", "season"], "interval_mm", "normal_season_mm", analog.is_train())
    out = joins.with_normals(rows, [(normal, ["entity", "season"])])
    return rounded(out.select(
        "entity", "date", (F.col("interval_mm") - F.col("normal_season_mm")).alias("anom_season_mm"),
        numbers.ratio_or_null(F.col("interval_mm"), F.col("normal_season_mm")).alias("anom_season_ratio")))


_MONSOON = """LEFT JOIN (SELECT cell, year(date) AS y, sum(mm) AS monsoon_mm FROM driver
    WHERE month(date) BETWEEN 6 AND 9 GROUP BY 1, 2) m
    ON m.cell = w.cell AND m.y = year(w.date) - CASE WHEN month(w.date) >= 10 THEN 0 ELSE 1 END"""
analog.define("table_rows", ("with_driver", "intensity", "trails", "driver"), f"""SELECT w.*, wet_days, heavy_days,
    max_day_mm, {', '.join(f'mm_{d}d' for d in TRAILING_DAYS)}, coalesce(monsoon_mm, 0) AS monsoon_mm,
    lag(w.interval_mm, 1) OVER e AS lag1, lag(w.interval_mm, 3) OVER e AS lag3,
    CASE WHEN count(*) OVER p4 = 4 THEN sum(w.interval_mm) OVER p4 END AS prior4
    FROM with_driver w JOIN intensity i ON i.entity = w.entity AND i.date = w.date
    JOIN trails t ON t.cell = w.cell AND t.date = w.date {_MONSOON}
    WINDOW e AS (PARTITION BY w.entity ORDER BY w.date),
    p4 AS (PARTITION BY w.entity ORDER BY w.date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")


@query("feature_table", sql(["table_rows"], f"""SELECT t.entity, t.date, t.split, gap, {R('delta')} AS delta,
prev_season || '_' || t.season AS transition, interval_mm, {R('interval_mm / gap')} AS interval_per_day,
mm_30d, mm_730d, t.monsoon_mm, wet_days, heavy_days, max_day_mm, lag1 AS interval_mm_lag1, lag3 AS interval_mm_lag3,
prior4 AS interval_mm_prior4, {R('a.v')} AS normal_annual_mm, {R('a.m')} AS normal_monsoon_mm,
{R('mm_365d - a.v')} AS anom_annual_mm, {R('t.monsoon_mm - a.m')} AS anom_monsoon_mm,
{R('interval_mm - s.v')} AS anom_season_mm
FROM table_rows t
LEFT JOIN (SELECT entity, avg(mm_365d) AS v, avg(monsoon_mm) AS m FROM table_rows WHERE split = 'train' GROUP BY 1) a
  ON a.entity = t.entity
LEFT JOIN (SELECT entity, season, avg(interval_mm) AS v FROM table_rows WHERE split = 'train' GROUP BY 1, 2) s
  ON s.entity = t.entity AND s.season = t.season"""))
def feature_table(spark, sf):
    rows = features.feature_table(analog.readings(spark, sf), analog.entities(spark, sf), analog.packed(spark, sf),
                                  analog.TRAIN, analog.VALID, analog.TEST)
    return rounded(rows.select(
        "entity", "date", "split", "gap", "delta", "transition", "interval_mm", "interval_per_day", "mm_30d", "mm_730d",
        "monsoon_mm", "wet_days", "heavy_days", "max_day_mm", "interval_mm_lag1", "interval_mm_lag3",
        "interval_mm_prior4", "normal_annual_mm", "normal_monsoon_mm", "anom_annual_mm", "anom_monsoon_mm",
        "anom_season_mm"))


analog.define("slots", ("driver",), """SELECT cell, date, mm, greatest(0, least(dayofyear(date), 365) - 1
    - CASE WHEN month(date) > 2 AND dayofyear(make_date(year(date)::BIGINT, 12, 31)) = 366 THEN 1 ELSE 0 END)::INT AS slot FROM driver""")
analog.define("slot_normals", ("slots",), """SELECT cell, slot, avg(mm) AS normal FROM slots WHERE year(date) <= 1998
    GROUP BY 1, 2""")
analog.define("smooth", ("slot_normals",), """SELECT n.cell, n.slot, any_value(n.normal) AS normal, avg(m.normal) AS smooth
    FROM slot_normals n JOIN slot_normals m ON m.cell = n.cell
    AND least(abs(m.slot - n.slot), 365 - abs(m.slot - n.slot)) <= 15 GROUP BY 1, 2""")


def _in_train(spark, sf):
    return F.year("date") <= analog.TRAIN[1]


@query("doy_normals", sql(["slot_normals"], f"SELECT cell, slot, {R('normal')} AS normal FROM slot_normals"))
def doy_normals(spark, sf):
    return rounded(aggregates.slot_means(analog.driver(spark, sf), "mm", _in_train(spark, sf)))


@query("smoothed_normals", sql(["smooth"], f"""SELECT cell, slot, {R('normal')} AS normal, {R('smooth')} AS smooth
FROM smooth"""))
def smoothed_normals(spark, sf):
    return rounded(sequences.smoothed_normals(analog.driver(spark, sf), _in_train(spark, sf)))


def packed_weeks(spark, sf, daily=None):
    recorded = analog.driver(spark, sf)
    normals = sequences.smoothed_normals(recorded, _in_train(spark, sf))
    return sequences.pack_weeks(recorded if daily is None else daily, normals)


def cell_weekly(spark, sf, daily=None):
    return sequences.attach_cell_weeks(analog.intervals(spark, sf), packed_weeks(spark, sf, daily))


def weekly(spark, sf, keep, daily=None):
    """Long form of the sequences: a row per reading and week."""
    return sequences.week_rows(cell_weekly(spark, sf, daily), keep)


def _weeks_sql(weeks: int) -> str:
    """Week ``k`` of each reading by joining its days, the direct way."""
    return f"""SELECT i.entity, i.date, CAST({weeks - 1} - (i.date - d.date) // 7 AS INT) AS week, sum(d.mm) AS rain_mm,
    count(*) FILTER (WHERE d.date > i.prev_date) / 7.0::DOUBLE AS in_interval,
    max(CASE WHEN (i.date - d.date) % 7 = 3 THEN sin(2 * pi() * (dayofyear(d.date) - 1) / 365.25) END) AS doy_sin,
    max(CASE WHEN (i.date - d.date) % 7 = 3 THEN cos(2 * pi() * (dayofyear(d.date) - 1) / 365.25) END) AS doy_cos,
    sum(d.mm - s.smooth) AS rain_anom_mm, count(*) FILTER (WHERE d.mm >= 2.5) / 7.0::DOUBLE AS wet_frac
    FROM intervals i JOIN slots d ON d.cell = i.cell AND d.date > i.date - {weeks * 7} AND d.date <= i.date
    JOIN smooth s ON s.cell = d.cell AND s.slot = d.slot
    WHERE i.date - DATE '1995-01-01' + 1 >= {weeks * 7} GROUP BY 1, 2, 3"""


analog.define("weeks", ("intervals", "slots", "smooth"), _weeks_sql(104))


@query("weekly_sequence", sql(["weeks"], f"""SELECT entity, date, count(*) AS weeks, {R('sum(rain_mm)')} AS rain_mm,
{R('sum(in_interval * week)')} AS in_interval, {R('sum(doy_sin * week)')} AS doy_sin, {R('sum(doy_cos * week)')} AS doy_cos,
{R('sum(rain_anom_mm * week)', 4)} AS rain_anom_mm, {R('sum(wet_frac * week)')} AS wet_frac,
{R('sum(rain_mm * week)')} AS rain_by_week FROM weeks GROUP BY 1, 2"""))
def weekly_sequence(spark, sf):
    """Every channel of every week, folded to one checksum per channel and reading (weighted by the week number)."""
    long = weekly(spark, sf, ["entity", "date"])
    return rounded(long.groupBy("entity", "date").agg(
        F.count(F.lit(1)).alias("weeks"), F.sum("rain_mm").alias("rain_mm"),
        *[F.sum(F.col(c) * F.col("week")).alias(c) for c in CHANNELS[1:]],
        F.sum(F.col("rain_mm") * F.col("week")).alias("rain_by_week")), rain_anom_mm=4)


@query("sequence_by_week", sql(["weeks", "intervals"], f"""SELECT split, week, count(*) AS rows,
{R('avg(rain_mm)')} AS rain_mm, {R('avg(in_interval)')} AS in_interval, {R('avg(rain_anom_mm)')} AS rain_anom_mm,
{R('avg(wet_frac)')} AS wet_frac FROM weeks JOIN intervals USING (entity, date) GROUP BY 1, 2"""))
def sequence_by_week(spark, sf):
    return rounded(weekly(spark, sf, ["split"]).groupBy("split", "week").agg(
        F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(c) for c in ("rain_mm", "in_interval", "rain_anom_mm", "wet_frac")]))


@query("channel_summary", sql(["weeks"], " UNION ALL ".join(
    f"SELECT '{c}' AS channel, {R(f'avg({c})')} AS mean, {R(f'stddev_pop({c})', 4)} AS std, {R(f'min({c})')} AS min, {R(f'max({c})')} AS max FROM weeks"
    for c in CHANNELS)))
def channel_summary(spark, sf):
    return rounded(quality.channel_summary(weekly(spark, sf, []), CHANNELS), std=4)


@query("interval_self_check", sql(["weeks", "intervals"], """SELECT 0.0::DOUBLE AS largest, count(*) AS rows FROM
(SELECT DISTINCT entity, date FROM weeks)"""))
def interval_self_check(spark, sf):
    return rounded(sequences.interval_mismatch(sequences.attach_weeks(cell_weekly(spark, sf))))


@query("channel_stats", sql(["weeks", "intervals"], f"""SELECT {R('avg(ln(1 + greatest(rain_mm, 0)))')} AS rain_mm_mean,
{R('stddev_pop(ln(1 + greatest(rain_mm, 0)))')} AS rain_mm_std,
{R('avg(sign(rain_anom_mm) * ln(1 + abs(rain_anom_mm)))')} AS rain_anom_mm_mean,
{R('stddev_pop(sign(rain_anom_mm) * ln(1 + abs(rain_anom_mm)))')} AS rain_anom_mm_std
FROM weeks JOIN intervals USING (entity, date) WHERE split = 'train'"""))
def channel_stats(spark, sf):
    return rounded(encode.channel_stats(weekly(spark, sf, ["split"]).where(analog.is_train())))


analog.define("squashed", ("weeks", "intervals"), """SELECT split, week, ln(1 + greatest(rain_mm, 0)) AS a,
    sign(rain_anom_mm) * ln(1 + abs(rain_anom_mm)) AS b FROM weeks JOIN intervals USING (entity, date)""")


@query("scaled_channels", sql(["squashed"], f"""SELECT v.split, week, count(*) AS rows,
{R('avg((a - ma) / sa)')} AS rain_mm, {R('avg((b - mb) / sb)')} AS rain_anom_mm
FROM squashed v, (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM squashed
WHERE split = 'train') GROUP BY 1, 2"""))
def scaled_channels(spark, sf):
    rows = weekly(spark, sf, ["split"])
    stats = encode.channel_stats(rows.where(analog.is_train())).first().asDict()
    return rounded(encode.scale_channels(rows, stats, CHANNELS).groupBy("split", "week").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("rain_mm").alias("rain_mm"), F.avg("rain_anom_mm").alias("rain_anom_mm")))


@query("rain_scaling", sql(["weeks"], f"""SELECT week, {R('avg(rain_mm * 1.2)')} AS rain_mm,
{R('avg(rain_anom_mm + 0.2 * rain_mm)')} AS rain_anom_mm, {R('avg(wet_frac)')} AS wet_frac FROM weeks GROUP BY 1"""))
def rain_scaling(spark, sf):
    return rounded(sequences.scale_rain(weekly(spark, sf, []), 1.2).groupBy("week").agg(
        *[F.avg(c).alias(c) for c in ("rain_mm", "rain_anom_mm", "wet_frac")]))


@query("week_mean_array", sql(["weeks"], f"SELECT week AS pos, {R('avg(rain_mm)')} AS mean, count(*) AS rows FROM weeks GROUP BY 1"))
def week_mean_array(spark, sf):
    rows = cell_weekly(spark, sf).select(F.col("weeks.rain_mm").alias("a"))
    return rounded(aggregates.array_means(rows, "a"))


def _patches(spark, sf, kept, count):
    from ..functions.arrays import patches as cut
    rows = cell_weekly(spark, sf).where(F.col("weeks").isNotNull())
    long = rows.select("entity", "date", F.posexplode(cut(kept(F.col("weeks.rain_mm")), 4, count)).alias("patch", "p"))
    return long.select("entity", "date", "patch", F.aggregate("p", F.lit(0.0), lambda a, v: a + v).alias("rain_mm"))


@query("patches", sql(["weeks"], "SELECT entity, date, CAST(week // 4 AS INT) AS patch, sum(rain_mm) AS rain_mm FROM weeks GROUP BY 1, 2, 3"))
def patches(spark, sf):
    """All 104 weeks as 26 patches of four."""
    return _patches(spark, sf, lambda a: a, 26)


@query("patches_last_year", sql(["weeks"], """SELECT entity, date, CAST((week - 52) // 4 AS INT) AS patch,
sum(rain_mm) AS rain_mm FROM weeks WHERE week >= 52 GROUP BY 1, 2, 3"""))
def patches_last_year(spark, sf):
    """The last 52 weeks alone."""
    from ..functions.arrays import keep_last
    return _patches(spark, sf, lambda a: keep_last(a, 52), 13)


_NUM = ["gap", "interval_mm", "mm_365d", "balance"]
analog.define("numeric_long", ("intervals", "table_rows"), "SELECT entity, date, split, feature, v FROM (SELECT entity, date, split, "
              "CAST(gap AS DOUBLE) AS gap, CAST(interval_mm AS DOUBLE) AS interval_mm, CAST(mm_365d AS DOUBLE) AS mm_365d, balance "
              "FROM table_rows) UNPIVOT INCLUDE NULLS (v FOR feature IN (gap, interval_mm, mm_365d, balance))")


def _numeric_rows(spark, sf):
    rows = analog.with_driver(spark, sf, "interval_mm", "mm_365d")
    return rows.select("entity", "date", "split", *[F.col(c).cast("double").alias(c) for c in _NUM])


analog.define("numeric_stats", ("numeric_long",), """SELECT feature, any_value(m) AS median, avg(coalesce(v, m)) AS mean,
    CASE WHEN stddev_pop(coalesce(v, m)) < 1e-6 THEN 1 ELSE stddev_pop(coalesce(v, m)) END AS std
    FROM numeric_long JOIN (SELECT feature, quantile_cont(v, 0.5) AS m FROM numeric_long WHERE split = 'train' GROUP BY 1)
    USING (feature) WHERE split = 'train' GROUP BY 1""")


@query("numeric_stats", sql(["numeric_stats"], f"""SELECT feature, {R('median')} AS median, {R('mean')} AS mean,
{R('std', 4)} AS std FROM numeric_stats"""))
def numeric_stats(spark, sf):
    return rounded(encode.numeric_stats(_numeric_rows(spark, sf), _NUM, analog.is_train()), std=4)


@query("encode_numeric", sql(["numeric_long", "numeric_stats"], "SELECT entity, date, " + ", ".join(
    R(f"max((coalesce(v, median) - mean) / std) FILTER (WHERE feature = '{c}')") + f" AS {c}" for c in _NUM)
    + " FROM numeric_long JOIN numeric_stats USING (feature) GROUP BY 1, 2"))
def encode_numeric(spark, sf):
    rows = _numeric_rows(spark, sf)
    stats = encode.saved(encode.numeric_stats(rows, _NUM, analog.is_train()))
    return rounded(encode.encode_numeric(rows, _NUM, stats).drop("split"))


@query("encode_category", sql(["changes"], """SELECT entity, date, prev_season || '_' || season AS transition,
coalesce(l.code, (SELECT count(*) FROM (SELECT DISTINCT prev_season, season FROM changes WHERE season_year = 1995)))::INT AS code
FROM changes c LEFT JOIN (SELECT t, row_number() OVER (ORDER BY t) - 1 AS code FROM
(SELECT DISTINCT prev_season || '_' || season AS t FROM changes WHERE season_year = 1995)) l ON l.t = prev_season || '_' || season"""))
def encode_category(spark, sf):
    """The first year never shows a January reading after a gap, so some later transitions are unseen."""
    rows = features.changes(analog.readings(spark, sf)).withColumn(
        "transition", cleaning.transition(F.col("prev_season"), F.col("season")))
    levels = encode.category_levels(rows, "transition", F.col("season_year") == analog.FIRST_YEAR)
    return encode.encode_category(rows, "transition", levels, "code").select("entity", "date", "transition", "code")


def _order_sql(key: str, source: str, seed: int = 42) -> str:
    return (f"SELECT k, row_number() OVER (ORDER BY md5(k || '|{seed}'), k) - 1 AS place, count(*) OVER () AS n "
            f"FROM (SELECT DISTINCT CAST({key} AS VARCHAR) AS k FROM {source})")


@query("fold_assign", sql(["intervals"], f"""SELECT k AS grp, (place % 5)::INT AS fold FROM ({_order_sql('grp', 'intervals')})"""))
def fold_assign(spark, sf):
    return splits.fold_of(analog.intervals(spark, sf), "grp")


@query("grouped_split", sql(["changes"], f"""SELECT CAST(k AS BIGINT) AS entity,
CASE WHEN place < round_even(n * 0.15::DOUBLE, 0) THEN 'test'
     WHEN place < round_even(n * 0.15::DOUBLE, 0) * 2 THEN 'valid' ELSE 'train' END AS split
FROM ({_order_sql('entity', 'changes')})"""))
def grouped_split(spark, sf):
    return splits.entity_split(features.changes(analog.readings(spark, sf)), "entity")


analog.define("random_split", ("changes",), f"""SELECT CAST(k AS BIGINT) AS entity,
    CASE WHEN place < round_even(n * 0.15::DOUBLE, 0) THEN 'test'
    WHEN place < round_even(n * 0.15::DOUBLE, 0) * 2 THEN 'valid' ELSE 'train' END AS random_split
    FROM ({_order_sql('entity', 'changes')})""")


@query("split_leak_check", sql(["changes", "random_split"], """SELECT count(*) FILTER (WHERE n > 1) AS crossing, count(*) AS entities
FROM (SELECT entity, count(DISTINCT random_split) AS n FROM changes JOIN random_split USING (entity) GROUP BY 1)"""))
def split_leak_check(spark, sf):
    rows = features.changes(analog.readings(spark, sf))
    return splits.crossing_entities(rows.join(splits.entity_split(rows, "entity"), "entity"), "entity")


@query("split_balance", sql(["changes", "random_split"], f"""SELECT random_split AS split, count(*) AS rows,
count(DISTINCT entity) AS entities, {R('avg(delta)', 5)} AS mean, {R('stddev_samp(delta)', 5)} AS std
FROM changes JOIN random_split USING (entity) GROUP BY 1"""))
def split_balance(spark, sf):
    rows = features.changes(analog.readings(spark, sf))
    return rounded(splits.split_balance(rows.join(splits.entity_split(rows, "entity"), "entity"), "entity", "delta"), 5)


@query("year_split_report", sql(["changes"], f"""SELECT coalesce(split, 'all') AS split, count(*) AS rows,
count(DISTINCT entity) AS entities, {R('avg(delta)', 5)} AS mean, {R('stddev_samp(delta)', 5)} AS std
FROM changes GROUP BY ROLLUP (split)"""))
def year_split_report(spark, sf):
    rows = features.changes(analog.readings(spark, sf)).withColumn(
        "split", cleaning.year_split(F.col("season_year"), analog.TRAIN, analog.VALID))
    return rounded(quality.build_report(rows, "entity", "delta"), 5)


@query("feature_spec")
def feature_spec(spark, sf):
    """Roles of the feature table's columns, after the guard that no forbidden column is a feature."""
    rows = features.feature_table(analog.readings(spark, sf), analog.entities(spark, sf), analog.packed(spark, sf),
                                  analog.TRAIN, analog.VALID, analog.TEST)
    meta = ["entity", "date", "prev_date", "value", "value_start", "season_year", "cell", "grp", "state", "lat", "lon",
            "split", "prev_season"]
    spec = cleaning.feature_spec(rows, "delta", meta, ["season", "segment", "transition"])
    chosen = [c for c in rows.columns if c not in meta and c != "delta"]
    cleaning.assert_no_leakage(chosen, "delta", meta)
    known = rows.agg(*[F.count(c).alias(c) for c in rows.columns]).unpivot([], rows.columns, "column", "known")
    return spec.join(known, "column")


@query("forward_calendar", sql(["readings"], """SELECT entity, date, CAST(greatest(0, least(dayofyear(date), 365) - 1
- CASE WHEN month(date) > 2 AND dayofyear(make_date(year(date)::BIGINT, 12, 31)) = 366 THEN 1 ELSE 0 END) AS INT) AS slot,
CASE WHEN month(date) BETWEEN 6 AND 9 THEN 'south-west monsoon' WHEN month(date) >= 10 THEN 'post-monsoon'
WHEN month(date) <= 2 THEN 'winter' ELSE 'pre-monsoon' END AS part_of_year,
CAST(date + INTERVAL 3 YEAR AS DATE) AS later,
CAST(1995 + ((2 + season_year + 7 - 2002) % 7 + 7) % 7 AS INT) AS replay FROM readings"""))
def forward_calendar(spark, sf):
    d = F.col("date")
    return analog.readings(spark, sf).select(
        "entity", "date", dates.day_slot(d).alias("slot"), dates.weather_season(d).alias("part_of_year"),
        dates.shift_years(d, 3).alias("later"),
        dates.replay_year(F.lit(2), F.col("season_year") + 7, analog.FIRST_YEAR, analog.LAST_YEAR).alias("replay"))
