"""Grouped statistics, ranks and rolling windows on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import ROLLING_MONTHS
from ..operators import aggregates, ranking, windows
from ..plans import features, review
from . import analog
from .analog import sql
from .registry import R, query, rounded


@query("group_summary", sql(["readings", "entities"], f"""SELECT grp, season, {R('avg(value)', 5)} AS mean, count(value) AS known,
count(*) AS rows, count(DISTINCT entity) AS entities, {R('stddev_samp(value)', 5)} AS std FROM readings JOIN entities USING (entity) GROUP BY 1, 2"""))
def group_summary(spark, sf):
    rows = analog.readings(spark, sf).join(analog.entities(spark, sf), "entity")
    return rounded(aggregates.summary(rows, ["grp", "season"], "value"), 5)


@query("group_quartiles", sql(["readings", "entities"], f"""SELECT grp, season, {R('quantile_cont(value, 0.25)')} AS q25,
{R('quantile_cont(value, 0.5)')} AS median, {R('quantile_cont(value, 0.75)')} AS q75 FROM readings JOIN entities USING (entity) GROUP BY 1, 2"""))
def group_quartiles(spark, sf):
    rows = analog.readings(spark, sf).join(analog.entities(spark, sf), "entity")
    return rounded(ranking.exact_percentiles(rows, ["grp", "season"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}))


@query("segment_profile", sql(["entities"], f"""SELECT segment, count(*) AS entities, {R('quantile_cont(balance, 0.5)')} AS median_balance,
{R('avg(CASE WHEN balance <= 3000 THEN 1.0 ELSE 0.0 END)')} AS share_low FROM entities GROUP BY 1"""))
def segment_profile(spark, sf):
    people = analog.entities(spark, sf)
    counts = people.groupBy("segment").agg(F.count(F.lit(1)).alias("entities"),
                                           F.avg((F.col("balance") <= 3000).cast("double")).alias("share_low"))
    return rounded(counts.join(ranking.exact_percentiles(people, ["segment"], "balance", {"median_balance": 0.5}), "segment"))


@query("percent_missing", sql(["sparse_driver"], f"""SELECT cell, {R('avg(CASE WHEN mm IS NULL THEN 100.0 ELSE 0 END)')} AS missing_pct,
count(*) AS rows FROM sparse_driver GROUP BY 1"""))
def percent_missing(spark, sf):
    return rounded(aggregates.percent_missing(analog.driver(spark, sf, fill=None), ["cell"], "mm"))


@query("season_share", sql(["driver"], f"SELECT {R('sum(mm) FILTER (WHERE month(date) BETWEEN 6 AND 9) / sum(mm)')} AS share FROM driver"))
def season_share(spark, sf):
    return rounded(aggregates.share_of_total(analog.driver(spark, sf), "mm", F.month("date").between(6, 9), "share"))


@query("group_slope", sql(["readings", "entities"], f"""SELECT grp, state, count(*) AS points, CASE WHEN count(*) >= 6 THEN
{R('regr_slope(value, season_year)')} END AS slope FROM (SELECT grp, state, season_year, avg(value) AS value FROM readings
JOIN entities USING (entity) WHERE season = 'NOV' GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def group_slope(spark, sf):
    rows = analog.readings(spark, sf).where("season = 'NOV'").join(analog.entities(spark, sf), "entity")
    yearly = rows.groupBy("grp", "state", "season_year").agg(F.avg("value").alias("value"))
    return rounded(aggregates.slope(yearly, ["grp", "state"], "season_year", "value", "slope", 6))


@query("own_trend", sql(["readings"], f"""SELECT entity, count(*) AS points, CASE WHEN count(*) >= 6 THEN
{R('regr_slope(value, season_year + (quarter(date) - 1) / 4.0)', 5)} ELSE 0 END AS slope FROM readings WHERE season_year BETWEEN 1995 AND 1998 GROUP BY 1"""))
def own_trend(spark, sf):
    rows = analog.readings(spark, sf).where(F.col("season_year") <= 1998).withColumn(
        "t", F.col("season_year") + (F.quarter("date") - 1) / 4.0)
    return rounded(aggregates.slope(rows, ["entity"], "t", "value", "slope", 6, otherwise=0.0), 5)


@query("within_corr", sql(["with_driver"], f"""SELECT grp, CASE WHEN stddev_pop(interval_mm) * stddev_pop(delta) > 0 THEN {R('corr(interval_mm, delta)')} END AS corr, count(*) AS rows FROM with_driver
GROUP BY 1 HAVING count(*) > 30 UNION ALL SELECT 'pooled', {R('corr(interval_mm, delta)')}, count(*) FROM with_driver"""))
def within_corr(spark, sf):
    rows = analog.with_driver(spark, sf, "interval_mm")
    within = aggregates.correlation(rows, ["grp"], "interval_mm", "delta", 30)
    pooled = aggregates.correlation(rows, [], "interval_mm", "delta").select(F.lit("pooled").alias("grp"), "corr", "rows")
    return rounded(within.unionByName(pooled))


def _avg_rank(column: str, source: str) -> str:
    return (f"SELECT {column}, avg(rn) AS rank FROM (SELECT {column}, row_number() OVER (ORDER BY {column}) AS rn "
            f"FROM {source}) GROUP BY 1")


@query("spearman", sql(["with_driver"], f"""SELECT {R('corr(a.rank, b.rank)')} AS spearman, count(*) AS rows FROM with_driver w
JOIN ({_avg_rank('interval_mm', 'with_driver')}) a ON a.interval_mm = w.interval_mm JOIN ({_avg_rank('delta', 'with_driver')}) b ON b.delta = w.delta"""))
def spearman(spark, sf):
    return rounded(ranking.spearman(analog.with_driver(spark, sf, "interval_mm"), "interval_mm", "delta"))


@query("average_ranks", sql(["with_driver"], f"SELECT season, interval_mm, avg(rn) AS rank FROM (SELECT season, interval_mm, "
       "row_number() OVER (PARTITION BY season ORDER BY interval_mm) AS rn FROM with_driver) GROUP BY 1, 2"))
def average_ranks(spark, sf):
    return ranking.average_ranks(analog.with_driver(spark, sf, "interval_mm"), ["season"], "interval_mm", "rank")


analog.define("yearly_driver", ("driver",), """SELECT cell, year(date)::INT AS year, sum(mm) AS mm FROM driver
    WHERE month(date) BETWEEN 6 AND 9 GROUP BY 1, 2""")


def _yearly(spark, sf):
    return analog.driver(spark, sf).where(F.month("date").between(6, 9)).groupBy(
        "cell", F.year("date").alias("year")).agg(F.sum("mm").alias("mm"))


@query("lag1_autocorr", sql(["yearly_driver"], f"""SELECT cell, CASE WHEN stddev_pop(CASE WHEN before IS NOT NULL THEN mm END) * stddev_pop(before) > 0 THEN {R('corr(mm, before)')} END AS autocorr FROM (SELECT cell, mm,
lag(mm) OVER (PARTITION BY cell ORDER BY year) AS before, count(*) OVER (PARTITION BY cell) AS n FROM yearly_driver) WHERE n = 7 GROUP BY 1"""))
def lag1_autocorr(spark, sf):
    return rounded(aggregates.lag1_autocorrelation(_yearly(spark, sf), ["cell"], "mm", "year", 7))


@query("climatology_vs_persistence", sql(["yearly_driver"], f"""SELECT count(*) AS rows, {R('avg(abs(mm - past_mean))', 5)} AS climatology_mae,
{R('avg(abs(mm - previous))', 5)} AS persistence_mae FROM (SELECT *, avg(mm) OVER (PARTITION BY cell ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past_mean,
lag(mm) OVER (PARTITION BY cell ORDER BY year) AS previous FROM yearly_driver) WHERE year BETWEEN 1999 AND 2001"""))
def climatology_vs_persistence(spark, sf):
    return rounded(review.naive_driver_errors(_yearly(spark, sf), "mm", ["cell"], "year", 1999, 2001), 5)


@query("past_mean", sql(["yearly_driver"], f"""SELECT cell, year, mm, {R('avg(mm) OVER (PARTITION BY cell ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)')} AS past_mean,
lag(mm) OVER (PARTITION BY cell ORDER BY year) AS previous FROM yearly_driver"""))
def past_mean(spark, sf):
    return rounded(windows.past_mean_and_last(_yearly(spark, sf), "mm", ["cell"], "year"))


@query("season_total_min_count", sql(["shipped"], """SELECT cell, year(month)::INT AS year, CASE WHEN count(mm) >= 4 THEN sum(mm) END AS season_mm FROM
(SELECT cell, date_trunc('month', date)::DATE AS month, sum(mm) AS mm FROM shipped GROUP BY 1, 2) WHERE month(month) BETWEEN 6 AND 9 GROUP BY 1, 2"""))
def season_total_min_count(spark, sf):
    months = aggregates.monthly(analog.shipped(spark, sf), "mm", F.col("mm") > 2.5, ["cell"])
    return months.where(F.month("month").between(6, 9)).groupBy("cell", F.year("month").alias("year")).agg(
        aggregates.sum_if_complete("mm", 4).alias("season_mm"))


analog.define("monthly_driver", ("driver",), """SELECT cell, date_trunc('month', date)::DATE AS month, sum(mm) AS mm,
    count(*) FILTER (WHERE mm > 2.5) AS wet_days FROM driver GROUP BY 1, 2""")
_ROLL = ", ".join(f"CASE WHEN count(*) OVER w{n} = {n} THEN sum(mm) OVER w{n} END AS mm_{n}m" for n in ROLLING_MONTHS)
_ROLLW = ", ".join(f"w{n} AS (PARTITION BY cell ORDER BY month ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in ROLLING_MONTHS)
analog.define("rolled", ("monthly_driver",), f"SELECT cell, month, mm, wet_days, {_ROLL} FROM monthly_driver WINDOW {_ROLLW}")


def _monthly(spark, sf):
    return aggregates.monthly(analog.driver(spark, sf), "mm", F.col("mm") > 2.5, ["cell"])


@query("rolling_months", sql(["rolled"], """SELECT cell, month, mm, mm_3m, mm_6m, mm_12m, mm_24m, mm_36m, CASE WHEN count(*) OVER w = 12 THEN
(sum(wet_days) OVER w)::BIGINT END AS wet_days_12m FROM rolled WINDOW w AS (PARTITION BY cell ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""))
def rolling_months(spark, sf):
    return windows.rolling_rows(windows.rolling_rows(_monthly(spark, sf), "mm", ROLLING_MONTHS), "wet_days", [12]).drop("wet_days")


@query("month_zscore", sql(["rolled"], f"""SELECT r.cell, r.month, {R('(mm_12m - m) / nullif(s, 0)')} AS mm_12m_z FROM rolled r LEFT JOIN
(SELECT cell, month(month) AS k, avg(mm_12m) AS m, stddev_samp(mm_12m) AS s FROM rolled GROUP BY 1, 2) t ON t.cell = r.cell AND t.k = month(r.month)"""))
def month_zscore(spark, sf):
    return rounded(review.monthly_features(_monthly(spark, sf)).select("cell", "month", "mm_12m_z"))


@query("month_zscore_train", sql(["monthly_driver"], f"""SELECT r.cell, r.month, {R('(mm - m) / nullif(s, 0)')} AS z FROM monthly_driver r LEFT JOIN
(SELECT cell, month(month) AS k, avg(mm) AS m, stddev_samp(mm) AS s FROM monthly_driver WHERE year(month) <= 1998 GROUP BY 1, 2) t ON t.cell = r.cell AND t.k = month(r.month)"""))
def month_zscore_train(spark, sf):
    months = _monthly(spark, sf).withColumn("k", F.month("month"))
    return rounded(windows.z_score(months, "mm", ["cell", "k"], "z", F.year("month") <= analog.TRAIN[1]).select("cell", "month", "z"))


@query("calendar_month_mean", sql(["monthly_driver"], f"SELECT month(month)::INT AS cal_month, {R('avg(mm)')} AS mean FROM monthly_driver GROUP BY 1"))
def calendar_month_mean(spark, sf):
    return rounded(aggregates.calendar_means(_monthly(spark, sf), "mm")[0])


@query("annual_mean", sql(["monthly_driver"], f"SELECT year(month)::INT AS year, {R('avg(mm) * 12')} AS annual FROM monthly_driver GROUP BY 1"))
def annual_mean(spark, sf):
    return rounded(aggregates.calendar_means(_monthly(spark, sf), "mm")[1])


@query("group_month_table", sql(["readings", "entities", "rolled"], f"""SELECT e.grp, e.state, season_year, season, {R('avg(value)', 5)} AS value_mean,
{R('stddev_samp(value)', 5)} AS value_std, count(DISTINCT r.entity) AS entities, {R('avg(mm_12m)', 5)} AS mm_12m, {R('avg(lat)', 5)} AS lat FROM readings r JOIN entities e USING (entity)
LEFT JOIN rolled m ON m.cell = e.cell AND m.month = date_trunc('month', r.date) WHERE e.grp IN (SELECT grp FROM readings JOIN entities USING (entity) GROUP BY 1
HAVING count(DISTINCT entity) >= 3) GROUP BY 1, 2, 3, 4"""))
def group_month_table(spark, sf):
    """Modelling table by group, year and season, for groups of at least three entities."""
    from ..operators.cleaning import grouped_filter
    rows = analog.readings(spark, sf).join(analog.entities(spark, sf), "entity").withColumn("month", F.trunc("date", "month"))
    rows = grouped_filter(rows, ["grp"], "entity", 3).join(
        windows.rolling_rows(_monthly(spark, sf), "mm", [12]).select("cell", "month", "mm_12m"), ["cell", "month"], "left")
    return rounded(rows.groupBy("grp", "state", "season_year", "season").agg(
        F.avg("value").alias("value_mean"), F.stddev_samp("value").alias("value_std"), F.countDistinct("entity").alias("entities"),
        F.avg("mm_12m").alias("mm_12m"), F.avg("lat").alias("lat")), 5)


@query("same_season_lag", sql(["campaign_readings"], f"""SELECT entity, season, season_year, {R('lag(value) OVER (PARTITION BY entity, season ORDER BY season_year)')} AS value_lag
FROM campaign_readings"""))
def same_season_lag(spark, sf):
    from ..plans.forecast import campaign_readings
    rows = windows.same_season_lag(campaign_readings(analog.readings(spark, sf)), "value", "value_lag", order="season_year")
    return rounded(rows.select("entity", "season", "season_year", "value_lag"))


@query("regular_steps", sql(["campaign_readings"], f"""SELECT entity, season_year, season, {R('value - v')} AS delta FROM (SELECT *, q - lag(q) OVER w AS step, lag(value) OVER w AS v FROM
(SELECT *, season_year * 4 + list_position(['JAN','MAY','AUG','NOV'], season) AS q FROM campaign_readings) WINDOW w AS (PARTITION BY entity ORDER BY date)) WHERE step = 1"""))
def regular_steps(spark, sf):
    from ..plans.forecast import campaign_readings, regular_changes
    rows = regular_changes(campaign_readings(analog.readings(spark, sf)))
    return rounded(rows.select("entity", "season_year", "season", "delta"))


@query("skewness", sql(["readings"], f"""SELECT {R('skewness(value)', 5)} AS raw, {R('skewness(ln(1 + value))', 5)} AS log FROM readings"""))
def skewness(spark, sf):
    rows = analog.readings(spark, sf).withColumn("log_value", F.log1p("value"))
    raw = aggregates.skewness(rows, "value", "raw")
    return rounded(raw.withColumn("log", aggregates.skewness(rows, "log_value", "log").scalar()), 5)


@query("histogram", sql(["changes"], """SELECT least(floor((least(greatest(delta, -300), 300) + 300) / 10) + 1, 60)::INT AS bin, count(*) AS rows FROM changes GROUP BY 1"""))
def histogram(spark, sf):
    return aggregates.histogram(features.changes(analog.readings(spark, sf)), "delta", -300.0, 300.0, 60)


@query("time_bins", sql(["driver"], f"""SELECT x::INT AS bin, {R('avg(mm)')} AS mm FROM (SELECT date - DATE '1995-01-01' AS i, avg(mm) AS mm FROM driver GROUP BY 1) d
JOIN range(0, 300) g(x) ON i >= (x * 2557) // 300 AND i < greatest((x * 2557) // 300 + 1, ((x + 1) * 2557) // 300) GROUP BY 1"""))
def time_bins(spark, sf):
    daily = analog.driver(spark, sf).groupBy(F.datediff("date", F.to_date(F.lit(analog.FIRST_DAY))).alias("i")).agg(F.avg("mm").alias("mm"))
    return rounded(aggregates.time_bins(daily, "i", "mm", 2557, 300))


@query("rise_fall", sql(["changes"], """SELECT season_year, season, count(delta) AS known, count(*) FILTER (WHERE delta > 0) AS fell,
count(*) FILTER (WHERE delta <= 0) AS rose FROM changes GROUP BY 1, 2"""))
def rise_fall(spark, sf):
    return aggregates.rise_fall(features.changes(analog.readings(spark, sf)), ["season_year", "season"], "delta")


@query("day_summary", sql(["sparse_driver"], f"""SELECT date, {R('avg(coalesce(mm, 0))')} AS mean_mm, max(coalesce(mm, 0)) AS max_mm,
count(*) FILTER (WHERE mm >= 64.5) AS heavy_cells, count(*) FILTER (WHERE mm >= 2.5) AS cells_with_rain FROM sparse_driver GROUP BY 1"""))
def day_summary(spark, sf):
    return rounded(aggregates.day_summary(analog.driver(spark, sf, fill=None), "mm", ["date"]))


@query("day_cells", sql(["sparse_driver"], """SELECT cell, date, mm FROM sparse_driver WHERE mm >= 0.6 AND date = DATE '1998-07-26'"""))
def day_cells(spark, sf):
    from ..functions.constants import SHOWN_DAY_MM
    return analog.driver(spark, sf, fill=None).where((F.col("date") == F.to_date(F.lit("1998-07-26"))) & (F.col("mm") >= SHOWN_DAY_MM))


@query("within_spread", sql(["with_driver"], f"""SELECT feature, {R('avg(s)', 5)} AS mean_std, {R('median(s)', 5)} AS median_std, {R('max(s)', 5)} AS max_std, count(s) AS entities FROM (SELECT entity, 'gap' AS feature,
stddev_samp(gap) AS s FROM with_driver GROUP BY 1 UNION ALL SELECT entity, 'balance', stddev_samp(balance) FROM with_driver GROUP BY 1 UNION ALL
SELECT entity, 'interval_mm', stddev_samp(interval_mm) FROM with_driver GROUP BY 1) GROUP BY 1"""))
def within_spread(spark, sf):
    return rounded(aggregates.mean_within_std(analog.with_driver(spark, sf, "interval_mm"), "entity", ["gap", "balance", "interval_mm"]), 5)


@query("running_sum", sql(["driver"], "SELECT cell, date, cum FROM driver"))
def running_sum(spark, sf):
    return windows.running_sum(analog.driver(spark, sf), "mm", "cum").drop("mm")


@query("topk_overlap", sql(["readings", "entities"], """WITH s AS (SELECT grp, regr_slope(value, season_year) AS a, avg(value) AS b FROM readings JOIN entities USING (entity) GROUP BY 1)
SELECT * FROM (SELECT count(*) AS overlap FROM (SELECT grp FROM s ORDER BY a DESC, grp LIMIT 10) x JOIN (SELECT grp FROM s ORDER BY b DESC, grp LIMIT 10) y USING (grp))""".replace(
    "WITH s AS", "SELECT * FROM (WITH s AS") + ")"))
def topk_overlap(spark, sf):
    rows = analog.readings(spark, sf).join(analog.entities(spark, sf), "entity").groupBy("grp").agg(
        F.regr_slope("value", F.col("season_year").cast("double")).alias("a"), F.avg("value").alias("b"))
    first, second = rows.select("grp", F.col("a").alias("score")), rows.select("grp", F.col("b").alias("score"))
    return ranking.top_overlap(first, second, ["grp"], "score", 10)


@query("top_wettest_days", sql(["driver"], "SELECT cell, date, mm FROM driver ORDER BY mm DESC, cell, date LIMIT 20"))
def top_wettest_days(spark, sf):
    return ranking.top_rows(analog.driver(spark, sf), [F.desc("mm"), F.asc("cell"), F.asc("date")], 20)
