"""Scans, keys, filters, labels and gap filling on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, strings
from ..functions.constants import BLANK_TOKENS
from ..operators import aggregates, cleaning, joins, quality, ranking, series, windows
from ..sources import grid, wide
from . import analog
from .analog import sql, table
from .registry import R, query, r, rounded

_QUARTERS = [f"{m}-{y:02d}" for y in (*range(95, 100), 0, 1) for m in ("Jan", "May", "Aug", "Nov")]


def wide_orders(spark, sf):
    """Orders as a wide file: one row per customer, one column per campaign with the last reading of the quarter."""
    rows = analog.readings(spark, sf)
    label = F.concat(F.initcap("season"), F.lit("-"), F.date_format("date", "yy"))
    rows = rows.withColumn("campaign", label)
    last = rows.groupBy("entity", "campaign").agg(F.max_by("value", "date").alias("value"))
    return aggregates.pivot(last, ["entity"], "campaign", _QUARTERS, "value")


@query("unpivot_wide", sql(["campaign_readings"], f"""SELECT entity, season, season_year, make_date(season_year::BIGINT,
CASE season WHEN 'JAN' THEN 1 WHEN 'MAY' THEN 5 WHEN 'AUG' THEN 8 ELSE 11 END, 15) AS campaign_date,
{R('value')} AS value FROM campaign_readings"""))
def unpivot_wide(spark, sf):
    df = wide_orders(spark, sf)
    long = wide.parse_campaign(wide.to_long(df, ["entity"], wide.campaign_columns(df), "value"))
    return long.select("entity", "season", "season_year", "campaign_date", r("value").alias("value"))


@query("pivot_campaigns", sql(["campaign_readings"], "SELECT entity, " + ", ".join(
    R(f"max(value) FILTER (WHERE season_year = 1998 AND season = '{s}')") + f" AS {s.lower()}_98"
    for s in ("JAN", "MAY", "AUG", "NOV")) + " FROM campaign_readings GROUP BY entity"))
def pivot_campaigns(spark, sf):
    return wide_orders(spark, sf).select("entity", *[r(f"`{s}-98`").alias(f"{s.lower()}_98")
                                                     for s in ("Jan", "May", "Aug", "Nov")])


@query("row_mean", sql(["campaign_readings"], f"SELECT entity, {R('avg(value)')} AS mean_value FROM campaign_readings GROUP BY 1"))
def row_mean(spark, sf):
    from ..functions.arrays import mean_known
    df = wide_orders(spark, sf)
    return df.select("entity", r(mean_known(*[F.col(f"`{c}`") for c in wide.campaign_columns(df)])).alias("mean_value"))


_KEYED = """SELECT entity, key, count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY entity) - 1 AS i
FROM (SELECT entity, CAST(round(lat, 4) AS VARCHAR) || '_' || CAST(round(lon, 4) AS VARCHAR) AS key FROM entities)"""


@query("dup_keys", sql(["entities"], f"SELECT entity, CASE WHEN n > 1 THEN key || '_' || i ELSE key END AS uid FROM ({_KEYED})"))
def dup_keys(spark, sf):
    return cleaning.coordinate_key(analog.entities(spark, sf), "lat", "lon", "entity", "uid").select("entity", "uid")


@query("range_filter", sql(["readings"], f"SELECT entity, date, {R('value')} AS value FROM readings WHERE value > 50 AND value < 200"))
def range_filter(spark, sf):
    return rounded(cleaning.between_open(analog.readings(spark, sf), "value", 50.0, 200.0).select("entity", "date", "value"))


@query("tidy_category", """SELECT p_type AS kind, CASE WHEN lower(trim(replace(p_brand, 'Brand#1', '-'))) IN ('-', '') THEN 'unknown'
ELSE lower(trim(replace(p_brand, 'Brand#1', '-'))) END AS brand, count(*) AS rows FROM part GROUP BY 1, 2""")
def tidy_category(spark, sf):
    part = table(spark, sf, "part").select("p_type", F.replace("p_brand", F.lit("Brand#1"), F.lit("-")).alias("b"))
    return part.groupBy(F.col("p_type").alias("kind"), strings.tidy_category(F.col("b")).alias("brand")).agg(
        F.count(F.lit(1)).alias("rows"))


@query("enough_readings", sql(["readings"], f"""SELECT entity, date, {R('value')} AS value FROM readings
WHERE entity IN (SELECT entity FROM readings GROUP BY 1 HAVING count(*) >= 8)"""))
def enough_readings(spark, sf):
    return rounded(cleaning.enough_readings(analog.readings(spark, sf), "entity", 8).select("entity", "date", "value"))


@query("lenient_cast", """SELECT p_type, count(*) AS rows, count(TRY_CAST(replace(p_brand, 'Brand#', CASE WHEN p_size > 25 THEN '' ELSE 'x' END)
AS DOUBLE)) AS numbers, sum(TRY_CAST(replace(p_brand, 'Brand#', CASE WHEN p_size > 25 THEN '' ELSE 'x' END) AS DOUBLE)) AS total FROM part GROUP BY 1""")
def lenient_cast(spark, sf):
    text = F.replace("p_brand", F.lit("Brand#"), F.when(F.col("p_size") > 25, "").otherwise("x"))
    part = table(spark, sf, "part").select("p_type", text.alias("t")).withColumn("v", F.expr("try_cast(t as double)"))
    return part.groupBy("p_type").agg(F.count(F.lit(1)).alias("rows"), F.count("v").alias("numbers"), F.sum("v").alias("total"))


@query("year_split", sql(["readings"], """SELECT entity, date, CASE WHEN season_year BETWEEN 1995 AND 1998 THEN 'train'
WHEN season_year = 1999 THEN 'valid' ELSE 'test' END AS split FROM readings WHERE season_year >= 1995"""))
def year_split(spark, sf):
    y = F.col("season_year")
    rows = analog.readings(spark, sf).where(cleaning.known_years(y, analog.TRAIN, analog.VALID, analog.TEST))
    return rows.select("entity", "date", cleaning.year_split(y, analog.TRAIN, analog.VALID).alias("split"))


# customers stand in for stations with blank types: segments are the well types, balances the recorded aquifers
_TYPES = {"AUTOMOBILE": "Dug well", "BUILDING": "Bore well", "FURNITURE": "-", "HOUSEHOLD": "Dug cum bore well",
          "MACHINERY": " Not available "}
_TYPE_SQL = "CASE segment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " END"
analog.define("stations", ("entities",), f"""SELECT *, {_TYPE_SQL} AS well_type,
    CASE WHEN balance < 0 THEN '-' WHEN balance < 2000 THEN NULL WHEN balance < 4000 THEN 'Confined' ELSE 'Unconfined' END AS aquifer
    FROM entities""")
analog.define("filled", ("stations",), """SELECT entity, aquifer AS aquifer_raw,
    CASE WHEN trim(aquifer) NOT IN ('-', 'Not available', '', 'nan', 'None') THEN aquifer END AS a,
    CASE WHEN trim(well_type) NOT IN ('-', 'Not available', '', 'nan', 'None') THEN well_type END AS t FROM stations""")


def stations(spark, sf):
    kinds = F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv])
    b = F.col("balance")
    return analog.entities(spark, sf).select(
        "*", F.element_at(kinds, F.col("segment")).alias("well_type"),
        F.when(b < 0, "-").when(b < 2000, None).when(b < 4000, "Confined").otherwise("Unconfined").alias("aquifer"))


_FILLED = """CASE WHEN a IS NULL AND t IN ('Dug well', 'Dug cum bore well') THEN 'Unconfined' ELSE coalesce(a, 'Unknown') END"""


@query("fill_category", sql(["filled"], f"""SELECT entity, {_FILLED} AS aquifer, CASE WHEN a IS NOT NULL THEN 'cgwb'
WHEN t IN ('Dug well', 'Dug cum bore well') THEN 'inferred_dug_well' ELSE 'unknown' END AS aquifer_source,
coalesce(t, 'Unknown') AS well_type FROM filled"""))
def fill_category(spark, sf):
    return cleaning.fill_aquifer(stations(spark, sf)).select("entity", "aquifer", "aquifer_source", "well_type")


@query("value_counts", sql(["filled"], f"""SELECT coalesce(x.v, y.v) AS aquifer, coalesce(x.n, 0) AS before, coalesce(y.n, 0) AS after
FROM (SELECT coalesce(aquifer_raw, 'null') AS v, count(*) AS n FROM filled GROUP BY 1) x
FULL JOIN (SELECT {_FILLED} AS v, count(*) AS n FROM filled GROUP BY 1) y ON x.v = y.v"""))
def value_counts(spark, sf):
    raw = stations(spark, sf)
    before = raw.select(F.coalesce("aquifer", F.lit("null")).alias("aquifer"))
    return aggregates.value_counts(before, cleaning.fill_aquifer(raw), "aquifer")


@query("crosstab_margins", sql(["filled"], """SELECT CASE WHEN grouping(t) = 1 THEN 'total' ELSE t END AS well_type,
count(*) FILTER (WHERE a = 'Confined') AS "Confined", count(*) FILTER (WHERE a = 'Unconfined') AS "Unconfined",
count(*) AS total, round(count(*) FILTER (WHERE a = 'Unconfined') / count(*)::DOUBLE + 1e-9, 3) AS share
FROM (SELECT coalesce(t, 'Unknown') AS t, a FROM filled WHERE a IS NOT NULL) GROUP BY ROLLUP (t)"""))
def crosstab_margins(spark, sf):
    blank = strings.blank_to_null
    known = stations(spark, sf).select(F.coalesce(blank(F.col("well_type"), BLANK_TOKENS), F.lit("Unknown")).alias("well_type"),
                                       blank(F.col("aquifer"), BLANK_TOKENS).alias("aquifer"))
    out = aggregates.crosstab_margins(known, "well_type", "aquifer", ["Confined", "Unconfined"])
    return out.withColumn("share", r(F.col("Unconfined") / F.col("total"), 3))


@query("priority_source", sql(["entities"], f"""SELECT entity, CASE WHEN entity % 3 = 0 THEN 0.018 WHEN entity % 5 < 2 THEN 0.13
WHEN entity % 7 = 0 THEN 0.043 ELSE 0.07 END::DOUBLE AS sy, CASE WHEN entity % 3 = 0 THEN 'published' WHEN entity % 5 < 2 THEN 'map'
WHEN entity % 7 = 0 THEN 'map_nearest' ELSE 'guess' END AS sy_source, CASE WHEN entity % 3 = 0 THEN 'folded metasediments / sedimentary aquitard'
WHEN entity % 5 < 2 THEN 'unconsolidated sedimentary (alluvium)' WHEN entity % 7 = 0 THEN 'consolidated sedimentary, permeable' END AS rock FROM entities"""))
def priority_source(spark, sf):
    e = F.col("entity")
    value, source = cleaning.first_known(
        [("published", F.when(e % 3 == 0, 0.018)), ("map", F.when(e % 5 < 2, 0.13)), ("map_nearest", F.when(e % 7 == 0, 0.043))],
        (F.lit(0.07), F.lit("guess")))
    rows = analog.entities(spark, sf).select("entity", value.alias("sy"), source.alias("sy_source"))
    return rows.withColumn("rock", cleaning.rock_class(F.col("sy")))


@query("keep_originals", sql(["stations"], """SELECT entity, coalesce(aquifer, 'none') AS aquifer, aquifer AS aquifer_ingest,
well_type AS well_type_ingest FROM stations"""))
def keep_originals(spark, sf):
    keep = {"aquifer": "aquifer_ingest", "well_type": "well_type_ingest"}
    once = cleaning.keep_originals(stations(spark, sf), keep)
    changed = once.withColumn("aquifer", F.coalesce("aquifer", F.lit("none")))
    again = cleaning.keep_originals(changed, keep)
    return again.select("entity", "aquifer", *keep.values())


@query("quality_report", sql(["stations"], """SELECT * FROM (SELECT count(*) - count(DISTINCT entity) AS entity_unique,
count(*) FILTER (WHERE aquifer IS NULL) AS aquifer_known, count(*) FILTER (WHERE state IS NULL) AS state_known,
count(*) FILTER (WHERE well_type NOT IN ('Dug well', 'Bore well')) AS well_type_allowed FROM stations)
UNPIVOT (failures FOR "check" IN (entity_unique, aquifer_known, state_known, well_type_allowed))"""))
def quality_report(spark, sf):
    return quality.quality_checks(stations(spark, sf), "entity", ["aquifer", "state"], {"well_type": ["Dug well", "Bore well"]})


@query("edge_cases", sql(["stations", "readings"], """SELECT * FROM (SELECT count(*) FILTER (WHERE aquifer IS NULL OR aquifer = '-') AS no_aquifer,
count(*) FILTER (WHERE balance < 0) AS below_zero, count(*) FILTER (WHERE entity NOT IN (SELECT entity FROM readings)) AS never_read
FROM stations) UNPIVOT ("count" FOR "case" IN (no_aquifer, below_zero, never_read))"""))
def edge_cases(spark, sf):
    read = analog.readings(spark, sf).select("entity").distinct().withColumn("read", F.lit(True))
    rows = stations(spark, sf).join(read, "entity", "left")
    return quality.count_report(rows, {
        "no_aquifer": F.col("aquifer").isNull() | (F.col("aquifer") == "-"), "below_zero": F.col("balance") < 0,
        "never_read": F.col("read").isNull()})


@query("key_containment", "SELECT o_custkey AS entity FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal >= 0")
def key_containment(spark, sf):
    known = analog.entities(spark, sf).where("balance >= 0").select("entity")
    return quality.outside(analog.readings(spark, sf), ["entity"], known)


@query("exact_subsample", sql(["readings"], f"""SELECT entity, date, {R('value')} AS value, season, season_year FROM readings
ORDER BY md5('42|' || entity || '|' || date), entity || '|' || date LIMIT 500"""))
def exact_subsample(spark, sf):
    """A fixed sample of 500 readings: sampling is the feature here, so it is the one place with a row count."""
    rows = analog.readings(spark, sf).withColumn("key", F.concat_ws("|", "entity", F.col("date").cast("string")))
    return rounded(cleaning.exact_subsample(rows, "key", 500, 42).drop("key"))


@query("first_row", sql(["readings"], f"""SELECT entity, min(date) AS date, {R('arg_min(value, date)')} AS value FROM readings GROUP BY 1"""))
def first_row(spark, sf):
    return rounded(windows.first_row(analog.readings(spark, sf), ["entity"], ["date"], ["date", "value"]))


@query("last_reading", sql(["readings"], f"""SELECT entity, max(date) AS last_date, {R('arg_max(value, date)')} AS last_value,
arg_max(season, date) AS last_season FROM readings GROUP BY 1"""))
def last_reading(spark, sf):
    return rounded(windows.last_reading(analog.readings(spark, sf), ["value", "season"]))


@query("semi_join", sql(["readings", "entities"], f"""SELECT entity, date, {R('value')} AS value FROM readings
WHERE entity IN (SELECT entity FROM entities WHERE grp IN (SELECT grp FROM entities GROUP BY 1 HAVING count(*) >= 60))"""))
def semi_join(spark, sf):
    people = analog.entities(spark, sf)
    keep = cleaning.grouped_filter(people, ["grp"], "entity", 60).select("entity")
    return rounded(joins.only_in(analog.readings(spark, sf), keep, ["entity"]).select("entity", "date", "value"))


@query("star_join", sql(["readings", "entities", "driver"], f"""WITH m AS (SELECT cell, date_trunc('month', date)::DATE AS month, sum(mm) AS mm FROM driver GROUP BY 1, 2),
g AS (SELECT cell, date_trunc('month', date)::DATE AS month, count(DISTINCT entity) AS entities_read, avg(value) AS mean_value,
stddev_samp(value) AS spread FROM readings JOIN entities USING (entity) GROUP BY 1, 2)
SELECT m.cell, m.month, m.mm, coalesce(entities_read, 0) AS entities_read, {R('mean_value', 5)} AS mean_value, {R('spread', 5)} AS spread,
n_name AS grp, CAST(quarter(m.month) AS INT) AS quarter FROM m LEFT JOIN g USING (cell, month) JOIN nation ON n_nationkey = m.cell""".replace("WITH m AS", "SELECT * FROM (WITH m AS") + ")"))
def star_join(spark, sf):
    fact = aggregates.monthly(analog.driver(spark, sf), "mm", F.col("mm") >= 2.5, ["cell"]).drop("wet_days")
    read = analog.readings(spark, sf).join(analog.entities(spark, sf), "entity").groupBy(
        "cell", F.trunc("date", "month").alias("month")).agg(
        F.countDistinct("entity").alias("entities_read"), F.avg("value").alias("mean_value"),
        F.stddev_samp("value").alias("spread"))
    place = table(spark, sf, "nation").select(F.col("n_nationkey").alias("cell"), F.col("n_name").alias("grp"))
    months = fact.select("month").distinct().withColumn("quarter", F.quarter("month"))
    return rounded(joins.star(fact, read, ["cell", "month"], [(place, ["cell"]), (months, ["month"])], ["entities_read"]), 5)


@query("combine_measures", sql(["driver"], """SELECT cell, date_trunc('month', date)::DATE AS month, sum(mm) AS mm,
count(*) FILTER (WHERE mm > 2.5) AS wet_days FROM driver GROUP BY 1, 2"""))
def combine_measures(spark, sf):
    both = aggregates.monthly(analog.driver(spark, sf), "mm", F.col("mm") > 2.5, ["cell"])
    return joins.combine_measures(both.select("cell", "month", "mm"), both.select("cell", "month", "wet_days"), ["cell", "month"])


@query("as_of_lookup", sql(["readings", "entities", "driver", "shipped"], """SELECT r.entity, r.date, max(s.date) AS event_date, arg_max(s.mm, s.date) AS mm
FROM readings r JOIN entities e USING (entity) LEFT JOIN shipped s ON s.cell = e.cell AND s.date <= r.date GROUP BY 1, 2"""))
def as_of_lookup(spark, sf):
    """Last day the cell's driver was recorded, on or before each reading."""
    asked = analog.readings(spark, sf).join(analog.entities(spark, sf).select("entity", "cell"), "entity").select("entity", "cell", "date")
    found = series.latest_at_or_before(asked, analog.shipped(spark, sf), ["cell"], "date", "date", ["mm"])
    return found.select("entity", "date", "event_date", "mm")


@query("campaign_index", sql(["readings"], """SELECT date, season, season_year, (row_number() OVER (ORDER BY date) - 1)::INT AS campaign
FROM (SELECT DISTINCT date, season, season_year FROM readings)"""))
def campaign_index(spark, sf):
    return cleaning.dense_index(analog.readings(spark, sf), "date", ["season", "season_year"], "campaign")


@query("calendar_gaps", sql(["shipped"], """SELECT cell, count(*) AS days, (max(date) - min(date) + 1)::INT AS span,
max(date) - min(date) + 1 - count(DISTINCT date) AS missing FROM shipped GROUP BY 1"""))
def calendar_gaps(spark, sf):
    return series.calendar_gaps(analog.shipped(spark, sf))


@query("dense_calendar", sql(["sparse_driver"], "SELECT cell, date, mm FROM sparse_driver"))
def dense_calendar(spark, sf):
    return analog.driver(spark, sf, fill=None)


@query("dense_months", sql(["shipped"], """SELECT n_nationkey AS cell, m.month AS month, coalesce(s.mm, 0) AS mm FROM nation CROSS JOIN
(SELECT CAST(unnest(generate_series(date_trunc('year', (SELECT min(date) FROM shipped)), date_trunc('year', (SELECT max(date) FROM shipped)) + INTERVAL 11 MONTH, INTERVAL 1 MONTH)) AS DATE) AS month) m
LEFT JOIN (SELECT cell, date_trunc('month', date)::DATE AS month, sum(mm) AS mm FROM shipped GROUP BY 1, 2) s
ON s.cell = n_nationkey AND s.month = m.month"""))
def dense_months(spark, sf):
    known = analog.shipped(spark, sf)
    monthly = aggregates.monthly(known, "mm", F.col("mm") > 0, ["cell"])
    return series.dense_calendar(monthly, analog.cells(spark, sf), *analog.calendar_ends(known), "mm", 0.0, "month", date="month")


@query("pack_grid", sql(["shipped", "sparse_driver"], """SELECT cell, date, CASE WHEN mm IS NOT NULL THEN CAST(round_even(least(greatest(mm / 7, 0), 3000) * 10, 0) AS SMALLINT) END AS mm10
FROM sparse_driver JOIN (SELECT DISTINCT cell FROM shipped WHERE mm IS NOT NULL) USING (cell)"""))
def pack_grid(spark, sf):
    sevenths = analog.driver(spark, sf, fill=None).withColumn("mm", F.col("mm") / 7)
    return grid.pack_grid(sevenths, "mm", ("cell",))


@query("unpack_grid", sql(["shipped", "sparse_driver"], f"""SELECT cell, date, CASE WHEN mm IS NOT NULL THEN {R('round_even(least(greatest(mm / 7, 0), 3000) * 10, 0) / 10')} END AS mm FROM sparse_driver
JOIN (SELECT DISTINCT cell FROM shipped WHERE mm IS NOT NULL) USING (cell)"""))
def unpack_grid(spark, sf):
    packed = pack_grid(spark, sf)
    old = packed.withColumn("mm10", F.coalesce("mm10", F.lit(-9999)))
    return rounded(grid.unpack(old, sentinel=-9999))


@query("quantised_export", sql(["sparse_driver"], f"""SELECT cell, date, CAST(year(date) AS INT) AS year, code::SMALLINT AS code,
{R('exp(code / 33.0::DOUBLE) - 1')} AS mm FROM (SELECT cell, date, least(greatest(round_even(ln(1 + greatest(coalesce(mm, 0), 0)) * 33, 0), 0), 255) AS code
FROM sparse_driver)"""))
def quantised_export(spark, sf):
    coded = grid.quantised(analog.driver(spark, sf, fill=None))
    return coded.withColumn("mm", r(numbers.dequantise(F.col("code"))))


@query("national_mean", sql(["sparse_driver"], "SELECT date, round(coalesce(avg(mm), 0) + 1e-9, 2) AS mean_mm FROM sparse_driver GROUP BY 1"))
def national_mean(spark, sf):
    shifted = analog.driver(spark, sf, fill=None).withColumn("mm", F.col("mm") + 1e-9)
    return grid.national_mean(shifted)


@query("history_documents", sql(["scored"], """SELECT entity, any_value(grp) AS grp, any_value(state) AS state, count(*) AS readings,
to_json(list({'d': CAST(date AS VARCHAR), 'gap': gap} ORDER BY date))::VARCHAR AS h FROM scored GROUP BY 1"""))
def history_documents(spark, sf):
    from ..sources.sinks import history_documents as documents
    docs = documents(analog.scored(spark, sf), "entity", ["grp", "state"], "date", {
        "d": F.col("date").cast("string"), "gap": F.col("gap")})
    return docs.select("entity", "grp", "state", F.size("h").cast("long").alias("readings"), F.to_json("h").alias("h"))


@query("column_pruned_scan", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS rows FROM lineitem
WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2""")
def column_pruned_scan(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_shipdate")
    return lines.where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz")).groupBy(
        "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("rows"))


@query("union_years", sql(["readings"], f"SELECT entity, date, {R('value')} AS value FROM readings"))
def union_years(spark, sf):
    """The readings put together from one piece per year; the first and the last take what lies beyond."""
    from functools import reduce
    rows = analog.readings(spark, sf)
    year = F.least(F.greatest(F.col("season_year"), F.lit(analog.FIRST_YEAR)), F.lit(analog.LAST_YEAR))
    pieces = [rows.where(year == y) for y in range(analog.FIRST_YEAR, analog.LAST_YEAR + 1)]
    return rounded(reduce(lambda a, b: a.unionByName(b), pieces).select("entity", "date", "value"))


@query("thinnest_campaigns", sql(["readings"], """SELECT season_year, season, count(DISTINCT entity) AS entities FROM readings GROUP BY 1, 2
ORDER BY entities, season_year, season LIMIT 5"""))
def thinnest_campaigns(spark, sf):
    counts = analog.readings(spark, sf).groupBy("season_year", "season").agg(F.countDistinct("entity").alias("entities"))
    return ranking.top_rows(counts, [F.asc("entities"), F.asc("season_year"), F.asc("season")], 5)


@query("gap_report", sql(["changes", "readings"], """SELECT * FROM (SELECT count(*) FILTER (WHERE p IS NULL) AS first_readings,
count(*) FILTER (WHERE date - p < 45) AS too_close, count(*) FILTER (WHERE date - p > 400) AS too_far, count(*) FILTER (WHERE date - p BETWEEN 45 AND 400) AS usable
FROM (SELECT date, lag(date) OVER (PARTITION BY entity ORDER BY date) AS p FROM readings)) UNPIVOT ("count" FOR "case" IN (first_readings, too_close, too_far, usable))"""))
def gap_report(spark, sf):
    rows = windows.previous_reading(analog.readings(spark, sf))
    gap = F.datediff("date", "prev_date")
    return quality.count_report(rows, {
        "first_readings": F.col("prev_date").isNull(), "too_close": gap < 45, "too_far": gap > 400, "usable": gap.between(45, 400)})
