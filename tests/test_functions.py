import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stillwell.functions import arrays, dates, geometry, numbers, strings


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_day_slots_of_common_and_leap_years(spark):
    days = pd.date_range("1999-01-01", "2001-12-31")
    got = {r["d"]: r["s"] for r in spark.createDataFrame([(d.date(),) for d in days], "d date").select(
        "d", dates.day_slot(F.col("d")).alias("s")).collect()}
    doy = np.minimum(days.dayofyear.to_numpy(), 365) - 1 - (days.is_leap_year & (days.month > 2))
    assert [got[d.date()] for d in days] == np.clip(doy, 0, 364).tolist()
    assert got[dt.date(2000, 2, 29)] == got[dt.date(2000, 3, 1)] == 59
    assert got[dt.date(2000, 12, 30)] == got[dt.date(2000, 12, 31)] == 363
    assert got[dt.date(1999, 12, 31)] == 364


def test_shift_years_clamps_leap_day(spark):
    assert one(spark, dates.shift_years(F.lit(dt.date(2000, 2, 29)), 1)) == dt.date(2001, 2, 28)
    assert one(spark, dates.shift_years(F.lit(dt.date(2004, 2, 29)), -4)) == dt.date(2000, 2, 29)


def test_regular_steps_are_after_and_up_to(spark):
    got = one(spark, dates.regular_steps(F.lit(dt.date(2019, 5, 15)), F.lit(dt.date(2020, 1, 15))))
    assert got == [dt.date(2019, 8, 15), dt.date(2019, 11, 15), dt.date(2020, 1, 15)]


@pytest.mark.parametrize("member,year,want", [(0, 2023, 2000), (22, 2023, 2022), (22, 2024, 2000), (5, 2046, 2005)])
def test_replay_year_is_a_ring(spark, member, year, want):
    assert one(spark, dates.replay_year(F.lit(member), F.lit(year), 2000, 2022)) == want


def test_part_of_year_and_monsoon_year(spark):
    assert one(spark, dates.weather_season(F.lit(dt.date(2026, 10, 9)))) == "post-monsoon"
    assert one(spark, dates.weather_season(F.lit(dt.date(2026, 2, 9)))) == "winter"
    assert one(spark, dates.monsoon_year(F.lit(dt.date(2010, 9, 30)))) == 2009
    assert one(spark, dates.monsoon_year(F.lit(dt.date(2010, 10, 1)))) == 2010


def test_numbers(spark):
    assert one(spark, numbers.tenths(F.lit(0.25))) == 2            # half to even
    assert one(spark, numbers.tenths(F.lit(0.35))) == round(0.35 * 10)
    assert one(spark, numbers.tenths(F.lit(9999.0))) == 30000
    assert one(spark, numbers.tenths(F.lit(float("nan")))) is None
    q = one(spark, numbers.quantise(F.lit(100.0)))
    assert abs(one(spark, numbers.dequantise(F.lit(q))) - 100) < 2
    assert one(spark, numbers.quantise(F.lit(None).cast("double"))) == 0
    assert one(spark, numbers.ratio_or_null(F.lit(3.0), F.lit(0.0))) is None
    assert one(spark, numbers.signed_log_inverse(numbers.signed_log(F.lit(-7.5)))) == pytest.approx(-7.5)


def test_strings(spark):
    assert one(spark, strings.fold(F.lit("  Bengalūru–Rural "))) == "bengaluru rural"
    assert one(spark, strings.tidy_category(F.lit(" - "))) == "unknown"
    assert one(spark, strings.tidy_category(F.lit(None).cast("string"))) == "unknown"
    assert one(spark, strings.tidy_category(F.lit(" Dug Well"))) == "dug well"
    names = one(spark, strings.other_names(F.lit("Bengaluru"), F.lit("Bengaluru"),
                                           F.lit("Ban'nkalor,Bangalore,bangalore,बेंगलुरु,BLR,bengalooru")))
    assert names == ["BLR", "Bangalore", "Ban'nkalor", "bengalooru"]


def test_arrays(spark):
    week = F.array(*[F.lit(float(i)) for i in range(28)])
    assert one(spark, arrays.chunk_sums(week, 7, 4)) == [sum(range(7 * i, 7 * i + 7)) for i in range(4)]
    assert one(spark, arrays.keep_last(week, 3)) == [25.0, 26.0, 27.0]
    assert one(spark, arrays.patches(week, 14, 2)) == [[float(i) for i in range(14)], [float(i) for i in range(14, 28)]]
    assert one(spark, arrays.mean_known(F.lit(1.0), F.lit(None).cast("double"), F.lit(4.0))) == 2.5
    assert one(spark, arrays.differences(week, F.lit(0), 7, 3)) == [7.0, 7.0, 7.0]


L_SHAPE = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]


@pytest.mark.parametrize("x,y,inside,distance", [
    (0.5, 0.5, True, 0), (1.5, 0.5, True, 0), (0.5, 1.5, True, 0), (1.5, 1.5, False, 0.5), (1.0, 1.5, True, 0),
    (2.0, 0.5, True, 0), (0, 0, True, 0), (3.0, 0.5, False, 1), (-1, -1, False, 2 ** 0.5)])
def test_polygon_covers_and_distance(spark, x, y, inside, distance):
    ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in L_SHAPE])
    assert one(spark, geometry.covers(ring, F.lit(float(x)), F.lit(float(y)))) is inside
    assert one(spark, geometry.distance_to_ring(ring, F.lit(float(x)), F.lit(float(y)))) == pytest.approx(distance)
