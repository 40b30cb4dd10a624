"""Calendar expressions. Dates are Spark ``date`` everywhere, so no time zone enters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .constants import READING_DAY, SEASON_MONTH, SEASONS


def is_leap(date: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(F.year(date), F.lit(2), F.lit(1)))) == 29


def day_slot(date: Column) -> Column:
    """Day-of-year slot 0..364 shared by leap and common years.

    In a leap year every day after February moves back one slot, so 29 February shares slot 59 with
    1 March and 30 and 31 December share slot 363.
    """
    after_leap_day = F.when(is_leap(date) & (F.month(date) > 2), 1).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.dayofyear(date), F.lit(365)) - 1 - after_leap_day).cast("int")


def season_of_quarter(date: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEASONS]), F.quarter(date))


def season_index(season: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(s) for s in SEASONS]), season) - 1).cast("int")


def weather_season(date: Column) -> Column:
    """Name of the part of the year a day falls in."""
    m = F.month(date)
    return (F.when(m.between(6, 9), "south-west monsoon").when(m >= 10, "post-monsoon")
            .when(m <= 2, "winter").otherwise("pre-monsoon"))


def shift_years(date: Column, years: Column | int) -> Column:
    """The same day ``years`` later; 29 February becomes 28 February in a common year."""
    years = F.lit(years) if isinstance(years, int) else years
    return F.add_months(date, (years * 12).cast("int"))


def reading_date(year: Column, season: Column) -> Column:
    months = F.create_map(*[F.lit(x) for pair in SEASON_MONTH.items() for x in pair])
    return F.make_date(year, F.element_at(months, season), F.lit(READING_DAY))


def regular_steps(after: Column, until: Column) -> Column:
    """Array of regular reading dates ``d`` with ``after < d <= until``."""
    days = F.flatten(F.transform(
        F.sequence(F.year(after), F.year(until)),
        lambda y: F.array(*[F.make_date(y, F.lit(SEASON_MONTH[s]), F.lit(READING_DAY)) for s in SEASONS])))
    return F.filter(days, lambda d: (d > after) & (d <= until))


def replay_year(member: Column, year: Column, first: int, last: int) -> Column:
    """Past year whose driver stands in for future ``year`` in ensemble ``member``."""
    return (F.lit(first) + F.pmod(member + year - F.lit(last + 1), F.lit(last - first + 1))).cast("int")


def season_number(year: Column, season_pos: Column) -> Column:
    """Running number of a season, so consecutive seasons differ by one. ``season_pos`` counts from 0."""
    return year * 4 + season_pos


def monsoon_year(date: Column) -> Column:
    """Year of the June-September season most recently completed at ``date``."""
    return F.when(F.month(date) >= 10, F.year(date)).otherwise(F.year(date) - 1)
