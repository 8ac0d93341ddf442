"""A calendar of twelve 30-day months, as integer expressions. 30 February is a day of it, so no Spark date is involved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day360(year: Column, month: Column, day: Column) -> Column:
    """Days since year 0."""
    return (year * 360 + (month - 1) * 30 + (day - 1)).cast("long")


def hour360(year: Column, month: Column, day: Column, hour: Column) -> Column:
    """Hours since year 0."""
    return (day360(year, month, day) * 24 + hour).cast("long")


def from_timestamp(ts: Column) -> Column:
    """hour360 of a Gregorian timestamp; day 31 counts as day 30."""
    return hour360(F.year(ts), F.month(ts), F.least(F.dayofmonth(ts), F.lit(30)), F.hour(ts))


def parts(hour: Column) -> dict[str, Column]:
    """year, month, day, hour of an hour360."""
    day = F.floor(hour / 24)
    return {"year": F.floor(day / 360).cast("int"), "month": (F.floor(F.pmod(day, F.lit(360)) / 30) + 1).cast("int"), "day": (F.pmod(day, F.lit(30)) + 1).cast("int"), "hour": F.pmod(hour, F.lit(24)).cast("int")}


def hydro_year(year: Column, month: Column) -> Column:
    """December belongs to the year after it."""
    return (year + F.when(month == 12, 1).otherwise(0)).cast("int")


def day_of_year(month: Column, day: Column, hydro: bool = False) -> Column:
    """1 to 360, from January, or from December for the hydrological year."""
    return ((month % 12) * 30 + day if hydro else (month - 1) * 30 + day).cast("int")


def hydro_index(hour: Column, year: Column) -> Column:
    """Hours since 1 December of the year before the hydrological year."""
    return (hour - ((year - 1) * 360 + 330) * 24).cast("long")


def season(month: Column) -> Column:
    """Meteorological season of a month."""
    return F.when(month.isin(12, 1, 2), "djf").when(month.isin(3, 4, 5), "mam").when(month.isin(6, 7, 8), "jja").otherwise("son")


def season_year(year: Column, month: Column) -> Column:
    """The year a season is counted to: December to the next."""
    return hydro_year(year, month)


def angle(day: Column, days: int = 360) -> Column:
    """Angle of a day of the year."""
    return (day - 1) * (2 * 3.141592653589793 / days)
