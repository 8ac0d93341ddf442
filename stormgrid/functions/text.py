"""Codes, labels and numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(number: Column, width: int = 2) -> Column:
    """A whole number with zeros before it; longer ones stay whole."""
    text = number.cast("long").cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def unpadded(text: Column) -> Column:
    """Without zeros before it."""
    return F.regexp_replace(text, "^0+", "")


def squeezed(text: Column) -> Column:
    """Without spaces."""
    return F.replace(text, F.lit(" "), F.lit(""))


def number(text: Column) -> Column:
    """A number written as text; NULL if it is none."""
    return text.try_cast("double")


def half_even(value: Column, digits: int) -> Column:
    """Rounded, exact halves to the even digit."""
    return F.bround(value, digits)


def hour_code(text: Column) -> dict[str, Column]:
    """year, month, day, hour of a yyyymmddhh text, which may be of a calendar with a 30 February."""
    return {"year": text.substr(1, 4).cast("int"), "month": text.substr(5, 2).cast("int"), "day": text.substr(7, 2).cast("int"), "hour": text.substr(9, 2).cast("int")}


def hours_since_1970(year: Column, month: Column, day: Column, hour: Column) -> Column:
    """Hours since 1970 began, in years of twelve 30-day months."""
    return ((((year - 1970) * 12 + month - 1) * 30 + day - 1) * 24 + hour).cast("long")


def logs(value: Column) -> dict[str, Column]:
    """Natural and decimal logarithm; NULL up to 0."""
    v = F.when(value > 0, value)
    return {"ln": F.ln(v), "log10": F.log10(v)}
