"""Pivots, unions, repairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot(df: DataFrame, index: Sequence[str], column: str, domain: Sequence, value: str, how: str = "avg") -> DataFrame:
    """Index by domain, in domain order; an explicit domain spares Spark the pass that would find it."""
    return df.groupBy(*index).pivot(column, list(domain)).agg(getattr(F, how)(value))


def stack(tables: Sequence[DataFrame], source: Sequence[str] | None = None) -> DataFrame:
    """All rows under one another, missing columns NULL; with a source label if given."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("source", F.lit(source[k])) if source else t
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def repair_exploded(df: DataFrame, keys: Sequence[str], order: str, value: str, series: str = "series") -> DataFrame:
    """Rows that were blown up by a series become one row per key again: the series in row order, other columns from the first row."""
    rest = [c for c in df.columns if c not in (*keys, order, value)]
    got = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_s"), F.min(F.struct(order, *rest)).alias("_f"))
    return got.select(*keys, F.transform("_s", lambda x: x["v"]).alias(series), *[F.col(f"_f.{c}").alias(c) for c in rest])


def linear_index(df: DataFrame, nx: int) -> DataFrame:
    """iy, ix to one number."""
    return df.withColumn("cell", F.col("iy") * nx + F.col("ix"))


def grid_index(df: DataFrame, nx: int) -> DataFrame:
    """The number of a cell back to iy, ix."""
    return df.withColumns({"iy": F.floor(F.col("cell") / nx), "ix": F.col("cell") % nx})


def transpose(df: DataFrame, label: str, columns: Sequence[str], domain: Sequence, out: str = "column") -> DataFrame:
    """Columns become rows and the values of `label` (the given ones, in that order) columns. One value per label and column."""
    long = df.unpivot([label], list(columns), out, "_v")
    return long.groupBy(out).pivot(label, list(domain)).agg(F.first("_v"))


def unpacked(df: DataFrame, struct: str) -> DataFrame:
    """A struct's fields as columns."""
    return df.select(*[c for c in df.columns if c != struct], f"{struct}.*")


def wide_by_two(df: DataFrame, index: Sequence[str], a: str, b: str, domain: Sequence[tuple], value: str, name: str = "{0}cm_{1}") -> DataFrame:
    """A column for each given pair of values of a and b, such as depth and variable; sums, NULL without a row."""
    return df.groupBy(*index).agg(*[F.sum(F.when((F.col(a) == x) & (F.col(b) == y), F.col(value))).alias(name.format(x, y)) for x, y in domain])


def ordered(df: DataFrame, column: str, domain: Sequence) -> DataFrame:
    """Rows sorted by a column in the given order of its values; others last, by value."""
    return df.orderBy(F.coalesce(*[F.when(F.col(column) == v, k) for k, v in enumerate(domain)], F.lit(len(domain))), column)


def renamed(df: DataFrame, names: dict[str, str] | None = None, suffix: str = "", but: Sequence[str] = (), without: Sequence[str] = ()) -> DataFrame:
    """Columns renamed by a map (absent ones are no error), the others with a suffix but for some, and without those to drop."""
    out = df.drop(*without).withColumnsRenamed(names or {})
    keep = {*but, *(names or {}).values()}
    return out.withColumnsRenamed({c: c + suffix for c in out.columns if c not in keep}) if suffix else out
