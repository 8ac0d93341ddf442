"""Binning, labels and guarded arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that stand for "missing" in gridded inputs.
SENTINELS = (-9999.0, -99999.0)
#: Whatever is as large as this is missing as well.
HUGE = 1e19


def clean(value: Column, nodata: float | None = None) -> Column:
    """NaN, sentinels, huge values and `nodata` become NULL."""
    bad = F.isnan(value) | value.isin(*SENTINELS) | (F.abs(value) >= HUGE)
    if nodata is not None:
        bad |= value == nodata
    return F.when(~bad, value)


def cut(value: Column, edges: Sequence[float], labels: Sequence | None = None, right: bool = True, include_lowest: bool = False) -> Column:
    """The interval that holds the value: right-closed, or left-closed. Outside all of them: NULL. Without labels, its number from 0."""
    out = None
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        above = (value > a) if right else (value >= a)
        if right and include_lowest and k == 0:
            above = value >= a
        inside = above & ((value <= b) if right else (value < b))
        label = F.lit(k if labels is None else labels[k])
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def quantile_edges(df: DataFrame, column: str, q: int) -> list[float]:
    """Edges of q quantile bins, linearly interpolated; equal ones once. A few numbers reach the driver."""
    got = df.agg(F.percentile(column, F.array(*[F.lit(k / q) for k in range(q + 1)])).alias("e")).first()["e"] or []
    return sorted({float(x) for x in got})


def qcut(df: DataFrame, column: str, q: int, out: str, edges: Sequence[float] | None = None) -> DataFrame:
    """df with the number of each value's quantile bin; ties stay together. `edges` of another table can be used again."""
    edges = quantile_edges(df, column, q) if edges is None else edges
    return df.withColumn(out, cut(F.col(column), edges, include_lowest=True) if len(edges) > 1 else F.lit(None).cast("int"))


def digitize(value: Column, edges: Sequence[float]) -> Column:
    """How many ascending edges are at most the value."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))


def periods(year: Column, spans: Sequence[tuple[str, int, int]], last_wins: bool = False) -> Column:
    """Label of the first (or last) inclusive span of years that holds the year."""
    out = None
    for name, a, b in reversed(spans) if last_wins else spans:
        out = F.when(year.between(a, b), name) if out is None else out.when(year.between(a, b), name)
    return out


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.nullif(b, F.lit(0))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """The value within bounds; NULL stays NULL."""
    out = value if low is None else F.when(value < low, F.lit(float(low))).otherwise(value)
    return out if high is None else F.when(out > high, F.lit(float(high))).otherwise(out)


def near(value: Column, target: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|value - target| <= atol + rtol * |target|."""
    return F.abs(value - target) <= F.lit(atol) + F.lit(rtol) * F.abs(target)


def product(a: Column, b: Column) -> Column:
    """Interaction of two columns."""
    return a * b


def noise(seed: int = 0) -> Column:
    """Values of a standard normal distribution, as a control that explains nothing; they depend on how rows are dealt out."""
    return F.randn(seed)


def p_label(p: Column, star: float = 0.05) -> Column:
    """'<0.05' below the level, else the value with two decimals."""
    return F.when(p < star, "<0.05").otherwise(F.format_number(p, 2))
