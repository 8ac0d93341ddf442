"""Shape of an event's hourly series, as higher-order functions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An hour is wet above this, and a peak counts from this height and distance on.
WET, PEAK_HEIGHT, PEAK_DISTANCE = 0.1, 10.0, 3


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def _at(a: Column, k: Column) -> Column:
    return F.element_at(a, k.cast("int"))


def trimmed(series: Column, wet: float = WET) -> Column:
    """From the first to the last wet hour; NULL if none is wet."""
    marks = F.filter(F.transform(series, lambda x, i: F.when(x > wet, i)), lambda i: i.isNotNull())
    return F.when(F.size(marks) > 0, F.slice(series, F.array_min(marks) + 1, F.array_max(marks) - F.array_min(marks) + 1))


def cumulative(series: Column) -> Column:
    """Running sums, each from the one before."""
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("a"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["s"] + F.coalesce(x, F.lit(0.0))
        return F.struct(s.alias("s"), F.concat(acc["a"], F.array(s)).alias("a"))

    return F.when(series.isNotNull(), F.aggregate(series, start, step, lambda acc: acc["a"]))


def interpolated(values: Column, points: int) -> Column:
    """The series at that many places, evenly from its first to its last value, linear between values; NULL for an empty one."""
    n = F.size(values)

    def at(k: Column) -> Column:
        place = k * (n - 1) / F.lit(max(points - 1, 1))
        low = F.least(F.floor(place).cast("int"), F.greatest(n - 2, F.lit(0)))
        a, b = _at(values, low + 1), _at(values, F.least(low + 2, n))
        return a + (b - a) * (place - low)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at))


def peak_index(series: Column) -> Column:
    """Place of the first maximum, from 0."""
    return (F.array_position(series, F.array_max(series)) - 1).cast("int")


def rolling_max(series: Column, hours: int) -> Column:
    """The largest sum of that many consecutive hours, or of all if there are fewer."""
    w = F.least(F.lit(hours), F.size(series))
    return F.array_max(F.transform(F.sequence(F.lit(1), F.size(series) - w + 1), lambda k: _sum(F.slice(series, k, w))))


def gini(series: Column) -> Column:
    """Inequality of the hours' amounts; 0 for all-dry series."""
    s, n, total = F.array_sort(series), F.size(series), _sum(series)
    weighted = _sum(F.transform(s, lambda x, i: x * (i + 1)))
    return F.when(total == 0, 0.0).otherwise(2 * weighted / (n * total) - (n + 1) / n)


def time_std(series: Column) -> Column:
    """Standard deviation of the hours 1..n, weighted by amount, over n."""
    n, total = F.size(series), F.nullif(_sum(series), F.lit(0.0))
    mean = _sum(F.transform(series, lambda x, i: x * (i + 1))) / total
    return F.sqrt(_sum(F.transform(series, lambda x, i: x * (i + 1 - mean) * (i + 1 - mean))) / total) / n


def d50(series: Column) -> Column:
    """Percent of the duration at which half the total has fallen, interpolated between hours."""
    n = F.size(series)
    sums = cumulative(series)
    share = F.transform(sums, lambda c: c / F.nullif(F.element_at(sums, -1), F.lit(0.0)))
    k = F.array_min(F.filter(F.transform(share, lambda c, i: F.when(c >= 0.5, i)), lambda i: i.isNotNull()))
    step = F.when(n > 1, F.lit(100.0) / F.greatest(n - 1, F.lit(1))).otherwise(100.0)
    now = _at(share, k + 1)
    before = F.when(k > 0, _at(share, F.greatest(k, F.lit(1)))).otherwise(0.0)
    at_before, at_now = F.when(k > 0, (k - 1) * step).otherwise(0.0), F.when(k > 0, k * step).otherwise(step)
    return at_before + (F.lit(0.5) - before) / F.nullif(now - before, F.lit(0.0)) * (at_now - at_before)


def max_quartile(series: Column) -> Column:
    """Which quarter of the duration holds most, 0 to 3, the first of equals; NULL for a single hour."""
    n, share = F.size(series), cumulative(series)

    def value(q: float) -> Column:
        p = F.lit(q) * (n - 1)
        low = F.floor(p)
        a, b = _at(share, low + 1), _at(share, F.least(low + 2, n))
        return a + (b - a) * (p - low)

    steps = F.array(*[F.round(value((k + 1) / 4) - value(k / 4), 9) for k in range(4)])  # equal but for the last digits counts as equal
    return F.when(n > 1, F.array_position(steps, F.array_max(steps)) - 1).cast("int")


def transition_rate(series: Column) -> Column:
    """Changes between dry and wet, per hour."""
    n = F.size(series)
    flips = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: (n > 1) & ((_at(series, k) > 0) != (_at(series, F.least(k + 1, n)) > 0)))
    return F.size(flips) / n


def n_peaks(series: Column, height: float = PEAK_HEIGHT, distance: int = PEAK_DISTANCE) -> Column:
    """Local maxima of that height, at least `distance` hours apart (higher ones first), and ends that are as high.

    A plateau is one maximum, at its middle. Candidates are taken by height; one
    stays if no higher one that stays is nearer than the distance.
    """
    n = F.size(series)
    inner = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("k"), _at(series, k).alias("v")))
    # the plateau that starts at k ends before the first later place with another value
    def end(k: Column) -> Column:
        later = F.filter(F.sequence(k, n), lambda j: _at(series, j) != _at(series, k))
        return F.coalesce(F.array_min(later) - 1, n)

    starts = F.filter(inner, lambda x: (x["k"] > 1) & (x["v"] >= height) & (_at(series, F.greatest(x["k"] - 1, F.lit(1))) < x["v"]))
    tops = F.filter(F.transform(starts, lambda x: F.struct((-x["v"]).alias("neg"), (-F.floor((x["k"] + end(x["k"])) / 2)).cast("int").alias("back"), end(x["k"]).alias("end"))), lambda x: (x["end"] < n) & (_at(series, F.least(x["end"] + 1, n)) < -x["neg"]))
    kept = F.aggregate(F.array_sort(tops), F.array().cast("array<int>"), lambda acc, x: F.when(F.exists(acc, lambda p: F.abs(p + x["back"]) < distance), acc).otherwise(F.concat(acc, F.array(-x["back"]))))
    edges = F.when(_at(series, F.lit(1)) >= height, F.when(_at(series, F.lit(1)) > _at(series, F.least(F.lit(2), n)), 1).otherwise(0)).otherwise(0) + F.when(_at(series, n) >= height, F.when(_at(series, n) > _at(series, F.greatest(n - 1, F.lit(1))), 1).otherwise(0)).otherwise(0)
    return F.when(n <= 2, 1).otherwise(F.size(kept) + edges)


def modality(peaks: Column) -> Column:
    """Label of a number of peaks."""
    return F.when(peaks == 0, "no clear peak").when(peaks == 1, "unimodal").when(peaks == 2, "bimodal").otherwise("multimodal")


def with_metrics(df: DataFrame, series: str, wet: float = WET) -> DataFrame:
    """df with all metrics of a column of series; the series is trimmed once."""
    return df.withColumn("_t", trimmed(F.col(series), wet)).withColumns(metrics(F.col(series), F.col("_t"))).drop("_t")


def metrics(series: Column, t: Column) -> dict[str, Column]:
    """All metrics of a series whose wet part is t; those of an all-dry one are 0 or NULL."""
    k, total = peak_index(t), _sum(t)
    before, after = _sum(F.slice(t, F.lit(1), k)), _sum(F.slice(t, k + 2, F.size(t)))
    dry = t.isNull()
    peak = F.array_max(t)
    return {
        "length": F.size(series),
        "length_of_active_rain": F.size(t),
        "total_acc": F.coalesce(total, F.lit(0.0)),
        "max_intensity": peak,
        **{f"max_{h}h": rolling_max(t, h) for h in (2, 3, 6, 12, 16)},
        "peak_position_ratio": k / F.greatest(F.size(t) - 1, F.lit(1)),
        "before_peak": before,
        "after_peak": after,
        "at_peak": peak,
        "peak_share": peak / total,
        "nonpeak_share": 1 - peak / total,
        "loading_index": (before - after) / total,
        "d50": d50(t),
        "gini": F.when(dry, 0.0).otherwise(gini(t)),
        "time_based_std": time_std(t),
        "dry_ratio": F.size(F.filter(t, lambda x: x == 0)) / F.size(t) * 100,
        "wet_dry_transition_rate": transition_rate(t),
        "max_quartile_index": max_quartile(t),
        "n_peaks": F.when(dry, 0).otherwise(n_peaks(t)),
        "modality": modality(F.when(dry, 0).otherwise(n_peaks(t))),
    }
