"""Gridded fields over time, fields on different grids, and polygons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import meets_box, within

# ---------------------------------------------------------------- events in time


def extract_at_cell(cells: DataFrame, peaks: DataFrame, keys: Sequence[str], value: str = "value", wet: float = 0.1) -> DataFrame:
    """By event at its peak cell: the series in time order, total, maximum, first and last wet step, and the steps between them, both included.

    Events without a wet step have NULL onset and duration. A series is as long as
    its event, which the data model bounds.
    """
    here = cells.join(peaks.where("found").select(*keys, "peak_y", "peak_x"), list(keys)).where("y = peak_y and x = peak_x")
    is_wet = F.col(value) > wet
    out = here.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("t", F.col(value).alias("v")))).alias("_s"),
        F.sum(value).alias("total"), F.max(value).alias("max"), F.min(F.when(is_wet, F.col("t"))).alias("first_wet"), F.max(F.when(is_wet, F.col("t"))).alias("last_wet"),
    )
    return out.select(*keys, F.transform("_s", lambda p: p["v"]).alias("series"), "total", "max", "first_wet", "last_wet", (F.col("last_wet") - F.col("first_wet") + 1).alias("wet_duration"))


def step_stats(cells: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """By step: mean, maximum, total and number of valid cells, and the first cell with the maximum. Steps without a valid cell go."""
    valid = cells.where(F.col(value).isNotNull())
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x")))
    out = valid.groupBy(*keys, "t").agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.sum(value).alias("sum"), F.count("*").alias("n"), best.alias("_b"))
    return out.select(*keys, "t", "mean", "max", "sum", "n", (-F.col("_b.y")).alias("max_y"), (-F.col("_b.x")).alias("max_x"))


def step_distance(steps: DataFrame, y: int, x: int) -> DataFrame:
    """step_stats with the distance of each step's maximum from a fixed cell, and whether it is that cell."""
    dy, dx = F.col("max_y") - y, F.col("max_x") - x
    return steps.withColumns({"distance": F.hypot(dy, dx), "same_cell": (dy == 0) & (dx == 0)})


def step_neighbourhood_max(cells: DataFrame, keys: Sequence[str], y: int, x: int, reach: int = 1, value: str = "value") -> DataFrame:
    """By step the maximum around a cell and that of the whole grid; NULL where all is."""
    near = (F.abs(F.col("y") - y) <= reach) & (F.abs(F.col("x") - x) <= reach)
    return cells.groupBy(*keys, "t").agg(F.max(F.when(near, F.col(value))).alias("near_max"), F.max(value).alias("grid_max"))


def daily_cross_check(hourly: DataFrame, daily: DataFrame, hour: str, day: str, value: str) -> DataFrame:
    """Maxima of the daily field on the days that an hourly event touches."""
    days = hourly.select(F.floor(F.col(hour) / 24).alias(day)).distinct()
    return daily.join(days, day, "left_semi").groupBy(day).agg(F.max(value).alias("daily_max"))


def categories(parts: Sequence[tuple[str, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """One category per cell: that of the first table that has it."""
    both = None
    for k, (name, cells) in enumerate(parts):
        rows = cells.select(*keys, F.lit(k).alias("_k"), F.lit(name).alias("category"))
        both = rows if both is None else both.unionByName(rows)
    return both.groupBy(*keys).agg(F.min_by("category", "_k").alias("category"))


def cell_summary(cells: DataFrame, chosen: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Of the chosen cells: maximum, total, mean and number of valid steps."""
    return cells.join(chosen, list(keys), "left_semi").groupBy(*keys).agg(F.max(value).alias("max"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def flood_frequency(flood: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """By cell how many events flooded it; NULL where none did."""
    return flood.groupBy(*keys).agg(F.nullif(F.count_if(F.col(value) > 0), F.lit(0)).alias("frequency"))


def ratio_series(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """a / b by key; NULL where that is not finite."""
    both = a.join(b.select(*keys, F.col(value).alias("_b")), list(keys))
    ratio = F.col(value) / F.nullif(F.col("_b"), F.lit(0.0))
    return both.withColumn("ratio", F.when(~F.isnan(ratio) & (F.abs(ratio) < float("inf")), ratio)).drop("_b")


def daily_constancy(ratios: DataFrame, keys: Sequence[str], hour: str = "t", ratio: str = "ratio", rtol: float = 0.01, atol: float = 1e-8) -> DataFrame:
    """By day: mean and population deviation of an hourly ratio, and whether all its hours are near the mean. NULL hours are left out; days without any go."""
    rows = ratios.where(F.col(ratio).isNotNull()).withColumn("day", F.floor(F.col(hour) / 24))
    by = rows.groupBy(*keys, "day").agg(F.avg(ratio).alias("mean"), F.stddev_pop(ratio).alias("std"), F.min(ratio).alias("_a"), F.max(ratio).alias("_b"))
    near = F.greatest(F.abs(F.col("_a") - F.col("mean")), F.abs(F.col("_b") - F.col("mean"))) <= F.lit(atol) + F.lit(rtol) * F.abs(F.col("mean"))
    return by.withColumn("constant", near).drop("_a", "_b")


def anomaly(values: DataFrame, climatology: DataFrame, keys: Sequence[str], at: str, value: str, clim: str, width: float = 1.0) -> DataFrame:
    """values with the climatology interpolated linearly between its days, and the difference; NULL for a key without one. Beyond the first or last day, that day's value holds.

    The climatology's spans are laid out in slots of `width` from its first day to
    its last, and a value looks its slot up by an equi-join. A slot holds the few
    spans that touch it; a climatology has a year of days at most.
    """
    ends = climatology.agg(F.min(F.floor(F.col(at) / width)), F.max(F.floor(F.col(at) / width))).first()
    if ends[0] is None:
        return values.withColumns({"climatology": F.lit(None).cast("double"), "anomaly": F.lit(None).cast("double")})
    spans = climatology.where(F.col(at).isNotNull()).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(at).cast("double").alias("_a"), F.col(clim).cast("double").alias("_va"))
    after = Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_a")
    spans = spans.withColumns({"_b": F.lead("_a").over(after), "_vb": F.lead("_va").over(after), "_first": F.row_number().over(after) == 1})
    low = F.when(F.col("_first"), F.lit(ends[0])).otherwise(F.floor(F.col("_a") / width))
    high = F.when(F.col("_b").isNull(), F.lit(ends[1])).otherwise(F.floor(F.col("_b") / width))
    own = [f"_k_{k}" for k in keys]
    slots = spans.withColumn("_slot", F.explode(F.sequence(low, high))).groupBy(*own, "_slot").agg(F.array_sort(F.collect_list(F.struct("_a", "_va", "_b", "_vb"))).alias("_spans"))
    placed = values.withColumn("_at", F.least(F.greatest(F.floor(F.col(at) / width), F.lit(ends[0])), F.lit(ends[1])))
    both = placed.join(slots, [placed["_at"] == slots["_slot"], *[placed[k].eqNullSafe(slots[f"_k_{k}"]) for k in keys]], "left")
    held = F.filter("_spans", lambda s: s["_a"] <= F.col(at))
    span = F.when(F.col(at).isNotNull(), F.when(F.size(held) > 0, F.element_at(held, -1)).otherwise(F.col("_spans")[0]))
    share = F.least(F.greatest((F.col(at) - F.col("_s._a")) / (F.col("_s._b") - F.col("_s._a")), F.lit(0.0)), F.lit(1.0))
    at_ = F.when(F.col("_s._b").isNull(), F.col("_s._va")).otherwise(F.col("_s._va") + (F.col("_s._vb") - F.col("_s._va")) * share)
    both = both.withColumn("_s", span).withColumn("climatology", at_)
    return both.withColumn("anomaly", F.col(value) - F.col("climatology")).select(*values.columns, "climatology", "anomaly")


# ---------------------------------------------------------------- fields on one grid and on others


def on_same_grid(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two rasters pixel by pixel; a pixel that only one of them has raises."""
    odd = a.select(*keys, F.lit(1).alias("_a")).join(b.select(*keys, F.lit(1).alias("_b")), list(keys), "full").where("_a is null or _b is null").limit(3).collect()
    if odd:
        raise ValueError(f"the grids differ, as at {odd}")
    return a.join(b, list(keys))


def over_time(cells: DataFrame, flat: DataFrame, value: str, by: str, out: str) -> DataFrame:
    """A field in time divided by one without time."""
    return cells.join(flat.select("y", "x", F.col(by).alias("_f")), ["y", "x"]).withColumn(out, F.col(value) / F.nullif(F.col("_f"), F.lit(0.0))).drop("_f")


def where_valid(df: DataFrame, mask: str, value: float, out: str) -> DataFrame:
    """A constant where another field is valid."""
    return df.withColumn(out, F.when(F.col(mask).isNotNull(), F.lit(value)))


def nearest(fine: DataFrame, coarse: DataFrame, x: str, y: str, x_edge: float, y_edge: float, width: float, keep: Sequence[str]) -> DataFrame:
    """Fine pixels with the values of the coarse cell that holds their centre; NULL off the coarse grid."""
    keyed = fine.withColumns({"ix": F.floor((F.col(x) - x_edge) / width), "iy": F.floor((F.col(y) - y_edge) / width)})
    return keyed.join(coarse.select("ix", "iy", *keep), ["ix", "iy"], "left").select(*fine.columns, *keep)


def area_weighted(fine: DataFrame, x: str, y: str, size: float, x_edge: float, y_edge: float, width: float, value: str) -> DataFrame:
    """By coarse cell the mean of the pixels that overlap it, weighted by the overlap, NULL pixels left out, and the area that is covered. A pixel is a square around its centre."""
    parts = fine.where(F.col(value).isNotNull())
    for c, edge, name in ((x, x_edge, "ix"), (y, y_edge, "iy")):
        low, high = F.col(c) - size / 2 - edge, F.col(c) + size / 2 - edge
        parts = parts.withColumn(name, F.explode(F.sequence(F.floor(low / width), F.ceil(high / width) - 1)))
        parts = parts.withColumn(f"_{name}", F.least(high, (F.col(name) + 1) * width) - F.greatest(low, F.col(name) * width))
    area = F.col("_ix") * F.col("_iy")
    return parts.groupBy("iy", "ix").agg((F.sum(F.col(value) * area) / F.nullif(F.sum(area), F.lit(0.0))).alias("mean"), F.sum(area).alias("covered"))


def proportion(binned: DataFrame, inside: Column, capacity: int, out: str = "proportion", null_as: bool | None = None) -> DataFrame:
    """By coarse cell the share of its pixels, `capacity` in a full cell, that meet a condition, between 0 and 1. null_as: what an unknown pixel counts as; None: not as a pixel that meets it."""
    met = F.coalesce(inside, F.lit(bool(null_as)))
    return binned.groupBy("iy", "ix").agg(F.least(F.lit(1.0), F.count_if(met) / F.lit(float(capacity))).alias(out))


def flow_direction(df: DataFrame, gx: str, gy: str, rows_down: bool = True) -> DataFrame:
    """Unit vector down the slope; NULL where it is flat. rows_down: row numbers grow southwards."""
    size = F.nullif(F.hypot(gx, gy), F.lit(0.0))
    return df.withColumns({"flow_x": -F.col(gx) / size, "flow_y": (F.col(gy) if rows_down else -F.col(gy)) / size})


def edge_flow(df: DataFrame, keys: Sequence[str], ny: int, nx: int, width: int = 1) -> DataFrame:
    """By key the mean outward part of the flow along each edge of the grid, within `width` cells of it, and whether all of that edge is unknown."""
    edges = {"north": (F.col("y") < width, F.col("flow_y")), "south": (F.col("y") >= ny - width, -F.col("flow_y")), "west": (F.col("x") < width, -F.col("flow_x")), "east": (F.col("x") >= nx - width, F.col("flow_x"))}
    agg = [y for name, (at, out) in edges.items() for y in (F.avg(F.when(at, out)).alias(f"{name}_outflow"), F.bool_and(F.when(at, out.isNull())).alias(f"{name}_unknown"))]
    return df.groupBy(*keys).agg(*agg)


def coarse_saturation(df: DataFrame, moisture: str, capacity: str, depth: float = 225.0) -> DataFrame:
    """Saturation of coarse cells from mm in `depth` mm of soil, negative values unknown, 1 at most; and the storage that is left, in mm."""
    s = F.col(moisture) / (depth * F.nullif(F.col(capacity), F.lit(0.0)))
    out = df.withColumn("saturation", F.when(s >= 0, F.when(s > 1, F.lit(1.0)).otherwise(s)))
    return out.withColumn("storage_left", (1 - F.col("saturation")) * depth * F.col(capacity))


def bounds_agree(df: DataFrame, centre: str, low: str, high: str, tolerance: float = 1e-6) -> DataFrame:
    """How many centres are not the mean of their bounds."""
    off = F.abs(F.col(centre) - (F.col(low) + F.col(high)) / 2) > tolerance
    return df.agg(F.count_if(F.coalesce(off, F.lit(True))).alias("n_off"), F.count("*").alias("n"))


def audit(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float] = (0.01, 0.5, 0.99)) -> DataFrame:
    """By key: unknown, infinite and valid values, the share of valid ones above 1, and quantiles of the valid ones."""
    v = F.col(value)
    valid = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    known = F.when(valid, v)
    out = df.groupBy(*keys).agg(
        F.count_if(v.isNull() | F.isnan(v)).alias("n_unknown"), F.count_if(F.abs(v) == float("inf")).alias("n_infinite"), F.count_if(valid).alias("n_valid"),
        (F.count_if(known > 1) / F.nullif(F.count_if(valid), F.lit(0))).alias("over_1"), F.percentile(known, F.array(*map(F.lit, shares))).alias("_q"),
    )
    return out.select(*keys, "n_unknown", "n_infinite", "n_valid", "over_1", *[F.col("_q")[k].alias(f"q{round(100 * s):02d}") for k, s in enumerate(shares)])


def uncovered(pixels: DataFrame, value: str, mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many pixels with value 0 the mask does not cover."""
    return pixels.where(F.col(value) == 0).join(mask, list(keys), "left_anti").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- polygons


def mask(cells: DataFrame, rings: Sequence[Sequence[tuple[float, float]]], x: str, y: str, size: float, method: str = "center_point") -> DataFrame:
    """Cells of a polygon: those whose centre is in it, or, as full_cell, all that it touches. Another method raises."""
    if method == "center_point":
        return cells.where(within(F.col(x), F.col(y), rings))
    if method != "full_cell":
        raise ValueError(f"no such method: {method}")
    return cells.where(meets_box(F.col(x), F.col(y), size / 2, rings))


def clipped(cells: DataFrame, inside: Column, keys: Sequence[str], value: str = "value") -> DataFrame:
    """By key the mean, maximum and minimum of valid cells inside, and their number; NULL without any."""
    v = F.when(inside, F.col(value))
    return cells.groupBy(*keys).agg(F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.count(v).alias("n"))
