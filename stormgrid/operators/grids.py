"""Cells, rasters and storm footprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.geometry import cell
from .joins import settled
from .windows import TASK_ROWS, over_rows


def peak_cell(cells: DataFrame, keys: Sequence[str], value: str = "value", floor: float = 0.0, order: Sequence[str] = ("t", "y", "x")) -> DataFrame:
    """By event the cell with the largest value, the first in (t, y, x) of equals, and how many tie. Values up to `floor` make found = false with NULLs."""
    order = [c for c in order if c in cells.columns]
    same = cells.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_at"))  # ties are counted where values are combined
    top = same.groupBy(*keys).agg(F.max(F.struct(F.col(value).alias("v"), "_n", "_at")).alias("m"))
    found = F.coalesce(F.col("m.v") > floor, F.lit(False))
    return top.select(*keys, found.alias("found"), F.when(found, F.col("m.v")).alias("peak_value"), *[F.when(found, F.col(f"m._at.{c}")).alias(f"peak_{c}") for c in order], F.when(found, F.col("m._n")).otherwise(0).alias("n_ties"))


def neighbourhood(cells: DataFrame, peaks: DataFrame, keys: Sequence[str], value: str = "value", reach: int = 1, extra: Sequence[str] = ()) -> DataFrame:
    """By event: total, total without the peak, and number of cells in the square around the peak, clipped to the grid; sums of extra columns, such as flooded areas of the cells."""
    near = cells.join(peaks.where("found").select(*keys, "peak_y", "peak_x"), list(keys)).where((F.abs(F.col("y") - F.col("peak_y")) <= reach) & (F.abs(F.col("x") - F.col("peak_x")) <= reach))
    here = (F.col("y") == F.col("peak_y")) & (F.col("x") == F.col("peak_x"))
    return near.groupBy(*keys).agg(F.sum(value).alias("neighbourhood_total"), F.coalesce(F.sum(F.when(~here, F.col(value))), F.lit(0.0)).alias("neighbourhood_without_peak"), F.count(value).alias("neighbourhood_n"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"neighbourhood_{c}") for c in extra])


def footprint(cells: DataFrame, peaks: DataFrame, keys: Sequence[str], value: str = "value", levels: Sequence[float] = (0.5, 0.6, 0.8), extra: Sequence[str] = ()) -> DataFrame:
    """By event and level: total, mean and number of cells at that share of the peak or more; sums and means of extra columns. One pass, a row per level."""
    rows = cells.join(peaks.where("found").select(*keys, "peak_value"), list(keys))
    agg = [x for k, s in enumerate(levels) for m in [F.col(value) >= s * F.col("peak_value")] for x in (F.sum(F.when(m, F.col(value))).alias(f"t{k}"), F.count(F.when(m, 1)).alias(f"n{k}"), *[y for c in extra for y in (F.coalesce(F.sum(F.when(m, F.col(c))), F.lit(0.0)).alias(f"s{k}_{c}"), F.avg(F.when(m, F.col(c))).alias(f"m{k}_{c}"))])]
    out = rows.groupBy(*keys).agg(*agg)
    each = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("level"), F.col(f"t{k}").alias("threshold_total"), F.col(f"n{k}").alias("threshold_n"), (F.col(f"t{k}") / F.nullif(F.col(f"n{k}"), F.lit(0))).alias("threshold_mean"), *[y for c in extra for y in (F.col(f"s{k}_{c}").alias(f"threshold_{c}"), F.col(f"m{k}_{c}").alias(f"threshold_{c}_mean"))]) for k, s in enumerate(levels)])).alias("r")
    return out.select(*keys, each).select(*keys, "r.*")


def antecedent(cells: DataFrame, field: DataFrame, peaks: DataFrame, keys: Sequence[str], antecedent: str, level: float = 0.5, value: str = "value") -> DataFrame:
    """By event the mean of another field (y, x, antecedent) over the footprint at a level, and its value at the peak cell."""
    rows = cells.join(peaks.where("found").select(*keys, "peak_value", "peak_y", "peak_x"), list(keys)).where(F.col(value) >= level * F.col("peak_value")).join(field.select("y", "x", antecedent), ["y", "x"])
    here = (F.col("y") == F.col("peak_y")) & (F.col("x") == F.col("peak_x"))
    return rows.groupBy(*keys).agg(F.avg(antecedent).alias("antecedent_mean"), F.max(F.when(here, F.col(antecedent))).alias("antecedent_at_peak"))


def connected_cells(cells: DataFrame, keys: Sequence[str], connectivity: int = 4, rounds: int = 60) -> DataFrame:
    """Cells (keys, y, x) with `label`, the smallest cell (y, x) that they are connected with.

    connectivity: 4, or 8 with diagonals. Neighbouring cells make edges, and in
    each round every cell's larger neighbours, then its smaller ones, are tied to
    its smallest neighbour, so that distances in a component shrink by more than
    half: a chain of n cells takes about log2(n) rounds. Rounds are written to the
    shared folder, and a count and a checksum come to the driver.
    """
    if connectivity not in (4, 8):
        raise ValueError(f"no such connectivity: {connectivity}")
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if connectivity == 8 else [])]
    own = settled(cells.select(*keys, F.struct(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).alias("a")).distinct())
    moved = F.explode(F.array(*[F.struct((F.col("a.y") + dy).alias("y"), (F.col("a.x") + dx).alias("x")) for dy, dx in steps])).alias("b")
    now = own.select(*keys, "a", moved).join(own.withColumnRenamed("a", "b"), [*keys, "b"]).select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))  # the second step's cell comes later in (y, x)
    now, seen = settled(now), None
    for _ in range(rounds):
        both = now.unionByName(now.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.min("b").alias("m")).select(*keys, "a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = large.join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(*keys, "a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = settled(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components still changed after {rounds} rounds")
    label = now.groupBy(*keys, "a").agg(F.min("b").alias("label"))
    return own.join(label, [*keys, "a"], "left").select(*keys, "a.y", "a.x", F.coalesce("label", "a").alias("label"))


def peak_cluster(cells: DataFrame, peaks: DataFrame, keys: Sequence[str], value: str = "value", level: float = 0.5, connectivity: int = 4, rounds: int = 60) -> DataFrame:
    """Cells at the level or above that are connected with the peak cell, the one of their component that the peak is in; see connected_cells."""
    mask = cells.join(peaks.where("found").select(*keys, "peak_value", "peak_y", "peak_x"), list(keys)).where(F.col(value) >= level * F.col("peak_value"))
    labels = settled(connected_cells(mask, keys, connectivity, rounds))
    wanted = labels.join(peaks.where("found").select(*keys, F.col("peak_y").alias("y"), F.col("peak_x").alias("x")), [*keys, "y", "x"], "left_semi").select(*keys, "label")
    chosen = labels.join(wanted, [*keys, "label"], "left_semi").select(*keys, "y", "x")
    return mask.select(*keys, "y", "x", value).join(chosen, [*keys, "y", "x"], "left_semi")


def cluster_summary(cluster: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """By event: total, cells, mean of a cluster, and its cells beside the peak."""
    return cluster.groupBy(*keys).agg(F.sum(value).alias("cluster_total"), F.count("*").alias("cluster_n"), F.avg(value).alias("cluster_mean"), (F.count("*") - 1).alias("cluster_others"))


def exceedance(cells: DataFrame, keys: Sequence[str], threshold: float, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Cells over a threshold by step, and steps over it by cell."""
    over = cells.where(F.col(value) > threshold)
    return over.groupBy(*keys, "t").agg(F.count("*").alias("n_cells"), F.max(value).alias("max_value")), over.groupBy(*keys, "y", "x").agg(F.count("*").alias("n_steps"), F.max(value).alias("max_value"))


def to_coarse(points: DataFrame, x: str, y: str, x_edge: float, y_edge: float, width: float, nx: int, ny: int) -> DataFrame:
    """Points with the coarse cell (iy, ix) of their centre; points off the grid go."""
    out = points.withColumns({"ix": cell(F.col(x), x_edge, width), "iy": cell(F.col(y), y_edge, width)})
    return out.where(F.col("ix").between(0, nx - 1) & F.col("iy").between(0, ny - 1))


def coarse_stats(binned: DataFrame, value: str, wet: float = 0.0, pixel_area: float = 1.0) -> DataFrame:
    """By coarse cell: mean, number of pixels, wet area, and volume over wet pixels."""
    wet_ = F.col(value) > wet
    return binned.groupBy("iy", "ix").agg(F.avg(value).alias("mean"), F.count(value).alias("n"), (F.count(F.when(wet_, 1)) * pixel_area).alias("area"), (F.coalesce(F.sum(F.when(wet_, F.col(value))), F.lit(0.0)) * pixel_area).alias("volume"))


def coarse_mode(binned: DataFrame, klass: str) -> DataFrame:
    """By coarse cell: the most frequent class, the smallest of equals, and its share."""
    n = binned.where(F.col(klass).isNotNull()).groupBy("iy", "ix", klass).agg(F.count("*").alias("n"))
    return n.groupBy("iy", "ix").agg(F.max(F.struct("n", (-F.col(klass)).alias("neg"))).alias("m"), F.sum("n").alias("total")).select("iy", "ix", (-F.col("m.neg")).alias("mode"), (F.col("m.n") / F.col("total")).alias("mode_share"))


def dense(df: DataFrame, nx: int, ny: int, fill: dict[str, float] | None = None, block: int = 1 << 16) -> DataFrame:
    """A row for each cell of the grid; the named columns get their fill value, others NULL.

    Each row of df is followed by the cells up to the next one, within blocks of
    cells that begin with a mark: rows and marks are shuffled and sorted, cells are
    not, so the grid may be far larger than the table.
    """
    others = [c for c in df.columns if c not in ("iy", "ix")]
    at = F.col("iy").cast("long") * nx + F.col("ix").cast("long")
    inside = df.where((F.col("iy") >= 0) & (F.col("iy") < ny) & (F.col("ix") >= 0) & (F.col("ix") < nx))
    given = inside.select(at.alias("_at"), F.lit(True).alias("_row"), *others)
    marks = df.sparkSession.range(0, nx * ny, block).select(F.col("id").alias("_at"), F.lit(False).alias("_row"))
    both = given.unionByName(marks, allowMissingColumns=True).withColumn("_block", F.floor(F.col("_at") / block))
    next_ = F.coalesce(F.lead("_at").over(Window.partitionBy("_block").orderBy("_at", "_row")), F.least((F.col("_block") + 1) * block, F.lit(nx * ny)))
    spans = both.withColumn("_to", next_ - 1).where(F.col("_row") | (F.col("_to") >= F.col("_at")))
    cells = spans.select("*", F.posexplode(F.sequence("_at", F.greatest("_at", "_to"))).alias("_k", "_cell"))
    out = cells.select(F.expr(f"_cell div {nx}").cast("int").alias("iy"), (F.col("_cell") % nx).cast("int").alias("ix"), *[F.when(F.col("_k") == 0, F.col(c)).alias(c) for c in others])
    return out.na.fill(fill) if fill else out


def slope(cells: DataFrame, keys: Sequence[str], value: str = "value", spacing: float = 1.0, most: int = TASK_ROWS) -> DataFrame:
    """Slope in degrees: central differences inside, one-sided ones at the edges. A window along rows and one along columns; long ones are spread."""
    out = cells
    for name, other, along in (("_gy", "x", "y"), ("_gx", "y", "x")):

        def gradient(w: WindowSpec) -> Column:
            low, high, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
            return F.when(low.isNull(), high - v).when(high.isNull(), v - low).otherwise((high - low) / 2) / spacing

        out = over_rows(out, [*keys, other], [along], 1, 1, {name: gradient}, most)
    return out.withColumn("slope", F.degrees(F.atan(F.hypot("_gx", "_gy")))).drop("_gx", "_gy")


def zonal(points: DataFrame, zone: str, value: str) -> DataFrame:
    """By zone: mean, least, largest and number of valid pixels; share above 1 and below 0 of them."""
    v = F.col(value)
    return points.where(F.col(zone).isNotNull()).groupBy(zone).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"), *[(F.count(F.when(m, 1)) / F.nullif(F.count(v), F.lit(0)) * 100).alias(name) for name, m in (("pct_over_1", v > 1), ("pct_under_0", v < 0))])


def mosaic(rasters: Sequence[DataFrame], value: str = "value") -> DataFrame:
    """One raster of several, the first valid value of each pixel winning."""
    both = None
    for k, r in enumerate(rasters):
        r = r.withColumn("_k", F.lit(k))
        both = r if both is None else both.unionByName(r)
    return both.where(F.col(value).isNotNull()).groupBy("row", "col").agg(F.min_by(value, "_k").alias(value))


def soil_columns(df: DataFrame, moisture: str, porosity: str, conductivity: str, depth: float | None = 0.225, per_second: bool = False, area: float = 900.0) -> DataFrame:
    """Saturation from kg/m2 of the top `depth` metres (None: the older form, without it), uptake length and capacity, remaining deficit, and uptake in m3 of a pixel.

    conductivity: cm/h, or m/s with per_second. Without porosity, or where it is 0, all but the uptake length is NULL.
    """
    out = df.withColumn("saturation", F.col(moisture) / 1000 / F.lit(depth or 1.0) / F.nullif(F.col(porosity), F.lit(0.0)))
    length = 4 * (25.4 * 3.6) ** 0.5 * F.sqrt(F.col(conductivity)) if per_second else 0.06375 * F.sqrt(F.col(conductivity))
    out = out.withColumn("lu", length).withColumn("fumax", F.nullif(F.col(porosity), F.lit(0.0)) * F.col("lu"))
    out = out.withColumn("deficit", F.when(F.col("saturation").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("saturation"))))
    return out.withColumn("fu", F.col("deficit") * F.col("fumax")).withColumn("fu_volume", F.col("fu") * F.lit(area))
