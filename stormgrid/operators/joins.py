"""Joins in time and space, matching, and positional binding."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import within_column


def interval_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, stop: str, width: int = 720, how: str = "inner") -> DataFrame:
    """points with start <= at < stop of a span with the same keys. Spans are dealt to buckets of `width`, so the join is an equi-join with a residual.

    how: 'inner', or 'left' to keep spans without a point.
    """
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.greatest(F.floor((F.col(stop) - 1) / width), F.floor(F.col(start) / width)))))
    on = [*keys, "_b"]
    hit = s.join(p, on, "inner").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))).drop("_b")
    if how == "inner":
        return hit
    found = hit.select(*[F.col(c).alias(f"_s_{c}") for c in spans.columns]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in spans.columns]
    rest = spans.join(found, same, "left_anti")
    return hit.unionByName(rest, allowMissingColumns=True)


def lookback_means(events: DataFrame, daily: DataFrame, keys: Sequence[str], event: str, anchor: str, day: str, value: str, days: Sequence[int] = (2, 3, 4, 5)) -> DataFrame:
    """For each event the mean of the values on the n days before its anchor, for each n. One join at the longest n; NULL without any day."""
    spans = events.select(event, *keys, F.col(anchor).alias("_anchor")).withColumns({"_start": F.col("_anchor") - max(days), "_stop": F.col("_anchor")})
    hit = interval_join(daily.select(*keys, day, value), spans, keys, day, "_start", "_stop", 30)
    means = hit.groupBy(event).agg(*[F.avg(F.when(F.col(day) >= F.col("_anchor") - n, F.col(value))).alias(f"mean_{n}d") for n in days])
    return events.join(means, event, "left")


def antecedent_totals(events: DataFrame, daily: DataFrame, keys: Sequence[str], event: str, anchor: str, day: str, value: str, days: Sequence[int] = (1, 2, 5, 10)) -> DataFrame:
    """The same with totals; 0 without any day."""
    spans = events.select(event, *keys, F.col(anchor).alias("_anchor")).withColumns({"_start": F.col("_anchor") - max(days), "_stop": F.col("_anchor")})
    hit = interval_join(daily.select(*keys, day, value), spans, keys, day, "_start", "_stop", 30)
    sums = hit.groupBy(event).agg(*[F.sum(F.when(F.col(day) >= F.col("_anchor") - n, F.col(value))).alias(f"total_{n}d") for n in days])
    return events.join(sums, event, "left").na.fill(0.0, [f"total_{n}d" for n in days])


def day_before(events: DataFrame, daily: DataFrame, keys: Sequence[str], onset: str, day: str, value: str) -> DataFrame:
    """Each event with the value of the day before its onset, NULL if that day is missing."""
    d = daily.select(*keys, (F.col(day) + 1).alias(onset), F.col(value).alias(f"{value}_day_before"))
    return events.join(d, [*keys, onset], "left")


def asof_before(events: DataFrame, series: DataFrame, keys: Sequence[str], anchor: str, at: str, value: str) -> DataFrame:
    """Each event with the last value strictly before its anchor, NULL without one. Of values at the same time the largest counts.

    One sort of the union of both sides by key and time, over range partitions: a key's last value is carried from part to part, so a hot key is spread.
    """
    seen = F.struct(F.col(at).alias("t"), F.col(value).alias("v"))
    none = F.lit(None).cast(series.select(seen.alias("s")).schema["s"].dataType)
    row = F.lit(None).cast(events.select(F.struct("*").alias("r")).schema["r"].dataType)
    both = series.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), seen.alias("_seen"), row.alias("_row")).unionByName(events.select(*keys, F.col(anchor).alias("_t"), F.lit(0).alias("_side"), none.alias("_seen"), F.struct("*").alias("_row")))
    both = in_parts(both, [*keys, "_t", "_side"]).drop("_mono")
    here = Window.partitionBy("_pid", *keys).orderBy("_t", "_side", "_seen").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = both.withColumn("_last", F.last("_seen", ignorenulls=True).over(here)).where("_side = 0")
    parts = both.groupBy("_pid", *keys).agg(F.max("_seen").alias("_seen"))
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_pid", *keys, F.last("_seen", ignorenulls=True).over(earlier).alias("_carried"))  # a row per key and part
    on = [got["_pid"] == parts["_pid"], *[got[k].eqNullSafe(parts[k]) for k in keys]]
    return got.join(parts, on, "left").select("_row.*", F.coalesce("_last", "_carried")["v"].alias(f"{value}_before"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, rings: str = "rings") -> DataFrame:
    """points left-joined to the polygons that hold them (edges excluded; in two polygons: two rows).

    Polygons carry minx, miny, maxx, maxy, and are dealt to grid cells as wide as
    their bounds are on average; a point is in one cell, so the join is an
    equi-join with the exact test as its residual, at any number of polygons.
    """
    wide = polygons.agg(F.greatest(F.avg(F.col("maxx") - F.col("minx")), F.avg(F.col("maxy") - F.col("miny")))).first()[0] or 1.0
    spread = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / wide), F.floor(F.col(high) / wide)))
    held = polygons.withColumn("_cx", spread("minx", "maxx")).withColumn("_cy", spread("miny", "maxy"))
    p = points.withColumns({"_px": F.floor(F.col(x) / wide), "_py": F.floor(F.col(y) / wide)})
    on = (p["_px"] == held["_cx"]) & (p["_py"] == held["_cy"]) & p[x].between(held["minx"], held["maxx"]) & p[y].between(held["miny"], held["maxy"]) & within_column(p[x], p[y], held[rings])
    return p.join(held, on, "left").drop("_px", "_py", "_cx", "_cy", rings, "minx", "miny", "maxx", "maxy")


def bind_columns(left: DataFrame, right: DataFrame, left_order: Sequence[str | Column], right_order: Sequence[str | Column]) -> DataFrame:
    """Rows paired by their places in two orders; unequal numbers of rows raise. Clashing names stay those of the left.

    Places are counted over range partitions, so neither table passes one task.
    """
    a, b = with_place(left, left_order), with_place(right.drop(*[c for c in right.columns if c in left.columns and c not in right_order]), right_order)
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows cannot be bound to {m}")
    dup = [c for c in b.columns if c in a.columns and c != "_place"]
    return a.join(b.drop(*dup), "_place").drop("_place")


def shared_folder(spark: SparkSession) -> str:
    """Folder that spark.checkpoint.dir names; a temporary one where that is unset, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: for results that another computation, or one after a lost executor, could give differently."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_weighted(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, most: int = 1000) -> DataFrame:
    """Inner join where right has a row per key, and in `weight` how many of left's rows have it. Keys with over 1 / most of all rows, `most` at most, are broadcast, so their rows stay where they are; the rest is shuffled."""
    total = right.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * F.lit(most) > F.lit(total)
    hot, other = right.where(is_hot), right.where(~is_hot)
    return left.join(F.broadcast(hot), list(keys)).unionByName(left.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(other, list(keys)))


def in_parts(df: DataFrame, order: Sequence[str | Column], times: int = 1) -> DataFrame:
    """df in range partitions of an order, `times` as many as a shuffle has, sorted, with their numbers in `_pid`. Settled: bounds come from samples, and all uses have to see the same parts."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * times
    return settled(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """df with the total of the rows before each, by group and order; within range partitions, then over them, so a hot group is spread. NULL keys are a group."""
    df = in_parts(df, [*keys, *order]).drop("_mono")
    here = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy("_pid", *keys).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_pid").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))  # a row per group and part
    on = F.col("_pid") == F.col("_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    got = df.withColumn("_in", F.coalesce(F.sum(value).over(here), F.lit(0))).join(parts, on)
    return got.withColumn(out, F.col("_in") + F.col("_before")).drop("_pid", "_p", "_in", "_before", *[f"_k_{k}" for k in keys])


def with_place(df: DataFrame, order: Sequence[str | Column], out: str = "_place") -> DataFrame:
    """df with each row's place in a total order, from 0: range-partitioned sort, rows counted per partition, offsets added."""
    order = [F.expr(c) if isinstance(c, str) else c for c in order]
    df = in_parts(df, order)
    counts = df.groupBy("_pid").agg(F.count("*").alias("_n"), F.min("_mono").alias("_low"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    return df.join(F.broadcast(offsets.select("_pid", "_low", "_before")), "_pid").withColumn(out, F.col("_mono") - F.col("_low") + F.col("_before")).drop("_pid", "_mono", "_low", "_before")


def marked_right(events: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every distinct lookup row with its events, and matched = true where it has any; events without a lookup row go."""
    return events.withColumn("matched", F.lit(True)).join(lookup.dropDuplicates(), list(keys), "right").na.fill(False, ["matched"])


def lookup(df: DataFrame, table: DataFrame, left: str, right: str) -> DataFrame:
    """df with a dimension table's columns; the keys have different names and the right one is dropped. NULL without a match."""
    return df.join(table, df[left] == table[right], "left").drop(table[right])


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str], a_span: tuple[str, str], b_span: tuple[str, str], width: int = 720) -> DataFrame:
    """Pairs of half-open spans with equal keys that overlap, once each: both are dealt to buckets of `width`, and a pair is taken in the first bucket that both are in."""
    cut = lambda df, span, name: df.withColumn(name, F.explode(F.sequence(F.floor(F.col(span[0]) / width), F.floor((F.col(span[1]) - 1) / width))))
    x, y = (df.where(F.col(span[1]) > F.col(span[0])) for df, span in ((a, a_span), (b, b_span)))
    both = cut(x, a_span, "_b").join(cut(y, b_span, "_b"), [*keys, "_b"])
    both = both.where((F.col(a_span[1]) > F.col(b_span[0])) & (F.col(a_span[0]) < F.col(b_span[1])))
    return both.where(F.col("_b") == F.floor(F.greatest(a_span[0], b_span[0]) / width)).drop("_b")


def contains_hour(df: DataFrame, hour: str, start: str, stop: str, out: str = "time_mismatch") -> DataFrame:
    """Flags rows whose hour is not in their half-open span; NULLs are mismatches."""
    return df.withColumn(out, ~F.coalesce((F.col(hour) >= F.col(start)) & (F.col(hour) < F.col(stop)), F.lit(False)))


def total_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join that has to find every key of the left; a missing one raises."""
    missing = left.join(right, list(keys), "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"no match for {missing}")
    return left.join(right, list(keys))


def remaining(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work that is not done yet."""
    return todo.join(done, list(keys), "left_anti")


def nearest_within_blocks(late: DataFrame, early: DataFrame, block: Sequence[str], features: Sequence[str], key: str, caliper: float = 1.0, most: int = 4) -> DataFrame:
    """For each late row the nearest early row of its block by Euclidean distance, with replacement; none beyond the caliper.

    Equal rows are taken together. Early rows are dealt to cells of all features, and
    a late row meets those of its cell and the cells around it: whoever it finds
    within a cell's width is the nearest. Cells begin as narrow as `most` early rows
    in the usual one ask for, and those who found nobody go on to cells twice as
    wide, up to the caliper. So a denser table makes cells narrower, not fuller.
    """
    points = settled(early.groupBy(*block, *features).agg(F.min(key).alias("match")).select(*block, *[F.col(f).alias(f"_{f}") for f in features], "match"))
    todo, found = settled(late.select(*block, *features).distinct()), None
    cell = lambda f, width: F.floor(F.col(f) / (width * (1 + 1e-9)))  # noqa: E731 (a little wider, as quotients are rounded)
    cells = [f"_c{k}" for k in range(len(features))]
    placed = lambda width: points.withColumns({c: cell(f"_{f}", width) for c, f in zip(cells, features, strict=True)})
    full = placed(caliper).groupBy(*block, *cells).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n").cast("double")) / F.sum("n")).first()[0] or 1.0
    d = F.sqrt(sum(((F.col(x) - F.col(f"_{x}")) * (F.col(x) - F.col(f"_{x}")) for x in features), F.lit(0.0)))
    for halved in range(max(0, round(math.log2(full / most) / len(features))), -1, -1):
        width = caliper / 2**halved
        asking = todo
        for c, f in zip(cells, features, strict=True):
            asking = asking.withColumn(c, F.explode(F.array(*[cell(f, width) + k for k in (-1, 0, 1)])))
        hit = asking.join(placed(width), [*block, *cells]).withColumn("distance", d).where(F.col("distance") <= width)
        got = settled(hit.groupBy(*block, *features).agg(F.min(F.struct("distance", "match")).alias("m")))
        found = got if found is None else found.unionByName(got)
        if halved:
            todo = settled(todo.join(got, [*block, *features], "left_anti"))
    best = late.select(*block, *features, key).join(found, [*block, *features]).groupBy(*block, key).agg(F.min("m").alias("m"))
    return best.select(*block, key, "m.match", "m.distance")
