"""Rolling, ranking and ordered-group operators. Every order has a tiebreak."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .joins import running_total, with_place


#: Rows of one group that a window takes in one task; groups of more are spread.
TASK_ROWS = 1_000_000


def over_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], back: int, ahead: int, columns: dict[str, Callable[[WindowSpec], Column]], most: int = TASK_ROWS) -> DataFrame:
    """df with columns over windows that reach at most `back` rows back and `ahead` rows on in their group; columns get the ordered window, and give it its frame.

    Where no group has more than `most` rows, a plain window per group does.
    Otherwise rows are placed in the order of group and order and cut into runs
    of `most`; each run also gets the `back` rows before it and the `ahead` rows
    behind it, makes its columns, and drops those guests. Only that many rows
    are copied per run, and one group with all rows is spread over all runs.
    """
    plain = Window.partitionBy(*keys).orderBy(*order)
    largest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= most:
        return df.withColumns({name: made(plain) for name, made in columns.items()})
    size = max(most, back, ahead)
    rows = with_place(df, [*keys, *order])
    run, at = F.floor(F.col("_place") / size), F.col("_place") % size
    copies = F.filter(F.array(F.struct(run.alias("run"), F.lit(True).alias("own")), F.when((at < ahead) & (run > 0), F.struct((run - 1).alias("run"), F.lit(False).alias("own"))), F.when(at >= size - back, F.struct((run + 1).alias("run"), F.lit(False).alias("own")))), lambda c: c.isNotNull())
    rows = rows.withColumn("_r", F.explode(copies)).withColumns({"_run": F.col("_r.run"), "_own": F.col("_r.own")})
    here = Window.partitionBy("_run", *keys).orderBy("_place")
    return rows.withColumns({name: made(here) for name, made in columns.items()}).where("_own").drop("_r", "_run", "_own", "_place")


def centred_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: int, least: int, out: str = "rolling", most: int = TASK_ROWS) -> DataFrame:
    """Centred rolling mean; an even width reaches one row further back. NULL with fewer than `least` values. The order has to be total in a group."""
    back, ahead = width // 2, (width - 1) // 2

    def mean(w: WindowSpec) -> Column:
        w = w.rowsBetween(-back, ahead)
        return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))

    return over_rows(df, keys, order, back, ahead, {out: mean}, most)


def rolling_max_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, hours: Sequence[int], most: int = TASK_ROWS) -> DataFrame:
    """By group the largest sum of h consecutive rows for each h, or of all rows if there are fewer."""

    def trailing(h: int) -> Callable[[WindowSpec], Column]:
        return lambda w: F.when(F.count("*").over(w.rowsBetween(-(h - 1), 0)) == h, F.sum(value).over(w.rowsBetween(-(h - 1), 0)))

    rows = over_rows(df, keys, order, max(hours) - 1, 0, {f"_s{h}": trailing(h) for h in hours}, most)
    return rows.groupBy(*keys).agg(*[F.when(F.count("*") >= h, F.max(f"_s{h}")).otherwise(F.sum(value)).alias(f"max_{h}h") for h in hours])


def group_number(df: DataFrame, key: Sequence[str], order: str, out: str = "group_id") -> DataFrame:
    """Dense number of each group, from 0, by first appearance. Groups are counted over range partitions; rows with a NULL key go."""
    first = df.groupBy(*key).agg(F.min(order).alias("_first"))
    return df.join(with_place(first, ["_first", *key], out).drop("_first"), list(key))


def demean(df: DataFrame, keys: Sequence[str], value: str, out: str = "within") -> DataFrame:
    """The value without its group's mean; by aggregation and join, so a hot group is combined first. NULL keys are a group."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("_m")).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_m")
    joined = df.join(means, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return joined.withColumn(out, F.col(value) - F.col("_m")).select(*df.columns, *([out] if out not in df.columns else []))


def top_k(df: DataFrame, value: str, tie: Sequence[str], k: int) -> DataFrame:
    """The k largest, ties by the given order."""
    return df.where(F.col(value).isNotNull()).orderBy(F.desc(value), *tie).limit(k)


def stride(df: DataFrame, order: Sequence[str], step: int, start: int = 0) -> DataFrame:
    """Every step-th row of an order."""
    return with_place(df, order).where((F.col("_place") >= start) & ((F.col("_place") - start) % step == 0)).drop("_place")


def head(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """The first k rows of an order."""
    return df.orderBy(*order).limit(k)


def tail(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """The last k rows of an order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(k)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """n rows, or all if there are fewer, of the table or of each class: those whose hash with the seed is least, the same in every run."""
    if not by:
        return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def nearest_of(df: DataFrame, target: str, candidates: Sequence[str], out: str = "nearest") -> DataFrame:
    """Name of the column whose value is nearest to the target; the first of equals, NULL without any."""
    gaps = F.filter(F.array(*[F.struct(F.abs(F.col(c) - F.col(target)).alias("gap"), F.lit(k).alias("k"), F.lit(c).alias("name")) for k, c in enumerate(candidates)]), lambda x: x["gap"].isNotNull())
    return df.withColumn(out, F.array_min(gaps)["name"])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with equal keys the first in the order, by a combining aggregation."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    got = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return got.select(*keys, "_r.*").select(*df.columns)


def dominant(df: DataFrame, columns: Sequence[str], out: str = "dominant") -> DataFrame:
    """Name of the column with the largest absolute value in each row; the first of equals."""
    best = F.array_max(F.array(*[F.struct(F.abs(F.col(c)).alias("v"), F.lit(-k).alias("k"), F.lit(c).alias("name")) for k, c in enumerate(columns)]))
    return df.withColumn(out, best["name"])


def ecdf(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], out: str = "ecdf") -> DataFrame:
    """Place in the sorted group over its size; the tie columns make the order total. A hot group is spread over range partitions; rows with a NULL key go."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    placed = running_total(df.withColumn("_one", F.lit(1)), keys, [value, *tie], "_one", "_before_")
    return placed.join(sizes, list(keys)).withColumn(out, (F.col("_before_") + 1) / F.col("_size")).drop("_one", "_before_", "_size")


def transitions(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, most: int = TASK_ROWS) -> DataFrame:
    """By group the rate of changes between dry and wet."""
    wet = F.col(value) > 0
    rows = over_rows(df, keys, order, 1, 0, {"_c": lambda w: (wet != F.lag(wet).over(w)).cast("int")}, most)
    return rows.groupBy(*keys).agg((F.sum(F.coalesce("_c", F.lit(0))) / F.count("*")).alias("transition_rate"))
