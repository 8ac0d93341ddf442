"""Grouped summaries, periods, trends, correlation and regression."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import in_parts, join_weighted, running_total, settled


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """mean, median, std, sem, ci95, count (non-null), size (rows) by group."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("std"), F.count(v).alias("count"), F.count("*").alias("size")).withColumn("sem", F.col("std") / F.sqrt(F.nullif(F.col("count"), F.lit(0)))).withColumn("ci95", 1.96 * F.col("sem"))


def regional_period_summary(df: DataFrame, values: Sequence[str], region: str, year: str, spans: Sequence[tuple[str, int, int]], round_to: int = 6) -> DataFrame:
    """By region and for each span of years, inclusive and possibly overlapping: means, n and events a year, and each later span's absolute and percent change against the first. One pass."""
    inside = {name: F.col(year).between(a, b) for name, a, b in spans}
    agg = [F.avg(F.when(m, F.col(v))).alias(f"{v}_{name}") for name, m in inside.items() for v in values]
    agg += [F.count(F.when(m, 1)).alias(f"n_{name}") for name, m in inside.items()]
    out = df.groupBy(region).agg(*agg)
    first = spans[0][0]
    out = out.withColumns({f"rate_{name}": F.col(f"n_{name}") / (b - a + 1) for name, a, b in spans})
    for name, *_ in spans[1:]:
        for v in [*values, "rate"]:
            new, old = F.col(f"{v}_{name}"), F.col(f"{v}_{first}")
            out = out.withColumns({f"{v}_change_{name}": new - old, f"{v}_pct_{name}": (new - old) / F.nullif(old, F.lit(0.0)) * 100})
    return out.select(*[F.round(c, round_to).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def mean_abs(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean of absolute values by group."""
    return df.groupBy(*keys).agg(F.avg(F.abs(F.col(value))).alias("mean_abs"), F.count(value).alias("n"))


def medians(df: DataFrame, keys: Sequence[str], value: str, least: int = 1) -> DataFrame:
    """Median and number of known values by coordinate or other keys; fewer than `least`: no row."""
    return df.groupBy(*keys).agg(F.median(value).alias("median"), F.count(value).alias("n")).where(F.col("n") >= least)


def group_share(df: DataFrame, outer: Sequence[str], inner: Sequence[str]) -> DataFrame:
    """n and share of each inner group in its outer group."""
    n = df.groupBy(*outer, *inner).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*outer)))


def counts_over_domain(df: DataFrame, key: str, domain: DataFrame) -> DataFrame:
    """n and percent of every value of a domain, 0 for those without a row. Rows outside the domain do not count."""
    n = domain.join(df.groupBy(key).agg(F.count("*").alias("n")), key, "left").na.fill(0, ["n"])
    total = n.agg(F.sum("n").alias("_total"))  # one row
    return n.join(F.broadcast(total)).withColumn("percent", F.col("n") / F.nullif(F.col("_total"), F.lit(0)) * 100).drop("_total")


def mean_of_means(df: DataFrame, region: str, year: str, value: str) -> DataFrame:
    """By year, the mean of the regions' means."""
    return df.groupBy(region, year).agg(F.avg(value).alias("m")).groupBy(year).agg(F.avg("m").alias("mean_of_means"), F.count("*").alias("n_regions"))


def moments(x: Column, y: Column) -> list[Column]:
    """Sums of a simple regression, over rows where both are there."""
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")]


def simple_ols(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """slope, intercept, r2, n, se, t and df of y on x by group, in one aggregation."""
    out = df.groupBy(*keys).agg(*moments(F.col(x), F.col(y)))
    rest = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.nullif(F.col("sxx"), F.lit(0.0)), F.lit(0.0))
    out = out.withColumn("df", F.col("n") - 2).withColumn("se", F.when(F.col("n") > 2, F.sqrt(rest / F.nullif(F.col("n") - 2, F.lit(0)) / F.nullif(F.col("sxx"), F.lit(0.0)))))
    return out.withColumn("t", F.col("slope") / F.nullif(F.col("se"), F.lit(0.0))).drop("sxx", "syy", "sxy")


def with_p_value(df: DataFrame, t: str = "t", dof: str = "df", out: str = "p") -> DataFrame:
    """Two-sided p of t, by the continued fraction of the incomplete beta function (a pandas UDF over one row per group)."""
    @F.pandas_udf("double")
    def p(ts: pd.Series, ns: pd.Series) -> pd.Series:
        from math import exp, lgamma, log

        def beta(a: float, b: float, x: float) -> float:
            if x <= 0 or x >= 1:
                return float(x >= 1)
            if x > (a + 1) / (a + b + 2):
                return 1 - beta(b, a, 1 - x)
            c, d, h = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300), 0.0
            h = d
            for m in range(1, 300):
                for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                    d, c = 1 / (1 + num * d or 1e-300), 1 + num / c or 1e-300
                    h *= d * c
                if abs(d * c - 1) < 1e-14:
                    break
            return exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) * h / a

        return pd.Series([beta(n / 2, 0.5, n / (n + t * t)) if n and n > 0 and not np.isnan(t) else None for t, n in zip(ts.astype(float), ns.astype(float), strict=True)])

    return df.withColumn(out, p(F.col(t).cast("double"), F.col(dof).cast("double")))


def trend(df: DataFrame, keys: Sequence[str], year: str, value: str, least: int = 5, baseline_years: int = 20) -> DataFrame:
    """Linear trend of yearly values by group: slope, r2, n, baseline (mean of the years up to the first plus `baseline_years`), percent change over the period. Fewer than `least` points: no row."""
    by_year = F.collect_list(F.struct(F.col(year).alias("y"), F.col(value).alias("v")))  # a value per year: a short list
    out = df.groupBy(*keys).agg(*moments(F.col(year).cast("double"), F.col(value)), by_year.alias("_years"), F.min(year).alias("_min"), F.max(year).alias("_max")).where(F.col("n") >= least)
    early = F.filter("_years", lambda p: (p["y"] <= F.col("_min") + baseline_years) & p["v"].isNotNull())
    out = out.withColumn("baseline", F.aggregate(early, F.lit(0.0), lambda s, p: s + p["v"]) / F.nullif(F.size(early), F.lit(0)))
    return out.withColumn("pct_change", F.col("slope") * (F.col("_max") - F.col("_min")) / F.nullif(F.col("baseline"), F.lit(0.0)) * 100).select(*keys, "slope", "intercept", "r2", "n", "baseline", "pct_change")


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """df with ranks from 1, equal values sharing their mean rank. Rows are counted by value first, and a group's values are spread over range partitions; rows with a NULL key or value go."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranks = settled(running_total(counts, keys, [value], "_c", "_b").select(*keys, value, "_c", (F.col("_b") + (F.col("_c") + 1) / 2).alias(out)))
    return join_weighted(df, ranks, [*keys, value], "_c").drop("_c")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation and n by group, over rows where both are there.

    Rows are counted by pair of values once; ranks come from the margins of those
    counts, and the correlation from weighted sums of centred ranks. No row of df
    is joined. Rows with a NULL key go.
    """
    rows = df.where(" and ".join(f"`{c}` is not null" for c in (*keys, x, y)))
    pairs = settled(rows.groupBy(*keys, x, y).agg(F.count("*").alias("_c")))
    sizes = pairs.groupBy(*keys).agg(F.sum("_c").alias("n"))
    both = pairs.join(sizes, list(keys)) if keys else pairs.join(F.broadcast(sizes))
    for c, out in ((x, "_rx"), (y, "_ry")):
        margin = pairs.groupBy(*keys, c).agg(F.sum("_c").alias("_m"))
        ranks = running_total(margin, keys, [c], "_m", "_b").select(*keys, c, (F.col("_b") + (F.col("_m") + 1) / 2).alias(out))
        both = both.join(ranks, [*keys, c]).withColumn(out, F.col(out) - (F.col("n") + 1) / 2)
    sums = {name: F.sum(F.col("_c") * F.col(a) * F.col(b)) for name, a, b in (("xx", "_rx", "_rx"), ("yy", "_ry", "_ry"), ("xy", "_rx", "_ry"))}
    out = both.groupBy(*keys).agg(F.max("n").alias("n"), *[c.alias(name) for name, c in sums.items()])
    return out.select(*keys, (F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0))).alias("rho"), "n")


def spearman_each(df: DataFrame, keys: Sequence[str], candidates: Sequence[str], y: str) -> DataFrame:
    """`spearman` of each candidate with one y: rows keys, k (the candidate's place), rho, n, over rows where both are there.

    Rows are counted by all values once and dealt out by range of y, so that y's
    ranks for every candidate come from one sort; a candidate's own ranks are
    joined from its margin. Rows with a NULL key go.
    """
    xs, each = [f"_x{k}" for k in range(len(candidates))], range(len(candidates))
    rows = df.where(" and ".join(f"`{c}` is not null" for c in (*keys, y))).select(*keys, F.col(y).alias("_y"), *[F.col(c).alias(x) for c, x in zip(candidates, xs, strict=True)])
    counts = in_parts(rows.groupBy(*rows.columns).agg(F.count("*").alias("_c")), [*keys, "_y"], 8).drop("_mono")  # equal values are in one part; small parts are dealt evenly below
    counts = counts.withColumns({f"_w{k}": F.when(F.col(x).isNotNull(), F.col("_c")).otherwise(0) for k, x in enumerate(xs)})
    over = Window.partitionBy(*keys)
    earlier = over.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("_pid", *keys).agg(*[F.sum(f"_w{k}").alias(f"_t{k}") for k in each])  # a row per group and part
    parts = parts.select("_pid", *keys, *[c for k in each for c in (F.coalesce(F.sum(f"_t{k}").over(earlier), F.lit(0)).alias(f"_b{k}"), F.sum(f"_t{k}").over(over).alias(f"_n{k}"))])
    here, same = Window.partitionBy("_pid", *keys).orderBy("_y").rangeBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("_pid", *keys, "_y")
    spread = counts.repartition(8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_pid", *keys)  # a part or two in a task
    both = spread.select("*", *[c for k in each for c in (F.sum(f"_w{k}").over(here).alias(f"_u{k}"), F.sum(f"_w{k}").over(same).alias(f"_m{k}"))]).join(parts, ["_pid", *keys])
    for k, x in enumerate(xs):
        margin = counts.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.sum("_c").alias("_m"))
        ranks = running_total(margin, keys, [x], "_m", "_b").select(*keys, x, (F.col("_b") + (F.col("_m") + 1) / 2).alias(f"_r{k}"))
        both = both.join(ranks, [*keys, x], "left")
    rx = lambda k: F.col(f"_r{k}") - (F.col(f"_n{k}") + 1) / 2
    ry = lambda k: F.col(f"_b{k}") + F.col(f"_u{k}") - (F.col(f"_m{k}") - 1) / 2 - (F.col(f"_n{k}") + 1) / 2
    sums = both.groupBy(*keys).agg(*[c for k in each for c in (F.max(f"_n{k}").alias(f"n{k}"), *[F.sum(F.col(f"_w{k}") * a * b).alias(f"{name}{k}") for name, a, b in (("xx", rx(k), rx(k)), ("yy", ry(k), ry(k)), ("xy", rx(k), ry(k)))])])
    one = lambda k: F.struct(F.lit(k).alias("k"), (F.col(f"xy{k}") / F.nullif(F.sqrt(F.col(f"xx{k}") * F.col(f"yy{k}")), F.lit(0.0))).alias("rho"), F.col(f"n{k}").alias("n"))
    return sums.select(*keys, F.explode(F.array(*[one(k) for k in each])).alias("_r")).select(*keys, "_r.*").where("n > 0")


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over rows where both are there; NULL if one of them does not vary (corr raises then, under ANSI rules)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.regr_sxy(y, x) / F.nullif(F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)), F.lit(0.0))


def two_regressor_r2(df: DataFrame, keys: Sequence[str], y: str, a: str, b: str, least: int = 20) -> DataFrame:
    """R2 of y on a, on a and b, and what b adds (0 at least), from correlations in one aggregation. Fewer than `least` rows: NULL."""
    out = df.where(" and ".join(f"`{c}` is not null" for c in (y, a, b))).groupBy(*keys).agg(correlation(y, a).alias("ya"), correlation(y, b).alias("yb"), correlation(a, b).alias("ab"), F.count("*").alias("n"))
    both = (F.col("ya") * F.col("ya") + F.col("yb") * F.col("yb") - 2 * F.col("ya") * F.col("yb") * F.col("ab")) / F.nullif(1 - F.col("ab") * F.col("ab"), F.lit(0.0))
    some = F.col("n") >= least
    added = both - F.col("ya") * F.col("ya")
    return out.select(*keys, "n", F.when(some, F.col("ya") * F.col("ya")).alias("r2_a"), F.when(some, both).alias("r2_ab"), F.when(some & added.isNotNull(), F.greatest(added, F.lit(0.0))).alias("r2_added"))


def strongest(df: DataFrame, keys: Sequence[str], candidates: Sequence[str], y: str) -> DataFrame:
    """By group the candidate with the largest positive correlation with y; the first of equals; '' without any."""
    got = df.groupBy(*keys).agg(*[correlation(c, y).alias(c) for c in candidates])
    best = F.array_max(F.array(*[F.struct(F.when(F.col(c) > 0, F.col(c)).alias("rho"), F.lit(-k).alias("k"), F.lit(c).alias("name")) for k, c in enumerate(candidates)]))
    return got.select(*keys, F.coalesce(F.when(best["rho"].isNotNull(), best["name"]), F.lit("")).alias("strongest"), best["rho"].alias("rho"))


def circular_mean(df: DataFrame, keys: Sequence[str], angle: Column, days: int = 360) -> DataFrame:
    """Mean day of the year (1 to days) on the circle, concentration R and n by group."""
    out = df.groupBy(*keys).agg(F.avg(F.sin(angle)).alias("s"), F.avg(F.cos(angle)).alias("c"), F.count("*").alias("n"))
    turn = 2 * 3.141592653589793
    return out.select(*keys, (F.pmod(F.atan2("s", "c"), F.lit(turn)) / turn * days + 1).alias("mean_day"), F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")).alias("concentration"), "n")


def climatology(df: DataFrame, keys: Sequence[str], members: Sequence[str], value: str) -> DataFrame:
    """Mean and population standard deviation over members' means."""
    return df.groupBy(*keys, *members).agg(F.avg(value).alias("m")).groupBy(*keys).agg(F.avg("m").alias("clim_mean"), F.stddev_pop("m").alias("clim_std"))


def problem_combos(df: DataFrame, keys: Sequence[str], value: str, threshold: float) -> DataFrame:
    """By group with any: rows, rows over the threshold, percent (1 decimal)."""
    over = F.col(value) > threshold
    out = df.groupBy(*keys).agg(F.count("*").alias("total"), F.count(F.when(over, 1)).alias("n_over")).where("n_over > 0")
    return out.withColumn("percent", F.round(F.col("n_over") / F.col("total") * 100, 1))


def offending(df: DataFrame, keys: Sequence[str], value: str, key: str, threshold: float) -> DataFrame:
    """The rows over the threshold, one each: a group can have any number, so they are not gathered into lists."""
    return df.where(F.col(value) > threshold).select(*keys, key, value)


def diff_report(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str], rtol: float = 1e-6, atol: float = 1e-6, tolerances: dict[str, float] | None = None) -> DataFrame:
    """By column: how many values of two versions differ, and by how much at most. One full join, one aggregation, then a row per column."""
    a = old.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = new.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns])
    both = a.join(b, list(keys), "full")
    numeric = {c for c, t in old.dtypes if t in ("double", "float", "int", "bigint")}
    agg = []
    for c in columns:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        off = ~F.coalesce(F.abs(x - y) <= F.lit((tolerances or {}).get(c, atol)) + rtol * F.abs(y), F.lit(False)) if c in numeric else ~x.eqNullSafe(y)
        off = off & ~(x.isNull() & y.isNull())
        agg += [F.count(F.when(off, 1)).alias(f"n_{c}"), (F.max(F.abs(x - y)) if c in numeric else F.lit(None)).cast("double").alias(f"d_{c}")]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n_diff"), F.col(f"d_{c}").alias("max_abs_diff")) for c in columns])).alias("r")
    return both.agg(*agg).select(rows).select("r.*").withColumn("status", F.when(F.col("n_diff") == 0, "ok").otherwise("DIFF"))


def enrichment(df: DataFrame, bin_: str, inside: Column) -> DataFrame:
    """By bin: its share among rows inside a subset over its share among all rows."""
    n = df.groupBy(bin_).agg(F.count("*").alias("n"), F.count(F.when(inside, 1)).alias("k"))
    total = n.agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"))  # one row
    return n.join(F.broadcast(total)).select(bin_, "n", "k", ((F.col("k") / F.nullif(F.col("_k"), F.lit(0))) / (F.col("n") / F.col("_n"))).alias("enrichment"))
