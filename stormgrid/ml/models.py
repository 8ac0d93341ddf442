"""Forests, cross-validation, importance, clusters and bootstraps on Spark ML."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import settled, with_place


def regressor(kind: str, features: Sequence[str], target: str, **options) -> Pipeline:
    """A pipeline of assembler, scaler and model: 'forest', 'boosted' or 'linear'."""
    make = {"forest": RandomForestRegressor, "boosted": GBTRegressor, "linear": LinearRegression}[kind]
    extra = {} if kind == "linear" else {"seed": 0}
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_features", withMean=True), make(featuresCol="_features", labelCol=target, predictionCol="prediction", **extra, **options)])


def with_fold(df: DataFrame, key: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """Fold by hash of the key: the same in every run."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds)).cast("int"))


def scores(predicted: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """r2, mae, rmse, mape and n, in one aggregation."""
    y, p = F.col(target), F.col("prediction")
    out = predicted.groupBy(*keys).agg(F.sum((y - p) * (y - p)).alias("_e"), F.var_pop(y).alias("_v"), F.count("*").alias("n"), F.avg(F.abs(y - p)).alias("mae"), F.avg(F.abs((y - p) / F.nullif(y, F.lit(0.0)))).alias("mape"))
    return out.select(*keys, "n", (1 - F.col("_e") / F.nullif(F.col("_v") * F.col("n"), F.lit(0.0))).alias("r2"), "mae", F.sqrt(F.col("_e") / F.col("n")).alias("rmse"), "mape")


def out_of_fold(df: DataFrame, kind: str, features: Sequence[str], target: str, key: str, folds: int = 5, **options) -> DataFrame:
    """Predictions of every row by a model that has not seen its fold."""
    rows, out = settled(with_fold(df, key, folds)), None
    for k in range(folds):
        model = regressor(kind, features, target, **options).fit(rows.where(F.col("fold") != k))
        part = model.transform(rows.where(F.col("fold") == k)).select(key, target, "fold", "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def permutation_importance(model, df: DataFrame, features: Sequence[str], target: str, groups: dict[str, Sequence[str]] | None = None, repeats: int = 5, seed: int = 0, ddof: int = 1) -> DataFrame:
    """name, importance, sd: mean loss of r2 over some shuffles of a feature, or of a group of them together, and its deviation.

    Rows get places in one order by hash; in each repeat the row at place p takes
    its values from place (a * p + b) mod n, with a and n without a common factor,
    so every row gives once. One join brings a row and its donor together for all
    groups of a repeat, and all groups and repeats are scored in one pass; no row
    is sorted or joined again for a feature.
    """
    named = groups or {f: [f] for f in features}
    rows = with_place(df.select(*features, target), [F.xxhash64(F.lit(seed), *features, target), *features, target])
    n = rows.count()
    rng, moves = random.Random(seed), []
    while len(moves) < repeats:
        a, b = rng.randrange(1, max(2, n)), rng.randrange(max(1, n))
        if math.gcd(a, max(1, n)) == 1:
            moves.append(F.struct(F.lit(len(moves)).alias("repeat"), F.lit(a).cast("decimal(38,0)").alias("a"), F.lit(b).alias("b")))
    m = F.explode(F.array(*moves)).alias("m")
    asked = rows.select("*", m).select(*features, target, F.col("m.repeat").alias("repeat"), ((F.col("m.a") * F.col("_place") + F.col("m.b")) % F.lit(max(1, n))).cast("long").alias("_place"))
    both = asked.join(rows.select("_place", F.struct(*features).alias("_d")), "_place")
    one = lambda name, own: F.struct(F.lit(name).alias("name"), *[F.col(f"_d.{f}" if f in own else f).alias(f) for f in features])
    mixed = both.select(target, "repeat", F.explode(F.array(*[one(g, set(c)) for g, c in named.items()])).alias("r")).select(target, "repeat", "r.*")
    base = scores(model.transform(rows), target).select(F.col("r2").alias("_base"))  # one row
    lost = scores(model.transform(mixed), target, ["name", "repeat"]).join(F.broadcast(base)).withColumn("_l", F.col("_base") - F.col("r2"))
    return lost.groupBy("name").agg(F.avg("_l").alias("importance"), (F.stddev_samp("_l") if ddof else F.stddev_pop("_l")).alias("sd")).orderBy(F.desc("importance"), "name")


def fold_summary(predicted: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Means and deviations of the folds' scores."""
    by = scores(predicted, target, [*keys, "fold"])
    return by.groupBy(*keys).agg(F.count("*").alias("folds"), *[f(c).alias(f"{c}_{name}") for c in ("r2", "mae", "rmse") for name, f in (("mean", F.avg), ("std", F.stddev_samp))])


def drop_column_importance(df: DataFrame, kind: str, features: Sequence[str], target: str, key: str, **options) -> list[tuple[str, float]]:
    """Loss of out-of-fold r2 without each feature."""
    full = scores(out_of_fold(df, kind, features, target, key, **options), target).first()["r2"]
    return [(f, full - scores(out_of_fold(df, kind, [x for x in features if x != f], target, key, **options), target).first()["r2"]) for f in features]


def clusters(df: DataFrame, features: Sequence[str], k: int, seed: int = 0) -> tuple[DataFrame, float, float]:
    """df with a cluster, the inertia and the silhouette of k-means on standardised features."""
    made = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_features", withMean=True), KMeans(featuresCol="_features", predictionCol="cluster", k=k, seed=seed)]).fit(df)
    got = made.transform(df)
    return got.drop("_raw", "_features"), made.stages[-1].summary.trainingCost, ClusteringEvaluator(featuresCol="_features", predictionCol="cluster").evaluate(got)


def bootstrap_mean(df: DataFrame, keys: Sequence[str], value: str, draws: int = 200, seed: int = 0) -> DataFrame:
    """By group the 2.5 and 97.5 percentiles of resampled means.

    Values are counted first, and a value that c rows have takes part in a draw
    with a weight from Poisson's distribution of mean c, as c weights of mean 1
    add up to. Weights follow from seed, group and value. A task adds its draws up
    as one row of arrays per group, and these are what is shuffled and added.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.lit(""), *keys, "_v"))
    head = "".join(f"`{c}` {t}, " for c, t in rows.dtypes if c in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *key, v, c, h in b[[*keys, "_v", "_c", "_h"]].itertuples(index=False, name=None):
                w = np.random.default_rng(h & (1 << 64) - 1).poisson(c, draws)
                key = tuple(None if pd.isna(k) else k for k in key)
                sums[key] = sums.get(key, 0.0) + np.stack((w * v, w))
            if len(sums) > 10_000:
                yield pd.DataFrame([(*k, list(x[0]), list(x[1])) for k, x in sums.items()], columns=[*keys, "_s", "_w"])
                sums = {}
        yield pd.DataFrame([(*k, list(x[0]), list(x[1])) for k, x in sums.items()], columns=[*keys, "_s", "_w"])

    parts = rows.mapInPandas(run, f"{head}_s array<double>, _w array<double>")
    each = lambda c: F.array(*[F.sum(F.col(c)[k]) for k in range(draws)])
    got = parts.groupBy(*keys).agg(each("_s").alias("_s"), each("_w").alias("_w"))
    means = F.array_sort(F.filter(F.zip_with("_s", "_w", lambda s, w: s / F.nullif(w, F.lit(0.0))), lambda x: x.isNotNull()))
    at = lambda q: (F.size("_m") - 1) * F.lit(q)
    near = lambda q: F.col("_m")[F.floor(at(q)).cast("int")] + (at(q) - F.floor(at(q))) * (F.col("_m")[F.ceil(at(q)).cast("int")] - F.col("_m")[F.floor(at(q)).cast("int")])
    return got.withColumn("_m", means).select(*keys, near(0.025).alias("low"), near(0.975).alias("high"))


def split_scores(df: DataFrame, kind: str, features: Sequence[str], target: str, key: str, test: float = 0.2, **options) -> DataFrame:
    """Scores on rows held out by a hash of the key, of a model fitted on the others."""
    rows = df.withColumn("_u", F.pmod(F.xxhash64(F.lit("split"), F.col(key)), F.lit(1_000_000)) / 1_000_000)
    model = regressor(kind, features, target, **options).fit(rows.where(F.col("_u") >= test))
    return scores(model.transform(rows.where(F.col("_u") < test)), target)


def random_search(df: DataFrame, kind: str, features: Sequence[str], target: str, key: str, space: dict[str, Sequence], draws: int = 40, folds: int = 3, seed: int = 0) -> DataFrame:
    """Out-of-fold scores of settings drawn from a space, each once, with their ranks by r2."""
    every = [dict(zip(space, v, strict=True)) for v in itertools.product(*space.values())]
    drawn = random.Random(seed).sample(every, min(draws, len(every)))
    rows = [(str(s), *scores(out_of_fold(df, kind, features, target, key, folds, **s), target).select("r2", "mae", "rmse").first()) for s in drawn]
    return df.sparkSession.createDataFrame(rows, "settings string, r2 double, mae double, rmse double").withColumn("rank", F.rank().over(Window.orderBy(F.desc("r2"))))  # a row per draw


def solo_scores(df: DataFrame, kind: str, features: Sequence[str], target: str, key: str, **options) -> list[tuple[str, float]]:
    """Out-of-fold r2 of each feature alone."""
    return [(f, scores(out_of_fold(df, kind, [f], target, key, **options), target).first()["r2"]) for f in features]


def gain_by_class(df: DataFrame, kind: str, features: Sequence[str], extra: Sequence[str], target: str, key: str, klass: str, folds: int = 3, **options) -> DataFrame:
    """By class the out-of-fold r2 without and with some more features, of one model each for all classes."""
    out = None
    for name, columns in (("r2_without", features), ("r2_with", [*features, *extra])):
        got = out_of_fold(df, kind, columns, target, key, folds, **options).join(df.select(key, klass), key)
        one = scores(got, target, [klass]).select(klass, F.col("r2").alias(name))
        out = one if out is None else out.join(one, klass)
    return out.withColumn("gain", F.col("r2_with") - F.col("r2_without"))


def compare_errors(a: DataFrame, b: DataFrame, key: str, target: str) -> DataFrame:
    """Row by row which of two models' predictions is nearer, and by how much."""
    both = a.select(key, target, F.abs(F.col("prediction") - F.col(target)).alias("error_a")).join(b.select(key, F.abs(F.col("prediction") - F.col(target)).alias("error_b")), key)
    return both.withColumn("gain", F.col("error_a") - F.col("error_b")).withColumn("winner", F.when(F.col("gain") > 0, "b").when(F.col("gain") < 0, "a").otherwise("tie"))


def cluster_sweep(df: DataFrame, features: Sequence[str], ks: Sequence[int] = tuple(range(2, 13)), seed: int = 0) -> DataFrame:
    """k, inertia, silhouette, ratio (Calinski and Harabasz's) and davies_bouldin of k-means for each k, on standardised features.

    The models are fitted one after the other; then two passes over the rows score
    all k: the first adds up, by k and cluster, rows, features, squares and
    distances; with these sums the second has each row's silhouette on squared
    distances. A row per k and cluster leaves a task.
    """
    spread = StandardScaler(inputCol="_raw", outputCol="_features", withMean=True)
    ready = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_raw"), spread]).fit(df).transform(df).select("_features").persist()
    try:
        centres = [np.array(KMeans(featuresCol="_features", predictionCol="cluster", k=k, seed=seed).fit(ready).clusterCenters()) for k in ks]
        out = cluster_scores(ready.select(vector_to_array("_features").alias("x")), centres)
    finally:
        ready.unpersist()
    return df.sparkSession.createDataFrame([(int(k), *row) for k, row in zip(ks, out, strict=True)], "k int, inertia double, silhouette double, ratio double, davies_bouldin double")


def cluster_scores(rows: DataFrame, centres: Sequence[np.ndarray]) -> list[tuple]:
    """Inertia, silhouette, ratio and Davies and Bouldin's index for each set of centres. rows: x, an array."""

    def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = ((x[:, None] - c[None]) ** 2).sum(-1)
        own = far.argmin(1)
        return own, far[np.arange(len(x)), own]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            x = np.stack(b["x"].to_list()) if len(b) else np.zeros((0, centres[0].shape[1]))
            for k, c in enumerate(centres):
                own, far = nearest(x, c)
                for j in np.unique(own):
                    at = own == j
                    add = np.concatenate(([at.sum(), (x[at] ** 2).sum(), far[at].sum(), np.sqrt(far[at]).sum()], x[at].sum(0)))
                    got[k, int(j)] = got.get((k, int(j)), 0.0) + add
        yield pd.DataFrame([(k, j, list(v)) for (k, j), v in got.items()], columns=["k", "j", "s"])

    width = 4 + centres[0].shape[1]
    stats = rows.mapInPandas(sums, "k int, j int, s array<double>").groupBy("k", "j").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s")).collect()
    known = [np.zeros((len(c), width)) for c in centres]
    for r in stats:
        known[r["k"]][r["j"]] = r["s"]

    def silhouettes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(centres))
        for b in batches:
            x = np.stack(b["x"].to_list()) if len(b) else np.zeros((0, width - 4))
            for k, c in enumerate(centres):
                n, square, mean = known[k][:, 0], known[k][:, 1], known[k][:, 4:]
                own, _ = nearest(x, c)
                # sum over a cluster of |x - y|^2, from its sums
                all_ = n * (x**2).sum(1)[:, None] + square - 2 * x @ mean.T
                with np.errstate(divide="ignore", invalid="ignore"):
                    inside = all_[np.arange(len(x)), own] / (n[own] - 1)
                    outside = np.where(n > 0, all_ / n, np.inf)
                outside[np.arange(len(x)), own] = np.inf
                outside = outside.min(1, initial=np.inf)
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = (outside - inside) / np.maximum(outside, inside)
                total[k] += np.where((n[own] > 1) & np.isfinite(outside), np.nan_to_num(s), 0.0).sum()
        yield pd.DataFrame({"k": range(len(centres)), "s": total})

    score = {r["k"]: r["s"] for r in rows.mapInPandas(silhouettes, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}
    out = []
    for k in range(len(centres)):
        full = known[k][known[k][:, 0] > 0]
        n, inertia, means = full[:, 0], float(full[:, 2].sum()), full[:, 4:] / full[:, :1]
        rows_, groups = n.sum(), len(full)
        overall = full[:, 4:].sum(0) / max(rows_, 1)
        between = float((n * ((means - overall) ** 2).sum(1)).sum())
        gap = np.sqrt(((means[:, None] - means[None]) ** 2).sum(-1))
        scatter = full[:, 3] / n
        np.fill_diagonal(gap, np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            worst = ((scatter[:, None] + scatter[None]) / gap).max(1, initial=0.0)
        ratio = float(between / (groups - 1) / (inertia / (rows_ - groups))) if groups > 1 and rows_ > groups and inertia else None
        out.append((inertia, float(score.get(k, 0.0) / rows_) if rows_ else None, ratio, float(worst.mean()) if groups > 1 else None))
    return out


def prepared(df: DataFrame, target: str, drop: Sequence[str] = (), group: str | None = None, order: str | None = None, positive: bool = False) -> DataFrame:
    """Rows ready for a model: without NULLs, of positive targets only if asked, without some columns, and with the number of their group by first appearance."""
    from ..operators.windows import group_number

    out = df.drop(*drop)
    out = out.where(" and ".join(f"`{c}` is not null" for c in out.columns))
    out = out.where(F.col(target) > 0) if positive else out
    return group_number(out, [group], order) if group and order else out


def save(model, path: str) -> None:
    """A fitted pipeline, written over an earlier one."""
    model.write().overwrite().save(path)


def group_ranks(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Rank table of candidate settings."""
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(by))))
