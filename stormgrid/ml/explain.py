"""Shares of tree ensembles' predictions by feature: Shapley values along the trees' paths."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import shared_folder

#: Nodes that are broadcast at once; a larger ensemble passes over the rows in several steps.
PIECE = 50_000
#: Rows by path features that one step takes.
BLOCK = 1 << 20


@dataclass
class Tree:
    """One tree's inner nodes, and of each leaf its weighted value, the steps to it (node, went left), its features, and for each feature the share of training rows that its steps keep."""

    feature: np.ndarray
    threshold: np.ndarray
    chosen: list[frozenset | None]
    leaves: list[tuple[float, list[tuple[int, bool]], list[int], np.ndarray]]

    def goes_left(self, x: np.ndarray) -> np.ndarray:
        """Rows by inner nodes."""
        out = x[:, self.feature] <= self.threshold
        for k, some in enumerate(self.chosen):
            if some is not None:
                out[:, k] = np.isin(x[:, self.feature[k]], list(some))
        return out


def trees(model) -> list[Tree]:
    """The trees of a fitted Spark ML tree, forest or boosted ensemble, with the weights that its prediction gives them. Read from the model's own saved form, which the driver holds anyway."""
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data")
    if "nodeData" in rows.columns:
        weights = list(model.treeWeights)
        if hasattr(model, "_call_java") and type(model).__name__.startswith("RandomForest"):
            weights = [w / sum(weights) for w in weights]
        rows = rows.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        weights, rows = [1.0], rows.select(F.lit(0).alias("tree"), "*")
    cover = F.col("impurityStats")[0]
    got = rows.select("tree", "id", "prediction", cover.alias("cover"), "leftChild", "rightChild", "split.featureIndex", "split.leftCategoriesOrThreshold", "split.numCategories").collect()
    by: dict[int, dict] = {}
    for r in got:
        by.setdefault(r["tree"], {})[r["id"]] = r
    return [_tree(nodes, weights[t]) for t, nodes in sorted(by.items())]


def _tree(nodes: Mapping[int, object], weight: float) -> Tree:
    inner = [i for i in sorted(nodes) if nodes[i]["leftChild"] >= 0]
    number = {i: k for k, i in enumerate(inner)}
    split = lambda i: list(nodes[i]["leftCategoriesOrThreshold"])
    is_set = lambda i: nodes[i]["numCategories"] >= 0
    out = Tree(np.array([nodes[i]["featureIndex"] for i in inner], int), np.array([np.nan if is_set(i) else split(i)[0] for i in inner], float), [frozenset(split(i)) if is_set(i) else None for i in inner], [])
    waiting: list[tuple[int, list, dict]] = [(0, [], {})]
    while waiting:
        i, steps, kept = waiting.pop()
        n = nodes[i]
        if n["leftChild"] < 0:
            out.leaves.append((weight * n["prediction"], steps, list(kept), np.array(list(kept.values()), float)))
            continue
        for child, left in ((n["leftChild"], True), (n["rightChild"], False)):
            f = n["featureIndex"]
            waiting.append((child, [*steps, (number[i], left)], {**kept, f: kept.get(f, 1.0) * nodes[child]["cover"] / n["cover"]}))
    return out


def base_value(ensemble: Sequence[Tree]) -> float:
    """The mean prediction over the training rows, as the trees' covers have it."""
    return float(sum(value * share.prod() for t in ensemble for value, _, _, share in t.leaves))


def shares(ensemble: Sequence[Tree], x: np.ndarray) -> np.ndarray:
    """Shapley values, rows by features.

    To a leaf with value v, a set S of known features leads with the weight
    v * prod(o_f, f in S) * prod(z_f, f not in S): o_f says whether the row takes
    all steps on f, z_f is the share of training rows that do. For such a product
    the sum over all orders of the features is the integral over t from 0 to 1 of
    v * (o_i - z_i) * prod(t * o_f + (1 - t) * z_f, f <> i), a polynomial in t, which
    Gauss and Legendre's points give exactly. No factor is 0 at these points.
    """
    out = np.zeros(x.shape)
    for tree in ensemble:
        if not len(tree.feature):
            continue
        left, row = _patterns(tree.goes_left(x))
        made = np.zeros((len(left), x.shape[1]))
        for value, steps, features, share in tree.leaves:
            m = len(features)
            takes = np.ones((len(left), m))
            for node, went_left in steps:
                takes[:, features.index(tree.feature[node])] *= left[:, node] == went_left
            at, weight = np.polynomial.legendre.leggauss((m + 1) // 2)
            t, weight = (at + 1) / 2, weight / 2
            factor = takes[:, :, None] * t + (1 - t) * share[None, :, None]
            others = factor.prod(1)[:, None] / factor
            made[:, features] += value * (takes - share) * (others @ weight)
        out += made[row]
    return out


def _patterns(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a boolean matrix, and the number that each row has among them: a tree tells rows apart by its nodes' answers only."""
    row = np.zeros(len(left), np.int64)
    for k in range(0, left.shape[1], 32):  # each answer so far has a number below the rows' count, and 32 more bits fit beside it
        bits = left[:, k : k + 32] @ (1 << np.arange(min(32, left.shape[1] - k), dtype=np.int64))
        _, first, row = np.unique((row << 32) | bits, return_index=True, return_inverse=True)
    return left[first], row


def with_shares(model, df: DataFrame, features: str, out: str = "shap") -> DataFrame:
    """df without its vector columns, with `out` (a Shapley value per feature) and `<out>_base`; on each row they add up to the model's prediction.

    model: a fitted tree model of Spark ML that reads the vector column `features`.
    The trees are broadcast in pieces of some PIECE nodes, and rows pass over one
    piece after the other where they are read: nothing is shuffled.
    """
    every = trees(model)
    pieces: list[list[Tree]] = [[]]
    size = 0
    for t in every:
        if size and size + len(t.feature) > PIECE:
            pieces.append([])
            size = 0
        pieces[-1].append(t)
        size += len(t.feature)
    rows = df.withColumn("_x", vector_to_array(features))
    rows = rows.select(*[c for c, kind in rows.dtypes if kind != "vector"]).withColumns({out: F.transform("_x", lambda _: F.lit(0.0)), f"{out}_base": F.lit(base_value(every))})
    for piece in pieces:
        rows = rows.mapInArrow(_adder(df.sparkSession.sparkContext.broadcast(piece), rows.columns.index(out), rows.columns.index("_x")), rows.schema)
    return rows.drop("_x")


def _adder(shared, at: int, x_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(x_at).flatten().to_numpy().reshape(b.num_rows, -1)
                got = b.column(at).flatten().to_numpy().reshape(x.shape).copy()
                step = max(1, BLOCK // 64)
                for k in range(0, len(x), step):
                    got[k : k + step] += shares(shared.value, x[k : k + step])
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(got.ravel()))
                yield pa.record_batch([cells.cast(b.schema.field(at).type) if k == at else b.column(k) for k in range(b.num_columns)], schema=b.schema)

    return run


def share_columns(df: DataFrame, names: Sequence[str], groups: Mapping[str, Sequence[str]] | None = None, shap: str = "shap") -> DataFrame:
    """Shapley values as a column per feature, or per group of features, whose values add up."""
    of = {n: F.col(shap)[k] for k, n in enumerate(names)}
    return df.withColumns({g: sum((of[m] for m in members), F.lit(0.0)) for g, members in (groups or {n: [n] for n in names}).items()})


def share_summary(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """By key and column the mean and deviation of absolute values, and the mean value. One aggregation."""
    agg = [x for c in columns for x in (F.avg(F.abs(c)).alias(f"_a_{c}"), F.stddev_samp(F.abs(c)).alias(f"_s_{c}"), F.avg(c).alias(f"_m_{c}"))]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"_a_{c}").alias("mean_abs"), F.col(f"_s_{c}").alias("sd_abs"), F.col(f"_m_{c}").alias("mean")) for c in columns])).alias("r")
    return df.groupBy(*keys).agg(*agg).select(*keys, each).select(*keys, "r.*")
