"""Trees' shares, exact masks, components, spread windows, resampling and regression against definitions."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from stormgrid.ml import explain, models
from stormgrid.operators import fields, grids, inference, joins, windows
from stormgrid.sources import scans

# ---------------------------------------------------------------- trees


def value_of(tree, node_of, known, x):
    """A tree's value where only the features in `known` are, by the definition: unknown ones take both ways by their covers."""
    total = 0.0
    for value, steps, features, share in tree.leaves:
        weight = 1.0
        for f, z in zip(features, share, strict=True):
            if f in known:
                weight *= all((tree.goes_left(x[None])[0, n] == left) for n, left in steps if node_of[n] == f)
            else:
                weight *= z
        total += value * weight
    return total


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted", "categories"])
def test_shares_equal_shapley_values_and_add_up(spark, monkeypatch, kind):
    monkeypatch.setattr(explain, "PIECE", 8)
    rng = random.Random(5)
    rows = [(float(rng.randrange(6)), rng.random(), float(rng.randrange(4)), k) for k in range(300)]
    df = spark.createDataFrame([(*r, r[0] * r[1] * 3 + (r[2] % 2) * 2 + (r[0] > 3) * r[2]) for r in rows], "a double, b double, c double, k int, y double")
    made = VectorAssembler(inputCols=["a", "b", "c"], outputCol="v0" if kind == "categories" else "v").transform(df)
    if kind == "categories":
        made = VectorIndexer(inputCol="v0", outputCol="v", maxCategories=8).fit(made).transform(made)
    model = {"tree": DecisionTreeRegressor, "forest": RandomForestRegressor, "boosted": GBTRegressor, "categories": RandomForestRegressor}[kind](featuresCol="v", labelCol="y", maxDepth=4, **({} if kind == "tree" else {"seed": 1}), **({"numTrees": 4} if kind in ("forest", "categories") else {"maxIter": 4} if kind == "boosted" else {})).fit(made)
    got = explain.with_shares(model, model.transform(made), "v").collect()
    assert len(got) == 300 and set(got[0].asDict()) == {"a", "b", "c", "k", "y", "prediction", "shap", "shap_base"}
    for r in got:
        assert sum(r["shap"]) + r["shap_base"] == pytest.approx(r["prediction"], abs=1e-9)
    ensemble = explain.trees(model)
    assert len(ensemble) == (1 if kind == "tree" else 4)
    assert any(c is not None for t in ensemble for c in t.chosen) == (kind == "categories")
    for r in got[:40]:
        x = np.array([r["a"], r["b"], r["c"]])
        want = [0.0] * 3
        for order in itertools.permutations(range(3)):
            for k, f in enumerate(order):
                worth = [sum(value_of(t, t.feature, set(order[:m]), x) for t in ensemble) for m in (k, k + 1)]
                want[f] += (worth[1] - worth[0]) / 6
        assert r["shap"] == pytest.approx(want, abs=1e-9)
    both = explain.share_columns(spark.createDataFrame(got), ["a", "b", "c"], {"ab": ["a", "b"], "c": ["c"]})
    s = {r["name"]: r for r in explain.share_summary(both, ["ab", "c"]).collect()}
    ab = [abs(r["shap"][0] + r["shap"][1]) for r in got]
    assert s["ab"]["mean_abs"] == pytest.approx(np.mean(ab)) and s["ab"]["sd_abs"] == pytest.approx(np.std(ab, ddof=1))
    assert explain.with_shares(model, made.limit(0), "v").count() == 0


def test_shares_are_worked_out_once_for_rows_with_the_same_answers(monkeypatch):
    rng = np.random.default_rng(3)
    feature = rng.integers(0, 2, 40)  # a chain of 40 nodes, whose answers take more than one word of bits
    leaves = [(float(k), [(j, True) for j in range(k)] + [(k, False)], sorted({int(f) for f in feature[: k + 1]}), np.array([0.5] * len({int(f) for f in feature[: k + 1]}))) for k in range(40)]
    tree = explain.Tree(feature, rng.integers(0, 9, 40) + 0.5, [None] * 40, leaves)
    x = rng.integers(0, 10, (5000, 2)).astype(float)
    each = np.array([explain.shares([tree], r[None])[0] for r in x[:200]])
    seen = []
    patterns = explain._patterns
    monkeypatch.setattr(explain, "_patterns", lambda left: seen.append(patterns(left)) or seen[-1])
    assert explain.shares([tree], x)[:200] == pytest.approx(each) and explain.shares([tree], x[:0]).shape == (0, 2)
    left, row = seen[0]
    assert len(left) <= 100 and (left[row] == tree.goes_left(x)).all() and len({r.tobytes() for r in left}) == len(left)


def test_importance_over_repeats(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.random(), rng.random(), rng.random()) for _ in range(400)], "a double, b double, c double").withColumn("t", 3 * F.col("a") + F.col("b"))
    model = models.regressor("linear", ["a", "b", "c"], "t").fit(df)
    got = {r["name"]: r for r in models.permutation_importance(model, df, ["a", "b", "c"], "t", repeats=8).collect()}
    assert got["a"]["importance"] == pytest.approx(2 * 9 / 10, abs=0.25) and got["b"]["importance"] == pytest.approx(0.2, abs=0.05) and abs(got["c"]["importance"]) < 1e-6
    assert 0 < got["a"]["sd"] < 0.2 and got["c"]["sd"] < 1e-6
    again = {r["name"]: r for r in models.permutation_importance(model, df, ["a", "b", "c"], "t", repeats=8).collect()}
    assert again["a"]["importance"] == pytest.approx(got["a"]["importance"])
    group = models.permutation_importance(model, df, ["a", "b", "c"], "t", {"ab": ["a", "b"], "c": ["c"]}, repeats=3, ddof=0).collect()
    assert [r["name"] for r in group] == ["ab", "c"] and group[0]["importance"] == pytest.approx(2, abs=0.3)


def test_cluster_scores_equal_definitions(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.6, (25, 2)) for m in (0, 3, 7)])
    centres = [np.array([[0.0, 0.0], [5.0, 5.0]]), np.array([[0.0, 0.0], [3.0, 3.0], [7.0, 7.0], [90.0, 90.0]])]
    got = models.cluster_scores(spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3), centres)
    for c, (inertia, silhouette, ratio, index) in zip(centres, got, strict=True):
        own = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        used = sorted(set(own.tolist()))
        means = {j: x[own == j].mean(0) for j in used}
        assert inertia == pytest.approx(sum(((x[own == j] - c[j]) ** 2).sum() for j in used))
        between = sum((own == j).sum() * ((means[j] - x.mean(0)) ** 2).sum() for j in used)
        assert ratio == pytest.approx(between / (len(used) - 1) / (inertia / (len(x) - len(used))))
        scatter = {j: np.sqrt(((x[own == j] - c[j]) ** 2).sum(-1)).mean() for j in used}
        assert index == pytest.approx(np.mean([max((scatter[i] + scatter[j]) / np.linalg.norm(means[i] - means[j]) for j in used if j != i) for i in used]))
        far = ((x[:, None] - x[None]) ** 2).sum(-1)
        s = []
        for i in range(len(x)):
            inside = far[i, own == own[i]].sum() / ((own == own[i]).sum() - 1)
            outside = min(far[i, own == j].mean() for j in used if j != own[i])
            s.append((outside - inside) / max(outside, inside))
        assert silhouette == pytest.approx(np.mean(s))


# ---------------------------------------------------------------- masks and components


def touches(ring, x, y, h):
    """Exact: does the closed square meet the polygon? By clipping each edge to the square, and the centre's crossings."""
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        low, high = Fraction(0), Fraction(1)
        for d, a, b in ((x2 - x1, x - h - x1, x + h - x1), (y2 - y1, y - h - y1, y + h - y1)):
            if d == 0:
                if a > 0 or b < 0:
                    low, high = Fraction(1), Fraction(0)
            else:
                t, u = sorted((Fraction(a) / d, Fraction(b) / d))
                low, high = max(low, t), min(high, u)
        if low <= high:
            return True
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * Fraction(x2 - x1) / (y2 - y1):
            inside = not inside
    return inside


def test_full_cells_equal_an_exact_test_on_slivers(spark):
    rng = random.Random(3)
    cells = spark.createDataFrame([(float(x), float(y)) for x in range(-1, 12) for y in range(-1, 12)], "x double, y double")
    for n in range(12):
        a, b = [(Fraction(rng.randrange(0, 640), 64), Fraction(rng.randrange(0, 640), 64)) for _ in range(2)]
        ring = [a, b, (b[0] + Fraction(rng.randrange(1, 5), 64), b[1] + Fraction(rng.randrange(1, 5), 64))] if n < 8 else [a, b, (Fraction(rng.randrange(0, 640), 64), Fraction(rng.randrange(0, 640), 64))]
        got = {(r["x"], r["y"]) for r in fields.mask(cells, [[(float(p), float(q)) for p, q in ring]], "x", "y", 1.0, "full_cell").collect()}
        assert got == {(float(x), float(y)) for x in range(-1, 12) for y in range(-1, 12) if touches(ring, Fraction(x), Fraction(y), Fraction(1, 2))}, ring
    hole = [[(-2.0, -2.0), (20.0, -2.0), (20.0, 20.0), (-2.0, 20.0)], [(2.2, 2.2), (7.8, 2.2), (7.8, 7.8), (2.2, 7.8)]]
    got = {(r["x"], r["y"]) for r in fields.mask(cells, hole, "x", "y", 1.0, "full_cell").collect()}
    assert (5.0, 5.0) not in got and (2.0, 5.0) in got and (3.0, 5.0) not in got and (0.0, 0.0) in got
    with pytest.raises(ValueError):
        fields.mask(cells, hole, "x", "y", 1.0, "other")


def test_a_long_chain_is_one_component_within_a_dozen_rounds(spark):
    cells = spark.createDataFrame([("a", 0, x) for x in range(1000)] + [("a", 2, x) for x in range(0, 40, 2)] + [("b", k, k) for k in range(30)], "event string, y int, x int")
    four = grids.connected_cells(cells, ["event"], rounds=12)
    sizes = sorted(r["count"] for r in four.groupBy("event", "label").count().collect())
    assert sizes == [1] * 50 + [1000]
    eight = grids.connected_cells(cells, ["event"], 8, rounds=12)
    assert sorted(r["count"] for r in eight.groupBy("event", "label").count().collect()) == [1] * 20 + [30, 1000]
    with pytest.raises(ValueError):
        grids.connected_cells(cells, ["event"], 6)
    assert grids.connected_cells(cells.limit(0), ["event"]).count() == 0


def test_components_equal_a_flood_fill(spark):
    rng = random.Random(8)
    on = {(y, x) for y in range(25) for x in range(25) if rng.random() < 0.55}
    for connectivity in (4, 8):
        label = {}
        for start in sorted(on):
            if start not in label:
                wave = [start]
                label[start] = start
                while wave:
                    y, x = wave.pop()
                    for dy, dx in itertools.product((-1, 0, 1), repeat=2):
                        to = (y + dy, x + dx)
                        if (connectivity == 8 or not dy * dx) and to in on and to not in label:
                            label[to] = start
                            wave.append(to)
        got = grids.connected_cells(spark.createDataFrame([(1, *c) for c in on], "k int, y int, x int"), ["k"], connectivity).collect()
        assert {(r["y"], r["x"]): tuple(r["label"]) for r in got} == label


# ---------------------------------------------------------------- windows


def test_spread_windows_equal_plain_ones(spark):
    rng = random.Random(6)
    rows = [("hot", k, rng.choice([None, rng.random(), 0.0])) for k in range(700)] + [("small", k, float(k)) for k in range(4)] + [(None, k, 1.0) for k in range(9)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(5)
    tidy = lambda d: sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in d.select(*sorted(d.columns)).collect()), key=repr)
    for most in (7, 50):
        for width, least in ((10, 5), (5, 5)):
            assert tidy(windows.centred_mean(df, ["k"], ["t"], "v", width, least, most=most)) == tidy(windows.centred_mean(df, ["k"], ["t"], "v", width, least))
        assert tidy(windows.rolling_max_sum(df, ["k"], ["t"], "v", [2, 3, 6, 16], most=most)) == tidy(windows.rolling_max_sum(df, ["k"], ["t"], "v", [2, 3, 6, 16]))
        assert tidy(windows.transitions(df, ["k"], ["t"], "v", most=most)) == tidy(windows.transitions(df, ["k"], ["t"], "v"))
    grid = spark.createDataFrame([(1, y, x, rng.random()) for y in range(12) for x in range(15)], "k int, y int, x int, value double")
    assert tidy(grids.slope(grid, ["k"], most=4)) == tidy(grids.slope(grid, ["k"]))
    spread = windows.over_rows(df.where("k = 'hot'"), ["k"], ["t"], 3, 2, {"n": lambda w: F.count("*").over(w.rowsBetween(-3, 2)), "p": lambda w: F.spark_partition_id()}, most=20)
    assert spread.count() == 700 and spread.where("n < 6").count() == 5


# ---------------------------------------------------------------- climatology, medians, files


def test_anomaly_keeps_keys_without_a_climatology(spark):
    values = spark.createDataFrame([("a", 15.0, 5.0), ("a", 20.5, 5.0), ("a", -3.0, 5.0), ("a", 400.0, 5.0), ("b", 15.0, 7.0), (None, 1.0, 1.0), ("a", None, 2.0), ("c", 3.25, 1.0)], "k string, day double, v double")
    clim = spark.createDataFrame([("a", 10.0, 1.0), ("a", 20.0, 3.0), ("a", 30.0, 13.0), (None, 5.0, 4.0), ("c", 3.1, 0.0), ("c", 3.2, 1.0), ("c", 3.3, 3.0)], "k string, day double, c double")
    got = sorted(((r["k"], r["day"], r["climatology"], r["anomaly"]) for r in fields.anomaly(values, clim, ["k"], "day", "v", "c").collect()), key=repr)
    near = [(k, d, None if c is None else round(c, 9), None if a is None else round(a, 9)) for k, d, c, a in got]
    assert sorted(near, key=repr) == sorted([("a", 15.0, 2.0, 3.0), ("a", 20.5, 3.5, 1.5), ("a", -3.0, 1.0, 4.0), ("a", 400.0, 13.0, -8.0), ("b", 15.0, None, None), (None, 1.0, 4.0, -3.0), ("a", None, None, None), ("c", 3.25, 2.0, -1.0)], key=repr)
    assert fields.anomaly(values, clim.limit(0), ["k"], "day", "v", "c").where("climatology is null").count() == 8


@pytest.mark.parametrize("most", [5000, 20])
def test_median_regression_equals_the_best_vertex(spark, most):
    rng = np.random.default_rng(2)
    for n, p in ((60, 1), (40, 2)):
        x, noise = rng.normal(size=(n, p)), rng.standard_t(2, n)
        y = x.sum(1) * 2 + noise
        rows = [(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)]
        df = spark.createDataFrame(rows + rows[:9] * 2 + [(*[1.0] * p, None)], [*"abc"[:p], "y"])
        fit = inference.median_regression(df, "y", list("abc"[:p]), most=most)
        m = np.column_stack([np.ones(n + 18), np.concatenate([x, x[:9], x[:9]])])
        yy = np.concatenate([y, y[:9], y[:9]])
        best = min(np.abs(yy - m @ np.linalg.solve(m[list(c)], yy[list(c)])).sum() for c in itertools.combinations(range(n), p + 1))
        assert fit.objective == pytest.approx(best, rel=1e-9) and abs(fit.gap) <= 1e-6 * best
        assert np.abs(yy - m @ list(fit.coefficients.values())).sum() == pytest.approx(best, rel=1e-9)
    with pytest.raises(ValueError):
        inference.median_regression(df.limit(0), "y", ["a"])


def test_block_bootstrap_equals_drawing_years_one_by_one(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["g", "h", None]), rng.randrange(1999, 2012), float(rng.randrange(12))) for _ in range(900)] + [("only early", 2001, 1.0)]
    df = spark.createDataFrame(rows, "g string, year int, v double")
    got = {r["g"]: r for r in inference.block_bootstrap(df, ["g"], "year", "v", (2000, 2003), (2006, 2011), 40, 3).collect()}
    draw = np.random.default_rng(3)
    weights = {}
    for name, (a, b) in (("early", (2000, 2003)), ("late", (2006, 2011))):
        weights[name] = [dict(zip(range(a, b + 1), draw.multinomial(b - a + 1, [1 / (b - a + 1)] * (b - a + 1)).tolist(), strict=True)) for _ in range(40)]
    for g in ("g", "h", None):
        def median(w, g=g):
            values = [v for k, y, v in rows if k == g for _ in range(w.get(y, 0))]
            return np.median(values)
        gaps = [median(late) - median(early) for early, late in zip(weights["early"], weights["late"], strict=True)]
        assert got[g]["difference"] == pytest.approx(median(dict.fromkeys(range(2006, 2012), 1)) - median(dict.fromkeys(range(2000, 2004), 1)))
        assert (got[g]["low"], got[g]["high"]) == pytest.approx(tuple(np.percentile(gaps, [2.5, 97.5])))
    assert got["only early"]["difference"] is None


def test_effect_with_controls_is_the_regression_s_coefficient(spark):
    rng = np.random.default_rng(4)
    late, c = rng.integers(0, 2, 200), rng.normal(size=200)
    y = 10 + 2 * late + 3 * c + rng.normal(size=200)
    df = spark.createDataFrame([("g", int(a), float(b), float(v)) for a, b, v in zip(late, c, y, strict=True)] + [("g", 1, None, 5.0)], "g string, late int, c double, y double")
    r = inference.effect(df, ["g"], F.col("late") == 1, "y", ["c"]).first()
    beta = np.linalg.lstsq(np.column_stack([np.ones(200), late, c]), y, rcond=None)[0]
    assert r["effect_pct"] == pytest.approx(100 * beta[1] / abs(y[late == 0].mean())) and r["low_pct"] < r["effect_pct"] < r["high_pct"] and (r["n_early"], r["n_late"]) == ((late == 0).sum(), (late == 1).sum())


def test_event_numbers_follow_the_files_that_are_read_in_pieces(spark, tmp_path):
    rng = random.Random(2)
    want = {}
    for name in ("severn_01", "severn_02", "thames_01"):
        starts = [rng.randrange(10_000) for _ in range(500)]
        want[name] = starts
        lines = ["start_indices,stop_indices,peaks,start_year,start_month,start_day,start_hour,event_durations,event_num", *[f"{s},{s + 1},1.5,2000,1,1,0,24,999" for s in starts]]
        (tmp_path / f"{name}_full_events.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = scans.event_files(spark, str(tmp_path))
        assert spark.read.csv(str(tmp_path), header=True).rdd.getNumPartitions() > 6
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    by = {}
    for r in got:
        by.setdefault(f"{r['catchment_num']}_{r['ens']}", {})[r["event_num"]] = r["start_indices"]
    assert {k: [v[n] for n in range(1, 501)] for k, v in by.items()} == want


def test_ranks_of_few_values_join_no_hot_key(spark):
    df = spark.createDataFrame([("g", float(k % 3)) for k in range(300)] + [("h", float(k)) for k in range(2000)], "k string, v double")
    right = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    assert joins.join_weighted(df, right, ["k", "v"], "n").count() == 2300
    assert math.isclose(joins.join_weighted(df, right, ["k", "v"], "n").agg(F.sum("n")).first()[0], 3 * 100 * 100 + 2000)
