"""NULLs, ties, empty tables and errors that the driver's tables do not hold."""

import random

import pytest
from pyspark.sql import functions as F

from stormgrid.functions import calendar360, storm, text
from stormgrid.ml import models
from stormgrid.operators import aggregates, fields, grids, inference, joins, reshape, windows
from stormgrid.sources import scans


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is None, str(x)) for x in r])


def test_left_interval_join_returns_spans_once(spark):
    spans = spark.createDataFrame([(1, 0, 10, None), (1, 20, 30, "b"), (2, 0, 5, None), (2, 0, 5, None)], "k int, a int, b int, label string")
    points = spark.createDataFrame([(1, 3)], "k int, t int")
    got = joins.interval_join(points, spans, ["k"], "t", "a", "b", how="left").groupBy("k", "a").agg(F.count("*").alias("n"), F.count("t").alias("hits"))
    assert rows(got) == [(1, 0, 1, 1), (1, 20, 1, 0), (2, 0, 2, 0)]


def test_demean_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 9.0), ("b", None)], "k string, v double")
    assert rows(windows.demean(df, ["k"], "v").select("k", "within")) == [("a", -1.0), ("a", 1.0), ("b", None), (None, -2.0), (None, 2.0)]


def test_soil_without_porosity_is_unknown(spark):
    df = spark.createDataFrame([(90.0, 0.4, 4.0), (90.0, 0.0, 4.0), (90.0, None, 4.0), (None, 0.4, 4.0)], "m double, e double, k double")
    got = [tuple(r) for r in grids.soil_columns(df, "m", "e", "k").select("saturation", "fumax", "deficit", "fu").collect()]
    assert got[0][0] == pytest.approx(1.0) and got[0][2] == pytest.approx(0.0)
    assert got[1] == got[2] == (None, None, None, None) and got[3][0] is None and got[3][1] is not None and got[3][2] is None
    old = grids.soil_columns(df, "m", "e", "k", depth=None, per_second=True).first()
    assert old["saturation"] == pytest.approx(0.09 / 0.4) and old["lu"] == pytest.approx(4 * (25.4 * 3.6) ** 0.5 * 2)


def test_second_regressor_with_nothing_known(spark):
    df = spark.createDataFrame([("a", float(k), 1.0, float(k)) for k in range(30)], "g string, y double, a double, b double")
    assert aggregates.two_regressor_r2(df, ["g"], "y", "a", "b").first()["r2_added"] is None


def test_modality_of_trimmed_series(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 12.0, 0.5, 0.5, 0.5, 13.0, 0.0]), (3, [5.0, 1.0])], "k int, s array<double>")
    got = {r["k"]: (r["n_peaks"], r["modality"]) for r in storm.with_metrics(df, "s").collect()}
    assert got == {1: (0, "no clear peak"), 2: (2, "bimodal"), 3: (1, "unimodal")}


def test_cluster_that_still_grows_raises(spark):
    cells = spark.createDataFrame([(1, 0, x, 9.0 - x / 100) for x in range(6)], "event int, y int, x int, value double")
    peaks = grids.peak_cell(cells, ["event"])
    with pytest.raises(RuntimeError):
        grids.peak_cluster(cells, peaks, ["event"], rounds=1)
    assert grids.peak_cluster(cells, peaks, ["event"]).count() == 6


def test_spearman_by_hand(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), rng.randrange(6), rng.randrange(6)) for _ in range(200)] + [("c", 1, 1), ("d", None, 2), (None, 1, 2)]
    got = {r["k"]: (r["rho"], r["n"]) for r in aggregates.spearman(spark.createDataFrame(data, "k string, x int, y int"), ["k"], "x", "y").collect()}
    import pandas as pd

    for k in "ab":
        d = pd.DataFrame([(x, y) for g, x, y in data if g == k]).rank()
        assert got[k] == (pytest.approx(d[0].corr(d[1])), len(d))
    assert got["c"] == (None, 1) and set(got) == set("abc")


def test_series_at_the_peak(spark):
    cells = spark.createDataFrame([(1, 2, 0, 0, 0.0), (1, 0, 0, 0, 5.0), (1, 1, 0, 0, 0.3), (1, 0, 0, 1, 4.0), (2, 0, 0, 0, 0.0)], "event int, t int, y int, x int, value double")
    got = fields.extract_at_cell(cells, grids.peak_cell(cells, ["event"]), ["event"]).collect()
    assert [tuple(r) for r in got] == [(1, [5.0, 0.3, 0.0], 5.3, 5.0, 0, 1, 2)]
    assert rows(fields.step_stats(cells.withColumn("value", F.when(F.col("t") != 2, F.col("value"))), ["event"]).select("event", "t", "max_x")) == [(1, 0, 0), (1, 1, 0), (2, 0, 0)]


def test_grids_that_differ_raise(spark):
    a = spark.range(3).withColumnRenamed("id", "row")
    with pytest.raises(ValueError):
        fields.on_same_grid(a.withColumn("v", F.lit(1)), a.where("row < 2").withColumn("w", F.lit(2)), ["row"])


def test_masks_by_centre_and_by_any_part(spark):
    cells = spark.range(16).select((F.col("id") % 4).cast("double").alias("x"), F.floor(F.col("id") / 4).cast("double").alias("y"))
    ring = [[(0.6, 0.6), (2.4, 0.6), (2.4, 2.4), (0.6, 2.4)]]
    assert rows(fields.mask(cells, ring, "x", "y", 1.0)) == [(float(x), float(y)) for x in (1, 2) for y in (1, 2)]
    assert fields.mask(cells, [[(0.9, 0.9), (1.1, 0.9), (1.1, 1.1)]], "x", "y", 1.0, "full_cell").count() == 1
    with pytest.raises(ValueError):
        fields.mask(cells, ring, "x", "y", 1.0, "other")


def test_area_weights(spark):
    fine = spark.createDataFrame([(1.0, 0.5, 4.0), (0.25, 0.5, 1.0), (0.5, 0.5, None)], "x double, y double, v double")
    got = {(r["iy"], r["ix"]): (r["mean"], r["covered"]) for r in fields.area_weighted(fine, "x", "y", 1.0, 0.0, 0.0, 1.0, "v").collect()}
    assert got[0, 1] == (4.0, 0.5) and got[0, 0] == (pytest.approx((4 * 0.5 + 0.75) / 1.25), 1.25) and got[0, -1] == (1.0, 0.25)


def test_anomaly_beyond_the_last_day(spark):
    clim = spark.createDataFrame([(10, 1.0), (20, 3.0)], "day int, clim double")
    got = fields.anomaly(spark.createDataFrame([(5, 2.0), (15, 2.0), (30, 2.0)], "day int, v double"), clim, [], "day", "v", "clim")
    assert rows(got.select("day", "climatology", "anomaly")) == [(15, 2.0, 0.0), (30, 3.0, -1.0), (5, 1.0, 1.0)]


def test_regression_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=80)
    df = spark.createDataFrame([("g", *map(float, (*r, t))) for r, t in zip(x, y, strict=True)] + [("h", 1.0, 1.0, 1.0, 1.0), ("g", None, 1.0, 1.0, 1.0)], "k string, a double, b double, c double, y double")
    got = {r["term"]: r for r in inference.ols(df, ["k"], "y", ["a", "b", "c"]).collect()}
    m = np.column_stack([np.ones(80), x])
    inverse = np.linalg.inv(m.T @ m)
    beta = inverse @ m.T @ y
    e = (y - m @ beta) / (1 - np.einsum("ij,jk,ik->i", m, inverse, m))
    se = np.sqrt(np.diag(inverse @ (m.T * e**2) @ m @ inverse))
    assert [got[t]["estimate"] for t in ("intercept", "a", "b", "c")] == pytest.approx(list(beta)) and [got[t]["se"] for t in ("intercept", "a", "b", "c")] == pytest.approx(list(se))
    assert {r["n"] for r in got.values()} == {80}
    fit = inference.median_regression(df.where("k = 'g'"), "y", ["a", "b", "c"])
    off = np.abs(y - m @ [fit.coefficients[t] for t in ("intercept", "a", "b", "c")]).sum()
    assert off == pytest.approx(fit.objective) and abs(fit.gap) < 1e-6
    assert all(off <= np.abs(y - m @ (beta + rng.normal(size=4) * s)).sum() + 1e-6 for s in (0.0, 0.05, 0.2, 0.5) for _ in range(50))


def test_greedy_matching_equals_going_row_by_row(spark):
    rng = random.Random(4)
    late = [(k, rng.choice("ab"), rng.random() * 5) for k in range(60)]
    early = [(100 + k, rng.choice("ab"), rng.random() * 5) for k in range(50)]
    want, free = {}, dict((k, (b, v)) for k, b, v in early)
    for k, b, v in late:
        near = sorted((abs(w - v), e) for e, (c, w) in free.items() if c == b and abs(w - v) <= 0.5)
        if near:
            want[k] = near[0][1]
            del free[near[0][1]]
    as_table = lambda x: spark.createDataFrame(x, "id int, block string, v double")
    got = inference.greedy_matches(as_table(late), as_table(early), ["block"], ["v"], "id", "id", 0.5)
    assert {r["late"]: r["early"] for r in got.collect()} == want


def test_greedy_matching_in_stretches_equals_going_row_by_row(spark):
    rng = random.Random(5)
    for features in (["v"], ["v", "w"]):  # values in steps, so that many distances tie, and fewer early rows than late ones
        row = lambda k: (k, rng.choice("ab"), rng.randrange(40) / 8, rng.randrange(4) / 8)  # noqa: E731, B023
        late, early = [row(k) for k in rng.sample(range(150), 90)], [row(k) for k in rng.sample(range(500, 900), 70)]
        want, free = {}, {e[0]: e for e in early}
        for k, block, *x in sorted(late):
            near = sorted((sum((p - q) ** 2 for p, q in list(zip(x, at, strict=True))[: len(features)]) ** 0.5, e) for e, b, *at in free.values() if b == block)
            if near and near[0][0] <= 1.5:
                want[k] = near[0][1]
                del free[near[0][1]]
        as_table = lambda x: spark.createDataFrame(x, "id int, block string, v double, w double")
        got = inference.greedy_matches(as_table(late + [(-1, "a", None, 1.0), (-2, None, 1.0, 1.0), (-3, "a", float("nan"), 1.0)]), as_table(early), ["block"], features, "id", "id", 1.5, most=6)
        assert {r["late"]: r["early"] for r in got.collect()} == want


def test_greedy_matching_of_many_equal_rows_takes_few_rounds(spark, monkeypatch):
    written = []
    settle = inference.settled
    monkeypatch.setattr(inference, "settled", lambda df: written.append(1) or settle(df))
    n = spark.range(400).select(F.col("id"), F.lit(1).alias("block"), F.lit(2.0).alias("v"))
    got = inference.greedy_matches(n.where("id % 2 = 1"), n.where("id % 2 = 0"), ["block"], ["v"], "id", "id")
    assert sorted((r["late"], r["early"]) for r in got.collect()) == [(k + 1, k) for k in range(0, 400, 2)] and len(written) < 10


def test_nearest_in_narrowing_cells_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    row = lambda k: (k, rng.choice("ab"), rng.randrange(64) / 16 if k % 2 else rng.random() * 4, rng.randrange(64) / 16 if k % 3 else rng.random() * 40)
    late, early = [row(k) for k in range(200)], [row(k) for k in range(1000, 1900)]
    late, early = late + [(k + 500, *r) for k, *r in late[:20]], early + [(k - 600, *r) for k, *r in early[:300]]
    want = {}
    for k, b, x, y in late:
        near = sorted((((x - p) * (x - p) + (y - q) * (y - q)) ** 0.5, e) for e, c, p, q in early if b == c)
        if near[0][0] <= 1.0:
            want[k] = near[0][::-1]
    as_table = lambda r: spark.createDataFrame(r, "id int, block string, x double, y double")
    met = []
    floor = F.floor
    monkeypatch.setattr(F, "floor", lambda c: met.append(1) or floor(c))
    got = joins.nearest_within_blocks(as_table(late + [(-1, "a", None, 1.0)]), as_table(early + [(-2, "b", 1.0, None)]), ["block"], ["x", "y"], "id", 1.0)
    assert {r["id"]: (r["match"], r["distance"]) for r in got.collect()} == want and len(want) > 150
    assert len(met) > 10  # more than one width of cells


def test_dense_grid_sorts_no_cells(spark):
    df = spark.createDataFrame([(0, 0, 1.0, "a"), (2, 3, 2.0, "b"), (2, 3, 3.0, "c"), (4, 6, None, "d"), (5, 0, 9.0, "out"), (0, -1, 9.0, "out"), (None, 1, 9.0, "out")], "iy int, ix int, v double, s string")
    want = [(y, x, None if (y, x) == (9, 9) else 0.0, None) for y in range(5) for x in range(7) if (y, x) not in ((0, 0), (2, 3), (4, 6))] + [(0, 0, 1.0, "a"), (2, 3, 2.0, "b"), (2, 3, 3.0, "c"), (4, 6, 0.0, "d")]
    for block in (1, 4, 35, 1 << 16):
        assert sorted(map(tuple, grids.dense(df, 7, 5, {"v": 0}, block).collect()), key=str) == sorted(want, key=str)
    large = grids.dense(df.drop("s"), 40_000, 40_000).where("v > 1")  # 1,600 million cells; none of them shuffled
    assert sorted(map(tuple, large.collect())) == [(2, 3, 2.0), (2, 3, 3.0), (5, 0, 9.0)]


def test_event_files_in_parts_are_numbered_through(spark, tmp_path):
    names = "start_indices,stop_indices,peaks,start_year,start_month,start_day,start_hour,event_durations,event_num"
    for part, starts in (("part-00000", [5, 3]), ("part-00001", []), ("part-00002", [9, 1, 7])):
        for file in ("a_01", "b_02"):
            (tmp_path / f"file={file}").mkdir(exist_ok=True)
            (tmp_path / f"file={file}" / f"{part}.csv").write_text("\n".join([names, *[f"{s},{s},1.5,2000,1,1,0,24,99" for s in starts]]) + "\n")
    got = scans.event_files(spark, str(tmp_path), r"file=([^/]+)_(\d{2})/[^/]*\.csv$", parts=True)
    assert sorted((r["catchment_num"], r["event_num"], r["start_indices"]) for r in got.collect()) == [(c, k + 1, s) for c in "ab" for k, s in enumerate([5, 3, 9, 1, 7])]


def test_event_files_are_written_by_more_than_one_task(spark, tmp_path, monkeypatch):
    from stormgrid.plans import fields as plan

    monkeypatch.setattr(plan, "_folder", lambda spark: str(tmp_path / "out"))
    spark.range(20_000).selectExpr("id as o_orderkey", "id as o_custkey", "'O' as o_orderstatus").write.parquet(str(tmp_path / "orders.parquet"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["start"]: r["event_num"] for r in plan.event_files_numbered(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == {k: n + 1 for n, k in enumerate(sorted(range(20_000), key=lambda k: (k % 7, k)))}
    assert len(list((tmp_path / "out" / "file=statusO_01").glob("*.csv"))) > 1


def test_rank_correlations_of_several_columns_with_one(spark, monkeypatch):
    rng = random.Random(7)
    some = lambda v: None if rng.random() < 0.2 else v
    made = [(rng.choice(["a", "b", None]), some(float(rng.randrange(8))), some(rng.random()), None, some(float(rng.randrange(30)))) for _ in range(400)]
    made += [("c", 1.0, 2.0, None, 3.0), ("d", 1.0, None, None, None)]
    df = spark.createDataFrame(made, "g string, p double, q double, none double, y double")
    monkeypatch.setattr(aggregates, "settled", None)  # y is not ranked anew for each column
    each = {(r["g"], r["k"]): (r["rho"], r["n"]) for r in aggregates.spearman_each(df, ["g"], ["p", "q", "none"], "y").collect()}
    monkeypatch.undo()
    want = {(r["g"], k): (r["rho"], r["n"]) for k, c in enumerate(("p", "q", "none")) for r in aggregates.spearman(df, ["g"], c, "y").collect()}
    assert set(each) == set(want) == {(g, k) for g in "abc" for k in (0, 1)}
    for at, (rho, n) in want.items():
        assert each[at] == (rho if rho is None else pytest.approx(rho), n)
    assert aggregates.spearman_each(df.where("g = 'a'"), [], ["p"], "y").first()["rho"] == pytest.approx(want["a", 0][0])


def test_columns_grouped_by_correlation(spark):
    matrix = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", -0.85), ("a", "d", 0.0), ("b", "d", 0.0), ("c", "d", None)], "a string, b string, rho double")
    assert inference.correlated_groups(matrix, 0.8) == [["a", "b", "c"], ["d"]]
    assert inference.correlated_groups(matrix, 0.8, "average") == [["a", "b"], ["c"], ["d"]]
    assert inference.group_names(matrix, [["a", "b", "c"], ["d"]]) == {"b": ["a", "b", "c"], "d": ["d"]}
    assert list(inference.group_names(matrix, [["a", "b", "c"]], ["c"])) == ["c"]


def test_bootstrap_holds_the_estimate(spark):
    df = spark.range(4000).select((F.col("id") % 10 + 2000).cast("int").alias("year"), ((F.col("id") * 7919) % 100 + F.when(F.col("id") % 10 >= 5, 20).otherwise(0)).cast("double").alias("v"))
    r = inference.block_bootstrap(df, [], "year", "v", (2000, 2004), (2005, 2009), 60).first()
    assert r["low"] <= r["difference"] <= r["high"] and r["difference"] == pytest.approx(20, abs=5)
    low, high = models.bootstrap_mean(df.withColumn("k", F.lit(1)), ["k"], "v", 60).select("low", "high").first()
    assert low < df.agg(F.avg("v")).first()[0] < high and high - low < 5


def test_models_learn_what_is_there(spark):
    df = spark.range(600).select(F.col("id").alias("key"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("k")).withColumn("t", 3 * F.col("a") + F.col("b"))
    assert models.split_scores(df, "linear", ["a", "b"], "t", "key").first()["r2"] > 0.999
    gains = models.gain_by_class(df, "linear", ["b"], ["a"], "t", "key", "k", 2)
    assert all(r["gain"] > 0.7 for r in gains.collect())
    best = models.random_search(df, "forest", ["a", "b"], "t", "key", {"maxDepth": [1, 5], "numTrees": [4]}, 5, 2).orderBy("rank").first()
    assert "5" in best["settings"] and best["r2"] > 0.8
    a = df.select("key", "t", (F.col("t") + 1).alias("prediction"))
    assert rows(models.compare_errors(a, a.withColumn("prediction", F.col("t")), "key", "t").groupBy("winner").count()) == [("b", 600)]
    fine = models.permutation_importance(models.regressor("linear", ["a", "b"], "t").fit(df), df.select("a", "b", "t"), ["a", "b"], "t").collect()
    assert [r["feature"] if "feature" in r else r["name"] for r in fine] == ["a", "b"]


def test_reshaping(spark):
    df = spark.createDataFrame([("p", 1.0, 2.0), ("q", 3.0, None)], "k string, a double, b double")
    assert rows(reshape.transpose(df, "k", ["a", "b"], ["q", "p"])) == [("a", 3.0, 1.0), ("b", None, 2.0)]
    assert reshape.renamed(df, {"a": "z"}, "_s", but=["k"], without=["b", "none"]).columns == ["k", "z"]


def test_codes(spark):
    got = spark.createDataFrame([("1999023005", 7)], "t string, n int").select(*text.hour_code(F.col("t")).values(), text.padded(F.col("n")), text.unpadded(F.lit("007")), text.number(F.lit("x1")), text.half_even(F.lit(0.125), 2)).first()
    assert tuple(got) == (1999, 2, 30, 5, "07", "7", None, 0.12)
    got = spark.range(1).select(calendar360.from_timestamp(F.lit("2001-03-31 04:00:00").cast("timestamp")).alias("h"), calendar360.hydro_index(calendar360.hour360(F.lit(2001), F.lit(1), F.lit(1), F.lit(0)), F.lit(2001)).alias("i")).first()
    assert got["h"] == ((2001 * 12 + 2) * 30 + 29) * 24 + 4 and got["i"] == 30 * 24


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "north_01_full_events.csv").write_text(",".join(scans.EVENT_SCHEMA.fieldNames() if hasattr(scans.EVENT_SCHEMA, "fieldNames") else [c.split()[0] for c in scans.EVENT_SCHEMA.split(",")]) + "\n")
    cells = spark.createDataFrame([(2000 * 8640 + 5, 0, 0, 1.0), (2001 * 8640, 0, 1, -9999.0)], "hour360 long, y int, x int, value double").withColumn("ens", F.lit("01"))
    scans.write_field(cells, str(tmp_path / "field"), ["ens"], {"value": {"units": "mm"}})
    back = scans.grid_cells(spark, str(tmp_path / "field" / "data"), "01")
    assert rows(scans.years_of(back, 2001).select("x", "value")) == [(1, None)] and back.count() == 2
    assert spark.read.parquet(str(tmp_path / "field" / "about")).first()["text"] == "mm"
    assert scans.one_field(cells, ("hour360", "y", "x")) == "value"
    with pytest.raises(ValueError):
        scans.one_field(cells.withColumn("w", F.lit(1.0)))
    flood = spark.createDataFrame([(1, 10, "area", 1.0), (1, 10, "area", 2.0), (2, 10, "area", 3.0)], "event_num int, depth int, variable string, value double")
    flood.write.parquet(str(tmp_path / "flood"))
    with pytest.raises(ValueError):
        scans.flood_cells(spark, str(tmp_path / "flood"), 10, "area")
    (tmp_path / "shapes.json").write_text('{"properties":{"name":"a"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4]]]}}\n')
    points = spark.createDataFrame([(1.0, 1.0), (9.0, 9.0)], "x double, y double")
    assert rows(joins.points_in_polygons(points, scans.polygons(spark, str(tmp_path / "shapes.json")), "x", "y")) == [(1.0, 1.0, "a"), (9.0, 9.0, None)]
    scans.write_csv(points, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "k string, t long, y int, x int, v double")
    assert fields.step_stats(none, ["k"], "v").count() == 0
    assert inference.ols(none, ["k"], "v", ["t"]).count() == 0
    assert inference.tails(none, "v").count() == 0 and inference.halves(none, "v").count() == 0
    assert windows.stride(none, ["t"], 3).count() == 0 and windows.sample_rows(none, "t", 3, by=["k"]).count() == 0
    assert joins.overlapping(none.withColumn("u", F.col("t")), none.select("k", F.col("t").alias("a"), F.col("t").alias("b")), ["k"], ("t", "u"), ("a", "b")).count() == 0
