"""Registered queries against DuckDB, and operators on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from stormgrid.functions import binning, calendar360, storm
from stormgrid.functions.geometry import within
from stormgrid.operators import aggregates, grids, joins, reshape, windows
from stormgrid.plans import registry

from .compare import differences, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, con, name):
    assert differences(registry.QUERIES[name](spark, SF_DIR), con, registry.ORACLE_SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - {"rf_cv_metrics", "perm_importance"}))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF_DIR).count() > 0


def one(spark, series, column):
    return spark.createDataFrame([(series,)], "s array<double>").select(column(F.col("s")).alias("v")).first()["v"]


def test_storm_shapes(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.05, 1.0, 4.0, 1.0, 0.0]), (2, [5.0]), (3, [0.0, 0.0, 0.0]), (4, None)], "k int, s array<double>")
    got = {r["k"]: r for r in storm.with_metrics(rows, "s").collect()}
    assert (got[1]["length_of_active_rain"], got[1]["total_acc"], got[1]["max_intensity"], got[1]["peak_position_ratio"]) == (3, 6.0, 4.0, 0.5)
    assert (got[1]["before_peak"], got[1]["after_peak"], got[1]["loading_index"], got[1]["max_2h"]) == (1.0, 1.0, 0.0, 5.0)
    assert (got[2]["length_of_active_rain"], got[2]["total_acc"], got[2]["max_quartile_index"]) == (1, 5.0, None)
    assert (got[3]["total_acc"], got[3]["gini"], got[3]["max_intensity"]) == (0.0, 0.0, None)
    assert got[4]["max_intensity"] is None


def test_peaks(spark):
    assert one(spark, [12.0, 3.0, 3.0, 3.0, 15.0], storm.n_peaks) == 2
    assert one(spark, [0.2, 11.0, 11.0, 0.2, 0.2, 13.0], storm.n_peaks) == 2
    assert one(spark, [0.0, 0.0, 0.0], storm.n_peaks) == 0
    assert one(spark, [1.0, 0.0, 1.0, 0.0, 1.0], storm.transition_rate) == 0.8


def test_calendar_has_30_february(spark):
    got = spark.range(1).select(calendar360.hour360(F.lit(2000), F.lit(2), F.lit(30), F.lit(5)).alias("h")).select(*[c.alias(n) for n, c in calendar360.parts(F.col("h")).items()]).first()
    assert tuple(got) == (2000, 2, 30, 5)


def test_bins_and_missing_values(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (-9999.0,), (1e20,), (float("nan"),), (None,)], "v double")
    v = binning.clean(F.col("v"))
    got = rows.select(v.alias("v"), binning.cut(v, [0, 1, 2]).alias("right"), binning.cut(v, [0, 1, 2], right=False).alias("left")).collect()
    assert [tuple(x) for x in got] == [(0.0, None, 0), (1.0, 0, 1), (2.0, 1, None), *[(None, None, None)] * 4]


def test_point_on_an_edge_is_outside(spark):
    rings = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)]]
    pts = spark.createDataFrame([(3.0, 3.0), (1.5, 1.5), (0.0, 2.0), (5.0, 1.0)], "x double, y double")
    assert [r[0] for r in pts.select(within(F.col("x"), F.col("y"), rings)).collect()] == [True, False, False, False]


def test_cluster_connectivity(spark):
    cells = spark.createDataFrame([(1, 0, 0, 10.0), (1, 1, 1, 9.0), (1, 1, 2, 9.0), (1, 3, 3, 9.0)], "event int, y int, x int, value double")
    peaks = grids.peak_cell(cells, ["event"])
    assert grids.peak_cluster(cells, peaks, ["event"]).count() == 1
    assert grids.peak_cluster(cells, peaks, ["event"], connectivity=8).count() == 3


def test_event_without_a_peak(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0.0), (2, 0, 0, 3.0), (2, 0, 1, 3.0)], "event int, y int, x int, value double")
    got = {r["event"]: r for r in grids.peak_cell(cells, ["event"]).collect()}
    assert (got[1]["found"], got[1]["peak_value"], got[1]["n_ties"]) == (False, None, 0)
    assert (got[2]["found"], got[2]["peak_x"], got[2]["n_ties"]) == (True, 0, 2)


def test_ordered_operators_on_one_hot_key(spark):
    rows = spark.range(500).select(F.lit("a").alias("k"), F.col("id").alias("t"), (F.col("id") % 50).alias("v"))
    got = joins.running_total(rows.withColumn("one", F.lit(1)), ["k"], ["t"], "one", "before").where("before <> t").count()
    assert got == 0
    ranks = aggregates.average_rank(rows, ["k"], "v", "rank").select("v", "rank").distinct().collect()
    assert {r["v"]: r["rank"] for r in ranks} == {v: v * 10 + 5.5 for v in range(50)}
    asof = joins.asof_before(rows.select("k", "t"), rows, ["k"], "t", "t", "v").collect()
    assert {r["t"]: r["v_before"] for r in asof} == {t: (t - 1) % 50 if t else None for t in range(500)}
    assert windows.group_number(rows, ["v"], "t").where("group_id <> v").count() == 0


def test_unequal_tables_are_not_bound(spark):
    with pytest.raises(ValueError):
        joins.bind_columns(spark.range(3), spark.range(2).withColumnRenamed("id", "b"), ["id"], ["b"])


def test_total_lookup_raises(spark):
    with pytest.raises(KeyError):
        joins.total_lookup(spark.range(3), spark.range(2), ["id"])


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 1, 5.0, "a"), (1, 0, 4.0, "a"), (2, 0, 1.0, "b")], "k int, o int, v double, label string")
    got = {r["k"]: (r["series"], r["label"]) for r in reshape.repair_exploded(rows, ["k"], "o", "v").collect()}
    assert got == {1: ([4.0, 5.0], "a"), 2: ([1.0], "b")}


def test_p_values(spark):
    rows = spark.createDataFrame([(2.228139, 10), (0.0, 5)], "t double, df int")
    got = [r["p"] for r in aggregates.with_p_value(rows).collect()]
    assert got == pytest.approx([0.05, 1.0], abs=1e-5)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, t long, v double")
    assert aggregates.summary(none, ["k"], "v").count() == 0
    assert windows.group_number(none, ["k"], "t").count() == 0
    assert joins.asof_before(none.select("k", "t"), none, ["k"], "t", "t", "v").count() == 0
