"""Queries over cells in time, coarse and fine grids, and codes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binning, text
from ..functions.geometry import distance, in_box
from ..operators import fields, grids, joins, reshape, windows
from ..sources import scans
from .base import CELLS, PEAKS, cells, query, r, table, tidy

#: Shipped quantity by supplier's nation (y), line number (x) and month (t), and by year as event.
_STEPS = """steps AS (
  SELECT CAST(year(l_shipdate) AS BIGINT) AS event, CAST(month(l_shipdate) AS BIGINT) AS t, l_suppkey % 10 AS y, CAST(l_linenumber AS BIGINT) AS x, sum(l_quantity) AS value FROM lineitem GROUP BY ALL
)"""
_STEP_PEAKS = """peaks AS (
  SELECT event, t AS peak_t, y AS peak_y, x AS peak_x, value AS peak_value FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY value DESC, t, y, x) AS k FROM steps) WHERE k = 1 AND value > 0
)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.year("l_shipdate").cast("long").alias("event"), F.month("l_shipdate").cast("long").alias("t"), (F.col("l_suppkey") % 10).alias("y"), F.col("l_linenumber").cast("long").alias("x")).agg(F.sum("l_quantity").alias("value"))


@query(f"""WITH {_STEPS}, {_STEP_PEAKS}, s AS (SELECT s.*, peak_t FROM steps s JOIN peaks p ON s.event = p.event AND y = peak_y AND x = peak_x)
SELECT event, array_to_string(list(CAST(CAST(value AS BIGINT) AS VARCHAR) ORDER BY t), ',') AS series, sum(value) AS total, max(value) AS max, min(t) FILTER (value > 100) AS first_wet, max(t) FILTER (value > 100) AS last_wet,
  max(t) FILTER (value > 100) - min(t) FILTER (value > 100) + 1 AS wet_duration FROM s GROUP BY event""")
def extract_at_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _steps(spark, sf_dir)
    got = fields.extract_at_cell(c, grids.peak_cell(c, ["event"]), ["event"], wet=100.0)
    return tidy(got.withColumn("series", F.array_join(F.transform("series", lambda v: v.cast("long").cast("string")), ",")))


@query(f"""WITH {_STEPS}, k AS (SELECT *, row_number() OVER (PARTITION BY event, t ORDER BY value DESC, y, x) AS k FROM steps),
s AS (SELECT event, t, avg(value) AS mean, max(value) AS max, sum(value) AS sum, count(*) AS n, max(y) FILTER (k = 1) AS max_y, max(x) FILTER (k = 1) AS max_x FROM k GROUP BY 1, 2)
SELECT event, t, {r("mean")}, max, sum, n, max_y, max_x, {r("sqrt((max_y - 3) * (max_y - 3) + (max_x - 2) * (max_x - 2))", "distance")}, max_y = 3 AND max_x = 2 AS same_cell FROM s""")
def step_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(fields.step_distance(fields.step_stats(_steps(spark, sf_dir), ["event"]), 3, 2))


@query(f"""WITH {_STEPS} SELECT event, t, max(value) FILTER (abs(y - 3) <= 1 AND abs(x - 2) <= 1) AS near_max, max(value) AS grid_max FROM steps GROUP BY 1, 2""")
def step_neighbourhood_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(fields.step_neighbourhood_max(_steps(spark, sf_dir), ["event"], 3, 2))


_FLOOD = "flood AS (SELECT event, y, x, value / 10 AS area FROM cells WHERE (y + x) % 3 <> 0), both_ AS (SELECT c.*, f.area FROM cells c LEFT JOIN flood f USING (event, y, x))"


def _flooded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return c.join(c.where((F.col("y") + F.col("x")) % 3 != 0).select("event", "y", "x", (F.col("value") / 10).alias("area")), ["event", "y", "x"], "left")


@query(f"""WITH {CELLS}, {PEAKS}, {_FLOOD} SELECT p.event, {r("sum(value)", "neighbourhood_total")}, {r("coalesce(sum(value) FILTER (NOT (y = peak_y AND x = peak_x)), 0)", "neighbourhood_without_peak")}, count(*) AS neighbourhood_n, {r("coalesce(sum(area), 0)", "neighbourhood_area")}
FROM peaks p JOIN both_ c ON c.event = p.event AND abs(y - peak_y) <= 1 AND abs(x - peak_x) <= 1 GROUP BY 1""")
def flood_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _flooded(spark, sf_dir)
    return tidy(grids.neighbourhood(c, grids.peak_cell(c, ["event"]), ["event"], extra=["area"]))


@query(f"""WITH {CELLS}, {PEAKS}, {_FLOOD} SELECT p.event, CAST(level AS DOUBLE) AS level, {r("sum(value)", "threshold_total")}, count(*) AS threshold_n, {r("avg(value)", "threshold_mean")}, {r("coalesce(sum(area), 0)", "threshold_area")}, {r("avg(area)", "threshold_area_mean")}
FROM peaks p JOIN both_ c ON c.event = p.event CROSS JOIN (SELECT unnest([0.5, 0.6, 0.8]) AS level) WHERE value >= level * peak_value GROUP BY 1, 2""")
def flood_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _flooded(spark, sf_dir)
    return tidy(grids.footprint(c, grids.peak_cell(c, ["event"]), ["event"], extra=["area"]))


@query(f"""WITH {CELLS} SELECT y, x, nullif(count(*) FILTER (value > 2000), 0) AS frequency FROM cells GROUP BY 1, 2""")
def flood_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(fields.flood_frequency(cells(spark, sf_dir).withColumn("value", F.greatest(F.col("value") - 2000, F.lit(0.0))), ["y", "x"]))


@query("""WITH d AS (SELECT DISTINCT CAST(floor(event_id / 24) AS BIGINT) AS day FROM events WHERE event_type = 'error'), f AS (SELECT l_partkey % 500 AS day, l_quantity AS v FROM lineitem)
SELECT day, max(v) AS daily_max FROM f WHERE day IN (SELECT day FROM d) GROUP BY day""")
def daily_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("hour"))
    daily = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 500).alias("day"), F.col("l_quantity").alias("v"))
    return tidy(fields.daily_cross_check(hourly, daily, "hour", "day", "v"))


@query(f"""WITH {CELLS}, {PEAKS} SELECT c.event, c.y, c.x, CASE WHEN y = peak_y AND x = peak_x THEN 'peak' WHEN abs(y - peak_y) <= 1 AND abs(x - peak_x) <= 1 THEN 'nearby' ELSE 'high' END AS category
FROM cells c JOIN peaks p ON c.event = p.event WHERE (abs(y - peak_y) <= 1 AND abs(x - peak_x) <= 1) OR value > 2000""")
def cell_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    near = c.join(grids.peak_cell(c, ["event"]).where("found"), "event")
    dy, dx = F.abs(F.col("y") - F.col("peak_y")), F.abs(F.col("x") - F.col("peak_x"))
    return fields.categories([("peak", near.where((dy == 0) & (dx == 0))), ("nearby", near.where((dy <= 1) & (dx <= 1))), ("high", c.where("value > 2000"))], ["event", "y", "x"])


@query(f"""WITH {_STEPS} SELECT event, y, x, max(value) AS max, sum(value) AS total, {r("avg(value)", "mean")}, count(*) AS n FROM steps WHERE (event, y, x) IN (SELECT event, y, x FROM steps WHERE value > 400) GROUP BY 1, 2, 3""")
def chosen_cell_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _steps(spark, sf_dir)
    return tidy(fields.cell_summary(c, c.where("value > 400").select("event", "y", "x"), ["event", "y", "x"]))


_RATIO = f"{_STEPS}, flat AS (SELECT y, x, sum(value) AS f FROM steps GROUP BY 1, 2)"


@query(f"""WITH {_RATIO} SELECT event, t, y, x, {r("value / f * 1000", "share")} FROM steps JOIN flat USING (y, x)""")
def field_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _steps(spark, sf_dir)
    return tidy(fields.over_time(c, c.groupBy("y", "x").agg((F.sum("value") / 1000).alias("f")), "value", "f", "share").drop("value"))


_HOURLY_RATIO = """a AS (SELECT event_type AS k, CAST(user_id % 72 AS BIGINT) AS t, round(sum(value), 4) AS v FROM events GROUP BY 1, 2), b AS (SELECT CAST(user_id % 72 AS BIGINT) AS t, round(sum(value) FILTER (user_id % 2 = 0), 4) AS v FROM events GROUP BY 1),
ratio AS (SELECT k, t, a.v, a.v / nullif(b.v, 0) AS ratio FROM a JOIN b USING (t))"""


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("t", F.col("user_id") % 72)
    a = e.groupBy(F.col("event_type").alias("k"), "t").agg(F.round(F.sum("value"), 4).alias("value"))
    b = e.groupBy("t").agg(F.round(F.sum(F.when(F.col("user_id") % 2 == 0, F.col("value"))), 4).alias("value"))
    return fields.ratio_series(a, b, ["t"])


@query(f"""WITH {_HOURLY_RATIO} SELECT k, t, v AS value, {r("ratio")} FROM ratio""")
def ratio_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_ratios(spark, sf_dir))


@query(f"""WITH {_HOURLY_RATIO}, d AS (SELECT k, CAST(floor(t / 24) AS BIGINT) AS day, avg(ratio) AS m, stddev_pop(ratio) AS s FROM ratio WHERE ratio IS NOT NULL GROUP BY 1, 2)
SELECT d.k, d.day, {r("any_value(m)", "mean")}, {r("any_value(s)", "std")}, bool_and(abs(ratio - m) <= 1e-8 + 0.3 * abs(m)) AS constant
FROM d JOIN ratio q ON q.k = d.k AND CAST(floor(q.t / 24) AS BIGINT) = d.day WHERE ratio IS NOT NULL GROUP BY 1, 2""")
def daily_constancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(fields.daily_constancy(_ratios(spark, sf_dir), ["k"], rtol=0.3))


@query(f"""WITH c AS (SELECT o_orderpriority AS k, CAST(month(o_orderdate) AS BIGINT) * 30 - 15 AS day, avg(o_totalprice) AS clim FROM orders GROUP BY 1, 2),
v AS (SELECT o_orderkey, o_orderpriority AS k, CAST((month(o_orderdate) - 1) * 30 + least(day(o_orderdate), 30) AS BIGINT) AS day, o_totalprice AS value FROM orders),
j AS (SELECT v.*, lo.day AS a, lo.clim AS va, hi.day AS b, hi.clim AS vb FROM v JOIN c lo ON lo.k = v.k AND lo.day = greatest(15, ((v.day - 15) // 30) * 30 + 15) LEFT JOIN c hi ON hi.k = lo.k AND hi.day = lo.day + 30),
i AS (SELECT *, CASE WHEN b IS NULL THEN va ELSE va + (vb - va) * least(greatest((day - a) / (b - a), 0), 1) END AS c FROM j)
SELECT o_orderkey, k, day, value, {r("c", "climatology")}, {r("value - c", "anomaly")} FROM i""")
def climatology_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    m = F.month("o_orderdate").cast("long")
    clim = o.groupBy(F.col("o_orderpriority").alias("k"), (m * 30 - 15).alias("day")).agg(F.avg("o_totalprice").alias("clim"))
    rows = o.select("o_orderkey", F.col("o_orderpriority").alias("k"), ((m - 1) * 30 + F.least(F.dayofmonth("o_orderdate"), F.lit(30))).alias("day"), F.col("o_totalprice").alias("value"))
    return tidy(fields.anomaly(rows, clim, ["k"], "day", "value", "clim"))


# ---------------------------------------------------------------- grids


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey // 40 AS ix, l_suppkey // 40 AS iy FROM lineitem), c AS (SELECT ix, iy, count(*) AS n FROM f GROUP BY 1, 2 HAVING count(*) % 2 = 0)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, n FROM f LEFT JOIN c USING (ix, iy)""")
def nearest_coarse_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    coarse = fine.groupBy(F.floor(F.col("l_partkey") / 40).alias("ix"), F.floor(F.col("l_suppkey") / 40).alias("iy")).agg(F.count("*").alias("n")).where("n % 2 = 0")
    return tidy(fields.nearest(fine, coarse, "l_partkey", "l_suppkey", 0.0, 0.0, 40.0, ["n"]))


@query(f"""WITH p AS (SELECT s_suppkey % 10 * 3.0 AS x, s_suppkey // 10 * 3.0 AS y, s_acctbal AS v FROM supplier), b AS (SELECT *, x - 1.5 AS x0, x + 1.5 AS x1, y - 1.5 AS y0, y + 1.5 AS y1 FROM p),
c AS (SELECT *, unnest(range(CAST(floor(x0 / 5) AS BIGINT), CAST(ceil(x1 / 5) AS BIGINT))) AS ix FROM b), d AS (SELECT *, unnest(range(CAST(floor(y0 / 5) AS BIGINT), CAST(ceil(y1 / 5) AS BIGINT))) AS iy FROM c),
w AS (SELECT iy, ix, v, (least(x1, (ix + 1) * 5) - greatest(x0, ix * 5)) * (least(y1, (iy + 1) * 5) - greatest(y0, iy * 5)) AS a FROM d)
SELECT iy, ix, {r("sum(v * a) / nullif(sum(a), 0)", "mean")}, {r("sum(a)", "covered")} FROM w GROUP BY 1, 2""")
def area_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 10 * 3.0).alias("x"), (F.floor(F.col("s_suppkey") / 10) * 3.0).alias("y"), F.col("s_acctbal").alias("v"))
    return tidy(fields.area_weighted(p, "x", "y", 3.0, 0.0, 0.0, 5.0, "v"))


@query(f"""SELECT l_suppkey // 20 AS iy, l_partkey // 20 AS ix, {r("least(1, count(*) FILTER (l_linenumber IN (2, 3)) / 5.0)", "proportion")} FROM lineitem GROUP BY 1, 2""")
def proportion_of_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_suppkey") / 20).alias("iy"), F.floor(F.col("l_partkey") / 20).alias("ix"), "l_linenumber")
    return tidy(fields.proportion(binned, F.col("l_linenumber").isin(2, 3), 5))


_GRADIENT = f"""{CELLS}, far AS (SELECT max(y) + 1 AS ny FROM cells), g AS (SELECT event, y, x, value - 1500 AS gx, CASE WHEN x = 0 THEN 0 ELSE value - 1400 END AS gy FROM cells),
flow AS (SELECT event, y, x, -gx / nullif(sqrt(gx * gx + gy * gy), 0) AS flow_x, gy / nullif(sqrt(gx * gx + gy * gy), 0) AS flow_y FROM g)"""


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = cells(spark, sf_dir).select("event", "y", "x", (F.col("value") - 1500).alias("gx"), F.when(F.col("x") == 0, 0.0).otherwise(F.col("value") - 1400).alias("gy"))
    return fields.flow_direction(g, "gx", "gy")


@query(f"""WITH {_GRADIENT} SELECT event, y, x, {r("flow_x")}, {r("flow_y")} FROM flow""")
def flow_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_flow(spark, sf_dir).select("event", "y", "x", "flow_x", "flow_y"))


@query(f"""WITH {_GRADIENT} SELECT event, {r("avg(flow_y) FILTER (y < 2)", "north_outflow")}, bool_and(flow_y IS NULL) FILTER (y < 2) AS north_unknown, {r("avg(-flow_y) FILTER (y >= ny - 2)", "south_outflow")}, bool_and(flow_y IS NULL) FILTER (y >= ny - 2) AS south_unknown,
  {r("avg(-flow_x) FILTER (x < 2)", "west_outflow")}, bool_and(flow_x IS NULL) FILTER (x < 2) AS west_unknown, {r("avg(flow_x) FILTER (x >= 8)", "east_outflow")}, bool_and(flow_x IS NULL) FILTER (x >= 8) AS east_unknown FROM flow, far GROUP BY event""")
def edge_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    ny = int(table(spark, sf_dir, "lineitem").agg(F.floor(F.max("l_suppkey") / 10)).first()[0]) + 1
    return tidy(fields.edge_flow(_flow(spark, sf_dir), ["event"], ny, 10, 2))


@query(f"""WITH s AS (SELECT p_partkey, (p_size - 3) * 4.0 / (225 * (0.1 + p_size / 200)) AS s, 0.1 + p_size / 200 AS c FROM part), t AS (SELECT *, CASE WHEN s >= 0 THEN least(s, 1) END AS u FROM s)
SELECT p_partkey, {r("u", "saturation")}, {r("(1 - u) * 225 * c", "storage_left")} FROM t""")
def coarse_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") - 3) * 4.0).alias("m"), (F.lit(0.1) + F.col("p_size") / 200).alias("c"))
    return tidy(fields.coarse_saturation(rows, "m", "c").drop("m", "c"))


@query("""SELECT count(*) FILTER (abs(l_quantity - (l_quantity - l_linenumber % 3 + l_quantity + l_linenumber % 2) / 2) > 1e-6) AS n_off, count(*) AS n FROM lineitem""")
def bounds_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, k = F.col("l_quantity"), F.col("l_linenumber")
    return tidy(fields.bounds_agree(table(spark, sf_dir, "lineitem").select(q, (q - k % 3).alias("low"), (q + k % 2).alias("high")), "l_quantity", "low", "high"))


@query(f"""WITH v AS (SELECT c_mktsegment, CASE WHEN c_acctbal < -500 THEN NULL ELSE c_acctbal / 5000 END AS v FROM customer)
SELECT c_mktsegment, count(*) FILTER (v IS NULL) AS n_unknown, CAST(0 AS BIGINT) AS n_infinite, count(v) AS n_valid, {r("count(*) FILTER (v > 1) / nullif(count(v), 0)", "over_1")}, {r("quantile_cont(v, 0.01)", "q01")}, {r("quantile_cont(v, 0.5)", "q50")}, {r("quantile_cont(v, 0.99)", "q99")} FROM v GROUP BY 1""")
def missing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", F.when(F.col("c_acctbal") >= -500, F.col("c_acctbal") / 5000).alias("v"))
    return tidy(fields.audit(rows, ["c_mktsegment"], "v"))


@query("""SELECT count(*) AS n FROM customer WHERE c_nationkey = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def uncovered_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.uncovered(table(spark, sf_dir, "customer"), "c_nationkey", table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query(f"""WITH {CELLS} SELECT event, {r("avg(value) FILTER (x >= 2 AND x <= 5 AND y >= 1 AND y <= 4)", "mean")}, max(value) FILTER (x >= 2 AND x <= 5 AND y >= 1 AND y <= 4) AS max, min(value) FILTER (x >= 2 AND x <= 5 AND y >= 1 AND y <= 4) AS min, count(*) FILTER (x >= 2 AND x <= 5 AND y >= 1 AND y <= 4) AS n FROM cells GROUP BY 1""")
def clipped_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(fields.clipped(cells(spark, sf_dir), in_box(F.col("x"), F.col("y"), (2, 1, 5, 4)), ["event"]))


@query(f"""WITH {CELLS} SELECT event, y, x, value FROM cells WHERE x + y < 6""")
def polygon_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(fields.mask(cells(spark, sf_dir), [[(-1, -1), (7, -1), (-1, 7)]], "x", "y", 1.0))


@query(f"""WITH {CELLS} SELECT event, y, x, value FROM cells WHERE abs(x - 2 * y - 0.3) <= 1.5 AND x <= 6.8 AND y <= 3.75""")
def sliver_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a polygon thinner than any of them touches: a ring there and back along x = 2 y + 0.3."""
    return tidy(fields.mask(cells(spark, sf_dir), [[(-1.7, -1.0), (6.3, 3.0), (6.3, 3.0)]], "x", "y", 1.0, "full_cell"))


@query(f"""WITH {CELLS} SELECT event, y, x, {r("sqrt((y - 4) * (y - 4) + (x - 4) * (x - 4))", "away")} FROM cells""")
def distance_from_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(cells(spark, sf_dir).select("event", "y", "x", distance(F.col("y") - 4, F.col("x") - 4).alias("away")))


@query(f"""WITH {CELLS} SELECT event, y * 10 + x AS cell, y AS iy, x AS ix FROM cells""")
def linear_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reshape.linear_index(cells(spark, sf_dir).select("event", F.col("y").alias("iy"), F.col("x").alias("ix")), 10).select("event", "cell")
    return tidy(reshape.grid_index(made, 10))


@query(f"""WITH {CELLS}, {PEAKS}, d AS (SELECT s_suppkey // 10 AS y, s_suppkey % 10 AS x, s_acctbal AS wet FROM supplier)
SELECT c.event, {r("avg(wet)", "antecedent_mean")}, {r("max(wet) FILTER (c.y = peak_y AND c.x = peak_x)", "antecedent_at_peak")} FROM cells c JOIN peaks p ON p.event = c.event JOIN d ON d.y = c.y AND d.x = c.x WHERE value >= 0.8 * peak_value GROUP BY 1""")
def antecedent_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    d = table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 10).alias("y"), (F.col("s_suppkey") % 10).alias("x"), F.col("s_acctbal").alias("wet"))
    return tidy(grids.antecedent(c, d, grids.peak_cell(c, ["event"]), ["event"], "wet", 0.8))


# ---------------------------------------------------------------- joins, codes, orders


@query("""WITH t AS (SELECT DISTINCT s_nationkey FROM supplier), e AS (SELECT c_custkey, c_nationkey, true AS m FROM customer WHERE c_nationkey % 3 = 0)
SELECT CAST(s_nationkey AS BIGINT) AS nation, c_custkey, coalesce(m, false) AS matched FROM e RIGHT JOIN t ON c_nationkey = s_nationkey""")
def right_join_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "customer").where("c_nationkey % 3 = 0").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return tidy(joins.marked_right(events, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")), ["nation"]).select("nation", "c_custkey", "matched"))


@query("""SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey""")
def class_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = table(spark, sf_dir, "nation").where("n_regionkey < 3").select("n_nationkey", "n_name")
    return tidy(joins.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), classes, "c_nationkey", "n_nationkey"))


@query("""WITH a AS (SELECT event_id, event_type, event_id * 3 AS s, event_id * 3 + 40 AS e FROM events WHERE user_id % 2 = 0), b AS (SELECT event_id AS other, event_type, event_id * 3 + 1 AS s2, event_id * 3 + 60 AS e2 FROM events WHERE user_id % 2 = 1)
SELECT event_type, event_id, other FROM a JOIN b USING (event_type) WHERE e > s2 AND s < e2""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = e.where("user_id % 2 = 0").select("event_id", "event_type", (F.col("event_id") * 3).alias("s"), (F.col("event_id") * 3 + 40).alias("e"))
    b = e.where("user_id % 2 = 1").select(F.col("event_id").alias("other"), "event_type", (F.col("event_id") * 3 + 1).alias("s2"), (F.col("event_id") * 3 + 60).alias("e2"))
    return joins.overlapping(a, b, ["event_type"], ("s", "e"), ("s2", "e2"), 64).select("event_type", "event_id", "other")


@query("""WITH a AS (SELECT s_suppkey, s_acctbal FROM supplier), b AS (SELECT c_custkey, c_acctbal FROM customer) SELECT s_suppkey, s_acctbal, c_acctbal, s_acctbal > c_acctbal AS larger FROM a JOIN b ON s_suppkey = c_custkey""")
def raster_with_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s_suppkey"), "c_acctbal").join(a.select("s_suppkey"), "s_suppkey", "left_semi")
    return fields.on_same_grid(a, b, ["s_suppkey"]).withColumn("larger", F.col("s_acctbal") > F.col("c_acctbal"))


@query("""SELECT o_orderkey, NOT coalesce(hour(o_orderdate) * 100 + o_custkey % 97 >= 10 AND hour(o_orderdate) * 100 + o_custkey % 97 < 80, false) AS time_mismatch FROM orders""")
def time_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.hour("o_orderdate") * 100 + F.col("o_custkey") % 97).alias("h"), F.lit(10).alias("a"), F.lit(80).alias("b"))
    return joins.contains_hour(rows, "h", "a", "b").select("o_orderkey", "time_mismatch")


@query(r"""SELECT p_partkey, CASE WHEN p_size < 10 THEN '0' || p_size ELSE CAST(p_size AS VARCHAR) END AS code, CAST(p_size AS VARCHAR) AS bare, replace(p_name, ' ', '') AS squeezed, TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS number, TRY_CAST(p_name AS DOUBLE) AS no_number, round_even(p_retailprice / 8, 1) AS half_even FROM part""")
def codes_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = text.padded(F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), text.unpadded(code).alias("bare"), text.squeezed(F.col("p_name")).alias("squeezed"), text.number(F.substring_index("p_brand", "#", -1)).alias("number"), text.number(F.col("p_name")).alias("no_number"), text.half_even(F.col("p_retailprice") / 8, 1).alias("half_even"))


@query(f"""SELECT o_orderkey, CAST((((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1) * 30 + day(o_orderdate) - 1) * 24 AS BIGINT) AS hours, {r("ln(o_totalprice)", "ln")}, {r("log10(o_totalprice)", "log10")} FROM orders""")
def hour_codes_and_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = text.hour_code(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("00")))
    return tidy(table(spark, sf_dir, "orders").select("o_orderkey", text.hours_since_1970(*at.values()).alias("hours"), *[c.alias(n) for n, c in text.logs(F.col("o_totalprice")).items()]))


@query(f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_quantity >= 40 THEN 3 WHEN l_quantity >= 20 THEN 2 WHEN l_quantity >= 5 THEN 1 ELSE 0 END AS digit, {r("CASE WHEN l_quantity < 10 THEN 10 WHEN l_quantity > 30 THEN 30 ELSE l_quantity END", "clipped")}, {r("l_extendedprice / nullif(l_linenumber - 2, 0)", "ratio", 2)}, abs(l_quantity - 25) <= 1e-8 + 0.1 * 25 AS near FROM lineitem""")
def guarded_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", binning.digitize(q, [5, 20, 40]).alias("digit"), binning.clip(q, 10, 30).alias("clipped"), binning.safe_ratio(F.col("l_extendedprice"), F.col("l_linenumber") - 2).alias("ratio"), binning.near(q, F.lit(25.0), 0.1).alias("near"))
    return tidy(rows.withColumn("ratio", F.round(F.col("ratio") + 1e-7, 2)))


@query("""SELECT s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS k FROM supplier) WHERE k >= 3 AND (k - 3) % 7 = 0""")
def strided_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.stride(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), ["s_suppkey"], 7, 3)


@query("""(SELECT 'head' AS side, c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5) UNION ALL (SELECT 'tail', c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 5)""")
def head_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    order = ["c_acctbal", "c_custkey"]
    return reshape.stack([f(c, order, 5).select(F.lit(side).alias("side"), "*") for side, f in (("head", windows.head), ("tail", windows.tail))])


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN abs(l_tax * 100 - 5) <= abs(l_discount * 100 - 5) AND abs(l_tax * 100 - 5) <= abs(l_quantity - 5) THEN 'tax' WHEN abs(l_discount * 100 - 5) <= abs(l_quantity - 5) THEN 'discount' ELSE 'quantity' END AS nearest FROM lineitem""")
def nearest_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(5.0).alias("target"), (F.col("l_tax") * 100).alias("tax"), (F.col("l_discount") * 100).alias("discount"), F.col("l_quantity").alias("quantity"))
    return tidy(windows.nearest_of(rows, "target", ["tax", "discount", "quantity"]).select("l_orderkey", "l_linenumber", "nearest"))


# ---------------------------------------------------------------- files


def _folder(spark: SparkSession) -> str:
    return f"{joins.shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("""SELECT CAST(o_orderkey AS BIGINT) AS start, 'status' || o_orderstatus AS catchment, '01' AS ens, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey % 7, o_orderkey) AS event_num FROM orders""")
def event_files_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event files, one per status and in parts, whose rows are in an order of their own, written and read again: numbers follow the files."""
    folder = _folder(spark)
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("status"), F.col("o_orderstatus"), F.lit("_01")).alias("file"), (F.col("o_custkey") % 7).alias("_k"), F.col("o_orderkey").cast("int").alias("start_indices"), *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in scans.EVENT_SCHEMA.split(", ")[1:])])
    rows.repartitionByRange("file", "_k", "start_indices").sortWithinPartitions("file", "_k", "start_indices").drop("_k").write.option("header", True).partitionBy("file").csv(folder)
    got = scans.event_files(spark, folder, r"file=([^/]+)_(\d{2})/[^/]*\.csv$", parts=True)
    return tidy(got.select(F.col("start_indices").cast("long").alias("start"), F.col("catchment_num").alias("catchment"), "ens", "event_num"))


@query("""SELECT CAST(year(l_shipdate) AS VARCHAR) AS ens, CAST(dayofyear(l_shipdate) AS BIGINT) AS hour360, l_suppkey % 10 AS y, CASE WHEN sum(l_quantity) <> 25 THEN sum(l_quantity) END AS value
FROM lineitem WHERE dayofyear(l_shipdate) >= 100 AND dayofyear(l_shipdate) < 160 AND year(l_shipdate) = 1996 GROUP BY 1, 2, 3""")
def member_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells written as a folder per member and read again: one member, a range of hours, one value that means none."""
    folder = _folder(spark)
    cells = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("string").alias("ens"), F.dayofyear("l_shipdate").cast("long").alias("hour360"), (F.col("l_suppkey") % 10).alias("y")).agg(F.sum("l_quantity").alias("value"))
    scans.write_parts(cells, folder, ["ens"])
    return scans.grid_cells(spark, folder, "1996", (100, 160), nodata=25.0).select(F.col("ens").cast("string").alias("ens"), "hour360", "y", "value")


@query("""SELECT l_suppkey AS row, CAST(l_linenumber AS BIGINT) AS col, CASE WHEN max(l_quantity) < 50 THEN max(l_quantity) END AS value FROM lineitem WHERE l_suppkey BETWEEN 10 AND 40 AND l_linenumber BETWEEN 2 AND 5 GROUP BY 1, 2""")
def pixels_in_a_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster's pixels written and read again in a box, nodata as NULL."""
    folder = _folder(spark)
    table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_linenumber").cast("long").alias("col")).agg(F.max("l_quantity").alias("value")).write.parquet(folder)
    return scans.pixels(spark, folder, nodata=50.0, box=(10, 2, 40, 5))


@query("""WITH c AS (SELECT CAST(l_linenumber AS BIGINT) AS event_num, l_suppkey % 10 AS cell, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT event_num, cell, v AS value FROM c""")
def flood_cells_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flood tables of two depths, written in folders by depth and variable, of which one is read; events without a cell would raise."""
    folder = _folder(spark)
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("event_num"), (F.col("l_suppkey") % 10).alias("cell")).agg(F.sum("l_quantity").alias("value"))
    both = rows.withColumns({"depth": F.explode(F.array(F.lit(10), F.lit(30))), "variable": F.lit("area")})
    scans.write_parts(both.withColumn("value", F.when(F.col("depth") == 10, F.col("value")).otherwise(-F.col("value"))), folder, ["depth", "variable"])
    return scans.flood_cells(spark, folder, 10, "area").select("event_num", "cell", "value")


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1""")
def work_not_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose folder is not there yet."""
    folder = _folder(spark)
    n = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    scans.write_parts(n.where("o_orderpriority = '1-URGENT'"), folder, ["o_orderpriority"])
    return scans.not_written(n, spark, folder, ["o_orderpriority"])
