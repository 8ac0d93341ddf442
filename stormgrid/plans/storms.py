"""Queries over event series, grid cells and fine pixels, and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import storm
from ..ml import models
from ..operators import grids, joins, reshape, windows
from ..streaming.windows import hourly_totals
from .base import CELLS, DAILY, PEAKS, SERIES, cells, daily, hourly, query, r, series, table, tidy

_METRICS = f"""WITH {SERIES},
span AS (SELECT event_type, d, min(h) FILTER (v > 0.1) AS a, max(h) FILTER (v > 0.1) AS b FROM series GROUP BY 1, 2),
t AS (SELECT event_type, d, h - a AS i, b - a + 1 AS n, v FROM series JOIN span USING (event_type, d) WHERE h BETWEEN a AND b),
w AS (SELECT *, sum(v) OVER o AS c, row_number() OVER (PARTITION BY event_type, d ORDER BY v, i) AS k, lag(v) OVER o AS p,
  {", ".join(f"CASE WHEN i + 1 >= least({h}, n) THEN sum(v) OVER (PARTITION BY event_type, d ORDER BY i ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW) END AS s{h}" for h in (2, 3, 6, 12, 16))},
  sum(v) OVER g AS total, max(v) OVER g AS peak, sum(v * (i + 1)) OVER g / sum(v) OVER g AS centre
  FROM t WINDOW o AS (PARTITION BY event_type, d ORDER BY i), g AS (PARTITION BY event_type, d)),
top AS (SELECT event_type, d, min(i) AS k FROM w WHERE v = peak GROUP BY 1, 2),
m AS (SELECT event_type, d, any_value(w.n) AS n, any_value(total) AS total, any_value(peak) AS peak, any_value(top.k) AS top,
  {", ".join(f"max(s{h}) AS s{h}" for h in (2, 3, 6, 12, 16))},
  coalesce(sum(v) FILTER (i < top.k), 0) AS before, coalesce(sum(v) FILTER (i > top.k), 0) AS after,
  2 * sum(w.k * v) / (any_value(w.n) * any_value(total)) - (any_value(w.n) + 1) / any_value(w.n) AS gini,
  sqrt(sum(v * (i + 1 - centre) * (i + 1 - centre)) / any_value(total)) / any_value(w.n) AS tstd,
  count(*) FILTER (v = 0) / count(*) * 100 AS dry, count(*) FILTER ((v > 0) <> (p > 0)) / count(*) AS flips,
  min(i) FILTER (c / total >= 0.5) AS half
  FROM w JOIN top USING (event_type, d) GROUP BY 1, 2),
share AS (SELECT event_type, d, i, c / total AS s FROM w),
quarter AS (SELECT event_type, d, q, lo.s + (hi.s - lo.s) * (q / 4 * (n - 1) - floor(q / 4 * (n - 1))) AS s
  FROM m CROSS JOIN (SELECT unnest(range(5)) AS q) JOIN share lo USING (event_type, d) JOIN share hi USING (event_type, d)
  WHERE lo.i = floor(q / 4 * (n - 1)) AND hi.i = least(floor(q / 4 * (n - 1)) + 1, n - 1)),
step AS (SELECT event_type, d, q - 1 AS q, s - lag(s) OVER (PARTITION BY event_type, d ORDER BY q) AS s FROM quarter),
most AS (SELECT event_type, d, q FROM (SELECT *, row_number() OVER (PARTITION BY event_type, d ORDER BY round(s, 9) DESC, q) AS k FROM step WHERE s IS NOT NULL) WHERE k = 1),
halves AS (SELECT m.event_type, m.d, CASE WHEN half > 0 THEN lo.s ELSE 0 END AS s0, hi.s AS s1, CASE WHEN n > 1 THEN 100 / (n - 1) ELSE 100 END AS step
  FROM m LEFT JOIN share lo ON lo.event_type = m.event_type AND lo.d = m.d AND lo.i = half - 1 JOIN share hi ON hi.event_type = m.event_type AND hi.d = m.d AND hi.i = half)
SELECT event_type, d, CAST(24 AS BIGINT) AS length, n AS length_of_active_rain, {r("total", "total_acc")}, {r("peak", "max_intensity")},
  {", ".join(r(f"s{h}", f"max_{h}h") for h in (2, 3, 6, 12, 16))}, {r("top / greatest(n - 1, 1)", "peak_position_ratio")}, {r("before", "before_peak")}, {r("after", "after_peak")}, {r("peak", "at_peak")},
  {r("peak / total", "peak_share")}, {r("1 - peak / total", "nonpeak_share")}, {r("(before - after) / total", "loading_index")},
  {r("CASE WHEN half > 0 THEN (half - 1) * step + (0.5 - s0) / (s1 - s0) * step ELSE 0.5 / s1 * step END", "d50")},
  {r("gini")}, {r("tstd", "time_based_std")}, {r("dry", "dry_ratio")}, {r("flips", "wet_dry_transition_rate")}, CASE WHEN n > 1 THEN most.q END AS max_quartile_index
FROM m JOIN halves USING (event_type, d) JOIN most USING (event_type, d)"""


@query(_METRICS)
def storm_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(storm.with_metrics(series(spark, sf_dir), "series").drop("series", "n_peaks", "modality"))


#: Plateaus between lower values are peaks, taken by height; one stays if none that stays is nearer than three hours. Ends count apart.
_PEAKS_SQL = f"""WITH RECURSIVE {SERIES},
span AS (SELECT event_type, d, min(h) FILTER (v > 0.1) AS a, max(h) FILTER (v > 0.1) AS b FROM series GROUP BY 1, 2),
t AS (SELECT event_type, d, h - a AS i, b - a + 1 AS n, v FROM series JOIN span USING (event_type, d) WHERE h BETWEEN a AND b),
runs AS (SELECT event_type, d, v, n, min(i) AS first, max(i) AS last FROM (SELECT *, i - row_number() OVER (PARTITION BY event_type, d, v ORDER BY i) AS g FROM t) GROUP BY event_type, d, v, n, g),
tops AS (SELECT r.event_type, r.d, (first + last + 2) // 2 AS mid, row_number() OVER (PARTITION BY r.event_type, r.d ORDER BY r.v DESC, (first + last + 2) // 2 DESC) AS k FROM runs r
  JOIN t p ON p.event_type = r.event_type AND p.d = r.d AND p.i = first - 1 JOIN t q ON q.event_type = r.event_type AND q.d = r.d AND q.i = last + 1 WHERE r.v >= 10 AND p.v < r.v AND q.v < r.v),
pick AS (SELECT event_type, d, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM span
  UNION ALL SELECT p.event_type, p.d, p.k + 1, CASE WHEN len(list_filter(p.kept, lambda x: abs(x - mid) < 3)) > 0 THEN p.kept ELSE list_append(p.kept, mid) END FROM pick p JOIN tops o ON o.event_type = p.event_type AND o.d = p.d AND o.k = p.k + 1),
inner_ AS (SELECT event_type, d, max(len(kept)) AS inside FROM pick GROUP BY 1, 2),
ends AS (SELECT event_type, d, any_value(n) AS n, max(v) FILTER (i = 0) AS v0, max(v) FILTER (i = 1) AS v1, max(v) FILTER (i = n - 2) AS w1, max(v) FILTER (i = n - 1) AS w0 FROM t GROUP BY 1, 2),
c AS (SELECT s.event_type, s.d, CASE WHEN n IS NULL THEN 0 WHEN n <= 2 THEN 1 ELSE inside + CASE WHEN v0 >= 10 AND v0 > v1 THEN 1 ELSE 0 END + CASE WHEN w0 >= 10 AND w0 > w1 THEN 1 ELSE 0 END END AS n_peaks
  FROM span s LEFT JOIN ends USING (event_type, d) JOIN inner_ USING (event_type, d))
SELECT event_type, d, CAST(n_peaks AS BIGINT) AS n_peaks, CASE n_peaks WHEN 0 THEN 'no clear peak' WHEN 1 THEN 'unimodal' WHEN 2 THEN 'bimodal' ELSE 'multimodal' END AS modality FROM c"""


@query(_PEAKS_SQL)
def modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    wet = series(spark, sf_dir).withColumn("t", storm.trimmed(F.col("series")))
    peaks = wet.select("event_type", "d", F.when(F.col("t").isNull(), 0).otherwise(storm.n_peaks(F.col("t"))).alias("n_peaks"))
    return tidy(peaks.withColumn("modality", storm.modality(F.col("n_peaks"))))


@query(f"""WITH {DAILY} SELECT event_type, day, {r("CASE WHEN count(total) OVER w >= 3 THEN avg(total) OVER w END", "rolling")} FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def centred_rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(windows.centred_mean(daily(spark, sf_dir), ["event_type"], ["day"], "total", 5, 3).drop("total"))


@query(f"""WITH {SERIES}, w AS (SELECT event_type, d, {", ".join(f"CASE WHEN h + 1 >= {h} THEN sum(v) OVER (PARTITION BY event_type, d ORDER BY h ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW) END AS s{h}" for h in (2, 3, 6, 12, 16))} FROM series)
SELECT event_type, d, {", ".join(r(f"max(s{h})", f"max_{h}h") for h in (2, 3, 6, 12, 16))} FROM w GROUP BY 1, 2""")
def rolling_max_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(windows.rolling_max_sum(hourly(spark, sf_dir), ["event_type", "d"], ["h"], "v", [2, 3, 6, 12, 16]))


@query(f"""WITH {SERIES}, w AS (SELECT event_type, d, v > 0 AS wet, lag(v > 0) OVER (PARTITION BY event_type, d ORDER BY h) AS was FROM series)
SELECT event_type, d, {r("count(*) FILTER (wet <> was) / count(*)", "transition_rate")} FROM w GROUP BY 1, 2""")
def wet_dry_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(windows.transitions(hourly(spark, sf_dir), ["event_type", "d"], ["h"], "v"))


@query(f"""WITH {SERIES} SELECT event_type, d, array_to_string(list(CAST(CAST(round(v * 100) AS BIGINT) AS VARCHAR) ORDER BY h), ',') AS series FROM series GROUP BY 1, 2""")
def repair_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hourly(spark, sf_dir).withColumn("v", F.round(F.col("v") * 100).cast("long"))
    return reshape.repair_exploded(rows, ["event_type", "d"], "h", "v").withColumn("series", F.array_join("series", ","))


@query(f"""WITH {SERIES}, p AS (SELECT event_type, d, k, k * 23 / 10.0 AS place FROM (SELECT DISTINCT event_type, d FROM series) CROSS JOIN (SELECT unnest(range(11)) AS k)),
q AS (SELECT p.*, lo.v + (hi.v - lo.v) * (place - lo.h) AS v FROM p JOIN series lo ON lo.event_type = p.event_type AND lo.d = p.d AND lo.h = least(floor(place), 22) JOIN series hi ON hi.event_type = p.event_type AND hi.d = p.d AND hi.h = lo.h + 1)
SELECT event_type, d, k, {r("v")} FROM q""")
def interpolated_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(series(spark, sf_dir).select("event_type", "d", F.posexplode(storm.interpolated(F.col("series"), 11)).alias("k", "v")))


_EVENT_ID = "event_type || '/' || day"


@query(f"""WITH {DAILY} SELECT {_EVENT_ID.replace("event_type", "a.event_type").replace("day", "a.day")} AS event,
  {", ".join(r(f"avg(b.total) FILTER (b.day >= a.day - {n})", f"mean_{n}d") for n in (2, 3, 4, 5))}
FROM daily a LEFT JOIN daily b ON a.event_type = b.event_type AND b.day >= a.day - 5 AND b.day < a.day GROUP BY 1""")
def lookback_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    events = d.select(F.concat_ws("/", "event_type", "day").alias("event"), "event_type", F.col("day").alias("anchor"))
    return tidy(joins.lookback_means(events, d, ["event_type"], "event", "anchor", "day", "total").drop("event_type", "anchor"))


@query(f"""WITH {DAILY} SELECT {_EVENT_ID.replace("event_type", "a.event_type").replace("day", "a.day")} AS event,
  {", ".join(r(f"coalesce(sum(b.total) FILTER (b.day >= a.day - {n}), 0)", f"total_{n}d") for n in (1, 2, 5, 10))}
FROM daily a LEFT JOIN daily b ON a.event_type = b.event_type AND b.day >= a.day - 10 AND b.day < a.day GROUP BY 1""")
def antecedent_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    events = d.select(F.concat_ws("/", "event_type", "day").alias("event"), "event_type", F.col("day").alias("anchor"))
    return tidy(joins.antecedent_totals(events, d, ["event_type"], "event", "anchor", "day", "total").drop("event_type", "anchor"))


@query(f"""WITH {DAILY}, e AS (SELECT event_id, event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS onset FROM events)
SELECT event_id, e.event_type, onset, total AS total_day_before FROM e LEFT JOIN daily b ON b.event_type = e.event_type AND b.day + 1 = onset""")
def day_before_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("onset"))
    return joins.day_before(events, daily(spark, sf_dir), ["event_type"], "onset", "day", "total").select("event_id", "event_type", "onset", "total_day_before")


@query("""WITH s AS (SELECT user_id, date_trunc('hour', ts) AS hour_, round(sum(value), 4) AS v FROM events GROUP BY 1, 2)
SELECT user_id, hour_, lag(v) OVER (PARTITION BY user_id ORDER BY hour_) AS v_before FROM s""")
def asof_latest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("hour_")).agg(F.round(F.sum("value"), 4).alias("v"))
    return joins.asof_before(s.select("user_id", "hour_"), s, ["user_id"], "hour_", "hour_", "v")


@query("""SELECT event_type, date_trunc('hour', ts) AS start, round(sum(value), 4) + 0.0 AS total, count(*) AS n FROM events GROUP BY 1, 2""")
def hourly_window_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(hourly_totals(table(spark, sf_dir, "events"), ["event_type"]))


@query(f"""WITH {CELLS}, {PEAKS} SELECT p.event, true AS found, peak_value, peak_y, peak_x, count(*) AS n_ties FROM peaks p JOIN cells c ON c.event = p.event AND c.value = p.peak_value GROUP BY ALL""")
def peak_cell_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(grids.peak_cell(cells(spark, sf_dir), ["event"]))


@query(f"""WITH {CELLS}, {PEAKS} SELECT p.event, {r("sum(value)", "neighbourhood_total")}, {r("coalesce(sum(value) FILTER (NOT (y = peak_y AND x = peak_x)), 0)", "neighbourhood_without_peak")}, count(*) AS neighbourhood_n
FROM peaks p JOIN cells c ON c.event = p.event AND abs(y - peak_y) <= 1 AND abs(x - peak_x) <= 1 GROUP BY 1""")
def neighbourhood_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return tidy(grids.neighbourhood(c, grids.peak_cell(c, ["event"]), ["event"]))


@query(f"""WITH {CELLS}, {PEAKS} SELECT p.event, CAST(level AS DOUBLE) AS level, {r("sum(value)", "threshold_total")}, count(*) AS threshold_n, {r("avg(value)", "threshold_mean")}
FROM peaks p JOIN cells c ON c.event = p.event CROSS JOIN (SELECT unnest([0.5, 0.6, 0.8]) AS level) WHERE value >= level * peak_value GROUP BY 1, 2""")
def threshold_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return tidy(grids.footprint(c, grids.peak_cell(c, ["event"]), ["event"]))


def _cluster_sql(near: str) -> str:
    return f"""WITH RECURSIVE {CELLS}, {PEAKS}, mask AS (SELECT c.* FROM cells c JOIN peaks p ON c.event = p.event AND value >= 0.85 * peak_value),
reach AS (SELECT event, peak_y AS y, peak_x AS x FROM peaks UNION SELECT m.event, m.y, m.x FROM reach r JOIN mask m ON m.event = r.event AND {near})
SELECT event, {r("sum(value)", "cluster_total")}, count(*) AS cluster_n, {r("avg(value)", "cluster_mean")}, count(*) - 1 AS cluster_others FROM reach JOIN mask USING (event, y, x) GROUP BY 1"""


def _cluster(spark: SparkSession, sf_dir: str, connectivity: int) -> DataFrame:
    c = cells(spark, sf_dir)
    return tidy(grids.cluster_summary(grids.peak_cluster(c, grids.peak_cell(c, ["event"]), ["event"], level=0.85, connectivity=connectivity), ["event"]))


@query(_cluster_sql("abs(m.y - r.y) + abs(m.x - r.x) = 1"))
def peak_cluster_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cluster(spark, sf_dir, 4)


@query(_cluster_sql("greatest(abs(m.y - r.y), abs(m.x - r.x)) = 1"))
def peak_cluster_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cluster(spark, sf_dir, 8)


@query(f"""WITH {CELLS} SELECT event AS t, count(*) AS n_cells, max(value) AS max_value FROM cells WHERE value > 2000 GROUP BY 1""")
def exceedance_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(grids.exceedance(cells(spark, sf_dir).withColumnRenamed("event", "t"), [], 2000.0)[0])


@query(f"""WITH {CELLS} SELECT y, x, count(*) AS n_steps, max(value) AS max_value FROM cells WHERE value > 2000 GROUP BY 1, 2""")
def exceedance_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(grids.exceedance(cells(spark, sf_dir).withColumnRenamed("event", "t"), [], 2000.0)[1])


#: Fine points are line items by part and supplier; coarse cells are 20 wide, from the least to the largest key.
_FINE = "fine AS (SELECT l_partkey // 20 AS ix, l_suppkey // 20 AS iy, l_quantity, l_linenumber FROM lineitem)"


def _fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    nx, ny = _extent(spark, sf_dir)
    return grids.to_coarse(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", 0.0, 0.0, 20.0, nx, ny)


def _extent(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Columns and rows of the coarse grid that holds every line item: two numbers reach the driver."""
    far = table(spark, sf_dir, "lineitem").agg(F.floor(F.max("l_partkey") / 20), F.floor(F.max("l_suppkey") / 20)).first()
    return int(far[0] or 0) + 1, int(far[1] or 0) + 1


@query(f"""WITH {_FINE} SELECT iy, ix, {r("avg(l_quantity)", "mean")}, count(*) AS n, {r("count(*) FILTER (l_quantity > 10) * 0.25", "area")}, {r("coalesce(sum(l_quantity) FILTER (l_quantity > 10), 0) * 0.25", "volume")} FROM fine GROUP BY 1, 2""")
def fine_to_coarse_mean_area_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(grids.coarse_stats(_fine(spark, sf_dir), "l_quantity", 10.0, 0.25))


@query(f"""WITH {_FINE}, n AS (SELECT iy, ix, l_linenumber, count(*) AS n FROM fine GROUP BY 1, 2, 3)
SELECT iy, ix, CAST(l_linenumber AS BIGINT) AS mode, {r("share", "mode_share")} FROM (SELECT *, n / sum(n) OVER (PARTITION BY iy, ix) AS share, row_number() OVER (PARTITION BY iy, ix ORDER BY n DESC, l_linenumber) AS k FROM n) WHERE k = 1""")
def fine_to_coarse_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(grids.coarse_mode(_fine(spark, sf_dir), "l_linenumber"))


@query(f"""WITH {_FINE}, c AS (SELECT iy, ix, count(*) AS n FROM fine WHERE l_quantity > 49 GROUP BY 1, 2)
SELECT y AS iy, x AS ix, coalesce(n, 0) AS n FROM (SELECT unnest(range((SELECT max(l_suppkey) // 20 + 1 FROM lineitem))) AS y) CROSS JOIN (SELECT unnest(range((SELECT max(l_partkey) // 20 + 1 FROM lineitem))) AS x) LEFT JOIN c ON iy = y AND ix = x""")
def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _fine(spark, sf_dir).where("l_quantity > 49").groupBy("iy", "ix").agg(F.count("*").alias("n"))
    return tidy(grids.dense(n, *_extent(spark, sf_dir), {"n": 0}))


@query(f"""WITH {CELLS}, g AS (SELECT *, lag(value) OVER a AS w0, lead(value) OVER a AS w1, lag(value) OVER b AS n0, lead(value) OVER b AS n1 FROM cells WINDOW a AS (PARTITION BY event, y ORDER BY x), b AS (PARTITION BY event, x ORDER BY y)),
s AS (SELECT *, (CASE WHEN w0 IS NULL THEN w1 - value WHEN w1 IS NULL THEN value - w0 ELSE (w1 - w0) / 2 END) / 1000 AS gx, (CASE WHEN n0 IS NULL THEN n1 - value WHEN n1 IS NULL THEN value - n0 ELSE (n1 - n0) / 2 END) / 1000 AS gy FROM g)
SELECT event, y, x, value, {r("degrees(atan(sqrt(gx * gx + gy * gy)))", "slope")} FROM s""")
def slope_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(grids.slope(cells(spark, sf_dir), ["event"], spacing=1000.0))


@query(f"""WITH {CELLS} SELECT y AS zone, {r("avg(value)", "mean")}, min(value) AS min, max(value) AS max, count(value) AS n, {r("count(*) FILTER (value > 1) / count(value) * 100", "pct_over_1")}, {r("count(*) FILTER (value < 0) / count(value) * 100", "pct_under_0")} FROM cells GROUP BY 1""")
def zonal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(grids.zonal(cells(spark, sf_dir).withColumnRenamed("y", "zone"), "zone", "value"))


@query(f"""WITH p AS (SELECT p_partkey, p_size * 4.0 AS m, 0.3 + p_size / 200 AS e, p_retailprice / 100 AS k FROM part), s AS (SELECT p_partkey, m / 1000 / 0.225 / e AS saturation, 0.06375 * sqrt(k) AS lu, e FROM p)
SELECT p_partkey, {r("saturation")}, {r("lu")}, {r("e * lu", "fumax")}, {r("greatest(0, 1 - saturation)", "deficit")}, {r("greatest(0, 1 - saturation) * e * lu", "fu")}, {r("greatest(0, 1 - saturation) * e * lu * 900", "fu_volume")} FROM s""")
def soil_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 4.0).alias("m"), (F.lit(0.3) + F.col("p_size") / 200).alias("e"), (F.col("p_retailprice") / 100).alias("k"))
    return tidy(grids.soil_columns(rows, "m", "e", "k").drop("m", "e", "k"))


@query(f"""WITH {CELLS} SELECT y AS row, x AS col, coalesce(max(value) FILTER (event = 1995), max(value) FILTER (event = 1996)) AS value FROM cells WHERE event IN (1995, 1996) AND NOT (event = 1995 AND value < 2000) GROUP BY 1, 2""")
def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).select("event", F.col("y").alias("row"), F.col("x").alias("col"), "value")
    first = c.where("event = 1995").withColumn("value", F.when(F.col("value") >= 2000, F.col("value")))
    return tidy(grids.mosaic([first.drop("event"), c.where("event = 1996").drop("event")]))


_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.xxhash64("*").alias("key"), *_FEATURES, "l_extendedprice")


@query()
def kmeans_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, inertia, silhouette = models.clusters(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), "s_acctbal"), ["nation", "s_acctbal"], 4)
    return got.groupBy("cluster").agg(F.count("*").alias("n")).withColumns({"inertia": F.lit(inertia), "silhouette": F.lit(silhouette)})


@query()
def rf_cv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.scores(models.out_of_fold(_rows(spark, sf_dir), "forest", _FEATURES, "l_extendedprice", "key", 3, numTrees=5, maxDepth=4), "l_extendedprice", ["fold"])


@query()
def perm_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return models.permutation_importance(models.regressor("linear", _FEATURES, "l_extendedprice").fit(rows), rows, _FEATURES, "l_extendedprice")


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.bootstrap_mean(table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", 50)
