"""Queries over orders and line items: periods, bins, shares, trends, regression, time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binning, calendar360
from ..operators import aggregates, joins, reshape, windows
from ..sources.scans import name_parts
from .base import FACTS, NUDGE, facts, query, r, table, tidy

#: Inclusive spans of years; neighbours share a year.
SPANS = (("early", 1995, 1997), ("middle", 1997, 1999), ("late", 1999, 2001))
_IN = {n: f"year BETWEEN {a} AND {b}" for n, a, b in SPANS}


def _regional_sql() -> str:
    first = SPANS[0][0]
    base = [f"avg(o_totalprice) FILTER ({c}) AS o_totalprice_{n}, count(*) FILTER ({c}) AS n_{n}, count(*) FILTER ({c}) / {b - a + 1} AS rate_{n}" for (n, a, b), c in zip(SPANS, _IN.values(), strict=True)]
    out = ["region", *[f"n_{n}" for n in _IN], *[r(f"{v}_{n}") for n in _IN for v in ("o_totalprice", "rate")]]
    for n in list(_IN)[1:]:
        for v in ("o_totalprice", "rate"):
            new, old = f"{v}_{n}", f"{v}_{first}"
            out += [r(f"({new} - {old})", f"{v}_change_{n}"), r(f"(({new} - {old}) / nullif({old}, 0) * 100)", f"{v}_pct_{n}")]
    return f"WITH {FACTS}, s AS (SELECT region, {', '.join(base)} FROM facts GROUP BY region) SELECT {', '.join(out)} FROM s"


@query(_regional_sql())
def regional_period_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(aggregates.regional_period_summary(facts(spark, sf_dir), ["o_totalprice"], "region", "year", SPANS, 9))


@query(f"""WITH {FACTS}, y AS (SELECT region, year, avg(o_totalprice) AS m FROM facts GROUP BY 1, 2),
s AS (SELECT region, regr_slope(m, year) AS slope, regr_intercept(m, year) AS intercept, regr_r2(m, year) AS r2, count(*) AS n, avg(m) AS baseline, max(year) - min(year) AS span FROM y GROUP BY 1)
SELECT region, {r("slope")}, {r("intercept", digits=2)}, {r("r2")}, n, {r("baseline")}, {r("slope * span / baseline * 100", "pct_change")} FROM s WHERE n >= 5""")
def annual_trend_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = facts(spark, sf_dir).groupBy("region", "year").agg(F.avg("o_totalprice").alias("m"))
    out = aggregates.trend(yearly, ["region"], "year", "m")
    return tidy(out.withColumn("intercept", F.round(F.col("intercept") + NUDGE, 2)))


_EDGES = [0, 10, 20, 30, 40, 50]


@query(f"""WITH p AS (SELECT CASE {" ".join(f"WHEN l_quantity > {a} AND l_quantity <= {b} THEN '{a}-{b}'" for a, b in zip(_EDGES[:-1], _EDGES[1:]))} END AS intensity,
  CASE WHEN year(l_shipdate) BETWEEN 1995 AND 1997 THEN 'early' WHEN year(l_shipdate) BETWEEN 1997 AND 1999 THEN 'middle' WHEN year(l_shipdate) BETWEEN 1999 AND 2001 THEN 'late' END AS period, l_extendedprice AS v FROM lineitem)
SELECT intensity, {", ".join(r(f"avg(v) FILTER (period = '{n}')", n) for n in _IN)} FROM p GROUP BY intensity""")
def period_intensity_mean_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = [f"{a}-{b}" for a, b in zip(_EDGES[:-1], _EDGES[1:], strict=True)]
    rows = table(spark, sf_dir, "lineitem").select(binning.cut(F.col("l_quantity"), _EDGES, labels).alias("intensity"), binning.periods(F.year("l_shipdate"), SPANS).alias("period"), "l_extendedprice")
    return tidy(reshape.pivot(rows, ["intensity"], "period", [n for n, *_ in SPANS], "l_extendedprice"))


@query(f"""WITH e AS (SELECT quantile_cont(l_quantity, 0.0) AS e0, quantile_cont(l_quantity, 1.0 / 3) AS e1, quantile_cont(l_quantity, 2.0 / 3) AS e2, quantile_cont(l_quantity, 1.0) AS e3 FROM lineitem)
SELECT CAST(CASE WHEN l_quantity <= e1 THEN 0 WHEN l_quantity <= e2 THEN 1 ELSE 2 END AS BIGINT) AS tertile, count(*) AS n, {r("avg(l_extendedprice)", "mean_price")} FROM lineitem, e GROUP BY 1""")
def tertile_bin_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = binning.qcut(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", 3, "tertile")
    return tidy(rows.groupBy("tertile").agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("mean_price")))


@query(f"""WITH b AS (SELECT CAST(CASE WHEN l_discount < 0.02 THEN 0 WHEN l_discount < 0.05 THEN 1 WHEN l_discount < 0.08 THEN 2 ELSE 3 END AS BIGINT) AS klass, l_extendedprice AS v FROM lineitem),
s AS (SELECT klass, avg(v) AS mean, median(v) AS median, stddev_samp(v) AS std, count(v) AS count, count(*) AS size FROM b GROUP BY 1)
SELECT klass, {r("mean")}, {r("median")}, {r("std")}, count, size, {r("std / sqrt(count)", "sem")}, {r("1.96 * std / sqrt(count)", "ci95")} FROM s""")
def class_bin_left_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(binning.cut(F.col("l_discount"), [0, 0.02, 0.05, 0.08, 1], right=False).alias("klass"), "l_extendedprice")
    return tidy(aggregates.summary(rows, ["klass"], "l_extendedprice"))


@query(f"""WITH {FACTS}, m AS (SELECT region, year, avg(o_totalprice) AS m FROM facts GROUP BY 1, 2)
SELECT year, {r("avg(m)", "mean_of_means")}, count(*) AS n_regions FROM m GROUP BY 1""")
def mean_of_regional_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(aggregates.mean_of_means(facts(spark, sf_dir), "region", "year", "o_totalprice"))


@query(f"""WITH {FACTS}, n AS (SELECT region, o_orderpriority, count(*) AS n FROM facts GROUP BY 1, 2)
SELECT region, o_orderpriority, n, {r("n / sum(n) OVER (PARTITION BY region)", "share")} FROM n""")
def group_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(aggregates.group_share(facts(spark, sf_dir), ["region"], ["o_orderpriority"]))


@query(f"""WITH n AS (SELECT month(o_orderdate) AS month, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1),
d AS (SELECT m AS month, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, 14)) AS m) LEFT JOIN n ON month = m)
SELECT month, n, {r("n / nullif(sum(n) OVER (), 0) * 100", "percent")} FROM d""")
def monthly_counts_over_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.month("o_orderdate").cast("long").alias("month"))
    return tidy(aggregates.counts_over_domain(rows, "month", spark.range(1, 14).withColumnRenamed("id", "month")))


@query("""WITH f AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1), g AS (SELECT o_custkey, row_number() OVER (ORDER BY k, o_custkey) - 1 AS group_id FROM f)
SELECT o_orderkey, o_custkey, group_id FROM orders JOIN g USING (o_custkey)""")
def ngroup_first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.group_number(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], "o_orderkey").select("o_orderkey", "o_custkey", "group_id")


@query(f"""SELECT l_orderkey, l_extendedprice, l_returnflag, {r("l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag)", "within")} FROM lineitem""")
def demean_within_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(windows.demean(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_returnflag"), ["l_returnflag"], "l_extendedprice"))


@query(f"""WITH k AS (SELECT l_returnflag,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS ry FROM lineitem)
SELECT l_returnflag, {r("corr(rx, ry)", "rho")}, count(*) AS n FROM k GROUP BY 1""")
def spearman_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(aggregates.spearman(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


@query(f"""WITH s AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n,
  regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem GROUP BY 1),
e AS (SELECT *, sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS se FROM s)
SELECT l_returnflag, {r("slope")}, {r("intercept")}, {r("r2")}, n, n - 2 AS df, {r("se")}, {r("slope / se", "t")} FROM e""")
def ols_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(aggregates.simple_ols(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


@query(f"""WITH s AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_discount) AS slope, regr_intercept(l_extendedprice, l_discount) AS intercept, regr_r2(l_extendedprice, l_discount) AS r2, count(*) AS n, regr_sxx(l_extendedprice, l_discount) AS xx, regr_syy(l_extendedprice, l_discount) AS yy, regr_sxy(l_extendedprice, l_discount) AS xy FROM lineitem GROUP BY 1),
t AS (SELECT *, sqrt((yy - xy * xy / xx) / (n - 2) / xx) AS se FROM s)
SELECT l_returnflag, {r("slope", digits=2)}, {r("intercept", digits=2)}, {r("r2")}, n, n - 2 AS df, {r("se", digits=2)}, {r("slope / se", "t")}, abs(slope / se) > 1.9605 AS significant FROM t""")
def ols_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.with_p_value(aggregates.simple_ols(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_extendedprice"))
    out = out.withColumn("significant", F.col("p") < 0.05).drop("p")  # hundreds of rows a group: t and normal agree; the values of p are tested apart
    return tidy(out.withColumns({c: F.round(F.col(c) + NUDGE, 2) for c in ("slope", "intercept", "se")}))


@query(f"""WITH c AS (SELECT l_linestatus, corr(l_extendedprice, l_quantity) AS ya, corr(l_extendedprice, l_tax) AS yb, corr(l_quantity, l_tax) AS ab, count(*) AS n FROM lineitem GROUP BY 1),
b AS (SELECT *, (ya * ya + yb * yb - 2 * ya * yb * ab) / (1 - ab * ab) AS both_r2 FROM c)
SELECT l_linestatus, n, {r("ya * ya", "r2_a")}, {r("both_r2", "r2_ab")}, {r("greatest(both_r2 - ya * ya, 0)", "r2_added")} FROM b""")
def two_regressor_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(aggregates.two_regressor_r2(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_extendedprice", "l_quantity", "l_tax"))


@query(f"""WITH c AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS a, corr(l_discount, l_extendedprice) AS b, corr(l_tax, l_extendedprice) AS c FROM lineitem GROUP BY 1)
SELECT l_returnflag, CASE WHEN a > 0 AND a >= coalesce(CASE WHEN b > 0 THEN b END, 0) AND a >= coalesce(CASE WHEN c > 0 THEN c END, 0) THEN 'l_quantity' WHEN b > 0 AND b >= coalesce(CASE WHEN c > 0 THEN c END, 0) THEN 'l_discount' WHEN c > 0 THEN 'l_tax' ELSE '' END AS strongest,
  {r("CASE WHEN greatest(a, b, c) > 0 THEN greatest(a, b, c) END", "rho")} FROM c""")
def strongest_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(aggregates.strongest(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"))


_PARTS = "CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(least(day(o_orderdate), 30) AS BIGINT) AS d"


@query(f"""WITH p AS (SELECT o_orderkey, {_PARTS} FROM orders)
SELECT o_orderkey, y + CASE WHEN m = 12 THEN 1 ELSE 0 END AS hydro_year, y * 360 + (m - 1) * 30 + d - 1 AS day360, (m % 12) * 30 + d AS hydro_day,
  CASE WHEN m IN (12, 1, 2) THEN 'djf' WHEN m <= 5 THEN 'mam' WHEN m <= 8 THEN 'jja' ELSE 'son' END AS season FROM p""")
def hydro_year_and_day360(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, m, d = F.year("o_orderdate"), F.month("o_orderdate"), F.least(F.dayofmonth("o_orderdate"), F.lit(30))
    return tidy(table(spark, sf_dir, "orders").select("o_orderkey", calendar360.hydro_year(y, m).alias("hydro_year"), calendar360.day360(y, m, d).alias("day360"), calendar360.day_of_year(m, d, True).alias("hydro_day"), calendar360.season(m).alias("season")))


@query(f"""WITH p AS (SELECT o_orderpriority, ((month(o_orderdate) - 1) * 30 + least(day(o_orderdate), 30) - 1) * (2 * pi() / 360) AS a FROM orders),
s AS (SELECT o_orderpriority, avg(sin(a)) AS s, avg(cos(a)) AS c, count(*) AS n FROM p GROUP BY 1)
SELECT o_orderpriority, {r("(atan2(s, c) + CASE WHEN atan2(s, c) < 0 THEN 2 * pi() ELSE 0 END) / (2 * pi()) * 360 + 1", "mean_day")}, {r("sqrt(s * s + c * c)", "concentration")}, n FROM s""")
def circular_mean_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    day = calendar360.day_of_year(F.month("o_orderdate"), F.least(F.dayofmonth("o_orderdate"), F.lit(30)))
    return tidy(aggregates.circular_mean(rows, ["o_orderpriority"], calendar360.angle(day)))


@query(f"""WITH {FACTS}, p AS (SELECT region, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'djf' WHEN month(o_orderdate) <= 5 THEN 'mam' WHEN month(o_orderdate) <= 8 THEN 'jja' ELSE 'son' END AS season,
  year + CASE WHEN month(o_orderdate) = 12 THEN 1 ELSE 0 END AS season_year, o_totalprice FROM facts)
SELECT region, season, season_year, {r("avg(o_totalprice)", "mean_price")}, count(*) AS n FROM p GROUP BY 1, 2, 3""")
def season_year_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.month("o_orderdate")
    keys = [F.col("region"), calendar360.season(m).alias("season"), calendar360.season_year(F.col("year"), m).alias("season_year")]
    return tidy(facts(spark, sf_dir).groupBy(*keys).agg(F.avg("o_totalprice").alias("mean_price"), F.count("*").alias("n")))


@query(f"""WITH {FACTS}, m AS (SELECT month(o_orderdate) AS month, region, avg(o_totalprice) AS m FROM facts GROUP BY 1, 2)
SELECT month, {r("avg(m)", "clim_mean")}, {r("stddev_pop(m)", "clim_std")} FROM m GROUP BY 1""")
def climatology_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).withColumn("month", F.month("o_orderdate"))
    return tidy(aggregates.climatology(rows, ["month"], ["region"], "o_totalprice"))


@query(f"""WITH {FACTS}, s AS (SELECT region, c_mktsegment, count(*) AS total, count(*) FILTER (o_totalprice > 400000) AS n_over FROM facts GROUP BY 1, 2)
SELECT region, c_mktsegment, total, n_over, {r("n_over / total * 100", "percent", 1)} FROM s WHERE n_over > 0""")
def problem_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(aggregates.problem_combos(facts(spark, sf_dir), ["region", "c_mktsegment"], "o_totalprice", 400000.0))


@query(f"""WITH {FACTS} SELECT region, c_mktsegment, o_orderkey, o_totalprice FROM facts WHERE o_totalprice > 400000""")
def problem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.offending(facts(spark, sf_dir), ["region", "c_mktsegment"], "o_totalprice", "o_orderkey", 400000.0)


@query(f"""WITH n AS (SELECT l_quantity, count(*) AS n, count(*) FILTER (l_extendedprice > 50000) AS k FROM lineitem GROUP BY 1)
SELECT l_quantity, n, k, {r("(k / sum(k) OVER ()) / (n / sum(n) OVER ())", "enrichment")} FROM n""")
def enrichment_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(aggregates.enrichment(table(spark, sf_dir, "lineitem"), "l_quantity", F.col("l_extendedprice") > 50000))


@query("""WITH d AS (SELECT count(*) FILTER (o_orderkey % 10 = 0) AS gone, count(*) FILTER (o_orderkey % 10 <> 0 AND o_orderkey % 7 = 0) AS moved, count(*) FILTER (o_orderkey % 10 <> 0 AND o_orderkey % 11 = 0) AS renamed FROM orders)
SELECT 'o_totalprice' AS "column", gone + moved AS n_diff, CASE WHEN moved > 0 THEN 1.0 END AS max_abs_diff, CASE WHEN gone + moved = 0 THEN 'ok' ELSE 'DIFF' END AS status FROM d
UNION ALL SELECT 'o_orderpriority', gone + renamed, NULL, CASE WHEN gone + renamed = 0 THEN 'ok' ELSE 'DIFF' END FROM d
UNION ALL SELECT 'o_orderstatus', gone, NULL, CASE WHEN gone = 0 THEN 'ok' ELSE 'DIFF' END FROM d""")
def dataset_diff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders")
    new = old.where("o_orderkey % 10 <> 0").withColumns({"o_totalprice": F.col("o_totalprice") + F.when(F.col("o_orderkey") % 7 == 0, 1.0).otherwise(0.0), "o_orderpriority": F.when(F.col("o_orderkey") % 11 == 0, "other").otherwise(F.col("o_orderpriority"))})
    return tidy(aggregates.diff_report(old, new, ["o_orderkey"], ["o_totalprice", "o_orderpriority", "o_orderstatus"], rtol=0.0, atol=0.5))


_DAY = "CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)"


def _order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("long").alias("day"))


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, {_DAY} AS day FROM orders)
SELECT a.o_orderkey, count(*) AS n_before, {r("sum(b.o_totalprice)", "spent_before")} FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.day >= a.day - 180 AND b.day < a.day GROUP BY 1""")
def event_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _order_days(spark, sf_dir)
    spans = orders.select("o_orderkey", "o_custkey", (F.col("day") - 180).alias("start"), F.col("day").alias("stop"))
    hit = joins.interval_join(orders.select("o_custkey", "day", "o_totalprice"), spans, ["o_custkey"], "day", "start", "stop", 180)
    return tidy(hit.groupBy("o_orderkey").agg(F.count("*").alias("n_before"), F.sum("o_totalprice").alias("spent_before")))


@query("""WITH big AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM big)""")
def semi_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.remaining(table(spark, sf_dir, "customer"), done, ["c_custkey"]).select("c_custkey", "c_name")


@query("""WITH a AS (SELECT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1995), b AS (SELECT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1996)
SELECT 'both' AS part, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'first' AS part, k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'second' AS part, k FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def key_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (table(spark, sf_dir, "orders").where(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("k")) for y in (1995, 1996))
    return reshape.stack([a.intersect(b), a.subtract(b), b.subtract(a)], ["both", "first", "second"]).select(F.col("source").alias("part"), "k")


@query("""WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders), b AS (SELECT o_totalprice AS price, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS k FROM orders)
SELECT o_orderkey, price FROM a JOIN b USING (k)""")
def positional_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    prices = orders.select(F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("key"))
    return joins.bind_columns(orders.select("o_orderkey"), prices, ["o_orderkey"], ["price", "key"]).select("o_orderkey", "price")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def topk_first_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 25)


@query("""SELECT c_custkey, CASE WHEN abs(c_acctbal) / 100 >= c_nationkey AND abs(c_acctbal) / 100 >= 10 THEN 'balance' WHEN c_nationkey >= 10 THEN 'nation' ELSE 'fixed' END AS dominant FROM customer""")
def dominant_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("balance"), F.col("c_nationkey").cast("double").alias("nation"), F.lit(10.0).alias("fixed"))
    return windows.dominant(rows, ["balance", "nation", "fixed"]).select("c_custkey", "dominant")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1""")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return windows.keep_first(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(f"""SELECT o_orderkey, o_orderpriority, {r("row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) / count(*) OVER (PARTITION BY o_orderpriority)", "ecdf")} FROM orders""")
def ecdf_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return tidy(windows.ecdf(rows, ["o_orderpriority"], "o_totalprice", ["o_orderkey"]).drop("o_totalprice"))


@query("""SELECT o_orderkey, regexp_extract(name, 'res_(\\d+)_(\\d{4})', 1) AS catchment, regexp_extract(name, 'res_(\\d+)_(\\d{4})', 2) AS year
FROM (SELECT o_orderkey, 'res_' || o_custkey || '_' || year(o_orderdate) || '.csv' AS name FROM orders)""")
def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("res_"), F.col("o_custkey"), F.lit("_"), F.year("o_orderdate"), F.lit(".csv")).alias("name"))
    return rows.withColumns(name_parts(F.col("name"), r"res_(\d+)_(\d{4})", ("catchment", "year"))).drop("name")


#: Rectangles over (nation, balance): name, x from and to, y from and to.
RECTANGLES = (("low", 0.0, 10.0, -1000.0, 2000.0), ("mid", 5.0, 15.0, 1000.0, 6000.0), ("high", 12.0, 24.0, 5000.0, 9999.0))


@query("SELECT c_custkey, zone FROM customer LEFT JOIN (VALUES " + ", ".join(str(x) for x in RECTANGLES) + ") p(zone, x0, x1, y0, y1) ON c_nationkey > x0 AND c_nationkey < x1 AND c_acctbal > y0 AND c_acctbal < y1")
def point_in_region_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, a, c, b, d, [[(a, c), (b, c), (b, d), (a, d)]]) for n, a, b, c, d in RECTANGLES]
    polygons = spark.createDataFrame(rows, "zone string, minx double, miny double, maxx double, maxy double, rings array<array<struct<x: double, y: double>>>")
    points = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("x"), F.col("c_acctbal").alias("y"))
    return joins.points_in_polygons(points, polygons, "x", "y").select("c_custkey", "zone")


@query(f"""WITH {FACTS}, f AS (SELECT region, o_orderkey, o_totalprice / 1000 AS price, c_acctbal / 1000 AS balance, year FROM facts),
h AS (SELECT a.region, a.o_orderkey, b.o_orderkey AS match, sqrt((a.price - b.price) * (a.price - b.price) + (a.balance - b.balance) * (a.balance - b.balance)) AS distance
  FROM f a JOIN f b ON a.region = b.region AND a.year >= 2000 AND b.year <= 1996 AND b.price BETWEEN a.price - 0.5 AND a.price + 0.5)
SELECT region, o_orderkey, match, {r("distance")} FROM (SELECT *, row_number() OVER (PARTITION BY region, o_orderkey ORDER BY distance, match) AS k FROM h WHERE distance <= 0.5) WHERE k = 1""")
def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).select("region", "o_orderkey", (F.col("o_totalprice") / 1000).alias("price"), (F.col("c_acctbal") / 1000).alias("balance"), "year")
    return tidy(joins.nearest_within_blocks(rows.where("year >= 2000"), rows.where("year <= 1996"), ["region"], ["price", "balance"], "o_orderkey", 0.5))
