"""Queries that describe, compare and test groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binning
from ..ml import explain, models
from ..operators import aggregates, inference, joins, reshape
from .base import FACTS, facts, query, r, table, tidy

_Q = ("l_quantity", "l_discount", "l_tax")


@query(f"""SELECT o_orderpriority, count(*) AS count, {r("avg(o_totalprice)", "mean")}, {r("stddev_samp(o_totalprice)", "std")}, min(o_totalprice) AS min, max(o_totalprice) AS max, {r("quantile_cont(o_totalprice, 0.1)", "p10")}, {r("quantile_cont(o_totalprice, 0.5)", "p50")}, {r("quantile_cont(o_totalprice, 0.9)", "p90")} FROM orders GROUP BY 1""")
def describe_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(inference.describe(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice"))


@query("""SELECT l_returnflag, count(DISTINCT l_partkey) AS n_l_partkey, count(DISTINCT l_suppkey) AS n_l_suppkey FROM lineitem GROUP BY 1""")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.distinct_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_partkey", "l_suppkey"])


@query("""SELECT CAST(k AS BIGINT) AS k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1""")
def merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(inference.merged_counts([table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))], "k"))


@query("""SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.most_frequent(table(spark, sf_dir, "orders"), "o_custkey")


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)
SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice <= a THEN 'low' ELSE 'high' END AS tail FROM orders, q WHERE o_totalprice <= a OR o_totalprice >= b""")
def quantile_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.tails(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("""WITH q AS (SELECT median(o_totalprice) AS m FROM orders) SELECT o_orderkey, CASE WHEN o_totalprice < m THEN 'low' ELSE 'high' END AS half, CASE WHEN o_totalprice < 100000 THEN 'small' ELSE 'large' END AS size FROM orders, q""")
def median_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inference.halves(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")
    return inference.halves(rows, "o_totalprice", "size", ("small", "large"), 100_000.0).drop("o_totalprice")


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem)
SELECT CAST(CASE WHEN k * 4 <= n - 1 THEN 0 WHEN k * 4 <= 2 * (n - 1) THEN 1 WHEN k * 4 <= 3 * (n - 1) THEN 2 ELSE 3 END AS BIGINT) AS bin, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high FROM k GROUP BY 1""")
def first_rank_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inference.first_rank_bins(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 4)
    return tidy(rows.groupBy("bin").agg(F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high")))


_EDGES = [1.0, 10.0, 20.0, 35.0, 50.0]


@query(f"""WITH b AS (SELECT CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN 1 WHEN l_quantity <= 35 THEN 2 ELSE 3 END AS bin, l_extendedprice AS v FROM lineitem WHERE l_quantity BETWEEN 1 AND 50)
SELECT CAST(bin AS BIGINT) AS bin, CAST([5.5, 15.0, 27.5, 42.5][bin + 1] AS DOUBLE) AS middle, count(*) AS n, {r("avg(v)", "mean")}, {r("1.96 * stddev_samp(v) / sqrt(count(*))", "ci95")} FROM b GROUP BY bin""")
def binned_means_with_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(inference.binned_means(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", _EDGES))


@query(f"""WITH b AS (SELECT l_returnflag, least(CAST(floor((l_extendedprice - 1000) / 2000) AS BIGINT), 49) AS bin, sum(l_quantity) AS weight FROM lineitem WHERE l_extendedprice BETWEEN 1000 AND 101000 GROUP BY 1, 2)
SELECT l_returnflag, bin, 1000 + (bin + 0.5) * 2000 + 0.0 AS centre, weight, {r("weight / sum(weight) OVER (PARTITION BY l_returnflag) / 2000", "density", 10)} FROM b""")
def weighted_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.histogram(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 1000.0, 101_000.0, 50, F.col("l_quantity"))
    return out.withColumn("density", F.round(F.col("density") + F.lit(1e-7), 10) + F.lit(0.0))


@query("""WITH b AS (SELECT CAST(floor(((month(o_orderdate) - 1) * 30 + least(day(o_orderdate), 30) - 1) / 15) AS BIGINT) AS bin FROM orders WHERE o_totalprice > 150000)
SELECT k AS bin, k * 15 + 8.0 AS centre, count(bin) AS n FROM (SELECT unnest(range(24)) AS k) LEFT JOIN b ON bin = k GROUP BY 1""")
def day_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_totalprice > 150000").select(((F.month("o_orderdate") - 1) * 30 + F.least(F.dayofmonth("o_orderdate"), F.lit(30))).alias("day"))
    return tidy(inference.day_bins(rows, "day", 15))


@query(f"""WITH {FACTS}, b AS (SELECT o_orderpriority, region, o_totalprice AS v, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS m FROM facts)
SELECT o_orderpriority, region, count(*) AS n, {r("avg(v) - any_value(m)", "deviation")}, {r("1.96 * stddev_samp(v) / sqrt(count(*))", "ci95")} FROM b GROUP BY 1, 2 HAVING count(*) >= 30""")
def bin_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(inference.bin_deviation(facts(spark, sf_dir), "o_orderpriority", "region", "o_totalprice"))


@query(f"""WITH a AS (SELECT CAST(month(o_orderdate) AS BIGINT) AS month, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT CAST(month(l_shipdate) AS BIGINT) AS month, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1),
p AS (SELECT month, a.n / (SELECT sum(n) FROM a) * 100 AS pa, b.n / (SELECT sum(n) FROM b) * 100 AS pb FROM a JOIN b USING (month))
SELECT month, {r("pa", "pct_a")}, {r("pb", "pct_b")}, {r("least(pa, pb)", "overlap")}, {r("pa - least(pa, pb)", "only_a")}, {r("pb - least(pa, pb)", "only_b")} FROM p""")
def monthly_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.month("o_orderdate").cast("long").alias("month"))
    b = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.month("l_shipdate").cast("long").alias("month"))
    return tidy(inference.monthly_overlap(a, b, "month"))


@query(f"""SELECT l_returnflag, {r("avg(abs(l_quantity - 25))", "mean_abs")}, count(*) AS n FROM lineitem GROUP BY 1""")
def mean_of_absolutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(aggregates.mean_abs(table(spark, sf_dir, "lineitem").withColumn("off", F.col("l_quantity") - 25), ["l_returnflag"], "off"))


@query("""SELECT l_suppkey % 10 AS x, l_suppkey // 10 AS y, median(l_extendedprice) AS median, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 20""")
def coordinate_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("x"), F.floor(F.col("l_suppkey") / 10).alias("y"), "l_extendedprice")
    return aggregates.medians(rows, ["x", "y"], "l_extendedprice", 20)


@query(f"""SELECT l_orderkey, l_partkey, l_suppkey, {r("l_quantity * l_discount", "interaction")} FROM lineitem""")
def interaction_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", binning.product(F.col("l_quantity"), F.col("l_discount")).alias("interaction")))


# ---------------------------------------------------------------- regression and correlation

#: Two regressors: the estimates by sums around the means, and HC3 errors by leverages.
_OLS2 = f"""WITH b AS (SELECT l_returnflag AS g, l_quantity AS a, l_discount AS b, l_extendedprice AS y FROM lineitem),
m AS (SELECT g, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM b GROUP BY g),
c AS (SELECT g, n, a - ma AS a, b - mb AS b, y - my AS y, ma, mb, my FROM b JOIN m USING (g)),
s AS (SELECT g, any_value(n) AS n, any_value(ma) AS ma, any_value(mb) AS mb, any_value(my) AS my, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS yb, sum(y * y) AS yy FROM c GROUP BY g),
t AS (SELECT *, aa * bb - ab * ab AS det, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ca, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM s),
e AS (SELECT c.g, t.n, ca, cb, det, aa, bb, ab, yy, c.a, c.b, c.y - ca * c.a - cb * c.b AS e, 1 / t.n + (c.a * c.a * bb - 2 * c.a * c.b * ab + c.b * c.b * aa) / det AS h FROM c JOIN t USING (g)),
v AS (SELECT g, any_value(n) AS n, any_value(ca) AS ca, any_value(cb) AS cb, 1 - sum(e * e) / any_value(yy) AS r2,
  sqrt(sum(e * e / ((1 - h) * (1 - h)) * ((a * bb - b * ab) / det) * ((a * bb - b * ab) / det))) AS sa, sqrt(sum(e * e / ((1 - h) * (1 - h)) * ((b * aa - a * ab) / det) * ((b * aa - a * ab) / det))) AS sb FROM e GROUP BY g),
l AS (SELECT g, n, r2, 'l_quantity' AS term, ca AS c, sa AS s FROM v UNION ALL SELECT g, n, r2, 'l_discount', cb, sb FROM v)
SELECT g AS l_returnflag, term, {r("c", "estimate", 3)}, {r("s", "se", 3)}, {r("c - 1.96 * s", "low", 3)}, {r("c + 1.96 * s", "high", 3)}, {r("r2")}, n FROM l"""


@query(_OLS2)
def robust_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.ols(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", ["l_quantity", "l_discount"]).where("term <> 'intercept'").drop("p")
    return tidy(tidy(out.select("l_returnflag", "term", "r2", "n"))).join(tidy(out.drop("r2", "n"), 3), ["l_returnflag", "term"])


_PAIRS = [(a, b) for i, a in enumerate((*_Q, "l_extendedprice")) for b in (*_Q, "l_extendedprice")[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'rho')} FROM lineitem" for a, b in _PAIRS))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(inference.correlation_matrix(table(spark, sf_dir, "lineitem"), [*_Q, "l_extendedprice"]))


def _ranks(*columns: str) -> str:
    return "k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in columns) + " FROM lineitem)"


@query(f"WITH {_ranks(*_Q)} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'rho')} FROM k" for i, a in enumerate(_Q) for b in _Q[i + 1 :]))
def rank_correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(inference.correlation_matrix(table(spark, sf_dir, "lineitem"), _Q, "spearman"))


@query(f"""WITH m AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS rho FROM lineitem" for a, b in _PAIRS)})
SELECT 'price' AS "group", {r("avg(rho)", "mean_rho")}, {r("min(abs(rho))", "least_abs_rho")}, sign(avg(rho)) + 0.0 AS sign FROM m WHERE a <> 'l_discount' AND b <> 'l_discount' GROUP BY 1""")
def group_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = inference.correlation_matrix(table(spark, sf_dir, "lineitem"), [*_Q, "l_extendedprice"])
    return tidy(inference.group_cohesion(matrix, {"price": ["l_quantity", "l_tax", "l_extendedprice"], "rest": ["l_discount"]}))


@query(f"""WITH k AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS b FROM lineitem)
SELECT l_returnflag, {r("corr(a, b)", "rho")}, count(*) AS n, abs(corr(a, b)) * sqrt((count(*) - 2) / (1 - corr(a, b) * corr(a, b))) > 1.9605 AS significant FROM k GROUP BY 1""")
def spearman_with_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.spearman_test(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return tidy(out.withColumn("significant", F.col("p") < 0.05).drop("p"))  # hundreds of rows a group: t and normal agree


@query(f"""WITH k AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice + 1000 * l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice + 1000 * l_quantity) - 1) / 2 AS b FROM lineitem)
SELECT l_returnflag, 'l_quantity' AS critical, {r("corr(a, b)", "rho")} FROM k GROUP BY 1""")
def critical_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns({"minus": -F.col("l_quantity"), "y": F.col("l_extendedprice") + 1000 * F.col("l_quantity")})
    return tidy(inference.critical_candidate(rows, ["l_returnflag"], ["minus", "l_quantity", "l_tax"], "y"))


@query(f"""WITH s AS (SELECT avg(l_quantity) AS ma, stddev_pop(l_quantity) AS sa, avg(l_extendedprice) AS mb, stddev_pop(l_extendedprice) AS sb, avg(l_tax) AS mc, stddev_pop(l_tax) AS sc, sign(corr(l_quantity, l_extendedprice)) AS g FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, {r("((l_quantity - ma) / sa + g * (l_extendedprice - mb) / sb) / 2", "size")}, {r("(l_tax - mc) / sc", "tax")} FROM lineitem, s""")
def grouped_colour_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax")
    return tidy(inference.grouped_value(rows, {"size": ["l_quantity", "l_extendedprice"], "tax": ["l_tax"]}).select("l_orderkey", "l_partkey", "l_suppkey", "size", "tax"))


# ---------------------------------------------------------------- effects


@query(f"""WITH {FACTS}, s AS (SELECT region, avg(o_totalprice) FILTER (year < 1998) AS me, var_pop(o_totalprice) FILTER (year < 1998) AS ve, count(*) FILTER (year < 1998) AS ne, avg(o_totalprice) FILTER (year >= 1998) AS ml, var_pop(o_totalprice) FILTER (year >= 1998) AS vl, count(*) FILTER (year >= 1998) AS nl FROM facts GROUP BY 1),
t AS (SELECT *, sqrt(ve / ne / ((1 - 1 / ne) * (1 - 1 / ne)) + vl / nl / ((1 - 1 / nl) * (1 - 1 / nl))) AS se FROM s)
SELECT region, {r("(ml - me) / abs(me) * 100", "effect_pct")}, {r("(ml - me - 1.96 * se) / abs(me) * 100", "low_pct")}, {r("(ml - me + 1.96 * se) / abs(me) * 100", "high_pct")}, ne AS n_early, nl AS n_late FROM t""")
def late_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(inference.effect(facts(spark, sf_dir), ["region"], F.col("year") >= 1998, "o_totalprice"))


@query(f"""WITH {FACTS}, b AS (SELECT region AS g, CASE WHEN year >= 1998 THEN 1.0 ELSE 0.0 END AS a, c_acctbal AS b, o_totalprice AS y FROM facts), m AS (SELECT g, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM b GROUP BY g),
c AS (SELECT g, n, a - ma AS a, b - mb AS b, y - my AS y FROM b JOIN m USING (g)),
s AS (SELECT g, any_value(n) AS n, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS yb FROM c GROUP BY g),
t AS (SELECT *, aa * bb - ab * ab AS det, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ca, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM s),
e AS (SELECT c.g, ca, det, bb, ab, c.a, c.b, c.y - ca * c.a - cb * c.b AS e, 1 / t.n + (c.a * c.a * bb - 2 * c.a * c.b * ab + c.b * c.b * aa) / det AS h FROM c JOIN t USING (g)),
v AS (SELECT g, any_value(ca) AS c, sqrt(sum(e * e / ((1 - h) * (1 - h)) * ((a * bb - b * ab) / det) * ((a * bb - b * ab) / det))) AS s FROM e GROUP BY g),
k AS (SELECT g, avg(y) FILTER (a = 0) AS me, count(*) FILTER (a = 0) AS n_early, count(*) FILTER (a = 1) AS n_late FROM b GROUP BY g)
SELECT g AS region, {r("c / abs(me) * 100", "effect_pct")}, {r("(c - 1.96 * s) / abs(me) * 100", "low_pct")}, {r("(c + 1.96 * s) / abs(me) * 100", "high_pct")}, n_early, n_late FROM v JOIN k USING (g)""")
def late_effect_with_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(inference.effect(facts(spark, sf_dir), ["region"], F.col("year") >= 1998, "o_totalprice", ["c_acctbal"]))


@query(f"""WITH p AS (SELECT s_suppkey AS k, CAST(s_nationkey AS DOUBLE) AS x, s_acctbal AS y FROM supplier),
lines AS (SELECT DISTINCT (b.y - a.y) / (b.x - a.x) AS slope, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS intercept FROM p a JOIN p b ON a.x < b.x),
fits AS (SELECT slope, intercept, sum(abs(y - intercept - slope * x)) AS objective FROM lines, p GROUP BY 1, 2),
best AS (SELECT * FROM fits ORDER BY objective LIMIT 1)
SELECT 'intercept' AS term, {r("intercept", "estimate", 3)}, {r("objective", digits=3)}, true AS proved FROM best UNION ALL SELECT 'x', {r("slope", "estimate", 3)}, {r("objective", digits=3)}, true FROM best""")
def median_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = inference.median_regression(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("double").alias("x"), "s_acctbal"), "s_acctbal", ["x"])
    proved = abs(fit.gap) <= 1e-6 * (1 + fit.objective)
    return tidy(spark.createDataFrame([(t, v, fit.objective, proved) for t, v in fit.coefficients.items()], "term string, estimate double, objective double, proved boolean"), 3)


@query(" UNION ALL ".join(f"SELECT '{f}' AS feature, {r(f'''(avg({f}) FILTER (l_returnflag = 'R') - avg({f}) FILTER (l_returnflag <> 'R')) / sqrt((var_samp({f}) FILTER (l_returnflag = 'R') + var_samp({f}) FILTER (l_returnflag <> 'R')) / 2)''', 'smd')} FROM lineitem" for f in _Q))
def balance_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(inference.balance(table(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "R", _Q))


@query()
def placebo_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") - 5000).alias("gap"))
    return tidy(inference.placebo(rows, "gap", "s_suppkey", 50))


@query()
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(inference.block_bootstrap(facts(spark, sf_dir).withColumn("o_totalprice", F.round("o_totalprice", -3)), ["region"], "year", "o_totalprice", (1995, 1997), (1998, 2000), 50))


@query("""WITH RECURSIVE l AS (SELECT s_suppkey AS late, s_acctbal AS a, CAST(s_nationkey AS BIGINT) AS nation, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier WHERE s_suppkey % 2 = 1), e AS (SELECT s_suppkey AS early, s_acctbal AS b, CAST(s_nationkey AS BIGINT) AS nation FROM supplier WHERE s_suppkey % 2 = 0),
t AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS late, CAST(NULL AS BIGINT) AS early
  UNION ALL SELECT t.k + 1, CASE WHEN n.early IS NULL THEN taken ELSE list_append(taken, n.early) END, n.late, n.early FROM t, LATERAL (
    SELECT l.late, (SELECT min_by(e.early, struct_pack(d := abs(e.b - l.a), i := e.early)) FROM e WHERE e.nation = l.nation AND abs(e.b - l.a) <= 3000 AND NOT list_contains(t.taken, e.early)) AS early FROM l WHERE l.k = t.k + 1) n)
SELECT l.nation, t.late, t.early, round(abs(a - b), 4) + 0.0 AS distance FROM t JOIN l ON l.late = t.late JOIN e ON e.early = t.early""")
def greedy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("nation"), "s_suppkey", "s_acctbal")
    return tidy(inference.greedy_matches(s.where("s_suppkey % 2 = 1"), s.where("s_suppkey % 2 = 0"), ["nation"], ["s_acctbal"], "s_suppkey", "s_suppkey", 3000.0))


# ---------------------------------------------------------------- shapes of tables


@query(f"""WITH t AS (SELECT o_orderpriority AS p, {r("avg(o_totalprice)", "mean")}, {r("max(o_totalprice)", "max")}, {r("min(o_totalprice)", "min")} FROM orders GROUP BY 1), l AS (UNPIVOT t ON mean, max, min INTO NAME stat VALUE v)
SELECT stat, {", ".join(f"max(v) FILTER (p = '{p}') AS " + chr(34) + p + chr(34) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))} FROM l GROUP BY 1""")
def transposed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tidy(table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("max"), F.min("o_totalprice").alias("min")))
    return reshape.transpose(t, "o_orderpriority", ["mean", "max", "min"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "stat")


@query("""SELECT l_returnflag, """ + ", ".join(f"sum(l_quantity) FILTER (l_linenumber = {k} AND l_linestatus = '{s}') AS \"{k}cm_{s}\"" for k in (1, 3) for s in "OF") + " FROM lineitem GROUP BY 1")
def wide_by_depth_and_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.wide_by_two(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber", "l_linestatus", [(k, s) for k in (1, 3) for s in "OF"], "l_quantity")


@query("""SELECT o_orderpriority AS priority, count(*) AS n_all, max(o_totalprice) AS top_all FROM orders GROUP BY 1""")
def unpacked_and_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.struct(F.count("*").alias("n"), F.max("o_totalprice").alias("top"), F.lit(1).alias("spare")).alias("m"))
    return reshape.renamed(reshape.unpacked(rows, "m"), {"o_orderpriority": "priority", "absent": "x"}, "_all", without=["spare", "nothing"])


@query("""SELECT CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END AS place, count(*) AS n FROM orders GROUP BY 1""")
def domain_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = reshape.ordered(table(spark, sf_dir, "orders").select("o_orderpriority").distinct(), "o_orderpriority", ["5-LOW", "1-URGENT"])
    placed = joins.with_place(ordered, [F.coalesce(F.when(F.col("o_orderpriority") == "5-LOW", 0), F.when(F.col("o_orderpriority") == "1-URGENT", 1), F.lit(2)), "o_orderpriority"], "place")
    n = table(spark, sf_dir, "orders").join(F.broadcast(placed.withColumn("place", F.least("place", F.lit(2)))), "o_orderpriority")
    return tidy(n.groupBy(F.col("place").cast("long").alias("place")).agg(F.count("*").alias("n")))


# ---------------------------------------------------------------- models


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.xxhash64("*").alias("key"), *_Q, "l_extendedprice", "l_returnflag")


@query()
def hold_out_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.split_scores(_sample(spark, sf_dir), "linear", _Q, "l_extendedprice", "key")


@query()
def random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.random_search(_sample(spark, sf_dir), "forest", _Q, "l_extendedprice", "key", {"maxDepth": [2, 4], "numTrees": [3]}, 2, 2)


@query()
def gain_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.gain_by_class(_sample(spark, sf_dir), "linear", ["l_tax"], ["l_quantity"], "l_extendedprice", "key", "l_returnflag", 2)


@query()
def shap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute shares of a forest's predictions by class and feature, and of grouped features."""
    rows, ready = _sample(spark, sf_dir), models.regressor("forest", _Q, "l_extendedprice", numTrees=5, maxDepth=4)
    fit = ready.fit(rows)
    known = explain.share_columns(explain.with_shares(fit.stages[-1], fit.transform(rows).select("l_returnflag", "_features"), "_features"), _Q)
    both = explain.share_columns(known, _Q, {"price": ["l_discount", "l_tax"]})
    return tidy(explain.share_summary(both, [*_Q, "price"], ["l_returnflag"]))


@query()
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and deviations of a linear model's scores over three folds."""
    return tidy(models.fold_summary(models.out_of_fold(_sample(spark, sf_dir), "linear", _Q, "l_extendedprice", "key", 3), "l_extendedprice"))


@query()
def cluster_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.cluster_sweep(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("double").alias("nation"), "s_acctbal"), ["nation", "s_acctbal"], (2, 4))


@query("""WITH p AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0), f AS (SELECT c_mktsegment, min(c_custkey) AS m FROM p GROUP BY 1), n AS (SELECT c_mktsegment, row_number() OVER (ORDER BY m, c_mktsegment) - 1 AS group_id FROM f)
SELECT p.*, group_id FROM p JOIN n USING (c_mktsegment)""")
def prepared_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.prepared(table(spark, sf_dir, "customer"), "c_acctbal", ["c_name", "c_nationkey"], "c_mktsegment", "c_custkey", True).select("c_custkey", "c_acctbal", "c_mktsegment", "group_id")
