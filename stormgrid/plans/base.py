"""What the registered queries share: the registry, tables, and rounding on both sides of a comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Decimals that results of sums over doubles are rounded to, and what is added before, so that exact halves go up in every engine.
DIGITS, NUDGE = 4, 1e-7


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that says the same."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded (and no negative zero), whole numbers as long."""
    made = {"double": lambda c: F.round(c + F.lit(NUDGE), digits) + F.lit(0.0), "float": lambda c: F.round(c.cast("double") + F.lit(NUDGE), digits) + F.lit(0.0), "int": lambda c: c.cast("long"), "smallint": lambda c: c.cast("long")}
    return df.select(*[made[t](F.col(c)).alias(c) if t in made else F.col(c) for c, t in df.dtypes])


def r(expr: str, name: str | None = None, digits: int = DIGITS) -> str:
    """SQL for a rounded column."""
    return f"round({expr} + {NUDGE}, {digits}) + 0.0 AS {name or expr}"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with customer, nation, region and year: the event table with region and response."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    out = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, F.col("c_nationkey") == nation["n_nationkey"]).join(region, F.col("n_regionkey") == region["r_regionkey"])
    return out.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus", "c_acctbal", "c_mktsegment", "c_nationkey", F.col("r_name").alias("region"), F.year("o_orderdate").alias("year"))


#: The same as a common table expression.
FACTS = """facts AS (
  SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, o_orderstatus, c_acctbal, c_mktsegment, c_nationkey,
         r_name AS region, CAST(year(o_orderdate) AS BIGINT) AS year
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, d, series: 24 hourly totals, 0 for hours without a row. One shuffle of partial sums."""
    hours = [F.round(F.coalesce(F.sum(F.when(F.hour("ts") == h, F.col("value"))), F.lit(0.0)), 4) for h in range(24)]
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.array(*hours).alias("series"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, a row per hour: event_type, d, h, v."""
    return series(spark, sf_dir).select("event_type", "d", F.posexplode("series").alias("h", "v"))


SERIES = """hours AS (SELECT event_type, CAST(ts AS DATE) AS d, CAST(hour(ts) AS BIGINT) AS h, round(sum(value), 4) AS v FROM events GROUP BY 1, 2, 3),
series AS (
  SELECT k.event_type, k.d, g.h, coalesce(s.v, 0.0) AS v
  FROM (SELECT DISTINCT event_type, d FROM hours) k CROSS JOIN (SELECT unnest(range(24)) AS h) g LEFT JOIN hours s ON s.event_type = k.event_type AND s.d = k.d AND s.h = g.h
)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, day (from 0), total of each day."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("day")).agg(F.round(F.sum("value"), 4).alias("total"))


DAILY = """daily AS (
  SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event (a year), y, x, value: quantities shipped by each supplier, suppliers laid out ten to a row."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.year("l_shipdate").cast("long").alias("event"), F.floor(F.col("l_suppkey") / 10).alias("y"), (F.col("l_suppkey") % 10).alias("x")).agg(F.sum("l_quantity").alias("value"))


CELLS = """cells AS (
  SELECT CAST(year(l_shipdate) AS BIGINT) AS event, l_suppkey // 10 AS y, l_suppkey % 10 AS x, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3
)"""

#: The peak cell of each event: the largest value, the first in (y, x) of equals.
PEAKS = """peaks AS (
  SELECT event, y AS peak_y, x AS peak_x, value AS peak_value FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY value DESC, y, x) AS k FROM cells) WHERE k = 1 AND value > 0
)"""
