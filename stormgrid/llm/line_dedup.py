"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A line is boilerplate on a site if more than this share of the site's pages contain it, and at least so many pages.
RATIO, LEAST_PAGES = 0.02, 3


def boilerplate_lines(df: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """(site, line_md5, pages, total): lines in more than `ratio` of their site's pages.

    Lines are compared without the spaces around them; a page counts once for
    each line; blank lines never count. Counts are combined map-side over
    (site, line), so a hot site or a hot line is spread over all tasks.
    """
    pages = df.select(F.coalesce(F.col(site), F.lit("")).alias("site"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = pages.groupBy("site").agg(F.count("*").alias("total"))
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    held = pages.select("site", F.explode(F.transform(lines, lambda x: F.unhex(F.md5(x)))).alias("line_md5")).groupBy("site", "line_md5").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    return held.join(total, "site").where(F.col("pages") > ratio * F.col("total"))


def host_of(url: Column) -> Column:
    """The host of a page's address, lower-cased, as its site; NULL if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def drop_boilerplate(df: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES, spare_copies: bool = False, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """Every row with its boilerplate lines taken out of the text, in a column order like df's, plus two columns of counts: lines, and lines dropped. Columns of df that have the counts' names are replaced.

    Each site's boilerplate is one short array: a line is in over `ratio` of the
    pages, so a site has at most (lines per page) / ratio of them. The arrays are
    written first, so that Spark knows their size before it plans the join on
    site: it broadcasts them where they are below its threshold, without moving
    any text, and else joins by shuffle, where it splits hot sites. In a row, the
    lines' hashes meet the array once; single lines are then held against those
    that both have.

    A null site is a site of its own, together with the empty one. Null texts
    stay null, with 0 lines; repeated rows are kept; a text that loses all its
    lines becomes empty and stays. With spare_copies, a text with no other lines
    than boilerplate is left whole: a whole text repeated on a site is a group of
    copies, of which a later step may keep one, and not boilerplate around a text.
    """
    bad = boilerplate_lines(df, site, text, ratio, least).select(F.col("site").alias("bad_site"), F.lower(F.hex("line_md5")).alias("md5")).groupBy("bad_site").agg(F.collect_list("md5").alias("bad"))
    bad = written(bad, "boilerplate")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    held = F.col(f"row.`{text}`")
    rows = rows.join(bad, F.coalesce(F.col(f"row.`{site}`"), F.lit("")) == F.col("bad_site"), "left").withColumn("parts", F.split(held, "\n"))
    rows = rows.withColumn("hit", F.array_intersect(F.transform("parts", lambda x: F.md5(F.trim(x))), "bad"))
    kept = F.when(F.size("hit") > 0, F.filter("parts", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("hit"), F.md5(F.trim(x))))).otherwise(F.col("parts"))
    rows = rows.withColumn("kept", kept)
    if spare_copies:
        rows = rows.withColumn("kept", F.when(F.exists("kept", lambda x: F.trim(x) != ""), F.col("kept")).otherwise(F.col("parts")))
    n = F.when(held.isNull(), 0).otherwise(F.size("parts")).cast("long")
    out = [F.when(held.isNull(), F.lit(None)).otherwise(F.array_join("kept", "\n")).alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns if c not in counts]
    return rows.select(*out, n.alias(counts[0]), (n - F.when(held.isNull(), 0).otherwise(F.size("kept"))).cast("long").alias(counts[1]))
