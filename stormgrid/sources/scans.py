"""Typed scans and checkpointed sinks. Missing values become NULL on read."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binning import clean
from ..operators.joins import settled

#: Columns of an event file.
EVENT_SCHEMA = "start_indices int, stop_indices int, peaks double, start_year int, start_month int, start_day int, start_hour int, event_durations int, event_num int"


def name_parts(path, pattern: str, names: Sequence[str]) -> dict:
    """Columns from a path by a pattern's groups."""
    return {n: F.regexp_extract(path, pattern, k + 1) for k, n in enumerate(names)}


def event_files(spark: SparkSession, path: str, pattern: str = r"([^/]+)_(\d{2})_full_events[^/]*\.csv$", parts: bool = False) -> DataFrame:
    """Event CSVs with the catchment and member of their file names; events are numbered 1..N by position in the file.

    parts: the files of a folder are the parts of one file, in the order of their
    names. Rows are counted by piece of a file and numbered from where their piece
    begins; no file is gathered in a task.
    """
    from pyspark.sql import Window

    rows = spark.read.schema(EVENT_SCHEMA).csv(path, header=True).withColumn("_path", F.col("_metadata.file_path"))
    rows = rows.withColumns(name_parts(F.col("_path"), pattern, ("catchment_num", "ens")))
    rows = settled(rows.withColumns({"_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()}))  # lines of a block come in their order
    file = F.regexp_replace("_path", "/[^/]*$", "") if parts else F.col("_path")
    pieces = rows.groupBy("_path", "_block").agg(F.min("_line").alias("_first"), F.count("*").alias("_n")).withColumn("_file", file)
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("_path", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    number = (F.col("_line") - F.col("_first") + F.col("_before") + 1).cast("int")
    return rows.join(F.broadcast(pieces), ["_path", "_block"]).withColumn("event_num", number).drop("_path", "_block", "_line", "_first", "_before")


def grid_cells(spark: SparkSession, path: str, ens: str | None = None, hours: tuple[int, int] | None = None, value: str = "value", nodata: float | None = None) -> DataFrame:
    """Cells of a table partitioned by member; a range of hours is pushed down to the files."""
    df = spark.read.parquet(path)
    if ens is not None:
        df = df.where(F.col("ens") == ens)
    if hours is not None:
        df = df.where((F.col("hour360") >= hours[0]) & (F.col("hour360") < hours[1]))
    return df.withColumn(value, clean(F.col(value), nodata))


def one_field(df: DataFrame, axes: Sequence[str] = ("t", "y", "x")) -> str:
    """The one column besides the axes, bounds and partition columns that is a number; none or several raise."""
    found = [c for c, t in df.dtypes if c not in axes and not c.endswith("_bnds") and t in ("float", "double")]
    if len(found) != 1:
        raise ValueError(f"exactly one field is expected, not {found}")
    return found[0]


def flood_cells(spark: SparkSession, path: str, depth: int, variable: str) -> DataFrame:
    """Flooded area or volume of cells by event at a depth; every event has to have as many cells, or this raises."""
    if depth not in (10, 30) or variable not in ("area", "volume"):
        raise ValueError(f"no such flood table: {depth}, {variable}")
    rows = spark.read.parquet(path).where((F.col("depth") == depth) & (F.col("variable") == variable))
    sizes = rows.groupBy("event_num").agg(F.count("*").alias("n")).agg(F.min("n").alias("a"), F.max("n").alias("b")).first()
    if sizes["a"] != sizes["b"]:
        raise ValueError(f"events have between {sizes['a']} and {sizes['b']} cells")
    return rows


def pixels(spark: SparkSession, path: str, value: str = "value", nodata: float | None = None, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixels (row, col, value) of a raster kept as Parquet, nodata as NULL; a box of rows and columns, inclusive, is pushed down to the files."""
    df = spark.read.parquet(path)
    if box:
        df = df.where(F.col("row").between(box[0], box[2]) & F.col("col").between(box[1], box[3]))
    return df.withColumn(value, clean(F.col(value), nodata))


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of line-separated GeoJSON features: name, rings and bounds, for points_in_polygons."""
    rows = spark.read.schema("properties struct<name:string>, geometry struct<type:string,coordinates:array<array<array<double>>>>").json(path)
    rings = F.transform("geometry.coordinates", lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    points = F.flatten("rings")
    bound = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return rows.select(F.col("properties.name").alias("name"), rings.alias("rings")).withColumns({"minx": bound(F.array_min, "x"), "miny": bound(F.array_min, "y"), "maxx": bound(F.array_max, "x"), "maxy": bound(F.array_max, "y")})


def event_record(events: DataFrame, event_num: int) -> dict | None:
    """One event as a record."""
    row = events.where(F.col("event_num") == event_num).limit(1).collect()
    return row[0].asDict() if row else None


def years_of(cells: DataFrame, year: int) -> DataFrame:
    """Steps of one year of twelve 30-day months, by hour360: a range that reaches the files."""
    return cells.where((F.col("hour360") >= year * 8640) & (F.col("hour360") < (year + 1) * 8640))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, in one folder."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_field(df: DataFrame, path: str, keys: Sequence[str], about: dict[str, dict[str, str]]) -> None:
    """A field's rows by key, and beside them a table of what its columns are: column, attribute, text."""
    write_parts(df, f"{path}/data", keys)
    rows = [(c, a, t) for c, some in about.items() for a, t in some.items()]
    df.sparkSession.createDataFrame(rows, "column string, attribute string, text string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def write_pixel_cells(binned: DataFrame, path: str, nx: int) -> None:
    """Which coarse cell each pixel went to: row, col, cell."""
    binned.select("row", "col", (F.col("iy") * nx + F.col("ix")).alias("cell")).write.mode("overwrite").parquet(path)


def raster_files(spark: SparkSession, path: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """A listing of files with the parts of their names; contents are not read."""
    df = spark.read.format("binaryFile").load(path).select("path", "length")
    return df.withColumns(name_parts(F.col("path"), pattern, names))


def matching_file(files: DataFrame, days: DataFrame, path: str = "path", day: str = "day") -> DataFrame:
    """For each day (yyyymmdd) the first file whose name has a range _start-stop_ that holds it, or NULL."""
    spans = files.select(path, F.regexp_extract(path, r"_(\d{8})-(\d{8})_", 1).alias("_a"), F.regexp_extract(path, r"_(\d{8})-(\d{8})_", 2).alias("_b")).where("_a <> ''")
    got = days.join(spans, (F.col(day) >= F.col("_a")) & (F.col(day) <= F.col("_b")), "left")
    return got.groupBy(*days.columns).agg(F.min(path).alias(path))


def distinct_columns(df: DataFrame) -> DataFrame:
    """Only the first of columns with the same name."""
    seen: set[str] = set()
    keep = [k for k, c in enumerate(df.columns) if not (c in seen or seen.add(c))]
    return df.toDF(*[f"_{k}" for k in range(len(df.columns))]).select(*[F.col(f"_{k}").alias(df.columns[k]) for k in keep])


def list_column(text: str, element: str = "int"):
    """A list written as text, parsed; NULL if it is none."""
    return F.from_json(F.col(text), f"array<{element}>")


def write_parts(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """One folder per key values; a rerun replaces only the folders it writes."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def not_written(todo: DataFrame, spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Work whose folder is not there yet."""
    try:
        done = spark.read.parquet(path).select(*keys).distinct()
    except Exception as e:
        if not re.search("PATH_NOT_FOUND|UNABLE_TO_INFER_SCHEMA", str(e)):
            raise
        return todo
    return todo.join(done, list(keys), "left_anti")


def crop(cells: DataFrame, value: str = "value") -> DataFrame:
    """Without rows and columns of the grid that have no valid value."""
    some = cells.where(F.col(value).isNotNull())
    return cells.join(some.select("y").distinct(), "y", "left_semi").join(some.select("x").distinct(), "x", "left_semi")
