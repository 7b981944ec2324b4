"""Fields: long tables ``(ts, x, y, v)``, one row a grid cell; a missing row is background."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FIELD = ["ts", "x", "y", "v"]


def read(spark: SparkSession, path: str, level: int | None = None, ts_min: int | None = None, ts_max: int | None = None) -> DataFrame:
    """A field stored as Parquet; timestep range and level become scan filters.

    Columns beyond ``ts, x, y, v`` (and ``level``) are not read.
    """
    df = spark.read.parquet(path)
    if level is not None:
        df = df.where(F.col("level") == level)
    if ts_min is not None:
        df = df.where(F.col("ts") >= ts_min)
    if ts_max is not None:
        df = df.where(F.col("ts") <= ts_max)
    return df.select("ts", "x", "y", F.col("v").cast("double").alias("v"))


def write(field: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """Store a field or feature table as Parquet, partitioned by ``by`` if given."""
    writer = field.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)


def grid_from_axes(lon: DataFrame, lat: DataFrame) -> DataFrame:
    """``(x, y, lon, lat)`` from the two axis tables ``lon(x, lon)`` and ``lat(y, lat)``."""
    return lon.crossJoin(F.broadcast(lat)).select("x", "y", "lon", "lat")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour of day by user, a step a day: the sum of event values (6 digits)."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.groupBy(
        F.date_format("ts", "yyyyMMdd").cast("long").alias("ts"), F.hour("ts").alias("x"), F.col("user_id").cast("int").alias("y")
    ).agg(F.round(F.sum("value"), 6).alias("v"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an 8 x 8 grid, the vector's id as its step."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    flat = df.select(F.col("vec_id").alias("ts"), F.posexplode("embedding").alias("i", "e"))
    return flat.select("ts", (F.col("i") % 8).cast("int").alias("x"), F.expr("cast(i div 8 as int)").alias("y"), F.col("e").cast("double").alias("v"))


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by discount, a step a ship month: the sum of prices (2 digits)."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.groupBy(
        (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("long").alias("ts"),
        (F.col("l_quantity").cast("int") - 1).alias("x"),
        F.round(F.col("l_discount") * 100).cast("int").alias("y"),
    ).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))


def points_to_grid(points: DataFrame, lon0: float, lat0: float, step: float, nx: int, ny: int) -> DataFrame:
    """Points ``(ts, ord, lon, lat, v)`` onto the nearest cell of a regular grid; the last of a cell wins.

    Points beyond half a step outside the grid, and null coordinates, are dropped.
    """
    near = points.select("ts", "ord", "v", F.floor((F.col("lon") - lon0) / step + 0.5).cast("int").alias("x"), F.floor((F.col("lat") - lat0) / step + 0.5).cast("int").alias("y"))
    near = near.where(F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1))
    return near.groupBy("ts", "x", "y").agg(F.max_by("v", "ord").alias("v"))


def with_background(field: DataFrame, nx: int, ny: int, value: float = 0.0) -> DataFrame:
    """The dense field of every step: missing cells get ``value``."""
    steps = field.select("ts").distinct()
    grid = steps.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    return grid.join(field, ["ts", "x", "y"], "left").select("ts", "x", "y", F.coalesce("v", F.lit(value)).alias("v"))


def seq_of(ts: Column) -> Column:
    """A timestep ``YYYYMM[DD[HH[MM]]]`` as a timestamp."""
    text = F.when(F.length(ts.cast("string")) == 6, F.concat(ts.cast("string"), F.lit("010000"))).otherwise(F.rpad(ts.cast("string"), 12, "0"))
    return F.to_timestamp(text, "yyyyMMddHHmm")
