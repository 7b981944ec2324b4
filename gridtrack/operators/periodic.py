"""Features on a domain that repeats along x, features at its edge, and splits over several levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gridtrack.operators import features
from gridtrack.operators.components import components


def label(cells: DataFrame, nx: int, connectivity: int = 8) -> DataFrame:
    """As :func:`features.label`, and features that meet across the seam are one, by the smallest id.

    ``ts`` must fit 23 bits.
    """
    own = features.label(cells, connectivity)
    reach = (-1, 0, 1) if connectivity == 8 else (0,)
    west = own.where("x = 0").select("ts", F.explode(F.array(*[F.col("y") + d for d in reach])).alias("y"), F.col("fid").alias("a"))
    east = own.where(F.col("x") == nx - 1).select("ts", "y", F.col("fid").alias("b"))
    key = lambda fid: F.shiftleft(F.col("ts"), 40) + F.col(fid)
    roots = components(west.join(east, ["ts", "y"]).select(key("a").alias("a"), key("b").alias("b")))
    out = own.withColumn("node", key("fid")).join(roots, "node", "left")
    return out.select("ts", "x", "y", "v", F.coalesce(F.col("root") % F.lit(1 << 40), "fid").alias("fid"))


def at_edge(cells: DataFrame, nx: int, ny: int) -> DataFrame:
    """``(ts, fid, north, east, south, west)``: at which sides of the domain a feature has a cell."""
    has = lambda c: F.max(c.cast("int")) == 1
    return cells.groupBy("ts", "fid").agg(has(F.col("y") == ny - 1).alias("north"), has(F.col("x") == nx - 1).alias("east"), has(F.col("y") == 0).alias("south"), has(F.col("x") == 0).alias("west"))


def split_levels(cells: DataFrame, levels: list[float], connectivity: int = 8, seed_minsize: int = 1, minsize: int = 1, maxsize: int | None = None) -> DataFrame:
    """Split features level by level, ascending, each on what the one before left; then by size.

    A feature without a part above a level stays as it is.
    """
    for level in sorted(levels):
        cells = features.split(cells, level, connectivity, seed_minsize)
    n = F.count("*").over(Window.partitionBy("ts", "fid"))
    ok = F.col("_n") >= minsize if maxsize is None else F.col("_n").between(minsize, maxsize)
    return cells.withColumn("_n", n).where(ok).drop("_n")


def northernmost(cells: DataFrame) -> DataFrame:
    """``(ts, fid, x, y)``: each feature's cell of the largest y, of several the smallest x."""
    best = F.max_by(F.struct("x", "y"), F.struct("y", -F.col("x"))).alias("c")
    return cells.groupBy("ts", "fid").agg(best).select("ts", "fid", "c.x", "c.y")


def background_rim(cells: DataFrame, nx: int, ny: int) -> DataFrame:
    """``(ts, fid, x, y)``: background cells next to each feature, inside the domain."""
    from gridtrack.operators import field_ops

    near = features.sent(cells, field_ops.EIGHT).where(F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1))
    return near.join(cells.select("ts", "x", "y"), ["ts", "x", "y"], "left_anti").select("ts", F.col("nfid").alias("fid"), "x", "y").distinct()


def claimed_once(cells: DataFrame) -> DataFrame:
    """Of cells that several features ``(ts, x, y, v, fid, ord)`` claim, those of the first by ``ord``."""
    first = F.row_number().over(Window.partitionBy("ts", "x", "y").orderBy("ord"))
    return cells.withColumn("_k", first).where("_k = 1").drop("_k")
