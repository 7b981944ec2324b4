"""Geometry of paths and features: hulls, polygons to cells, rings' lengths and areas, distances."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridtrack import functions as fn


def hull(points: list[tuple[float, float]], eps: float = 1e-9) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise, by monotone chains; points on an edge are no corners."""
    own = sorted(set(points))
    if len(own) < 3:
        return own
    out: list[tuple[float, float]] = []
    for way in (own, own[::-1]):
        chain: list[tuple[float, float]] = []
        for p in way:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= eps:
                chain.pop()
            chain.append(p)
        out += chain[:-1]
    return out


def _hull_measures(points: list) -> tuple[float, float]:
    """Perimeter and area; of points on a line the distance of the outermost, and 0."""
    h = hull([(p["x"], p["y"]) for p in points])
    if len(h) < 2:
        return 0.0, 0.0
    length = sum(math.dist(a, b) for a, b in zip(h, h[1:] + h[:1], strict=True))
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(h, h[1:] + h[:1], strict=True)) / 2
    return (length / 2 if len(h) == 2 else length), abs(area)


def hulls(points: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, hull_len, hull_area)`` of ``points(*keys, x, y)``; a group is a feature or a track's path."""

    @F.pandas_udf("struct<hull_len: double, hull_area: double>")
    def measure(p: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_hull_measures(list(x)) for x in p], columns=["hull_len", "hull_area"])

    held = points.groupBy(*keys).agg(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("p"))
    return held.select(*keys, measure("p").alias("m")).select(*keys, "m.*")


def smooth_path(path: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Running mean over ``n`` (odd) steps of ``path(*keys, seq, x, y)``, shorter at both ends alike."""
    w = Window.partitionBy(*keys).orderBy("seq")
    own, back = F.row_number().over(w) - 1, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq"))) - 1
    numbered = path.withColumn("r", F.least(F.lit(n // 2), own, back))
    out = [numbered["r"]]
    for c in ("x", "y"):
        mean = F.col(c)
        for r in range(1, n // 2 + 1):
            mean = F.when(F.col("r") == r, F.avg(c).over(w.rowsBetween(-r, r))).otherwise(mean)
        out.append(mean.alias(f"{c}m"))
    return numbered.select(*keys, "seq", *out[1:]).toDF(*keys, "seq", "x", "y")


def path_length(path: DataFrame, keys: list[str], metric=None) -> DataFrame:
    """``(*keys, n_points, n_distinct, length)`` along ``path(*keys, seq, x, y)``; metric of (x, y, x, y), great circle if none."""
    w = Window.partitionBy(*keys).orderBy("seq")
    before = path.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)})
    d = (metric or fn.great_circle)(F.col("px"), F.col("py"), F.col("x"), F.col("y"))
    return before.groupBy(*keys).agg(F.count("*").alias("n_points"), F.countDistinct("x", "y").alias("n_distinct"), F.coalesce(F.sum(d), F.lit(0.0)).alias("length"))


def insignificant(path: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Keys of paths that have at most two points when rounded to the tolerance."""
    near = path.select(*keys, F.round(F.col("x") / tolerance).alias("x"), F.round(F.col("y") / tolerance).alias("y"))
    return near.groupBy(*keys).agg(F.countDistinct("x", "y").alias("k")).where("k <= 2").select(*keys)


def ring_area(ring: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, area)`` in km2 of closed rings ``(*keys, seq, lon, lat)``, in the equal-area cylindrical projection; signed."""
    w = Window.partitionBy(*keys).orderBy("seq")
    e = ring.withColumns({"plon": F.lag("lon").over(w), "plat": F.lag("lat").over(w)}).where("plon IS NOT NULL")
    piece = F.radians(F.col("lon") - F.col("plon")) * (F.sin(F.radians("lat")) + F.sin(F.radians("plat"))) / 2
    return e.groupBy(*keys).agg((-F.sum(piece) * fn.EARTH_KM**2).alias("area"))


def polygons_to_cells(path: DataFrame, nx: int, ny: int) -> DataFrame:
    """``(id, x, y)``: cells whose centre is inside, even and odd, of ``path(id, ring, seq, x, y)`` in grid units.

    Each edge is sent to the rows it crosses; the crossings of a row, sorted, bound its runs, so
    work is by edges and runs and not by cells and edges.  Rings close themselves; holes are rings.
    """
    w = Window.partitionBy("id", "ring").orderBy("seq")
    whole = Window.partitionBy("id", "ring").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = path.withColumns({"bx": F.coalesce(F.lead("x").over(w), F.first("x").over(whole)), "by": F.coalesce(F.lead("y").over(w), F.first("y").over(whole))})
    low, high = F.least("y", "by"), F.greatest("y", "by")
    first, last = F.greatest(F.ceil(low), F.lit(0)).cast("int"), F.least(F.ceil(high) - 1, F.lit(ny - 1)).cast("int")
    rows = e.withColumns({"r0": first, "r1": last}).where("r0 <= r1").withColumn("row", F.explode(F.sequence("r0", "r1")))
    at = F.col("x") + (F.col("row") - F.col("y")) * (F.col("bx") - F.col("x")) / (F.col("by") - F.col("y"))
    crossings = rows.select("id", "row", at.alias("at"))
    order = Window.partitionBy("id", "row").orderBy("at")
    pairs = crossings.withColumns({"k": F.row_number().over(order), "to": F.lead("at").over(order)}).where("k % 2 = 1")
    x0, x1 = F.greatest(F.ceil("at"), F.lit(0)).cast("int"), F.least(F.ceil("to") - 1, F.lit(nx - 1)).cast("int")
    runs = pairs.withColumns({"x0": x0, "x1": x1}).where("x0 <= x1")
    return runs.select("id", F.explode(F.sequence("x0", "x1")).alias("x"), F.col("row").alias("y")).distinct()


def circle_path(lon: Column, lat: Column, radius: float, points: int) -> Column:
    """The outline of a circle on the sphere: an array of (lon, lat), the first again at the end."""
    d = radius / fn.EARTH_KM

    def at(i: Column) -> Column:
        bearing = i * (2 * math.pi / points)
        a = F.radians(lat)
        sin = F.sin(a) * math.cos(d) + F.cos(a) * math.sin(d) * F.cos(bearing)
        east = F.atan2(F.sin(bearing) * math.sin(d) * F.cos(a), math.cos(d) - F.sin(a) * sin)
        return F.struct((lon + F.degrees(east)).alias("lon"), F.degrees(F.asin(sin)).alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: at((i % points).cast("double")))


def domain_path(grid: DataFrame, nx: int, ny: int, inset: int = 0) -> DataFrame:
    """``(seq, lon, lat)`` along the domain's edge, ``inset`` cells inside, counter-clockwise from the lower left, closed.

    ``grid(x, y, lon, lat)``.
    """
    x0, y0, x1, y1 = inset, inset, nx - 1 - inset, ny - 1 - inset
    w, h = x1 - x0, y1 - y0
    seq = F.when(F.col("y") == y0, F.col("x") - x0).when(F.col("x") == x1, w + F.col("y") - y0).when(F.col("y") == y1, w + h + x1 - F.col("x")).otherwise(2 * w + h + y1 - F.col("y"))
    rim = grid.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1) & (F.col("x").isin(x0, x1) | F.col("y").isin(y0, y1)))
    rim = rim.select(seq.alias("seq"), "lon", "lat")
    return rim.unionByName(rim.where("seq = 0").withColumn("seq", F.lit(2 * (w + h))))


def valid_box(field: DataFrame) -> DataFrame:
    """``(ts, xmin, ymin, xmax, ymax, whole)`` of the cells with a value; whole: the box has no other."""
    ok = field.where("v IS NOT NULL AND NOT isnan(v)")
    box = ok.groupBy("ts").agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"), F.count("*").alias("n"))
    return box.select("ts", "xmin", "ymin", "xmax", "ymax", (F.col("n") == (F.col("xmax") - F.col("xmin") + 1) * (F.col("ymax") - F.col("ymin") + 1)).alias("whole"))


def regular_axes(grid: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``(regular, dlon, dlat)``: whether lon depends on x alone and lat on y alone, in even steps."""
    spread = grid.groupBy("x").agg((F.max("lon") - F.min("lon")).alias("s")).agg(F.max("s").alias("sx"))
    across = grid.groupBy("y").agg((F.max("lat") - F.min("lat")).alias("s")).agg(F.max("s").alias("sy"))
    ends = grid.agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y", "lon", "lat")))
    step = ends.select("*", ((F.col("max_lon") - F.col("min_lon")) / (F.col("max_x") - F.col("min_x"))).alias("dlon"), ((F.col("max_lat") - F.col("min_lat")) / (F.col("max_y") - F.col("min_y"))).alias("dlat"))
    off = grid.join(F.broadcast(step)).agg(F.max(F.greatest(F.abs(F.col("lon") - F.col("min_lon") - (F.col("x") - F.col("min_x")) * F.col("dlon")), F.abs(F.col("lat") - F.col("min_lat") - (F.col("y") - F.col("min_y")) * F.col("dlat")))).alias("off"))
    even = (F.col("sx") <= tolerance) & (F.col("sy") <= tolerance) & (F.col("off") <= tolerance)
    return step.join(spread).join(across).join(off).select(even.alias("regular"), "dlon", "dlat")  # one row each


def _haversine(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    a1, a2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * fn.EARTH_KM * np.arcsin(np.minimum(np.sqrt(h), 1))


def distance_km(cells: DataFrame, rim: DataFrame, nx: int, ny: int, lon0: float, lat0: float, step: float, exact: bool = True) -> DataFrame:
    """``(ts, x, y, dist)``: km from every grid cell to the nearest cell of ``rim``, 0 inside features.

    Exact: the least great-circle distance; else that to the cell nearest in grid units (ties to the
    smaller x, then y).  A step is a task, bounded by its grid; rows of the grid are worked on one
    at a time.
    """

    def run(key: tuple, inside: pa.Table, edge: pa.Table) -> pa.Table:
        ex, ey = edge.column("x").to_numpy().astype(float), edge.column("y").to_numpy().astype(float)
        order = np.lexsort((ey, ex))
        ex, ey = ex[order], ey[order]
        own = np.zeros((nx, ny), bool)
        own[inside.column("x").to_numpy(), inside.column("y").to_numpy()] = True
        dist = np.zeros((nx, ny))
        ys = np.arange(ny)
        for x in range(nx) if len(ex) else ():
            if exact:
                d = _haversine(lon0 + x * step, lat0 + ys[:, None] * step, lon0 + ex[None, :] * step, lat0 + ey[None, :] * step)
                dist[x] = d.min(axis=1)
            else:
                near = ((x - ex[None, :]) ** 2 + (ys[:, None] - ey[None, :]) ** 2).argmin(axis=1)
                dist[x] = _haversine(lon0 + x * step, lat0 + ys * step, lon0 + ex[near] * step, lat0 + ey[near] * step)
        dist[own] = 0
        gx, gy = np.meshgrid(np.arange(nx), ys, indexing="ij")
        ts = key[0].as_py() if hasattr(key[0], "as_py") else key[0]
        return pa.table({"ts": pa.array(np.full(nx * ny, ts, np.int64)), "x": pa.array(gx.ravel(), pa.int32()), "y": pa.array(gy.ravel(), pa.int32()), "dist": pa.array(dist.ravel())})

    edge = rim.select(F.col("ts").alias("step"), F.col("x").alias("ex"), F.col("y").alias("ey")).toDF("step", "x", "y")
    return cells.select("ts", "x", "y").groupBy("ts").cogroup(edge.groupBy("step")).applyInArrow(run, "ts long, x int, y int, dist double")


def periodic_distance(x1: Column, y1: Column, x2: Column, y2: Column, nx: float) -> Column:
    """Distance of two points on a domain that repeats every ``nx`` along x."""
    dx = F.abs(x1 - x2)
    return F.sqrt(F.pow(F.least(dx, nx - dx), 2) + F.pow(y1 - y2, 2))
