"""Operators on fields ``(ts, x, y, v)``.

Row-wise operators are projections.  Stencils sum or compare shifted copies of the field: each
cell sends its value to the cells that need it (an explode bounded by the stencil) and one
aggregation by cell gathers them, so a stencil is one shuffle whatever its size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

CELL = ["ts", "x", "y"]
FOUR = [(0, 1), (1, 0), (0, -1), (-1, 0)]
EIGHT = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]
TWELVE = [*EIGHT, (0, 2), (2, 0), (0, -2), (-2, 0)]
TWENTY = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) != (0, 0) and abs(dx) + abs(dy) < 4]
NEIGHBOURS = {4: FOUR, 8: EIGHT, 12: TWELVE, 20: TWENTY}


def mask_range(field: DataFrame, mask: Column, lower: float | None, upper: float | None) -> DataFrame:
    """Zero where ``mask`` is not strictly above ``lower`` and strictly below ``upper``."""
    keep = F.lit(True)
    if lower is not None:
        keep &= mask > lower
    if upper is not None:
        keep &= mask < upper
    return field.withColumn("v", F.when(keep, F.col("v")).otherwise(0.0))


def trim(field: DataFrame, n: int, nx: int, ny: int) -> DataFrame:
    """Zero the n outermost cells at all edges."""
    inside = F.col("x").between(n, nx - 1 - n) & F.col("y").between(n, ny - 1 - n)
    return field.withColumn("v", F.when(inside, F.col("v")).otherwise(0.0))


def mirror(field: DataFrame, reference: float = 0.0) -> DataFrame:
    """Reflect values about a reference value."""
    return field.withColumn("v", F.lit(2.0 * reference) - F.col("v"))


def reduce_pick(field: DataFrame, stride: int, nx: int, ny: int) -> DataFrame:
    """Every ``stride``-th cell (odd), the box centres; what is left at the far edges is dropped."""
    h = stride // 2
    pick = field.where((F.col("x") % stride == h) & (F.col("y") % stride == h) & (F.col("x") < nx // stride * stride) & (F.col("y") < ny // stride * stride))
    return pick.select("ts", F.expr(f"cast(x div {stride} as int)").alias("x"), F.expr(f"cast(y div {stride} as int)").alias("y"), "v")


def reduce_mean(field: DataFrame, stride: int, nx: int, ny: int) -> DataFrame:
    """Means of stride x stride boxes (missing cells count as zero)."""
    boxes = field.where((F.col("x") < nx // stride * stride) & (F.col("y") < ny // stride * stride))
    return boxes.groupBy("ts", F.expr(f"cast(x div {stride} as int)").alias("x"), F.expr(f"cast(y div {stride} as int)").alias("y")).agg((F.sum("v") / (stride * stride)).alias("v"))


def gathered(field: DataFrame, offsets: list[tuple[int, int]], aggregates: list[Column]) -> DataFrame:
    """For each cell of the field, aggregates of ``n`` (a neighbour's value) over ``offsets``."""
    offs = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in [(0, 0), *offsets]])
    sent = field.select("ts", "x", "y", "v", F.explode(offs).alias("o"))
    own = (F.col("o.dx") == 0) & (F.col("o.dy") == 0)
    sent = sent.select("ts", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), F.when(own, F.col("v")).alias("v"), F.when(~own, F.col("v")).alias("n"))
    out = sent.groupBy(*CELL).agg(F.max("v").alias("v"), *aggregates)
    return out.where("v IS NOT NULL")


def extrema(field: DataFrame, n: int, nx: int, ny: int, largest: bool = False) -> DataFrame:
    """Strict local minima (or maxima) among 4, 8, 12 or 20 neighbours, away from the edge band."""
    band = 1 if n <= 8 else 2
    best = F.max("n") if largest else F.min("n")
    out = gathered(field, NEIGHBOURS[n], [best.alias("best"), F.count("n").alias("k")])
    beats = F.col("v") > F.col("best") if largest else F.col("v") < F.col("best")
    inside = F.col("x").between(band, nx - 1 - band) & F.col("y").between(band, ny - 1 - band)
    return out.where(inside & (F.col("k") == n) & beats).select(*CELL, "v")


def window_extrema(field: DataFrame, size: int, largest: bool = False) -> DataFrame:
    """Cells that equal the extreme of their size x size window; the window must be whole."""
    r = size // 2
    offsets = [(dx, dy) for dx in range(-r, r + 1) for dy in range(-r, r + 1) if (dx, dy) != (0, 0)]
    best = F.max("n") if largest else F.min("n")
    out = gathered(field, offsets, [best.alias("best"), F.count("n").alias("k")])
    ok = F.col("v") >= F.col("best") if largest else F.col("v") <= F.col("best")
    return out.where((F.col("k") == size * size - 1) & ok).select(*CELL, "v")


def diffuse(field: DataFrame, passes: int = 1, strength: float = 1.0) -> DataFrame:
    """Conservative diffusion: v + strength/8 * sum(neighbour - v) over the four neighbours present."""
    for _ in range(passes):
        out = gathered(field, FOUR, [F.sum("n").alias("s"), F.count("n").alias("k")])
        field = out.select(*CELL, (F.col("v") + 0.125 * strength * (F.coalesce("s", F.lit(0.0)) - F.col("k") * F.col("v"))).alias("v"))
    return field


def gradient(field: DataFrame, stride: int = 1, dlon: float = 0.5, dlat: float = 0.5, lat0: float = -40.0) -> DataFrame:
    """Centred differences per 100 km: adds gx, gy (null where a side is missing)."""
    by_x, by_y = Window.partitionBy("ts", "y").orderBy("x"), Window.partitionBy("ts", "x").orderBy("y")

    def step(w, axis: str) -> Column:
        ahead, behind = F.lead("v", stride).over(w), F.lag("v", stride).over(w)
        whole = (F.lead(axis, stride).over(w) - F.lag(axis, stride).over(w)) == 2 * stride
        return F.when(whole, ahead - behind)

    per = 1.111775 * 2 * stride
    lat = F.lit(lat0) + F.col("y") * dlat
    return field.withColumn("gx", step(by_x, "x") / (per * dlon * F.cos(F.radians(lat)))).withColumn("gy", step(by_y, "y") / (per * dlat))


def front_fields(thermal: DataFrame, wind: DataFrame, min_grad: float, stride: int = 1) -> DataFrame:
    """Frontal area and velocity where the gradient exceeds ``min_grad``.

    ``wind(ts, x, y, u, w)``.  Adds |grad| and the wind along the unit gradient.
    """
    g = gradient(thermal, stride).withColumn("grad", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    g = g.where(F.col("grad") > min_grad)
    joined = g.join(wind, CELL)
    return joined.select(*CELL, F.col("grad").alias("farea"), ((F.col("u") * F.col("gx") + F.col("w") * F.col("gy")) / F.col("grad")).alias("fvel"))


def divergence(wind: DataFrame, stride: int = 1) -> DataFrame:
    """du/dx + dw/dy of ``wind(ts, x, y, u, w)``."""
    gx = gradient(wind.select(*CELL, F.col("u").alias("v")), stride).select(*CELL, "gx")
    gy = gradient(wind.select(*CELL, F.col("w").alias("v")), stride).select(*CELL, "gy")
    return gx.join(gy, CELL).where("gx IS NOT NULL AND gy IS NOT NULL").select(*CELL, (F.col("gx") + F.col("gy")).alias("v"))


def destagger(field: DataFrame, axis: str) -> DataFrame:
    """Average of each cell and the next along an axis; the last cell stays."""
    other = "y" if axis == "x" else "x"
    w = Window.partitionBy("ts", other).orderBy(axis)
    return field.withColumn("v", F.coalesce((F.col("v") + F.lead("v").over(w)) / 2, F.col("v")))


def erode(mask: DataFrame, eight: bool = True) -> DataFrame:
    """Cells of ``mask(ts, x, y)`` all of whose neighbours are in the mask."""
    offsets = EIGHT if eight else FOUR
    out = gathered(mask.select(*CELL, F.lit(1).alias("v")), offsets, [F.count("n").alias("k")])
    return out.where(F.col("k") == len(offsets)).select(*CELL)


def dilate(mask: DataFrame, nx: int, ny: int, eight: bool = True) -> DataFrame:
    """Cells in the mask or next to it, inside the domain."""
    offs = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in [(0, 0), *(EIGHT if eight else FOUR)]])
    out = mask.select("ts", "x", "y", F.explode(offs).alias("o")).select("ts", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    return out.where(F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1)).distinct()


def edge_distance(mask: DataFrame) -> DataFrame:
    """Cells of the mask with ``dist``: steps along the grid to the nearest edge of their row or column run."""

    def run(axis: str, other: str) -> Column:
        w = Window.partitionBy("ts", other).orderBy(axis)
        return F.col(axis) - F.row_number().over(w)

    m = mask.withColumn("rx", run("x", "y")).withColumn("ry", run("y", "x"))
    wx, wy = Window.partitionBy("ts", "y", "rx"), Window.partitionBy("ts", "x", "ry")
    west, east = F.col("x") - F.min("x").over(wx), F.max("x").over(wx) - F.col("x")
    south, north = F.col("y") - F.min("y").over(wy), F.max("y").over(wy) - F.col("y")
    return m.select(*CELL, F.least(west, east, south, north).alias("dist"))


def shrink(mask: DataFrame, n: int) -> DataFrame:
    """Cells at least n steps inside their row run and column run."""
    return edge_distance(mask).where(F.col("dist") >= n).select(*CELL)


def zones(mask: DataFrame) -> DataFrame:
    """Zone code of the cells of a rectangle's surroundings: 10 * zx + zy, 1 before, 3 inside, 5 after."""
    w = Window.partitionBy("ts")
    z = lambda c: F.when(F.col(c) < F.min(F.when(F.col("m"), F.col(c))).over(w), 1).when(F.col(c) > F.max(F.when(F.col("m"), F.col(c))).over(w), 5).otherwise(3)
    return mask.select(*CELL, (10 * z("x") + z("y")).alias("zone"))


def smooth(field: DataFrame, sigma: float, nx: int, ny: int, truncate: float = 4.0) -> DataFrame:
    """Gaussian filter of a dense field, axis by axis, edges reflected: each pass is one shuffle."""
    r = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    total = sum(weights)
    for axis, n, other in (("x", nx, "y"), ("y", ny, "x")):
        # a value goes to the cells whose window meets it, straight or mirrored at an edge: as many rows as taps
        reach: dict[tuple[int, int], float] = {}
        for k, w in zip(range(-r, r + 1), weights, strict=True):
            for to in range(n):
                m = (to + k) % (2 * n)
                source = m if m < n else 2 * n - 1 - m
                reach[source, to] = reach.get((source, to), 0.0) + w / total
        rows = [[(to, w) for (source, to), w in sorted(reach.items()) if source == i] for i in range(n)]
        table = F.array(*[F.array(*[F.struct(F.lit(to).alias("to"), F.lit(w).alias("w")) for to, w in row]) for row in rows])
        sent = field.select("ts", other, "v", F.explode(F.element_at(table, F.col(axis) + 1)).alias("t"))
        field = sent.groupBy("ts", F.col("t.to").alias(axis), other).agg(F.sum(F.col("v") * F.col("t.w")).alias("v")).select("ts", "x", "y", "v")
    return field


def circle_mask(grid: DataFrame, distance: Column, radius: float) -> DataFrame:
    """Cells of ``grid`` whose distance is at most the radius."""
    return grid.where(distance <= radius)


def filter_by_field(points: DataFrame, other: DataFrame, limit: float, below: bool = True) -> DataFrame:
    """Points where another field (topography, say) is below, or above, a limit."""
    o = other.select(*CELL, F.col("v").alias("_o"))
    return points.join(o, CELL).where(F.col("_o") < limit if below else F.col("_o") > limit).drop("_o")


def filter_edge(points: DataFrame, band: int, nx: int, ny: int) -> DataFrame:
    """Points at least ``band`` cells inside the domain."""
    return points.where(F.col("x").between(band, nx - 1 - band) & F.col("y").between(band, ny - 1 - band))


def frame(field: DataFrame, n: int, value: float, nx: int, ny: int) -> DataFrame:
    """The ``n`` outermost cells set to a constant, so that contours close."""
    inside = F.col("x").between(n, nx - 1 - n) & F.col("y").between(n, ny - 1 - n)
    return field.withColumn("v", F.when(inside, F.col("v")).otherwise(F.lit(float(value))))


def halo(field: DataFrame, nx: int, ny: int, periodic: bool) -> DataFrame:
    """The field with a ring of cells around it, -1 and nx: the other side's where x is periodic, else copies of the edge."""
    x = F.col("x")
    if periodic:
        copies = F.array_compact(F.array(x, F.when(x == 0, F.lit(nx)), F.when(x == nx - 1, F.lit(-1))))
    else:
        copies = F.array_compact(F.array(x, F.when(x == 0, F.lit(-1)), F.when(x == nx - 1, F.lit(nx))))
    wide = field.withColumn("x", F.explode(copies))
    y = F.col("y")
    return wide.withColumn("y", F.explode(F.array_compact(F.array(y, F.when(y == 0, F.lit(-1)), F.when(y == ny - 1, F.lit(ny))))))


_RING = {name: 1 << i for i, name in enumerate(("N", "NE", "E", "SE", "S", "SW", "W", "NW"))}
_AT = {"N": (0, 1), "NE": (1, 1), "E": (1, 0), "SE": (1, -1), "S": (0, -1), "SW": (-1, -1), "W": (-1, 0), "NW": (-1, 1)}
BRIDGED = [("W", "E"), ("N", "S"), ("NE", "SW"), ("SE", "NW"), ("NE", "S"), ("NE", "W"), ("SE", "N"), ("SE", "W"), ("NW", "S"), ("NW", "E"), ("SW", "N"), ("SW", "E")]


def join_lines(mask: DataFrame, nx: int, ny: int) -> DataFrame:
    """Cells of ``mask(ts, x, y)``, and those between two of them that close a gap in a line."""
    offs = F.array(*[F.struct(F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy"), F.lit(_RING[k]).alias("bit")) for k, (dx, dy) in _AT.items()])
    sent = mask.select("ts", "x", "y", F.explode(offs).alias("o")).select("ts", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), F.col("o.bit").alias("bit"))
    ring = sent.where(F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1)).groupBy("ts", "x", "y").agg(F.sum(F.col("bit")).cast("int").alias("ring"))
    ok = F.lit(False)
    for a, b in BRIDGED:
        both = _RING[a] | _RING[b]
        ok |= F.col("ring").bitwiseAND(F.lit(both)) == both
    return mask.select("ts", "x", "y").unionByName(ring.where(ok).select("ts", "x", "y")).distinct()


def unrotate(u: Column, v: Column, rlon: Column, rlat: Column, pole_lat: float) -> tuple[Column, Column]:
    """Wind on a rotated grid as wind to the east and north, at rotated coordinates in degrees."""
    import math as m

    p = m.radians(pole_lat)
    lon, lat = F.radians(rlon), F.radians(rlat)
    sin = F.cos(lon) * m.cos(p) * F.cos(lat) + m.sin(p) * F.sin(lat)
    cos = F.sqrt(1 - sin * sin)
    a = (F.cos(lat) * m.sin(p) - m.cos(p) * F.cos(lon) * F.sin(lat)) / cos
    b = m.cos(p) * F.sin(lon) / cos
    return u * a + v * b, v * a - u * b


def climatology(field: DataFrame, month: Column, threshold: float) -> DataFrame:
    """``(x, y, season, n, frequency, mean, variance)``: how often a cell is over the threshold, by season.

    The mean is of a sum in order of the steps, so its last digit does not depend on partitions; a
    group holds a value a step of a season.  Missing values count in n only.
    """
    season = F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").otherwise("SON")
    inorder = F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("ts", "v"))))
    total = F.aggregate(inorder, F.lit(0.0), lambda a, r: a + r.v)
    mean = F.when(F.count("v") > 0, total / F.count("v"))
    return field.groupBy("x", "y", season.alias("season")).agg(F.count("*").alias("n"), F.avg((F.col("v") >= threshold).cast("double")).alias("frequency"), mean.alias("mean"), F.var_pop("v").alias("variance"))


def zones_with_hole(mask: DataFrame) -> DataFrame:
    """Zone code 10 * zx + zy of the surroundings of a rectangle with a rectangular hole: 1 before it, 2 before
    the hole, 3 as far as the hole, 4 after it, 5 after the rectangle.  ``mask(ts, x, y, m, hole)``.
    """
    w = Window.partitionBy("ts")

    def z(c: str) -> Column:
        edge = lambda f, flag: f(F.when(F.col(flag), F.col(c))).over(w)
        return F.when(F.col(c) < edge(F.min, "m"), 1).when(F.col(c) > edge(F.max, "m"), 5).when(F.col(c) < edge(F.min, "hole"), 2).when(F.col(c) > edge(F.max, "hole"), 4).otherwise(3)

    return mask.select(*CELL, (10 * z("x") + z("y")).alias("zone"))


def crop(mask: DataFrame, pad: int = 0) -> DataFrame:
    """Cells of the box around the true cells of ``mask(ts, x, y, m)`` and ``pad`` more, counted from its corner."""
    w = Window.partitionBy("ts")
    low = lambda c: F.min(F.when(F.col("m"), F.col(c))).over(w) - pad
    high = lambda c: F.max(F.when(F.col("m"), F.col(c))).over(w) + pad
    box = mask.withColumns({"x0": low("x"), "x1": high("x"), "y0": low("y"), "y1": high("y")})
    box = box.where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
    return box.select("ts", (F.col("x") - F.greatest("x0", F.lit(0))).alias("x"), (F.col("y") - F.greatest("y0", F.lit(0))).alias("y"), "m")
