"""Depressions and cyclones by nested level sets.

A closed contour bounds a connected set of cells below its level that doesn't touch the domain's
edge.  All levels are labelled at once (a level is a plane of its own), nesting is an equi-join of
cells between neighbouring levels, and a depression's centres are the local minima inside.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from gridtrack.operators import features, field_ops

PLANES = 1000  # a plane is ts * PLANES + level index


def level_sets(field: DataFrame, levels: list[float], connectivity: int = 8) -> DataFrame:
    """Labelled cells ``(ts, level, x, y, v, fid)`` below each level; level counts from 0, ascending."""
    arr = F.array(*[F.lit(float(v)) for v in sorted(levels)])
    planes = field.select("ts", "x", "y", "v", F.posexplode(arr).alias("level", "top")).where("v < top")
    cells = features.label(planes.select((F.col("ts") * PLANES + F.col("level")).alias("ts"), "x", "y", "v"), connectivity)
    return cells.select(F.expr(f"ts div {PLANES}").alias("ts"), (F.col("ts") % PLANES).cast("int").alias("level"), "x", "y", "v", "fid")


def contours(sets: DataFrame, field: DataFrame, nx: int, ny: int) -> DataFrame:
    """``(ts, level, fid, n, vmin, closed, n_minima)`` of each level's components."""
    lows = field_ops.extrema(field, 8, nx, ny).select("ts", "x", "y", F.lit(1).alias("low"))
    edge = ~(F.col("x").between(1, nx - 2) & F.col("y").between(1, ny - 2))
    return sets.join(lows, ["ts", "x", "y"], "left").groupBy("ts", "level", "fid").agg(
        F.count("*").alias("n"), F.min("v").alias("vmin"), (F.max(edge.cast("int")) == 0).alias("closed"), F.count("low").alias("n_minima")
    )


def tree(sets: DataFrame) -> DataFrame:
    """``(ts, level, fid, parent)``: the component of the next level that contains each component."""
    up = sets.select("ts", (F.col("level") - 1).alias("level"), "x", "y", F.col("fid").alias("parent"))
    return sets.join(up, ["ts", "level", "x", "y"]).select("ts", "level", "fid", "parent").distinct()


def cyclones(found: DataFrame, nested: DataFrame, levels: list[float], max_centres: int = 3) -> DataFrame:
    """Outermost closed components with one to ``max_centres`` minima: ``(ts, level, fid, n, depth, n_minima)``."""
    good = found.where(F.col("closed") & F.col("n_minima").between(1, max_centres))
    outer = good.select("ts", (F.col("level") - 1).alias("level"), F.col("fid").alias("parent"))
    inside = nested.join(outer, ["ts", "level", "parent"], "left_semi").select("ts", "level", "fid")
    top = F.element_at(F.array(*[F.lit(float(v)) for v in sorted(levels)]), F.col("level") + 1)
    return good.join(inside, ["ts", "level", "fid"], "left_anti").select("ts", "level", "fid", "n", (top - F.col("vmin")).alias("depth"), "n_minima")


def containment(sets: DataFrame) -> DataFrame:
    """``(ts, up_level, up, level, fid)``: every component with all it contains, itself included.

    An equi-join of cells; a cell is in at most as many components as there are levels.
    """
    up = sets.select("ts", "x", "y", F.col("level").alias("up_level"), F.col("fid").alias("up"))
    return sets.join(up, ["ts", "x", "y"]).where("level <= up_level").select("ts", "up_level", "up", "level", "fid").distinct()


def depressions(sets: DataFrame, field: DataFrame, levels: list[float], nx: int, ny: int) -> DataFrame:
    """A row a component: the tree of what it contains.

    ``(ts, level, fid, n, closed, n_minima, n_contours, n_innermost, max_contour_depth,
    min_contour_depth, nested, shared_contours, shared_depth, max_depth, min_depth,
    shared_contour_ratio, shared_depth_ratio, bcc_fraction, radius)``.  Contour depths count levels
    down to the deepest and the shallowest innermost component; shared contours are those above
    the first branching, itself included; depths are level differences, to minima for max and min;
    bcc_fraction is the share of open components among all it contains; radius that of a circle of n cells.
    """
    found = contours(sets, field, nx, ny)
    inside = containment(sets)
    kids = tree(sets).select("ts", (F.col("level") + 1).alias("level"), F.col("parent").alias("fid")).distinct().withColumn("has", F.lit(1))
    leaf = found.join(kids, ["ts", "level", "fid"], "left").withColumn("leaf", F.col("has").isNull()).select("ts", "level", "fid", "vmin", "closed", "leaf")
    at = inside.join(leaf, ["ts", "level", "fid"])
    per = at.groupBy("ts", "up_level", "up", "level").agg(F.count("*").alias("k"))
    branch = per.groupBy("ts", "up_level", "up").agg(F.max(F.when(F.col("k") > 1, F.col("level"))).alias("branch"), F.max("k").alias("widest"), F.min("level").alias("deepest"))
    value = F.array(*[F.lit(float(v)) for v in sorted(levels)])
    own = at.groupBy("ts", "up_level", "up").agg(
        F.count("*").alias("n_contours"), F.sum(F.col("leaf").cast("int")).alias("n_innermost"), F.max(F.when(F.col("leaf"), F.col("level"))).alias("shallowest"),
        F.min("vmin").alias("low"), F.max(F.when(F.col("leaf"), F.col("vmin"))).alias("high"), F.avg((~F.col("closed")).cast("double")).alias("bcc_fraction"),
    )
    out = own.join(branch, ["ts", "up_level", "up"]).withColumnsRenamed({"up_level": "level", "up": "fid"}).join(found, ["ts", "level", "fid"])
    last = F.coalesce(F.col("branch") + 1, F.col("deepest"))
    top = F.element_at(value, F.col("level") + 1)
    shared, depth = F.col("level") - last + 1, top - F.element_at(value, last + 1)
    return out.select(
        "ts", "level", "fid", "n", "closed", "n_minima", "n_contours", "n_innermost", (F.col("level") - F.col("deepest")).alias("max_contour_depth"), (F.col("level") - F.col("shallowest")).alias("min_contour_depth"),
        (F.col("widest") == 1).alias("nested"), shared.alias("shared_contours"), depth.alias("shared_depth"), (top - F.col("low")).alias("max_depth"), (top - F.col("high")).alias("min_depth"),
        (shared / (F.col("level") - F.col("deepest") + 1)).alias("shared_contour_ratio"), (depth / (top - F.col("low"))).alias("shared_depth_ratio"), "bcc_fraction", F.sqrt(F.col("n") / math.pi).alias("radius"),
    )


def centred(found: DataFrame, least_double: float = 0.5, least_triple: float = 0.7, least_contours: int = 1, max_bcc: float = 1.0) -> DataFrame:
    """Depressions that are cyclones, with their type: SCC, or DCC and TCC where enough contours are shared.

    Of nested ones the outermost; closed, with ``least_contours`` levels and more, and with a
    boundary-crossing share of at most ``max_bcc``.
    """
    n, ratio = F.col("n_minima"), F.col("shared_contour_ratio")
    kind = F.when(n == 1, "SCC").when((n == 2) & (ratio >= least_double), "DCC").when((n == 3) & (ratio >= least_triple), "TCC")
    ok = F.col("closed") & (F.col("max_contour_depth") + 1 >= least_contours) & (F.col("bcc_fraction") <= max_bcc)
    return found.withColumn("type", kind).where(ok & F.col("type").isNotNull())


def outermost(found: DataFrame, inside: DataFrame) -> DataFrame:
    """Those of ``found(ts, level, fid)`` that no other of them contains; ``inside`` as :func:`containment` gives it."""
    keys = found.select("ts", F.col("level").alias("up_level"), F.col("fid").alias("up"))
    covered = inside.where("level < up_level").join(keys, ["ts", "up_level", "up"], "left_semi").select("ts", "level", "fid").distinct()
    return found.join(covered, ["ts", "level", "fid"], "left_anti")


def centre(sets: DataFrame, field: DataFrame, levels: list[float], nx: int, ny: int) -> DataFrame:
    """``(ts, level, fid, xc, yc)``: the mean of a component's minima, weighed by their depth below its level."""
    lows = field_ops.extrema(field, 8, nx, ny).select("ts", "x", "y", F.col("v").alias("low"))
    top = F.element_at(F.array(*[F.lit(float(v)) for v in sorted(levels)]), F.col("level") + 1)
    w = F.sum("w")
    met = sets.join(lows, ["ts", "x", "y"]).withColumn("w", top - F.col("low"))
    return met.groupBy("ts", "level", "fid").agg((F.sum(F.col("w") * F.col("x")) / w).alias("xc"), (F.sum(F.col("w") * F.col("y")) / w).alias("yc"))


def contained(sets: DataFrame, points: DataFrame, levels: list[float]) -> DataFrame:
    """``(ts, level, fid, n_points)``: points ``(ts, x, y, v)`` inside a component at or above its level (maxima, say)."""
    top = F.element_at(F.array(*[F.lit(float(v)) for v in sorted(levels)]), F.col("level") + 1)
    p = points.select("ts", "x", "y", F.col("v").alias("p"))
    return sets.join(p, ["ts", "x", "y"]).where(F.col("p") >= top).groupBy("ts", "level", "fid").agg(F.count("*").alias("n_points"))
