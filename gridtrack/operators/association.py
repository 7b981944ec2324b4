"""Associations between feature sets of the same timestep, and categories of features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridtrack.operators import features
from gridtrack.operators.components import components


def direct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Features of two sets that share cells: ``(ts, fid_a, fid_b, n_overlap)``."""
    left = a.select("ts", "x", "y", F.col("fid").alias("fid_a"))
    right = b.select("ts", "x", "y", F.col("fid").alias("fid_b"))
    return left.join(right, ["ts", "x", "y"]).groupBy("ts", "fid_a", "fid_b").agg(F.count("*").alias("n_overlap"))


def indirect(ab: DataFrame, bc: DataFrame) -> DataFrame:
    """A-B and B-C give A-C: ``(ts, fid_a, fid_c, n_via)``."""
    right = bc.select("ts", F.col("fid_a").alias("fid_b"), F.col("fid_b").alias("fid_c"))
    return ab.join(right, ["ts", "fid_b"]).groupBy("ts", "fid_a", "fid_c").agg(F.countDistinct("fid_b").alias("n_via"))


def categories(cells: DataFrame, medium: int, large: int) -> DataFrame:
    """``(ts, fid, n, category)``: small, medium and large features; small ones without neighbours
    are clutter0, those without a large neighbour clutter1."""
    sizes = cells.groupBy("ts", "fid").agg(F.count("*").alias("n"))
    pairs = features.neighbours(cells).join(sizes.select("ts", F.col("fid").alias("nfid"), F.col("n").alias("nn")), ["ts", "nfid"])
    near = pairs.groupBy("ts", "fid").agg(F.max("nn").alias("largest"))
    small = F.col("n") < medium
    name = F.when(F.col("n") >= large, "large").when(~small, "medium").when(F.col("largest").isNull(), "clutter0").when(F.col("largest") < large, "clutter1").otherwise("small")
    return sizes.join(near, ["ts", "fid"], "left").select("ts", "fid", "n", name.alias("category"))


def temporal_rescue(cells: DataFrame, named: DataFrame, steps: DataFrame, least: float) -> DataFrame:
    """Clutter that large features of the step before or after cover to a share ``least`` of its size.

    ``steps(ts, seq)`` numbers all processed timesteps.
    """
    own = cells.join(named, ["ts", "fid"]).join(steps, "ts")
    big = own.where("category = 'large'").select(F.explode(F.array(F.col("seq") - 1, F.col("seq") + 1)).alias("seq"), F.col("seq").alias("from"), "x", "y")
    clutter = own.where("category LIKE 'clutter%'")
    met = clutter.join(big, ["seq", "x", "y"]).groupBy("ts", "fid", "n", "from").agg(F.count("*").alias("k"))
    return met.where(F.col("k") >= least * F.col("n")).select("ts", "fid").distinct()


def merge_in_categories(cells: DataFrame, named: DataFrame) -> DataFrame:
    """``(ts, x, y, v, fid, category)``: touching features of one category become one, by the smallest id."""
    own = cells.join(named.select("ts", "fid", "category"), ["ts", "fid"])
    pairs = features.neighbours(cells).select("ts", "fid", "nfid")
    kinds = named.select("ts", "fid", "category")
    same = pairs.join(kinds, ["ts", "fid"]).join(kinds.toDF("ts", "nfid", "other"), ["ts", "nfid"]).where("category = other")
    key = lambda fid: F.shiftleft(F.col("ts"), 40) + F.col(fid)
    roots = components(same.select(key("fid").alias("a"), key("nfid").alias("b")))
    out = own.withColumn("node", key("fid")).join(roots, "node", "left")
    return out.select("ts", "x", "y", "v", F.coalesce(F.col("root") % F.lit(1 << 40), "fid").alias("fid"), "category")


KINDS = ["clutter0", "clutter1", "medium", "large", "small"]


def surgery(cells: DataFrame, medium: int, large: int, big: int) -> DataFrame:
    """Cells with their features' final category: clutter0, clutter1 or large, a step a task.

    Obvious clutter; touching features of a category merged; small ones become medium; medium ones
    that touch clutter1 are clutter1 too; the rest is large, merged again; clutter1 of ``big`` cells
    and more is clutter0.  The same as :func:`categories` and :func:`merge_in_categories` in turn, but
    a step's cells are bounded by its grid and steps never meet: one shuffle, nothing is joined.
    """

    def run(t: pa.Table) -> pa.Table:
        x, y, fid = (t.column(c).to_numpy().astype(np.int64) for c in ("x", "y", "fid"))
        names, at = np.unique(fid, return_inverse=True)
        a, b = features.touching(features.cell_numbers(x, y), at)
        n = np.bincount(at, minlength=len(names))
        nearest = np.full(len(names), -1)  # the largest neighbour's size
        np.maximum.at(nearest, np.r_[a, b], n[np.r_[b, a]])
        kind = np.select([n >= large, n >= medium, nearest < 0, nearest < large], [3, 2, 0, 1], 4)
        same = kind[a] == kind[b]
        root = features.least(len(names), a[same], b[same])
        kind[kind == 4] = 2
        other = root[a] != root[b]
        a, b = np.r_[a[other], b[other]], np.r_[b[other], a[other]]
        hit = np.zeros(len(names), bool)
        hit[root[a[kind[b] == 1]]] = True
        kind = np.where(kind == 2, np.where(hit[root], 1, 3), kind)
        same = kind[a] == kind[b]
        root = features.least(len(names), np.r_[np.arange(len(names)), a[same]], np.r_[root, b[same]])
        total = np.bincount(root, n, len(names))
        kind[(kind == 1) & (total[root] >= big)] = 0
        t = t.set_column(t.schema.get_field_index("fid"), "fid", pa.array(names[root][at]))
        return t.append_column("category", pa.array(np.array(KINDS)[kind][at].tolist(), pa.string()))

    cells = cells.select(F.col("ts").cast("long").alias("ts"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("v").cast("double").alias("v"), F.col("fid").cast("long").alias("fid"))
    return cells.groupBy("ts").applyInArrow(run, f"{features.CELLS_DDL}, category string")


def associates(pairs: DataFrame, names: list[str], empty: bool = False) -> DataFrame:
    """``(ts, fid_a, name, n)``: how many partners of each name a feature of ``pairs(ts, fid_a, name, fid_b)`` has."""
    n = pairs.where(F.col("name").isin(names)).groupBy("ts", "fid_a", "name").agg(F.countDistinct("fid_b").alias("n"))
    if not empty:
        return n
    every = pairs.select("ts", "fid_a").distinct().withColumn("name", F.explode(F.array(*map(F.lit, names))))
    return every.join(n, ["ts", "fid_a", "name"], "left").na.fill(0, ["n"])


def resolved(pairs: DataFrame, known: DataFrame, missing: str = "error") -> DataFrame:
    """``pairs(ts, fid_a, fid_b)`` whose partner is in ``known(ts, fid)``; others are an error, or ignored."""
    if missing not in ("error", "ignore"):
        raise ValueError(missing)
    there = known.select("ts", F.col("fid").alias("fid_b")).distinct()
    if missing == "error" and pairs.join(there, ["ts", "fid_b"], "left_anti").limit(1).count():
        raise ValueError("a partner is not there")
    return pairs.join(there, ["ts", "fid_b"], "left_semi")
