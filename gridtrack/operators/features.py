"""Features: connected sets of cells above a threshold, one row a cell ``(ts, x, y, v, fid)``.

``fid`` is the smallest cell number ``x * 2**20 + y`` of the feature, so it does not depend on any
order of creation.  A timestep is the unit of work: its cells are bounded by the grid, its features
are labelled in one vectorised pass, and steps never meet, so there is one shuffle by ``ts``.
:func:`label_graph` labels without that bound, as components of the cell graph.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridtrack.operators import field_ops
from gridtrack.operators.components import components

ROW = 1 << 20
KEY = ["ts", "fid"]
CELLS_DDL = "ts long, x int, y int, v double, fid long"


def cell_number(x: Column, y: Column) -> Column:
    return x.cast("long") * ROW + y


def cell_numbers(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) * ROW + y


def _labels(ids: np.ndarray, connectivity: int) -> np.ndarray:
    """Smallest connected cell number of each of the sorted cell numbers."""
    n = len(ids)
    steps = [1, ROW] if connectivity == 4 else [1, ROW, ROW + 1, ROW - 1]
    a, b = [], []
    for s in steps:
        at = np.searchsorted(ids, ids + s)
        hit = np.flatnonzero((at < n) & (ids[np.minimum(at, n - 1)] == ids + s))
        a.append(hit)
        b.append(at[hit])
    return ids[least(n, np.concatenate(a), np.concatenate(b))]


def least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest that the edges between ``a`` and ``b`` connect it to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def touching(number: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unlike groups ``of`` cells that touch, one for each pair of touching cells; cells may be repeated."""
    order = np.argsort(number, kind="stable")
    ids, of = number[order], of[order]
    a, b = [], []
    for s in (1, ROW, ROW + 1, ROW - 1):
        lo = np.searchsorted(ids, ids + s)
        k = np.searchsorted(ids, ids + s, "right") - lo
        a.append(np.repeat(of, k))
        b.append(of[np.arange(k.sum()) + np.repeat(lo - np.cumsum(k) + k, k)])
    a, b = np.concatenate(a), np.concatenate(b)
    return a[a != b], b[a != b]


def label(cells: DataFrame, connectivity: int = 8) -> DataFrame:
    """Adds ``fid`` to cells ``(ts, x, y, v)``; repeated cells share a feature."""

    def run(t: pa.Table) -> pa.Table:
        number = t.column("x").to_numpy().astype(np.int64) * ROW + t.column("y").to_numpy()
        ids, back = np.unique(number, return_inverse=True)
        return t.append_column("fid", pa.array(_labels(ids, connectivity)[back]))

    cells = cells.select(F.col("ts").cast("long").alias("ts"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("v").cast("double").alias("v"))
    return cells.groupBy("ts").applyInArrow(run, CELLS_DDL)


def label_graph(cells: DataFrame, connectivity: int = 8) -> DataFrame:
    """As :func:`label`, for steps too large for a task: components of the graph of cells.

    ``ts`` must fit 23 bits (number the steps first) and x 20 bits.
    """
    own = cells.withColumn("c", F.shiftleft(F.col("ts").cast("long"), 40) + cell_number(F.col("x"), F.col("y")))
    steps = [(0, 1), (1, 0)] if connectivity == 4 else [(0, 1), (1, 0), (1, 1), (1, -1)]
    ahead = own.select(F.col("c").alias("a"), F.explode(F.array(*[F.col("c") + (dx * ROW + dy) for dx, dy in steps])).alias("b"))
    roots = components(ahead.join(own.select(F.col("c").alias("b")), "b"))
    out = own.join(roots, own["c"] == roots["node"], "left")
    return out.select("ts", "x", "y", "v", (F.coalesce("root", "c") % F.lit(1 << 40)).alias("fid"))


def find(field: DataFrame, lower: float | None = None, upper: float | None = None, connectivity: int = 8, minsize: int = 1, maxsize: int | None = None) -> DataFrame:
    """Features of ``lower <= v < upper`` with a size in range.  None: no bound."""
    cells = field
    if lower is not None:
        cells = cells.where(F.col("v") >= lower)
    if upper is not None:
        cells = cells.where(F.col("v") < upper)
    out = label(cells, connectivity)
    if minsize > 1 or maxsize is not None:
        n = F.count("*").over(Window.partitionBy(*KEY))
        out = out.withColumn("_n", n).where((F.col("_n") >= minsize) & (F.col("_n") <= maxsize if maxsize is not None else F.lit(True))).drop("_n")
    return out


def stats(cells: DataFrame) -> DataFrame:
    """Size and min, max, mean, median, sum of values and absolute values, bounding box and centre."""
    a = F.abs("v")
    return cells.groupBy(*KEY).agg(
        F.count("*").alias("n"),
        *[f(c).alias(f"{name}{suffix}") for c, suffix in ((F.col("v"), ""), (a, "_abs")) for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("median", F.median), ("sum", F.sum))],
        F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"),
        F.bround(F.avg("x"), 0).cast("int").alias("xc"), F.bround(F.avg("y"), 0).cast("int").alias("yc"),
    )


def sent(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each cell at each neighbouring place: ``(ts, x, y, nfid)``.

    Spark takes these rows for as few as the cells, in the size of their file; the hint keeps joins
    from sending all of them through the driver.
    """
    offs = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    return cells.select("ts", "x", "y", "fid", F.explode(offs).alias("o")).select("ts", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), F.col("fid").alias("nfid")).hint("merge")


def boundary(cells: DataFrame, connectivity: int = 8) -> DataFrame:
    """Cells with a neighbour, by the inverse connectivity, outside their feature; the domain edge counts."""
    offsets = field_ops.FOUR if connectivity == 8 else field_ops.EIGHT
    near = cells.join(sent(cells, offsets), ["ts", "x", "y"], "left")
    inside = F.count(F.when(F.col("nfid") == F.col("fid"), 1))
    return near.groupBy("ts", "x", "y", "fid").agg(inside.alias("k")).where(F.col("k") < len(offsets)).drop("k")


def neighbours(cells: DataFrame) -> DataFrame:
    """Pairs of features that touch, both ways, with the number of touching cell pairs: ``(ts, fid, nfid, contacts)``."""
    near = cells.join(sent(cells, field_ops.EIGHT), ["ts", "x", "y"]).where("nfid <> fid")
    return near.groupBy("ts", "fid", "nfid").agg(F.count("*").alias("contacts"))


def shared_boundary(cells: DataFrame, connectivity: int = 8) -> DataFrame:
    """For each feature, boundary cells next to background only, and next to each neighbour."""
    rim = boundary(cells, connectivity)
    near = rim.join(sent(cells, field_ops.EIGHT), ["ts", "x", "y"], "left").where("nfid IS NULL OR nfid <> fid")
    met = near.groupBy("ts", "fid", "nfid").agg(F.countDistinct("x", "y").alias("cells"))
    touching = near.where("nfid IS NOT NULL").select("ts", "x", "y", "fid").distinct()
    free = rim.join(touching, ["ts", "x", "y", "fid"], "left_anti").groupBy("ts", "fid").agg(F.count("*").alias("cells"))
    return met.where("nfid IS NOT NULL").unionByName(free.select("ts", "fid", F.lit(-1).cast("long").alias("nfid"), "cells"))


def seeded(cells: DataFrame, seeds: DataFrame) -> DataFrame:
    """Features that hold one of the cells ``seeds(ts, x, y)``."""
    hit = cells.join(seeds.select("ts", "x", "y").distinct(), ["ts", "x", "y"]).select(*KEY).distinct()
    return cells.join(hit, KEY, "left_semi")


def merge_adjacent(cells: DataFrame) -> DataFrame:
    """Touching features become one, named by the smallest of their ids."""
    return label(cells.select("ts", "x", "y", "v"), 8)


def grow(cells: DataFrame, nx: int, ny: int, steps: int = 1) -> DataFrame:
    """Grow all features by ``steps`` rings of free cells; grown cells have no value.

    A contested cell goes to the feature with most direct neighbours of it, then most diagonal
    ones, then the larger feature, then the smaller id.
    """
    for _ in range(steps):
        direct = sent(cells, field_ops.FOUR).withColumn("d", F.lit(1))
        diagonal = sent(cells, [o for o in field_ops.EIGHT if o not in field_ops.FOUR]).withColumn("d", F.lit(0))
        sizes = cells.groupBy(*KEY).agg(F.count("*").alias("size")).withColumnRenamed("fid", "nfid")
        claims = direct.unionByName(diagonal).where(F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1))
        claims = claims.join(cells.select("ts", "x", "y"), ["ts", "x", "y"], "left_anti")
        claims = claims.groupBy("ts", "x", "y", "nfid").agg(F.sum("d").alias("direct"), F.sum(1 - F.col("d")).alias("diagonal")).join(sizes, ["ts", "nfid"])
        best = F.max_by("nfid", F.struct("direct", "diagonal", "size", (-F.col("nfid")).alias("i")))
        new = claims.groupBy("ts", "x", "y").agg(best.alias("fid")).select("ts", "x", "y", F.lit(None).cast("double").alias("v"), "fid")
        cells = cells.unionByName(new)
    return cells


def split(cells: DataFrame, level: float, connectivity: int = 8, seed_minsize: int = 1) -> DataFrame:
    """Split features at a level: parts above it are seeds that grow back over their feature.

    Each ring of free cells of the feature goes to the seed with most direct, then diagonal
    neighbours, then the larger part, then the stronger (sum of values), then the smaller id.  A
    feature without seed stays whole.
    """
    near = [(dx, dy, int(dx == 0 or dy == 0)) for dx, dy in field_ops.EIGHT]

    def run(t: pa.Table) -> pa.Table:
        x, y, v, fid = (t.column(c).to_numpy() for c in ("x", "y", "v", "fid"))
        number = x.astype(np.int64) * ROW + y
        place = {int(c): i for i, c in enumerate(number)}
        high = np.flatnonzero(v >= level)
        part = np.full(len(number), -1, np.int64)
        if len(high):
            order = np.argsort(number[high])
            part[high[order]] = _labels(number[high[order]], connectivity)
            names, size = np.unique(part[high], return_counts=True)
            for name in names[size < seed_minsize]:
                part[part == name] = -1
        has = set(fid[part >= 0].tolist())
        free = [i for i in range(len(number)) if part[i] < 0 and fid[i] in has]
        while free:
            sizes = dict(zip(*(z.tolist() for z in np.unique(part[part >= 0], return_counts=True)), strict=True))
            sums: dict[int, float] = {}
            for p, z in zip(part[part >= 0].tolist(), v[part >= 0].tolist(), strict=True):
                sums[p] = sums.get(p, 0.0) + z
            won, rest = [], []
            for i in free:
                claims: dict[int, list[int]] = {}
                for dx, dy, d in near:
                    j = place.get(int(number[i]) + dx * ROW + dy)
                    if j is not None and part[j] >= 0 and fid[j] == fid[i] and (d or connectivity == 8):
                        claims.setdefault(int(part[j]), [0, 0])[1 - d] += 1
                if claims:
                    won.append((i, max(claims, key=lambda p: (*claims[p], sizes[p], sums[p], -p))))
                else:
                    rest.append(i)
            if not won:
                break
            for i, p in won:
                part[i] = p
            free = rest
        out = np.where(part >= 0, part, fid)
        # a part is named by its smallest cell
        least: dict[int, int] = {}
        for p, c in zip(out.tolist(), number.tolist(), strict=True):
            least[p] = min(least.get(p, c), c)
        return t.set_column(t.schema.get_field_index("fid"), "fid", pa.array([least[p] for p in out.tolist()], pa.int64()))

    return cells.groupBy("ts").applyInArrow(run, CELLS_DDL)


def cluster_filter(mask: DataFrame, minsize: int) -> DataFrame:
    """Cells ``(ts, x, y)`` of 8-connected clusters with at least ``minsize`` cells."""
    return find(mask.withColumn("v", F.lit(1.0)), minsize=minsize).select("ts", "x", "y")


def distance_to_features(cells: DataFrame, nx: int, ny: int) -> DataFrame:
    """Distance in cells of every grid cell of the cells' steps to the nearest feature cell.

    A step is a task, bounded by its grid.  Separable: along each row to the nearest feature cell,
    then the least of dx^2 + dy^2 over the rows, a row at a time.
    """

    def run(t: pa.Table) -> pa.Table:
        hit = np.zeros((nx, ny), bool)
        hit[t.column("x").to_numpy(), t.column("y").to_numpy()] = True
        at = np.arange(nx)[:, None]
        left = np.maximum.accumulate(np.where(hit, at, -(1 << 30)), axis=0)
        right = np.minimum.accumulate(np.where(hit, at, 1 << 30)[::-1], axis=0)[::-1]
        d2 = np.minimum(at - left, right - at).astype(float) ** 2
        best = np.full((nx, ny), np.inf)
        for y in range(ny):
            best = np.minimum(best, d2[:, y : y + 1] + (np.arange(ny) - y)[None, :] ** 2)
        x, y = np.meshgrid(np.arange(nx), np.arange(ny), indexing="ij")
        ts = t.column("ts")[0].as_py()
        return pa.table({"ts": pa.array(np.full(nx * ny, ts, np.int64)), "x": pa.array(x.ravel(), pa.int32()), "y": pa.array(y.ravel(), pa.int32()), "dist": pa.array(np.sqrt(best).ravel())})

    return cells.select("ts", "x", "y").groupBy("ts").applyInArrow(run, "ts long, x int, y int, dist double")


def replace_values(cells: DataFrame, field: DataFrame) -> DataFrame:
    """Cells with the values of another field; null where it has none."""
    return cells.drop("v").join(field.select("ts", "x", "y", "v"), ["ts", "x", "y"], "left").select("ts", "x", "y", "v", "fid")


def on_mask(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """``(ts, fid, n, n_mask)``: size, and cells on ``mask(ts, x, y)``."""
    m = mask.select("ts", "x", "y").distinct().withColumn("m", F.lit(1))
    return cells.join(m, ["ts", "x", "y"], "left").groupBy(*KEY).agg(F.count("*").alias("n"), F.count("m").alias("n_mask"))


def overlapping_boxes(cells: DataFrame, bin: int = 16) -> DataFrame:
    """Pairs ``fid < nfid`` of a step whose bounding boxes meet, with the meeting box.

    Boxes are sent to the bins of a coarse grid that they touch; a pair is taken in the bin of its
    meeting box's lower corner.
    """
    box = cells.groupBy(*KEY).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    bins = lambda a, b: F.sequence(F.floor(F.col(a) / bin), F.floor(F.col(b) / bin))
    dealt = box.withColumn("bx", F.explode(bins("x0", "x1"))).withColumn("by", F.explode(bins("y0", "y1")))
    other = dealt.toDF("ts", "nfid", "nx0", "nx1", "ny0", "ny1", "bx", "by")
    met = dealt.join(other, ["ts", "bx", "by"]).where("fid < nfid AND x0 <= nx1 AND nx0 <= x1 AND y0 <= ny1 AND ny0 <= y1")
    met = met.where((F.col("bx") == F.floor(F.greatest("x0", "nx0") / bin)) & (F.col("by") == F.floor(F.greatest("y0", "ny0") / bin)))
    return met.select("ts", "fid", "nfid", F.greatest("x0", "nx0").alias("xmin"), F.greatest("y0", "ny0").alias("ymin"), F.least("x1", "nx1").alias("xmax"), F.least("y1", "ny1").alias("ymax"))
