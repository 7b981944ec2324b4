"""Tracking: features of consecutive steps are linked by overlap and size, links are assembled.

A step's features depend on the step before alone, so all pairs of steps are worked on in
parallel: an equi-join on cells gives overlaps, subsets of partners become candidates, a greedy
pass a pair of steps accepts candidates, and tracks are the components of the accepted links.
``steps(ts, seq)`` numbers all processed timesteps, also those without features: an empty step
ends every track.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridtrack import scratch
from gridtrack.operators.components import components

SHIFT = 40  # a vertex is seq * 2**SHIFT + fid


def steps_of(field: DataFrame) -> DataFrame:
    """``(ts, seq)`` of all steps of a field, numbered from 1 by ranges: no task sees them all."""
    ranged = field.select("ts").distinct().repartitionByRange("ts").withColumn("part", F.spark_partition_id())
    ranged = scratch.table(ranged, "steps")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("k"))
    before = sizes.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))  # a row a range
    own = F.row_number().over(Window.partitionBy("part").orderBy("ts"))
    return ranged.join(before, "part").select("ts", (own + F.col("before")).cast("long").alias("seq"))


def overlaps(cells: DataFrame, steps: DataFrame) -> DataFrame:
    """``(seq, fid, nseq, nfid, n_overlap, n, nn)``: features of a step and the next that share cells, with sizes.

    Spark judges tables by the size of their files, far less than their rows take in the driver: no
    join may broadcast what grows with the field.
    """
    own = cells.join(steps.hint("merge"), "ts").select("seq", "x", "y", "fid")
    sizes = own.groupBy("seq", "fid").agg(F.count("*").alias("n"))
    ahead = own.select((F.col("seq") - 1).alias("seq"), "x", "y", F.col("fid").alias("nfid"))
    met = own.join(ahead.hint("merge"), ["seq", "x", "y"]).groupBy("seq", "fid", "nfid").agg(F.count("*").alias("n_overlap"))
    nsizes = sizes.select((F.col("seq") - 1).alias("seq"), F.col("fid").alias("nfid"), F.col("n").alias("nn"))
    return met.join(sizes.hint("merge"), ["seq", "fid"]).join(nsizes.hint("merge"), ["seq", "nfid"]).select("seq", "fid", (F.col("seq") + 1).alias("nseq"), "nfid", "n_overlap", "n", "nn")


def scores(parent: Column, child: Column, overlap: Column, alpha: float, min_size: float, min_overlap: float) -> tuple[Column, Column, Column]:
    p_size = F.least(parent, child) / F.greatest(parent, child)
    p_overlap = 2.0 * overlap / (parent + child)
    total = F.when(p_size >= min_size, (1 - alpha) * p_size).otherwise(0.0) + F.when(p_overlap >= min_overlap, alpha * p_overlap).otherwise(0.0)
    return p_size, p_overlap, total


def candidates(met: DataFrame, alpha: float = 0.5, max_children: int = 4, min_size: float = 0.0, min_overlap: float = 0.0) -> DataFrame:
    """``(seq, forward, parent, children, p_size, p_overlap, p_tot)`` for all subsets of partners.

    Forward: one feature, one or more of the next step; backward: one feature, two or more of the
    step before.  Subsets grow one id at a time, in ascending order, up to ``max_children``, so no
    more are built than are asked for.
    """
    pair = lambda fid, n: F.struct(F.col(fid).alias("fid"), F.col(n).alias("n"), F.col("n_overlap").alias("o"))
    fwd = F.struct(F.lit(True).alias("forward"), F.col("fid").alias("parent"), F.col("n").alias("size"), pair("nfid", "nn").alias("c"))
    bwd = F.struct(F.lit(False).alias("forward"), F.col("nfid").alias("parent"), F.col("nn").alias("size"), pair("fid", "n").alias("c"))
    both = met.select("seq", F.explode(F.array(fwd, bwd)).alias("e")).select("seq", "e.*")
    grown = both.groupBy("seq", "forward", "parent", "size").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    grown = grown.withColumn("sets1", F.transform("cs", lambda c: F.array(c)))
    for k in range(2, max_children + 1):
        more = F.expr(f"flatten(transform(sets{k - 1}, s -> transform(filter(cs, c -> c.fid > element_at(s, -1).fid), c -> concat(s, array(c)))))")
        grown = grown.withColumn(f"sets{k}", more)
    every = F.concat(*(F.col(f"sets{k}") for k in range(1, max_children + 1)))
    out = grown.select("seq", "forward", "parent", "size", F.explode(every).alias("children"))
    out = out.where("forward OR size(children) > 1")
    total = F.aggregate("children", F.lit(0).cast("long"), lambda s, c: s + c.n)
    shared = F.aggregate("children", F.lit(0).cast("long"), lambda s, c: s + c.o)
    p_size, p_overlap, p_tot = scores(F.col("size"), total, shared, alpha, min_size, min_overlap)
    return out.select("seq", "forward", "parent", "size", "children", p_size.alias("p_size"), p_overlap.alias("p_overlap"), p_tot.alias("p_tot"))


def assign(found: DataFrame, min_p_tot: float = 0.0) -> DataFrame:
    """Accepted candidates: the best first, each feature at most once a pair of steps.

    Order: p_tot, backward before forward, more children, larger ids.
    """

    def run(t: pa.Table) -> pa.Table:
        forward, parent, ids, p_tot = (t.column(c).to_pylist() for c in ("forward", "parent", "ids", "p_tot"))
        used: set = set()
        keep = []
        for i in sorted(range(len(ids)), key=lambda i: (-p_tot[i], forward[i], -len(ids[i]), -parent[i], [-c for c in ids[i]])):
            # a feature of the earlier step is (True, fid), of the later step (False, fid)
            own = {(forward[i], parent[i]), *((not forward[i], c) for c in ids[i])}
            if own.isdisjoint(used):
                used |= own
                keep.append(i)
        return t.select(["seq", "forward", "parent", "ids"]).take(pa.array(keep, pa.int64()))

    slim = found.where(F.col("p_tot") >= min_p_tot).select("seq", "forward", "parent", F.transform("children", lambda c: c.fid).alias("ids"), "p_tot")
    won = slim.groupBy("seq").applyInArrow(run, "seq long, forward boolean, parent long, ids array<long>")
    keyed = found.withColumn("ids", F.transform("children", lambda c: c.fid))
    return keyed.join(won.hint("merge"), ["seq", "forward", "parent", "ids"])


def edges(accepted: DataFrame, alpha: float = 0.5) -> DataFrame:
    """``(seq, src, dst, n_overlap, p_share, p_tot, p_size, p_overlap)`` in chronological order."""
    c = accepted.select("*", F.explode("children").alias("c"))
    _, _, alone = scores(F.col("size"), F.col("c.n"), F.col("c.o"), alpha, 0.0, 0.0)
    all_alone = F.aggregate("children", F.lit(0.0), lambda s, z: s + scores(F.col("size"), z.n, z.o, alpha, 0.0, 0.0)[2])
    src = F.when(F.col("forward"), F.col("parent")).otherwise(F.col("c.fid"))
    dst = F.when(F.col("forward"), F.col("c.fid")).otherwise(F.col("parent"))
    share = F.when(F.size("children") == 1, 1.0).otherwise(alone / all_alone)
    return c.select("seq", src.alias("src"), dst.alias("dst"), F.col("c.o").alias("n_overlap"), share.alias("p_share"), "p_tot", "p_size", "p_overlap")


def vertex(seq: Column, fid: Column) -> Column:
    return F.shiftleft(seq.cast("long"), SHIFT) + fid


def vertices(cells: DataFrame, steps: DataFrame, links: DataFrame) -> DataFrame:
    """``(seq, fid, n, n_in, n_out, type)`` of every feature.

    start or genesis without a predecessor, continuation with one, merging with more; /splitting
    with more than one successor, /lysis or /stop at the end; continuation gives way to its suffix.
    """
    own = cells.join(steps.hint("merge"), "ts").groupBy("seq", "fid").agg(F.count("*").alias("n"))
    n_out = links.groupBy("seq", F.col("src").alias("fid")).agg(F.count("*").alias("n_out"))
    n_in = links.groupBy((F.col("seq") + 1).alias("seq"), F.col("dst").alias("fid")).agg(F.count("*").alias("n_in"))
    span = steps.agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    v = own.join(n_out.hint("merge"), ["seq", "fid"], "left").join(n_in.hint("merge"), ["seq", "fid"], "left").na.fill(0, ["n_in", "n_out"]).join(F.broadcast(span))
    base = F.when(F.col("n_in") == 0, F.when(F.col("seq") == F.col("first"), "start").otherwise("genesis")).when(F.col("n_in") == 1, "continuation").otherwise("merging")
    suffix = F.when(F.col("n_out") > 1, "splitting").when(F.col("n_out") == 0, F.when(F.col("seq") == F.col("last"), "stop").otherwise("lysis"))
    kind = F.when(suffix.isNull(), base).when(base == "continuation", suffix).otherwise(F.concat_ws("/", base, suffix))
    return v.select("seq", "fid", "n", "n_in", "n_out", kind.alias("type"))


def tracks(own: DataFrame, links: DataFrame) -> DataFrame:
    """Adds ``track``, the smallest vertex of the component, to ``own(seq, fid, ...)``."""
    ends = links.select(vertex(F.col("seq"), F.col("src")).alias("a"), vertex(F.col("seq") + 1, F.col("dst")).alias("b"))
    roots = components(ends)
    v = own.withColumn("node", vertex(F.col("seq"), F.col("fid")))
    return v.join(roots.hint("merge"), "node", "left").withColumn("track", F.coalesce("root", "node")).drop("node", "root")


def track(cells: DataFrame, steps: DataFrame, alpha: float = 0.5, max_children: int = 4, min_size: float = 0.0, min_overlap: float = 0.0, min_p_tot: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Vertices with their track, and edges."""
    found = scratch.table(candidates(overlaps(cells, steps), alpha, max_children, min_size, min_overlap), "candidates")
    links = scratch.table(edges(assign(found, min_p_tot), alpha), "links")
    return tracks(vertices(cells, steps, links), links), links


def track_stats(cells: DataFrame, steps: DataFrame, own: DataFrame) -> DataFrame:
    """A row a track: duration, sizes, footprint, path of the size-weighted mean centres."""
    placed = cells.join(steps, "ts").join(own.select("seq", "fid", "track"), ["seq", "fid"])
    feet = placed.groupBy("track", "x", "y").agg(F.count("*").alias("k")).groupBy("track").agg(F.count("*").alias("footprint_n"), F.max("k").alias("max_feature_count"))
    per = placed.groupBy("track", "seq").agg(F.count("*").alias("n"), F.avg("x").alias("xm"), F.avg("y").alias("ym"))
    w = Window.partitionBy("track").orderBy("seq")
    moved = F.sqrt(F.pow(F.col("xm") - F.lag("xm").over(w), 2) + F.pow(F.col("ym") - F.lag("ym").over(w), 2))
    path = per.withColumn("moved", F.coalesce(moved, F.lit(0.0))).groupBy("track").agg(
        (F.count("*") - 1).alias("duration"), F.min("seq").alias("seq_start"), F.max("seq").alias("seq_end"),
        F.avg("n").alias("ts_n_mean"), F.median("n").alias("ts_n_median"), F.percentile("n", 0.8).alias("ts_n_p80"), F.percentile("n", 0.9).alias("ts_n_p90"),
        F.sum("moved").alias("distance"),
    )
    sizes = own.groupBy("track").agg(F.count("*").alias("n_features"), F.avg("n").alias("n_mean"), F.median("n").alias("n_median"))
    out = path.join(feet, "track").join(sizes, "track")
    return out.withColumn("velocity", F.when(F.col("duration") > 0, F.col("distance") / F.col("duration")).otherwise(0.0)).withColumn("footprint_n_ts_rel_p80", F.col("footprint_n") / F.col("ts_n_p80"))


def group(table: DataFrame, criteria: dict[str, float]) -> DataFrame:
    """``grp`` 2 where every criterion reaches its threshold, else 1."""
    ok = F.lit(True)
    for name, least in criteria.items():
        ok &= F.col(name) >= least
    return table.withColumn("grp", F.when(ok, 2).otherwise(1))


def project(cells: DataFrame, steps: DataFrame, own: DataFrame) -> DataFrame:
    """Rasters of track id, duration and age; where tracks overlap the larger id wins."""
    v = own.join(own.groupBy("track").agg(F.min("seq").alias("s0"), (F.max("seq") - F.min("seq")).alias("duration")), "track")
    placed = cells.join(steps, "ts").join(v.select("seq", "fid", "track", "s0", "duration"), ["seq", "fid"])
    best = F.max(F.struct("track", "duration", (F.col("seq") - F.col("s0")).alias("age")))
    return placed.groupBy("ts", "x", "y").agg(best.alias("b")).select("ts", "x", "y", F.col("b.track").alias("track"), F.col("b.duration").alias("duration"), F.col("b.age").alias("age"))


def cut_at(own: DataFrame, borders: list[int]) -> DataFrame:
    """Adds ``period``, the number of borders (in seq) at or below a vertex's step: tracks cut at period borders."""
    period = F.lit(0)
    for b in borders:
        period = period + (F.col("seq") >= b).cast("int")
    return own.withColumn("period", period)


def legacy_probability(met: DataFrame, min_overlap: float = 0.1, max_area: float = 1.9, weight: float = 0.5, min_area_prob: float = 0.0) -> DataFrame:
    """Successor probability of the polygon tracker, on cell counts: overlap and area terms, weighted."""
    fraction = 2.0 * F.col("n_overlap") / (F.col("n") + F.col("nn"))
    ratio = F.greatest("n", "nn") / F.least("n", "nn")
    p_o = F.greatest((fraction - min_overlap) / (1 - min_overlap), F.lit(0.0))
    p_a = F.greatest(F.lit(max_area) - ratio, F.lit(0.0)) / (max_area - 1)
    p = F.when(p_a < min_area_prob, 0.0).otherwise(weight * p_o + (1 - weight) * p_a)
    return met.select("seq", "fid", "nfid", p_o.alias("p_o"), p_a.alias("p_a"), p.alias("p"))


def associated(own: DataFrame, steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(track, n_associated, ts_associated)``: features and steps of a track with a partner in ``pairs(ts, fid_a)``."""
    some = pairs.select("ts", F.col("fid_a").alias("fid")).distinct().join(steps, "ts").select("seq", "fid", F.lit(1).alias("hit"))
    met = own.join(some, ["seq", "fid"], "left")
    return met.groupBy("track").agg(F.count("hit").alias("n_associated"), F.countDistinct(F.when(F.col("hit") == 1, F.col("seq"))).alias("ts_associated"))


def measures(cells: DataFrame, steps: DataFrame, own: DataFrame) -> DataFrame:
    """A row a track: further criteria, each by the name it has as a grouping criterion.

    Footprints over sizes, widths (features a step), values of the features' statistics, hull of the
    path of mean centres; a hull of points on a line has the length of their distance and no area.
    """
    from gridtrack.operators import geometry

    placed = cells.join(steps, "ts").join(own.select("seq", "fid", "track"), ["seq", "fid"])
    feet = placed.groupBy("track").agg(F.countDistinct("x", "y").alias("footprint_n"))
    per = placed.groupBy("track", "seq").agg(F.count("*").alias("n"), F.countDistinct("fid").alias("width"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    ts = per.groupBy("track").agg(F.median("n").alias("tmed"), F.percentile("n", 0.9).alias("t90"), F.avg("n").alias("tavg"), F.max("n").alias("tmax"), F.avg("width").alias("mean_width"), F.max("width").alias("max_width"))
    a = F.abs("v")
    feature = placed.groupBy("track", "seq", "fid").agg(F.count("*").alias("n"), F.median("v").alias("med"), F.avg("v").alias("avg"), F.avg(a).alias("aavg"), F.median(a).alias("amed"))
    sizes = feature.groupBy("track").agg(
        F.median("n").alias("nmed"), F.percentile("n", 0.8).alias("n80"), F.avg("n").alias("navg"), F.max("n").alias("nmax"),
        F.median(F.abs("med")).alias("values_med_abs_med"), F.avg(F.abs("avg")).alias("values_mean_abs_mean"), F.median(F.abs("avg")).alias("values_med_abs_mean"),
        F.median("aavg").alias("values_med_mean_abs"), F.median("amed").alias("values_med_med_abs"), F.sort_array(F.collect_list("n")).alias("features_n"),
    )
    w = Window.partitionBy("track").orderBy("seq")
    moved = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    path = per.withColumn("moved", moved).groupBy("track").agg(F.coalesce(F.sum("moved"), F.lit(0.0)).alias("distance"))
    hull = geometry.hulls(per.select("track", "x", "y"), ["track"])
    out = feet.join(ts, "track").join(sizes, "track").join(path, "track").join(hull, "track")
    rel = lambda c: F.col("footprint_n") / F.col(c)
    return out.select(
        "track", F.log10("footprint_n").alias("footprint_n__log10"), (F.col("t90") - F.col("tmed")).alias("features_ts_n__p90_minus_median"),
        rel("nmed").alias("footprint_n_rel__median"), rel("n80").alias("footprint_n_rel__p80"), rel("navg").alias("footprint_n_rel__mean"), rel("nmax").alias("footprint_n_rel__max"),
        rel("tmed").alias("footprint_n_ts_rel__median"), rel("tavg").alias("footprint_n_ts_rel__mean"), rel("tmax").alias("footprint_n_ts_rel__max"),
        "values_med_abs_med", "values_mean_abs_mean", "values_med_abs_mean", "values_med_mean_abs", "values_med_med_abs",
        "mean_width", "max_width", F.col("hull_len").alias("mean_centers_ts_hull_len"), F.col("hull_area").alias("mean_centers_ts_hull_area"),
        F.when(F.col("distance") > 0, F.col("hull_len") / F.col("distance")).otherwise(2.0).alias("mean_centers_ts_hull_len__per__distance_mean_centers"),
        F.when(F.col("hull_len") > 0, F.col("hull_area") / F.col("hull_len")).alias("mean_centers_ts_hull__area_per_len"), F.lit(-1).alias("max_length"), "features_n",
    )


def holes(cells: DataFrame, steps: DataFrame, own: DataFrame) -> DataFrame:
    """``(track, n_holes_sum, n_holes_mean, n_holes_median)`` over a track's features."""
    from gridtrack.operators import rings

    found = rings.rings(cells, 8).where("seq = 0").groupBy("ts", "fid").agg(F.count(F.when(F.col("kind") == "hole", 1)).alias("k"))
    met = found.join(steps, "ts").join(own.select("seq", "fid", "track"), ["seq", "fid"])
    return met.groupBy("track").agg(F.sum("k").alias("n_holes_sum"), F.avg("k").alias("n_holes_mean"), F.median("k").alias("n_holes_median"))


def ages(own: DataFrame) -> DataFrame:
    """``own`` with the age of each vertex: the steps its track has had before."""
    return own.withColumn("age", F.dense_rank().over(Window.partitionBy("track").orderBy("seq")) - 1)


def named(own: DataFrame, steps: DataFrame) -> DataFrame:
    """``(track, id)``: ids as a first timestep times 10,000 and a number from 0, in order of the tracks."""
    first = own.groupBy("track").agg(F.min("seq").alias("seq")).join(steps, "seq")
    return first.select("track", (F.col("ts") * 10_000 + F.row_number().over(Window.partitionBy("ts").orderBy("track")) - 1).alias("id"))


def longest(stats: DataFrame, least: int) -> DataFrame:
    """Tracks of at least that duration."""
    return stats.where(F.col("duration") >= least)


def is_time_to_split(step: int, interval: int) -> bool:
    """Whether active tracks are to be split after the step of this number, counted from 0."""
    return step > 0 and interval > 0 and step % interval == 0
