"""Post-processing of track graphs: weak edges, adjacent features, partial tracks, segments, stubs.

Vertices ``(seq, fid, n, track)``, edges ``(seq, src, dst, n_overlap, ...)`` from a step to the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridtrack import scratch
from gridtrack.operators.components import components
from gridtrack.operators.features import cell_numbers, least, touching
from gridtrack.operators.tracking import overlaps, scores, vertex


def rescore(links: DataFrame, sizes: DataFrame, alpha: float = 0.5) -> DataFrame:
    """``(seq, src, dst, n_overlap, p_share, p_tot, p_size, p_overlap)`` of the edges as they are.

    An edge of a feature with several successors is scored with all of them, else one of a feature
    with several predecessors with all of those; no least size or overlap.  ``sizes(seq, fid, n)``.
    """
    a = sizes.select("seq", F.col("fid").alias("src"), "n")
    b = sizes.select((F.col("seq") - 1).alias("seq"), F.col("fid").alias("dst"), F.col("n").alias("nn"))
    e = links.select("seq", "src", "dst", "n_overlap").join(a.hint("merge"), ["seq", "src"]).join(b.hint("merge"), ["seq", "dst"])
    out, into = Window.partitionBy("seq", "src"), Window.partitionBy("seq", "dst")
    e = e.withColumns({"n_out": F.count("*").over(out), "n_in": F.count("*").over(into), "nn_all": F.sum("nn").over(out), "o_out": F.sum("n_overlap").over(out), "n_all": F.sum("n").over(into), "o_in": F.sum("n_overlap").over(into)})
    split, merge = F.col("n_out") > 1, F.col("n_in") > 1
    parent = F.when(split, F.col("n")).when(merge, F.col("nn")).otherwise(F.col("n"))
    child = F.when(split, F.col("nn_all")).when(merge, F.col("n_all")).otherwise(F.col("nn"))
    shared = F.when(split, F.col("o_out")).when(merge, F.col("o_in")).otherwise(F.col("n_overlap"))
    p_size, p_overlap, p_tot = scores(parent, child, shared, alpha, 0.0, 0.0)
    e = e.withColumns({"p_size": p_size, "p_overlap": p_overlap, "p_tot": p_tot, "alone": scores(F.col("n"), F.col("nn"), F.col("n_overlap"), alpha, 0.0, 0.0)[2]})
    share = F.when(split, F.col("alone") / F.sum("alone").over(out)).when(merge, F.col("alone") / F.sum("alone").over(into)).otherwise(F.lit(1.0))
    return e.select("seq", "src", "dst", "n_overlap", share.alias("p_share"), "p_tot", "p_size", "p_overlap")


def remove_weak(links: DataFrame, sizes: DataFrame, least: float, alpha: float = 0.5, max_rounds: int = 50) -> DataFrame:
    """Edges rescored, those below ``least`` removed, and so on until none is."""
    now = scratch.table(rescore(links, sizes, alpha), "edges")
    for _ in range(max_rounds):
        if not now.where(F.col("p_tot") < least).limit(1).count():
            return now
        was, now = now, scratch.table(rescore(now.where(F.col("p_tot") >= least), sizes, alpha), "edges")
        scratch.drop(was)
    raise RuntimeError("weak edges remain")


def merge_in_tracks(cells: DataFrame, steps: DataFrame, own: DataFrame, links: DataFrame, alpha: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Cells with touching features of a track and step made one, and the edges between what they became.

    The smallest id names the merged one.  Edges join what had an edge before, scored anew.  A step is
    a task, as in labelling; no join sends its rows through the driver.
    """
    alone = vertex(F.col("seq"), F.col("fid"))  # the track of a feature that ``own`` lacks
    placed = cells.join(steps.hint("merge"), "ts").join(own.select("seq", "fid", "track").hint("merge"), ["seq", "fid"], "left")
    placed = placed.select("ts", "seq", "x", "y", "v", "fid", F.coalesce("track", alone).alias("track"))

    def run(t: pa.Table) -> pa.Table:
        names, first, at = np.unique(t.column("fid").to_numpy(), return_index=True, return_inverse=True)
        a, b = touching(cell_numbers(t.column("x").to_numpy(), t.column("y").to_numpy()), at)
        track = t.column("track").to_numpy()[first]
        same = track[a] == track[b]
        return t.set_column(t.schema.get_field_index("track"), "name", pa.array(names[least(len(names), a[same], b[same])][at]))

    merged = scratch.table(placed.groupBy("seq").applyInArrow(run, "ts long, seq long, x int, y int, v double, fid long, name long"), "merged")
    roots = scratch.table(merged.select("seq", "fid", "name").distinct(), "roots")

    def named(edges: DataFrame, end: str, shift: int) -> DataFrame:
        root = roots.select((F.col("seq") - shift).alias("seq"), F.col("fid").alias(end), "name").hint("merge")
        return edges.join(root, ["seq", end], "left").withColumn(end, F.coalesce("name", end)).drop("name")

    whole = merged.select("ts", "x", "y", "v", F.col("name").alias("fid"))
    edges = named(named(links.select("seq", "src", "dst"), "src", 0), "dst", 1).distinct()
    found = overlaps(whole, steps).select("seq", F.col("fid").alias("src"), F.col("nfid").alias("dst"), "n_overlap")
    sizes = merged.groupBy("seq", F.col("name").alias("fid")).agg(F.count("*").alias("n"))
    return whole, rescore(edges.join(found.hint("merge"), ["seq", "src", "dst"]), sizes, alpha)


def cut_off(own: DataFrame, links: DataFrame, until: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices with ``part`` 0 up to ``until`` and 1 from then on, the edges that stay, and those lost between."""
    return own.withColumn("part", (F.col("seq") > until).cast("int")), links.where(F.col("seq") != until), links.where(F.col("seq") == until)


def merge_partial(own: DataFrame, links: DataFrame, lost: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inverse of :func:`cut_off`.  Lost edges whose ends are not there are an error."""
    whole = own.drop("part").distinct()
    for end, shift in (("src", 0), ("dst", 1)):
        gone = lost.select((F.col("seq") + shift).alias("seq"), F.col(end).alias("fid")).join(whole.select("seq", "fid"), ["seq", "fid"], "left_anti")
        if gone.limit(1).count():
            raise ValueError("an edge leads to a feature that no part has")
    return whole, links.unionByName(lost)


def completeness(own: DataFrame, links: DataFrame, lost: DataFrame) -> DataFrame:
    """``(track, part, n_features, n_missing, complete)``: parts of tracks and how many lost edges leave them."""
    ends = lost.select("seq", F.col("src").alias("fid")).unionByName(lost.select((F.col("seq") + 1).alias("seq"), F.col("dst").alias("fid")))
    n = ends.groupBy("seq", "fid").agg(F.count("*").alias("k"))
    out = own.join(n, ["seq", "fid"], "left").groupBy("track", "part").agg(F.count("*").alias("n_features"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_missing"))
    return out.withColumn("complete", F.col("n_missing") == 0)


def heads(own: DataFrame, links: DataFrame) -> DataFrame:
    """Vertices without a successor, and whether they are of the last step (their track is active)."""
    last = own.agg(F.max("seq").alias("last"))
    ends = own.join(links.select("seq", F.col("src").alias("fid")).distinct(), ["seq", "fid"], "left_anti")
    return ends.join(F.broadcast(last)).select("seq", "fid", "track", (F.col("seq") == F.col("last")).alias("active"))


def finished(own: DataFrame, links: DataFrame) -> DataFrame:
    """``(track, seq_start, finished)``: a track is finished when none of its heads is active."""
    active = heads(own, links).groupBy("track").agg(F.max(F.col("active").cast("int")).alias("active"))
    return own.groupBy("track").agg(F.min("seq").alias("seq_start")).join(active, "track").select("track", "seq_start", (F.col("active") == 0).alias("finished"))


def window(own: DataFrame, links: DataFrame, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """Vertices of the steps ``first`` to ``last``, and the edges with both ends among them."""
    return own.where(F.col("seq").between(first, last)), links.where(F.col("seq").between(first, last - 1))


def outside(first: Column, last: Column, start: int, end: int, strict: bool) -> Column:
    """Whether a track's steps are outside a range: strictly, begin before it or end after it; else wholly."""
    return (first < start) | (last > end) if strict else (last < start) | (first > end)


def biggest(own: DataFrame, most: int, skip: int = 0) -> DataFrame:
    """Vertices of the ``most`` tracks with most features after the first ``skip``, ties to the smaller id."""
    top = own.groupBy("track").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "track").offset(skip).limit(most)
    return own.join(top.select("track"), "track", "left_semi")


def degrees(own: DataFrame, links: DataFrame) -> DataFrame:
    """``own`` with ``n_in`` and ``n_out``."""
    n_out = links.groupBy("seq", F.col("src").alias("fid")).agg(F.count("*").alias("n_out"))
    n_in = links.groupBy((F.col("seq") + 1).alias("seq"), F.col("dst").alias("fid")).agg(F.count("*").alias("n_in"))
    return own.join(n_out, ["seq", "fid"], "left").join(n_in, ["seq", "fid"], "left").na.fill(0, ["n_in", "n_out"])


def segments(own: DataFrame, links: DataFrame) -> DataFrame:
    """``own`` with ``segment``: vertices joined by edges that neither split nor merge; the smallest names it."""
    d = degrees(own, links)
    plain = links.join(d.where("n_out = 1").select("seq", F.col("fid").alias("src")), ["seq", "src"], "left_semi")
    plain = plain.join(d.where("n_in = 1").select((F.col("seq") - 1).alias("seq"), F.col("fid").alias("dst")), ["seq", "dst"], "left_semi")
    roots = components(plain.select(vertex(F.col("seq"), F.col("src")).alias("a"), vertex(F.col("seq") + 1, F.col("dst")).alias("b")))
    v = d.withColumn("node", vertex(F.col("seq"), F.col("fid")))
    return v.join(roots, "node", "left").withColumn("segment", F.coalesce("root", "node")).drop("node", "root")


def stubs(own: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """``(seq, fid)`` of the vertices of end branches of at most ``n`` steps that go.

    An end branch is a segment that begins where a feature splits and ends without a successor, or
    ends where features merge and begins without a predecessor.  Where all branches of a split (or
    merging) are that short, the most significant stays: the longest, then the largest, then the
    smallest id.
    """
    v = scratch.table(segments(own, links), "segments")
    seg = v.groupBy("segment").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.sum("n").alias("size"), F.min_by("n_in", "seq").alias("n_in"), F.max_by("n_out", "seq").alias("n_out"), F.min_by("fid", "seq").alias("head"), F.max_by("fid", "seq").alias("tail"))
    seg = seg.withColumn("length", F.col("last") - F.col("first") + 1)
    d = degrees(own, links)
    before = links.join(d.where("n_out > 1").select("seq", F.col("fid").alias("src")), ["seq", "src"], "left_semi").select((F.col("seq") + 1).alias("first"), F.col("dst").alias("head"), vertex(F.col("seq"), F.col("src")).alias("at"))
    after = links.join(d.where("n_in > 1").select((F.col("seq") - 1).alias("seq"), F.col("fid").alias("dst")), ["seq", "dst"], "left_semi").select(F.col("seq").alias("last"), F.col("src").alias("tail"), vertex(F.col("seq") + 1, F.col("dst")).alias("at"))
    split = seg.join(before, ["first", "head"]).select("segment", "at", "length", "size", ((F.col("n_in") == 1) & (F.col("n_out") == 0) & (F.col("length") <= n)).alias("short"))
    merge = seg.join(after, ["last", "tail"]).select("segment", "at", "length", "size", ((F.col("n_out") == 1) & (F.col("n_in") == 0) & (F.col("length") <= n)).alias("short"))
    gone = []
    for branches in (split, merge):
        w = Window.partitionBy("at")
        rank = F.row_number().over(w.orderBy(F.col("short"), F.desc("length"), F.desc("size"), "segment"))
        gone.append(branches.withColumn("rank", rank).where("short AND rank > 1").select("segment"))
    return v.join(gone[0].unionByName(gone[1]).distinct(), "segment", "left_semi").select("seq", "fid")


def without(own: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges without the vertices ``gone(seq, fid)``."""
    kept = links.join(gone.select("seq", F.col("fid").alias("src")), ["seq", "src"], "left_anti")
    kept = kept.join(gone.select((F.col("seq") - 1).alias("seq"), F.col("fid").alias("dst")), ["seq", "dst"], "left_anti")
    return own.join(gone, ["seq", "fid"], "left_anti"), kept


def event_types(own: DataFrame, links: DataFrame, edge: DataFrame, steps: DataFrame) -> DataFrame:
    """``(seq, fid, event)``: isolated, enter and exit (at the domain's edge), start and stop, genesis and
    lysis, merging, splitting, else continuation.  ``edge(seq, fid)`` are features at the domain's edge.
    """
    span = steps.agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    v = degrees(own, links).join(edge.select("seq", "fid", F.lit(1).alias("rim")).distinct(), ["seq", "fid"], "left").join(F.broadcast(span))
    rim = F.col("rim").isNotNull()
    born = F.when(F.col("seq") == F.col("first"), "start").when(rim, "enter").otherwise("genesis")
    died = F.when(F.col("seq") == F.col("last"), "stop").when(rim, "exit").otherwise("lysis")
    event = F.when((F.col("n_in") == 0) & (F.col("n_out") == 0), "isolated").when(F.col("n_in") == 0, born).when(F.col("n_out") == 0, died)
    event = event.when(F.col("n_in") > 1, "merging").when(F.col("n_out") > 1, "splitting").otherwise("continuation")
    return v.select("seq", "fid", event.alias("event"))


def bridges(cells: DataFrame, steps: DataFrame, own: DataFrame, links: DataFrame) -> DataFrame:
    """``(seq, src, dst, n_overlap)``: placeholders over exactly one missed step.

    A feature without successor and one two steps on without predecessor that share cells; each is
    the other's best by shared cells, then by the smaller id.
    """
    d = degrees(own, links)
    own_cells = cells.join(steps, "ts").select("seq", "x", "y", "fid")
    ends = own_cells.join(d.where("n_out = 0").select("seq", "fid"), ["seq", "fid"], "left_semi")
    begins = own_cells.join(d.where("n_in = 0").select("seq", "fid"), ["seq", "fid"], "left_semi").select((F.col("seq") - 2).alias("seq"), "x", "y", F.col("fid").alias("dst"))
    met = ends.join(begins, ["seq", "x", "y"]).groupBy("seq", F.col("fid").alias("src"), "dst").agg(F.count("*").alias("n_overlap"))
    best = lambda end, other: F.row_number().over(Window.partitionBy("seq", end).orderBy(F.desc("n_overlap"), other))
    return met.withColumns({"a": best("src", "dst"), "b": best("dst", "src")}).where("a = 1 AND b = 1").drop("a", "b")
