"""Approximate nearest neighbours by shifted space-filling curves.

Each curve projects the vectors onto a few random orthogonal directions, shifts and quantises
them, and orders them along a Hilbert curve.  The order is cut into blocks of about ``block`` rows
at quantiles of the keys of PLACES rows a block, chosen by hash; a query meets the blocks that its window touches, keeps the
best of each, and the windows of all curves are merged and ranked by the inner product of the
original vectors in double precision.

The width of the window, a share of the order, is fitted: the smallest at which a bounded sample
of queries against a bounded sample of rows reaches ``target`` recall.  Data without structure in
any few directions need wide windows, clustered data narrow ones; the share found is reported by
:func:`plan`.

Scores of what a block finds best are summed again in one order, a component after the other, so
that a pair's score does not depend on the block it was found in.  Equal vectors are folded beforehand and expanded at the end: only the k + 1 smallest ids of a group
can be among k neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridtrack.llm.common import scratch

CURVES = 4
DIMS = 8
BITS = 4
SAMPLE = 4096
PROBES = 192
BLOCK = 8192
PLACES = 8  # keys a block that the cuts are taken from
QUERIES = 8192  # of one block's task


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points, by the transposed Gray-code transform."""
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            t = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[:, n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


@dataclass
class Curve:
    """One ordering: directions, cuts of each direction, sorted keys of the sample."""

    directions: np.ndarray
    cuts: np.ndarray
    keys: np.ndarray

    def key(self, v: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Curve position; equal positions are spread by a hash of the id."""
        y = v @ self.directions
        cells = np.stack([np.searchsorted(c, y[:, i]) for i, c in enumerate(self.cuts)], axis=1) if len(v) else np.zeros((0, len(self.cuts)), np.int64)
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        return hilbert(cells, BITS) << 20 | mixed.astype(np.int64)

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Share of the order that lies before each key."""
        return (np.searchsorted(self.keys, keys) + 0.5) / (len(self.keys) + 1)


def fit(v: np.ndarray, ids: np.ndarray, curves: int, k: int, target: float, seed: int) -> tuple[list[Curve], float]:
    """Curves and the window's share of the order, from a sample of vectors."""
    rng = np.random.default_rng(seed)
    d = v.shape[1]
    m = min(DIMS, d)
    out, left = [], np.empty((d, 0))
    for _ in range(curves):
        if left.shape[1] < m:
            left = np.linalg.qr(rng.normal(size=(d, d)))[0]
        directions, left = left[:, :m], left[:, m:]
        y = v @ directions
        shift = rng.uniform(0, 1, m)  # the shift moves the grid, here along the quantiles
        steps = (np.arange((1 << BITS) - 1) + shift[:, None]) / ((1 << BITS) - 1)
        cuts = np.stack([np.quantile(y[:, i], np.sort(steps[i])) for i in range(m)])
        curve = Curve(directions, cuts, np.empty(0, np.int64))
        curve.keys = np.sort(curve.key(v, ids))
        out.append(curve)
    if len(v) <= 2 * k:
        return out, 1.0
    probes = np.arange(min(PROBES, len(v)))
    scores = v[probes] @ v.T
    scores[probes, probes] = -np.inf
    near = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    gap = np.full(near.shape, np.inf)
    for c in out:
        at = c.place(c.key(v, ids))
        gap = np.minimum(gap, np.abs(at[near] - at[probes][:, None]))
    half = float(np.quantile(gap, target))
    return out, min(1.0, 2 * half + 2 / len(v))


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)``: rows with an id and a vector of the most common length, finite and not zero."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    out = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    out = out.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    size = out.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return out.where(F.size("v") == (size["n"] if size else 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _best(scores: np.ndarray, k: int, slack: float = 0.0) -> np.ndarray:
    """Column indices of the k largest of each row, and all that tie with the last, or nearly."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return scores >= least[:, None] - slack


def _place_by_all(folded: DataFrame, curves: list[Curve], total: int, blocks: int) -> None:
    """Take the places along each curve from rows of the whole table, SAMPLE or PLACES a block, chosen by hash."""
    stride = max(1, total // max(SAMPLE, PLACES * blocks))
    shared = folded.sparkSession.sparkContext.broadcast(curves)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            if b.num_rows:
                ids, v = b.column(0).to_numpy(), _matrix(b.column(1))
                yield pa.record_batch([pa.array(c.key(v, ids)) for c in own], names=[f"k{i}" for i in range(len(own))])

    some = folded.select(F.element_at("ids", 1).alias("id"), "v").where(F.pmod(F.xxhash64("id"), F.lit(stride)) == 0)
    found = some.mapInArrow(keys, ", ".join(f"k{i} long" for i in range(len(curves)))).toArrow()
    for i, c in enumerate(curves):
        c.keys = np.sort(found.column(i).to_numpy())


def search(rows: DataFrame, queries: str, k: int = 20, curves: int = CURVES, target: float = 0.96, block: int = BLOCK, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of each row that meets ``queries``.

    ``queries`` is a condition on ``id``.  Candidates are all usable rows but those with the
    query's own id.  Ties go to the smaller id; fewer candidates than k give fewer rows.  Null,
    zero, non-finite vectors, those of another length and rows without an id take no part.
    Repeated rows are one candidate.
    """
    spark = rows.sparkSession
    whole = usable(rows, id_col, vec_col).distinct()
    numbered = whole.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(f"n <= {k + 1}")
    folded = scratch.table(numbered.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "vectors")
    asked = scratch.table(whole.where(queries), "queries")
    total, n_asked = folded.count(), asked.count()
    sample = folded.select(F.element_at("ids", 1).alias("id"), "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    if not total or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = _matrix(sample.column("v").combine_chunks())
    made, share = fit(v, sample.column("id").to_numpy(), curves, k, target, seed)
    blocks = max(1, -(-total // block))
    if total > SAMPLE:
        _place_by_all(folded, made, total, blocks)
    chunks = max(1, -(-int(n_asked * min(1.0, share + 1 / blocks)) // QUERIES))
    shared = spark.sparkContext.broadcast((made, share, blocks, chunks))

    def deal(batches: Iterator[pa.RecordBatch], asking: bool) -> Iterator[pa.RecordBatch]:
        own, width, n_blocks, n_chunks = shared.value
        for b in batches:
            ids, vectors = b.column(0).to_numpy(), _matrix(b.column(1))
            for c, curve in enumerate(own):
                at = curve.place(curve.key(vectors, ids))
                if asking:
                    lo = np.clip(((at - width / 2) * n_blocks).astype(np.int64), 0, n_blocks - 1)
                    hi = np.clip(((at + width / 2) * n_blocks).astype(np.int64), 0, n_blocks - 1)
                    times = hi - lo + 1
                    take = np.repeat(np.arange(len(ids)), times)
                    part = np.arange(len(take)) - np.repeat(np.cumsum(times) - times, times) + lo[take]
                    chunk = ids[take] // 7 % n_chunks
                else:
                    take = np.tile(np.arange(len(ids)), n_chunks)
                    part = np.clip((at * n_blocks).astype(np.int64), 0, n_blocks - 1)[take]
                    chunk = np.repeat(np.arange(n_chunks), len(ids))
                columns = [pa.array((c * n_blocks + part) * n_chunks + chunk), *(b.column(i).take(pa.array(take)) for i in range(b.num_columns))]
                yield pa.record_batch(columns, names=["task", *b.schema.names])

    left = asked.select("id", "v").dropDuplicates(["v"])
    left = scratch.table(left, "asked")
    asks = left.mapInArrow(lambda it: deal(it, True), "task long, id long, v array<double>")
    holds = folded.select(F.element_at("ids", 1).alias("id"), "v", "ids").mapInArrow(lambda it: deal(it, False), "task long, id long, v array<double>, ids array<long>")

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        qid, found_ids, found_scores = [], [], []
        if q.num_rows and r.num_rows:
            mine, theirs = _matrix(q.column("v").combine_chunks()), _matrix(r.column("v").combine_chunks())
            groups, names = r.column("ids").to_pylist(), q.column("id").to_pylist()
            for lo in range(0, len(mine), 256):
                scores = mine[lo : lo + 256] @ theirs.T
                keep = _best(scores, k + 1, 1e-12 * np.abs(scores).max(initial=1.0))
                for i in range(len(scores)):
                    js = np.flatnonzero(keep[i])
                    exact = (theirs[js] * mine[lo + i]).cumsum(axis=1)[:, -1]  # component after component
                    pairs = sorted((-s, x) for j, s in zip(js.tolist(), exact.tolist(), strict=True) for x in groups[j])[: k + 1]
                    qid.append(names[lo + i])
                    found_ids.append([x for _, x in pairs])
                    found_scores.append([float(-s) for s, _ in pairs])
        return pa.table([pa.array(qid, pa.int64()), pa.array(found_ids, pa.list_(pa.int64())), pa.array(found_scores, pa.list_(pa.float64()))], names=["qid", "ids", "scores"])

    met = asks.groupBy("task").cogroup(holds.groupBy("task")).applyInArrow(meet, "qid long, ids array<long>, scores array<double>")
    # windows overlap: one entry an id, nearest first
    pair = F.expr("transform(arrays_zip(ids, scores), x -> named_struct('s', -x.scores, 'id', x.ids))")
    every = met.select("qid", pair.alias("found")).groupBy("qid").agg(F.flatten(F.collect_list("found")).alias("found"))
    one = left.select(F.col("id").alias("qid"), "v")
    named = asked.select(F.col("id").alias("query_id"), "v").join(one, "v").select("query_id", "qid")
    best = F.expr(f"slice(array_sort(filter(transform(array_distinct(transform(found, x -> x.id)), i -> named_struct('s', array_min(transform(filter(found, x -> x.id = i), x -> x.s)), 'id', i)), x -> x.id <> query_id)), 1, {k})")
    short = F.expr(f"slice(array_sort(array_distinct(found)), 1, {(k + 1) * curves * 2})")
    ranked = every.select("qid", short.alias("found")).join(named, "qid").select("query_id", best.alias("found"))
    return ranked.select("query_id", F.posexplode("found").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def plan(rows: DataFrame, k: int = 20, curves: int = CURVES, target: float = 0.96, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """The window's share of each order that :func:`search` would use on ``rows``."""
    sample = usable(rows, id_col, vec_col).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    return fit(_matrix(sample.column("v").combine_chunks()), sample.column("id").to_numpy(), curves, k, target, seed)[1]
