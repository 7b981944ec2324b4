"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit halves.  Two fingerprints that differ in two bits or
fewer either differ in at most one bit of the first half, or in two bits there and in none of the
second.  The index therefore holds, for each distinct fingerprint, the 32 variants of its first
half with one bit wiped out, and its second half as it is; an equality join on these keys meets
every link once, and each meeting is verified on all 64 bits.

Copies share a fingerprint and are folded before the join.  Within a key, partners are looked up
by probing the at most 528 masks that may still differ, never by listing all pairs, and only a
spanning forest of a key's links is emitted; components are then found in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridtrack.llm.common import scratch, tidy
from gridtrack.operators.components import components

SEED = 42
_ONE = [1 << i for i in range(32)]
_TWO = [a | b for i, a in enumerate(_ONE) for b in _ONE[:i]]


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint of one text, unsigned: bit set where over half of the shingle hashes set it."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    raw = b"".join([digest(s, SEED) for s in shingles])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, th, fp)`` per row: th the text's 64-bit hash, fp a signed long.

    Null or wordless text: fp 0.  Other columns are not read.
    """
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps, pa.int64())], schema=schema)

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(tidy(run), "id long, th long, fp long")


def variants(fp: Column) -> Column:
    """The 33 keys of a fingerprint: kind (0-31 the wiped bit, 32 the second half) above 32 bits."""
    top = F.shiftrightunsigned(fp, 32)
    wiped = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.shiftleft(j.cast("long"), 32).bitwiseOR(top.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), j)))))
    return F.concat(wiped, F.array(F.lit(32 << 32).cast("long").bitwiseOR(fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))))


def _linked(kind: int, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``fps`` (sorted, unsigned) that this kind of key has to find."""
    if kind == 32:
        masks = [m << 32 for m in _TWO]
    else:
        bit = 1 << (32 + kind)
        masks = [bit, *(bit | m for m in _ONE)] + ([*_ONE, *_TWO] if kind == 0 else [])
    if len(fps) <= 64:
        x = fps[:, None] ^ fps[None, :]
        i, j = np.nonzero(np.triu(np.bitwise_count(x) <= 2, 1))
        if len(i):
            keep = np.isin(x[i, j], np.array(masks, np.uint64))
            yield i[keep], j[keep]
        return
    for m in masks:
        want = fps ^ np.uint64(m)
        at = np.searchsorted(fps, want)
        hit = np.nonzero((at < len(fps)) & (fps[np.minimum(at, len(fps) - 1)] == want) & (fps < want))[0]
        if len(hit):
            yield hit, at[hit]


def _forest(kind: int, fps: np.ndarray) -> Iterator[tuple[int, int]]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    for i, j in _linked(kind, fps):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                yield a, b


def links(distinct: DataFrame, n: int | None = None) -> DataFrame:
    """Spanning links ``(a, b)`` among distinct fingerprints ``fp`` that differ in at most two bits."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(keys)]
        many = ends - starts > 1
        out: list[tuple[int, int]] = []
        for lo, hi in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            own = np.sort(fps[lo:hi].view(np.uint64))
            signed = own.view(np.int64)
            out += [(signed[a], signed[b]) for a, b in _forest(int(keys[lo]) >> 32, own)]
        if out:
            a, b = np.array(out, np.int64).T
            yield pa.record_batch([pa.array(a), pa.array(b)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            k, f = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(k):
                continue
            held.append((k, f))
            if k[-1] == held[0][0][0]:  # one key so far: wait for its end
                continue
            keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            done = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            yield from solve(keys[:done], fps[:done])
            held = [(keys[done:], fps[done:])]
        if held:
            keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from solve(keys, fps)

    keyed = distinct.select(F.explode(variants(F.col("fp"))).alias("key"), "fp")
    dealt = keyed.repartition("key") if n is None else keyed.repartition(n, "key")
    return dealt.sortWithinPartitions("key").mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, th, fp, root, component_id)``: one row per row of ``docs``, the component's smallest id.

    Texts are lower-cased (A-Z) and cut into three-word shingles; fingerprints link at two or
    fewer differing bits; root is the component's smallest fingerprint, th the text's hash.  Null
    ids stay in their component but are never its name unless all its ids are null (then null).
    Empty texts share fingerprint 0.  An empty table gives no rows.
    """
    fps = scratch.table(fingerprints(docs, id_col, text_col), "fingerprints")
    first = fps.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(first.select("fp")))
    named = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.table(named.join(least, "root").select("fp", "root", "component_id"), "classes")
    return fps.join(named, "fp").select("id", "th", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, least: Fraction | None = None) -> DataFrame:
    """One row of each group of near-duplicates, all columns as they were.

    Without ``least``, groups are those of :func:`near_duplicates`.  With it, texts are near whose
    distinct ``width``-word shingles have a Jaccard similarity of ``least`` or more: the fingerprint
    index proposes pairs, each is compared exactly, and what no fingerprint promises to find is
    found by a set-similarity join (:mod:`gridtrack.llm.jaccard`).

    The row kept has the group's smallest id and, of several texts with that id, the smallest hash;
    repeated rows are one.  A group whose ids are all null keeps the row of the smallest text hash.
    """
    if least is None:
        return only(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)
    from gridtrack.llm import jaccard

    return only(docs, jaccard.near_duplicates(docs, width, least, id_col=id_col, text_col=text_col), id_col, text_col)


def _free(taken: list[str], *names: str) -> list[str]:
    """Names like ``names`` that no column of ``taken`` has, in whatever case."""
    low = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in low:
            n += "_"
        out.append(n)
    return out


def only(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`keep_one` keeps, given their groups ``classes(id, th, root)``."""
    text, key, th, n = _free(docs.columns, "_text", "_id", "_th", "_n")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("best")
    chosen = classes.groupBy("root").agg(best).select(F.col("best.id").alias(key), F.col("best.th").alias(th))
    own = docs.withColumn(text, F.xxhash64(F.col(text_col).cast("string")))
    kept = own.join(chosen, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.col(text) == F.col(th)), "left_semi")
    first = Window.partitionBy(id_col, text).orderBy(*[F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)] or [F.col(text)])
    return kept.withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
