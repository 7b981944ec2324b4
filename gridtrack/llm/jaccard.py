"""Near-duplicates by exact Jaccard similarity of word shingles, as a set-similarity join.

Shingle hashes are put in one order for all texts.  Two sets with a similarity of ``least`` or more
share one of the first ``m - ceil(least m) + 1`` hashes of each (its *prefix*), so lists of the sets
that have a hash in their prefix meet every near pair; lengths, places in the order and bitmaps of the
sets, which bound what two can share, tell most others apart, and the rest is compared whole: no
near pair is lost and none is guessed.

SimHash fingerprints of the sets (:mod:`gridtrack.llm.simhash`: two of 64 bits apart, or equal) propose
pairs first; those that prove near link copies with few edits, and linked sets are not paired again.
Pairs near 0.8 differ in some ten bits, which no index of few keys can promise to find; the join finds
them.  Hashes in many prefixes of a sample (boilerplate) are put last in the order, so that texts meet by
what is their own; any order gives the same pairs.  Within a list, sets are first compared with the list's smallest; sets that this links need no
pairs among themselves, so families of edited copies cost a link each and not a pair each.  What is left
is paired as far as a list has few pairs a set.  The sets of the others go to blocks, and two blocks that
meet in a list are compared whole in one task, which gives the links of a spanning forest and no row a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gridtrack.llm.common import parts, scratch, tidy, trim
from gridtrack.llm.simhash import links as fingerprint_links, only
from gridtrack.operators.components import components

WIDTH = 5
LEAST = Fraction(4, 5)
SAMPLE = 8  # one text in so many is looked at for common hashes
HOT = 8  # prefixes of the sample from which a hash counts as common
DENSE = 8  # pairs a set of a list up to which they are listed; lists with more are compared by blocks
BLOCK = 256  # sets of a block, and hashes of all its sets: as near as hashing deals them
BLOCK_HASHES = 1 << 20
COMMON = 200_000  # common hashes that are put last, the most frequent; any number gives the same pairs
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word shingles, sorted; one shingle if it has ``width`` words or fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as simhash cuts them
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 7)][: len(words)], np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.array([digest(x, 7) for x in words], np.uint64)
    n = len(w) - width + 1
    h = w[:n].copy()
    for i in range(1, width):
        h = (h ^ (h >> np.uint64(31))) * _POWERS[i % 4] + w[i : i + n]
    h = (h ^ (h >> np.uint64(29))) * _POWERS[0]
    return np.unique(h ^ (h >> np.uint64(32)))


def _ordered(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Sorted hashes with the common ones put last."""
    if not len(common) or not len(h):
        return h
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    late = common[at] == h
    return np.r_[h[~late], h[late]]


def fingerprint(h: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes, signed: a bit is set where over half of them set it."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)).tobytes(), "big", signed=True)


def bitmap(h: np.ndarray) -> bytes:
    """A bit for the first bits of each hash, out of a power of two of twice as many bits or more."""
    log = max(3, (2 * len(h) - 1).bit_length())
    bits = np.zeros(1 << log, np.uint8)
    bits[(h >> np.uint64(64 - log)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _most_shared(x: bytes, y: bytes, m: int, n: int) -> int:
    """What sets of m and n hashes can share at most: a bit that only one has is a hash that only it has."""
    u, v = (np.unpackbits(np.frombuffer(z, np.uint8)) for z in (x, y))
    size = min(len(u), len(v))
    u, v = (z.reshape(size, -1).max(axis=1) for z in (u, v))
    return min(m - int((u > v).sum()), n - int((v > u).sum()))


def _signed(docs: DataFrame, common: np.ndarray, width: int, least: Fraction, id_col: str, text_col: str) -> DataFrame:
    """``(id, th, s, m, prefix, bits, fp)`` per row: text hash, the set's hash and size; prefix, bitmap and fingerprint once a set and task."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    p, q = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, seen = shared.value, set()
        for b in batches:
            for lo, hi in parts(b.column(2)):
                s, m, prefix, bits, fp = [], [], [], [], []
                for text in b.column(2)[lo:hi].to_pylist():
                    h = shingles(text, width)
                    s.append(xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63))
                    m.append(len(h))
                    new = len(h) and s[-1] not in seen
                    seen.add(s[-1])
                    bits.append(bitmap(h) if new else None)
                    fp.append(fingerprint(h) if new else None)
                    prefix.append(_ordered(h, late)[: len(h) + 1 + (-len(h) * p // q)].view(np.int64) if new else None)
                yield pa.record_batch([b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array(s, pa.int64()), pa.array(m, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(fp, pa.int64())], names=["id", "th", "s", "m", "prefix", "bits", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(tidy(run), "id long, th long, s long, m int, prefix array<long>, bits binary, fp long")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of sorted batches, cut where the first column (the key) changes; no key is split."""
    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        cols = tuple(c.to_numpy() for c in b.columns)
        if not len(cols[0]):
            continue
        held.append(cols)
        if cols[0][-1] == held[0][0][0]:  # one key so far: wait for its end
            continue
        whole = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        done = int(np.searchsorted(whole[0], whole[0][-1]))  # the last key may go on
        yield tuple(c[:done] for c in whole)
        held = [tuple(c[done:] for c in whole)]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _shared(signed: DataFrame) -> DataFrame:
    """``(key, m, s, pos)``: a row for each hash of a prefix that stands in another prefix too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _keys(batches):
            new = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[2][1:] != cols[2][:-1])]  # a set once
            cols = [c[new] for c in cols]
            same = cols[0][1:] == cols[0][:-1]
            keep = np.r_[False, same] | np.r_[same, False]
            yield pa.record_batch([pa.array(c[keep]) for c in cols], names=["key", "m", "s", "pos"])

    rows = signed.select(F.posexplode("prefix").alias("pos", "key"), "m", "s").select("key", "m", "s", "pos")
    return rows.repartition("key").sortWithinPartitions("key", "s").mapInArrow(tidy(run), "key long, m int, s long, pos int")


def _pairs(lists: DataFrame, least: Fraction, first: bool) -> DataFrame:
    """Distinct pairs ``(a, b)`` that may be near, of ``lists(key, m, s, pos, c)``.

    ``first``: only those with a list's smallest set; otherwise all others whose sets differ in c, but
    for a list with over ``DENSE`` pairs a set a row ``(key, null)`` instead.
    """
    p, q = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, m, s, pos, c in _keys(batches):
            m, pos = m.astype(np.int64), pos.astype(np.int64)
            cut = np.flatnonzero(np.diff(key)) + 1
            out, size = [], 0
            for lo, hi in zip(np.r_[0, cut].tolist(), np.r_[cut, len(key)].tolist(), strict=True):
                own, n = [], 0
                for i in [lo] if first else range(lo + 1, hi - 1):
                    end = lo + int(np.searchsorted(m[lo:hi], m[i] * q // p, "right"))
                    j = slice(i + 1, end)
                    most = np.minimum(m[i] - pos[i], m[j] - pos[j])  # if the key is the first that both have
                    ok = ((p + q) * most >= p * (m[i] + m[j])) & (c[j] != c[i])
                    if ok.any():
                        b = s[j][ok]
                        own.append((np.minimum(b, s[i]), np.maximum(b, s[i]), np.zeros(len(b), bool)))
                        n += len(b)
                    if not first and n > DENSE * (hi - lo):
                        own, n = [(key[lo : lo + 1], key[lo : lo + 1], np.ones(1, bool))], 1
                        break
                out += own
                size += n
                if size > 100_000:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)

    def batch(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, b, dense = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.record_batch([pa.array(a), pa.array(b, mask=dense)], names=["a", "b"])

    dealt = lists.select("key", "m", "s", "pos", "c").repartition("key").sortWithinPartitions("key", "m", "s")
    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def _in_common(u: list[np.ndarray], v: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of u has in common with each of v."""
    row, col = (np.repeat(np.arange(len(z)), [len(x) for x in z]) for z in (u, v))
    code, at = np.unique(np.concatenate(u), return_inverse=True)
    flat = np.concatenate(v)
    to = np.minimum(np.searchsorted(code, flat), max(0, len(code) - 1))
    met = code[to] == flat
    to, col = to[met], col[met]
    used = np.zeros(len(code), bool)
    used[to] = True
    new = np.cumsum(used) - 1
    row, at, to = row[used[at]], new[at[used[at]]], new[to]
    both = np.zeros((len(u), len(v)), np.float32)  # exact: sets have less than 2^24 hashes in a slice
    for lo in range(0, int(used.sum()), 4096):
        x, y = np.zeros((len(u), 4096), np.float32), np.zeros((len(v), 4096), np.float32)
        i, j = (at >= lo) & (at < lo + 4096), (to >= lo) & (to < lo + 4096)
        x[row[i], at[i] - lo] = 1
        y[col[j], to[j] - lo] = 1
        both += x @ y.T
    return both.astype(np.int64)


def _forest(s: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links (s[i], s[j]) that join sets whose classes c no link before has joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = root(int(c[a])), root(int(c[b]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(min(s[a], s[b])), int(max(s[a], s[b]))))
    return out


def _shingled(wanted: DataFrame, docs: DataFrame, width: int, text_col: str) -> DataFrame:
    """``(s, h)``: the shingle hashes of each set of ``wanted(s, th)``, written."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for s, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if s not in seen:
                    seen.add(s)
                    yield pa.record_batch([pa.array([s], pa.int64()), pa.array([shingles(text.as_py(), width).tobytes()], pa.binary())], names=["s", "h"])

    own = docs.select(F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    whole = own.join(wanted, "th").select("s", "text").mapInArrow(tidy(cut), "s long, h binary")
    return scratch.table(whole.groupBy("s").agg(F.first("h").alias("h")), "shingles")


def _by_blocks(hot: DataFrame, docs: DataFrame, sets: DataFrame, width: int, least: Fraction, text_col: str) -> DataFrame:
    """Links ``(a, b)`` that join what classes c of ``hot(key, s, m, c, n, size)`` near pairs of a list join.

    n and size: the sets of the list and the hashes of them all.  A set's block is cut from the longest
    list that it stands in, so that copies with many lists in common are in few blocks, apart by size; two
    blocks are compared once, however many lists they meet in.
    """
    p, q = least.numerator, least.denominator

    def links(x: int, y: int, cols: tuple[np.ndarray, ...]) -> list[tuple[int, int]]:
        block, s, c, h = cols
        h = [np.frombuffer(z, np.uint64) for z in h]
        u, v = np.flatnonzero(block == x), np.flatnonzero(block == y)
        if not len(u) or not len(v) or c.min() == c.max():
            return []
        m = np.array([len(z) for z in h], np.int64)
        both = _in_common([h[i] for i in u], [h[i] for i in v])
        i, j = np.nonzero(((p + q) * both >= p * (m[u][:, None] + m[v][None, :])) & (c[u][:, None] != c[v][None, :]))
        return _forest(s, c, u[i], v[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held and (found := links(*at, tuple(np.array([r[k] for r in held], t) for k, t in enumerate((np.int64, np.int64, np.int64, object))))):
                yield pa.record_batch([pa.array(z, pa.int64()) for z in zip(*found, strict=True)], names=["a", "b"])

        for b in batches:
            for x, y, *row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if (x, y) != at:
                    yield from done()
                    at, held = (x, y), []
                held.append(row)
        yield from done()

    chunks = F.greatest(F.ceil(F.col("home.n") / BLOCK), F.ceil(F.col("home.size") / BLOCK_HASHES))
    like = F.floor(F.log("m") * 4)  # sets of sizes that differ by a quarter are of neighbouring kinds
    home = hot.groupBy("s").agg(F.first("c").alias("c"), F.first("m").alias("m"), F.max(F.struct("n", "size", "key")).alias("home"))
    home = scratch.table(home.select("s", "c", "m", F.xxhash64("home.key", like, F.pmod(F.xxhash64("s"), chunks)).alias("block")), "home")
    met = hot.select("key", "s").join(home, "s").groupBy("key", "block").agg(*(f(k).alias(f"{n}_{k}") for k in "cm" for n, f in (("lo", F.min), ("hi", F.max))))
    met = scratch.table(met, "met")
    x, y = (met.select("key", *(F.col(n).alias(f"{k}_{n}") for n in met.columns[1:])) for k in "xy")
    unlike = "least(x_lo_c, y_lo_c) < greatest(x_hi_c, y_hi_c)"
    met = x.join(y, "key").where(f"x_block <= y_block AND {unlike} AND {p} * x_lo_m <= {q} * y_hi_m AND {p} * y_lo_m <= {q} * x_hi_m")
    met = met.select(F.col("x_block").alias("x"), F.col("y_block").alias("y")).distinct()
    sides = met.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    h = _shingled(sets.select("s", "th").join(home, "s", "left_semi"), docs, width, text_col)
    dealt = sides.join(home.join(h, "s"), "block").select("x", "y", "block", "s", "c", "h").repartition("x", "y").sortWithinPartitions("x", "y")
    found = scratch.table(dealt.mapInArrow(tidy(run), "a long, b long"), "near")
    for t in (h, home):
        scratch.drop(t)
    return found


def _near(pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int, least: Fraction, text_col: str) -> DataFrame:
    """Those of ``pairs`` whose sets have the similarity; ``sets(s, th, m, bits)`` has a text for each set."""
    p, q = least.numerator, least.denominator

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
                keep.append((p + q) * both >= p * (len(u) + len(v)))
            yield pa.record_batch(b.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [(p + q) * _most_shared(x, y, m, n) >= p * (m + n) for x, y, m, n in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)]
            yield pa.record_batch(b.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("s").alias("a"), F.col("bits").alias("x"), "m"), "a").join(sets.select(F.col("s").alias("b"), F.col("bits").alias("y"), F.col("m").alias("n")), "b")
    pairs = scratch.table(both.select("a", "b", "x", "y", "m", "n").mapInArrow(tidy(may), "a long, b long"), "may")
    wanted = sets.select("s", "th").join(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct(), "s", "left_semi")
    whole = _shingled(wanted, docs, width, text_col)
    held = pairs.join(whole.select(F.col("s").alias("a"), F.col("h").alias("x")), "a").join(whole.select(F.col("s").alias("b"), F.col("h").alias("y")), "b")
    near = scratch.table(held.select("a", "b", "x", "y").mapInArrow(tidy(compare), "a long, b long"), "near")
    for t in (whole, pairs):
        scratch.drop(t)
    return near


def _proposed(sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``sets(s, fp)`` that stand for each two fingerprints linked: the smallest sets
    of both, and each set with the smallest of its own fingerprint."""
    hub = sets.groupBy("fp").agg(F.min("s").alias("hub"))
    same = sets.join(hub, "fp").where("s <> hub").select(F.col("hub").alias("x"), F.col("s").alias("y"))
    met = fingerprint_links(hub.select("fp")).join(hub.select(F.col("fp").alias("a"), F.col("hub").alias("x")), "a").join(hub.select(F.col("fp").alias("b"), F.col("hub").alias("y")), "b").select("x", "y")
    return same.unionByName(met).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, least: Fraction = LEAST, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, th, root)`` per row of ``docs``: root names the group, th is the text's hash.

    Texts are lower-cased (A-Z) and cut into ``width``-word shingles; distinct shingles with a
    Jaccard similarity of ``least`` or more link, and groups are components of links.  A text of
    ``width`` words or fewer is one shingle.  Null, empty and wordless texts are one group.
    """
    spark = docs.sparkSession
    scratch.release(spark)  # what the driver holds of earlier stages and rounds
    trim()
    some = docs.where(F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(SAMPLE)) == 0)
    often = _shared(_signed(some, np.empty(0, np.uint64), width, least, id_col, text_col)).groupBy("key").agg(F.count("*").alias("n"))
    often = often.where(F.col("n") > hot).orderBy(F.desc("n"), "key").limit(COMMON).select("key").toArrow()
    common = np.sort(often.column("key").to_numpy().view(np.uint64))
    signed = scratch.table(_signed(docs, common, width, least, id_col, text_col), "signed")
    lists = scratch.table(_shared(signed.where("prefix IS NOT NULL")), "lists")
    sets = lists.select("s").distinct()
    sets = signed.where("prefix IS NOT NULL").join(sets, "s", "left_semi").groupBy("s").agg(F.min("th").alias("th"), F.first("m").alias("m"), F.first("bits").alias("bits"))
    sets = scratch.table(sets, "sets")
    proposed = scratch.table(_proposed(signed.where("prefix IS NOT NULL").select("s", "fp").distinct()), "proposed")
    links = _near(proposed, docs, sets, width, least, text_col)
    linked = scratch.table(components(links), "linked").select(F.col("node").alias("s"), F.col("root").alias("c"))
    named = lists.join(linked, "s", "left").withColumn("c", F.coalesce("c", "s"))
    tried = scratch.table(_pairs(named, least, True).join(proposed, ["a", "b"], "left_anti"), "tried")
    links = links.unionByName(_near(tried, docs, sets, width, least, text_col))
    found = scratch.table(components(links), "linked").select(F.col("node").alias("s"), F.col("root").alias("c"))
    scratch.release(spark)
    named = lists.join(found, "s", "left").withColumn("c", F.coalesce("c", "s"))
    open_ = named.groupBy("key").agg(F.count("*").alias("n"), F.sum("m").alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    named = scratch.table(named.join(open_.where("n > 2 AND lo < hi").select("key", "n", "size"), "key"), "open")
    scratch.drop(lists)
    paired = scratch.table(_pairs(named, least, False), "paired")
    more = scratch.table(paired.where("b IS NOT NULL").join(tried.unionByName(proposed), ["a", "b"], "left_anti"), "more")
    hot = scratch.table(named.join(paired.where("b IS NULL").select(F.col("a").alias("key")), "key", "left_semi"), "hot")
    for t in (named, paired, tried, proposed):
        scratch.drop(t)
    links = links.unionByName(_near(more, docs, sets, width, least, text_col))
    scratch.release(spark)
    links = links.unionByName(_by_blocks(hot, docs, sets, width, least, text_col))
    for t in (more, hot):
        scratch.drop(t)
    roots = components(links).select(F.col("node").alias("s"), "root")
    return signed.join(roots, "s", "left").select("id", "th", F.coalesce("root", "s").alias("root"))


def keep_one(docs: DataFrame, width: int = WIDTH, least: Fraction = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, chosen as :func:`simhash.keep_one` chooses."""
    return only(docs, near_duplicates(docs, width, least, id_col=id_col, text_col=text_col), id_col, text_col)
