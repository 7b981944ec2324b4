"""Exact substring de-duplication by suffix arrays.

What is looked for: every string of ``width`` bytes that starts at two places or more.

1. Candidates.  Each window of ``width`` bytes chooses the leftmost smallest hash of the
   ``gram``-byte strings in it.  Equal windows choose equal strings, so only windows that chose a
   string which is chosen elsewhere too can be repeated: no repeat is lost.  The stretch of a text
   whose windows chose the same place is a *context*; a text's windows are split among its
   contexts.  Equal contexts are counted, not copied.
2. Shards.  Contexts that chose the same string go to the same shard, one copy of each, with the
   number of copies.  Where all that chose a string are equal, every window is repeated and no more
   need be asked.  A string chosen by very many different contexts is hot: its contexts are cut into
   sub-contexts that agree on a longer string; where that is hot still, into single windows, of
   which a count tells all.
3. Suffix arrays.  A window whose hash no other of the shard has is not repeated; stretches of the
   other windows that are equal repeat each other whole.  Where a string was also chosen by a stretch
   that equals no other, its stretches, one copy of each, set apart by a byte that UTF-8 never uses,
   get a suffix array by induced sorting; permuted common prefixes then tell which windows have a
   neighbour that agrees on ``width`` bytes.
4. Spans.  Found windows go back to all places of their context, join into spans for each text,
   and the spans are cut out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gridtrack.llm.common import parts, scratch, tidy, trim

WIDTH = 400
GRAM = 160
HOT = 512  # contexts of one string from which it is cut further
DEPTH = 3
SHARD_BYTES = 2 << 20
SEPARATOR = b"\xff"  # in no UTF-8 text
PRIME = np.uint64(0x9E3779B97F4A7C15)
CODE = 5  # bytes that stand for a word where passages are counted in words
_SHIFTS = np.arange(CODE, dtype=np.uint64) * np.uint64(7)


# ---------------------------------------------------------------- suffix arrays


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S); the end counts as smaller still."""
    n = len(text)
    differ = np.empty(n, bool)
    differ[:-1] = text[:-1] != text[1:]
    differ[-1] = True
    smaller = np.zeros(n, bool)
    smaller[:-1] = text[:-1] < text[1:]
    nearest = np.where(differ, np.arange(n), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    return smaller[nearest]


def _scatter(sa: np.ndarray, where: np.ndarray, chars: np.ndarray, pos: np.ndarray, step: int) -> None:
    """Append ``pos`` to the buckets ``chars``, in order, from the fronts (step 1) or ends (-1) at ``where``."""
    if len(pos) == 1:
        c = chars[0]
        sa[where[c]] = pos[0]
        where[c] += step
        return
    order = np.argsort(chars.astype(np.uint8), kind="stable")  # by radix
    c = chars[order]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    size = np.diff(np.r_[first, len(c)])
    rank = np.arange(len(c)) - np.repeat(first, size)
    sa[where[c] + step * rank] = pos[order]
    where[c[first]] += step * size


def _induce(text: np.ndarray, s_type: np.ndarray, sa: np.ndarray, counts: np.ndarray) -> None:
    """Induce L-suffixes from the left, then S-suffixes from the right, a bucket at a time.

    Within a bucket, suffixes induced into the same bucket (runs of one byte) are taken in waves.
    """
    n = len(text)
    ends = np.cumsum(counts)
    starts = ends - counts
    front = starts.copy()
    last = n - 1  # the suffix before the virtual end is of type L and comes first
    _scatter(sa, front, text[last : last + 1], np.array([last]), 1)
    present = np.flatnonzero(counts)
    for c in present.tolist():
        lo = starts[c]
        while lo < front[c]:  # L-suffixes, in waves
            hi = front[c]
            j = sa[lo:hi] - 1
            j = j[j >= 0]
            j = j[~s_type[j]]
            if len(j):
                _scatter(sa, front, text[j], j, 1)
            lo = hi
        seeds = sa[front[c] : ends[c]]  # S-suffixes put there before
        j = seeds[seeds > 0] - 1
        j = j[~s_type[j]]
        if len(j):
            _scatter(sa, front, text[j], j, 1)
    back = ends - 1
    for c in present[::-1].tolist():
        hi = ends[c] - 1
        while hi > back[c]:
            lo = back[c]
            j = sa[lo + 1 : hi + 1][::-1] - 1
            j = j[j >= 0]
            j = j[s_type[j]]
            if len(j):
                _scatter(sa, back, text[j], j, -1)
            hi = lo
        # L-suffixes of the bucket, from the right
        j = sa[starts[c] : front[c]][::-1] - 1
        j = j[j >= 0]
        j = j[s_type[j]]
        if len(j):
            _scatter(sa, back, text[j], j, -1)


def _sort_names(names: np.ndarray, span: int = 1) -> np.ndarray:
    """Order of the suffixes of a string of names, recursively.

    ``names`` are the ranks of runs of ``span`` names each; two runs in a row are named by their
    pair, and so on until no name occurs twice.
    """
    n = len(names)
    key = names * (n + 1)
    key[: max(n - span, 0)] += names[span:] + 1
    order = np.argsort(key)  # equal keys get one name, in whatever order
    new = np.r_[True, np.diff(key[order]) != 0]
    if new.all():
        return order
    named = np.empty(n, np.int64)
    named[order] = np.cumsum(new) - 1
    return _sort_names(named, 2 * span)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of bytes, by induced sorting; a suffix that is a prefix of another comes first."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = text.astype(np.int64)
    counts = np.bincount(text, minlength=256)
    s_type = _types(text)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    sa = np.full(n, -1, np.int64)

    def seed(order: np.ndarray) -> None:
        sa[:] = -1
        back = np.cumsum(counts) - 1
        _scatter(sa, back, text[order[::-1]], order[::-1], -1)
        _induce(text, s_type, sa, counts)

    if not len(lms):
        _induce(text, s_type, sa, counts)
        return sa
    seed(lms)
    # name the substrings between leftmost-smaller positions, in the order just induced
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    in_order = sa[is_lms[sa]]
    length = np.zeros(n, np.int64)
    length[lms] = np.diff(np.r_[lms, n]) + 1
    a, b = in_order[:-1], in_order[1:]
    same = (length[a] == length[b]) & (b + length[b] <= n) & (a + length[a] <= n)
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        bad = text[a[live] + k] != text[b[live] + k]
        same[live[bad]] = False
        live = live[~bad]
        k += 1
        live = live[length[a[live]] > k]
    name = np.zeros(n, np.int64)
    name[in_order] = np.r_[0, np.cumsum(~same)]
    reduced = name[lms]
    top = int(reduced.max()) + 1
    if top < len(lms):
        order = lms[_sort_names(reduced)]
    else:
        order = np.empty(len(lms), np.int64)
        order[reduced] = lms
    seed(order)
    return sa


def plcp(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: at each position, the common prefix with the suffix sorted before it.

    Only positions whose left neighbours differ from their partners' are compared (eight bytes at
    a time); everywhere else the value is the one before it less one.
    """
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    at = np.arange(n)
    same_left = (phi > 0) & (at > 0)
    same_left[same_left] = text[at[same_left] - 1] == text[phi[same_left] - 1]
    same_left[1:] &= phi[1:] == phi[:-1] + 1
    heads = np.flatnonzero(~same_left)
    out = np.zeros(n, np.int64)
    padded = np.r_[text, np.zeros(16, np.uint8)]
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    size = np.zeros(len(heads), np.int64)
    live = np.flatnonzero(phi[heads] >= 0)
    left = n - np.maximum(heads, phi[heads])
    while len(live):
        i, j = heads[live] + size[live], phi[heads[live]] + size[live]
        x = (words[i] != words[j])
        stop = np.where(x.any(axis=1), x.argmax(axis=1), 8)
        size[live] = np.minimum(size[live] + stop, left[live])
        live = live[(stop == 8) & (size[live] < left[live])]
    out[heads] = size + heads
    return np.maximum.accumulate(np.where(same_left, 0, out)) - at


def repeated_starts(contexts: list[bytes], width: int, copies: list[int] | None = None) -> list[np.ndarray]:
    """For each context, the starts whose ``width`` bytes also start elsewhere among the contexts.

    ``copies`` is how often a context stands for; the suffixes of its copies would be its
    neighbours in the suffix array, with all its remaining bytes in common.
    """
    text = np.frombuffer(b"".join(c + SEPARATOR for c in contexts), np.uint8)
    sa = suffix_array(text)
    common = plcp(text, sa)
    best = common.copy()
    best[sa[:-1]] = np.maximum(best[sa[:-1]], common[sa[1:]])
    out, at = [], 0
    for i, c in enumerate(contexts):
        own = best[at : at + max(len(c) - width + 1, 0)]
        if copies and copies[i] > 1:
            own = np.maximum(own, np.arange(len(c), width - 1, -1))
        out.append(np.flatnonzero(own >= width))
        at += len(c) + 1
    return out


# ---------------------------------------------------------------- candidates


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A rolling hash of every ``gram`` bytes, by doubling."""
    h, size, out, have = raw.astype(np.uint64) + np.uint64(1), 1, None, 0
    power = PRIME
    left = gram
    while left:
        if left & 1:
            if out is None:
                out, have = h, size
            else:  # ``out`` covers ``have`` bytes, append ``size`` more
                m = len(raw) - have - size + 1
                out = out[:m] * power + h[have : have + m]
                have += size
        left >>= 1
        if left:
            m = len(raw) - 2 * size + 1
            if m <= 0:
                return np.empty(0, np.uint64)
            h = h[:m] * power + h[size : size + m]
            power = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
            size *= 2
    return out ^ (out >> np.uint64(29))


def repeated_runs(groups: list[int], contexts: list[bytes], width: int, copies: list[int]) -> Iterator[tuple[int, int, int]]:
    """``(context, lo, hi)`` of the maximal stretches whose windows are repeated among the contexts of a group.

    As :func:`repeated_starts` finds them, of which only stretches are asked that equal no other.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    raw = b"".join(c + SEPARATOR for c in contexts)
    many = np.maximum(sizes - width + 1, 0)
    of = np.repeat(np.arange(len(contexts)), many)
    start = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    h = gram_hashes(np.frombuffer(raw, np.uint8), width)[begin[of] + start] if len(of) else np.empty(0, np.uint64)
    by = np.sort(h)
    more = np.unique(by[1:][by[1:] == by[:-1]])
    may = np.flatnonzero(more[np.minimum(np.searchsorted(more, h), len(more) - 1)] == h) if len(more) else np.empty(0, np.int64)
    of, start = of[may], start[may]
    new = np.r_[True, (np.diff(of) != 0) | (np.diff(start) != 1)] if len(of) else np.empty(0, bool)
    first, last = np.flatnonzero(new), np.flatnonzero(np.r_[new[1:], True]) if len(of) else new
    at = begin[of[first]] + start[first]
    strings: dict[tuple[int, bytes], list] = {}  # of a group: copies, and where it stands
    for i, lo, a, n in zip(of[first].tolist(), start[first].tolist(), at.tolist(), (start[last] - start[first] + width).tolist(), strict=True):
        held = strings.setdefault((groups[i], raw[a : a + n]), [0, []])
        held[0] += copies[i]
        held[1].append((i, lo))
    for i, n in enumerate(copies):
        if n > 1 and many[i]:
            yield i, 0, int(sizes[i])
    asked = {g for (g, _), (n, _) in strings.items() if n == 1}
    for (g, x), (n, where) in strings.items():
        if n > 1 and g not in asked:
            yield from ((i, lo, lo + len(x)) for i, lo in where if copies[i] == 1)
    left = [(x, n, where) for (g, x), (n, where) in strings.items() if g in asked]
    if left:
        for (_, _, where), starts in zip(left, repeated_starts([x for x, _, _ in left], width, [n for _, n, _ in left]), strict=True):
            for r in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if len(starts) else ():
                yield from ((i, lo + int(r[0]), lo + int(r[-1]) + width) for i, lo in where if copies[i] == 1)


def chosen(raw: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of a text: first window, last window, place of the chosen gram, its hash."""
    if len(raw) < width:
        e = np.empty(0, np.int64)
        return e, e, e, e
    h = gram_hashes(raw, gram) * PRIME
    span = width - gram + 1
    # leftmost minimum of each ``span`` hashes: pack 32 bits and the place, then minima by doubling
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    low, size = key, 1
    while 2 * size <= span:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    return first, last, place[first], (h[place[first]]).view(np.int64)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def word_codes(text: str | None) -> bytes:
    """Every word of a text as CODE bytes of its hash, seven bits each, and no spaces."""
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(w, 3) for w in _bytes(text).split()]), ">u8").astype(np.uint64)
    return (h[:, None] >> _SHIFTS & np.uint64(127)).astype(np.uint8).tobytes()


def _hash(raw: bytes, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(raw, seed) - (1 << 63)


def _hashes(digests: list[bytes]) -> np.ndarray:
    """What ``_hash`` gives for digests, of many at once."""
    return (np.frombuffer(b"".join(digests), ">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


SPOTS = pa.schema([("id", pa.int64()), ("tk", pa.int64()), ("first", pa.int32()), ("size", pa.int32()), ("gram", pa.int64()), ("ctx", pa.int64())])
SPOTS_DDL = "id long, tk long, first int, size int, gram long, ctx long"


def spots(texts: DataFrame, width: int, gram: int, words: bool = False) -> DataFrame:
    """A row for each context of each text: where it starts, its length, and the hashes of gram and context.

    ``words``: of the text's words as :func:`word_codes` writes them.
    """
    digest, as_bytes = xxhash.xxh64_digest, word_codes if words else _bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in parts(b.column(2), 4 << 20):
                firsts, sizes, keys, digests, many = [], [], [], [], []
                for text in b.column(2)[lo:hi].to_pylist():
                    raw = as_bytes(text)
                    first, last, _, key = chosen(np.frombuffer(raw, np.uint8), width, gram)
                    size = last - first + width
                    firsts.append(first)
                    sizes.append(size)
                    keys.append(key)
                    many.append(len(first))
                    digests += [digest(raw[f:e]) for f, e in zip(first.tolist(), (first + size).tolist(), strict=True)]
                if digests:
                    of = pa.array(np.repeat(np.arange(lo, hi), many))
                    numbers = (np.concatenate(firsts).astype(np.int32), np.concatenate(sizes).astype(np.int32), np.concatenate(keys), _hashes(digests))
                    yield pa.record_batch([b.column(0).take(of), b.column(1).take(of), *map(pa.array, numbers)], schema=SPOTS)

    return (texts if words else texts.where(F.octet_length("text") >= width)).mapInArrow(tidy(run), SPOTS_DDL)


def sub_contexts(raw: bytes, width: int, gram: int, depth: int) -> Iterator[tuple[int, int, bytes]]:
    """A context's windows split into at most 2**depth groups: hash of what a group agrees on, shift, bytes.

    A window that starts a bytes before the gram and b - a of ``width - gram`` bytes after it goes
    by a; windows with a in one of 2**depth intervals share all bytes from the gram less the
    smallest a to the end of the window with the largest.
    """
    place = int(chosen(np.frombuffer(raw, np.uint8), width, gram)[2][0])
    reach = width - gram
    step = -(-(reach + 1) // (1 << depth))
    for near in range(0, reach + 1, step):
        far = min(near + step - 1, reach)
        lo, hi = max(place - far, 0), min(place - near, len(raw) - width)
        if lo <= hi:
            yield _hash(raw[place - near : place - far + width], near + 1), lo, raw[lo : hi + width]


def _cut(contexts: DataFrame, width: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(g, c, shift, sub, n, own) for g, c, n, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True) for sub, shift, own in sub_contexts(raw, width, gram, DEPTH)]
            if out:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["gram", "ctx", "shift", "grp", "copies", "raw"])

    return contexts.select("gram", "ctx", "copies", "raw").mapInArrow(tidy(run), "gram long, ctx long, shift int, grp long, copies long, raw binary")


def _windows(parts_: DataFrame, width: int) -> DataFrame:
    """Every window of sub-contexts: its start in the context and its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, c, shift, n, raw in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                m = len(raw) - width + 1
                yield pa.record_batch([pa.array([g] * m, pa.int64()), pa.array([c] * m, pa.int64()), pa.array(range(shift, shift + m), pa.int32()), pa.array([n] * m, pa.int64()), pa.array([_hash(raw[i : i + width], 5) for i in range(m)], pa.int64())], names=["gram", "ctx", "lo", "copies", "win"])

    return parts_.select("gram", "ctx", "shift", "copies", "raw").mapInArrow(tidy(run), "gram long, ctx long, lo int, copies long, win long")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("tk"), F.col(text_col).cast("string").alias("text"))


def repeats(texts: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES, words: bool = False) -> DataFrame:
    """``(id, tk, spans)`` for every text of ``texts(id, tk, text)`` with a repeated stretch.

    spans are byte ranges (lo, hi), sorted and merged.  tk is a hash of the text; rows that agree
    in id and text have the same spans.  ``words``: the same of the text's words as :func:`word_codes`
    writes them, each as CODE bytes.
    """
    found = scratch.table(spots(texts, width, gram, words), "spots")
    # tables of their own, so that adaptive execution can split the joins' hot keys
    again = scratch.table(found.groupBy("gram").agg(F.count("*").alias("places")).where("places > 1").select("gram"), "again")
    places = scratch.table(found.join(again, "gram", "left_semi"), "places")
    scratch.drop(found)
    contexts = places.groupBy("gram", "ctx").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tk", "first", "size")).alias("at"))
    contexts = scratch.table(contexts, "contexts")
    kinds = scratch.table(contexts.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    # all equal, and twice or more: every window is repeated
    alone = contexts.join(kinds, "gram", "left_anti").select("gram", "ctx", F.lit(0).alias("lo"), F.col("at.size").alias("hi"))
    wanted = contexts.join(kinds, "gram").select(F.col("at.id").alias("id"), F.col("at.tk").alias("tk"), F.struct(F.col("at.first").alias("first"), F.col("at.size").alias("size"), "gram", "ctx", "copies", "kinds").alias("c"))
    wanted = wanted.groupBy("id", "tk").agg(F.collect_list("c").alias("c"))  # as many as one text has contexts

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, cs in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                raw = word_codes(text.as_py()) if words else _bytes(text.as_py())
                numbers = [pa.array([c[k] for c in cs], pa.int64()) for k in ("gram", "ctx", "copies", "kinds")]
                yield pa.record_batch([*numbers, pa.array([raw[c["first"] : c["first"] + c["size"]] for c in cs], pa.binary())], names=["gram", "ctx", "copies", "kinds", "raw"])

    held = texts.join(wanted.withColumnsRenamed({"id": "wid", "tk": "wtk"}), F.col("tk").eqNullSafe(F.col("wtk")) & F.col("id").eqNullSafe(F.col("wid")))
    raw = scratch.table(held.select("text", "c").mapInArrow(tidy(fetch), "gram long, ctx long, copies long, kinds long, raw binary"), "raw")
    size = raw.agg(F.sum(F.length("raw")).alias("n"), F.max("kinds").alias("kinds")).first()
    shards = max(1, -(-(size["n"] or 0) // shard_bytes))
    every = raw.where(F.col("kinds") <= hot).select("gram", "ctx", F.lit(0).alias("shift"), F.col("gram").alias("grp"), "copies", "raw")
    counted = None
    if (size["kinds"] or 0) > hot:
        cut = scratch.table(_cut(raw.where(F.col("kinds") > hot), width, gram), "cut")
        groups = scratch.table(cut.groupBy("grp").agg(F.sum("copies").alias("n"), F.count("*").alias("m")).where("n > 1"), "groups")
        every = every.unionByName(cut.join(groups.where(F.col("m") <= hot), "grp", "left_semi").select(every.columns))
        still = scratch.table(_windows(cut.join(groups.where(F.col("m") > hot), "grp", "left_semi"), width), "windows")
        twice = scratch.table(still.groupBy("win").agg(F.sum("copies").alias("n")).where("n > 1").select("win"), "twice")
        counted = still.join(twice, "win", "left_semi").select("gram", "ctx", "lo", (F.col("lo") + width).alias("hi"))

    def solve(t: pa.Table) -> pa.Table:
        one = {(g, c, s): (group, n, r) for g, c, s, group, n, r in zip(*(t.column(k).to_pylist() for k in ("gram", "ctx", "shift", "grp", "copies", "raw")), strict=True)}
        keys, (groups, copies, raws) = list(one), zip(*one.values(), strict=True)
        rows = [(*keys[i][:2], keys[i][2] + lo, keys[i][2] + hi) for i, lo, hi in repeated_runs(groups, raws, width, copies)]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        trim()
        return pa.table([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["gram", "ctx", "lo", "hi"])

    runs = every.withColumn("shard", F.pmod(F.xxhash64("grp"), F.lit(shards))).groupBy("shard").applyInArrow(solve, "gram long, ctx long, lo int, hi int")
    runs = runs.unionByName(alone)
    if counted is not None:
        runs = runs.unionByName(counted)
    runs = scratch.table(runs.groupBy("gram", "ctx").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "runs")  # within one context
    for done in (again, contexts, kinds, raw):
        scratch.drop(done)
    back = places.join(runs, ["gram", "ctx"]).select("id", "tk", "first", F.expr("transform(runs, r -> named_struct('lo', first + r.lo, 'hi', first + r.hi))").alias("runs"))
    back = back.dropDuplicates(["id", "tk", "first"]).groupBy("id", "tk").agg(F.flatten(F.collect_list("runs")).alias("spans"))  # as many as one text has contexts
    return back


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, keep = 0, []
    for lo, hi in spans:
        keep.append(raw[at:lo])
        at = hi
    return b"".join([*keep, raw[at:]])


def word_runs(spans: list[dict], words: int) -> list[tuple[int, int]]:
    """Spans of a coded text as ranges of its words."""
    ranges = [(-(-lo // CODE), hi // CODE) for lo, hi in merged(spans)]
    return [(lo, hi) for lo, hi in ranges if hi - lo >= words]


def word_spans(raw: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Ranges of words as byte ranges, from a first word's start to a last word's end."""
    at = [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", raw)] if ranges else []
    return [{"lo": at[lo][0], "hi": at[hi - 1][1]} for lo, hi in ranges]


def remove(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), words: int | None = None, cut_words: bool = True) -> DataFrame:
    """Cut repeated stretches out of all texts: one row per row of ``docs``.

    ``(id, n_bytes, n_removed, n_spans, n_passages, n_passage_words, kept_sha256, kept, *carry)``.  Every byte inside a string
    of ``width`` bytes that also starts elsewhere, same text included, goes; strings are judged on
    the input.  Null texts are empty; repeated rows repeat each other; a text shorter than
    ``width`` stays whole.  ``kept`` is text: where a cut splits a character, its rest is dropped
    there, while kept_sha256 is of the bytes.  ``carry`` names columns handed on untouched.
    ``words``: also every run of that many words that starts elsewhere, whatever its bytes; words
    are parted by ASCII spaces and compared by hash, the spaces between them are not compared; the
    maximal runs and their words are counted, and with ``cut_words`` also cut.  An empty table gives
    no rows.
    """
    texts = _texts(docs, id_col, text_col)
    found = repeats(texts, width, gram, hot, shard_bytes)
    if words:
        found = found.withColumn("kind", F.lit("spans")).unionByName(repeats(texts, CODE * words, max(CODE * words * gram // width, 1), hot, shard_bytes, True).withColumn("kind", F.lit("runs")))
        found = found.groupBy("id", "tk").agg(*(F.first(F.when(F.col("kind") == k, F.col("spans")), True).alias(k) for k in ("spans", "runs")))
    else:
        found = found.withColumn("runs", F.lit(None).cast(found.schema["spans"].dataType))
    found = found.withColumnsRenamed({"id": "wid", "tk": "wtk"})
    extra = [F.col(c).alias(f"_{i}") for i, c in enumerate(carry)]
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("tk"), F.col(text_col).cast("string").alias("text"), *extra)
    both = own.join(found, F.col("tk").eqNullSafe(F.col("wtk")) & F.col("id").eqNullSafe(F.col("wid")), "left").select("id", "text", "spans", "runs", *(f"_{i}" for i in range(len(carry))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in parts(b.column(1)):
                out = []
                for text, spans, runs in zip(*(b.column(i)[lo:hi].to_pylist() for i in (1, 2, 3)), strict=True):
                    raw = _bytes(text)
                    passages = word_runs(runs or [], words or 0)
                    cuts = merged((spans or []) + (word_spans(raw, passages) if cut_words else []))
                    kept = cut_out(raw, cuts)
                    out.append((len(raw), len(raw) - len(kept), len(cuts), len(passages), sum(hi - lo for lo, hi in passages), hashlib.sha256(kept).hexdigest(), text if not cuts else kept.decode("utf-8", "ignore")))
                types = (*[pa.int64()] * 5, pa.string(), pa.string())
                yield pa.record_batch([b.column(0)[lo:hi], *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)), *(b.column(4 + i)[lo:hi] for i in range(len(carry)))], names=["id", "n_bytes", "n_removed", "n_spans", "n_passages", "n_passage_words", "kept_sha256", "kept", *(f"_{i}" for i in range(len(carry)))])

    kinds = dict(both.dtypes)
    ddl = "id long, n_bytes long, n_removed long, n_spans long, n_passages long, n_passage_words long, kept_sha256 string, kept string" + "".join(f", _{i} {kinds[f'_{i}']}" for i in range(len(carry)))
    return both.mapInArrow(tidy(run), ddl).withColumnsRenamed({f"_{i}": c for i, c in enumerate(carry)})
