"""Hierarchical Pitman-Yor language model over words.

Tokens are lower-cased words and one end mark a text.  Every distinct token of the training texts
has a context restaurant of its own (the tokens that follow it), and all restaurants share a parent
over all distinct tokens and one event "unseen", whose base measure is uniform:

    P(w | u) = (c_uw - d t_uw) / (c_u + a)  +  (a + d T_u) / (c_u + a) * P(w)
    P(w)     = (c0_w - d0 t0_w) / (C0 + a0) +  (a0 + d0 T0) / (C0 + a0) / (V + 1)

c are customers, t tables; a context's tables are the parent's customers (c0_w = sum of t_uw).
Nothing is capped: cells (u, w, c), words and their statistics are Spark tables that grow with the
input.

Seatings are sampled by Gibbs sweeps: each cell's tables are redrawn by seating its customers one
after the other, given its restaurant's tables and the parent's probability of the last sweep; then
tables and customers are summed for each word, the parent's tables are redrawn, and the
concentrations drawn from a grid.  A cell of one customer has one table, so only cells of two and
more take part.  Independent chains go through the sweeps side by side.  Random numbers are hashes
of cell, sweep and chain, and sums are of whole numbers: a seating can be drawn again wherever it
is needed and is never stored, and no result depends on partitions or row order.  Weights are
averaged over chains and the sweeps after burn-in; the averages still sum to one over seen words
and "unseen".

A text's score is the sum of log P(w) + log weight of the parent in w's restaurant (every token is
as often context as word), and for each pair met in training a correction.  At most ``words`` words,
the most frequent, are numbered, and their values broadcast; all others go by their hash, and cells
that hold one get its values by a join.  The values of the ``pairs`` most frequent pairs are
broadcast too; a text's other words and pairs meet theirs in one exchange.  Both ways give the same
numbers.

Counts, cells and a text's words and pairs go between tasks in blocks: the packed columns of many
entries that a hash of their key deals to the same bucket, one Spark row a block.  Buckets grow in
number with the input.  Cells with a word that has no number meet its values in that word's bucket.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridtrack.llm.common import forget, parts, scratch, tidy

WORDS = 131_072  # broadcast at most so many words' values; the others are joined
PAIRS = 1 << 20  # and so many pairs'
CHAINS = 2
SWEEPS = 3
BURN = 1
END = b""  # no word is empty
BLOCK = 250_000  # entries of a block at most
BUCKET = 1 << 21  # and about so many tokens to a bucket
LEAST = 12  # buckets of a small input
BIG = 64  # customers that are seated singly
DEALT = "bucket int, tag int, data binary"
GRID = np.exp(np.linspace(-3, 12, 31))
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8) + np.where(np.isin(np.arange(256), np.arange(65, 91)), 32, 0).astype(np.uint8)
_SEED = 11
# the primes of XXH64
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_LONG = 32  # words of so many bytes are hashed one by one


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, _SEED) >> 1


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _hashes(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """:func:`_hash` of the words of ``text`` (bytes) that begin there: XXH64 step by step, all words of a size at once."""
    out = np.empty(len(begin), np.uint64)
    text = np.concatenate([text, np.zeros(8, np.uint8)])
    eight, four = (np.ndarray(len(text) - 8, t, text, strides=(1,)) for t in ("<u8", "<u4"))
    kind = np.minimum(size, _LONG).astype(np.uint8)
    order, edges = np.argsort(kind, kind="stable"), np.r_[0, np.cumsum(np.bincount(kind, minlength=_LONG + 1))]
    for n in np.flatnonzero(np.diff(edges[:-1])).tolist():
        some = order[edges[n] : edges[n + 1]]
        at, h = begin[some], np.full(len(some), (_SEED + int(_P5) + n) & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for _ in range(n // 8):
            h = _turned(h ^ (_turned(eight[at] * _P2, 31) * _P1), 27) * _P1 + _P4
            at = at + 8
        if n % 8 >= 4:
            h = _turned(h ^ (four[at] * _P1), 23) * _P2 + _P3
            at = at + 4
        for _ in range(n % 4):
            h = _turned(h ^ (text[at] * _P5), 11) * _P1
            at = at + 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[some] = (h ^ (h >> np.uint64(32))) >> np.uint64(1)
    for i in order[edges[_LONG] :].tolist():
        out[i] = _hash(text[begin[i] : begin[i] + size[i]].tobytes())
    return out.view(np.int64)


def read(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens (words lower-cased in A-Z, then one end) of all texts, and where each text begins."""
    found = [_read(texts[lo:hi]) for lo, hi in parts(texts, 1 << 20)]
    before_ = np.cumsum([0, *(len(h) for h, _ in found)])
    return np.concatenate([h for h, _ in found]), np.concatenate([first + n for (_, first), n in zip(found, before_, strict=False)])


def _read(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    cut = np.zeros(len(data) + 1, bool)  # a text ends before this byte
    cut[edges] = True
    space = np.r_[True, _SPACE[data], True]
    word = ~space[1:-1]
    begin = np.flatnonzero(word & (space[:-2] | cut[:-1]))
    size = np.flatnonzero(word & (space[2:] | cut[1:])) + 1 - begin
    h = _hashes(_LOWER[data], begin, size)
    # an end after the last word of each text
    ends = np.searchsorted(begin, edges[1:])
    first = np.r_[0, ends[:-1]] + np.arange(len(texts))
    out = np.empty(len(h) + len(texts), np.int64)
    own = np.ones(len(out), bool)
    own[ends + np.arange(len(texts))] = False
    out[own], out[~own] = h, _hash(END)
    return out, first


def before(w: np.ndarray, end: int) -> np.ndarray:
    """The context of each token: the token before it; a text begins after an end."""
    return np.r_[np.int64(end), w[:-1]] if len(w) else w


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def _times(n: int, by: np.uint64) -> np.uint64:
    return np.uint64(n * int(by) & 0xFFFFFFFFFFFFFFFF)


def pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit name of context and word."""
    return _mix(_mix(u.view(np.uint64)) * _C1 + w.view(np.uint64)).view(np.int64)


# ------------------------------------------------------------------ seating


def tables(c: np.ndarray, strength: np.ndarray, d: float, key: np.ndarray, salt: int) -> np.ndarray:
    """Redraw the tables of dishes with ``c`` customers: seat them one after the other.

    ``strength`` is a dish's (a + d T) p, T the restaurant's tables and p the parent's probability.
    Customer n + 1 opens a table with odds strength : n - d t.  Customers beyond the first 64 are
    seated in blocks that grow with n, with the odds of the block's middle; the number of its tables
    is binomial.  Random numbers are hashes of ``key``, ``salt`` and the draw's number.
    """
    return seated(c, strength[:, None], d, key, [salt])[:, 0]


def seated(c: np.ndarray, strength: np.ndarray, d: float, key: np.ndarray, salts: list[int]) -> np.ndarray:
    """:func:`tables` for each column of ``strength``, with its salt: all in one go, as they end together."""
    out = np.repeat((c > 0).astype(np.float64)[:, None], len(salts), axis=1)
    # falling counts, so that those not yet seated are the first
    many = np.flatnonzero(c > 1)
    order = many[np.argsort(-c[many])]
    less, s = -c[order], strength[order].T.copy()
    t = np.ones(s.shape)
    seed = _mix(key[order].view(np.uint64)[None, :] + np.array([_times(x, _C1) for x in salts])[:, None])
    n, step, draw = 1, 1, 0
    while live := int(np.searchsorted(less, -n)):
        draw += 1
        x = (_mix(seed[:, :live] + _times(draw, _C1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        size = np.minimum(step, -less[:live] - n)
        p = s[:, :live] / (s[:, :live] + np.maximum(n + (size - 1) / 2 - d * t[:, :live], 1e-9))
        t[:, :live] += x < p if step == 1 else _binomial(np.tile(size, len(p)), p.ravel(), x.ravel()).reshape(p.shape)
        n += step
        step = 1 if n < BIG else n // 16
    out[order] = np.minimum(t, -less).T
    return out


def _binomial(size: np.ndarray, p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The binomial draw at the quantile ``x``; by its normal limit where the variance is over 100."""
    p = np.clip(p, 1e-300, 1 - 1e-12)
    var = size * p * (1 - p)
    out = np.clip(np.round(size * p + np.sqrt(var) * _quantile(x)), 0, size)
    few = np.flatnonzero(var <= 100)
    flip = p[few] > 0.5
    q = np.where(flip, 1 - p[few], p[few])
    n, k = size[few].astype(np.float64), np.zeros(len(few))
    mass = np.exp(n * np.log1p(-q))
    left = x[few] - mass
    live = np.flatnonzero((left > 0) & (k < n))
    while len(live):
        mass[live] *= (n[live] - k[live]) / (k[live] + 1) * q[live] / (1 - q[live])
        k[live] += 1
        left[live] -= mass[live]
        live = live[(left[live] > 0) & (k[live] < n[live]) & ((mass[live] > 1e-18) | (k[live] < n[live] * q[live]))]
    out[few] = np.where(flip, n - k, k)
    return out


def _quantile(x: np.ndarray) -> np.ndarray:
    """The standard normal quantile, by a rational approximation good to 4.5e-4."""
    tail = np.sqrt(-2 * np.log(np.clip(np.minimum(x, 1 - x), 1e-300, 0.5)))
    z = tail - (2.515517 + 0.802853 * tail + 0.010328 * tail**2) / (1 + 1.432788 * tail + 0.189269 * tail**2 + 0.001308 * tail**3)
    return np.where(x < 0.5, -z, z)


def _lgamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    near = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    return near - reduce(add, (np.log(x + i) for i in range(8)))


def seating_weight(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Log probability, for each concentration of the grid, of c customers at t tables (a row a restaurant)."""
    a = GRID[None, :]
    c, t = c[:, None].astype(np.float64), t[:, None].astype(np.float64)
    return _lgamma(a / d + t) - _lgamma(a / d) - _lgamma(a + c) + _lgamma(a) + t * np.log(d)


def _drawn(logp: np.ndarray, key: int) -> float:
    """A concentration by the weights of the grid and a number hashed from ``key``."""
    logp = logp - 0.1 * np.log1p(GRID)
    p = np.exp(logp - logp.max())
    x = float(_mix(np.array([_times(key, _C1)]))[0] >> np.uint64(11)) * 2.0**-53
    return float(GRID[min(int(np.searchsorted(np.cumsum(p / p.sum()), x)), len(GRID) - 1)])


def _discount(n1: float, n2: float) -> float:
    return min(max(n1 / (n1 + 2 * n2), 0.05), 0.95) if n1 and n2 else 0.5


# ------------------------------------------------------------------ words by number or hash


class Common:
    """The numbered words: ``h`` their hashes by number (falling count), others have the code ~hash."""

    def __init__(self, h: np.ndarray, c: np.ndarray):
        order = np.lexsort((h, -c))
        self.h, self.c = h[order], c[order]
        self.order = np.argsort(self.h)
        self.sorted = self.h[self.order]
        # hashes lie evenly: where those with the same first bits begin
        self.shift = 63 - min(len(h).bit_length() + 1, 62)
        self.first = np.searchsorted(self.sorted, np.arange(1 << (63 - self.shift)) << self.shift).astype(np.int32)

    def codes(self, h: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return ~h
        last = len(self.h) - 1
        at = np.minimum(self.first[h >> self.shift], last)
        live = np.flatnonzero((self.sorted[at] < h) & (at < last))
        while len(live):
            at[live] += 1
            live = live[(self.sorted[at[live]] < h[live]) & (at[live] < last)]
        return np.where(self.sorted[at] == h, self.order[at], ~h)

    def hashes(self, code: np.ndarray) -> np.ndarray:
        return np.where(code >= 0, self.h[np.maximum(code, 0)] if len(self.h) else 0, ~code)


def _found(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return at, keys[at] == want


def named(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The key of a pair of codes: both numbers, or else a hash below zero."""
    out = u * (1 << 31) + w
    rare = np.flatnonzero((u < 0) | (w < 0))
    out[rare] = ~(pair(u[rare], w[rare]) & np.int64((1 << 63) - 1))
    return out


def _level(c: np.ndarray) -> np.ndarray:
    """Eight levels for each doubling of a count."""
    return np.floor(8 * np.log2(c) + 1e-9).astype(np.int64)


def _within(levels: DataFrame, most: int) -> int | None:
    """The smallest level with at most ``most`` rows from it on, of ``levels(level, n)``; None: there is none."""
    counts = levels.groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect()
    sums = np.cumsum([r["n"] for r in counts])
    fit_ = int(np.searchsorted(sums, most, "right"))
    return counts[fit_ - 1]["level"] if fit_ else None


# ------------------------------------------------------------------ blocks


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of eight bytes an entry, less their smallest value, byte by byte as far as they need, compressed."""
    n = len(columns[0])
    head, planes = n.to_bytes(4, "little"), []
    for c in columns:
        c = np.ascontiguousarray(c).view(np.uint64)
        low = int(c.min())
        width = ((int(c.max()) - low).bit_length() + 7) // 8
        low = low if width < 8 else 0
        head += bytes([width]) + low.to_bytes(8, "little")
        each, out = (c - np.uint64(low)).view(np.uint8).reshape(n, 8), np.empty((width, n), np.uint8)
        for i in range(width):
            out[i] = each[:, i]
        planes.append(out)
    return head + pa.Codec("zstd", compression_level=1).compress(np.concatenate(planes), asbytes=True)


def unpacked(data: bytes, types: list) -> list[np.ndarray]:
    n, at = int.from_bytes(data[:4], "little"), 4 + 9 * len(types)
    widths = data[4:at:9]
    planes = np.empty((0, n), np.uint8)
    if sum(widths):
        planes = np.frombuffer(pa.Codec("zstd").decompress(data[at:], n * sum(widths)), np.uint8).reshape(-1, n)
    out, first = [], 0
    for k, (t, width) in enumerate(zip(types, widths, strict=True)):
        each = np.zeros((n, 8), np.uint8)
        for i in range(width):
            each[:, i] = planes[first + i]
        first += width
        c = each.reshape(-1).view(np.uint64)
        c += np.uint64(int.from_bytes(data[5 + 9 * k : 13 + 9 * k], "little"))
        out.append(c.view(t))
    return out


def joined(blocks: list[bytes], types: list) -> list[np.ndarray]:
    """The columns of several blocks, one after the other."""
    if not blocks:
        return [np.empty(0, t) for t in types]
    return [np.concatenate(c) for c in zip(*(unpacked(b, types) for b in blocks), strict=True)]


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((_mix(key.view(np.uint64)) >> np.uint64(24)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def dealt(key: np.ndarray, columns: list[np.ndarray], buckets: int, tag: int = 0) -> Iterator[pa.RecordBatch]:
    """Blocks of ``columns`` for the buckets that a hash of ``key`` names."""
    if not len(key):
        return
    at = _bucket(key, buckets)
    order = np.argsort(at, kind="stable")
    columns, edges = [c[order] for c in columns], np.r_[0, np.cumsum(np.bincount(at, minlength=buckets))]
    names, data, size = [], [], 0
    for i in np.flatnonzero(np.diff(edges)).tolist():
        for lo in range(edges[i], edges[i + 1], BLOCK):
            names.append(i)
            data.append(packed([c[lo : min(lo + BLOCK, edges[i + 1])] for c in columns]))
            size += len(data[-1])
        if size > 4 << 20:
            yield _blocks(names, tag, data)
            names, data, size = [], [], 0
    if names:
        yield _blocks(names, tag, data)


def _blocks(names: list[int], tag: int, data: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(names, pa.int32()), pa.array([tag] * len(names), pa.int32()), pa.array(data, pa.binary())], names=["bucket", "tag", "data"])


def met(blocks: DataFrame, buckets: int, run: Callable, ddl: str) -> DataFrame:
    """What ``run`` gives for each bucket's blocks, a list for each tag."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, list[bytes]]] = {}
        for x in batches:
            for i, tag, data in zip(*(c.to_pylist() for c in x.columns), strict=True):
                held.setdefault(i, {}).setdefault(tag, []).append(data)
        while held:
            yield from run(held.popitem()[1])

    return blocks.repartition(buckets, "bucket").mapInArrow(tidy(whole), ddl)


def summed(key: np.ndarray, first: list[np.ndarray], sums: list[np.ndarray]) -> list[np.ndarray]:
    """For each distinct key the first of some columns and the sums of others."""
    if not len(key):
        return [*first, *sums]
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return [*(c[order[new]] for c in first), *(np.add.reduceat(c[order], new) for c in sums)]


def by_text(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, and for each key and text it is ``of`` (a small number): the key's place among them, the text and how often."""
    if not len(key):
        return key, *[np.empty(0, np.int64)] * 3
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    bits = np.int64(int(of.max()).bit_length())
    both = (np.cumsum(new) - 1 << bits) | of[order]
    both.sort()
    at = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    n = np.diff(np.r_[at, len(both)])
    both = both[at]
    return key[new], both >> bits, both & ((np.int64(1) << bits) - 1), n


def _buckets(docs: DataFrame, tokens: int | None = None) -> int:
    """As many as Spark has shuffle partitions; where the tokens are known as many as these need, for
    between buckets go as many blocks as the square of their number.
    """
    most = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return most if tokens is None else max(min(most, LEAST), -(-tokens // BUCKET))


def _by_rows(columns: list[np.ndarray], names: list[str], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(columns[0]), most):
        yield pa.record_batch([pa.array(np.ascontiguousarray(c[lo : lo + most])) for c in columns], names=names)


# ------------------------------------------------------------------ the model in Spark


def _release(spark: SparkSession) -> None:
    """Let the shuffle files of plans that are done go: Spark's scheduler holds the last plan until the
    next job, Python holds it in cycles and tells the driver about a second later that they are gone.
    """
    spark.range(1).count()
    gc.collect()
    time.sleep(1.5)
    scratch.release(spark)


@dataclass
class State:
    """What the driver knows after some sweeps, one number a chain: the concentrations and discounts,
    the parent's customers and tables, and how the parent's tables are drawn.
    """

    kinds: int
    d: float
    a: list[float]
    a0: list[float]
    d0: list[float]
    every: list[int]
    many: list[int]
    salt: int | None = None  # of the parent's tables; None: one table for each word
    drawn: list[tuple[float, float]] | None = None  # the strength and discount they were drawn with

    def rest(self, k: int) -> float:
        return (self.a0[k] + self.d0[k] * self.many[k]) / (self.kinds + 1)

    def parent_tables(self, c0: np.ndarray, h: np.ndarray) -> np.ndarray:
        if self.salt is None:
            return (c0 > 0).astype(np.float64)
        return np.stack([tables(c0[:, k], np.full(len(h), s), d0, h, self.salt + k) for k, (s, d0) in enumerate(self.drawn)], axis=1)

    def share(self, c0: np.ndarray, h: np.ndarray) -> np.ndarray:
        """P(w) of each chain, a row a word."""
        t0 = self.parent_tables(c0, h)
        k = range(len(self.a))
        return (c0 - np.array(self.d0) * t0 + np.array([self.rest(i) for i in k])) / np.array([self.every[i] + self.a0[i] for i in k])

    def unseen(self) -> float:
        return float(np.mean([self.rest(k) / (self.every[k] + self.a0[k]) for k in range(len(self.a))]))

    def seat(self, c: np.ndarray, t_u: np.ndarray, share: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
        """Tables of cells, a column a chain."""
        return seated(c, self.strength(t_u, share), self.d, key, [salt + k for k in range(len(self.a))])

    def strength(self, t_u: np.ndarray, share: np.ndarray) -> np.ndarray:
        return (np.array(self.a) + self.d * t_u) * share


@dataclass
class Model:
    """``words(h, c, p, b)``: a word's code, count, P(w) and the parent's weight in its restaurant;
    ``cells(kind, bucket, n, twos, data)``: blocks of pairs' codes and counts; ``weighed``, given a condition
    on these, their averaged own weight e and correction lp: P(w | u) = e + b_u p_w, and lp is its
    log10 less that of b_u p_w.  ``blocks``, given which counts and a function of arrays (u, w, c, e,
    lp), what that function gives, of pairs without numbers alone where so told; ``weigh`` does the
    same in a task with (u, w, c, no values) of numbered words.
    """

    words: DataFrame
    cells: DataFrame
    blocks: Callable[..., DataFrame]
    weigh: Callable[[Iterator[tuple], Callable], Iterator]
    buckets: int
    total: int
    kinds: int
    unseen: float
    common: Common
    sent: Broadcast  # of common

    def weighed(self, keep: Column) -> DataFrame:
        give = lambda *x: _by_rows(list(x), ["u", "w", "c", "e", "lp"])
        return self.blocks(None, give, "u long, w long, c long, e double, lp double").where(keep)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _words(texts: DataFrame, buckets: int) -> DataFrame:
    """``(h, c)``: each token's hash and count in ``texts(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in parts(b.column(0), 16 << 20):
                h, n = np.unique(read(b.column(0)[lo:hi])[0], return_counts=True)
                yield from dealt(h, [h, n.astype(np.int64)], buckets)

    def add_up(blocks: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        h, n = joined(blocks[0], [np.int64] * 2)
        yield from _by_rows(summed(h, [h], [n]), ["h", "c"])

    return met(texts.select("text").mapInArrow(tidy(run), DEALT), buckets, add_up, "h long, c long")


CELLS = "kind int, bucket int, n long, twos long, data binary"


def _pairs(texts: DataFrame, shared, buckets: int) -> DataFrame:
    """Blocks of ``(u, w, c)``: how often each token follows each context in ``texts(text)``, by codes;
    ``kind`` tells whether c is above one, u has no number, w has none.  A pair is in one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = shared.value.codes(np.array([_hash(END)]))[0]
        for b in batches:
            for lo, hi in parts(b.column(0), 16 << 20):
                w = shared.value.codes(read(b.column(0)[lo:hi])[0])
                u = before(w, end)
                key, own = named(u, w), (u >= 0) & (w >= 0)
                both, n = np.unique(key[own], return_counts=True)
                rare = np.flatnonzero(~own)
                key, u, w, m = summed(key[rare], [key[rare], u[rare], w[rare]], [np.ones(len(rare), np.int64)])
                u, w = np.concatenate([both >> 31, u]), np.concatenate([both & np.int64((1 << 31) - 1), w])
                yield from dealt(np.concatenate([both, key]), [u, w, np.concatenate([n, m]).astype(np.int64)], buckets)
        forget(shared)

    def add_up(blocks: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        u, w, n = joined(blocks[0], [np.int64] * 3)
        key, u, w, c = summed(key := named(u, w), [key, u, w], [n])
        kind = 4 * (c > 1) + 2 * (u < 0) + (w < 0)
        for k in range(8):
            own = np.flatnonzero(kind == k)
            for lo in range(0, len(own), BLOCK):
                some = own[lo : lo + BLOCK]
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array(_bucket(key[some[:1]], buckets), pa.int32()), pa.array([len(some)], pa.int64()), pa.array([int((c[some] == 2).sum())], pa.int64()), pa.array([packed([u[some], w[some], c[some]])], pa.binary())], names=["kind", "bucket", "n", "twos", "data"])

    return met(texts.select("text").mapInArrow(tidy(run), DEALT), buckets, add_up, CELLS)


def _opened(batches: Iterator[pa.RecordBatch], choose: Callable | None = None) -> Iterator[tuple]:
    """The cells (u, w, c, no columns) of the blocks ``data``, of chosen counts only; those of large counts,
    few but long to seat, at the end all at once.
    """
    held: list[list[np.ndarray]] = []
    for x in batches:
        for data in x.column(0).to_pylist():
            u, w, c = unpacked(data, [np.int64] * 3)
            if choose is not None:
                own = choose(c)
                u, w, c = u[own], w[own], c[own]
            big = c > BIG
            if big.any():
                held.append([x[big] for x in (u, w, c)])
                u, w, c = u[~big], w[~big], c[~big]
            if len(u):
                yield u, w, c, []
    if held:
        yield *(np.concatenate(x) for x in zip(*held, strict=True)), []


def _thick(batches: Iterator[pa.RecordBatch], least: int = 250_000) -> Iterator[pa.RecordBatch]:
    """Batches joined to about ``least`` rows: what is done for each draw is then done seldom."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _dealt_rows(table: DataFrame, buckets: int, tag: int) -> DataFrame:
    """Blocks of a table of eight-byte columns, by the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _thick(batches):
            yield from dealt(x.column(0).to_numpy(), [c.to_numpy() for c in x.columns], buckets, tag)

    return table.mapInArrow(tidy(run), DEALT)


CELL, BY_U, BY_W, HALF = range(4)  # what meets in a word's bucket: cells, values of words, cells with those of u


@dataclass
class Values:
    """Values of words without a number: ``blocks`` (tag BY_U or BY_W) of their codes and values, the
    types of these, and those of a word that is not in the blocks.
    """

    blocks: DataFrame
    types: dict[int, list]
    default: dict[int, list]

    def of(self, side: int, code: np.ndarray, blocks: list[bytes]) -> list[np.ndarray]:
        key, *columns = joined(blocks, [np.int64, *self.types[side]])
        order = np.argsort(key)
        at, hit = _found(key[order], code)
        out = []
        for c, t, none in zip(columns, self.types[side], self.default[side], strict=True):
            v = np.full(len(code), none, t)
            v[hit] = c[order][at[hit]]
            out.append(v)
        return out


def _apart(cells: DataFrame, values: Values, run: Callable, ddl: str, buckets: int, choose: Callable | None = None) -> DataFrame:
    """What ``run`` gives of the cells (u, w, c, values of u and of w) of which a word has no number."""
    types, default = values.types, values.default
    blocks = {side: values.blocks.where(F.col("tag") == side) for side in (BY_U, BY_W)}
    values = Values(None, types, default)

    def deal(kind: int, side: int) -> DataFrame:
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for u, w, c, _ in _opened(batches, choose):
                yield from dealt(u if side == BY_U else w, [u, w, c], buckets, CELL)

        return cells.where(F.col("kind") % 4 == kind).select("data").mapInArrow(tidy(go), DEALT)

    def with_u(found: dict[int, list[bytes]]) -> Iterator[list[np.ndarray]]:
        u, w, c = joined(found.pop(CELL, []), [np.int64] * 3)
        if len(u):
            yield [u, w, c, *values.of(BY_U, u, found.pop(BY_U, []))]

    def left(found: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        yield from run((u, w, c, [*v, *[None] * len(types[BY_W])]) for u, w, c, *v in with_u(found))

    def half(found: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for cell in with_u(found):
            yield from dealt(cell[1], cell, buckets, HALF)

    def with_w(found: dict[int, list[bytes]]) -> Iterator[tuple]:
        own = found.pop(BY_W, [])
        u, w, c = joined(found.pop(CELL, []), [np.int64] * 3)
        if len(u):
            yield u, w, c, [*[None] * len(types[BY_U]), *values.of(BY_W, w, own)]
        u, w, c, *v = joined(found.pop(HALF, []), [np.int64] * 3 + types[BY_U])
        if len(u):
            yield u, w, c, [*v, *values.of(BY_W, w, own)]

    one = met(deal(2, BY_U).unionByName(blocks[BY_U]), buckets, left, ddl)
    both = met(deal(3, BY_U).unionByName(blocks[BY_U]), buckets, half, DEALT)
    return one.unionByName(met(deal(1, BY_W).unionByName(both).unionByName(blocks[BY_W]), buckets, lambda found: run(with_w(found)), ddl))


def _tally(blocks: DataFrame, values: Values | None, columns: list[str], value, size: int, buckets: int) -> DataFrame:
    """Sums for each word of what ``value(u, w, c, values)`` gives: (u, w, what to add to u, what to add
    to w), the last two a list of columns, None where nothing is.  Without ``values`` it needs none, else words without a number have theirs.

    Numbered words are summed in the task, the others once a batch.
    """
    m = len(columns)

    def tally(cells: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((m, size), np.int64)
        for cell in cells:
            u, w, to_u, to_w = value(*cell)
            away = []
            for code, v in ((u, to_u), (w, to_w)):
                far = np.flatnonzero(code < 0)
                own = np.flatnonzero(code >= 0) if len(far) else slice(None)
                for i, x in enumerate(v):
                    if x is not None and len(far) < len(code):
                        dense[i] += np.bincount(code[own], x[own], size).astype(np.int64)
                if len(far):
                    away.append([code[far], *(np.zeros(len(far), np.int64) if x is None else x[far] for x in v)])
            if away:
                h, *v = (np.concatenate(x) for x in zip(*away, strict=True))
                out = summed(h, [h], v)
                yield from dealt(out[0], out, buckets)
        some = np.flatnonzero(dense.any(axis=0))
        yield from dealt(some, [some, *dense[:, some]], buckets)

    def add_up(blocks: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        h, *v = joined(blocks[0], [np.int64] * (1 + m))
        yield from _by_rows(summed(h, [h], v), ["h", *columns])

    own = blocks if values is None else blocks.where("kind % 4 = 0")
    sums = own.select("data").mapInArrow(tidy(lambda x: tally(_opened(x))), DEALT)
    if values is not None:
        sums = sums.unionByName(_apart(blocks, values, tally, DEALT, buckets))
    return met(sums, buckets, add_up, "h long, " + ", ".join(f"{c} long" for c in columns))


def _filled(columns: list, code: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """The numbered words' rows of ``dense``, the others' of ``columns``, which are not needed where all have numbers."""
    own = code >= 0
    width = int(np.prod(dense.shape[1:]))
    out = np.zeros((len(code), width), dense.dtype)
    if own.any():
        out[own] = dense.reshape(len(dense), width)[code[own]]
    if not own.all():
        for i, c in enumerate(columns):
            out[~own, i] = c[~own]
    return out


def _totals(words: DataFrame, state: State, shared) -> tuple[np.ndarray, np.ndarray]:
    """For each chain the parent's customers and tables, its words of one and two customers, and the
    grid's log weights over all context restaurants, in thousandths, so that sums are exact.

    ``words(h, c, st)``; st has the chains' tables, then their customers.
    """
    grid, chains = len(GRID), len(state.a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        sums = np.zeros((chains, 4 + grid), np.int64)
        for x in _thick(batches):
            h, c, st = x.column(0).to_numpy(), x.column(1).to_numpy(), x.column(2).flatten().to_numpy().reshape(x.num_rows, -1)
            t, c0 = st[:, :chains], st[:, chains:]
            t0 = state.parent_tables(c0, common.hashes(h))
            for k in range(chains):
                sums[k, :4] += (c0[:, k].sum(), int(t0[:, k].sum()), (c0[:, k] == 1).sum(), (c0[:, k] == 2).sum())
                # most are of one customer
                more = np.flatnonzero((c > 1) | (t[:, k] > 1))
                more = more[np.lexsort((t[more, k], c[more]))]
                a, b = np.r_[1, c[more]], np.r_[1, t[more, k]]
                new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                n = np.diff(np.r_[new, len(a)])
                n[0] += len(c) - len(more) - 1
                sums[k, 4:] += (np.round(seating_weight(a[new], b[new], state.d) * 1000).astype(np.int64) * n[:, None]).sum(axis=0)
        yield pa.record_batch([pa.array(range(chains), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=["k", "v"])

    got = words.select("h", "c", "st").mapInArrow(run, "k int, v array<long>").groupBy("k").agg(*(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(4 + grid))).collect()  # a row a chain
    out = np.zeros((chains, 4 + grid), object)
    for r in got:
        out[r["k"]] = [r[f"v{i}"] for i in range(4 + grid)]
    return out[:, :4], out[:, 4:].astype(np.float64) / 1000


def _rows(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(n, -1)


def fit(train: DataFrame, words: int = WORDS, chains: int = CHAINS, sweeps: int = SWEEPS, burn: int = BURN, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the texts of ``train``.  Null texts are empty; repeated rows count again.

    Without rows there is no word and "unseen" has probability one.  ``words`` bounds what is
    numbered and broadcast.
    """
    context = train.sparkSession.sparkContext
    texts = _texts(train, id_col, text_col)
    counted = scratch.table(_words(texts, _buckets(train)), "words")
    n = counted.agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).first()
    total, kinds = n["total"] or 0, n["kinds"]
    level = F.floor(8 * F.log2("c") + 1e-9)
    least = _within(counted.groupBy(level.alias("level")).agg(F.count("*").alias("n")), words)
    top = counted.where(level >= least).select("h", "c").toArrow() if least is not None else None
    common = Common(top.column("h").to_numpy(), top.column("c").to_numpy()) if top else Common(np.empty(0, np.int64), np.empty(0, np.int64))
    scratch.drop(counted)
    shared, size = context.broadcast(common), len(common.h)
    # in folders by count and by which words have a number, so that each part is read by itself
    buckets = _buckets(train, total)
    cells = scratch.table(_pairs(texts, shared, buckets), "cells", by="kind")
    multi = cells.where("kind >= 4")
    few = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("kind") < 4, F.col("n"))).alias("n1"), F.sum("twos").alias("n2")).first()

    def count(u: np.ndarray, w: np.ndarray, c: np.ndarray, _):
        one = (c == 1).astype(np.int64)
        return u, w, [None, one, 1 - one, None, None], [c, None, None, one, 1 - one]

    # a word's count, and its pairs of one and of more customers, as context (t1, m1) and as word (s1, m2)
    base = scratch.table(_tally(cells, None, ["c", "t1", "m1", "s1", "m2"], count, size, buckets), "base")
    # the first seating has one table for each cell and each word
    begin = F.array(*[F.col("t1") + F.col("m1")] * chains, *[F.col("s1") + F.col("m2")] * chains)
    still = base.where("m1 + m2 = 0").select("h", "c", begin.alias("st"))
    moving = scratch.table(base.where("m1 + m2 > 0").select("h", "c", "t1", "s1", begin.alias("st")), "moving")
    got = base.where("h >= 0").select("h", begin.alias("st")).toArrow()
    dense = np.zeros((size, 2 * chains), np.int64)
    if got.num_rows:
        dense[got.column("h").to_numpy()] = _rows(got.column("st").combine_chunks(), got.num_rows)
    pairs = few["n"] or 0
    state = State(kinds, _discount(few["n1"] or 0, few["n2"] or 0), [10.0] * chains, [10.0] * chains, [0.5] * chains, [pairs] * chains, [kinds] * chains)
    states, history = [state], [dense]
    salt = [(seed * 1000 + i) * 100 for i in range(sweeps)]
    for sweep in range(sweeps if total else 0):
        values = context.broadcast((state, dense[:, :chains], state.share(dense[:, chains:], common.h)))

        def seat(u: np.ndarray, w: np.ndarray, c: np.ndarray, more: list, values=values, salt=salt[sweep]):
            common, (state, t_dense, share_dense) = shared.value, values.value
            t_u, hw = _filled(more[:chains], u, t_dense), common.hashes(w)
            share, rare = np.zeros((len(w), chains)), w < 0
            share[~rare] = share_dense[w[~rare]]
            if rare.any():
                share[rare] = state.share(np.stack([c[rare] for c in more[chains:]], axis=1), hw[rare])
            t, none = [*state.seat(c, t_u, share, pair(common.hashes(u), hw), salt).astype(np.int64).T], [None] * chains
            return u, w, t + none, none + t

        last = 2 * chains * sweep
        at = lambda j: [F.col("st")[last + j + k] for k in range(chains)]
        rare = moving.where("h < 0")
        met_ = _dealt_rows(rare.select("h", *at(0)), buckets, BY_U).unionByName(_dealt_rows(rare.select("h", *at(chains)), buckets, BY_W))
        others = Values(met_, {BY_U: [np.int64] * chains, BY_W: [np.int64] * chains}, {BY_U: [0] * chains, BY_W: [0] * chains})
        names = [f"{x}{k}" for x in ("out", "in") for k in range(chains)]
        moved = _tally(multi, others, names, seat, size, buckets)
        now = F.array(*[F.col("t1" if x.startswith("out") else "s1") + F.coalesce(x, F.lit(0)) for x in names])
        was, moving = moving, scratch.table(moving.join(moved, "h", "left").select("h", "c", "t1", "s1", F.concat("st", now).alias("st")), "moving")
        scratch.drop(was)
        values.destroy()
        _release(train.sparkSession)
        latest = moving.select("h", "c", F.slice("st", last + 2 * chains + 1, 2 * chains).alias("st"))
        got = latest.where("h >= 0").toArrow()
        dense = dense.copy()
        if got.num_rows:
            dense[got.column("h").to_numpy()] = _rows(got.column("st").combine_chunks(), got.num_rows)
        state = State(kinds, state.d, list(state.a), list(state.a0), list(state.d0), list(state.every), list(state.many), salt[sweep] + 50, [(state.rest(k), state.d0[k]) for k in range(chains)])
        sums, weights = _totals(latest.unionByName(still), state, shared)
        for k in range(chains):
            state.every[k], state.many[k] = int(sums[k, 0]), int(sums[k, 1])
            state.d0[k] = _discount(float(sums[k, 2]), float(sums[k, 3]))
            state.a0[k] = _drawn(seating_weight(np.array([state.every[k]]), np.array([state.many[k]]), state.d0[k])[0], salt[sweep] + 80 + k)
            state.a[k] = _drawn(weights[k], salt[sweep] + 90 + k)
        states.append(state)
        history.append(dense)
    taken = range(min(burn, sweeps - 1), sweeps) if total else []
    unseen = float(np.mean([states[i + 1].unseen() for i in taken])) if total else 1.0

    def averaged(st: np.ndarray, c: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(w) and the parent's weight of words with the seatings ``st`` of all sweeps."""
        p, b = np.zeros(len(c)), np.zeros(len(c))
        for i in taken:
            after, x = states[i + 1], 2 * chains * (i + 1)
            p += after.share(st[:, x + chains : x + 2 * chains], h).mean(axis=1)
            a = np.array(states[i].a)
            b += ((a + state.d * st[:, x : x + chains]) / (c[:, None] + a)).mean(axis=1)
        return p / max(len(taken), 1), b / max(len(taken), 1)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for x in _thick(batches):
            if x.num_rows:
                h, c = x.column(0).to_numpy(), x.column(1).to_numpy()
                p, b = averaged(_rows(x.column(2), len(h)), c, common.hashes(h))
                yield pa.record_batch([x.column(0), x.column(1), pa.array(p), pa.array(b)], names=["h", "c", "p", "b"])

    every = moving.select("h", "c", "st").unionByName(still.select("h", "c", F.flatten(F.array_repeat("st", len(states))).alias("st")))
    found = scratch.table(every.mapInArrow(tidy(finish), "h long, c long, p double, b double"), "model")
    ask = [(2 * chains * i + k, 2 * chains * i + chains + k) for i in taken for k in range(chains)]

    def values_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _thick(batches):
            if x.num_rows:
                h, c, st = x.column(0).to_numpy(), x.column(1).to_numpy(), _rows(x.column(2), x.num_rows)
                p, b = averaged(st, c, ~h)
                yield from dealt(h, [h, c, b, *(st[:, i] for i, _ in ask)], buckets, BY_U)
                yield from dealt(h, [h, p, *(st[:, j] for _, j in ask)], buckets, BY_W)

    # all words met once have the same values
    p, b = (float(v[0]) for v in averaged(np.ones((1, 2 * chains * len(states)), np.int64), np.ones(1, np.int64), np.zeros(1, np.int64)))
    others = Values(
        scratch.table(every.where("h < 0 AND c > 1").mapInArrow(tidy(values_of), DEALT), "values"),
        {BY_U: [np.int64, np.float64] + [np.int64] * len(ask), BY_W: [np.float64] + [np.int64] * len(ask)},
        {BY_U: [1, b] + [1] * len(ask), BY_W: [p] + [1] * len(ask)},
    )
    scratch.drop(base)
    scratch.drop(moving)
    p, b = averaged(np.concatenate(history, axis=1), common.c, common.h)
    dense_t = np.stack([history[i][:, :chains] for i in taken], axis=1) if total else np.zeros((0, 0, chains), np.int64)
    dense_share = np.stack([states[i].share(history[i][:, chains:], common.h) for i in taken], axis=1) if total else np.zeros((0, 0, chains))
    values = context.broadcast((p, b, dense_t, dense_share))
    n_taken = len(taken)

    def weigh(cells: Iterator[tuple], give: Callable) -> Iterator[pa.RecordBatch]:
        common, (p, b, dense_t, dense_share) = shared.value, values.value
        for u, w, c, more in cells:
            cu, b_u, p_w = (_filled(more[i : i + 1], code, table)[:, 0] for i, code, table in ((0, u, common.c), (1, u, b), (2 + n_taken * chains, w, p)))
            t = np.ones((len(u), n_taken, chains))
            many = np.flatnonzero(c > 1)
            if len(many):
                mu, mw = u[many], w[many]
                # the seatings of all sweeps of words without a number
                shape = (len(many), n_taken, chains)
                t_u = _filled([v if v is None else v[many] for v in more[2 : 2 + n_taken * chains]], mu, dense_t).reshape(shape)
                hw, rare = common.hashes(mw), mw < 0
                share = np.zeros(shape)
                share[~rare] = dense_share[mw[~rare]] if len(dense_share) else 0
                if rare.any():
                    c0 = np.stack([v[many][rare] for v in more[3 + n_taken * chains :]], axis=1).reshape(-1, n_taken, chains)
                    for j, i in enumerate(taken):
                        share[rare, j] = states[i].share(c0[:, j], hw[rare])
                key = pair(common.hashes(mu), hw)
                strength = np.concatenate([states[i].strength(t_u[:, j], share[:, j]) for j, i in enumerate(taken)], axis=1)
                t[many] = seated(c[many], strength, state.d, key, [salt[i] + k for i in taken for k in range(chains)]).reshape(shape)
            a = np.array([states[i].a for i in taken])
            e = ((c[:, None, None] - state.d * t) / (cu[:, None, None] + a)).mean(axis=(1, 2))
            low = b_u * p_w
            yield from give(u, w, c, e, np.log10((e + low) / low))

    def blocks(choose: Callable | None, give: Callable, ddl: str, numbered: bool = True) -> DataFrame:
        some = multi if choose is not None and not choose(np.ones(1, np.int64))[0] else cells
        rare = _apart(some, others, lambda x: weigh(x, give), ddl, buckets, choose)
        return some.where("kind % 4 = 0").select("data").mapInArrow(tidy(lambda x: weigh(_opened(x, choose), give)), ddl).unionByName(rare) if numbered else rare

    _release(train.sparkSession)
    return Model(found, cells, blocks, weigh, buckets, total, kinds, unseen, common, shared)


# what the blocks of apply hold
TEXT, PAIR, WORD, ASKED_PAIR, ASKED_WORD, ANSWER, NUMBERED = range(7)
TEXT_TYPES = [np.int64] * 5 + [np.float64] * 2  # row, id, has an id, tokens, known ones, base, score


def score(docs: DataFrame, train: DataFrame, words: int = WORDS, pairs: int = PAIRS, chains: int = CHAINS, sweeps: int = SWEEPS, burn: int = BURN, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score, perplexity)`` per row of ``docs``.

    ``train`` has the rows learned from.  base_score adds log10((c + 0.1) / (N + 0.1 (V + 1))) over
    the tokens; score is the model's log10 probability.  Null texts are empty: just the end.
    Without training rows every token is unseen, and unseen is certain.  Null and repeated ids are
    scored row by row, equal texts get equal scores.  An empty table gives no rows.  Words whose
    counts tie are numbered by hash.  ``words`` and ``pairs`` bound what is broadcast and change no
    score.
    """
    return apply(docs, fit(train, words, chains, sweeps, burn, seed, id_col, text_col), pairs, id_col, text_col)


def apply(docs: DataFrame, model: Model, pairs: int = PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The scores of :func:`score` by a fitted model."""
    spark = docs.sparkSession
    total, kinds = model.total, model.kinds
    plain = float(np.log10(0.1 / (total + 0.1 * (kinds + 1))))
    base = F.log10((F.col("c") + 0.1) / (total + 0.1 * (kinds + 1)))
    own = model.words.select(F.col("h").alias("key"), "c", (F.log10("p") + F.log10("b")).alias("lp"), base.alias("base"))
    buckets, weigh = model.buckets, model.weigh

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1024, np.int64)  # a count below 2**63 has a level below 504
        for _, _, c, _ in _opened(batches):
            n += np.bincount(_level(c), minlength=1024)
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some), pa.array(n[some])], names=["level", "n"])

    singles = model.cells.where("kind < 4").select(F.lit(0).cast("long").alias("level"), "n")
    least = _within(model.cells.where("kind >= 4").select("data").mapInArrow(tidy(levels), "level long, n long").unionByName(singles), pairs)

    choose = None if least is None else lambda c: _level(c) < least

    def lookup(u: np.ndarray, w: np.ndarray, c: np.ndarray, e: np.ndarray, lp: np.ndarray) -> Iterator[pa.RecordBatch]:
        return _by_rows([named(u, w), lp], ["key", "lp"])

    def send(u: np.ndarray, w: np.ndarray, c: np.ndarray, e: np.ndarray, lp: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = named(u, w)
        return dealt(key, [key, lp], buckets, PAIR)

    got = own.where("key >= 0").toArrow()
    lp, bases = np.zeros(len(model.common.h)), np.zeros(len(model.common.h))
    lp[got.column("key").to_numpy()], bases[got.column("key").to_numpy()] = got.column("lp").to_numpy(), got.column("base").to_numpy()
    often, often_lp = np.empty(0, np.int64), np.empty(0)
    if least is not None:
        top = model.blocks(lambda c: _level(c) >= least, lookup, "key long, lp double").toArrow()  # at most ``pairs`` rows
        order = np.argsort(top.column("key").to_numpy())
        often, often_lp = top.column("key").to_numpy()[order], top.column("lp").to_numpy()[order]
        del top
        _release(spark)
    sent_words, shared = model.sent, spark.sparkContext.broadcast((lp, bases, often, often_lp))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, (lp, bases, often, often_lp) = sent_words.value, shared.value
        end = common.codes(np.array([_hash(END)]))[0]
        for b in batches:
            for lo, hi in parts(b.column(2)):
                row, ids = b.column(0)[lo:hi].to_numpy(), b.column(1)[lo:hi]
                h, begin = read(b.column(2)[lo:hi])
                w, size = common.codes(h), np.diff(np.r_[begin, len(h)])
                del h
                of, own = np.repeat(np.arange(len(row)), size), w >= 0
                base, gain = np.zeros(len(w)), np.zeros(len(w))
                base[own], gain[own] = bases[w[own]], lp[w[own]]
                sums = [np.add.reduceat(x, begin) for x in (own.astype(np.int64), base, gain)]
                del base, gain
                key, at, text, n = by_text(named(before(w, end), w), of)
                j, hit = _found(often, key)
                sums[2] += np.bincount(text, n * np.where(hit, often_lp[j] if len(often) else 0.0, 0.0)[at], len(row))
                yield from dealt(row, [row, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), size, *sums], buckets, TEXT)
                left = np.flatnonzero(~hit[at])
                key = key[at[left]]
                yield from dealt(key, [key, row[text[left]], n[left]], buckets, ASKED_PAIR)
                rare = np.flatnonzero(~own)
                key, at, text, n = by_text(w[rare], of[rare])
                yield from dealt(key[at], [key[at], row[text], n], buckets, ASKED_WORD)
        forget(shared)

    unseen = float(np.log10(model.unseen))

    def by_row(row: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
        """Sums for each row of a block: its rows were read together, so that they lie close."""
        low = row.min()
        some = np.flatnonzero(np.bincount(row - low))
        return [some + low, *(np.bincount(row - low, c)[some] for c in columns)]

    def answer(blocks: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        """Each text's sums go on, with what it gets for the words and pairs of this bucket."""
        text = joined(blocks.pop(TEXT, []), TEXT_TYPES)
        yield from dealt(text[0], text, buckets, TEXT)
        key, lp = joined(blocks.pop(PAIR, []), [np.int64, np.float64])
        keys, lps = [key], [lp]
        for u, w, c, _ in _opened([pa.record_batch([pa.array(blocks.pop(NUMBERED, []), pa.binary())], names=["data"])], choose):
            keys.append(named(u, w))
            lps += weigh([(u, w, c, [])], lambda u, w, c, e, lp: [lp])
        key, lp = np.concatenate(keys), np.concatenate(lps)
        order = np.argsort(key)
        key, lp = key[order], lp[order]
        sums: list[list[np.ndarray]] = [[none := np.empty(0, np.int64), none, np.empty(0), np.empty(0)]]
        for block in blocks.pop(ASKED_PAIR, []):
            want, row, n = unpacked(block, [np.int64] * 3)
            at, hit = _found(key, want)
            if hit.any():
                row, gain = by_row(row[hit], n[hit] * lp[at[hit]])
                sums.append([row, np.zeros(len(row), np.int64), np.zeros(len(row)), gain])
        key, lp, base = joined(blocks.pop(WORD, []), [np.int64, np.float64, np.float64])
        order = np.argsort(key)
        key, lp, base = key[order], lp[order], base[order]
        for block in blocks.pop(ASKED_WORD, []):
            want, row, n = unpacked(block, [np.int64] * 3)
            at, hit = _found(key, want)
            value = lambda table, none: n * np.where(hit, table[at] if len(table) else none, none)  # noqa: B023, E731
            row, known, low, gain = by_row(row, n * hit, value(base, plain), value(lp, unseen))
            sums.append([row, known.astype(np.int64), low, gain])
        rows, *sums = (np.concatenate(x) for x in zip(*sums, strict=True))
        sums = summed(rows, [rows], sums)
        yield from dealt(sums[0], sums, buckets, ANSWER)

    def whole(blocks: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        row, ids, has, size, n, base, gain = joined(blocks.pop(TEXT, []), TEXT_TYPES)
        order = np.argsort(row)
        to, more, more_base, more_gain = joined(blocks.pop(ANSWER, []), [np.int64, np.int64, np.float64, np.float64])
        at = order[np.searchsorted(row[order], to)]
        n = n + np.bincount(at, more, len(row)).astype(np.int64)
        base, gain = base + np.bincount(at, more_base, len(row)), gain + np.bincount(at, more_gain, len(row))
        for lo in range(0, len(row), 100_000):
            x = slice(lo, lo + 100_000)
            yield pa.record_batch([pa.array(ids[x], mask=has[x] == 0), *(pa.array(c[x]) for c in (size, n, base, gain))], names=["id", "n_tokens", "n_known", "base_score", "score"])

    rows = _texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    sent = rows.mapInArrow(tidy(measure), DEALT).unionByName(_dealt_rows(own.where("key < 0").select("key", "lp", "base"), buckets, WORD))
    if least is None or least > 0:
        # cells of numbered words lie in their buckets as they are; the others' shuffle files go before the texts are sent
        rare = scratch.table(model.blocks(choose, send, DEALT, False), "rare")
        _release(spark)
        sent = sent.unionByName(model.cells.where("kind % 4 = 0").select("bucket", F.lit(NUMBERED).alias("tag"), "data")).unionByName(rare)
    out = met(met(sent, buckets, answer, DEALT), buckets, whole, "id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("id", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
