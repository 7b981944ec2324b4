"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Examples are at most ``most`` labelled rows (those of the smallest id hashes).  A text's terms are
all its lower-cased words and their first STEM characters; every term of an example is in the
vocabulary.  A term weighs (1 + ln tf) idf r, r its relevance: the squared log2 of 2 plus how many
times as often it stands in toxic examples as in the others (counted in Spark), so that words that
go with neither label weigh least and no threshold depends on the number of examples.

Examples become unit vectors in an inverted index cut into blocks of examples, toxic ones first,
with each term's largest weight in each block.  Terms that a sixteenth of the examples have are held
as dense rows, whose part of all cosines is one product; with it and the other terms' largest
weights a query bounds every block, scores the most promising whole (all at once where the bounds lie
within a factor of two), and then all others that could still reach its k-th best cosine, so the
neighbours are exact.  They vote with a weight that falls with distance; a monotone fit over the
examples, each scored without itself, turns votes into probabilities.  Texts without any term of an
example get the rate among such examples.

The index has an entry for each distinct term of each example; ``most`` bounds their number.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gridtrack.llm.common import forget, kept, parts, scratch, tidy

WORD = re.compile(r"[^\W\d_]+")
STEM = 4
BLOCK = 512
OFTEN = 16  # a term that one example in so many has is a dense row
FIRST = 2  # blocks scored at once before the others are judged by their bounds
MEMO = 300_000  # words numbered before they are forgotten, and those of one text
TOGETHER = 64  # texts whose frequent terms go through one product
LATIN = bytes(i if WORD.match(chr(i)) else 32 for i in range(256))  # what WORD does not match becomes a space


def words_of(text: str) -> list[str]:
    """The lower-cased words (WORD), found byte by byte where all characters are Latin-1."""
    low = text.lower()
    try:
        return low.encode("latin-1").translate(LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(low)


def terms_of(word: str) -> tuple[int, int]:
    """Hashes of a lower-cased word and of its stem; a space tells the stem from a word."""
    return xxhash.xxh64_intdigest(word) - (1 << 63), xxhash.xxh64_intdigest(f"{word[:STEM]} ") - (1 << 63)


class Numbers(dict):
    """Words numbered as they come; ``new`` are those not yet looked up."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Terms:
    """Known terms of whole texts and their counts, with a bounded memo of words; ``keys`` are sorted hashes."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.words = keys, Numbers()
        self.ids = np.empty((0, 2), np.int32)  # of each numbered word, the numbers of its two terms or -1

    def _learn(self) -> None:
        new = self.words.new
        want = np.array([h for w in new for h in terms_of(w)], np.int64)
        at = np.full(len(want), -1)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            at = np.where(self.keys[at] == want, at, -1)
        end = len(self.words)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty((2 * end - len(self.ids), 2), np.int32)])
        self.ids[end - len(new) : end] = at.reshape(-1, 2)
        new.clear()

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known terms, ascending, and how often the text has them."""
        words = Counter(words_of(text))
        if len(self.words) > MEMO:
            self.words = Numbers()
        number = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if self.words.new:
            self._learn()
        t = self.ids[number].ravel().astype(np.int64)
        n = np.repeat(np.fromiter(words.values(), np.int64, len(words)), 2)
        own = t >= 0
        ids, back = np.unique(t[own], return_inverse=True)
        return ids, np.bincount(back, n[own], len(ids)).astype(np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    ends = np.cumsum(size)
    out = np.repeat(start - (ends - size), size)
    out += np.arange(len(out))
    return out


class Index:
    """Unit vectors of examples in a block-max inverted index."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, terms: int, relevance: np.ndarray | None = None):
        self.n, self.toxic = len(vectors), toxic
        df = np.zeros(terms, np.int64)
        for t, _ in vectors:
            df[t] += 1
        self.weigh = (np.log((1 + self.n) / (1 + df)) + 1) * (1.0 if relevance is None else relevance)
        self.blocks = -(-max(self.n, 1) // BLOCK)
        often = np.flatnonzero(df * OFTEN > self.n)
        self.row = np.full(terms, -1, np.int32)
        self.row[often] = np.arange(len(often), dtype=np.int32)
        self.rows = np.zeros((len(often), self.n), np.float32)
        rare_t, rare_w, size = [], [], np.zeros(self.n, np.int64)
        for i, (t, n) in enumerate(vectors):
            w, r = self.unit(t, n).astype(np.float32), self.row[t]
            self.rows[r[r >= 0], i] = w[r >= 0]
            rare_t.append(t[r < 0].astype(np.int32))
            rare_w.append(w[r < 0])
            size[i] = len(rare_t[-1])
        term = np.concatenate(rare_t) if rare_t else np.empty(0, np.int32)
        order = np.argsort(term, kind="stable")  # within a term by example
        term, self.who = term[order], np.repeat(np.arange(self.n), size)[order]  # as bincount takes them
        self.weight = np.concatenate(rare_w)[order] if rare_w else np.empty(0, np.float32)
        # a range of postings for each term and block that has it, with its largest weight
        block = self.who // BLOCK
        self.start = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]).astype(np.int32) if len(term) else np.empty(0, np.int32)
        self.size = np.diff(np.r_[self.start, len(term)]).astype(np.int32)
        self.block = block[self.start].astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, self.start) if len(term) else np.empty(0, np.float32)
        self.first = np.searchsorted(term[self.start], np.arange(terms + 1)).astype(np.int32)
        self.posts = np.searchsorted(term, np.arange(terms + 1)).astype(np.int32)

    def unit(self, t: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The terms' weights in a vector of length one."""
        w = (1 + np.log(n)) * self.weigh[t]
        length = np.sqrt((w * w).sum())
        return w / length if length else w

    def frequent(self, vectors: list[tuple[np.ndarray, np.ndarray]], units: list[np.ndarray] | None = None) -> np.ndarray:
        """The frequent terms' part of all cosines, a row a vector; one product for all of them."""
        whole = np.zeros((len(vectors), len(self.rows)), np.float32)
        for i, (t, n) in enumerate(vectors):
            r = self.row[t]
            own = r >= 0
            whole[i, r[own]] = (self.unit(t, n) if units is None else units[i])[own]
        return whole @ self.rows

    def nearest(self, t: np.ndarray, n: np.ndarray, k: int, without: int = -1, base: np.ndarray | None = None, unit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest, nearest first, ties to the smaller position."""
        base = self.frequent([(t, n)])[0] if base is None else base
        rare = self.row[t] < 0
        t, q = t[rare], (self.unit(t, n) if unit is None else unit)[rare]
        size, once = self.first[t + 1] - self.first[t], q
        at, q = _ranges(self.first[t], size), np.repeat(q, size)
        block = self.block[at]
        bound = np.bincount(block, q * self.top[at], self.blocks) + np.maximum.reduceat(base, np.arange(0, self.n, BLOCK))
        ids, cos = np.empty(0, np.int64), np.empty(0)
        left = bound > 0
        if bound.min() > bound.max() / 2:  # bounds so near each other seldom rule a block out
            some = np.arange(self.blocks)
        else:
            some = np.argsort(-bound, kind="stable")[:FIRST]
        while True:
            now = np.zeros(self.blocks, bool)
            now[some] = left[some]
            left &= ~now
            if now.all():
                m, by = self.posts[t + 1] - self.posts[t], once
                post = _ranges(self.posts[t], m)
            else:
                own = now[block]
                where, m, by = at[own], self.size[at[own]], q[own]
                post = _ranges(self.start[where], m)
            sums = np.bincount(self.who[post], np.repeat(by, m) * self.weight[post], self.n) if len(post) else np.zeros(self.n)
            sums += base
            if not now.all():
                sums[~np.repeat(now, BLOCK)[: self.n]] = 0.0
            if without >= 0:
                sums[without] = 0
            hit = np.flatnonzero(sums > max(0.0, cos[-1] - 1e-6 if len(cos) == k else 0.0))
            ids, cos = np.concatenate([ids, hit]), np.concatenate([cos, sums[hit]])
            if len(cos) > 2 * k > 0:  # others are below the k-th when rounded, too
                near = np.flatnonzero(cos >= np.partition(cos, -k)[-k] - 2e-6)
                ids, cos = ids[near], cos[near]
            order = np.lexsort((ids, -np.round(cos, 6)))[:k]
            ids, cos = ids[order], cos[order]
            some = np.flatnonzero(left & (bound + 1e-6 >= cos[-1])) if len(cos) == k else np.flatnonzero(left)
            if not len(some):
                return ids, cos

    def vote(self, t: np.ndarray, n: np.ndarray, k: int, without: int = -1, base: np.ndarray | None = None, unit: np.ndarray | None = None) -> tuple[float | None, np.ndarray]:
        """Distance-weighted share of toxic neighbours (None: no neighbour), and the neighbours."""
        ids, cos = self.nearest(t, n, k, without, base, unit) if len(t) else (np.empty(0, np.int64), np.empty(0))
        if not len(ids):
            return None, ids
        w = 1 / (1.05 - np.minimum(cos, 1))
        return float((w * self.toxic[ids]).sum() / w.sum()), ids


def monotone(votes: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: cut points and the probability from each on, smoothed by one half."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for v, y in zip(votes[order], toxic[order], strict=True):
        if pools and pools[-1][3] == v:
            pools[-1][0] += y
            pools[-1][1] += 1
        else:
            pools.append([float(y), 1.0, v, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] and pools[-2][3] != pools[-1][3]:
            b = pools.pop()
            pools[-1] = [pools[-1][0] + b[0], pools[-1][1] + b[1], pools[-1][2], b[3]]
    return np.array([p[2] for p in pools]), np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools])


class Model:
    def __init__(self, vocabulary: np.ndarray, index: Index, ids: list, k: int):
        self.vocabulary, self.index, self.ids, self.k = vocabulary, index, ids, k
        self.cuts, self.rates, self.none = np.empty(0), np.empty(0), 0.0

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> None:
        votes = []
        for lo in range(0, len(vectors), TOGETHER):
            some = vectors[lo : lo + TOGETHER]
            votes += [self.index.vote(*v, self.k, lo + i, b)[0] for i, (v, b) in enumerate(zip(some, self.index.frequent(some), strict=True))]
        has = np.array([v is not None for v in votes], bool)
        self.none = (float(toxic[~has].sum()) + 0.5) / (float((~has).sum()) + 1) if len(toxic) else 0.0
        if has.any():
            self.cuts, self.rates = monotone(np.array([v for v in votes if v is not None]), toxic[has])

    def scores(self, every: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list]]:
        """For each text the probability and the ids of the neighbours that speak for it."""
        out = []
        for lo in range(0, len(every), TOGETHER):
            some = every[lo : lo + TOGETHER]
            units = [self.index.unit(*c) for c in some]
            out += [self._score(*x) for x in zip(some, self.index.frequent(some, units), units, strict=True)]
        return out

    def _score(self, counts: tuple[np.ndarray, np.ndarray], base: np.ndarray, unit: np.ndarray) -> tuple[float, list]:
        vote, ids = self.index.vote(*counts, self.k, base=base, unit=unit)
        if vote is None or not len(self.cuts):
            return self.none, []
        at = max(int(np.searchsorted(self.cuts, vote, "right")) - 1, 0)
        return float(self.rates[at]), [self.ids[i] for i in ids]


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, k: int = 25, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the labelled rows given: at most ``most`` of them, by id hash.

    Null ids and labels are left out; of several labels of one id the largest counts, of several
    texts the smallest.  Without examples the model gives 0.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    ids = ids.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    examples = scratch.table(texts.groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text")), "examples")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (Counter(), Counter())
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                both[y > 0].update({t for w in set(words_of(text)) for t in terms_of(w)})
        names = list(both[0] | both[1])
        for lo in range(0, len(names), 50_000):
            some = names[lo : lo + 50_000]
            yield pa.record_batch([pa.array(some, pa.int64()), pa.array([both[1][f] for f in some], pa.int64()), pa.array([both[0][f] for f in some], pa.int64())], names=["f", "n1", "n0"])

    counted = examples.select("y", "text").mapInArrow(tidy(seen), "f long, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    total = examples.agg(F.sum((F.col("y") > 0).cast("long")).alias("n1"), F.sum((F.col("y") <= 0).cast("long")).alias("n0")).first()
    found = counted.orderBy("f").toArrow()
    vocab = found.column("f").to_numpy()
    n1, n0 = found.column("n1").to_numpy(), found.column("n0").to_numpy()
    relevance = np.log2(2 + n1 / np.maximum(n0, 1) * (total["n0"] or 0) / max(total["n1"] or 0, 1)) ** 2

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(vocab)
        for x in batches:
            own = [terms.counts(t) for t in x.column(2).to_pylist()]
            yield pa.record_batch([x.column(0), x.column(1), pa.array([t.astype(np.int32) for t, _ in own], pa.list_(pa.int32())), pa.array([n.astype(np.int32) for _, n in own], pa.list_(pa.int32()))], names=["id", "y", "t", "n"])

    drawn = examples.select("id", "y", "text").mapInArrow(tidy(vectors), "id long, y int, t array<int>, n array<int>").toArrow().combine_chunks()  # at most ``most`` rows
    ids, toxic = drawn.column("id").to_numpy(), (drawn.column("y").to_numpy() > 0).astype(np.int64)
    order = np.lexsort((ids, -toxic)).tolist()
    t, n = (drawn.column(c).combine_chunks() for c in ("t", "n"))
    own = [(t[i].values.to_numpy(), n[i].values.to_numpy()) for i in order]
    ids, toxic = ids[order].tolist(), toxic[order]
    model = Model(vocab, Index(own, toxic, len(vocab), relevance), ids, k)
    model.calibrate(own, toxic)
    scratch.drop(examples)
    return model


def apply(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, evidence)`` per row: probability, and up to k example ids, nearest first.

    No shuffle.  Null texts count as empty; a text without a term of an example gets the rate of
    such examples and no evidence.  Whole texts are read, however long; repeated rows score alike.
    Of examples equally near, toxic ones and then those of smaller ids come first.  An empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        terms = kept(("terms", shared._path), lambda: Terms(m.vocabulary))
        for b in batches:
            for lo, hi in parts(b.column(1)):
                found = m.scores([terms.counts(t or "") for t in b.column(1)[lo:hi].to_pylist()])
                yield pa.record_batch([b.column(0)[lo:hi], pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))], names=["id", "score", "evidence"])
        forget(shared)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run, keep=True), "id long, score double, evidence array<long>")


def below(docs: DataFrame, model: Model, limit: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, all columns as they were; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        terms = kept(("terms", shared._path), lambda: Terms(m.vocabulary))
        for b in batches:
            for lo, hi in parts(b.column(at)):
                part = b.slice(lo, hi - lo)
                yield part.filter(pa.array([p < limit for p, _ in m.scores([terms.counts(t or "") for t in part.column(at).to_pylist()])], pa.bool_()))
        forget(shared)

    return docs.mapInArrow(tidy(run, keep=True), docs.schema)
