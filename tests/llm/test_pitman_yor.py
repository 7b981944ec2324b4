import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridtrack.llm import pitman_yor
from gridtrack.llm.common import documents
from tests.llm.helpers import empty_docs, odd_docs


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def check_base(docs, train, **how):
    count = Counter(w for r in train.collect() for w in words(r.text))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r in docs.collect():
        own = words(r.text)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want[(r.doc_id, len(own), sum(count[w] > 0 for w in own), n, round(base, 6))] += 1
    rows = pitman_yor.score(docs, train, **how).collect()
    assert Counter((r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    return rows


def test_documents(spark, sf):
    docs = documents(spark, sf)
    train = docs.where("crc32(cast(doc_id as string)) % 10 <> 0")
    rows = check_base(docs, train, sweeps=2)
    held = [r for r in rows if zlib.crc32(str(r.id).encode()) % 10 == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    joined = {r.id: r.score for r in check_base(docs, train, words=50, pairs=40, sweeps=2)}
    assert all(math.isclose(r.score, joined[r.id], rel_tol=1e-9) for r in rows)


def test_odd(spark):
    docs = odd_docs(spark)
    check_base(docs, docs)
    rows = check_base(docs, docs.limit(0))
    assert all(r.score <= 1e-9 for r in rows)
    assert pitman_yor.score(empty_docs(spark), docs).count() == 0


def parts_of(model):
    names = {pitman_yor._hash(w.encode()): w for w in model_words}
    name = lambda code: names[int(model.common.hashes(np.array([code]))[0])]
    p = {name(r.h): (r.p, r.b) for r in model.words.collect()}
    e = {(name(r.u), name(r.w)): r.e for r in model.weighed(F.lit(True)).collect()}
    return p, e


TEXTS = ["a b a c a b", "b a d", "a b e f g", "a a b c", "A B a b a b a b", None, "", "c"]
model_words = sorted({w for t in TEXTS for w in words(t)})


def test_probabilities_sum_to_one(spark):
    """Over all seen words and "unseen", after every context."""
    train = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    model = pitman_yor.fit(train, words=3, chains=3, sweeps=4, burn=2)
    p, e = parts_of(model)
    assert 0 < len(model.common.h) < model.kinds
    assert set(p) == set(model_words) and model.kinds == len(p)
    count = Counter(x for t in TEXTS for x in zip(["", *words(t)], words(t)))
    assert set(e) == set(count)
    assert math.isclose(sum(x for x, _ in p.values()) + model.unseen, 1, abs_tol=1e-9)
    for u, (_, b) in p.items():
        own = sum(e.get((u, w), 0) + b * q for w, (q, _) in p.items())
        assert math.isclose(own + b * model.unseen, 1, abs_tol=1e-9), u
    assert e["a", "b"] > e["a", "d"] if ("a", "d") in e else e["a", "b"] > e["a", "a"]
    # and every text's score is the sum of its tokens' logarithms
    probes = [*TEXTS, "a zzz b", "zzz", "d a zzz yyy"]
    docs = spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string")
    for how in ({}, {"pairs": 3}):
        got = {r.id: r.score for r in pitman_yor.apply(docs, model, **how).collect()}
        for i, t in enumerate(probes):
            own = words(t)
            want = sum(math.log10(e.get((u, w), 0) + p.get(u, (0, 1))[1] * p.get(w, (model.unseen, 0))[0]) for u, w in zip(["", *own], own))
            assert math.isclose(got[i], want, rel_tol=1e-9), (t, how)


def test_bounds_change_nothing(spark):
    train = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    one = {r.id: r.score for r in pitman_yor.score(train, train).collect()}
    for how in ({"words": 0, "pairs": 0}, {"words": 2, "pairs": 3}):
        other = {r.id: r.score for r in pitman_yor.score(train, train, **how).collect()}
        assert all(math.isclose(one[i], other[i], rel_tol=1e-9) for i in one)


def test_partitions_change_nothing(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text").where("doc_id < 60")
    train = docs.where("doc_id % 10 <> 0")
    once = {r.id: r.score for r in pitman_yor.score(docs.coalesce(1), train.coalesce(1)).collect()}
    many = {r.id: r.score for r in pitman_yor.score(docs.repartition(7), train.repartition(50)).collect()}
    assert once.keys() == many.keys()
    assert all(math.isclose(once[i], many[i], rel_tol=1e-9) for i in once)


def test_seating():
    """Tables lie between one and the customers, and their mean is that of the Chinese restaurant."""
    n = 4000
    key = np.arange(n, dtype=np.int64) * 7919
    for c, strength, d in ((2, 1.0, 0.5), (30, 3.0, 0.3), (1000, 5.0, 0.2), (5000, 4000.0, 0.5)):
        t = pitman_yor.tables(np.full(n, c), np.full(n, strength), d, key, 3)
        rng = np.random.default_rng(1)
        want = []
        for _ in range(400):
            m = 1
            for k in range(1, c):
                m += rng.random() < strength / (strength + k - d * m)
            want.append(m)
        assert t.min() >= 1 and t.max() <= c
        assert abs(t.mean() - np.mean(want)) < 5 * np.std(want) / 20 + 0.02 * np.mean(want)


def test_seating_weight():
    from math import lgamma, log

    for c, t, d in ((7, 3, 0.4), (1000, 20, 0.8), (1, 1, 0.5)):
        got = pitman_yor.seating_weight(np.array([c]), np.array([t]), d)[0]
        want = [lgamma(a / d + t) - lgamma(a / d) - lgamma(a + c) + lgamma(a) + t * log(d) for a in pitman_yor.GRID]
        assert np.allclose(got, want, atol=1e-6)


def test_pairs_go_in_blocks(spark, sf):
    """A Spark row holds many pairs, each pair is in one block with its whole count."""
    docs = documents(spark, sf)
    texts = pitman_yor._texts(docs, "doc_id", "text").repartition(5)
    want = Counter(x for r in docs.select("text").collect() for x in zip(["", *words(r.text)], words(r.text)))
    hashes = {w: pitman_yor._hash(w.encode("utf-8", "surrogatepass")) for w in {w for x in want for w in x}}
    top = sorted(Counter(w for (_, w), n in want.items() for _ in range(n)).values())[-100]
    count = Counter()
    for (_, w), n in want.items():
        count[hashes[w]] += n
    some = np.array([h for h, n in count.items() if n > top], np.int64)
    common = pitman_yor.Common(some, np.array([count[h] for h in some.tolist()], np.int64))
    blocks = pitman_yor._pairs(texts, spark.sparkContext.broadcast(common), 3).collect()
    assert len(blocks) < len(want) / 100
    got = Counter()
    for r in blocks:
        u, w, c = pitman_yor.unpacked(bytes(r.data), [np.int64] * 3)
        assert r.n == len(u) and r.twos == (c == 2).sum()
        assert {4 * (n > 1) + 2 * (a < 0) + (b < 0) for a, b, n in zip(u.tolist(), w.tolist(), c.tolist())} == {r.kind}
        assert set(pitman_yor._bucket(pitman_yor.named(u, w), 3).tolist()) == {r.bucket}
        for pair in zip(common.hashes(u).tolist(), common.hashes(w).tolist(), c.tolist()):
            assert pair[:2] not in got
            got[pair[:2]] = pair[2]
    assert got == {(hashes[a], hashes[b]): n for (a, b), n in want.items()}


def test_words_are_read_as_bytes():
    """Tokens and hashes of odd texts, and what reading takes: a few bytes for each of the text's, no object a word."""
    long = ["x" * n + "Y" for n in range(40)]
    texts = ["A b  C\x0b\x0cd\te\nf\r", None, "", " ", "ÄÖ zweite straße x", *long, "\x00 a\x00b \x1c\x85 " + "z" * 500, " end "]
    for own in (texts, [None], ["", ""], texts[::-1]):
        for kind in (pa.string(), pa.large_string()):
            h, begin = pitman_yor.read(pa.array(["cut", *own, "cut"], kind)[1:-1])
            each = [[pitman_yor._hash(w.encode()) for w in words(t)] for t in own]
            assert h.tolist() == [x for ws in each for x in ws]
            assert np.diff(begin).tolist() == [len(ws) for ws in each[:-1]] and begin[0] == 0
    text = pa.array([" ".join(f"word{i * k % 9973}" for i in range(700)) for k in range(2500)])
    tracemalloc.start()
    h, _ = pitman_yor.read(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(h) == 701 * 2500
    assert most < 3 * text.nbytes


def test_chains_are_seated_at_once():
    """Several columns of strengths give what each gives alone, and a cell's tables depend on no other cell."""
    rng = np.random.default_rng(3)
    c, key = np.minimum(rng.zipf(1.5, 3000), 10**6).astype(np.int64), rng.integers(0, 2**62, 3000)
    strength = rng.random((3000, 3)) * 3
    got = pitman_yor.seated(c, strength, 0.4, key, [5, 6, 9])
    assert got.shape == strength.shape and (got >= 1).all() and (got <= c[:, None]).all()
    for k, salt in enumerate((5, 6, 9)):
        assert (got[:, k] == pitman_yor.tables(c, strength[:, k], 0.4, key, salt)).all()
    some = rng.permutation(3000)[:100]
    assert (got[some] == pitman_yor.seated(c[some], strength[some], 0.4, key[some], [5, 6, 9])).all()


def test_blocks_keep_their_columns():
    rng = np.random.default_rng(4)
    for columns in ([np.zeros(5, np.int64)], [np.array([-7])], [rng.integers(-(2**63), 2**63 - 1, 900), rng.random(900) - 0.5, np.arange(900) + 2**40, -np.arange(900)]):
        back = pitman_yor.unpacked(pitman_yor.packed(columns), [c.dtype for c in columns])
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(columns, back, strict=True))


def test_buckets_follow_the_tokens(spark):
    """Blocks go from each bucket to each: many shuffle partitions must not make many buckets of few tokens."""
    train = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 211)
        assert pitman_yor.fit(train, words=3).buckets <= 12
        assert pitman_yor._buckets(train, 10**9) == -(-(10**9) // pitman_yor.BUCKET)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
