import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtrack.llm import toxicity
from gridtrack.llm.common import documents, read
from gridtrack.llm.queries import HELD_OUT, learned_labels
from tests.llm.helpers import empty_docs, odd_docs


def test_nearest_is_exact():
    rng = np.random.default_rng(3)
    vectors = [(np.sort(rng.choice(40, m, replace=False)), rng.integers(1, 4, m)) for m in rng.integers(0, 9, 500)]
    vectors += vectors[:30]
    index = toxicity.Index(vectors, rng.integers(0, 2, len(vectors)), 40)
    dense = np.zeros((len(vectors), 40))
    for i, (t, n) in enumerate(vectors):
        dense[i, t] = index.unit(t, n)
    for t, n in vectors[::7]:
        cos = dense[:, t] @ index.unit(t, n)
        want = [i for i in np.lexsort((np.arange(len(cos)), -np.round(cos, 6))) if cos[i] > 0][:10]
        ids, found = index.nearest(t, n, 10)
        assert np.allclose(found, cos[want], atol=2e-6)
        assert sum(a != b for a, b in zip(ids.tolist(), want)) <= 2  # where roundings part a tie


def test_monotone():
    cuts, rates = toxicity.monotone(np.array([0.1, 0.2, 0.2, 0.5, 0.9]), np.array([0, 1, 0, 0, 1]))
    assert (np.diff(rates) > 0).all() and (np.diff(cuts) > 0).all()


def test_held_out(spark):
    where = "/root/testdata/sf0.1"
    docs, labels = documents(spark, where).where("doc_id < 5000"), read(spark, where, "labels").where("doc_id < 5000")
    model = toxicity.fit(docs, learned_labels(spark, where).where("doc_id < 5000"))
    rows = toxicity.apply(docs, model).join(labels.where(HELD_OUT), F.col("id") == F.col("doc_id")).collect()
    hit = sum(r.score >= 0.3 and r.toxic == 1 for r in rows)
    assert hit >= 0.8 * sum(r.toxic == 1 for r in rows)
    assert hit >= 0.75 * sum(r.score >= 0.3 for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("where, least, sure", [("sf0.001", 0.5, 0.3), ("sf0.01", 0.7, 0.6)])
def test_small_tables(spark, where, least, sure):
    """Held-out toxic texts are found with 64 examples, 9 of them toxic, and with 305."""
    where = f"/root/testdata/{where}"
    docs, labels = documents(spark, where), read(spark, where, "labels")
    rows = toxicity.apply(docs, toxicity.fit(docs, learned_labels(spark, where))).join(labels.where(HELD_OUT), F.col("id") == F.col("doc_id")).collect()
    hit = sum(r.score >= 0.3 and r.toxic == 1 for r in rows)
    assert hit >= least * sum(r.toxic == 1 for r in rows)
    assert hit >= sure * sum(r.score >= 0.3 for r in rows)


def test_scores_are_those_of_dense_cosine(spark, sf):
    """The whole way: terms, weights, neighbours, votes and the calibrated score, by dense vectors."""
    docs = documents(spark, sf)
    labels = {r.doc_id: r.toxic for r in learned_labels(spark, sf).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}

    def counts(text):
        out = {}
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            for t in (w, w[:4] + " "):
                out[t] = out.get(t, 0) + 1
        return out

    ids = sorted((i for i in labels if i in texts), key=lambda i: (-labels[i], i))
    own = {i: counts(t) for i, t in texts.items()}
    terms = sorted({t for i in ids for t in own[i]})
    n1, n = sum(labels[i] for i in ids), len(ids)
    weigh = {}
    for t in terms:
        a, b = sum(t in own[i] for i in ids if labels[i]), sum(t in own[i] for i in ids if not labels[i])
        weigh[t] = (math.log((1 + n) / (1 + a + b)) + 1) * math.log2(2 + a / max(b, 1) * (n - n1) / n1) ** 2

    def unit(c):
        v = np.array([(1 + math.log(c[t])) * weigh[t] if t in c else 0.0 for t in terms])
        return v / (np.linalg.norm(v) or 1)

    dense = np.stack([unit(own[i]) for i in ids])

    def vote(v, skip=None):
        cos = dense @ v
        if skip is not None:
            cos[skip] = 0
        near = [j for j in np.lexsort((np.arange(n), -np.round(cos, 6))) if cos[j] > 1e-9][:25]
        if not near:
            return None, []
        w = [1 / (1.05 - min(cos[j], 1)) for j in near]
        return sum(x * labels[ids[j]] for x, j in zip(w, near)) / sum(w), [ids[j] for j in near]

    toxic = np.array([labels[i] for i in ids])
    votes = [vote(dense[j], j)[0] for j in range(n)]
    assert None not in votes
    cuts, rates = toxicity.monotone(np.array(votes), toxic)
    got = {r.id: (r.score, r.evidence) for r in toxicity.apply(docs, toxicity.fit(docs, learned_labels(spark, sf))).collect()}
    for i, c in own.items():
        v, near = vote(unit(c))
        if v is not None:
            assert len(set(got[i][1]) ^ set(near)) <= 4, i
            assert math.isclose(got[i][0], rates[max(int(np.searchsorted(cuts, v + 1e-6, "right")) - 1, 0)], abs_tol=0.1), i


def test_odd(spark, sf):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (5, None), (5, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.apply(docs, model).count() == docs.count()
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.apply(docs, none).collect()} <= {0.0, 0.5}
    assert toxicity.apply(empty_docs(spark), model).count() == 0
    assert toxicity.below(docs, model, 2.0).count() == docs.count()


def test_a_text_is_weighed_once(monkeypatch):
    rng = np.random.default_rng(8)
    own = [(np.unique(rng.integers(0, 60, 12)), None) for _ in range(300)]
    own = [(t, rng.integers(1, 4, len(t))) for t, _ in own]
    toxic = (np.arange(300) < 90).astype(np.int64)
    model = toxicity.Model(np.arange(60), toxicity.Index(own, toxic, 60), list(range(300)), 10)
    model.calibrate(own, toxic)
    want = [model._score(c, model.index.frequent([c])[0], model.index.unit(*c)) for c in own[:70]]
    calls, unit = [], toxicity.Index.unit
    monkeypatch.setattr(toxicity.Index, "unit", lambda self, t, n: calls.append(1) or unit(self, t, n))
    assert [(round(p, 9), len(e)) for p, e in model.scores(own[:70])] == [(round(p, 9), len(e)) for p, e in want]
    assert len(calls) == 70


def test_words_and_blocks_at_once(monkeypatch):
    """Latin-1 words are found without the pattern, as it finds them; bounds that lie close send all blocks at once."""
    probes = ["".join(map(chr, range(0x3000))), "İstanbul ²x ¼ µm\x85a\xa0b\x1cc_d", "", *("a" + chr(i) + "B" for i in range(0x300))]
    assert all(toxicity.words_of(t) == toxicity.WORD.findall(t.lower()) for t in probes)
    rng = np.random.default_rng(5)
    vectors = [(np.sort(rng.choice(400, 30, replace=False)), rng.integers(1, 5, 30)) for _ in range(3 * toxicity.BLOCK)]
    index = toxicity.Index(vectors, np.zeros(len(vectors), np.int64), 400)
    dense = np.zeros((len(vectors), 400))
    for i, (t, n) in enumerate(vectors):
        dense[i, t] = index.unit(t, n)
    calls, ranges = [], toxicity._ranges
    monkeypatch.setattr(toxicity, "_ranges", lambda *x: calls.append(1) or ranges(*x))
    for _ in range(20):  # of no example: the bounds lie close
        t, n = np.sort(rng.choice(400, 30, replace=False)), rng.integers(1, 5, 30)
        q = np.zeros(400)
        q[t] = index.unit(t, n)
        cos = dense @ q
        ids, found = index.nearest(t, n, 10)
        assert np.allclose(found, cos[ids], atol=1e-5) and np.allclose(found, np.sort(cos)[::-1][:10], atol=1e-5)
    assert len(calls) == 2 * 20
    monkeypatch.setattr(toxicity, "WORD", None)
    assert toxicity.words_of("Être à l'heure") == ["être", "à", "l", "heure"]
