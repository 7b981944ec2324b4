import random
from collections import defaultdict

from gridtrack.llm import jaccard
from tests.llm.helpers import empty_docs, odd_docs


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(items):
    """items: (id, text) -> groups of row numbers."""
    sets = [shingle_set(t) for _, t in items]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)) and a and b:
                parent[root(i)] = root(j)
    groups = defaultdict(set)
    for i in range(len(sets)):
        groups[root(i)].add(items[i][0])
    return sorted(map(sorted, groups.values()))


def got(df, **kw):
    groups = defaultdict(set)
    for r in jaccard.near_duplicates(df, **kw).collect():
        groups[r.root].add(r.id)
    return sorted(map(sorted, groups.values()))


def edited(spark):
    """Texts with edited copies near 0.8, a large family, and texts that share boilerplate."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for n in [6, 9, 12, 30, 60, 120, 400, 1000]:
        for _ in range(3):
            base = [word() for _ in range(n)]
            texts.append(base)
            for _ in range(5):
                copy = base[:]
                for _ in range(rng.randrange(1, max(2, n // 30) + 1)):
                    copy[rng.randrange(n)] = word()
                texts.append(copy[: n - rng.randrange(max(1, n // 50) + 1)])
    family = [word() for _ in range(200)]
    texts += [[*family[:i], "cut", *family[i + 1 :]] for i in range(100)]
    notice = [word() for _ in range(40)]
    texts += [[*notice, *(word() for _ in range(rng.randrange(4, 40)))] for _ in range(150)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_edited_copies_are_all_found(spark):
    items = edited(spark)
    df = spark.createDataFrame(items, "doc_id long, text string")
    want = brute(items)
    assert max(map(len, want)) == 100 and len(want) < len(items) - 140
    assert got(df) == want
    assert got(df, hot=1) == want and got(df, hot=10**9) == want  # the order of hashes is free


def test_copies_that_are_not_quite_near_cost_no_row_a_pair(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    base, texts = [word() for _ in range(100)], []
    for _ in range(400):
        copy = base[:]
        for k in rng.sample(range(3, 97), rng.choice([1, 3, 4, 4])):
            copy[k] = word()
        texts.append(copy)
    items = [(i, " ".join(t)) for i, t in enumerate(texts + [[*t, "end"] for t in texts[::20]])]
    want, made, whole = brute(items), [], jaccard._pairs
    assert len(want) > 100 and max(map(len, want)) > 50

    def counted(*a):
        made.append((out := whole(*a)).count())
        return out

    monkeypatch.setattr(jaccard, "_pairs", counted)
    df = spark.createDataFrame(items, "doc_id long, text string")
    assert got(df) == want
    assert sum(made) < 10 * len(items)  # not a row a pair
    for name, few in (("DENSE", 0), ("BLOCK", 100), ("BLOCK_HASHES", 20_000)):  # more and smaller blocks: the same groups
        monkeypatch.setattr(jaccard, name, few)
    assert got(df) == want


def test_stage_keeps_one_of_edited_copies(spark, sf):
    import corpus_pipeline

    items = edited(spark)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in items], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_duplicates"](spark, df, sf).collect()]
    assert sorted(kept) == sorted(g[0] for g in brute(items))


def test_odd(spark):
    rows = [(r.doc_id, r.text) for r in odd_docs(spark).collect()]
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    assert got(spark.createDataFrame(numbered, "doc_id long, text string")) == brute(numbered)
    assert got(empty_docs(spark)) == []
    assert jaccard.keep_one(odd_docs(spark)).count() == len(brute(numbered))
