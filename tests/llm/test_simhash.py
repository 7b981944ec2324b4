import random
from collections import Counter, defaultdict

import xxhash

from gridtrack.llm import simhash
from gridtrack.llm.common import documents
from tests.llm.helpers import empty_docs, odd_docs


def brute_fp(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items):
    """items: (id, fp) -> Counter of (id, component)."""
    fps = sorted({f for _, f in items})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for d, f in items:
        if d is not None:
            least[root(f)].append(d)
    return Counter((d, f, min(least[root(f)], default=None)) for d, f in items)


def got(df):
    return Counter((r.id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect())


def test_documents(spark, sf):
    docs = documents(spark, sf)
    want = brute_components([(r.doc_id, brute_fp(r.text)) for r in docs.collect()])
    assert got(docs) == want


def test_odd(spark):
    docs = odd_docs(spark)
    assert got(docs) == brute_components([(r.doc_id, brute_fp(r.text)) for r in docs.collect()])
    assert got(empty_docs(spark)) == Counter()


def test_links_against_all_pairs(spark):
    rnd = random.Random(5)
    fps = set()
    for _ in range(40):
        centre = rnd.getrandbits(64)
        fps.add(centre)
        for _ in range(12):
            fps.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4))))
    # a dense ball: one key holds more than the pairwise limit
    centre = rnd.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(24)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    linked = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in linked)
    parent = {f: f for f in fps}

    def root(p, x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in linked:
        parent[root(parent, a)] = root(parent, b)
    brute = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 2:
                brute[root(brute, a)] = root(brute, b)
    groups = lambda p: {frozenset(f for f in fps if root(p, f) == r) for r in {root(p, f) for f in fps}}
    assert groups(parent) == groups(brute)
