import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from gridtrack.llm import suffix
from gridtrack.llm.common import documents
from tests.llm.helpers import empty_docs, odd_docs


def brute(rows, width):
    starts = defaultdict(int)
    for _, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - width + 1):
            starts[raw[i : i + width]] += 1
    out = Counter()
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - width + 1):
            if starts[raw[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[(d, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def got(docs, **how):
    return Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove(docs, **how).collect())


def test_suffix_array_and_prefixes():
    rnd = random.Random(1)
    for _ in range(200):
        n, k = rnd.randrange(150), rnd.choice([1, 2, 3, 10, 250])
        raw = bytes(rnd.randrange(k) for _ in range(n)) * rnd.choice([1, 1, 3])
        text = np.frombuffer(raw, np.uint8)
        sa = suffix.suffix_array(text)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        common = suffix.plcp(text, sa)
        for i, j in zip(sa[1:], sa[:-1], strict=True):
            m = 0
            while max(i, j) + m < len(raw) and raw[i + m] == raw[j + m]:
                m += 1
            assert common[i] == m


def test_runs_are_those_of_the_suffix_array_of_all_contexts(monkeypatch):
    rnd, asked, whole = random.Random(4), [], suffix.repeated_starts
    for _ in range(150):
        width, letters = rnd.choice([4, 7, 12]), rnd.choice(["ab", "abc", "abcdefghijkl"])
        base, contexts = [rnd.choice(letters) for _ in range(60)], {}
        for _ in range(rnd.randrange(12)):
            at = rnd.randrange(40)
            own = base[at : at + rnd.randrange(width, 30)]
            own[rnd.randrange(len(own))] = rnd.choice(letters)
            if len(own) >= width:
                contexts["".join(own).encode()] = rnd.choice([1, 1, 1, 2])
        raws, copies = list(contexts), list(contexts.values())
        want = [(i, int(r[0]), int(r[-1]) + width) for i, s in enumerate(whole(raws, width, copies)) for r in np.split(s, np.flatnonzero(np.diff(s) > 1) + 1) if len(s)] if raws else []
        assert sorted(suffix.repeated_runs([7] * len(raws), raws, width, copies)) == want
    # stretches that are equal, and windows that are alone, need no suffix array
    monkeypatch.setattr(suffix, "repeated_starts", lambda x, *a: asked.append(sum(map(len, x))) or whole(x, *a))
    text = lambda n: bytes(rnd.choice(b"abcdefgh") for _ in range(n))
    passage = text(60)
    contexts = [bytes([48 + i]) * 20 + passage + bytes([65 + i]) * 20 for i in range(9)]
    runs = list(suffix.repeated_runs([7] * 9, contexts, 40, [1] * 9))
    assert sorted(runs) == [(i, 20, 80) for i in range(9)] and not asked


def test_documents(spark, sf):
    docs = documents(spark, sf)
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()], suffix.WIDTH)


def planted(spark, seed=2):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(25), prose(6)
    rows = []
    for i in range(120):
        t = prose(rnd.randint(0, 60))
        if i % 3 == 0:
            t += f" {passage} " + prose(rnd.randint(0, 20))
        if i % 2 == 0:
            t = prose(3) + f" {line} " + t
        rows.append((i if i % 17 else None, t))
    rows += rows[:9] + [(1000 + i, rows[5][1]) for i in range(30)] + [(2000, "ab" * 400), (2001, "x" * 900), (2002, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_planted(spark):
    docs, rows = planted(spark)
    for width, gram, hot in ((100, 40, 512), (100, 40, 5), (64, 16, 3), (60, 60, 1)):
        assert got(docs, width=width, gram=gram, hot=hot, shard_bytes=8000) == brute(rows, width)


def test_hot_passage(spark):
    """A passage in very many texts with unlike surroundings is cut down to single windows."""
    rnd = random.Random(8)
    prose = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = prose(150)
    rows = [(i, prose(rnd.randint(0, 60)) + passage + prose(rnd.randint(0, 60))) for i in range(1500)] + [(9000 + i, passage[: 90 + i]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, width=100, gram=40, hot=8, shard_bytes=100_000) == brute(rows, 100)


def test_odd(spark):
    docs = odd_docs(spark)
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()], suffix.WIDTH)
    assert got(empty_docs(spark)) == Counter()


def test_context_columns_are_those_of_a_plain_loop(spark):
    raw = [bytes([97 + (i * i * 7 + i // 5) % 26]) for i in range(900)]
    rows = [(None, 1, b"".join(raw).decode()), (7, 2, b"".join(raw[::-1]).decode()), (8, 3, "short"), (9, 4, "é" * 300)]
    want = []
    for i, tk, text in rows:
        own = text.encode()
        first, last, _, key = suffix.chosen(np.frombuffer(own, np.uint8), 400, 160)
        want += [(i, tk, f, n, k, suffix._hash(own[f : f + n])) for f, n, k in zip(first.tolist(), (last - first + 400).tolist(), key.tolist(), strict=True)]
    got = suffix.spots(spark.createDataFrame(rows, "id long, tk long, text string").coalesce(1), 400, 160).collect()
    assert [tuple(r) for r in got] == want and len({r[0] for r in want}) == 3
    some = [b"", b"a", b"passage"]
    assert suffix._hashes([suffix.xxhash.xxh64_digest(x) for x in some]).tolist() == [suffix._hash(x) for x in some]
