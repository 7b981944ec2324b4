import zlib
from collections import Counter

from gridtrack.llm import sharding
from gridtrack.llm.common import documents
from tests.llm.helpers import empty_docs, odd_docs


def brute(rows, shards):
    key = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 16)
    rows = sorted(rows, key=key)
    return Counter((r[0], key(r)[3], key(r)[2], *sharding.place(i, len(rows), shards)) for i, r in enumerate(rows))


def got(df, shards):
    return Counter((r.doc_id, r["size"], r.text_crc32, r["shard"], r.slot) for r in sharding.shard(df, shards).collect())


def test_place_is_a_permutation():
    for n in (1, 2, 3, 5, 17, 1000, 4097):
        places = {sharding.place(i, n, 7) for i in range(n)}
        sizes = Counter(s for s, _ in places)
        assert len(places) == n
        assert max(sizes.values()) - (min(sizes.values()) if len(sizes) == 7 else 0) <= 1
        assert all({s for k, s in places if k == shard} == set(range(size)) for shard, size in sizes.items())
    assert [sharding.place(i, 1000, 40, seed=1) for i in range(20)] != [sharding.place(i, 1000, 40, seed=2) for i in range(20)]


def test_documents(spark, sf):
    docs = documents(spark, sf)
    assert got(docs, 40) == brute([(r.doc_id, r.text) for r in docs.collect()], 40)


def test_odd(spark):
    docs = odd_docs(spark)
    assert got(docs, 3) == brute([(r.doc_id, r.text) for r in docs.collect()], 3)
    assert got(empty_docs(spark), 3) == Counter()


def test_hot_ids(spark):
    rows = [(7, f"t{i % 50}") for i in range(400)] + [(i, "x") for i in range(600)] + [(None, f"n{i}") for i in range(100)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 40) == brute(rows, 40)


def test_cycle_walk_in_spark(spark):
    for n in (1, 2, 3, 7, 12, 31):
        df = spark.range(n).selectExpr("id doc_id", "'a' text")
        assert got(df, 5) == brute([(i, "a") for i in range(n)], 5)
