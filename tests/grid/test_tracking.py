"""Moving rectangles: linear tracks, splits, merges, empty steps."""

from gridtrack.operators import features, tracking
from gridtrack.streaming.tracker import label_step, link


def box(ts, x0, y0, w, h):
    return [(ts, x, y, 1.0) for x in range(x0, x0 + w) for y in range(y0, y0 + h)]


def tracked(spark, rows, steps, **how):
    p = spark.createDataFrame(rows, "ts long, x int, y int, v double")
    s = spark.createDataFrame([(t, i + 1) for i, t in enumerate(steps)], "ts long, seq long")
    own, links = tracking.track(features.label(p, 8), s, **how)
    return own.orderBy("seq", "fid").collect(), links.collect()


def test_linear(spark):
    own, links = tracked(spark, [c for t in range(5) for c in box(t, t, 0, 4, 4)], range(5))
    assert [v.type for v in own] == ["start", "continuation", "continuation", "continuation", "stop"]
    assert len({v.track for v in own}) == 1 and len(links) == 4
    assert all(abs(e.p_size - 1) < 1e-12 and abs(e.p_overlap - 0.75) < 1e-12 for e in links)


def test_empty_step_ends_tracks(spark):
    own, links = tracked(spark, box(0, 0, 0, 3, 3) + box(2, 0, 0, 3, 3), range(3))
    assert not links and [v.type for v in own] == ["start/lysis", "genesis/stop"]


def test_split_and_merge(spark):
    rows = box(0, 0, 0, 3, 9) + box(1, 0, 0, 3, 4) + box(1, 0, 5, 3, 4) + box(2, 0, 0, 3, 9)
    own, links = tracked(spark, rows, range(3))
    assert [v.type for v in own] == ["start/splitting", "continuation", "continuation", "merging/stop"]
    assert len(links) == 4 and len({v.track for v in own}) == 1
    assert all(abs(e.p_share - 0.5) < 1e-12 for e in links)


def test_max_children(spark):
    rows = box(0, 0, 0, 3, 9) + box(1, 0, 0, 3, 4) + box(1, 0, 5, 3, 4)
    own, links = tracked(spark, rows, range(2), max_children=1)
    assert len(links) == 1


def test_streaming_rules_equal_batch(spark):
    import random

    rnd = random.Random(1)
    rows = [(t, x, y, 1.0) for t in range(12) for x in range(14) for y in range(14) if rnd.random() < 0.45]
    _, links = tracked(spark, rows, range(12))
    want = sorted((e.seq, e.src, e.dst, round(e.p_tot, 9)) for e in links)
    import numpy as np

    steps = [label_step(np.array([r[1] for r in rows if r[0] == t]), np.array([r[2] for r in rows if r[0] == t]), 8) for t in range(12)]
    got = sorted((t + 1, e[0], e[1], round(e[4], 9)) for t in range(11) for e in link(steps[t], steps[t + 1], 0.5, 4, 0.0))
    assert got == want


def test_branch_removal():
    from gridtrack.operators.branches import prune

    # main 1-2-3-4-5-6-7; a side branch from 2 that ends at once, one from 1 that lives on
    main = [(i, i + 1, 0.9, 5) for i in range(1, 7)]
    short, long_ = [(2, 20, 0.3, 2)], [(1, 10, 0.4, 2), *[(i, i + 1, 0.9, 2) for i in range(10, 16)]]
    edges = main + short + long_
    cut = set(range(len(edges))) - set(prune(edges, 3))
    assert [edges[i] for i in cut] == [(1, 10, 0.4, 2)]
    assert len(prune(edges, -1)) == len(edges)
    # a branch that comes back within n steps stays
    loop = main + [(2, 30, 0.2, 1), (30, 4, 0.2, 1)]
    assert len(prune(loop, 3)) == len(loop)


def test_programs(spark, tmp_path):
    from gridtrack.plans import cli

    rows = [c for t in range(4) for c in box(t, t, 0, 4, 4)]
    spark.createDataFrame(rows, "ts long, x int, y int, v double").write.parquet(str(tmp_path / "field"))
    out = lambda n: str(tmp_path / n)
    cli.main(["identify", "--field", out("field"), "--out", out("f"), "--lower", "0.5"], spark)
    cli.main(["track", "--features", out("f"), "--out", out("t")], spark)
    cli.main(["group", "--tracks", out("t"), "--out", out("g"), "--least", "duration=3"], spark)
    cli.main(["project", "--tracks", out("t"), "--out", out("p")], spark)
    assert spark.read.parquet(out("g")).first()["grp"] == 2
    assert spark.read.parquet(out("p")).count() == 64
    assert spark.read.json(out("t") + "/stats-json").first()["duration"] == 3
