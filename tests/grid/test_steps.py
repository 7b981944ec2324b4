"""Front surgery and merging in tracks work on a step a task: the same as the operators in turn, without joins through the driver."""

import random

from pyspark.sql import functions as F

from gridtrack import scratch
from gridtrack.operators import association, features, graphs, tracking

FIELD = "ts long, x int, y int, v double"


def field(spark, steps, seed, share=0.45, nx=12):
    rng = random.Random(seed)
    return spark.createDataFrame([(t, x, y, rng.random()) for t in range(1, steps + 1) for x in range(nx) for y in range(nx) if rng.random() < share], FIELD)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def in_turn(cells, medium, large, big):
    first = association.merge_in_categories(cells, association.categories(cells, medium, large))
    first = scratch.table(first.withColumn("category", F.when(F.col("category") == "small", "medium").otherwise(F.col("category"))), "first")
    kinds = first.select("ts", "fid", "category").distinct()
    hit = features.neighbours(first).join(kinds.toDF("ts", "nfid", "other"), ["ts", "nfid"]).where("other = 'clutter1'").select("ts", "fid", F.lit(1).alias("hit")).distinct()
    name = F.expr("CASE WHEN category = 'medium' AND hit IS NOT NULL THEN 'clutter1' WHEN category = 'medium' THEN 'large' ELSE category END")
    merged = association.merge_in_categories(first.drop("category"), kinds.join(hit, ["ts", "fid"], "left").select("ts", "fid", name.alias("category")))
    sizes = merged.groupBy("ts", "fid").agg(F.count("*").alias("n"))
    final = F.expr(f"CASE WHEN category = 'clutter1' AND n >= {big} THEN 'clutter0' ELSE category END")
    return merged.join(sizes, ["ts", "fid"]).select("ts", "x", "y", "v", "fid", final.alias("category"))


def test_surgery_is_one_task_a_step(spark):
    cells = scratch.table(features.label(field(spark, 6, 3), 4), "cells")
    got = association.surgery(cells, 4, 8, 12)
    assert "Join" not in plan(got)
    got = sorted(map(tuple, got.collect()))
    assert got == sorted(map(tuple, in_turn(cells, 4, 8, 12).collect()))
    assert {r[5] for r in got} == {"clutter0", "clutter1", "large"}
    assert association.surgery(cells.limit(0), 4, 8, 12).count() == 0


def test_merging_in_tracks_sends_no_table_through_the_driver(spark):
    f = field(spark, 5, 7)
    cells = scratch.table(features.label(f, 4), "cells")
    steps = scratch.table(tracking.steps_of(f), "steps")
    links = scratch.table(tracking.edges(tracking.assign(tracking.candidates(tracking.overlaps(cells, steps)), 0.1)), "links")
    own = scratch.table(tracking.tracks(tracking.vertices(cells, steps, links), links), "vertices")
    whole, edges = graphs.merge_in_tracks(cells, steps, own, links)
    assert "BroadcastHashJoin" not in plan(edges)
    # by brute force
    seq = {r.ts: r.seq for r in steps.collect()}
    track = {(r.seq, r.fid): r.track for r in own.collect()}
    rows = cells.collect()
    at = {(r.ts, r.x, r.y): r.fid for r in rows}
    name = {(seq[r.ts], r.fid): r.fid for r in rows}
    changed = True
    while changed:
        changed = False
        for (t, x, y), fid in at.items():
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    other = at.get((t, x + dx, y + dy))
                    a, b = (seq[t], fid), (seq[t], other)
                    if other is not None and track[a] == track[b] and name[b] < name[a]:
                        name[a], changed = name[b], True
    assert sorted((r.ts, r.x, r.y, r.fid) for r in whole.collect()) == sorted((r.ts, r.x, r.y, name[seq[r.ts], r.fid]) for r in rows)
    assert any(k[1] != v for k, v in name.items())
    own_cells = {}
    for (t, x, y), fid in at.items():
        own_cells.setdefault((seq[t], name[seq[t], fid]), set()).add((x, y))
    want = {(r.seq, name[r.seq, r.src], name[r.seq + 1, r.dst]) for r in links.collect()}
    want = {(s, a, b, len(own_cells[s, a] & own_cells[s + 1, b])) for s, a, b in want}
    assert {(r.seq, r.src, r.dst, r.n_overlap) for r in edges.collect()} == want
