"""Hand-made shapes: components, rings, splitting, growth."""

from gridtrack.operators import association, features, field_ops, rings
from gridtrack.sources import fields


def cells(spark, *rows, ts=1, v=1.0):
    return spark.createDataFrame([(ts, x, len(rows) - 1 - y, v) for y, r in enumerate(rows) for x, c in enumerate(r) if c != "."], "ts long, x int, y int, v double")


def sizes(df):
    return sorted(r["count"] for r in df.groupBy("ts", "fid").count().collect())


def test_connectivity(spark):
    p = cells(spark, "##..", "..##", "#...", "#..#")
    assert sizes(features.label(p, 4)) == [1, 2, 2, 2]
    assert sizes(features.label(p, 8)) == [1, 2, 4]
    assert sizes(features.label_graph(p, 8)) == [1, 2, 4]
    assert features.label(p.limit(0)).count() == 0


def test_long_snake(spark):
    rows = [("#" * 40 if y % 4 == 0 else ("." * 39 + "#" if y % 4 == 1 else "#" * 40 if y % 4 == 2 else "#" + "." * 39)) for y in range(41)]
    assert len(sizes(features.label(cells(spark, *rows), 4))) == 1


def test_rings_with_holes(spark):
    p = features.label(cells(spark, "#####", "#...#", "#.#.#", "#...#", "#####"), 4)
    found = rings.rings(p, 4).collect()
    kinds = sorted({(r.fid, r.kind, r.ring_no) for r in found}, key=str)
    assert [k for _, k, _ in kinds].count("shell") == 2
    assert [k for _, k, _ in kinds].count("hole") == 1
    for fid, kind, no in kinds:
        path = [(r.x, r.y) for r in sorted(found, key=lambda r: r.seq) if (r.fid, r.kind, r.ring_no) == (fid, kind, no)]
        assert len(path) == 1 or path[0] == path[-1]
        assert all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(path, path[1:], strict=False))


def test_touching_corner_by_connectivity():
    px = {(0, 0), (1, 1)}
    assert len(rings.trace(px, 8)) == 1
    assert len(rings.trace(px, 4)) == 2
    assert [k for k, _ in rings.trace({(0, 0)}, 8)] == ["shell"]


def test_split_keeps_cells(spark):
    df = spark.createDataFrame([(1, x, 0, v) for x, v in enumerate([3.0, 1.0, 1.0, 1.0, 3.0, 3.0])] + [(1, 9, 9, 1.0)], "ts long, x int, y int, v double")
    out = features.split(features.label(df, 8), 2.0)
    assert sizes(out) == [1, 2, 4] or sizes(out) == [1, 3, 3]
    assert out.count() == 7


def test_grow_ties(spark):
    p = features.label(cells(spark, "#...#"), 8)
    grown = features.grow(p, 5, 1, 2)
    assert grown.count() == 5
    assert {r.fid for r in grown.where("x = 2").collect()} == {0}
    assert grown.where("v IS NULL").count() == 3


def test_cluster_filter_and_distance(spark):
    p = cells(spark, "##..#")
    assert features.cluster_filter(p.select("ts", "x", "y"), 2).count() == 2
    d = {(r.x, r.y): r.dist for r in features.distance_to_features(p.where("x = 4"), 5, 2).collect()}
    assert d[(4, 0)] == 0 and d[(0, 0)] == 4 and abs(d[(1, 1)] - 10**0.5) < 1e-12


def test_clutter_names(spark):
    p = features.label(cells(spark, "####.", "####.", "....#", "#...."), 4)
    names = {r.n: r.category for r in association.categories(p, 2, 8).where("n = 8").collect()}
    assert names == {8: "large"}
    ones = sorted(r.category for r in association.categories(p, 2, 8).where("n = 1").collect())
    assert ones == ["clutter0", "small"]


def test_background_and_io(spark, tmp_path):
    p = cells(spark, "#.", ".#")
    dense = fields.with_background(p, 2, 2)
    assert dense.count() == 4 and dense.agg({"v": "sum"}).first()[0] == 2.0
    fields.write(dense, str(tmp_path / "f"), by="ts")
    assert fields.read(spark, str(tmp_path / "f"), ts_min=1).count() == 4
    assert fields.read(spark, str(tmp_path / "f"), ts_min=2).count() == 0


def test_dilate_undoes_erode_of_a_box(spark):
    box = cells(spark, ".....", ".###.", ".###.", ".###.", ".....").select("ts", "x", "y")
    core = field_ops.erode(box)
    assert core.count() == 1
    assert sorted(map(tuple, field_ops.dilate(core, 5, 5).collect())) == sorted(map(tuple, box.collect()))
