"""Further registered queries: graphs, measures, geometry, depressions, files."""

from __future__ import annotations



from pyspark.sql import functions as F

from gridtrack import scratch
from gridtrack.operators import association, contours, features, field_ops, geometry, graphs, periodic, tracking
from gridtrack.plans import queries as q
from gridtrack.plans.queries import EMBED, HIGH, LAB8, LOW, NX, NY, SETS_SQL, STATS, TRACK, comps, query, rounded, rounded_scaled
from gridtrack.sources import fields, files

# ------------------------------------------------------------------ track graphs


def _graph(spark, d):
    cells, steps, links = q._links(spark, d)
    own = scratch.table(tracking.tracks(tracking.vertices(cells, steps, links), links), "vertices").select("seq", "fid", "n", "track")
    return cells, steps, own, links


def rescored(src: str, sizes: str, out: str) -> str:
    """CTEs that give the edges of ``src`` (seq, src, dst, n_overlap) their probabilities anew."""
    return f"""{out}_a AS (SELECT e.seq, e.src, e.dst, e.n_overlap, a.n, b.n AS nn, count(*) OVER o AS n_out, count(*) OVER i AS n_in, sum(b.n) OVER o AS nn_all, sum(e.n_overlap) OVER o AS o_out, sum(a.n) OVER i AS n_all, sum(e.n_overlap) OVER i AS o_in
 FROM {src} e JOIN {sizes} a ON a.seq = e.seq AND a.fid = e.src JOIN {sizes} b ON b.seq = e.seq + 1 AND b.fid = e.dst WINDOW o AS (PARTITION BY e.seq, e.src), i AS (PARTITION BY e.seq, e.dst)),
{out}_b AS (SELECT *, CAST(CASE WHEN n_out > 1 THEN n WHEN n_in > 1 THEN nn ELSE n END AS DOUBLE) AS p, CAST(CASE WHEN n_out > 1 THEN nn_all WHEN n_in > 1 THEN n_all ELSE nn END AS DOUBLE) AS c, CASE WHEN n_out > 1 THEN o_out WHEN n_in > 1 THEN o_in ELSE n_overlap END AS s,
 0.5 * (CAST(least(n, nn) AS DOUBLE) / greatest(n, nn)) + 0.5 * (2.0 * n_overlap / (n + nn)) AS alone FROM {out}_a),
{out} AS (SELECT seq, src, dst, n_overlap, CASE WHEN n_out > 1 THEN alone / sum(alone) OVER (PARTITION BY seq, src) WHEN n_in > 1 THEN alone / sum(alone) OVER (PARTITION BY seq, dst) ELSE 1.0 END AS p_share, 0.5 * least(p, c) / greatest(p, c) + 0.5 * (2.0 * s / (p + c)) AS p_tot, least(p, c) / greatest(p, c) AS p_size, 2.0 * s / (p + c) AS p_overlap FROM {out}_b)"""


EDGE_OUT = "seq, src, dst, n_overlap, round(CAST(p_share AS DOUBLE), 5) AS p_share, round(CAST(p_tot AS DOUBLE), 5) AS p_tot, round(CAST(p_size AS DOUBLE), 5) AS p_size, round(CAST(p_overlap AS DOUBLE), 5) AS p_overlap"


@query(f"{TRACK}, {rescored('ed', 'sz', 'r0')} SELECT {EDGE_OUT} FROM r0")
def track_edges_rescored(spark, d):
    _, _, own, links = _graph(spark, d)
    return rounded(graphs.rescore(links, own), 5)


def _weak(rounds: int, least: float) -> str:
    out = [rescored("ed", "sz", "r0")]
    for i in range(rounds):
        out += [f"k{i} AS (SELECT * FROM r{i} WHERE p_tot >= {least})", rescored(f"k{i}", "sz", f"r{i + 1}")]
    return f"{TRACK}, {', '.join(out)} SELECT {EDGE_OUT} FROM r{rounds}"


@query(_weak(4, 0.4))
def track_weak_edges(spark, d):
    """Edges of at least 0.4, scored anew until all are; four rounds are enough on these tables."""
    _, _, own, links = _graph(spark, d)
    return rounded(graphs.remove_weak(links, own, 0.4), 5)


TRACK4 = TRACK.replace(LAB8, comps("c", f"v >= {HIGH}", 4))


@query(f"""{TRACK4}, nb AS (SELECT DISTINCT a.seq, a.fid, b.fid AS nfid FROM u a JOIN u b ON a.seq = b.seq AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.fid <> b.fid JOIN own oa ON oa.seq = a.seq AND oa.fid = a.fid JOIN own ob ON ob.seq = b.seq AND ob.fid = b.fid WHERE oa.track = ob.track),
mg AS (SELECT seq, fid, fid AS lab FROM sz UNION SELECT nb.seq, nb.nfid, mg.lab FROM mg JOIN nb ON nb.seq = mg.seq AND nb.fid = mg.fid WHERE nb.nfid > mg.lab),
rt AS (SELECT seq, fid, min(lab) AS root FROM mg GROUP BY ALL), uu AS (SELECT u.seq, u.x, u.y, rt.root AS fid FROM u JOIN rt ON rt.seq = u.seq AND rt.fid = u.fid),
zz AS (SELECT seq, fid, count(*) AS n FROM uu GROUP BY ALL), me AS (SELECT DISTINCT ed.seq, a.root AS src, b.root AS dst FROM ed JOIN rt a ON a.seq = ed.seq AND a.fid = ed.src JOIN rt b ON b.seq = ed.seq + 1 AND b.fid = ed.dst),
mo AS (SELECT me.seq, me.src, me.dst, count(*) AS n_overlap FROM me JOIN uu a ON a.seq = me.seq AND a.fid = me.src JOIN uu b ON b.seq = me.seq + 1 AND b.fid = me.dst AND a.x = b.x AND a.y = b.y GROUP BY ALL),
{rescored('mo', 'zz', 'r0')} SELECT {EDGE_OUT} FROM r0""")
def track_merged_features(spark, d):
    """Features of four-connected labelling that touch in a corner, merged inside their tracks."""
    cells = scratch.table(q.embed_features(spark, d, HIGH, 4), "cells")
    steps = tracking.steps_of(fields.embeddings(spark, d))
    found = scratch.table(tracking.candidates(tracking.overlaps(cells, steps)), "candidates")
    links = scratch.table(tracking.edges(tracking.assign(found, 0.1)), "links")
    own = scratch.table(tracking.tracks(tracking.vertices(cells, steps, links), links), "vertices")
    return rounded(graphs.merge_in_tracks(cells, steps, own, links)[1], 5)


@query(f"""{TRACK}, tt AS (SELECT track, min(seq) AS first, max(seq) AS last FROM own GROUP BY track), lo AS (SELECT * FROM ed WHERE seq = 100),
en AS (SELECT seq, src AS fid FROM lo UNION ALL SELECT seq + 1, dst FROM lo), k AS (SELECT seq, fid, count(*) AS k FROM en GROUP BY ALL)
SELECT own.track, CAST(own.seq > 100 AS INTEGER) AS part, count(*) AS n_features, CAST(coalesce(sum(k.k), 0) AS BIGINT) AS n_missing, coalesce(sum(k.k), 0) = 0 AS complete FROM own LEFT JOIN k ON k.seq = own.seq AND k.fid = own.fid GROUP BY ALL""")
def track_parts(spark, d):
    _, _, own, links = _graph(spark, d)
    parts, stay, lost = graphs.cut_off(own, links, 100)
    return graphs.completeness(parts, stay, lost)


@query(f"{TRACK} SELECT seq, fid, n, track FROM own")
def track_parts_merged(spark, d):
    """Cut and joined again: nothing is lost."""
    _, _, own, links = _graph(spark, d)
    return graphs.merge_partial(*graphs.cut_off(own, links, 100))[0]


@query(f"{TRACK}, h AS (SELECT own.*, own.seq = (SELECT max(seq) FROM own) AS active FROM own ANTI JOIN ed ON ed.seq = own.seq AND ed.src = own.fid) SELECT track, min(own.seq) AS seq_start, NOT bool_or(h.active) AS finished FROM own JOIN h USING (track) GROUP BY track")
def track_finished(spark, d):
    _, _, own, links = _graph(spark, d)
    return graphs.finished(own, links)


@query(f"{TRACK} SELECT seq, src, dst, n_overlap FROM ed WHERE seq BETWEEN 50 AND 149")
def track_window(spark, d):
    _, _, own, links = _graph(spark, d)
    return graphs.window(own, links, 50, 150)[1].select("seq", "src", "dst", "n_overlap")


@query(f"{TRACK}, k AS (SELECT track FROM own GROUP BY track ORDER BY count(*) DESC, track LIMIT 20 OFFSET 2) SELECT seq, fid, n, track FROM own SEMI JOIN k ON k.track = own.track")
def track_biggest(spark, d):
    """The feature is a limit: the 20 biggest tracks after the first two."""
    _, _, own, _ = _graph(spark, d)
    return graphs.biggest(own, 20, 2)


@query(f"{TRACK}, r AS (SELECT track, min(seq) AS a, max(seq) AS b FROM own GROUP BY track) SELECT track, a < 50 OR b > 150 AS strict, b < 50 OR a > 150 AS liberal FROM r")
def track_outside_range(spark, d):
    _, _, own, _ = _graph(spark, d)
    r = own.groupBy("track").agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    return r.select("track", graphs.outside(F.col("a"), F.col("b"), 50, 150, True).alias("strict"), graphs.outside(F.col("a"), F.col("b"), 50, 150, False).alias("liberal"))


SEG = """dg AS (SELECT own.*, (SELECT count(*) FROM ed WHERE ed.seq + 1 = own.seq AND ed.dst = own.fid) AS n_in, (SELECT count(*) FROM ed WHERE ed.seq = own.seq AND ed.src = own.fid) AS n_out FROM own),
pe_ AS (SELECT ed.seq, ed.src, ed.dst FROM ed JOIN dg a ON a.seq = ed.seq AND a.fid = ed.src AND a.n_out = 1 JOIN dg b ON b.seq = ed.seq + 1 AND b.fid = ed.dst AND b.n_in = 1),
sg0 AS (SELECT seq * 1099511627776 + fid AS id, seq * 1099511627776 + fid AS lab FROM own UNION SELECT (e.seq + 1) * 1099511627776 + e.dst, s.lab FROM sg0 s JOIN pe_ e ON e.seq * 1099511627776 + e.src = s.id),
sg AS (SELECT dg.*, m.lab AS segment FROM dg JOIN (SELECT id, min(lab) AS lab FROM sg0 GROUP BY id) m ON m.id = dg.seq * 1099511627776 + dg.fid)"""


@query(f"{TRACK}, {SEG} SELECT seq, fid, segment FROM sg")
def track_segments(spark, d):
    _, _, own, links = _graph(spark, d)
    return graphs.segments(own, links).select("seq", "fid", "segment")


@query(f"""{TRACK}, {SEG}, se AS (SELECT segment, min(seq) AS first, max(seq) AS last, sum(n) AS size, arg_min(n_in, seq) AS n_in, arg_max(n_out, seq) AS n_out, arg_min(fid, seq) AS head, arg_max(fid, seq) AS tail, max(seq) - min(seq) + 1 AS length FROM sg GROUP BY segment),
sp AS (SELECT se.segment, ed.seq * 1099511627776 + ed.src AS spot, length, size, se.n_in = 1 AND se.n_out = 0 AND length <= 2 AS short FROM ed JOIN dg ON dg.seq = ed.seq AND dg.fid = ed.src AND dg.n_out > 1 JOIN se ON se.first = ed.seq + 1 AND se.head = ed.dst),
mp AS (SELECT se.segment, (ed.seq + 1) * 1099511627776 + ed.dst AS spot, length, size, se.n_out = 1 AND se.n_in = 0 AND length <= 2 AS short FROM ed JOIN dg ON dg.seq = ed.seq + 1 AND dg.fid = ed.dst AND dg.n_in > 1 JOIN se ON se.last = ed.seq AND se.tail = ed.src),
gone AS (SELECT segment FROM (SELECT *, row_number() OVER (PARTITION BY spot ORDER BY short, length DESC, size DESC, segment) AS k FROM sp) WHERE short AND k > 1 UNION SELECT segment FROM (SELECT *, row_number() OVER (PARTITION BY spot ORDER BY short, length DESC, size DESC, segment) AS k FROM mp) WHERE short AND k > 1)
SELECT seq, fid FROM sg SEMI JOIN gone ON gone.segment = sg.segment""")
def track_stubs(spark, d):
    _, _, own, links = _graph(spark, d)
    return graphs.stubs(own, links, 2)


@query(f"""{TRACK}, {SEG}, rm AS (SELECT DISTINCT seq, fid FROM u WHERE x IN (0, 7) OR y IN (0, 7))
SELECT seq, fid, CASE WHEN n_in = 0 AND n_out = 0 THEN 'isolated' WHEN n_in = 0 THEN CASE WHEN seq = 1 THEN 'start' WHEN rm.seq IS NOT NULL THEN 'enter' ELSE 'genesis' END
 WHEN n_out = 0 THEN CASE WHEN seq = (SELECT max(seq) FROM st) THEN 'stop' WHEN rm.seq IS NOT NULL THEN 'exit' ELSE 'lysis' END WHEN n_in > 1 THEN 'merging' WHEN n_out > 1 THEN 'splitting' ELSE 'continuation' END AS event
FROM dg LEFT JOIN rm USING (seq, fid)""")
def track_events(spark, d):
    cells, steps, own, links = _graph(spark, d)
    edge = cells.where((F.col("x").isin(0, NX - 1)) | F.col("y").isin(0, NY - 1)).join(steps, "ts").select("seq", "fid")
    return graphs.event_types(own, links, edge, steps)


@query(f"""{TRACK}, {SEG}, mb AS (SELECT a.seq, a.fid AS src, b.fid AS dst, count(*) AS n_overlap FROM u a JOIN dg da ON da.seq = a.seq AND da.fid = a.fid AND da.n_out = 0 JOIN u b ON b.seq = a.seq + 2 AND b.x = a.x AND b.y = a.y JOIN dg db ON db.seq = b.seq AND db.fid = b.fid AND db.n_in = 0 GROUP BY ALL),
bb AS (SELECT *, row_number() OVER (PARTITION BY seq, src ORDER BY n_overlap DESC, dst) AS a, row_number() OVER (PARTITION BY seq, dst ORDER BY n_overlap DESC, src) AS b FROM mb) SELECT seq, src, dst, n_overlap FROM bb WHERE a = 1 AND b = 1""")
def track_bridges(spark, d):
    cells, steps, own, links = _graph(spark, d)
    return graphs.bridges(cells, steps, own, links)


def hull_sql(points: str, key: str) -> str:
    """CTEs up to hl({key}, hull_len, hull_area): sides of the hull are pairs with all points on their left."""
    return f"""hp AS (SELECT DISTINCT {key}, x, y FROM {points}),
hs AS (SELECT a.{key}, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM hp a JOIN hp b ON a.{key} = b.{key} AND (a.x <> b.x OR a.y <> b.y)),
hc AS (SELECT hs.*, (bx - ax) * (k.y - ay) - (by_ - ay) * (k.x - ax) AS z, (k.x - ax) * (bx - ax) + (k.y - ay) * (by_ - ay) AS t, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS tt FROM hs JOIN hp k ON k.{key} = hs.{key}),
he AS (SELECT {key}, ax, ay, bx, by_, max(abs(z)) AS wide FROM hc GROUP BY ALL HAVING min(z) >= -1e-9 AND max(CASE WHEN abs(z) <= 1e-9 AND (t > tt + 1e-9 OR t < -1e-9) THEN 1 ELSE 0 END) = 0),
hl AS (SELECT p.{key}, coalesce(e.len, 0) AS hull_len, coalesce(abs(e.area), 0) AS hull_area FROM (SELECT DISTINCT {key} FROM {points}) p LEFT JOIN (SELECT {key}, CASE WHEN max(wide) <= 1e-9 THEN sum(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2))) / 2 ELSE sum(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2))) END AS len, sum(ax * by_ - bx * ay) / 2 AS area FROM he GROUP BY {key}) e ON e.{key} = p.{key})"""


MEASURES = [
    "footprint_n__log10", "features_ts_n__p90_minus_median", "footprint_n_rel__median", "footprint_n_rel__p80", "footprint_n_rel__mean", "footprint_n_rel__max", "footprint_n_ts_rel__median", "footprint_n_ts_rel__mean", "footprint_n_ts_rel__max",
    "values_med_abs_med", "values_mean_abs_mean", "values_med_abs_mean", "values_med_mean_abs", "values_med_med_abs", "mean_width", "mean_centers_ts_hull_len", "mean_centers_ts_hull_area", "mean_centers_ts_hull_len__per__distance_mean_centers", "mean_centers_ts_hull__area_per_len",
]


@query(f"""{TRACK}, {STATS}, pv AS (SELECT own.track, u.seq, u.fid, u.v FROM u JOIN own ON u.seq = own.seq AND u.fid = own.fid), pp AS (SELECT track, xm AS x, ym AS y FROM pe), {hull_sql('pp', 'track')},
fe AS (SELECT track, seq, fid, count(*) AS n, median(v) AS med, avg(v) AS av, avg(abs(v)) AS aav, median(abs(v)) AS amed FROM pv GROUP BY ALL),
fs AS (SELECT track, median(n) AS nmed, quantile_cont(n, 0.8) AS n80, avg(n) AS navg, max(n) AS nmax, median(abs(med)) AS values_med_abs_med, avg(abs(av)) AS values_mean_abs_mean, median(abs(av)) AS values_med_abs_mean, median(aav) AS values_med_mean_abs, median(amed) AS values_med_med_abs FROM fe GROUP BY track),
wd AS (SELECT track, avg(w) AS mean_width, max(w) AS max_width FROM (SELECT track, seq, count(*) AS w FROM own GROUP BY ALL) GROUP BY track), tm AS (SELECT track, max(n) AS tmax FROM pe GROUP BY track),
al_ AS (SELECT track, log10(footprint_n) AS footprint_n__log10, ts_n_p90 - ts_n_median AS features_ts_n__p90_minus_median, footprint_n / nmed AS footprint_n_rel__median, footprint_n / n80 AS footprint_n_rel__p80, footprint_n / navg AS footprint_n_rel__mean, CAST(footprint_n AS DOUBLE) / nmax AS footprint_n_rel__max,
 footprint_n / ts_n_median AS footprint_n_ts_rel__median, footprint_n / ts_n_mean AS footprint_n_ts_rel__mean, CAST(footprint_n AS DOUBLE) / tmax AS footprint_n_ts_rel__max, values_med_abs_med, values_mean_abs_mean, values_med_abs_mean, values_med_mean_abs, values_med_med_abs, mean_width, max_width,
 hull_len AS mean_centers_ts_hull_len, hull_area AS mean_centers_ts_hull_area, CASE WHEN distance > 0 THEN hull_len / distance ELSE 2.0 END AS mean_centers_ts_hull_len__per__distance_mean_centers, CASE WHEN hull_len > 0 THEN hull_area / hull_len END AS mean_centers_ts_hull__area_per_len
 FROM ts_ JOIN fs USING (track) JOIN wd USING (track) JOIN tm USING (track) JOIN hl USING (track))
SELECT track, max_width, {', '.join(f'round(CAST({m} AS DOUBLE), 5) AS {m}' for m in MEASURES)} FROM al_""")
def track_measures(spark, d):
    cells, steps, own, _ = _graph(spark, d)
    return rounded(tracking.measures(cells, steps, own).select("track", "max_width", *MEASURES), 5)


@query(f"{TRACK} SELECT track, CAST(first.ts * 10000 + row_number() OVER (PARTITION BY first.ts ORDER BY track) - 1 AS BIGINT) AS id FROM (SELECT own.track, min(st.ts) AS ts FROM own JOIN st USING (seq) GROUP BY track) first")
def track_names(spark, d):
    _, steps, own, _ = _graph(spark, d)
    return tracking.named(own, steps)


@query(f"{TRACK} SELECT seq, fid, CAST(dense_rank() OVER (PARTITION BY track ORDER BY seq) - 1 AS INTEGER) AS age FROM own")
def track_ages(spark, d):
    _, _, own, _ = _graph(spark, d)
    return tracking.ages(own).select("seq", "fid", "age")


@query()
def track_holes(spark, d):
    cells, steps, own, _ = _graph(spark, d)
    return tracking.holes(cells, steps, own)


# ------------------------------------------------------------------ geometry


@query(f"WITH RECURSIVE {EMBED}, {LAB8}, pp AS (SELECT ts * 1099511627776 + fid AS k, x, y FROM c), {hull_sql('pp', 'k')} SELECT k // 1099511627776 AS ts, k % 1099511627776 AS fid, round(CAST(hull_len AS DOUBLE), 5) AS hull_len, round(CAST(hull_area AS DOUBLE), 5) AS hull_area FROM hl")
def feature_hulls(spark, d):
    return rounded(geometry.hulls(q.embed_features(spark, d), ["ts", "fid"]), 5)


RIM8 = "rim AS (SELECT a.ts, a.x, a.y, a.fid FROM c a LEFT JOIN c b ON a.ts = b.ts AND a.fid = b.fid AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY ALL HAVING count(b.x) < 4)"
HAV = "2 * 6378.137 * asin(least(sqrt(pow(sin(radians((b.y - a.y) * 0.5) / 2), 2) + cos(radians(-40 + a.y * 0.5)) * cos(radians(-40 + b.y * 0.5)) * pow(sin(radians((b.x - a.x) * 0.5) / 2), 2)), 1.0))"


def _far(spark, d, exact: bool):
    cells = scratch.table(q.embed_features(spark, d), "cells")
    return rounded(geometry.distance_km(cells, features.boundary(cells, 8), NX, NY, 0.0, -40.0, 0.5, exact), 4)


@query(f"WITH RECURSIVE {EMBED}, {LAB8}, {RIM8}, g AS (SELECT f.ts, f.x, f.y, c.fid FROM f LEFT JOIN c USING (ts, x, y)) SELECT a.ts, a.x, a.y, round(CASE WHEN a.fid IS NOT NULL THEN 0.0 ELSE min({HAV}) END, 4) AS dist FROM g a JOIN rim b ON b.ts = a.ts GROUP BY a.ts, a.x, a.y, a.fid")
def closest_feature_km(spark, d):
    return _far(spark, d, True)


@query(f"WITH RECURSIVE {EMBED}, {LAB8}, {RIM8}, g AS (SELECT f.ts, f.x, f.y, c.fid FROM f LEFT JOIN c USING (ts, x, y)), n AS (SELECT a.ts, a.x, a.y, a.fid, {HAV} AS km, row_number() OVER (PARTITION BY a.ts, a.x, a.y ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.x, b.y) AS k FROM g a JOIN rim b ON b.ts = a.ts) SELECT ts, x, y, round(CASE WHEN fid IS NOT NULL THEN 0.0 ELSE km END, 4) AS dist FROM n WHERE k = 1")
def closest_feature_km_approx(spark, d):
    return _far(spark, d, False)


POLY = [(0.6, 0.7), (6.3, 1.2), (4.4, 3.1), (6.6, 6.4), (1.1, 5.2), (2.5, 3.3)]
POLY_SQL = ", ".join(f"({i}, {x}, {y}, {POLY[(i + 1) % len(POLY)][0]}, {POLY[(i + 1) % len(POLY)][1]})" for i, (x, y) in enumerate(POLY))


@query(f"WITH e(i, ax, ay, bx, by_) AS (VALUES {POLY_SQL}), g AS (SELECT a.x, b.y FROM (SELECT unnest(range(8)) AS x) a, (SELECT unnest(range(8)) AS y) b), n AS (SELECT g.x, g.y, count(*) FILTER ((ay < g.y) <> (by_ < g.y) AND ax + (g.y - ay) * (bx - ax) / (by_ - ay) <= g.x) AS k FROM g, e GROUP BY ALL) SELECT 'p' AS id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM n WHERE k % 2 = 1")
def polygon_cells(spark, d):
    path = spark.createDataFrame([("p", 0, i, x, y) for i, (x, y) in enumerate(POLY)], "id string, ring int, seq int, x double, y double")
    return geometry.polygons_to_cells(path, NX, NY)


@query(f"""WITH p AS (SELECT i, radians(47.0) AS a, 2 * pi() * (i % 24) / 24 AS w, 800.0 / 6378.137 AS d FROM (SELECT unnest(range(25)) AS i)), s AS (SELECT *, sin(a) * cos(d) + cos(a) * sin(d) * cos(w) AS z FROM p)
SELECT CAST(i AS INTEGER) AS seq, round(8.0 + degrees(atan2(sin(w) * sin(d) * cos(a), cos(d) - sin(a) * z)), 6) AS lon, round(degrees(asin(z)), 6) AS lat FROM s""")
def circle_outline(spark, d):
    one = spark.range(1).select(F.posexplode(geometry.circle_path(F.lit(8.0), F.lit(47.0), 800.0, 24)).alias("seq", "p"))
    return rounded(one.select("seq", "p.lon", "p.lat"))


@query()
def circle_area(spark, d):
    """Area of that circle in the equal-area projection, and length along its outline, km."""
    one = spark.range(1).select(F.posexplode(geometry.circle_path(F.lit(8.0), F.lit(47.0), 800.0, 720)).alias("seq", "p")).select(F.lit("c").alias("id"), "seq", "p.lon", "p.lat")
    length = geometry.path_length(one.select("id", "seq", F.col("lon").alias("x"), F.col("lat").alias("y")), ["id"])
    return geometry.ring_area(one, ["id"]).join(length, "id")


@query(f"WITH {EMBED}, g AS (SELECT DISTINCT x, y, x * 0.5 AS lon, -40 + y * 0.5 AS lat FROM f), r AS (SELECT CASE WHEN y = 0 THEN x WHEN x = 7 THEN 7 + y WHEN y = 7 THEN 14 + 7 - x ELSE 21 + 7 - y END AS seq, lon, lat FROM g WHERE x IN (0, 7) OR y IN (0, 7)) SELECT CAST(seq AS INTEGER) AS seq, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat FROM r UNION ALL SELECT 28, CAST(lon AS DOUBLE), CAST(lat AS DOUBLE) FROM r WHERE seq = 0")
def domain_outline(spark, d):
    grid = fields.embeddings(spark, d).select("x", "y").distinct().select("x", "y", (F.col("x") * 0.5).cast("double").alias("lon"), (-40 + F.col("y") * 0.5).cast("double").alias("lat"))
    return geometry.domain_path(grid, NX, NY).select(F.col("seq").cast("int").alias("seq"), "lon", "lat")


@query(f"WITH {EMBED} SELECT ts, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, count(*) = (max(x) - min(x) + 1) * (max(y) - min(y) + 1) AS whole FROM f WHERE v >= 0 GROUP BY ts")
def valid_box(spark, d):
    f = fields.embeddings(spark, d)
    return geometry.valid_box(f.withColumn("v", F.when(F.col("v") >= 0, F.col("v")).otherwise(float("nan"))))


@query("SELECT true AS regular, 0.5 AS dlon, 0.25 AS dlat")
def regular_axes(spark, d):
    grid = fields.embeddings(spark, d).select("x", "y").distinct().select("x", "y", (F.col("x") * 0.5).cast("double").alias("lon"), (-40 + F.col("y") * 0.25).cast("double").alias("lat"))
    return geometry.regular_axes(grid)


@query(f"{TRACK}, {STATS}, a AS (SELECT track, seq, xm, ym, row_number() OVER (PARTITION BY track ORDER BY seq) - 1 AS f, count(*) OVER (PARTITION BY track) - row_number() OVER (PARTITION BY track ORDER BY seq) AS b FROM pe) SELECT a.track, a.seq, round(avg(p.xm), 5) AS x, round(avg(p.ym), 5) AS y FROM a JOIN a p ON p.track = a.track AND abs(p.f - a.f) <= least(1, a.f, a.b) GROUP BY ALL")
def track_smooth_path(spark, d):
    cells, steps, own, _ = _graph(spark, d)
    placed = cells.join(steps, "ts").join(own.select("seq", "fid", "track"), ["seq", "fid"])
    path = placed.groupBy("track", "seq").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return rounded(geometry.smooth_path(path, ["track"], 3), 5)


# ------------------------------------------------------------------ fields and masks


@query(f"WITH {EMBED} SELECT ts, x, y, CASE WHEN x IN (0, 7) OR y IN (0, 7) THEN 1000.0 ELSE round(v, 6) END AS v FROM f")
def field_frame(spark, d):
    return rounded(field_ops.frame(fields.embeddings(spark, d), 1, 1000.0, NX, NY))


def _halo(periodic_: bool) -> str:
    source = "((x % 8) + 8) % 8" if periodic_ else "least(greatest(x, 0), 7)"
    return f"WITH {EMBED}, g AS (SELECT a.x, b.y FROM (SELECT unnest(range(-1, 9)) AS x) a, (SELECT unnest(range(-1, 9)) AS y) b), h AS (SELECT x, y, {source} AS sx, least(greatest(y, 0), 7) AS sy FROM g) SELECT f.ts, CAST(h.x AS INTEGER) AS x, CAST(h.y AS INTEGER) AS y, round(f.v, 6) AS v FROM h JOIN f ON f.x = h.sx AND f.y = h.sy"


@query(_halo(True))
def field_halo_periodic(spark, d):
    return rounded(field_ops.halo(fields.embeddings(spark, d), NX, NY, True))


@query(_halo(False))
def field_halo(spark, d):
    return rounded(field_ops.halo(fields.embeddings(spark, d), NX, NY, False))


def _has(dx: int, dy: int) -> str:
    return f"EXISTS (SELECT 1 FROM m WHERE m.ts = f.ts AND m.x = f.x + {dx} AND m.y = f.y + {dy})"


_JOINED = " OR ".join(f"({_has(*field_ops._AT[a])} AND {_has(*field_ops._AT[b])})" for a, b in field_ops.BRIDGED)


@query(f"WITH {EMBED}, m AS MATERIALIZED (SELECT ts, x, y FROM f WHERE v >= 0.15), o AS (SELECT ts, sum(DISTINCT 0) AS z, x, y FROM m GROUP BY ALL) SELECT ts, x, y FROM o UNION SELECT f.ts, f.x, f.y FROM f WHERE {_JOINED}")
def mask_joined_lines(spark, d):
    f = fields.embeddings(spark, d)
    return field_ops.join_lines(f.where("v >= 0.15").select("ts", "x", "y"), NX, NY)


@query(f"""WITH {EMBED}, p AS (SELECT ts, x, y, v AS u, 0.1 - v AS w, radians(x * 0.5) AS lo, radians(-2 + y * 0.5) AS la, radians(43.0) AS po FROM f),
s AS (SELECT *, sqrt(1 - pow(cos(lo) * cos(po) * cos(la) + sin(po) * sin(la), 2)) AS co FROM p), r AS (SELECT *, (cos(la) * sin(po) - cos(po) * cos(lo) * sin(la)) / co AS a, cos(po) * sin(lo) / co AS b FROM s)
SELECT ts, x, y, round(u * a + w * b, 6) AS u, round(w * a - u * b, 6) AS w FROM r""")
def wind_unrotated(spark, d):
    f = q._wind(fields.embeddings(spark, d))
    u, w = field_ops.unrotate(F.col("u"), F.col("w"), F.col("x") * 0.5, -2 + F.col("y") * 0.5, 43.0)
    return rounded(f.select("ts", "x", "y", u.alias("u"), w.alias("w")))


@query(f"WITH {q.EVENTS} SELECT x, y, CASE WHEN ts // 100 % 100 IN (12, 1, 2) THEN 'DJF' WHEN ts // 100 % 100 IN (3, 4, 5) THEN 'MAM' WHEN ts // 100 % 100 IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, count(*) AS n, round(avg(CASE WHEN v >= 50 THEN 1.0 ELSE 0.0 END), 5) AS frequency, round(avg(v) * 0.97, 2) AS mean, round(var_pop(v) * 0.97, 1) AS variance FROM f GROUP BY ALL")
def field_climatology(spark, d):
    f = fields.events(spark, d)
    out = field_ops.climatology(f, F.expr("cast(ts div 100 % 100 as int)"), 50.0)
    return out.select("x", "y", "season", "n", rounded_scaled(F.col("frequency"), 5).alias("frequency"), rounded_scaled(F.col("mean") * 0.97, 2).alias("mean"), rounded_scaled(F.col("variance") * 0.97, 1).alias("variance"))


@query(f"WITH {EMBED}, z AS (SELECT ts, x, y, 10 * CASE WHEN x < 1 THEN 1 WHEN x > 6 THEN 5 WHEN x < 3 THEN 2 WHEN x > 4 THEN 4 ELSE 3 END + CASE WHEN y < 1 THEN 1 WHEN y > 5 THEN 5 WHEN y < 2 THEN 2 WHEN y > 3 THEN 4 ELSE 3 END AS zone FROM f) SELECT ts, x, y, CAST(zone AS INTEGER) AS zone FROM z")
def mask_zones_hole(spark, d):
    f = fields.embeddings(spark, d)
    m = f.select("ts", "x", "y", (F.col("x").between(1, 6) & F.col("y").between(1, 5)).alias("m"), (F.col("x").between(3, 4) & F.col("y").between(2, 3)).alias("hole"))
    return field_ops.zones_with_hole(m).select("ts", "x", "y", F.col("zone").cast("int").alias("zone"))


# ------------------------------------------------------------------ features


@query(f"""WITH RECURSIVE {EMBED}, {LAB8}, wr AS (SELECT DISTINCT w.ts, w.fid AS a, e.fid AS b FROM c w JOIN c e ON e.ts = w.ts AND w.x = 0 AND e.x = 7 AND abs(e.y - w.y) <= 1),
l2 AS (SELECT ts, a, b FROM wr UNION SELECT ts, b, a FROM wr), mr AS (SELECT DISTINCT ts, fid, fid AS lab FROM c UNION SELECT mr.ts, l2.b, mr.lab FROM mr JOIN l2 ON l2.ts = mr.ts AND l2.a = mr.fid WHERE l2.b > mr.lab),
rt AS (SELECT ts, fid, min(lab) AS root FROM mr GROUP BY ALL) SELECT c.ts, c.x, c.y, rt.root AS fid FROM c JOIN rt ON rt.ts = c.ts AND rt.fid = c.fid""")
def features_periodic(spark, d):
    f = fields.embeddings(spark, d)
    return periodic.label(f.where(F.col("v") >= HIGH), NX).select("ts", "x", "y", "fid")


@query(f"WITH RECURSIVE {EMBED}, {LAB8} SELECT ts, fid, bool_or(y = 7) AS north, bool_or(x = 7) AS east, bool_or(y = 0) AS south, bool_or(x = 0) AS west FROM c GROUP BY ALL")
def features_at_edge(spark, d):
    return periodic.at_edge(q.embed_features(spark, d), NX, NY)


@query(f"WITH RECURSIVE {EMBED}, {LAB8} SELECT ts, fid, x, y FROM (SELECT *, row_number() OVER (PARTITION BY ts, fid ORDER BY y DESC, x) AS k FROM c) WHERE k = 1")
def feature_northernmost(spark, d):
    return periodic.northernmost(q.embed_features(spark, d))


@query(f"WITH RECURSIVE {EMBED}, {LAB8} SELECT DISTINCT f.ts, c.fid, f.x, f.y FROM c JOIN f ON f.ts = c.ts AND abs(f.x - c.x) <= 1 AND abs(f.y - c.y) <= 1 ANTI JOIN c AS o ON o.ts = f.ts AND o.x = f.x AND o.y = f.y")
def feature_background(spark, d):
    return periodic.background_rim(q.embed_features(spark, d), NX, NY)


@query()
def features_split_levels(spark, d):
    return periodic.split_levels(q.embed_features(spark, d, LOW, 8), [0.1, 0.15]).select("ts", "x", "y", "fid")


@query()
def front_surgery(spark, d):
    cells = q.embed_features(spark, d, LOW, 4)
    return association.surgery(cells, 4, 8, 12).select("ts", "x", "y", "fid", "category")


# ------------------------------------------------------------------ depressions

TREE = """ins AS (SELECT DISTINCT a.ts, b.level AS ul, b.fid AS up, a.level, a.fid FROM s a JOIN s b ON a.ts = b.ts AND a.x = b.x AND a.y = b.y AND a.level <= b.level),
lf AS (SELECT ct.*, NOT EXISTS (SELECT 1 FROM nt WHERE nt.ts = ct.ts AND nt.level = ct.level - 1 AND nt.parent = ct.fid) AS leaf FROM ct),
at_ AS (SELECT i.ts, i.ul, i.up, lf.level, lf.fid, lf.vmin, lf.closed, lf.leaf FROM ins i JOIN lf ON lf.ts = i.ts AND lf.level = i.level AND lf.fid = i.fid),
pl AS (SELECT ts, ul, up, max(CASE WHEN k > 1 THEN level END) AS branch, max(k) AS widest, min(level) AS deepest FROM (SELECT ts, ul, up, level, count(*) AS k FROM at_ GROUP BY ALL) GROUP BY ALL),
ow AS (SELECT ts, ul, up, count(*) AS n_contours, count(*) FILTER (leaf) AS n_innermost, max(level) FILTER (leaf) AS shallowest, min(vmin) AS low, max(vmin) FILTER (leaf) AS high, avg(CASE WHEN closed THEN 0.0 ELSE 1.0 END) AS bcc FROM at_ GROUP BY ALL),
dp AS (SELECT ct.*, n_contours, n_innermost, ow.ul - deepest AS dmax, ow.ul - shallowest AS dmin, widest = 1 AS nested, coalesce(branch + 1, deepest) AS l0, low, high, bcc, deepest FROM ct JOIN ow ON ow.ts = ct.ts AND ow.ul = ct.level AND ow.up = ct.fid JOIN pl ON pl.ts = ct.ts AND pl.ul = ct.level AND pl.up = ct.fid),
dq AS (SELECT dp.*, CAST(t1.t AS DOUBLE) AS top, CAST(t0.t AS DOUBLE) AS bottom FROM dp JOIN lv t1 ON t1.k = dp.level JOIN lv t0 ON t0.k = dp.l0)"""


def _depressions(spark, d):
    field, sets = q._sets(spark, d)
    return field, sets, contours.depressions(sets, field, q.LEVELS, NX, NY)


@query(f"""WITH RECURSIVE {SETS_SQL}, {TREE} SELECT ts, level, fid, n, closed, n_minima, n_contours, n_innermost, CAST(dmax AS INTEGER) AS max_contour_depth, CAST(dmin AS INTEGER) AS min_contour_depth, nested, CAST(level - l0 + 1 AS INTEGER) AS shared_contours, round(top - bottom, 5) AS shared_depth, round(top - low, 5) AS max_depth, round(top - high, 5) AS min_depth,
 round(CAST(level - l0 + 1 AS DOUBLE) / (level - deepest + 1), 5) AS shared_contour_ratio, round((top - bottom) / (top - low), 5) AS shared_depth_ratio, round(CAST(bcc AS DOUBLE), 5) AS bcc_fraction, round(sqrt(n / pi()), 5) AS radius FROM dq""")
def depressions(spark, d):
    return rounded(_depressions(spark, d)[2], 5)


@query(f"""WITH RECURSIVE {SETS_SQL}, {TREE}, ok AS (SELECT *, CASE WHEN n_minima = 1 THEN 'SCC' WHEN n_minima = 2 AND CAST(level - l0 + 1 AS DOUBLE) / (level - deepest + 1) >= 0.5 THEN 'DCC' WHEN n_minima = 3 AND CAST(level - l0 + 1 AS DOUBLE) / (level - deepest + 1) >= 0.7 THEN 'TCC' END AS type FROM dq WHERE closed AND bcc <= 1)
SELECT o.ts, o.level, o.fid, o.n, o.type FROM ok o WHERE type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ins i JOIN ok h ON h.ts = i.ts AND h.level = i.ul AND h.fid = i.up AND h.type IS NOT NULL WHERE i.ts = o.ts AND i.level = o.level AND i.fid = o.fid AND i.ul > o.level)""")
def cyclone_types(spark, d):
    _, sets, found = _depressions(spark, d)
    good = scratch.table(contours.centred(found), "cyclones")
    return contours.outermost(good, contours.containment(sets)).select("ts", "level", "fid", "n", "type")


@query(f"""WITH RECURSIVE {SETS_SQL}, dw AS (SELECT s.ts, s.level, s.fid, s.x, s.y, CAST(lv.t AS DOUBLE) - s.v AS w FROM s JOIN lo ON lo.ts = s.ts AND lo.x = s.x AND lo.y = s.y JOIN lv ON lv.k = s.level)
SELECT ts, level, fid, round(sum(w * x) / sum(w), 5) AS xc, round(sum(w * y) / sum(w), 5) AS yc FROM dw GROUP BY ALL""")
def depression_centres(spark, d):
    field, sets = q._sets(spark, d)
    return rounded(contours.centre(sets, field, q.LEVELS, NX, NY), 5)


# ------------------------------------------------------------------ files


@query(f"WITH RECURSIVE {EMBED}, {LAB8} SELECT ts, x, y, round(v, 6) AS v, fid FROM c WHERE (ts, fid) IN (SELECT (ts, fid) FROM c GROUP BY ts, fid HAVING count(*) >= 2)")
def features_json(spark, d):
    """Feature records written as JSON and read back, those of two cells and more."""
    cells = scratch.table(q.embed_features(spark, d), "cells")
    records = files.feature_records(cells, features.stats(cells), features.neighbours(cells))
    where = f"{scratch.folder(spark)}/features-{spark.sparkContext.startTime}"
    files.write_records(records, where)
    return rounded(files.features_of(files.read_records(spark, where, files.FEATURE), minsize=2))


@query(f"{TRACK} SELECT track, src, dst, ed.seq, round(p_tot, 5) AS p_tot, round(CAST(p_share AS DOUBLE), 5) AS p_share FROM ed JOIN own ON own.seq = ed.seq AND own.fid = ed.src")
def tracks_json(spark, d):
    _, _, own, links = _graph(spark, d)
    where = f"{scratch.folder(spark)}/tracks-{spark.sparkContext.startTime}"
    files.write_records(files.track_records(own, links), where)
    return rounded(files.links_of(files.read_records(spark, where, files.TRACK)), 5)


@query(f"WITH {EMBED} SELECT a.ts, a.x, a.y, round(sqrt(pow(least(abs(a.x - 6), 8 - abs(a.x - 6)), 2) + pow(a.y - 1, 2)), 6) AS dist FROM f a")
def periodic_distance(spark, d):
    f = fields.embeddings(spark, d)
    return rounded(f.select("ts", "x", "y", geometry.periodic_distance(F.col("x"), F.col("y"), F.lit(6), F.lit(1), float(NX)).alias("dist")))


