"""The registered queries of the grid operators, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridtrack import functions as fn, scratch
from gridtrack.operators import association, branches, contours, features, field_ops, rings, tracking
from gridtrack.sources import fields
from gridtrack.streaming import tracker

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NX = NY = 8
LOW, HIGH = 0.05, 0.1

EVENTS = "f AS (SELECT CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS ts, CAST(hour(ts) AS INTEGER) AS x, CAST(user_id AS INTEGER) AS y, round(sum(value), 6) AS v FROM events GROUP BY ALL)"
EMBED = "f AS (SELECT vec_id AS ts, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(64)) AS i))"
ITEMS = "f AS (SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS ts, CAST(l_quantity AS INTEGER) - 1 AS x, CAST(round(l_discount * 100) AS INTEGER) AS y, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY ALL)"


def comps(name: str, where: str, connectivity: int = 8, src: str = "f") -> str:
    """CTEs up to ``name(ts, x, y, v, fid)``: labelled cells of ``src`` that meet ``where``."""
    near = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1" if connectivity == 8 else "abs(a.x - b.x) + abs(a.y - b.y) = 1"
    return f"""{name}_p AS (SELECT ts, x, y, v, CAST(x AS BIGINT) * 1048576 + y AS id FROM {src} WHERE {where}),
{name}_e AS (SELECT a.ts, a.id AS a, b.id AS b FROM {name}_p a JOIN {name}_p b ON a.ts = b.ts AND {near} AND a.id <> b.id),
{name}_r AS (SELECT ts, id, id AS lab FROM {name}_p UNION SELECT r.ts, e.b, r.lab FROM {name}_r r JOIN {name}_e e ON e.ts = r.ts AND e.a = r.id WHERE e.b > r.lab),
{name} AS (SELECT p.ts, p.x, p.y, p.v, l.fid FROM {name}_p p JOIN (SELECT ts, id, min(lab) AS fid FROM {name}_r GROUP BY ALL) l ON p.ts = l.ts AND p.id = l.id)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_scaled(c: Column, digits: int) -> Column:
    """A double rounded half away from zero as its binary product with 10^digits, like SQL's; F.round takes its decimal text."""
    return F.round(c * 10.0**digits, 0) / 10.0**digits


# ------------------------------------------------------------------ fields


@query(f"WITH {EVENTS} SELECT ts, x, y, v FROM f")
def field_events_daily(spark, d):
    return fields.events(spark, d).select(*fields.FIELD)


@query(f"WITH {EMBED} SELECT ts, x, y, CASE WHEN v > -0.1 AND v < 0.1 THEN round(v, 6) ELSE 0.0 END AS v FROM f")
def field_mask_range(spark, d):
    return rounded(field_ops.mask_range(fields.embeddings(spark, d), F.col("v"), -0.1, 0.1))


@query(f"WITH {EMBED} SELECT ts, x, y, CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 THEN round(v, 6) ELSE 0.0 END AS v FROM f")
def field_trim(spark, d):
    return rounded(field_ops.trim(fields.embeddings(spark, d), 1, NX, NY))


@query(f"WITH {EMBED} SELECT ts, x, y, round(0.5 - v, 6) AS v FROM f")
def field_mirror_refval(spark, d):
    return rounded(field_ops.mirror(fields.embeddings(spark, d), 0.25))


@query(f"WITH {EMBED} SELECT ts, CAST(x // 3 AS INTEGER) AS x, CAST(y // 3 AS INTEGER) AS y, round(v, 6) AS v FROM f WHERE x % 3 = 1 AND y % 3 = 1 AND x < 6 AND y < 6")
def field_reduce_pick(spark, d):
    return rounded(field_ops.reduce_pick(fields.embeddings(spark, d), 3, NX, NY))


@query(f"WITH {EMBED} SELECT ts, CAST(x // 3 AS INTEGER) AS x, CAST(y // 3 AS INTEGER) AS y, round(sum(v) / 9, 6) AS v FROM f WHERE x < 6 AND y < 6 GROUP BY ts, x // 3, y // 3")
def field_reduce_mean(spark, d):
    return rounded(field_ops.reduce_mean(fields.embeddings(spark, d), 3, NX, NY))


def _extrema(n: int, largest: bool) -> None:
    where = {4: "abs(g.x - f.x) + abs(g.y - f.y) = 1", 8: "greatest(abs(g.x - f.x), abs(g.y - f.y)) = 1", 12: "(greatest(abs(g.x - f.x), abs(g.y - f.y)) = 1 OR (abs(g.x - f.x) + abs(g.y - f.y) = 2 AND abs(g.x - f.x) <> 1))", 20: "greatest(abs(g.x - f.x), abs(g.y - f.y)) <= 2 AND abs(g.x - f.x) + abs(g.y - f.y) BETWEEN 1 AND 3"}[n]
    band = 1 if n <= 8 else 2
    test = "f.v > max(g.v)" if largest else "f.v < min(g.v)"
    sql = f"WITH {EMBED} SELECT f.ts, f.x, f.y, round(f.v, 6) AS v FROM f JOIN f g ON f.ts = g.ts AND {where} WHERE f.x BETWEEN {band} AND {7 - band} AND f.y BETWEEN {band} AND {7 - band} GROUP BY f.ts, f.x, f.y, f.v HAVING {test}"

    def run(spark, d):
        return rounded(field_ops.extrema(fields.embeddings(spark, d), n, NX, NY, largest))

    run.__name__ = f"field_extrema_{'max' if largest else 'min'}{n}"
    query(sql)(run)


for _n in (4, 8, 12, 20):
    for _largest in (False, True):
        _extrema(_n, _largest)


@query(f"WITH {EMBED} SELECT f.ts, f.x, f.y, round(f.v, 6) AS v FROM f JOIN f g ON f.ts = g.ts AND abs(g.x - f.x) <= 1 AND abs(g.y - f.y) <= 1 WHERE f.x BETWEEN 1 AND 6 AND f.y BETWEEN 1 AND 6 GROUP BY f.ts, f.x, f.y, f.v HAVING f.v <= min(g.v)")
def field_filter_extrema_9(spark, d):
    return rounded(field_ops.window_extrema(fields.embeddings(spark, d), 3))


def _diffused(passes: int) -> str:
    out, last = [EMBED], "f"
    for i in range(passes):
        out.append(f"d{i} AS (SELECT a.ts, a.x, a.y, a.v + 0.125 * sum(b.v - a.v) AS v FROM {last} a JOIN {last} b ON a.ts = b.ts AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY a.ts, a.x, a.y, a.v)")
        last = f"d{i}"
    return f"WITH {', '.join(out)} SELECT ts, x, y, round(v, 5) AS v FROM {last}"


@query(_diffused(1))
def field_diffuse_1(spark, d):
    return rounded(field_ops.diffuse(fields.embeddings(spark, d), 1), 5)


@query(_diffused(3))
def field_diffuse_3(spark, d):
    return rounded(field_ops.diffuse(fields.embeddings(spark, d), 3), 5)


# the grid is dense: a neighbour is the row before or after
GRAD = """m AS MATERIALIZED (SELECT * FROM f),
g AS (SELECT ts, x, y, v, (lead(v) OVER bx - lag(v) OVER bx) / (1.111775 * 2 * 0.5 * cos(radians(-40.0 + y * 0.5))) AS gx, (lead(v) OVER by_ - lag(v) OVER by_) / (1.111775 * 2 * 0.5) AS gy
  FROM m WINDOW bx AS (PARTITION BY ts, y ORDER BY x), by_ AS (PARTITION BY ts, x ORDER BY y))"""


@query(f"WITH {EMBED}, {GRAD} SELECT ts, x, y, round(v, 6) AS v, round(gx, 6) AS gx, round(gy, 6) AS gy FROM g")
def field_gradient_stride1(spark, d):
    return rounded(field_ops.gradient(fields.embeddings(spark, d)))


def _wind(field: DataFrame) -> DataFrame:
    """A made-up wind from the field itself: u is the value, w its mirror image."""
    return field.select("ts", "x", "y", F.col("v").alias("u"), (0.1 - F.col("v")).alias("w"))


@query(f"WITH {EMBED}, {GRAD} SELECT ts, x, y, round(sqrt(gx * gx + gy * gy), 6) AS farea, round((v * gx + (0.1 - v) * gy) / sqrt(gx * gx + gy * gy), 6) AS fvel FROM g WHERE sqrt(gx * gx + gy * gy) > 0.1")
def front_area_velocity(spark, d):
    field = fields.embeddings(spark, d)
    return rounded(field_ops.front_fields(field, _wind(field), 0.1))


@query(f"WITH {EMBED}, {GRAD} SELECT ts, x, y, round(gx - gy, 5) AS v FROM g WHERE gx IS NOT NULL AND gy IS NOT NULL")
def field_divergence(spark, d):
    return rounded(field_ops.divergence(_wind(fields.embeddings(spark, d))), 5)


@query(f"WITH {EMBED}, m AS MATERIALIZED (SELECT * FROM f) SELECT ts, x, y, round(coalesce((v + lead(v) OVER (PARTITION BY ts, y ORDER BY x)) / 2, v), 6) AS v FROM m")
def field_destagger(spark, d):
    return rounded(field_ops.destagger(fields.embeddings(spark, d), "x"))


_T, _Q, _P = "(v * 100)", "(abs(v) * 0.02)", "850.0"
_K, _M = f"({_T} + 273.15)", f"greatest(1e-10, {_Q})"
THETA_E = f"{_K} * pow(1000.0 / {_P}, 0.2854 * (1.0 - 0.28 * {_Q})) * exp((3.376 / (2840.0 / (3.5 * ln({_K}) - ln(100.0 * {_P} * {_M} / (0.622 + 0.378 * {_Q})) - 0.1998) + 55.0) - 0.00254) * 1000.0 * {_M} * (1.0 + 0.81 * {_Q}))"


@query(f"WITH {EMBED} SELECT ts, x, y, round((v * 100 + CASE WHEN v * 100 < 100 THEN 273.15 ELSE 0 END) * pow(1000.0 / 850.0, 0.286), 6) AS v FROM f")
def theta(spark, d):
    return rounded(fields.embeddings(spark, d).withColumn("v", fn.theta(F.col("v") * 100, F.lit(850.0))))


@query(f"WITH {EMBED} SELECT ts, x, y, round({THETA_E}, 5) AS v FROM f")
def theta_e(spark, d):
    f = fields.embeddings(spark, d)
    return rounded(f.withColumn("v", fn.theta_e(F.col("v") * 100, F.abs("v") * 0.02, F.lit(850.0))), 5)


@query(f"WITH {EMBED} SELECT ts, x, y, round(fmod(degrees(atan2(v, 0.1 - v)) + 180.0 + 360.0, 360.0), 5) AS v FROM f")
def wind_direction(spark, d):
    return rounded(fields.embeddings(spark, d).withColumn("v", fn.wind_direction(F.col("v"), 0.1 - F.col("v"))), 5)


MASK = f"{EMBED}, m AS (SELECT ts, x, y FROM f WHERE v >= 0.0)"


def _mask(spark, d):
    return fields.embeddings(spark, d).where("v >= 0.0").select("ts", "x", "y")


@query(f"WITH {MASK} SELECT a.ts, a.x, a.y FROM m a JOIN m b ON a.ts = b.ts AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY ALL HAVING count(*) = 4")
def mask_erode(spark, d):
    return field_ops.erode(_mask(spark, d), eight=False)


@query(f"WITH {MASK}, o AS (SELECT unnest([-1, 0, 1]) AS o) SELECT DISTINCT ts, CAST(x + a.o AS INTEGER) AS x, CAST(y + b.o AS INTEGER) AS y FROM m, o a, o b WHERE x + a.o BETWEEN 0 AND 7 AND y + b.o BETWEEN 0 AND 7")
def mask_dilate(spark, d):
    return field_ops.dilate(_mask(spark, d), NX, NY)


EDGE = f"""{MASK}, k AS (SELECT *, x - row_number() OVER (PARTITION BY ts, y ORDER BY x) AS rx, y - row_number() OVER (PARTITION BY ts, x ORDER BY y) AS ry FROM m),
q AS (SELECT ts, x, y, CAST(least(x - min(x) OVER a, max(x) OVER a - x, y - min(y) OVER b, max(y) OVER b - y) AS INTEGER) AS dist FROM k WINDOW a AS (PARTITION BY ts, y, rx), b AS (PARTITION BY ts, x, ry))"""


@query(f"WITH {EDGE} SELECT ts, x, y, dist FROM q")
def mask_edge_distance(spark, d):
    return field_ops.edge_distance(_mask(spark, d))


@query(f"WITH {EDGE} SELECT ts, x, y FROM q WHERE dist >= 1")
def mask_shrink_n(spark, d):
    return field_ops.shrink(_mask(spark, d), 1)


@query(f"WITH {EMBED}, b AS (SELECT ts, min(x) FILTER (v >= 0.25) AS x0, max(x) FILTER (v >= 0.25) AS x1, min(y) FILTER (v >= 0.25) AS y0, max(y) FILTER (v >= 0.25) AS y1 FROM f GROUP BY ts) SELECT f.ts, f.x, f.y, CAST(10 * (CASE WHEN x < x0 THEN 1 WHEN x > x1 THEN 5 ELSE 3 END) + (CASE WHEN y < y0 THEN 1 WHEN y > y1 THEN 5 ELSE 3 END) AS INTEGER) AS zone FROM f JOIN b ON f.ts = b.ts")
def mask_zones(spark, d):
    return field_ops.zones(fields.embeddings(spark, d).withColumn("m", F.col("v") >= 0.25))


MONTHLY = [1.0, 2.0, 4.0, 7.0, 11.0, 16.0, 16.0, 11.0, 7.0, 4.0, 2.0, 1.0]


@query(f"""WITH t AS (SELECT DISTINCT date_trunc('day', l_shipdate) AS ts FROM lineitem),
m AS (SELECT k, {MONTHLY} AS v, CAST((DATE '1990-01-01' + to_months(CAST(k AS INTEGER))) AS TIMESTAMP) AS b, CAST((DATE '1990-01-01' + to_months(CAST(k + 1 AS INTEGER))) AS TIMESTAMP) AS e FROM (SELECT unnest(range(0, 240)) AS k)),
c AS (SELECT (epoch(b) + epoch(e)) / 2 AS s, v[k % 12 + 1] AS v, lead((epoch(b) + epoch(e)) / 2) OVER (ORDER BY k) AS s1, lead(v[k % 12 + 1]) OVER (ORDER BY k) AS v1 FROM m)
SELECT CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS ts, round(CAST(v + (v1 - v) * (epoch(ts) - s) / (s1 - s) AS DOUBLE), 6) AS threshold FROM t JOIN c ON epoch(ts) >= s AND epoch(ts) < s1""")
def monthly_threshold(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet").select(F.date_trunc("day", "l_shipdate").alias("t")).distinct()
    return rounded(t.select(F.date_format("t", "yyyyMMdd").cast("long").alias("ts"), fn.mid_month_threshold(MONTHLY, F.col("t")).alias("threshold")))


@query(f"WITH {EMBED} SELECT DISTINCT x, y, round(0.5 * pi() / 180 * 6378.1 * cos(radians(-40 + y * 0.5)) * 0.5 * 111.32, 5) AS km2 FROM f")
def cell_area(spark, d):
    grid = fields.embeddings(spark, d).select("x", "y").distinct()
    return rounded(grid.withColumn("km2", fn.cell_area(-40 + F.col("y") * 0.5, 0.5, 0.5)), 5)


@query(f"WITH {EMBED} SELECT DISTINCT x, y, round(2 * 6378.137 * asin(sqrt(pow(sin(radians(-40 + y * 0.5 + 38) / 2), 2) + cos(radians(-38)) * cos(radians(-40 + y * 0.5)) * pow(sin(radians(x * 0.5 - 2) / 2), 2))), 5) AS km FROM f")
def great_circle(spark, d):
    grid = fields.embeddings(spark, d).select("x", "y").distinct()
    return rounded(grid.withColumn("km", fn.great_circle(F.lit(2.0), F.lit(-38.0), F.col("x") * 0.5, -40 + F.col("y") * 0.5)), 5)


@query("WITH p AS (SELECT event_id AS ord, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS ts, user_id * 0.13 AS lon, value * 0.11 AS lat, value AS v FROM events), g AS (SELECT *, CAST(floor(lon / 0.5 + 0.5) AS INTEGER) AS x, CAST(floor(lat / 0.5 + 0.5) AS INTEGER) AS y FROM p) SELECT ts, x, y, round(max_by(v, ord), 6) AS v FROM g WHERE x BETWEEN 0 AND 39 AND y BETWEEN 0 AND 39 GROUP BY ALL")
def points_to_grid(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    p = e.select(F.col("event_id").alias("ord"), F.date_format("ts", "yyyyMMdd").cast("long").alias("ts"), (F.col("user_id") * 0.13).alias("lon"), (F.col("value") * 0.11).alias("lat"), F.col("value").alias("v"))
    return rounded(fields.points_to_grid(p, 0.0, 0.0, 0.5, 40, 40))


@query("SELECT CAST(strftime(t, '%Y%m%d%H') AS BIGINT) AS ts, row_number() OVER (ORDER BY t) AS seq FROM (SELECT unnest(generate_series(TIMESTAMP '2000-09-01 00:00:00', TIMESTAMP '2000-11-30 21:00:00', INTERVAL 6 HOUR)) AS t)")
def timestep_sequence(spark, d):
    return timesteps(spark, "2000-09-01 00:00:00", "2000-11-30 21:00:00", 6)


def timesteps(spark: SparkSession, first: str, last: str, hours: int) -> DataFrame:
    """``(ts, seq)`` of a period, ts as YYYYMMDDHH; seq is computed, not counted over a sort."""
    whole = f"sequence(timestamp'{first}', timestamp'{last}', interval {hours} hours)"
    return spark.sql(f"SELECT cast(date_format(t, 'yyyyMMddHH') AS long) AS ts, cast(k + 1 AS long) AS seq FROM (SELECT posexplode({whole}) AS (k, t))")


# ------------------------------------------------------------------ features


def embed_features(spark, d, low=HIGH, connectivity=8, **how):
    return features.find(fields.embeddings(spark, d), low, connectivity=connectivity, **how)


def _features(name: str, field, cte: str, where: str, connectivity: int, **how) -> None:
    sql = f"WITH RECURSIVE {cte}, {comps('c', where, connectivity)} SELECT ts, x, y, round(v, 6) AS v, fid FROM c"
    if how.get("minsize"):
        sql += f" QUALIFY count(*) OVER (PARTITION BY ts, fid) >= {how['minsize']}"

    def run(spark, d):
        return rounded(features.find(field(spark, d), connectivity=connectivity, **how))

    run.__name__ = name
    query(sql)(run)


_features("features_threshold_8c", fields.embeddings, EMBED, "v >= 0.1", 8, lower=0.1)
_features("features_threshold_4c", fields.embeddings, EMBED, "v >= 0.1", 4, lower=0.1, minsize=2)
_features("features_band", fields.embeddings, EMBED, "v >= 0.05 AND v < 0.2", 8, lower=0.05, upper=0.2)
_features("features_upper", fields.embeddings, EMBED, "v < -0.1", 4, upper=-0.1)
_features("features_events", fields.events, EVENTS, "v >= 20", 8, lower=20.0)

LAB8, LAB4 = comps("c", "v >= 0.1", 8), comps("c", "v >= 0.1", 4)
LOW4 = comps("c", "v >= 0.05", 4)


@query(f"WITH RECURSIVE {EMBED}, {LAB8} SELECT ts, x, y, round(v, 6) AS v, fid FROM c")
def features_graph(spark, d):
    return rounded(features.label_graph(fields.embeddings(spark, d).where("v >= 0.1"), 8))


@query(f"""WITH RECURSIVE {EMBED}, {LAB8} SELECT ts, fid, count(*) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(sum(v), 6) AS sum,
round(min(abs(v)), 6) AS min_abs, round(max(abs(v)), 6) AS max_abs, round(avg(abs(v)), 6) AS mean_abs, round(median(abs(v)), 6) AS median_abs, round(sum(abs(v)), 6) AS sum_abs,
min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, CAST(round_even(avg(x), 0) AS INTEGER) AS xc, CAST(round_even(avg(y), 0) AS INTEGER) AS yc FROM c GROUP BY ts, fid""")
def feature_stats(spark, d):
    return rounded(features.stats(embed_features(spark, d)))


@query(f"WITH RECURSIVE {EMBED}, {LAB8} SELECT ts, fid, round(sum(0.5 * pi() / 180 * 6378.1 * cos(radians(-40 + y * 0.5)) * 0.5 * 111.32), 4) AS km2 FROM c GROUP BY ts, fid")
def feature_area(spark, d):
    cells = embed_features(spark, d)
    return rounded(cells.groupBy("ts", "fid").agg(F.sum(fn.cell_area(-40 + F.col("y") * 0.5, 0.5, 0.5)).alias("km2")), 4)


def _boundary(connectivity: int, lab: str, near: str, full: int) -> None:
    sql = f"WITH RECURSIVE {EMBED}, {lab} SELECT a.ts, a.x, a.y, a.fid FROM c a LEFT JOIN c b ON a.ts = b.ts AND a.fid = b.fid AND {near} GROUP BY ALL HAVING count(b.x) < {full}"

    def run(spark, d):
        return features.boundary(embed_features(spark, d, 0.0, connectivity), connectivity)

    run.__name__ = f"feature_boundary_{connectivity}c"
    query(sql)(run)


_boundary(8, comps("c", "v >= 0.0", 8), "abs(a.x - b.x) + abs(a.y - b.y) = 1", 4)
_boundary(4, comps("c", "v >= 0.0", 4), "greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1", 8)


@query(f"WITH RECURSIVE {EMBED}, {LOW4} SELECT a.ts, a.fid, b.fid AS nfid, count(*) AS contacts FROM c a JOIN c b ON a.ts = b.ts AND a.fid <> b.fid AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL")
def feature_neighbors(spark, d):
    return features.neighbours(embed_features(spark, d, LOW, 4))


@query(f"""WITH RECURSIVE {EMBED}, {LOW4},
rim AS (SELECT a.ts, a.x, a.y, a.fid FROM c a LEFT JOIN c b ON a.ts = b.ts AND a.fid = b.fid AND greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1 GROUP BY ALL HAVING count(b.x) < 8),
near AS (SELECT DISTINCT r.ts, r.x, r.y, r.fid, b.fid AS nfid FROM rim r JOIN c b ON r.ts = b.ts AND r.fid <> b.fid AND abs(r.x - b.x) <= 1 AND abs(r.y - b.y) <= 1)
SELECT ts, fid, nfid, count(*) AS cells FROM near GROUP BY ALL UNION ALL SELECT ts, fid, CAST(-1 AS BIGINT) AS nfid, count(*) AS cells FROM rim ANTI JOIN near USING (ts, x, y, fid) GROUP BY ts, fid""")
def shared_boundary(spark, d):
    return features.shared_boundary(embed_features(spark, d, LOW, 4), 4)


@query(f"WITH RECURSIVE {EMBED}, {LAB8} SELECT ts, x, y, round(v, 6) AS v, fid FROM c SEMI JOIN (SELECT ts, fid FROM c WHERE v >= 0.25) s USING (ts, fid)")
def features_seeded(spark, d):
    field = fields.embeddings(spark, d)
    return rounded(features.seeded(features.find(field, HIGH), field.where("v >= 0.25")))


@query(f"WITH RECURSIVE {EMBED}, {LAB8} SELECT ts, x, y, round(v, 6) AS v, fid FROM c")
def features_merge_adjacent(spark, d):
    return rounded(features.merge_adjacent(embed_features(spark, d, HIGH, 4)))


@query(f"""WITH RECURSIVE {EMBED}, {comps("c", "v >= 0.2", 8)}, s AS (SELECT ts, fid, count(*) AS size FROM c GROUP BY ALL), o AS (SELECT unnest([-1, 0, 1]) AS o),
k AS (SELECT c.ts, CAST(c.x + a.o AS INTEGER) AS x, CAST(c.y + b.o AS INTEGER) AS y, c.fid, sum(CASE WHEN a.o = 0 OR b.o = 0 THEN 1 ELSE 0 END) AS direct, sum(CASE WHEN a.o <> 0 AND b.o <> 0 THEN 1 ELSE 0 END) AS diagonal FROM c, o a, o b WHERE NOT (a.o = 0 AND b.o = 0) AND c.x + a.o BETWEEN 0 AND 7 AND c.y + b.o BETWEEN 0 AND 7 GROUP BY ALL),
n AS (SELECT k.* FROM k ANTI JOIN c USING (ts, x, y)),
w AS (SELECT n.ts, n.x, n.y, n.fid FROM n JOIN s USING (ts, fid) QUALIFY row_number() OVER (PARTITION BY n.ts, n.x, n.y ORDER BY direct DESC, diagonal DESC, size DESC, n.fid) = 1)
SELECT ts, x, y, round(v, 6) AS v, fid FROM c UNION ALL SELECT ts, x, y, CAST(NULL AS DOUBLE) AS v, fid FROM w""")
def features_grow_1(spark, d):
    return rounded(features.grow(embed_features(spark, d, 0.2), NX, NY, 1))


@query()
def features_split_level(spark, d):
    return rounded(features.split(embed_features(spark, d, LOW), 0.2))


@query(f"WITH RECURSIVE {EMBED}, {comps('c', 'v >= 0.05', 8)} SELECT ts, x, y FROM c QUALIFY count(*) OVER (PARTITION BY ts, fid) >= 4")
def cluster_filter(spark, d):
    return features.cluster_filter(fields.embeddings(spark, d).where(F.col("v") >= LOW).select("ts", "x", "y"), 4)


@query(f"WITH {EMBED}, c AS (SELECT * FROM f WHERE v >= 0.2) SELECT f.ts, f.x, f.y, round(min(sqrt((f.x - c.x) * (f.x - c.x) + (f.y - c.y) * (f.y - c.y))), 6) AS dist FROM f JOIN c ON f.ts = c.ts GROUP BY f.ts, f.x, f.y")
def closest_feature_xy(spark, d):
    return rounded(features.distance_to_features(fields.embeddings(spark, d).where("v >= 0.2"), NX, NY))


# ------------------------------------------------------------------ associations

SETS = f"{EMBED}, {comps('a', 'v >= 0.05', 8)}, {comps('b', 'v >= 0.1', 4)}, {comps('z', 'v >= 0.15', 8)}"
AB = "ab AS (SELECT a.ts, a.fid AS fid_a, b.fid AS fid_b, count(*) AS n_overlap FROM a JOIN b USING (ts, x, y) GROUP BY ALL)"
BC = "bc AS (SELECT b.ts, b.fid AS fid_b, z.fid AS fid_c FROM b JOIN z USING (ts, x, y) GROUP BY ALL)"


@query(f"WITH RECURSIVE {SETS}, {AB} SELECT ts, fid_a, fid_b, n_overlap FROM ab")
def assoc_direct(spark, d):
    return association.direct(embed_features(spark, d, LOW, 8), embed_features(spark, d, HIGH, 4))


@query(f"WITH RECURSIVE {SETS}, {AB}, {BC} SELECT ab.ts, fid_a, fid_c, count(DISTINCT ab.fid_b) AS n_via FROM ab JOIN bc ON ab.ts = bc.ts AND ab.fid_b = bc.fid_b GROUP BY ALL")
def assoc_indirect(spark, d):
    a, b, c = embed_features(spark, d, LOW, 8), embed_features(spark, d, HIGH, 4), embed_features(spark, d, 0.15, 8)
    return association.indirect(association.direct(a, b), association.direct(b, c))


CATEGORIES = f"""{EMBED}, {LOW4}, s AS (SELECT ts, fid, count(*) AS n FROM c GROUP BY ALL),
near AS (SELECT DISTINCT a.ts, a.fid, b.fid AS nfid FROM c a JOIN c b ON a.ts = b.ts AND a.fid <> b.fid AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
g AS (SELECT near.ts, near.fid, max(s.n) AS largest FROM near JOIN s ON s.ts = near.ts AND s.fid = near.nfid GROUP BY ALL),
k AS (SELECT s.ts, s.fid, s.n, CASE WHEN n >= 8 THEN 'large' WHEN n >= 4 THEN 'medium' WHEN largest IS NULL THEN 'clutter0' WHEN largest < 8 THEN 'clutter1' ELSE 'small' END AS category FROM s LEFT JOIN g ON s.ts = g.ts AND s.fid = g.fid)"""


@query(f"WITH RECURSIVE {CATEGORIES} SELECT ts, fid, n, category FROM k")
def clutter_categories(spark, d):
    return association.categories(embed_features(spark, d, LOW, 4), 4, 8)


@query(f"""WITH RECURSIVE {CATEGORIES}, st AS (SELECT ts, row_number() OVER (ORDER BY ts) AS seq FROM (SELECT DISTINCT ts FROM f)),
o AS (SELECT c.ts, seq, c.x, c.y, c.fid, k.n, category FROM c JOIN k ON c.ts = k.ts AND c.fid = k.fid JOIN st ON st.ts = c.ts)
SELECT DISTINCT ts, fid FROM (SELECT a.ts, a.fid, b.seq FROM o a JOIN o b ON abs(a.seq - b.seq) = 1 AND a.x = b.x AND a.y = b.y AND b.category = 'large' AND a.category LIKE 'clutter%' GROUP BY a.ts, a.fid, a.n, b.seq HAVING count(*) >= 0.5 * a.n)""")
def temporal_rescue(spark, d):
    cells = embed_features(spark, d, LOW, 4)
    return association.temporal_rescue(cells, association.categories(cells, 4, 8), tracking.steps_of(fields.embeddings(spark, d)), 0.5)


# ------------------------------------------------------------------ tracking

TRACK_CELLS = f"{EMBED}, {LAB8}, st AS (SELECT ts, row_number() OVER (ORDER BY ts) AS seq FROM (SELECT DISTINCT ts FROM f)), u AS (SELECT st.seq, c.* FROM c JOIN st ON c.ts = st.ts)"
MET = "sz AS (SELECT seq, fid, count(*) AS n FROM u GROUP BY ALL), met AS (SELECT o.*, a.n, b.n AS nn FROM (SELECT a.seq, a.fid, b.seq AS nseq, b.fid AS nfid, count(*) AS n_overlap FROM u a JOIN u b ON b.seq = a.seq + 1 AND a.x = b.x AND a.y = b.y GROUP BY ALL) o JOIN sz a ON a.seq = o.seq AND a.fid = o.fid JOIN sz b ON b.seq = o.nseq AND b.fid = o.nfid)"
CAND = """pr AS (SELECT seq, true AS forward, fid AS parent, n AS size, nfid AS c, nn AS cn, n_overlap AS co FROM met UNION ALL SELECT seq, false, nfid, nn, fid, n, n_overlap FROM met),
sub AS (SELECT seq, forward, parent, size, [c] AS ids, [cn] AS ns, [co] AS os FROM pr UNION ALL SELECT s.seq, s.forward, s.parent, s.size, list_append(s.ids, p.c), list_append(s.ns, p.cn), list_append(s.os, p.co) FROM sub s JOIN pr p ON s.seq = p.seq AND s.forward = p.forward AND s.parent = p.parent AND p.c > s.ids[-1] WHERE len(s.ids) < 4),
sc AS (SELECT *, CAST(least(size, list_sum(ns)) AS DOUBLE) / greatest(size, list_sum(ns)) AS p_size, CAST(2 * list_sum(os) AS DOUBLE) / (size + list_sum(ns)) AS p_overlap FROM sub WHERE forward OR len(ids) > 1),
cand AS (SELECT *, CAST(0.5 AS DOUBLE) * p_size + CAST(0.5 AS DOUBLE) * p_overlap AS p_tot FROM sc)"""


def _tracked(spark, d):
    cells = scratch.table(embed_features(spark, d, HIGH, 8), "cells")
    return cells, tracking.steps_of(fields.embeddings(spark, d))


@query(f"WITH RECURSIVE {TRACK_CELLS}, {MET} SELECT seq, fid, nseq, nfid, n_overlap, n, nn FROM met")
def overlap_pairs(spark, d):
    return tracking.overlaps(*_tracked(spark, d))


@query(f"WITH RECURSIVE {TRACK_CELLS}, {MET}, {CAND} SELECT seq, forward, parent, array_to_string(ids, ',') AS children, round(p_size, 6) AS p_size, round(p_overlap, 6) AS p_overlap, round(p_tot, 6) AS p_tot FROM cand")
def successor_probabilities(spark, d):
    found = tracking.candidates(tracking.overlaps(*_tracked(spark, d)))
    ids = F.array_join(F.transform("children", lambda c: c.fid.cast("string")), ",")
    return rounded(found.select("seq", "forward", "parent", ids.alias("children"), "p_size", "p_overlap", "p_tot"))


# the greedy walk as a fold: used features are +(fid + 1) for the earlier step, -(fid + 1) for the later
GREEDY = """rk AS (SELECT *, list_prepend(CASE WHEN forward THEN parent + 1 ELSE -(parent + 1) END, list_transform(ids, lambda c: CASE WHEN forward THEN -(c + 1) ELSE c + 1 END)) AS own,
 row_number() OVER (PARTITION BY seq ORDER BY p_tot DESC, forward, len(ids) DESC, parent DESC, ids DESC) AS k FROM cand WHERE p_tot >= 0.1),
fold AS (SELECT seq, list_reduce(list_prepend({'used': CAST([] AS BIGINT[]), 'acc': CAST([] AS BIGINT[])}, list({'used': own, 'acc': [k]} ORDER BY k)), lambda s, c: CASE WHEN list_has_any(s.used, c.used) THEN s ELSE {'used': list_concat(s.used, c.used), 'acc': list_concat(s.acc, c.acc)} END) AS r FROM rk GROUP BY seq),
won AS (SELECT rk.* FROM rk JOIN (SELECT seq, unnest(r.acc) AS k FROM fold) w ON rk.seq = w.seq AND rk.k = w.k),
one AS (SELECT seq, forward, parent, size, len(ids) AS m, p_tot, p_size, p_overlap, unnest(ids) AS c, unnest(ns) AS cn, unnest(os) AS co FROM won),
al AS (SELECT *, CAST(0.5 AS DOUBLE) * (CAST(least(size, cn) AS DOUBLE) / greatest(size, cn)) + CAST(0.5 AS DOUBLE) * (CAST(2 * co AS DOUBLE) / (size + cn)) AS alone FROM one),
ed AS (SELECT seq, CASE WHEN forward THEN parent ELSE c END AS src, CASE WHEN forward THEN c ELSE parent END AS dst, co AS n_overlap, CASE WHEN m = 1 THEN 1.0 ELSE alone / sum(alone) OVER (PARTITION BY seq, forward, parent) END AS p_share, p_tot, p_size, p_overlap FROM al)"""
VERT = """vx AS (SELECT sz.seq, sz.fid, sz.n, (SELECT count(*) FROM ed WHERE ed.seq + 1 = sz.seq AND ed.dst = sz.fid) AS n_in, (SELECT count(*) FROM ed WHERE ed.seq = sz.seq AND ed.src = sz.fid) AS n_out FROM sz),
vt AS (SELECT *, CASE WHEN n_in = 0 THEN CASE WHEN seq = 1 THEN 'start' ELSE 'genesis' END WHEN n_in = 1 THEN 'continuation' ELSE 'merging' END AS base,
 CASE WHEN n_out > 1 THEN 'splitting' WHEN n_out = 0 THEN CASE WHEN seq = (SELECT max(seq) FROM st) THEN 'stop' ELSE 'lysis' END END AS suffix FROM vx)"""
COMP = """lk AS (SELECT seq * 1099511627776 + src AS a, (seq + 1) * 1099511627776 + dst AS b FROM ed), l2 AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
tr AS (SELECT seq * 1099511627776 + fid AS id, seq * 1099511627776 + fid AS lab FROM sz UNION SELECT l2.b, tr.lab FROM tr JOIN l2 ON l2.a = tr.id WHERE l2.b > tr.lab),
tk AS (SELECT id, min(lab) AS track FROM tr GROUP BY id), own AS (SELECT sz.seq, sz.fid, sz.n, tk.track FROM sz JOIN tk ON tk.id = sz.seq * 1099511627776 + sz.fid)"""
TRACK = f"WITH RECURSIVE {TRACK_CELLS}, {MET}, {CAND}, {GREEDY}, {VERT}, {COMP}"


def _links(spark, d):
    cells, steps = _tracked(spark, d)
    found = scratch.table(tracking.candidates(tracking.overlaps(cells, steps)), "candidates")
    # written once: degrees, components and statistics all read the links
    return cells, steps, scratch.table(tracking.edges(tracking.assign(found, 0.1)), "links")


@query(f"{TRACK} SELECT seq, src, dst, n_overlap, round(p_share, 6) AS p_share, round(p_tot, 6) AS p_tot, round(p_size, 6) AS p_size, round(p_overlap, 6) AS p_overlap FROM ed")
def track_edges(spark, d):
    return rounded(_links(spark, d)[2])


@query(f"{TRACK} SELECT seq, fid, n, n_in, n_out, CASE WHEN suffix IS NULL THEN base WHEN base = 'continuation' THEN suffix ELSE base || '/' || suffix END AS type FROM vt")
def track_types(spark, d):
    return tracking.vertices(*_links(spark, d))


@query(f"{TRACK} SELECT seq, fid, track FROM own")
def track_ids(spark, d):
    cells, steps, links = _links(spark, d)
    return tracking.tracks(tracking.vertices(cells, steps, links), links).select("seq", "fid", "track")


STATS = """pl AS (SELECT own.track, u.seq, u.x, u.y FROM u JOIN own ON u.seq = own.seq AND u.fid = own.fid),
ft AS (SELECT track, count(*) AS footprint_n, max(k) AS max_feature_count FROM (SELECT track, x, y, count(*) AS k FROM pl GROUP BY ALL) GROUP BY track),
pe AS (SELECT track, seq, count(*) AS n, avg(x) AS xm, avg(y) AS ym FROM pl GROUP BY ALL),
mv AS (SELECT *, coalesce(sqrt(pow(xm - lag(xm) OVER w, 2) + pow(ym - lag(ym) OVER w, 2)), 0) AS moved FROM pe WINDOW w AS (PARTITION BY track ORDER BY seq)),
ph AS (SELECT track, count(*) - 1 AS duration, min(seq) AS seq_start, max(seq) AS seq_end, avg(n) AS ts_n_mean, median(n) AS ts_n_median, quantile_cont(n, 0.8) AS ts_n_p80, quantile_cont(n, 0.9) AS ts_n_p90, sum(moved) AS distance FROM mv GROUP BY track),
ns AS (SELECT track, count(*) AS n_features, avg(n) AS n_mean, median(n) AS n_median FROM own GROUP BY track),
ts_ AS (SELECT *, CASE WHEN duration > 0 THEN distance / duration ELSE 0 END AS velocity, CAST(footprint_n AS DOUBLE) / ts_n_p80 AS footprint_n_ts_rel_p80 FROM ph JOIN ft USING (track) JOIN ns USING (track))"""


def _stats(spark, d):
    cells, steps, links = _links(spark, d)
    own = scratch.table(tracking.tracks(tracking.vertices(cells, steps, links), links), "vertices")
    return cells, steps, own, tracking.track_stats(cells, steps, own)


@query(f"{TRACK}, {STATS} SELECT track, duration, seq_start, seq_end, round(ts_n_mean, 5) AS ts_n_mean, round(ts_n_median, 5) AS ts_n_median, round(ts_n_p80, 5) AS ts_n_p80, round(ts_n_p90, 5) AS ts_n_p90, round(distance, 5) AS distance, footprint_n, max_feature_count, n_features, round(n_mean, 5) AS n_mean, round(n_median, 5) AS n_median, round(velocity, 5) AS velocity, round(footprint_n_ts_rel_p80, 5) AS footprint_n_ts_rel_p80 FROM ts_")
def track_stats(spark, d):
    return rounded(_stats(spark, d)[3], 5)


@query(f"{TRACK}, {STATS} SELECT track, CAST(CASE WHEN duration >= 1 AND footprint_n_ts_rel_p80 >= 1.2 THEN 2 ELSE 1 END AS INTEGER) AS grp FROM ts_")
def track_group_split(spark, d):
    return tracking.group(_stats(spark, d)[3], {"duration": 1, "footprint_n_ts_rel_p80": 1.2}).select("track", "grp")


@query(f"{TRACK}, sp AS (SELECT track, min(seq) AS s0, max(seq) - min(seq) AS duration FROM own GROUP BY track) SELECT u.ts, u.x, u.y, own.track, sp.duration, u.seq - sp.s0 AS age FROM u JOIN own ON u.seq = own.seq AND u.fid = own.fid JOIN sp ON sp.track = own.track")
def project_tracks(spark, d):
    cells, steps, own, _ = _stats(spark, d)
    return tracking.project(cells, steps, own)


@query(f"{TRACK} SELECT seq, fid, track, CAST((CASE WHEN seq >= 100 THEN 1 ELSE 0 END) + (CASE WHEN seq >= 300 THEN 1 ELSE 0 END) AS INTEGER) AS period FROM own")
def track_periods(spark, d):
    cells, steps, links = _links(spark, d)
    own = tracking.tracks(tracking.vertices(cells, steps, links), links)
    return tracking.cut_at(own, [100, 300]).select("seq", "fid", "track", "period")


@query(f"WITH RECURSIVE {TRACK_CELLS}, {MET}, p AS (SELECT seq, fid, nfid, greatest((2.0 * n_overlap / (n + nn) - 0.1) / 0.9, 0) AS p_o, greatest(1.9 - CAST(greatest(n, nn) AS DOUBLE) / least(n, nn), 0) / 0.9 AS p_a FROM met) SELECT seq, fid, nfid, round(CAST(p_o AS DOUBLE), 5) AS p_o, round(CAST(p_a AS DOUBLE), 5) AS p_a, round(CAST(0.5 * p_o + 0.5 * p_a AS DOUBLE), 5) AS p FROM p")
def legacy_successor_probability(spark, d):
    return rounded(tracking.legacy_probability(tracking.overlaps(*_tracked(spark, d))), 5)


# ------------------------------------------------------------------ rings, contours, streams


@query(f"""WITH RECURSIVE {EMBED}, {comps("c", "v >= 0.0", 8)} SELECT ts, fid, count(*) AS cells FROM (SELECT a.ts, a.x, a.y, a.fid FROM c a LEFT JOIN c b ON a.ts = b.ts AND a.fid = b.fid AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY ALL HAVING count(b.x) < 4) GROUP BY ALL""")
def feature_ring_cells(spark, d):
    """Distinct cells on the rings of a feature: its boundary."""
    found = rings.rings(embed_features(spark, d, 0.0, 8), 8)
    return found.groupBy("ts", "fid").agg(F.countDistinct("x", "y").alias("cells"))


@query(f"""WITH RECURSIVE {EMBED}, {comps("c", "v >= 0.0", 8)}, h0 AS (SELECT f.ts, f.x, f.y, c.fid FROM f LEFT JOIN c USING (ts, x, y)),
o AS (SELECT DISTINCT c.ts, c.fid, g.x, g.y FROM (SELECT DISTINCT ts, fid FROM c) c, (SELECT a.x, b.y FROM (SELECT unnest(range(-1, 9)) AS x) a, (SELECT unnest(range(-1, 9)) AS y) b) g ANTI JOIN c AS m ON m.ts = c.ts AND m.fid = c.fid AND m.x = g.x AND m.y = g.y),
r AS (SELECT ts, fid, x, y, (x + 1) * 10 + y + 1 AS lab FROM o UNION SELECT b.ts, b.fid, b.x, b.y, a.lab FROM r a JOIN o b ON a.ts = b.ts AND a.fid = b.fid AND abs(a.x - b.x) + abs(a.y - b.y) = 1 WHERE a.lab < (b.x + 1) * 10 + b.y + 1),
k AS (SELECT ts, fid, x, y, min(lab) AS lab FROM r GROUP BY ALL)
SELECT ts, fid, count(DISTINCT lab) - 1 AS n_holes FROM k GROUP BY ALL""")
def feature_holes(spark, d):
    """Holes of a feature, the rings that aren't shells."""
    found = rings.rings(embed_features(spark, d, 0.0, 8), 8).where("seq = 0")
    return found.groupBy("ts", "fid").agg(F.count(F.when(F.col("kind") == "hole", 1)).alias("n_holes"))


LEVELS = [-0.1, -0.05, 0.0]
SETS_SQL = f"""{EMBED}, lv AS (SELECT unnest([0, 1, 2]) AS k, unnest([-0.1, -0.05, 0.0]) AS t), pf AS (SELECT f.ts * 1000 + k AS ts, x, y, v FROM f, lv WHERE v < t),
{comps("w", "true", 8, "pf")}, s AS (SELECT ts // 1000 AS ts, CAST(ts % 1000 AS INTEGER) AS level, x, y, v, fid FROM w),
lo AS (SELECT f.ts, f.x, f.y FROM f JOIN f g ON f.ts = g.ts AND greatest(abs(g.x - f.x), abs(g.y - f.y)) = 1 WHERE f.x BETWEEN 1 AND 6 AND f.y BETWEEN 1 AND 6 GROUP BY f.ts, f.x, f.y, f.v HAVING f.v < min(g.v)),
ct AS (SELECT s.ts, level, fid, count(*) AS n, min(v) AS vmin, bool_and(s.x BETWEEN 1 AND 6 AND s.y BETWEEN 1 AND 6) AS closed, count(lo.x) AS n_minima FROM s LEFT JOIN lo ON s.ts = lo.ts AND s.x = lo.x AND s.y = lo.y GROUP BY ALL),
nt AS (SELECT DISTINCT a.ts, a.level, a.fid, b.fid AS parent FROM s a JOIN s b ON a.ts = b.ts AND b.level = a.level + 1 AND a.x = b.x AND a.y = b.y)"""


def _sets(spark, d):
    field = fields.embeddings(spark, d)
    return field, scratch.table(contours.level_sets(field, LEVELS), "sets")


@query(f"WITH RECURSIVE {SETS_SQL} SELECT ts, level, fid, n, round(vmin, 6) AS vmin, closed, n_minima FROM ct")
def contour_components(spark, d):
    field, sets = _sets(spark, d)
    return rounded(contours.contours(sets, field, NX, NY))


@query(f"WITH RECURSIVE {SETS_SQL} SELECT ts, level, fid, parent FROM nt")
def contour_tree(spark, d):
    return contours.tree(_sets(spark, d)[1])


@query(f"""WITH RECURSIVE {SETS_SQL}, g AS (SELECT * FROM ct WHERE closed AND n_minima BETWEEN 1 AND 3)
SELECT g.ts, g.level, g.fid, g.n, round(CAST(lv.t AS DOUBLE) - g.vmin, 6) AS depth, g.n_minima FROM g JOIN lv ON lv.k = g.level
WHERE NOT EXISTS (SELECT 1 FROM nt JOIN g h ON h.ts = nt.ts AND h.level = nt.level + 1 AND h.fid = nt.parent WHERE nt.ts = g.ts AND nt.level = g.level AND nt.fid = g.fid)""")
def cyclones(spark, d):
    field, sets = _sets(spark, d)
    return rounded(contours.cyclones(contours.contours(sets, field, NX, NY), contours.tree(sets), LEVELS))


@query(SQL["track_edges"])
def stream_track_edges(spark, d):
    found = tracker.track_edges(tracker.embedding_stream(spark, d), HIGH, min_p_tot=0.1)
    return rounded(tracker.run_once(found, "stream-edges"))


@query(SQL["field_events_daily"])
def stream_field_events(spark, d):
    return tracker.run_once(tracker.event_field_stream(spark, d), "stream-events", "complete")


@query()
def track_branches_removed(spark, d):
    cells, steps, links = _links(spark, d)
    own = tracking.tracks(tracking.vertices(cells, steps, links), links)
    return rounded(branches.remove_branches(links, own, 3))


# ------------------------------------------------------------------ further field and feature operators


@query(f"""WITH {EMBED}, t AS (SELECT k, exp(-0.5 * k * k) AS w FROM (SELECT unnest(range(-4, 5)) AS k)), q AS (SELECT k, w / (SELECT sum(w) FROM t) AS w FROM t),
i AS (SELECT c, ((c + k) % 16 + 16) % 16 AS m, w FROM (SELECT unnest(range(8)) AS c), q), j AS (SELECT c, CASE WHEN m < 8 THEN m ELSE 15 - m END AS s, w FROM i),
a AS (SELECT f.ts, j.c AS x, f.y, sum(f.v * j.w) AS v FROM f JOIN j ON j.s = f.x GROUP BY ALL)
SELECT a.ts, CAST(a.x AS INTEGER) AS x, CAST(j.c AS INTEGER) AS y, round(sum(a.v * j.w), 5) AS v FROM a JOIN j ON j.s = a.y GROUP BY ALL""")
def field_smooth(spark, d):
    return rounded(field_ops.smooth(fields.embeddings(spark, d), 1.0, NX, NY), 5)


@query(f"WITH {EMBED} SELECT DISTINCT x, y FROM f WHERE 2 * 6378.137 * asin(sqrt(pow(sin(radians(-40 + y * 0.5 + 38) / 2), 2) + cos(radians(-38)) * cos(radians(-40 + y * 0.5)) * pow(sin(radians(x * 0.5 - 2) / 2), 2))) <= 100")
def circle_mask(spark, d):
    grid = fields.embeddings(spark, d).select("x", "y").distinct()
    return field_ops.circle_mask(grid, fn.great_circle(F.lit(2.0), F.lit(-38.0), F.col("x") * 0.5, -40 + F.col("y") * 0.5), 100.0)


LOWS = f"{EMBED}, lo AS (SELECT f.ts, f.x, f.y, f.v FROM f JOIN f g ON f.ts = g.ts AND greatest(abs(g.x - f.x), abs(g.y - f.y)) = 1 WHERE f.x BETWEEN 1 AND 6 AND f.y BETWEEN 1 AND 6 GROUP BY f.ts, f.x, f.y, f.v HAVING f.v < min(g.v))"


@query(f"WITH {LOWS} SELECT lo.ts, lo.x, lo.y, round(lo.v, 6) AS v FROM lo WHERE lo.x * lo.y * 0.01 < 0.12 AND x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5")
def extrema_filtered(spark, d):
    field = fields.embeddings(spark, d)
    points = field_ops.extrema(field, 8, NX, NY)
    topography = field.withColumn("v", F.col("x") * F.col("y") * 0.01)
    return rounded(field_ops.filter_edge(field_ops.filter_by_field(points, topography, 0.12), 2, NX, NY))


@query(f"WITH RECURSIVE {EMBED}, {LAB8} SELECT ts, x, y, round(0.5 - v, 6) AS v, fid FROM c")
def features_replace_values(spark, d):
    field = fields.embeddings(spark, d)
    return rounded(features.replace_values(features.find(field, HIGH), field_ops.mirror(field, 0.25)))


@query(f"WITH RECURSIVE {EMBED}, {LAB8} SELECT ts, fid, count(*) AS n, count(*) FILTER (v >= 0.2) AS n_mask FROM c GROUP BY ALL")
def features_on_mask(spark, d):
    field = fields.embeddings(spark, d)
    return features.on_mask(features.find(field, HIGH), field.where("v >= 0.2"))


@query(f"""WITH RECURSIVE {EMBED}, {LAB8}, b AS (SELECT ts, fid, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM c GROUP BY ALL)
SELECT a.ts, a.fid, b.fid AS nfid, greatest(a.x0, b.x0) AS xmin, greatest(a.y0, b.y0) AS ymin, least(a.x1, b.x1) AS xmax, least(a.y1, b.y1) AS ymax FROM b a JOIN b ON a.ts = b.ts AND a.fid < b.fid AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1""")
def feature_overlap_bbox(spark, d):
    return features.overlapping_boxes(embed_features(spark, d))


@query(f"""{TRACK}, z AS (SELECT DISTINCT u.seq, u.fid FROM u WHERE u.v >= 0.15)
SELECT track, count(z.fid) AS n_associated, count(DISTINCT z.seq) AS ts_associated FROM own LEFT JOIN z ON z.seq = own.seq AND z.fid = own.fid GROUP BY track""")
def track_associated(spark, d):
    cells, steps, links = _links(spark, d)
    own = tracking.tracks(tracking.vertices(cells, steps, links), links)
    return tracking.associated(own, steps, association.direct(cells, embed_features(spark, d, 0.15)))


from gridtrack.plans import more  # noqa: E402, F401  (registers its queries)
