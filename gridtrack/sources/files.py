"""Files of other formats: NPZ fields and masks, feature and track JSON, INI settings, file names with timesteps.

NPZ files are read by Spark as binary rows and opened where they lie, a file a row, so a period of
many files is read by many tasks; netCDF and HDF5 need libraries that are not here.
"""

from __future__ import annotations

import configparser
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FIELD_DDL = "ts long, x int, y int, v double"


def timestep_of(path: str, template: str) -> int | None:
    """The timestep in a file name: ``template`` has {YYYY}, {MM}, {DD}, {HH}, {NN} where its digits stand."""
    keys = re.findall(r"\{(YYYY|MM|DD|HH|NN)\}", template)
    pattern = re.sub(r"\\\{(YYYY|MM|DD|HH|NN)\\\}", lambda m: r"(\d{4})" if m[1] == "YYYY" else r"(\d{2})", re.escape(template))
    found = re.search(pattern + "$", path)
    if not found:
        return None
    part = dict(zip(keys, found.groups(), strict=True))
    return int("".join(part[k] for k in ("YYYY", "MM", "DD", "HH", "NN") if k in part))


def file_names(template: str, timesteps: list[int]) -> list[str]:
    """File names of timesteps ``YYYYMM[DD[HH[NN]]]``, the inverse of :func:`timestep_of`."""
    out = []
    for ts in timesteps:
        s = str(ts)
        part = {"YYYY": s[:4], "MM": s[4:6], "DD": s[6:8], "HH": s[8:10], "NN": s[10:12]}
        out.append(re.sub(r"\{(YYYY|MM|DD|HH|NN)\}", lambda m: part[m[1]], template))
    return out


def related(first: dict[str, list[int]], second: dict[str, list[int]]) -> dict[str, list[str]]:
    """For each file of ``first``, the files of ``second`` that share one of its timesteps."""
    return {a: [b for b, theirs in second.items() if set(own) & set(theirs)] for a, own in first.items()}


def _plane(array: np.ndarray, level: int | None) -> np.ndarray:
    """Two dimensions ``[x, y]`` of an array: a leading time of one goes, then a level is taken."""
    a = np.asarray(np.ma.filled(array, np.nan) if np.ma.isMaskedArray(array) else array, float)
    while a.ndim > 3 or (a.ndim == 3 and level is None and a.shape[0] == 1):
        a = a[0]
    if a.ndim == 3:
        a = a[level or 0]
    return a


def read_npz(spark: SparkSession, paths: str | list[str], name: str, template: str, level: int | None = None, transpose: bool = False, mirror: bool = False, stride: int = 1, mode: str = "mean", factor: float = 1.0, crop: int = 0) -> DataFrame:
    """``(ts, x, y, v)`` of an array ``name`` of NPZ files whose names hold the timestep.

    In this order: level, reduction by ``stride`` (``mean`` of boxes or their centre, ``pick``),
    transposition, sign, factor, and ``crop`` cells off each edge.  Cells without a value (NaN) are
    left out; a file without the array or a timestep is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ts = timestep_of(path, template)
                if ts is None:
                    raise ValueError(f"no timestep in {path}")
                with np.load(io.BytesIO(raw.as_py())) as found:
                    a = _plane(found[name], level)
                if stride > 1:
                    nx, ny = a.shape[0] // stride, a.shape[1] // stride
                    boxes = a[: nx * stride, : ny * stride].reshape(nx, stride, ny, stride)
                    a = boxes.mean(axis=(1, 3)) if mode == "mean" else boxes[:, stride // 2, :, stride // 2]
                if transpose:
                    a = a.T
                a = (-a if mirror else a) * factor
                if crop:
                    a = a[crop:-crop, crop:-crop]
                x, y = np.nonzero(~np.isnan(a))
                yield pa.record_batch([pa.array(np.full(len(x), ts, np.int64)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(a[x, y])], names=["ts", "x", "y", "v"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, FIELD_DDL)


def read_npz_points(spark: SparkSession, paths: str | list[str], name: str, template: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``(ts, ord, lon, lat, v)`` of point lists in NPZ files; no points give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with np.load(io.BytesIO(raw.as_py())) as found:
                    own = [np.asarray(found[k], float).ravel() for k in (lon, lat, name)]
                n = len(own[0])
                yield pa.record_batch([pa.array(np.full(n, timestep_of(path, template) or 0, np.int64)), pa.array(np.arange(n, dtype=np.int64)), *map(pa.array, own)], names=["ts", "ord", "lon", "lat", "v"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "ts long, ord long, lon double, lat double, v double")


def read_npz_rings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(id, ring, kind, seq, lon, lat)`` of masks: arrays ``<name>_shell_<i>`` and ``<name>_hole_<i>`` of two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                with np.load(io.BytesIO(raw.as_py())) as found:
                    for i, key in enumerate(sorted(found.files)):
                        m = re.fullmatch(r"(.+)_(shell|hole)_\d+", key)
                        if m:
                            p = np.asarray(found[key], float).reshape(-1, 2)
                            n = len(p)
                            yield pa.record_batch([pa.array([m[1]] * n), pa.array([i] * n, pa.int32()), pa.array([m[2]] * n), pa.array(range(n), pa.int32()), pa.array(p[:, 0]), pa.array(p[:, 1])], names=["id", "ring", "kind", "seq", "lon", "lat"])

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(run, "id string, ring int, kind string, seq int, lon double, lat double")


def write_npz(field: DataFrame, folder: str, name: str, nx: int, ny: int) -> None:
    """One NPZ file a timestep below a folder that all executors share, ``<ts>.npz``; missing cells are NaN."""
    import os

    def put(key: tuple, t: pa.Table) -> pa.Table:
        a = np.full((nx, ny), np.nan)
        a[t.column("x").to_numpy(), t.column("y").to_numpy()] = t.column("v").to_numpy()
        os.makedirs(folder, exist_ok=True)
        np.savez_compressed(f"{folder}/{key[0].as_py()}.npz", **{name: a})
        return pa.table({"ts": pa.array([key[0].as_py()], pa.int64())})

    field.groupBy("ts").applyInArrow(put, "ts long").count()


# ------------------------------------------------------------------ JSON

FEATURE = "id long, timestep long, center array<int>, stats struct<n: long, min: double, max: double, mean: double, median: double, sum: double>, neighbors array<long>, pixels array<array<int>>, values array<double>"
TRACK = "id long, timesteps array<long>, features array<long>, n_features long, duration long, edges array<struct<src: long, dst: long, seq: long, p_tot: double, p_share: double>>"


def feature_records(cells: DataFrame, stats: DataFrame, near: DataFrame | None = None, pixels: bool = True) -> DataFrame:
    """A row a feature, as its JSON record: id, timestep, center, stats, neighbours, and its cells if asked for.

    The cells are merged in and not broadcast: a file of them is a fraction of their size in memory.
    """
    own = stats.select("ts", "fid", F.array("xc", "yc").alias("center"), F.struct("n", "min", "max", "mean", "median", "sum").alias("stats"))
    if near is None:
        own = own.withColumn("neighbors", F.lit(None).cast("array<long>"))
    else:
        own = own.join(near.groupBy("ts", "fid").agg(F.array_sort(F.collect_set("nfid")).alias("neighbors")).hint("merge"), ["ts", "fid"], "left")
    if pixels:
        p = cells.groupBy("ts", "fid").agg(F.array_sort(F.collect_list(F.struct("x", "y", "v"))).alias("p"))  # of one feature
        own = own.join(p.hint("merge"), ["ts", "fid"]).withColumns({"pixels": F.transform("p", lambda c: F.array(c.x, c.y)), "values": F.transform("p", lambda c: c.v)})
    else:
        own = own.withColumns({"pixels": F.lit(None).cast("array<array<int>>"), "values": F.lit(None).cast("array<double>")})
    return own.select(F.col("fid").alias("id"), F.col("ts").alias("timestep"), "center", "stats", "neighbors", "pixels", "values")


def track_records(own: DataFrame, links: DataFrame, edges: bool = True) -> DataFrame:
    """A row a track, as its JSON record: its steps, features, counts, and its graph if asked for."""
    v = own.groupBy("track").agg(F.array_sort(F.collect_set("seq")).alias("timesteps"), F.array_sort(F.collect_list("fid")).alias("features"), F.count("*").alias("n_features"), (F.countDistinct("seq") - 1).alias("duration"))
    if edges:
        member = own.select("seq", F.col("fid").alias("src"), "track")
        e = links.join(member, ["seq", "src"]).groupBy("track").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "seq", "p_tot", "p_share"))).alias("edges"))
        v = v.join(e, "track", "left")
    else:
        v = v.withColumn("edges", F.lit(None).cast("array<struct<src: long, dst: long, seq: long, p_tot: double, p_share: double>>"))
    return v.withColumnRenamed("track", "id")


def write_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A record a line of JSON."""
    records.select(F.to_json(F.struct(*records.columns)).alias("value")).write.mode(mode).text(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of that schema (FEATURE, TRACK or of one's own); a line that is none is an error."""
    return spark.read.text(path).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def features_of(records: DataFrame, minsize: int = 1, maxsize: int | None = None, timesteps: list[int] | None = None) -> DataFrame:
    """Cells ``(ts, x, y, v, fid)`` of feature records of a size and of timesteps."""
    ok = F.col("stats.n") >= minsize
    if maxsize is not None:
        ok &= F.col("stats.n") <= maxsize
    if timesteps is not None:
        ok &= F.col("timestep").isin(timesteps)
    p = records.where(ok).select("timestep", "id", F.explode(F.arrays_zip("pixels", "values")).alias("c"))
    return p.select(F.col("timestep").alias("ts"), F.col("c.pixels")[0].alias("x"), F.col("c.pixels")[1].alias("y"), F.col("c.values").alias("v"), F.col("id").alias("fid"))


def links_of(records: DataFrame, zero_share: bool = True) -> DataFrame:
    """Edges of track records; without ``zero_share`` those of a share of 0 are left out."""
    e = records.select(F.col("id").alias("track"), F.explode("edges").alias("e")).select("track", "e.*")
    return e if zero_share else e.where("p_share > 0")


def select_features(cells: DataFrame, own: DataFrame, ts_start: int, ts_end: int, tracked_only: bool) -> DataFrame:
    """Features of a period; those outside stay if a track has them, and with ``tracked_only`` others go. ``own(ts, fid)``."""
    member = own.select("ts", "fid").distinct().withColumn("_t", F.lit(1))
    met = cells.join(member, ["ts", "fid"], "left")
    inside, tracked = F.col("ts").between(ts_start, ts_end), F.col("_t").isNotNull()
    return met.where(tracked if tracked_only else inside | tracked).drop("_t")


# ------------------------------------------------------------------ settings


def typed(value: str) -> object:
    """An option's value: none, a truth value, a number, a list of such, or text."""
    v = value.strip()
    if v.lower() in ("", "none"):
        return None
    if v.lower() in ("true", "yes", "on", "false", "no", "off"):
        return v.lower() in ("true", "yes", "on")
    for kind in (int, float):
        try:
            return kind(v)
        except ValueError:
            pass
    return [typed(x) for x in v.split(",")] if "," in v else v


def read_settings(text: str) -> dict[str, dict[str, object]]:
    """Sections and typed options of INI text."""
    parser = configparser.ConfigParser()
    parser.read_string(text)
    return {s: {k: typed(v) for k, v in parser[s].items()} for s in parser.sections()}


def merge_settings(every: list[dict[str, dict[str, object]]]) -> dict[str, dict[str, object]]:
    """Settings one after the other; of an option the last."""
    out: dict[str, dict[str, object]] = {}
    for one in every:
        for section, options in one.items():
            out.setdefault(section, {}).update(options)
    return out


def write_settings(settings: dict[str, dict[str, object]]) -> str:
    """INI text that :func:`read_settings` reads back."""
    lines = []
    for section, options in settings.items():
        lines.append(f"[{section}]")
        lines += [f"{k} = {', '.join(map(str, v)) if isinstance(v, list) else '' if v is None else v}" for k, v in options.items()]
        lines.append("")
    return "\n".join(lines)


def find_settings(names: list[str], priorities: list[str]) -> str | None:
    """The INI file to take: the first of the priorities that is there, else the only one, else none."""
    for p in priorities:
        if p in names:
            return p
    own = [n for n in names if n.endswith(".ini")]
    return own[0] if len(own) == 1 else None


def options_with(options: dict[str, object], prefix: str) -> dict[str, object]:
    """The options whose name begins with a prefix and an underscore, without it."""
    return {k[len(prefix) + 1 :]: v for k, v in options.items() if k.startswith(f"{prefix}_")}


def plain(text: Column) -> Column:
    """Text without accents on Latin letters."""
    accented, base = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
    return F.translate(text, accented, base)
