"""The tracker over a stream of field rows.

The state of a domain is the last processed step: its number, its time and its feature cells, so
it is bounded by one grid.  A step's rows arrive in one micro-batch; rows of steps at or before the
last processed one are late and dropped, as the batch tracker takes steps in order.  Steps without
features still count.  Emitted edges equal those of the batch tracker.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridtrack import scratch
from gridtrack.operators.features import ROW, _labels
from gridtrack.sources import fields

EDGES = "seq long, src long, dst long, n_overlap long, p_share double, p_tot double, p_size double, p_overlap double"


def label_step(x: np.ndarray, y: np.ndarray, connectivity: int) -> pd.Series:
    """Feature ids of a step's cells, by cell number."""
    ids = np.unique(x.astype(np.int64) * ROW + y)
    return pd.Series(_labels(ids, connectivity) if len(ids) else ids, index=ids)


def score(size: int, child: int, shared: int, alpha: float) -> tuple[float, float, float]:
    p_size, p_overlap = min(size, child) / max(size, child), 2.0 * shared / (size + child)
    return p_size, p_overlap, (1 - alpha) * p_size + alpha * p_overlap


def link(old: pd.Series, new: pd.Series, alpha: float, max_children: int, min_p_tot: float) -> list[tuple]:
    """Edges between two labelled steps, by the batch tracker's rules."""
    both = old.index.intersection(new.index)
    met = pd.DataFrame({"a": old.loc[both].to_numpy(), "b": new.loc[both].to_numpy()}).value_counts()
    n_old, n_new = old.value_counts(), new.value_counts()
    fwd: dict[int, list] = {}
    bwd: dict[int, list] = {}
    for (a, b), n in met.items():
        fwd.setdefault(a, []).append((b, int(n_new[b]), int(n)))
        bwd.setdefault(b, []).append((a, int(n_old[a]), int(n)))
    found = []
    for forward, partners, sizes, least in ((True, fwd, n_old, 1), (False, bwd, n_new, 2)):
        for p, own in partners.items():
            own.sort()
            size = int(sizes[p])
            for k in range(least, min(max_children, len(own)) + 1):
                for some in combinations(own, k):
                    s = score(size, sum(c[1] for c in some), sum(c[2] for c in some), alpha)
                    if s[2] >= min_p_tot:
                        found.append((s[2], not forward, k, p, tuple(c[0] for c in some), some, size, s))
    found.sort(key=lambda c: c[:5], reverse=True)
    used: set = set()
    out = []
    for _, backward, k, p, ids, some, size, s in found:
        own = {(not backward, p), *((backward, c) for c in ids)}
        if own & used:
            continue
        used |= own
        alone = [score(size, c[1], c[2], alpha)[2] for c in some]
        for c, z in zip(some, alone, strict=True):
            src, dst = (c[0], p) if backward else (p, c[0])
            out.append((int(src), int(dst), c[2], 1.0 if k == 1 else z / sum(alone), s[2], s[0], s[1]))
    return out


def track_edges(field: DataFrame, threshold: float, connectivity: int = 8, alpha: float = 0.5, max_children: int = 4, min_p_tot: float = 0.0) -> DataFrame:
    """A streaming DataFrame of edges from a streaming field ``(domain, ts, x, y, v)``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, last, cells = (0, None, b"") if not state.exists else state.get
        old = pickle.loads(cells) if cells else None
        rows = pd.concat(list(batches), ignore_index=True)
        out = []
        for ts, own in rows.groupby("ts", sort=True):
            if last is not None and ts <= last:
                continue
            hit = own[own["v"] >= threshold]
            new = label_step(hit["x"].to_numpy(), hit["y"].to_numpy(), connectivity)
            if old is not None:
                out += [(seq, *e) for e in link(old, new, alpha, max_children, min_p_tot)]
            seq, last, old = seq + 1, int(ts), new
        state.update((seq, last, pickle.dumps(old)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EDGES.split(", ")])

    return field.groupBy("domain").applyInPandasWithState(step, EDGES, "seq long, last long, cells binary", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all available input into a table in the shared folder, with a checkpoint there."""
    spark = stream.sparkSession
    where = f"{scratch.folder(spark)}/{name}-{id(stream):x}-{spark.sparkContext.startTime}"
    if mode == "append":
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{where}/checkpoint").option("path", f"{where}/out").trigger(availableNow=True).start().awaitTermination()
    else:
        write = lambda df, _: df.write.mode("overwrite").parquet(f"{where}/out")
        stream.writeStream.outputMode("complete").option("checkpointLocation", f"{where}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def parquet_stream(spark: SparkSession, schema: str, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    whole = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(f"{sf_dir}/{name}.parquet") if whole else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def embedding_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as a stream of 8 x 8 field rows."""
    raw = parquet_stream(spark, "vec_id long, embedding array<float>", sf_dir, "embeddings")
    flat = raw.select(F.col("vec_id").alias("ts"), F.posexplode("embedding").alias("i", "e"))
    return flat.select(F.lit(0).alias("domain"), "ts", (F.col("i") % 8).cast("int").alias("x"), F.expr("cast(i div 8 as int)").alias("y"), F.col("e").cast("double").alias("v"))


def event_field_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily event field as a running aggregate over a stream of events, late by at most 40 days."""
    raw = parquet_stream(spark, "event_id long, ts timestamp, user_id long, event_type string, value double", sf_dir, "events")
    day = F.window(F.col("ts").alias("t"), "1 day").alias("w")
    summed = raw.withWatermark("ts", "40 days").groupBy(day, F.hour("ts").alias("x"), F.col("user_id").cast("int").alias("y")).agg(F.round(F.sum("value"), 6).alias("v"))
    return summed.select(F.date_format("w.start", "yyyyMMdd").cast("long").alias("ts"), "x", "y", "v").select(*fields.FIELD)
