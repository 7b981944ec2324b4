"""Command-line programs: identify, track, group and project, over Parquet tables.

    python -m gridtrack.plans.cli identify --field F --out FEATURES --lower 0.1
    python -m gridtrack.plans.cli track    --features FEATURES --out TRACKS
    python -m gridtrack.plans.cli group    --tracks TRACKS --out GROUPS --least duration=4
    python -m gridtrack.plans.cli project  --tracks TRACKS --out RASTERS

A tracks folder holds the tables cells, steps, vertices, edges and stats; stats also go out as JSON.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from gridtrack.operators import features, tracking
from gridtrack.sources import fields


def identify(spark: SparkSession, a: argparse.Namespace) -> None:
    field = fields.read(spark, a.field, a.level, a.ts_min, a.ts_max)
    found = features.find(field, a.lower, a.upper, a.connectivity, a.minsize, a.maxsize)
    if a.split is not None:
        found = features.split(found, a.split, a.connectivity)
    fields.write(found, f"{a.out}/cells")
    fields.write(tracking.steps_of(field), f"{a.out}/steps")
    fields.write(features.stats(spark.read.parquet(f"{a.out}/cells")), f"{a.out}/features")


def track(spark: SparkSession, a: argparse.Namespace) -> None:
    cells, steps = spark.read.parquet(f"{a.features}/cells"), spark.read.parquet(f"{a.features}/steps")
    own, links = tracking.track(cells, steps, a.alpha, a.max_children, a.min_p_size, a.min_p_overlap, a.min_p_tot)
    fields.write(cells, f"{a.out}/cells")
    fields.write(steps, f"{a.out}/steps")
    fields.write(own, f"{a.out}/vertices")
    fields.write(links, f"{a.out}/edges")
    stats = tracking.track_stats(cells, steps, spark.read.parquet(f"{a.out}/vertices"))
    stats = stats.where(stats["duration"] >= a.min_duration)
    fields.write(stats, f"{a.out}/stats")
    spark.read.parquet(f"{a.out}/stats").write.mode("overwrite").json(f"{a.out}/stats-json")


def group(spark: SparkSession, a: argparse.Namespace) -> None:
    criteria = {k: float(v) for k, v in (x.split("=") for x in a.least)}
    fields.write(tracking.group(spark.read.parquet(f"{a.tracks}/stats"), criteria), a.out, by="grp")


def project(spark: SparkSession, a: argparse.Namespace) -> None:
    cells, steps, own = (spark.read.parquet(f"{a.tracks}/{t}") for t in ("cells", "steps", "vertices"))
    fields.write(tracking.project(cells, steps, own), a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridtrack")
    sub = top.add_subparsers(required=True)
    p = sub.add_parser("identify")
    p.set_defaults(run=identify)
    p.add_argument("--field", required=True)
    p.add_argument("--out", required=True)
    for name in ("lower", "upper", "split"):
        p.add_argument(f"--{name}", type=float)
    for name in ("level", "ts-min", "ts-max", "maxsize"):
        p.add_argument(f"--{name}", type=int)
    p.add_argument("--minsize", type=int, default=1)
    p.add_argument("--connectivity", type=int, choices=(4, 8), default=4)
    p = sub.add_parser("track")
    p.set_defaults(run=track)
    p.add_argument("--features", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--alpha", type=float, default=0.5)
    p.add_argument("--max-children", type=int, default=4)
    for name in ("min-p-size", "min-p-overlap", "min-p-tot"):
        p.add_argument(f"--{name}", type=float, default=0.0)
    p.add_argument("--min-duration", type=int, default=0)
    p = sub.add_parser("group")
    p.set_defaults(run=group)
    p.add_argument("--tracks", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--least", action="append", default=[], metavar="NAME=VALUE")
    p = sub.add_parser("project")
    p.set_defaults(run=project)
    p.add_argument("--tracks", required=True)
    p.add_argument("--out", required=True)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(spark or SparkSession.builder.appName("gridtrack").getOrCreate(), a)


if __name__ == "__main__":
    main()
