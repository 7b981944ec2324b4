"""Boundary rings of features: closed pixel paths, shells and holes.

The border between feature and background is a set of unit edges; walking them with the feature on
the left closes every ring.  Where two rings touch in a corner, 8-connectivity turns so as to stay
on the feature, 4-connectivity so as to leave it.  A ring that runs counter-clockwise (positive
area) is a shell, a clockwise one a hole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

DDL = "ts long, fid long, kind string, ring_no int, seq int, x int, y int"


def trace(cells: set[tuple[int, int]], connectivity: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Rings of a set of pixels: kind and the closed path of pixels (first = last, a single pixel once)."""
    # an edge runs from a corner in a direction, its pixel on the left
    edges: dict[tuple[int, int], dict[tuple[int, int], tuple[int, int]]] = {}
    for x, y in cells:
        for out, start, way in (((x, y - 1), (x, y), (1, 0)), ((x + 1, y), (x + 1, y), (0, 1)), ((x, y + 1), (x + 1, y + 1), (-1, 0)), ((x - 1, y), (x, y + 1), (0, -1))):
            if out not in cells:
                edges.setdefault(start, {})[way] = (x, y)
    rings = []
    while edges:
        start = min(edges, key=lambda c: (-c[1], c[0]))
        at, way = start, next(iter(sorted(edges[start])))
        first, path, area = (at, way), [], 0
        while True:
            here = edges[at]
            path.append(here.pop(way))
            if not here:
                del edges[at]
            nxt = (at[0] + way[0], at[1] + way[1])
            area += at[0] * nxt[1] - nxt[0] * at[1]
            left, right = (-way[1], way[0]), (way[1], -way[0])
            turns = (right, way, left) if connectivity == 8 else (left, way, right)
            at = nxt
            if at == first[0] and first[1] not in edges.get(at, {}) and (at not in edges or not any(t in edges[at] for t in turns) or at == first[0]):
                break
            way = next(t for t in turns if t in edges[at])
        pixels = [p for i, p in enumerate(path) if i == 0 or p != path[i - 1]]
        if len(pixels) > 1 and pixels[0] != pixels[-1]:
            pixels.append(pixels[0])
        rings.append(("shell" if area > 0 else "hole", pixels))
    return rings


def rings(cells: DataFrame, connectivity: int = 8) -> DataFrame:
    """``(ts, fid, kind, ring_no, seq, x, y)`` of labelled cells; a step's grid bounds a task."""

    def run(t: pa.Table) -> pa.Table:
        own: dict[tuple[int, int], set] = {}
        for ts, fid, x, y in zip(*(t.column(c).to_pylist() for c in ("ts", "fid", "x", "y")), strict=True):
            own.setdefault((ts, fid), set()).add((x, y))
        out = [(ts, fid, kind, i, s, x, y) for (ts, fid), px in own.items() for i, (kind, path) in enumerate(trace(px, connectivity)) for s, (x, y) in enumerate(path)]
        cols = list(zip(*out, strict=True)) or [()] * 7
        types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        return pa.table([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=["ts", "fid", "kind", "ring_no", "seq", "x", "y"])

    return cells.groupBy("ts").applyInArrow(run, DDL)
