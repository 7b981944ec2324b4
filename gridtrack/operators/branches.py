"""Branch removal: short side branches of tracks stay, long ones become tracks of their own.

At a splitting the edge with the largest p_tot (then overlap, then smaller end) is the main one.
Another edge stays if its branch ends within ``n - 2`` steps, or meets the main branch again
within ``n`` steps; else it is cut.  Splittings first, then mergings, which are splittings of the
graph read backwards.  A track is the unit of work.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridtrack.operators.tracking import vertex


def reach(nexts: dict[int, list[int]], start: int, steps: int) -> tuple[set[int], int]:
    """Vertices within ``steps`` of start, start included, and how many steps the longest path takes (steps + 1: further)."""
    seen, front, depth = {start}, {start}, 0
    while front and depth <= steps:
        front = {b for a in front for b in nexts.get(a, ())}
        if not front:
            return seen, depth
        depth += 1
        if depth <= steps:
            seen |= front
    return seen, depth


def prune(edges: list[tuple[int, int, float, int]], n: int) -> list[int]:
    """Positions of the edges ``(src, dst, p_tot, n_overlap)`` that stay."""
    if n < 0:
        return list(range(len(edges)))
    kept = set(range(len(edges)))
    for back in (False, True):
        out: dict[int, list[int]] = {}
        for i in kept:
            out.setdefault(edges[i][1 if back else 0], []).append(i)
        cut = set()
        for _, own in sorted(out.items()):
            if len(own) < 2:
                continue
            nexts: dict[int, list[int]] = {}
            for i in kept - cut:
                a, b = edges[i][:2][::-1] if back else edges[i][:2]
                nexts.setdefault(a, []).append(b)
            end = lambda i: edges[i][0 if back else 1]  # noqa: B023, E731
            own = sorted(own, key=lambda i: (-edges[i][2], -edges[i][3], end(i)))
            main, _ = reach(nexts, end(own[0]), n)
            for i in own[1:]:
                side, length = reach(nexts, end(i), n)
                if length > max(n - 2, 0) and not side & main or n == 0:
                    cut.add(i)
        kept -= cut
    return sorted(kept)


def remove_branches(links: DataFrame, own: DataFrame, n: int) -> DataFrame:
    """The edges that stay; ``own(seq, fid, track)`` names the tracks.  Negative n keeps all edges."""
    member = own.select("seq", F.col("fid").alias("src"), "track")
    named = links.join(member, ["seq", "src"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"]).reset_index(drop=True)
        rows = list(zip(pdf["a"], pdf["b"], pdf["p_tot"], pdf["n_overlap"], strict=True))
        return pdf.loc[prune(rows, n), ["seq", "src", "dst", "track"]]

    slim = named.select("track", "seq", "src", "dst", "p_tot", "n_overlap", vertex(F.col("seq"), F.col("src")).alias("a"), vertex(F.col("seq") + 1, F.col("dst")).alias("b"))
    stay = slim.groupBy("track").applyInPandas(run, "seq long, src long, dst long, track long")
    return links.join(stay.select("seq", "src", "dst"), ["seq", "src", "dst"], "left_semi")
