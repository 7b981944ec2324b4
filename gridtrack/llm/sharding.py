"""A reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered 0 ... n-1 in the order of (id, CRC-32 of the text, size).  The numbering is
distributed: id ranges cut at approximate quantiles are counted, the counts' running sums give
each range its offset, and a window numbers the rows of a range.  An id so frequent that it fills
ranges of its own is cut further by CRC; rows that agree in all three are counted before the
shuffle and only expanded at the end.

The permutation works on the mixed-radix square a * b >= n with a = ceil(sqrt(n)): eight
alternating rounds add a keyed hash of one digit to the other.  A value beyond n walks on along
its cycle until it falls inside; as at most a*b - n < a values lie beyond, at most a steps are
needed, and all are taken if need be.  Position q goes to shard q % shards, slot q / shards, so
shard sizes differ by one at most, and both are computable from the row number alone, as
:func:`place` does without Spark.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

ROUNDS = 8
PRIME = 2147483647


def keys(seed: int) -> list[tuple[int, int, int]]:
    """Round constants, spelled from the seed by a multiplicative generator modulo PRIME."""
    x, out = (seed * 48271 + 11) % PRIME or 1, []
    for _ in range(ROUNDS):
        row = []
        for _ in range(3):
            x = x * 48271 % PRIME
            row.append(x)
        out.append(tuple(row))
    return out


def radix(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def place(row: int, n: int, shards: int, seed: int = 42) -> tuple[int, int]:
    """Shard and slot of a row number."""
    a, b = radix(n)
    x = row
    while True:
        left, right = x // b, x % b
        for i, (k1, k2, k3) in enumerate(keys(seed)):
            m = a if i % 2 == 0 else b
            h = ((right if i % 2 == 0 else left) % PRIME * k1 + k2) % PRIME
            h = (h * h + k3) % PRIME
            if i % 2 == 0:
                left = (left + h) % m
            else:
                right = (right + h) % m
        x = left * b + right
        if x < n:
            return x % shards, x // shards


def _step(x: str, n: int, seed: int) -> str:
    """SQL of one pass of all rounds over the expression ``x``, nested by struct-free substitution."""
    a, b = radix(n)
    left, right = f"(({x}) div {b}L)", f"(({x}) % {b}L)"
    text = f"named_struct('l', {left}, 'r', {right})"
    for i, (k1, k2, k3) in enumerate(keys(seed)):
        src, dst, m = ("r", "l", a) if i % 2 == 0 else ("l", "r", b)
        h = f"((s.{src} % {PRIME}L * {k1}L + {k2}L) % {PRIME}L)"
        new = f"((s.{dst} + (pow2({h}) + {k3}L) % {PRIME}L) % {m}L)"
        text = f"transform(array({text}), s -> named_struct('l', {new if dst == 'l' else 's.l'}, 'r', {new if dst == 'r' else 's.r'}))[0]"
        text = text.replace(f"pow2({h})", f"{h} * {h}")
    return f"transform(array({text}), s -> s.l * {b}L + s.r)[0]"


def _permuted(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Adds ``q``, the permuted ``row``.  The rounds are plain columns, so they are compiled."""
    a, b = radix(n)
    df = df.withColumns({"_l": F.expr(f"row div {b}L"), "_r": F.expr(f"row % {b}L")})
    for i, (k1, k2, k3) in enumerate(keys(seed)):
        src, dst, m = ("_r", "_l", a) if i % 2 == 0 else ("_l", "_r", b)
        df = df.withColumn("_h", F.expr(f"({src} % {PRIME}L * {k1}L + {k2}L) % {PRIME}L"))
        df = df.withColumn(dst, F.expr(f"({dst} + (_h * _h + {k3}L) % {PRIME}L) % {m}L"))
    df = df.withColumn("q", F.expr(f"_l * {b}L + _r"))
    again = _step("x", n, seed)
    walk = f"CASE WHEN q < {n}L THEN q ELSE aggregate(sequence(1, {a}), q, (x, i) -> CASE WHEN x < {n}L THEN x ELSE {again} END) END"
    return df.withColumn("q", F.expr(walk)).drop("_l", "_r", "_h")


def numbered(rows: DataFrame, ranges: int = 256) -> tuple[DataFrame, int]:
    """``rows(doc_id, text_crc32, size)`` with ``row``, the global row number, and the row count."""
    ids = F.col("doc_id")
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("c"), F.count("*").alias("n")).first()
    n, cuts = cuts["n"], cuts["c"] or []
    twice = sorted({x for x, y in zip(cuts, cuts[1:], strict=False) if x == y})
    cuts = sorted(set(cuts))
    lit: Column = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.expr("cast(array() as array<long>)")
    # the number of cuts below the id; nulls come first, in a range of their own that is cut by CRC
    span = F.when(ids.isNull(), F.lit(-1)).otherwise(F.size(F.filter(lit, lambda c: c < ids)) if cuts else F.lit(0))
    fine = (ids.isin(twice) | ids.isNull()) if twice else ids.isNull()
    # an id among the doubled cuts gets a range of its own, after the rest of the range it ends
    counted = rows.groupBy("doc_id", "text_crc32", "size").agg(F.count("*").alias("copies"))
    counted = counted.withColumns({"span": span.cast("long") * 2 + F.when(fine, 1).otherwise(0), "part": F.when(fine, F.expr("text_crc32 div 16777216")).otherwise(F.lit(0).cast("long"))})
    sums = counted.groupBy("span", "part").agg(F.sum("copies").alias("total"))
    ahead = Window.orderBy("span", "part").rowsBetween(Window.unboundedPreceding, -1)  # at most ranges * 256 rows
    offsets = sums.select("span", "part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("span", "part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    begun = counted.withColumn("begin", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(F.broadcast(offsets), ["span", "part"])
    whole = begun.withColumn("row", F.explode(F.expr("sequence(ahead + begin, ahead + begin + copies - 1)")))
    return whole.select("doc_id", "text_crc32", "size", "row"), n


def shard(docs: DataFrame, shards: int = 40, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, row, shard, slot)`` for every row of ``docs``.

    size is the text's UTF-8 length plus 16; a null text counts as empty.  Null ids are numbered
    first.  Rows that agree in id, CRC and size are interchangeable and get neighbouring row
    numbers.  Fewer rows than shards leave shards empty; an empty table gives no rows.
    """
    raw = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"").cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.crc32(raw).alias("text_crc32"), (F.octet_length(raw).cast("long") + 16).alias("size"))
    rows, n = numbered(rows)
    out = _permuted(rows, n, seed)
    return out.select("doc_id", "size", "text_crc32", "row", F.expr(f"cast(q % {shards} as int)").alias("shard"), F.expr(f"q div {shards}").alias("slot"))

