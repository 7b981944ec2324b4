"""The registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridtrack.llm import bpe, hilbert_ann, license_scan, packing, pitman_yor, quality, sharding, simhash, suffix, toxicity
from gridtrack.llm.common import documents, read

PASSAGE = 51
Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op3_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.search(read(spark, sf_dir, "embeddings"), "id % 20 = 0")


def learned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label rows that may be learned from: CRC-32 of the id as text, modulo 4, is not 2."""
    return read(spark, sf_dir, "labels").select("doc_id", "toxic").where(f"NOT {HELD_OUT}")


HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)"


def op4_nearest_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, learned_labels(spark, sf_dir))
    found = toxicity.apply(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


def op5_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that repeat; and, counted only, runs of PASSAGE words and more that repeat."""
    found = suffix.remove(documents(spark, sf_dir), words=PASSAGE, cut_words=False)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end=2)


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = "coalesce(crc32(cast(doc_id as string)) % 10 = 0, false)"
    found = pitman_yor.score(docs, docs.where(f"NOT {held}")).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.expr(held).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_perplexity_rules, op2_license_scan, op3_hilbert_neighbours, op4_nearest_toxic, op5_bpe_transducer, op6_suffix_array, op7_simhash, op8_feistel_shards, op9_online_packing, op10_pitman_yor)}


WINDOWS_SQL = f"""
WITH h AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id, i, hash(b[i + 1:i + {suffix.WIDTH}]) AS k FROM (SELECT doc_id, b, unnest(range(n - {suffix.WIDTH - 1})) AS i FROM h WHERE n >= {suffix.WIDTH})),
s AS (SELECT doc_id, i FROM p WHERE k IN (SELECT k FROM p GROUP BY k HAVING count(*) > 1)),
j AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {suffix.WIDTH} THEN 0 ELSE 1 END AS new FROM s),
q AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM j),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + {suffix.WIDTH} AS hi FROM q GROUP BY doc_id, r),
g AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM runs),
t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), x -> x <> '') AS w FROM documents),
wp AS (SELECT doc_id, i, hash(w[i + 1:i + {PASSAGE}]) AS k FROM (SELECT doc_id, w, unnest(range(len(w) - {PASSAGE - 1})) AS i FROM t WHERE len(w) >= {PASSAGE})),
ws AS (SELECT doc_id, i FROM wp WHERE k IN (SELECT k FROM wp GROUP BY k HAVING count(*) > 1)),
wj AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {PASSAGE} THEN 0 ELSE 1 END AS new FROM ws),
wq AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM wj),
wr AS (SELECT doc_id, count(*) AS n_passages, sum(n) AS n_passage_words FROM (SELECT doc_id, r, max(i) + {PASSAGE} - min(i) AS n FROM wq GROUP BY doc_id, r) GROUP BY doc_id),
c AS (SELECT g.doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head, max(hi) AS last FROM g JOIN h USING (doc_id) GROUP BY g.doc_id)
SELECT h.doc_id, h.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h.h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256,
  CAST(coalesce(n_passages, 0) AS BIGINT) AS n_passages, CAST(coalesce(n_passage_words, 0) AS BIGINT) AS n_passage_words
FROM h LEFT JOIN c USING (doc_id) LEFT JOIN wr USING (doc_id)"""


def shards_sql(shards: int = 40, seed: int = 42) -> str:
    """The Feistel walk as a recursive query; CRC-32 by its polynomial, a byte a step."""
    left, right = "l0", "r0"
    step = "SELECT row, n, a, b, x // b AS l0, x % b AS r0 FROM w WHERE first OR x >= n"
    for i, (k1, k2, k3) in enumerate(sharding.keys(seed)):
        even = i % 2 == 0
        src, dst, m, keep, name = (right, left, "a", right, f"l{i + 1}") if even else (left, right, "b", left, f"r{i + 1}")
        h = f"(({src} % {sharding.PRIME} * {k1} + {k2}) % {sharding.PRIME})"
        step = f"SELECT row, n, a, b, {keep}, ({dst} + ({h} * {h} + {k3}) % {sharding.PRIME}) % {m} AS {name} FROM ({step})"
        left, right = (name, right) if even else (left, name)
    return f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
bytes AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents),
d AS (SELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, tab),
c AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM documents),
g AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row FROM d),
w AS (SELECT row, n, a, (n + a - 1) // a AS b, row AS x, true AS first FROM g, c
  UNION ALL SELECT row, n, a, b, {left} * b + {right} AS x, false AS first FROM ({step}))
SELECT g.doc_id, g.size, g.text_crc32, 'rows' AS law, CAST(x % {shards} AS INTEGER) AS shard, x // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM g JOIN w ON g.row = w.row AND NOT w.first AND w.x < w.n"""


def oracle_sql() -> dict[str, str]:
    return {"op6_suffix_array": WINDOWS_SQL, "op8_feistel_shards": shards_sql()}
