"""Odd tables that every text operator has to take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, size int, row int"


def odd_texts() -> list[str | None]:
    return [None, "", " \n\t ", "one", "one two", "Same text here.", "Same text here.", "same TEXT here.", "é ü 日本 🙂", "x" * 20_000, "lorem ipsum dolor sit amet " * 400, "A\x00b", "<|endoftext|> and 'll", "﻿bom"]


def odd_docs(spark):
    """Null ids, repeated rows, clashing extra columns."""
    rows = [(i if i != 3 else None, t, None if i % 3 else "en", None, i, i, "k", i, i) for i, t in enumerate(odd_texts())]
    rows += [rows[5], rows[5], rows[3]]
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def write_documents(spark, df, where) -> str:
    df.write.mode("overwrite").parquet(f"{where}/documents.parquet")
    return str(where)
