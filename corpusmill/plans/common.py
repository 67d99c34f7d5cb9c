"""Tables as the reference's records, and pieces of SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python's white space as a class of DuckDB's regular expressions, and all else.
WS = r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({sql_strip(x)}, '[{WS}]+', ' ', 'g'))"


def sql_excerpt(x: str, limit: int = 180) -> str:
    c = sql_collapse(x)
    return f"CASE WHEN length({c}) > {limit} THEN regexp_replace(substr({c}, 1, {limit - 3}), '[{WS}]+$', '') || '...' ELSE {c} END"


def sql_word_excerpt(x: str, limit: int = 500) -> str:
    return f"CASE WHEN length({x}) > {limit} THEN regexp_replace(substr({x}, 1, {limit}), '(?s)^(.+) [^ ]*$', '\\1') ELSE {x} END"


def sql_bucket(x: str) -> str:
    return f"CASE WHEN length({x}) < 120 THEN 'short' WHEN length({x}) < 320 THEN 'medium' WHEN length({x}) < 700 THEN 'long' ELSE 'very_long' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a normalized corpus: languages as sources and sources as their files, for uneven strata."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("prompt_id"), F.col("lang").alias("source"), F.col("source").alias("source_file"), F.col("doc_id").alias("source_row"), "text")


SQL_CORPUS = "(SELECT CAST(doc_id AS VARCHAR) AS prompt_id, lang AS source, source AS source_file, doc_id AS source_row, text FROM documents)"
