"""Normalizing files as they arrive: a file stream whose batches are canonical lines, each kept once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators import normalize
from corpusmill.sources import files
from corpusmill.sources.index import Index


def canonical_lines(lines: DataFrame) -> DataFrame:
    """Lines (value) as canonical records with the reason of their rejection."""
    return normalize.records_of(files.parsed(lines, "value"))


def start(spark: SparkSession, arrivals: str, output: str, checkpoint: str, mapping: list[tuple[str, str, str]]) -> StreamingQuery:
    """Every new file below arrivals is normalized and added to the index at output, with prompt_id as id; one that is there
    already is not added. Of what is there, a batch of new ids reads filters only.

    A batch that is tried again finds its own rows in the output, so nothing is written twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        kept = normalize.normalized(normalize.classify(canonical_lines(batch), session.createDataFrame(mapping, "source string, source_file string, field string")))
        Index(session, output).append(kept.select(F.col("prompt_id").alias("id"), "source", "source_file", "source_row", "text", F.to_json("raw_fields").alias("raw_fields")))

    lines = spark.readStream.format("text").schema("value string").option("recursiveFileLookup", True).load(arrivals)
    return lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
