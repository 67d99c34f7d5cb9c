"""Normalizing canonical records: the mapped field's text, cleaned, with a stable id; rejects are counted by reason."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.audit import python_type
from corpusmill.sources import files, publish

logger = logging.getLogger(__name__)
REASONS = ["blank", "malformed", "invalid_canonical", "non_string", "empty_text"]


def unmapped(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """Files of the records that the mapping lacks. Normalizing must not begin while there are any."""
    return records.select("source", "source_file").distinct().join(mapping, ["source", "source_file"], "left_anti")


def classify(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """records (source, source_file, source_row, fields, reason) with the text or why there is none.

    A line that is no record, or whose source, file or row is missing or of a wrong type, is an invalid_canonical one.
    The mapping has a row for each source and file, so it is joined by Spark's own choice of strategy; a record
    whose file is missing fails the run.
    """
    keyless = F.col("source").isNull() | F.col("source_file").isNull() | F.col("source_row").isNull()
    odd = F.when(F.col("reason").isin("not_object", "fields_not_object") | (F.col("reason").isNull() & keyless), "invalid_canonical")
    records = records.withColumn("reason", F.coalesce(odd, "reason"))
    joined = records.join(mapping, ["source", "source_file"], "left")
    checked = F.when(F.col("reason").isNull() & F.col("field").isNull(), F.raise_error(F.concat(F.lit("no field mapped for "), F.coalesce("source", F.lit("?")), F.lit("/"), F.coalesce("source_file", F.lit("?")))).cast("string")).otherwise(F.col("field"))
    # A path in quotes takes any field name but one with a quote, which the mapping has none of.
    value = F.try_variant_get("fields", F.concat(F.lit("$['"), checked, F.lit("']")), "variant")
    rows = joined.withColumn("value", value)
    raw = F.when(python_type(F.schema_of_variant("value")) == "str", F.expr("try_variant_get(value, '$', 'string')"))
    rows = rows.withColumn("raw", raw).withColumn("text", T.normalize(F.col("raw")))
    reason = F.coalesce(F.col("reason"), F.when(F.col("raw").isNull(), "non_string").when(F.col("text") == "", "empty_text"))
    return rows.withColumn("reason", reason).drop("value", "raw", "field")


def normalized(classified: DataFrame) -> DataFrame:
    """The kept records as prompt_id, source, source_file, source_row, text, raw_fields."""
    kept = classified.where("reason is null")
    if "source_json" in kept.columns:
        ids = T.prompt_id_of(F.col("source"), F.col("source_json"), F.col("source_file_json"), F.col("source_row"), F.col("fields_json"))
    else:
        ids = T.prompt_id(F.col("source"), F.col("source_file"), F.col("source_row"), F.col("fields_json"))
    return kept.select(ids.alias("prompt_id"), "source", "source_file", "source_row", "text", F.col("fields").alias("raw_fields"))


def accounting(classified: DataFrame) -> DataFrame:
    """Lines read, kept and rejected by reason, for each file and (source_file null) over all."""
    counts = [F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(f"skipped_{r}") for r in REASONS]
    keys = ["source", "source_file"]
    return classified.groupingSets([[], keys], *keys).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("reason").isNull()).alias("kept"), *counts)


def records_of(lines: DataFrame, *keep: str) -> DataFrame:
    """Parsed lines (of files.parsed) as what classify() takes, with what ids are made of."""
    keys = ("source", "source_file", "source_row")
    return lines.select(*[F.col("record")[c].alias(c) for c in keys], "fields", "fields_json", "reason", "parsed.source_json", "parsed.source_file_json", *keep)


def run(spark: SparkSession, path: str, output: str, mapping: DataFrame, audit: dict | None = None) -> DataFrame:
    """Canonical files to normalized JSON lines at output, which are replaced as one. Returns the accounting of each file
    (key: source and name, by folder; null for all, with the number of files): lines = kept + all skipped, always.

    Files of the mapping are checked against an audit's report, if given: what it lacks is logged. A record whose file
    is not mapped fails the run; a file without lines has zeros.
    """
    own = files.canonical(spark, path).withColumnsRenamed({"source": "folder", "source_file": "file"})
    classified = classify(records_of(own, "folder", "file"), mapping)
    publish.jsonl(normalized(classified), output)
    by_file = classified.select(F.col("folder").alias("source"), F.col("file").alias("source_file"), "source_file", "reason").toDF("source", "source_file", "named", "reason")
    counted = accounting(by_file)
    names = ["lines", "kept", *[f"skipped_{r}" for r in REASONS]]
    listed = files.listing(spark, path).select("source", "source_file")
    each = listed.join(counted.where("source is not null"), ["source", "source_file"], "left").na.fill(0, names)
    key = F.concat_ws("/", "source", "source_file").alias("key")
    whole = each.agg(F.lit(None).cast("string").alias("key"), F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    if audit:
        pairs = by_file.where("named is not null").select("source", "source_file", "named").distinct()
        for r in warned(spark, mapping.join(pairs.select("source", F.col("source_file").alias("file"), F.col("named").alias("source_file")), ["source", "source_file"]), audit).collect():
            logger.warning("%s/%s: %s (%s)", r["source"], r["source_file"], r["warning"], r["field"])
    return each.select(key, F.lit(1).cast("long").alias("files"), *names).unionByName(whole)


def warned(spark: SparkSession, mapped: DataFrame, audit: dict) -> DataFrame:
    """mapping_warnings() of canonical files (source, file, field) by an audit's report."""
    of = [(*key.split("/", 1), r) for key, r in audit["file_summaries"].items()]
    keys = "source string, source_file string"
    listed = spark.createDataFrame([(s, f) for s, f, _ in of], keys)
    fields = spark.createDataFrame([(s, f, name) for s, f, r in of for name in r["fields"]], f"{keys}, field string")
    likely = spark.createDataFrame([(s, f, c["field_name"]) for s, f, r in of for c in r["likely_prompt_bearing_fields"]], f"{keys}, field string")
    return mapping_warnings(mapped.select("source", F.col("file").alias("source_file"), "field"), listed, fields, likely)


def mapping_warnings(mapping: DataFrame, files: DataFrame, fields: DataFrame, likely: DataFrame) -> DataFrame:
    """Mapped files that the audit lacks, or whose field it hasn't seen or doesn't find likely to hold the text."""
    keys = ["source", "source_file"]
    seen = mapping.join(files.select(*keys, F.lit(True).alias("has_file")), keys, "left")
    seen = seen.join(fields.select(*keys, "field", F.lit(True).alias("has_field")), [*keys, "field"], "left")
    seen = seen.join(likely.select(*keys, "field", F.lit(True).alias("is_likely")), [*keys, "field"], "left")
    warning = F.when(F.col("has_file").isNull(), "file missing").when(F.col("has_field").isNull(), "field unseen").when(F.col("is_likely").isNull(), "field not likely")
    return seen.select(*keys, "field", warning.alias("warning")).where("warning is not null")


def resume(records: DataFrame, done: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Records that are not done yet, by key."""
    return records.join(done.select(key).distinct(), key, "left_anti")


def first_of_each_text(records: DataFrame, order: str = "ord") -> DataFrame:
    """One record for each exact text, the first in order. Texts are compared by hash, so they are exchanged once."""
    first = records.groupBy(T.stable_hash(F.col("text")).alias("__hash")).agg(F.min_by(F.struct("*"), order).alias("__row"))
    return first.select("__row.*")
