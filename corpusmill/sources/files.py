"""Reading raw, canonical and normalized files with the numbers of their lines.

Files are read in splits, whose lines are counted and summed up before each.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import arrow
from corpusmill.sources import csv_splits, publish, registry

logger = logging.getLogger(__name__)
#: Splits whose line counts every task may hold (some 60 bytes each).
MOST_SPLITS = 1_000_000
CANONICAL = "source string, source_file string, source_row long, fields_json string"


class DataError(ValueError):
    """A file that breaks the rules of its format; the message names file and line."""


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files of a glob: path, source, source_file and length; none of them is read. The driver lists them, as Spark's own
    sources do, which leave out files without a byte."""
    fs, place = publish.place(spark, path)
    found = [(s.getPath().toString(), s.getLen()) for s in fs.globStatus(place) or [] if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    return with_origin(spark.createDataFrame(found, "path string, length long"))


def paths(spark: SparkSession, root: str) -> DataFrame:
    """Files two levels below root with source and source_file, in path order; metadata.json files are left out."""
    return listing(spark, f"{root}/*/*").where("source_file NOT IN ('metadata.json', 'fetch_metadata.json', 'fetch_run_summary.json')").orderBy("source", "source_file")


def with_origin(df: DataFrame) -> DataFrame:
    parts = F.split(F.col("path"), "/")
    return df.withColumn("source", F.element_at(parts, -2)).withColumn("source_file", F.element_at(parts, -1))


def splits_of(rows: DataFrame, *sums: Column) -> DataFrame:
    """The splits of lines (path, block, place) with the first place and the number of lines, and more sums."""
    return rows.groupBy("path", "block").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), *sums)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines of text files: path, source, source_file, line (from 1) and text.

    A task numbers the rows of its splits without a gap, so a line's number is its place after the first one of its split,
    plus the lines of the file's splits before. Counting them is a first pass, which reads lines and keeps a row for each
    split; these go to all tasks (beyond MOST_SPLITS, the join is a shuffled one), so no text is exchanged.
    """
    rows = raw_lines(spark, path)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = splits_of(rows).select("path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    shifts = publish.kept(shifts, "line-splits")
    numbered = rows.join(publish.small_side(shifts, MOST_SPLITS), ["path", "block"]).withColumn("line", F.col("place") + F.col("shift"))
    return with_origin(numbered).select("path", "source", "source_file", "line", "text")


def raw_lines(spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    """Lines with the file and split that they are in, and a number that rises by one from line to line of a task."""
    place, block = F.monotonically_increasing_id().alias("place"), F.col("_metadata.file_block_start").alias("block")
    reader = spark.read.option("lineSep", end) if end else spark.read
    # Spark tells paths as URIs.
    file = F.col("_metadata.file_path")
    file = F.when(F.contains(file, F.lit("%")), F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))).otherwise(file)
    return reader.text(path).select(file.alias("path"), block, place, F.col("value").alias("text"))


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSONL files as canonical records. Blank lines count but give no record; a malformed line fails the read."""
    rows = lines(spark, path).where(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"))
    value = arrow.canonical_json("text")
    where = F.concat(F.lit("malformed JSON in "), "path", F.lit(" line "), F.col("line").cast("string"))
    rows = rows.withColumn("value", value).withColumn("value", F.when(F.col("value").isNull(), F.raise_error(where).cast("string")).otherwise(F.col("value")))
    return rows.select("source", "source_file", F.col("line").alias("source_row"), wrapped(F.col("value")).alias("fields_json"))


def wrapped(value: Column) -> Column:
    """An object as it is, any other value as {"_value": value}."""
    return F.when(value.startswith("{"), value).otherwise(F.concat(F.lit('{"_value":'), value, F.lit("}")))


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """CSV files as canonical records of strings; source_row is the last physical line of a record. Files are read in
    splits, whatever line breaks are inside quotes; absent cells are null, and too many fail the read."""
    return with_origin(csv_splits.read(spark, path)).select("source", "source_file", "source_row", "fields_json")


def csv_row_count(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV payloads as fetched: blank lines count, the header doesn't; null if not UTF-8."""
    files = with_origin(spark.read.format("binaryFile").load(path))
    text = F.decode("content", "UTF-8")
    sound = F.encode(text, "UTF-8") == F.col("content")
    pieces = F.size(F.split(F.regexp_replace(text, "(\r\n|\r|\n)\\z", ""), "\r\n|\r|\n", -1))
    rows = F.when(F.length(text) == 0, 0).otherwise(F.greatest(pieces - 1, F.lit(0)))
    return files.select("source", "source_file", F.when(F.is_valid_utf8(F.col("content").cast("string")) & sound, rows).cast("long").alias("record_count"), F.octet_length("content").cast("long").alias("byte_count"))


def canonical_name(raw_name: Column) -> Column:
    """Output name of a raw file; other suffixes fail."""
    ok = F.lower(raw_name).rlike(r"\.(jsonl|csv)$")
    return F.when(ok, F.regexp_replace(raw_name, r"(?i)\.csv$", ".jsonl")).otherwise(F.raise_error(F.concat(F.lit("unsupported suffix: "), raw_name)).cast("string"))


def convert(spark: SparkSession, root: str) -> DataFrame:
    """All raw files below root as canonical records."""
    names = [r[0] for r in paths(spark, root).select(F.lower(F.element_at(F.split("source_file", r"\."), -1))).distinct().collect()]
    if odd := [n for n in names if n not in READERS]:
        raise DataError(f"unsupported suffix: {odd[0]}")
    parts = [READERS[n](spark, f"{root}/*/*.{suffix_glob(n)}") for n in ("jsonl", "csv") if n in names]
    if not parts:
        return spark.createDataFrame([], CANONICAL)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def suffix_glob(suffix: str) -> str:
    """A suffix in either case."""
    return "".join(f"[{c}{c.upper()}]" for c in suffix)


def of_type(value: Column, name: str, prefixes: tuple[str, ...], kind: str) -> Column:
    """A field of a parsed object if it has one of these types, else null."""
    field = F.try_variant_get(value, F.lit(f"$.{name}"), "variant")
    is_ = F.lit(False)
    for prefix in prefixes:
        is_ = is_ | F.schema_of_variant(field).startswith(prefix)
    return F.when(is_, F.try_variant_get(value, F.lit(f"$.{name}"), kind))


def parsed(rows: DataFrame, text: str = "text", entries: bool = False) -> DataFrame:
    """rows with what one parse of their line gives: the reason for which it is no canonical record (null if it is one)
    and an error's message, record (source, source_file, source_row, each null if it is missing or of another type), its
    fields as a variant and as canonical JSON, and `line` of all that (with its entries, if asked)."""
    one = arrow.canonical_entries if entries else arrow.canonical_line
    rows = rows.withColumn("parsed", one(text))
    keys = F.struct("parsed.source", "parsed.source_file", "parsed.source_row")
    return rows.withColumns({"reason": F.col("parsed.reason"), "record": F.when(F.col("parsed.reason").isNull(), keys), "fields_json": F.col("parsed.fields_json"), "fields": F.try_parse_json("parsed.fields_json")})


def conversion_totals(converted: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Records by source and file, and (both null) over all with the number of files: of those listed, if given, which
    may have no records."""
    by_file = converted.groupBy("source", "source_file").agg(F.count(F.lit(1)).alias("record_count"))
    if listed:
        by_file = listed.select("source", "source_file").join(by_file, ["source", "source_file"], "left").na.fill(0, ["record_count"])
    totals = by_file.agg(F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("source_file"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("record_count"), F.count(F.lit(1)).alias("file_count"))
    return by_file.withColumn("file_count", F.lit(1).cast("long")).unionByName(totals)


def canonical(spark: SparkSession, path: str) -> DataFrame:
    """Lines of canonical files with the reason of their rejection (null if kept) and their parsed parts."""
    return parsed(lines(spark, path))


def normalized(spark: SparkSession, path: str) -> DataFrame:
    """Normalized records, strictly: a malformed line, a missing key or a wrong type fails and is named, and so does an
    empty input. Blank lines are passed over; raw_fields may be missing."""
    rows = lines(spark, path).where(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"))
    value = F.when(arrow.is_json("text"), F.try_parse_json("text"))
    text_keys = {c: of_type(F.col("value_"), c, ("STRING",), "string") for c in ("prompt_id", "source", "source_file", "text")}
    rows = rows.withColumn("value_", value).withColumn("raw_", F.try_variant_get("value_", F.lit("$.raw_fields"), "variant"))
    rows = rows.select("path", "line", "value_", "raw_", F.struct(*[x.alias(c) for c, x in text_keys.items()], of_type(F.col("value_"), "source_row", ("BIGINT", "BOOLEAN"), "bigint").alias("source_row")).alias("r"))
    wrong = F.when(F.col("value_").isNull(), "malformed line")
    for c in (*text_keys, "source_row"):
        wrong = wrong.when(F.col("r")[c].isNull(), f"{c} missing or of a wrong type")
    wrong = wrong.when(~F.coalesce(F.schema_of_variant("raw_"), F.lit("OBJECT")).startswith("OBJECT"), "raw_fields of a wrong type")
    named = F.raise_error(F.concat(wrong, F.lit(" in "), "path", F.lit(" line "), F.col("line").cast("string"))).cast("string")
    rows = rows.withColumn("prompt_id", F.when(wrong.isNotNull(), named).otherwise(F.col("r.prompt_id")))
    if rows.isEmpty():
        raise DataError(f"no records in {path}")
    return rows.select("prompt_id", "r.source", "r.source_file", "r.source_row", "r.text", F.coalesce("raw_", F.parse_json(F.lit("{}"))).alias("raw_fields"))


def optional_report(spark: SparkSession, path: str) -> DataFrame | None:
    """A JSON report, or None if there is no such file."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.option("multiLine", True).json(path)


def legacy(spark: SparkSession, parts: list[tuple]) -> DataFrame:
    """Direct loads in order: (source, path of JSON lines, field) as text and source, or (source, path, field, key, value)
    for the records whose key has that value. What isn't there is logged and doesn't stop the others."""
    out = spark.createDataFrame([], "ord bigint, text string, source string")
    for n, (source, path, name, *only) in enumerate(parts):
        if listing(spark, path).isEmpty():
            logger.error("nothing to load for %s at %s", source, path)
            continue
        rows = lines(spark, path)
        rows = rows.where(F.get_json_object("text", f"$.{only[0]}") == only[1]) if only else rows
        out = out.unionByName(rows.select((F.lit(n).cast("bigint") * (1 << 40) + F.col("line")).alias("ord"), F.get_json_object("text", f"$.{name}").alias("text"), F.lit(source).alias("source")))
    return out


def legacy_all(spark: SparkSession, raw: str) -> DataFrame:
    """The registry's direct loads from a raw folder, without texts that came before: text and source."""
    rows = legacy(spark, [(source, f"{raw}/{source}/{name}", *more) for source, name, *more in registry.LOADS]).where("text is not null")
    first = rows.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min_by(F.struct("text", "source"), "ord").alias("row"))
    return first.select("row.*")


READERS = {"jsonl": jsonl, "csv": csv_files, "canonical": canonical, "normalized": normalized, "lines": lines}


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """A reader by kind; an unknown one is an error."""
    if kind not in READERS:
        raise ValueError(f"unknown kind of source: {kind}")
    return READERS[kind](spark, path)
