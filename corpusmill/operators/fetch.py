"""Taking the registry's snapshots from a landing folder (there is no network here) into the raw folder, as one step."""

from __future__ import annotations

import logging
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources import files, publish, registry

logger = logging.getLogger(__name__)
METADATA, SUMMARY = "fetch_metadata.json", "fetch_run_summary.json"
RESULT = "source_name string, source_type string, required boolean, status string, error_type string, error_message string"


class RequiredSourceFailed(RuntimeError):
    """A required source couldn't be fetched."""


def from_table(spark: SparkSession, path: str, target: str, options: dict[str, str]) -> None:
    """A delimited table with a header as JSON lines of strings, in order, under an exact name. An empty cell is an empty
    string, whatever it says otherwise is text."""
    rows = spark.read.options(**options).csv(path).na.fill("")
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(f"{target}.parts")
    try:
        found = files.listing(spark, f"{target}.parts/part-*").select("path").collect()
        publish.concatenated(spark, [(target, sorted(r["path"] for r in found))])
    finally:
        publish.remove(spark, f"{target}.parts")


def take(spark: SparkSession, source: registry.Source, landing: str, staging: str) -> None:
    """The snapshots of one source: files as they are, copied by tasks, and tables that stand for them (.tsv, with the
    snapshot's options) as JSON lines."""
    copies = []
    for shot in source.snapshots:
        own, target = f"{landing}/{source.source_name}/{shot.output_name}", f"{staging}/{source.source_name}/{shot.output_name}"
        table = own.removesuffix(".jsonl") + ".tsv"
        if publish.exists(spark, own):
            copies += [(target, [r["path"]]) for r in files.listing(spark, own).collect()]
        elif shot.options and publish.exists(spark, table):
            from_table(spark, table, target, shot.options)
        else:
            raise FileNotFoundError(own)
    publish.concatenated(spark, copies)


def counted(spark: SparkSession, staging: str) -> dict[tuple[str, str], tuple[int | None, int]]:
    """Records and bytes of every snapshot: lines with something on them, rows of CSV files (null if they aren't UTF-8)."""
    sizes = {(r["source"], r["source_file"]): r["length"] for r in files.listing(spark, f"{staging}/*/*").collect()}
    found = {k: (0, n) for k, n in sizes.items()}
    if any(name.endswith(".jsonl") for _, name in sizes):
        lines = files.raw_lines(spark, f"{staging}/*/*.jsonl").where(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"))
        for r in files.with_origin(lines.groupBy("path").count()).collect():
            found[(r["source"], r["source_file"])] = (r["count"], sizes[(r["source"], r["source_file"])])
    if any(name.endswith(".csv") for _, name in sizes):
        for r in files.csv_row_count(spark, f"{staging}/*/*.csv").collect():
            found[(r["source"], r["source_file"])] = (r["record_count"], r["byte_count"])
    return found


def metadata(source: registry.Source, counts: dict, when: str) -> dict:
    """What is kept of one source's fetch, with records and bytes of each snapshot."""
    hub = source.source_type == registry.HUB
    origin = {"dataset_identifier" if hub else "repository": source.origin}
    shots = []
    for shot in source.snapshots:
        records, size = counts[(source.source_name, shot.output_name)]
        of = {"config": shot.config, "split": shot.split} if hub else {"url": shot.url, "format_label": shot.format_label}
        shots.append({
            "source_name": source.source_name, "source_type": source.source_type, **origin, **of, "fetch_timestamp": when, "snapshot_name": shot.output_name, "output_file": shot.output_name,
            "record_count": records if hub or shot.format_label == "csv" else None, "byte_count": size, **({"load_dataset_kwargs": shot.options} if hub else {}),
        })
    known = [s["record_count"] for s in shots if s["record_count"] is not None]
    return {
        "source_name": source.source_name, "source_type": source.source_type, "fetch_timestamp": when, "snapshot_count": len(shots), "total_record_count": sum(known) if known else None,
        "total_byte_count": sum(s["byte_count"] for s in shots), "snapshots": shots, **origin,
    }


def fetch_all(spark: SparkSession, landing: str, raw: str, sources: tuple[registry.Source, ...] = registry.SOURCES) -> DataFrame:
    """Takes each source's snapshots and publishes them together. Returns a row for each source.

    A source that fails doesn't stop the others; the raw folder is replaced only if every required source succeeds. Each
    source's folder gets its metadata. The summary of the run goes into the raw folder, or beside it if that stays as it
    was; a run that succeeds takes such a summary away.
    """
    when, results = datetime.now(UTC).isoformat(), []
    base = lambda s: {"source_name": s.source_name, "source_type": s.source_type, "required": s.required}

    def summary() -> dict:
        failed = [r for r in results if r["status"] == "failed"]
        return {
            "fetch_timestamp": when, "all_required_sources_succeeded": not any(r["required"] for r in failed), "successful_source_count": len(results) - len(failed), "failed_source_count": len(failed),
            "required_failure_count": sum(r["required"] for r in failed), "optional_failure_count": sum(not r["required"] for r in failed), "source_results": results,
        }

    def write(staging: str) -> None:
        for source in sources:
            try:
                take(spark, source, landing, staging)
                results.append(base(source) | {"status": "success"})
            except Exception as error:  # noqa: BLE001 - reported as the source's status
                publish.remove(spark, f"{staging}/{source.source_name}")
                logger.error("source %s failed: %s", source.source_name, error)
                results.append(base(source) | {"status": "failed", "error_type": type(error).__name__, "error_message": str(error).split("\n")[0]})
        counts = counted(spark, staging)
        for source, result in zip(sources, results, strict=True):
            if result["status"] == "success":
                result["summary"] = metadata(source, counts, when)
                publish.report(spark, f"{staging}/{source.source_name}/{METADATA}", result["summary"])
        if not summary()["all_required_sources_succeeded"]:
            raise RequiredSourceFailed
        publish.report(spark, f"{staging}/{SUMMARY}", summary())

    beside = f"{raw.rstrip('/')}-{SUMMARY}"
    try:
        publish.replace(spark, raw, write)
        publish.remove(spark, beside)
    except RequiredSourceFailed:
        publish.report(spark, beside, summary())
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in RESULT.split(", ")) for r in results], RESULT)


def totals(spark: SparkSession, raw: str) -> DataFrame:
    """source_name, byte_count and record_count of the snapshots that a raw folder's metadata tells of, as
    ingest.snapshot_totals() takes them."""
    reports = spark.read.option("multiLine", True).json(f"{raw}/*/{METADATA}")
    return reports.select(F.explode("snapshots").alias("s")).select("s.source_name", "s.byte_count", "s.record_count")

