"""Writing: staged output that replaces what was there in one step, reports and checkpoints."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.arrow import record_line

#: Bytes that a copy holds, tasks that copy, and files whose numbers every task may hold.
COPIED, MOST_COPIES, MOST_FILES = 4 << 20, 1000, 200_000


def place(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = place(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = place(spark, path)
    fs.delete(at, True)


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Writes next to path and renames: a failed write leaves what was there, and always clears its staging."""
    mark = uuid.uuid4().hex
    staging, old = f"{path}.staging-{mark}", f"{path}.old-{mark}"
    try:
        write(staging)
        fs, at = place(spark, path)
        moved = fs.exists(at)
        if moved:
            if not fs.rename(at, place(spark, old)[1]):
                raise OSError(f"can't rename {path} to {old}")
        at.getParent() and fs.mkdirs(at.getParent())
        try:
            done = fs.rename(place(spark, staging)[1], at)
        except Exception:
            moved and fs.rename(place(spark, old)[1], at)
            raise
        if not done:
            moved and fs.rename(place(spark, old)[1], at)
            raise OSError(f"can't rename {staging} to {path}")
        remove(spark, old)
    finally:
        remove(spark, staging)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share; only a local session may lack it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "file:///tmp/checkpoints").rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, which whoever owns that clears; what reads it depends on nothing before."""
    path = f"{shared_dir(df.sparkSession)}/corpusmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows, counted first; else df, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(df: DataFrame, path: str, *by: str) -> None:
    """A Parquet table, in folders by the given columns."""
    replace(df.sparkSession, path, lambda to: df.write.partitionBy(*by).parquet(to))


def jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, columns in order, absent values kept as null."""
    replace(df.sparkSession, path, lambda to: df.write.option("ignoreNullFields", False).json(to))


def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files (target, parts) that are written by joining their parts in order, a stream at a time."""
    from pyarrow import fs

    for batch in batches:
        sizes = []
        for target, parts in zip(batch["target"].to_pylist(), batch["parts"].to_pylist()):
            system, place = fs.FileSystem.from_uri(target)
            system.create_dir(place.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(place) as out:
                for part in parts:
                    with system.open_input_stream(fs.FileSystem.from_uri(part)[1]) as own:
                        while data := own.read(COPIED):
                            out.write(data)
                sizes.append(out.tell())
        yield pa.RecordBatch.from_arrays([batch["target"], pa.array(sizes, pa.int64())], ["target", "bytes"])


def concatenated(spark: SparkSession, files: list[tuple[str, list[str]]]) -> None:
    """Writes each file (target, parts) as its parts in order: by the file system itself where it can (HDFS joins the
    blocks of files), else by a task for each file, which copies bytes."""
    joined, todo = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, []
    for target, parts in files:
        fs, at = place(spark, target)
        if parts and fs.getScheme() == "hdfs":
            fs.mkdirs(at.getParent())
            fs.rename(joined(parts[0]), at)
            rest = spark.sparkContext._gateway.new_array(joined, len(parts) - 1)
            for k, part in enumerate(parts[1:]):
                rest[k] = joined(part)
            len(parts) > 1 and fs.concat(at, rest)
        else:
            todo.append((at.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri().toString(), parts))
    if todo:
        rows = spark.createDataFrame(todo, "target string, parts array<string>").repartition(min(len(todo), MOST_COPIES), "target")
        rows.mapInArrow(copied, "target string, bytes long").write.format("noop").mode("overwrite").save()


def canonical(df: DataFrame, path: str, listed: DataFrame | None = None) -> None:
    """Canonical records (source, source_file, source_row, fields_json) as path/source/name.jsonl, a line each in order of
    rows, as one step. A CSV file's name ends in .jsonl then. Files that are listed (source, source_file) are there
    even without records.

    Records are written in ranges over all files, so a file of any size is the work of many tasks, each of which gives
    an ordered part of it; the parts are then put together under the exact name.
    """
    spark = df.sparkSession
    line = record_line("source", "source_file", "source_row", "fields_json")
    found = df.select("source", "source_file").distinct()
    names = (listed.select("source", "source_file").union(found).distinct() if listed else found).collect()  # one row for each file
    number = {(r["source"], r["source_file"]): k for k, r in enumerate(sorted(names))}
    named = {(s, re.sub(r"(?i)[.]csv$", ".jsonl", f)): k for (s, f), k in number.items()}
    if len(named) < len(number):
        raise ValueError("two files of a source would have the same canonical name")
    ids = spark.createDataFrame([(s, f, k) for (s, f), k in number.items()], "source string, source_file string, file int")
    rows = df.join(small_side(ids, MOST_FILES), ["source", "source_file"]).select("file", "source_row", line.alias("value"))

    def write(to: str) -> None:
        rows.repartitionByRange("file", "source_row").sortWithinPartitions("file", "source_row").select("file", "value").write.partitionBy("file").text(f"{to}.parts")
        try:
            pieces: dict[int, list[str]] = {}
            parts = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{to}.parts").select("path")
            for path_ in (r["path"] for r in parts.toLocalIterator()):
                pieces.setdefault(int(path_.rsplit("/", 2)[1].removeprefix("file=")), []).append(path_)
            # Parts are named by the number of their range.
            ordered = lambda k: sorted(pieces.get(k, []), key=lambda p: int(p.rsplit("/part-", 1)[1].split("-")[0]))
            concatenated(spark, [(f"{to}/{s}/{name}", ordered(k)) for (s, name), k in named.items()])
            fs, at = place(spark, to)
            fs.mkdirs(at)
        finally:
            remove(spark, f"{to}.parts")

    replace(spark, path, write)


def report(spark: SparkSession, path: str, content: object) -> None:
    """A small JSON report, made on the driver and written through Spark's file system."""
    text = json.dumps(content, ensure_ascii=False, indent=2, default=str)

    def write(to: str) -> None:
        fs, at = place(spark, to)
        out = fs.create(at, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    replace(spark, path, write)


def append_checkpoint(df: DataFrame, path: str) -> None:
    """Adds finished rows to a checkpoint."""
    df.write.mode("append").parquet(path)


def checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a checkpoint holds; nothing if there is none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
