"""Sharding by histogram sort.

Rows are ordered by a key (hash of the text, hash of the id). Exact byte counts below candidate boundaries are
taken across all partitions, boundaries are refined until each splitter meets the tolerance, and then rows are
exchanged once. Only DataFrame functions run on the data; the driver sees at most fanout counts per open splitter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import table, written

MASK = (1 << 63) - 1
SEED = 7


@dataclass
class Splitter:
    """The search for one boundary: the key interval [low, high) that holds it and the bytes below low."""

    target: float
    low: int = 0
    high: int = MASK
    below: int = 0
    text_key: int | None = None  # set once the boundary lies inside one group of equal texts
    found: tuple[int, int] | None = None

    @property
    def interval(self) -> tuple[int | None, int, int]:
        return self.text_key, self.low, self.high


def row_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_key(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit(MASK))


def id_key(doc_id: Column) -> Column:
    return F.xxhash64(doc_id, F.lit(SEED)).bitwiseAND(F.lit(MASK))


def histogram(keys: DataFrame, intervals: list[tuple[int | None, int, int]], fanout: int) -> dict[tuple[int, int], tuple]:
    """Exact bytes, rows and least and greatest key of each cell of each interval."""
    number, cell, least = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for n, (group, low, high) in enumerate(intervals):
        key = F.col("k1") if group is None else F.col("k2")
        inside = (key >= low) & (key < high)
        if group is not None:
            inside &= F.col("k1") == group
        width = max(1, -(-(high - low) // fanout))
        number = F.when(inside, F.lit(n)).otherwise(number)
        cell = F.when(inside, F.expr(f"({'k1' if group is None else 'k2'} - {low}L) div {width}L")).otherwise(cell)
        least = F.when(inside, key).otherwise(least)
    cells = (
        keys.select(number.alias("n"), cell.alias("cell"), least.alias("key"), "size")
        .where("n is not null")
        .groupBy("n", "cell")
        .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("least"), F.max("key").alias("most"))
    )
    return {(r["n"], r["cell"]): (r["size"], r["rows"], r["least"], r["most"]) for r in cells.collect()}


def narrow(s: Splitter, cells: list[tuple], slack: float) -> None:
    """One round for one splitter: cells are (size, rows, least, most) in key order."""
    before = s.below
    for size, rows, least, most in cells:
        if before + size < s.target:
            before += size
            continue
        under, over = s.target - before, before + size - s.target
        at = (lambda key: (key, 0)) if s.text_key is None else (lambda key: (s.text_key, key))
        if min(under, over) <= slack or rows == 1 or (least == most and s.text_key is not None):
            s.found = at(least) if under <= over else at(most + 1)
        elif least == most:
            s.text_key, s.low, s.high, s.below = least, 0, MASK, before
        else:
            s.low, s.high, s.below = least, most + 1, before
        return
    s.found = (MASK, 0)


def find_splitters(keys: DataFrame, shards: int, tolerance: float = 0.002, fanout: int = 64) -> list[tuple[int, int]]:
    """The keys at which shards 1, 2, ... begin. keys: k1, k2 and size."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    todo = [Splitter(total * j / shards) for j in range(1, shards)]
    slack = tolerance * total / shards
    while open_ := [s for s in todo if s.found is None]:
        intervals = list(dict.fromkeys(s.interval for s in open_))
        cells = histogram(keys, intervals, fanout)
        for s in open_:
            n = intervals.index(s.interval)
            narrow(s, [cells[k] for k in sorted(cells) if k[0] == n], slack)
    return sorted(s.found for s in todo)


def shard_number(splitters: list[tuple[int, int]], k1: Column, k2: Column) -> Column:
    """How many splitters are at or below a key."""
    number = F.lit(0)
    for a, b in splitters:
        number = number + ((k1 > a) | ((k1 == a) & (k2 >= b))).cast("int")
    return number


def shard(df: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id", tolerance: float = 0.002, rows_per_task: int = 200_000) -> DataFrame:
    """df with columns shard and slot (they replace columns of these names); slots count from 0 in each shard.

    Bytes per shard differ from an equal share by the tolerance, or by one row where single rows are larger than
    that. Equal texts stay together where the tolerance allows it; a larger group is cut by its ids. Rows with the
    same text and id always stay together. A null text has no bytes (its text_crc32 in the query is 0, that of no bytes) and a
    null id is an id of its own. An empty table gives an empty result.
    """
    k1, k2 = text_key(F.col(text)), id_key(F.col(doc_id))
    keys = written(df.select(k1.alias("k1"), k2.alias("k2"), row_bytes(F.col(text)).alias("size")), "shard-keys")
    splitters = find_splitters(keys, shards, tolerance)
    number = shard_number(splitters, F.col("k1"), F.col("k2"))
    parts = max(8, -(-keys.count() // (shards * rows_per_task)))
    part = F.pmod(F.col("k2"), F.lit(parts))
    # One row for each of at most shards * parts tasks of the exchange below.
    counts = keys.groupBy(number.alias("s"), part.alias("p")).agg(F.count(F.lit(1)).alias("rows"))
    ahead = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("s", "p", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("first"))
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), k1.alias("k1"), k2.alias("k2"))
    rows = rows.withColumns({"s": number, "p": part})
    within = F.row_number().over(Window.partitionBy("s", "p").orderBy("k1", "k2")) - 1
    out = rows.withColumn("within", within).join(F.broadcast(first), ["s", "p"])
    return out.select(*[F.col("row")[c].alias(c) for c in kept], F.col("s").alias("shard"), (F.col("first") + F.col("within")).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of nearly equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", row_bytes(F.col("text")).alias("size"), F.coalesce(F.crc32(F.col("text")), F.lit(0)).alias("text_crc32"), "text")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
