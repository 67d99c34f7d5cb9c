"""What the operators of this subpackage share: tables between steps, and tables to read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
#: Items of an array that running() gathers at a time.
RUN = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Only a local session may leave it unset; it then gets /tmp/checkpoints.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and returns what reads it: lineage ends there, and a lost
    executor costs no more than a reread. The folder's owner clears it, as with any checkpoint."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows, counted first; else df, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slices(items: Column) -> Column:
    """An array as an array of slices of RUN items, the last of what is left."""
    starts = lambda x: F.filter(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(RUN)), lambda k: k <= F.size(x))
    return let(items, lambda x: F.transform(starts(x), lambda k: F.slice(x, k, F.lit(RUN))))


def running(items: Column, zero: Column, step) -> Column:
    """step(state, item) folded from zero over an array, as the array of the states after each item.

    Arrays are copied when they grow, so states are gathered slice by slice and slices joined at the end.
    """
    last = lambda states: F.element_at(states, -1)
    within = lambda state, some: F.aggregate(some, F.array(state), lambda states, item: F.concat(states, F.array(step(last(states), item))))
    # Each slice's states begin with the one that it started from.
    parts = F.aggregate(slices(items), F.array(F.array(zero)), lambda done, some: F.concat(done, F.array(within(last(last(done)), some))))
    return F.flatten(F.transform(parts, lambda states: F.slice(states, 2, RUN)))


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
