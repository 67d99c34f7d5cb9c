"""Reproducible stratified samples: a budget shared among sources, then turns among the strata of each source."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T

BUDGET, LEAST, LARGEST_SHARE = 500, 6, 0.35
SEED = "corpusmill-sample-1"


def allocate(available: dict[str, int], budget: int = BUDGET, least: int = LEAST, share: float = LARGEST_SHARE) -> dict[str, int]:
    """How many records each source gives.

    Every source first gives `least`, if the budget allows it; else sources give one each in turns by name. What is
    left goes by the records left, within a cap on any source's share: whole parts first, then single records by
    largest remainder, until the budget or all caps are met.
    """
    names = sorted(available)
    floor = {n: min(available[n], least) for n in names}
    if sum(floor.values()) > budget:
        turns = {n: 0 for n in names}
        while sum(turns.values()) < budget:
            for n in [n for n in names if turns[n] < available[n]][: budget - sum(turns.values())]:
                turns[n] += 1
        return turns
    cap = {n: min(available[n], max(math.ceil(budget * max(share, 1 / len(names))), floor[n])) for n in names}
    got = dict(floor)
    while (rest := budget - sum(got.values())) > 0 and (open_ := [n for n in names if got[n] < cap[n]]):
        left = {n: available[n] - got[n] for n in open_}
        ideal = {n: rest * left[n] / sum(left.values()) for n in open_}
        more = {n: min(cap[n] - got[n], math.floor(ideal[n])) for n in open_}
        spare = rest - sum(more.values())
        hungry = [n for n in sorted(open_, key=lambda n: (math.floor(ideal[n]) - ideal[n], -left[n], n)) if more[n] < cap[n] - got[n]]
        for n in hungry[:spare]:
            more[n] += 1
        if not any(more.values()):
            more[min(open_, key=lambda n: (-left[n], n))] = 1
        for n in open_:
            got[n] += more[n]
    return got


def select_round(records: DataFrame, analyzed: DataFrame | None, number: int, budget: int = BUDGET, seed: str = SEED) -> DataFrame:
    """The sample of a round from records (prompt_id, source, source_file, source_row, text) not analyzed before.

    Records of a stratum (source, file, length bucket) are in order of a hash; strata take turns in order of another
    one. Turn k of all strata comes before turn k + 1, so sorting by turn and stratum is the same. Within a stratum
    only as many turns as the source's quota are kept, before strata meet.
    """
    unseen = records if analyzed is None else records.join(analyzed.select("prompt_id").distinct(), "prompt_id", "left_anti")
    rows = unseen.withColumn("bucket", T.length_bucket(F.col("text")))
    quota = allocate({r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}, budget)
    # One row for each source.
    quotas = records.sparkSession.createDataFrame(list(quota.items()), "source string, quota int") if quota else records.sparkSession.createDataFrame([], "source string, quota int")
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    stratum = F.concat(F.lit("("), quoted(F.col("source")), F.lit(", "), quoted(F.col("source_file")), F.lit(", "), quoted(F.col("bucket")), F.lit(")"))
    rows = rows.withColumn("record_hash", T.stable_hash(F.concat_ws(":", F.lit(seed), "source", "source_file", "prompt_id")))
    rows = rows.withColumn("stratum_hash", T.stable_hash(F.concat_ws(":", F.lit(seed), F.lit("stratum"), F.col("source"), stratum)))
    turn = F.row_number().over(Window.partitionBy("source", "source_file", "bucket").orderBy("record_hash", "prompt_id"))
    rows = rows.withColumn("turn", turn).where(F.col("turn") <= budget).join(F.broadcast(quotas), "source")
    place = F.row_number().over(Window.partitionBy("source").orderBy("turn", "stratum_hash"))
    chosen = rows.withColumn("place", place).where(F.col("place") <= F.col("quota")).orderBy("source", "place").limit(budget)
    n = F.row_number().over(Window.orderBy("source", "place"))
    return chosen.select(
        F.format_string(f"R{number:02d}S%03d", n).alias("sample_id"), "prompt_id", "source", "source_file", "source_row", F.col("bucket").alias("prompt_length_bucket"),
        T.excerpt(F.col("text")).alias("excerpt"), F.concat_ws("|", "source", "source_file", "bucket").alias("stratification_signature"),
    )
