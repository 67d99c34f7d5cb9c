"""Bloom filters as tables: built by one aggregation, asked by a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a word of a filter, words of a slice, bits that an id sets, and bits for each id (one id in 256 or so passes).
WORD, SLICE, HASHES, BITS = 64, 1024, 6, 12


def places(id_: Column, slices: Column) -> tuple[Column, Column]:
    """The slice of an id, and the numbers of its bits there."""
    bits = F.lit(SLICE * WORD)
    return F.pmod(F.xxhash64(id_, F.lit(-1)), slices), F.array(*[F.pmod(F.xxhash64(id_, F.lit(k)), bits) for k in range(HASHES)])


def build(ids: DataFrame, group: str, id_: str) -> DataFrame:
    """Filters of the ids of each group: rows (group, slices, slice, words). A filter is cut into slices of SLICE words, of
    which an id falls into one, so no row grows with the group."""
    sizes = ids.groupBy(group).agg(F.ceil(F.count(F.lit(1)) * BITS / (SLICE * WORD)).cast("long").alias("slices"))
    part, bits = places(F.col(id_), F.col("slices"))
    each = ids.join(sizes, group).select(group, "slices", part.alias("slice"), F.explode(bits).alias("bit"))
    word, mask = F.expr(f"bit div {WORD}").cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % WORD).cast("int"))
    words = each.groupBy(group, "slices", "slice", word.alias("word")).agg(F.bit_or(mask).alias("bits"))
    held = words.groupBy(group, "slices", "slice").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("set"))
    full = F.transform(F.sequence(F.lit(0), F.lit(SLICE - 1)), lambda k: F.coalesce(F.try_element_at("set", k), F.lit(0).cast("long")))
    return held.select(group, "slices", "slice", full.alias("words"))


def possible(ids: DataFrame, filters: DataFrame, group: str, id_: str) -> DataFrame:
    """Those of ids (group, id) that a filter of their group may have; a group may have several filters, of any sizes."""
    sizes = filters.select(group, "slices").distinct()
    part, bits = places(F.col(id_), F.col("slices"))
    asked = ids.select(group, id_).distinct().join(sizes, group).select(group, id_, "slices", part.alias("slice"), bits.alias("bits"))
    found = asked.join(filters, [group, "slices", "slice"])
    has = lambda p: F.call_function("shiftrightunsigned", F.get("words", F.floor(p / WORD).cast("int")), (p % WORD).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return found.where(F.forall("bits", has)).select(group, id_).distinct()
