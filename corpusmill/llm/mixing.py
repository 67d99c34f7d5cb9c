"""Mixing sources to target weights with Efraimidis-Spirakis keys.

Each document gets an exponential key -ln(u) / quality. Within its source, documents are sorted by that key and
their sizes prefix-summed; whole epochs come first, then the documents whose prefix fits what is left of the
source's budget. The last of them is taken in part, so that a source meets its target to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import n_words, small_side, table, written

SEED = "mix-1"
#: Most times that a source's words may be taken.
EPOCHS = 3
#: Quality weights of documents labelled 1 and 0, and of those without a label.
QUALITY = {1: 1.0, 0: 0.25, None: 0.5}
#: Weights are joined by broadcast up to so many (16 bytes each), else by a shuffle.
BROADCAST_WEIGHTS = 300_000
#: So are sources, up to so many (200 bytes each).
BROADCAST_SOURCES = 50_000
#: Targets are worked out by one task, over a row for each source.
MOST_SOURCES = 5_000_000


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size), a row for each of MOST_SOURCES sources at most, with target: shares by weight 1, 2, 3, 1, ... in code-point order, null last;
    no target is above EPOCHS times its size, and what exceeds that is shared again by weight.

    Sharing again and again ends at one level per unit of weight, with the sources of least size per weight full;
    prefix sums over the sources in that order find it. The frame has one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    s = s.withColumn("cap", (F.col("source_size") * EPOCHS).cast("double")).withColumn("fill", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fill", F.col("source").isNull(), "source")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    s = s.withColumn("full", F.col("fill") <= F.col("level"))
    level = F.min(F.when(~F.col("full"), F.struct("fill", "level"))).over(everything)["level"]
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level))
    return s.select("source", "source_size", "target")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that the id and the seed decide."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id and weight of each labelled document; of several labels the best counts."""
    best = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return best.select("doc_id", F.when(F.col("quality") >= 1, QUALITY[1]).when(F.col("quality") < 1, QUALITY[0]).otherwise(QUALITY[None]).alias("weight"))


def ranged(rows: DataFrame, shares: DataFrame, ranges: int) -> DataFrame:
    """rows with the range that their key falls into: of the chance that a document of the source has a smaller key, which
    is the sum over its weights w of their shares times 1 - exp(-w key). So each range of a source holds as many rows."""
    joined = rows.join(small_side(shares, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("of")))
    below = F.aggregate("shares", F.lit(0.0), lambda sum_, s: sum_ + s["n"] / F.col("all") * (1 - F.exp(-s["weight"] * F.col("key"))))
    return joined.withColumn("range", F.least(F.floor(below * ranges), F.lit(ranges - 1))).drop("of", "all", "shares", "weight")


def mix(docs: DataFrame, weights: DataFrame | None = None, payload: str | None = None, seed: str = SEED, rows_per_task: int = 100_000) -> DataFrame:
    """docs (doc_id, source, size) with source_size, target, taken (words), copies (whole) and tail (words beyond).

    weights: doc_id and weight > 0, one row per id. A source of any size is cut into ranges of keys that hold about as
    many documents each, and a prefix sum is that of the ranges before plus that within a range. A null source is a
    source of its own. Documents without words get 0. Of rows of one id and size that of the least hash of its payload comes
    first, so reruns agree; rows alike in every column are interchangeable. Of other columns only payload is kept, and
    carried through one exchange. An empty table gives no rows; more than MOST_SOURCES sources fail.
    """
    carried = [payload] if payload else []
    rows = docs.select("doc_id", "source", "size", *carried)
    if weights is not None:
        rows = rows.join(small_side(weights, BROADCAST_WEIGHTS), "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(None).cast("double"))
    weight = F.coalesce(F.col("weight"), F.lit(QUALITY[None]))
    key = -F.log(uniform(F.col("doc_id"), seed)) / weight
    # Weights between two powers of two count as the lower one for the ranges.
    rows = rows.select("doc_id", "source", "size", key.alias("key"), F.pow(F.lit(2.0), F.floor(F.log2(weight))).alias("weight"), *carried)
    keys = written(rows.drop(*carried), "mix-keys")
    shares = keys.groupBy("source", "weight").agg(F.count(F.lit(1)).alias("n"))
    # A row for each source, which holds a pair for each power of two.
    shares = written(shares.groupBy(F.col("source").alias("of")).agg(F.sum("n").alias("all"), F.collect_list(F.struct("weight", "n")).alias("shares")), "mix-shares")
    total, sources = (x or 0 for x in shares.agg(F.sum("all"), F.count(F.lit(1))).first())
    if sources > MOST_SOURCES:
        raise ValueError(f"{sources} sources; targets are shared out among {MOST_SOURCES} at most")
    keys, rows = (ranged(x, shares, max(32, -(-total // rows_per_task))) for x in (keys, rows))
    rows = rows if payload else keys
    summed = keys.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    summed = summed.withColumn("ahead", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)))
    goals = targets(keys.groupBy("source").agg(F.sum("size").alias("source_size")))
    goals = goals.withColumn("words", F.floor("target")).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)))
    plan = summed.alias("a").join(goals.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    plan = plan.select(F.col("a.source").alias("s"), F.col("range").alias("r"), "ahead", "source_size", "target", "epochs", (F.col("words") - F.col("epochs") * F.col("source_size")).alias("rest"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", *[F.xxhash64(c) for c in carried]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("ahead") - F.col("before")))
    taken = F.col("epochs") * F.col("size") + part
    whole = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(0))
    out = rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *carried)
    return out.withColumn("copies", whole).withColumn("tail", F.col("taken") - F.col("copies") * F.col("size"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights of their sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = mix(docs, quality_weights(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
l AS (
  SELECT doc_id, CASE WHEN max(quality) >= 1 THEN 1.0 WHEN max(quality) < 1 THEN 0.25 ELSE 0.5 END AS weight
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
k AS (
  SELECT d.*, -ln((CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)
    / coalesce(CAST(weight AS DOUBLE), 0.5) AS key
  FROM d LEFT JOIN l USING (doc_id)),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS weight,
    CAST({EPOCHS} * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
v AS (
  SELECT *, cap / weight AS fill, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, source_size, CASE WHEN fill <= level THEN cap ELSE weight * first_value(CASE WHEN fill > level THEN level END IGNORE NULLS)
    OVER (ORDER BY fill, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS target FROM v),
p AS (
  SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + least(size, greatest(0, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM p
"""
