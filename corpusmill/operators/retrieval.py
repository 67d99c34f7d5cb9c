"""Hybrid retrieval: exact dense search, BM25 over postings, reciprocal rank fusion, reranking and result cards."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from corpusmill.functions import text as T
from corpusmill.sources import publish
from corpusmill.sources.registry import UNKNOWN

logger = logging.getLogger(__name__)
DEPTH, SHOWN = 20, 5
#: Folders of stored postings, and tasks that write each.
BUCKETS, SPREAD = 64, 4
K1, B, RRF = 1.2, 0.75, 60
#: Documents of a range are 2 to this; ranges that are read first, how many times more each time, and up to which number
#: all tasks may know them. Scores are rounded to 6 digits, so bounds are compared with some slack.
RANGE_BITS, FIRST, GROWTH, HELD, BROADCAST_RANGES, SLACK = 6, 8, 4, 5000, 1_000_000, 2e-6
#: Goes into the key of stored postings: another layout, or other terms, are another index.
LAYOUT = 3
#: Terms of some ranges that are inverted at a time.
TERMS = 1 << 20


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense(index: DataFrame, query: list[float], k: int = DEPTH) -> DataFrame:
    """id and score of the k nearest points of index (id, dense) by cosine; a top-k without a full sort."""
    scored = index.select("id", F.round(cosine(F.col("dense"), F.array(*[F.lit(float(x)) for x in query])), 6).alias("score"))
    return scored.where("score is not null").orderBy(F.desc("score"), "id").limit(k)


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame) -> DataFrame:
    """(term, id, tf, size) for docs (id, text): built once, then read by term."""
    rows = docs.select("id", terms(F.col("text")).alias("terms"))
    return rows.select("id", F.size("terms").cast("long").alias("size"), F.explode("terms").alias("term")).groupBy("term", "id", "size").agg(F.count(F.lit(1)).alias("tf"))


def whole_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, range, terms), in order of their ranges, in batches of whole ranges with TERMS terms or one range."""
    left = None
    for batch in chain(batches, [None]):
        rows = batch if left is None else left if batch is None else pa.concat_batches([left, batch])
        if rows is None or not rows.num_rows:
            continue
        ranges = rows["range"].to_numpy()
        starts = np.flatnonzero(np.diff(ranges, prepend=ranges[0] - 1))
        # The last range may go on in the next batch.
        starts = starts if batch is not None else np.append(starts, len(ranges))
        n = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(rows["terms"]), 0).to_numpy(zero_copy_only=False))])
        begin = 0
        for k, end in enumerate(starts):
            if end > begin and (k + 1 == len(starts) or n[starts[k + 1]] - n[begin] > TERMS):
                yield rows.slice(begin, end - begin)
                begin = int(end)
        left = rows.slice(begin)


def inverted(batches: Iterator[pa.RecordBatch], mean: float) -> Iterator[pa.RecordBatch]:
    """Rows (id, range, terms), in order of their ranges, to what each term has in each range: ids and their weights."""
    for rows in whole_ranges(batches):
        size = pc.fill_null(pc.list_value_length(rows["terms"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = rows["terms"].flatten().dictionary_encode()
        each = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(size) + np.repeat(np.arange(len(size)), size)
        each, tf = np.unique(each, return_counts=True)
        term, row = np.divmod(each, len(size))
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / mean))
        of = rows["range"].to_numpy()[row]
        first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
        at = pa.array(np.append(first, len(each)), pa.int32())
        lists = [pa.ListArray.from_arrays(at, x) for x in (rows["id"].take(pa.array(row)), pa.array(weight))]
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(term[first])), pa.array(of[first]), *lists], ["term", "range", "id", "weight"])


@dataclass(frozen=True)
class Postings:
    """A stored sparse index. Documents are numbered by length and cut into ranges; a term has a row for each range
    that it is in, with its documents there and the greatest weight it has in any of them. So a query knows from a few
    numbers what a range can score at most, and reads the ranges that may have one of the k best."""

    path: str

    @classmethod
    def build(cls, docs: DataFrame, path: str) -> Postings:
        """Stores the postings of docs (id, text) in folders by hash of the term, sorted by term and range, and the
        statistics of the corpus. A folder is written by SPREAD tasks, as one term may hold much of it.

        Texts are exchanged once, into ranges that lie within a task, which inverts them; so what is exchanged then is a
        term's documents in a range at a time, as two arrays. Nothing is joined.
        """
        spark = docs.sparkSession

        def write(to: str) -> None:
            # Documents of like sizes, whose weights are alike, are in ranges of their own.
            docs.limit(0).select("id").write.parquet(f"{to}/shape")
            docs.select(F.size(terms(F.col("text"))).cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).write.parquet(f"{to}/stats")
            mean = spark.read.parquet(f"{to}/stats").first()["mean"] or 1.0
            placed = docs.where("id is not null").select("id", "text", F.length("text").alias("length")).repartitionByRange("length", "id").sortWithinPartitions("length", "id")
            rows = placed.withColumn("range", F.shiftright(F.monotonically_increasing_id(), RANGE_BITS)).select("id", "range", terms(F.col("text")).alias("terms"))
            kind = docs.schema["id"].dataType
            shape = types.StructType().add("term", "string").add("range", "long").add("id", types.ArrayType(kind)).add("weight", types.ArrayType(types.DoubleType()))
            bucket, spread = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"), F.pmod(F.xxhash64("range"), F.lit(SPREAD))
            held = rows.mapInArrow(lambda batches: inverted(batches, mean), shape).withColumn("bucket", bucket).repartition("bucket", spread).sortWithinPartitions("bucket", "term", "range")
            held = held.select("term", "range", F.array_max("weight").alias("most"), F.size("id").cast("long").alias("n"), F.arrays_zip("id", "weight").alias("docs"), "bucket")
            held.write.partitionBy("bucket").parquet(f"{to}/postings")

        publish.replace(spark, path, write)
        return cls(path)

    def top(self, spark: SparkSession, query: list[str], k: int = DEPTH, ids: DataFrame | None = None) -> DataFrame:
        """id and BM25 score of the k best documents (among ids, if given) for the terms of a query."""
        return self.search(spark, query, k, ids)[0]

    def search(self, spark: SparkSession, query: list[str], k: int = DEPTH, ids: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
        """The same, with the number of ranges that have a term of the query, and of those whose documents were read.

        Ranges are read from the greatest bound on, ever more at a time, until no other can reach the kth score so far.
        """
        query, out = sorted(set(query)), stored_shape(spark, self.path)
        stats = spark.read.parquet(f"{self.path}/stats").first()
        if not stats["n"]:
            return spark.createDataFrame([], out), {"ranges": 0, "read": 0}
        asked = spark.createDataFrame([(q,) for q in query], "term string").select("term", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).alias("bucket")).collect()
        stored = spark.read.parquet(f"{self.path}/postings")
        found = stored.where(F.col("bucket").isin([r["bucket"] for r in asked]) & F.col("term").isin(query))
        seen = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row for each asked term
        idf = F.lit(0.0)
        for term, df in seen.items():
            idf = F.when(F.col("term") == term, math.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))).otherwise(idf)
        bounds = found.groupBy("range").agg(F.sum(idf * F.col("most")).alias("bound"))
        allowed = None if ids is None else ids.select("id").distinct()

        def scores(ranges: list | DataFrame) -> DataFrame:
            some = found.where(F.col("range").isin(ranges)) if isinstance(ranges, list) else found.join(ranges, "range", "left_semi")
            each = some.select(idf.alias("idf"), F.explode("docs").alias("d")).select("d.id", (F.col("idf") * F.col("d.weight")).alias("part"))
            each = each if allowed is None else each.join(allowed, "id", "left_semi")
            return each.groupBy("id").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")

        best, ranges, read = best_first(spark, bounds, scores, k, out)
        return best, {"ranges": ranges, "read": read}


def shape_of(kind) -> str:
    return f"id {kind.simpleString()}, score double"


def stored_shape(spark: SparkSession, path: str) -> str:
    """The columns of a search of a stored index, of which there is an empty table."""
    return shape_of(spark.read.parquet(f"{path}/shape").schema["id"].dataType)


def best_first(spark: SparkSession, bounds: DataFrame, scores, k: int, shape: str) -> tuple[DataFrame, int, int]:
    """The k best of what scores(parts) gives (id, score rounded to 6 digits) over all parts, how many parts there are, and
    how many were read.

    bounds: (range, bound), a score that no point of the range exceeds. Parts are taken in order of their bounds, FIRST of
    them and then GROWTH times as many each time; when the kth score is above all bounds left, the rest goes unread. Up
    to HELD bounds come to the driver, and parts are a list, which goes down into the scan; of more bounds only the last
    one taken does, and parts are a table.
    """
    best: list[tuple] = []
    better = lambda rows: sorted([*best, *map(tuple, rows)], key=lambda r: (-r[1], r[0]))[:k]
    found = lambda parts: scores(parts).orderBy(F.desc("score"), "id").limit(k).collect()
    least = lambda: best[-1][1] - SLACK if len(best) == k else -math.inf
    held, step, read = bounds.orderBy(F.desc("bound"), "range").limit(HELD + 1).collect(), FIRST, 0
    if len(held) <= HELD:
        while taken := [r["range"] for r in held[read : read + step] if r["bound"] >= least()]:
            best, read, step = better(found(taken)), read + len(taken), step * GROWTH
        return spark.createDataFrame(best, shape), len(held), read
    bounds, last = publish.kept(bounds, "ranges-bounds"), None
    while True:
        left = bounds if last is None else bounds.where((F.col("bound") < last["bound"]) | ((F.col("bound") == last["bound"]) & (F.col("range") > last["range"])))
        taken = publish.kept(left.where(F.col("bound") >= least()).orderBy(F.desc("bound"), "range").limit(step), "ranges-taken")
        n = taken.count()
        if n:
            best = better(found(F.broadcast(taken.select("range")) if n <= BROADCAST_RANGES else taken.select("range")))
            last = taken.orderBy("bound", F.desc("range")).first()
        read += n
        if n < step:
            return spark.createDataFrame(best, shape), bounds.count(), read
        step *= GROWTH


def sparse(docs: DataFrame, query: list[str], k: int = DEPTH) -> DataFrame:
    """id and BM25 score of the k best docs (id, text) for the terms of a query.

    Without a stored index: one pass takes sizes and the query's term counts, so no other term leaves its row.
    """
    query = sorted(set(query))
    own = F.col("terms")
    having = lambda q: F.size(F.filter(own, lambda t: t == q)).cast("long")
    tf = [having(q).alias(f"tf{n}") for n, q in enumerate(query)]
    rows = docs.select("id", terms(F.col("text")).alias("terms")).select("id", F.size(own).cast("long").alias("size"), *tf)
    df = [F.count_if(F.col(f"tf{n}") > 0).alias(f"df{n}") for n in range(len(query))]
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"), *df).first()
    score = F.lit(0.0)
    for n in range(len(query)):
        idf = F.log(F.lit(1 + (stats["n"] - stats[f"df{n}"] + 0.5) / (stats[f"df{n}"] + 0.5)))
        tf_ = F.col(f"tf{n}")
        score = score + idf * tf_ * (K1 + 1) / (tf_ + K1 * (1 - B + B * F.col("size") / (stats["mean"] or 1.0)))
    return rows.select("id", F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def ranked(top: DataFrame, by: str) -> DataFrame:
    """Ranks of a list that is already cut to its depth."""
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), F.lit(by).alias("retriever"))


def fuse(*lists: DataFrame, k: int = DEPTH) -> DataFrame:
    """id and score of the k best by the sum of 1 / (60 + rank) over ranked lists."""
    both = lists[0]
    for more in lists[1:]:
        both = both.unionByName(more)
    scored = both.groupBy("id").agg(F.round(F.sum(1 / (RRF + F.col("rank"))), 9).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def search(index: DataFrame, query_text: str, query_vector: list[float], provider=None, category: str | None = None, k: int = DEPTH, n: int = SHOWN, stored: Postings | None = None, clusters=None) -> DataFrame:
    """Result cards for a query over index (id, prompt_id, source, technique, text, dense).

    The category is a predicate below both searches. stored: the index's postings, without which its texts are read;
    their statistics are those of the whole index, whatever the category. clusters: its stored dense index, without which all
    vectors are compared. provider.rerank(df, query) gives new scores; without one the
    fused scores stay.
    """
    some = index.where(F.col("technique") == category) if category is not None else index
    words = [r for r in some.sparkSession.range(1).select(terms(F.lit(query_text))).first()[0]]
    nearest = clusters.top(some.sparkSession, query_vector, k, category) if clusters else dense(some, query_vector, k)
    lists = [ranked(nearest, "dense")]
    if words:
        by_terms = stored.top(some.sparkSession, words, k, None if category is None else some) if stored else sparse(some.select("id", "text"), words, k)
        lists.append(ranked(by_terms, "sparse"))
    # At most k rows; their ids go down into the index as a filter.
    rows = fuse(*lists, k=k).collect()
    fused = some.sparkSession.createDataFrame(rows, shape_of(some.schema["id"].dataType))
    found = some.drop("dense").where(F.col("id").isin([r["id"] for r in rows])).join(F.broadcast(fused), "id")
    if provider is not None:
        found = provider.rerank(found, query_text)
    # Of equal scores the card whose own id, a string, is the least comes first.
    return cards(found.orderBy(F.desc("score"), F.coalesce("prompt_id", F.lit("")), "id").limit(n))


def retrieve(index: DataFrame, query_text: str, query_vector: list[float], **how) -> list[dict]:
    """The cards of search(), as rows; whatever goes wrong is logged, and then there are none."""
    try:
        return [r.asDict() for r in search(index, query_text, query_vector, **how).collect()]
    except Exception:  # noqa: BLE001 - a caller of a service gets an empty answer
        logger.exception("retrieval failed")
        return []


def cards(found: DataFrame) -> DataFrame:
    return found.select(
        F.coalesce("prompt_id", F.lit("")).alias("id"), T.word_excerpt(F.col("text")).alias("prompt_excerpt"), F.coalesce("technique", F.lit(UNKNOWN)).alias("technique"),
        F.coalesce("source", F.lit("")).alias("source"), T.confidence(F.col("score")).alias("confidence"), F.coalesce("score", F.lit(0.0)).alias("confidence_score"),
    )


def breakdown(found: DataFrame) -> DataFrame:
    return found.groupBy("technique").agg(F.count(F.lit(1)).alias("n"))


def category_counts(points: DataFrame, dimension: DataFrame) -> DataFrame:
    """All techniques of the dimension with their counts, 0 if none; labels outside it don't show."""
    counts = points.groupBy(F.col("technique").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return dimension.join(counts, "name", "left").select("position", "name", F.coalesce("n", F.lit(0)).cast("long").alias("count"), "icon").orderBy("position")


def lookup(points: DataFrame, prompt_id: str) -> DataFrame:
    """The full text of a prompt; of several points with its id, the least."""
    found = points.where(F.col("prompt_id") == prompt_id).orderBy("id").limit(1)
    return found.select(F.col("prompt_id").alias("id"), F.col("text").alias("full_prompt"), F.coalesce("technique", F.lit(UNKNOWN)).alias("technique"), F.coalesce("source", F.lit("")).alias("source"))


def stats(points: DataFrame) -> DataFrame:
    return points.agg(F.count(F.lit(1)).alias("total_prompts"), F.count_distinct("source").alias("total_sources"))
