"""Exact top-k search by inner product: columnar branch and bound.

Queries and candidates are dealt in blocks, and each pair of blocks is one group. In a group, candidates lie in
vertical layout, one row per dimension, dimensions of most mass first. Products are summed one block of dimensions
after the other; a candidate's score is then known up to the product of the norms of what remains, so candidates
that cannot reach the k-th best lower bound leave, and the survivors are compacted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import table, written
from corpusmill.llm.vectors import block, every, matrix, usable

SCALE = 256
#: Vectors in a block, on average; ids are hashed to blocks.
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 8192
#: Dimensions summed between two rounds of pruning, and queries taken together in the first round.
DIMENSIONS, TOGETHER = 16, 64


def search(queries: np.ndarray, query_ids: np.ndarray, found: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, ids and scores of its k best rows of found, ties to smaller ids; all hold whole numbers."""
    order = np.argsort(-(found**2).sum(axis=0), kind="stable")
    columns, queries = np.ascontiguousarray(found.T[order]), queries[:, order]
    cuts = [*range(0, len(order), DIMENSIONS), len(order)]
    rest = [np.sqrt((columns[c:] ** 2).sum(axis=0)) for c in cuts[1:]]
    query_rest = [np.sqrt((queries[:, c:] ** 2).sum(axis=1)) for c in cuts[1:]]
    out = []
    for first in range(0, len(queries), TOGETHER):
        some = queries[first : first + TOGETHER]
        opening = some[:, : cuts[1]] @ columns[: cuts[1]]
        opening[query_ids[first : first + TOGETHER, None] == ids[None]] = -np.inf
        for j, q in enumerate(some):
            alive, sums = np.flatnonzero(opening[j] > -np.inf), None
            sums = opening[j][alive]
            for step in range(1, len(cuts)):
                slack = rest[step - 1][alive] * query_rest[step - 1][first + j]
                if len(alive) > k:
                    # Scores are whole numbers, so half of one covers what rounding does to the bounds.
                    least = np.partition(sums - slack, len(alive) - k)[len(alive) - k] - 0.5
                    keep = sums + slack >= least
                    alive, sums = alive[keep], sums[keep]
                if step < len(cuts) - 1:
                    a, b = cuts[step], cuts[step + 1]
                    sums = sums + q[a:b] @ columns[a:b, alive]
            top = np.lexsort((ids[alive], -sums))[:k]
            out.append((ids[alive][top], sums[top].astype(np.int64)))
    return out


def search_large(queries: np.ndarray, query_ids: np.ndarray, found: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """As search(), for numbers whose products a double can't hold: in Python's integers. A score beyond 64 bits fails the
    run, as there is no such long."""
    whole = lambda m: [[int(x) for x in row] for row in m]
    out, rows = [], whole(found)
    for q, own in zip(whole(queries), query_ids, strict=True):
        scored = sorted((-sum(a * b for a, b in zip(q, r, strict=True)), i) for r, i in zip(rows, ids, strict=True) if i != own)[:k]
        out.append((np.array([i for _, i in scored], dtype=np.int64), np.array([-s for s, _ in scored], dtype=np.int64)))
    return out


def search_group(group: pa.Table, k: int) -> pa.Table:
    asks = group["asks"].to_numpy()
    ids, numbers = group["vec_id"].to_numpy(), np.floor(SCALE * matrix(group["vector"]))
    queries, found = numbers[asks], numbers[~asks]
    exact = len(numbers) and np.abs(numbers).max() ** 2 * numbers.shape[1] < 2.0**52
    best = (search if exact else search_large)(queries, ids[asks], found, ids[~asks], k) if len(queries) and len(found) else []
    query_ids = np.repeat(ids[asks][: len(best)], [len(i) for i, _ in best])
    none = [np.zeros(0, dtype=np.int64)]
    return pa.table({"query_id": query_ids, "vec_id": np.concatenate([i for i, _ in best] or none), "score": np.concatenate([s for _, s in best] or none)})


def top_k(vectors: DataFrame, is_query, k: int = 5, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """vectors (vec_id, vector) to query_id, rank from 1, vec_id, score: the k best of each query among all others.

    is_query: a condition on vec_id. Unusable vectors and null ids take no part; of several rows with one id the
    least vector counts. Vectors of different lengths are not compared. Other columns are dropped. Fewer candidates
    than k give fewer rows; an empty table gives none.
    """
    rows = vectors.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = written(rows.withColumn("length", F.size("vector")), "topk-vectors")
    asking = is_query(F.col("vec_id"))
    count, asked = rows.agg(F.count(F.lit(1)), F.count_if(asking)).first()
    across, down = max(1, -(-asked // query_block)), max(1, -(-count // candidate_block))
    queries = rows.where(asking).select("vec_id", "vector", "length", F.lit(True).alias("asks"), block(F.col("vec_id"), across, 1).alias("q"), every(down).alias("c"))
    found = rows.select("vec_id", "vector", "length", F.lit(False).alias("asks"), every(across).alias("q"), block(F.col("vec_id"), down, 2).alias("c"))
    groups = queries.unionByName(found).repartition(max(1, across * down), "q", "c", "length").groupBy("q", "c", "length")
    best = groups.applyInArrow(lambda group: search_group(group, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every 50th vector among all the others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return top_k(vectors, lambda i: i % 50 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS n
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.n, c.n), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
