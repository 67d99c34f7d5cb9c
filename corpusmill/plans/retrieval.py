"""Sampling, retrieval and reporting queries over the tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import clusters, ingest, retrieval, sampling, taxonomy
from corpusmill.plans.common import SQL_CORPUS, corpus, sql_bucket, sql_excerpt, sql_word_excerpt, table
from corpusmill.sources import publish, registry

#: Words of the synthetic texts, for sparse search.
ASKED = ["the", "tion", "nicht"]
DIMENSION = [("view", "v"), ("click", "c"), ("purchase", "p"), ("no_such_type", "n")]
SCORES = [0.7, 0.4, 0.39, None, 1.0, 0.0]


def quota_allocation_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    return spark.createDataFrame(list(sampling.allocate({r["lang"]: r["n"] for r in counts}).items()), "source string, quota bigint")


def round1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.select_round(corpus(spark, sf_dir), None, 1)


def round2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    return sampling.select_round(docs, publish.kept(sampling.select_round(docs, None, 1).select("prompt_id"), "round1"), 2)


def category_counts_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("technique"))
    return retrieval.category_counts(events, registry.techniques(spark, DIMENSION)).select("name", "count", "icon")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with the documents of their numbers: a convention of these tables only."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("technique"), F.col("embedding").alias("dense"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("prompt_id"), "source", "text")
    return vectors.join(docs, "id")


def stored(spark: SparkSession, sf_dir: str, name: str, docs: DataFrame, *tables: str, kind: type = retrieval.Postings):
    """The index of docs, as ingestion leaves it: built where there is none yet for these tables' files and this layout."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{sf_dir}/{t}.parquet" for t in tables])
    state = files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).cast("string")).first()[0]
    path = f"{publish.shared_dir(spark)}/corpusmill/{kind.__name__.lower()}-{name}-{hashlib.md5(f'{retrieval.LAYOUT} {sf_dir} {state}'.encode()).hexdigest()}"
    return kind(path) if publish.exists(spark, path) else kind.build(docs, path)


def documents_index(spark: SparkSession, sf_dir: str) -> retrieval.Postings:
    return stored(spark, sf_dir, "documents", table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "documents")


def asked_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


def dense_of(spark: SparkSession, sf_dir: str, category: str | None = None) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("dense"))
    vectors = vectors if category is None else vectors.where(F.col("label") == int(category))
    return retrieval.dense(vectors, asked_vector(spark, sf_dir))


def dense_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_of(spark, sf_dir)


def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_of(spark, sf_dir, "3")


def stored_vectors(spark: SparkSession, sf_dir: str) -> clusters.Clusters:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("technique"), F.col("embedding").alias("dense"))
    return stored(spark, sf_dir, "embeddings", vectors, "embeddings", kind=clusters.Clusters)


def dense_topk_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest points by the stored index."""
    return stored_vectors(spark, sf_dir).top(spark, asked_vector(spark, sf_dir))


def dense_topk_clusters_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_vectors(spark, sf_dir).top(spark, asked_vector(spark, sf_dir), technique="3")


def sparse_topk_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).top(spark, ASKED)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(retrieval.ranked(dense_of(spark, sf_dir), "dense"), retrieval.ranked(sparse_topk_bm25(spark, sf_dir), "sparse"))


def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sparse search finds, scored again by the share of the query's words that a text has."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = docs.join(F.broadcast(sparse_topk_bm25(spark, sf_dir)), "id")
    return ingest.Overlap().rerank(found, " ".join([*ASKED, "absent"])).select("id", "score")


def hybrid_search_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = index(spark, sf_dir)
    return retrieval.search(both, " ".join(ASKED), asked_vector(spark, sf_dir), stored=stored(spark, sf_dir, "indexed", both.select("id", "text"), "documents", "embeddings"))


def technique_breakdown_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dense_of(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("technique")), "id")
    return retrieval.breakdown(found)


def confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dense_of(spark, sf_dir).select("id", "score")
    fixed = spark.createDataFrame([(-1 - n, s) for n, s in enumerate(SCORES)], "id bigint, score double")
    return found.unionByName(fixed).select("id", T.confidence(F.col("score")).alias("confidence"))


def prompt_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    points = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("prompt_id"), "source", "text", F.lit(None).cast("string").alias("technique"))
    return retrieval.lookup(points, "17")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.stats(table(spark, sf_dir, "documents"))


def postings_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All postings: how often each term occurs in each document, and the document's size."""
    return retrieval.postings(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")).select("term", "id", "tf", "size")


def saturation_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of events as rounds, with users that were not seen before as news."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"))
    fresh = events.groupBy("user_id").agg(F.min("day").alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("new_categories"))
    days = events.groupBy("day").agg(F.count(F.lit(1)).alias("samples")).join(fresh, "day", "left")
    rounds = days.select(F.datediff("day", F.lit("2024-01-01")).cast("long").alias("round"), "samples", F.coalesce("new_categories", F.lit(0)).alias("new_categories"))
    return taxonomy.saturation(rounds)


def run_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: filled ones have succeeded, urgent ones were required."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed")
    return ingest.run_summary(orders.select(F.col("o_orderkey").cast("string").alias("source_name"), F.col("o_orderpriority").startswith("1").alias("required"), status.alias("status")))


def snapshot_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as snapshots: those of a priority whose number is odd couldn't be counted."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderpriority").alias("source_name"), F.col("o_custkey").alias("byte_count"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("record_count"))
    return ingest.snapshot_totals(rows)


QUERIES = {
    "quota_allocation_lang": quota_allocation_lang,
    "round1_sample": round1_sample,
    "round2_sample_unseen": round2_sample,
    "category_counts_dim": category_counts_dim,
    "technique_breakdown_topk": technique_breakdown_topk,
    "dense_topk_cosine": dense_topk_cosine,
    "dense_topk_filtered": dense_topk_filtered,
    "dense_topk_clusters": dense_topk_clusters,
    "dense_topk_clusters_filtered": dense_topk_clusters_filtered,
    "sparse_topk_bm25": sparse_topk_bm25,
    "rrf_fusion": rrf_fusion,
    "rerank_overlap": rerank_overlap,
    "hybrid_search_cards": hybrid_search_cards,
    "confidence_buckets": confidence_buckets,
    "prompt_lookup": prompt_lookup,
    "corpus_stats": corpus_stats,
    "postings_by_term": postings_by_term,
    "saturation_streak": saturation_streak,
    "run_status_summary": run_status_summary,
    "snapshot_totals": snapshot_totals,
}


def sql_allocation(counts: str, name: str, rounds: int = 6) -> str:
    """Common table expressions that end in `name` (source, quota): the sharing of a budget of 500, a few rounds of it."""
    steps = [
        f"{name}_c AS ({counts})",
        f"{name}_0 AS (SELECT source, n, least(n, 6) AS got, least(n, greatest(ceil(500 * greatest(0.35, 1 / (SELECT count(*) FROM {name}_c))), least(n, 6))) AS cap FROM {name}_c)",
    ]
    for k in range(rounds):
        steps += [
            f"{name}_a{k} AS (SELECT *, (SELECT 500 - sum(got) FROM {name}_{k}) AS rest, sum(CASE WHEN got < cap THEN n - got END) OVER () AS total FROM {name}_{k})",
            f"{name}_b{k} AS (SELECT *, CASE WHEN got < cap THEN rest * (n - got) / total ELSE 0 END AS ideal FROM {name}_a{k})",
            f"{name}_d{k} AS (SELECT *, least(cap - got, floor(ideal)) AS whole FROM {name}_b{k})",
            f"""{name}_e{k} AS (SELECT *, row_number() OVER (PARTITION BY cap - got - whole > 0 ORDER BY floor(ideal) - ideal, got - n, source) AS place,
              rest - sum(whole) OVER () AS spare FROM {name}_d{k})""",
            f"{name}_{k + 1} AS (SELECT source, n, CAST(got + whole + CASE WHEN cap - got - whole > 0 AND place <= spare THEN 1 ELSE 0 END AS BIGINT) AS got, cap FROM {name}_e{k})",
        ]
    steps.append(f"{name} AS (SELECT source, got AS quota FROM {name}_{rounds})")
    return ", ".join(steps)


def sql_round(records: str, name: str, number: int) -> str:
    """Common table expressions that end in `name`: a round's sample from a relation of records."""
    seed = sampling.SEED
    return f"""{name}_r AS (SELECT *, {sql_bucket("text")} AS bucket FROM {records}),
{sql_allocation(f"SELECT source, count(*) AS n FROM {name}_r GROUP BY source", f"{name}_q")},
{name}_h AS (SELECT *, sha256('{seed}:' || source || ':' || source_file || ':' || prompt_id) AS rh,
  sha256('{seed}:stratum:' || source || ':(''' || source || ''', ''' || source_file || ''', ''' || bucket || ''')') AS sh FROM {name}_r),
{name}_t AS (SELECT *, row_number() OVER (PARTITION BY source, source_file, bucket ORDER BY rh, prompt_id) AS turn FROM {name}_h),
{name}_p AS (SELECT t.*, row_number() OVER (PARTITION BY t.source ORDER BY turn, sh) AS place, quota FROM {name}_t t JOIN {name}_q q ON t.source = q.source),
{name} AS (SELECT 'R{number:02d}S' || printf('%03d', row_number() OVER (ORDER BY source, place)) AS sample_id, prompt_id, source, source_file, source_row, bucket AS prompt_length_bucket,
  {sql_excerpt("text")} AS excerpt, source || '|' || source_file || '|' || bucket AS stratification_signature FROM {name}_p WHERE place <= quota)"""


COSINE = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[]))"
SQL_DENSE = f"SELECT vec_id AS id, round({COSINE}, 6) AS score FROM embeddings WHERE TRUE ORDER BY score DESC, id LIMIT 20"


def sql_sparse(docs: str = "documents") -> str:
    parts = " + ".join(f"ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * size / mean))" for k in range(len(ASKED)))
    tf = ", ".join(f"len(list_filter(terms, lambda t: t = '{w}')) AS tf{k}" for k, w in enumerate(sorted(ASKED)))
    df = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(ASKED)))
    return rf"""SELECT id, round({parts}, 6) AS score FROM
  (SELECT id, len(terms) AS size, {tf} FROM (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS terms FROM {docs})) x,
  (SELECT count(*) AS n, avg(size) AS mean, {df} FROM (SELECT len(terms) AS size, {tf} FROM (SELECT list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS terms FROM {docs})))
WHERE score > 0 ORDER BY score DESC, id LIMIT 20"""


def sql_fused(docs: str = "documents", dense: str = SQL_DENSE) -> str:
    ranked = "SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM"
    return f"""SELECT id, round(sum(1 / (60 + rank)), 9) AS score FROM ({ranked} ({dense}) UNION ALL {ranked} ({sql_sparse(docs)}))
GROUP BY id ORDER BY score DESC, id LIMIT 20"""


CONFIDENCE = "CASE WHEN coalesce(score, 0) >= 0.7 THEN 'HIGH' WHEN coalesce(score, 0) >= 0.4 THEN 'MED' ELSE 'LOW' END"
INDEXED = "(SELECT d.* FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"
ORACLES = {
    "quota_allocation_lang": f"WITH {sql_allocation('SELECT lang AS source, count(*) AS n FROM documents GROUP BY lang', 'q')} SELECT source, quota FROM q",
    "round1_sample": f"WITH {sql_round(SQL_CORPUS, 'a', 1)} SELECT * FROM a",
    "round2_sample_unseen": f"WITH {sql_round(SQL_CORPUS, 'a', 1)}, {sql_round(f'(SELECT * FROM {SQL_CORPUS} WHERE prompt_id NOT IN (SELECT prompt_id FROM a))', 'b', 2)} SELECT * FROM b",
    "category_counts_dim": f"SELECT name, count(event_id) AS count, icon FROM (VALUES {', '.join(map(str, DIMENSION))}) AS d(name, icon) LEFT JOIN events ON event_type = name GROUP BY name, icon",
    "technique_breakdown_topk": f"SELECT label AS technique, count(*) AS n FROM ({SQL_DENSE}) JOIN embeddings ON id = vec_id GROUP BY label",
    "dense_topk_cosine": SQL_DENSE,
    "dense_topk_filtered": SQL_DENSE.replace("WHERE TRUE", "WHERE label = 3"),
    "dense_topk_clusters": SQL_DENSE,
    "dense_topk_clusters_filtered": SQL_DENSE.replace("WHERE TRUE", "WHERE label = 3"),
    "sparse_topk_bm25": sql_sparse(),
    "rrf_fusion": sql_fused(),
    "rerank_overlap": rf"""
SELECT doc_id AS id, round(len(list_intersect([{", ".join(f"'{w}'" for w in ASKED)}, 'absent'], regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'))) / {len(ASKED) + 1}, 6) AS score
FROM documents WHERE doc_id IN (SELECT id FROM ({sql_sparse()}))""",
    "hybrid_search_cards": f"""
SELECT CAST(id AS VARCHAR) AS id, {sql_word_excerpt("text")} AS prompt_excerpt, CAST(label AS VARCHAR) AS technique, source, {CONFIDENCE} AS confidence, score AS confidence_score
FROM ({sql_fused(INDEXED, SQL_DENSE.replace("WHERE TRUE", "WHERE vec_id IN (SELECT doc_id FROM documents)"))}) JOIN documents ON id = doc_id JOIN embeddings ON id = vec_id
ORDER BY score DESC, id LIMIT 5""",
    "confidence_buckets": f"SELECT id, {CONFIDENCE} AS confidence FROM (({SQL_DENSE}) UNION ALL SELECT -1, 0.7 UNION ALL SELECT -2, 0.4 UNION ALL SELECT -3, 0.39 UNION ALL SELECT -4, NULL UNION ALL SELECT -5, 1.0 UNION ALL SELECT -6, 0.0)",
    "prompt_lookup": "SELECT '17' AS id, text AS full_prompt, 'Unknown' AS technique, source FROM documents WHERE doc_id = 17",
    "corpus_stats": "SELECT count(*) AS total_prompts, count(DISTINCT source) AS total_sources FROM documents",
    "postings_by_term": r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS terms FROM documents),
u AS (SELECT doc_id, unnest(terms) AS term, len(terms) AS size FROM t)
SELECT term, doc_id AS id, count(*) AS tf, size FROM u GROUP BY term, doc_id, size""",
    "saturation_streak": """
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day FROM events),
f AS (SELECT day, count(*) AS fresh FROM (SELECT user_id, min(day) AS day FROM e GROUP BY user_id) GROUP BY day),
r AS (SELECT CAST(day - DATE '2024-01-01' AS BIGINT) AS round, samples, coalesce(fresh, 0) AS fresh FROM (SELECT day, count(*) AS samples FROM e GROUP BY day) LEFT JOIN f USING (day))
SELECT round, CAST(sum(samples) OVER w AS BIGINT) AS analyzed, CAST(round - coalesce(max(CASE WHEN fresh > 0 THEN round END) OVER w, 0) AS BIGINT) AS streak
FROM r WINDOW w AS (ORDER BY round ROWS UNBOUNDED PRECEDING)""",
    "run_status_summary": """
SELECT count(*) AS source_count, count(*) FILTER (good) AS success_count, count(*) FILTER (NOT good) AS failed_count,
  count(*) FILTER (NOT good AND required) AS required_failed_count, count(*) FILTER (NOT good AND NOT required) AS optional_failed_count,
  required_failed_count = 0 AS all_required_succeeded
FROM (SELECT o_orderstatus = 'F' AS good, starts_with(o_orderpriority, '1') AS required FROM orders)""",
    "snapshot_totals": """
SELECT o_orderpriority AS source_name, count(*) AS snapshot_count, CAST(sum(o_custkey) AS BIGINT) AS total_bytes, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END) AS BIGINT) AS total_records
FROM orders GROUP BY o_orderpriority""",
}
