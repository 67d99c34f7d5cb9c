"""Classification, guards and ingestion into the index. Models sit behind providers; the ones here are offline stand-ins."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import normalize, retrieval
from corpusmill.sources import publish, registry
from corpusmill.sources.index import Index

PREFIX, MOST_TOKENS = 1000, 8000
#: Characters of excerpts that an answering provider is shown at once.
CONTEXT = 12_000
POINT = "id string, prompt_id string, source string, text string, dense array<float>, technique string"

#: Words that the offline classifier takes as a sign of a technique.
RULES = [
    ("Persona Hijacking", ["pretend", "persona", "act as", "you are now"]),
    ("Fictional Framing", ["story", "novel", "fiction", "roleplay"]),
    ("Authority Impersonation", ["developer", "administrator", "authorized"]),
    ("Token Manipulation", ["base64", "leetspeak", "encode"]),
    ("Hypothetical Distancing", ["hypothetical", "what if", "imagine"]),
    ("Instruction Injection", ["ignore", "override", "previous instructions"]),
    ("Social Engineering", ["please", "urgent", "trust"]),
    ("Multi-language Switching", ["translate", "language"]),
    ("Payload Splitting", ["part one", "combine", "split"]),
    ("Gradual Escalation", ["step by step", "next step"]),
]


def whitelisted(label: Column, names: list[str] | None = None) -> Column:
    """The label if it is one of the names, else Unknown."""
    names = [n for n, _ in registry.TECHNIQUES] if names is None else names
    return F.when(label.isin(*names), label).otherwise(registry.UNKNOWN)


@dataclass
class Rules:
    """A classifier by the first rule with a word in the text; expressions only."""

    rules: list[tuple[str, list[str]]] = field(default_factory=lambda: RULES)

    def label(self, text: Column) -> Column:
        lowered, found = F.lower(text), F.lit(None).cast("string")
        for name, words in reversed(self.rules):
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(lowered, F.lit(w))
            found = F.when(hit, name).otherwise(found)
        return found


@dataclass
class HashedEmbedder:
    """Vectors of hashed words of unit length: deterministic, no stand-in for a model's meaning."""

    size: int = 64

    def embed(self, text: Column) -> Column:
        size = self.size

        def run(column: pa.Array) -> pa.Array:
            import xxhash

            words = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(column, "")))
            flat = pc.list_flatten(words).dictionary_encode()
            # A word of the batch is hashed once; the split leaves empty ones at the ends of a text, which count for nothing.
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()] or [0], np.uint64)
            signs = np.where(hashes >> np.uint64(63), 1.0, -1.0) * np.array([w != "" for w in flat.dictionary.to_pylist()] or [False])
            at, rows = flat.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
            sums = np.bincount(rows * size + (hashes % np.uint64(size)).astype(np.int64)[at], signs[at], len(column) * size).reshape(-1, size)
            norms = np.sqrt((sums**2).sum(axis=1, keepdims=True))
            values = (sums / np.where(norms > 0, norms, 1.0)).astype(np.float32)
            return pa.ListArray.from_arrays(pa.array(range(0, values.size + 1, size), pa.int32()), values.ravel())

        return F.arrow_udf(run, "array<float>")(text)

    def one(self, spark: SparkSession, text: str) -> list[float]:
        return list(spark.range(1).select(self.embed(F.lit(text))).first()[0])


@dataclass
class Overlap:
    """A reranker by the share of the query's words that a text has."""

    def rerank(self, found: DataFrame, query: str) -> DataFrame:
        asked = F.array_distinct(F.filter(F.split(F.lower(F.lit(query)), r"[^\p{L}\p{N}]+"), lambda t: t != ""))
        have = F.filter(F.split(F.lower(F.col("text")), r"[^\p{L}\p{N}]+"), lambda t: t != "")
        return found.withColumn("score", F.round(F.size(F.array_intersect(asked, have)) / F.greatest(F.size(asked), F.lit(1)), 6))


def packed(excerpts: Iterable[str], most: int = CONTEXT) -> list[str]:
    """Excerpts as contexts of at most so many characters each; an excerpt that is longer by itself is one."""
    contexts: list[str] = []
    for x in excerpts:
        if contexts and len(contexts[-1]) + 1 + len(x) <= most:
            contexts[-1] += " " + x
        else:
            contexts.append(x)
    return contexts


@dataclass
class Extractive:
    """A stand-in for a model that writes answers: the words of the contexts, up to a limit."""

    words: int = 300

    def answer(self, query: str, context: str) -> str:
        return " ".join(context.split()[: self.words])

    def refine(self, query: str, answer: str, context: str) -> str:
        return self.answer(query, f"{answer} {context}")


def synthesize(query: str, excerpts: Iterable[str], provider=None) -> str:
    """An answer from excerpts: a provider answers from the first context, and refines that with each further one."""
    provider, contexts = provider or Extractive(), packed(excerpts)
    found = provider.answer(query, contexts[0]) if contexts else ""
    for context in contexts[1:]:
        found = provider.refine(query, found, context)
    return found


def classify(records: DataFrame, provider=None) -> DataFrame:
    """records with technique, from the first 1000 characters of text; what isn't a known label is Unknown."""
    provider = provider or Rules()
    return records.withColumn("technique", whitelisted(provider.label(F.substring("text", 1, PREFIX))))


def token_count(text: Column) -> Column:
    """Words, as a stand-in for an embedding model's tokens."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")).cast("long")


def within_limit(records: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    return records.where(token_count(F.col("text")) <= most)


def points(classified: DataFrame, embedder=None) -> DataFrame:
    embedder = embedder or HashedEmbedder()
    id_ = T.legacy_id(F.col("source"), F.col("text"))
    rows = classified.withColumn("id", id_).withColumn("dense", embedder.embed(F.col("text")))
    prompt = F.col("prompt_id") if "prompt_id" in classified.columns else F.substring_index("id", "__", -1)
    return rows.select("id", prompt.alias("prompt_id"), "source", "text", "dense", "technique")


def ingest(records: DataFrame, checkpoint: str, index: str, provider=None, embedder=None) -> dict[str, int]:
    """Records (prompt_id, source, text) into the index: those done before are skipped, too long ones left out.

    Classified records are added to the checkpoint before the index is replaced, so a run that was broken off goes
    on where it ended; the checkpoint goes when all is in the index.
    """
    spark = records.sparkSession
    schema = "prompt_id string, source string, text string, technique string"
    done = publish.checkpoint(spark, checkpoint, schema)
    publish.append_checkpoint(classify(normalize.resume(records, done), provider).select("prompt_id", "source", "text", "technique"), checkpoint)
    everything = publish.checkpoint(spark, checkpoint, schema)
    kept = within_limit(everything)
    whole = Index(spark, index)
    whole.upsert(points(kept, embedder))
    if (stored := whole.points()) is not None:
        retrieval.Postings.build(stored.select("id", "text"), f"{index}-postings")
    counts = {"records": everything.count(), "kept": kept.count()}
    publish.remove(spark, checkpoint)
    return counts | {"skipped": counts["records"] - counts["kept"]}


def run_summary(results: DataFrame) -> DataFrame:
    """Status counts over sources (source_name, required, status)."""
    failed = F.col("status") != "success"
    counts = [F.count_if(~failed).alias("success_count"), F.count_if(failed).alias("failed_count"), F.count_if(failed & F.col("required")).alias("required_failed_count"), F.count_if(failed & ~F.col("required")).alias("optional_failed_count")]
    return results.agg(F.count(F.lit(1)).alias("source_count"), *counts).withColumn("all_required_succeeded", F.col("required_failed_count") == 0)


def snapshot_totals(snapshots: DataFrame) -> DataFrame:
    """Bytes and records of each source's snapshots; records is null if none could be counted."""
    return snapshots.groupBy("source_name").agg(F.count(F.lit(1)).alias("snapshot_count"), F.sum("byte_count").alias("total_bytes"), F.sum("record_count").alias("total_records"))
