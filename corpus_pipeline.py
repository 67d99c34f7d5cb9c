"""From raw documents to token ids, in stages that are each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Nulls
in any column, empty texts, repeated rows and extra columns pass through as each stage's docstring says; empty
tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import langid, mixing, secrets, text_dedup
from corpusmill.llm.bpe import ByteBpe, n_ids
from corpusmill.llm.common import n_words, small_side, table, written

#: SQL has no way to express these stages; tests hold them against a plain version.
ORACLE_SQL = None
RANKS = "byte_bpe_multi_50k.tiktoken"


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if it has that column, of its present texts."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the known languages; those without letters and those in doubt go."""
    rows = docs.select(F.struct("*").alias("doc"))
    of = lambda c: F.col("doc")[c]
    found = langid.identify(rows, langid.fit_documents(docs), of("text"), of("lang"), of("source"), F.lit("documents"))
    return found.where("accepted").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least id; of equal ids that whose text has the least
    hash. Each different text of an id is a document, and rows alike in id and text are one. Rows without an id stay,
    as do texts without a word."""
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = written(again, "pipeline-repeated")
    if again.isEmpty():
        found = written(text_dedup.near_duplicates(docs), "pipeline-classes")
        gone = found.where("doc_id is not null and not kept").select("doc_id").distinct()
        return docs.join(small_side(gone, text_dedup.BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)
    # Texts of a repeated id get a key each, others keep their id for one.
    again = small_side(again.withColumn("__again", F.lit(True)), text_dedup.BROADCAST_IDS)
    key = F.when(F.col("__again"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long"))
    keyed = docs.join(again, "doc_id", "left").withColumn("__key", key)
    found = written(text_dedup.near_duplicates(keyed.select("__key", "text"), doc_id="__key"), "pipeline-classes")
    found = found.where("doc_id is not null").select(F.col("doc_id").alias("__key"), "component_id").distinct()
    names = keyed.where("__again").select("__key", F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash")).distinct()
    place = F.struct(F.coalesce("id", "__key"), F.coalesce("hash", F.lit(0)), F.col("__key").alias("key"))
    first = found.join(names, "__key", "left").groupBy("component_id").agg(F.min(place)["key"].alias("__key"))
    gone = written(found.join(first, "__key", "left_anti").select("__key"), "pipeline-gone")
    kept = keyed.join(small_side(gone, text_dedup.BROADCAST_IDS), "__key", "left_anti")
    once = kept.where("__again").dropDuplicates(["__key"])
    return kept.where("__again is null").select(*docs.columns).unionByName(once.select(*docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced."""
    return measured(secrets.redact(secrets.scan(docs, to="__spans"), spans="__spans")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, always whole: the one that meets the budget of its source within it
    is taken once more if that lands nearer the target, else not. So a source is off its target by half of that
    document at most, and none is taken more than mixing.EPOCHS times.

    Documents without a word are not in the mix.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct("*").alias("doc"))
    mixed = mixing.mix(rows, mixing.quality_weights(table(spark, sf_dir, "labels")), payload="doc")
    # The target less what whole copies up to here give; a tail is only left where copies < EPOCHS.
    missing = F.col("tail") + F.col("target") - F.floor("target")
    more = F.when((F.col("tail") > 0) & (2 * missing >= F.col("size")), 1).otherwise(0)
    times = (F.col("copies") + more).cast("int")
    return mixed.select("doc", F.explode(F.array_repeat(F.lit(0), times))).select("doc.*").select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: little-endian unsigned 32-bit integers, and how many."""
    import public_tokenizers

    bpe = ByteBpe(spark, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    ids = bpe.encode(docs, keep=[c for c in ("doc_id", "lang", "source") if c in docs.columns])
    return ids.withColumn("n_tokens", n_ids("ids"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
