"""Language ID by Bayesian evidence fusion.

The posterior of a language is the product of the text's likelihood (hashed letter trigrams), the likelihood of the
language that the markup declares, and the prior of the host, which is smoothed towards that of its address suffix
and that towards the whole table's. Priors and the reliability of declarations come from grouped aggregation of
what the texts alone say; a row's own vote is taken out of its priors. A background, by which all trigrams are alike,
stands for all other languages and for junk: a text that it explains better than any language does is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import textnum as tn
from corpusmill.llm.common import let, running, small_side, table, written

LANGUAGES = ("en", "fr", "de", "es")
BITS = 16
#: The model is fitted on at most so many labelled rows a language, those with the least hashes of their ids.
TRAIN_ROWS = 2_000
#: Trigrams of one text are far from independent, so they count as so many independent ones at most.
MOST_TRIGRAMS = 40
#: Pseudo-counts: of a trigram, of a host's and a suffix's prior, of a declaration's reliability.
GRAM_COUNT, PRIOR_COUNT, DECLARED_COUNT = 0.5, 8.0, 2.0
#: A document is rejected if it has no letters or if no language has at least this posterior.
LEAST_POSTERIOR = 0.5
#: Of the background: its prior, and how far its log likelihood of a trigram lies on the way from what a language's own
#: trigrams have on average to what one has that the model never saw.
OTHER_PRIOR, OTHER_WAY = 1e-6, 0.6
#: Joined by broadcast up to so many hosts (100 bytes each), else by a shuffle.
BROADCAST_HOSTS = 50_000
#: Letters of any script keep their bytes; all else is a blank.
LETTERS = np.full(256, 32, dtype=np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table index of the trigram at each byte, and whether it lies within one text and has a letter."""
    x = np.concatenate([LETTERS[data], np.full(2, 32, dtype=np.uint8)]).astype(np.uint32)
    a, b, c = x[:-2], x[1:-1], x[2:]
    code = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))) >> np.uint32(32 - BITS)
    use = (a != 32) | (b != 32)
    for back in (1, 2):
        last = off[1:] - back
        use[last[last >= off[:-1]]] = False
    return code, use


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (n, text) to (n, code, count) of the partition."""
    totals = np.zeros((len(LANGUAGES), 1 << BITS))
    for batch in batches:
        numbers = batch["n"].to_numpy()
        for data, off, first in tn.chunks(batch["text"]):
            code, use = trigrams(data, off)
            of = np.repeat(numbers[first : first + len(off) - 1], np.diff(off))
            for n in range(len(LANGUAGES)):
                totals[n] += np.bincount(code[use & (of == n)], minlength=1 << BITS)
    n, code = np.nonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(totals[n, code].astype(np.int64))], ["n", "code", "count"])


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Log likelihoods, language by trigram, from labelled (id, text, lang): at most `rows` rows of each language."""
    names = F.array(*[F.lit(x) for x in LANGUAGES])
    ids = labelled.where(F.col("lang").isin(*LANGUAGES)).select("id", "lang", F.xxhash64("id").alias("h"))
    picked = None
    for lang in LANGUAGES:
        some = ids.where(F.col("lang") == lang).orderBy("h").limit(rows)
        picked = some if picked is None else picked.unionByName(some)
    # At most len(LANGUAGES) * rows ids.
    sample = labelled.join(F.broadcast(picked.select("id").distinct()), "id", "left_semi").where(F.col("lang").isin(*LANGUAGES))
    texts = sample.select((F.array_position(names, F.col("lang")) - 1).cast("int").alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    counts = texts.mapInArrow(count_trigrams, "n int, code int, count long").groupBy("n", "code").agg(F.sum("count").alias("count"))
    totals = np.full((len(LANGUAGES), 1 << BITS), GRAM_COUNT)
    for r in counts.toLocalIterator():  # at most languages * 2^BITS rows
        totals[r["n"], r["code"]] += r["count"]
    return np.log(totals / totals.sum(axis=1, keepdims=True)).astype(np.float32)


def background(model: np.ndarray) -> float:
    """The background's log likelihood of a trigram. It depends on the model, as one fitted on little knows little."""
    own = (np.exp(model.astype(np.float64)) * model).sum(axis=1).mean()
    return float(own + OTHER_WAY * (model.min(axis=1).mean() - own))


def likelihoods(texts: pa.Array, model: np.ndarray) -> pa.Array:
    """For each text the tempered log likelihoods of each language and of the background and, last, the number of its
    trigrams."""
    out, other = np.zeros((len(texts), len(model) + 2)), background(model)
    for data, off, first in tn.chunks(texts):
        code, use = trigrams(data, off)
        last = first + len(off) - 1
        many = np.concatenate([[0], np.cumsum(use)])
        many = many[off[1:]] - many[off[:-1]]
        out[first:last, -1] = many
        out[first:last, -2] = np.minimum(many, MOST_TRIGRAMS) * other
        for n, row in enumerate(model):
            sums = np.concatenate([[0.0], np.cumsum(np.where(use, row[code], 0), dtype=np.float64)])
            out[first:last, n] = (sums[off[1:]] - sums[off[:-1]]) / np.maximum(many, 1) * np.minimum(many, MOST_TRIGRAMS)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))


def softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def best(chances: Column) -> Column:
    return (F.array_position(chances, F.array_max(chances)) - 1).cast("int")


def votes(n: Column) -> list[Column]:
    """Grouped counts by language of the column n."""
    return [F.count_if(n == k).cast("double") for k in range(len(LANGUAGES))]


def identify(df: DataFrame, model: np.ndarray, text: Column, declared: Column, host: Column, suffix: Column, keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all, if not named) with language (null if rejected), posterior and accepted; columns of these
    names are replaced.

    Null or unknown declarations, hosts and suffixes are no evidence or a host of their own; a null or empty text
    has no letters and is rejected. Repeated rows are separate votes. Rows are kept as they are, however many a
    host has: counts are summed before they are exchanged. An empty table stays empty. Texts are read by Python once: what
    it makes of them is written beside the columns to keep.
    """
    zeros, size = F.array_repeat(F.lit(0.0), len(LANGUAGES)), len(LANGUAGES)
    kept = [c for c in keep or df.columns if c.lower() not in ("language", "posterior", "accepted")]
    known = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LANGUAGES]), F.lower(F.substring(F.trim(declared), 1, 2))), F.lit(0)).cast("int") - 1
    said = F.arrow_udf(lambda texts: likelihoods(texts, model), "array<double>")(text)
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), said.alias("said"), known.alias("declared"),
        F.coalesce(host, F.lit("")).alias("host"), F.coalesce(suffix, F.lit("")).alias("suffix"),
    )
    rows = written(rows, "langid-rows")
    even = [0.0] * size + [math.log(OTHER_PRIOR * size)]
    alone = best(softmax(F.zip_with(F.slice("said", 1, size + 1), F.array(*[F.lit(x) for x in even]), lambda x, y: x + y)))
    rows = rows.withColumn("vote", F.when((F.get("said", F.lit(size + 1)) > 0) & (alone < size), alone))
    voted = rows.where("vote is not null").select("vote", "declared", "host", "suffix")
    counted = written(voted.groupBy("suffix", "host", "declared", "vote").count(), "langid-votes")
    by = lambda *keys: counted.groupBy(*keys).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("vote") == k, F.col("count"))), F.lit(0)).cast("double") for k in range(size)]).alias("votes"))

    overall = F.array(*[F.lit(float(x)) for x in (by().first() or [[0.0] * size])[0]])
    trust = np.full((size + 1, size), DECLARED_COUNT / size)  # of a declaration (last: none), given the language
    for r in counted.groupBy("declared", "vote").agg(F.sum("count").alias("count")).collect():  # (languages + 1) * languages rows
        trust[r["declared"], r["vote"]] += r["count"]
    for k in range(size):
        trust[k, k] += DECLARED_COUNT
    trust = np.log(trust / trust.sum(axis=0))
    trusted = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in trust])
    hosts = by("suffix", "host").select("suffix", "host", F.col("votes").alias("host_votes"))
    suffixes = by("suffix").select("suffix", F.col("votes").alias("suffix_votes"))
    hosts = written(hosts.join(suffixes, "suffix"), "langid-hosts")
    rows = rows.join(small_side(hosts, BROADCAST_HOSTS), ["suffix", "host"], "left")

    own = F.transform(zeros, lambda _, k: F.when(F.col("vote") == k, 1.0).otherwise(0.0))
    less = lambda a: F.zip_with(F.coalesce(a, zeros), own, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    smooth = lambda a, prior: F.zip_with(a, prior, lambda x, p: (x + PRIOR_COUNT * p) / (total(a) + PRIOR_COUNT))
    rows = rows.withColumn("whole", less(overall)).withColumn("whole", F.transform("whole", lambda x: (x + 1) / (total(F.col("whole")) + size)))
    rows = rows.withColumn("sv", less(F.col("suffix_votes"))).withColumn("prior", smooth(F.col("sv"), F.col("whole")))
    rows = rows.withColumn("hv", less(F.col("host_votes"))).withColumn("prior", smooth(F.col("hv"), F.col("prior")))
    evidence = F.when(F.col("declared") >= 0, F.get(trusted, F.col("declared"))).otherwise(zeros)
    fused = F.zip_with(F.zip_with(F.slice("said", 1, size), F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b), evidence, lambda a, b: a + b)
    other = F.get("said", F.lit(size)) + math.log(OTHER_PRIOR)
    rows = rows.withColumn("post", F.slice(softmax(F.concat(fused, F.array(other))), 1, size))
    accepted = F.coalesce((F.array_max("post") >= LEAST_POSTERIOR) & (F.get("said", F.lit(size + 1)) > 0), F.lit(False))
    return rows.select(
        *[F.col("row")[c].alias(c) for c in kept],
        F.when(accepted, F.get(F.array(*[F.lit(x) for x in LANGUAGES]), best(F.col("post")))).alias("language"), F.array_max("post").alias("posterior"), accepted.alias("accepted"),
    )


#: Where the text of a page may be hidden from: scripts, styles and comments begin and end there.
EDGES = r"(?i)<(?:script|style)\b|<!--|</(?:script|style)\s*+>|-->"


def page_text(html: Column) -> Column:
    """What a page shows, roughly: without scripts, styles, comments, tags and entities. One that does not end hides the
    rest, as in a browser. The page is read once, from edge to edge, however many there are."""

    def move(hidden: Column, mark: Column) -> Column:
        opens = F.when(mark.startswith("<sc"), 1).when(mark.startswith("<st"), 2).when(mark == "<!--", 3).otherwise(0)
        closes = F.when(mark.startswith("</sc"), 1).when(mark.startswith("</st"), 2).when(mark == "-->", 3).otherwise(0)
        return F.when(hidden == 0, opens).when(hidden == closes, 0).otherwise(hidden)

    def shown(marks: Column) -> Column:
        hidden = F.concat(F.array(F.lit(0)), running(marks, F.lit(0), move))
        gaps = F.arrays_zip(F.split(html, EDGES, -1).alias("gap"), hidden.alias("hidden"))
        return F.array_join(F.transform(F.filter(gaps, lambda g: g["hidden"] == 0), lambda g: g["gap"]), " ")

    bare = F.when(html.rlike(EDGES), let(F.transform(F.regexp_extract_all(html, F.lit(EDGES), 0), F.lower), shown)).otherwise(html)
    return F.regexp_replace(F.regexp_replace(bare, "<[^<>]*+>", " "), r"&#?\w{1,10};", " ")


def declared_language(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?i)<html\b[^<>]*?\blang\s*+=\s*+[\"']?([A-Za-z]{2,3})", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1), F.lit("")))


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def fit_documents(docs: DataFrame) -> np.ndarray:
    return fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, by their markup and addresses, and all documents, by their declared language and source."""
    docs = table(spark, sf_dir, "documents")
    model = fit_documents(docs)
    pages = table(spark, sf_dir, "pages").select("page_id", page_text(F.col("html")).alias("text"), declared_language(F.col("html")).alias("declared"), host_of(F.col("url")).alias("host"))
    pages = pages.withColumn("suffix", suffix_of(F.col("host"))).withColumn("doc_id", F.lit(None).cast("long"))
    rows = docs.select(F.lit(None).cast("long").alias("page_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit("documents").alias("suffix"), "doc_id")
    rows = rows.unionByName(pages)
    found = identify(rows, model, F.col("text"), F.col("declared"), F.col("host"), F.col("suffix"), keep=["doc_id", "page_id", "declared"])
    return found.select("doc_id", "page_id", "declared", "language", "posterior", "accepted", F.col("accepted").alias("kept"))
