"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features are words, word pairs, word shapes (letter and digit runs cut to one character) and shape pairs with whether
the second word repeats the first, hashed into one weight table; a text's value of a feature is its share among the text's n-grams of that family. Training
takes a bounded sample of labelled rows; scoring takes every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import textnum as tn
from corpusmill.llm.common import table

BITS = 18
FAMILIES = 4
#: At most so many labelled rows, those with the least hashes of their ids, are used for training.
TRAIN_ROWS = 20_000
EPOCHS = 3
#: Rate, rate offset, and weights of the absolute and squared penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
THRESHOLD = 0.7

#: Bytes by class for word shapes: letters a or A, digits 0, all others themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = SHAPE[128:] = 97
SHAPE[65:91] = 65
SHAPE[48:58] = 48


def families(data: np.ndarray, off: np.ndarray, powers: tn.Powers) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family the weight index of every n-gram, in text order, and the number of n-grams of each text."""
    starts, ends, counts = tn.words(data, off)
    plain = tn.hashes(tn.UPPER[data], starts, ends, powers)
    shape = SHAPE[data]
    keep = np.ones(len(shape), dtype=bool)
    keep[1:] = (shape[1:] != shape[:-1]) | tn.SPACE[data[1:]]
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shaped = tn.hashes(shape[keep], place[starts], place[ends], powers)
    again = np.zeros(len(plain), dtype=np.uint64)
    again[:-1] = plain[:-1] == plain[1:]
    out = []
    for k, (h, n, salt) in enumerate(((plain, 1, None), (plain, 2, None), (shaped, 1, None), (shaped, 2, again * tn.BASE))):
        g, many = tn.grams(h, counts, n, salt)
        out.append((tn.mix(g + tn.PLACES[k]) >> np.uint64(64 - BITS), many))
    return out


def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ord, label, text) to (ord, label, index, value), sparse and without repeats."""
    powers = tn.Powers()
    for batch in batches:
        index, value = [], []
        for data, off, _ in tn.chunks(batch["text"]):
            cut = [np.split(i, np.cumsum(many)[:-1]) for i, many in families(data, off, powers)]
            for parts in zip(*cut, strict=True):
                i = np.concatenate(parts)
                v = np.concatenate([np.full(len(p), 1 / max(len(p), 1)) for p in parts])
                i, back = np.unique(i, return_inverse=True)
                index.append(i.astype(np.int32))
                value.append(np.bincount(back, v, len(i)).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch["ord"], batch["label"], pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["ord", "label", "index", "value"])


def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All training rows, once for each epoch and in order, to one row: the weights and, last, the bias. Rows are taken as
    they come, so only the weights are held."""
    z, n = (np.zeros((1 << BITS) + 1) for _ in range(2))
    for b in batches:
        for y, i, v in zip(b["label"].to_pylist(), b["index"], b["value"], strict=True):
            i, v = np.append(i.values.to_numpy(), 1 << BITS), np.append(v.values.to_numpy(), 1.0)
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(wi @ v, -35, 35))) - y) * v
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[i] = ni + g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()])], ["weights"])


def scores(texts: pa.Array, weights: np.ndarray, powers: tn.Powers) -> np.ndarray:
    out = np.empty(len(texts))
    for data, off, first in tn.chunks(texts):
        total = np.full(len(off) - 1, float(weights[-1]))
        for index, many in families(data, off, powers):
            sums = np.concatenate([[0.0], np.cumsum(weights[index.astype(np.int64)], dtype=np.float64)])
            ends = np.cumsum(many)
            total += (sums[ends] - sums[ends - many]) / np.maximum(many, 1)
        out[first : first + len(total)] = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
    return out


def fit(labelled: DataFrame, docs: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from at most that many rows of labelled (doc_id, label), whose texts are in docs (doc_id, text).

    Of several labels of an id the greatest counts; of several texts that of the least hash (null texts are empty), so an
    id is one row however often it stands. Without labelled rows all weights are 0 and all scores 0.5.
    """
    ids = labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = ids.withColumn("ord", F.xxhash64("doc_id")).orderBy("ord").limit(rows)
    texts = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "ord", F.col("label").cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text"))
    once = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text")
    texts = texts.groupBy("doc_id", "ord", "label").agg(once).select("ord", "label", "text")
    sparse = texts.mapInArrow(featurize, "ord long, label int, index array<int>, value array<float>")
    sparse = sparse.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))
    order = ["epoch", "ord", "label", F.hash("index"), F.hash("value")]
    model = sparse.repartition(1).sortWithinPartitions(*order).select("label", "index", "value").mapInArrow(train, "weights binary").first()
    return np.frombuffer(model[0], dtype=np.float32) if model else np.zeros((1 << BITS) + 1, dtype=np.float32)


def score(df: DataFrame, weights: np.ndarray, text: str = "text", to: str = "score") -> DataFrame:
    """df with the probability that a text is good. Null and empty texts get that of the bias alone. Rows are scored one by
    one: repeated rows alike, nulls in other columns change nothing, an empty table stays empty; of other columns only
    one of the score's name is replaced."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(scores(texts, weights, tn.Powers()))

    return df.withColumn(to, F.arrow_udf(run, "double")(F.col(f"`{text}`")))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model that saw no held-out label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4))
    labels = table(spark, sf_dir, "labels").where(part != 2).select("doc_id", F.col("quality").alias("label"))
    rows = score(docs, fit(labels, docs))
    return rows.select("doc_id", (part == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
