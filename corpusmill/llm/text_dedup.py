"""MinHash near-dedup by one-permutation hashing.

A document's set is its distinct word shingles, as 64-bit hashes. One permutation deals the set to bins, the least
hash of each bin is the bin's value, and an empty bin takes that of another one, chosen by the same random order of
bins for all documents (optimal densification). Bands of bins are buckets; documents with equal sets count as one.

In each bucket the least document is the centre of a star of candidate edges, so a bucket of m documents gives
m - 1 pairs, and pairs are confirmed on full sets. Where a bucket then holds more than one component, each document
outside its largest component is compared with those of other components, in tiles of bounded size that emit likely
pairs only. So no link is lost that shares a bucket, and no bucket gives all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import textnum as tn
from corpusmill.llm.common import small_side, table, written
from corpusmill.llm.components import components

SHINGLE = 5
#: Documents link if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Rows of a band and bands: a pair of similarity 0.75 shares no bucket with probability (1 - 0.75^4)^40 = 2e-7.
ROWS, BANDS = 4, 40
BINS = ROWS * BANDS
#: In a bucket of several components sets are compared by their least LOW hashes, 32 bits of each: exactly for sets
#: of at most LOW shingles, else by an estimate with a deviation of 0.019. What such a comparison needs to be likely.
LOW, EXACT_LIKELY, LOW_LIKELY = 512, 0.735, 0.65
#: Documents in a tile of such a bucket, on average.
TILE = 512
#: A pair of sets of at least SKETCHED shingles goes on to its full sets if SKETCH_MATCHES of its BINS one-byte bins
#: agree. At similarity 0.75 that is 120 on average with a deviation of 5.5 or, as smaller sets are nearly
#: exhausted by the bins, less.
SKETCHED, SKETCH_MATCHES = 64, 80
#: Rows that Python takes at a time.
PART = 1000
#: Joined by broadcast up to so many ids (8 bytes each), else by a shuffle.
BROADCAST_IDS = 200_000

#: For each bin the order in which it looks for a bin that is not empty.
ORDER = np.argsort(np.random.default_rng(4).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1), axis=1)


def sets(texts: pa.Array, powers: tn.Powers) -> Iterator[np.ndarray]:
    """The sorted set of each text."""
    for data, off, _ in tn.chunks(texts):
        starts, ends, counts = tn.words(data, off)
        hashes = tn.hashes(tn.UPPER[data], starts, ends, powers)
        shingles, many = tn.grams(hashes, counts, SHINGLE)
        shingles, hashes = (np.split(x, np.cumsum(n)[:-1]) for x, n in ((shingles, many), (hashes, counts)))
        for s, h in zip(shingles, hashes, strict=True):
            if not len(s) and len(h):
                s = tn.mix((h * tn.PLACES[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
            yield np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """The values of all bins for a set that is not empty."""
    bins = ((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    full = bins[first]
    out = np.zeros(BINS, dtype=np.uint64)
    out[full] = s[first]
    if len(full) < BINS:
        empty = np.ones(BINS, dtype=bool)
        empty[full] = False
        empty = np.flatnonzero(empty)
        out[empty] = s[first][ORDER[empty[:, None], full[None]].argmin(axis=1)]
    return out


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to (doc_id, n, f1, f2, bands, bytes): f1 and f2 identify the set, null if it is empty."""
    powers, band = tn.Powers(), np.arange(BANDS, dtype=np.uint64) * tn.BASE
    for batch in parts(batches):
        n, f1, f2, bands, marks = [], [], [], [], []
        for s in sets(batch["text"], powers):
            n.append(len(s))
            if not len(s):
                f1.append(None), f2.append(None), bands.append(None), marks.append(None)
                continue
            values = signature(s)
            f1.append(int(tn.mix(s + tn.PLACES[1]).sum().view(np.int64)))
            f2.append(int(np.bitwise_xor.reduce(tn.mix(s + tn.PLACES[2])).view(np.int64)))
            keys = (values.reshape(BANDS, ROWS) * tn.PLACES[:ROWS]).sum(axis=1) + band
            bands.append(tn.mix(keys).view(np.int64))
            marks.append((tn.mix(values) >> np.uint64(56)).astype(np.uint8).view(np.int64))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, longs), pa.array(marks, longs)],
            ["doc_id", "n", "f1", "f2", "bands", "bytes"],
        )


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most PART rows, as what is made of a text may be larger than it."""
    for batch in batches:
        for k in range(0, batch.num_rows, PART):
            yield batch.slice(k, PART)


def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to (rep, set)."""
    powers = tn.Powers()
    for batch in parts(batches):
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([s.view(np.int64) for s in sets(batch["text"], powers)], pa.list_(pa.int64()))], ["rep", "set"])


def differing(a: Column, b: Column) -> Column:
    """How many of two sketches' bytes differ: each byte's bits gather in its lowest one."""
    x = F.zip_with(a, b, lambda p, q: p.bitwiseXOR(q))
    gathered = lambda by: lambda p: p.bitwiseOR(F.shiftrightunsigned(p, by))
    for by in (4, 2, 1):
        x = F.transform(x, gathered(by))
    return F.aggregate(x, F.lit(0), lambda many, p: many + F.bit_count(p.bitwiseAND(F.lit(0x0101010101010101))))


def as_lows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to (rep, low): the upper halves of the set's least hashes."""
    powers = tn.Powers()
    for batch in parts(batches):
        lows = [(s[: LOW + 1] >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets(batch["text"], powers)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lows, pa.binary())], ["rep", "low"])


def likely_pairs(group: pa.Table) -> pa.Table:
    """One tile pair of a bucket: rows that are asked about (asks) against the others, to pairs (a, b) that may link."""
    whole = [np.frombuffer(x, dtype=np.uint32) for x in group["low"].to_pylist()]
    asks, reps, components_ = (group[c].to_numpy() for c in ("asks", "rep", "component"))
    asked, others = np.flatnonzero(asks), np.flatnonzero(~asks)
    found: list[tuple[int, int]] = []
    if len(asked) and len(others):
        lows = [x[:LOW] for x in whole]
        # Beyond its cut a set isn't known.
        cuts = np.array([x[LOW] if len(x) > LOW else 1 << 32 for x in whole], dtype=np.uint64)
        every_, sizes = np.concatenate([lows[k] for k in others]), np.array([len(lows[k]) for k in others])
        starts = np.cumsum(sizes) - sizes
        for k in asked:
            a, cut = lows[k], np.minimum(cuts[k], cuts[others])
            hits = a[np.minimum(np.searchsorted(a, every_), len(a) - 1)] == every_
            known = (every_ < cuts[k]) if cuts[k] < 1 << 32 else np.ones(len(every_), dtype=bool)
            shared, theirs = np.add.reduceat(hits & known, starts, dtype=np.int64), np.add.reduceat(known, starts, dtype=np.int64)
            ours = np.searchsorted(a.astype(np.uint64), cut)
            shared = np.minimum(shared, ours)
            needed = np.where(cut < 1 << 32, LOW_LIKELY, EXACT_LIKELY)
            near = (shared >= needed * (ours + theirs - shared)) & (components_[others] != components_[k])
            found += [(reps[k], reps[o]) for o in others[near]]
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})


def of_texts(docs: DataFrame, ids: DataFrame, function, name: str, kind: str, repeated: bool) -> DataFrame:
    """(rep, name): what function makes of the texts of some ids, each only once; texts without a word are left out."""
    made = docs.join(small_side(ids, BROADCAST_IDS), "doc_id").select("doc_id", "text").mapInArrow(function, f"rep long, {name} {kind}")
    made = made.where((F.size if kind == "array<long>" else F.octet_length)(F.col(name)) > 0)
    return made.groupBy("rep", F.xxhash64(name).alias("h")).agg(F.first(name).alias(name)).select("rep", name) if repeated else made


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, repeated: bool, sketched: bool = True) -> DataFrame:
    """Those of pairs (a, b) that link, by sketches (if asked) and then by full sets, made again for them only."""
    likely = pairs
    if sketched:
        about = nodes.select("rep", "n", "bytes")
        of = lambda name: about.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col("bytes").alias(f"bytes_{name}"))
        likely = pairs.join(of("b"), "b").join(of("a"), "a")
        likely = likely.where((F.least("n_a", "n_b") < SKETCHED) | (differing(F.col("bytes_a"), F.col("bytes_b")) <= BINS - SKETCH_MATCHES))
    likely = written(likely.select("a", "b"), "dedup-likely")
    ids = likely.select(F.col("a").alias("doc_id")).unionAll(likely.select("b")).distinct()
    full = written(of_texts(docs, ids, as_sets, "set", "array<long>", repeated), "dedup-sets")
    of = lambda name: full.select(F.col("rep").alias(name), F.col("set").alias(f"set_{name}"))
    both = likely.join(of("b"), "b").join(of("a"), "a").select("a", "b", F.size("set_a").cast("long").alias("n_a"), F.size("set_b").alias("n_b"), F.size(F.array_intersect("set_a", "set_b")).alias("shared"))
    return written(both.where(100 * F.col("shared") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b").distinct(), "dedup-links")


def similar_sizes(x, y):
    return 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)


def open_buckets(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (key, rep, n) of buckets of several components, with their component and the bucket's largest one."""
    named = buckets.join(classes, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    sizes = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.max_by("component", F.struct("size", "component")).alias("largest"))
    return written(named.join(mixed.where("many > 1").select("key", "largest"), "key"), "dedup-open")


def tiled(opened: DataFrame, lows: DataFrame) -> DataFrame:
    """Rows of open buckets for each pair of tiles: documents outside the largest component ask all documents.

    Those that ask are tiled apart from all, so a bucket of m documents of which few ask exchanges m rows for each of
    few tiles, and each that asks once for each tile of all.
    """
    asks = F.col("component") != F.col("largest")
    tiles = opened.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"), F.ceil(F.count_if(asks) / TILE).cast("int").alias("asking"))
    rows = opened.join(tiles, "key").join(lows, "rep")
    place = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda i, j, asks: F.struct(i.alias("i"), j.alias("j"), F.lit(asks).alias("asks"))
    told = F.transform(numbers(F.col("asking")), lambda i: pair(i, place(F.col("tiles")), False))
    asked = F.when(asks, F.transform(numbers(F.col("tiles")), lambda j: pair(place(F.col("asking")), j, True)))
    return rows.select("key", "rep", "component", "low", F.inline(F.concat(told, F.coalesce(asked, F.slice(told, 1, 0)))))


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df's rows as doc_id, n_shingles, component_id and kept.

    Null and empty texts have no shingles and link with nothing; a text of fewer words than a shingle is one
    shingle. Rows with one id are one document, which links by any of its texts. A row without an id has no
    component and is not kept. Other columns are dropped. An empty table gives no rows.
    """
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = written(docs.mapInArrow(sketch, "doc_id long, n long, f1 long, f2 long, bands array<long>, bytes array<long>"), "dedup-sketches")
    sound = rows.where("f1 is not null and doc_id is not null")
    nodes = sound.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes"))
    nodes = written(nodes, "dedup-nodes")
    again = sound.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    repeated = not again.isEmpty()

    members = nodes.select("rep", "n", F.explode("bands").alias("key"))
    stars = members.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
    stars = written(stars.select("key", "centre"), "dedup-stars")
    crowded = written(members.join(stars, "key"), "dedup-buckets")
    pairs = crowded.where((F.col("rep") != F.col("centre.rep")) & similar_sizes(F.col("n"), F.col("centre.n")))
    pairs = written(pairs.select(F.col("rep").alias("a"), F.col("centre.rep").alias("b")).distinct(), "dedup-pairs")
    links = confirmed(docs, nodes, pairs, repeated)
    if repeated:
        same = sound.join(again, "doc_id").join(nodes.select("f1", "f2", "rep"), ["f1", "f2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        links = links.unionAll(same)
    classes = components(links)
    opened = open_buckets(crowded.select("key", "rep", "n"), classes)
    if not opened.isEmpty():
        ids = opened.select(F.col("rep").alias("doc_id")).distinct()
        lows = written(of_texts(docs, ids, as_lows, "low", "binary", repeated), "dedup-lows")
        likely = tiled(opened, lows).groupBy("key", "i", "j").applyInArrow(likely_pairs, "a long, b long")
        likely = written(likely.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "dedup-pairs")
        more = confirmed(docs, nodes, likely, repeated, sketched=False)
        if not more.isEmpty():
            classes = components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))

    found = nodes.select("f1", "f2", "rep").join(classes, F.col("rep") == F.col("node"), "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n", "f1", "f2").join(found, ["f1", "f2"], "left")
    # A text without a word is in the class of its id's other texts.
    wordless = rows.where("f1 is null and doc_id is not null").select("doc_id").distinct()
    named = sound.join(small_side(wordless, BROADCAST_IDS), "doc_id", "left_semi").join(found, ["f1", "f2"])
    named = written(named.groupBy("doc_id").agg(F.min("component").alias("of_id")), "dedup-wordless")
    if not named.isEmpty():
        out = out.join(small_side(named, BROADCAST_IDS), "doc_id", "left").withColumn("component", F.coalesce("component", "of_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their classes of near copies."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
