"""Embedding near-dedup by PCA-ordered tiled comparison.

Unit vectors are turned to the principal axes of the whole table, so leading dimensions hold most of a product.
Vectors of one label are dealt to slabs along the first axis, wide enough that links join the same or adjacent
slabs only, and slabs to tiles of bounded size; each pair of tiles that come near enough is one group. In a group, products are summed
over leading dimensions first, the rest is bounded by the norms of what remains, and pairs that cannot reach the
threshold are dropped. A group gives counts of links and a spanning forest of them, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table, written
from corpusmill.llm.components import components
from corpusmill.llm.vectors import matrix, usable

THRESHOLD = 0.93
#: Vectors in a tile, on average.
TILE = 8192
#: Further axes along which large slabs are cut, and axes of the boxes around tiles.
AXES, BOX = 3, 8
#: Rows of a tile that are compared at a time, which bounds the products held.
ROWS = 512
#: Dimensions summed between two rounds of pruning.
DIMENSIONS = 16
#: While more than this share of a tile pair is alive, products are taken of whole tiles.
DENSE = 0.02
#: Pairs whose remaining products are taken at once.
PAIRS = 1 << 18
ROUNDING = 1e-12
#: Turned vectors find pairs down to so much below the threshold, and where a product is so near to it, the vectors as they
#: came decide.
NEAR = 1e-9
#: What goes with a vector: two hashes that identify it, its least id, how often it occurs, its label and length.
CARRIED = ["f1", "f2", "rep", "copies", "label", "length", "own"]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vector) to the partition's sums of products of components: length, i, j, sum."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        lengths = batch["length"].to_numpy()
        for n in np.unique(lengths):
            x = unit(matrix(pa.chunked_array([batch["vector"].filter(pa.array(lengths == n))])))
            sums[n] = sums.get(n, 0) + x.T @ x
    for n, m in sums.items():
        i, j = np.indices(m.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, n, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m.ravel())], ["length", "i", "j", "sum"])


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By length of vectors, the axes as columns, those of most mass first. The driver gets length^2 sums."""
    sums = vectors.select("length", "vector").mapInArrow(moments, "length int, i int, j int, sum double").groupBy("length", "i", "j").agg(F.sum("sum").alias("sum"))
    found: dict[int, np.ndarray] = {}
    for r in sums.toLocalIterator():
        found.setdefault(r["length"], np.zeros((r["length"], r["length"])))[r["i"], r["j"]] = r["sum"]
    return {n: np.linalg.eigh(m)[1][:, ::-1] for n, m in found.items()}


def turned(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray], width: float) -> Iterator[pa.RecordBatch]:
    """Adds slab and replaces vector by the unit vector along the axes."""
    for batch in batches:
        lengths, out, slab = batch["length"].to_numpy(), [None] * batch.num_rows, np.zeros(batch.num_rows, dtype=np.int32)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            x = unit(matrix(pa.chunked_array([batch["vector"].take(pa.array(at))]))) @ axes[int(n)]
            slab[at] = np.floor(x[:, 0] / width)
            for k, row in zip(at, x, strict=True):
                out[k] = row
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in CARRIED), pa.array(slab), pa.array(out, pa.list_(pa.float64()))], [*CARRIED, "slab", "vector"])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows. Scaling by a power of two first keeps squares finite and changes no digit."""
    a, b = (x * np.exp2(-np.floor(np.log2(np.abs(x).max(axis=1, keepdims=True)))) for x in (a, b))
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float, of_a: np.ndarray | None = None, of_b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of rows whose product is at least the threshold; of_a and of_b, the vectors that a and b were
    turned from, decide near it."""
    parts = [near_pairs(a[k : k + ROWS], b, threshold) for k in range(0, len(a), ROWS)]
    i, j, values = (np.concatenate([p[n] + (k * ROWS if n == 0 else 0) for k, p in enumerate(parts)]) for n in range(3))
    close = np.flatnonzero(np.abs(values - threshold) <= NEAR)
    if of_a is not None and len(close):
        values[close] = cosines(of_a[i[close]], of_b[j[close]])
    keep = values >= threshold
    return i[keep], j[keep]


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (in a, in b) and products of rows whose product is at least the threshold less NEAR."""
    threshold = threshold - NEAR
    cuts = [*range(0, a.shape[1], DIMENSIONS), a.shape[1]]
    rest = lambda x, c: np.sqrt((x[:, c:] ** 2).sum(axis=1))
    sums, alive, step = np.zeros((len(a), len(b))), None, 0
    for step in range(len(cuts) - 1):
        c, d = cuts[step], cuts[step + 1]
        sums += a[:, c:d] @ b[:, c:d].T
        alive = sums >= threshold - ROUNDING * (d < a.shape[1]) - np.outer(rest(a, d), rest(b, d))
        if np.count_nonzero(alive) <= DENSE * alive.size:
            break
    i, j = np.nonzero(alive)
    values = sums[i, j]
    for c, d in zip(cuts[step + 1 : -1], cuts[step + 2 :], strict=True):
        parts = [np.einsum("ij,ij->i", a[i[k : k + PAIRS], c:d], b[j[k : k + PAIRS], c:d]) for k in range(0, len(i), PAIRS)]
        values = values + np.concatenate(parts or [values])
        keep = values >= threshold - ROUNDING * (d < a.shape[1]) - rest(a, d)[i] * rest(b, d)[j]
        i, j, values = i[keep], j[keep], values[keep]
    return i, j, values


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least place that each of n places reaches over the links (i, j)."""
    labels, a, b = np.arange(n), np.concatenate([i, j]), np.concatenate([j, i])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    firsts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else a
    while len(a):
        new = labels.copy()
        new[a[firsts]] = np.minimum(labels[a[firsts]], np.minimum.reduceat(labels[b], firsts))
        new = new[new]
        if (new == labels).all():
            break
        labels = new
    return labels


def compare(group: pa.Table, threshold: float) -> pa.Table:
    """One pair of tiles to rows (f1, f2, links), how many a vector has, and rows (a, b), edges between ids."""
    first, second = group.filter(group["first"]), group.filter(group["second"])
    out = {"f1": [], "f2": [], "links": [], "a": [], "b": []}
    if len(first) and len(second):
        same = bool(first["second"][0].as_py())
        i, j = linked_pairs(matrix(first["vector"]), matrix(second["vector"]), threshold, matrix(first["own"]), matrix(second["own"]))
        if same:
            i, j = i[i < j], j[i < j]
        else:
            j = j + len(first)
        f1, f2, reps, copies = (first[c].to_numpy() if same else np.concatenate([first[c].to_numpy(), second[c].to_numpy()]) for c in CARRIED[:4])
        counts = (np.bincount(i, copies[j], len(reps)) + np.bincount(j, copies[i], len(reps))).astype(np.int64)
        labels = forest(i, j, len(reps))
        some, moved = np.flatnonzero(counts), np.flatnonzero(labels != np.arange(len(reps)))
        nulls = [None] * len(some), [None] * len(moved)
        out = {"f1": [*f1[some], *nulls[1]], "f2": [*f2[some], *nulls[1]], "links": [*counts[some], *nulls[1]], "a": [*nulls[0], *reps[moved]], "b": [*nulls[0], *reps[labels[moved]]]}
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def tiled(vectors: DataFrame, tile: int, width: float) -> DataFrame:
    """Each vector once for every pair of tiles that it is in and that may hold a link.

    A slab of more than two tiles is cut along more axes into cells, which are cut into tiles of bounded size. The boxes
    around tiles tell how near two of them come, so pairs that are farther apart than any link is are never exchanged.
    """
    slab, cells = ["label", "length", "slab"], [f"c{k}" for k in range(AXES)]
    of = [*slab, *cells, "tile"]
    sizes = vectors.groupBy(*slab).agg(F.count(F.lit(1)).alias("n"))
    depth = F.when(F.col("n") > 2 * tile, F.least(F.lit(AXES), F.ceil(F.log(F.col("n") / tile) / F.log(F.lit(4.0))))).otherwise(0)
    sizes = written(sizes.select(*slab, depth.cast("int").alias("depth")), "slab-sizes")
    rows = vectors.join(sizes, slab)
    rows = rows.withColumns({c: F.when(F.col("depth") > k, F.coalesce(F.floor(F.get("vector", F.lit(k + 1)) / width), F.lit(0))).otherwise(0).cast("int") for k, c in enumerate(cells)})
    counts = written(rows.groupBy(*slab, *cells).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")), "tile-sizes")
    rows = rows.join(counts, [*slab, *cells]).withColumn("tile", F.pmod(F.col("f2"), F.col("tiles")).cast("int"))
    side = lambda least: F.array(*[(F.min if least else F.max)(F.get("vector", F.lit(k))) for k in range(BOX)])
    boxes = written(rows.groupBy(*of).agg(side(True).alias("low"), side(False).alias("high")).withColumn("t", F.monotonically_increasing_id()), "tile-boxes")
    a, b = boxes.select(*slab, F.col("t").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high")), boxes.select(*slab, F.col("t").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    both = a.join(b, slab).where("a <= b").unionByName(a.join(b.withColumn("slab", F.col("slab") - 1), slab))
    gap = lambda k: F.greatest(F.lit(0.0), F.get("a_low", F.lit(k)) - F.get("b_high", F.lit(k)), F.get("b_low", F.lit(k)) - F.get("a_high", F.lit(k)))
    apart = F.lit(0.0)
    for k in range(BOX):
        apart = apart + gap(k) * gap(k)
    pairs = both.where(apart <= width * width).select("a", "b", F.monotonically_increasing_id().alias("pair"))
    member = lambda t, first, second: F.struct(F.col(t).alias("t"), F.lit(first).alias("first"), F.lit(second).alias("second"))
    members = F.when(F.col("a") == F.col("b"), F.array(member("a", True, True))).otherwise(F.array(member("a", True, False), member("b", False, True)))
    members = written(pairs.select("pair", F.inline(members)), "tile-pairs")
    return rows.join(boxes.select(*of, "t"), of).join(members, "t").select(*CARRIED, "vector", "pair", "first", "second")


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """df (vec_id, vector, label) to vec_id, n_links, component_id and kept, a row for each row.

    Vectors link if their labels are equal and not null, and their cosine is at least the threshold (above 0).
    Unusable and zero vectors, and those of other lengths, don't link. Equal vectors are compared once and counted as
    often as they occur; rows with one id are one node. A row without an id has no component and is not kept.
    """
    zero = ~F.exists("vector", lambda x: x != 0)
    part = usable(F.col("vector")) & ~zero & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = df.select("vec_id", "vector", "label", F.coalesce(part, F.lit(False)).alias("part"))
    rows = rows.withColumns({"f1": F.xxhash64("label", "vector"), "f2": F.xxhash64(F.lit(11), "vector", "label")})
    copies = rows.where("part").groupBy("f1", "f2", "label").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    copies = written(copies.withColumn("length", F.size("vector")), "dedup-vectors")

    axes, width = principal_axes(copies), float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    copies = copies.withColumn("own", F.col("vector"))
    kinds = dict(copies.dtypes)
    slabs = copies.select(*CARRIED, "vector").mapInArrow(
        lambda batches: turned(batches, axes, width), f"f1 long, f2 long, rep long, copies long, label {kinds['label']}, length int, own {kinds['own']}, slab int, vector array<double>"
    )
    pairs = tiled(written(slabs, "dedup-turned"), tile, width).groupBy("pair")
    found = written(pairs.applyInArrow(lambda group: compare(group, threshold), "f1 long, f2 long, links long, a long, b long"), "dedup-links")

    links = found.where("links is not null").groupBy("f1", "f2").agg(F.sum("links").alias("links"))
    classes = components(found.where("b is not null")).withColumnRenamed("node", "rep")
    about = copies.select("f1", "f2", "rep", "copies").join(links, ["f1", "f2"], "left").join(classes, "rep", "left")
    about = about.select("f1", "f2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rows = rows.select("vec_id", F.when(F.col("part"), F.col("f1")).alias("f1"), F.when(F.col("part"), F.col("f2")).alias("f2"))
    out = rows.join(about, ["f1", "f2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings compared within their labels."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label"))
