"""Merkle dataset manifest.

Every row is a leaf. The leaves of a group are in order, and every run of ARITY consecutive nodes hashes to a node of the
next level until one is left, the group's root; the roots of groups, in order, give the dataset's root the same way. What
a leaf needs to be checked against that root are its siblings on the way up.

Leaves are cut into aligned blocks. In a block, a traversal goes from leaf to leaf: it keeps the siblings of the current
leaf alone, and for each level a treehash stack that works out, a few leaves a step, the nodes which the level needs next.
So it holds nodes in proportion to the logarithm of the block. Roots of blocks are leaves of the layer above, which is
done alike; its paths are shared by all leaves of a block and appended to theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import small_side, table, written

#: Nodes that hash to one, and the levels and leaves of a block.
ARITY, LEVELS = 3, 6
BLOCK = ARITY**LEVELS
#: Rows up to which places and paths are broadcast (a path is a few KB at most); beyond, the joins are shuffled.
BROADCAST_PLACES, BROADCAST_PATHS = 500_000, 20_000
PATH = "array<struct<before:string,after:string>>"


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


class Treehash:
    """The nodes of one level over a range of leaves, worked out a leaf at a time."""

    def __init__(self, leaves: list[str], level: int):
        self.leaves, self.level, self.stack = leaves, level, [[] for _ in range(level + 1)]
        self.at = self.end = 0

    def start(self, begin: int) -> None:
        """The nodes after the first one of the run that begins at a leaf; there may be none."""
        width, n = ARITY**self.level, len(self.leaves)
        self.at, self.end = min(begin + width, n), min(begin + ARITY * width, n)

    @property
    def tail(self) -> int:
        """The level of the lowest node on the stack."""
        return next((h for h, nodes in enumerate(self.stack) if nodes), self.level)

    @property
    def held(self) -> int:
        return sum(map(len, self.stack))

    def step(self) -> None:
        """Takes one more leaf, and closes runs that are full, or have no more leaves."""
        self.stack[0].append(self.leaves[self.at])
        self.at += 1
        for h in range(self.level):
            if self.stack[h] and (len(self.stack[h]) == ARITY or self.at == self.end):
                self.stack[h + 1].append(digest(self.stack[h]))
                self.stack[h] = []

    def take(self) -> list[str]:
        """The nodes, and whatever is left to do for them."""
        while self.at < self.end:
            self.step()
        nodes, self.stack[self.level] = self.stack[self.level], []
        return nodes


class Traversal:
    """Authentication paths of the leaves of a block of so many levels, in order."""

    def __init__(self, leaves: list[str], levels: int):
        self.leaves, self.levels = leaves, levels
        self.trees = [Treehash(leaves, h) for h in range(levels)]
        self.left: list[list[str]] = [[] for _ in range(levels)]
        self.right: list[list[str]] = []
        for tree in self.trees:
            tree.start(0)
            self.right.append(tree.take())
            tree.start(ARITY ** (tree.level + 1))
        self.before, self.after = [""] * levels, ["".join(r) for r in self.right]

    @property
    def held(self) -> int:
        return sum(t.held for t in self.trees) + sum(map(len, self.left)) + sum(map(len, self.right))

    def advance(self, leaf: int) -> None:
        """From the leaf before to this one: on each level, the finished node goes to the left, or ends its run."""
        node = self.leaves[leaf - 1]
        for h, tree in enumerate(self.trees):
            ended = leaf % ARITY ** (h + 1) == 0
            if ended:
                node, self.left[h], self.right[h] = digest([*self.left[h], node]), [], tree.take()
                tree.start(leaf + ARITY ** (h + 1))
            else:
                self.left[h].append(node)
                del self.right[h][:1]
            self.before[h], self.after[h] = "".join(self.left[h]), "".join(self.right[h])
            if not ended:
                return

    def work(self) -> None:
        """One leaf for each level's stack, where the lowest node is first: two of three steps would do."""
        for _ in self.trees:
            todo = [t for t in self.trees if t.at < t.end]
            if todo:
                min(todo, key=lambda t: (t.tail, t.level)).step()

    def __iter__(self) -> Iterator[tuple[list[str], list[str]]]:
        """By leaf, what stands before and after its ancestor of each level; the lists are reused."""
        for leaf in range(len(self.leaves)):
            if leaf:
                self.advance(leaf)
            yield self.before, self.after
            self.work()

    def root(self) -> str:
        node = self.leaves[0]
        for right in self.right:
            node = digest([node, *right])
        return node


def levels_of(n: int) -> int:
    """Levels of a tree of n leaves."""
    levels, width = 0, 1
    while width < n:
        levels, width = levels + 1, width * ARITY
    return levels


def hashed(*columns: Column) -> Column:
    """The digest of values: each `-` if null, else its length in bytes, `:` and itself."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in columns]), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with the place of each in its `key` by the columns of the order, from 0, and `n`, the rows of the key.

    Rows are sorted in ranges over all keys, so a key of any size is spread over tasks; the rows of a key in the ranges
    before are one number for each range that it reaches into.
    """
    seq = F.monotonically_increasing_id()
    rows = written(rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("seq", seq), "merkle-sorted")
    part = F.shiftright("seq", 33)
    runs = rows.groupBy("key", part.alias("part")).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("rows"))
    ahead = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"ahead": F.coalesce(F.sum("rows").over(ahead), F.lit(0)), "n": F.sum("rows").over(Window.partitionBy("key"))})
    runs = written(runs.drop("rows"), "merkle-runs")
    joined = rows.withColumn("part", part).join(small_side(runs, BROADCAST_PLACES), ["key", "part"])
    return joined.select(*rows.columns[:-1], "n", (F.col("seq") - F.col("first") + F.col("ahead")).alias("place"))


def in_blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """Nodes (key, place, n, node, more) as a row for each block, which has its nodes in order in arrays."""
    block = F.expr(f"place div {BLOCK}L").alias("block")
    each = F.sort_array(F.collect_list(F.struct("place", "node", *more))).alias("nodes")
    grouped = nodes.groupBy("key", block).agg(F.first("n").alias("n"), each)
    return grouped.select("key", "block", "n", *[F.col("nodes")[c].alias(c) for c in ("node", *more)])


def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (key, block, n, node) to what they are in the layer above (key, place, n, node)."""
    for batch in batches:
        roots, n = [], batch["n"].to_pylist()
        for k, size in enumerate(n):
            leaves = [x.hex() for x in batch["node"][k].as_py()]
            roots.append(bytes.fromhex(Traversal(leaves, min(LEVELS, levels_of(size))).root()))
        above = pa.array([-(-size // BLOCK) for size in n], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["key"], batch["block"], above, pa.array(roots, pa.binary())], ["key", "place", "n", "node"])


def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to blocks the paths of their leaves within them."""
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            leaves, levels = [x.hex() for x in one["node"][0].as_py()], min(LEVELS, levels_of(one["n"][0].as_py()))
            before, after = [], []
            for b, a in Traversal(leaves, levels):
                before += b
                after += a
            steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
            paths = pa.ListArray.from_arrays(pa.array(range(0, levels * len(leaves) + 1, levels) if levels else [0] * (len(leaves) + 1), pa.int32()), steps)
            paths = pa.ListArray.from_arrays(pa.array([0, len(leaves)], pa.int32()), paths)
            yield pa.RecordBatch.from_arrays([*one.columns, paths], [*one.schema.names, "path"])


def with_paths(blocks: DataFrame) -> DataFrame:
    """Blocks (key, block, n, node, ...) with an array of their leaves' paths to the root of the block."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema)
    return blocks.mapInArrow(proved, f"{shape}, path array<{PATH}>")


def paths_up(nodes: DataFrame) -> DataFrame:
    """Nodes (key, place, n, node) with the path of each to its key's root, and that root: (key, place, path, root).

    Each layer has the BLOCKth part of the nodes of the one below; keys that have come to their root stay as they are.
    """
    blocks = written(in_blocks(nodes), "merkle-blocks")
    roots = written(blocks.mapInArrow(rooted, "key string, place long, n long, node binary"), "merkle-roots")
    if roots.where("n > 1").isEmpty():
        above = roots.select("key", F.col("place").alias("block"), F.lit(None).cast(PATH).alias("above"), F.lower(F.hex("node")).alias("root"))
    else:
        above = paths_up(roots).select("key", F.col("place").alias("block"), F.col("path").alias("above"), "root")
    joined = with_paths(blocks).join(above, ["key", "block"])
    each = joined.select("key", "block", "root", "above", F.posexplode("path").alias("k", "within"))
    path = F.concat("within", F.coalesce("above", F.array().cast(PATH)))
    return written(each.select("key", (F.col("block") * BLOCK + F.col("k")).alias("place"), path.alias("path"), "root"), "merkle-paths")


class Manifest:
    """The tree over a table: leaves are digests of `fields`, groups are the values of a column (null first, then bytewise
    by UTF-8), a group's leaves ascend by `order` (null first; rows of equal order by digest).

    All fields may be null, and are part of the digest as such. Rows alike in all fields are leaves of their own. An
    empty table has no root, and no rows. Everything that is exchanged is a digest with the row's order, never a text.
    """

    def __init__(self, df: DataFrame, fields: list[str], group: str = "source", order: str = "doc_id", tampered: dict[str, Column] | None = None):
        """tampered: other values for fields, by which rows are to be checked; where they don't differ, nothing is kept."""
        key = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit(""))
        leaf, other = hashed(*[F.col(f"`{f}`") for f in fields]), hashed(*[(tampered or {}).get(f, F.col(f"`{f}`")) for f in fields])
        rows = df.select(key.alias("key"), F.col(f"`{order}`").alias("order"), F.unhex(leaf).alias("node"), F.unhex(other if tampered else F.lit(None)).alias("other"))
        rows = rows.withColumn("other", F.when(F.col("other") != F.col("node"), F.col("other")))
        # A number of its own tells rows alike apart, so that a range may begin among them.
        rows = written(rows.withColumn("at", F.monotonically_increasing_id()), "merkle-leaves")
        leaves = placed(rows, ["order", "node", "at"])
        self.blocks = written(in_blocks(leaves, "order", "other"), "merkle-leaf-blocks")
        roots = written(self.blocks.mapInArrow(rooted, "key string, place long, n long, node binary"), "merkle-block-roots")
        paths = paths_up(roots)
        #: A row for each group: its key, subroot, and path to the root.
        subroots = paths.where("place = 0").select(F.lit("").alias("key"), F.col("key").alias("order"), F.unhex("root").alias("node"))
        groups = written(placed(subroots, ["order"]), "merkle-groups")
        up = paths_up(groups.select("key", "place", "n", "node"))
        self.groups = groups.join(up, ["key", "place"]).select(F.col("order").alias("key"), F.lower(F.hex("node")).alias("subroot"), F.col("path").alias("top"), "root")
        self.paths = written(paths.drop("root").join(small_side(self.groups, BROADCAST_PATHS), "key"), "merkle-above")

    def proofs(self) -> DataFrame:
        """A row for each leaf: order, leaf, other (null, or the digest of the tampered row), proof, subroot and root.

        The proof is an array, from the leaf up, of what stands before and after the node in its run: digests as text.
        Blocks meet their paths before leaves get theirs, so a join moves no proofs.
        """
        above = self.paths.select("key", F.col("place").alias("block"), F.concat("path", "top").alias("above"), "subroot", "root")
        blocks = with_paths(self.blocks.join(small_side(above, BROADCAST_PATHS), ["key", "block"]))
        each = blocks.select("above", "subroot", "root", F.explode(F.arrays_zip("order", "node", "other", "path")).alias("x"))
        text = lambda c: F.lower(F.hex(F.col("x")[c])).alias({"node": "leaf"}.get(c, c))
        return each.select(F.col("x.order").alias("order"), text("node"), text("other"), F.concat("x.path", "above").alias("proof"), "subroot", "root")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def siblings(proof: Column) -> Column:
    """The digest of all nodes of a proof, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, and half of them tampered with: their line breaks are gone."""
    bare = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0, F.replace("text", F.lit("\n"), F.lit("")))
    manifest = Manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], tampered={"text": F.coalesce(bare, "text")})
    rows = manifest.proofs().withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("proof")))
    return rows.select(F.col("order").alias("doc_id"), "leaf", "subroot", "root", siblings(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def sql_levels(nodes: str, name: str, levels: int) -> tuple[list[str], str]:
    """Common table expressions of a tree over a relation (g, i, d: group, place, digest), and the name of its last level; a
    group that has come to its root stays."""
    steps = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM ({nodes}))"]
    for k in range(levels):
        up = f"SELECT g, CASE WHEN c > 1 THEN i // {ARITY} ELSE i END AS i, CASE WHEN any_value(c) > 1 THEN sha256(string_agg(d, '' ORDER BY {name}{k}.i)) ELSE any_value(d) END AS d FROM {name}{k} GROUP BY g, CASE WHEN c > 1 THEN i // {ARITY} ELSE i END"
        steps.append(f"{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM ({up}))")
    return steps, f"{name}{levels}"


def sql_paths(name: str, state: str, levels: int) -> tuple[list[str], str]:
    """Common table expressions that take states (doc_id, leaf, g, i, proof, fold) up a tree, level by level."""
    steps = []
    for k in range(levels):
        of = lambda sign: f"(SELECT coalesce(string_agg(d, '' ORDER BY n.i), '') FROM {name}{k} n WHERE n.g = s.g AND n.i // {ARITY} = s.i // {ARITY} AND n.i {sign} s.i)"  # noqa: B023, E731
        around = f"SELECT s.*, (SELECT any_value(n.c) FROM {name}{k} n WHERE n.g = s.g) AS c, {of('<')} AS l, {of('>')} AS r FROM {state} s"
        state = f"{name}p{k + 1}"
        steps.append(f"{state} AS (SELECT doc_id, leaf, g, CASE WHEN c > 1 THEN i // {ARITY} ELSE i END AS i, proof || CASE WHEN c > 1 THEN l || r ELSE '' END AS proof, CASE WHEN c > 1 THEN sha256(l || fold || r) ELSE fold END AS fold FROM ({around}))")
    return steps, state


def sql_op12(source_levels: int = 9, root_levels: int = 4) -> str:
    """The manifest in SQL, for groups of 3^9 documents and 3^4 groups at most; CRC-32 bit by bit."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(part, ["doc_id", '"source"', "lang", "n_chars", text])) + ")"
    shift = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = "xor(x, CAST(ord(substr(CAST(doc_id AS VARCHAR), CAST(k // 8 + 1 AS INTEGER), 1)) AS BIGINT))"
    # One step for each bit: a byte goes in before its first one.
    crc = f"""list_reduce(list_prepend(4294967295, range(CAST(8 * length(CAST(doc_id AS VARCHAR)) AS BIGINT))), lambda x, k: {shift.replace("c ", f"(CASE WHEN k % 8 = 0 THEN {byte} ELSE x END) ")})"""
    trees, top = sql_levels("SELECT g, i, d FROM placed", "t", source_levels)
    sources = f"SELECT 'all' AS g, row_number() OVER (ORDER BY g) - 1 AS i, d, g AS own FROM {top}"
    roots, last = sql_levels("SELECT g, i, d FROM sources", "r", root_levels)
    inner, done = sql_paths("t", "begun", source_levels)
    outer, end = sql_paths("r", "onward", root_levels)
    steps = [
        f"docs AS (SELECT *, coalesce('+' || \"source\", '') AS g, {leaf('text')} AS d, {leaf('''replace(text, chr(10), '')''')} AS other, xor({crc}, 4294967295) & 1 = 0 AS even FROM documents)",
        "placed AS (SELECT doc_id, g, d, CASE WHEN even THEN other ELSE d END AS fold, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM docs)",
        *trees, f"sources AS ({sources})", *roots,
        "begun AS (SELECT doc_id, d AS leaf, g, i, '' AS proof, fold FROM placed)", *inner,
        f"onward AS (SELECT doc_id, leaf, 'all' AS g, s.i, proof, fold FROM {done} p JOIN sources s ON s.own = p.g)", *outer,
        f"subs AS (SELECT p.doc_id, p.leaf, s.d AS subroot FROM {done} p JOIN sources s ON s.own = p.g)",
    ]
    return f"""WITH {", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)}
SELECT e.doc_id, e.leaf, subroot, (SELECT any_value(d) FROM {last}) AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = (SELECT any_value(d) FROM {last}) AS verified
FROM {end} e JOIN subs USING (doc_id, leaf)"""


OP12_SQL = sql_op12()
