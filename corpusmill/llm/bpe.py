"""Byte-level BPE.

Texts are cut into words (the matches of a pattern), and the distinct words of a block of documents are folded together,
as one array of their bytes' tokens: in every round the adjacent pair of lowest rank of each word is merged, until no
pair has a rank (words of over LONG_WORD bytes, which are few, are merged by a heap as they are cut). Ranks are found by
binary search in the sorted pairs of the vocabulary. Documents then take the tokens of their words. Decoding concatenates
the binary pieces that the ids stand for. All of it is one pass over the table without an exchange; a block depends on its
own rows only.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import table

#: The rank of a pair that has none.
NO_RANK = np.iinfo(np.int32).max
#: Words of more bytes, for which folding takes too many rounds, are merged by a heap.
LONG_WORD = 512
#: A block ends with the group of TEXTS documents that brings its texts to so many characters.
BLOCK_CHARS = 8 << 20
#: Texts, or rows to decode, that are Python objects at a time.
TEXTS = 256
INDEX = np.dtype("<u4")


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id from a rank file: lines of base64 and rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the rank file must rank all single bytes, without gaps")
    return tokens


def ranked_pairs(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of tokens that merge to one, as a * number of tokens + b in order, and what they merge to. The first
    stands for none."""
    ids = {t: i for i, t in enumerate(tokens)}
    cuts = ((ids.get(t[:k]), ids.get(t[k:]), i) for t, i in ids.items() for k in range(1, len(t)))
    found = sorted((a * len(tokens) + b, i) for a, b, i in cuts if a is not None and b is not None)
    keys, to = zip((-1, NO_RANK), *found)
    return np.array(keys, np.int64), np.array(to, np.int32)


def fold(parts: np.ndarray, sizes: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of words in a row, given their bytes' tokens, and how many each word has: in each round the leftmost pair of
    lowest rank of every word is merged. n: how many tokens there are. Returns tokens, with words in the order in which
    they were done, the number of each such word, and its number of tokens."""
    keys, to = pairs

    def ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a.astype(np.int64) * n + b
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        return np.where(keys[at] == pair, to[at], NO_RANK)

    done, word, begins = [], np.arange(len(sizes)), np.cumsum(sizes) - sizes
    rank = np.full(len(parts), NO_RANK, np.int32)
    rank[:-1] = ranks(parts[:-1], parts[1:])
    # The last part of a word has no pair.
    rank[begins + sizes - 1] = NO_RANK
    while len(word):
        least = np.minimum.reduceat(rank, begins)
        more = least != NO_RANK
        if not more.all():
            of = np.repeat(more, sizes)
            done.append((parts[~of], word[~more], sizes[~more]))
            parts, rank, word, sizes, least = parts[of], rank[of], word[more], sizes[more], least[more]
            begins = np.cumsum(sizes) - sizes
            if not len(word):
                break
        owner = np.repeat(np.arange(len(word)), sizes)
        some = np.flatnonzero(rank == least[owner])
        at = some[np.diff(owner[some], prepend=-1) != 0]
        ends = begins + sizes - 1
        parts[at] = least
        # A merge changes the ranks of its place, and of the one before, if these are in the word.
        onward, before = at + 1 < ends, at > begins
        rank[at] = NO_RANK
        rank[at[onward]] = ranks(least[onward], parts[at[onward] + 2])
        rank[at[before] - 1] = ranks(parts[at[before] - 1], least[before])
        kept = np.ones(len(parts), bool)
        kept[at + 1] = False
        parts, rank, sizes = parts[kept], rank[kept], sizes - 1
        begins = np.cumsum(sizes) - sizes
    tokens, words, counts = (np.concatenate([np.zeros(0, np.int64), *(d[k] for d in done)]) for k in range(3))
    return tokens, words, counts


def merged(word: bytes, ids: dict[bytes, int], tokens: list[bytes]) -> list[int]:
    """The tokens that the fold gives, by a heap of pairs: in time n log n, for words of any length."""
    parts = [ids[word[k : k + 1]] for k in range(len(word))]
    before, after = [*range(-1, len(word) - 1)], [*range(1, len(word) + 1)]

    def pair(k: int) -> tuple[int, int, int, int] | None:
        """The pair that begins at a place, as rank, place and parts; None if it has no rank."""
        a, b = parts[k], parts[after[k]] if after[k] < len(parts) else None
        found = None if b is None else ids.get(tokens[a] + tokens[b])
        return None if found is None else (found, k, a, b)

    todo = [p for p in map(pair, range(len(parts))) if p]
    heapify(todo)
    while todo:
        found, k, a, b = heappop(todo)
        right = after[k]
        # A pair whose parts have been merged into others is none any more.
        if parts[k] != a or right >= len(parts) or parts[right] != b:
            continue
        parts[k], parts[right], after[k] = found, -1, after[right]
        if after[k] < len(parts):
            before[after[k]] = k
        for at in (before[k], k):
            if at >= 0 and (new := pair(at)):
                heappush(todo, new)
    return [x for x in parts if x >= 0]


def encoded(words: list[bytes], ids: dict[bytes, int], tokens: list[bytes], odd: dict[bytes, int], pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of words, one array for all, where each word's begin in it, and how many they are.

    Words of over LONG_WORD bytes aren't folded, nor odd ones, which are a token as a whole though their parts merge to
    others.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    apart = (size > LONG_WORD) | (size == 0)
    if odd:
        apart |= np.fromiter((w in odd for w in words), bool, len(words))
    folded = np.flatnonzero(~apart)
    singles = np.array([ids[bytes([b])] for b in range(256)], np.int32)
    parts = singles[np.frombuffer(b"".join([words[k] for k in folded] if apart.any() else words), np.uint8)]
    found, which, n = fold(parts, size[folded], pairs, len(tokens))
    others = np.flatnonzero(apart)
    rest = [[ids[words[k]]] if words[k] in ids else merged(words[k], ids, tokens) for k in others]
    found = np.concatenate([found, *(np.array(x, np.int64) for x in rest)]).astype(INDEX)
    which, n = np.concatenate([folded[which], others]), np.concatenate([n, np.fromiter(map(len, rest), np.int64, len(rest))])
    begins, many = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    begins[which], many[which] = np.cumsum(n) - n, n
    return found, begins, many


def cut(batches: Iterator[pa.RecordBatch], pattern: str, tokens: list[bytes], odd: dict[bytes, int], pairs: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (row, text) to (row, ids): the distinct words of a block of texts are encoded, and each text takes its own."""
    ids, find = {t: i for i, t in enumerate(tokens)}, regex.compile(pattern).findall

    def block() -> Iterator[pa.RecordBatch]:
        found, begins, many = encoded(list(map(str.encode, numbers)), ids, tokens, odd, pairs)
        for row, each in zip(rows, places):
            words = np.concatenate(each)
            n = many[words]
            mine = found[np.repeat(begins[words] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            # Bytes up to the end of each text.
            ends = INDEX.itemsize * np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *map(len, each)])]
            data = pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(mine)])
            yield pa.RecordBatch.from_arrays([row, data], ["row", "ids"])

    numbers: defaultdict[str, int] = defaultdict(count().__next__)
    rows, places, chars = [], [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, TEXTS):
            part = batch.slice(k, TEXTS)
            each = []
            for text in part["text"].to_pylist():
                found = find(text or "")
                each.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                chars += len(text or "")
            rows.append(part["row"])
            places.append(each)
            if chars >= BLOCK_CHARS:
                yield from block()
                numbers = defaultdict(count().__next__)
                rows, places, chars = [], [], 0
    if places:
        yield from block()


class ByteBpe:
    """A vocabulary: its tokens and the pairs of them that merge are in every task (some MB)."""

    def __init__(self, spark: SparkSession, rank_file: str, pattern: str):
        self.pattern, self.tokens = pattern, read_ranks(rank_file)
        ids = {t: i for i, t in enumerate(self.tokens)}
        # The tokenizer's library takes a word that is a token as that; nearly all tokens are what their bytes merge to.
        self.odd = {t: i for t, i in ids.items() if merged(t, ids, self.tokens) != [i]}
        self.shared = spark.sparkContext.broadcast((self.tokens, self.odd, ranked_pairs(self.tokens)))

    def encode(self, df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
        """The columns to keep (all but an older `ids`, if not named) with ids: little-endian unsigned 32-bit integers.

        A null text is empty and has no ids. Each row is encoded, repeated ones too. Rows stay in their partitions; an
        empty table stays empty.
        """
        keep = [c for c in keep or df.columns if c.lower() != "ids"]
        kept = T.StructType([df.schema[c] for c in keep])
        pattern, shared = self.pattern, self.shared
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
        done = rows.mapInArrow(lambda batches: cut(batches, pattern, *shared.value), T.StructType().add("row", kept).add("ids", T.BinaryType()))
        return done.select(*[F.col("row")[c].alias(c) for c in keep], "ids")

    def decode(self, df: DataFrame, ids: str = "ids", to: str = "decoded") -> DataFrame:
        """df with the bytes that its ids stand for, pieces concatenated; null for null."""
        pieces = self.tokens

        def concatenated(column: pa.Array) -> pa.Array:
            of = lambda x: None if x is None else b"".join(map(pieces.__getitem__, np.frombuffer(x, INDEX).tolist()))
            some = [pa.array(map(of, column.slice(k, TEXTS).to_pylist()), pa.binary()) for k in range(0, len(column), TEXTS)]
            return pa.concat_arrays(some) if some else pa.array([], pa.binary())

        return df.withColumn(to, F.arrow_udf(concatenated, "binary")(F.col(ids)))


def n_ids(ids: Column) -> Column:
    return F.expr(f"octet_length({ids}) div {INDEX.itemsize}").cast("long")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded."""
    import public_tokenizers

    bpe = ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]))
    return rows.select("doc_id", n_ids("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
