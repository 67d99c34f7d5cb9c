"""Cross-tokenizer alignment.

Two tokenizers cut the same bytes. The texts of an Arrow batch are laid end to end with the byte offsets of the documents
in it; a count of the places where tokens of A end, and one for B, give everything: both end at a cut between groups,
either ends at the end of a link (the bytes that one token of A and one of B share), and prefix sums of the two, read at
the offsets of a document, are its own figures. Pairs of ids are counted over all documents afterwards.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import table, written

#: A batch is laid end to end in parts of at most so many bytes, or of one text.
PART_BYTES = 2 << 20
#: Segments of texts whose tokens a task remembers, and how many are encoded at a time.
SEGMENTS, ENCODED = 400_000, 2048
#: Longer segments of ASCII go to A's own library, as the faster one fails at a million blanks in a row.
LONG_SEGMENT = 100_000
#: Pairs whose counts every task holds (13 bytes each): the commonest ones; documents that have others are joined to them.
HEAD = 1 << 20
#: Bins of counts for each doubling.
BINS = 8
#: White space of SentencePiece (fixed value).
BLANK = "▁"
#: Between a visible ASCII character and a blank neither tokenizer merges: A's pattern starts anew at a blank after
#: other than white space, and B has no piece with a blank after something else (else its texts stay whole). A blank that
#: ends a text stays with what is before it, as B puts no blank before an empty text.
CUT = r"([!-~]) "
#: Characters of which one that no text of a part has marks the cuts; if they have all, the texts stay whole.
MARKS = [chr(k) for k in range(1, 9)]


def byte_level() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: visible Latin-1 characters stand for themselves, the other
    bytes are the characters from 256 on, in order."""
    shown = [b for b in range(256) if chr(b).isprintable() and b != 32]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}


def in_a_row(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of lists in a row, and the number of each."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(n.sum())), n


class ByteLevel:
    """Tokenizer A, from the JSON of a byte-level BPE whose pre-tokenizer is the pattern of that kind.

    Its library encodes what has other than ASCII characters. ASCII, of which all libraries have one notion, is encoded
    by the faster library from the same vocabulary, if its ids follow the order of merges, which is what that one needs.
    """

    def __init__(self, text: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        self.library.encode_special_tokens = True
        model, byte = json.loads(text)["model"], byte_level()
        special = {x["id"] for x in json.loads(text)["added_tokens"]}
        ids = {bytes(map(byte.__getitem__, t)): k for t, k in model["vocab"].items() if k not in special}
        self.bytes = [b""] * (max(model["vocab"].values()) + 1)
        for t, k in ids.items():
            self.bytes[k] = t
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        ordered = [model["vocab"]["".join(m)] for m in pairs] == list(range(256, len(ids))) and sorted(ids.values()) == list(range(len(ids)))
        self.ascii = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={}) if ordered else None
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, and the number of each."""
        plain = np.array([bool(self.ascii) and len(t) <= LONG_SEGMENT and t.isascii() and "!" <= t[-1] <= "~" for t in texts], bool)
        others = self.library.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False)
        rest, n_rest = in_a_row([x.ids for x in others])
        if not plain.any():
            return rest, n_rest
        # All that end in a visible ASCII character, whence tokens begin anew, are encoded as one text.
        mine = [t for t, p in zip(texts, plain) if p]
        fast = self.ascii.encode_to_numpy("".join(mine), disallowed_special=()).astype(np.int32)
        ends = np.searchsorted(np.cumsum(self.sizes[fast]), np.cumsum([len(t) for t in mine]), "right")
        n = np.zeros(len(texts), np.int64)
        n[plain], n[~plain] = np.diff(ends, prepend=0), n_rest
        which, ids = np.repeat(plain, n), np.empty(len(fast) + len(rest), np.int32)
        ids[which], ids[~which] = fast, rest
        return ids, n


class Pieces:
    """Tokenizer B, from the model of a SentencePiece vocabulary, which puts a blank before a text itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(k) for k in range(self.library.vocab_size())]
        self.cuts = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(k) else p.replace(BLANK, " ").encode() for k, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, and the number of each."""
        return in_a_row(self.library.encode([t[1:] for t in texts], num_threads=1))


class Tokens:
    """Ids of segments, one array after the other, and where each segment's begin."""

    def __init__(self, tokenizer: ByteLevel | Pieces):
        self.tokenizer, self.bytes = tokenizer, tokenizer.bytes
        self.sizes, self.pieces = np.array([len(b) for b in self.bytes], np.int64), pa.array(self.bytes, pa.large_binary())
        self.clear()

    def clear(self) -> None:
        self.ids, self.at, self.same = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)

    def add(self, segments: list[str]) -> None:
        """Encodes more segments, and tells of each whether its tokens' bytes are its own."""
        found = [self.tokenizer.encode(segments[k : k + ENCODED]) for k in range(0, len(segments), ENCODED)]
        ids, n = (np.concatenate([np.zeros(0, kind), *(x[k] for x in found)]) for k, kind in ((0, np.int32), (1, np.int64)))
        sizes = pc.binary_length(pa.array(segments, pa.string())).to_numpy(zero_copy_only=False)
        if np.array_equal(segmented(self.sizes[ids], np.cumsum(n)), sizes) and "".join(segments).encode() == self.spelled(ids):
            same = np.ones(len(n), bool)
        else:
            each = np.split(ids, np.cumsum(n)[:-1])
            same = np.array([b"".join(map(self.bytes.__getitem__, x)) == s.encode() for x, s in zip(each, segments)], bool)
        self.ids, self.same = np.concatenate([self.ids, ids]), np.concatenate([self.same, same])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n)])

    def spelled(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens in a row."""
        text = self.pieces.take(pa.array(ids))
        return text.buffers()[2].to_pybytes()[: int(self.sizes[ids].sum())] if len(ids) else b""

    def joined(self, segments: np.ndarray) -> bytes:
        return self.spelled(self.of(segments)[0])

    def of(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments in a row, and the number of each."""
        n = self.at[segments + 1] - self.at[segments]
        return self.ids[np.repeat(self.at[segments] - np.cumsum(n) + n, n) + np.arange(n.sum())], n


def segmented(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values up to each end, less those up to the end before."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[np.concatenate([[0], ends])])


class Aligner:
    """Aligns the texts of a task's batches."""

    def __init__(self, a_json: str, b_model: bytes):
        first, second = ByteLevel(a_json), Pieces(b_model)
        self.a, self.b, self.cuts = Tokens(first), Tokens(second), second.cuts
        self.numbers: defaultdict[str, int] = defaultdict(count().__next__)
        # Decimal ids with what follows them: A in a group and last in it, B in a group, last in it and last of a document.
        a = [b"%d%s" % (k, s) for k in range(len(first.bytes)) for s in (b",", b"|")]
        b = [b"%d%s" % (k, s) for k in range(len(second.bytes)) for s in (b",", b";", b"")]
        self.written, self.b_from = pa.array(a + b, pa.large_binary()), len(a)

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' segments in a row, all of which are encoded, and how many each text has."""
        if len(self.numbers) > SEGMENTS:
            self.numbers = defaultdict(count().__next__)
            self.a.clear()
            self.b.clear()
        empty, whole = pc.equal(texts, ""), pc.binary_join_element_wise("", texts, " ")
        mark = next((c for c in MARKS if not pc.any(pc.match_substring(texts, c)).as_py()), None)
        if self.cuts and mark:
            marked = pc.replace_substring_regex(whole, CUT, rf"\1{mark} ")
            lists = pc.split_pattern(pc.replace_substring_regex(marked, rf"{mark} \z", " "), mark)
        else:
            lists = pa.ListArray.from_arrays(pa.array(range(len(whole) + 1), pa.int32()), whole)
        n = np.where(empty, 0, pc.list_value_length(lists)).astype(np.int64)
        kept = pc.list_flatten(lists.filter(pc.invert(empty))).dictionary_encode()
        had = len(self.numbers)
        numbers = np.fromiter(map(self.numbers.__getitem__, kept.dictionary.to_pylist()), np.int64, len(kept.dictionary))
        new = list(islice(self.numbers, had, None))
        self.a.add(new)
        self.b.add(new)
        return numbers[kept.indices.to_numpy()], n

    def aligned(self, texts: pa.Array) -> tuple[dict[str, np.ndarray], list[str]]:
        """Figures and links of each text, and digests."""
        texts = pc.fill_null(texts, "")
        segments, n = self.segments(texts)
        good = (self.a.same & self.b.same)[segments]
        if not good.all():
            # Texts with a segment whose tokens spell something else are out, unless they spell the whole text still.
            ends = np.cumsum(n)
            for k in np.flatnonzero(segmented(~good, ends)):
                mine = slice(ends[k] - n[k], ends[k])
                good[mine] = self.a.joined(segments[mine]) == self.b.joined(segments[mine]) == (" " + texts[k].as_py()).encode()
            n = segmented(good, ends)
            segments = segments[good]
        last = np.cumsum(n)
        (a, per_a), (b, per_b) = self.a.of(segments), self.b.of(segments)
        n_a, n_b = segmented(per_a, last), segmented(per_b, last)
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        # By byte: whether a token of A ends there, of B, and both, with the number of ends up to there.
        size = int(ends_a[-1]) if len(a) else 0
        in_a, in_b = np.bincount(ends_a, minlength=size + 1) > 0, np.bincount(ends_b, minlength=size + 1) > 0
        both = in_a & in_b
        upto_a, upto_b, upto = np.cumsum(in_a, dtype=np.int32), np.cumsum(in_b, dtype=np.int32), np.cumsum(both, dtype=np.int32)
        # Documents end where their last token does.
        ends = np.concatenate([[0], ends_a])[np.cumsum(n_a)]
        n_groups, n_links = np.diff(upto[ends], prepend=0), np.diff((upto_a + upto_b - upto)[ends], prepend=0)
        links = np.flatnonzero(in_a | in_b)
        pair = a[upto_a[links] - in_a[links]].astype(np.int64) * len(self.b.bytes) + b[upto_b[links] - in_b[links]]
        span = len(self.a.bytes) * len(self.b.bytes)
        keys, times = np.unique(np.repeat(np.arange(len(texts)), n_links) * span + pair, return_counts=True)
        at = np.searchsorted(keys, np.arange(len(texts) + 1) * span)
        sums = self.digests(a, b, ends_a, ends_b, both, upto_a, upto_b, upto, ends, n_a + n_b)
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "pairs": keys % span, "times": times, "at": at}, sums

    def digests(self, a, b, ends_a, ends_b, both, upto_a, upto_b, upto, ends, tokens) -> list[str]:
        """Digests of the groups of each document, written out for all of them at once."""
        cuts = np.flatnonzero(both)
        a_before, b_before = upto_a[cuts], np.concatenate([[0], upto_b[cuts]])
        codes = np.empty(len(a) + len(b), np.int64)
        # A token comes after those of its own side before it, and the other side's of groups before (B: its group's too).
        codes[np.arange(len(a)) + b_before[upto[ends_a] - both[ends_a]]] = 2 * a.astype(np.int64) + both[ends_a]
        final = np.zeros(len(both), bool)
        final[ends] = True
        codes[np.arange(len(b)) + a_before[upto[ends_b] - both[ends_b]]] = self.b_from + 3 * b.astype(np.int64) + both[ends_b] + final[ends_b]
        text = self.written.take(pa.array(codes))
        at = np.frombuffer(text.buffers()[1], np.int64)[np.concatenate([[0], np.cumsum(tokens)])] if len(codes) else np.zeros(len(tokens) + 1, np.int64)
        data = memoryview(text.buffers()[2]) if len(codes) else b""
        return [hashlib.sha256(data[x:y]).hexdigest() if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist())]


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have PART_BYTES together, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held + size > PART_BYTES and k > begin:
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += size
    if batch.num_rows > begin:
        yield batch.slice(begin)


def linked(batches: Iterator[pa.RecordBatch], a_json: str, b_model: bytes, number: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (row, text) to rows with figures, digest, and the pairs of ids that are linked in them with how often."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    aligner = Aligner(a_json, b_model)
    for batch in batches:
        for part in parts(batch):
            got, sums = aligner.aligned(part["text"])
            at = pa.array(got["at"], pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(got[c], kind)) for c, kind in (("pairs", number), ("times", pa.int32()))]
            figures = [pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
            names = ["row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
            yield pa.RecordBatch.from_arrays([part["row"], *figures, pa.array(sums, pa.string()), *lists], names)


def counted(batches: Iterator[pa.RecordBatch], head) -> Iterator[pa.RecordBatch]:
    """Adds the links' counts, as far as the head of counts has their pairs; the other pairs stay in the rows."""
    pairs, n, best = head.value
    for batch in batches:
        of = lambda c: batch[c].flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(batch["pairs"]).to_numpy(zero_copy_only=False), dtype=np.int64)
        mine, times = of("pairs"), of("times").astype(np.int64)
        at = np.minimum(np.searchsorted(pairs, mine), max(len(pairs) - 1, 0))
        here = pairs[at] == mine if len(pairs) else np.zeros(len(mine), bool)
        sums = [segmented(np.where(here, times * x[at], 0) if len(pairs) else times * 0, ends) for x in (best, n)]
        left = pa.array(np.concatenate([[0], np.cumsum(segmented(~here, ends))]), pa.int32())
        lists = [pa.ListArray.from_arrays(left, pa.array(x[~here], batch.schema.field(c).type.value_type)) for c, x in (("pairs", mine), ("times", times))]
        columns = [batch.column(k) for k in range(batch.num_columns - 2)]
        yield pa.RecordBatch.from_arrays([*columns, *lists, *map(pa.array, sums)], [*batch.schema.names, "n_best", "count_sum"])


class Alignment:
    """Two vocabularies: A by the file of a byte-level BPE, B by that of a SentencePiece model."""

    def __init__(self, spark: SparkSession, a_file: str, b_file: str, head: int = HEAD):
        self.spark, self.head = spark, head
        with open(a_file, encoding="utf-8") as a, open(b_file, "rb") as b:
            self.a_json, self.b_model = a.read(), b.read()
        self.n_b = len(Pieces(self.b_model).bytes)
        narrow = len(ByteLevel(self.a_json).bytes) * self.n_b <= 1 << 31
        self.number, self.kind = (pa.int32(), T.IntegerType()) if narrow else (pa.int64(), T.LongType())

    def links(self, df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
        """Rows as `row` (its columns to keep; all, if not named) with n_a, n_b, n_groups, n_links, groups_sha256, and
        `pairs` (A id times B's vocabulary, plus B id) linked in the text with `times`.

        A text that is null, empty, or not what its tokens' bytes spell with a blank before it, has no tokens: zeros and
        ''. Rows stay in their partitions, repeated ones too; an empty table stays empty.
        """
        keep = keep or df.columns
        a_json, b_model, number = self.a_json, self.b_model, self.number
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
        shape = T.StructType().add("row", T.StructType([df.schema[c] for c in keep]))
        for c in ("n_a", "n_b", "n_groups", "n_links"):
            shape = shape.add(c, T.LongType())
        shape = shape.add("groups_sha256", T.StringType()).add("pairs", T.ArrayType(self.kind)).add("times", T.ArrayType(T.IntegerType()))
        return rows.mapInArrow(lambda batches: linked(batches, a_json, b_model, number), shape)

    def counts(self, links: DataFrame) -> DataFrame:
        """Every pair of linked ids with n, how many links hold it, whether that is the most of its B id, and the bin of n.

        B ids are as many as B's vocabulary, so their side of the join is small.
        """
        each = links.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
        each = written(each.withColumn("b", F.col("pair") % self.n_b), "alignment-pairs")
        most = each.groupBy("b").agg(F.max("n").alias("most"))
        bins = F.floor(F.log2("n") * BINS).cast("int").alias("bin")
        return each.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"), bins)

    def commonest(self, counts: DataFrame) -> int:
        """The least bin with which the bins from it on hold no more pairs than the head may."""
        held, least = 0, 1 << 30
        for r in sorted(counts.groupBy("bin").count().collect(), reverse=True):
            held += r["count"]
            if held > self.head:
                break
            least = r["bin"]
        return least

    def align(self, df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
        """The columns to keep with the figures of links() and, of the links of each text, n_best (those whose pair is
        counted most of all pairs of its B id) and count_sum (the sum of their pairs' counts over all documents).

        Tasks hold the counts of the commonest pairs, HEAD at most. What pairs a row has beside is joined to the other
        counts: none of these pairs is in many rows, so none is hot.
        """
        links = self.links(df, text, keep)
        links = written(links.withColumn("at", F.monotonically_increasing_id()).select("at", *links.columns), "alignment-links")
        counts = written(self.counts(links), "alignment-counts")
        least = self.commonest(counts)
        head = counts.where(F.col("bin") >= least).select("pair", "n", "best").orderBy("pair").toArrow()
        tail = counts.where(F.col("bin") < least)
        arrays = tuple(head[c].to_numpy() for c in ("pair", "n", "best"))
        shared = self.spark.sparkContext.broadcast(arrays)
        shape = T.StructType([*links.schema.fields]).add("n_best", T.LongType()).add("count_sum", T.LongType())
        rows = links.mapInArrow(lambda batches: counted(batches, shared), shape)
        figures = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        if not tail.isEmpty():
            rows = written(rows, "alignment-rows")
            each = rows.select("at", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("at", F.col("x.pairs").alias("pair"), "x.times")
            more = each.join(tail, "pair").groupBy("at").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
            plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
            rows = rows.drop("pairs", "times").join(more, "at", "left")
            rows = rows.select("row", *[plus(c, {"n_best": "more_best", "count_sum": "more"}[c]) if c in ("n_best", "count_sum") else c for c in figures])
        return rows.select("row.*", *figures)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents in the tokens of a byte-level BPE and of a SentencePiece model."""
    import public_tokenizers

    both = Alignment(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return both.align(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
