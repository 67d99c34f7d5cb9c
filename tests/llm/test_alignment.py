"""Tokens of two vocabularies aligned, against a version that looks at every pair of tokens."""

import hashlib
import json
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpusmill.llm import alignment, queries
from corpusmill.llm.common import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def spans(ids, spelled):
    ends = np.cumsum([len(spelled[i]) for i in ids]).tolist()
    return list(zip(ids, [0, *ends[:-1]], ends))


def plain(libraries, texts):
    """The contract's columns of each text, a document at a time."""
    first, second = libraries
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    a_bytes = {k: bytes(byte[c] for c in t) for t, k in first.get_vocab(with_added_tokens=False).items() if k != 50256}
    pieces = [second.id_to_piece(k) for k in range(second.vocab_size())]
    b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
    each = []
    for text in texts:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        same = b"".join(a_bytes[i] for i in a) == b"".join(b_bytes[i] for i in b) == (" " + (text or "")).encode()
        a, b = (spans(a, a_bytes), spans(b, b_bytes)) if same else ([], [])
        links = [(x, y) for x, p, q in a for y, r, s in b if p < s and r < q] if len(a) < 3000 else swept(a, b)
        cuts = sorted({q for _, _, q in a} & {s for _, _, s in b})
        groups, i, j = [], 0, 0
        for cut in cuts:
            k, m = i, j
            while k < len(a) and a[k][2] <= cut:
                k += 1
            while m < len(b) and b[m][2] <= cut:
                m += 1
            groups.append(",".join(str(x[0]) for x in a[i:k]) + "|" + ",".join(str(x[0]) for x in b[j:m]))
            i, j = k, m
        each.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    counts = Counter(x for e in each for x in e[3])
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return [(na, nb, g, len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), digest) for na, nb, g, ls, digest in each]


def swept(a, b):
    """Links of two long cuts of one text, by a pointer into each."""
    links, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        links.append((a[i][0], b[j][0]))
        q, s = a[i][2], b[j][2]
        i, j = i + (q <= s), j + (s <= q)
    return links


def texts_of(rows):
    chance = np.random.default_rng(2)
    letters = list("aeiostnr éüñß  0123,.!?'\n\t日😀▁İ<s>")
    made = ["".join(chance.choice(letters, chance.integers(1, 200))) for _ in range(150)]
    more = ["▁", "a▁b", "<|endoftext|> <s> </s> <0x41>", " ", "  ", "\n\n x  y \n", "x\x01y z\x02", "".join(map(chr, range(1, 40))) + " a b", "\0 \0", "ﬁ ½ ｆ é é", "日本語" * 40, "a" * 3000, "　x\xa0y \x85 ​ z"]
    return [t for _, t, *_ in rows] + made + more


@pytest.mark.parametrize("head", [alignment.HEAD, 500, 0])
def test_figures_equal_all_pairs_of_tokens(spark, make_docs, odd_rows, libraries, head):
    """With counts that tasks hold, with some of them joined, and with all of them joined."""
    texts = texts_of(odd_rows)
    docs = make_docs([(k, t) for k, t in enumerate(texts)], clashes=True).drop("text").join(make_docs([(k, t) for k, t in enumerate(texts)]).select("doc_id", "text"), "doc_id")
    both = alignment.Alignment(spark, A, B, head)
    got = both.align(docs, keep=["doc_id", "size"]).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == plain(libraries, texts)
    assert both.align(docs.limit(0), keep=["doc_id"]).count() == 0


def test_query_equals_the_plain_version(spark, small, libraries):
    rows = sorted(table(spark, small, "documents").select("doc_id", "text").collect())
    got = sorted(queries.QUERIES["op11_alignment"](spark, small).collect())
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    assert [tuple(r[c] for c in COLUMNS) for r in got] == plain(libraries, [r.text for r in rows])


def test_repeated_rows_each_have_a_row_and_count(spark, make_docs, libraries):
    texts = ["the water of time"] * 5 + ["the water"]
    got = alignment.Alignment(spark, A, B).align(make_docs([(1, t) for t in texts]), keep=["doc_id"]).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(plain(libraries, texts))


def test_texts_that_end_in_one_blank_after_ascii_have_their_tokens(spark, make_docs, libraries):
    texts = ["a ", "the water of time ", "x  ", "é ", "été y ", "日本 .  z ", "one two\n", " ", "the water of time"]
    got = alignment.Alignment(spark, A, B).align(make_docs(list(enumerate(texts))), keep=["doc_id"]).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == plain(libraries, texts)
    assert all(r.n_a for r in got)


def test_a_million_blanks_in_a_row_are_encoded(libraries):
    with open(A, encoding="utf-8") as f:
        fast = alignment.ByteLevel(f.read())
    text = " x" + " " * 1_200_000 + "y"
    ids, n = fast.encode([text, " z"])
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x.ids for x in libraries[0].encode_batch([text, " z"], add_special_tokens=False)]


def test_both_libraries_of_a_cut_ascii_alike(libraries):
    """Every token's text, and all short strings of the characters on which notions of white space might differ."""
    with open(A, encoding="utf-8") as f:
        fast = alignment.ByteLevel(f.read())
    chars = [*map(chr, range(33)), "a", "1", "'", "s", "\x7f", " "]
    texts = [" " + x + y + z + "." for x in chars for y in chars for z in chars]
    texts += [" " + t.decode() + "." for t in fast.bytes if t.isascii()]
    ids, n = fast.encode(texts)
    found = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert fast.ascii and found == [x.ids for x in libraries[0].encode_batch_fast(texts, add_special_tokens=False)]


def test_a_vocabulary_out_of_order_goes_to_its_own_library(libraries):
    with open(A, encoding="utf-8") as f:
        model = json.load(f)
    model["model"]["merges"][0], model["model"]["merges"][1] = model["model"]["merges"][1], model["model"]["merges"][0]
    assert alignment.ByteLevel(json.dumps(model)).ascii is None


def test_parts_hold_whole_rows_and_bounded_bytes(monkeypatch):
    monkeypatch.setattr(alignment, "PART_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"row": [1, 2, 3, 4, 5, 6], "text": ["abc", None, "x" * 40, "abcd", "abcdef", "z"]})
    assert [p["row"].to_pylist() for p in alignment.parts(batch)] == [[1, 2], [3], [4, 5], [6]]
