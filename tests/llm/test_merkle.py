"""The manifest against a tree that is built whole."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import merkle, queries
from corpusmill.llm.common import table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [None if row[c] is None else str(row[c]) for c in FIELDS[:-1]] + [text]
    return h(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def levels(nodes):
    """All levels of a tree, leaves first."""
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][k : k + 3]) for k in range(0, len(found[-1]), 3)])
    return found


def path(tree, at):
    """Siblings before and after, by level."""
    steps = []
    for nodes in tree[:-1]:
        run = at - at % 3
        steps.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])))
        at //= 3
    return steps


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = [levels([leaf(r, r["text"]) for r in groups[s]]) for s in order]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(order):
        for at, r in enumerate(groups[s]):
            steps = path(trees[k], at) + path(top, k)
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            node = leaf(r, r["text"].replace("\n", "") if tampered else r["text"])
            for before, after in steps:
                node = h(before, node, after)
            root = top[-1][0]
            out.append((r["doc_id"], trees[k][0][at], trees[k][-1][0], root, h("".join(b + a for b, a in steps)), node, node == root))
    return sorted(out, key=str)


def query(spark, monkeypatch, df):
    monkeypatch.setattr(merkle, "table", lambda *_: df)
    return sorted(map(tuple, merkle.op12_merkle(spark, "").collect()), key=str)


def test_query_equals_a_whole_tree(spark, small):
    rows = table(spark, small, "documents").collect()
    got = sorted(map(tuple, queries.QUERIES["op12_merkle"](spark, small).collect()), key=str)
    assert got == plain(rows) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_odd_rows_over_blocks_of_any_depth(spark, make_docs, odd_rows, monkeypatch, depth):
    """Nulls, repeated rows and ids, many groups, one of them hot, and as many layers as small blocks need."""
    monkeypatch.setattr(merkle, "LEVELS", depth)
    monkeypatch.setattr(merkle, "BLOCK", 3**depth)
    rows = odd_rows + [(100 + k, f"a\nb{k}", "en", "hot") for k in range(300)] + [(k, "x\n", "de", f"é{k % 11}") for k in range(60)] + [(7, "same\n", "en", "hot")] * 4
    docs = make_docs(rows, clashes=True)
    assert query(spark, monkeypatch, docs) == plain(docs.collect())


def test_no_rows_one_row_and_one_group(spark, make_docs, monkeypatch):
    assert query(spark, monkeypatch, make_docs([(1, "a", "en", "s")]).limit(0)) == []
    for n in (1, 2, 3, 4, 27, 28):
        docs = make_docs([(k, f"{k}\n", "en", None) for k in range(n)])
        assert query(spark, monkeypatch, docs) == plain(docs.collect())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 100, 242, 243, 500, 729])
def test_traversal_gives_every_path_and_holds_few_nodes(n):
    leaves = [h(str(k)) for k in range(n)]
    tree, depth = levels(leaves), merkle.levels_of(n)
    walk, most = merkle.Traversal(leaves, depth), 0
    assert walk.root() == tree[-1][0] and depth == len(tree) - 1
    for k, (before, after) in enumerate(walk):
        assert list(zip(before, after)) == path(tree, k)
        most = max(most, walk.held)
    assert most <= 6 * depth


def test_stacks_are_ready_before_their_nodes_are_needed(monkeypatch):
    """The steps between leaves do all the work, so no leaf waits for a subtree."""
    late, take = [], merkle.Treehash.take
    walk = merkle.Traversal([h(str(k)) for k in range(729)], 6)
    monkeypatch.setattr(merkle.Treehash, "take", lambda tree: late.append(tree.end - tree.at) or take(tree))
    for _ in walk:
        pass
    assert late and max(late) == 0


def test_proofs_of_other_fields_and_orders(spark, make_docs):
    """The general interface: another grouping and order, fewer fields, nothing tampered with."""
    docs = make_docs([(k, f"t{k}", "en" if k % 2 else "de", f"s{k:03}") for k in range(40)])
    got = merkle.Manifest(docs, ["source", "text"], group="lang", order="source").proofs()
    good = got.where(merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root"))
    assert good.count() == 40 and got.where("other is not null").isEmpty() and got.select("subroot").distinct().count() == 2
    assert [r["order"] for r in got.orderBy("order").collect()] == [f"s{k:03}" for k in range(40)]
