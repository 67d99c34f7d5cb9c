"""Stored indexes that skip what can't be among the best, against searches of everything."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import clusters, retrieval


@pytest.mark.parametrize("held", [retrieval.HELD, 2])
def test_ranges_that_cannot_be_among_the_best_are_not_read(spark, small, tmp_path, monkeypatch, held):
    """With bounds that the driver holds, and with more than that."""
    monkeypatch.setattr(retrieval, "HELD", held)
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id as id", "text")
    docs = docs.unionByName(docs.selectExpr("id + 1000 as id", "concat(text, ' rareword ', text) as text").where("id % 40 = 0")).unionByName(docs.selectExpr("id + 5000 as id", "substr(text, 1, 300) as text"))
    stored = retrieval.Postings.build(docs, f"{tmp_path}/postings")
    for words in (["the", "nicht"], ["rareword"], ["the", "rareword", "tion", "no-such-term"], ["no-such-term"]):
        for k in (1, 20, 1000):
            best, report = stored.search(spark, words, k)
            assert best.collect() == retrieval.sparse(docs, words, k).collect(), (words, k)
            assert report["read"] <= report["ranges"]
    many = spark.range(20_000).select("id", F.concat(F.lit("common "), F.when(F.col("id") % 1000 == 7, "common common").otherwise(F.repeat(F.lit("filler "), (F.col("id") % 50).cast("int")))).alias("text"))
    stored = retrieval.Postings.build(many, f"{tmp_path}/many")
    best, report = stored.search(spark, ["common"], 10)
    assert best.collect() == retrieval.sparse(many, ["common"], 10).collect() and report["read"] < report["ranges"] / 4


def test_postings_of_no_documents(spark, tmp_path):
    stored = retrieval.Postings.build(spark.createDataFrame([], "id long, text string"), f"{tmp_path}/none")
    assert stored.top(spark, ["the"]).count() == 0


def vectors(n=3000, d=16, groups=25):
    chance = np.random.default_rng(6)
    centers = chance.normal(size=(groups, d))
    return [(k, str(k % 3), (centers[k % groups] * chance.uniform(0.5, 3) + chance.normal(size=d) * 0.3).tolist()) for k in range(n)]


def test_clusters_give_the_exact_nearest_and_skip_the_rest(spark, tmp_path):
    rows = vectors()
    odd = [(-1, "0", None), (-2, "0", [0.0] * 16), (-3, "0", [float("nan")] * 16), (-4, "0", [1.0] * 15 + [None]), (-5, "1", rows[7][2]), (-6, "1", rows[7][2])]
    points = spark.createDataFrame(rows + odd, "id long, technique string, dense array<double>")
    stored = clusters.Clusters.build(points, f"{tmp_path}/clusters")
    for query in (rows[7][2], rows[100][2], [1.0] + [0.0] * 15, [-x for x in rows[3][2]]):
        for k, technique in ((1, None), (20, None), (20, "1"), (20, "none")):
            best, report = stored.search(spark, query, k, technique)
            some = points.where("id > -1 or id < -4")
            some = some if technique is None else some.where(F.col("technique") == technique)
            assert best.collect() == retrieval.dense(some, query, k).collect()
            if technique is None and query is not None and query[0] in (rows[7][2][0], rows[100][2][0]):
                assert report["read"] < report["clusters"] / 2
    assert stored.top(spark, [0.0] * 16).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3])
def test_clusters_of_few_points(spark, tmp_path, n):
    points = spark.createDataFrame(vectors(n), "id long, technique string, dense array<double>")
    stored = clusters.Clusters.build(points, f"{tmp_path}/few")
    assert stored.top(spark, [1.0] * 16).collect() == retrieval.dense(points, [1.0] * 16).collect()


def test_cards_of_equal_scores_are_in_the_order_of_their_own_ids(spark):
    """Ranks of one list tie with those of the other; the fifth card is 10's or 9's, and as strings 10 comes first."""
    texts = {3: "word word word", 4: "word word x", 10: "word x y"}
    near = {1: [1.0, 0.0], 2: [1.0, 0.1], 9: [1.0, 0.2]}
    rows = [(k, str(k), "s", "t", texts.get(k, "a b c"), near.get(k)) for k in (1, 2, 3, 4, 9, 10)]
    index = spark.createDataFrame(rows, "id long, prompt_id string, source string, technique string, text string, dense array<double>")
    assert [r.id for r in retrieval.search(index, "word", [1.0, 0.0], k=6).collect()] == ["1", "3", "2", "4", "10"]


def test_ranges_are_inverted_whole_whatever_the_batches(monkeypatch):
    rows = [(k, k // 4, [f"t{(k * j) % 7}" for j in range(k % 6)]) for k in range(50)] + [(50, 12, None)]
    kind = pa.schema({"id": pa.int64(), "range": pa.int64(), "terms": pa.list_(pa.string())})
    table = pa.Table.from_pylist([dict(zip(kind.names, r)) for r in rows], kind)
    expected = {(t, g): [(k, terms.count(t)) for k, r, terms in rows if r == g and terms and t in terms] for g in range(13) for t in (f"t{j}" for j in range(7))}
    for size in (1, 3, 4, 7, 100):
        for most in (0, 12, 1 << 20):
            monkeypatch.setattr(retrieval, "TERMS", most)
            found = [r for b in retrieval.inverted(iter(table.to_batches(size)), 3.0) for r in b.to_pylist()]
            assert len(found) == len({(r["term"], r["range"]) for r in found})
            assert {(r["term"], r["range"]): r["id"] for r in found} == {key: [k for k, _ in docs] for key, docs in expected.items() if docs}
            for r in found:
                sizes = {k: len(terms or []) for k, _, terms in rows}
                assert r["weight"] == [tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[k] / 3.0)) for k, tf in expected[r["term"], r["range"]]]
