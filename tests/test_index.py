"""A stored index under batches, and the filters of its ids."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import filters
from corpusmill.sources import publish
from corpusmill.sources.index import KEPT, VERSIONS, Index


def points(spark, ids, text="a"):
    return spark.createDataFrame([(f"id{k}", f"p{k}", text) for k in ids], "id string, prompt_id string, text string")


def held(index):
    return {r.id: r.text for r in index.points().collect()}


def files_of(tmp_path):
    return {p.relative_to(tmp_path).as_posix(): p.stat().st_mtime_ns for p in tmp_path.rglob("data/**/part-*")}


def test_an_upsert_of_one_point_rewrites_one_folder(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/index", folders=8)
    assert index.points() is None and index.upsert(points(spark, [])) == []
    assert index.upsert(points(spark, range(200))) == list(range(8))
    before, manifest = files_of(tmp_path), index.manifest()
    touched = index.upsert(points(spark, [7, 7], "b"))
    assert len(touched) == 1 and {k for k, v in index.manifest().items() if v != manifest[k]} == set(touched)
    assert held(index) == {f"id{k}": "b" if k == 7 else "a" for k in range(200)}
    # Files of the version before stay for who reads it still, and none of them is written again.
    after = files_of(tmp_path)
    assert all(after[f] == t for f, t in before.items()) and {f.split("/")[3] for f in after if f not in before} == {f"folder={touched[0]}"}
    assert index.upsert(points(spark, [1000], "c")) and len(held(index)) == 201


@pytest.mark.parametrize("step", ["write", "commit"])
def test_a_batch_that_breaks_off_loses_nothing(spark, tmp_path, monkeypatch, step):
    index = Index(spark, f"{tmp_path}/index", folders=4)
    index.upsert(points(spark, range(50)))

    def broken(self, *args):
        if step == "commit":
            publish.report(self.spark, f"{self.path}/manifests/draft-x", {})
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(Index, step, broken)
        with pytest.raises(OSError):
            index.upsert(points(spark, range(100), "b"))
    assert held(index) == {f"id{k}": "a" for k in range(50)}
    index.upsert(points(spark, range(100), "b"))
    assert held(index) == {f"id{k}": "b" for k in range(100)}


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    index, write = Index(spark, f"{tmp_path}/index", folders=4), Index.write
    index.upsert(points(spark, range(5)))

    def slow(self, rows):
        version = write(self, rows)
        with monkeypatch.context() as m:
            m.setattr(Index, "write", write)
            Index(spark, self.path, 4).upsert(points(spark, [9], "other"))
        return version

    with monkeypatch.context() as m:
        m.setattr(Index, "write", slow)
        with pytest.raises(RuntimeError, match="another writer"):
            index.upsert(points(spark, [3], "mine"))
    assert held(index) == {**{f"id{k}": "a" for k in range(5)}, "id9": "other"}


def test_new_ids_read_filters_only_and_none_is_written_twice(spark, tmp_path, monkeypatch):
    index, read = Index(spark, f"{tmp_path}/index", folders=4), []
    index.append(points(spark, range(300)))
    points_of = Index.points
    monkeypatch.setattr(Index, "points", lambda self, folders=None: read.append(folders) or points_of(self, folders))
    filters_only = index.unseen(points(spark, range(10_000, 10_040)))
    assert filters_only.count() == 40 and sum(map(len, read)) <= 2
    index.append(points(spark, range(290, 330), "b"))
    index.append(points(spark, range(290, 330), "c"))
    monkeypatch.setattr(Index, "points", points_of)
    assert index.points().count() == 330 and held(index) == {f"id{k}": "a" if k < 300 else "b" for k in range(330)}


def test_many_batches_keep_few_versions_and_manifests(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/index", folders=1)
    for k in range(VERSIONS + 3):
        index.append(points(spark, range(3 * k, 3 * k + 5)))
    assert index.points().count() == 3 * (VERSIONS + 2) + 5 and len(index.manifest()[0]) <= VERSIONS and len(index.manifests()) == KEPT


def test_filters_have_all_ids_and_few_others(spark):
    ids = spark.range(20_000).select((F.col("id") % 3).cast("int").alias("g"), F.concat(F.lit("x"), F.col("id")).alias("id"))
    made = filters.build(ids, "g", "id")
    assert made.where("slices < 1 or size(words) <> 1024").isEmpty() and made.select("g").distinct().count() == 3
    assert filters.possible(ids, made, "g", "id").count() == 20_000
    others = spark.range(20_000).select((F.col("id") % 4).cast("int").alias("g"), F.concat(F.lit("y"), F.col("id")).alias("id"))
    assert filters.possible(others, made, "g", "id").count() < 200
