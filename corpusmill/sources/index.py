"""A stored index of points, which grows and changes by batches.

Points are in folders by hash of their id. A batch writes new versions of the folders that its ids fall into, and no
others, and then a manifest that names the files of every folder. That one rename is the change: before it readers see
the old folders, after it the new ones, and a batch that breaks off leaves nothing but files that nobody names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import filters
from corpusmill.sources import publish

#: Folders of an index, versions that a folder may be of before they become one, manifests that are kept (readers may use an
#: older one), and tasks that write a folder.
FOLDERS, VERSIONS, KEPT, SPREAD = 64, 8, 2, 4


class Index:
    """Points (id and any other columns) at a path."""

    def __init__(self, spark: SparkSession, path: str, folders: int = FOLDERS):
        self.spark, self.path, self.folders = spark, path.rstrip("/"), folders

    def folder(self, id_: Column) -> Column:
        return F.pmod(F.xxhash64(id_), F.lit(self.folders)).cast("int")

    def manifests(self) -> list[int]:
        """Numbers of manifests, oldest first."""
        fs, at = publish.place(self.spark, f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int | None = None) -> dict[int, list[str]]:
        """The versions of each folder that has points, by number: paths below the index."""
        number = number or max(self.manifests(), default=None)
        text = self.spark.read.text(f"{self.path}/manifests/{number}.json", wholetext=True).first()[0] if number else "{}"
        return {int(k): v for k, v in json.loads(text).items()}

    def commit(self, folders: dict[int, list[str]], number: int) -> None:
        """Names the current versions. If someone else has changed the index meanwhile, the number is taken, and this fails."""
        fs, at = publish.place(self.spark, f"{self.path}/manifests/{number}.json")
        draft = f"{self.path}/manifests/draft-{uuid.uuid4().hex}"
        publish.report(self.spark, draft, folders)
        if fs.exists(at) or not fs.rename(publish.place(self.spark, draft)[1], at):
            publish.remove(self.spark, draft)
            raise RuntimeError(f"{self.path} was changed by another writer; try the batch again")
        self.clear()

    def points(self, folders: list[int] | None = None) -> DataFrame | None:
        """The points of all folders or of some; None if there are none."""
        return self.read([v for k, held in sorted(self.manifest().items()) if folders is None or k in folders for v in held])

    def read(self, versions: list[str]) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{v}" for v in versions]) if versions else None

    def write(self, points: DataFrame) -> str:
        """Points (with their folder) and the filters of their ids as a new version; sorted within files, so that a search for
        a technique skips row groups."""
        version = f"data/{uuid.uuid4().hex}"
        order = [c for c in ("technique", "prompt_id", "id") if c in points.columns]
        spread = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SPREAD))
        points.repartition("folder", spread).sortWithinPartitions("folder", *order).write.partitionBy("folder").parquet(f"{self.path}/{version}")
        ids = self.spark.read.parquet(f"{self.path}/{version}").select(F.col("folder").cast("int").alias("folder"), "id")
        filters.build(ids, "folder", "id").write.parquet(f"{self.path}/{version.replace('data/', 'filters/')}")
        return version

    def batch(self, points: DataFrame) -> tuple[DataFrame, list[int]]:
        """One point for each id, and the numbers of the folders that they fall into, at most as many as folders."""
        rows = publish.kept(points.dropDuplicates(["id"]).withColumn("folder", self.folder(F.col("id"))), "index-batch")
        return rows, sorted(r["folder"] for r in rows.select("folder").distinct().collect())

    def upsert(self, points: DataFrame) -> list[int]:
        """Adds points, or puts them in the place of those of the same id; of several with one id any one is taken.
        Returns the numbers of the folders that were written anew."""
        number, held = max(self.manifests(), default=0), self.manifest()
        batch, touched = self.batch(points)
        if not touched:
            return []
        old = self.read([v for k in touched for v in held.get(k, [])])
        if old is not None:
            rest = old.join(batch.select("id"), "id", "left_anti").withColumn("folder", self.folder(F.col("id")))
            batch = batch.unionByName(rest, allowMissingColumns=True)
        version = self.write(batch)
        self.commit(held | {k: [f"{version}/folder={k}"] for k in touched}, number + 1)
        return touched

    def append(self, points: DataFrame) -> list[int]:
        """Adds the points whose ids the index has not, and leaves others as they are. Nothing that is there is read but
        filters, and the ids of folders in which these find a possible repeat. Folders of too many versions become one."""
        number, held = max(self.manifests(), default=0), self.manifest()
        batch, touched = self.batch(self.unseen(points))
        if not touched:
            return []
        version = self.write(batch)
        now = held | {k: [*held.get(k, []), f"{version}/folder={k}"] for k in touched}
        if many := [k for k, v in now.items() if len(v) > VERSIONS]:
            rows = self.read([v for k in many for v in now[k]])
            whole = self.write(rows.withColumn("folder", self.folder(F.col("id"))))
            now |= {k: [f"{whole}/folder={k}"] for k in many}
        self.commit(now, number + 1)
        return touched

    def seen(self, ids: DataFrame) -> DataFrame | None:
        """Those of ids that the index has; None if it has none. An id is looked up only if a filter lets it through."""
        held = self.manifest()
        if not held:
            return None
        ids = ids.select("id").withColumn("folder", self.folder(F.col("id")))
        # A version has the filters of the folders that were written with it, of which some may be replaced by now.
        stored = self.spark.read.parquet(*sorted({f"{self.path}/filters/{v.split('/')[1]}" for versions in held.values() for v in versions}))
        version = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        named = self.spark.createDataFrame([(k, v.split("/")[1]) for k, versions in held.items() for v in versions], "folder int, version string")
        current = stored.select("folder", "slices", "slice", "words", version.alias("version")).join(F.broadcast(named), ["folder", "version"]).drop("version")
        maybe = publish.kept(filters.possible(ids, current, "folder", "id"), "index-maybe")
        folders = sorted(r["folder"] for r in maybe.select("folder").distinct().collect())
        known = self.points(folders) if folders else None
        return known.select("id").join(maybe, "id", "left_semi") if known is not None else None

    def unseen(self, points: DataFrame) -> DataFrame:
        """Points whose id the index has not."""
        seen = self.seen(points)
        return points if seen is None else points.join(publish.kept(seen, "index-seen"), "id", "left_anti")

    def clear(self) -> None:
        """Removes older manifests, and the versions that only they name."""
        numbers = self.manifests()
        versions = lambda some: {v.split("/")[1] for n in some for held in self.manifest(n).values() for v in held}
        for v in versions(numbers[:-KEPT]) - versions(numbers[-KEPT:]):
            publish.remove(self.spark, f"{self.path}/data/{v}")
            publish.remove(self.spark, f"{self.path}/filters/{v}")
        for n in numbers[:-KEPT]:
            publish.remove(self.spark, f"{self.path}/manifests/{n}.json")
