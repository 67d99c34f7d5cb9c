"""What the service offers, as functions: search, categories, prompt lookup and statistics."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import effective_query
from corpusmill.operators import ingest, retrieval
from corpusmill.sources import registry

TTL_SECONDS = 300


@dataclass
class Service:
    """An index and the providers around it. Each query has its own filters, so calls don't affect each other."""

    index: DataFrame
    postings: retrieval.Postings | None = None
    embedder: object = field(default_factory=ingest.HashedEmbedder)
    reranker: object | None = field(default_factory=ingest.Overlap)
    synthesizer: object = field(default_factory=ingest.Extractive)
    clock: object = time.monotonic
    _counts: tuple[float, list] | None = None

    def query(self, query: str, category: str | None = None) -> dict:
        """The answer and result cards of a query; a blank query searches for the category, and without one is None."""
        spark = self.index.sparkSession
        query = spark.range(1).select(effective_query(F.lit(query).cast("string"), F.lit(category).cast("string"))).first()[0]
        if not query:
            return {}
        vector = self.embedder.one(spark, query)
        cards = retrieval.search(self.index, query, vector, self.reranker, category, stored=self.postings)
        rows = [r.asDict() for r in cards.collect()]
        counts: dict[str, int] = {}
        for r in rows:
            counts[r["technique"]] = counts.get(r["technique"], 0) + 1
        answer = ingest.synthesize(query, (r["prompt_excerpt"] for r in rows), self.synthesizer)
        return {"answer": answer, "results": rows, "technique_breakdown": counts, "result_count": len(rows), "query_type": "semantic"}

    def categories(self, hide_empty: bool = False) -> list[dict]:
        """Techniques with counts, kept for TTL_SECONDS."""
        now = self.clock()
        if self._counts is None or now >= self._counts[0]:
            counted = retrieval.category_counts(self.index.select("technique"), registry.techniques(self.index.sparkSession))
            self._counts = now + TTL_SECONDS, [r.asDict() for r in counted.drop("position").collect()]
        return [r for r in self._counts[1] if r["count"] > 0 or not hide_empty]

    def prompt(self, prompt_id: str) -> dict:
        found = retrieval.lookup(self.index, prompt_id).first()
        if found is None:
            raise KeyError(prompt_id)
        return found.asDict()

    def stats(self) -> dict:
        return retrieval.stats(self.index).first().asDict()
