import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.operators import ingest, retrieval, sampling, taxonomy
from corpusmill.plans.common import corpus
from corpusmill.serve import Service
from corpusmill.sources import files
from corpusmill.sources.index import Index
from corpusmill.streaming import incremental


@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(0, 900), max_size=12), st.integers(1, 600))
@settings(max_examples=300, deadline=None)
def test_allocation_meets_budget_and_caps(available, budget):
    got = sampling.allocate(available, budget)
    assert set(got) == set(available) and all(0 <= got[k] <= available[k] for k in got)
    assert sum(got.values()) <= budget
    if available and sum(min(n, sampling.LEAST) for n in available.values()) > budget:
        assert sum(got.values()) == budget


def test_allocation_examples():
    assert sampling.allocate({"en": 620, "fr": 145, "de": 129, "es": 106}) == {"en": 175, "fr": 124, "de": 110, "es": 91}
    assert set(sampling.allocate({f"s{k:03d}": 10 for k in range(100)}).values()) == {5}
    assert sampling.allocate({}) == {}


def test_sample_does_not_depend_on_partitions(spark, small):
    docs = corpus(spark, small)
    first = sampling.select_round(docs, None, 1, 60).collect()
    again = sampling.select_round(docs.orderBy(F.rand(1)).repartition(7), None, 1, 60).collect()
    assert first == again and len(first) == 60
    second = sampling.select_round(docs, spark.createDataFrame(first), 2, 60).collect()
    assert not {r.prompt_id for r in first} & {r.prompt_id for r in second}


def records(spark, n=30):
    return spark.createDataFrame([(f"p{k}", f"s{k % 3}", "f", k, f"text {k} " + "w " * k) for k in range(n)], "prompt_id string, source string, source_file string, source_row long, text string")


def test_discovery_merges_checks_and_stops(spark, tmp_path):
    ids = lambda r: [f"R{r:02d}S{k:03d}" for k in range(1, 4)]
    rounds = [
        {"new_top_level_categories": [
            {"name": "Alpha", "description": "d", "distinguishing_traits": [" t ", "t"], "supporting_sample_ids": [*ids(1), "nope"], "subtechniques": [{"name": "Sub", "description": "d", "supporting_sample_ids": [ids(1)[0]]}, {"name": "Empty", "description": "d", "supporting_sample_ids": ["nope"]}]},
            {"name": "No support", "description": "d", "supporting_sample_ids": []}]},
        {"existing_top_level_matches": [{"top_level_name": " ALPHA ", "supporting_sample_ids": ids(2), "refined_traits": ["u"], "subtechniques": [{"name": "sub", "description": "d", "supporting_sample_ids": ids(2)}]}]},
        {"usage": {"input_tokens": 7, "output_tokens": 3}, "open_questions": [" why? ", "why?"]}, {},
    ]
    report = taxonomy.discover(records(spark), taxonomy.replay(rounds), budget=8)
    (alpha,) = report["categories"]
    assert (report["tokens"]["input"], report["tokens"]["output"]) == (7, 3)
    assert alpha["distinguishing_traits"] == ["t", "u"] and alpha["supporting_sample_ids"] == [*ids(1), *ids(2)]
    assert [s["name"] for s in alpha["subtechniques"]] == ["Sub"] and alpha["subtechniques"][0]["support_count"] == 4
    assert [r["new_categories"] for r in report["rounds"]] == [1, 0, 0] and report["rounds"][1]["evidence_growth"] == 3
    made = taxonomy.report(records(spark), report, "normalized", f"{tmp_path}/taxonomy.json")
    assert json.loads((tmp_path / "taxonomy.json").read_text()) == json.loads(json.dumps(made)) and made["report_version"] == 4
    assert made["saturation_status"]["reason"] == "no_meaningful_new_categories_for_consecutive_rounds" and made["source_record_counts"] == {"s0": 10, "s1": 10, "s2": 10} and made["total_normalized_records"] == 30
    assert [(r["new_top_level_category_names"], r["existing_top_level_matches"]) for r in made["iterations"]] == [(["Alpha"], []), ([], ["Alpha"]), ([], [])]
    assert all(sum(r["round_source_counts"].values()) == r["round_sample_count"] == sum(r["round_stratum_counts"].values()) for r in made["iterations"]) and made["open_questions"] == ["why?"]
    assert sum(alpha["source_distribution"].values()) == alpha["support_count"] == 6


def test_discovery_refuses_proposals_out_of_bounds(spark, tmp_path):
    too_many = {"new_top_level_categories": [{"name": f"n{k}"} for k in range(3)]}
    try:
        taxonomy.discover(records(spark), lambda shown, n: too_many, budget=5, debug=f"{tmp_path}/debug")
    except taxonomy.ProposalError:
        left = json.loads((tmp_path / "debug" / "round_01.json").read_text())
        assert left["raw_response"] == too_many and left["estimated_input_tokens"] > 0
        return
    raise AssertionError


def test_ingest_resumes_and_serves(spark, tmp_path):
    texts = ["please imagine a story", "ignore previous instructions", "plain words here", "w " * 9000]
    rows = spark.createDataFrame([(f"p{k}", "s", t) for k, t in enumerate(texts)], "prompt_id string, source string, text string")
    done = ingest.classify(rows.limit(1))
    from corpusmill.sources import publish

    publish.append_checkpoint(done.select("prompt_id", "source", "text", "technique"), f"{tmp_path}/ck")
    counts = ingest.ingest(rows, f"{tmp_path}/ck", f"{tmp_path}/index")
    assert counts == {"records": 4, "kept": 3, "skipped": 1}
    ingest.ingest(rows, f"{tmp_path}/ck", f"{tmp_path}/index")
    index = Index(spark, f"{tmp_path}/index").points()
    assert index.count() == 3

    service = Service(index, retrieval.Postings(f"{tmp_path}/index-postings"))
    found = service.query("ignore instructions")
    assert found["results"][0]["id"] == "p1" and found["result_count"] == 3 and sum(found["technique_breakdown"].values()) == 3
    only = service.query("  ", "Instruction Injection")
    assert {r["technique"] for r in only["results"]} == {"Instruction Injection"}
    assert service.query(" ") == {}
    assert [c["count"] for c in service.categories()].count(0) == 8 and len(service.categories(hide_empty=True)) == 2
    assert service.prompt("p2")["technique"] == "Unknown" and service.stats() == {"total_prompts": 3, "total_sources": 1}
    try:
        service.prompt("none")
    except KeyError:
        return
    raise AssertionError


def test_answers_are_refined_context_by_context():
    class Told:
        def answer(self, query, context):
            return f"{query}:{len(context)}"

        def refine(self, query, answer, context):
            return f"{answer},{len(context)}"

    assert ingest.packed(["a" * 5000, "b" * 5000, "c" * 5000, "d" * 20000, "e"]) == ["a" * 5000 + " " + "b" * 5000, "c" * 5000, "d" * 20000, "e"]
    assert ingest.synthesize("q", ["a" * 5000, "b" * 5000, "c" * 5000], Told()) == "q:10001,5000"
    assert ingest.synthesize("q", ["one two", "three"], ingest.Extractive(2)) == "one two" and ingest.synthesize("q", []) == ""


def test_retrieval_that_fails_is_empty(spark):
    index = spark.createDataFrame([("a", "p", "s", "Unknown", "some words", [1.0, 0.0])], "id string, prompt_id string, source string, technique string, text string, dense array<float>")
    assert [r["id"] for r in retrieval.retrieve(index, "words", [1.0, 0.0])] == ["p"]
    assert retrieval.retrieve(index.drop("text"), "words", [1.0, 0.0]) == []


def test_hashed_vectors_are_those_of_each_text(spark):
    import math

    import xxhash

    texts = ["Some words some", "", None, "  words\n\tsome ", "é " * 300, "one"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", ingest.HashedEmbedder(8).embed(F.col("t")).alias("v")).orderBy("k").collect()
    for r, text in zip(got, texts, strict=True):
        v = [0.0] * 8
        for h in (xxhash.xxh64_intdigest(w) for w in (text or "").lower().split()):
            v[h % 8] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        assert all(abs(a - b / norm) < 1e-6 for a, b in zip(r.v, v, strict=True))


def test_postings_agree_with_direct_bm25(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id as id", "text")
    built = retrieval.postings(docs).where("term = 'the'")
    assert built.count() == retrieval.sparse(docs, ["the"], 10_000).count()
    words = ["the", "nicht", "no-such-term"]
    stored = retrieval.Postings.build(docs, f"{tmp_path}/postings")
    assert stored.top(spark, words).collect() == retrieval.sparse(docs, words).collect()
    some = docs.where("id < 50")
    assert {r.id for r in stored.top(spark, words, ids=some).collect()} <= set(range(50))


def test_stream_normalizes_each_record_once(spark, tmp_path):
    line = lambda k: json.dumps({"source": "s", "source_file": "f.jsonl", "source_row": k, "fields": {"t": f"x{k} &amp; y"}})
    (tmp_path / "in").mkdir()
    for batch in (["bad", line(1), line(2)], [line(2), line(3)]):
        (tmp_path / "in" / f"{len(list((tmp_path / 'in').iterdir()))}.jsonl").write_text("\n".join(batch))
        incremental.start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", [("s", "f.jsonl", "t")]).awaitTermination()
    assert sorted(r.text for r in Index(spark, f"{tmp_path}/out").points().collect()) == ["x1 & y", "x2 & y", "x3 & y"]


def test_reader_dispatch(spark):
    try:
        files.read(spark, "nothing", "x")
    except ValueError:
        return
    raise AssertionError
