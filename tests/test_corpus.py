import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import audit, fetch, ingest, normalize
from corpusmill.sources import files, publish, registry


def put(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data.encode() if isinstance(data, str) else data)
    return str(path)


def test_jsonl_numbers_physical_lines(spark, tmp_path):
    put(tmp_path, "src/a.jsonl", '{"a":1}\n\n{"b":"é"}\r\n[1]\n')
    rows = {r.source_row: r.fields_json for r in files.jsonl(spark, f"{tmp_path}/*/*.jsonl").collect()}
    assert rows == {1: '{"a":1}', 3: '{"b":"é"}', 4: '{"_value":[1]}'}


def test_jsonl_malformed_line_names_file_and_line(spark, tmp_path):
    put(tmp_path, "src/bad.jsonl", '{"a":1}\n{"a":1} x\n')
    with pytest.raises(Exception, match=r"bad\.jsonl line 2"):
        files.jsonl(spark, f"{tmp_path}/*/*.jsonl").collect()


def test_csv_rows_have_the_line_of_their_end(spark, tmp_path):
    text = '﻿a,b\r\n1,2\r\n\r\n"x\r\ny",3\r\n4\r\n'
    put(tmp_path, "src/t.csv", text.encode())
    rows = [(r.source_row, json.loads(r.fields_json)) for r in files.csv_files(spark, f"{tmp_path}/*/*.csv").collect()]
    assert rows == [(2, {"a": "1", "b": "2"}), (5, {"a": "x\r\ny", "b": "3"}), (6, {"a": "4", "b": None})]
    reader = csv.DictReader(io.StringIO(text.removeprefix("﻿"), newline=""))
    assert rows == [(reader.line_num, r) for r in reader]


def test_csv_with_too_many_cells_is_an_error(spark, tmp_path):
    put(tmp_path, "src/t.csv", "a,b\n5,6,7\n")
    with pytest.raises(Exception, match="line 2: more cells"):
        files.csv_files(spark, f"{tmp_path}/*/*.csv").collect()


def test_csv_row_count_counts_blank_lines(spark, tmp_path):
    put(tmp_path, "src/t.csv", "a,b\n1,2\n\n3,4\n")
    put(tmp_path, "src/u.csv", b"a\n\xff\n")
    rows = {r.source_file: r.record_count for r in files.csv_row_count(spark, f"{tmp_path}/*/*.csv").collect()}
    assert rows == {"t.csv": 3, "u.csv": None}


def corpus(tmp_path):
    put(tmp_path, "raw/one/a.jsonl", "\n".join(json.dumps(x) for x in [{"prompt": " Hello&amp;  world \r\n"}, {"prompt": 5}, {"prompt": "  "}, {"prompt": "Hello&amp;  world \r\n"}, {"other": "x"}]))
    put(tmp_path, "raw/two/b.csv", "goal,n\nFind it,1\nFind it,2\n")
    return f"{tmp_path}/raw", [("one", "a.jsonl", "prompt"), ("two", "b.jsonl", "goal")]


def test_convert_publish_audit_and_normalize(spark, tmp_path):
    raw, mapping = corpus(tmp_path)
    converted = files.convert(spark, raw)
    assert converted.count() == 7
    publish.canonical(converted, f"{tmp_path}/canonical")
    lines = {p.relative_to(tmp_path / "canonical").as_posix(): [json.loads(x) for x in p.read_text().splitlines()] for p in (tmp_path / "canonical").rglob("*.jsonl")}
    assert {k: [(x["source"], x["source_file"], x["source_row"]) for x in v] for k, v in lines.items()} == {"one/a.jsonl": [("one", "a.jsonl", k) for k in (1, 2, 3, 4, 5)], "two/b.jsonl": [("two", "b.csv", k) for k in (2, 3)]}
    converted = converted.withColumn("source_file", files.canonical_name(F.col("source_file")))

    records = converted.select("source", "source_file", "source_row", "fields_json", F.try_parse_json("fields_json").alias("fields"), F.lit(None).cast("string").alias("reason"))
    assert normalize.unmapped(records, registry.field_mapping(spark, mapping[:1])).collect()[0]["source"] == "two"
    classified = normalize.classify(records, registry.field_mapping(spark, mapping))
    counts = {r.source_file: r for r in normalize.accounting(classified).collect()}
    assert (counts["a.jsonl"].kept, counts["a.jsonl"].skipped_non_string, counts["a.jsonl"].skipped_empty_text) == (2, 2, 1)
    assert (counts[None].lines, counts[None].kept) == (7, 4)
    kept = normalize.normalized(classified).collect()
    assert sorted(r.text for r in kept) == ["Find it", "Find it", "Hello& world", "Hello& world"]
    assert len({r.prompt_id for r in kept}) == 4

    rows = audit.field_rows(records.select(F.col("source_row").alias("ord"), "source", "source_file", F.lit("x").alias("location"), "fields"))
    types = {(r.field, r.type): r.n for r in audit.type_histogram(rows, ["source"]).where("source = 'one'").collect()}
    assert types == {("prompt", "str"): 3, ("prompt", "int"): 1, ("other", "str"): 1}
    whole = audit.scoped_profile(rows).where("scope = 0 and field = 'prompt'").first()
    assert (whole.present_count, whole.string_count, whole.non_empty_string_count, whole.html_entity_count) == (4, 3, 2, 2)


def test_unmapped_file_stops_normalizing(spark):
    records = spark.createDataFrame([("s", "f", 1, '{"a":"x"}')], "source string, source_file string, source_row long, fields_json string")
    records = records.select("*", F.try_parse_json("fields_json").alias("fields"), F.lit(None).cast("string").alias("reason"))
    with pytest.raises(Exception, match="no field mapped for s/f"):
        normalize.classify(records, registry.field_mapping(spark, [])).collect()


def test_canonical_lines_are_rejected_by_reason(spark, tmp_path):
    put(tmp_path, "c/s/f.jsonl", '{"source":"s","source_file":"f","source_row":1,"fields":{"a":"x"}}\n\n{bad\n[]\n{"fields":1}\n')
    rows = {r.line: r.reason for r in files.canonical(spark, f"{tmp_path}/c/*/*.jsonl").collect()}
    assert rows == {1: None, 2: "blank", 3: "malformed", 4: "not_object", 5: "fields_not_object"}
    lines = files.canonical(spark, f"{tmp_path}/c/*/*.jsonl").where("reason is not null").select("source", "source_file", "line", "text", "reason")
    counts, samples = audit.malformed(lines, ["source"])
    assert {r.reason: r.n for r in counts.collect()} == {"blank": 1, "malformed": 1, "not_object": 1, "fields_not_object": 1}
    assert samples.count() == 4


def test_failed_write_leaves_what_was_there(spark, tmp_path):
    path = f"{tmp_path}/out"
    publish.table(spark.range(3), path)

    def fail(to):
        spark.range(5).write.parquet(to)
        raise RuntimeError

    with pytest.raises(RuntimeError):
        publish.replace(spark, path, fail)
    assert spark.read.parquet(path).count() == 3 and not publish.exists(spark, path + ".staging")
    publish.report(spark, f"{tmp_path}/report.json", {"a": [1, "é"]})
    assert json.loads((tmp_path / "report.json").read_text()) == {"a": [1, "é"]}
    assert files.optional_report(spark, f"{tmp_path}/none.json") is None
    assert files.optional_report(spark, f"{tmp_path}/report.json").count() == 1


def test_legacy_loads_skip_what_fails_and_keep_first(spark, tmp_path):
    a, b = put(tmp_path, "a.jsonl", '{"t":"x"}\n{"t":"y"}\n'), put(tmp_path, "b.jsonl", '{"t":"x"}\n')
    rows = files.legacy(spark, [("one", a, "t"), ("gone", f"{tmp_path}/gone.jsonl", "t"), ("two", b, "t")])
    assert rows.count() == 3
    assert {(r.text, r.source) for r in normalize.first_of_each_text(rows).collect()} == {("x", "one"), ("y", "one")}


def test_fetch_replaces_only_if_required_sources_succeed(spark, tmp_path):
    landing, raw = tmp_path / "landing", tmp_path / "raw"
    for s in registry.SOURCES[1:]:
        for x in s.snapshots:
            if x.options:
                put(landing, f"{s.source_name}/{x.output_name.replace('.jsonl', '.tsv')}", 'vanilla\tadversarial\nNA\t"two\twords"\n\té\n')
            else:
                put(landing, f"{s.source_name}/{x.output_name}", "a,b\n1,2\n\n3,4\n" if x.format_label == "csv" else '{"n":1}\n{"n":2}\n')
    first = ingest.run_summary(fetch.fetch_all(spark, str(landing), str(raw))).first()
    assert (first.failed_count, first.all_required_succeeded, raw.exists()) == (1, False, False)
    beside = json.loads((tmp_path / "raw-fetch_run_summary.json").read_text())
    assert beside["required_failure_count"] == 1 and beside["source_results"][0]["error_type"] == "FileNotFoundError"
    for x in registry.SOURCES[0].snapshots:
        put(landing, f"{registry.SOURCES[0].source_name}/{x.output_name}", '{"prompt":"x"}')
    assert ingest.run_summary(fetch.fetch_all(spark, str(landing), str(raw))).first().all_required_succeeded
    assert registry.snapshots(spark).count() == 12 and len(list(raw.rglob("*.jsonl"))) == 11 and not (tmp_path / "raw-fetch_run_summary.json").exists()
    assert json.loads((raw / "fetch_run_summary.json").read_text())["failed_source_count"] == 0
    told = {p.parent.name: json.loads(p.read_text()) for p in raw.rglob("fetch_metadata.json")}
    assert len(told) == len(registry.SOURCES) and told["advbench"]["total_record_count"] == 3 and told["trustairlab"]["total_record_count"] == 2
    for name, report in told.items():
        assert report["total_byte_count"] == sum((raw / name / x["output_file"]).stat().st_size for x in report["snapshots"]) and report["snapshot_count"] == len(report["snapshots"])
    assert [json.loads(x) for x in (raw / "wildjailbreak/train.jsonl").read_text().splitlines()] == [{"vanilla": "NA", "adversarial": "two\twords"}, {"vanilla": "", "adversarial": "é"}]
    totals = {r.source_name: (r.snapshot_count, r.total_records) for r in ingest.snapshot_totals(fetch.totals(spark, str(raw))).collect()}
    assert totals["wildjailbreak"] == (2, 4) and totals["advbench"] == (1, 3)


def test_direct_loads_of_a_raw_folder(spark, tmp_path):
    put(tmp_path, "trustairlab/jailbreak_2023_05_07_train.jsonl", '{"prompt":"one"}\n{"prompt":"two"}\n')
    put(tmp_path, "rubend18/train.jsonl", '{"Prompt":"two"}\n{"Prompt":"three"}\n{"other":1}\n')
    put(tmp_path, "jackhhao/train.jsonl", '{"prompt":"four","type":"jailbreak"}\n{"prompt":"five","type":"benign"}\n')
    put(tmp_path, "harmbench/HumanJailbreaks_test.jsonl", '{"Behavior":"six"}\n')
    got = {(r.text, r.source) for r in files.legacy_all(spark, str(tmp_path)).collect()}
    assert got == {("one", "trustairlab"), ("two", "trustairlab"), ("three", "rubend18"), ("four", "jackhhao"), ("six", "harmbench")}


def test_duplicate_samples_are_the_first_ten_then_sorted(spark):
    rows = [(g * 10 + k, "s", f"l{g:02d}", "t", f"h{g}") for g in range(12) for k in range(2 + (g == 3))]
    groups = audit.duplicate_groups(spark.createDataFrame(rows, "ord long, source string, location string, sample string, hash string"), ["source"])
    assert audit.duplicate_summary(groups, ["source"]).first().asDict() == {"source": "s", "duplicate_groups": 12, "duplicate_occurrences": 13}
    got = [r.hash for r in audit.duplicate_samples(groups, ["source"]).collect()]
    assert got == ["h3"] + [f"h{g}" for g in (9, 8, 7, 6, 5, 4, 2, 1, 0)]


def test_mapping_warnings(spark):
    mapping = registry.field_mapping(spark, [("a", "f", "x"), ("b", "f", "x"), ("c", "f", "x"), ("d", "f", "x")])
    seen = spark.createDataFrame([("b", "f", "y"), ("c", "f", "x"), ("d", "f", "x")], "source string, source_file string, field string")
    got = {r.source: r.warning for r in normalize.mapping_warnings(mapping, seen.select("source", "source_file"), seen, seen.where("source = 'd'")).collect()}
    assert got == {"a": "file missing", "b": "field unseen", "c": "field not likely"}


def test_lines_are_numbered_across_splits_as_in_whole_files(spark, tmp_path):
    contents = {"s/a.txt": "".join(f"line {k} {'x' * (k % 37)}" + ("\n", "\r\n")[k % 2] for k in range(400)), "s/b.txt": "\n\nthird\n\nfifth", "t/c.txt": "", "t/d.txt": "é\n" * 300}
    for name, text in contents.items():
        put(tmp_path, name, text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        got = files.lines(spark, f"{tmp_path}/*/*.txt")
        assert got.select("path").count() == sum(len(t.splitlines()) for t in contents.values())
        rows = {(r.source, r.source_file, r.line): r.text for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {(*name.split("/"), n): x for name, text in contents.items() for n, x in enumerate(text.splitlines(), 1)}


LINES = [
    {"source": "s", "source_file": "f", "source_row": 1, "fields": {"t": "A long enough text to be found likely here, by more than twenty characters", "n": 1}},
    {"source": "s", "source_file": "f", "source_row": 2, "fields": {"t": "A long enough text to be found likely here, by more than twenty characters", "n": 1}},
    {"source": 5, "source_file": "f", "source_row": 3, "fields": {"t": "x"}},
    {"source": "s", "source_file": "f", "source_row": 3.5, "fields": {"t": "x"}},
    {"source": "s", "source_file": "f", "fields": {}},
    {"source": "s", "source_file": "f", "source_row": 6, "fields": {"t": " \n "}},
    {"source": "s", "source_file": "f", "source_row": 7, "fields": {"t": 7}},
    [1],
    {"fields": 1},
]


def test_normalize_counts_every_line_once(spark, tmp_path):
    put(tmp_path, "c/s/f.jsonl", "\n".join([*map(json.dumps, LINES), "", "{bad"]))
    put(tmp_path, "c/s/none.jsonl", "")
    got = {r.key: r.asDict() for r in normalize.run(spark, f"{tmp_path}/c/*/*.jsonl", f"{tmp_path}/out", registry.field_mapping(spark, [("s", "f", "t")])).collect()}
    for name, n in (("s/f.jsonl", 1), (None, 2)):
        r = got[name]
        assert (r["lines"], r["kept"], r["files"]) == (11, 2, n) and r["lines"] == r["kept"] + sum(v for k, v in r.items() if k.startswith("skipped_"))
        assert [r[f"skipped_{k}"] for k in normalize.REASONS] == [1, 1, 5, 1, 1]
    assert set(got) == {"s/f.jsonl", "s/none.jsonl", None} and got["s/none.jsonl"]["lines"] == 0
    kept = files.normalized(spark, f"{tmp_path}/out/*.json").collect()
    assert [r.text for r in kept] == [LINES[0]["fields"]["t"]] * 2 and len({r.prompt_id for r in kept}) == 2


@pytest.mark.parametrize("broken", ['{"prompt_id": "p"}', '{"prompt_id": "p", "source": "s", "source_file": "f", "source_row": "1", "text": "t"}', "{bad", '{"prompt_id": "p", "source": "s", "source_file": "f", "source_row": 1, "text": "t", "raw_fields": 3}'])
def test_strict_scan_names_the_line(spark, tmp_path, broken):
    sound = '{"prompt_id": "p", "source": "s", "source_file": "f", "source_row": 1, "text": "t"}'
    put(tmp_path, "n.jsonl", f"{sound}\n\n{sound}\n")
    assert files.normalized(spark, f"{tmp_path}/n.jsonl").count() == 2
    put(tmp_path, "b.jsonl", f"{sound}\n{broken}\n")
    with pytest.raises(Exception, match=r"b\.jsonl line 2"):
        files.normalized(spark, f"{tmp_path}/b.jsonl").collect()


def test_audit_report_equals_one_made_by_hand(spark, tmp_path):
    put(tmp_path, "c/s/f.jsonl", "\n".join([*map(json.dumps, LINES), "", "{bad"]))
    put(tmp_path, "c/u/g.jsonl", json.dumps({"source": "u", "source_file": "g", "source_row": 1, "fields": {"q": None}}))
    report = audit.run(spark, f"{tmp_path}/c/*/*.jsonl")
    whole, one = report["corpus_summary"], report["file_summaries"]["s/f.jsonl"]
    assert (whole["total_sources"], whole["total_files"], whole["per_source_record_counts"]) == (2, 2, {"s": 7, "u": 1})
    assert (whole["total_records"], whole["empty_records"], whole["non_object_records"], whole["malformed_jsonl_lines"]) == (8, 3, 0, 4)
    assert (one["total_records"], one["empty_records"], one["source_name"]) == (7, 2, "s") and report["source_summaries"]["s"]["file_count"] == 1
    assert [(m["file"], m["line_number"], m["error"]) for m in one["malformed_line_samples"]] == [
        ("s/f.jsonl", 8, "Canonical record is not a JSON object"), ("s/f.jsonl", 9, "Canonical record fields payload is not a JSON object"), ("s/f.jsonl", 10, "Blank line"), ("s/f.jsonl", 11, "Expecting property name enclosed in double quotes")]
    raw = one["duplicate_raw_records"]
    assert (raw["duplicate_groups"], raw["duplicate_occurrences"]) == (2, 2) and [(s["count"], s["first_seen_at"], s["sample"]) for s in raw["samples"]] == [
        (2, "s/f:1", json.dumps(LINES[0]["fields"], sort_keys=True, separators=(",", ":"))), (2, "5/f:3", '{"t":"x"}')]
    assert [c["field_name"] for c in one["likely_prompt_bearing_fields"]] == ["t"]
    text = one["duplicate_likely_prompt_text"]
    assert (text["duplicate_groups"], text["duplicate_occurrences"], list(text["by_field"])) == (2, 2, ["t"])
    assert one["schema_variation"]["variant_count"] == 3 and one["schema_variation"]["dominant_fields"] == ["t"] and one["schema_variation"]["dominant_count"] == 4
    assert one["fields"]["t"]["value_type_counts"] == {"int": 1, "str": 5} and one["fields"]["n"]["present_count"] == 2 and one["fields"]["n"]["missing_count"] == 5
    publish.report(spark, f"{tmp_path}/audit.json", report)
    assert json.loads((tmp_path / "audit.json").read_text())["corpus_summary"]["total_records"] == 8


def test_a_failed_rename_restores_what_was_there(spark, tmp_path):
    path = f"{tmp_path}/out"
    publish.table(spark.range(3), path)
    with pytest.raises(Exception):
        publish.replace(spark, path, lambda to: None)
    assert spark.read.parquet(path).count() == 3


def test_legacy_type_filter_and_conversion_totals(spark, tmp_path):
    a = put(tmp_path, "a.jsonl", '{"t":"x","type":"bad"}\n{"t":"y","type":"good"}\n')
    assert [r.text for r in files.legacy(spark, [("one", a, "t", "type", "bad")]).collect()] == ["x"]
    raw, _ = corpus(tmp_path)
    totals = {(r.source, r.source_file): (r.record_count, r.file_count) for r in files.conversion_totals(files.convert(spark, raw)).collect()}
    assert totals == {("one", "a.jsonl"): (5, 1), ("two", "b.csv"): (2, 1), (None, None): (7, 2)}
