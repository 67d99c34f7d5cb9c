"""From raw files to normalized records and a report, each step on what the one before has written; and the report against
one that goes through the lines one after the other."""

import collections
import hashlib
import html
import json
import logging
import re

import numpy as np

from corpusmill.operators import audit, normalize
from corpusmill.sources import files, publish, registry


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, newline="")


def raw_files(root):
    chance = np.random.default_rng(3)
    text = lambda: " ".join(chance.choice(["the", "water", "&amp;", "é", "time\\n", "\t"], chance.integers(1, 30)))
    values = [text, lambda: None, lambda: int(chance.integers(9)), lambda: [], lambda: {"z": 1, "a": [True]}, lambda: "same text again and again", lambda: 1.5, lambda: "  "]
    for source in ("one", "two"):
        for n in range(2):
            rows = [{f: values[int(chance.integers(len(values)))]() for f in ("prompt", "b", "c")[: chance.integers(0, 4)]} for _ in range(60)]
            put(root, f"raw/{source}/f {n}.jsonl", "\n".join(json.dumps(r) if k % 9 else "" for k, r in enumerate(rows)) + "\n[1]\n")
    put(root, "raw/two/g.csv", "﻿prompt,n\r\nFind it,1\r\n\r\n" + '"two\r\nlines",2\r\nFind it,3\r\n' * 40)
    put(root, "raw/two/none.jsonl", "")
    put(root, "raw/two/metadata.json", "{}")


class Scope:
    """Counters of one scope, as lines come."""

    def __init__(self):
        self.total = self.empty = 0
        self.bad, self.shapes, self.fields = [], collections.Counter(), {}
        self.raw, self.texts = {}, {}

    def see(self, fields, where):
        self.total += 1
        self.empty += all(v is None or (isinstance(v, str) and not v.strip()) or (isinstance(v, (list, dict)) and not v) for v in fields.values())
        self.shapes[tuple(sorted(fields))] += 1
        text = json.dumps(fields, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        self.raw.setdefault(text, [0, where])[0] += 1
        for f, v in fields.items():
            self.fields.setdefault(f, []).append(v)
            if isinstance(v, str) and v.strip():
                self.texts.setdefault(f, {}).setdefault(v, [0, where])[0] += 1

    @staticmethod
    def repeats(seen):
        groups = [(n, where, t if len(t) <= 160 else t[:160] + "...") for t, (n, where) in seen.items() if n > 1]
        return {"duplicate_groups": len(groups), "duplicate_occurrences": sum(g[0] - 1 for g in groups), "samples": [dict(zip(("count", "first_seen_at", "sample"), g)) for g in sorted(groups[:10], key=lambda g: g[:2], reverse=True)]}

    def report(self):
        fields, likely = {}, []
        for f, values in sorted(self.fields.items()):
            texts = [v for v in values if isinstance(v, str)]
            odd = [sum(ord(c) == 127 or (ord(c) < 32 and c not in "\n\r\t") for c in t) for t in texts]
            full, sizes = sum(bool(t.strip()) for t in texts), [len(t) for t in texts]
            fields[f] = {
                "present_count": len(values), "missing_count": self.total - len(values), "null_count": sum(v is None for v in values), "string_count": len(texts),
                "non_string_count": sum(v is not None and not isinstance(v, str) for v in values), "non_empty_string_count": full, "non_empty_string_ratio": round(full / self.total, 4),
                "average_string_length": round(sum(sizes) / len(texts), 2) if texts else 0.0, "min_string_length": min(sizes, default=None), "max_string_length": max(sizes, default=None), "total_string_length": sum(sizes),
                "short_text_count": sum(0 < len(t.strip()) <= 20 for t in texts), "long_text_count": sum(n >= 2000 for n in sizes), "html_entity_count": sum(html.unescape(t) != t for t in texts),
                "escaped_newline_count": sum(bool(re.search(r"\\n|\\r", t)) for t in texts), "suspicious_control_character_count": sum(n > 0 for n in odd), "suspicious_control_character_instances": sum(odd),
                "value_type_counts": dict(sorted(collections.Counter(type(v).__name__ for v in values).items())),
            }
            average = sum(sizes) / (len(texts) or 1)
            if full and full / self.total >= 0.05 and average >= 20:
                likely.append({"field_name": f, "coverage_ratio": round(full / self.total, 4), "non_empty_string_count": full, "average_string_length": round(average, 2), "candidate_score": round(full / self.total * 0.65 + min(average / 500, 1) * 0.35, 4)})
        likely.sort(key=lambda c: (c["candidate_score"], c["average_string_length"], c["non_empty_string_count"], c["field_name"]), reverse=True)
        by_field = {c["field_name"]: r for c in likely if (r := self.repeats(self.texts[c["field_name"]]))["duplicate_groups"]}
        shapes = [{"fields": list(k), "count": n} for k, n in self.shapes.most_common(10)]
        return {
            "total_records": self.total, "empty_records": self.empty, "non_object_records": 0, "malformed_jsonl_lines": len(self.bad), "malformed_line_samples": self.bad[:10], "likely_prompt_bearing_fields": likely,
            "duplicate_raw_records": self.repeats(self.raw), "duplicate_likely_prompt_text": {k: sum(r[k] for r in by_field.values()) for k in ("duplicate_groups", "duplicate_occurrences")} | {"by_field": by_field},
            "schema_variation": {"variant_count": len(self.shapes), "dominant_fields": shapes[0]["fields"] if shapes else [], "dominant_count": shapes[0]["count"] if shapes else 0, "variants": shapes}, "fields": fields,
        }


def plain_report(root):
    corpus, sources, each = Scope(), {}, {}
    paths = sorted(root.glob("*/*.jsonl"))
    for path in paths:
        source, key = path.parent.name, f"{path.parent.name}/{path.name}"
        scopes = [corpus, sources.setdefault(source, Scope()), each.setdefault(key, Scope())]
        for n, line in enumerate(path.read_text().split("\n")[:-1] if path.stat().st_size else [], 1):
            record = json.loads(line) if line.strip() and not line.startswith("{bad") else None
            error = "Blank line" if not line.strip() else "Expecting property name enclosed in double quotes" if record is None else "Canonical record is not a JSON object" if not isinstance(record, dict) else None
            for s in scopes:
                if error:
                    s.bad.append({"file": key, "line_number": n, "error": error, "line_excerpt": line.strip()})
                else:
                    s.see(record["fields"], f"{record['source']}/{record['source_file']}:{record['source_row']}")
    return corpus.report(), {s: x.report() | {"file_count": sum(p.parent.name == s for p in paths)} for s, x in sources.items()}, {k: x.report() | {"source_name": k.split("/")[0]} for k, x in each.items()}


def test_raw_files_become_a_corpus_its_report_and_its_records(spark, tmp_path, caplog):
    raw_files(tmp_path)
    listed = files.paths(spark, f"{tmp_path}/raw")
    converted = files.convert(spark, f"{tmp_path}/raw")
    totals = {(r.source, r.source_file): (r.record_count, r.file_count) for r in files.conversion_totals(converted, listed).collect()}
    assert totals[("two", "none.jsonl")] == (0, 1) and totals[("two", "g.csv")] == (81, 1) and totals[(None, None)][1] == 6
    publish.canonical(converted, f"{tmp_path}/canonical", listed)
    root = tmp_path / "canonical"
    assert sorted(p.relative_to(root).as_posix() for p in root.rglob("*") if p.is_file() and not p.name.startswith((".", "_"))) == ["one/f 0.jsonl", "one/f 1.jsonl", "two/f 0.jsonl", "two/f 1.jsonl", "two/g.jsonl", "two/none.jsonl"]
    for path in root.rglob("*.jsonl"):
        lines = [json.loads(x) for x in path.read_text().splitlines()]
        assert [x["source_row"] for x in lines] == sorted(x["source_row"] for x in lines) and path.read_text() == "".join(json.dumps(x, ensure_ascii=False, sort_keys=True) + "\n" for x in lines)
    put(root, "one/bad.jsonl", "\n{bad\n[]\n")

    report = audit.run(spark, f"{root}/*/*.jsonl")
    corpus, sources, each = plain_report(root)
    own = report["corpus_summary"]
    assert {k: own.pop(k) for k in ("total_sources", "total_files", "per_source_record_counts")} == {"total_sources": 2, "total_files": 7, "per_source_record_counts": {s: r["total_records"] for s, r in sources.items()}}
    assert own == corpus and report["source_summaries"] == sources and report["file_summaries"] == each

    mapping = registry.field_mapping(spark, [(s, f"f {n}.jsonl", "prompt") for s in ("one", "two") for n in range(2)] + [("two", "g.csv", "n")])
    with caplog.at_level(logging.WARNING):
        counts = {r.key: r.asDict() for r in normalize.run(spark, f"{root}/*/*.jsonl", f"{tmp_path}/normalized", mapping, report).collect()}
    assert [m.getMessage() for m in caplog.records if "not likely" in m.getMessage()] == ["two/g.jsonl: field not likely (n)"]
    assert counts[None]["files"] == 7 and counts["two/none.jsonl"]["lines"] == 0 and counts["one/bad.jsonl"]["kept"] == 0
    assert counts[None]["lines"] == sum(len(p.read_text().splitlines()) for p in root.rglob("*.jsonl"))
    kept = files.normalized(spark, f"{tmp_path}/normalized/*.json").collect()
    assert len(kept) == counts[None]["kept"] and {r.text for r in kept if r.source_file == "g.csv"} == {"1", "2", "3"}
    one = next(r for r in kept if r.source_file == "g.csv")
    canon = json.dumps({"raw_fields": {"prompt": "Find it", "n": "1"}, "source": "two", "source_file": "g.csv", "source_row": 2}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    assert "two_" + hashlib.sha256(canon.encode()).hexdigest()[:20] in {r.prompt_id for r in kept} and one.source == "two"


def test_a_hot_file_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Its ordered parts are put together under its name."""
    seen = []
    own = publish.concatenated
    monkeypatch.setattr(publish, "concatenated", lambda session, found: seen.extend(len(parts) for _, parts in found) or own(session, found))
    rows = spark.range(0, 20000, 1, 8).selectExpr("'s' source", "'hot.jsonl' source_file", "20000 - id source_row", """concat('{"a":"', repeat('x', 400), '"}') fields_json""")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        publish.canonical(rows, f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    got = [json.loads(x)["source_row"] for x in (tmp_path / "out/s/hot.jsonl").read_text().splitlines()]
    assert got == list(range(1, 20001)) and seen == [4]


def test_the_audit_parses_a_line_once_and_reads_the_corpus_twice(spark, tmp_path):
    put(tmp_path, "c/s/f.jsonl", '{"fields":{"t":"x"}}\n' * 5)
    plan = audit.facts(files.lines(spark, f"{tmp_path}/c/*/*.jsonl"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Scan text") == 1
