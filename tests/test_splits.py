"""Readers that cut files anywhere, against readers of whole files."""

import csv
import io
import json
from contextlib import contextmanager

import numpy as np
import pytest

from corpusmill.sources import csv_splits, files


@contextmanager
def tiny_splits(spark, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", f"{size}b")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def whole(text):
    reader = csv.DictReader(io.StringIO(text.removeprefix("﻿"), newline=""))
    return [(reader.line_num, dict(r)) for r in reader]


def texts():
    chance = np.random.default_rng(8)
    cell = lambda: "".join(chance.choice(list('ab ,"\n\ré'), chance.integers(0, 12)))
    made = {}
    for n, end in enumerate(("\n", "\r\n")):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(["a", 'b "x"\nline', "c,"])
        for _ in range(150):
            writer.writerow([cell(), cell(), cell()][: chance.integers(1, 4)])
        made[f"s/quoted{n}.csv"] = "﻿" * n + out.getvalue()
    made["s/long.csv"] = "h\n" + '"' + "\n".join(f"line {k}" for k in range(400)) + '"\n' + "x\n" * 50 + '"open to the end\nof the file'
    made["s/literal.csv"] = 'a,b\nx"y,1\n"q"z"w,2\n"",3\n"""",4\n"a""",5\n\n\n "no",6\n' * 20
    made["t/old.csv"] = "a,b\r1,2\r\r3,4\r\n5\n\"x\ry\"\r6,7\n"
    made["t/header.csv"] = "only,header"
    made["t/empty.csv"] = ""
    made["t/late.csv"] = '"' + "long header\n" * 60 + '",b\n1,2\n'
    made["t/cr.csv"] = '"a\r\n\r\nb",c\r\n"1\r\n",2\r\n3,"4\r\n"'
    return made


@pytest.mark.parametrize("size", [53, 1 << 20])
def test_csv_in_splits_equals_whole_files(spark, tmp_path, size):
    made = texts()
    for name, text in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    with tiny_splits(spark, size):
        got = {}
        for r in files.csv_files(spark, f"{tmp_path}/*/*.csv").collect():
            got.setdefault(f"{r.source}/{r.source_file}", []).append((r.source_row, json.loads(r.fields_json)))
    for name, text in made.items():
        assert sorted(got.get(name, []), key=str) == sorted(whole(text), key=str), name


def test_states_after_lines_are_those_of_the_library():
    chance = np.random.default_rng(1)
    for _ in range(3000):
        line = "".join(chance.choice(list('ab,"'), chance.integers(0, 9)))
        for inside in (False, True):
            text = ('"' if inside else "") + line
            assert csv_splits.inside_after(line, inside) == (len(list(csv.reader(io.StringIO(text + "\nz\n", newline="")))) == 1), (line, inside)


def test_a_field_beyond_the_limit_fails(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.csv").write_text('a\n"' + "x\n" * 200_000)
    with tiny_splits(spark, 30_000), pytest.raises(Exception, match="field larger than field limit"):
        files.csv_files(spark, f"{tmp_path}/*/*.csv").collect()


def test_no_text_is_exchanged_for_line_numbers(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.jsonl").write_text('{"a":1}\n' * 50)
    (tmp_path / "s/b.csv").write_text("a\n1\n")
    for df in (files.lines(spark, f"{tmp_path}/s/*.jsonl"), files.jsonl(spark, f"{tmp_path}/s/*.jsonl")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
