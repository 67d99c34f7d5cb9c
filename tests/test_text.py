import hashlib
import html
import json
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.functions import arrow
from corpusmill.functions import text as T

ALPHABET = ["a", "b", "Z", " ", "  ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x00", "\x7f", "\xa0", "\x85", " ", "　", "é", "😀", "&amp;", "&lt;", "&#39;", "&", ";", "\\n", "."]


def strings(n=1500, seed=3):
    chance = random.Random(seed)
    return ["".join(chance.choices(ALPHABET, k=chance.randrange(0, 60))) for _ in range(n)]


def normalize(x):
    x = html.unescape(x).replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ")
    x = re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "", x)
    x = re.sub(r"[ \t\f\v]+(?=\n|$)", "", x)
    x = re.sub(r"(?<=\S)[ \t\f\v]{2,}(?=\S)", " ", x)
    return re.sub(r"\n{3,}", "\n\n", x).strip()


def excerpt(x, n=180):
    x = " ".join(x.split())
    return x if len(x) <= n else x[: n - 3].rstrip() + "..."


def word_excerpt(x, n=500):
    cut = x[:n]
    return cut[: cut.rfind(" ")] if len(x) > n and cut.rfind(" ") > 0 else cut


def test_functions_equal_plain_python(spark):
    texts = strings() + ["x" * 119, "x" * 120, "x" * 320, "x" * 700, " " + "w" * 600, "a b " * 200, "é" * 181]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n long, t string")
    t = F.col("t")
    rows = df.select("n", T.normalize(t), T.strip(t), T.collapse(t), T.excerpt(t), T.word_excerpt(t), T.suspicious(t), T.length_bucket(t), T.category_key(t), T.stable_hash(t)).collect()
    for r in rows:
        x = texts[r[0]]
        n = len(x)
        bucket = "short" if n < 120 else "medium" if n < 320 else "long" if n < 700 else "very_long"
        odd = sum(ord(c) == 127 or (ord(c) < 32 and c not in "\n\r\t") for c in x)
        assert list(r[1:]) == [normalize(x), x.strip(), " ".join(x.split()), excerpt(x), word_excerpt(x), odd, bucket, " ".join(x.lower().split()), hashlib.sha256(x.encode()).hexdigest()]


def test_normalizer_is_idempotent_without_entities(spark):
    df = spark.createDataFrame([(x.replace("&", ""),) for x in strings(seed=5)], "t string").select(T.clean(F.col("t")).alias("t"))
    assert df.where(T.clean(F.col("t")) != F.col("t")).count() == 0


def test_canonical_json_and_prompt_id(spark):
    raw = ['{"b":1.0,"a":"é\\u001f"}', '{"a":1,"a":2}', '{"x": -0.0, "y": [1, {"k": null}]}']
    df = spark.createDataFrame([("s\"q", "f.jsonl", n, r) for n, r in enumerate(raw)], "s string, f string, n long, r string")
    rows = df.select("n", arrow.canonical_json("r").alias("c"), T.prompt_id(F.col("s"), F.col("f"), F.col("n"), F.col("r")).alias("id")).collect()
    dump = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    for r in rows:
        fields = json.loads(raw[r.n])
        assert r.c == dump(fields)
        whole = dump({"source": 's"q', "source_file": "f.jsonl", "source_row": r.n, "raw_fields": fields})
        assert r.id == 's"q_' + hashlib.sha256(whole.encode()).hexdigest()[:20]


def test_small_functions(spark):
    row = spark.range(1).select(
        T.cleaned_traits(F.array(F.lit(" a "), F.lit(""), F.lit("b"), F.lit("a"), F.lit(None).cast("string"))),
        T.merged(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z")), 2),
        T.truncate(F.lit("x" * 161)),
        T.provenance(F.lit("s"), F.lit("f"), F.lit(3), F.lit("p"), F.lit(9)),
        T.provenance(F.lit(None).cast("string"), F.lit("f"), F.lit(3), F.lit("p"), F.lit(9)),
        T.effective_query(F.lit(" \t"), F.lit("c")),
        T.legacy_id(F.lit("s"), F.lit("t")),
    ).first()
    assert list(row) == [["a", "b"], ["x", "y"], "x" * 160 + "...", "s/f:3", "p:9", "c", "s__" + hashlib.md5(b"t").hexdigest()[:8]]


def test_lines_are_given_on_in_parts(monkeypatch):
    """Of bounded rows and bytes, and all of them in order; the whole batch was held before."""
    monkeypatch.setattr(arrow, "LINE_BYTES", 100)
    lines = [json.dumps({"fields": {"text": "é" * (n % 70)}}) for n in range(3000)] + ["", None, "x" * 500]
    parts = list(arrow.canonical_entries.func(iter([pa.array(lines, pa.string()).slice(1), pa.array([], pa.string())])))
    assert all(len(p) == 1 or sum(len((x or "").encode()) for x in q.to_pylist()) <= 100 for p, q in zip(parts, arrow.few(pa.array(lines[1:], pa.string()))))
    assert len(parts) > 1000 and [r for p in parts for r in p.to_pylist()] == [{f.name: arrow._line(x, True).get(f.name) for f in arrow.LINE} for x in lines[1:]]
