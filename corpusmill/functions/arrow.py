"""Arrow functions for what Spark has no expression for: HTML entities and Python's JSON."""

from __future__ import annotations

import html
import json
import re
from html.entities import html5
from itertools import chain
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def _each(function, kind=None):
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else function(x) for x in column.to_pylist()], kind or pa.string())

    return run


#: Entities that end in a semicolon.
CLOSED = re.compile("&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)")


def _closed(text: str) -> str:
    return CLOSED.sub(lambda m: html.unescape(m[0]) if m[1][0] == "#" or m[1] in html5 else m[0], text)


def _canonical(text: str) -> str | None:
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except ValueError:
        return None


def _status(line: str) -> str | None:
    """Why a canonical line is rejected, or null."""
    if not line.strip():
        return "blank"
    try:
        record = json.loads(line)
    except ValueError:
        return "malformed"
    if not isinstance(record, dict):
        return "not_object"
    return None if isinstance(record.get("fields"), dict) else "fields_not_object"


def _is_json(line: str) -> bool:
    try:
        json.loads(line)
    except ValueError:
        return False
    return True


#: What canonical_line() gives of a line: why it is rejected (a code, and the message of an audit), or its keys, each null
#: if it is missing or of another type, its own name of its place, its fields as canonical JSON, their names, and whether
#: all their values are empty. entries are its fields with their Python types, and the texts of strings.
ENTRY = T.StructType().add("field", T.StringType()).add("type", T.StringType()).add("text", T.StringType())
LINE = T.StructType([T.StructField(c, T.StringType()) for c in ("reason", "error", "source", "source_file", "own", "source_json", "source_file_json", "fields_json")])
LINE = LINE.add("source_row", T.LongType()).add("empty", T.BooleanType()).add("names", T.ArrayType(T.StringType())).add("entries", T.ArrayType(ENTRY))
#: Lines that are parsed, and given on, at a time, and their bytes (or one line): what a task's Python holds beside a batch.
LINES, LINE_BYTES = 1024, 1 << 20
DUMP = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode


def _rejected(line: str) -> tuple[str, str] | dict:
    """The code and message of a line that is no canonical record, or the record."""
    if not line.strip():
        return "blank", "Blank line"
    try:
        record = json.loads(line)
    except ValueError as error:
        return "malformed", getattr(error, "msg", str(error))
    if not isinstance(record, dict):
        return "not_object", "Canonical record is not a JSON object"
    return record if isinstance(record.get("fields"), dict) else ("fields_not_object", "Canonical record fields payload is not a JSON object")


def _line(line: str | None, entries: bool) -> dict:
    record = _rejected(line or "")
    if isinstance(record, tuple):
        return {"reason": record[0], "error": record[1]}
    source, name, row, fields = (record.get(c) for c in ("source", "source_file", "source_row", "fields"))
    void = lambda v: v is None or (isinstance(v, str) and not v.strip()) or (isinstance(v, (list, dict)) and not v)
    return {
        "source": source if isinstance(source, str) else None, "source_file": name if isinstance(name, str) else None,
        # As in Python, true and false are whole numbers.
        "source_row": int(row) if isinstance(row, int) and abs(row) < 1 << 63 else None, "own": f"{source}/{name}:{row}" if source and name and isinstance(row, int) else None,
        "source_json": DUMP(source), "source_file_json": DUMP(name), "fields_json": DUMP(fields), "names": sorted(fields), "empty": all(map(void, fields.values())),
        "entries": [{"field": k, "type": type(v).__name__, "text": v if isinstance(v, str) else None} for k, v in fields.items()] if entries else None,
    }


def _sound(x):
    """Half surrogates, which JSON may escape and UTF-8 can't hold, as question marks."""
    if isinstance(x, str):
        return x.encode("utf-8", "replace").decode()
    if isinstance(x, list):
        return [_sound(y) for y in x]
    return {k: _sound(v) for k, v in x.items()} if isinstance(x, dict) else x


def few(column: pa.Array) -> Iterator[pa.Array]:
    """A column of strings in parts of at most LINES rows and LINE_BYTES, or of one row."""
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))])
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(at, at[begin] + LINE_BYTES, "right")) - 1
        end = max(begin + 1, min(end, begin + LINES))
        yield column.slice(begin, end - begin)
        begin = end


def _lines(entries: bool):
    kind = to_arrow_type(LINE)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in chain.from_iterable(map(few, columns)):
            found = [_line(x, entries) for x in part.to_pylist()]
            try:
                yield pa.array(found, kind)
            except UnicodeEncodeError:
                yield pa.array(_sound(found), kind)

    return F.arrow_udf(run, LINE)


def _serialized(source: pa.Array, name: pa.Array, row: pa.Array, fields: pa.Array) -> pa.Array:
    each = zip(*(c.to_pylist() for c in (source, name, row, fields)))
    return pa.array([json.dumps({"source": s, "source_file": n, "source_row": r, "fields": json.loads(f)}, ensure_ascii=False, sort_keys=True) for s, n, r, f in each], pa.string())


#: A canonical line in one parse, without and with its entries; and the line of a record (source, file, row, fields).
canonical_line, canonical_entries = _lines(False), _lines(True)
record_line = F.arrow_udf(_serialized, T.StringType())
html_unescape = F.arrow_udf(_each(html.unescape), T.StringType())
#: The same of entities that end in a semicolon; html.unescape takes some names without one too.
closed_unescape = F.arrow_udf(_each(_closed), T.StringType())
#: Sorted keys, compact, non-ASCII kept; null if the text isn't JSON.
canonical_json = F.arrow_udf(_each(_canonical), T.StringType())
canonical_status = F.arrow_udf(_each(_status), T.StringType())
is_json = F.arrow_udf(_each(_is_json, pa.bool_()), T.BooleanType())
