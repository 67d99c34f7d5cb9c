"""CSV files in splits.

A line ends a record unless it ends inside quotes, so what a split does to a reader is a function of two states: outside
and inside. A first pass takes each split's function, by running its lines from both states; composed along the file, they
tell in which state every split begins. A second pass then parses the records of each split where they stand. Only what
a record leaves on both sides of a split's edge is exchanged and put together. Records are those of Python's reader (of a
quote that is open at a file's end, a last line break is not kept).
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: From inside quotes to the quote that closes them; and the rest of a field.
CLOSE, REST = re.compile(r'[^"]*(?:""[^"]*)*"(?!")').match, re.compile(r"[^,\r]*").match
RECORD = "path string, source_row long, cells array<string>, first boolean, open long, block long, text string"
#: Headers of files that every task may hold.
MOST_HEADERS = 100_000


def inside_after(line: str, inside: bool) -> bool:
    """Whether a reader is inside quotes after a line, which it begins inside or outside."""
    at, end = 0, len(line)
    if inside:
        if not (found := CLOSE(line)):
            return True
        at = REST(line, found.end()).end() + 1
    while at < end:
        if line[at] == '"':
            if not (found := CLOSE(line, at + 1)):
                return True
            at = found.end()
        at = REST(line, at).end() + 1
    return False


def runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of one split each."""
    number = batch["split"].to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def physical(lines: list[str]) -> int:
    """Lines as a reader counts them: a carriage return alone ends one, too."""
    return len(lines) + sum(x.count("\r", 0, len(x) - 1) for x in lines if "\r" in x)


def rows_of(text: str, line: int, header: bool) -> Iterator[tuple[int, list[str]]]:
    """Records of a text that begins after so many lines, with the number of the line that ends each. Blank lines give
    none, unless they stand for the header."""
    reader = csv.reader(io.StringIO(text, newline=""))
    for k, cells in enumerate(reader):
        if cells or (header and k == 0):
            yield line + reader.line_num, cells


def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (split, block, text) to a row for each split: the states after it from outside and inside, whether from
    inside it comes outside at all, its physical lines, and the first record if that is a file's and ends here."""
    now, state, closes, count, begun, header = None, [False, True], False, 0, [], None
    names = ["split", "from_out", "from_in", "closes", "lines", "header"]

    def done() -> pa.RecordBatch:
        row = [now, *state, closes, count, header]
        kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds)], names)

    for batch in batches:
        for run in runs(batch):
            split, first = run["split"][0].as_py(), run["block"][0].as_py() == 0
            if split != now:
                if now is not None:
                    yield done()
                now, state, closes, count, begun, header = split, [False, True], False, 0, [], None
            texts = run["text"].to_pylist()
            count += physical(texts)
            if first and header is None:
                for x in texts:
                    begun.append(x.removeprefix("﻿") if not begun else x)
                    if not inside_after("\n".join(begun) if len(begun) > 1 else begun[0], False):
                        header, begun = next(rows_of("\n".join(begun) + "\n", 0, True))[1], []
                        break
            for k in np.flatnonzero(pc.match_substring(run["text"], '"').to_numpy(zero_copy_only=False)):
                state = [inside_after(texts[k], s) for s in state]
                closes |= not state[1]
    if now is not None:
        yield done()


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (path, split, block, entry, before, open, text) to records, and to what is left of records at the edges of
    splits: text with the block in which its record begins (open), and its own block."""
    limit = csv.field_size_limit()
    now = None

    class Split:
        def __init__(self, run: pa.RecordBatch):
            of = lambda c: run[c][0].as_py()
            self.number, self.path, self.block, self.inside, self.line, self.open = of("split"), of("path"), of("block"), of("entry"), of("before"), of("open")
            # Lines that wait for the end of their record, and whether that begins in this split.
            self.held, self.own, self.out = [], not self.inside, []

        def left(self) -> None:
            """The lines so far as a piece of a record that has another piece elsewhere."""
            if self.held:
                self.out.append((self.path, self.line, None, self.own and self.line == 0, self.block if self.own else self.open, self.block, "\n".join(self.held)))
                self.line += physical(self.held)
                self.held = []

        def take(self, texts: list[str], quoted: np.ndarray) -> None:
            if self.line == 0 and not self.held and texts and self.own:
                texts[0] = texts[0].removeprefix("﻿")
            begin = 0
            # A line ends its record if the state after it is outside; only lines with quotes change it.
            for k in [*np.flatnonzero(quoted).tolist(), len(texts)]:
                if not self.inside and k > begin:
                    self.parse(texts[begin:k])
                    begin = k
                if k == len(texts):
                    break
                was, self.inside = self.inside, inside_after(texts[k], self.inside)
                if was and not self.inside:
                    self.held += texts[begin : k + 1]
                    begin = k + 1
                    if self.own:
                        lines, self.held = self.held, []
                        self.parse(lines)
                    else:
                        self.left()
                        self.own = True
                elif not was and not self.inside:
                    self.parse(texts[begin : k + 1])
                    begin = k + 1
            self.held += texts[begin:]
            if self.inside and not self.own and sum(map(len, self.held)) > limit:
                raise csv.Error(f"{self.path}: field larger than field limit ({limit}) at line {self.line + 1}")

        def parse(self, lines: list[str]) -> None:
            first = self.line == 0
            for number, cells in rows_of("\n".join(lines) + "\n", self.line, first):
                self.out.append((self.path, number, cells, first, None, None, None))
                first = False
            self.line += physical(lines)

        def given(self) -> pa.RecordBatch:
            columns = list(zip(*self.out)) or [[]] * 7
            self.out = []
            kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["path", "source_row", "cells", "first", "open", "block", "text"])

    for batch in batches:
        for run in runs(batch):
            if now is None or run["split"][0].as_py() != now.number:
                if now:
                    now.left()
                    yield now.given()
                now = Split(run)
            for k in range(0, run.num_rows, 4096):
                part = run.slice(k, 4096)["text"]
                now.take(part.to_pylist(), pc.match_substring(part, '"').to_numpy(zero_copy_only=False))
                yield now.given()
    if now:
        now.left()
        yield now.given()


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a record (path, pieces in order: block, source_row, first, text) to what they hold."""
    for batch in batches:
        out = []
        for path, pieces in zip(batch["path"].to_pylist(), batch["pieces"].to_pylist()):
            first = pieces[0]["first"]
            for number, cells in rows_of("\n".join(p["text"] for p in pieces), pieces[0]["source_row"], first):
                out.append((path, number, cells, first))
                first = False
        columns = list(zip(*out)) or [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["path", "source_row", "cells", "first"])


def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (path, source_row, cells, header) to JSON objects; absent cells are null, and too many fail."""
    for batch in batches:
        out = []
        for path, row, cells, header in zip(*(batch[c].to_pylist() for c in ("path", "source_row", "cells", "header"))):
            if len(cells) > len(header):
                raise ValueError(f"{'/'.join(path.split('/')[-2:])} line {row}: more cells than the header has")
            filled = dict(zip(header, cells + [None] * (len(header) - len(cells))))
            out.append(json.dumps(filled, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
        yield pa.RecordBatch.from_arrays([batch["path"], batch["source_row"], pa.array(out, pa.string())], ["path", "source_row", "fields_json"])


def entries(splits: DataFrame) -> DataFrame:
    """Splits with the state in which each begins (entry), the lines before, and the block in which the record that is
    open at its beginning began.

    A split either keeps the state, turns it, or sets it. So the state is what the last split that set it set it to, turned
    as often as splits since do.
    """
    file = Window.partitionBy("path").orderBy("block")
    upto, before = file.rowsBetween(Window.unboundedPreceding, 0), file.rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("from_out") & ~F.col("from_in")).cast("int")
    rows = splits.withColumns({"turned": F.sum(turns).over(upto), "before": F.coalesce(F.sum("lines").over(before), F.lit(0))})
    sets = F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").cast("int").alias("to"), "turned"))
    last, turned = F.last(sets, ignorenulls=True).over(before), F.coalesce(F.last("turned").over(before), F.lit(0))
    state = (F.coalesce(last["to"], F.lit(0)) + turned - F.coalesce(last["turned"], F.lit(0))) % 2 == 1
    rows = rows.withColumn("entry", state)
    begins = F.when(~F.col("entry") | F.col("closes"), F.col("block"))
    return rows.withColumn("open", F.last(begins, ignorenulls=True).over(before))


def read(spark: SparkSession, path: str) -> DataFrame:
    """CSV files as path, source_row (the last physical line of a record) and fields_json, read in splits."""
    from corpusmill.sources import files, publish

    rows = files.raw_lines(spark, path, "\n")
    counted = publish.kept(files.splits_of(rows), "csv-splits")
    counted = counted.withColumn("split", F.xxhash64("path", "block"))
    side = publish.small_side(counted.select("path", "block", "split"), files.MOST_SPLITS)
    tagged = rows.join(side, ["path", "block"]).select("split", "block", "text")
    shape = "split long, from_out boolean, from_in boolean, closes boolean, lines long, header array<string>"
    found = publish.kept(tagged.mapInArrow(functions, shape), "csv-functions")
    splits = publish.kept(entries(counted.join(found, "split")).select("path", "block", "split", "entry", "before", "open", "header"), "csv-entries")
    side = splits.select("path", "block", "split", "entry", "before", "open")
    parsed = rows.join(publish.small_side(side, files.MOST_SPLITS), ["path", "block"]).select("path", "split", "block", "entry", "before", "open", "text").mapInArrow(records, RECORD)
    whole = parsed.where("cells is not null").select("path", "source_row", "cells", "first")
    pieces = parsed.where("cells is null").groupBy("path", "open").agg(F.sort_array(F.collect_list(F.struct("block", "source_row", "first", "text"))).alias("pieces"))
    whole = whole.unionByName(pieces.select("path", "pieces").mapInArrow(joined, "path string, source_row long, cells array<string>, first boolean"))
    headers = splits.where("block = 0 and header is not null").select("path", "header")
    if not splits.where("block = 0 and header is null").isEmpty():
        # A header that goes beyond the first split, or its file's end.
        late = whole.where("first").join(headers, "path", "left_anti").select("path", F.col("cells").alias("header"))
        headers = headers.unionByName(publish.kept(late, "csv-headers"))
    return whole.where("not first").join(publish.small_side(headers, MOST_HEADERS), "path").select("path", "source_row", "cells", "header").mapInArrow(objects, "path string, source_row long, fields_json string")
