"""Secret scans with DataFrame functions only.

Base kinds are regular expressions. The entropy kind adds candidate strings (long runs of token characters) in
which some window of WINDOW characters has at least the Shannon entropy asked of its character class. Counts by
character and class are updated as one character enters the window and one leaves. An allow-list takes words,
numbers, UUIDs and placeholders between separators out of the windows, and a candidate that a base span covers is
suppressed.

Positions come from splitting a text at the matches: a match starts after the lengths of all that precedes it. No
pattern repeats a group, so that none of them recurses, and arrays grow slice by slice (common.running), so that
texts of any length and number of matches take time in proportion.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import let, running, slices, table

#: Base kinds in order: kind, pattern, group whose length counts, least length (fixed values).
BASE = [
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    # A run from AKIA that is too short holds no later AKIA run that is long enough, so the length can be in the pattern.
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
ENTROPY = "entropy"
WINDOW = 20
SEPARATORS = "[-_/+=]"
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW
#: Bits a character that a window needs, by its class: hex digits only (4 bits at most), letters only, or letters and
#: digits (4.32 at most, as all windows of 20). A window without letters, or without digits but with a separator, has none.
HEX_BITS, LETTER_BITS, MIXED_BITS = 3.0, 4.0, 3.7
#: So many characters of a window that spans separators must lie in pieces that are no words, numbers and the like.
WOVEN = 12
#: Pieces between separators that are no secrets: letters only, digits only, a word and a number, placeholders.
ALLOWED = [r"^[A-Za-z]*$", r"^[0-9]*$", r"^[A-Za-z]+[0-9]{1,4}$", r"(?i)example|placeholder|dummy|changeme|your"]
PLACEHOLDER = ALLOWED[-1]
#: A UUID, by separators of the same length in its place.
UUID, BLANKED = r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9A-Za-z])", "-" * 36
REDACTED = "[SECRET]"
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
KINDS = [k for k, *_ in BASE] + [ENTROPY]


def none() -> Column:
    return F.array().cast(SPAN)


def located(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the pattern's matches for which keep(whole match, its group values) holds."""
    group = BASE[kind][2] if kind < len(BASE) else 0
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    value = F.regexp_extract_all(text, F.lit(pattern), group)

    def spans(parts: Column) -> Column:
        # Lengths before each match: F.split gives one piece more than there are matches.
        ends = running(parts, F.lit(0).cast("bigint"), lambda at, part: at + F.length(part["gap"]) + F.coalesce(F.length(part["hit"]), F.lit(0)))
        found = F.filter(F.arrays_zip(parts.alias("part"), ends.alias("end")), lambda x: x["part"]["hit"].isNotNull() & keep(x["part"]["hit"], x["part"]["value"]))
        return F.transform(found, lambda x: F.struct((x["end"] - F.length(x["part"]["hit"])).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), value.alias("value"))
    return F.when(text.rlike(pattern), let(parts, spans)).otherwise(none())


def weight(n: Column) -> Column:
    """n log2 n, 0 for 0."""
    return F.get(F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 1)]), n)


def slide(codes: Column, letters: Column, step, zero: Column) -> Column:
    """Folds step(entropy or null, char that enters, char that leaves or null, state) over a string of characters.

    codes: the place of each character in letters, from 0. The counts of a window's characters are a string with a
    character for each letter, which holds its count.
    """
    counted = lambda counts, code: F.ascii(F.substring(counts, code + 1, F.lit(1))) - 1
    put = lambda counts, code, n: F.overlay(counts, F.char(n + 1), code + 1, F.lit(1))

    def move(state: Column, code: Column) -> Column:
        at = state["at"]
        leaves = F.when(at >= WINDOW, F.get(codes, at - WINDOW))

        def out(left: Column) -> Column:
            less = F.when(leaves.isNull(), state["counts"]).otherwise(put(state["counts"], leaves, left - 1))
            gone = F.when(leaves.isNull(), 0.0).otherwise(weight(left - 1) - weight(left))
            return let(F.struct(less.alias("counts"), (state["total"] + gone).alias("total")), enter)

        def enter(now: Column) -> Column:
            return let(counted(now["counts"], code), lambda n: more(now, n))

        def more(now: Column, n: Column) -> Column:
            return let(now["total"] + weight(n + 1) - weight(n), lambda total: F.struct((at + 1).alias("at"), put(now["counts"], code, n + 1).alias("counts"), total.alias("total"), seen(total).alias("own")))

        def seen(total: Column) -> Column:
            entropy = F.when(at >= WINDOW - 1, math.log2(WINDOW) - total / WINDOW)
            return step(entropy, code, leaves, state["own"], at)

        return let(F.when(leaves.isNull(), 0).otherwise(counted(state["counts"], leaves)), out)

    counts = F.repeat(F.lit("\x01"), F.size(letters))
    start = F.struct(F.lit(0).alias("at"), counts.alias("counts"), F.lit(0.0).alias("total"), zero.alias("own"))
    return F.aggregate(codes, start, move, lambda s: s["own"])


def characters(text: Column, body) -> Column:
    """body(codes, letters) for the characters of a string."""
    chars = lambda c: let(F.array_distinct(c), lambda letters: let(F.transform(c, lambda x: F.array_position(letters, x).cast("int") - 1), lambda codes: body(codes, letters)))
    return let(F.split(text, ""), chars)


def window_entropy(text: Column) -> Column:
    """The greatest Shannon entropy, in bits a character, of any WINDOW characters in a row; 0 if there are fewer."""
    step = lambda entropy, code, leaves, best, at: F.greatest(best, F.coalesce(entropy, F.lit(0.0)))
    return characters(text, lambda codes, letters: slide(codes, letters, step, F.lit(0.0)))


def woven(candidate: Column) -> Column:
    """For each character of a candidate whether its piece between separators may be (part of) a secret: 2 if it is
    letters and digits, 1 if it may count for a letters-only or hex window only, else 0."""
    pieces = F.split(candidate, SEPARATORS, -1)

    def mark(piece: Column) -> Column:
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | piece.rlike(pattern)
        return F.array_repeat(F.when(~allowed, 2).when(~piece.rlike(PLACEHOLDER), 1).otherwise(0), F.length(piece) + 1)

    return F.flatten(F.transform(pieces, mark))


def suspicious(candidate: Column) -> Column:
    """Whether some window of a candidate has the entropy that its class asks for."""

    def judged(text: Column) -> Column:
        def over(codes: Column, letters: Column, marks: Column) -> Column:
            kinds = lambda pattern: F.transform(letters, lambda c: c.rlike(pattern).cast("int"))
            return let(F.struct(kinds("[0-9]").alias("digit"), kinds("[A-Za-z]").alias("letter"), kinds("[0-9A-Fa-f]").alias("hex")), lambda k: slide(codes, letters, lambda *x: step(k, marks, *x), zero))

        zero = F.struct(*[F.lit(0).alias(c) for c in ("digits", "letters", "hexes", "woven", "plain")], F.lit(False).alias("hit"))

        def step(k: Column, marks: Column, entropy: Column, code: Column, leaves: Column, s: Column, at: Column) -> Column:
            moved = lambda of, enters, gone: of + enters - F.coalesce(gone, F.lit(0))
            by = lambda name, kind: moved(s[name], F.get(k[kind], code), F.get(k[kind], leaves))
            mark = lambda n: moved(s["woven" if n == 2 else "plain"], (F.get(marks, at) >= n).cast("int"), F.when(leaves.isNotNull(), (F.get(marks, at - WINDOW) >= n).cast("int")))
            now = F.struct(by("digits", "digit").alias("digits"), by("letters", "letter").alias("letters"), by("hexes", "hex").alias("hexes"), mark(2).alias("woven"), mark(1).alias("plain"))
            return let(now, lambda n: F.struct(*[n[c].alias(c) for c in ("digits", "letters", "hexes", "woven", "plain")], (s["hit"] | F.coalesce(entropy >= bits(n), F.lit(False))).alias("hit")))

        def bits(n: Column) -> Column:
            whole = (n["plain"] == WINDOW) & (n["letters"] > 0)
            return F.when(whole & (n["hexes"] == WINDOW) & (n["digits"] > 0), HEX_BITS).when(whole & (n["letters"] == WINDOW), LETTER_BITS).when((n["woven"] >= WOVEN) & (n["digits"] > 0) & (n["letters"] > 0), MIXED_BITS)

        return characters(text, lambda codes, letters: let(woven(text), lambda marks: over(codes, letters, marks)))["hit"]

    return let(F.regexp_replace(candidate, UUID, BLANKED), judged)


def scan(df: DataFrame, text: str = "text", to: str = "spans") -> DataFrame:
    """df with a column of spans (it replaces one of this name): array of start, kind (index into KINDS) and end, sorted.

    Positions are code points, the end exclusive. A null or empty text has no spans. Rows are scanned one by one:
    repeated rows and nulls in other columns change nothing, an empty table stays empty.
    """
    x = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = [located(x, pattern, kind, lambda hit, value, n=least: F.length(value) >= n) for kind, (_, pattern, _, least) in enumerate(BASE)]
    more = located(x, CANDIDATE, len(BASE), lambda hit, _: suspicious(hit))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != to.lower()]
    rows = df.select(*kept, F.array_sort(F.concat(*base, more)).alias("__all"))

    def uncovered(spans: Column) -> Column:
        # In order of start, base kinds first: the furthest end of base spans that begin at or before each span.
        ends = running(spans, F.lit(0).cast("bigint"), lambda most, s: F.greatest(most, F.when(s["kind"] < len(BASE), s["end"]).otherwise(F.lit(0))))
        both = F.filter(F.arrays_zip(spans.alias("span"), ends.alias("most")), lambda z: (z["span"]["kind"] < len(BASE)) | (z["span"]["end"] > z["most"]))
        return F.transform(both, lambda z: z["span"])

    return rows.select(*kept, F.when(F.exists("__all", lambda s: s["kind"] == len(BASE)), let(F.col("__all"), uncovered)).otherwise(F.col("__all")).alias(to))


def redact(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """df whose texts have REDACTED in place of each span; spans that overlap or touch count as one."""
    x = F.col(f"`{text}`")
    ints = F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))

    def clean(all_: Column) -> Column:
        return let(running(all_, F.lit(-1), lambda most, s: F.greatest(most, s["end"])), lambda ends: between(all_, ends))

    def between(all_: Column, ends: Column) -> Column:
        # What lies before each span that begins beyond all earlier ones, and what follows the last.
        before = F.transform(all_, lambda s, k: F.struct(F.when(k == 0, -1).otherwise(F.get(ends, k - 1)).alias("most"), s["start"].alias("to")))
        gaps = F.transform(F.filter(before, lambda g: g["to"] > g["most"]), lambda g: F.struct(F.greatest(g["most"], F.lit(0)).alias("at"), g["to"].alias("to")))
        # A slice of gaps is cut from the part of the text that it spans.
        cut = lambda some: let(F.get(some, F.lit(0))["at"], lambda first: let(F.substring(x, first + 1, F.element_at(some, -1)["to"] - first), lambda part: F.transform(some, lambda g: F.substring(part, g["at"] - first + 1, g["to"] - g["at"]))))
        pieces = F.flatten(F.transform(slices(gaps), cut))
        return F.array_join(F.concat(pieces, F.array(F.substring(x, F.element_at(ends, -1) + 1, F.length(x)))), REDACTED)

    return df.withColumn(text, F.when(F.size(spans) > 0, let(ints, clean)).otherwise(x))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every whole text of documents."""
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return rows.select("doc_id", *[count(k).alias(f"n_{BASE[k][0]}") for k in range(len(BASE))], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
