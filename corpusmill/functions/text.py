"""Text, hash and id functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.arrow import canonical_json, closed_unescape, html_unescape

#: Python's white space as a Java character class (fixed value; use with the (?U) flag).
SPACE = r"[\s\x1c-\x1f]"
#: Patterns of the normalizer and of the audit (fixed values). Java's \v is a class, so \x0B stands for it.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
TRAILING = r"(?d)[ \t\f\x0B]+(?=\n|$)"
INNER_RUN = r"(?dU)(?<=\S)[ \t\f\x0B]{2,}(?=\S)"
ENTITY = r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,8}|#x[0-9A-Fa-f]{1,8});"
ESCAPED_NEWLINE = r"\\r\\n|\\n|\\r"
#: The same white space as characters.
BLANKS = "".join(filter(str.isspace, map(chr, range(0x3001))))


def strip(x: Column) -> Column:
    """Without white space at either end, as Python's str.strip()."""
    return F.btrim(x, F.lit(BLANKS))


def unescape(x: Column, closed: bool = False) -> Column:
    """HTML entities replaced (closed: those that end in a semicolon only); texts without & never leave the JVM's hands."""
    replaced = closed_unescape if closed else html_unescape
    return F.when(F.contains(x, F.lit("&")), replaced(F.when(F.contains(x, F.lit("&")), x))).otherwise(x)


def clean(x: Column) -> Column:
    """The normalizer after entities: newlines, no-break spaces, control characters, runs of blanks and lines."""
    x = F.translate(F.regexp_replace(x, "\r\n?", "\n"), " ", " ")
    x = F.regexp_replace(F.regexp_replace(x, CONTROL, ""), TRAILING, "")
    x = F.regexp_replace(F.regexp_replace(x, INNER_RUN, " "), "\n{3,}", "\n\n")
    return strip(x)


def normalize(x: Column, closed: bool = False) -> Column:
    return clean(unescape(x, closed))


def collapse(x: Column) -> Column:
    """Words joined by single blanks."""
    return F.regexp_replace(strip(x), rf"(?U){SPACE}+", " ")


def rstrip(x: Column) -> Column:
    return F.rtrim(x, F.lit(BLANKS))


def excerpt(x: Column, limit: int = 180) -> Column:
    """Collapsed text, cut to limit with an ellipsis."""
    x = collapse(x)
    return F.when(F.length(x) > limit, F.concat(rstrip(F.substring(x, 1, limit - 3)), F.lit("..."))).otherwise(x)


def word_excerpt(x: Column, limit: int = 500) -> Column:
    """The first characters of a longer text, up to its last blank if that isn't the first character."""
    return F.when(F.length(x) > limit, F.regexp_replace(F.substring(x, 1, limit), r"(?s)(?<=.) [^ ]*\z", "")).otherwise(x)


def truncate(x: Column, limit: int = 160) -> Column:
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit("..."))).otherwise(x)


def suspicious(x: Column) -> Column:
    """Number of control characters other than tab and newlines."""
    return F.regexp_count(x, F.lit(CONTROL))


def length_bucket(x: Column) -> Column:
    n = F.length(x)
    return F.when(n < 120, "short").when(n < 320, "medium").when(n < 700, "long").otherwise("very_long")


def category_key(x: Column) -> Column:
    return collapse(F.lower(x))


def cleaned_traits(x: Column) -> Column:
    """An array of strings stripped, without blanks and repeats, in order."""
    kept = F.filter(F.transform(x, strip), lambda t: F.coalesce(t != "", F.lit(False)))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def merged(a: Column, b: Column, limit: int | None = None) -> Column:
    """Two arrays in order, without repeats, cut to limit."""
    both = F.array_distinct(F.concat(a, b))
    return F.slice(both, 1, limit) if limit else both


def stable_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def legacy_id(source: Column, text: Column) -> Column:
    return F.concat(source, F.lit("__"), F.substring(F.md5(text), 1, 8))


def prompt_id(source: Column, source_file: Column, source_row: Column, raw_fields_json: Column) -> Column:
    """source, underscore and 20 hex digits of the hash of the record's canonical JSON."""
    quoted = lambda c: F.regexp_extract(canonical_json(F.to_json(F.struct(c.alias("v")))), r"(?s)^\{\"v\":(.*)\}$", 1)
    return prompt_id_of(source, quoted(source), quoted(source_file), source_row, canonical_json(raw_fields_json))


def prompt_id_of(source: Column, source_json: Column, source_file_json: Column, source_row: Column, fields_json: Column) -> Column:
    """The same from values that are canonical JSON already."""
    parts = [F.lit('{"raw_fields":'), fields_json, F.lit(',"source":'), source_json, F.lit(',"source_file":'), source_file_json, F.lit(',"source_row":'), source_row.cast("string"), F.lit("}")]
    return F.concat(source, F.lit("_"), F.substring(stable_hash(F.concat(*parts)), 1, 20))


def provenance(source: Column, source_file: Column, source_row: Column, path: Column, line: Column) -> Column:
    own = F.concat(source, F.lit("/"), source_file, F.lit(":"), source_row.cast("string"))
    known = (source != "") & (source_file != "") & source_row.isNotNull()
    return F.when(F.coalesce(known, F.lit(False)), own).otherwise(F.concat(path, F.lit(":"), line.cast("string")))


def confidence(score: Column) -> Column:
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s >= 0.7, "HIGH").when(s >= 0.4, "MED").otherwise("LOW")


def effective_query(query: Column, category: Column) -> Column:
    """The trimmed query, else the chosen category, else null."""
    return F.coalesce(F.nullif(strip(query), F.lit("")), category)
