"""Audit of a corpus: field profiles, schema variants, duplicates and likely text fields, in three scopes.

A record is (ord, source, source_file, location, fields), fields a VARIANT object; ord gives first-seen order.
Scopes are the corpus, each source and each file. run() reads the corpus once into facts: hashes, lengths, flags and the
beginnings of texts. From these come states by file that merge into those of sources and the corpus: counters, how often
each hash, key set and type occurs and where first, and the first rejected lines.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.sources import files, publish

SHORT, LONG = 20, 2000
SAMPLES = VARIANTS = 10
MIN_COVERAGE = 0.05
SCOPES = [[], ["source"], ["source", "source_file"]]
COUNTERS = [
    "present_count", "null_count", "non_string_count", "string_count", "non_empty_string_count", "total_string_length", "short_text_count",
    "long_text_count", "html_entity_count", "escaped_newline_count", "suspicious_control_character_count", "suspicious_control_character_instances",
]


def python_type(variant_type: Column) -> Column:
    """The name of the Python type of a variant, from schema_of_variant."""
    by_prefix = {"STRING": "str", "BIGINT": "int", "DOUBLE": "float", "DECIMAL": "float", "BOOLEAN": "bool", "VOID": "NoneType", "ARRAY": "list", "OBJECT": "dict"}
    name = F.lit(None).cast("string")
    for prefix, python in by_prefix.items():
        name = F.when(variant_type.startswith(prefix), python).otherwise(name)
    return name


def field_rows(records: DataFrame) -> DataFrame:
    """One row for each field of each record: ord, source, source_file, location, field, type, text (of strings)."""
    exploded = records.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("fields").outer()).select(F.col("key").alias("field"), F.col("value").alias("v")))
    kind = python_type(F.schema_of_variant("v"))
    return exploded.select("ord", "source", "source_file", "location", "field", kind.alias("type"), F.when(kind == "str", F.expr("try_variant_get(v, '$', 'string')")).alias("text"))


def measured(rows: DataFrame) -> DataFrame:
    """rows (type, text) with what several counters take from a text, so that each is worked out once."""
    return rows.withColumns({"stripped": F.length(T.strip(F.col("text"))), "odd": T.suspicious(F.col("text"))})


def counters() -> list[Column]:
    """The additive counters of a field, over measured rows."""
    type_, text, stripped, odd = F.col("type"), F.col("text"), F.col("stripped"), F.col("odd")
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return [
        F.count(F.lit(1)).alias("present_count"),
        count(type_ == "NoneType", "null_count"),
        count(~type_.isin("NoneType", "str"), "non_string_count"),
        count(type_ == "str", "string_count"),
        count(stripped > 0, "non_empty_string_count"),
        F.coalesce(F.sum(F.length(text).cast("long")), F.lit(0)).alias("total_string_length"),
        count((stripped > 0) & (stripped <= SHORT), "short_text_count"),
        count(F.length(text) >= LONG, "long_text_count"),
        count(text.rlike(T.ENTITY), "html_entity_count"),
        count(text.rlike(T.ESCAPED_NEWLINE), "escaped_newline_count"),
        count(odd > 0, "suspicious_control_character_count"),
        F.coalesce(F.sum(odd.cast("long")), F.lit(0)).alias("suspicious_control_character_instances"),
        F.min(F.length(text)).cast("long").alias("min_string_length"),
        F.max(F.length(text)).cast("long").alias("max_string_length"),
    ]


def profile(rows: DataFrame) -> DataFrame:
    """Counters by source, source_file and field."""
    return measured(rows).groupBy("source", "source_file", "field").agg(*counters())


def widen(by_file: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Merges what was aggregated by source and file for every scope; scope: 0 corpus, 1 source, 2 file."""
    sets = [[*s, *keys] for s in SCOPES]
    level = F.lit(2) - F.grouping("source").cast("int") - F.grouping("source_file").cast("int")
    return by_file.groupingSets(sets, "source", "source_file", *keys).agg(level.alias("scope"), *aggregates)


def scoped_profile(rows: DataFrame) -> DataFrame:
    sums = [F.sum(c).cast("long").alias(c) for c in COUNTERS]
    return widen(profile(rows), ["field"], [*sums, F.min("min_string_length").alias("min_string_length"), F.max("max_string_length").alias("max_string_length")])


def report(profiled: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Adds missing_count, ratio and average; totals: keys and total_records."""
    joined = profiled.join(totals, keys) if keys else profiled.crossJoin(totals)
    return joined.select(
        *profiled.columns,
        F.greatest(F.col("total_records") - F.col("present_count"), F.lit(0)).alias("missing_count"),
        F.round(F.when(F.col("total_records") > 0, F.col("non_empty_string_count") / F.col("total_records")).otherwise(0.0), 4).alias("non_empty_string_ratio"),
        F.round(F.when(F.col("string_count") > 0, F.col("total_string_length") / F.col("string_count")).otherwise(0.0), 2).alias("average_string_length"),
    )


def likely_fields(profiled: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Fields that may hold the text, with their scores; best first within each scope."""
    joined = profiled.join(totals, keys) if keys else profiled.crossJoin(totals)
    coverage = F.col("non_empty_string_count") / F.col("total_records")
    average = F.col("total_string_length") / F.col("string_count")
    score = coverage * 0.65 + F.least(average / 500, F.lit(1.0)) * 0.35
    kept = joined.where((F.col("total_records") > 0) & (F.col("non_empty_string_count") > 0)).where((coverage >= MIN_COVERAGE) & (average >= SHORT))
    kept = kept.select(*keys, "field", F.round(coverage, 4).alias("coverage_ratio"), "non_empty_string_count", F.round(average, 2).alias("average_string_length"), F.round(score, 4).alias("candidate_score"))
    return kept.orderBy(*keys, F.desc("candidate_score"), F.desc("average_string_length"), F.desc("non_empty_string_count"), F.desc("field"))


def type_histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "field", "type").agg(F.count(F.lit(1)).alias("n"))


def empty_value(type_: Column, v: Column) -> Column:
    """Null, blank string, empty list or empty object."""
    text = F.try_variant_get(v, F.lit("$"), "string")
    return (type_ == "NoneType") | ((type_ == "str") & (T.strip(text) == "")) | (type_.isin("list", "dict") & F.to_json(v).isin("[]", "{}"))


def schema_variants(records: DataFrame, keys: list[str], limit: int = VARIANTS) -> DataFrame:
    """Distinct sorted key sets with counts: records (keys, ord, names). The first `limit` of each scope."""
    counted = records.groupBy(*keys, "names").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    place = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    return counted.withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit)


def duplicate_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, ord, location, sample, hash) to groups of at least two: only hashes and samples are exchanged."""
    first = F.min_by(F.struct("sample", "location"), "ord")
    grouped = rows.groupBy(*keys, "hash").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), first.alias("seen"))
    return grouped.where("n > 1").select(*keys, "hash", "n", "first", F.col("seen.sample").alias("sample"), F.col("seen.location").alias("first_seen_at"))


def duplicate_summary(groups: DataFrame, keys: list[str]) -> DataFrame:
    return groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_occurrences"))


def duplicate_samples(groups: DataFrame, keys: list[str], limit: int = SAMPLES) -> DataFrame:
    """The first groups seen of each scope, then in order of count and place, both descending."""
    place = Window.partitionBy(*keys).orderBy("first")
    return groups.withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit).orderBy(*keys, F.desc("n"), F.desc("first_seen_at"))


def malformed(lines: DataFrame, keys: list[str], limit: int = SAMPLES) -> tuple[DataFrame, DataFrame]:
    """Counts of rejected lines (source_file, line, text, reason) by reason, and the first ones with excerpts."""
    counts = lines.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))
    place = Window.partitionBy(*keys).orderBy("source_file", "line")
    first = lines.withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit)
    return counts, first.select(*keys, "source_file", "line", "reason", T.truncate(T.strip(F.col("text")), 120).alias("line_excerpt"))


def empty_record(json_: Column) -> Column:
    """Whether a record (canonical JSON) is an object all of whose values are empty, or itself an empty value."""
    values = F.map_values(F.from_json(F.when(json_.startswith("{"), json_), "map<string,variant>"))
    whole = F.parse_json(json_)
    inside = F.forall(values, lambda v: F.coalesce(empty_value(python_type(F.schema_of_variant(v)), v), F.lit(True)))
    return F.when(json_.startswith("{"), inside).otherwise(empty_value(python_type(F.schema_of_variant(whole)), whole))


def record_counters(records: DataFrame, keys: list[str]) -> DataFrame:
    """records (keys, json) to counts of all, of empty ones and of those that are no objects."""
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_records"), count(empty_record(F.col("json")), "empty_records"), count(~F.col("json").startswith("{"), "non_object_records"))


def record_hashes(records: DataFrame) -> DataFrame:
    """records with what duplicate_groups() asks for, of whole records."""
    return records.withColumns({"sample": T.truncate(F.col("json")), "hash": T.stable_hash(F.col("json"))})


def text_hashes(rows: DataFrame) -> DataFrame:
    """Texts of fields that aren't blank with what duplicate_groups() asks for."""
    some = rows.where((F.col("type") == "str") & (T.strip(F.col("text")) != ""))
    return some.withColumns({"sample": T.truncate(F.col("text")), "hash": T.stable_hash(F.col("text"))})


def likely_duplicates(rows: DataFrame, likely: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicate groups of the texts of likely fields (keys, field), by field."""
    return duplicate_groups(text_hashes(rows).join(likely.select(*keys, "field"), [*keys, "field"], "left_semi"), [*keys, "field"])


FILE = ["source", "source_file"]
SCOPE = ["scope", *FILE]
HASH = {"n": F.sum, "first": F.min}


def facts(lines: DataFrame) -> DataFrame:
    """Lines (source, source_file, line, text: a file's folder and name) as what the audit takes from them, in one parse:
    error and excerpt of rejected ones; of records their location, hash and beginning, names of fields, whether they are
    empty, and by field type, measures, hash and beginning of the text."""
    rows = files.parsed(lines, entries=True)
    own, text = F.col("parsed.own"), F.col("text")
    where = F.coalesce(own, F.concat_ws(":", F.concat_ws("/", *FILE), F.col("line").cast("string")))

    def measure(e: Column) -> Column:
        t = e["text"]
        some = F.when(F.length(T.strip(t)) > 0, t)
        return F.struct(
            e["field"].alias("field"), e["type"].alias("type"), F.length(t).alias("length"), F.length(T.strip(t)).alias("stripped"), t.rlike(T.ENTITY).alias("entity"),
            t.rlike(T.ESCAPED_NEWLINE).alias("escaped"), T.suspicious(t).alias("odd"), F.unhex(T.stable_hash(some)).alias("hash"), T.truncate(some).alias("sample"),
        )

    return rows.select(
        *FILE, "line", F.col("parsed.error").alias("error"), F.when(F.col("reason").isNotNull(), T.truncate(T.strip(text), 120)).alias("excerpt"), where.alias("location"),
        F.unhex(T.stable_hash(F.col("fields_json"))).alias("hash"), T.truncate(F.col("fields_json")).alias("sample"), F.col("parsed.names").alias("names"), F.col("parsed.empty").alias("empty"),
        F.transform("parsed.entries", measure).alias("entries"),
    )


def merged(states: DataFrame, keys: list[str], **how) -> DataFrame:
    """States by file and keys as states of every scope: scope (0 corpus, 1 source, 2 file), with an empty source and
    file for the wider ones, keys, and each column merged as told. States that come from one file merge to themselves."""
    wide = widen(states, keys, [f(c).alias(c) for c, f in how.items()])
    return wide.withColumns({c: F.coalesce(c, F.lit("")) for c in FILE})


def seen_first() -> Column:
    """The sample and place of the first occurrence of a hash, over facts."""
    return F.min(F.struct(*FILE, "line", "sample", "location")).alias("first")


def repeated(states: DataFrame, keys: list[str]) -> DataFrame:
    """Hashes by file (n, first) to groups of at least two in a scope. A hash that occurs once in the corpus is no
    group anywhere, so only the others are merged."""
    often = states.groupBy(*keys, "hash").agg(F.sum("n").alias("n")).where("n > 1").select(*keys, "hash")
    return merged(states.join(often, [*keys, "hash"], "left_semi"), [*keys, "hash"], **HASH).where("n > 1")


def first_groups(groups: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Groups and surplus occurrences by scope and keys, and the groups that were seen first."""
    place = Window.partitionBy(*SCOPE, *keys).orderBy("first")
    shown = groups.withColumn("place", F.row_number().over(place)).where(F.col("place") <= SAMPLES)
    shown = shown.select(*SCOPE, *keys, F.col("n").alias("count"), F.col("first.location").alias("first_seen_at"), F.col("first.sample").alias("sample"))
    return groups.groupBy(*SCOPE, *keys).agg(F.count(F.lit(1)).alias("duplicate_groups"), F.sum(F.col("n") - 1).alias("duplicate_occurrences")), shown


def states(seen: DataFrame) -> dict[str, DataFrame]:
    """Facts as rows by scope: records, rejected, fields, types, variants, raw (duplicate records) and texts (duplicate
    texts of the fields that are likely to hold the text in that scope), each with what is shown of them."""
    good, bad = seen.where("error is null"), seen.where("error is not null")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    total = {"total_records": F.sum, "empty_records": F.sum}
    records = merged(good.groupBy(*FILE).agg(F.count(F.lit(1)).alias("total_records"), count(F.col("empty")).alias("empty_records")), [], **total)
    entries = good.select(*FILE, "line", "location", F.explode("entries").alias("e")).select(*FILE, "line", "location", "e.*")
    measures = entries.select(*FILE, "field", "type", "length", "stripped", "entity", "escaped", "odd")
    fields = merged(measures.groupBy(*FILE, "field").agg(*sums(measures)), ["field"], **{c: F.sum for c in COUNTERS}, min_string_length=F.min, max_string_length=F.max)
    types = merged(measures.groupBy(*FILE, "field", "type").agg(F.count(F.lit(1)).alias("n")), ["field", "type"], n=F.sum)
    fields = publish.kept(fields, "audit-fields")
    # Which fields may hold the text is known from the counters of their scope.
    records = publish.kept(records, "audit-records")
    coverage, average = F.col("non_empty_string_count") / F.col("total_records"), F.col("total_string_length") / F.col("string_count")
    likely = fields.join(records, SCOPE).where((F.col("non_empty_string_count") > 0) & (coverage >= MIN_COVERAGE) & (average >= SHORT)).select(*SCOPE, "field")
    by_hash = lambda rows, *keys: rows.where("hash is not null").groupBy(*FILE, *keys, "hash").agg(F.count(F.lit(1)).alias("n"), seen_first())
    raw, raw_shown = first_groups(repeated(by_hash(good), []), [])
    probable = publish.small_side(likely.select("field").distinct(), 100_000)
    texts = repeated(by_hash(entries.join(probable, "field", "left_semi"), "field"), ["field"]).join(likely, [*SCOPE, "field"], "left_semi")
    texts, texts_shown = first_groups(texts, ["field"])
    variants = good.groupBy(*FILE, "names").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*FILE, "line")).alias("first"))
    variants = merged(variants, ["names"], **HASH)
    dominant = variants.withColumn("place", F.row_number().over(Window.partitionBy(*SCOPE).orderBy(F.desc("n"), "first"))).where(F.col("place") <= VARIANTS)
    # The first rejected lines of a scope are among the first ones of its files.
    head = Window.partitionBy(*FILE).orderBy("line")
    lines = bad.select(*FILE, "line", "error", "excerpt").withColumn("place", F.row_number().over(head)).where(F.col("place") <= SAMPLES)
    return {
        "records": records, "rejected": merged(bad.groupBy(*FILE).agg(F.count(F.lit(1)).alias("n")), [], n=F.sum), "rejected_shown": first_lines(lines), "fields": fields, "types": types,
        "raw": raw, "raw_shown": raw_shown, "texts": texts, "texts_shown": texts_shown, "variants": variants.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n")), "variants_shown": dominant,
    }


def first_lines(lines: DataFrame) -> DataFrame:
    """The first rejected lines of files as those of every scope."""
    scopes = F.array(*[F.struct(F.lit(k).alias("scope"), (F.col("source") if k > 0 else F.lit("")).alias("of_source"), (F.col("source_file") if k > 1 else F.lit("")).alias("of_file")) for k in range(3)])
    each = lines.select(*FILE, "line", "error", "excerpt", F.explode(scopes).alias("s"))
    place = Window.partitionBy("s").orderBy(*FILE, "line")
    shown = each.withColumn("place", F.row_number().over(place)).where(F.col("place") <= SAMPLES)
    return shown.select("s.scope", F.col("s.of_source").alias("source"), F.col("s.of_file").alias("source_file"), "place", F.concat_ws("/", *FILE).alias("file"), F.col("line").alias("line_number"), "error", F.col("excerpt").alias("line_excerpt"))


def sums(rows: DataFrame) -> list[Column]:
    """counters() over facts, whose texts are measured already."""
    type_, count = F.col("type"), lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    of = {
        "present_count": F.count(F.lit(1)), "null_count": count(type_ == "NoneType"), "non_string_count": count(~type_.isin("NoneType", "str")), "string_count": count(type_ == "str"),
        "non_empty_string_count": count(F.col("stripped") > 0), "total_string_length": F.coalesce(F.sum(F.col("length").cast("long")), F.lit(0)),
        "short_text_count": count((F.col("stripped") > 0) & (F.col("stripped") <= SHORT)), "long_text_count": count(F.col("length") >= LONG), "html_entity_count": count(F.col("entity")),
        "escaped_newline_count": count(F.col("escaped")), "suspicious_control_character_count": count(F.col("odd") > 0), "suspicious_control_character_instances": F.coalesce(F.sum(F.col("odd").cast("long")), F.lit(0)),
        "min_string_length": F.min("length").cast("long"), "max_string_length": F.max("length").cast("long"),
    }
    return [c.alias(name) for name, c in of.items()]


def run(spark: SparkSession, path: str) -> dict:
    """The audit of canonical files (a glob whose files are each in their source's folder): a summary of the corpus, of each
    source and of each file, files without a line among them.

    The corpus is read twice: lines are counted, then parsed once into facts, from which all else comes. Only counters
    and the first samples of each scope come to the driver.
    """
    seen = publish.kept(facts(files.lines(spark, path)), "audit-facts")
    found = {name: by_scope(df) for name, df in states(seen).items()}
    listed = sorted((r["source"], r["source_file"]) for r in files.listing(spark, path).select(*FILE).collect())
    names = sorted({s for s, _ in listed})
    per_file = {f"{s}/{f}": reported(found, (2, s, f)) | {"source_name": s} for s, f in listed}
    per_source = {s: reported(found, (1, s, "")) | {"file_count": sum(x == s for x, _ in listed)} for s in names}
    corpus = reported(found, (0, "", "")) | {"total_sources": len(names), "total_files": len(listed), "per_source_record_counts": {s: r["total_records"] for s, r in per_source.items()}}
    return {
        "generated_at": datetime.now(UTC).isoformat(), "canonical_root": path, "report_version": 2,
        "analysis_constraints": {"raw_data_modified": False, "canonical_data_modified": False, "normalized_artifacts_created": False},
        "thresholds": {"short_text_threshold": SHORT, "long_text_threshold": LONG, "max_duplicate_samples": SAMPLES, "max_malformed_line_samples": SAMPLES, "max_schema_variants": VARIANTS},
        "corpus_summary": corpus, "source_summaries": per_source, "file_summaries": per_file,
    }


def by_scope(df: DataFrame) -> dict[tuple, list[dict]]:
    """Rows of a state by scope, source and file."""
    found: dict[tuple, list] = {}
    for r in df.toLocalIterator():
        row = r.asDict(True)
        found.setdefault(tuple(row.pop(k) for k in SCOPE), []).append(row)
    return found


def candidates(fields: list[dict], total: int) -> list[dict]:
    """The fields of a scope that may hold the text, with their scores, best first."""
    kept = []
    for f in fields:
        coverage, average = f["non_empty_string_count"] / total, f["total_string_length"] / (f["string_count"] or 1)
        if f["non_empty_string_count"] and coverage >= MIN_COVERAGE and average >= SHORT:
            score = coverage * 0.65 + min(average / 500, 1.0) * 0.35
            kept.append({"field_name": f["field"], "coverage_ratio": round(coverage, 4), "non_empty_string_count": f["non_empty_string_count"], "average_string_length": round(average, 2), "candidate_score": round(score, 4)})
    return sorted(kept, key=lambda c: (c["candidate_score"], c["average_string_length"], c["non_empty_string_count"], c["field_name"]), reverse=True)


def reported(found: dict, key: tuple) -> dict:
    """One scope's part of the report."""
    of = lambda name: found[name].get(key, [])
    one = lambda name, default: (of(name) or [default])[0]
    none = {"duplicate_groups": 0, "duplicate_occurrences": 0}
    shown = lambda rows: [{k: r[k] for k in ("count", "first_seen_at", "sample")} for r in sorted(rows, key=lambda r: (r["count"], r["first_seen_at"]), reverse=True)]
    totals = one("records", {"total_records": 0, "empty_records": 0})
    total, fields = totals["total_records"], sorted(of("fields"), key=lambda f: f["field"])
    likely, texts = candidates(fields, total), {t["field"]: t for t in of("texts")}
    by_field = {c["field_name"]: {k: texts[c["field_name"]][k] for k in none} | {"samples": shown([s for s in of("texts_shown") if s["field"] == c["field_name"]])} for c in likely if c["field_name"] in texts}
    variants = [{"fields": v["names"], "count": v["n"]} for v in sorted(of("variants_shown"), key=lambda v: v["place"])]
    types: dict[str, dict] = {}
    for t in sorted(of("types"), key=lambda t: t["type"]):
        types.setdefault(t["field"], {})[t["type"]] = t["n"]
    lines = [{k: r[k] for k in ("file", "line_number", "error", "line_excerpt")} for r in sorted(of("rejected_shown"), key=lambda r: r["place"])]
    more = lambda f: {
        "missing_count": max(total - f["present_count"], 0), "non_empty_string_ratio": round(f["non_empty_string_count"] / total, 4),
        "average_string_length": round(f["total_string_length"] / f["string_count"], 2) if f["string_count"] else 0.0, "value_type_counts": types[f["field"]],
    }
    return {
        **totals, "non_object_records": 0, "malformed_jsonl_lines": one("rejected", {"n": 0})["n"], "malformed_line_samples": lines, "likely_prompt_bearing_fields": likely,
        "duplicate_raw_records": one("raw", none) | {"samples": shown(of("raw_shown"))}, "duplicate_likely_prompt_text": {k: sum(f[k] for f in by_field.values()) for k in none} | {"by_field": by_field},
        "schema_variation": {"variant_count": one("variants", {"n": 0})["n"], "dominant_fields": variants[0]["fields"] if variants else [], "dominant_count": variants[0]["count"] if variants else 0, "variants": variants},
        "fields": {f["field"]: {k: v for k, v in f.items() if k != "field"} | more(f) for f in fields},
    }
