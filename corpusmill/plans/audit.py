"""Audit queries over the tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.arrow import canonical_json
from corpusmill.operators import audit
from corpusmill.plans.common import sql_strip, table
from corpusmill.sources import publish

STRIPPED = sql_strip("text")
#: The patterns of functions.text, as DuckDB writes them.
ODD = r"length(regexp_replace(text, '[^\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'))"
ENTITY = "'&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,8}|#x[0-9A-Fa-f]{1,8});'"
SQL_COUNTERS = rf"""
  count(*) AS present_count, count(*) FILTER (text IS NULL) AS null_count, CAST(0 AS BIGINT) AS non_string_count, count(text) AS string_count,
  count(*) FILTER ({STRIPPED} <> '') AS non_empty_string_count, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS total_string_length,
  count(*) FILTER ({STRIPPED} <> '' AND length({STRIPPED}) <= 20) AS short_text_count, count(*) FILTER (length(text) >= 2000) AS long_text_count,
  count(*) FILTER (regexp_matches(text, {ENTITY})) AS html_entity_count,
  count(*) FILTER (regexp_matches(text, '\\r\\n|\\n|\\r')) AS escaped_newline_count,
  count(*) FILTER ({ODD} > 0) AS suspicious_control_character_count,
  CAST(coalesce(sum({ODD}), 0) AS BIGINT) AS suspicious_control_character_instances,
  min(length(text)) AS min_string_length, max(length(text)) AS max_string_length"""


def text_rows(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """String columns of documents as fields of records."""
    docs = table(spark, sf_dir, "documents")
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    rows = docs.select(F.col("doc_id").alias("ord"), F.col("source").alias("s"), F.col("lang").alias("l"), each)
    kind = F.when(F.col("text").isNull(), "NoneType").otherwise("str")
    return rows.select("ord", F.col("s").alias("source"), F.col("l").alias("source_file"), F.concat_ws(":", "s", F.col("ord").cast("string")).alias("location"), "field", kind.alias("type"), "text")


def totals(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(*keys).agg(F.count(F.lit(1)).alias("total_records"))


def text_profile_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_rows(spark, sf_dir, "text")
    profiled = audit.measured(rows).groupBy("source").agg(*audit.counters())
    return audit.report(profiled, totals(spark, sf_dir, "source"), ["source"])


def scopes_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.scoped_profile(text_rows(spark, sf_dir, "text"))


def texts_to_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_rows(spark, sf_dir, "text").where(T.strip(F.col("text")) != "")
    return rows.select("ord", "source", "location", T.truncate(F.col("text")).alias("sample"), T.stable_hash(F.col("text")).alias("hash"))


def duplicate_text_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_summary(audit.duplicate_groups(texts_to_hash(spark, sf_dir), ["source"]), ["source"])


def duplicate_samples_first10(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = audit.duplicate_groups(texts_to_hash(spark, sf_dir).withColumn("scope", F.lit("corpus")), ["scope"])
    return audit.duplicate_samples(groups, ["scope"]).select("scope", "hash", "n", "sample", "first_seen_at")


def likely_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_rows(spark, sf_dir, "text", "lang", "source")
    profiled = audit.measured(rows).groupBy("field").agg(*audit.counters())
    return audit.likely_fields(profiled, totals(spark, sf_dir), [])


def schema_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("props is not null")
    names = F.array_join(F.array_sort(F.json_object_keys("props")), ",")
    rows = events.select("event_type", F.col("event_id").alias("ord"), names.alias("names"))
    return audit.schema_variants(rows, ["event_type"]).select("event_type", "names", "n", "first", F.col("place").cast("long"))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events' properties as records, some of them replaced by empty ones and by what is no object."""
    n = F.col("event_id")
    odd = F.when(n % 7 == 0, "{}").when(n % 11 == 0, '{"a":null,"b":" \\t"}').when(n % 13 == 0, "[1]").when(n % 17 == 0, '{"a":0,"b":""}').when(n % 19 == 0, '{"a":[],"b":{}}').when(n % 23 == 0, '""').when(n % 29 == 0, '"[]"')
    events = table(spark, sf_dir, "events").where("props is not null")
    return events.select("event_type", n.alias("ord"), n.cast("string").alias("location"), canonical_json(F.coalesce(odd, "props")).alias("json"))


def record_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.record_counters(raw_records(spark, sf_dir), ["event_type"])


def duplicate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_summary(audit.duplicate_groups(audit.record_hashes(raw_records(spark, sf_dir)), ["event_type"]), ["event_type"])


def value_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("props is not null")
    records = events.select(F.col("event_id").alias("ord"), F.col("event_type").alias("source"), F.lit("props").alias("source_file"), F.col("event_id").cast("string").alias("location"), F.try_parse_json("props").alias("fields"))
    return audit.type_histogram(audit.field_rows(records).where("field is not null"), ["source"])


def entity_and_control_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        html.rlike(T.ENTITY).alias("has_entity"),
        html.rlike(T.ESCAPED_NEWLINE).alias("has_escaped_newline"),
        T.suspicious(html).cast("long").alias("control_characters"),
        F.regexp_count(html, F.lit(T.ENTITY)).cast("long").alias("entities"),
    )


def canonical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as lines of canonical files, one for each source and language: with the text, the language and, on every
    third, a note; some lines are no records."""
    n = F.col("doc_id")
    note = F.when(n % 3 == 0, F.concat(F.lit("a note that stands on many records of "), "lang"))
    fields = F.struct(F.col("text").alias("body"), F.col("lang").alias("tag"), note.alias("note"))
    line = F.to_json(F.struct("source", F.col("lang").alias("source_file"), n.alias("source_row"), fields.alias("fields")), {"ignoreNullFields": "false"})
    odd = F.when(n % 11 == 0, "{bad").when(n % 13 == 0, "  ").when(n % 17 == 0, "[1]")
    return table(spark, sf_dir, "documents").select("source", F.concat("lang", F.lit(".jsonl")).alias("source_file"), n.alias("line"), F.coalesce(odd, line).alias("text"))


def merged_states(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return audit.states(publish.kept(audit.facts(canonical_lines(spark, sf_dir)), "facts"))[name]


def merged_likely_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate texts of likely fields in every scope, from states by file."""
    return merged_states(spark, sf_dir, "texts")


def merged_duplicate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of repeated records that were seen first, in every scope."""
    return merged_states(spark, sf_dir, "raw_shown").select(*audit.SCOPE, "count", "first_seen_at")


def merged_rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rejected lines of every scope."""
    return merged_states(spark, sf_dir, "rejected_shown").select(*audit.SCOPE, F.col("place").cast("long").alias("place"), "file", "line_number", "error", "line_excerpt")


QUERIES = {
    "audit_text_profile_by_source": text_profile_by_source,
    "audit_scopes_grouping_sets": scopes_grouping_sets,
    "audit_duplicate_text_by_source": duplicate_text_by_source,
    "audit_duplicate_samples_first10": duplicate_samples_first10,
    "audit_likely_fields": likely_fields,
    "audit_schema_variants": schema_variants,
    "audit_value_types": value_types,
    "audit_record_counters": record_counters,
    "audit_duplicate_records": duplicate_records,
    "audit_entity_and_control_flags": entity_and_control_flags,
    "audit_merged_likely_duplicates": merged_likely_duplicates,
    "audit_merged_duplicate_samples": merged_duplicate_samples,
    "audit_merged_rejected_lines": merged_rejected_lines,
}

RAW = "CASE " + " ".join(f"WHEN event_id % {n} = 0 THEN '{n}'" for n in (7, 11, 13, 17, 19, 23, 29)) + " END"
SAMPLE = "CASE WHEN length(text) > 160 THEN substr(text, 1, 160) || '...' ELSE text END"
#: Lines of documents as records, and each row once for every scope that it belongs to.
SCOPED = """
l AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'bad' WHEN doc_id % 13 = 0 THEN 'blank' WHEN doc_id % 17 = 0 THEN 'list' END AS odd,
  CASE WHEN doc_id % 3 = 0 THEN 'a note that stands on many records of ' || lang END AS note FROM documents),
s AS (SELECT l.*, scope, CASE WHEN scope > 0 THEN source ELSE '' END AS of_source, CASE WHEN scope > 1 THEN lang || '.jsonl' ELSE '' END AS of_file FROM l, (VALUES (0), (1), (2)) AS k(scope))"""
ORACLES = {
    "audit_merged_likely_duplicates": f"""
WITH {SCOPED},
f AS (SELECT scope, of_source, of_file, unnest(['body', 'tag', 'note']) AS field, unnest([text, lang, note]) AS text FROM s WHERE odd IS NULL),
n AS (SELECT scope, of_source, of_file, count(*) AS total FROM s WHERE odd IS NULL GROUP BY ALL),
p AS (SELECT scope, of_source, of_file, field FROM (SELECT scope, of_source, of_file, field, count(*) FILTER ({STRIPPED} <> '') AS ne, sum(length(text)) AS size, count(text) AS c FROM f GROUP BY ALL)
  JOIN n USING (scope, of_source, of_file) WHERE ne > 0 AND ne / total >= 0.05 AND size / c >= 20),
g AS (SELECT scope, of_source, of_file, field, text, count(*) AS c FROM f WHERE {STRIPPED} <> '' GROUP BY ALL HAVING c > 1)
SELECT scope, of_source AS source, of_file AS source_file, field, count(*) AS duplicate_groups, CAST(sum(c - 1) AS BIGINT) AS duplicate_occurrences
FROM g JOIN p USING (scope, of_source, of_file, field) GROUP BY ALL""",
    "audit_merged_duplicate_samples": f"""
WITH {SCOPED},
g AS (SELECT scope, of_source, of_file, text, lang, note, count(*) AS count, min((source, lang || '.jsonl', doc_id)) AS first, arg_min(source || '/' || lang || ':' || doc_id, (source, lang || '.jsonl', doc_id)) AS first_seen_at
  FROM s WHERE odd IS NULL GROUP BY ALL HAVING count > 1)
SELECT scope, of_source AS source, of_file AS source_file, count, first_seen_at FROM (SELECT *, row_number() OVER (PARTITION BY scope, of_source, of_file ORDER BY first) AS place FROM g) WHERE place <= 10""",
    "audit_merged_rejected_lines": f"""
WITH {SCOPED}
SELECT scope, of_source AS source, of_file AS source_file, place, r.source || '/' || lang || '.jsonl' AS file, doc_id AS line_number,
  CASE odd WHEN 'bad' THEN 'Expecting property name enclosed in double quotes' WHEN 'blank' THEN 'Blank line' ELSE 'Canonical record is not a JSON object' END AS error,
  CASE odd WHEN 'bad' THEN '{{bad' WHEN 'blank' THEN '' ELSE '[1]' END AS line_excerpt
FROM (SELECT *, row_number() OVER (PARTITION BY scope, of_source, of_file ORDER BY source, lang || '.jsonl', doc_id) AS place FROM s WHERE odd IS NOT NULL) r WHERE place <= 10""",
    "audit_text_profile_by_source": f"""
SELECT source, {SQL_COUNTERS}, CAST(0 AS BIGINT) AS missing_count,
  round(count(*) FILTER ({STRIPPED} <> '') / count(*), 4) AS non_empty_string_ratio,
  round(coalesce(sum(length(text)), 0) / greatest(count(text), 1), 2) AS average_string_length
FROM documents GROUP BY source""",
    "audit_scopes_grouping_sets": f"""
SELECT source, lang AS source_file, 'text' AS field, CAST(2 - grouping(source) - grouping(lang) AS INTEGER) AS scope, {SQL_COUNTERS}
FROM documents GROUP BY GROUPING SETS ((), (source), (source, lang))""",
    "audit_duplicate_text_by_source": f"""
SELECT source, count(*) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS duplicate_occurrences
FROM (SELECT source, sha256(text) AS h, count(*) AS n FROM documents WHERE {STRIPPED} <> '' GROUP BY source, h HAVING n > 1) GROUP BY source""",
    "audit_duplicate_samples_first10": f"""
SELECT 'corpus' AS scope, hash, n, sample, first_seen_at FROM (
  SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first, arg_min({SAMPLE}, doc_id) AS sample, arg_min(source || ':' || doc_id, doc_id) AS first_seen_at
  FROM documents WHERE {STRIPPED} <> '' GROUP BY hash HAVING n > 1 ORDER BY first LIMIT 10)""",
    "audit_likely_fields": f"""
WITH f AS (SELECT unnest(['text', 'lang', 'source']) AS field, unnest([text, lang, source]) AS text FROM documents),
p AS (SELECT field, count(*) FILTER ({STRIPPED} <> '') AS ne, sum(length(text)) AS total, count(text) AS s FROM f GROUP BY field),
c AS (SELECT *, ne / (SELECT count(*) FROM documents) AS coverage, total / s AS average FROM p WHERE ne > 0)
SELECT field, round(coverage, 4) AS coverage_ratio, ne AS non_empty_string_count, round(average, 2) AS average_string_length,
  round(coverage * 0.65 + least(average / 500, 1.0) * 0.35, 4) AS candidate_score
FROM c WHERE coverage >= 0.05 AND average >= 20""",
    "audit_schema_variants": """
WITH v AS (SELECT event_type, array_to_string(list_sort(json_keys(props)), ',') AS names, count(*) AS n, min(event_id) AS first FROM events WHERE props IS NOT NULL GROUP BY 1, 2)
SELECT event_type, names, n, first, place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, first) AS place FROM v) WHERE place <= 10""",
    "audit_value_types": """
WITH k AS (SELECT event_type, props, unnest(json_keys(props)) AS field FROM events WHERE props IS NOT NULL),
t AS (SELECT event_type, field, json_type(json_extract(props, '$."' || field || '"')) AS j FROM k)
SELECT event_type AS source, field, CASE j WHEN 'VARCHAR' THEN 'str' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float'
  WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'NoneType' WHEN 'ARRAY' THEN 'list' ELSE 'dict' END AS type, count(*) AS n
FROM t GROUP BY ALL""",
    "audit_record_counters": f"""
WITH r AS (SELECT event_type, {RAW} AS kind FROM events WHERE props IS NOT NULL)
SELECT event_type, count(*) AS total_records, count(*) FILTER (kind IN ('7', '11', '19', '23')) AS empty_records, count(*) FILTER (kind IN ('13', '23', '29')) AS non_object_records
FROM r GROUP BY event_type""",
    "audit_duplicate_records": f"""
SELECT event_type, count(*) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS duplicate_occurrences
FROM (SELECT event_type, {RAW} AS kind, CASE WHEN {RAW} IS NULL THEN props END AS own, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY ALL HAVING n > 1) GROUP BY event_type""",
    "audit_entity_and_control_flags": rf"""
SELECT page_id, regexp_matches(html, {ENTITY}) AS has_entity, regexp_matches(html, '\\r\\n|\\n|\\r') AS has_escaped_newline,
  {ODD.replace("text", "html")} AS control_characters, len(regexp_extract_all(html, {ENTITY})) AS entities
FROM pages""",
}
