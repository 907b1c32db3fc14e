"""Inputs of the queries, as DataFrames and as SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql as S
from ..functions import text as T
from ..operators import cleanup, layout
from ..session import latest, table

#: Lines of a page of the word fixture, and how words stand off their line.
PAGE_LINES, JITTER = 40, [0.0, 1.0, 2.9, 3.1]


def elements(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.elements_of(table(spark, d, "document_elements"))


def with_contents(elements: DataFrame) -> DataFrame:
    """The elements and, as page 0 of each file, a contents page: a line with the page for each heading of the file."""
    lines = elements.where((F.col("element_type") == "HEADING") & (T.strip(F.col("text")) != ""))
    entry = F.concat(F.col("text"), F.lit(" . . "), F.col("page_number").cast("string"))
    return elements.unionByName(lines.withColumns({"element_id": F.concat(F.lit("contents:"), "element_id"), "text": entry, "page_number": F.lit(0), "element_type": F.lit("PROSE")}))


def evidence(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    columns = columns or ("source_file", "page_number", "evidence_type", "text", "section_heading", "table_caption", "row_label", "column_label", "number_hints", "unit_hint", "time_hint", "entity_hint")
    return latest(table(spark, d, "evidence_units").select("evidence_id", *columns, "loaded_at"), "evidence_id").drop("loaded_at")


def facts(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "canonical_facts"), "fact_id").drop("loaded_at", "extracted_at")


def raw_tables(spark: SparkSession, d: str) -> DataFrame:
    return layout.raw_tables(table(spark, d, "structured_tables"))


def row_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of table rows with the columns of evidence units; captions and headings are not set by the extractor."""
    none = F.lit(None).cast("string")
    return layout.table_row_evidence(raw_tables(spark, d)).withColumns({"section_heading": none, "table_caption": none, "entity_hint": none}).dropDuplicates(["evidence_id"])


def words(spark: SparkSession, d: str) -> DataFrame:
    """Words of the documents' lines on a grid, with some heights off: 40 lines a page, 12 points apart."""
    lines = layout.split_lines(table(spark, d, "documents")).where("text <> ''")
    one = lines.select("doc_id", "line_no", F.posexplode(F.split("text", " ")).alias("w", "text"))
    place = F.col("line_no") - 1
    jitter = F.get(F.array(*[F.lit(j) for j in JITTER]), F.col("w") % len(JITTER))
    out = one.select(F.concat(F.lit("doc_"), "doc_id", F.lit(".pdf")).alias("source_file"), (F.floor(place / PAGE_LINES) + 1).cast("int").alias("page_number"), "line_no", (place % PAGE_LINES * 1_000_000 + F.col("w")).cast("bigint").alias("ord"), (10.0 * F.col("w")).alias("x0"), (12.0 * (place % PAGE_LINES) + jitter).alias("y0"), "text")
    return out.withColumn("x1", F.col("x0") + 8.0).withColumn("y1", F.col("y0") + 10.0)


ELEMENTS = """
elements AS (
    SELECT element_id, coalesce(source_file, '') AS source_file, page_number, coalesce(element_type, 'PROSE') AS element_type,
        coalesce(text, '') AS text, heading, "table" AS tab, evidence_ids, coalesce(top, 0) AS top
    FROM document_elements WHERE element_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY element_id ORDER BY loaded_at DESC NULLS LAST, source_file DESC NULLS LAST, page_number DESC, text DESC NULLS LAST) = 1)"""

CONTENTS = f"""
with_contents AS (
    SELECT source_file, page_number, text FROM elements
    UNION ALL SELECT source_file, 0, text || ' . . ' || page_number FROM elements WHERE element_type = 'HEADING' AND {S.strip("text")} <> '')"""

EVIDENCE = """
evidence AS (
    SELECT * EXCLUDE (loaded_at, embedding) FROM evidence_units WHERE evidence_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY loaded_at DESC NULLS LAST, source_file DESC NULLS LAST, page_number DESC, text DESC NULLS LAST) = 1)"""

FACTS = """
facts AS (
    SELECT * EXCLUDE (loaded_at, extracted_at) FROM canonical_facts WHERE fact_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY loaded_at DESC NULLS LAST, entity DESC NULLS LAST, attribute DESC NULLS LAST, raw_value DESC NULLS LAST) = 1)"""

RAW_TABLES = r"""
raw_tables AS (
    SELECT table_id, source_file, page_number, coalesce(try_cast(nullif(regexp_extract(table_id, '(\d+)$', 1), '') AS INT), 1) AS table_index, caption, unit,
        list_concat([coalesce(headers, []::VARCHAR[])], coalesce(rows, []::VARCHAR[][])) AS raw, bbox
    FROM structured_tables WHERE table_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY loaded_at DESC NULLS LAST, source_file DESC NULLS LAST, page_number DESC) = 1)"""

CLEANED = f"""{RAW_TABLES},
cleaned AS (
    SELECT * FROM (SELECT *, list_filter(list_transform(list_filter(raw, lambda r: r IS NOT NULL), lambda r: list_transform(r, lambda c: {S.collapse("c")})), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS rs FROM raw_tables)
    WHERE len(rs) > 0)"""

SPLIT = f"""{CLEANED},
split AS (
    SELECT *, CASE WHEN head THEN rs[1] ELSE []::VARCHAR[] END AS headers, CASE WHEN head THEN rs[2:] ELSE rs END AS body
    FROM (SELECT *, len(rs) > 1 AND len(list_filter(rs[1], lambda c: c <> '')) >= 2 AS head FROM cleaned))"""

ROW_EVIDENCE = f"""{CLEANED},
body AS (
    SELECT source_file, page_number, table_index, rs[1] AS h, unnest(rs[2:]) AS v, generate_subscripts(rs[2:], 1) AS j FROM cleaned WHERE len(rs) > 1),
bearing AS (
    SELECT *, 'Table ' || table_index || '; row ' || j || '; ' || array_to_string(list_filter(list_transform(v, lambda x, i: CASE WHEN x <> '' THEN (CASE WHEN coalesce(h[i], '') <> '' THEN h[i] ELSE 'column_' || i END) || '=' || x END), lambda x: x IS NOT NULL), '; ') AS text
    FROM (SELECT *, array_to_string(list_concat(h, v), ' ') AS whole FROM body)
    WHERE NOT {S.claim_noise("whole")} AND (regexp_matches(whole, '[0-9]') OR {S.contains_any("lower(whole)", T.METRIC_TERMS)})),
row_evidence AS (
    SELECT DISTINCT ON (evidence_id) * FROM (
    SELECT substr(sha1(coalesce(source_file, '') || '|' || coalesce(page_number::VARCHAR, '') || '|TABLE_ROW|' || {S.strip("text")}), 1, 16) AS evidence_id, source_file, page_number, 'TABLE_ROW' AS evidence_type, text,
        nullif(v[1], '') AS row_label, {S.number_hints("text")} AS number_hints, {S.hint("text", T.UNIT)} AS unit_hint, {S.hint("text", T.TIME)} AS time_hint
    FROM bearing) ORDER BY evidence_id)"""

LINES = r"""
lines AS (
    SELECT doc_id, generate_subscripts(a, 1) AS line_no, unnest(a) AS raw FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS a FROM documents WHERE text IS NOT NULL))"""

WORDS = f"""{LINES},
words AS (
    SELECT source_file, page_number, line_no, 10.0 * w AS x0, 12.0 * place + [0.0, 1.0, 2.9, 3.1][w % 4 + 1] AS y0, text FROM (
        SELECT 'doc_' || doc_id || '.pdf' AS source_file, (line_no - 1) // {PAGE_LINES} + 1 AS page_number, line_no, (line_no - 1) % {PAGE_LINES} AS place, unnest(a) AS text, generate_subscripts(a, 1) - 1 AS w
        FROM (SELECT doc_id, line_no, string_split(t, ' ') AS a FROM (SELECT doc_id, line_no, {S.collapse("raw")} AS t FROM lines) WHERE t <> '')))"""
