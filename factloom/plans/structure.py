"""Queries of layout, cleanup, filters, hints and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql as S
from ..functions import text as T
from ..operators import cleanup, layout, scoring, tables
from ..session import table
from . import inputs as I

SEP = "¦"


def joined(c: str, sep: str = SEP):
    return F.array_join(c, sep)


def split_lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.split_lines(table(spark, d, "documents"))


def clean_cell_text(spark: SparkSession, d: str) -> DataFrame:
    raw = I.raw_tables(spark, d).select("table_id", F.posexplode("raw").alias("row_index", "r"))
    return raw.select("table_id", "row_index", F.posexplode("r").alias("column_index", "c")).select("table_id", "row_index", "column_index", T.collapse(F.col("c")).alias("text"))


def heading_classify(spark: SparkSession, d: str) -> DataFrame:
    t = T.collapse(F.col("text"))
    return I.elements(spark, d).select("element_id", T.looks_like_heading(t, 0.65).alias("heading_65"), T.looks_like_heading(t, 0.75).alias("heading_75"), T.looks_like_new_block(F.col("text")).alias("new_block"))


def noise_lines(spark: SparkSession, d: str) -> DataFrame:
    return I.elements(spark, d).select("element_id", T.is_noise_line(F.col("text")).alias("noise_line"), T.is_noise_heading(F.col("text")).alias("noise_heading"))


def line_bbox(spark: SparkSession, d: str) -> DataFrame:
    return layout.line_boxes(I.words(spark, d), ["source_file", "page_number", "line_no"])


def assemble_lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.assemble_lines(I.words(spark, d))


def assemble_lines_sorted(spark: SparkSession, d: str) -> DataFrame:
    return layout.assemble_lines(I.words(spark, d), presorted=True)


def text_elements(spark: SparkSession, d: str) -> DataFrame:
    return layout.text_elements(assemble_lines(spark, d))


def merge_claim_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = layout.split_lines(table(spark, d, "documents")).where("text <> ''")
    page = (F.floor((F.col("line_no") - 1) / I.PAGE_LINES) + 1).cast("int")
    return layout.prose_evidence(lines.select(F.concat(F.lit("doc_"), "doc_id", F.lit(".pdf")).alias("source_file"), page.alias("page_number"), "line_no", "text")).drop("row_label")


def exclude_table_boxes(spark: SparkSession, d: str) -> DataFrame:
    lines = I.elements(spark, d).where("element_type <> 'TABLE'").select("element_id", "source_file", "page_number", F.lit(36.0).alias("x0"), F.col("top").alias("y0"), F.lit(559.0).alias("x1"), (F.col("top") + 10.0).alias("y1"))
    return layout.outside_tables(lines, I.raw_tables(spark, d)).select("element_id", "source_file", "page_number", "y0")


def clean_rows(spark: SparkSession, d: str) -> DataFrame:
    r = I.raw_tables(spark, d).select("table_id", F.posexplode(layout.clean_rows(F.col("raw"))).alias("row_index", "r"))
    return r.select("table_id", "row_index", joined("r").alias("cells"))


def split_headers(spark: SparkSession, d: str) -> DataFrame:
    return layout.structured_tables(I.raw_tables(spark, d)).select("table_id", joined("headers").alias("headers"), F.size("headers").alias("n_headers"), F.size("rows").alias("n_rows"))


def table_text(spark: SparkSession, d: str) -> DataFrame:
    t = layout.structured_tables(I.raw_tables(spark, d))
    return t.select("table_id", layout.table_text(F.col("caption"), F.col("unit"), F.col("headers"), F.col("rows")).alias("text"))


def table_row_ids(spark: SparkSession, d: str) -> DataFrame:
    t = layout.structured_tables(I.raw_tables(spark, d))
    return t.select("table_id", F.posexplode("evidence_ids").alias("row_index", "evidence_id"))


def table_row_evidence(spark: SparkSession, d: str) -> DataFrame:
    return I.row_evidence(spark, d).select("evidence_id", "source_file", "page_number", "text", "row_label", joined("number_hints").alias("number_hints"), "unit_hint", "time_hint")


def merge_prose_blocks(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.merge_blocks(I.elements(spark, d)).select("element_id", "source_file", "page_number", "element_type", "text", "top", "n_lines", joined("evidence_ids").alias("evidence_ids"))


def join_lines(spark: SparkSession, d: str) -> DataFrame:
    return merge_prose_blocks(spark, d).where("n_lines > 1").select("element_id", "text", F.length("text").alias("n_chars"))


def toc_lines(spark: SparkSession, d: str) -> DataFrame:
    return I.elements(spark, d).where(T.looks_like_toc_line(F.col("text"))).select("element_id", "text")


def toc_pages(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.toc_pages(I.with_contents(I.elements(spark, d)))


def filter_elements(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.filter_elements(I.elements(spark, d)).select("element_id", "source_file", "page_number", "element_type", "text")


def admin_tables(spark: SparkSession, d: str) -> DataFrame:
    e = I.elements(spark, d).where("element_type = 'TABLE'")
    return e.select("element_id", T.admin_signals(F.col("text")).alias("signals"), cleanup.is_admin_table().alias("admin"))


def low_value_text(spark: SparkSession, d: str) -> DataFrame:
    return I.elements(spark, d).where("element_type <> 'TABLE'").select("element_id", T.is_low_value_heading(F.col("text")).alias("low_heading"), T.is_low_value_prose(F.col("text")).alias("low_prose"))


def number_hints(spark: SparkSession, d: str) -> DataFrame:
    return I.evidence(spark, d, "text").select("evidence_id", joined(T.number_hints(F.col("text"))).alias("number_hints"))


def unit_hint(spark: SparkSession, d: str) -> DataFrame:
    return I.evidence(spark, d, "text").select("evidence_id", T.unit_hint(F.col("text")).alias("unit_hint"))


def time_hint(spark: SparkSession, d: str) -> DataFrame:
    return I.evidence(spark, d, "text").select("evidence_id", T.time_hint(F.col("text")).alias("time_hint"))


def metric_language(spark: SparkSession, d: str) -> DataFrame:
    return I.evidence(spark, d, "text").select("evidence_id", T.has_metric_language(F.col("text")).alias("metric"))


def claims(spark: SparkSession, d: str) -> DataFrame:
    return I.evidence(spark, d, "text").select("evidence_id", T.is_claim_noise(F.col("text")).alias("noise"), T.looks_like_claim(F.col("text")).alias("claim"))


def fact_candidates(spark: SparkSession, d: str) -> DataFrame:
    return scoring.fact_candidates(I.evidence(spark, d)).select("evidence_id", "score")


def parse_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = I.row_evidence(spark, d).select("evidence_id", F.posexplode(tables.pairs_of(F.col("text"))).alias("ord", "p"))
    return e.select("evidence_id", "ord", "p.k", "p.v")


def route_rows(spark: SparkSession, d: str) -> DataFrame:
    return tables.route_rows(I.row_evidence(spark, d))


def reconstruct_tables(spark: SparkSession, d: str) -> DataFrame:
    t = tables.reconstruct_tables(I.row_evidence(spark, d))
    return t.select("source_file", "page_number", "caption", "unit", "table_id", F.size("rows").alias("n_rows"), joined(F.transform("rows", lambda r: r["evidence_id"])).alias("row_ids"), joined(F.flatten(F.transform("rows", lambda r: r["values"]))).alias("row_values"))


def table_headers(spark: SparkSession, d: str) -> DataFrame:
    return tables.reconstruct_tables(I.row_evidence(spark, d)).select("source_file", "page_number", "identity", joined("headers").alias("headers"))


def assess_structure(spark: SparkSession, d: str) -> DataFrame:
    return tables.reconstruct_tables(I.row_evidence(spark, d)).select("source_file", "page_number", "identity", "deterministic", F.round("confidence", 6).alias("confidence"))


def table_facts(spark: SparkSession, d: str) -> DataFrame:
    return tables.table_facts(I.row_evidence(spark, d)).select("fact_id", "entity", "attribute", "raw_value", "unit", "normalized_value", "time", "evidence_id").distinct()


def split_tables(spark: SparkSession, d: str) -> DataFrame:
    t = tables.reconstruct_tables(I.row_evidence(spark, d))
    return tables.split_tables(t, 60).select("table_id", "chunk_no", F.size("evidence_ids").alias("n_rows"), "n_tokens")


def dedup_evidence(spark: SparkSession, d: str) -> DataFrame:
    return scoring.drop_repeats(I.evidence(spark, d)).select("evidence_id")


def low_information(spark: SparkSession, d: str) -> DataFrame:
    return I.evidence(spark, d).select("evidence_id", scoring.is_low_information().alias("low"))


def structural_class(spark: SparkSession, d: str) -> DataFrame:
    return I.evidence(spark, d).select("evidence_id", scoring.structural_class().alias("kind"))


def topic_label(spark: SparkSession, d: str) -> DataFrame:
    e = I.evidence(spark, d).withColumn("source_file", T.text_of("source_file"))
    return scoring.topic_labels(e, ["source_file"])


QUERIES = {f.__name__: f for f in (split_lines, clean_cell_text, heading_classify, noise_lines, line_bbox, assemble_lines, assemble_lines_sorted, text_elements, merge_claim_lines, exclude_table_boxes, clean_rows, split_headers, table_text, table_row_ids, table_row_evidence, merge_prose_blocks, join_lines, toc_lines, toc_pages, filter_elements, admin_tables, low_value_text, number_hints, unit_hint, time_hint, metric_language, claims, fact_candidates, parse_pairs, route_rows, reconstruct_tables, table_headers, assess_structure, table_facts, split_tables, dedup_evidence, low_information, structural_class, topic_label)}

_DROP = f"({S.collapse('text')} = '' OR CASE element_type WHEN 'TABLE' THEN false WHEN 'HEADING' THEN {S.isin(S.norm('text'), T.NOISE_HEADINGS)} ELSE {S.noise_line('text')} END)"
_BLOCKS = f"""{I.ELEMENTS},
kept AS (SELECT *, lag(element_type) OVER w AS bt, lag(top) OVER w AS btop FROM elements WHERE NOT {_DROP} WINDOW w AS (PARTITION BY source_file, page_number ORDER BY top, element_id)),
runs AS (SELECT *, sum(CASE WHEN coalesce(element_type = 'PROSE' AND bt = 'PROSE' AND top - btop BETWEEN 0 AND 12.0 AND NOT {S.new_block("text")}, false) THEN 0 ELSE 1 END) OVER (PARTITION BY source_file, page_number ORDER BY top, element_id) AS block FROM kept),
glued AS (SELECT *, {S.collapse("text")} AS c, lag({S.collapse("text")}) OVER (PARTITION BY source_file, page_number, block ORDER BY top, element_id) AS b FROM runs),
blocks AS (
    SELECT source_file, page_number, first(element_type ORDER BY top, element_id) AS kind, first(element_id ORDER BY top, element_id) AS first_id, first(text ORDER BY top, element_id) AS own,
        string_agg(CASE WHEN b IS NULL OR ends_with(b, '-') OR regexp_matches(c, '^[.,;:)%]') THEN c ELSE ' ' || c END, '' ORDER BY top, element_id) AS merged, min(top) AS top, count(*) AS n_lines,
        flatten(list(coalesce(evidence_ids, []) ORDER BY top, element_id)) AS ids
    FROM glued GROUP BY source_file, page_number, block)"""
_BLOCK_ROWS = """SELECT CASE WHEN kind = 'PROSE' THEN concat_ws(':', source_file, page_number) || ':merged:' || first_id ELSE first_id END AS element_id, source_file, page_number, kind AS element_type,
    CASE WHEN kind = 'PROSE' THEN merged ELSE own END AS text, top, n_lines, array_to_string(list_transform(list_filter(list_transform(ids, lambda x, i: {'x': x, 'i': i}), lambda s: list_position(ids, s.x) = s.i), lambda s: s.x), '¦') AS evidence_ids FROM blocks"""

_TOC = f"""{I.ELEMENTS},
toc AS (
    SELECT source_file, page_number, count(*) AS n_texts, count(*) FILTER ({S.toc_line("text")}) AS n_toc, bool_or(contains(lower(text), 'contents')) AS named
    FROM elements WHERE {S.strip("text")} <> '' GROUP BY ALL HAVING n_texts >= 4 AND (named OR n_toc / n_texts >= 0.55))"""
_ADMIN_SIGNALS = "(" + " + ".join(f"contains({S.norm('text')}, {S.q(s)})::INT" for s in T.ADMIN_SIGNALS) + ")"
_ADMIN = f"(tab IS NOT NULL AND {_ADMIN_SIGNALS} >= 2 AND len(list_filter(coalesce(tab.rows, []), lambda r: len(list_filter(r, lambda c: regexp_matches(regexp_replace(c, '[,.\\- ]', '', 'g'), '^\\p{{Nd}}{{2,}}$'))) > 0)) <= 1)"
_LOW_HEADING = f"({S.isin(S.norm('text'), T.LOW_HEADINGS)} OR {S.contains_any(S.norm('text'), T.LOW_HEADING_PHRASES)})"
_LOW_PROSE = f"({S.contains_any(S.norm('text'), T.LOW_PROSE_PHRASES)} OR length({S.collapse('text')}) < 18)"

_T, _LOW = S.strip("text"), "lower(coalesce(text, ''))"
_NUMBER = "coalesce(len(number_hints) > 0, false)"
_SCORE = f"""CASE WHEN {_T} = '' THEN 0 ELSE (CASE WHEN {_NUMBER} THEN 3 ELSE 0 END) + (CASE WHEN coalesce(unit_hint, '') <> '' THEN 3 ELSE 0 END) + (CASE WHEN coalesce(time_hint, '') <> '' THEN 2 ELSE 0 END)
    + (CASE WHEN coalesce(entity_hint, '') <> '' THEN 2 ELSE 0 END) + (CASE WHEN evidence_type = 'TABLE_ROW' THEN 3 ELSE 0 END) + (CASE WHEN {S.contains_any(_LOW, T.CANDIDATE_METRICS)} THEN 2 ELSE 0 END)
    + (CASE WHEN {_NUMBER} AND length({_T}) >= 40 THEN 1 ELSE 0 END) - (CASE WHEN length({_T}) < 20 THEN 3 ELSE 0 END) - (CASE WHEN {S.contains_any(f"lower({_T})", T.METADATA)} THEN 5 ELSE 0 END) END"""

_ALL = {s: "(" + " OR ".join(f"contains(lower(p.k), {S.q(t)})" for t in terms) + ")" for s, terms in {"route_period": tables.ROUTE_PERIODS, "table_period": tables.TABLE_PERIODS, "fact_period": tables.FACT_PERIODS, "percent": tables.PERCENT_COLUMNS, "unit": tables.UNIT_COLUMNS, "units": [*tables.UNIT_COLUMNS, "units"], "yoy": [*tables.PERCENT_COLUMNS, "yoy"]}.items()}
_NUM = r"'^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$'"
_PAIRS = f"""{I.ROW_EVIDENCE},
paired AS (
    SELECT *, list_filter(list_transform(list_filter(string_split(text, ';'), lambda s: contains(s, '=')), lambda s: {{'k': {S.strip("split_part(s, '=', 1)")}, 'v': {S.strip("regexp_replace(s, '^[^=]*=', '')")}}}), lambda p: p.k <> '' AND p.v <> '') AS pairs
    FROM row_evidence)"""
_VALUE = f"(regexp_matches({S.strip("translate(p.v, ',₹%()-', '')")}, {_NUM}) OR lower({S.strip("translate(p.v, ',₹%()-', '')")}) IN ('yes', 'no', 'nil', 'none', 'n.a.', 'na', 'n/a'))"


def _bare(strip_percent: str, negative: str) -> str:
    c = f"translate({S.strip('p.v')}, ',₹{strip_percent}', '')"
    return f"(CASE WHEN starts_with({c}, '(') AND ends_with({c}, ')') THEN '{negative}' || substr({c}, 2, length({c}) - 2) ELSE {c} END)"


_NONE = "('', '-', '—', 'na', 'n.a.', 'n/a')"
_TABLE_NUMERIC = f"({_bare('%', '')} NOT IN {_NONE} AND regexp_matches({S.strip(_bare('%', ''))}, {_NUM}))"
_FACT_NUMBER = S.strip(f"replace({_bare('', '-')}, '%', '')")
_FACT_NUMERIC = f"({_FACT_NUMBER} NOT IN {_NONE} AND regexp_matches({_FACT_NUMBER}, {_NUM}))"
_META = f"(starts_with({S.strip('lower(p.k)')}, 'column_') OR {S.strip('lower(p.k)')} IN ('table', 'row', 's. no.', 's.no.', 'serial'))"
_FACT_META = f"({S.strip('lower(p.k)')} IN ('table', 'row', 'column', 's. no.', 's.no.', 'serial', 'no.'))"
_REBUILT = f"""{_PAIRS},
labelled AS (
    SELECT *, CASE WHEN starts_with(seg, 'table ') THEN seg WHEN seg <> '' THEN seg ELSE 'unknown-table' END AS identity,
        coalesce(nullif(row_label, ''), list_filter(pairs, lambda p: NOT {_TABLE_NUMERIC} AND NOT {_META} AND NOT {_ALL["table_period"]} AND NOT {_ALL["units"]})[1].v) AS label
    FROM (SELECT *, {S.strip(f"split_part({S.norm('text')}, ';', 1)")} AS seg FROM paired)),
valued AS (
    SELECT *, list_filter(pairs, lambda p: NOT coalesce(p.v = label, false) AND NOT {_META}) AS kept, list_filter(pairs, lambda p: {_ALL["table_period"]} OR {_ALL["yoy"]} OR regexp_matches(lower(p.k), '^column_(?:[1-9]|1[0-5])$')) AS hk,
        coalesce(nullif(unit_hint, ''), list_filter(pairs, lambda p: {_ALL["units"]})[1].k) AS u FROM labelled),
tabs AS (
    SELECT source_file, page_number, identity, list(evidence_id ORDER BY evidence_id) AS row_ids, flatten(list(list_transform(kept, lambda p: p.k || '=' || p.v) ORDER BY evidence_id)) AS vals,
        flatten(list(list_transform(hk, lambda p: p.k) ORDER BY evidence_id)) AS hs, first(u ORDER BY evidence_id) FILTER (u IS NOT NULL) AS unit, count(*) AS n_rows, count(*) FILTER (len(kept) > 0) AS n_valued,
        coalesce(avg(len(list_filter(kept, lambda p: {_TABLE_NUMERIC})) / len(kept)) FILTER (len(kept) > 0), 0) AS ratio
    FROM valued GROUP BY source_file, page_number, identity),
rebuilt AS (
    SELECT *, list_filter(hs, lambda x, i: list_position(hs, x) = i) AS headers, CASE WHEN identity <> 'unknown-table' THEN identity END AS caption, printf('table-%05d', row_number() OVER (ORDER BY source_file NULLS FIRST, page_number NULLS FIRST, identity)) AS table_id FROM tabs),
assessed AS (
    SELECT *, n_valued > 0 AND (len(headers) >= 2 AND ratio >= 0.5 OR unit IS NOT NULL AND ratio >= 0.6) AS deterministic,
        CASE WHEN n_valued = 0 THEN 0.95 WHEN len(headers) >= 2 AND ratio >= 0.5 THEN least(0.99, 0.70 + 0.15 * least(len(headers), 2) + 0.10 * ratio) WHEN unit IS NOT NULL AND ratio >= 0.6 THEN 0.82 ELSE 0.65 END AS confidence
    FROM rebuilt)"""

SQL = {
    "split_lines": f"WITH {I.LINES} SELECT doc_id, line_no, {S.collapse('raw')} AS text FROM lines",
    "clean_cell_text": f"""WITH {I.RAW_TABLES}, rs AS (SELECT table_id, unnest(raw) AS r, generate_subscripts(raw, 1) - 1 AS row_index FROM raw_tables)
        SELECT table_id, row_index, column_index, {S.collapse("c")} AS text FROM (SELECT table_id, row_index, unnest(r) AS c, generate_subscripts(r, 1) - 1 AS column_index FROM rs)""",
    "heading_classify": f"WITH {I.ELEMENTS} SELECT element_id, {S.heading('t', 0.65)} AS heading_65, {S.heading('t', 0.75)} AS heading_75, {S.new_block('text')} AS new_block FROM (SELECT *, {S.collapse('text')} AS t FROM elements)",
    "noise_lines": f"WITH {I.ELEMENTS} SELECT element_id, {S.noise_line('text')} AS noise_line, {S.isin(S.norm('text'), T.NOISE_HEADINGS)} AS noise_heading FROM elements",
    "line_bbox": f"WITH {I.WORDS} SELECT source_file, page_number, line_no, min(x0) AS x0, min(y0) AS y0, max(x0 + 8.0) AS x1, max(y0 + 10.0) AS y1 FROM words GROUP BY ALL",
    "exclude_table_boxes": f"""WITH {I.ELEMENTS}, {I.RAW_TABLES} SELECT element_id, source_file, page_number, top AS y0 FROM elements e WHERE element_type <> 'TABLE' AND NOT EXISTS (
        SELECT 1 FROM raw_tables b WHERE b.source_file = e.source_file AND b.page_number = e.page_number AND len(bbox) >= 4 AND greatest(36.0, bbox[1]) < least(559.0, bbox[3]) AND greatest(e.top, bbox[2]) < least(e.top + 10.0, bbox[4]))""",
    "clean_rows": f"WITH {I.CLEANED} SELECT table_id, generate_subscripts(rs, 1) - 1 AS row_index, array_to_string(unnest(rs), '¦') AS cells FROM cleaned",
    "split_headers": f"WITH {I.SPLIT} SELECT table_id, array_to_string(headers, '¦') AS headers, len(headers) AS n_headers, len(body) AS n_rows FROM split",
    "table_text": f"""WITH {I.SPLIT} SELECT table_id, array_to_string(list_concat(list_filter(['[TABLE]', CASE WHEN coalesce(caption, '') <> '' THEN 'Caption: ' || caption END, CASE WHEN coalesce(unit, '') <> '' THEN 'Unit: ' || unit END,
        CASE WHEN len(headers) > 0 THEN 'Headers: ' || array_to_string(headers, ' | ') END], lambda x: x IS NOT NULL), list_transform(body, lambda r: array_to_string(r, ' | '))), chr(10)) AS text FROM split""",
    "table_row_ids": f"""WITH {I.SPLIT}, r AS (SELECT table_id, source_file, page_number, table_index, unnest(body) AS row, generate_subscripts(body, 1) AS i FROM split)
        SELECT table_id, i - 1 AS row_index, substr(sha1(coalesce(source_file, '') || '|' || coalesce(page_number::VARCHAR, '') || '|' || table_index || '|' || i || '|' || array_to_string(row, '|')), 1, 16) AS evidence_id FROM r""",
    "table_row_evidence": f"WITH {I.ROW_EVIDENCE} SELECT evidence_id, source_file, page_number, text, row_label, array_to_string(number_hints, '¦') AS number_hints, unit_hint, time_hint FROM row_evidence",
    "merge_prose_blocks": f"WITH {_BLOCKS} {_BLOCK_ROWS}",
    "join_lines": f"WITH {_BLOCKS} SELECT element_id, text, length(text) AS n_chars FROM ({_BLOCK_ROWS}) WHERE n_lines > 1",
    "toc_lines": f"WITH {I.ELEMENTS} SELECT element_id, text FROM elements WHERE {S.toc_line('text')}",
    "toc_pages": f"""WITH {I.ELEMENTS}, {I.CONTENTS}
        SELECT source_file, page_number, count(*) AS n_texts, count(*) FILTER ({S.toc_line("text")}) AS n_toc FROM with_contents WHERE {S.strip("text")} <> ''
        GROUP BY ALL HAVING n_texts >= 4 AND (bool_or(contains(lower(text), 'contents')) OR n_toc / n_texts >= 0.55)""",
    "filter_elements": f"""WITH {_TOC} SELECT element_id, source_file, page_number, element_type, text FROM elements e WHERE NOT EXISTS (SELECT 1 FROM toc t WHERE t.source_file = e.source_file AND t.page_number = e.page_number)
        AND {S.collapse("text")} <> '' AND NOT CASE element_type WHEN 'TABLE' THEN {_ADMIN} WHEN 'HEADING' THEN {_LOW_HEADING} ELSE {_LOW_PROSE} END""",
    "admin_tables": f"WITH {I.ELEMENTS} SELECT element_id, {_ADMIN_SIGNALS} AS signals, {_ADMIN} AS admin FROM elements WHERE element_type = 'TABLE'",
    "low_value_text": f"WITH {I.ELEMENTS} SELECT element_id, {_LOW_HEADING} AS low_heading, {_LOW_PROSE} AS low_prose FROM elements WHERE element_type <> 'TABLE'",
    "number_hints": f"WITH {I.EVIDENCE} SELECT evidence_id, array_to_string({S.number_hints('text')}, '¦') AS number_hints FROM evidence",
    "unit_hint": f"WITH {I.EVIDENCE} SELECT evidence_id, {S.hint('text', T.UNIT)} AS unit_hint FROM evidence",
    "time_hint": f"WITH {I.EVIDENCE} SELECT evidence_id, {S.hint('text', T.TIME)} AS time_hint FROM evidence",
    "metric_language": f"WITH {I.EVIDENCE} SELECT evidence_id, {S.contains_any(_LOW, T.METRIC_TERMS)} AS metric FROM evidence",
    "claims": f"WITH {I.EVIDENCE} SELECT evidence_id, {S.claim_noise('text')} AS noise, {S.claim('text')} AS claim FROM evidence",
    "fact_candidates": f"WITH {I.EVIDENCE} SELECT * FROM (SELECT evidence_id, {_SCORE} AS score FROM evidence) WHERE score >= 5",
    "parse_pairs": f"WITH {_PAIRS} SELECT evidence_id, ord, p.k AS k, p.v AS v FROM (SELECT evidence_id, unnest(pairs) AS p, generate_subscripts(pairs, 1) - 1 AS ord FROM paired)",
    "route_rows": f"""WITH {_PAIRS}, c AS (SELECT evidence_id, len(pairs) AS n, len(list_filter(pairs, lambda p: {_VALUE})) AS nv, len(list_filter(pairs, lambda p: lower(p.k) IN ('s. no.', 's.no.', 'no.', 'serial', 'sr. no.') AND NOT ({_ALL["route_period"]} OR {_ALL["percent"]} OR {_ALL["units"]}))) AS ns FROM paired)
        SELECT evidence_id, CASE WHEN n >= 2 AND nv >= 2 AND nv / n >= 0.5 THEN 'DETERMINISTIC' ELSE 'LLM' END AS decision,
            CASE WHEN n < 2 THEN 0.95 WHEN nv < 1 THEN 0.90 WHEN nv >= 2 AND nv / n >= 0.5 THEN least(0.99, round(0.75 + 0.05 * nv, 4)) WHEN ns > n // 2 THEN 0.85 ELSE 0.70 END::DOUBLE AS confidence,
            CASE WHEN n < 2 THEN {S.q(tables.FEW_PAIRS)} WHEN nv < 1 THEN {S.q(tables.NO_VALUE_COLUMNS)} WHEN nv >= 2 AND nv / n >= 0.5 THEN {S.q(tables.REGULAR_ROW)} WHEN ns > n // 2 THEN {S.q(tables.STRUCTURAL)} ELSE {S.q(tables.AMBIGUOUS)} END AS reason FROM c""",
    "reconstruct_tables": f"WITH {_REBUILT} SELECT source_file, page_number, caption, unit, table_id, n_rows, array_to_string(row_ids, '¦') AS row_ids, array_to_string(vals, '¦') AS row_values FROM rebuilt",
    "table_headers": f"WITH {_REBUILT} SELECT source_file, page_number, identity, array_to_string(headers, '¦') AS headers FROM rebuilt",
    "assess_structure": f"WITH {_REBUILT} SELECT source_file, page_number, identity, deterministic, round(confidence::DOUBLE, 6) AS confidence FROM assessed",
    "table_facts": f"""WITH {_PAIRS}, f AS (SELECT *, list_filter(pairs, lambda p: NOT {_FACT_NUMERIC} AND NOT {_FACT_META} AND NOT {_ALL["fact_period"]} AND NOT {_ALL["unit"]})[1].v AS attribute, list_filter(pairs, lambda p: {_ALL["unit"]})[1].k AS unit FROM paired WHERE len(pairs) >= 2),
        x AS (SELECT evidence_id, attribute, unit, unnest(pairs) AS p FROM f WHERE attribute IS NOT NULL)
        SELECT DISTINCT substr(sha1(evidence_id || '|' || p.k || '|' || p.v), 1, 16) AS fact_id, 'UNKNOWN' AS entity, attribute, p.v AS raw_value, unit, try_cast({_FACT_NUMBER} AS DOUBLE) AS normalized_value, p.k AS time, evidence_id
        FROM x WHERE p.k <> attribute AND {_FACT_NUMERIC} AND NOT {_FACT_META}""",
    "dedup_evidence": f"""WITH {I.EVIDENCE} SELECT evidence_id FROM evidence QUALIFY row_number() OVER (PARTITION BY {S.norm("text")}, evidence_type, {S.norm("section_heading")}, {S.norm("table_caption")}, {S.norm("row_label")}, {S.norm("column_label")}, source_file, page_number ORDER BY evidence_id) = 1""",
    "low_information": f"""WITH {I.EVIDENCE} SELECT evidence_id, t = '' OR contains(t, 'annual report') AND length(t) < 120 OR contains(t, 'cin:') AND length(t) < 250 OR contains(t, 'all amounts in indian rupees') AND length(t) < 250 OR coalesce(evidence_type, '') = 'TABLE_ROW' AND length(t) < 20 AS low FROM (SELECT *, {S.norm("text")} AS t FROM evidence)""",
    "structural_class": f"WITH {I.EVIDENCE} SELECT evidence_id, CASE WHEN evidence_type = 'HEADING' THEN 'heading' WHEN {_NUMBER} AND (coalesce(unit_hint, '') <> '' OR coalesce(time_hint, '') <> '') THEN 'quantitative' WHEN {_NUMBER} THEN 'numeric' WHEN evidence_type = 'TABLE_ROW' THEN 'table' ELSE 'prose' END AS kind FROM evidence",
    "topic_label": f"""WITH {I.EVIDENCE}, m AS (SELECT *, coalesce(source_file, '') AS f, row_number() OVER (PARTITION BY coalesce(source_file, '') ORDER BY page_number NULLS FIRST, evidence_id) AS pos FROM evidence),
        heads AS (SELECT f, section_heading, count(*) AS n, min(pos) AS p FROM m WHERE coalesce(section_heading, '') <> '' GROUP BY ALL),
        best AS (SELECT f, section_heading AS h FROM heads QUALIFY row_number() OVER (PARTITION BY f ORDER BY n DESC, p) = 1)
        SELECT f AS source_file, coalesce(any_value(h), first(table_caption ORDER BY pos) FILTER (coalesce(table_caption, '') <> ''), first(left(coalesce(text, ''), 100) ORDER BY pos)) AS topic_label FROM m LEFT JOIN best USING (f) GROUP BY f""",
}
SQL["split_tables"] = f"""WITH RECURSIVE {_REBUILT},
    head AS (SELECT source_file, page_number, identity, table_id, greatest(1, length(array_to_string(list_filter(list_concat([caption, unit], headers), lambda x: coalesce(x, '') <> ''), ' ')) // 4) AS base FROM assessed WHERE NOT deterministic),
    rws AS MATERIALIZED (SELECT table_id, base, row_number() OVER (PARTITION BY table_id ORDER BY evidence_id) AS pos,
        greatest(1, length(array_to_string(list_concat([coalesce(label, '')], list_transform(kept, lambda p: p.k || '=' || p.v)), ' ')) // 4) AS cost
        FROM valued v JOIN head h ON h.source_file IS NOT DISTINCT FROM v.source_file AND h.page_number IS NOT DISTINCT FROM v.page_number AND h.identity = v.identity),
    walk(table_id, pos, cost, chunk_no, held, base) AS (
        SELECT table_id, pos, cost, 0, base + cost, base FROM rws WHERE pos = 1
        UNION ALL SELECT r.table_id, r.pos, r.cost, CASE WHEN w.held + r.cost > 60 THEN w.chunk_no + 1 ELSE w.chunk_no END, CASE WHEN w.held + r.cost > 60 THEN r.base + r.cost ELSE w.held + r.cost END, r.base
        FROM walk w JOIN rws r ON r.table_id = w.table_id AND r.pos = w.pos + 1)
    SELECT table_id, chunk_no, count(*) AS n_rows, sum(cost) + max(base) AS n_tokens FROM walk GROUP BY table_id, chunk_no"""
