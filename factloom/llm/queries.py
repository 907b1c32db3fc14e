"""Queries of this subpackage, and their SQL where SQL can say it over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import byte_bpe, containers, groups, neighbours, repeated_lines, residue, splitting

#: Columns of the elements that the queries of problem 5 return.
_COLUMNS = ["element_id", "source_file", "page_number", "element_type", "text", "heading", "top", "loaded_at"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.group_links(groups.links_of(table(spark, sf_dir, "fact_relationships"))).select(F.col("node").alias("fact_id"), "group_id")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.fact_groups(table(spark, sf_dir, "fact_relationships"), table(spark, sf_dir, "canonical_facts"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_pairs(table(spark, sf_dir, "evidence_units"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(table(spark, sf_dir, "compact_contexts"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_contexts(table(spark, sf_dir, "compact_contexts"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.repeated_elements(table(spark, sf_dir, "document_elements"))


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.without_repeated(table(spark, sf_dir, "document_elements").select(_COLUMNS)).drop("loaded_at")


def p5_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.rebuilt_documents(table(spark, sf_dir, "document_elements").select(_COLUMNS)).drop("loaded_at")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_counts(table(spark, sf_dir, "documents"))


def p7_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.fill(byte_bpe.token_counts(table(spark, sf_dir, "documents")))


def p7_fullness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.fullness(p7_bins(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_kinds(spark, sf_dir).select("doc_id").distinct()


def p8_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents"))


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.join(p8_found(spark, sf_dir), "doc_id", "left_anti").select("doc_id", "lang", "source", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_LINES = r"""
lines AS (
    SELECT element_id, source_file, split_part(source_file, '/', 1) AS issuer,
        lower(regexp_replace(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}0-9]+', '', 'g')) AS line
    FROM document_elements WHERE source_file IS NOT NULL AND text IS NOT NULL
),
repeated AS (SELECT issuer, line FROM lines WHERE line <> '' GROUP BY ALL HAVING count(DISTINCT source_file) >= 12)
"""

_DELTAS = r"""
by_delta AS (SELECT *, ((instr('0123456789abcdef', substr(md5(source_file), 1, 1)) - 1) % 4)::INT AS dl FROM lines WHERE line <> '' AND element_id IS NOT NULL),
steps AS (SELECT unnest([0, 1, 2, 3])::INT AS d),
crossed AS (SELECT d, issuer, line FROM steps JOIN by_delta ON dl <= d GROUP BY ALL HAVING count(DISTINCT source_file) >= 12),
gone AS (SELECT element_id, min(d) AS g FROM by_delta JOIN crossed USING (issuer, line) WHERE d >= dl GROUP BY element_id),
one AS (SELECT *, ((instr('0123456789abcdef', substr(md5(coalesce(source_file, '')), 1, 1)) - 1) % 4)::INT AS own FROM document_elements WHERE element_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY element_id ORDER BY loaded_at DESC) = 1),
built AS (SELECT DISTINCT source_file, own AS delta FROM one UNION SELECT source_file, greatest(g, own) FROM one JOIN gone USING (element_id))
"""

_PAIRS = r"""
ids AS (SELECT lower(regexp_replace(fact_a_id, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')) AS a, lower(regexp_replace(fact_b_id, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')) AS b, lower(regexp_replace(status, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')) AS s FROM fact_relationships),
links AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM ids WHERE s = 'corroboration' UNION ALL SELECT b, a FROM ids WHERE s = 'corroboration') WHERE a <> '' AND b <> '' AND a <> b),
reach AS (SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other)
"""

SQL: dict[str, str] = {
    "p1_found": f"WITH RECURSIVE {_PAIRS} SELECT node AS fact_id, min(other) AS group_id FROM reach GROUP BY node",
    "p1_groups": f"""WITH RECURSIVE {_PAIRS}, g AS (SELECT node, min(other) AS low FROM reach GROUP BY node),
        n AS (SELECT DISTINCT x FROM (SELECT a AS x FROM ids UNION ALL SELECT b FROM ids UNION ALL SELECT lower(regexp_replace(fact_id, '^\\s+|\\s+$', '', 'g')) FROM canonical_facts) WHERE x <> '')
        SELECT x AS fact_id, coalesce(low, x) AS group_id FROM n LEFT JOIN g ON g.node = x""",
    "p3_found": r"""
        SELECT DISTINCT context_id FROM compact_contexts
        WHERE length(array_to_string(list_filter(list_transform(evidence, lambda e: e.text), lambda t: t IS NOT NULL AND t <> ''), chr(10) || chr(10))) // 4 > 2500
            AND context_id IS NOT NULL""",
    "p5_found": f"WITH {_LINES} SELECT DISTINCT element_id FROM lines SEMI JOIN repeated USING (issuer, line) WHERE element_id IS NOT NULL",
    "p5_clean": f"""WITH {_LINES},
        found AS (SELECT DISTINCT element_id FROM lines SEMI JOIN repeated USING (issuer, line) WHERE element_id IS NOT NULL)
        SELECT element_id, source_file, page_number, element_type, text, heading, top FROM document_elements
        WHERE element_id IS NOT NULL AND element_id NOT IN (SELECT element_id FROM found)
        QUALIFY row_number() OVER (PARTITION BY element_id ORDER BY loaded_at DESC) = 1""",
    "p5_rebuilt": f"""WITH {_LINES}, {_DELTAS}
        SELECT b.delta, o.element_id, o.source_file, o.page_number, o.element_type, o.text, o.heading, o.top FROM one o JOIN built b ON o.source_file IS NOT DISTINCT FROM b.source_file LEFT JOIN gone g ON g.element_id = o.element_id
        WHERE g.g IS NULL OR g.g > b.delta""",
}
