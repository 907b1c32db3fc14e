"""Queries of contexts, grounding, canonicalisation, matching, vectors, packing and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql as S
from ..functions import text as T
from ..operators import canonical as C
from ..operators import cleanup, cluster, embed, grounding, layout, matching, near, packing, report, scoring
from ..session import table, written
from . import inputs as I
from .structure import _BLOCK_ROWS, _BLOCKS, joined

KEYWORDS = ["revenue", "shipments", "margin", "tonnage", "fuel cost", "network"]
QUESTION = "Which parcel revenue did the cargo company report for FY24?"
#: Least dot product of embedding_candidates: pairs of different labels are not nearer in the test vectors.
NEAR_LABELS = 0.30


def structured_chunks(spark: SparkSession, d: str) -> DataFrame:
    return packing.structured_chunks(I.elements(spark, d), packing.API_TOKENS).select("source_file", "chunk_no", "n_elements", "packed_tokens", "estimated_tokens", F.get("evidence", F.lit(0))["evidence_id"].alias("first_id"))


def clean_filter_chunk(spark: SparkSession, d: str) -> DataFrame:
    """The whole front end: elements to blocks, to filtered blocks, to contexts; contexts numbered over all files."""
    blocks = written(cleanup.merge_blocks(I.elements(spark, d)), "blocks")
    c = packing.structured_chunks(cleanup.filter_elements(blocks), packing.API_TOKENS)
    n = packing.numbered(c.select("source_file", "chunk_no", "n_elements", "packed_tokens", "estimated_tokens"), ["source_file", "chunk_no"], "n", 0)
    return n.select(F.format_string("context-%05d", "n").alias("context_id"), "source_file", "chunk_no", "n_elements", "packed_tokens", "estimated_tokens")


def evidence_chunks(spark: SparkSession, d: str) -> DataFrame:
    return packing.evidence_chunks(I.evidence(spark, d, "source_file", "page_number", "text")).select("source_file", "chunk_no", "topic", "n_units", "estimated_tokens")


def rank_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = I.evidence(spark, d).withColumn("page", F.concat_ws(":", T.text_of("source_file"), "page_number"))
    return packing.rank_evidence(e, "page").select("page", "evidence_id", "score", "rank", "cost")


def round_robin_budget(spark: SparkSession, d: str) -> DataFrame:
    e = I.evidence(spark, d).withColumn("issuer", F.substring_index(T.text_of("source_file"), "/", 1))
    return packing.round_robin(packing.rank_evidence(e, "issuer"), "issuer").select("issuer", "evidence_id", "round", "position", "so_far")


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    e = I.evidence(spark, d, "source_file", "page_number", "evidence_type", "text", "section_heading", "table_caption", "row_label", "column_label", "number_hints", "unit_hint", "time_hint", "embedding")
    usable = scoring.drop_repeats(e).where(~scoring.is_low_information() & (F.size("embedding") == 128) & ~F.exists("embedding", lambda x: F.isnan(x) | x.isNull()) & F.exists("embedding", lambda x: x != 0))
    return usable.select("evidence_id", T.text_of("source_file").alias("source_file"), "page_number", "text", "embedding", scoring.structural_class().alias("kind"))


def _groups(m: DataFrame) -> DataFrame:
    """(block, evidence_id, group_id, group_size): groups of the evidence of all files; a block is a component of its near pairs."""
    linked = written(near.near_components(m, "evidence_id", "embedding", cluster.SIMILARITY), "components")
    placed = m.join(linked, "evidence_id", "left")
    alone = placed.where("component is null").select(F.col("evidence_id").alias("block"), "evidence_id", F.col("evidence_id").alias("group_id"), F.lit(1).alias("group_size"))
    return cluster.cluster(placed.where("component is not null").withColumnRenamed("component", "block"), "block").unionByName(alone)


def cluster_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _groups(written(_clustered(spark, d), "members"))


def pack_contexts(spark: SparkSession, d: str) -> DataFrame:
    m = written(_clustered(spark, d), "members")
    groups = _groups(m).select("evidence_id", "group_id")
    return packing.pack_contexts(m.join(groups, "evidence_id").withColumn("cost", packing.context_cost()))


def context_topics(spark: SparkSession, d: str) -> DataFrame:
    m = written(_clustered(spark, d), "members")
    groups = written(_groups(m).select("evidence_id", "group_id", "group_size"), "groups")
    e = I.evidence(spark, d, "source_file", "page_number", "text", "section_heading", "table_caption").join(groups, "evidence_id")
    labels = scoring.topic_labels(e, ["group_id"]).join(groups.groupBy("group_id").agg(F.max("group_size").alias("size")), "group_id")
    packed = written(packing.pack_contexts(m.join(groups, "evidence_id").withColumn("cost", packing.context_cost())), "packed")
    return packing.context_topics(packed, labels.join(packed.select("block", "group_id"), "group_id"), ["block"])


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").where("embedding is not null")
    return v.select("vec_id", F.posexplode(embed.unit_vector(F.col("embedding"))).alias("d", "x")).select("vec_id", "d", F.round("x", 5).alias("x"))


def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    return report.context_scores(table(spark, d, "compact_contexts"), KEYWORDS)


def top_contexts(spark: SparkSession, d: str) -> DataFrame:
    return report.top_contexts(keyword_score(spark, d), 2).select("document", "context_id", "score", "rank")


def half_context(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "compact_contexts").where("context_id is not null").groupBy("context_id").agg(F.max_by("evidence", F.struct("loaded_at", F.xxhash64("evidence"))).alias("evidence"))
    half = grounding.half_text(F.col("evidence"))
    return one.select("context_id", F.length(half).alias("n_chars"), F.md5(half.cast("binary")).alias("digest"))


def distinct_keywords(spark: SparkSession, d: str) -> DataFrame:
    return report.distinct_keywords(table(spark, d, "canonical_facts"), "attribute", "fact_id")


def serialize_context(spark: SparkSession, d: str) -> DataFrame:
    s = grounding.serialize_contexts(table(spark, d, "compact_contexts"))
    return s.select("context_id", F.length("prompt").alias("n_chars"), F.md5(F.col("prompt").cast("binary")).alias("digest"))


def serialize_elements(spark: SparkSession, d: str) -> DataFrame:
    return I.elements(spark, d).select("element_id", packing.serialize_element().alias("text"))


def grounding_cases(spark: SparkSession, d: str) -> DataFrame:
    """Facts that point at each piece of context evidence rightly or wrongly, in turn: exact, recased, altered, wrong id, cells in and out of range."""
    e = grounding.context_evidence(table(spark, d, "compact_contexts"))
    n = F.col("ord") % 6
    text = T.text_of("e.text")
    quote = F.when(n == 1, F.upper(F.substring(text, 3, 40))).when(n == 2, F.concat(F.substring(text, 3, 20), F.lit("~x"))).otherwise(F.substring(text, 3, 40))
    tab = T.text_of("e.table_ref") != ""
    return e.select(
        "context_id", F.concat("context_id", F.lit(":"), "ord").alias("fact_id"), F.lit("Issuer").alias("entity"), F.when(n == 4, "").otherwise("measure").alias("attribute"), F.substring(quote, 5, 6).alias("raw_value"), quote.alias("exact_quote"),
        F.when(n == 3, "no-such-id").when(n == 5, F.lit(None)).otherwise(F.col("e.evidence_id")).alias("evidence_id"), F.when(tab & (n != 3), F.col("e.table_ref")).alias("table_ref"),
        F.when(n == 2, 99).when(n == 1, -1).otherwise(0).alias("row_index"), F.when(n == 5, 1).otherwise(0).alias("column_index"), F.lit(1.0).alias("normalized_value"),
    )


def ground_all(spark: SparkSession, d: str) -> DataFrame:
    g = grounding.ground(written(grounding_cases(spark, d), "cases"), table(spark, d, "compact_contexts"))
    return g.select("fact_id", "status", "raw_value", "column_name", "evidence_id", "exact_quote")


def ground_table(spark: SparkSession, d: str) -> DataFrame:
    g = grounding.ground(written(grounding_cases(spark, d), "cases"), table(spark, d, "compact_contexts"))
    return g.where("table_ref is not null").select("fact_id", "status", "raw_value", "column_name")


def ground_prose(spark: SparkSession, d: str) -> DataFrame:
    g = grounding.ground(written(grounding_cases(spark, d), "cases"), table(spark, d, "compact_contexts"))
    return g.where("table_ref is null").select("fact_id", "status")


def norm_text(spark: SparkSession, d: str) -> DataFrame:
    return I.facts(spark, d).select("fact_id", C.norm_text(F.col("exact_quote")).alias("norm"))


def extract_time(spark: SparkSession, d: str) -> DataFrame:
    return I.facts(spark, d).select("fact_id", C.extract_time(F.col("exact_quote")).alias("time"), C.remove_time(F.col("exact_quote")).alias("rest"))


def clean_attribute(spark: SparkSession, d: str) -> DataFrame:
    a = C.clean_attribute(F.col("attribute"))
    return I.facts(spark, d).select("fact_id", a.alias("attribute"), C.singular(a).alias("singular"), C.has_semantic_content(F.col("attribute")).alias("semantic"))


def numeric_candidates(spark: SparkSession, d: str) -> DataFrame:
    return I.facts(spark, d).select("fact_id", joined(C.numeric_candidates(F.col("exact_quote"))).alias("quote"), joined(C.numeric_candidates(F.col("raw_value"))).alias("raw"))


def canonical_facts(spark: SparkSession, d: str) -> DataFrame:
    return C.canonicalize(I.facts(spark, d)).select("fact_id", "entity", "attribute", "raw_value", "time", "status")


def value_number(spark: SparkSession, d: str) -> DataFrame:
    return I.facts(spark, d).select("fact_id", matching.value_number(F.col("raw_value")).alias("value"))


def unit_type(spark: SparkSession, d: str) -> DataFrame:
    return I.facts(spark, d).select("fact_id", matching.unit_type(F.col("raw_value")).alias("unit_type"))


def attribute_tokens(spark: SparkSession, d: str) -> DataFrame:
    return I.facts(spark, d).select("fact_id", joined(matching.attribute_tokens(F.col("attribute")), " ").alias("tokens"))


def document_of(spark: SparkSession, d: str) -> DataFrame:
    return I.facts(spark, d).select("fact_id", matching.document_of(F.col("source_file"), F.col("evidence_id")).alias("document"))


def entity_compat(spark: SparkSession, d: str) -> DataFrame:
    e = I.facts(spark, d).select(matching.norm(F.col("entity")).alias("e")).distinct()
    return matching.compatible_entities(written(e, "e"))


def attribute_compat(spark: SparkSession, d: str) -> DataFrame:
    a = I.facts(spark, d).select(matching.attribute_tokens(F.col("attribute")).alias("a")).distinct()
    return matching.compatible_attributes(written(a, "a")).select(joined("a", " ").alias("a"), joined("a2", " ").alias("a2"))


def embedding_candidates(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return embed.similar_to_queries(v, v.where("vec_id % 50 = 0"), NEAR_LABELS).select("a", "b", F.round("similarity", 5).alias("similarity"))


def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return I.facts(spark, d).select("fact_id", joined(embed.hash_counts(embed.identity_text()).cast("array<string>"), " ").alias("counts"))


def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    return I.evidence(spark, d).select("evidence_id", embed.evidence_text().alias("text"))


def identity_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = matching.candidate_pairs(written(matching.fact_classes(I.facts(spark, d)), "classes"))
    return p.select(F.col("fact_id_a").alias("fact_a_id"), F.col("fact_id_b").alias("fact_b_id"), "similarity")


def classify_relationships(spark: SparkSession, d: str) -> DataFrame:
    return matching.classify_relationships(I.facts(spark, d))


def relationship_stats(spark: SparkSession, d: str) -> DataFrame:
    return report.relationship_stats(classify_relationships(spark, d))


def document_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "document_elements").where("source_file is not null")
    return report.document_stats(docs, I.facts(spark, d))


def ask_top8(spark: SparkSession, d: str) -> DataFrame:
    return report.ask(I.facts(spark, d), QUESTION).select("fact_id", "score")


def fact_json(spark: SparkSession, d: str) -> DataFrame:
    j = report.fact_json()
    return I.facts(spark, d).select("fact_id", F.get_json_object(j, "$.entity").alias("entity"), F.get_json_object(j, "$.raw_value").alias("raw_value"), F.get_json_object(j, "$.scope").alias("scope"))


def centroids(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").where("embedding is not null").select("label", F.posexplode("embedding").alias("d", "x"))
    mean = v.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_n"), F.collect_list(F.struct("d", "x")).alias("v")).select("label", F.inline("v"), "_n").select("label", "d", F.round(F.col("x") / F.greatest("_n", F.lit(1e-12)), 5).alias("x"))


QUERIES = {f.__name__: f for f in (structured_chunks, clean_filter_chunk, evidence_chunks, rank_evidence, round_robin_budget, cluster_evidence, pack_contexts, context_topics, unit_vectors, keyword_score, top_contexts, half_context, distinct_keywords, serialize_context, serialize_elements, ground_all, ground_table, ground_prose, norm_text, extract_time, clean_attribute, numeric_candidates, canonical_facts, value_number, unit_type, attribute_tokens, document_of, entity_compat, attribute_compat, embedding_candidates, hash_embeddings, embedding_texts, identity_candidates, classify_relationships, relationship_stats, document_stats, ask_top8, fact_json, centroids)}


def _greedy(rows: str, limit: int) -> str:
    """Recursive walk over rows (g, pos, cost) of all groups at once."""
    return f"""walk(g, pos, cost, chunk_no, held) AS (
        SELECT g, pos, cost, 0, cost FROM {rows} WHERE pos = 1
        UNION ALL SELECT r.g, r.pos, r.cost, CASE WHEN w.held + r.cost > {limit} THEN w.chunk_no + 1 ELSE w.chunk_no END, CASE WHEN w.held + r.cost > {limit} THEN r.cost ELSE w.held + r.cost END
        FROM walk w JOIN {rows} r ON r.g = w.g AND r.pos = w.pos + 1)"""


_SERIAL = """CASE element_type WHEN 'TABLE' THEN CASE WHEN tab IS NULL THEN '' ELSE array_to_string(list_concat(
        list_filter(['[TABLE]', 'TABLE_REF: ' || element_id, 'PAGE: ' || coalesce(page_number, 0), CASE WHEN coalesce(tab.caption, '') <> '' THEN 'CAPTION: ' || tab.caption END, CASE WHEN coalesce(tab.unit, '') <> '' THEN 'UNIT: ' || tab.unit END], lambda x: x IS NOT NULL),
        list_transform(coalesce(tab.headers, []), lambda h, i: 'HEADER ' || (i - 1) || ': ' || coalesce(h, '')),
        flatten(list_transform(coalesce(tab.rows, []), lambda r, i: list_concat(['ROW ' || (i - 1) || ':'], list_transform(r, lambda c, j: 'CELL ' || (j - 1) || ': ' || coalesce(c, ''))))), ['[/TABLE]']), chr(10)) END
    WHEN 'HEADING' THEN '[HEADING] ' || text ELSE '[PROSE] ' || text END"""
_DOWN = lambda x: f"(CASE WHEN {x} = '' THEN 0 ELSE greatest(1, length({x}) // 4) END)"
_UP = lambda x: f"(CASE WHEN {x} = '' THEN 0 ELSE ceil(length({x}) / 4)::INT END)"
_NUMBER = "coalesce(len(number_hints) > 0, false)"
_USE = f"(4 * {_NUMBER}::INT + 3 * (coalesce(unit_hint, '') <> '')::INT + 2 * (coalesce(time_hint, '') <> '')::INT + 2 * (coalesce(entity_hint, '') <> '')::INT + CASE coalesce(evidence_type, '') WHEN 'TABLE_ROW' THEN 2 WHEN 'PROSE' THEN 1 ELSE 0 END)"
_META = "('[' || evidence_id || '] ' || coalesce(source_file, '') || ' p.' || coalesce(page_number::VARCHAR, 'None'))"


def _ranked(group: str) -> str:
    return f"""{I.EVIDENCE}, once AS (SELECT *, {group} AS g FROM evidence QUALIFY row_number() OVER (PARTITION BY {group}, {S.norm("text")}, coalesce(source_file, ''), page_number ORDER BY evidence_id) = 1),
        ranked AS (SELECT *, {_USE} AS score, {_UP("coalesce(text, '')")} + {_UP(_META)} + 5 AS cost, row_number() OVER (PARTITION BY g ORDER BY {_USE} DESC, coalesce(source_file, ''), page_number NULLS FIRST, evidence_id) AS rank FROM once)"""


_CONTEXTS = """contexts AS (SELECT context_id, evidence FROM compact_contexts WHERE context_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY context_id ORDER BY loaded_at DESC NULLS LAST) = 1)"""
_CELLS = lambda a: f"list_transform(coalesce({a}, []), lambda c: coalesce(c, ''))"
_FULL = f"""{S.strip(f"array_to_string(list_transform(list_filter(evidence, lambda e: e IS NOT NULL), lambda e: array_to_string(list_concat([coalesce(e.text, '')], list_filter(list_concat([array_to_string({_CELLS('e.table_headers')}, ' ')], list_transform(coalesce(e.table_rows, []), lambda r: array_to_string({_CELLS('r')}, ' '))), lambda x: x <> '')), ' ')), chr(10))")}"""
_SCORES = f"""{_CONTEXTS}, full_texts AS (SELECT context_id, coalesce(evidence[1].source_file, '') AS document, coalesce({_FULL}, '') AS t FROM contexts),
    scores AS (SELECT context_id, document, {" + ".join(f"contains(lower(t), {S.q(k)})::INT" for k in KEYWORDS)} + least(len(list_filter({S.words(S.collapse("lower(t)"))}, lambda w: regexp_matches(w, '\\p{{Nd}}'))) // 3, 10) AS score FROM full_texts)"""
_PRESENT = lambda label, x: f"CASE WHEN coalesce({x}, '') <> '' THEN '{label}' || {x} || chr(10) ELSE '' END"
_BLOCK = f"""'EVIDENCE_ID: ' || coalesce(e.evidence_id, '') || chr(10) || 'SOURCE_FILE: ' || coalesce(e.source_file, '') || chr(10) || 'PAGE: ' || coalesce(e.page_number::VARCHAR, '') || chr(10)
    || {_PRESENT("ELEMENT_TYPE: ", "e.element_type")} || {_PRESENT("TABLE_REF: ", "e.table_ref")}
    || CASE WHEN len(e.table_headers) > 0 THEN 'TABLE_HEADERS:' || chr(10) || array_to_string(list_transform(e.table_headers, lambda h, i: '  HEADER ' || (i - 1) || ': ' || coalesce(h, '')), chr(10)) || chr(10) ELSE '' END
    || CASE WHEN len(e.table_rows) > 0 THEN 'TABLE_ROWS:' || chr(10) || array_to_string(list_transform(e.table_rows, lambda r, i: '  ROW ' || (i - 1) || ':' || chr(10) || array_to_string(list_transform(r, lambda c, j: '    CELL ' || (j - 1) || ': ' || coalesce(c, '') || chr(10)), '')), '') ELSE '' END
    || 'TEXT:' || chr(10) || coalesce(e.text, '') || chr(10)"""

_CASES = f"""{_CONTEXTS}, ev AS (SELECT context_id, unnest(evidence) AS e, generate_subscripts(evidence, 1) - 1 AS ord FROM contexts),
    evs AS (SELECT * FROM ev WHERE e IS NOT NULL),
    quoted AS (SELECT *, ord % 6 AS n, CASE ord % 6 WHEN 1 THEN upper(substr(coalesce(e.text, ''), 3, 40)) WHEN 2 THEN substr(coalesce(e.text, ''), 3, 20) || '~x' ELSE substr(coalesce(e.text, ''), 3, 40) END AS exact_quote FROM evs),
    cases AS (SELECT context_id, context_id || ':' || ord AS fact_id, CASE WHEN n = 4 THEN '' ELSE 'measure' END AS attribute, substr(exact_quote, 5, 6) AS raw_value, exact_quote,
        CASE n WHEN 3 THEN 'no-such-id' WHEN 5 THEN NULL ELSE e.evidence_id END AS evidence_id, CASE WHEN coalesce(e.table_ref, '') <> '' AND n <> 3 THEN e.table_ref END AS table_ref, CASE n WHEN 2 THEN 99 WHEN 1 THEN -1 ELSE 0 END AS r, CASE n WHEN 5 THEN 1 ELSE 0 END AS c FROM quoted),
    by_id AS (SELECT context_id, e.evidence_id AS evidence_id, arg_max(coalesce(e.text, ''), ord) AS src FROM evs GROUP BY ALL),
    by_ref AS (SELECT context_id, e.table_ref AS table_ref, arg_max(e, ord) AS t FROM evs WHERE coalesce(e.table_ref, '') <> '' GROUP BY ALL),
    looked AS (SELECT c.*, i.src, f.t, CASE WHEN r >= 0 THEN f.t.table_rows[r + 1] END AS row FROM cases c LEFT JOIN by_id i USING (context_id, evidence_id) LEFT JOIN by_ref f USING (context_id, table_ref)),
    tested AS (SELECT *, {S.strip("CASE WHEN c >= 0 THEN row[c + 1] END")} AS cell, {S.strip("exact_quote")} AS qq, {S.strip("src")} AS ss, {S.strip("raw_value")} AS vv, attribute <> '' AND raw_value <> '' AS full_fact FROM looked),
    grounded AS (SELECT *, CASE WHEN NOT full_fact THEN 'UNCERTAIN' WHEN table_ref IS NOT NULL THEN CASE WHEN cell <> '' THEN 'VALID' ELSE 'GROUNDING_FAILURE' END
        WHEN coalesce(evidence_id, '') <> '' AND qq <> '' AND ss <> '' AND (contains(ss, qq) OR contains({S.norm("ss")}, {S.norm("qq")})) AND (vv = '' OR contains(qq, vv) OR contains({S.norm("qq")}, {S.norm("vv")})) THEN 'VALID' ELSE 'GROUNDING_FAILURE' END AS status,
        full_fact AND table_ref IS NOT NULL AND cell <> '' AS bound FROM tested)"""

_NORM = lambda x: S.collapse(f"regexp_replace(replace(lower({S.strip(x)}), '_', ' '), '[^a-z0-9%()/.,\\-{T.WS}]', ' ', 'g')")


def _remove(x: str) -> str:
    out = _NORM(x)
    for p in C.TIMES:
        out = f"regexp_replace({out}, {S.q(p)}, ' ', 'g')"
    return S.collapse(out)


def _clean(x: str) -> str:
    drop = ", ".join(S.q(w) for w in C.CONTEXT_WORDS + C.MODIFIERS)
    return f"array_to_string(list_filter({S.words(_remove(x))}, lambda w: w NOT IN ({drop})), ' ')"


def _first_time(x: str) -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches({x}, {S.q(p)}) THEN {{'at': length(regexp_extract({x}, {S.q('(?s)^(.*?)(?:' + p + ')')}, 1)), 'i': {i}, 't': trim(regexp_extract({x}, {S.q(p)}))}} END" for i, p in enumerate(C.TIMES))
    return f"(list_sort(list_filter([{hits}], lambda h: h IS NOT NULL))[1].t)"


_SEMANTIC = lambda x: f"list_has_any({S.words(_NORM(x))}, [{', '.join(S.q(w) for w in C.SEMANTIC)}])"
_SINGULAR = lambda x: f"array_to_string(list_transform({S.words(x)}, lambda w: CASE w {' '.join(f'WHEN {S.q(a)} THEN {S.q(b)}' for a, b in C.SINGULAR.items())} ELSE w END), ' ')"
_CANDIDATES = lambda x: f"list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), {S.q(C.NUMERIC)}), lambda m: {S.strip('m')}), lambda m: NOT (NOT regexp_matches(m, '[A-Za-z%]$') AND coalesce(try_cast(regexp_replace(m, '[^0-9.]', '', 'g') AS DOUBLE) % 1 = 0 AND try_cast(regexp_replace(m, '[^0-9.]', '', 'g') AS DOUBLE) BETWEEN 1900 AND 2100, false)))"
_GENERIC = "(" + ", ".join(S.q(g) for g in C.GENERIC) + ")"
_CANON = f"""{I.FACTS}, a0 AS (SELECT *, {_clean("attribute")} AS own, {_clean("qualifier")} AS q1, {_clean("exact_quote")} AS q2, {_NORM("attribute")} AS na FROM facts),
    a1 AS (SELECT *, {_SINGULAR(_clean("derived"))} AS a FROM (SELECT *, CASE WHEN own <> '' AND own NOT IN {_GENERIC} THEN own WHEN q1 <> '' AND q1 NOT IN {_GENERIC} AND {_SEMANTIC("q1")} THEN q1 WHEN q2 <> '' AND q2 NOT IN {_GENERIC} AND {_SEMANTIC("q2")} THEN q2 ELSE '' END AS derived FROM a0)),
    a2 AS (SELECT *, coalesce(status, 'VALID') = 'VALID' AS valid, {_CANDIDATES("exact_quote")} AS qc, {_CANDIDATES("raw_value")} AS rc FROM a1)"""

_LOW = S.strip("lower(coalesce(raw_value, ''))")
_VT = f"(CASE WHEN starts_with({_LOW}, '(') AND ends_with({_LOW}, ')') THEN '-' || substr({_LOW}, 2, length({_LOW}) - 2) ELSE {_LOW} END)"
_BARE = f"regexp_replace({_VT}, '[,₹%]|rs\\.|rs', '', 'g')"
_VALUE = f"""((CASE WHEN regexp_matches({_VT}, '(?:^|[{T.WS}(])-') THEN -1 ELSE 1 END) * try_cast(nullif(regexp_extract({_BARE}, '[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE) * (CASE WHEN contains({_BARE}, 'billion') OR regexp_matches({_BARE}, '\\bbn\\b') THEN 1e9
    WHEN contains({_BARE}, 'million') OR regexp_matches({_BARE}, '\\bmn\\b') THEN 1e6 WHEN contains({_BARE}, 'thousand') OR regexp_matches({_BARE}, '\\bk\\b') THEN 1e3 WHEN regexp_matches({_BARE}, '\\bcr\\b') THEN 1e7 WHEN regexp_matches({_BARE}, '\\bm\\b') THEN 1e6 ELSE 1.0 END))"""
_RAWLOW = "lower(coalesce(raw_value, ''))"
_UNIT = f"(CASE WHEN contains({_RAWLOW}, '%') THEN 'PERCENT' WHEN regexp_matches({_RAWLOW}, {S.q(matching.CURRENCY)}) THEN 'CURRENCY' WHEN regexp_matches({_RAWLOW}, {S.q(matching.VOLUME)}) THEN 'VOLUME' WHEN {_VALUE} IS NOT NULL THEN 'NUMBER' ELSE 'TEXT' END)"
_MN = lambda x: f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9%]+', ' ', 'g'))"
_TOKENS = lambda x: f"list_sort(list_distinct(list_filter({S.words(_MN(x))}, lambda w: w NOT IN ({', '.join(S.q(w) for w in matching.STOP)}))))"
_DOC = "coalesce(nullif(source_file, ''), nullif(split_part(nullif(evidence_id, ''), ':', 1), ''), 'unknown')"
_WITHIN = lambda a, b: f"len(list_filter({a}, lambda x: NOT list_contains({b}, x))) = 0"
_DIMS = "[" + ", ".join(S.q(w) for w in matching.DIMENSIONS) + "]"
_MORE = lambda a, b: f"NOT list_has_any(list_filter({b}, lambda x: NOT list_contains({a}, x)), {_DIMS})"
_ATTR = lambda a, b: f"(len({a}) > 0 AND len({b}) > 0 AND CASE WHEN {_WITHIN(a, b)} THEN {_MORE(a, b)} WHEN {_WITHIN(b, a)} THEN {_MORE(b, a)} ELSE false END)"
_ENT = lambda a, b: f"({a} = '' OR {b} = '' OR contains({a}, {b}) OR contains({b}, {a}))"
_IDENTITY = "'Entity: ' || coalesce(entity, '') || ' | Attribute: ' || coalesce(attribute, '') || ' | Time: ' || coalesce(time, '') || ' | Scope: ' || coalesce(scope, '') || ' | Qualifier: ' || coalesce(qualifier, '')"
_COUNTS = f"list_transform(range(64), lambda i: len(list_filter(list_transform({S.words(f'trim(regexp_replace(lower({_IDENTITY}), {S.q("[^a-z0-9%]+")}, {S.q(" ")}, {S.q("g")}))')}, lambda w: ('0x' || substr(md5(w), 1, 4))::INT % 64), lambda b: b = i)))"
_PAIR_SQL = f"""{I.FACTS}, classes AS (SELECT {_DOC} AS doc, entity, attribute, time, scope, qualifier, raw_value, min(fact_id) AS fact_id, count(DISTINCT fact_id) AS members FROM facts WHERE coalesce(status, 'VALID') = 'VALID' GROUP BY ALL),
    c AS MATERIALIZED (SELECT fact_id, members, doc, {_MN("entity")} AS e, {_TOKENS("attribute")} AS a, {_VALUE} AS v, {_UNIT} AS u, {_MN("time")} AS t, {_MN("scope")} AS s, coalesce(time, '') <> '' AS ht, coalesce(scope, '') <> '' AS hs, {_COUNTS} AS n FROM classes),
    aa AS MATERIALIZED (SELECT x.a AS a1, y.a AS a2 FROM (SELECT DISTINCT a FROM c) x, (SELECT DISTINCT a FROM c) y WHERE {_ATTR("x.a", "y.a")}),
    met AS MATERIALIZED (SELECT x AS l, y AS r, list_dot_product(x.n::DOUBLE[], y.n::DOUBLE[]) AS dp, list_dot_product(x.n::DOUBLE[], x.n::DOUBLE[]) * list_dot_product(y.n::DOUBLE[], y.n::DOUBLE[]) AS nn FROM c x JOIN aa ON aa.a1 = x.a JOIN c y ON y.a = aa.a2 WHERE x.fact_id < y.fact_id AND x.doc <> y.doc AND {_ENT("x.e", "y.e")}),
    pairs AS (SELECT *, round(dp / sqrt(nn), 3) AS similarity FROM met WHERE nn > 0 AND dp * dp >= 0.5625 * nn)"""
_LABELLED = f"""{_PAIR_SQL}, terms AS (SELECT *, abs(l.v - r.v) <= 0.001 * greatest(abs(l.v), abs(r.v), 1.0) AS eq, (NOT (l.ht OR r.ht) OR l.t <> '' AND l.t = r.t) AND (NOT (l.hs OR r.hs) OR l.s <> '' AND l.s = r.s) AS ctx, l.ht OR r.ht OR l.hs OR r.hs AS anyctx, (l.t <> '' AND r.t <> '' AND l.t <> r.t) OR (l.s <> '' AND r.s <> '' AND l.s <> r.s) AS dif FROM pairs),
    ruled AS (SELECT *, CASE WHEN l.v IS NULL OR r.v IS NULL THEN 1 WHEN l.u <> r.u THEN 2 WHEN eq AND ctx THEN 3 WHEN NOT eq AND ctx AND anyctx THEN 4 WHEN NOT eq AND dif THEN 5 WHEN eq THEN 6 ELSE 7 END AS k FROM terms),
    labelled AS (SELECT substr(sha1(l.fact_id || '|' || r.fact_id), 1, 16) AS relationship_id, l.fact_id AS fact_a_id, r.fact_id AS fact_b_id, l.members AS members_a, r.members AS members_b, similarity,
        ['UNCERTAIN', 'UNCERTAIN', 'CORROBORATION', 'CONTRADICTION', 'CONTEXTUAL_RESOLUTION', 'UNCERTAIN', 'UNCERTAIN'][k] AS status, [4, 7, 9, 9, 7, 6, 4][k] AS confidence,
        ['value not numeric', 'unit types differ', 'same context, equal values', 'same context, different values', 'time or scope differs', 'equal values, context incomplete', 'context incomplete'][k] AS rule, 'DETERMINISTIC' AS resolution_method FROM ruled)"""

SQL = {
    "structured_chunks": f"""WITH RECURSIVE {I.ELEMENTS}, ser AS (SELECT *, {_SERIAL} AS stext FROM elements),
        rws AS MATERIALIZED (SELECT source_file AS g, row_number() OVER (PARTITION BY source_file ORDER BY page_number NULLS FIRST, top, element_id) AS pos, element_id, stext, {_DOWN("stext")} AS cost FROM ser), {_greedy("rws", packing.API_TOKENS)}
        SELECT g AS source_file, chunk_no, count(*) AS n_elements, sum(cost) AS packed_tokens, greatest(1, (sum(length(stext)) + 2 * (count(*) - 1)) // 4) AS estimated_tokens, first(element_id ORDER BY pos) AS first_id FROM walk JOIN rws USING (g, pos, cost) GROUP BY g, chunk_no""",
    "evidence_chunks": f"""WITH RECURSIVE {I.EVIDENCE}, rws AS MATERIALIZED (SELECT coalesce(source_file, '') AS g, coalesce(page_number, 0) AS page, row_number() OVER (PARTITION BY coalesce(source_file, '') ORDER BY coalesce(page_number, 0), evidence_id) AS pos,
        greatest(1, (length(coalesce(text, '')) + length('[' || evidence_id || '] p.' || coalesce(page_number, 0))) // 4) AS cost FROM evidence), {_greedy("rws", packing.EVIDENCE_TOKENS)}
        SELECT g AS source_file, chunk_no, g || ' | pages ' || min(page) || '-' || max(page) AS topic, count(*) AS n_units, sum(cost) AS estimated_tokens FROM walk JOIN rws USING (g, pos, cost) GROUP BY g, chunk_no""",
    "rank_evidence": f"WITH {_ranked('concat_ws(' + S.q(':') + ', coalesce(source_file, ' + S.q('') + '), page_number)')} SELECT g AS page, evidence_id, score, rank, cost FROM ranked",
    "round_robin_budget": f"""WITH {_ranked("split_part(coalesce(source_file, ''), '/', 1)")}, turns AS (SELECT *, row_number() OVER (PARTITION BY g, coalesce(source_file, '') ORDER BY rank) AS round, min(rank) OVER (PARTITION BY g, coalesce(source_file, '')) AS seen FROM ranked WHERE rank <= 30),
        summed AS (SELECT *, row_number() OVER w AS position, sum(cost) OVER w AS so_far FROM turns WINDOW w AS (PARTITION BY g ORDER BY round, seen)) SELECT g AS issuer, evidence_id, round, position, so_far FROM summed WHERE position = 1 OR so_far <= 2500""",
    "unit_vectors": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL)
        SELECT vec_id, generate_subscripts(e, 1) - 1 AS d, round(unnest(e) / greatest(sqrt(list_dot_product(e, e)), 1e-12), 5) AS x FROM v""",
    "keyword_score": f"WITH {_SCORES} SELECT * FROM scores",
    "top_contexts": f"WITH {_SCORES} SELECT document, context_id, score, row_number() OVER (PARTITION BY document ORDER BY score DESC, context_id) AS rank FROM scores QUALIFY rank <= 2",
    "half_context": f"WITH {_CONTEXTS} SELECT context_id, length(h) AS n_chars, md5(h) AS digest FROM (SELECT context_id, CASE WHEN t = '' THEN '' ELSE left(t, greatest(length(t) // 2, 1)) END AS h FROM (SELECT context_id, coalesce({_FULL}, '') AS t FROM contexts))",
    "distinct_keywords": f"SELECT k AS keyword, min(fact_id) AS place FROM (SELECT {S.strip('lower(attribute)')} AS k, fact_id FROM canonical_facts) WHERE k <> '' GROUP BY k",
    "serialize_context": f"""WITH {_CONTEXTS}, ev AS (SELECT context_id, unnest(evidence) AS e, generate_subscripts(evidence, 1) AS i FROM contexts)
        SELECT context_id, length(p) AS n_chars, md5(p) AS digest FROM (SELECT context_id, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY i) AS p FROM ev WHERE e IS NOT NULL GROUP BY context_id)""",
    "serialize_elements": f"WITH {I.ELEMENTS} SELECT element_id, {_SERIAL} AS text FROM elements",
    "ground_all": f"""WITH {_CASES} SELECT fact_id, status, CASE WHEN bound THEN cell ELSE raw_value END AS raw_value, CASE WHEN bound THEN t.table_headers[c + 1] END AS column_name,
        CASE WHEN bound THEN coalesce(t.table_evidence_ids[r + 1], table_ref || ':row:' || r) ELSE evidence_id END AS evidence_id, CASE WHEN bound THEN array_to_string(list_transform(row, lambda x: coalesce(x, '')), ' | ') ELSE exact_quote END AS exact_quote FROM grounded""",
    "ground_table": f"WITH {_CASES} SELECT fact_id, status, CASE WHEN bound THEN cell ELSE raw_value END AS raw_value, CASE WHEN bound THEN t.table_headers[c + 1] END AS column_name FROM grounded WHERE table_ref IS NOT NULL",
    "ground_prose": f"WITH {_CASES} SELECT fact_id, status FROM grounded WHERE table_ref IS NULL",
    "norm_text": f"WITH {I.FACTS} SELECT fact_id, {_NORM('exact_quote')} AS norm FROM facts",
    "extract_time": f"WITH {I.FACTS} SELECT fact_id, {_first_time('n')} AS time, {_remove('exact_quote')} AS rest FROM (SELECT *, {_NORM('exact_quote')} AS n FROM facts)",
    "clean_attribute": f"WITH {I.FACTS} SELECT fact_id, {_clean('attribute')} AS attribute, {_SINGULAR(_clean('attribute'))} AS singular, {_SEMANTIC('attribute')} AS semantic FROM facts",
    "numeric_candidates": f"WITH {I.FACTS} SELECT fact_id, array_to_string({_CANDIDATES('exact_quote')}, '¦') AS quote, array_to_string({_CANDIDATES('raw_value')}, '¦') AS raw FROM facts",
    "canonical_facts": f"""WITH {_CANON} SELECT fact_id, CASE WHEN valid AND coalesce(entity, '') <> '' THEN {S.strip("entity")} ELSE entity END AS entity, CASE WHEN valid THEN a ELSE attribute END AS attribute,
        CASE WHEN valid AND coalesce(raw_value, '') <> '' AND normalized_value IS NULL AND len(rc) = 0 AND len(qc) = 1 THEN qc[1] ELSE raw_value END AS raw_value,
        CASE WHEN valid THEN coalesce(CASE WHEN coalesce(time, '') <> '' THEN {_NORM("time")} WHEN a <> '' THEN {_first_time("na")} ELSE time END, time) ELSE time END AS time,
        CASE WHEN valid AND (a = '' OR a IN {_GENERIC}) THEN 'UNCERTAIN' ELSE status END AS status FROM a2""",
    "value_number": f"WITH {I.FACTS} SELECT fact_id, {_VALUE} AS value FROM facts",
    "unit_type": f"WITH {I.FACTS} SELECT fact_id, {_UNIT} AS unit_type FROM facts",
    "attribute_tokens": f"WITH {I.FACTS} SELECT fact_id, array_to_string({_TOKENS('attribute')}, ' ') AS tokens FROM facts",
    "document_of": f"WITH {I.FACTS} SELECT fact_id, {_DOC} AS document FROM facts",
    "entity_compat": f"WITH {I.FACTS}, d AS (SELECT DISTINCT {_MN('entity')} AS e FROM facts) SELECT x.e AS e, y.e AS e2 FROM d x, d y WHERE {_ENT('x.e', 'y.e')}",
    "attribute_compat": f"WITH {I.FACTS}, d AS (SELECT DISTINCT {_TOKENS('attribute')} AS a FROM facts) SELECT array_to_string(x.a, ' ') AS a, array_to_string(y.a, ' ') AS a2 FROM d x, d y WHERE {_ATTR('x.a', 'y.a')}",
    "embedding_candidates": """SELECT DISTINCT least(x.vec_id, y.vec_id) AS a, greatest(x.vec_id, y.vec_id) AS b, round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 5) AS similarity FROM embeddings x, embeddings y
        WHERE x.vec_id % 50 = 0 AND x.label <> y.label AND list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.30""",
    "hash_embeddings": f"WITH {I.FACTS} SELECT fact_id, array_to_string({_COUNTS}, ' ') AS counts FROM facts",
    "embedding_texts": f"""WITH {I.EVIDENCE} SELECT evidence_id, concat_ws(' | ', CASE WHEN coalesce(section_heading, '') <> '' THEN 'Section: ' || section_heading END, CASE WHEN coalesce(table_caption, '') <> '' THEN 'Table: ' || table_caption END,
        CASE WHEN coalesce(row_label, '') <> '' THEN 'Row: ' || row_label END, CASE WHEN coalesce(column_label, '') <> '' THEN 'Column: ' || column_label END, coalesce(text, '')) AS text FROM evidence""",
    "identity_candidates": f"WITH {_PAIR_SQL} SELECT l.fact_id AS fact_a_id, r.fact_id AS fact_b_id, similarity FROM pairs",
    "classify_relationships": f"WITH {_LABELLED} SELECT * FROM labelled",
    "relationship_stats": f"WITH {_LABELLED} SELECT count(*) AS candidate_relationships, count(*) FILTER (status = 'CORROBORATION') AS corroborations, count(*) FILTER (status = 'CONTRADICTION') AS contradictions, count(*) FILTER (status = 'CONTEXTUAL_RESOLUTION') AS contextual_resolutions, count(*) FILTER (status = 'UNCERTAIN') AS uncertain FROM labelled",
    "document_stats": f"""WITH {I.FACTS}, d AS (SELECT DISTINCT source_file FROM document_elements WHERE source_file IS NOT NULL) SELECT d.source_file, count(fact_id) AS fact_count, count(fact_id) FILTER (coalesce(status, 'VALID') = 'VALID') AS valid_fact_count,
        count(fact_id) FILTER (status = 'UNCERTAIN') AS uncertain_fact_count, count(fact_id) FILTER (status = 'GROUNDING_FAILURE') AS grounding_failure_count FROM d LEFT JOIN facts USING (source_file) GROUP BY ALL""",
    "ask_top8": f"""WITH {I.FACTS}, t AS (SELECT fact_id, lower(concat_ws(' ', coalesce(entity, ''), coalesce(attribute, ''), coalesce(raw_value, ''), coalesce(time, ''), coalesce(scope, ''))) AS x FROM facts)
        SELECT fact_id, score FROM (SELECT fact_id, {" + ".join(f"contains(x, {S.q(w)})::INT" for w in sorted({w for w in QUESTION.lower().split() if len(w) > 2}))} AS score FROM t) WHERE score > 0 ORDER BY score DESC, fact_id LIMIT 8""",
    "fact_json": f"WITH {I.FACTS} SELECT fact_id, coalesce(entity, '') AS entity, coalesce(raw_value, '') AS raw_value, scope FROM facts",
    "centroids": """WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings WHERE embedding IS NOT NULL), m AS (SELECT label, d, avg(x) AS x FROM v GROUP BY ALL)
        SELECT label, d, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY label)), 1e-12), 5) AS x FROM m""",
}
