"""Tables from evidence: key-value pairs, routing, reconstruction, facts, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .packing import greedy_chunks, numbered

# Signals in column names and values, by use.
TEXTUAL_VALUES = ["yes", "no", "nil", "none", "n.a.", "na", "n/a"]
NO_VALUES = ["", "-", "—", "na", "n.a.", "n/a"]
ROUTE_PERIODS = ["fy", "q1", "q2", "q3", "q4", "march", "june", "september", "december", "year", "month", "ended"]
TABLE_PERIODS = ["fy", "q1", "q2", "q3", "q4", "march", "june", "september", "december", "year ended", "months ended"]
FACT_PERIODS = ["fy", "q1", "q2", "q3", "q4", "march", "june", "september", "december"]
PERCENT_COLUMNS = ["%", "margin", "growth"]
UNIT_COLUMNS = ["₹", "rs", "inr", "usd", "million", "crore", "cr", "lakhs"]
SERIAL_COLUMNS = ["s. no.", "s.no.", "no.", "serial", "sr. no."]
FACT_METADATA = ["table", "row", "column", "s. no.", "s.no.", "serial", "no."]
TABLE_METADATA = ["table", "row", "s. no.", "s.no.", "serial"]
#: Codes of why a row takes its route.
FEW_PAIRS, NO_VALUE_COLUMNS, REGULAR_ROW, STRUCTURAL, AMBIGUOUS = "FEW_PAIRS", "NO_VALUE_COLUMN", "REGULAR", "HEADER_LIKE", "UNCLEAR"
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
NO_ROW_NUMBER = 10**9
#: Tokens a batch of table rows may have.
BATCH_TOKENS = 6000


def pairs_of(text: Column) -> Column:
    """Array of (k, v): segments between semicolons split at their first =, both sides filled."""
    halves = F.transform(F.filter(F.split(T.text_of(text), ";"), lambda s: s.contains("=")), lambda s: F.struct(T.strip(F.substring_index(s, "=", 1)).alias("k"), T.strip(F.regexp_replace(s, "^[^=]*=", "")).alias("v")))
    return F.filter(halves, lambda p: (p["k"] != "") & (p["v"] != ""))


def without(c: Column, signs: str) -> Column:
    return F.translate(c, signs, "")


def looks_like_value(v: Column) -> Column:
    """A number without its signs, or one of some words."""
    cleaned = T.strip(without(v, ",₹%()-"))
    return cleaned.rlike(NUMBER) | F.lower(cleaned).isin(TEXTUAL_VALUES)


def _bare(v: Column, negative: str) -> Column:
    c = without(T.strip(v), ",₹")
    return F.when(c.startswith("(") & c.endswith(")"), F.concat(F.lit(negative), F.regexp_replace(c, r"^\(|\)$", ""))).otherwise(c)


def parse_number(v: Column) -> Column:
    """The number of a cell as DOUBLE: grouping and currency signs dropped, parentheses negative, null for markers of no value."""
    c = T.strip(F.replace(_bare(v, "-"), F.lit("%"), F.lit("")))
    return F.when(~c.isin(NO_VALUES) & c.rlike(NUMBER), c.try_cast("double"))


def value_is_numeric(v: Column) -> Column:
    c = without(T.strip(v), ",₹%")
    c = F.when(c.startswith("(") & c.endswith(")"), F.regexp_replace(c, r"^\(|\)$", "")).otherwise(c)
    return ~c.isin(NO_VALUES) & T.strip(c).rlike(NUMBER)


def has(k: Column, signals: list[str]) -> Column:
    return T.contains_any(F.lower(k), signals)


def table_rows(evidence: DataFrame) -> DataFrame:
    return evidence.where("evidence_type = 'TABLE_ROW'").withColumn("pairs", pairs_of(T.collapse(F.col("text"))))


def route_rows(evidence: DataFrame) -> DataFrame:
    """(evidence_id, decision, confidence, reason) of each table row: whether it can be read without a model."""
    n = F.size("pairs")
    values = F.size(F.filter("pairs", lambda p: looks_like_value(p["v"])))
    serial = F.size(F.filter("pairs", lambda p: F.lower(p["k"]).isin(SERIAL_COLUMNS) & ~(has(p["k"], ROUTE_PERIODS) | has(p["k"], PERCENT_COLUMNS) | has(p["k"], [*UNIT_COLUMNS, "units"]))))
    rows = table_rows(evidence).select("evidence_id", n.alias("n"), values.alias("nv"), serial.alias("ns"))
    few, none, plain, noise = F.col("n") < 2, F.col("nv") < 1, (F.col("nv") >= 2) & (F.col("nv") / F.greatest("n", F.lit(1)) >= 0.5), F.col("ns") > F.floor(F.col("n") / 2)
    return rows.select(
        "evidence_id",
        F.when(~few & ~none & plain, "DETERMINISTIC").otherwise("LLM").alias("decision"),
        F.when(few, 0.95).when(none, 0.90).when(plain, F.least(F.lit(0.99), F.round(0.75 + 0.05 * F.col("nv"), 4))).when(noise, 0.85).otherwise(0.70).alias("confidence"),
        F.when(few, FEW_PAIRS).when(none, NO_VALUE_COLUMNS).when(plain, REGULAR_ROW).when(noise, STRUCTURAL).otherwise(AMBIGUOUS).alias("reason"),
    )


def table_identity(caption: Column, text: Column, heading: Column) -> Column:
    first = T.strip(F.substring_index(T.norm(text), ";", 1))
    cap, head = T.norm(caption), T.norm(heading)
    return F.when(T.text_of(caption) != "", cap).when(first.startswith("table "), first).when(head != "", head).when(first != "", first).otherwise("unknown-table")


def row_number_of(text: Column, natural: bool = False) -> Column:
    """The number of a `row …=n` segment, else a billion: rows without one come in the order of their ids.

    natural reads the number of `row n` as extractors write it, so that rows come in the order of the page.
    """
    if natural:
        return F.coalesce(F.regexp_extract(T.norm(text), r"(?:^|; ?)row (\d{1,9})(?: ?;|$)", 1).try_cast("int"), F.lit(NO_ROW_NUMBER))
    seg = F.filter(F.transform(F.split(T.norm(text), ";"), lambda s: T.strip(s)), lambda s: s.startswith("row ") & s.rlike(r"^[^=]*= ?[+-]?\d{1,9} ?$"))
    return F.coalesce(T.strip(F.regexp_replace(F.get(seg, F.lit(0)), "^[^=]*=", "")).try_cast("int"), F.lit(NO_ROW_NUMBER))


def _row_label(pairs: Column, numeric, periods: list[str], units: list[str], metadata) -> Column:
    fits = F.filter(pairs, lambda p: ~numeric(p["v"]) & ~metadata(p["k"]) & ~has(p["k"], periods) & ~has(p["k"], units))
    return F.get(fits, F.lit(0))["v"]


def _table_metadata(k: Column) -> Column:
    n = T.strip(F.lower(k))
    return n.startswith("column_") | n.isin(TABLE_METADATA)


def reconstruct_rows(evidence: DataFrame, natural: bool = False) -> DataFrame:
    """Each table row with its table's identity, row number, label and the values left once label and structure are out."""
    units = [*UNIT_COLUMNS, "units"]
    rows = table_rows(evidence).withColumn("identity", table_identity(F.col("table_caption"), F.col("text"), F.col("section_heading"))).withColumn("row_no", row_number_of(F.col("text"), natural))
    label = F.coalesce(F.nullif("row_label", F.lit("")), _row_label(F.col("pairs"), value_is_numeric, TABLE_PERIODS, units, _table_metadata))
    rows = rows.withColumn("label", label)
    kept = F.filter("pairs", lambda p: ~F.coalesce(p["v"] == F.col("label"), F.lit(False)) & ~_table_metadata(p["k"]))
    keys = F.transform(F.filter("pairs", lambda p: has(p["k"], [*TABLE_PERIODS, *PERCENT_COLUMNS, "yoy"]) | F.lower(p["k"]).rlike("^column_(?:[1-9]|1[0-5])$")), lambda p: p["k"])
    unit_key = F.get(F.filter("pairs", lambda p: has(p["k"], units)), F.lit(0))["k"]
    values = F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"]))
    numeric = F.size(F.filter(kept, lambda p: value_is_numeric(p["v"])))
    return rows.select("evidence_id", "source_file", "page_number", "identity", "row_no", "label", values.alias("values"), keys.alias("keys"), F.coalesce(F.nullif("unit_hint", F.lit("")), unit_key).alias("unit"), F.nullif("table_caption", F.lit("")).alias("caption"), numeric.alias("n_numeric"))


def reconstruct_tables(evidence: DataFrame, natural: bool = False) -> DataFrame:
    """One row a table: rows of a file and page with one identity, in the order of row number and id.

    A table id numbers tables by file, page and identity. deterministic and confidence say whether rows can be read
    without a model. Rows of one table are gathered to an array; a table is bounded by its page. natural: see row_number_of().
    """
    r = reconstruct_rows(evidence, natural)
    row = F.struct("row_no", "evidence_id", "label", "values", "keys", "unit", "caption", "n_numeric")
    t = r.groupBy("source_file", "page_number", "identity").agg(F.sort_array(F.collect_list(row)).alias("r"))
    headers = F.array_distinct(F.flatten(F.transform("r", lambda x: x["keys"])))
    first = lambda f: F.get(F.filter(F.transform("r", lambda x: x[f]), lambda u: u.isNotNull()), F.lit(0))
    valued = F.filter("r", lambda x: F.size(x["values"]) > 0)
    ratio = F.aggregate(valued, F.lit(0.0), lambda a, x: a + x["n_numeric"] / F.size(x["values"])) / F.greatest(F.size(valued), F.lit(1))
    t = t.withColumn("headers", headers).withColumn("unit", first("unit")).withColumn("caption", F.coalesce(first("caption"), F.when(F.col("identity") != "unknown-table", F.col("identity")))).withColumn("_ratio", ratio).withColumn("_valued", F.size(valued))
    headed = (F.size("headers") >= 2) & (F.col("_ratio") >= 0.5)
    united = F.col("unit").isNotNull() & (F.col("_ratio") >= 0.6)
    sure = (F.col("_valued") > 0) & (headed | united)
    confidence = F.when(F.col("_valued") == 0, 0.95).when(headed, F.least(F.lit(0.99), 0.70 + 0.15 * F.least(F.size("headers"), F.lit(2)) + 0.10 * F.col("_ratio"))).when(united, 0.82).otherwise(0.65)
    rows = F.transform("r", lambda x: F.struct(x["evidence_id"].alias("evidence_id"), x["values"].alias("values"), x["label"].alias("row_label")))
    t = t.select("source_file", "page_number", "identity", "caption", "unit", "headers", rows.alias("rows"), sure.alias("deterministic"), confidence.alias("confidence"))
    return numbered(t, ["source_file", "page_number", "identity"], "n").withColumn("table_id", F.format_string("table-%05d", "n")).drop("n")


def table_facts(evidence: DataFrame) -> DataFrame:
    """Facts of table rows: each numeric value of a row with a label and two pairs or more, its column as the time."""
    meta = lambda k: T.strip(F.lower(k)).isin(FACT_METADATA)
    numeric = lambda v: parse_number(v).isNotNull()
    rows = evidence.where("evidence_type = 'TABLE_ROW'").withColumn("pairs", pairs_of(F.col("text"))).where(F.size("pairs") >= 2)
    rows = rows.withColumn("attribute", _row_label(F.col("pairs"), numeric, FACT_PERIODS, UNIT_COLUMNS, meta)).where("attribute is not null")
    rows = rows.withColumn("unit", F.get(F.filter("pairs", lambda p: has(p["k"], UNIT_COLUMNS)), F.lit(0))["k"])
    one = rows.select("evidence_id", "source_file", "page_number", "entity_hint", "attribute", "unit", F.explode("pairs").alias("p")).withColumn("normalized_value", parse_number(F.col("p.v")))
    kept = one.where((F.col("p.k") != F.col("attribute")) & F.col("normalized_value").isNotNull() & ~meta(F.col("p.k")))
    return kept.select(T.sha16(F.col("evidence_id"), F.col("p.k"), F.col("p.v")).alias("fact_id"), F.coalesce(F.nullif("entity_hint", F.lit("")), F.lit("UNKNOWN")).alias("entity"), "attribute", F.col("p.v").alias("raw_value"), "unit", "normalized_value", F.col("p.k").alias("time"), "source_file", "page_number", "evidence_id", F.lit(9).alias("extraction_confidence"), F.lit("VALID").alias("status"))


def split_tables(tables: DataFrame, max_tokens: int = BATCH_TOKENS) -> DataFrame:
    """(table_id, chunk_no, rows, n_tokens): rows of tables that need a model, batched whole and in order; each batch repeats the header's cost."""
    open_ = tables.where("not deterministic")
    header = F.array_join(F.filter(F.concat(F.array("caption", "unit"), "headers"), lambda x: F.coalesce(x, F.lit("")) != ""), " ")
    rows = open_.select("table_id", F.greatest(F.lit(1), F.floor(F.length(header) / 4)).cast("int").alias("base"), F.posexplode("rows").alias("ord", "r"))
    text = F.array_join(F.concat(F.array(F.coalesce("r.row_label", F.lit(""))), "r.values"), " ")
    costed = rows.select("table_id", "base", "ord", F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int").alias("cost"), "r.evidence_id")
    chunks = greedy_chunks(costed, ["table_id"], ["ord", "evidence_id"], max_tokens, base="base")
    return chunks.groupBy("table_id", "chunk_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "evidence_id"))), lambda x: x["evidence_id"]).alias("evidence_ids"), (F.sum("cost") + F.max("base")).alias("n_tokens"))
