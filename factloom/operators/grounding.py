"""Facts held against the evidence they name; contexts as prompt text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def context_evidence(contexts: DataFrame) -> DataFrame:
    """(context_id, ord, e): the evidence of each context in order, one row per context and place."""
    one = contexts.where("context_id is not null").groupBy("context_id").agg(F.max_by("evidence", F.struct("loaded_at", F.xxhash64("evidence"))).alias("evidence"))
    return one.select("context_id", F.posexplode("evidence").alias("ord", "e")).where("e is not null")


def serialize(e: Column) -> Column:
    """One piece of evidence as the block a model reads; fields that are null or empty are left out."""
    present = lambda label, c: F.when(T.text_of(c) != "", F.concat(F.lit(label), c, F.lit("\n"))).otherwise("")
    cell = lambda c, j: F.concat(F.lit("    CELL "), j.cast("string"), F.lit(": "), T.text_of(c), F.lit("\n"))
    headers = F.when(F.size(e["table_headers"]) > 0, F.concat(F.lit("TABLE_HEADERS:\n"), F.array_join(F.transform(e["table_headers"], lambda h, i: F.concat(F.lit("  HEADER "), i.cast("string"), F.lit(": "), T.text_of(h))), "\n"), F.lit("\n"))).otherwise("")
    rows = F.when(F.size(e["table_rows"]) > 0, F.concat(F.lit("TABLE_ROWS:\n"), F.array_join(F.transform(e["table_rows"], lambda r, i: F.concat(F.lit("  ROW "), i.cast("string"), F.lit(":\n"), F.array_join(F.transform(r, cell), ""))), ""))).otherwise("")
    top = F.concat(F.lit("EVIDENCE_ID: "), T.text_of(e["evidence_id"]), F.lit("\nSOURCE_FILE: "), T.text_of(e["source_file"]), F.lit("\nPAGE: "), F.coalesce(e["page_number"].cast("string"), F.lit("")), F.lit("\n"))
    return F.concat(top, present("ELEMENT_TYPE: ", e["element_type"]), present("TABLE_REF: ", e["table_ref"]), headers, rows, F.lit("TEXT:\n"), T.text_of(e["text"]), F.lit("\n"))


def serialize_contexts(contexts: DataFrame) -> DataFrame:
    """(context_id, prompt): the blocks of a context's evidence, an empty line between them."""
    blocks = context_evidence(contexts).select("context_id", "ord", serialize(F.col("e")).alias("b"))
    return blocks.groupBy("context_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "b"))), lambda x: x["b"]), "\n\n").alias("prompt"))


def full_text(evidence: Column) -> Column:
    """Texts of the evidence, each followed by its headers and cells, by lines."""
    none, rows = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    cells = lambda a: F.transform(F.coalesce(a, none), lambda c: T.text_of(c))
    part = lambda e: F.array_join(F.concat(F.array(T.text_of(e["text"])), F.filter(F.concat(F.array(F.array_join(cells(e["table_headers"]), " ")), F.transform(F.coalesce(e["table_rows"], rows), lambda r: F.array_join(cells(r), " "))), lambda x: x != "")), " ")
    return T.strip(F.array_join(F.transform(F.filter(evidence, lambda e: e.isNotNull()), part), "\n"))


def half_text(evidence: Column) -> Column:
    """The first half of a context's text by characters, one at least; '' without text."""
    t = T.text_of(full_text(evidence))
    return F.when(t == "", "").otherwise(F.substring(t, F.lit(1), F.greatest(F.floor(F.length(t) / 2), F.lit(1)).cast("int")))


def contained(part: Column, whole: Column) -> Column:
    """part stands in whole as it is, or both without regard to white space and letter case."""
    return F.contains(whole, part) | F.contains(T.norm(whole), T.norm(part))


def ground(facts: DataFrame, contexts: DataFrame) -> DataFrame:
    """facts with status, and, for table facts, value, column, id and quote bound to the cell they point to.

    facts: context_id, entity, attribute, raw_value, exact_quote, evidence_id, table_ref, row_index, column_index and others. A fact without
    entity, attribute or value is UNCERTAIN; one with table_ref is VALID if the cell exists and is filled; else one with
    evidence_id if its quote is in the evidence and its value in the quote; all others are GROUNDING_FAILURE. normalized_value
    is cleared. Of evidence repeated in a context the last counts. The lookups are equi-joins on context and id.
    """
    e = context_evidence(contexts)
    by_id = e.groupBy("context_id", F.col("e.evidence_id").alias("evidence_id")).agg(F.max_by(F.col("e.text"), "ord").alias("_text"))
    by_ref = e.where(T.text_of(F.col("e.table_ref")) != "").groupBy("context_id", F.col("e.table_ref").alias("table_ref")).agg(F.max_by(F.struct("e.table_headers", "e.table_rows", "e.table_evidence_ids"), "ord").alias("_t"))
    f = facts.join(by_id, ["context_id", "evidence_id"], "left").join(by_ref, ["context_id", "table_ref"], "left")
    filled = lambda c: T.text_of(c) != ""
    r, c = F.col("row_index"), F.col("column_index")
    row = F.when(r >= 0, F.get("_t.table_rows", r))
    cell = T.strip(F.when(c >= 0, F.get(row, c)))
    cell_ok = F.coalesce(cell != "", F.lit(False))
    quote, source = T.strip(F.col("exact_quote")), T.strip(F.col("_text"))
    prose_ok = (quote != "") & (source != "") & contained(quote, source) & ((T.strip(F.col("raw_value")) == "") | contained(T.strip(F.col("raw_value")), quote))
    full = filled("entity") & filled("attribute") & filled("raw_value")
    status = F.when(~full, "UNCERTAIN").when(filled("table_ref"), F.when(cell_ok, "VALID").otherwise("GROUNDING_FAILURE")).when(filled("evidence_id"), F.when(prose_ok, "VALID").otherwise("GROUNDING_FAILURE")).otherwise("GROUNDING_FAILURE")
    bound = full & filled("table_ref") & cell_ok
    changes = {
        "status": status,
        "normalized_value": F.lit(None).cast("double"),
        "raw_value": F.when(bound, cell).otherwise(F.col("raw_value")),
        "column_name": F.when(bound, F.get("_t.table_headers", c)),
        "evidence_id": F.when(bound, F.coalesce(F.get("_t.table_evidence_ids", r), F.concat("table_ref", F.lit(":row:"), r.cast("string")))).otherwise(F.col("evidence_id")),
        "exact_quote": F.when(bound, F.array_join(F.transform(row, lambda x: T.text_of(x)), " | ")).otherwise(F.col("exact_quote")),
    }
    new = [v.alias(k) for k, v in changes.items() if k not in facts.columns]
    return f.select(*[changes.get(k, F.col(k)).alias(k) for k in facts.columns], *new)
