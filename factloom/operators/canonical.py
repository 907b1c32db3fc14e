"""Facts canonicalised: attribute, time and value cleaned, unclear ones set aside."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Vocabularies and patterns of canonicalisation.
GENERIC = ["value", "amount", "number", "metric", "figure", "data", "result", "total value", "aggregated value"]
TIMES = [
    r"\bq[1-4]\s*fy\s*\d{2,4}\b",
    r"\bfy\s*\d{2,4}\b",
    r"\bq[1-4]\b",
    r"\bfiscal\s+\d{4}\b",
    r"\bnine months(?: period)? ended [a-z]+\s+\d{1,2},\s+\d{4}\b",
    r"\bsix months(?: period)? ended [a-z]+\s+\d{1,2},\s+\d{4}\b",
    r"\bthree months(?: period)? ended [a-z]+\s+\d{1,2},\s+\d{4}\b",
]
CONTEXT_WORDS = ["the", "of", "from", "for", "in", "on", "at", "to", "and", "by", "as", "basis", "period", "ended", "during", "year", "quarter", "fiscal", "financial"]
MODIFIERS = ["total", "overall", "annual"]
SEMANTIC = ["margin", "growth", "change", "yoy", "qoq", "mom", "rate", "ratio", "share", "yield", "volume", "count", "ton", "tons", "tonnage", "shipment", "shipments", "revenue", "ebitda", "pat", "profit", "loss", "fleet", "size", "customer", "customers", "order", "orders", "center", "centers", "centre", "centres", "facility", "facilities", "adjusted", "adj"]
SINGULAR = {"shipments": "shipment", "customers": "customer", "orders": "order", "centres": "center", "centers": "center", "facilities": "facility", "tonnes": "ton", "tons": "ton"}
NUMERIC = r"(?i)(?:-|\()?[" + T.WS + r"]*(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)[" + T.WS + r"]*(?:%|cr|mn|bn|million|billion|thousand|k|m|b|crore|lakhs?|lacs?)?"


def norm_text(c: Column) -> Column:
    """Lower case, underscores and odd signs as spaces, single spaces."""
    t = F.replace(F.lower(T.strip(c)), F.lit("_"), F.lit(" "))
    return T.collapse(F.regexp_replace(t, r"[^a-z0-9%()/.,\-" + T.WS + "]", " "))


def extract_time(c: Column) -> Column:
    """The earliest period in the text; of those that start at one place the first pattern's."""
    n = norm_text(c)
    hits = F.array(*[F.struct(F.regexp_instr(n, F.lit(p)).alias("at"), F.lit(i).alias("i"), F.trim(F.regexp_extract(n, p, 0)).alias("t")) for i, p in enumerate(TIMES)])
    return F.array_min(F.filter(hits, lambda h: h["at"] > 0))["t"]


def remove_time(c: Column) -> Column:
    return T.collapse(reduce(lambda t, p: F.regexp_replace(t, p, " "), TIMES, norm_text(c)))


def clean_attribute(c: Column) -> Column:
    return F.array_join(F.filter(T.words(remove_time(c)), lambda w: ~w.isin(CONTEXT_WORDS + MODIFIERS)), " ")


def has_semantic_content(c: Column) -> Column:
    return F.arrays_overlap(T.words(norm_text(c)), F.array(*[F.lit(s) for s in SEMANTIC]))


def numeric_candidates(c: Column) -> Column:
    """Numbers with their units as written; bare whole numbers from 1900 to 2100 are years and left out."""
    found = F.transform(F.regexp_extract_all(T.text_of(c), F.lit(NUMERIC), F.lit(0)), lambda x: T.strip(x))
    number = lambda x: F.regexp_replace(x, r"[^0-9.]", "").try_cast("double")
    bare = lambda x: ~x.rlike(r"[A-Za-z%]$") & (number(x) == F.floor(number(x))) & number(x).between(1900, 2100)
    return F.filter(found, lambda x: ~F.coalesce(bare(x), F.lit(False)))


def singular(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SINGULAR.items() for x in kv])
    return F.array_join(F.transform(T.words(c), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def derive_attribute(attribute: Column, others: list[Column]) -> Column:
    """The cleaned attribute unless empty or generic; else the first other field that is neither and names a measure; else ''."""
    fits = lambda c: (c != "") & ~c.isin(GENERIC)

    def after(rest: list[Column]) -> Column:
        if not rest:
            return F.lit("")
        return T.let(clean_attribute(rest[0]), lambda c: F.when(fits(c) & has_semantic_content(c), c).otherwise(after(rest[1:])))

    return T.let(clean_attribute(attribute), lambda own: F.when(fits(own), own).otherwise(after(others)))


def canonicalize(facts: DataFrame) -> DataFrame:
    """Facts with entity, attribute, time and raw_value brought to one form; VALID ones whose attribute stays unclear become UNCERTAIN.

    Only VALID facts are touched (a null status counts as VALID). A time is taken from the attribute if there is none;
    a value without a number is replaced by the quote's if that has exactly one and no normalized value is set.
    """
    valid = F.coalesce("status", F.lit("VALID")) == "VALID"
    column = [F.col("column_name")] if "column_name" in facts.columns else []
    attribute = singular(clean_attribute(derive_attribute(F.col("attribute"), [*column, F.col("qualifier"), F.col("exact_quote")])))
    named = T.text_of("time") != ""
    f = facts.withColumn("_a", attribute)
    time = F.when(named, norm_text(F.col("time"))).when(F.col("_a") != "", norm_text_or_null(extract_time(F.col("attribute")))).otherwise(F.col("time"))
    lacks = (T.text_of("raw_value") != "") & F.col("normalized_value").isNull() & (F.size(numeric_candidates(F.col("raw_value"))) == 0)
    only = T.let(numeric_candidates(F.col("exact_quote")), lambda q: F.when(F.size(q) == 1, F.get(q, F.lit(0))))
    changes = {
        "entity": F.when(T.text_of("entity") != "", T.strip(F.col("entity"))).otherwise(F.col("entity")),
        "attribute": F.col("_a"),
        "time": F.coalesce(time, F.col("time")),
        "raw_value": F.coalesce(F.when(lacks, only), F.col("raw_value")),
        "status": F.when((F.col("_a") == "") | F.col("_a").isin(GENERIC), "UNCERTAIN").otherwise(F.col("status")),
    }
    return f.select(*[F.when(valid, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in facts.columns])


def norm_text_or_null(c: Column) -> Column:
    return F.when(c.isNotNull(), norm_text(c))
