"""Facts compared across documents: compatible pairs, similarity, relationship."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from .embed import filled_places, hash_counts, identity_text, sparse_dot

THRESHOLD = 0.75
#: Relative difference up to which two values are equal.
TOLERANCE = 0.001

# Words that are no part of an attribute, and those that make it another one.
STOP = ["the", "of", "from", "for", "in", "on", "at", "to", "and", "by", "fy", "q1", "q2", "q3", "q4", "annual", "year", "quarter", "yoy", "qoq", "mom", "since", "inception"]
DIMENSIONS = ["adjusted", "adj", "margin", "growth", "change", "rate", "ratio", "share", "yield", "volume", "value", "count", "size", "ton", "tonnage", "shipment", "revenue", "sales", "ebitda", "pat", "profit", "loss", "fleet", "customer", "order", "center", "facility", "hub"]
CURRENCY = r"\b(?:cr|mn|million|billion|thousand|rs)\b|₹"
VOLUME = r"\b(?:ton|tons|tonne|tonnes|shipment|shipments)\b"


def norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(T.text_of(c)), "[^a-z0-9%]+", " "))


def value_number(raw: Column) -> Column:
    """The first number of a raw value times its scale word, negative after a minus or in parentheses; null without one.

    Scales are read as words, but for billion, million and thousand, which count anywhere; crore and lakh do not scale.
    """
    low = T.strip(F.lower(T.text_of(raw)))
    t = F.when(low.startswith("(") & low.endswith(")"), F.concat(F.lit("-"), F.regexp_replace(low, r"^\(|\)$", ""))).otherwise(low)
    negative = t.rlike(f"(?:^|[{T.WS}(])-")
    bare = F.regexp_replace(t, r"[,₹%]|rs\.|rs", "")
    number = F.regexp_extract(bare, r"\d+(?:\.\d+)?", 0).try_cast("double")
    word = lambda w: bare.rlike(rf"\b{w}\b")
    factor = F.when(F.contains(bare, F.lit("billion")) | word("bn"), 1e9).when(F.contains(bare, F.lit("million")) | word("mn"), 1e6).when(F.contains(bare, F.lit("thousand")) | word("k"), 1e3).when(word("cr"), 1e7).when(word("m"), 1e6).otherwise(1.0)
    return F.when(negative, -number * factor).otherwise(number * factor)


def unit_type(raw: Column) -> Column:
    t = F.lower(T.text_of(raw))
    return F.when(F.contains(t, F.lit("%")), "PERCENT").when(t.rlike(CURRENCY), "CURRENCY").when(t.rlike(VOLUME), "VOLUME").when(value_number(raw).isNotNull(), "NUMBER").otherwise("TEXT")


def attribute_tokens(c: Column) -> Column:
    """The distinct words of an attribute without stop words, in order of spelling."""
    return F.array_sort(F.array_except(F.array_distinct(T.words(norm(c))), F.array(*[F.lit(s) for s in STOP])))


def document_of(source_file: Column, evidence_id: Column, table_ref: Column | None = None) -> Column:
    head = lambda c: F.nullif(F.substring_index(F.nullif(c, F.lit("")), ":", 1), F.lit(""))
    refs = [head(table_ref)] if table_ref is not None else []
    return F.coalesce(F.nullif(source_file, F.lit("")), *refs, head(evidence_id), F.lit("unknown"))


def entity_compatible(a: Column, b: Column) -> Column:
    """Normalised entities: either empty, or one within the other."""
    return (a == "") | (b == "") | F.contains(a, b) | F.contains(b, a)


def attribute_compatible(a: Column, b: Column) -> Column:
    """Token sets: neither empty, one within the other, and no dimension among what the larger has more."""
    more = F.when(F.size(F.array_except(a, b)) == 0, F.array_except(b, a)).when(F.size(F.array_except(b, a)) == 0, F.array_except(a, b))
    return (F.size(a) > 0) & (F.size(b) > 0) & more.isNotNull() & ~F.arrays_overlap(F.coalesce(more, F.array().cast("array<string>")), F.array(*[F.lit(d) for d in DIMENSIONS]))


def compatible_entities(entities: DataFrame) -> DataFrame:
    """(e, e2) of all compatible entities of a distinct column e, each with itself too.

    An entity within another holds its first three letters there, so pairs meet on those; nothing is compared with all.
    An empty entity goes with every one and makes two rows for each.
    """
    e = entities.select("e")
    filled = e.where("e <> ''")
    grams = filled.select(F.col("e").alias("whole"), F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("e")), lambda i: F.array(*[F.substring(F.col("e"), i, F.lit(n)) for n in (1, 2, 3)]))))).alias("g"))
    inner = filled.select(F.col("e").alias("part"), F.substring("e", 1, 3).alias("g")).join(grams, "g").where(F.contains("whole", F.col("part"))).select("part", "whole").distinct()
    ways = inner.select(F.col("part").alias("e"), F.col("whole").alias("e2")).unionByName(inner.select(F.col("whole").alias("e"), F.col("part").alias("e2")))
    # With the empty entity, if there is one.
    with_all = e.select("e", F.lit("").alias("e2")).join(e.select(F.col("e").alias("e2")), "e2", "left_semi").select("e", "e2")
    return ways.unionByName(with_all).unionByName(with_all.select(F.col("e2").alias("e"), F.col("e").alias("e2"))).distinct()


def compatible_attributes(attributes: DataFrame) -> DataFrame:
    """(a, a2) of all compatible token sets of a distinct array column a: a smaller set's first token is in the larger."""
    sets = attributes.where(F.size("a") > 0).select("a")
    larger = sets.select(F.col("a").alias("whole"), F.explode("a").alias("t"))
    inner = sets.select(F.col("a").alias("part"), F.get("a", F.lit(0)).alias("t")).join(larger, "t").where(attribute_compatible(F.col("part"), F.col("whole")) & (F.size(F.array_except("part", "whole")) == 0)).select("part", "whole")
    return inner.select(F.col("part").alias("a"), F.col("whole").alias("a2")).unionByName(inner.select(F.col("whole").alias("a"), F.col("part").alias("a2"))).distinct()


def fact_classes(facts: DataFrame) -> DataFrame:
    """VALID facts that say the same in the same document, as one row: its smallest id and the number of facts.

    What is compared later is worked out once a class: normalised fields, value, unit type, vector.
    """
    doc = document_of(F.col("source_file"), F.col("evidence_id"), F.col("table_ref") if "table_ref" in facts.columns else None)
    key = ["doc", "entity", "attribute", "time", "scope", "qualifier", "raw_value"]
    c = facts.where((F.coalesce("status", F.lit("VALID")) == "VALID") & F.col("fact_id").isNotNull()).withColumn("doc", doc).groupBy(*key).agg(F.min("fact_id").alias("fact_id"), F.countDistinct("fact_id").alias("members"))
    c = c.withColumn("e", norm(F.col("entity"))).withColumn("a", attribute_tokens(F.col("attribute"))).withColumn("v", value_number(F.col("raw_value"))).withColumn("u", unit_type(F.col("raw_value"))).withColumn("t", norm(F.col("time"))).withColumn("s", norm(F.col("scope")))
    c = c.withColumn("has_t", T.text_of("time") != "").withColumn("has_s", T.text_of("scope") != "").withColumn("counts", hash_counts(identity_text()))
    c = c.withColumn("filled", filled_places(F.col("counts")))
    return c.select("fact_id", "members", "doc", "e", "a", "v", "u", "t", "s", "has_t", "has_s", "counts", "filled", sparse_dot(F.col("filled"), F.col("counts")).alias("norm2"))


def candidate_pairs(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of classes of different documents, compatible in entity and attribute, with similarity of at least threshold.

    Which entities and attributes go together is found on their distinct values; classes then meet by equi-joins on both
    keys, so only compatible pairs are ever formed. The threshold is tested on whole numbers, free of rounding.
    """
    pairs_e, pairs_a = written(compatible_entities(classes.select("e").distinct()), "entities"), written(compatible_attributes(classes.select("a").distinct()), "attributes")
    # Classes meet as narrow rows; the rest of their columns is joined to the pairs that are left.
    slim = lambda x: classes.select(*[F.col(c).alias(f"{c}_{x}") for c in ("fact_id", "doc", "a", "e")])
    rest = lambda x: classes.select(*[F.col(c).alias(f"{c}_{x}") for c in classes.columns if c not in ("doc", "a", "e")])
    pairs_a, pairs_e = pairs_a.select(F.col("a").alias("a_a"), F.col("a2").alias("a_b")), pairs_e.select(F.col("e").alias("e_a"), F.col("e2").alias("e_b"))
    ids = slim("a").join(pairs_a, "a_a").join(pairs_e, "e_a").join(slim("b"), ["a_b", "e_b"]).where("fact_id_a < fact_id_b and doc_a <> doc_b").select("fact_id_a", "fact_id_b")
    meet = ids.join(rest("a"), "fact_id_a").join(rest("b"), "fact_id_b")
    scored = meet.withColumn("_dot", sparse_dot(F.col("filled_a"), F.col("counts_b")).cast("double")).withColumn("_n", F.col("norm2_a").cast("double") * F.col("norm2_b"))
    near = scored.where((F.col("_n") > 0) & (F.col("_dot") * F.col("_dot") >= threshold * threshold * F.col("_n")))
    return near.withColumn("similarity", F.round(F.col("_dot") / F.sqrt("_n"), 3)).drop("_dot", "_n", "counts_a", "counts_b", "filled_a", "filled_b", "norm2_a", "norm2_b")


def relationship() -> Column:
    """(status, confidence, rule) of a pair: the first rule that holds."""
    va, vb = F.col("v_a"), F.col("v_b")
    equal = F.abs(va - vb) <= TOLERANCE * F.greatest(F.abs(va), F.abs(vb), F.lit(1.0))
    both = lambda c: (F.col(c + "_a") != "") & (F.col(c + "_b") != "")
    same = lambda c: both(c) & (F.col(c + "_a") == F.col(c + "_b"))
    differs = lambda c: both(c) & (F.col(c + "_a") != F.col(c + "_b"))
    any_t, any_s = F.col("has_t_a") | F.col("has_t_b"), F.col("has_s_a") | F.col("has_s_b")
    context = (~any_t | same("t")) & (~any_s | same("s"))
    out = lambda status, confidence, rule: F.struct(F.lit(status).alias("status"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule"))
    return (
        F.when(va.isNull() | vb.isNull(), out("UNCERTAIN", 4, "value not numeric"))
        .when(F.col("u_a") != F.col("u_b"), out("UNCERTAIN", 7, "unit types differ"))
        .when(equal & context, out("CORROBORATION", 9, "same context, equal values"))
        .when(~equal & context & (any_t | any_s), out("CONTRADICTION", 9, "same context, different values"))
        .when(~equal & (differs("t") | differs("s")), out("CONTEXTUAL_RESOLUTION", 7, "time or scope differs"))
        .when(equal, out("UNCERTAIN", 6, "equal values, context incomplete"))
        .otherwise(out("UNCERTAIN", 4, "context incomplete"))
    )


def classify(pairs: DataFrame) -> DataFrame:
    """(relationship_id, fact_a_id, fact_b_id, members_a, members_b, similarity, status, confidence, rule, resolution_method)."""
    c = pairs.withColumn("_r", relationship())
    return c.select(T.sha16(F.col("fact_id_a"), F.col("fact_id_b")).alias("relationship_id"), F.col("fact_id_a").alias("fact_a_id"), F.col("fact_id_b").alias("fact_b_id"), "members_a", "members_b", "similarity", "_r.status", "_r.confidence", "_r.rule", F.lit("DETERMINISTIC").alias("resolution_method"))


def classify_relationships(facts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All related pairs of fact classes with their label. A fact's class is by fact_classes(); facts of one class share its pairs."""
    return classify(candidate_pairs(written(fact_classes(facts), "classes"), threshold))
