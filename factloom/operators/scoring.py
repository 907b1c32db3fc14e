"""Evidence worth extracting from: scores, repeats, structure, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MIN_SCORE = 5


def worthiness() -> Column:
    """Points for numbers, unit, time, entity, table rows and metrics, less some for short texts and notices; 0 for empty ones."""
    t = T.strip(F.col("text"))
    low = F.lower(T.text_of("text"))
    number = F.coalesce(F.size("number_hints") > 0, F.lit(False))
    filled = lambda c: T.text_of(c) != ""
    parts = [(number, 3), (filled("unit_hint"), 3), (filled("time_hint"), 2), (filled("entity_hint"), 2), (F.coalesce("evidence_type", F.lit("")) == "TABLE_ROW", 3), (T.contains_any(low, T.CANDIDATE_METRICS), 2), (number & (F.length(t) >= 40), 1), (F.length(t) < 20, -3), (T.contains_any(F.lower(t), T.METADATA), -5)]
    total = F.lit(0)
    for condition, points in parts:
        total = total + F.when(condition, points).otherwise(0)
    return F.when(t == "", 0).otherwise(total)


def fact_candidates(evidence: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """Evidence of min_score points or more, with its score."""
    return evidence.withColumn("score", worthiness()).where(F.col("score") >= min_score)


def drop_repeats(evidence: DataFrame) -> DataFrame:
    """The first unit (by id) of each text, type, heading, caption, labels, file and page: repeats in other files stay."""
    n = lambda c: T.norm(F.col(c))
    key = [n("text"), F.col("evidence_type"), n("section_heading"), n("table_caption"), n("row_label"), n("column_label"), F.col("source_file"), F.col("page_number")]
    # Hashed first: the key's texts needn't be shuffled.
    keyed = evidence.withColumn("_key", F.md5(F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]))))
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("evidence_id"))).where("_n = 1").drop("_n", "_key")


def is_low_information() -> Column:
    t = T.norm(F.col("text"))
    short = lambda n: F.length(t) < n
    has = lambda s: F.contains(t, F.lit(s))
    return (t == "") | (has("annual report") & short(120)) | (has("cin:") & short(250)) | (has("all amounts in indian rupees") & short(250)) | ((F.coalesce("evidence_type", F.lit("")) == "TABLE_ROW") & short(20))


def structural_class() -> Column:
    number = F.coalesce(F.size("number_hints") > 0, F.lit(False))
    tied = (T.text_of("unit_hint") != "") | (T.text_of("time_hint") != "")
    kind = F.coalesce("evidence_type", F.lit(""))
    return F.when(kind == "HEADING", "heading").when(number & tied, "quantitative").when(number, "numeric").when(kind == "TABLE_ROW", "table").otherwise("prose")


def topic_labels(members: DataFrame, group: list[str]) -> DataFrame:
    """(group…, topic_label): the commonest heading (of equals the first seen), else the first caption, else the first text's start.

    Members are in the order of file, page and id. Headings are counted before the shuffle to groups.
    """
    place = F.struct(T.text_of("source_file").alias("f"), "page_number", "evidence_id")
    m = members.withColumn("_p", place)
    heads = m.where(T.text_of("section_heading") != "").groupBy(*group, "section_heading").agg(F.count(F.lit(1)).alias("n"), F.min("_p").alias("p"))
    best = heads.groupBy(*group).agg(F.min_by("section_heading", F.struct(-F.col("n"), "p")).alias("heading"))
    rest = m.groupBy(*group).agg(F.min_by("table_caption", F.when(T.text_of("table_caption") != "", F.col("_p"))).alias("caption"), F.min_by(F.substring(T.text_of("text"), 1, 100), F.col("_p")).alias("first"))
    return rest.join(best, group, "left").select(*group, F.coalesce("heading", "caption", "first").alias("topic_label"))
