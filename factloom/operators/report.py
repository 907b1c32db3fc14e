"""Contexts ranked by keywords, statistics, answers, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .grounding import full_text

ANSWERS = 8


def keyword_score(text: Column, keywords: list[str]) -> Column:
    """A point for each keyword in the text, and one for every three words with a digit, ten of those at most; 0 without keywords."""
    clean = [k.strip().lower() for k in keywords]
    if not clean:
        return F.lit(0)
    low = F.lower(T.text_of(text))
    hits = F.lit(0)
    for k in clean:
        if k:
            hits = hits + F.contains(low, F.lit(k)).cast("int")
    digits = F.size(F.filter(T.words(T.collapse(low)), lambda w: w.rlike(r"\p{Nd}")))
    return hits + F.least(F.floor(digits / 3), F.lit(10)).cast("int")


def context_scores(contexts: DataFrame, keywords: list[str]) -> DataFrame:
    """(context_id, document, score): document is the file of the context's first evidence."""
    one = contexts.where("context_id is not null").groupBy("context_id").agg(F.max_by("evidence", F.struct("loaded_at", F.xxhash64("evidence"))).alias("evidence"))
    return one.select("context_id", T.text_of(F.get("evidence", F.lit(0))["source_file"]).alias("document"), keyword_score(full_text(F.col("evidence")), keywords).alias("score"))


def top_contexts(scores: DataFrame, limit: int = 1) -> DataFrame:
    """The contexts of highest score of each document, of equals the first; a rank limit the planner applies before the shuffle."""
    w = Window.partitionBy("document").orderBy(F.desc("score"), "context_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def distinct_keywords(df: DataFrame, keyword: str, place: str) -> DataFrame:
    """(keyword, place): keywords trimmed and in lower case, each once at its first place; empty ones left out."""
    k = T.strip(F.lower(F.col(keyword)))
    return df.select(k.alias("keyword"), F.col(place).alias("place")).where("keyword <> ''").groupBy("keyword").agg(F.min("place").alias("place"))


def relationship_stats(relationships: DataFrame) -> DataFrame:
    """One row: related pairs and how many of each status."""
    n = lambda s: F.count_if(F.col("status") == s)
    return relationships.agg(F.count(F.lit(1)).alias("candidate_relationships"), n("CORROBORATION").alias("corroborations"), n("CONTRADICTION").alias("contradictions"), n("CONTEXTUAL_RESOLUTION").alias("contextual_resolutions"), n("UNCERTAIN").alias("uncertain"))


def document_stats(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """(source_file, fact_count, valid_fact_count, uncertain_fact_count, grounding_failure_count) of each document, those without facts too."""
    status = F.coalesce("status", F.lit("VALID"))
    n = lambda s: F.count_if(status == s)
    counts = facts.groupBy("source_file").agg(F.count(F.lit(1)).alias("fact_count"), n("VALID").alias("valid_fact_count"), n("UNCERTAIN").alias("uncertain_fact_count"), n("GROUNDING_FAILURE").alias("grounding_failure_count"))
    return documents.select("source_file").distinct().join(counts, "source_file", "left").na.fill(0)


def ask(facts: DataFrame, question: str, limit: int = ANSWERS) -> DataFrame:
    """The facts that hold most of the question's words of three letters or more, the best first, of equals by id."""
    words = sorted({w for w in question.strip().lower().split() if len(w) > 2})
    if not question.strip():
        raise ValueError("the question is empty")
    text = F.lower(F.concat_ws(" ", *[T.text_of(c) for c in ("entity", "attribute", "raw_value", "time", "scope")]))
    score = F.lit(0)
    for w in words:
        score = score + F.contains(text, F.lit(w)).cast("int")
    return facts.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "fact_id").limit(limit)


def fact_json() -> Column:
    """A fact as a JSON object; five fields are '' where null, the others left out."""
    filled = [T.text_of(c).alias(c) for c in ("entity", "attribute", "raw_value", "exact_quote", "evidence_id")]
    return F.to_json(F.struct(*filled, "unit", "normalized_value", "time", "scope", "qualifier", "extraction_confidence", "status"))


def save_analysis(tables: dict[str, DataFrame], folder: str, analysis_id: str) -> None:
    """The tables of an analysis as Parquet under its id; a rerun replaces that analysis and no other."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/analysis_id={analysis_id}")


def load_analysis(spark, folder: str, name: str, analysis_id: str) -> DataFrame:
    """A table of an analysis; only its own files are read. An unknown id raises LookupError."""
    path = f"{folder}/{name}/analysis_id={analysis_id}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        raise LookupError(analysis_id)
    return spark.read.parquet(path)
