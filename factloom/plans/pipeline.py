"""The analysis as one plan: elements to contexts, contexts to facts, facts to relationships and a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import canonical, cleanup, extraction, grounding, matching, packing, report
from ..session import written
from . import inputs as I


def front_end(elements: DataFrame, target: int = packing.API_TOKENS) -> dict[str, DataFrame]:
    """Blocks, filtered blocks and contexts (with context_id and document) of elements."""
    blocks = written(cleanup.merge_blocks(elements), "blocks")
    kept = written(cleanup.filter_elements(blocks), "kept")
    chunks = packing.structured_chunks(kept, target)
    contexts = chunks.select(F.concat("source_file", F.lit("#"), F.format_string("context-%05d", "chunk_no")).alias("context_id"), F.col("source_file").alias("document"), "evidence", "estimated_tokens", F.lit(None).cast("timestamp").alias("loaded_at"))
    return {"blocks": blocks, "kept": kept, "contexts": written(contexts, "contexts")}


def document_counts(elements: DataFrame, front: dict[str, DataFrame]) -> DataFrame:
    """(source_file, raw_elements, clean_elements, filtered_elements, context_count) of every document."""
    n = lambda df, key, name: df.groupBy(F.col(key).alias("source_file")).agg(F.count(F.lit(1)).alias(name))
    out = n(elements, "source_file", "raw_elements")
    for df, key, name in ((front["blocks"], "source_file", "clean_elements"), (front["kept"], "source_file", "filtered_elements"), (front["contexts"], "document", "context_count")):
        out = out.join(n(df, key, name), "source_file", "left")
    return out.na.fill(0)


def analyze(elements: DataFrame, make: Callable[[], extraction.Extractor] = extraction.RuleExtractor, per_document: int = 1) -> dict[str, DataFrame]:
    """Documents, facts, relationships and stats: shared terms rank the contexts, the best are read by the extractor, facts are grounded, canonicalised and compared."""
    front = front_end(elements)
    terms = [r.keyword for r in extraction.shared_terms(front["contexts"]).collect()]  # twelve at most
    best = report.top_contexts(report.context_scores(front["contexts"], terms), per_document)
    chosen = written(front["contexts"].join(best.select("context_id"), "context_id", "left_semi"), "chosen")
    prompts = grounding.serialize_contexts(chosen)
    raw = written(extraction.extract_facts(prompts, make), "facts")
    found = raw.where("error is null").drop("error").withColumn("normalized_value", F.lit(None).cast("double"))
    facts = canonical.canonicalize(grounding.ground(found, chosen))
    facts = facts.withColumn("source_file", F.substring_index("context_id", "#", 1)).withColumn("fact_id", T.sha16(F.col("context_id"), F.col("attribute"), F.col("raw_value"), F.col("exact_quote"), F.col("evidence_id")))
    facts = written(facts, "facts")
    pairs = written(matching.classify_relationships(facts), "relationships")
    documents = document_counts(elements, front).join(report.document_stats(elements.select("source_file"), facts), "source_file", "left")
    return {"documents": documents, "facts": facts, "relationships": pairs, "stats": report.relationship_stats(pairs), "errors": raw.where("error is not null").select("context_id", "error")}


def process_counts(spark: SparkSession, d: str) -> DataFrame:
    e = written(I.elements(spark, d), "elements")
    return document_counts(e, front_end(e))


def analysis_documents(spark: SparkSession, d: str) -> DataFrame:
    return analyze(written(I.elements(spark, d), "elements"))["documents"]


def analysis_facts(spark: SparkSession, d: str) -> DataFrame:
    return analyze(written(I.elements(spark, d), "elements"))["facts"].select("fact_id", "source_file", "attribute", "raw_value", "time", "status")


QUERIES = {f.__name__: f for f in (process_counts, analysis_documents, analysis_facts)}
SQL: dict[str, str] = {}
