"""Facts from contexts by a pluggable extractor, and the terms documents share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .grounding import half_text

FACT = "entity string, attribute string, raw_value string, unit string, time string, scope string, qualifier string, exact_quote string, evidence_id string, table_ref string, row_index int, column_index int, extraction_confidence int"
_NAMES = [c.split()[0] for c in FACT.split(", ")]

PROMPT = """You read evidence from one document and list the facts in it.
Give each fact as entity, attribute, raw_value, unit, time, scope and qualifier, as the evidence words them. Do not calculate or convert.
For a sentence, name its EVIDENCE_ID and quote it exactly. For a table, name its TABLE_REF and the row and column, both counted from 0.
Leave out what the evidence does not say.

{context}"""


class Extractor(Protocol):
    """Lists the facts of a context as dictionaries of the fields of FACT; made once in a worker."""

    def extract(self, context: str) -> list[dict[str, Any]]: ...


class RuleExtractor:
    """An extractor that needs no model: each sentence with a number is a fact, named by the words before it."""

    _VALUE = re.compile(r"(?P<name>[A-Z][^.:;\n\[\]]{3,120}?) (?:was|were|is|came to|stood at|rose to|fell to) (?P<value>(?:[₹$€]|INR |Rs\.? ?|US\$ ?)?\d[\d,]*(?:\.\d+)?(?: ?(?:%|crore|lakh|million|mn|bn)(?!\w))?)")

    def extract(self, context: str) -> list[dict[str, Any]]:
        out = []
        for block in context.split("EVIDENCE_ID: ")[1:]:
            ident, _, rest = block.partition("\n")
            text = rest.partition("TEXT:\n")[2]
            for m in self._VALUE.finditer(text):
                name = m["name"].removeprefix("[PROSE] ").strip()
                out.append({"entity": "UNKNOWN", "attribute": name, "raw_value": m["value"], "exact_quote": m[0].strip(), "evidence_id": ident, "extraction_confidence": 5})
        return out


def extract_facts(prompts: DataFrame, make: Callable[[], Extractor]) -> DataFrame:
    """(context_id, fact fields…, error): one call a context; a call that fails gives one row with its error and no fact."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = make()
        for batch in batches:
            rows = []
            for c, p in zip(batch["context_id"], batch["prompt"], strict=True):
                try:
                    rows += [(c, *[f.get(n) for n in _NAMES], None) for f in extractor.extract(p or "")]
                except Exception as e:  # noqa: BLE001
                    rows.append((c, *[None] * len(_NAMES), f"{type(e).__name__}: {e}"))
            df = pd.DataFrame(rows, columns=["context_id", *_NAMES, "error"])
            for n in ("row_index", "column_index", "extraction_confidence"):
                df[n] = df[n].astype("Int32")
            yield df

    return prompts.select("context_id", "prompt").mapInPandas(run, f"context_id string, {FACT}, error string")


def shared_terms(contexts: DataFrame, limit: int = 12) -> DataFrame:
    """(keyword, documents): the words of four letters or more that stand in the first half of most documents' first contexts.

    What a model is asked for where there is one. contexts: context_id, document, evidence. Words are made distinct a document
    before they are counted.
    """
    first = contexts.groupBy("document").agg(F.min_by("evidence", "context_id").alias("evidence"))
    words = first.select("document", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(half_text(F.col("evidence"))), F.lit(r"\p{L}{4,}"), F.lit(0)))).alias("keyword"))
    return words.groupBy("keyword").agg(F.count(F.lit(1)).alias("documents")).orderBy(F.desc("documents"), "keyword").limit(limit)


def with_prompt(contexts: DataFrame) -> DataFrame:
    """(context_id, prompt): the question and a serialized context; braces in the evidence stay as they are."""
    before, after = PROMPT.split("{context}")
    return contexts.select("context_id", F.concat(F.lit(before), T.text_of("prompt"), F.lit(after)).alias("prompt"))
