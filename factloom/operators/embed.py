"""Texts as vectors, and vectors compared."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

DIM = 64
#: Query vectors compared with all rows in one pass.
QUERY_BLOCK = 4096


class Embedder(Protocol):
    """A model that turns texts to vectors; made once in a worker."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


def embed_with(df: DataFrame, text: str, make, out: str = "embedding") -> DataFrame:
    """df with the vectors that make().encode gives its texts, in Arrow batches; null texts count as empty."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            v = np.asarray(model.encode([t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]), np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * (v.shape[1] if v.ndim == 2 else 0)), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, flat], [*b.schema.names, out])

    return df.mapInArrow(run, schema)


def identity_text() -> Column:
    """What a fact is about, its value left out."""
    return F.concat(F.lit("Entity: "), T.text_of("entity"), F.lit(" | Attribute: "), T.text_of("attribute"), F.lit(" | Time: "), T.text_of("time"), F.lit(" | Scope: "), T.text_of("scope"), F.lit(" | Qualifier: "), T.text_of("qualifier"))


def evidence_text() -> Column:
    """An evidence unit's text after its heading, caption and labels, those there are."""
    part = lambda label, c: F.when(T.text_of(c) != "", F.concat(F.lit(label), c))
    return F.concat_ws(" | ", part("Section: ", "section_heading"), part("Table: ", "table_caption"), part("Row: ", "row_label"), part("Column: ", "column_label"), T.text_of("text"))


def hash_counts(c: Column, dim: int = DIM) -> Column:
    """Counts of the text's words by bucket (four digits of MD5 of the word, modulo dim): an embedder that needs no model."""
    tokens = T.words(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9%]+", " ")))
    buckets = F.transform(tokens, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int") % dim)
    # Each word's bucket is worked out once, and adds to one place of the counts.
    return F.aggregate(buckets, F.array_repeat(F.lit(0), dim), lambda counts, b: F.transform(counts, lambda x, i: x + (i == b).cast("int")))


def filled_places(counts: Column) -> Column:
    """(i, n) of the places of a vector of counts that are not zero."""
    return F.filter(F.transform(counts, lambda n, i: F.struct(i.alias("i"), n.alias("n"))), lambda p: p["n"] != 0)


def sparse_dot(filled: Column, counts: Column) -> Column:
    """The product of two vectors of counts by one's filled places: a text's words fill a few of them."""
    return F.aggregate(filled, F.lit(0).cast("bigint"), lambda s, p: s + p["n"].cast("bigint") * F.get(counts, p["i"]))


def unit_vector(v: Column) -> Column:
    """v with length one; a zero vector stays."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(v, lambda x: x / F.greatest(n, F.lit(1e-12)))


def similar_to_queries(rows: DataFrame, queries: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", other: str = "label") -> DataFrame:
    """(a, b, similarity): for each query vector all rows of another label whose dot product with it is at least threshold.

    The queries are a stated set (here every fiftieth row) and are compared in blocks of bounded size, each sent to the
    tasks that scan all rows; pairs of two queries come once, the smaller key first. Null vectors take no part.
    """
    spark = rows.sparkSession
    held = queries.where(F.col(vector).isNotNull()).select(key, other, vector)
    n = held.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    base = rows.where(F.col(vector).isNotNull()).select(key, other, vector)
    ids = held.select(key)
    out = None
    for i in range(blocks):
        # A hash splits the queries evenly; each block is of about QUERY_BLOCK rows.
        part = held.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i).orderBy(key).toPandas()
        if not len(part):
            continue
        sent = spark.sparkContext.broadcast((part[key].to_numpy(), part[other].to_numpy(), np.stack(part[vector].to_numpy()).astype(np.float64)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q_ids, q_labels, q = sent.value
            for b in batches:
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), -1)
                s = x @ q.T
                labels, keys = b.column(1).to_numpy(zero_copy_only=False), b.column(0).to_numpy(zero_copy_only=False)
                r, c = np.nonzero((s >= threshold) & (labels[:, None] != q_labels[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[c]), pa.array(keys[r]), pa.array(s[r, c])], ["q", "r", "similarity"])

        found = base.mapInArrow(run, "q bigint, r bigint, similarity double")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return base.select(F.col(key).alias("a"), F.col(key).alias("b"), F.lit(0.0).alias("similarity")).limit(0)
    # A pair of two queries is found from both sides.
    both = out.join(ids.select(F.col(key).alias("r"), F.lit(True).alias("is_query")), "r", "left")
    once = both.where("is_query is null or q < r")
    return once.select(F.least("q", "r").alias("a"), F.greatest("q", "r").alias("b"), "similarity")
