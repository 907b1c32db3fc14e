"""Ordered packing: greedy chunks, contexts of elements and of evidence, budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from . import near

CHARS = 4
STRUCTURED_TOKENS, API_TOKENS, EVIDENCE_TOKENS, CONTEXT_TOKENS, PER_GROUP = 6500, 2000, 2200, 2500, 30
#: Least similarity of a group's centroid to one of the context, and what other sources add to it.
GROUP_SIMILARITY, SOURCE_BONUS = 0.58, 0.08


def tokens_down(c: Column) -> Column:
    """Characters over four, rounded down; one at least, none of an empty text."""
    return F.when(T.text_of(c) == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(c) / CHARS))).cast("int")


def tokens_up(c: Column) -> Column:
    return F.when(T.text_of(c) == "", 0).otherwise(F.ceil(F.length(c) / CHARS)).cast("int")


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """df with its rows' number in a total order, without gathering it in one task.

    The sorted table is written; a row's number is its place in its part plus the rows of the parts before, whose
    counts (one a part) are all that the driver sees.
    """
    s = written(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_m", 33).cast("int")
    counts = {r[0]: r[1] for r in s.groupBy(part).count().collect()}
    total, before = start, []
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    offsets = F.array(*[F.lit(x) for x in before or [start]])
    return s.withColumn(name, F.get(offsets, part) + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m")


def greedy_chunks(df: DataFrame, group: list[str], order: list[str], limit: int, cost: str = "cost", base: str | None = None) -> DataFrame:
    """df with chunk_no, from 0 in each group: rows in order join a chunk until the next would take it beyond the limit.

    A row that alone is beyond the limit has a chunk of its own. Rows of a group are sorted by Spark, which spills, and
    pass through the task as a stream with a few numbers of state: df should be narrow, and a group need not fit in memory.
    """
    fields = df.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", chunk_no int"
    ready = df.repartition(*[F.col(g) for g in group]).sortWithinPartitions(*group, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, chunk, held, full = None, 0, False, 0
        for batch in batches:
            out = np.empty(len(batch), np.int32)
            start = batch[base].to_numpy() if base else np.zeros(len(batch), np.int64)
            for i, (k, c) in enumerate(zip(zip(*[batch[g] for g in group], strict=True), batch[cost].to_numpy(), strict=True)):
                if k != key:
                    key, chunk, held, full = k, 0, False, start[i]
                if held and full + c > limit:
                    chunk, full = chunk + 1, start[i]
                held, full = True, full + c
                out[i] = chunk
            yield batch.assign(chunk_no=out)

    return ready.mapInPandas(run, schema)


def serialize_table(e_id: Column, page: Column, table: Column) -> Column:
    present = lambda label, c: F.when(T.text_of(c) != "", F.concat(F.lit(label), c))
    top = F.array(F.lit("[TABLE]"), F.concat(F.lit("TABLE_REF: "), e_id), F.concat(F.lit("PAGE: "), page.cast("string")), present("CAPTION: ", table["caption"]), present("UNIT: ", table["unit"]))
    none = F.array().cast("array<string>")
    headers = F.transform(F.coalesce(table["headers"], none), lambda h, i: F.concat(F.lit("HEADER "), i.cast("string"), F.lit(": "), T.text_of(h)))
    row = lambda r, i: F.concat(F.array(F.concat(F.lit("ROW "), i.cast("string"), F.lit(":"))), F.transform(r, lambda c, j: F.concat(F.lit("CELL "), j.cast("string"), F.lit(": "), T.text_of(c))))
    rows = F.flatten(F.transform(F.coalesce(table["rows"], F.array().cast("array<array<string>>")), row))
    return F.array_join(F.concat(F.filter(top, lambda x: x.isNotNull()), headers, rows, F.array(F.lit("[/TABLE]"))), "\n")


def serialize_element() -> Column:
    kind = F.col("element_type")
    table = F.when(F.col("table").isNull(), "").otherwise(serialize_table(F.col("element_id"), F.coalesce("page_number", F.lit(0)), F.col("table")))
    return F.when(kind == "TABLE", table).when(kind == "HEADING", F.concat(F.lit("[HEADING] "), "text")).otherwise(F.concat(F.lit("[PROSE] "), "text"))


def structured_chunks(elements: DataFrame, target: int = STRUCTURED_TOKENS) -> DataFrame:
    """Contexts of elements in reading order, one file each and within the target; larger elements stand alone and tables whole.

    (source_file, chunk_no, n_elements, packed_tokens, estimated_tokens, evidence, text_tokens): chunk_no counts from 0 in the file.
    Only ids and costs pass through the fold; texts are joined to it and gathered by context, whose size the target bounds.
    """
    e = elements.withColumn("_text", serialize_element())
    e = e.withColumn("cost", tokens_down(F.col("_text")))
    fold = greedy_chunks(e.select("source_file", F.coalesce("page_number", F.lit(0)).alias("page_number"), "top", "element_id", "cost"), ["source_file"], ["page_number", "top", "element_id"], target)
    place = fold.select("element_id", "chunk_no", F.col("cost").alias("_cost"))
    is_table = (F.col("element_type") == "TABLE") & F.col("table").isNotNull()
    item = F.struct(
        F.coalesce("page_number", F.lit(0)).alias("page_number"), "top", F.col("element_id").alias("evidence_id"), "source_file", F.col("_text").alias("text"), "element_type",
        F.when(is_table, F.col("element_id")).alias("table_ref"), F.when(is_table, F.col("table.headers")).alias("table_headers"), F.when(is_table, F.col("table.rows")).alias("table_rows"), F.when(is_table, F.col("table.evidence_ids")).alias("table_evidence_ids"),
    )
    c = e.join(place, "element_id").groupBy("source_file", "chunk_no").agg(F.count(F.lit(1)).alias("n_elements"), F.sum("_cost").alias("packed_tokens"), F.sort_array(F.collect_list(item)).alias("evidence"))
    length = F.aggregate("evidence", F.lit(0), lambda a, x: a + F.length(x["text"])) + 2 * (F.size("evidence") - 1)
    return c.select("source_file", "chunk_no", "n_elements", "packed_tokens", F.greatest(F.lit(1), F.floor(length / CHARS)).cast("int").alias("estimated_tokens"), "evidence")


def evidence_cost() -> Column:
    meta = F.concat(F.lit("["), "evidence_id", F.lit("] p."), F.coalesce(F.col("page_number").cast("string"), F.lit("None")))
    return F.greatest(F.lit(1), F.floor((F.length(T.text_of("text")) + F.length(meta)) / CHARS)).cast("int")


def evidence_chunks(evidence: DataFrame, target: int = EVIDENCE_TOKENS) -> DataFrame:
    """(source_file, chunk_no, topic, n_units, estimated_tokens, evidence_ids): evidence of a file packed in the order of page and id, chunk_no from 0."""
    costed = evidence.select(T.text_of("source_file").alias("source_file"), F.coalesce("page_number", F.lit(0)).alias("page_number"), "evidence_id", evidence_cost().alias("cost"))
    c = greedy_chunks(costed, ["source_file"], ["page_number", "evidence_id"], target).groupBy("source_file", "chunk_no")
    c = c.agg(F.min("page_number").alias("_a"), F.max("page_number").alias("_b"), F.count(F.lit(1)).alias("n_units"), F.sum("cost").alias("estimated_tokens"), F.transform(F.sort_array(F.collect_list(F.struct("page_number", "evidence_id"))), lambda x: x["evidence_id"]).alias("evidence_ids"))
    return c.select("source_file", "chunk_no", F.concat("source_file", F.lit(" | pages "), "_a", F.lit("-"), "_b").alias("topic"), "n_units", "estimated_tokens", "evidence_ids")


def usefulness() -> Column:
    filled = lambda c: (T.text_of(c) != "").cast("int")
    numbers = F.coalesce(F.size("number_hints") > 0, F.lit(False)).cast("int")
    kind = F.coalesce("evidence_type", F.lit(""))
    return 4 * numbers + 3 * filled("unit_hint") + 2 * filled("time_hint") + 2 * filled("entity_hint") + F.when(kind == "TABLE_ROW", 2).when(kind == "PROSE", 1).otherwise(0)


def context_cost() -> Column:
    meta = F.concat(F.lit("["), "evidence_id", F.lit("] "), T.text_of("source_file"), F.lit(" p."), F.coalesce(F.col("page_number").cast("string"), F.lit("None")))
    return tokens_up(F.col("text")) + tokens_up(meta) + 5


def rank_evidence(evidence: DataFrame, group: str) -> DataFrame:
    """Units of each group without repeats of a text on a page, with score, rank and cost."""
    key = [group, T.norm(F.col("text")), T.text_of("source_file"), F.col("page_number")]
    first = evidence.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("evidence_id"))).where("_n = 1").drop("_n")
    scored = first.withColumn("score", usefulness()).withColumn("cost", context_cost()).withColumn("source_file", T.text_of("source_file"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "source_file", "page_number", "evidence_id")))


def round_robin(ranked: DataFrame, group: str, budget: int = CONTEXT_TOKENS, per_group: int = PER_GROUP) -> DataFrame:
    """The best units of each group, taken from its sources in turn until the next would exceed the budget; the first always stays.

    The rank's limit comes first, so that the windows after it hold a bounded number of rows a group.
    """
    top = ranked.where(F.col("rank") <= per_group)
    by_source = Window.partitionBy(group, "source_file")
    turns = top.withColumn("round", F.row_number().over(by_source.orderBy("rank"))).withColumn("_seen", F.min("rank").over(by_source))
    w = Window.partitionBy(group).orderBy("round", "_seen")
    summed = turns.withColumn("position", F.row_number().over(w)).withColumn("so_far", F.sum("cost").over(w))
    return summed.where((F.col("position") == 1) | (F.col("so_far") <= budget)).drop("_seen")


def pack_groups(groups: pd.DataFrame, budget: int = CONTEXT_TOKENS) -> list[list[str]]:
    """Groups combined to contexts: the largest left seeds, the most similar one joins until none fits.

    groups: group_id, size, tokens, sources (set), centroid. Of equals the smallest id is taken. The first candidate
    beyond the budget ends the context. One pass over the centroids for each group, and no matrix of them.
    """
    g = groups.sort_values("group_id", kind="stable").reset_index(drop=True)
    ids, size, cost, sources = g["group_id"].tolist(), g["size"].to_numpy(), g["tokens"].tolist(), g["sources"].tolist()
    c = np.stack(g["centroid"].to_list())
    holders: dict[str, list[int]] = {}
    for i, names in enumerate(sources):
        for name in names:
            holders.setdefault(name, []).append(i)
    left, out = np.ones(len(g), bool), []
    for seed in np.argsort(-size, kind="stable").tolist():
        if not left[seed]:
            continue
        chosen, tokens, seen, new = [], 0, set(), seed
        nearest, other = np.full(len(g), -np.inf), np.ones(len(g), bool)
        while True:
            chosen.append(new)
            left[new], tokens = False, tokens + cost[new]
            for name in sources[new] - seen:
                other[holders[name]] = False
            seen |= sources[new]
            nearest = np.maximum(nearest, c @ c[new])
            score = np.where(left & (nearest >= GROUP_SIMILARITY), nearest + (SOURCE_BONUS * other if seen else 0.0), -np.inf)
            new = int(np.argmax(score))
            if score[new] == -np.inf or tokens + cost[new] > budget:
                break
        out.append([ids[i] for i in chosen])
    return out


def group_rows(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, size, tokens, sources, centroid): one row a group, with its cost, sources and mean direction.

    members: keys, source_file, cost, embedding.
    """
    dims = members.select(*keys, F.posexplode("embedding").alias("d", "x")).groupBy(*keys, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = dims.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("centroid"))
    facts = members.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("size"), F.sum("cost").alias("tokens"), F.sort_array(F.collect_set("source_file")).alias("sources"))
    return facts.join(mean, keys)


def pack_rows(rows: DataFrame, block: list[str], budget: int = CONTEXT_TOKENS) -> DataFrame:
    """(block…, group_id, context_no): groups of each block, one row each as from group_rows(), packed to contexts numbered from 1 in the block."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*block).schema.fields) + ", group_id string, context_no int"

    def run(df: pd.DataFrame) -> pd.DataFrame:
        unit = [np.asarray(c, float) / max(float(np.linalg.norm(c)), 1e-12) for c in df["centroid"]]
        packed = pack_groups(df.assign(centroid=unit, sources=[set(s) for s in df["sources"]]), budget)
        rows = [(g, n) for n, gs in enumerate(packed, 1) for g in gs]
        out = pd.DataFrame(rows, columns=["group_id", "context_no"])
        for b in reversed(block):
            out.insert(0, b, df[b].iloc[0])
        return out

    return rows.groupBy(*block).applyInPandas(run, schema)


def pack_contexts(members: DataFrame, budget: int = CONTEXT_TOKENS) -> DataFrame:
    """(block, group_id, context_no): groups of all documents packed to contexts, numbered from 1 in the block.

    members: group_id, source_file, cost, embedding. A context joins groups through similarities of GROUP_SIMILARITY or
    more, so it lies within one component of them: blocks are those components, named by their smallest group, and
    change nothing. A block's task holds groups, not members; a group that is like no other is a context of its own.
    """
    rows = written(group_rows(members, ["group_id"]), "groups")
    linked = written(near.near_components(rows, "group_id", "centroid", GROUP_SIMILARITY), "components")
    placed = rows.join(linked, "group_id", "left")
    alone = placed.where("component is null").select(F.col("group_id").alias("block"), "group_id", F.lit(1).alias("context_no"))
    return pack_rows(placed.where("component is not null").withColumnRenamed("component", "block"), ["block"], budget).unionByName(alone)


def context_topics(packed: DataFrame, labels: DataFrame, block: list[str]) -> DataFrame:
    """(block…, context_no, topic): the label of a context's only group, or those of its first three, as packed by pack_contexts().

    labels: block…, group_id, topic_label, size. Groups count in the order of falling size and id.
    """
    g = packed.join(labels, [*block, "group_id"])
    order = F.struct((-F.col("size")).alias("s"), "group_id", T.text_of("topic_label").alias("label"))
    first = F.slice(F.sort_array(F.collect_list(order)), 1, 3)
    return g.groupBy(*block, "context_no").agg(F.array_join(F.transform(first, lambda x: x["label"]), " | ").alias("topic"))
