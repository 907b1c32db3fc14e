"""Groups of facts from their pairwise links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.near import group_links

#: White space at either end, no-break spaces included.
_ENDS = r"(?U)^\s+|\s+$"


def tidy(c: Column) -> Column:
    """An id or a status without surrounding white space, in lower case."""
    return F.lower(F.regexp_replace(c, _ENDS, ""))


def links_of(relationships: DataFrame, status: str = "corroboration") -> DataFrame:
    """Distinct links (u < v) of the rows with this status. Null and blank ids, self pairs and other statuses give none."""
    a, b = tidy(F.col("fact_a_id")), tidy(F.col("fact_b_id"))
    return (
        relationships.where(tidy(F.col("status")) == status)
        .select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), a.alias("_a"), b.alias("_b"))
        .where((F.col("_a") != "") & (F.col("_b") != "") & (F.col("u") < F.col("v")))
        .select("u", "v")
        .distinct()
    )


def fact_groups(relationships: DataFrame, facts: DataFrame) -> DataFrame:
    """(fact_id, group_id): every fact id of either table once; a fact without links is its own group."""
    named = facts.select(tidy(F.col("fact_id")).alias("node")).unionByName(relationships.select(F.explode(F.array(tidy(F.col("fact_a_id")), tidy(F.col("fact_b_id")))).alias("node")))
    nodes = named.where("node <> ''").distinct()
    groups = group_links(links_of(relationships))
    return nodes.join(groups, "node", "left").select(F.col("node").alias("fact_id"), F.coalesce("group_id", "node").alias("group_id"))
