"""Elements cleaned and merged to blocks, and blocks filtered for extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import latest

#: Vertical gap, in points, up to which lines of prose are one paragraph.
PARAGRAPH_GAP = 12.0
#: A contents page: so many texts at least, and this share of lines that look like entries.
TOC_LINES, TOC_SHARE = 4, 0.55

COLUMNS = ["element_id", "source_file", "page_number", "element_type", "text", "heading", "table", "evidence_ids", "top"]


def elements_of(table: DataFrame) -> DataFrame:
    """One row an element (the last loaded); null files, texts, types and tops count as '', '', PROSE and 0."""
    one = latest(table.select(*COLUMNS, "loaded_at"), "element_id").drop("loaded_at")
    return one.withColumn("source_file", T.text_of("source_file")).withColumn("text", T.text_of("text")).withColumn("element_type", F.coalesce("element_type", F.lit("PROSE"))).withColumn("top", F.coalesce("top", F.lit(0.0)))


def should_drop() -> Column:
    t = F.col("text")
    kind = F.col("element_type")
    return (T.collapse(t) == "") | F.when(kind == "TABLE", False).when(kind == "HEADING", T.is_noise_heading(t)).otherwise(T.is_noise_line(t))


def join_lines(lines: Column) -> Column:
    """Lines as one text: no space after a hyphen or before closing punctuation."""

    def glue(all_lines: Column) -> Column:
        tight = lambda x, i: F.get(all_lines, i - 1).endswith("-") | x.rlike("^[.,;:)%]")
        return F.array_join(F.transform(all_lines, lambda x, i: F.when((i == 0) | tight(x, i), x).otherwise(F.concat(F.lit(" "), x))), "")

    return T.let(lines, glue)


def merge_blocks(elements: DataFrame) -> DataFrame:
    """Blocks: page furniture dropped, consecutive close lines of prose on a page merged, headings and tables as they are.

    Lines merge while the gap from the one before is 0 to 12 points and the line begins no new block; dropped lines
    do not break a run. A block's id is file:page:merged:first id. The page is the window's key, so a file that holds a
    large share of the rows is spread over its pages.
    """
    w = Window.partitionBy("source_file", "page_number").orderBy("top", "element_id")
    kept = elements.where(~should_drop()).withColumn("_before", F.lag(F.struct("element_type", "top")).over(w))
    gap = F.col("top") - F.col("_before.top")
    goes_on = (F.col("element_type") == "PROSE") & (F.col("_before.element_type") == "PROSE") & (gap >= 0) & (gap <= PARAGRAPH_GAP) & ~T.looks_like_new_block(F.col("text"))
    runs = kept.withColumn("_block", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w))
    row = F.struct("top", "element_id", "element_type", "text", "heading", "table", "evidence_ids")
    block = runs.groupBy("source_file", "page_number", "_block").agg(F.sort_array(F.collect_list(row)).alias("r"))
    first = F.get("r", F.lit(0))
    prose = first["element_type"] == "PROSE"
    empty = F.array().cast("array<string>")
    ids = F.array_distinct(F.flatten(F.transform("r", lambda x: F.coalesce(x["evidence_ids"], empty))))
    return block.select(
        F.when(prose, F.concat(F.concat_ws(":", "source_file", "page_number"), F.lit(":merged:"), first["element_id"])).otherwise(first["element_id"]).alias("element_id"), "source_file", "page_number", first["element_type"].alias("element_type"),
        F.when(prose, join_lines(F.transform("r", lambda x: T.collapse(x["text"])))).otherwise(first["text"]).alias("text"), first["heading"].alias("heading"), first["table"].alias("table"), ids.alias("evidence_ids"), first["top"].alias("top"), F.size("r").alias("n_lines"),
    )


def toc_pages(elements: DataFrame) -> DataFrame:
    """(source_file, page_number, n_texts, n_toc): the contents pages: four texts or more, the word contents or mostly entries."""
    t = elements.where(T.strip(F.col("text")) != "")
    page = t.groupBy("source_file", "page_number").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(T.looks_like_toc_line(F.col("text")).cast("int")).alias("n_toc"), F.max(F.contains(F.lower("text"), F.lit("contents"))).alias("named"))
    return page.where((F.col("n_texts") >= TOC_LINES) & (F.col("named") | (F.col("n_toc") / F.col("n_texts") >= TOC_SHARE))).drop("named")


def is_admin_table() -> Column:
    """Two signals of an address table or more, and one numeric row at most."""
    rows = F.coalesce(F.col("table.rows"), F.array().cast("array<array<string>>"))
    numeric = F.size(F.filter(rows, lambda r: F.coalesce(T.has_numeric_cell(r), F.lit(False))))
    return F.col("table").isNotNull() & (T.admin_signals(F.col("text")) >= 2) & (numeric <= 1)


def low_value() -> Column:
    t, kind = F.col("text"), F.col("element_type")
    return (T.collapse(t) == "") | F.when(kind == "TABLE", is_admin_table()).when(kind == "HEADING", T.is_low_value_heading(t)).otherwise(T.is_low_value_prose(t))


def filter_elements(elements: DataFrame) -> DataFrame:
    """The elements that are on no contents page and not of low value."""
    return elements.join(toc_pages(elements).select("source_file", "page_number"), ["source_file", "page_number"], "left_anti").where(~low_value()).select(*elements.columns)
