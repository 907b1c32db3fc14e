"""Page layout: lines from words, boxes, tables' rows and text, elements."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Vertical distance within which a word belongs to a line.
LINE_HEIGHT = 3.0
#: Characters up to which lines are merged to one claim.
CLAIM_CHARS = 500


def split_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): the lines of each text from 1, collapsed. Null texts have none."""
    lines = documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("p", "t"))
    return lines.select("doc_id", (F.col("p") + 1).alias("line_no"), T.collapse(F.col("t")).alias("text"))


def _greedy_lines(y: list[float], tolerance: float) -> list[int]:
    """For each word the first line whose first word is within the tolerance; else a new one."""
    anchors: list[float] = []
    out = []
    for v in y:
        at = next((i for i, a in enumerate(anchors) if abs(a - v) <= tolerance), len(anchors))
        if at == len(anchors):
            anchors.append(v)
        out.append(at)
    return out


def assemble_lines(words: DataFrame, presorted: bool = False, tolerance: float = LINE_HEIGHT) -> DataFrame:
    """(source_file, page_number, line_no, text, x0, y0, x1, y1): a page's words joined to lines, from 1 down the page.

    Words join in their order (ord), or, if presorted, in that of rounded height and x0 (halves to even). Each joins the
    first line whose first word is within the tolerance in y0. A page is the unit of work; words without y0 are left out.
    """

    def page(df: pd.DataFrame) -> pd.DataFrame:
        # pandas rounds halves to even.
        df = df.assign(_r=(df["y0"] / tolerance).round()).sort_values(["_r", "x0", "ord"] if presorted else ["ord"], kind="stable")
        df["line"] = _greedy_lines(df["y0"].tolist(), tolerance)
        df["_seq"] = range(len(df))
        g = df.sort_values(["line", "x0", "_seq"], kind="stable").groupby("line", sort=True)
        out = g.agg(text=("text", " ".join), x0=("x0", "min"), top=("y0", "min"), x1=("x1", "max"), y1=("y1", "max"))
        out["anchor"] = df.groupby("line", sort=True)["y0"].first()
        out = out.sort_values(["top", "x0"] if presorted else ["anchor"], kind="stable")
        return pd.DataFrame({"source_file": df["source_file"].iloc[0], "page_number": df["page_number"].iloc[0], "line_no": range(1, len(out) + 1), "text": out["text"].to_numpy(), "x0": out["x0"].to_numpy(), "y0": out["top"].to_numpy(), "x1": out["x1"].to_numpy(), "y1": out["y1"].to_numpy()})

    ready = words.where("y0 is not null").select("source_file", "page_number", "ord", "x0", "y0", "x1", "y1", F.coalesce("text", F.lit("")).alias("text"))
    lines = ready.groupBy("source_file", "page_number").applyInPandas(page, "source_file string, page_number int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    return lines.withColumn("text", T.collapse(F.col("text")) if presorted else T.strip(F.col("text")))


def line_boxes(words: DataFrame, by: list[str]) -> DataFrame:
    """The box around the words of each group."""
    return words.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def outside_tables(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """The lines that overlap no table box of their page in both directions; boxes: source_file, page_number, bbox.

    An anti-join on the page with the overlap as residual. Null and short boxes cover nothing.
    """
    b = boxes.where(F.size("bbox") >= 4).select("source_file", "page_number", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("tx0", "ty0", "tx1", "ty1"))]).distinct()
    on = (lines["source_file"] == b["source_file"]) & (lines["page_number"] == b["page_number"]) & (F.greatest("x0", "tx0") < F.least("x1", "tx1")) & (F.greatest("y0", "ty0") < F.least("y1", "ty1"))
    return lines.join(b, on, "left_anti")


def text_elements(lines: DataFrame) -> DataFrame:
    """Elements of lines: no empty ones and no page furniture; HEADING or PROSE, ids file:page:type:line."""
    kind = F.when(T.looks_like_heading(T.collapse(F.col("text"))), "HEADING").otherwise("PROSE")
    kept = lines.where(~T.is_noise_line(F.col("text"))).withColumn("element_type", kind)
    return kept.select(
        F.concat_ws(":", "source_file", "page_number", F.lower("element_type"), "line_no").alias("element_id"), "source_file", "page_number", "element_type", "text",
        F.when(F.col("element_type") == "HEADING", F.col("text")).alias("heading"), F.col("y0").alias("top"),
    )


def clean_rows(rows: Column) -> Column:
    """Cells collapsed, null ones empty; null rows and rows of empty cells left out."""
    cleaned = F.transform(F.filter(rows, lambda r: r.isNotNull()), lambda r: F.transform(r, lambda c: T.collapse(c)))
    return F.filter(cleaned, lambda r: F.exists(r, lambda c: c != ""))


def split_headers(rows: Column) -> tuple[Column, Column]:
    """Headers and body of cleaned rows: the first row heads if there are others and it has two filled cells or more."""
    head = (F.size(rows) > 1) & (F.size(F.filter(F.get(rows, F.lit(0)), lambda c: c != "")) >= 2)
    none = F.array().cast("array<string>")
    return F.when(head, F.get(rows, F.lit(0))).otherwise(none), F.when(head, F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1)))).otherwise(rows)


def raw_tables(tables: DataFrame) -> DataFrame:
    """Tables as found on a page, headers as the first row; table_index is the number in the table's id, else 1."""
    one = tables.groupBy("table_id").agg(F.max_by(F.struct("source_file", "page_number", "caption", "unit", "headers", "rows", "bbox"), F.struct("loaded_at", "source_file", "page_number")).alias("t")).where("table_id is not null")
    index = F.coalesce(F.regexp_extract("table_id", r"(\d+)$", 1).try_cast("int"), F.lit(1))
    rows = F.concat(F.array(F.coalesce("t.headers", F.array().cast("array<string>"))), F.coalesce("t.rows", F.array().cast("array<array<string>>")))
    return one.select("table_id", "t.source_file", "t.page_number", index.alias("table_index"), "t.caption", "t.unit", rows.alias("raw"), "t.bbox")


def structured_tables(raw: DataFrame) -> DataFrame:
    """Tables with headers, body and an id for each body row; tables without a filled row are left out."""
    cleaned = raw.withColumn("_rows", clean_rows(F.col("raw"))).where(F.size("_rows") > 0)
    headers, body = split_headers(F.col("_rows"))
    split = cleaned.withColumn("headers", headers).withColumn("rows", body)
    ids = F.transform("rows", lambda r, i: T.sha16(F.col("source_file"), F.col("page_number"), F.col("table_index"), i + 1, F.array_join(r, "|")))
    return split.withColumn("evidence_ids", ids).drop("_rows", "raw")


def table_text(caption: Column, unit: Column, headers: Column, rows: Column) -> Column:
    """A table as text: a mark, caption, unit and headers where there are any, and a line a row."""
    present = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    top = F.array(F.lit("[TABLE]"), present("Caption: ", caption), present("Unit: ", unit), F.when(F.size(headers) > 0, F.concat(F.lit("Headers: "), F.array_join(headers, " | "))))
    return F.array_join(F.concat(F.filter(top, lambda x: x.isNotNull()), F.transform(rows, lambda r: F.array_join(r, " | "))), "\n")


def table_row_evidence(raw: DataFrame) -> DataFrame:
    """Evidence of table rows: the first filled row heads, each later one that bears a number or metric gives `Table i; row j; header=value; …`.

    Hints are read from that text, so its numbers of table and row count among number_hints. Rows of notices and
    rows without a filled cell give none.
    """
    cleaned = raw.withColumn("_rows", clean_rows(F.col("raw"))).where(F.size("_rows") > 0)
    rows = cleaned.select("source_file", "page_number", "table_index", F.get("_rows", F.lit(0)).alias("h"), F.posexplode(F.slice("_rows", F.lit(2), F.greatest(F.size("_rows"), F.lit(1)))).alias("j", "v"))
    whole = F.array_join(F.concat("h", "v"), " ")
    bearing = rows.where(~T.is_claim_noise(whole) & (whole.rlike(r"\d") | T.has_metric_language(whole)))
    header = lambda i: F.when(F.coalesce(F.get("h", i), F.lit("")) != "", F.get("h", i)).otherwise(F.concat(F.lit("column_"), i + 1))
    pairs = F.filter(F.transform("v", lambda x, i: F.when(x != "", F.concat(header(i), F.lit("="), x))), lambda x: x.isNotNull())
    text = F.concat(F.lit("Table "), F.col("table_index"), F.lit("; row "), F.col("j") + 1, F.lit("; "), F.array_join(pairs, "; "))
    out = bearing.select("source_file", "page_number", text.alias("text"), F.nullif(F.get("v", F.lit(0)), F.lit("")).alias("row_label"))
    return with_hints(out.withColumn("evidence_type", F.lit("TABLE_ROW")))


def with_hints(df: DataFrame) -> DataFrame:
    """Evidence with its id (16 digits over source, page, type and text) and hints."""
    t = F.col("text")
    ident = T.sha16(F.col("source_file"), F.col("page_number"), F.col("evidence_type"), T.strip(t))
    return df.withColumn("evidence_id", ident).withColumn("number_hints", T.number_hints(t)).withColumn("unit_hint", T.unit_hint(t)).withColumn("time_hint", T.time_hint(t))


def _merge_claims(texts: list[str], claim: list[bool], number: list[bool], metric: list[bool], has: Callable[[str], tuple[bool, bool]]) -> list[str]:
    out, i = [], 0
    while i < len(texts):
        merged, j = texts[i], i + 1
        n, m = number[i], metric[i]
        if not merged:
            i += 1
            continue
        while j < len(texts) and texts[j]:
            if j > i + 1 and claim[j] and number[j] or len(merged) + 1 + len(texts[j]) > CLAIM_CHARS:
                break
            if not (n or m) and merged[-1] in ".!?":
                break
            merged = f"{merged} {texts[j]}"
            n, m = n or number[j], has(merged)[1] or m
            j += 1
        out.append(merged)
        i = j
    return out


def prose_evidence(lines: DataFrame) -> DataFrame:
    """Evidence of prose: lines of a page merged down the page as long as they make one claim, claims kept.

    A claim goes on with the next line unless that is empty, would make it longer than 500 characters, or is itself a
    claim with a number (not right after the first line), and unless it ends a sentence without number or metric.
    """
    t = T.collapse(F.col("text"))
    marked = lines.select("source_file", "page_number", "line_no", t.alias("text")).withColumn("claim", T.looks_like_claim(F.col("text"))).withColumn("number", F.col("text").rlike(r"\d")).withColumn("metric", T.has_metric_language(F.col("text")))

    def page(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("line_no", kind="stable")
        terms = T.METRIC_TERMS
        merged = _merge_claims(df["text"].tolist(), df["claim"].tolist(), df["number"].tolist(), df["metric"].tolist(), lambda s: (False, any(x in s.lower() for x in terms)))
        return pd.DataFrame({"source_file": df["source_file"].iloc[0], "page_number": df["page_number"].iloc[0], "text": merged})

    claims = marked.groupBy("source_file", "page_number").applyInPandas(page, "source_file string, page_number int, text string").where(T.looks_like_claim(F.col("text")))
    return with_hints(claims.withColumn("evidence_type", F.lit("PROSE")).withColumn("row_label", F.lit(None).cast("string")))


def reading_order(elements: DataFrame) -> DataFrame:
    """elements with ord, their place in the page's order of top and id."""
    w = Window.partitionBy("source_file", "page_number").orderBy("top", "element_id")
    return elements.withColumn("ord", F.row_number().over(w))
