"""Layout, cleanup, filters, packing: brute force and hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import cleanup, layout, packing, tables

ELEMENT = "element_id string, source_file string, page_number int, element_type string, text string, heading string, table struct<table_id string, page_number int, caption string, unit string, headers array<string>, rows array<array<string>>, evidence_ids array<string>, bbox array<double>>, evidence_ids array<string>, top double, loaded_at timestamp, cost int, chunk_no int"


def el(i, kind, text, top, page=1, f="a.pdf", ids=None):
    return (i, f, page, kind, text, None, None, ids, top, None, 1, 1)


def test_headings(spark):
    cases = {"ANNUAL REPORT": True, "2. Financial Performance": True, "Revenue rose by 5%.": False, "": False, "1234": False, "Mostly lower case here": False, "A" * 141: False, " ".join(["AB"] * 15): False}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.looks_like_heading(F.col("t")).alias("h"))
    assert {r.t: r.h for r in df.collect()} == cases


def test_merge_blocks(spark):
    rows = [
        el("p1", "PROSE", "Revenue rose by 5 per cent in the inter-", 10.0, ids=["x"]), el("p2", "PROSE", "national business", 20.0, ids=["x", "y"]), el("p3", "PROSE", "www.nseindia.com", 25.0), el("p4", "PROSE", ", it said.", 30.0), el("p5", "PROSE", "far away", 60.0),
        el("p6", "PROSE", "• bullet", 65.0), el("h1", "HEADING", "Contents", 70.0), el("h2", "HEADING", "RESULTS", 71.0), el("p7", "PROSE", "after", 72.0), el("p8", "PROSE", None, 73.0), el("p9", "PROSE", "other page", 74.0, page=2), el("n1", "PROSE", "no file", 1.0, f=None),
    ]
    e = cleanup.elements_of(spark.createDataFrame(rows + rows[:1], ELEMENT))
    got = {r.element_id: (r.text, r.evidence_ids, r.n_lines) for r in cleanup.merge_blocks(e).collect()}
    assert got["a.pdf:1:merged:p1"] == ("Revenue rose by 5 per cent in the inter-national business, it said.", ["x", "y"], 3)
    assert {"a.pdf:1:merged:p5", "a.pdf:1:merged:p6", "h2", "a.pdf:1:merged:p7", "a.pdf:2:merged:p9", ":1:merged:n1"} < set(got) and len(got) == 7


def test_toc_page_is_dropped(spark):
    rows = [el(f"t{i}", "PROSE", f"Chapter of some kind {i} ..... {i + 3}", float(i)) for i in range(5)] + [el("x", "PROSE", "A paragraph that is long enough to be kept", 1.0, page=2), el("y", "PROSE", "short", 2.0, page=2)]
    e = cleanup.elements_of(spark.createDataFrame(rows, ELEMENT))
    assert [(r.source_file, r.page_number, r.n_texts, r.n_toc) for r in cleanup.toc_pages(e).collect()] == [("a.pdf", 1, 5, 5)]
    assert [r.element_id for r in cleanup.filter_elements(e).collect()] == ["x"]
    empty = cleanup.elements_of(spark.createDataFrame([], ELEMENT))
    assert cleanup.filter_elements(empty).count() == 0 and cleanup.merge_blocks(empty).count() == 0


@pytest.mark.parametrize("presorted", [False, True])
def test_assemble_lines_against_brute_force(spark, presorted):
    rng = random.Random(3)
    words = [("f", 1, i, float(rng.randrange(100)), rng.randrange(8) * 4 + rng.choice([0.0, 1.0, 2.9, 3.1]), f"w{i}") for i in range(60)]
    df = spark.createDataFrame(words, "source_file string, page_number int, ord int, x0 double, y0 double, text string").withColumn("x1", F.col("x0") + 5).withColumn("y1", F.col("y0") + 5)
    order = sorted(words, key=lambda w: (round(w[4] / 3.0), w[3], w[2])) if presorted else words
    lines = []
    for w in order:
        for line in lines:
            if abs(line[0][4] - w[4]) <= 3.0:
                line.append(w)
                break
        else:
            lines.append([w])
    keyed = [(((min(w[4] for w in line), min(w[3] for w in line)) if presorted else line[0][4]), " ".join(w[5] for w in sorted(line, key=lambda w: w[3]))) for line in lines]
    want = [t for _, t in sorted(keyed, key=lambda x: x[0])]
    got = [r.text for r in layout.assemble_lines(df, presorted).orderBy("line_no").collect()]
    assert got == want


def test_merge_claims():
    t = [">2.8Bn", "Express parcel shipments", "delivered since inception"]
    got = layout._merge_claims(t, [False] * 3, [True, False, False], [False, True, False], lambda s: (False, "shipments" in s))
    assert got == [" ".join(t)]
    assert layout._merge_claims(["It is done.", "next"], [False] * 2, [False] * 2, [False] * 2, lambda s: (False, False)) == ["It is done.", "next"]


def test_tables(spark):
    df = spark.createDataFrame([("t1", "f.pdf", 1, 1, None, "INR", [["Item", " Q1 "], None, ["Sales", "(1,200)"], ["", None], ["Ragged"]], None), ("t2", None, None, 2, "", None, [["only", "row"]], [1.0])], "table_id string, source_file string, page_number int, table_index int, caption string, unit string, raw array<array<string>>, bbox array<double>")
    got = {r.table_id: (r.headers, r.rows, len(r.evidence_ids)) for r in layout.structured_tables(df).collect()}
    assert got == {"t1": (["Item", "Q1"], [["Sales", "(1,200)"], ["Ragged"]], 2), "t2": ([], [["only", "row"]], 1)}
    ev = layout.table_row_evidence(df).collect()
    # The digit of a header counts, so the row without a value is kept.
    assert sorted((r.text, r.row_label) for r in ev) == [("Table 1; row 1; Item=Sales; Q1=(1,200)", "Sales"), ("Table 1; row 2; Item=Ragged", "Ragged")]


def test_numbers_of_cells(spark):
    cases = {"(217)": -217.0, "1,930": 1930.0, "₹ 5%": 5.0, "—": None, "n/a": None, "": None, "1e3": 1000.0, "abc": None, "nan": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tables.parse_number(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == cases


def test_routing_rules(spark):
    texts = {"few": "Table 1; row 1; a=b", "none": "x; a=b; c=d", "plain": "x; Item=Sales; Q1=5; Q2=6", "noise": "s. no.=1; no.=q; serial=w", "ambiguous": "a=1; b=q; c=w"}
    df = spark.createDataFrame([(k, "TABLE_ROW", t) for k, t in texts.items()], "evidence_id string, evidence_type string, text string")
    got = {r.evidence_id: (r.decision, r.confidence) for r in tables.route_rows(df).collect()}
    assert got == {"few": ("LLM", 0.95), "none": ("LLM", 0.9), "plain": ("DETERMINISTIC", 0.85), "noise": ("LLM", 0.85), "ambiguous": ("LLM", 0.7)}


@pytest.mark.parametrize("partitions", [1, 8])
def test_greedy_chunks_against_brute_force(spark, partitions):
    rng = random.Random(5)
    rows = [(f"g{rng.randrange(4)}", i, rng.choice([1, 5, 9, 30])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, cost int").repartition(partitions)
    got = {(r.g, r.i): r.chunk_no for r in packing.greedy_chunks(df, ["g"], ["i"], 20).collect()}
    want, state = {}, {}
    for g, i, c in sorted(rows):
        chunk, full, held = state.get(g, (0, 0, False))
        if held and full + c > 20:
            chunk, full = chunk + 1, 0
        state[g] = (chunk, full + c, True)
        want[(g, i)] = chunk
    assert got == want


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert [(r.k, r.n) for r in packing.numbered(df, ["k"], "n", 0).orderBy("k").collect()] == [(i, i) for i in range(1000)]
    assert packing.numbered(df.limit(0), ["k"], "n").count() == 0


def test_natural_row_order(spark):
    cases = {"Table 1; row 12; a=b": (10**9, 12), "Table 1; row no=7; a=b": (7, 10**9), "x": (10**9, 10**9), None: (10**9, 10**9)}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tables.row_number_of(F.col("t")).alias("a"), tables.row_number_of(F.col("t"), True).alias("b"))
    assert {r.t: (r.a, r.b) for r in df.collect()} == cases
