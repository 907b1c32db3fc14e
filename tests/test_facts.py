"""Matching, canonicalisation, grounding, clustering, packing, extraction, sources, streaming."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.operators import canonical, cluster, embed, extraction, grounding, matching, near, packing, report
from factloom.plans import facts
from factloom.sources import documents
from factloom.streaming import evidence as stream

FACT = "fact_id string, entity string, attribute string, raw_value string, time string, scope string, qualifier string, source_file string, evidence_id string, status string, members int"


def fact(i, value, doc, time=None, scope=None, attribute="Revenue", entity="Acme", status="VALID"):
    return (i, entity, attribute, value, time, scope, None, doc, None, status, 0)


def test_all_seven_rules(spark):
    pairs = {
        "value not numeric": (fact("a1", "strong", "d1"), fact("a2", "5", "d2")),
        "unit types differ": (fact("b1", "5%", "d1"), fact("b2", "5", "d2")),
        "same context, equal values": (fact("c1", "1,000", "d1", "FY24"), fact("c2", "1000.5", "d2", "fy24")),
        "same context, different values": (fact("e1", "1000", "d1", "FY24"), fact("e2", "1002", "d2", "FY24")),
        "time or scope differs": (fact("f1", "5 mn", "d1", "FY24"), fact("f2", "6 mn", "d2", "FY23")),
        "equal values, context incomplete": (fact("g1", "5", "d1", "FY24"), fact("g2", "5", "d2")),
        "context incomplete": (fact("h1", "5", "d1", "FY24"), fact("h2", "9", "d2")),
    }
    for rule, (a, b) in pairs.items():
        got = matching.classify_relationships(spark.createDataFrame([a, b], FACT), 0.0).collect()
        assert [r.rule for r in got] == [rule]
    alone = matching.classify_relationships(spark.createDataFrame([fact("i1", "5", "d1"), fact("i2", "5", "d1")], FACT), 0.0)
    assert alone.count() == 0
    assert matching.classify_relationships(spark.createDataFrame([], FACT)).count() == 0


def test_blocked_pairs_equal_unblocked(spark):
    rng = random.Random(1)
    entities, attributes = ["Acme", "Acme Ltd", "Zeta", "", None, "ac"], ["Revenue", "Revenue FY24", "EBITDA margin", "Adjusted EBITDA margin", "express parcel revenue", "parcel shipment", None, "fuel cost of Depot"]
    rows = [fact(f"f{i:02d}", str(i), f"d{rng.randrange(5)}", attribute=rng.choice(attributes), entity=rng.choice(entities), status=rng.choice(["VALID", "VALID", "UNCERTAIN", None])) for i in range(60)]
    c = matching.fact_classes(spark.createDataFrame(rows, FACT))
    got = {(r.fact_id_a, r.fact_id_b) for r in matching.candidate_pairs(c, 0.0).collect()}
    x = {r.fact_id: r for r in c.collect()}

    def ok(a, b):
        small, large = sorted((set(a.a), set(b.a)), key=len)
        return bool(a.a and b.a) and small <= large and not (large - small) & set(matching.DIMENSIONS) and (not a.e or not b.e or a.e in b.e or b.e in a.e)

    want = {(i, j) for i, j in itertools.combinations(sorted(x), 2) if x[i].doc != x[j].doc and ok(x[i], x[j]) and sum(p * q for p, q in zip(x[i].counts, x[j].counts, strict=True)) >= 0}
    assert got == want and got


def test_values(spark):
    cases = {"(123.45)": -123.45, "Rs. 5 cr": 5e7, "5 crore": 5.0, "2.8 bn": 2.8e9, "-4%": -4.0, "1,200 million": 1.2e9, "7k": 7.0, "7 k": 7000.0, "none": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", matching.value_number(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == {k: (None if v is None else pytest.approx(v)) for k, v in cases.items()}


def test_canonicalize(spark):
    schema = "fact_id string, entity string, attribute string, raw_value string, normalized_value double, time string, qualifier string, exact_quote string, status string"
    rows = [("a", " Acme ", "Total Shipments Q1 FY24", "many", None, None, None, "shipments were 1,200 mn in 2024", "VALID"), ("b", None, "value", "5", None, None, None, "nothing here", "VALID"), ("c", "X", "Total", "5", 1.0, "FY_24", "Profit growth", None, "VALID"), ("d", "X", "Total", "5", None, None, None, None, "UNCERTAIN")]
    got = {r.fact_id: r for r in canonical.canonicalize(spark.createDataFrame(rows, schema)).collect()}
    assert (got["a"].entity, got["a"].attribute, got["a"].time, got["a"].raw_value, got["a"].status) == ("Acme", "shipment", "q1 fy24", "1,200 mn", "VALID")
    assert got["b"].status == "UNCERTAIN" and got["c"].attribute == "profit growth" and got["c"].time == "fy 24" and got["d"].attribute == "Total"


def test_grounding_cases(spark):
    ctx = spark.createDataFrame([("c1", [("e1", "f", 1, "[PROSE] Sales were  5 mn", "PROSE", None, None, None, None), ("t1", "f", 1, "x", "TABLE", "t1", ["A", "B"], [["l", " 7 "], ["m"]], ["r0"])], None), ("c2", None, None)], "context_id string, evidence array<struct<evidence_id string, source_file string, page_number int, text string, element_type string, table_ref string, table_headers array<string>, table_rows array<array<string>>, table_evidence_ids array<string>>>, loaded_at timestamp")
    schema = "fact_id string, context_id string, entity string, attribute string, raw_value string, exact_quote string, evidence_id string, table_ref string, row_index int, column_index int, ord string"
    f = lambda i, raw, quote, ev, ref=None, r=None, c=None, e="E": (i, "c1", e, "a", raw, quote, ev, ref, r, c, "clash")
    rows = [f("exact", "5 mn", "Sales were  5 mn", "e1"), f("spaces", "5 MN", "sales WERE 5 mn", "e1"), f("altered", "5", "Sales was 5", "e1"), f("value", "6", "Sales were", "e1"), f("id", "5", "Sales", "zz"), f("cell", "x", None, None, "t1", 0, 1), f("bare", "x", None, None, "t1", 1, 0), f("row", "x", None, None, "t1", 9, 0), f("negative", "x", None, None, "t1", -1, 0), f("empty", "x", None, None, "t1", 1, 1), f("none", "x", None, None), f("fields", "x", "Sales", "e1", e="")]
    got = {r.fact_id: r for r in grounding.ground(spark.createDataFrame(rows, schema), ctx).collect()}
    assert {k for k, r in got.items() if r.status == "VALID"} == {"exact", "spaces", "cell", "bare"} and got["fields"].status == "UNCERTAIN"
    assert (got["cell"].raw_value, got["cell"].column_name, got["cell"].evidence_id, got["cell"].exact_quote) == ("7", "B", "r0", "l |  7 ") and got["bare"].evidence_id == "t1:row:1"


def distances(v, kinds):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return 1 - u @ u.T + cluster.PENALTY * np.array([[not cluster.compatible(a, b) for b in kinds] for a in kinds])


def test_average_linkage_against_brute_force():
    rng = np.random.default_rng(0)
    for t in range(60):
        n = 1 + t % 14
        v, kinds = rng.normal(size=(n, 3)), [("prose", "table", "numeric")[i] for i in rng.integers(0, 3 if t % 2 else 1, n)]
        d = distances(v, kinds)
        groups = [[i] for i in range(n)]
        while len(groups) > 1:
            best = min(((np.mean([d[a, b] for a in x for b in y]), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(groups), 2)))
            if best[0] >= 0.4:
                break
            groups[best[1]] += groups.pop(best[2])
        want = {frozenset(g) for g in groups}
        labels = cluster.average_linkage(v, kinds, 0.4)
        assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels)} == want


def test_average_linkage_of_a_large_block():
    """Far more members than a matrix of all distances would fit for."""
    rng = np.random.default_rng(1)
    v = np.repeat(rng.normal(size=(40, 64)), 50, axis=0) + 0.01 * rng.normal(size=(2000, 64))
    labels = cluster.average_linkage(v, ["prose"] * 2000, 0.28)
    assert (labels == np.repeat(np.arange(40), 50)).all()


def test_pack_groups_keeps_budget():
    df = pd.DataFrame({"group_id": ["a", "b", "c", "d"], "size": [3, 3, 1, 1], "tokens": [1000, 900, 900, 100], "sources": [{"x"}, {"y"}, {"x"}, {"z"}], "centroid": [np.array([1.0, 0]), np.array([0.99, 0.14]), np.array([0.98, 0.2]), np.array([0, 1.0])]})
    assert packing.pack_groups(df, 2000) == [["a", "b"], ["c"], ["d"]]


def test_similar_to_queries_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 4))
    df = spark.createDataFrame([(i, x[i].tolist(), i % 3) for i in range(40)] + [(99, None, 1)], "vec_id bigint, embedding array<float>, label int")
    got = {(r.a, r.b) for r in embed.similar_to_queries(df, df.where("vec_id % 5 = 0"), 0.5).collect()}
    x32 = x.astype(np.float32).astype(float)
    want = {tuple(sorted((i, j))) for i in range(0, 40, 5) for j in range(40) if i % 3 != j % 3 and x32[i] @ x32[j] >= 0.5}
    assert got == want


def test_report(spark):
    f = spark.createDataFrame([("1", "Acme", "Revenue", "5", None, None), ("2", None, "Cost", None, None, None)], "fact_id string, entity string, attribute string, raw_value string, time string, scope string")
    assert [r.fact_id for r in report.ask(f, "what revenue did acme have").collect()] == ["1"]
    with pytest.raises(ValueError):
        report.ask(f, "  ")


class Parser:
    def pages(self, content):
        if content == b"bad":
            raise RuntimeError("broken")
        yield documents.Page(content.decode(), [(0, 0, 5, 5, w) for w in content.decode().split()], [([["a", None]], [0.0, 0.0, 1.0, 1.0])])


def test_sources(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"two words")
    (tmp_path / "y.pdf").write_bytes(b"bad")
    parts = documents.parse(documents.files(spark, [f"{tmp_path}/*.pdf"]), Parser)
    assert sorted(r.text for r in documents.words_of(parts).collect()) == ["two", "words"] and documents.tables_of(parts).count() == 1 and documents.pages_of(parts).count() == 1
    assert [r.text for r in parts.where("part = 'error'").collect()] == ["RuntimeError: broken"]
    with pytest.raises(ValueError):
        documents.files(spark, ["a.docx"])
    with pytest.raises(FileNotFoundError):
        documents.files(spark, [f"{tmp_path}/none.pdf"])


class Failing:
    def extract(self, context):
        raise RuntimeError("no answer")


def test_extraction(spark):
    p = spark.createDataFrame([("c", "EVIDENCE_ID: e1\nTEXT:\n[PROSE] Net revenue was INR 5 crore.\n"), ("n", None)], "context_id string, prompt string")
    ok = extraction.extract_facts(p, extraction.RuleExtractor).collect()
    assert [(r.context_id, r.attribute, r.raw_value, r.evidence_id) for r in ok] == [("c", "Net revenue", "INR 5 crore", "e1")]
    assert [r.error for r in extraction.extract_facts(p, Failing).collect()] == ["RuntimeError: no answer"] * 2


def test_stream(spark, tmp_path):
    rows = [("a", "PROSE", "2024-01-01 10:00:00"), ("a", "PROSE", "2024-01-01 11:00:00"), ("b", "PROSE", "2024-01-02 10:00:00"), (None, "PROSE", "2024-01-02 10:00:00")]
    df = spark.createDataFrame(rows, "evidence_id string, evidence_type string, t string").selectExpr("evidence_id", "evidence_type", "cast(t as timestamp) as loaded_at")
    df.write.parquet(f"{tmp_path}/in")
    s = stream.first_of_each(stream.read(spark, f"{tmp_path}/in", df.schema), "evidence_id")
    q = s.writeStream.format("memory").queryName("firsts").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.evidence_id for r in spark.table("firsts").collect()) == ["a", "b"]
    m = stream.match_batches(stream.read(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/store", f"{tmp_path}/c2", lambda new, old: new.select("evidence_id").unionByName(old.select("evidence_id")).distinct(), f"{tmp_path}/found")
    m.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/found").where("evidence_id is not null").count() == 2
    spark.createDataFrame([("c", "PROSE", "2024-01-03 10:00:00")], "evidence_id string, evidence_type string, t string").selectExpr("evidence_id", "evidence_type", "cast(t as timestamp) as loaded_at").write.mode("append").parquet(f"{tmp_path}/in")
    m = stream.match_batches(stream.read(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/store", f"{tmp_path}/c2", lambda new, old: new.select("evidence_id").unionByName(old.select("evidence_id")).distinct(), f"{tmp_path}/found")
    m.awaitTermination()
    assert sorted(r.evidence_id for r in spark.read.parquet(f"{tmp_path}/found/batch=1").where("evidence_id is not null").collect()) == ["a", "b", "c"]


def test_analysis_is_kept_by_id(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    report.save_analysis({"facts": df}, str(tmp_path), "a1")
    report.save_analysis({"facts": df}, str(tmp_path), "a1")
    assert report.load_analysis(spark, str(tmp_path), "facts", "a1").count() == 1
    with pytest.raises(LookupError):
        report.load_analysis(spark, str(tmp_path), "facts", "zz")


def test_context_topics(spark):
    packed = spark.createDataFrame([("p", g, 1) for g in "abcd"] + [("p", "e", 2)], "page string, group_id string, context_no int")
    labels = spark.createDataFrame([("p", "a", "A", 1), ("p", "b", "B", 3), ("p", "c", "C", 2), ("p", "d", None, 2), ("p", "e", "E", 1)], "page string, group_id string, topic_label string, size int")
    assert {r.context_no: r.topic for r in packing.context_topics(packed, labels, ["page"]).collect()} == {1: "B | C | ", 2: "E"}


EVIDENCE = "evidence_id string, source_file string, page_number int, evidence_type string, text string, section_heading string, table_caption string, row_label string, column_label string, number_hints array<string>, unit_hint string, time_hint string, entity_hint string, embedding array<float>, loaded_at timestamp"


def unit(i, source, page, vector, text=None):
    return (i, source, page, "PROSE", text or f"text of {i}", None, None, None, None, None, None, None, None, [float(x) for x in vector], None)


def near_units():
    """Units on pages of three files: clusters that reach over files, and some on their own."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 128))
    return [unit(f"e{i:03d}", f"f{i % 3}.pdf", i % 7, centres[i % 12] + rng.normal(size=128) * rng.choice([0.3, 0.6, 0.8])) for i in range(150)]


def test_evidence_of_all_files_is_clustered(spark, tmp_path):
    spark.createDataFrame(near_units(), EVIDENCE).write.parquet(f"{tmp_path}/evidence_units.parquet")
    rows = facts.cluster_evidence(spark, str(tmp_path)).collect()
    x = sorted(near_units())
    labels = cluster.average_linkage(np.array([r[13] for r in x], float), ["prose"] * len(x), 1 - cluster.SIMILARITY)
    want = {frozenset(x[i][0] for i in np.flatnonzero(labels == k)) for k in set(labels.tolist())}
    got = {}
    for r in rows:
        got.setdefault(r.group_id, set()).add(r.evidence_id)
    assert {frozenset(g) for g in got.values()} == want and all(min(g) == i for i, g in got.items())
    assert {r.evidence_id: r.group_size for r in rows} == {e: len(g) for g in got.values() for e in g} and max(map(len, want)) > 3


def test_near_components_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    df = spark.createDataFrame([(f"k{i:03d}", x[i].tolist()) for i in range(300)], "key string, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(u @ u.T > 0.93)
    label = near._hook(np.arange(300), i, j)
    want = {f"k{a:03d}": f"k{b:03d}" for a, b in enumerate(label) if (label == b).sum() > 1}
    for alone in (10, 1000):
        links = near.near_links(df, "key", "v", 0.93, block=50, alone=alone)
        assert {r.node: r.group_id for r in near.group_links(links).collect()} == want and len(set(want.values())) > 5


def packed_by_hand(groups, budget):
    """Every candidate against every group of the context, over all groups at once."""
    left, out = dict(groups), []
    while left:
        seed = min(left, key=lambda i: (-left[i][0], i))
        chosen = [left.pop(seed)]
        names = [seed]
        while True:
            best, top = None, 0.57
            for i in sorted(left):
                close = max(float(c[3] @ left[i][3]) for c in chosen)
                score = close + (0.08 if not set().union(*[c[2] for c in chosen]) & left[i][2] else 0)
                if close >= 0.58 and score > top:
                    best, top = i, score
            if best is None or sum(c[1] for c in chosen) + left[best][1] > budget:
                break
            chosen.append(left.pop(best))
            names.append(best)
        out.append(names)
    return out


def test_contexts_join_groups_of_all_documents(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 128))
    rows = [unit(f"e{i:03d}", f"f{i % 5}.pdf", i % 9, centres[i % 8] + rng.normal(size=128) * 0.8, "word " * int(rng.integers(20, 700))) for i in range(160)]
    spark.createDataFrame(rows, EVIDENCE).write.parquet(f"{tmp_path}/evidence_units.parquet")
    d = str(tmp_path)
    group = {r.evidence_id: r.group_id for r in facts.cluster_evidence(spark, d).collect()}
    members = {g: [r for r in rows if group[r[0]] == g] for g in set(group.values())}
    cost = lambda r: -(-len(r[4]) // 4) + -(-len(f"[{r[0]}] {r[1]} p.{r[2]}") // 4) + 5
    mean = lambda x: x / np.linalg.norm(x)
    groups = {g: (len(m), sum(map(cost, m)), {r[1] for r in m}, mean(np.float32([r[13] for r in m]).astype(float).mean(axis=0))) for g, m in members.items()}
    want = packed_by_hand(groups, packing.CONTEXT_TOKENS)
    got = {}
    for r in facts.pack_contexts(spark, d).collect():
        got.setdefault((r.block, r.context_no), set()).add(r.group_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert any(len({s for g in c for s in groups[g][2]}) > max(len(groups[g][2]) for g in c) for c in want if len(c) > 1)
    topics = facts.context_topics(spark, d).collect()
    assert {(r.block, r.context_no) for r in topics} == set(got) and all(r.topic for r in topics)
