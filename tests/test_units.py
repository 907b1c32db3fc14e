"""Quantities: amounts, units, precedence, estimated words."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factloom.operators import units as U

T0, T1 = datetime(2024, 1, 1), datetime(2024, 2, 1)
FACTS = "fact_id string, entity string, attribute string, time string, scope string, source_file string, raw_value string, unit string, evidence_id string, loaded_at timestamp, amount string, word string"
TABLES = "evidence_ids array<string>, unit string, loaded_at timestamp, fact_id string"
RATES = [("inr", "unit", "money", "INR", 1.0), ("usd", "unit", "money", "USD", 1.0), ("kg", "unit", "mass", "kg", 1.0), ("tonne", "unit", "mass", "kg", 1000.0), ("percent", "unit", "share", "bps", 100.0), ("count", "unit", "count", "count", 1.0), ("hour", "unit", "duration", "minute", 60.0),
         ("thousand", "scale", None, None, 1e3), ("lakh", "scale", None, None, 1e5), ("million", "scale", None, None, 1e6), ("crore", "scale", None, None, 1e7), ("billion", "scale", None, None, 1e9)]

AMOUNTS = [
    ("1,234.50", 1234.5), ("63.323,87", 63323.87), ("4.601.304,7", 4601304.7), ("27,34", 27.34), ("1,36", 1.36), ("2,95,038", 295038), ("12 345,6", 12345.6), ("10 333 617", 10333617), ("(72.7)%", -72.7), ("₹(2,441)", -2441),
    ("−Rs. 59,148.5 Cr.", -59148.5), ("minus INR 1 815.20 Million", -1815.2), ("~52,4", 52.4), ("Rs.1,108", 1108), ("9.9 *", 9.9), ("+5", 5), ("30-47 lakh tonnes", None), ("21 to 39%", None), ("11 March 2020", None), ("Q1 FY25", None), ("n/a", None), ("", None), ("5 (audited)", 5),
]


@pytest.mark.parametrize("chunk", [AMOUNTS])
def test_amounts(spark, chunk):
    df = spark.createDataFrame([(t,) for t, _ in chunk], "t string").select("t", U.amount_in(U.plain(F.col("t"))).cast("double").alias("x"))
    got = {r.t: r.x for r in df.collect()}
    assert got == {t: (None if x is None else pytest.approx(x)) for t, x in chunk}


def run(spark, facts, tables=()):
    f = spark.createDataFrame([(i, None, None, None, None, None, raw, unit, ev, at, "x", "y") for i, raw, unit, ev, at in facts], FACTS)
    t = spark.createDataFrame([(ids, u, T0, "clash") for ids, u in tables], TABLES)
    r = spark.createDataFrame(RATES, "unit_code string, kind string, measure string, base_unit string, factor double")
    return {x.fact_id: (x.base_unit, x.base_value) for x in U.normalize_quantities(f, t, r).collect()}


def test_precedence_and_gaps(spark):
    facts = [
        ("a", "10.89kt", "t", "e1", T0), ("b", "19 %", None, "e1", T0), ("c", "5", None, "e1", T0), ("d", "5", "  ", None, T0), ("e", "5 vehicles", "Nos. (Mn)", None, T0), ("f", "684 hours", None, None, T0), ("g", "0.11", "lakh metric tonnes", "e1", T0),
        ("h", "(5.6)", "", "e2", T0), ("i", "7 widgets", None, None, T0), ("j", None, "kg", None, T0), ("k", "9", "kg", None, T0), ("k", "9", "kg", None, T1), (None, "9", "kg", None, T0), ("l", "3", "usd", "e1", T0), ("m", "2", "in 000s", "e3", T0), ("n", "2", "'000 MT", None, T0),
    ]
    tables = [(["e1"], "All figures in INR crore"), (["e1"], "All figures in INR crore"), (["e2", "e3"], "[Rs. (millions)]"), (None, "kg"), ([None], "kg")]
    assert run(spark, facts, tables) == {
        "a": ("kg", 10_890_000), "b": ("bps", 1900), "c": ("INR", 50_000_000), "e": ("count", 5_000_000), "f": ("minute", 41040), "g": ("kg", 11_000_000), "h": ("INR", -5_600_000), "k": ("kg", 9), "l": ("USD", 3), "m": ("INR", 2000), "n": ("kg", 2_000_000),
    }


def test_empty(spark):
    assert run(spark, []) == {}


def told(spark, rows, rates=RATES):
    f = spark.createDataFrame([(i, "Acme", thing, t, None, src, raw, None, None, T0, "x", "y") for i, thing, t, src, raw in rows], FACTS)
    r = spark.createDataFrame(rates, "unit_code string, kind string, measure string, base_unit string, factor double")
    return {x.fact_id: (x.base_unit, x.base_value) for x in U.normalize_quantities(f, spark.createDataFrame([], TABLES), r).collect()}


def test_strange_words_are_told_along_a_chain_of_sources(spark):
    """'zent' is tied to kg, 'gart' only to 'zent', 'hulm' only to 'gart', 'isk' only to 'hulm'; 'litres' and 'blorb' to nothing."""
    rows = []
    for i in range(6):
        n = (i + 1) * 5
        rows += [(f"k{i}", "stock", f"FY{i}", "a/1.pdf", f"{n * 1000} kg"), (f"z{i}", "Stock", f"FY{i}", "b/1.pdf", f"{n} zent")]
        rows += [(f"y{i}", "load", f"FY{i}", "b/1.pdf", f"{n} zents"), (f"g{i}", "load", f"FY{i}", "c/1.pdf", f"{n * 1000} gart")]
        rows += [(f"x{i}", "fill", f"FY{i}", "c/1.pdf", f"{n * 1000} gart"), (f"h{i}", "fill", f"FY{i}", "d/1.pdf", f"{n} hulm")]
        rows += [(f"w{i}", "heap", f"FY{i}", "d/1.pdf", f"{n} hulm"), (f"i{i}", "heap", f"FY{i}", "e/1.pdf", f"{n} thousand isk")]
    rows += [("other", "rest", "FY9", "z/1.pdf", "3 zent"), ("odd", "rest", "FY9", "z/1.pdf", "3 blorb"), ("wet", "rest", "FY9", "z/1.pdf", "3 litres"), ("null", "rest", "FY9", None, "4 hulm")]
    got = told(spark, rows)
    assert [got[i] for i in ("z2", "y2", "g2", "h2", "i2", "other", "null")] == [("kg", 15_000)] * 5 + [("kg", 3000), ("kg", 4000)]
    assert not {"odd", "wet"} & set(got)


def test_offset_is_applied_and_disagreement_is_not_told(spark):
    rates = [*RATES, ("celsius", "unit", "temperature", "kelvin", 1.0)]
    rows = [(f"k{i}", "heat", f"FY{i}", "a/1.pdf", f"{i * i * 100 + 1273} kg") for i in range(1, 7)] + [(f"c{i}", "heat", f"FY{i}", "b/1.pdf", f"{i * i * 100 + 1000} grad") for i in range(1, 7)]
    rows += [(f"m{i}", "noise", f"FY{i}", "a/1.pdf", f"{x} kg") for i, x in enumerate([3, 900, 14, 77, 2])] + [(f"n{i}", "noise", f"FY{i}", "b/1.pdf", f"{i + 1} wirr") for i in range(5)]
    got = told(spark, rows, rates)
    assert got["c2"] == ("kg", 1673) and not any(k.startswith("n") for k in got)


def test_known_words_held_out_are_told_again(spark):
    rows = [(f"{s}{i}", "Acme", "stock", f"FY{i}", None, f"{s}/1.pdf", raw, None, None, T0, "x", "y") for i in range(1, 6) for s, raw in (("a", f"{i * 7000} kg"), ("b", f"{i * 7} tonnes"))]
    r = spark.createDataFrame(RATES, "unit_code string, kind string, measure string, base_unit string, factor double")
    got = U.held_out(spark.createDataFrame(rows, FACTS), spark.createDataFrame([], TABLES), r, ("tonnes",)).collect()
    assert [tuple(x) for x in got] == [("kg", 5, 5, 5)]
