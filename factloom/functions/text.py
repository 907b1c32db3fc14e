"""Scalar columns over text: white space, headings, page furniture, hints and signals.

Each is a Column expression that runs inside the JVM. A null text counts as an empty one throughout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of white space, as a class for regular expressions.
WS = r"\t\n\x0B\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# Page furniture.
NOISE_LINES = ["www.delhivery.com", "www.bseindia.com", "www.nseindia.com", "this page is intentionally left blank"]
NOISE_PREFIXES = ["cin:", "registered office:", "corporate identity number:", "page no.", "page:"]
NOISE_HEADINGS = ["table of contents", "contents", "index"]
BULLETS = ["•", "▪", "●", "–", "—", "- "]
SECTIONS = ["section i:", "section ii:", "section iii:", "section iv:", "section v:", "section vi:", "section vii:", "section viii:"]
ADMIN_SIGNALS = ["registered office", "corporate office", "contact person", "telephone and e-mail", "telephone", "email", "website", "company secretary", "registrar"]
LOW_HEADINGS = ["prospectus", "index", "contents", "important notice"]
LOW_HEADING_PHRASES = ["registered office", "corporate office", "contact details", "telephone and e-mail"]
LOW_PROSE_PHRASES = ["please scan this qr code", "upi mandate end time", "for identification purposes only", "this page is intentionally left blank"]

# Patterns and terms of claims.
NUMBER = r"(?:[$€£₹][" + WS + r"]*)?[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?"
TIME = r"(?i)FY[" + WS + r"]*\d{2,4}|Q[1-4][" + WS + r"]*(?:FY[" + WS + r"]*)?\d{2,4}|\b(?:19|20)\d{2}\b|(?:January|February|March|April|May|June|July|August|September|October|November|December)[" + WS + r"]+\d{4}|(?:March|June|September|December)[" + WS + r"]+\d{1,2},?[" + WS + r"]+\d{4}"
UNIT = r"(?i)INR|USD|EUR|GBP|JPY|₹|\$|€|£|million|billion|thousand|crore|lakh|%|percent|percentage|tonnes?|kg|kilograms?|units?|employees?|people|customers?"
CLAIM_NOISE = ["copyright", "all rights reserved", "safe harbour", "safe harbor", "disclaimer", "registered office", "corporate office", "telephone and e-mail", "company secretary", "compliance officer", "membership no", "digitally signed"]
METRIC_TERMS = ["revenue", "sales", "income", "profit", "loss", "ebitda", "margin", "expense", "cost", "asset", "liabilit", "debt", "cash", "investment", "employees", "workforce", "customers", "shipments", "tonnes", "volume", "market share", "growth", "rate", "amount", "value", "orders", "parcels", "delivery", "deliveries"]
COMPARATIVES = ["increased", "decreased", "grew", "declined", "rose", "fell", "higher", "lower", "more than", "less than"]
CANDIDATE_METRICS = ["revenue", "income", "profit", "loss", "ebitda", "margin", "growth", "cost", "expense", "cash flow", "assets", "liabilities", "equity", "debt", "shares", "customers", "employees", "shipments", "volume", "rate", "ratio", "percentage", "holding", "capital", "turnover", "acquisition", "valuation"]
METADATA = ["cin:", "registered office", "corporate identity number", "table of contents", "contents", "page no", "all amounts in indian rupees", "unless otherwise stated"]


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once a row however often use names it.

    Within a lambda of an array function a plain column would be worked out again for each element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(text_of(c), f"[{WS}]+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(text_of(c), f"^[{WS}]+|[{WS}]+$", "")


def norm(c: Column) -> Column:
    return F.lower(collapse(c))


def words(c: Column) -> Column:
    """The words of a collapsed text; none of an empty one."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def alternation(terms: list[str]) -> str:
    """One pattern for 'contains any of': cheaper than a chain of contains on long texts."""
    return "|".join("".join("\\" + ch if ch in ".:$()[]{}*+?^|\\-" else ch for ch in t) for t in terms)


def contains_any(c: Column, terms: list[str]) -> Column:
    return c.rlike(alternation(terms))


def starts_any(c: Column, terms: list[str]) -> Column:
    return c.rlike("^(?:" + alternation(terms) + ")")


def short_digits(c: Column) -> Column:
    return c.rlike(r"^\p{Nd}{1,4}$")


def looks_like_heading(c: Column, ratio: float = 0.65) -> Column:
    """At most 140 characters and 14 words, no closing point, and mostly capitals or a leading digit. c: collapsed or stripped."""
    letters = F.length(F.regexp_replace(c, r"\P{L}", ""))
    capitals = F.length(F.regexp_replace(c, r"\P{Lu}", ""))
    n_words = F.size(words(collapse(c)))
    fits = (F.length(c) <= 140) & (n_words <= 14) & ~c.endswith(".") & (letters > 0)
    return fits & ((capitals / F.greatest(letters, F.lit(1)) >= ratio) | (c.rlike(r"^\p{Nd}") & (F.length(c) <= 100)))


def is_noise_line(c: Column) -> Column:
    n = norm(c)
    return (n == "") | n.isin(NOISE_LINES) | starts_any(n, NOISE_PREFIXES) | short_digits(n)


def is_noise_heading(c: Column) -> Column:
    return norm(c).isin(NOISE_HEADINGS)


def looks_like_new_block(c: Column) -> Column:
    s = strip(c)
    return (s == "") | s.rlike(r"^\p{Nd}[.)]") | starts_any(s, BULLETS) | looks_like_heading(s, 0.75)


def looks_like_toc_line(c: Column) -> Column:
    """A dotted leader, a last word that is a page number after two others, or a section's name."""
    s = strip(c)
    parts = words(collapse(F.replace(s, F.lit("..."), F.lit(" "))))
    last = F.replace(F.element_at(parts, -1), F.lit("."), F.lit(""))
    by_number = F.when(F.size(parts) >= 3, short_digits(last)).otherwise(False)
    return F.contains(s, F.lit("." * 64)) | F.contains(s, F.lit("…")) | by_number | starts_any(F.lower(s), SECTIONS)


def admin_signals(c: Column) -> Column:
    n = norm(c)
    out = F.lit(0)
    for s in ADMIN_SIGNALS:
        out = out + F.contains(n, F.lit(s)).cast("int")
    return out


def has_numeric_cell(row: Column) -> Column:
    return F.exists(row, lambda x: F.coalesce(F.regexp_replace(x, r"[,.\- ]", "").rlike(r"^\p{Nd}{2,}$"), F.lit(False)))


def is_low_value_heading(c: Column) -> Column:
    n = norm(c)
    return n.isin(LOW_HEADINGS) | contains_any(n, LOW_HEADING_PHRASES)


def is_low_value_prose(c: Column) -> Column:
    n = norm(c)
    return contains_any(n, LOW_PROSE_PHRASES) | (F.length(collapse(c)) < 18)


def number_hints(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(text_of(c), F.lit(NUMBER), F.lit(0)), lambda x: F.trim(x))


def unit_hint(c: Column) -> Column:
    return F.nullif(F.regexp_extract(text_of(c), UNIT, 0), F.lit(""))


def time_hint(c: Column) -> Column:
    return F.nullif(F.regexp_extract(text_of(c), TIME, 0), F.lit(""))


def has_metric_language(c: Column) -> Column:
    return contains_any(F.lower(text_of(c)), METRIC_TERMS)


def is_claim_noise(c: Column) -> Column:
    n = norm(c)
    return (n == "") | contains_any(n, CLAIM_NOISE) | n.rlike(f"encl[{WS}]*:")


def looks_like_claim(c: Column) -> Column:
    """A number with a metric, unit or time, or a metric with a word of comparison; 15 characters or more, no notice."""
    t = collapse(c)
    metric = has_metric_language(t)
    number = t.rlike(r"\d")
    return (F.length(t) >= 15) & ~is_claim_noise(t) & ((number & (metric | t.rlike(UNIT) | t.rlike(TIME))) | (metric & contains_any(F.lower(t), COMPARATIVES)))


def sha16(*parts: Column) -> Column:
    """First 16 hexadecimal digits of SHA-1 over the parts joined by |; null parts count as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")), 1, 16)
