"""The scalar columns of text.py as SQL fragments, written independently for the oracle's engine."""

from __future__ import annotations

from . import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def text_of(x: str) -> str:
    return f"coalesce({x}, '')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {q('[' + T.WS + ']+')}, ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), {q('^[' + T.WS + ']+|[' + T.WS + ']+$')}, '', 'g')"


def norm(x: str) -> str:
    return f"lower({collapse(x)})"


def contains_any(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


def starts_any(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(t)})" for t in terms) + ")"


def isin(x: str, terms: list[str]) -> str:
    return f"({x} IN ({', '.join(q(t) for t in terms)}))"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def words(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN [] ELSE string_split({x}, ' ') END)"


def heading(x: str, ratio: float = 0.65) -> str:
    letters = f"length(regexp_replace({x}, '\\P{{L}}', '', 'g'))"
    capitals = f"length(regexp_replace({x}, '\\P{{Lu}}', '', 'g'))"
    return f"(length({x}) <= 140 AND len({words(collapse(x))}) <= 14 AND NOT ends_with({x}, '.') AND {letters} > 0 AND ({capitals} / greatest({letters}, 1) >= {ratio} OR ({matches(x, '^\\p{Nd}')} AND length({x}) <= 100)))"


def noise_line(x: str) -> str:
    n = norm(x)
    return f"({n} = '' OR {isin(n, T.NOISE_LINES)} OR {starts_any(n, T.NOISE_PREFIXES)} OR {matches(n, '^\\p{Nd}{1,4}$')})"


def new_block(x: str) -> str:
    s = strip(x)
    return f"({s} = '' OR {matches(s, '^\\p{Nd}[.)]')} OR {starts_any(s, T.BULLETS)} OR {heading(s, 0.75)})"


def toc_line(x: str) -> str:
    s = strip(x)
    parts = words(collapse(f"replace({s}, '...', ' ')"))
    return f"(contains({s}, repeat('.', 64)) OR contains({s}, '…') OR (len({parts}) >= 3 AND {matches(f'replace({parts}[-1], {q(".")}, {q("")})', '^\\p{Nd}{1,4}$')}) OR {starts_any(f'lower({s})', T.SECTIONS)})"


def number_hints(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), {q(T.NUMBER)}), lambda h: trim(h))"


def hint(x: str, pattern: str) -> str:
    return f"nullif(regexp_extract(coalesce({x}, ''), {q(pattern)}), '')"


def claim_noise(x: str) -> str:
    n = norm(x)
    return f"({n} = '' OR {contains_any(n, T.CLAIM_NOISE)} OR {matches(n, f'encl[{T.WS}]*:')})"


def claim(x: str) -> str:
    t = collapse(x)
    metric = contains_any(f"lower({t})", T.METRIC_TERMS)
    return f"(length({t}) >= 15 AND NOT {claim_noise(t)} AND (({matches(t, '[0-9]')} AND ({metric} OR {matches(t, T.UNIT)} OR {matches(t, T.TIME)})) OR ({metric} AND {contains_any(f'lower({t})', T.COMPARATIVES)})))"
