"""Oversized items cut into pieces at natural boundaries, by one bounded regular expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import latest

#: Limit of a piece and what neighbouring pieces share, in tokens, and the characters of a token.
MAX_TOKENS, OVERLAP_TOKENS, CHARS = 2500, 100, 4
#: Two noncharacters stand for the two line feeds between items while the text is cut, so that a cut between
#: items is told from one between paragraphs.
_MARK = "\ufdd0"
_WIDE = r"[\x{10000}-\x{10FFFF}]"


def boundary_pattern(limit: int) -> str:
    """Alternatives by falling strength: the rest; up to an item's, paragraph's, row's, sentence's or word's end; else characters.

    Each but the first and last consumes at least half the limit and, greedily, as much as it can within it.
    Every repeated atom is one character, so matching neither recurses nor goes back more than the limit.
    """

    def up_to(end: str, width: int) -> str:
        return f".{{{max(limit // 2 - width, 0)},{max(limit - width, 0)}}}{end}"

    ends = [(_MARK * 2, 2), (r"\n\n", 2), (r"\n", 1), ("[.!?…।。][\"'”’)\\]]\\s", 3), ("[.!?…।。]\\s", 2), (r"\s", 1)]
    return "(?s)" + "|".join([f".{{1,{limit}}}\\z", *(up_to(e, w) for e, w in ends if limit > 2 * w), f".{{{max(limit - 8, 1)},{limit}}}(?!\\p{{M}})", f".{{1,{limit}}}"])


def texts_of(evidence: Column) -> Column:
    """The texts of the evidence in their order, null and empty ones left out; null evidence has none."""
    return F.coalesce(F.filter(F.transform(evidence, lambda e: e["text"]), lambda t: t.isNotNull() & (t != "")), F.array().cast("array<string>"))


def cut(marked: Column, max_chars: int, overlap: int, keep_marks: Column) -> Column:
    """Array of (start, overlap, text): marked text cut to pieces of at most max_chars characters (code points).

    start counts from 0 and includes the overlap, the last characters of the piece before. The pieces without their
    overlaps, one after the other, are the text, with a line feed for each mark unless keep_marks.
    """
    pattern = F.lit(boundary_pattern(max_chars - overlap))

    def pieces(wide: Column, segments: Column, sizes: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x)

            def shaped(p: Column) -> Column:
                back, start = p["back"], p["before"] - p["back"]
                near = F.concat(F.when(back == 0, F.lit("")).otherwise(F.substring(F.get(segments, i - 1), -back, back)), s)
                text = F.when(wide, F.substring(marked, start + 1, back + F.length(s))).otherwise(near)
                return F.struct(start.alias("start"), back.alias("overlap"), F.when(keep_marks, text).otherwise(F.replace(text, F.lit(_MARK), F.lit("\n"))).alias("text"))

            return T.let(before, lambda b: T.let(F.struct(b.alias("before"), F.when(i == 0, F.lit(0)).otherwise(F.least(F.lit(overlap), b)).alias("back")), shaped))

        return F.transform(segments, piece)

    # Characters beyond the basic plane take two places in a Java string; the pattern runs on a copy without them.
    def found(wide: Column) -> Column:
        shadow = F.when(wide, F.regexp_replace(marked, _WIDE, "¤")).otherwise(marked)
        return T.let(F.regexp_extract_all(shadow, pattern, F.lit(0)), lambda segments: T.let(F.transform(segments, lambda s: F.length(s)), lambda sizes: pieces(wide, segments, sizes)))

    return T.let(marked.rlike(_WIDE), found)


def pieces_of(contexts: DataFrame, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """(context_id, n_tokens, pieces): the pieces of each row's text; one piece for a context within the limit.

    The size is the number of characters over four, rounded down; estimated_tokens has no say. Null or empty evidence
    and contexts without text have no pieces. overlap_tokens must be less than half of max_tokens.
    """
    if not 0 <= 2 * overlap_tokens < max_tokens:
        raise ValueError("the overlap must be less than half the limit")

    def split(texts: Column, plain: Column, n_tokens: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("overlap"), plain.alias("text")))
        # Where a text holds the mark itself, items are told from paragraphs no more, and nothing else changes.
        marked = lambda keep: T.let(F.when(keep, plain).otherwise(F.array_join(texts, _MARK * 2)), lambda m: cut(m, max_tokens * CHARS, overlap_tokens * CHARS, keep))
        large = T.let(F.contains(plain, F.lit(_MARK)), marked)
        return F.struct(n_tokens.alias("n_tokens"), F.when(plain == "", F.slice(whole, 1, 0)).when(n_tokens <= max_tokens, whole).otherwise(large).alias("pieces"))

    row = T.let(texts_of(F.col("evidence")), lambda t: T.let(F.array_join(t, "\n\n"), lambda p: T.let(F.floor(F.length(p) / CHARS).cast("int"), lambda n: split(t, p, n))))
    kept = [c for c in contexts.columns if c in ("context_id", "loaded_at")]
    return contexts.where("context_id is not null").select(*kept, F.explode(F.array(row)).alias("_r")).select(*kept, "_r.n_tokens", "_r.pieces")


def oversized(contexts: DataFrame, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """(context_id): each context that had to be cut into two pieces or more, once."""
    return pieces_of(contexts, max_tokens, overlap_tokens).where(F.size("pieces") > 1).select("context_id").distinct()


def split_contexts(contexts: DataFrame, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """(context_id, piece_no, n_pieces, start, overlap, n_tokens, text): every context's pieces, piece_no from 0.

    Rows that repeat a context count once, the last loaded one. A mark (U+FDD0) that stands in a text stays.
    """
    cut_up = latest(pieces_of(contexts.select("context_id", "evidence", "loaded_at"), max_tokens, overlap_tokens), "context_id")
    one = cut_up.select("context_id", F.size("pieces").alias("n_pieces"), F.posexplode("pieces").alias("piece_no", "p"))
    return one.select("context_id", "piece_no", "n_pieces", "p.start", "p.overlap", F.floor(F.length("p.text") / CHARS).cast("int").alias("n_tokens"), "p.text")
