"""Template residue, filler text and error pages: positive-unlabelled naive Bayes by expectation-maximization.

Two models of one kind. Passages (sentences and lines) are scored as filler and as error by their words and pairs of
words; occurrences of placeholder forms are scored as left behind by what stands in them and beside them. Each
starts from trusted records, takes every other passage or occurrence of all documents as unlabelled, and is
reweighed by the posterior of the round before. Without trusted records nothing is found.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Features are counted by a hash of so many bits: the model's size is bounded whatever the corpus.
BITS, FORM_BITS = 20, 16
#: What the words beside a form count for together at most.
MOST_BESIDE = 8.0
#: A feature of a form says something if it was met so often.
MIN_MET = 6
#: Rounds of expectation-maximization over passages and over forms.
ROUNDS, FORM_ROUNDS, CONTEXT_ROUNDS = 2, 8, 2
#: Least log-odds of a placeholder, a filler passage and an error record; those of one feature count up to MOST.
MIN_PLACEHOLDER, MIN_FILLER, MIN_ERROR, MOST = 0.5, 10.0, 12.0, 6.0
#: Share of a notice's pairs of words that speak for one.
ALIKE = 0.55
#: A passage is a real sentence only with so many words, and real without a closing mark with so many.
REAL_WORDS, LONG_WORDS = 5, 14
#: Counts of usual features added to each class; a feature counts if it was met twice or in a trusted passage.
SMOOTH = 50.0
#: Trusted errors have so many characters at most: they hold the notice and little else. Trusted templates have so many forms at least.
TRUSTED_CHARS, TRUSTED_FORMS = 260, 3
#: Characters handled at a time.
CHUNK = 1_000_000

REAL, FILLER, ERROR = 0, 1, 2

# The forms placeholders are written in. Whether an occurrence is one is learnt.
FORMS = {
    "braces2": r"\{\{[^{}\n]{1,60}\}\}",
    "block": r"\{%[^%\n]{1,60}%\}",
    "erb": r"<%[^%\n]{1,60}%>",
    "dollar": r"\$\{[^{}\n]{1,60}\}",
    "at": r"@@\w{1,60}@@",
    "percent": r"%[A-Za-z]\w{1,60}%",
    "square2": r"\[\[[^\[\]\n]{1,60}\]\]",
    "guillemets": r"«[^\W\d][\w .-]{0,60}»",
    "angle2": r"<<[^<>\n]{1,60}>>",
    "angle": r"<[A-Za-z][\w .-]{1,60}>",
    "brace": r"\{\w{1,60}\}",
    "underlines": r"__[A-Za-z]\w{1,60}?__",
    "round": r"\((?:insert|enter|type|add|your|please (?:insert|enter)|to be|name of)\b[^()\n]{0,60}\)",
    "bullet": r"\[[•●]\]",
    "bracket": r"\[[^\W\d][^\[\]\n]{2,60}\]",
    "cell": r"#(?:REF!|N/A|NAME\?|VALUE!|DIV/0!)",
    "note": r"\b(?:FIXME|TODO|TBD|TBC|XXX)\b(?::[ \t]?\w+)?",
    "exes": r"\bX{1,4}[.,]X{1,4}(?:\s?%)?",
}
#: Text in quotation marks is quoted, not left behind.
_QUOTED = r"“[^”]{1,120}”|„[^“”]{1,120}[“”]|(?<![:{,] )(?<![{:,\w])\"[^\"\n:]{1,120}\"(?!\s*:)"
_ALL_FORMS = re.compile("|".join(f"(?P<{n}>{p})" for n, p in FORMS.items()))
_QUOTES = re.compile(_QUOTED)
#: What a text must hold for any form to stand in it, and for any quotation.
SIGNS = r"[{}<>\[\]@«#]|__|%[A-Za-z]|\((?:insert|enter|type|add|your|please|to be|name of)\b|FIXME|TODO|TB[DC]|XX|X[.,]X"
_SIGNS_OR_QUOTES = SIGNS + r"|[“„\"]"
# Words by which a sentence says that it names a form.
MENTION = {"field", "fields", "placeholder", "placeholders", "variable", "variables", "template", "templates", "token", "tokens", "tag", "tags", "syntax", "literal", "write", "written", "called", "named", "string", "print", "prints", "printed", "layout"}
#: Stand in a text for a form and for a quotation.
_FORM, _QUOTE = "", ""

# Notices by which a short record is trusted to be an error page or a demand for scripts, cookies or a check.
ERROR_SEEDS = "not found on this server|[345][0-9]{2} (not found|forbidden|bad gateway|service unavailable)|(^|\\n)(http )?error:? [345][0-9]{2}|internal (server )?error|access denied|lack permission|traceback \\(most recent|nullpointerexception|keyerror|\"error\": |connection refused|request timed out|too many requests|session has expired|requested url was rejected|verify that you are human|checking your browser|browser is not supported|ad blocker detected|(enable|allow|activate|permit|switch on) (javascript|scripts|active content|cookies)|javascript is turned off|turn js on|(needs|without) script(s|ing)|script support|scripts may be blocked|accept cookies|(could not|cannot) (be (opened|displayed|loaded)|connect)|failed to load|is damaged|was not found|does not exist|no longer (here|available)|moved or deleted|can.t find the|page (is|was) (gone|removed)|resource removed|something (went wrong|broke)|offline for maintenance|try (again )?later|seite nicht gefunden|(^|\\n)erreur [345][0-9]{2}|veuillez activer|bitte aktivieren sie javascript|active javascript en|p.gina no disponible|जावास्क्रिप्ट चालू|पृष्ठ नहीं मिला"
# Filler by which a passage is trusted.
FILLER_SEEDS = "lorem ipsum|foo bar|blah blah|bla bla|text goes here|your text here|texto de relleno|texte provisoire|hier steht ein beispieltext|this is a sample paragraph|dummy paragraph|click here to edit|add your (?:summary|text)|sample caption|body copy|यहाँ नमूना"
_SEEDS = {ERROR: re.compile(ERROR_SEEDS), FILLER: re.compile("^(?:" + FILLER_SEEDS + ")")}
#: Keys struck at random: words of one row of the keyboard alone, or without a vowel for long.
_HOME, _BOTTOM, _CONSONANTS = "asdfghjkl", "zxcvbnm", "bcdfghjklmnpqrstvwxz"

_LETTER, _DIGIT, _MARK, _SPACE, _LINE, _END, _CLOSE = 1, 2, 3, 4, 5, 6, 7
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each character: its class, its lower case (digits are one), and four counts of sixteen bits (keys of the home row, of the bottom row, consonants, digits)."""
    kind, low, counts = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint64), np.zeros(0x110000, np.uint64)
    for i in (*range(0xD800), *range(0xE000, 0x10000)):
        c = chr(i)
        if c in (_FORM, _QUOTE) or c.isalpha():
            kind[i] = _LETTER
        elif c.isdigit():
            kind[i], low[i], counts[i] = _DIGIT, 48, 1 << 48
        elif unicodedata.category(c) in ("Mn", "Mc"):
            kind[i] = _MARK
        elif c.isspace():
            kind[i] = _SPACE
        lower = c.lower()
        if kind[i] == _LETTER and len(lower) == 1:
            low[i] = ord(lower)
    kind[10] = _LINE
    for chars, k in ((".!?।", _END), ("\"”)", _CLOSE)):
        for c in chars:
            kind[ord(c)] = k
    for shift, chars in ((0, _HOME), (16, _BOTTOM), (32, _CONSONANTS)):
        for c in chars:
            counts[ord(c)] += np.uint64(1 << shift)
    return kind, low + np.uint64(1), counts


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    inverse = np.uint64(pow(int(_MULTIPLIER), -1, 2**64))
    ones = np.ones(n, np.uint64)
    up, down = ones.copy(), ones.copy()
    up[1:], down[1:] = _MULTIPLIER, inverse
    return np.cumprod(up), np.cumprod(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Passages:
    """The passages of some texts in flat arrays: of each its document, counts and flags, of each token its feature and passage.

    Passages end with a line or after a mark that closes a sentence; lines of one word go on in the next. Tokens are
    words in lower case, numbers, struck keys, forms and quotations; features are tokens and pairs of neighbouring ones.
    """

    def __init__(self, texts: list[str]) -> None:
        kind, low, counts = _tables()
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(codes)
        k = kind[codes]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1  # each text's closing line feed
        inner = (k >= _LETTER) & (k <= _MARK)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inner, [False]])))
        start, stop = edge[::2], edge[1::2]
        # Boundaries: line feeds, and white space after a closing mark and what closes a quotation.
        blank = (k == _SPACE) | (k == _LINE)
        last = lambda m, by: np.concatenate([np.zeros(by, bool), m[:-by]])
        end = k == _END
        closed, close = end.copy(), np.flatnonzero(k == _CLOSE)
        closed[close[end[np.maximum(close - 1, 0)]]] = True
        closed[close[closed[np.maximum(close - 1, 0)]]] = True
        cut = (k == _LINE) | (k == _SPACE) & last(closed, 1)
        # A line of one word goes on in the next, unless that is blank.
        feeds = np.flatnonzero(k == _LINE)
        begin = np.concatenate([[0], feeds[:-1] + 1])
        width = feeds - begin
        gaps = np.flatnonzero((k == _SPACE) & (codes != 13))
        single = np.searchsorted(gaps, begin) == np.searchsorted(gaps, feeds)
        follow = np.concatenate([blank[1:], [True]])[feeds]
        cut[feeds[single & (width >= 1) & (width <= 41) & ~follow]] = False
        cut[ends] = True
        cuts = np.flatnonzero(cut)
        # Four counts of each token at once, by differences of running sums.
        sums = np.concatenate([[np.uint64(0)], np.cumsum(counts[codes], dtype=np.uint64)])
        inside = sums[stop] - sums[start]
        size = stop - start
        field = lambda i: ((inside >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64)
        is_number = field(3) == size
        # Groups and decimals of one number are one token.
        joins = np.zeros(len(start), bool)
        gap = codes[np.minimum(stop[:-1], n - 1)]
        joins[1:] = is_number[1:] & is_number[:-1] & (start[1:] - stop[:-1] == 1) & ((gap == 44) | (gap == 46))
        struck = (size >= 3) & ((field(0) == size) | (field(1) == size) | (field(2) == size)) | (size >= 7) & (field(2) >= size - 1)
        start, stop, is_number, struck = start[~joins], stop[~joins], is_number[~joins], struck[~joins]
        up, down = _powers(1 << max(20, int(n).bit_length()))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(low[codes] * up[:n], dtype=np.uint64)])
        h = _mix((sums[stop] - sums[start]) * down[start])
        h[is_number] = np.uint64(3)
        h[struck] = np.uint64(5)
        mark = np.where(stop - start == 1, codes[start], 0)
        plain = ~is_number & (mark != ord(_FORM)) & (mark != ord(_QUOTE))
        # The passage of a token is that of the first cut not before it; only passages with tokens count.
        place = np.searchsorted(cuts, start)
        new = np.flatnonzero(np.diff(place, prepend=-1))
        self.n, self.token = len(new), (_mix(h) >> np.uint64(64 - BITS)).astype(np.int32)
        self.tokens = np.diff(np.append(new, len(start)))
        count = lambda m: np.add.reduceat(m.astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
        self.words, self.numbers = count(plain), count(is_number)
        self.doc = np.searchsorted(ends, start[new])
        ids = place[new]
        # The closing character of each passage, spaces aside, and whether it has the bar of a table's row.
        closing = np.maximum(cuts[ids] - 1, 0)
        for _ in range(3):
            closing = np.where(blank[closing], np.maximum(closing - 1, 0), closing)
        self.ended = closed[closing] | np.isin(codes[closing], [ord(x) for x in "…:;"])
        bars = np.flatnonzero(codes == ord("|"))
        since = np.concatenate([[0], cuts[:-1] + 1])[ids]
        self.barred = np.searchsorted(bars, since) < np.searchsorted(bars, cuts[ids])
        self.spans = (since, cuts[ids])
        self._joined = joined

    def text(self, i: int) -> str:
        return self._joined[self.spans[0][i] : self.spans[1][i] + 1].strip()

    def shape(self) -> np.ndarray:
        """Which passages have the shape of a real sentence or of a table's row."""
        return (self.words >= REAL_WORDS) & self.ended | self.barred & (self.numbers > 0) | (self.words >= LONG_WORDS)


class Counted:
    """Passages as they are written: tokens of all passages of all documents of a batch, and of each passage its features."""

    def __init__(self, token: np.ndarray, tokens: np.ndarray, flags: np.ndarray, doc: np.ndarray) -> None:
        self.n, self.token, self.tokens, self.flags, self.doc = len(tokens), token, tokens, flags, doc
        self.passage = np.repeat(np.arange(self.n), tokens)
        pair = np.flatnonzero(self.passage[1:] == self.passage[:-1])
        t = token.astype(np.uint64)
        self.pair = (_mix(t[pair] * np.uint64(0xD6E8FEB86659FD93) + t[pair + 1]) >> np.uint64(64 - BITS)).astype(np.int32)
        self.pair_of = self.passage[pair]

    @classmethod
    def of_batch(cls, batch: pa.RecordBatch) -> Counted:
        sizes, token, flags = batch.column("sizes"), batch.column("token"), batch.column("flags")
        doc = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(sizes)))
        return cls(np.asarray(token.flatten()), np.asarray(sizes.flatten()).astype(np.int64), np.asarray(flags.flatten()), doc)

    def sums(self, of_feature: np.ndarray) -> np.ndarray:
        return np.bincount(self.passage, weights=of_feature[self.token], minlength=self.n) + np.bincount(self.pair_of, weights=of_feature[self.pair], minlength=self.n)

    def tally(self, weight: np.ndarray, size: int) -> np.ndarray:
        """The weight of the passages that each feature is in."""
        return np.bincount(self.token, weights=weight[self.passage], minlength=size) + np.bincount(self.pair, weights=weight[self.pair_of], minlength=size)


def plain_forms(text: str) -> str:
    """The text with a sign for each form but those in brackets or after a note's word, and one for each quotation."""
    text = _QUOTES.sub(f" {_QUOTE} ", text)
    return _ALL_FORMS.sub(lambda m: m[0] if m.lastgroup in ("bracket", "note", "round", "angle") else f" {_FORM} ", text)


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) >> (32 - FORM_BITS)


def occurrences(text: str) -> list[tuple[str, list[str], list[str]]]:
    """(feature of the manner, words in it, words beside it) of each form in a text; open or quoted, and its kind, is the manner."""
    out = []
    spans = [m.span() for m in _QUOTES.finditer(text)]
    found = list(_ALL_FORMS.finditer(text))
    # Beside a form stand the words of its line, other forms aside.
    for m in found:
        a, b = m.span()
        inner = sorted({"0" if w.isdigit() else w.lower() for w in re.findall(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+|\d+", m[0])})
        head = _ALL_FORMS.sub(" ", text[max(text.rfind("\n", 0, a) + 1, a - 60) : a])
        end = text.find("\n", b)
        tail = _ALL_FORMS.sub(" ", text[b : min(end if end >= 0 else len(text), b + 60)])
        near = [w.lower() for w in (re.findall(r"[^\W\d_]+|[:,]", head)[-5:] + re.findall(r"[^\W\d_]+|[:,]", tail)[:5])]
        quoted = any(i <= a and b <= j for i, j in spans)
        beside = sorted(set(near)) + (["⟦mention⟧"] if MENTION & set(near) else [])
        out.append((("quoted " if quoted else "open ") + m.lastgroup, inner[:8], beside))
    return out


def is_template(text: str) -> bool:
    """Trusted: three lines in four or more hold a form outside of quotations, and TRUSTED_FORMS of them at least do."""
    lines = [x for x in _QUOTES.sub(" ", text).split("\n") if x.strip()]
    held = sum(bool(_ALL_FORMS.search(x)) for x in lines)
    return held >= TRUSTED_FORMS and 4 * held >= 3 * len(lines)


def _log_odds(left: np.ndarray, real: np.ndarray, n_left: float, n_real: float) -> np.ndarray:
    return np.log((left + 0.5) / (n_left + 1.0)) - np.log((real + 0.5) / (n_real + 1.0))


class FormModel:
    """Log-odds of what stands in and beside a form, and of its manner, for a placeholder left behind against other uses."""

    #: Where words in a form go that no trusted record has in one, and where the share of each class is kept.
    OTHER = 1 << FORM_BITS

    def __init__(self, known: np.ndarray, odds: np.ndarray | None = None, context: bool = False, prior: float = 0.0) -> None:
        self.known, self.odds, self.context, self.prior = known, odds, context, prior

    def slots(self, manner: int, inner: list[int], beside: list[int]) -> list[int]:
        return [manner, *{w if self.known[w] else self.OTHER for w in inner}, *beside]

    def score(self, manner: int, inner: list[int], beside: list[int]) -> float:
        """Log-odds that a form was left behind, the share of such forms included."""
        if self.odds is None:
            return -np.inf
        about = float(np.clip(self.odds[beside].sum(), -MOST_BESIDE, MOST_BESIDE)) if self.context and beside else 0.0
        return float(self.odds[self.slots(manner, inner, [])].sum()) + about + self.prior


def _forms_table(docs: DataFrame) -> DataFrame:
    """(doc_id, trusted, manner, inner, beside): a row for each form of all documents, features by their hash; written.

    trusted: true in a template, false in quotation marks, else null.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            batch = batch.filter(pc.match_substring_regex(batch.column("text"), SIGNS))
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = occurrences(text)
                trusted = bool(found) and is_template(text)
                for manner, inner, beside in found:
                    ids.append(i)
                    rows.append({"trusted": True if trusted and manner[0] == "o" else False if manner[0] == "q" else None, "manner": _bucket(manner), "inner": [_bucket(f"in {w}") for w in inner], "beside": [_bucket(f"by {w}") for w in beside]})
            schema = pa.schema([("trusted", pa.bool_()), ("manner", pa.int32()), ("inner", pa.list_(pa.int32())), ("beside", pa.list_(pa.int32()))])
            t = pa.RecordBatch.from_pylist(rows, schema)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *t.columns], ["doc_id", *schema.names])

    return written(docs.mapInArrow(run, f"doc_id {kind}, trusted boolean, manner int, inner array<int>, beside array<int>"), "forms")


def fit_forms(table: DataFrame, rounds: int = FORM_ROUNDS, context_rounds: int = CONTEXT_ROUNDS) -> FormModel:
    """The model of forms, by expectation-maximization over all forms of all documents.

    The forms of trusted templates are placeholders, quoted ones are not; all others are unlabelled and begin as other uses. The first rounds know
    manner and words in the form only, as templates have no text beside them; what stands beside is learnt after them from
    the posterior. Only counts by hashed feature come to the driver.
    """
    size = FormModel.OTHER + 1
    inner = table.where("trusted").select(F.explode(F.array_distinct("inner")).alias("f")).groupBy("f").count().where("count > 1").collect()
    known = np.zeros(size, bool)
    known[[r.f for r in inner]] = True
    model = FormModel(known)
    if not inner:
        return model
    for step in range(rounds + context_rounds):
        now = model

        def tally(batches: Iterator[pa.RecordBatch], now: FormModel = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 2 * size + 1))
            for batch in batches:
                for r in batch.to_pylist():
                    w = float(r["trusted"]) if r["trusted"] is not None else 0.0 if now.odds is None else 1.0 / (1.0 + np.exp(-np.clip(now.score(r["manner"], r["inner"], r["beside"]), -30, 30)))
                    at = [*now.slots(r["manner"], r["inner"], r["beside"]), size, *(size + 1 + f for f in set(r["inner"]))]
                    total[1, at] += w
                    total[0, at] += 1.0 - w
            at = np.flatnonzero(total.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0, at]), pa.array(total[1, at])], ["f", "real", "left"])

        rows = table.mapInArrow(tally, "f int, real double, left double").groupBy("f").agg(F.sum("real").alias("real"), F.sum("left").alias("left")).toArrow()
        counts = np.zeros((2, 2 * size + 1))
        counts[:, rows.column("f").to_numpy()] = [rows.column("real").to_numpy(), rows.column("left").to_numpy()]
        words = counts[:, size + 1 :]
        n_real, n_left = counts[:, size]
        # What was hardly met says nothing.
        met = counts[:, :size].sum(axis=0) >= MIN_MET
        met[FormModel.OTHER] = True
        odds = np.where(met, np.clip(_log_odds(counts[1, :size], counts[0, :size], n_left, n_real), -MOST, MOST), 0.0)
        if step >= 2:
            # Words that stand in forms left behind elsewhere are known in all.
            known = known | (words[1] >= 2) & (words[1] > words[0])
        model = FormModel(known, odds, step >= rounds, float(np.log((n_left + 1) / (n_real + 1))))
    return model


def _chunks(texts: list[str], size: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about so many characters together, a longer text alone, with the place of the first."""
    at, part, n = 0, [], 0
    for i, t in enumerate(texts):
        if part and n + len(t) > size:
            yield at, part
            at, part, n = i, [], 0
        part.append(t)
        n += len(t)
    if part:
        yield at, part


def _flags(p: Passages, hint: np.ndarray) -> np.ndarray:
    """Of each passage: 1 for the shape of a real one, 2 if it is trusted to be filler, 4 to be an error, 8 for another of a trusted error's record."""
    out = p.shape().astype(np.int8)
    of = hint[p.doc]
    for k, bit in ((FILLER, 2), (ERROR, 4)):
        for i in np.flatnonzero(of == k).tolist():
            if _SEEDS[k].search(p.text(i).lower()):
                out[i] |= bit
    # A trusted error is short: its other passages are as likely to be of it as real.
    out[(of == ERROR) & (out & 6 == 0)] |= 8
    return out


def _passage_table(docs: DataFrame) -> DataFrame:
    """(doc_id, token, sizes, flags): the tokens of each document with any, and of its passages the number of tokens and the flags; written.

    Later passes read these small numbers in place of the texts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            hint = np.where(np.asarray(pc.match_substring_regex(text, FILLER_SEEDS, ignore_case=True)), FILLER, REAL)
            short = np.flatnonzero(np.asarray(pc.and_(pc.less_equal(pc.utf8_length(text), TRUSTED_CHARS), pc.invert(pc.match_substring(text, "“")))))
            hint[short[np.asarray(pc.match_substring_regex(text.take(pa.array(short)), "(?s)" + ERROR_SEEDS, ignore_case=True))]] = ERROR
            texts = text.to_pylist()
            for i in np.flatnonzero(np.asarray(pc.match_substring_regex(text, _SIGNS_OR_QUOTES))).tolist():
                texts[i] = plain_forms(texts[i])
            for at, part in _chunks(texts):
                p = Passages(part)
                flags = _flags(p, hint[at : at + len(part)])
                held = np.bincount(p.doc, minlength=len(part))
                inside = np.bincount(p.doc, weights=p.tokens, minlength=len(part))
                offsets = lambda c: pa.array(np.concatenate([[0], np.cumsum(c)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets(c), pa.array(v)) for c, v in ((inside, p.token), (held, p.tokens.astype(np.int32)), (held, flags))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), *lists], ["doc_id", "token", "sizes", "flags"]).filter(pa.array(held > 0))

    return written(docs.mapInArrow(run, f"doc_id {kind}, token array<int>, sizes array<int>, flags array<tinyint>"), "passages")


def fit(passages: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """(2, 2^BITS): log-odds of each feature against real content, for filler and for errors; from all passages of all documents.

    Trusted passages keep their class. All others are reweighed in each round by the posterior of the model before, less the
    margins of the decisions; they begin as real, those beside a trusted error as half of it. Only counts by hashed feature come to the driver.
    """
    size = 1 << BITS
    odds, prior = np.zeros((2, size), np.float32), np.zeros(3)
    for step in range(rounds):
        model = passages.sparkSession.sparkContext.broadcast((odds, prior))

        def tally(batches: Iterator[pa.RecordBatch], step: int = step, model=model) -> Iterator[pa.RecordBatch]:
            total, sure, share = np.zeros((3, size)), np.zeros(size, bool), np.zeros(3)
            now, before = model.value
            for batch in batches:
                p = Counted.of_batch(batch)
                weight = np.zeros((3, p.n))
                if step:
                    s = np.stack([np.full(p.n, before[0]), before[1] + p.sums(now[0]) - MIN_FILLER, before[2] + p.sums(now[1]) - MIN_ERROR])
                    e = np.exp(s - s.max(axis=0))
                    weight[:] = e / e.sum(axis=0)
                else:
                    weight[ERROR] = 0.5 * (p.flags & 8 > 0)
                    weight[REAL] = 1.0 - weight[ERROR]
                known = (p.flags & 6) > 0
                weight[:, known] = 0.0
                weight[FILLER, p.flags & 2 > 0] = weight[ERROR, p.flags & 4 > 0] = 1.0
                weight[weight <= 0.01] = 0.0
                share += weight.sum(axis=1)
                total[REAL] += p.tally(weight[REAL], size)
                # Few passages are of the other classes: only those are counted.
                for k in (FILLER, ERROR):
                    t, q = np.flatnonzero(weight[k][p.passage]), np.flatnonzero(weight[k][p.pair_of])
                    total[k] += np.bincount(p.token[t], weights=weight[k][p.passage[t]], minlength=size) + np.bincount(p.pair[q], weights=weight[k][p.pair_of[q]], minlength=size)
                sure[p.token[known[p.passage]]] = True
                sure[p.pair[known[p.pair_of]]] = True
            at = np.flatnonzero(total.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, size), pa.int32()), *[pa.array(np.append(total[k, at], share[k])) for k in range(3)], pa.array(np.append(sure[at], True))], ["f", "real", "filler", "error", "sure"])

        schema = "f int, real double, filler double, error double, sure boolean"
        rows = passages.select("token", "sizes", "flags").mapInArrow(tally, schema).groupBy("f").agg(*[F.sum(c).cast("float").alias(c) for c in ("real", "filler", "error")], F.max("sure").alias("sure")).where("sure or real + filler + error >= 2").toArrow()
        model.unpersist()
        f = rows.column("f").to_numpy()
        counts = np.zeros((3, size + 1))
        counts[:, f] = [rows.column(c).to_numpy() for c in ("real", "filler", "error")]
        prior = np.log((counts[:, size] + 1) / (counts[:, size].sum() + 3))
        f = f[f < size]
        n = counts[:, :size].sum(axis=1)
        # Each class leans to what is usual in all: what a class was never seen to have speaks against it, however small it is.
        usual = counts[:, f].sum(axis=0) / max(n.sum(), 1.0)
        share_of = lambda k: (counts[k, f] + SMOOTH * usual) / (n[k] + SMOOTH)
        odds = np.zeros((2, size), np.float32)
        for i, k in enumerate((FILLER, ERROR)):
            # A class that no trusted passage is of is not looked for.
            if counts[k, size] > 0:
                odds[i, f] = np.clip(np.log(share_of(k)) - np.log(share_of(REAL)), -MOST, MOST)
    return odds


def decide(p: Counted, n: int, odds: np.ndarray) -> np.ndarray:
    """REAL, FILLER or ERROR for each of n documents.

    One filler passage marks a document however much real text is around it; errors and notices only mark it if no real
    sentence or table row stands beside them. A passage is filler itself, and does not just name it, if most of its words are of
    filler's vocabulary; a sentence that shares some turns with notices is none: most of a notice's pairs of words are known from notices.
    """
    filler, error = p.sums(odds[0]), p.sums(odds[1])
    odd = np.bincount(p.passage, weights=odds[0][p.token] > 0, minlength=p.n)
    is_filler = (filler >= MIN_FILLER) & ((filler > error) | (p.flags & 2 > 0)) & (2 * odd > p.tokens) & (p.tokens > 2)
    like = np.bincount(p.pair_of, weights=odds[1][p.pair] > 0, minlength=p.n) >= ALIKE * np.bincount(p.pair_of, minlength=p.n)
    real = (error <= 0) & (p.flags & 1 > 0)
    count = lambda w: np.bincount(p.doc, weights=w, minlength=n)
    out = np.full(n, REAL)
    out[(count(real) == 0) & (count(np.where(like, np.maximum(error, 0.0), 0.0)) >= MIN_ERROR)] = ERROR
    out[count(is_filler) > 0] = FILLER
    return out


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, kind) of the documents that hold residue in place of content; kind: placeholder, filler or error.

    A placeholder counts before filler, filler before an error. Null, empty and white-space texts hold none. Repeated rows of a
    doc_id give one row for each kind of theirs at most; rows with a null doc_id are left out. Other columns are not read, and
    texts are never shuffled.
    """
    spark = documents.sparkSession
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    forms = _forms_table(docs)
    form_model = fit_forms(forms)
    left = form_model.odds is not None

    def placeholders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield batch.select(["doc_id"]).filter(pa.array([left and r["trusted"] is not False and (r["trusted"] or form_model.score(r["manner"], r["inner"], r["beside"]) >= MIN_PLACEHOLDER) for r in rows], pa.bool_()))

    marked = forms.mapInArrow(placeholders, f"doc_id {kind}").distinct()
    passages = _passage_table(docs)
    odds = spark.sparkContext.broadcast(fit(passages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = decide(Counted.of_batch(batch), batch.num_rows, odds.value)
            hit = np.flatnonzero(k != REAL)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(hit)), pa.array(["filler" if k[i] == FILLER else "error" for i in hit], pa.string())], ["doc_id", "kind"])

    others = passages.mapInArrow(run, f"doc_id {kind}, kind string")
    both = marked.withColumn("kind", F.lit("placeholder")).unionByName(others)
    order = F.when(F.col("kind") == "placeholder", 0).when(F.col("kind") == "filler", 1).otherwise(2)
    return both.groupBy("doc_id").agg(F.min_by("kind", order).alias("kind"))
