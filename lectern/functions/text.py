"""Text as columns: four tokenizers, normalisation, counting, previews, snippets.

All is built from built-in functions but for Unicode normal forms, entity decoding,
HTML and snippets, which are vectorised functions that get only the rows that need
them (plain ASCII text has nothing to normalise).
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The stop words of the four tokenizers and of the word count.
STOP_ARCHIVE = "a an and are as at be but by for from has have he her him his i if in into is it its may of on or our shall she such than that the their them then there these they this those to upon us was we were what when which who will with would you your".split()
STOP_LIBRARY = "a all an and are as at be both by can could did do does each every few for from has have having he how i in is it its just me more most my no nor not of on only or own so some such than that the these this those to too very was we what when where which who why will with would you your".split()
STOP_BROWSER = "a about all am an and are as at be been being both but by can could did do does during each every few for from had has have he how i if in into is it its just may might more most must no nor not of on only or other own same she should so some such than that the these they this those through to too up very was we were what when where which who why will with would you".split()
STOP_SCRIPT = "a an and are as at be been but by for from had has have he her his if in into is it its of on or that the their them there they this to was were which who with".split()
STOP_FREQUENCY = "a an and are at be been but by can could did do does for from had has have how is in may might must of on or shall should that the this to was were what when where which who whom why will with would".split()

NOT_ASCII = r"[^\x00-\x7F]"


def words_literal(words: Sequence[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def nfkc(text: Column) -> Column:
    """Compatibility normal form; only texts with other than ASCII leave the JVM."""
    return F.coalesce(_nfkc(F.when(text.rlike(NOT_ASCII), text)), text)


def unescape(text: Column) -> Column:
    """Character references decoded; only texts with an ampersand leave the JVM."""
    return F.coalesce(_unescape(F.when(F.contains(text, F.lit("&")), text)), text)


def tokens_archive(text: Column, stop: Sequence[str] = STOP_ARCHIVE, least_bytes: int = 2) -> Column:
    """NFKC, runs of letters and digits, lower case, by length in bytes, without stop words; order and repeats kept."""
    parts = F.split(F.lower(nfkc(text)), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: (F.octet_length(t) >= least_bytes) & ~F.array_contains(words_literal(stop), t))


def tokens_library(text: Column, stop: Sequence[str] = STOP_LIBRARY, least: int = 3, most: int = 50) -> Column:
    """Runs of a-z, digits and apostrophes of 3 to 50 characters."""
    parts = F.regexp_extract_all(normalize_text(text), F.lit("[a-z0-9']+"), F.lit(0))
    return F.filter(parts, lambda t: F.length(t).between(least, most) & ~F.array_contains(words_literal(stop), t))


def tokens_browser(text: Column, stop: Sequence[str] = STOP_BROWSER, least_bytes: int = 3) -> Column:
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: (F.octet_length(t) >= least_bytes) & ~F.array_contains(words_literal(stop), t))


def tokens_all(text: Column) -> Column:
    """Runs of a-z, digits and apostrophes, none dropped."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))


def tokens_script(text: Column, stop: Sequence[str] = STOP_SCRIPT, least: int = 3) -> Column:
    return F.filter(tokens_all(text), lambda t: (F.length(t) >= least) & ~F.array_contains(words_literal(stop), t))


def query_terms(query: str, least: int = 3) -> list[str]:
    """A query's terms where stop words are kept."""
    return [t for t in re.findall(r"[a-z0-9']+", query.lower()) if len(t) >= least]


def archive_terms(query: str, stop: Sequence[str] = STOP_ARCHIVE, least_bytes: int = 2) -> list[str]:
    """A query as the archive tokenizer reads it (on the driver: a query is one line)."""
    parts = re.split(r"[^\w]+|_+", unicodedata.normalize("NFKC", query).lower())
    return [t for t in parts if len(t.encode()) >= least_bytes and t not in stop]


# normalisation -----------------------------------------------------------------


def normalize_whitespace(text: Column) -> Column:
    """LF line ends, no byte order mark, single blanks, at most one empty line, trimmed."""
    x = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "﻿", "")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(nfkc(text)), r"\s+", " "))


def identifier(text: Column) -> Column:
    """Lower case, runs of other than a-z and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug(text: Column, default: str = "") -> Column:
    x = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(x == "", F.lit(default)).otherwise(x)


def slug_plain(text: Column) -> Column:
    """Blanks to dashes, other punctuation to underscores, nothing collapsed; letters, digits and dashes stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\s", "-"), "[^a-z0-9-]", "_")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[.!?]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


def occurrences(text: Column, term: Column | str) -> Column:
    """How often a term stands in a text, not overlapping."""
    term = F.lit(term) if isinstance(term, str) else term
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")


def phrase_pattern(phrase: str) -> str:
    """A phrase as a word-bounded pattern whose blanks match any white space."""
    return r"\b" + r"\s+".join(re.escape(w) for w in phrase.split()) + r"\b"


def phrase_score(text: Column, phrases: Sequence[str]) -> Column:
    """The summed counts of phrases."""
    low = F.lower(text)
    total = F.lit(0)
    for p in phrases:
        total = total + F.regexp_count(low, F.lit(phrase_pattern(p.lower())))
    return total


def preview(text: Column, chars: int = 200) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)


def word_preview(text: Column, count: int = 40, more: str = "…") -> Column:
    w = words(text)
    return F.when(F.size(w) > count, F.concat(F.array_join(F.slice(w, 1, count), " "), F.lit(more))).otherwise(F.array_join(w, " "))


def simple_snippet(text: Column, query: str, around: int = 100, head: int = 200) -> Column:
    """The text around the first place of the query, else its beginning."""
    at = F.locate(query.lower(), F.lower(text))
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(text, start, F.lit(len(query)) + (at - start) + around)).otherwise(F.substring(text, 1, head))


# cleaning ----------------------------------------------------------------------


def strip_tags(text: Column) -> Column:
    """Breaks and ends of blocks to line ends, tags dropped, entities decoded, typographic quotes made plain."""
    x = F.regexp_replace(text, r"(?i)<br\s*/?>|</(?:p|div|h[1-6]|li|tr|blockquote)>", "\n")
    x = unescape(F.regexp_replace(x, "<[^>]+>", ""))
    return normalize_whitespace(F.translate(x, "‘’“”", "''\"\""))


def strip_boilerplate(text: Column) -> Column:
    """What stands between the START and END marks of an e-book, or all of it."""
    x = F.regexp_replace(text, r"(?is)^.*?\*\*\*\s*START OF [^\n]*?\*\*\*", "")
    return F.regexp_replace(x, r"(?is)\*\*\*\s*END OF .*$", "")


def cut_markers(text: Column, start: str | None = None, end: str | None = None) -> Column:
    """From the start mark on, up to the end mark; marks that are absent cut nothing."""
    x = text
    if start:
        at = F.locate(start, x)
        x = F.when(at > 0, F.substring(x, at, F.length(x))).otherwise(x)
    if end:
        upto = F.locate(end, x)
        x = F.when(upto > 0, F.substring(x, F.lit(1), upto - 1)).otherwise(x)
    return x


def drop_footnotes(text: Column) -> Column:
    """Bracketed and starred footnote marks, bracketed source notes, and lines of a page number only."""
    x = F.regexp_replace(text, r"\[\d{1,3}\]|\{\d{1,3}\}|\(\*\)", "")
    x = F.regexp_replace(x, r"(?i)\[(?:source|note|footnote)[^\]]*\]", "")
    return normalize_whitespace(F.regexp_replace(x, r"(?m)^[ \t]*\d{1,4}[ \t]*$", ""))


def plain_ligatures(text: Column) -> Column:
    x = F.replace(F.replace(F.replace(text, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), F.lit("œ"), F.lit("oe"))
    return normalize_whitespace(x)


class _Reader(HTMLParser):
    BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li tr br section article blockquote".split())

    def __init__(self, skip: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.skip, self.depth, self.out = skip, 0, []

    def handle_starttag(self, tag, attrs):
        if tag in self.skip:
            self.depth += 1
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.skip and self.depth:
            self.depth -= 1
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


def _read_html(page: str | None, skip: frozenset[str]) -> str | None:
    if page is None:
        return None
    reader = _Reader(skip)
    reader.feed(page)
    reader.close()
    lines = (re.sub(r"[ \t]+", " ", line).strip() for line in "".join(reader.out).split("\n"))
    return "\n".join(line for line in lines if line)


@F.pandas_udf(T.StringType())
def html_body(s: pd.Series) -> pd.Series:
    """The text of a page without script, style and the frame around it."""
    return s.map(lambda x: _read_html(x, frozenset("script style noscript header footer".split())))


@F.pandas_udf(T.StringType())
def html_events(s: pd.Series) -> pd.Series:
    """The text of a page without script and style, block by block."""
    return s.map(lambda x: _read_html(x, frozenset("script style noscript".split())))


# snippets ----------------------------------------------------------------------

SNIPPET = "text string, highlights array<struct<start:int,end:int>>, leading_ellipsis boolean, trailing_ellipsis boolean"


def find_terms(text: str, terms: Sequence[str]) -> list[tuple[int, int]]:
    """Word-bounded places of the terms whatever their case, overlaps merged."""
    spans: list[tuple[int, int]] = []
    for term in terms:
        if term:
            spans += [m.span() for m in re.finditer(rf"(?<!\w){re.escape(term)}(?!\w)", text, re.IGNORECASE)]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def densest_snippet(text: str, terms: Sequence[str], window: int) -> tuple[str, list[tuple[int, int]], bool, bool]:
    """The window that holds most places (the first of them), with byte ranges of the places in it."""
    n = len(text)
    width = min(window, n)
    places = find_terms(text, terms)
    start = 0
    if places:
        best = 0
        start = min(max(places[0][0] - window // 4, 0), n - width)
        for a, _ in places:
            s = min(max(a - window // 4, 0), n - width)
            inside = sum(1 for x, y in places if x >= s and y <= s + width)
            if inside > best:
                best, start = inside, s
    piece = text[start : start + width]
    at = lambda i: len(text[start:i].encode())
    marks = [(at(a), at(b)) for a, b in places if a >= start and b <= start + width]
    return piece, marks, start > 0, start + width < n


def snippet(text: Column, terms: Sequence[str], window: int = 240) -> Column:
    """The densest snippet of each text; meant for the few rows of a result."""
    terms = list(terms)

    @F.pandas_udf(SNIPPET)
    def build(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            piece, marks, lead, trail = densest_snippet(x or "", terms, window)
            rows.append((piece, [{"start": a, "end": b} for a, b in marks], lead, trail))
        return pd.DataFrame(rows, columns=["text", "highlights", "leading_ellipsis", "trailing_ellipsis"])

    return build(text)


def marked(text: Column, highlights: Column, open_mark: str = "<mark>", close_mark: str = "</mark>") -> Column:
    """Highlights of a snippet wrapped in marks, by byte ranges."""
    raw = F.encode(text, "UTF-8")
    piece = lambda a, b: F.decode(F.substring(raw, a + 1, b - a), "UTF-8")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    walked = F.aggregate(
        highlights,
        start,
        lambda acc, h: F.struct(F.concat(acc["out"], piece(acc["at"], h["start"]), F.lit(open_mark), piece(h["start"], h["end"]), F.lit(close_mark)).alias("out"), h["end"].alias("at")),
        lambda acc: F.concat(acc["out"], piece(acc["at"], F.octet_length(text))),
    )
    return walked
