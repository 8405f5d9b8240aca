"""Cutting long texts at natural boundaries, with an overlap.

Words are what stands between white space. A text of more than ``limit`` words is
cut into pieces of at most ``limit`` words; each piece after the first begins with
the last ``overlap`` words of the one before. Where to cut is found by dynamic
programming over cut places: the cost of a cut is 0 at the end of a paragraph, a
little at the end of a sentence, more after a clause, most inside one, and the cost
of a piece is its squared distance from an even share. Words inside a clause are
cut places only where sentences and paragraphs leave no other way, so a text with
sentence ends within reach is always cut at them.

Defined results: null ids and null texts have no pieces; a text within the limit is
one piece (or none with ``only_long``); blank texts have no pieces; a chunk
delivered twice counts once; white space between words is kept inside pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\S+")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’)\]]*$")
_CLAUSE = re.compile(r"(?:[,;:]|--|[—–])[\"'”’)\]]*$")
_ABBREVIATION = re.compile(r"^[\"'“‘(\[]*(?:Mr|Mrs|Ms|Dr|Hon|Gen|Rev|Col|Capt|St|No|Nos|Art|Sec|Vol|pp?|[A-Z])\.$")
#: Costs of a cut at the end of a paragraph, sentence, clause, and elsewhere.
PARAGRAPH, SENTENCE, CLAUSE, INSIDE = 0.0, 0.05, 4.0, 8.0


def cut_costs(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The spans of the words, and the cost of a cut after each."""
    spans = [m.span() for m in _WORD.finditer(text)]
    cost = np.full(len(spans), INSIDE)
    for i, (a, b) in enumerate(spans):
        gap = text[b : spans[i + 1][0]] if i + 1 < len(spans) else "\n\n"
        word = text[a:b]
        if gap.count("\n") > 1:
            cost[i] = PARAGRAPH
        elif _SENTENCE.search(word) and not _ABBREVIATION.search(word):
            cost[i] = SENTENCE
        elif _CLAUSE.search(word):
            cost[i] = CLAUSE
    return spans, cost


def _places(cost: np.ndarray, first: int, fresh: int) -> np.ndarray:
    """Cut places (numbers of words before them): natural ends, and all places in gaps too wide for a piece."""
    n = len(cost)
    natural = np.flatnonzero(cost <= SENTENCE) + 1
    natural = natural[natural < n]
    bounds = np.concatenate(([0], natural, [n]))
    gaps = np.diff(bounds)
    room = np.where(bounds[:-1] == 0, first, fresh)
    extra = [np.arange(bounds[i] + 1, bounds[i + 1]) for i in np.flatnonzero(gaps > room)]
    return np.unique(np.concatenate([[0], natural, *extra, [n]])).astype(np.int64)


def cut_points(cost: np.ndarray, limit: int, overlap: int) -> list[int]:
    """The numbers of words after which to cut, the last being all of them."""
    n, fresh = len(cost), limit - overlap
    if n <= limit:
        return [n]
    pieces = 1 + -(-(n - limit) // fresh)
    share = (n + overlap * (pieces - 1)) / pieces
    places = _places(cost, limit, fresh)
    best = np.full(len(places), np.inf)
    back = np.zeros(len(places), np.int64)
    best[0] = 0.0
    lows = np.searchsorted(places, places - fresh)
    for j in range(1, len(places)):
        end = places[j]
        low = 0 if end <= limit else lows[j]
        starts = places[low:j]
        words = end - starts + np.where(starts == 0, 0, overlap)
        # a little for every piece keeps their number down
        total = best[low:j] + ((words - share) / share) ** 2 + 0.25
        total[words > limit] = np.inf
        k = int(np.argmin(total))
        best[j] = total[k] + (cost[end - 1] if end < n else 0.0)
        back[j] = low + k
    out, j = [], len(places) - 1
    while j > 0:
        out.append(int(places[j]))
        j = back[j]
    return out[::-1]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(first word, number of words, text) of each piece."""
    spans, cost = cut_costs(text)
    if not spans:
        return []
    out, start = [], 0
    for end in cut_points(cost, limit, overlap):
        out.append((start, end - start, text[spans[start][0] : spans[end - 1][1]]))
        start = max(0, end - overlap)
    return out


def _pieces(batches: Iterator[pa.RecordBatch], limit: int, overlap: int, only_long: bool) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    names = ["id", "parent", "piece_no", "pieces", "first_word", "n_words", "text"]
    for batch in batches:
        rows = []
        for i, parent, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
            got = split_text(text, limit, overlap)
            if len(got) > 1 or not only_long:
                rows += [(i, parent, k, len(got), *piece) for k, piece in enumerate(got)]
        cols = list(zip(*rows)) if rows else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def split_long(df: DataFrame, id_col: str = "chunk_id", parent_col: str = "document_id", text_col: str = "text", *, limit: int = 650, overlap: int = 45, only_long: bool = True, unique: bool = False) -> DataFrame:
    """id, parent, piece_no (from 0), pieces, first_word, n_words, text of each piece. ``unique``: ids are known to occur once, so texts need not be shuffled to see to it."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than a piece")
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(parent_col).cast("string").alias("parent"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    if only_long:
        # more than limit words need as many characters, and white space between them
        src = src.where(F.length("text") > 2 * limit)
    if not unique:
        src = src.dropDuplicates(["id"])
    return src.mapInArrow(lambda b: _pieces(b, limit, overlap, only_long), "id string, parent string, piece_no int, pieces int, first_word int, n_words int, text string")
