r"""Encoding of texts with a byte-level BPE rank file.

Pre-tokenisation reproduces the split pattern of the rank files
(``'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+``)
without a regex: code points become an array of classes (letter, number, white
space, other); a run's start reaches all of its places by a running maximum, an
associative scan, so a whole batch of texts is cut at once. Where runs start, what a
space in front of a run joins, and where an apostrophe opens a contraction follow
from the classes of neighbouring places alone. The slices go through pair merging
once each and are then looked up.

Defined results: null and empty texts have no ids (an empty list); texts that look
like special tokens are plain text; a row is encoded for every row of the table,
also with a null id. Offsets are the ends of the tokens in bytes of the text, so
``text.encode()[end[i-1]:end[i]]`` is token i.
"""

from __future__ import annotations

import base64
import heapq
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files of public tokenizers are.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Code points with the White_Space property. Fixed values.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Characters that are cut at a time.
_BLOCK_CHARS = 400_000
_CACHE = 400_000
#: Longer slices are not kept.
_CACHED_CHARS = 64


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = SPACE
    return table


def cuts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one string, the starts of all slices in it, and how many slices each text has."""
    whole = "".join(texts)
    n = len(whole)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if not n:
        return whole, np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[code]
    first = np.zeros(n + 1, bool)  # a text starts here
    ends = np.cumsum(lengths)
    first[np.concatenate(([0], ends))] = True
    opens = first[:n].copy()
    opens[1:] |= kind[1:] != kind[:-1]  # a run of one class starts here
    place = np.arange(n)
    run = np.maximum.accumulate(np.where(opens, place, 0))  # the start of the run that each place is in
    closes = np.append(opens[1:], True)

    start = opens.copy()
    # the last white space before something else is a slice of its own, or the front of the next slice if it is a blank
    last_space = closes & (kind == SPACE) & ~first[1:]
    start |= last_space
    blank = last_space & (code == 0x20)
    after = np.flatnonzero(blank) + 1
    start[after] = False
    # contractions: a lone apostrophe that no blank joins, with certain letters after it
    quote = np.flatnonzero((code == 0x27) & opens & closes & ~first[1:])
    quote = quote[(quote + 1 < n)]
    quote = quote[(kind[np.minimum(quote + 1, n - 1)] == LETTER) & ((quote == 0) | first[quote] | ~blank[np.maximum(quote - 1, 0)])]
    if len(quote):
        a = code[quote + 1]
        two = quote + 2
        inside = two < n
        b = np.where(inside & ~first[np.minimum(two, n)], code[np.minimum(two, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        pair = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for q, width in ((quote[one], 2), (quote[pair & ~one], 3)):
            start[q + 1] = False
            at = q + width
            at = at[at < n]
            start[at] |= run[at] == run[at - 1]  # the letters left of the run start a slice; else one starts there already
    starts = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], ends))))
    return whole, starts, counts


class Encoder:
    """Merges by a rank file, with a cache of slices."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a slice: the pair of lowest rank is merged first, the leftmost among equals."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n = len(piece)
        ends = list(range(1, n + 1))  # the end of the part that starts here
        before = list(range(-1, n - 1))  # the start of the part before
        alive = [True] * n
        heap = []
        for i in range(n - 1):
            if (r := ranks.get(piece[i : i + 2])) is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            r, i, end = heapq.heappop(heap)
            if not alive[i] or ends[i] >= end:
                continue
            mid = ends[i]
            if mid >= n or not alive[mid] or ends[mid] != end:
                continue
            alive[mid] = False
            ends[i] = end
            if end < n:
                before[end] = i
                if (q := ranks.get(piece[i : ends[end]])) is not None:
                    heapq.heappush(heap, (q, i, ends[end]))
            if (j := before[i]) >= 0 and (q := ranks.get(piece[j:end])) is not None:
                heapq.heappush(heap, (q, j, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return tuple(out)

    def slices(self, texts: list[str]) -> tuple[list[tuple[int, ...]], np.ndarray]:
        """The ids of each slice of all texts, and the number of slices of each text."""
        whole, starts, counts = cuts(texts)
        bounds = starts.tolist()
        words = [whole[a:b] for a, b in zip(bounds, [*bounds[1:], len(whole)])]
        cache = self.cache
        if len(cache) > _CACHE:
            cache.clear()
        long = {}
        for w in set(words).difference(cache):
            (cache if len(w) <= _CACHED_CHARS else long)[w] = self.merge(w.encode("utf-8", "surrogatepass"))
        if long:
            return [cache[w] if w in cache else long[w] for w in words], counts
        return list(map(cache.__getitem__, words)), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        ids, counts = self.slices(texts)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        upto = np.concatenate(([0], np.cumsum(sizes)))
        ends = upto[np.cumsum(counts)] if len(counts) else np.empty(0, np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(upto[-1]))
        return flat, np.diff(np.concatenate(([0], ends)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str, directory: str | None = None) -> str:
    return os.path.join(directory or TOKENIZERS, f"{name}.tiktoken")


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    at, block, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if block and size + len(t) > _BLOCK_CHARS:
            yield at, block
            at, block, size = i, [], 0
        block.append(t)
        size += len(t)
    if block:
        yield at, block


def _encoded(batches: Iterator[pa.RecordBatch], path: str, offsets: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    width = np.zeros(max(enc.ranks.values()) + 1, np.int64)
    for token, rank in enc.ranks.items():
        width[rank] = len(token)
    for batch in batches:
        text_at = batch.num_columns - 1
        for at, block in _blocks(batch.column(text_at).to_pylist()):
            flat, sizes = enc.encode(block)
            bounds = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            cols = [batch.column(c).slice(at, len(block)) for c in range(text_at)] + [pa.ListArray.from_arrays(bounds, pa.array(flat))]
            if offsets:
                ends = np.cumsum(width[flat])
                starts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))[:-1]] if len(sizes) else np.empty(0, np.int64)
                cols.append(pa.ListArray.from_arrays(bounds, pa.array((ends - np.repeat(starts, sizes)).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, ["id", "ids", "ends"][: len(cols)])


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        last = batch.num_columns - 1
        sizes = [enc.encode(block)[1] for _, block in _blocks(batch.column(last).to_pylist())]
        n = pa.array(np.concatenate(sizes) if sizes else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(last)), n], [*batch.schema.names[:last], "n_tokens"])


def encode(df: DataFrame, id_col: str, text_col: str, path: str, *, offsets: bool = False) -> DataFrame:
    """The id column and ``ids`` (and ``ends``) of every row."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(src.dtypes)["id"]
    out = src.mapInArrow(lambda b: _encoded(b, path, offsets), f"id {kind}, ids array<int>" + ", ends array<int>" * offsets)
    return out.withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, text_col: str, path: str, *keep_cols: str) -> DataFrame:
    """``keep_cols`` and ``n_tokens`` of every row."""
    src = df.select(*keep_cols, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in src.dtypes[:-1])
    return src.mapInArrow(lambda b: _counted(b, path), f"{schema}, n_tokens bigint")


def decode(ids: list[int], path: str) -> str:
    """The text of a list of ids."""
    enc = encoder(path)
    back = enc.__dict__.setdefault("back", {r: t for t, r in enc.ranks.items()})
    return b"".join(back[i] for i in ids).decode("utf-8", "surrogatepass")
