"""Texts from scanned pages into continuous paragraphs.

Three kinds of damage are found, line by line:

* ``furniture``: running headers, footers and page numbers. Short lines of capitals or
  capitalised words and lines of a page number alone are what may stand at a page's
  edge. Of headers, lines of one work are brought together by their words (letters of
  like shape made one, glue words and numbers left out) with one word or one half of
  the only word free to differ; of page numbers, lines of the corpus by their dress
  with the number masked. A line repeated so at two different places, one of which is a
  page's edge on its face (it breaks into a sentence, or carries or adjoins a number), is
  furniture. Numbers are also tested for being a run: another number of the text that
  is as far off in value as it is in pages. Only where a line is repeated nowhere do
  other signs decide: a line at a page's edge made of the words of the work's title, a
  number that says "page" or breaks into a sentence. Headings of the text (chapter,
  section, article ...) repeat too, but are none.
* ``hyphen``: a word broken at the line's end. Whether the hyphen is the word's own
  is asked of the corpus: the compound with the hyphen against the joined word, by
  the number of texts that hold them elsewhere.
* ``misread``: a word in which letters were taken for others of like shape, or with
  a stray mark. Rare words of the corpus are turned back by the confusions of a scan
  (``rn`` for ``m``, ``c`` for ``e`` ...); one that then is a much more frequent word
  was misread. What a copyist does (letters left out, doubled, swapped) is no
  confusion of shapes. Words damaged on their face (digits or marks among letters, long
  s) are misread as they stand; ``repaired`` asks the corpus for the word that is most
  frequent once digits, marks and at most one kind of confusion are turned back. Where
  it knows none, only long s, ligatures and stray marks go.

Counting goes over all texts; the frequent words that nearly all tokens hit are
handed to the tasks up to a fixed number, any other word goes through a join, so
the size of the vocabulary decides nothing.

Defined results: null ids and texts have no rows; a chunk delivered twice counts
once; lines are numbered from 1, blank ones included; empty tables give no rows. A
chunk without damage is returned by ``repaired`` with its lines joined as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.names import distance
from lectern.runtime import cut, keep, small_side

#: Marks that break a word at the end of a line. Fixed values.
BREAKS = "-‐‑­¬"
#: Marks that a scan reads into words. Fixed values.
STRAYS = "@^~|\\•·¦§#$%*+<>_`{}°"
#: What a scan takes for what: the printed letters, then what is read instead. Fixed values.
CONFUSIONS = [
    ("e", "c"), ("c", "e"), ("n", "u"), ("u", "n"), ("h", "b"), ("b", "h"), ("h", "li"), ("d", "cl"), ("m", "rn"), ("m", "in"), ("in", "m"), ("rn", "m"),
    ("w", "vv"), ("u", "ii"), ("i", "j"), ("j", "i"), ("t", "f"), ("f", "t"), ("i", "l"), ("l", "i"), ("l", "t"), ("t", "l"), ("s", "f"), ("f", "s"), ("o", "c"), ("c", "o"),
    ("w", "v"), ("v", "y"), ("y", "v"), ("g", "q"), ("q", "g"), ("a", "o"), ("o", "a"), ("e", "o"), ("o", "e"), ("li", "h"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("fi", "h"), ("k", "lc"), ("r", "i"), ("n", "ri"), ("n", "ii"), ("b", "lo"), ("a", "u"), ("ct", "d"), ("E", "F"), ("F", "E"), ("I", "T"),
]
#: What digits, marks and old letters among letters are read for. Fixed values.
FACES = {"0": ("o",), "1": ("l", "i"), "5": ("s",), "6": ("b",), "8": ("b",), "9": ("g",), "@": ("a", ""), "&": ("c",), "ſ": ("s",), "ﬁ": ("fi",), "ﬂ": ("fl",), ".": ("",)} | dict.fromkeys("^~|\\•·¦", ("",))
#: Those of them that are never anything else. Fixed values.
_UNDRESS = str.maketrans({"ſ": "s", "ﬁ": "fi", "ﬂ": "fl"} | dict.fromkeys("^~|\\•·¦", ""))
#: Places with a choice that are tried one by one; beyond, the first choice stands at all.
_CHOICES = 6
#: A misread word's true form is in at least so many times more texts, or more different texts.
TIMES = 12
#: Places at which a line has to be repeated to be furniture.
PLACES = 2
#: Pages that a number may be off from the next one for each number between them (pages without a number are skipped).
SKIPPED = 3
#: Frequent words handed to every task; others are joined.
FREQUENT_WORDS = 50_000
BROADCAST_ROWS = 300_000

_EDGE = re.compile(r"^[^\w@&ſ]+|[^\w@&ſ]+$")
_PLAIN = re.compile(r"^[a-z]+(?:['’-][a-z]+)*$")
_ORDINAL = re.compile(r"^\d+(?:st|d|nd|rd|th|s|o|mo|vo|to)?$")
_ROMAN = re.compile(r"^m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
#: Damage on a word's face: stray marks, digits among letters, a full stop inside.
_ODD = re.compile(r"[@^~|\\•·¦ſ]|[A-Za-z]\d|\d[A-Za-z]|[a-z]&|&[a-z]{2}|[ﬁﬂ]|[a-z]{2}\.[a-z]|[a-z]\.[a-z]{2}")
_WORD_PARTS = re.compile(r"[\w@&'’.^~|\\•·¦]+")
_HYPHEN_END = re.compile(rf"(?:^|[\s(\"'“‘])([\w@&ſ'’-]*?[A-Za-zÀ-ÿſ@][{STRAYS!r}]?)[{BREAKS}]\s*$".replace(repr(STRAYS), re.escape(STRAYS)))
_FIRST_WORD = re.compile(r"^\W*([\w@&ſ'’^~|\\•-]+)")
_PAGE = r"(?:\d{1,4}|[ivxlc]{1,7})"
#: A page number in one of its dresses.
_NUMBER = rf"(?:[-–—]\s*{_PAGE}\s*[-–—]|\[\s*(?:p\.|pp\.|page|pg\.)?\s*{_PAGE}\s*\]|\(\s*(?:p\.|page|pg\.)?\s*{_PAGE}\s*\)|(?:pg|page|p)\b\.?\s*{_PAGE}|{_PAGE}\.?)"
_ONLY_NUMBER = re.compile(rf"^\s*{_NUMBER}\s*$", re.IGNORECASE)
_BARE_SENTENCE_END = re.compile(r"^\s*\d{1,4}[.?!]\s*$")
_LEADING = re.compile(rf"^\s*{_NUMBER}\s+(?=\S*[A-Za-z]{{2}})", re.IGNORECASE)
_TRAILING = re.compile(rf"(?<=[A-Za-z.\]\d])\s+{_NUMBER}\s*$", re.IGNORECASE)
_YEAR = re.compile(r"\[?\b1[5-9]\d\d\b\]?")
_HEADING = re.compile(r"^\W*(?:chapter|section|sect|article|art|book|part|resolution|title|canto|letter|no|number|of the)\b", re.IGNORECASE)
_ENDED = re.compile(r"[.!?:;][\"'”’)\]]*\s*$")
_SHAPES = str.maketrans({"0": "o", "1": "l", "5": "s", "6": "b", "8": "b", "f": "e", "ſ": "s", "@": "a", "i": "l", "j": "l", "t": "l", "u": "n", "v": "y", "c": "e", "h": "b", "o": "o"})
#: Words that titles and headers put around names.
_GLUE = frozenset("of the concerning convention at in and".split())


_GLUE_END = re.compile(r"\b(?:of|the|concerning|convention|at|in|and)\W*$")
_SAYS_PAGE = re.compile(r"(?i)\b(?:p|pp|pg|page)\b|^\[.*\]$|^\(.*\)$|^[-–—].*[-–—]$")
_PAGE_ANY = re.compile(r"\d{1,4}|(?<![a-z])[ivxlc]{1,7}(?![a-z])")
_ROMAN_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def bare(token: str) -> str:
    return _EDGE.sub("", token).lower()


def unshape(word: str) -> str:
    """A word with all letters of like shape made one."""
    w = word.lower().translate(_SHAPES)
    return w.replace("rn", "m").replace("ln", "m").replace("ll", "n").replace("el", "d").replace("yy", "w")


_GLUE_SHAPES = frozenset(unshape(w) for w in _GLUE)


@dataclass
class Edge:
    """A line that may be furniture."""

    keys: list[str]
    #: Whether it is a page number alone, which is compared over the corpus and not within its work.
    number: bool
    #: Hash of the lines around it.
    place: int
    #: Whether it stands at a page's edge on its face.
    sign: bool
    #: What makes it furniture if it is repeated nowhere: run, number, title or nothing.
    alone: str | None


class Lines:
    """The lines of a chunk, and which of them may be furniture."""

    def __init__(self, text: str, title: str | None):
        self.lines = text.split("\n")
        self.title_words = [unshape(w) for w in re.findall(r"[^\W\d_]+", title or "") if w.lower() not in _GLUE]

    def neighbour(self, i: int, step: int, skip: set[int]) -> str | None:
        i += step
        while 0 <= i < len(self.lines):
            if self.lines[i].strip() and i not in skip:
                return self.lines[i]
            i += step
        return None

    def of_title(self, words: list[str]) -> bool:
        """Whether all words are words of the title or what stands around it, one of the title's at least."""
        hit = False
        for w in words:
            if w in _GLUE_SHAPES:
                continue
            if any(w == t or (len(t) > 3 and distance(w, t, 2) <= (1 if len(t) < 9 else 2)) for t in self.title_words):
                hit = True
            elif not any(len(w) > 4 and distance(w, g, 1) <= 1 for g in _GLUE_SHAPES):
                return False
        return hit

    def edges(self) -> dict[int, Edge]:
        """The lines that may stand at a page's edge."""
        numbers, heads, unsure, values = set(), {}, [], {}
        for i, line in enumerate(self.lines):
            s = line.strip()
            if not s or len(s) > 90 or running(s):
                continue
            if _ONLY_NUMBER.match(s):
                (unsure.append(i) if _BARE_SENTENCE_END.match(s) else numbers.add(i))
                values[i] = page_value(s)
                continue
            core = header_core(s)
            words = [unshape(w) for w in re.findall(r"[^\W_]+", _YEAR.sub(" ", core)) if not w.isdigit()]
            if words and len(words) <= 9 and sum(c.isalpha() for c in core) > 3 and (core.isupper() or (_titled(core) and (len(words) > 1 or core != s) and not _GLUE_END.search(core))):
                title = self.of_title(words)
                if title or not _HEADING.match(core):
                    heads[i] = (core != s, words, title)
                    if core != s:
                        values[i] = page_value(s.replace(core, " ", 1))
        for i in unsure:  # a number and a full stop: the end of a sentence, or a page
            above = self.lines[i - 1] if i else ""
            below = self.neighbour(i, 1, numbers | heads.keys())
            inside = below is not None and below.lstrip()[:1].islower()
            if not above.strip() or (i - 1) in numbers or (i - 1) in heads or _ENDED.search(above) or inside:
                numbers.add(i)
        if not numbers and not heads:
            return {}
        skip = numbers | heads.keys()
        run = in_runs([values.get(i) for i in sorted(skip)])
        out = {}
        for at, i in enumerate(sorted(skip)):
            above, below = self.neighbour(i, -1, skip), self.neighbour(i, 1, skip)
            breaks = above is not None and below is not None and not _ENDED.search(above) and below.lstrip()[:1].islower()
            place = xxhash.xxh3_64_intdigest(f"{above}\n{below}") - (1 << 63)
            if i in numbers:
                s = self.lines[i].strip()
                beside = any(not 0 <= k < len(self.lines) or not self.lines[k].strip() or k in heads for k in (i - 1, i + 1))
                alone = "run" if run[at] else "number" if breaks or _SAYS_PAGE.search(s) else None
                out[i] = Edge([_PAGE_ANY.sub("#", re.sub(r"\s+", "", s.lower()))], True, place, breaks or beside, alone)
            else:
                carries, words, title = heads[i]
                capitals = self.lines[i].strip().isupper()
                by_number = any(k in numbers for k in (i - 2, i - 1, i + 1, i + 2))
                sign = breaks or carries or (by_number and capitals)
                apart = all(not 0 <= k < len(self.lines) or not self.lines[k].strip() for k in (i - 1, i + 1))
                out[i] = Edge(header_keys(words), False, place, sign, "title" if title and (sign or apart or by_number or capitals) else None)
        return out


def page_value(s: str) -> int | None:
    """The number in a page number's dress, arabic or roman."""
    if m := re.search(r"\d{1,4}", s):
        return int(m.group())
    m = re.search(r"(?<![a-z])[ivxlc]{1,7}(?![a-z])", s.lower())
    if not m or not _ROMAN.match(m.group()):
        return None
    v = [_ROMAN_VALUES[c] for c in m.group()]
    return sum(-x if x < y else x for x, y in zip(v, [*v[1:], 0]))


def in_runs(values: list[int | None]) -> list[bool]:
    """Whether each number has another that is as far from it in value as pages lie between them, in either direction."""
    out = [False] * len(values)
    known = [(i, v) for i, v in enumerate(values) if v is not None]
    for (i, v), (j, w) in zip(known, known[1:]):
        if 0 < abs(w - v) <= SKIPPED * (j - i):
            out[i] = out[j] = True
    return out


def header_keys(words: list[str]) -> list[str]:
    """Under what a header meets its like: its words, with one of them free to differ, or one half of an only word."""
    kept = [w for w in words if w not in _GLUE_SHAPES] or words
    keys = {" ".join(kept)}
    if len(kept) == 1:
        w = kept[0]
        keys |= {f"{w} *"} | ({f"{w[: len(w) // 2]}~", f"~{w[len(w) // 2 :]}"} if len(w) > 5 else set())
    else:
        keys |= {" ".join("*" if k == i else w for k, w in enumerate(kept)) for i in range(len(kept))}
    return sorted(keys)


def running(s: str) -> bool:
    """Whether a line is running text on its face: two words in small letters that are none of those around names."""
    small = 0
    for w in s.split():
        if w[0].islower() and w not in _GLUE:
            small += 1
            if small > 1:
                return True
    return False


def _titled(core: str) -> bool:
    return not any(w[0].islower() and w not in _GLUE for w in re.findall(r"[^\W_]+", core))


def header_core(s: str) -> str:
    """A line without the page number at one of its ends."""
    cut = _LEADING.sub("", s)
    if cut == s:
        cut = _TRAILING.sub("", s)
    return cut.strip()


def broken_words(lines: list[str], edges: set[int]) -> Iterator[tuple[int, str, list[tuple[int, str]]]]:
    """(line, first part, where the word may go on) of the words that a mark breaks at a line's end: behind each line that may be furniture, and on the first that is none."""
    for i, line in enumerate(lines):
        if line.rstrip()[-1:] not in BREAKS or not line.strip():
            continue
        m = _HYPHEN_END.search(line)
        if not m or line.rstrip()[-2:-1] in "-" + BREAKS:
            continue
        rests = []
        for j in range(i + 1, len(lines)):
            if not lines[j].strip():
                continue
            if n := _FIRST_WORD.match(lines[j]):
                rests.append((j, n.group(1)))
            if j not in edges:
                break
        if rests:
            yield i, m.group(1), rests


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with the number of texts that hold them, and of those that are no copy of another."""
    seen: Counter = Counter()
    copies: Counter = Counter()
    bared: dict[str, str] = {}
    for batch in batches:
        for text, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = set(text.split())
            if len(bared) > 500_000:
                bared.clear()
            for t in tokens.difference(bared):
                bared[t] = "" if t[-1] in BREAKS else bare(t)
            words = set(map(bared.__getitem__, tokens))
            seen.update(words)
            if not first:
                copies.update(words)
        if len(seen) > 300_000:
            yield _counted(seen, copies)
    if seen:
        yield _counted(seen, copies)


def _counted(seen: Counter, copies: Counter) -> pa.RecordBatch:
    seen.pop("", None)
    columns = [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([n - copies[w] for w, n in seen.items()], pa.int64())]
    seen.clear()
    copies.clear()
    return pa.RecordBatch.from_arrays(columns, ["word", "n", "d"])


def turned_back(word: str) -> set[str]:
    """What a word may have been before one kind of confusion, at one place or at all."""
    found = set()
    for true, read in CONFUSIONS:
        true, read = true.lower(), read.lower()
        at = word.find(read)
        if at >= 0:
            found.add(word.replace(read, true))
        while at >= 0:
            found.add(word[:at] + true + word[at + len(read) :])
            at = word.find(read, at + 1)
    found.discard(word)
    return found


def _turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (word, n, d, was)
            for word, n, d in zip(*(batch.column(c).to_pylist() for c in range(3)))
            if len(word) > 1 and _PLAIN.match(word) and not _ROMAN.match(word)
            for was in turned_back(word)
            if not copyist(word, was)
        ]
        cols = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n", "d", "was"])


def face_parts(token: str) -> list[str]:
    """The words of a token that are damaged on their face."""
    parts = (p.strip(".'’") for p in _WORD_PARTS.findall(token))
    return [p for p in parts if _ODD.search(p) and re.search(r"[A-Za-z]", p)]


def faced(word: str) -> set[str]:
    """What a word may be with digits, marks and old letters turned into letters."""
    options = [FACES.get(c, (c,)) for c in word.lower()]
    if sum(len(o) > 1 for o in options) > _CHOICES:
        options = [o[:1] for o in options]
    return {"".join(c) for c in product(*options)} - {""}


def _faced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(word, c, word.translate(_UNDRESS).lower()) for word in batch.column(0).to_pylist() for c in faced(word)]
        cols = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["word", "c", "undressed"])


def copyist(word: str, was: str) -> bool:
    """Whether one letter left out, doubled or swapped makes the word."""
    if len(word) == len(was) - 1:
        return any(was[:i] + was[i + 1 :] == word for i in range(len(was)))
    if len(word) == len(was) + 1:
        return any(word[:i] + word[i + 1 :] == was and (i and word[i] == word[i - 1]) for i in range(1, len(word)))
    if len(word) == len(was):
        d = [i for i in range(len(word)) if word[i] != was[i]]
        return len(d) == 2 and d[1] == d[0] + 1 and word[d[0]] == was[d[1]] and word[d[1]] == was[d[0]]
    return False


def vocabulary(texts: DataFrame) -> DataFrame:
    """word, n, d: the words of all texts (text, first), the number of texts that hold them, and of different texts."""
    return texts.mapInArrow(_counts, "word string, n bigint, d bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def misread_words(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """word, was: those of ``words`` (word, n, d) that are confusions of much more frequent words of the corpus, over all texts or over different ones."""
    turned = words.select("word", "n", "d").mapInArrow(_turned, "word string, n bigint, d bigint, was string")
    known = vocab.select(F.col("word").alias("was"), F.col("n").alias("was_n"), F.col("d").alias("was_d"))
    often = (F.col("was_n") >= F.col("n") * TIMES) | (F.col("was_d") >= F.col("d") * TIMES)
    w = Window.partitionBy("word").orderBy(F.desc("was_n"), "was")
    return turned.join(known, "was").where(often).withColumn("r", F.row_number().over(w)).where("r = 1").select("word", "was")


class Scans:
    """The scan damage of a table of chunks."""

    def __init__(self, df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", doc_col: str = "document_id", title_col: str = "title", *, unique: bool = False):
        """``unique``: ids are known to occur once, so texts need not be shuffled to see to it."""
        self.unique = unique
        self.src = df.select(
            F.col(id_col).cast("string").alias("id"), F.col(doc_col).cast("string").alias("doc"), F.col(title_col).cast("string").alias("title"), F.col(text_col).alias("text")
        ).where("id is not null and text is not null")
        self.vocab = cut(vocabulary(self._firsts()))
        self.misreads = cut(misread_words(self.vocab, self.vocab))
        # frequent words that were read right: what is not among them is looked up by a join
        ranked = self.vocab.join(self.misreads.select("word"), "word", "left_anti").orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS)
        self.frequent = frozenset(r.word for r in ranked.select("word").collect())

    def _firsts(self) -> DataFrame:
        """text, first of each chunk: one of the chunks with the same text is the first, so copies do not outweigh what else was read."""
        src = self.src.select("id", "text")
        rows = (src if self.unique else src.dropDuplicates(["id"])).withColumn("h", F.struct(F.xxhash64("text"), F.length("text")))
        repeated = keep(rows.groupBy("h").agg(F.min("id").alias("kept"), F.count("*").alias("copies")).where("copies > 1").select("h", "kept"))
        return rows.join(small_side(repeated, BROADCAST_ROWS), "h", "left").select("text", F.expr("kept is null or id = kept").alias("first"))

    def marks(self) -> DataFrame:
        """Lines with possible damage, before the corpus is asked.

        kind ``edge``: a line that may be furniture, with what it is compared by; ``hyphen``: a
        broken word, once for each line it may go on in; ``misread``: damage on a word's face;
        ``ask``: a word that is not among the frequent ones. ``unsure``: the row holds only
        if a line turns out to be furniture or not.
        """
        frequent = self.frequent
        return self.src.select("id", "doc", "title", "text").mapInArrow(lambda b: _marked(b, frequent), _MARKS)

    def furniture(self, marks: DataFrame) -> DataFrame:
        """id, line_no, why of each line that is furniture: a number of a run, repeated (within the work, or as a number's dress over the corpus), number or title."""
        edges = marks.where("kind = 'edge'").select("id", "line_no", "scope", "keys", "place", "sign", "alone")
        keyed = edges.select("id", "line_no", "scope", "place", "sign", F.explode("keys").alias("key"))
        again = keyed.groupBy("scope", "key").agg(F.countDistinct("place").alias("n"), F.max("sign").alias("at_edge")).where((F.col("n") >= PLACES) & F.col("at_edge"))
        repeated = keyed.join(again, keyed["scope"].eqNullSafe(again["scope"]) & (keyed["key"] == again["key"])).select("id", "line_no").distinct().withColumn("repeated", F.lit(True))
        why = F.when(F.col("alone") == "run", "run").when(F.col("repeated"), "repeated").otherwise(F.col("alone"))
        return edges.select("id", "line_no", "alone").join(repeated, ["id", "line_no"], "left").select("id", "line_no", why.alias("why")).where("why is not null").distinct()

    @staticmethod
    def _settled(rows: DataFrame, furniture: DataFrame) -> DataFrame:
        """Rows of marks that stand in no furniture."""
        at = furniture.select("id", "line_no")
        return rows.where("not unsure").unionByName(rows.where("unsure").join(at, ["id", "line_no"], "left_anti"))

    def hyphens(self, marks: DataFrame, furniture: DataFrame) -> DataFrame:
        """id, line_no, first, rest, word, rest_no of each broken word, that goes on in the next line that is no furniture."""
        rows = marks.where("kind = 'hyphen'").select("id", "line_no", "first", "rest", "word", "rest_no", "unsure")
        may = rows.where("unsure")
        for line in ("line_no", "rest_no"):
            may = may.join(furniture.select("id", F.col("line_no").alias(line)), ["id", line], "left_anti")
        told = may.groupBy("id", "line_no").agg(F.min_by(F.struct("first", "rest", "word", "rest_no"), "rest_no").alias("x")).select("id", "line_no", "x.*")
        return rows.where("not unsure").drop("unsure").unionByName(told)

    def damage(self) -> DataFrame:
        """id, line_no, defect of each damaged line."""
        marks = cut(self.marks())  # once, and out of the plans of the several stages that ask for it
        furniture = cut(self.furniture(marks))
        hyphens = self.hyphens(marks, furniture)
        plain = self._settled(marks.where("kind = 'misread'"), furniture).select("id", "line_no", F.lit("misread").alias("defect"))
        asked = self._settled(marks.where("kind = 'ask'"), furniture).join(self.misreads, "word").select("id", "line_no", F.lit("misread").alias("defect"))
        breaks = hyphens.join(self.breaks(hyphens).where("not own"), ["first", "rest"]).select("id", "line_no", F.lit("hyphen").alias("defect"))
        across = self.misread_across(hyphens)
        at = lambda line, side: across.where(side).select("id", F.col(line).alias("line_no"), F.lit("misread").alias("defect"))
        found = furniture.select("id", "line_no", F.lit("furniture").alias("defect")).unionByName(plain).unionByName(asked).unionByName(breaks)
        return found.unionByName(at("line_no", "in_first")).unionByName(at("rest_no", "in_rest")).distinct()

    def misread_across(self, hyphens: DataFrame) -> DataFrame:
        """id, line_no, rest_no, in_first, in_rest of the broken words with a confusion, and the part that has it."""
        hyphens = hyphens.select("id", "line_no", "rest_no", "first", "rest", F.concat("first", "rest").alias("word"))
        joined = hyphens.select("word").distinct().join(self.vocab, "word", "left").select("word", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("d", F.lit(1)).alias("d"))
        was = misread_words(joined, self.vocab)
        first_right, rest_right = F.expr("startswith(was, first)"), F.expr("endswith(was, rest)")
        return hyphens.join(was, "word").select("id", "line_no", "rest_no", (~first_right).alias("in_first"), (first_right | ~rest_right).alias("in_rest"))

    def breaks(self, hyphens: DataFrame) -> DataFrame:
        """first, rest, own of the words broken at a line's end: whether the hyphen is the word's own."""
        pairs = hyphens.select("first", "rest").distinct()
        v = self.vocab
        of = lambda name: v.select(F.col("word").alias(name), F.col("n").alias(f"{name}_n"))
        asked = (
            pairs.withColumn("joined", F.concat("first", "rest"))
            .withColumn("compound", F.concat_ws("-", "first", "rest"))
            .join(of("joined"), "joined", "left")
            .join(of("compound"), "compound", "left")
        )
        return asked.select("first", "rest", (F.coalesce("compound_n", F.lit(0)) > F.coalesce("joined_n", F.lit(0))).alias("own"))

    def true_words(self, words: DataFrame) -> DataFrame:
        """word, value of misread words (word): the most frequent word of the corpus that each may be."""
        may = cut(words.mapInArrow(_faced, "word string, c string, undressed string"))
        known = self.vocab.select(F.col("word").alias("c"), F.col("n").alias("c_n"), "d")
        asked = cut(may.select("c").distinct().join(known, "c", "left"))
        was = misread_words(asked.select(F.col("c").alias("word"), F.coalesce("c_n", F.lit(1)).alias("n"), F.coalesce("d", F.lit(1)).alias("d")), self.vocab).withColumnRenamed("word", "c")
        value = asked.join(was, "c", "left").select("c", F.coalesce("was", F.when(F.col("c_n").isNotNull(), F.col("c"))).alias("value")).where("value is not null")
        counted = value.join(self.vocab.select(F.col("word").alias("value"), F.col("n").alias("value_n")), "value")
        w = Window.partitionBy("word").orderBy(F.desc_nulls_last("value_n"), "value")
        best = may.join(counted, "c", "left").withColumn("r", F.row_number().over(w)).where("r = 1")
        return best.select("word", F.coalesce("value", "undressed").alias("value")).where("value <> lower(word)")

    def repaired(self) -> DataFrame:
        """id, text: continuous paragraphs with whole words, furniture taken out and misread words put right."""
        marks = cut(self.marks())  # once, and out of the plans of the several stages that ask for it
        fix = lambda kind, word, value: F.struct("line_no", kind.alias("kind"), word.alias("word"), value.alias("value")).alias("fix")
        none = F.lit("")
        furniture = cut(self.furniture(marks))
        hyphens = cut(self.hyphens(marks, furniture))
        breaks = self.breaks(hyphens)
        faces = self._settled(marks.where("kind = 'misread' and word is not null"), furniture).select("id", "line_no", "word")
        across = hyphens.join(breaks.where("not own"), ["first", "rest"]).select("id", "line_no", "rest_no", F.substring_index("word", "\n", 1).alias("head"), F.substring_index("word", "\n", -1).alias("tail"))
        across = across.withColumn("word", F.concat("head", "tail"))
        true = cut(self.true_words(faces.select("word").union(across.select("word")).distinct()))
        across = cut(across.join(true, "word").withColumn("cut", F.length("value") - F.least(F.length("tail"), F.length("value") - 1)).where("length(value) > 1"))
        fixes = (
            self._settled(marks.where("kind = 'ask'"), furniture).join(self.misreads, "word").select("id", fix(F.lit("misread"), F.col("word"), F.col("was")))
            .unionByName(furniture.select("id", fix(F.lit("furniture"), none, none)))
            .unionByName(hyphens.join(breaks, ["first", "rest"]).select("id", fix(F.when(F.col("own"), "own").otherwise("hyphen"), none, none)))
            .unionByName(faces.join(true, "word").select("id", fix(F.lit("face"), F.col("word"), F.col("value"))))
            .unionByName(across.select("id", fix(F.lit("head"), F.col("head"), F.expr("left(value, cut)"))))
            .unionByName(across.select("id", F.col("rest_no").alias("line_no"), "tail", F.expr("substring(value, cut + 1)").alias("end")).select("id", fix(F.lit("tail"), F.col("tail"), F.col("end"))))
        )
        per = fixes.distinct().groupBy("id").agg(F.collect_list("fix").alias("fixes"))
        texts = self.src.select("id", "text")
        joined = (texts if self.unique else texts.dropDuplicates(["id"])).join(per, "id", "left")
        return joined.mapInArrow(_repaired, "id string, text string")


_MARKS = "id string, line_no int, kind string, first string, rest string, word string, rest_no int, unsure boolean, scope string, keys array<string>, place bigint, sign boolean, alone string"
_MARK_TYPES = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.bool_(), pa.string())
_NONE = (None,) * 5
#: The scope of page numbers, which are compared over the corpus.
_CORPUS = "\u0000"


def _marked(batches: Iterator[pa.RecordBatch], frequent: frozenset[str]) -> Iterator[pa.RecordBatch]:
    known: dict[str, str | None] = {}  # token -> None if all right, '' if damaged on its face, else the word to ask for
    names = [c.split()[0] for c in _MARKS.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for i, doc, title, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if len(known) > 500_000:
                known.clear()
            tokens = set(text.split())
            for t in tokens.difference(known):
                known[t] = _look(t, frequent)
            bad = {t for t in tokens if known[t] is not None}
            if not bad and "\n" not in text:
                continue
            lines = Lines(text, title)
            edges = lines.edges() if "\n" in text else {}
            for n, e in edges.items():
                rows.append((i, n + 1, "edge", None, None, None, None, True, _CORPUS if e.number else doc, e.keys, e.place, e.sign, e.alone))
            ends: set[tuple[int, str]] = set()
            for n, first, rests in broken_words(lines.lines, edges.keys()):
                for m, rest in rests:
                    rows.append((i, n + 1, "hyphen", _plain(first), _plain(rest), f"{first}\n{_EDGE.sub('', rest)}", m + 1, n in edges or m in edges or len(rests) > 1, *_NONE))
                    ends |= {(n, lines.lines[n].split()[-1]), (m, lines.lines[m].split()[0])}
            if bad:
                for n, line in enumerate(lines.lines):
                    unsure = n in edges
                    for t in bad.intersection(line.split()):
                        word = known[t]
                        if word == "":
                            parts = [] if (n, t) in ends else face_parts(t)
                            rows += [(i, n + 1, "misread", None, None, part, None, unsure, *_NONE) for part in parts or [None]]
                        elif (n, t) not in ends:
                            rows.append((i, n + 1, "ask", None, None, word, None, unsure, *_NONE))
        cols = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _MARK_TYPES)], names)


def _plain(part: str) -> str:
    return re.sub(r"[^\w'’-]", "", part.lower()).strip("-'’")


def _look(token: str, frequent: frozenset[str]) -> str | None:
    word = bare(token)
    if not word or word == "&" or _ORDINAL.match(word):
        return None
    inner = _EDGE.sub("", token)
    # damage on a word's face first: a damaged word may be frequent enough to be known
    if _ODD.search(token.strip("\"'.,;:!?()[]“”‘’")) and re.search(r"[A-Za-z]", inner) and inner.lower() not in ("&c", "&c."):
        return ""
    return None if word in frequent else word


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, fixes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            out.append(repair(text, [(f["line_no"], f["kind"], f["word"], f["value"]) for f in fixes or ()]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])


#: Broken words are put right before words that stand whole.
_FIX_ORDER = {"head": 0, "tail": 0, "face": 1}


def _cased(read: str, value: str, before: str) -> str:
    """``value`` in the letter case of what was read; a first letter that was not read as one is a capital after a sentence's end."""
    letters = [c for c in read if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return value.upper()
    first = read.lstrip("^~|\\•·¦")[:1]
    capital = first.isupper() or (not first.isalpha() and (not before or re.search(r"[.!?][\"'”’)\]]*$", before) is not None))
    return value[:1].upper() + value[1:] if capital else value


def repair(text: str, fixes: list[tuple[int, str, str, str]]) -> str:
    """The text with its fixes made and the lines of each paragraph joined."""
    lines = text.split("\n")
    gone = {n - 1 for n, kind, *_ in fixes if kind == "furniture"}
    joined, own = ({n - 1 for n, kind, *_ in fixes if kind == k} for k in ("hyphen", "own"))
    for n, kind, word, value in sorted(fixes, key=lambda f: (_FIX_ORDER.get(f[1], 2), -len(f[2]))):  # the longer word first, so none is taken for a part of another
        if kind == "misread" and word:
            lines[n - 1] = re.sub(rf"(?i)(?<![\w]){re.escape(word)}(?![\w])", lambda m: value.upper() if m.group().isupper() else value.capitalize() if m.group()[:1].isupper() else value, lines[n - 1])
        elif kind == "face":
            before = next((x for x in reversed(lines[: n - 1]) if x.strip()), "") if n > 1 else ""
            lines[n - 1] = re.sub(rf"(?<![\w@&^~|\\•·¦]){re.escape(word)}(?![\w@&^~|\\•·¦])", lambda m: _cased(m.group(), value, m.string[: m.start()].strip() or before), lines[n - 1])
        elif kind == "head":
            lines[n - 1] = re.sub(rf"{re.escape(word)}(?=[{BREAKS}]\s*$)", lambda m: _cased(m.group(), value, m.string[: m.start()].strip()), lines[n - 1])
        elif kind == "tail":
            lines[n - 1] = re.sub(rf"^(\W*){re.escape(word)}", lambda m: m[1] + (value.upper() if word.isupper() and len(word) > 1 else value), lines[n - 1])
    paragraphs: list[str] = []
    open_paragraph, glue = False, False
    for n, line in enumerate(lines):
        if n in gone:
            continue
        s = line.strip()
        if not s:
            # a page's edge inside a sentence leaves blank lines that end no paragraph
            near = any(k in gone for k in range(max(0, n - 3), min(len(lines), n + 4)))
            if open_paragraph and not glue and not (near and paragraphs and not _ENDED.search(paragraphs[-1])):
                open_paragraph = False
            continue
        if n in joined or n in own:
            s = s.rstrip(BREAKS + " ") + "-" * (n in own)
        if open_paragraph:
            paragraphs[-1] += s if glue else " " + s
        else:
            paragraphs.append(s)
        open_paragraph, glue = True, n in joined or n in own
    return "\n\n".join(paragraphs)
