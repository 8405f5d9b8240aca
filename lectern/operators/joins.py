"""Joins by arrays, prefixes, substrings, patterns and ranges.

A register that is compared by a pattern (names, phrases) becomes part of one
expression over the text, in blocks of a bounded number of entries: the text is read
once, and no table is multiplied by another. Where both sides are large, they meet
over keys: ids in arrays are exploded, prefixes are cut at their separators.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of a register in one expression; a longer register is taken in blocks.
BLOCK = 500


def alias_pattern(names: Sequence[str]) -> str:
    """A word-bounded pattern of any of the names."""
    return r"(?i)\b(?:" + "|".join(re.escape(n) for n in names if n) + r")\b"


#: Entries of a register in one automaton; a longer register is taken in blocks, each of which reads the texts once.
NAMES = 50_000


def _automaton(register: Sequence[tuple[str, Sequence[str]]]):
    """All names of a block of a register in one automaton, or None if there is no name."""
    import ahocorasick

    found: dict[str, list[tuple[str, int]]] = {}
    for entry, names in register:
        for order, name in enumerate(n for n in names if n):
            found.setdefault(name.lower(), []).append((entry, order))
    automaton = ahocorasick.Automaton()
    for name, owners in found.items():
        automaton.add_word(name, (len(name), owners))
    automaton.make_automaton()
    return automaton if len(automaton) else None


_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def count_names(text: str, automaton) -> dict[str, int]:
    """How often each entry's names stand in a text as words, whatever their case; of names that overlap the earlier counts."""
    low = text.lower()
    n = len(low)
    places: dict[str, list[tuple[int, int, int]]] = {}
    for end, (length, owners) in automaton.iter(low):
        a, b = end - length + 1, end + 1
        if (a == 0 or (low[a - 1] in _WORD) != (low[a] in _WORD)) and (b == n or (low[b] in _WORD) != (low[end] in _WORD)):
            for entry, order in owners:
                places.setdefault(entry, []).append((a, order, b))
    out = {}
    for entry, spans in places.items():
        upto = count = 0
        for a, _, b in sorted(spans):
            if a >= upto:
                count, upto = count + 1, b
        out[entry] = count
    return out


def names_in_texts(df: DataFrame, id_col: str, text: Column, register: DataFrame, *keep: str, block: int = NAMES) -> DataFrame:
    """The same as ``mentions`` in one pass over each text for ``block`` entries of the register (entry, names array)."""
    src = df.select(F.col(id_col).alias("id"), *keep, text.alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in src.dtypes[:-1]) + ", entry string, n int"
    entries = register.where("entry is not null").select("entry", "names")
    blocks, out = -(-entries.count() // block), None
    for k in range(blocks):
        own = entries if blocks == 1 else entries.where(F.pmod(F.xxhash64("entry"), F.lit(blocks)) == k)
        part = src.mapInArrow(_finder([(r.entry, [n for n in r.names or () if n]) for r in own.collect()]), schema)  # about a block's entries
        out = part if out is None else out.unionByName(part)
    return src.mapInArrow(_finder([]), schema).limit(0) if out is None else out


def _finder(register: Sequence[tuple[str, Sequence[str]]]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(register)
        for batch in batches:
            at, entries, counts = [], [], []
            for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist() if automaton else ()):
                for entry, n in count_names(t or "", automaton).items():
                    at.append(i)
                    entries.append(entry)
                    counts.append(n)
            rows = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(entries, pa.string()), pa.array(counts, pa.int32())], [*batch.schema.names[:-1], "entry", "n"])

    return find


def mentions(df: DataFrame, id_col: str, text: Column, register: Sequence[tuple[str, Sequence[str]]], *keep: str) -> DataFrame:
    """id, entry, n: how often each entry's names stand in each text, where they do."""
    out = None
    for at in range(0, len(register), BLOCK):
        found = F.array(*(F.struct(F.lit(entry).alias("entry"), F.regexp_count(text, F.lit(alias_pattern(names))).alias("n")) for entry, names in register[at : at + BLOCK] if any(names)))
        part = df.select(F.col(id_col).alias("id"), *keep, F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("m")).select("id", *keep, "m.entry", "m.n")
        out = part if out is None else out.unionByName(part)
    return out


def phrase_hits(df: DataFrame, id_col: str, text: Column, register: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """id, entry, score: summed counts of each entry's phrases, white space of any kind between words."""
    pattern = lambda phrases: r"(?i)\b(?:" + "|".join(r"\s+".join(map(re.escape, p.split())) for p in phrases) + r")\b"
    out = None
    for at in range(0, len(register), BLOCK):
        found = F.array(*(F.struct(F.lit(entry).alias("entry"), F.regexp_count(text, F.lit(pattern(phrases))).alias("score")) for entry, phrases in register[at : at + BLOCK]))
        part = df.select(F.col(id_col).alias("id"), F.explode(F.filter(found, lambda x: x["score"] > 0)).alias("m")).select("id", "m.entry", "m.score")
        out = part if out is None else out.unionByName(part)
    return out


def author_holds_name(df: DataFrame, id_col: str, author: str, register: Sequence[tuple[str, str]], least: int = 5) -> DataFrame:
    """id, entry: names of more than four letters that stand inside an author, whatever the case."""
    low = F.lower(F.col(author))
    out = None
    for at in range(0, len(register), BLOCK):
        names = F.array(*(F.struct(F.lit(e).alias("entry"), F.lit(n.lower()).alias("name")) for e, n in register[at : at + BLOCK] if len(n) >= least))
        part = df.select(F.col(id_col).alias("id"), F.explode(F.filter(names, lambda x: F.contains(low, x["name"]))).alias("m")).select("id", "m.entry")
        out = part if out is None else out.unionByName(part)
    return out


def array_reference(left: DataFrame, left_id: str, array_col: str, right: DataFrame, right_id: str) -> DataFrame:
    """left id, place, right id for each id in an array that the right side has."""
    ids = left.select(F.col(left_id).alias("left_id"), F.posexplode(array_col).alias("place", "right_id"))
    return ids.join(right.select(F.col(right_id).alias("right_id")), "right_id").select("left_id", "place", "right_id")


def id_prefixes(df: DataFrame, id_col: str, separator: str = "_") -> DataFrame:
    """id, prefix: the id and what stands before each of its separators."""
    parts = F.split(F.col(id_col), re.escape(separator))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))
    return df.select(F.col(id_col).alias("id"), F.explode(prefixes).alias("prefix"))


def prefix_semi(left: DataFrame, key: str, right: DataFrame, id_col: str) -> DataFrame:
    """Left rows whose key is an id of the right side or its beginning before a separator."""
    ends = id_prefixes(right.select(id_col).distinct(), id_col).select(F.col("prefix").alias(key)).distinct()
    return left.join(ends, key, "left_semi")


def author_in_range(df: DataFrame, id_col: str, targets: DataFrame) -> DataFrame:
    """id, target for records with the target's author among theirs and a date in its range: an equi-join, then the range."""
    rows = df.select(F.col(id_col).alias("id"), "date", F.explode(F.array_distinct("authors")).alias("author")).where("author is not null")
    met = rows.join(targets.select("target", "author", "start", "end"), "author")
    return met.where("date >= start and date <= end").select("id", "target").distinct()


def siblings(df: DataFrame, chunk_id: str, n: int = 8) -> DataFrame:
    """Other chunks of a chunk's document, in archive order."""
    own = df.where(F.col("chunk_id") == chunk_id).select(F.col("document_id"), F.col("chunk_id").alias("own")).limit(1)
    return df.join(F.broadcast(own), "document_id").where("chunk_id <> own").orderBy("pos", "chunk_id").select("chunk_id", "pos").limit(n)


def missing(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Keys of the left side that the right side lacks."""
    return left.where(F.col(key).isNotNull()).select(key).join(right.select(F.col(right_key).alias(key)), key, "left_anti").distinct()


def same_author(records: DataFrame, id_col: str, authors: str, register: DataFrame, n: int) -> DataFrame:
    """entry, id, rank of at most n records an entry, authors compared without regard to case."""
    from pyspark.sql import Window

    rows = records.select(F.col(id_col).alias("id"), F.explode(authors).alias("a")).select("id", F.lower(F.trim("a")).alias("key")).distinct()
    met = rows.join(register.select("entry", F.lower(F.trim("name")).alias("key")), "key").select("entry", "id").distinct()
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("entry").orderBy("id"))).where(F.col("rank") <= n)
