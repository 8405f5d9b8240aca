"""Cutting documents into chunks: windows of words, packed paragraphs, and splits at headers.

Windows are closed forms over the array of words, so they stay in the JVM. Packing
paragraphs depends on what was packed before; it runs as a vectorised function over
the paragraphs of one document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import records as R
from lectern.functions import text as X

TARGET, LEAST, MOST, OVERLAP, SLACK = 320, 80, 650, 45, 120


def word_windows(words: Column, starts: Column, width: int) -> Column:
    """Structs (seq, start, text) for the starts, in words from 0."""
    return F.transform(starts, lambda s, i: F.struct(i.alias("seq"), s.alias("start"), F.array_join(F.slice(words, s + 1, F.lit(width)), " ").alias("text")))


def _empty() -> Column:
    return F.array().cast("array<int>")


def library_starts(n: Column, width: int = TARGET, least: int = LEAST, overlap: int = OVERLAP) -> Column:
    """A window every width - overlap words while at least ``least`` are left."""
    step = width - overlap
    return F.when(n >= least, F.sequence(F.lit(0), n - least, F.lit(step))).otherwise(_empty())


def archive_starts(n: Column, width: int = 300, step: int = 200) -> Column:
    """Windows up to the first that reaches the end; the rest of a text always is one."""
    last = F.greatest(F.lit(0), F.ceil((n - width) / F.lit(step)).cast("int")) * step
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(_empty())


def expander_starts(n: Column, width: int = 400, overlap: int = 50, least: int = 100) -> Column:
    return F.when(n >= least, F.sequence(F.lit(0), n - least, F.lit(width - overlap))).otherwise(_empty())


def windows(df: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
    """id, seq, start, n_words, text of the windows of each text; ``kind`` is library, archive or expander."""
    starts, width = {"library": (library_starts, TARGET), "archive": (archive_starts, 300), "expander": (expander_starts, 400)}[kind]
    w = df.select(F.col(id_col).alias("id"), X.words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    rows = w.select("id", F.explode(word_windows(F.col("w"), starts(F.size("w")), width)).alias("x")).select("id", "x.*")
    return rows.select("id", "seq", "start", F.size(F.split("text", " ")).alias("n_words"), "text")


def chunk_name(document_id: Column, seq: Column) -> Column:
    return F.concat(document_id, F.lit("_"), F.lpad(seq.cast("string"), 4, "0"))


# paragraphs ---------------------------------------------------------------------


def pack_paragraphs(text: str, target: int = TARGET, slack: int = SLACK, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Paragraphs packed up to target + slack words; longer ones in windows; short pieces go to the one before."""
    pieces: list[str] = []
    held: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            pieces.append("\n\n".join(held))
            held.clear()
            size = 0

    for paragraph in re.split(r"\n\s*\n", text):
        paragraph = paragraph.strip()
        words = paragraph.split()
        if not words:
            continue
        if len(words) > most:
            flush()
            pieces += [" ".join(words[s : s + target]) for s in range(0, len(words), target - overlap)]
        else:
            if held and size + len(words) > target + slack:
                flush()
            held.append(paragraph)
            size += len(words)
    flush()
    out: list[str] = []
    for piece in pieces:
        if out and len(piece.split()) < least:
            out[-1] += "\n\n" + piece
        else:
            out.append(piece)
    return out


def paragraph_chunks(text: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda x: pack_paragraphs(x) if x else [])

    return pack(text)


# splits at headers ----------------------------------------------------------------

ARTICLE = r"(?m)^(?=(?:ARTICLE|Article)\s+(?:[IVXLC]+|\d+)\b)"
ESSAY = r"(?m)^(?=(?:FEDERALIST|Federalist|BRUTUS|Brutus|CATO|Cato|CENTINEL|Centinel)\.?,?\s+(?:No\.?|NO\.?|Number|Letter)\s*[IVXLC\d]+)"
LETTER_TO = r"(?m)^(?=TO [A-Z][A-Z .'-]+\.?$)"
CORRESPONDENCE = r"(?m)^(?=(?:TO|FROM|To|From|Letter to)\s+[A-Z][A-Za-z .'-]+[.:]?$)"


def split_records(df: DataFrame, id_col: str, text_col: str, header: str | Column, *, least_words: int = 0, keep_front: bool = True) -> DataFrame:
    """id, seq, header, text, n_words: the parts that begin with a header (a pattern, or a column of patterns).

    Text before the first header is part 0, kept on request. Parts under ``least_words``
    are dropped; a text without any part left is one part of its own.
    """
    pattern = F.lit(header) if isinstance(header, str) else header
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("whole"), pattern.alias("pattern"))
    # a mark that no text holds stands before each header, for the split takes no column
    marked = F.regexp_replace("whole", F.col("pattern"), F.lit("\u0001"))
    parts = rows.select("id", "whole", F.posexplode(F.split(marked, "\u0001")).alias("seq", "part")).select("id", "whole", "seq", F.regexp_replace("part", r"^\s+|\s+$", "").alias("text"))
    counted = parts.withColumn("n_words", X.word_count(F.col("text"))).where("text <> ''")
    kept = counted.where((F.col("n_words") >= least_words) & (F.lit(keep_front) | (F.col("seq") > 0)))
    out = kept.select("id", "seq", F.when(F.col("seq") > 0, F.regexp_extract("text", r"^([^\n]*)", 1)).alias("header"), "text", "n_words")
    left = rows.join(out.select("id").distinct(), "id", "left_anti").where("trim(whole) <> ''").select("id", F.lit(0).alias("seq"), F.lit(None).cast("string").alias("header"), F.col("whole").alias("text"), X.word_count(F.col("whole")).alias("n_words"))
    return out.unionByName(left)


def constitution_records(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """record_id, seed clause, text: a preamble and the articles; a numeral met again gets a number of its own."""
    parts = split_records(df, id_col, text_col, ARTICLE)
    n = R.numeral(F.regexp_extract("header", r"(?i)^article\s+([IVXLC]+|\d+)", 1))
    numbered = parts.withColumn("numeral", F.regexp_extract(F.coalesce("header", F.lit("")), r"(?i)^article\s+([IVXLC]+|\d+)", 1)).withColumn("n", n)
    again = F.row_number().over(Window.partitionBy("id", "numeral").orderBy("seq"))
    name = F.when(F.col("seq") == 0, "preamble").otherwise(F.concat(F.lit("article_"), F.lower("numeral")))
    return numbered.withColumn("again", again).select(
        "id", "seq", F.concat("id", F.lit("_"), name, F.when(F.col("again") > 1, F.concat(F.lit("_"), F.lpad(F.col("again").cast("string"), 3, "0"))).otherwise("")).alias("record_id"),
        F.when(F.col("n").isNotNull() & (F.col("seq") > 0), F.upper("numeral")).alias("seed_clause"), "text", "n_words",
    )


def essay_records(df: DataFrame, id_col: str, text_col: str, authors: Sequence[str] = ("HAMILTON", "MADISON", "JAY")) -> DataFrame:
    """record_id, author, text: the author is named in one of the first eight lines."""
    parts = split_records(df, id_col, text_col, ESSAY, keep_front=False)
    head = F.array_join(F.slice(F.split("text", "\n"), 1, 8), "\n")
    return parts.select("id", "seq", F.concat("id", F.lit("_"), R.F.coalesce(X.identifier(F.col("header")), F.lit("whole"))).alias("record_id"), F.regexp_extract(head, rf"\b({'|'.join(authors)})\b", 1).alias("author"), "text", "n_words")


def letter_records(df: DataFrame, id_col: str, text_col: str, first_year: int = 1786, last_year: int = 1789) -> DataFrame:
    """Letters that begin with TO NAME and name a year of the range; a text without one is one record."""
    years = "|".join(map(str, range(first_year, last_year + 1)))
    parts = split_records(df, id_col, text_col, LETTER_TO, keep_front=False)
    return parts.where(F.col("header").isNull() | F.col("text").rlike(rf"\b(?:{years})\b"))


def correspondence_records(df: DataFrame, id_col: str, text_col: str, least_words: int = 60) -> DataFrame:
    """record_id of recipient and year."""
    parts = split_records(df, id_col, text_col, CORRESPONDENCE, least_words=least_words, keep_front=False)
    who = X.identifier(F.regexp_replace(F.coalesce("header", F.lit("letter")), r"(?i)^(?:to|from|letter to)\s+", ""))
    year = F.regexp_extract("text", r"\b(1[5-9]\d\d)\b", 1)
    return parts.select("id", "seq", F.concat_ws("_", "id", who, F.when(year != "", year)).alias("record_id"), "header", "text", "n_words")


#: Builders of records by the name of a manifest's strategy; an unknown one leaves the document whole.
STRATEGIES: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {
    "constitution_sections": constitution_records,
    "federalist_essays": essay_records,
    "convention_letters": letter_records,
    "correspondence_letters": correspondence_records,
    "numbered_essay_series": lambda df, i, t: split_records(df, i, t, r"(?m)^(?=(?:No\.?|NUMBER|Number|LETTER|Letter)\s+[IVXLC\d]+)", least_words=60, keep_front=False),
}


def build_records(df: DataFrame, id_col: str, text_col: str, strategy: str) -> DataFrame:
    """id, seq, text, n_words by the strategy's builder."""
    if strategy not in STRATEGIES:
        whole = df.select(F.col(id_col).alias("id"), F.lit(0).alias("seq"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        return whole.where("trim(text) <> ''").select("id", "seq", "text", X.word_count(F.col("text")).alias("n_words"))
    return STRATEGIES[strategy](df, id_col, text_col).select("id", "seq", "text", "n_words")


def assemble(df: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """chunk_id, document_id, seq, text, word_count, preview from packed paragraphs of at least ``least`` words."""
    packed = df.select(F.col(id_col).cast("string").alias("document_id"), F.posexplode(paragraph_chunks(F.col(text_col))).alias("seq", "text"))
    counted = packed.withColumn("word_count", X.word_count(F.col("text"))).where(F.col("word_count") >= least)
    seq = F.row_number().over(Window.partitionBy("document_id").orderBy("seq")) - 1
    return counted.withColumn("seq", seq).select(chunk_name(F.col("document_id"), F.col("seq")).alias("chunk_id"), "document_id", "seq", "text", "word_count", X.word_preview(F.col("text"), 40, " ...").alias("preview"))
