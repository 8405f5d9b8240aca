r"""Texts cut off by field limits or in transfer.

Two kinds of evidence, both by prefixes:

* Texts that are strict prefixes of longer texts elsewhere. Texts are grouped by a
  hash of a fixed-length prefix; groups that hold different lengths are sorted by
  text over all tasks, where a prefix stands directly before the texts it begins.
  Only neighbours are compared, so a prefix shared by a third of all texts is no
  quadratic join. (Texts shorter than the fixed length take no part in it.)
* Texts whose end says so: a mark of a cut, or an end that is no end of a sentence
  and none of the ways in which a kind of text closes (signature, list, closing
  line). Whether the last word of such a close is whole is decided by a self-join of
  the corpus's closing words on their prefixes: a word that is far rarer than the
  longer words it begins is the front of one of them.

A text that is a prefix of another is a case unless it ends as a sentence ends.

Defined results: null ids and null, empty or blank texts are no cases; copies of a
cut text are cases each; trailing white space does not matter; empty tables give no
rows; every source with a text is in the report, a null source as null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.runtime import keep, small_side

#: Characters of the prefix that brings texts together.
PREFIX = 32
#: A closing word this many times rarer than the words it begins is the front of one of them.
RARER = 8
#: Share of the texts with one kind of ending that makes a wording a closing formula, and how many texts it takes.
FORMULA_SHARE, FORMULA_TEXTS = 0.02, 3
BROADCAST_ROWS = 200_000

_TAIL, _MARK_ROOM = 400, 40
#: White space at the end of a text. Fixed values.
_WHITE = " \t\r\n\u000b\u000c\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_QUOTES = r"[\"'”’»)\]]*"
_ELLIPSIS = r"(?:\.{3,}|…)"
#: What is put after a cut, when a part of a sentence stands before it.
_CUT_MARK = rf"(?i)(?:\s*\[\s*(?:{_ELLIPSIS}|cut|truncated|more|continued)\s*\]|\s*\(\s*(?:more|cont(?:inue)?d?\.?|truncated|{_ELLIPSIS})\s*\)|\s*<\s*(?:truncated|more)\s*>)$"
_ENDS = rf"[.!?。]{_QUOTES}$"
_FUNCTION_WORDS = "a an and as at be but by for from had has have he if in is it its my no nor not of on or our shall so that the their them then they this to under unless until upon was we were what when where whereas which while who whom will with would you der die das und ein eine zu von mit nicht ohne wenn le la les de des du un une et ne que qui pour par el los las del y en se si no su"


def _last_line(text: Column) -> Column:
    return F.substring_index(text, "\n", -1)


def _line_before(text: Column) -> Column:
    head = F.substring(text, F.lit(1), F.length(text) - F.length(_last_line(text)))
    return _last_line(F.rtrim(head, F.lit(" \t\r\n")))


def endings(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, a hash of the text, the end of the text, its last line, the line before, the last word, and the kind of end.

    Kinds: ``sentence`` (ends as a sentence ends), ``ellipsis``, ``mark`` (a mark of a
    cut), ``line`` (a line that may be the close of its kind), ``open`` (anything else).
    """
    src = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike(r"[^\s\p{Z}]"))
    whole = F.rtrim(F.col("text"), F.lit(_WHITE))
    tail = src.select("id", "source", F.xxhash64(whole).alias("digest"), F.substring(whole, -_TAIL, _TAIL).alias("tail"))
    out = tail.select("id", "source", "digest", "tail", _last_line(F.col("tail")).alias("last_line"), _line_before(F.col("tail")).alias("line_before"))
    ll, before = F.col("last_line"), F.col("line_before")
    whole_bracket = ll.rlike(r"^\s*[\[(].*[A-Za-z]{2}.*[\])]$") & ~ll.rlike(_CUT_MARK)
    names = ll.rlike(r"^(?:[A-Z][\w'.’-]*,?\s+){1,4}[A-Z][\w'’-]*\.?$")
    after_close = before.rlike(r"[,;]\s*$") | before.rlike(r"(?i)\b(?:servants?|respect|esteem|yours|friends?|sincerely|truly|faithfully)\b[^.!?]*$")
    close = (
        F.when(ll.rlike(r"^\s*(?:[*•·_=~-]\s*){3,}$"), "rule")
        .when(ll.rlike(r"^\s*(?:[-*•–]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+\S+(?:\s+\S+){0,4}$"), "list")
        .when(whole_bracket, "bracket")
        .when(ll.rlike(r"^[^a-z]*[A-Z]{4,}[^a-z]*$") & (F.length(ll) < 40) & before.rlike(_ENDS), "capitals")
        .when(names & after_close, "signature")
        .when(ll.rlike(r"^(?:Signed|Done|Given|Dated|Witness|Attest|Teste)\b.{3,60}$"), "attested")
        .when(ll.rlike(r"^(?:[A-Z][a-z]+ \d+(?:, |$)){2,}$"), "count")
    )
    kind = (
        F.when(ll.rlike(_CUT_MARK), "mark")
        .when(ll.rlike(_ELLIPSIS + _QUOTES + "$"), "ellipsis")
        .when(ll.rlike(_ENDS) & ~ll.rlike(r"(?:^|\s)(?:Mr|Mrs|Ms|Dr|Hon|Gen|No|Nos|St|Messrs)\.$"), "sentence")
        .when(close.isNotNull(), "line")
        .otherwise("open")
    )
    word = F.regexp_extract(ll, r"([\p{L}\p{M}'’-]+)[^\p{L}]*$", 1)
    return out.withColumn("kind", kind).withColumn("close", close).withColumn("last_word", word)


def _broken_words(closing: DataFrame) -> DataFrame:
    """last_word for the closing words that are fronts of longer ones: a self-join on prefixes; copies of a text count once."""
    words = keep(closing.where("last_word <> ''").groupBy(F.col("last_word").alias("word")).agg(F.countDistinct("digest").alias("n")))
    fronts = (
        words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))).alias("word"))
        .where("word <> ''")
        .groupBy("word")
        .agg(F.sum("n").alias("longer"))
    )
    return words.join(fronts, "word").where(F.col("longer") >= F.lit(RARER) * F.col("n")).select(F.col("word").alias("last_word"))


def _sentence_of_ellipsis(ll: Column) -> Column:
    """The last sentence before an ellipsis."""
    body = F.regexp_replace(ll, _ELLIPSIS + _QUOTES + "$", "")
    return F.trim(F.regexp_extract(body, r"(?:^|[.!?]\s+)([^.!?]*)$", 1))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted texts, the hashes of those that begin the next different one; the ends of the partition for the next stage."""
    names, types = ["kind", "part", "digest", "text"], [pa.string(), pa.int32(), pa.int64(), pa.string()]
    last, part = None, 0
    for batch in batches:
        rows = []
        for part, digest, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if last is None:
                rows.append(("first", part, digest, text))
            elif text != last[1] and text.startswith(last[1]):
                rows.append(("prefix", part, last[0], None))
            last = (digest, text)
        cols = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
    if last:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(("last", part, *last), types)], names)


def prefixes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id of the texts that are strict prefixes of longer texts of the table."""
    # without white space and the mark of a cut behind it
    trimmed = F.rtrim(F.col(text_col), F.lit(_WHITE))
    mark = F.regexp_extract(F.substring(trimmed, -_MARK_ROOM, _MARK_ROOM), rf"(?:{_CUT_MARK}|\s*{_ELLIPSIS}{_QUOTES}$)", 0)
    body = F.rtrim(F.substring(trimmed, F.lit(1), F.length(trimmed) - F.length(mark)), F.lit(_WHITE))
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("raw")).where(F.col("id").isNotNull() & F.col("raw").isNotNull() & (F.length("raw") >= PREFIX))
    keyed = src.select("id", F.xxhash64(F.substring("raw", 1, PREFIX)).alias("key"), F.length("raw").alias("len"))
    shared = keyed.groupBy("key").agg(F.min("len").alias("shortest"), F.max("len").alias("longest")).where("shortest < longest").select("key")
    shared = small_side(keep(shared), BROADCAST_ROWS)
    rows = keep(
        df.select(F.col(id_col).alias("id"), F.col(text_col), F.xxhash64(F.substring(F.col(text_col), 1, PREFIX)).alias("key"))
        .where(F.col("id").isNotNull() & F.col(text_col).isNotNull())
        .join(shared, "key", "left_semi")
        .select("id", body.alias("text"))
        .select("id", "text", F.xxhash64("text").alias("digest"))
    )
    distinct = rows.select("digest", "text").distinct()
    ordered = distinct.repartitionByRange("text").sortWithinPartitions("text").select(F.spark_partition_id().alias("part"), "digest", "text")
    seen = keep(ordered.mapInArrow(_neighbours, "kind string, part int, digest bigint, text string"))
    # texts on the two sides of a border between partitions: as many rows as there are partitions
    tops = seen.where("kind = 'first'").select("part", F.col("text").alias("top"))
    ends = seen.where("kind = 'last'").select(F.col("part").alias("before"), "digest", F.col("text").alias("end"))
    # numbers of partitions alone are put in order, texts meet by them
    order = seen.where("kind = 'last'").select("part", F.lag("part").over(Window.orderBy("part")).alias("before"))
    across = tops.join(order, "part").join(ends, "before").where("startswith(top, end) and top <> end").select("digest")
    found = seen.where("kind = 'prefix'").select("digest").union(across).distinct()
    return rows.join(small_side(found, BROADCAST_ROWS), "digest", "left_semi").select("id").distinct()


def cut_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, reason of each text that was cut: ``prefix`` of a longer text, ``mark``, ``ellipsis``, ``open`` end or broken ``close``."""
    ends = keep(endings(df, id_col, text_col, source_col))
    begun = prefixes(df, id_col, text_col).withColumn("prefix", F.lit(True))

    # an ellipsis is a close where the same short sentence ends many different texts with it
    trailing = ends.where("kind = 'ellipsis'").withColumn("sentence", _sentence_of_ellipsis(F.col("last_line")))
    n_trailing = trailing.select("digest").distinct().count()
    formulas = (
        trailing.where("sentence <> ''")
        .groupBy("sentence")
        .agg(F.countDistinct("digest").alias("n"))
        .where((F.col("n") >= FORMULA_TEXTS) & (F.col("n") >= F.lit(FORMULA_SHARE * n_trailing)))
        .where(~F.lower(F.regexp_extract("sentence", r"(\S+)$", 1)).isin(*_FUNCTION_WORDS.split()))
        .select("sentence", F.lit(True).alias("formula"))
    )
    questions = F.col("last_line").rlike(_ELLIPSIS + r"\s*[?!]" + _QUOTES + "$")
    closing = ends.where("kind = 'line' and close in ('list', 'signature', 'attested')")
    broken = _broken_words(closing).withColumn("broken", F.lit(True))

    marked = (
        ends.withColumn("sentence", F.when(F.col("kind") == "ellipsis", _sentence_of_ellipsis(F.col("last_line"))))
        .join(small_side(keep(formulas), BROADCAST_ROWS), "sentence", "left")
        .join(small_side(keep(broken), BROADCAST_ROWS), "last_word", "left")
        .join(small_side(keep(begun), BROADCAST_ROWS), "id", "left")
    )
    in_words = F.lower("last_word").isin(*_FUNCTION_WORDS.split())
    reason = (
        F.when(F.col("prefix") & (F.col("kind") != "sentence"), "prefix")
        .when(F.col("kind") == "mark", "mark")
        .when((F.col("kind") == "ellipsis") & ~questions & F.col("formula").isNull(), "ellipsis")
        .when(F.col("kind") == "open", "open")
        .when((F.col("kind") == "line") & F.col("close").isin("list", "signature", "attested") & (F.col("broken") | in_words), "close")
    )
    return marked.withColumn("reason", reason).where("reason is not null").select("id", "source", "reason")


def cut_shares(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """source, texts, cut, share: how often each source cuts its texts."""
    per = df.where(F.col(id_col).isNotNull() & F.col(text_col).rlike(r"[^\s\p{Z}]")).groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("texts"))
    cut = cut_texts(df, id_col, text_col, source_col).groupBy(F.col("source").alias("s")).agg(F.count("*").alias("cut"))
    joined = per.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
    return joined.select("source", "texts", F.coalesce("cut", F.lit(0)).alias("cut"), (F.coalesce("cut", F.lit(0)) / F.col("texts")).alias("share"))
