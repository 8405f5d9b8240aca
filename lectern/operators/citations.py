"""Citations in texts: clauses, amendments, essays of series, persons; and the graph of what is cited together.

A citation is found by a pattern with Unicode word borders. Byte offsets are those in
the lower-cased text, as its readers expect.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.records import numeral
from lectern.runtime import cut

_B, _E, _S = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])", r"[ \t\n\f\r]*"
# Fixed values.
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth", "twenty-first", "twenty-second", "twenty-third", "twenty-fourth", "twenty-fifth", "twenty-sixth", "twenty-seventh"]
SERIES = ("federalist", "brutus", "cato", "centinel")
PERSONS = "madison hamilton jefferson adams washington franklin jay mason henry sherman wilson randolph morris dickinson pinckney ellsworth rutledge gerry lee monroe marshall story iredell".split()
ARTICLES, AMENDMENTS, ESSAYS, MOST_TARGETS = 7, 27, 85, 50

CLAUSE = rf"(?i){_B}article{_E}{_S}([0-9A-Za-z]+)(?:[ ,\t]*section{_S}([0-9A-Za-z]+))?"
AMENDMENT = rf"(?i){_B}amendment{_E}{_S}([0-9A-Za-z]+)"
ROMAN = ["", "I", "II", "III", "IV", "V", "VI", "VII"]


def extract(df: DataFrame, id_col: str, text_col: str, *, persons: Sequence[str] = PERSONS, series: Sequence[str] = SERIES) -> DataFrame:
    """id, kind, target, key, byte_offset, matched_text of every citation: one pass over each text, a row a match at its end.

    The offset counts in the lower-cased text: the pieces between the matches before it, and those matches.
    """
    by = lambda names: rf"(?i){_B}({'|'.join(names)})\s+amendment{_E}"
    name = F.array(*map(F.lit, ROMAN))
    number = lambda n, most: F.get(F.filter(F.array(n), lambda x: x.between(1, most)), 0)

    def clause(m: Column) -> Column:
        section = numeral(F.nullif(m["g2"], F.lit("")))
        return F.concat(F.get(name, number(numeral(m["g1"]), ARTICLES)), F.coalesce(F.concat(F.lit("."), section.cast("string")), F.lit("")))

    amended = lambda n: F.concat(F.lit("Amend."), n.cast("string"))
    ordinal = lambda m: amended(F.array_position(F.array(*map(F.lit, ORDINALS)), F.lower(m["g1"])))
    # kind, pattern, groups, target of a match (null if it is no citation); the last part of a hyphened ordinal is a word of its own, so it is cited too
    kinds = [
        ("clause", CLAUSE, 2, clause),
        ("clause", AMENDMENT, 1, lambda m: amended(number(numeral(m["g1"]), AMENDMENTS))),
        ("clause", by(o for o in ORDINALS if "-" in o), 1, ordinal),
        ("clause", by(o for o in ORDINALS if "-" not in o), 1, ordinal),
        ("essay", rf"(?i){_B}({'|'.join(series)}){_E}[ ,\t.]*(?:no\.|no|number|paper|letter)[\s.]*([0-9A-Za-z]+)", 2, lambda m: F.concat(F.lower(m["g1"]), F.lit(":"), number(numeral(m["g2"]), ESSAYS).cast("string"))),
        ("person", rf"(?i){_B}({'|'.join(persons)}){_E}", 1, lambda m: F.lower(m["g1"])),
    ]
    text = F.coalesce(F.col(text_col), F.lit(""))
    groups = lambda p, n: F.arrays_zip(*(F.regexp_extract_all(text, F.lit(p), F.lit(i)).alias(f"g{i}") for i in range(n + 1)))
    found = df.select(F.col(id_col).alias("id"), *(F.split(text, p, -1).alias(f"p{k}") for k, (_, p, _, _) in enumerate(kinds)), *(groups(p, n).alias(f"m{k}") for k, (_, p, n, _) in enumerate(kinds)))
    lengths = lambda parts: F.aggregate(parts, F.lit(0), lambda acc, x: acc + F.octet_length(F.lower(x)))

    def cited(k: int, kind: str, target: Callable[[Column], Column]) -> Column:
        def one(m: Column, i: Column) -> Column:
            before = lengths(F.slice(f"p{k}", F.lit(1), i + 1)) + lengths(F.transform(F.slice(f"m{k}", F.lit(1), i), lambda x: x["g0"]))
            return F.struct(F.lit(kind).alias("kind"), target(m).alias("target"), before.alias("byte_offset"), m["g0"].alias("matched_text"))

        return F.filter(F.transform(f"m{k}", one), lambda c: c["target"].isNotNull())

    every = found.select("id", F.explode(F.concat(*(cited(k, kind, target) for k, (kind, _, _, target) in enumerate(kinds)))).alias("c")).select("id", "c.*")
    return every.select("id", "kind", "target", F.concat_ws(":", "kind", "target").alias("key"), "byte_offset", "matched_text")


def top_targets(citations: DataFrame, n: int) -> DataFrame:
    return citations.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(n)


def cited_by(citations: DataFrame, key: str) -> DataFrame:
    return citations.where(F.col("key") == key)


def key_kind(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def co_citation(citations: DataFrame, n: int, cap: int | None = MOST_TARGETS) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, n) of the n most cited targets and edges (source, target, weight) of those cited in one text.

    With ``cap`` a text brings its first targets only, as the reader's graph does;
    without, all of the n targets, of which a text can hold no more.
    """
    citations = cut(citations.select("id", "key"))  # read twice
    nodes = top_targets(citations, n)
    wanted = F.broadcast(nodes.select("key"))  # n rows
    pairs = citations.join(wanted, "key").select("id", "key").distinct()
    if cap is not None and cap < n:
        pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("key"))).where(F.col("r") <= cap).drop("r")
    per = pairs.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("t"))  # at most n keys a text
    both = per.select(F.explode(F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda b: F.struct(a.alias("source"), b.alias("target")))))).alias("p")).select("p.*")
    return nodes, both.groupBy("source", "target").agg(F.count("*").alias("weight"))


def outgoing(citations: DataFrame, examples: int = 4) -> DataFrame:
    """id, key, n, the first matched texts."""
    ordered = F.array_sort(F.collect_list(F.struct("byte_offset", "matched_text")))
    return citations.groupBy("id", "key").agg(F.count("*").alias("n"), F.array_join(F.transform(F.slice(ordered, 1, examples), lambda x: x["matched_text"]), "|").alias("examples"))


def annotated_spans(citations: DataFrame) -> DataFrame:
    """id, start, end, key of spans that do not overlap, first come first kept."""
    spans = F.array_sort(F.collect_list(F.struct(F.col("byte_offset").alias("start"), (F.col("byte_offset") + F.octet_length("matched_text")).alias("end"), F.col("key").alias("key"))))
    first = F.struct(F.array().cast("array<struct<start:int,end:int,key:string>>").alias("out"), F.lit(0).alias("upto"))
    kept = F.aggregate(
        spans,
        first,
        lambda acc, s: F.when(s["start"] >= acc["upto"], F.struct(F.concat(acc["out"], F.array(s)).alias("out"), s["end"].alias("upto"))).otherwise(acc),
        lambda acc: acc["out"],
    )
    return citations.groupBy("id").agg(kept.alias("kept")).select("id", F.explode("kept").alias("s")).select("id", "s.*")
