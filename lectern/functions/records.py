"""Columns about records: ids, names from file stems, dates, states of work, references to cite."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How a file's stem gives its collection. (kind of test, pattern, collection), first hit wins.
COLLECTION_RULES = [
    ("prefix", "world_constitution_", "comparative_constitutions_world"),
    ("prefix", "eu_constitution", "comparative_constitutions_eu"),
    ("equal", "us_constitution_1787", "constitution"),
    ("equal", "federalist_papers_complete", "federalist_papers"),
    ("inside", "brutus", "anti_federalist"),
    ("inside", "cato", "anti_federalist"),
    ("inside", "centinel", "anti_federalist"),
    ("inside", "federal_farmer", "anti_federalist"),
    ("inside", "madisons_notes", "madisons_notes"),
    ("inside", "madison_debates", "madisons_notes"),
    ("inside", "elliots_debates", "elliots_debates"),
    ("inside", "bill_of_rights", "bill_of_rights"),
    ("inside", "founders_correspondence", "founders_correspondence"),
    ("prefix", "hamilton_", "founders_correspondence"),
    ("prefix", "jefferson_", "founders_correspondence"),
    ("inside", "madison_correspondence", "founders_correspondence"),
    ("prefix", "washington_", "founders_correspondence"),
    ("prefix", "adams_", "founders_correspondence"),
    ("prefix", "jay_", "founders_correspondence"),
    ("prefix", "franklin_", "founders_correspondence"),
    ("prefix", "mason_", "founders_correspondence"),
    ("prefix", "henry_", "founders_correspondence"),
    ("inside", "letters_delegates", "letters_delegates_congress"),
    ("inside", "farrand_records", "madisons_notes"),
]
# The author that a stem gives.
AUTHOR_RULES = [
    ("prefix", "hamilton_", "Alexander Hamilton"),
    ("prefix", "jefferson_", "Thomas Jefferson"),
    ("prefix", "madison_", "James Madison"),
    ("inside", "madisons_notes", "James Madison"),
    ("prefix", "washington_", "George Washington"),
    ("prefix", "adams_", "John Adams"),
    ("prefix", "jay_", "John Jay"),
    ("prefix", "franklin_", "Benjamin Franklin"),
    ("prefix", "mason_", "George Mason"),
    ("prefix", "henry_", "Patrick Henry"),
    ("inside", "brutus", "Brutus"),
    ("inside", "cato", "Cato"),
    ("inside", "centinel", "Centinel"),
    ("inside", "federal_farmer", "Federal Farmer"),
    ("equal", "federalist_papers_complete", "Hamilton, Madison, Jay"),
]
# Document types and reference types by collection.
TYPE_OF_COLLECTION = {
    "constitution": "foundational_document", "bill_of_rights": "foundational_document", "federalist_papers": "essay", "anti_federalist": "essay",
    "madisons_notes": "debate_record", "elliots_debates": "debate_record", "founders_correspondence": "letter", "letters_delegates_congress": "letter",
    "comparative_constitutions_world": "constitution", "comparative_constitutions_eu": "constitution",
}
BIBTEX_TYPES = {"constitution": "book", "bill_of_rights": "book", "federalist_papers": "article", "anti_federalist": "article", "madisons_notes": "book", "elliots_debates": "book", "comparative_constitutions_world": "book", "comparative_constitutions_eu": "book"}
RIS_TYPES = {
    "constitution": "BOOK", "bill_of_rights": "BOOK", "madisons_notes": "BOOK", "elliots_debates": "BOOK", "federalist_papers": "JOUR", "anti_federalist": "JOUR",
    "founders_correspondence": "MANSCPT", "letters_delegates_congress": "MANSCPT", "comparative_constitutions_world": "BOOK", "comparative_constitutions_eu": "BOOK",
}
KEY_STOP_WORDS = ("the", "a", "an", "of", "on", "in", "to", "for", "and")


def by_rules(stem: Column, rules: Sequence[tuple[str, str, str]], default: str) -> Column:
    """The value of the first rule that a stem meets."""
    out = None
    for kind, pattern, value in rules:
        test = {"prefix": F.startswith(stem, F.lit(pattern)), "inside": F.contains(stem, F.lit(pattern)), "equal": stem == pattern}[kind]
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.lit(default) if out is None else out.otherwise(default)


def mapped(key: Column, values: dict[str, str], default: str) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return F.lit(default) if out is None else out.otherwise(default)


def collection_of_stem(stem: Column) -> Column:
    return by_rules(stem, COLLECTION_RULES, "other")


def author_of_stem(stem: Column, collection: Column) -> Column:
    return F.when(collection.isin("comparative_constitutions_world", "comparative_constitutions_eu"), "").otherwise(by_rules(stem, AUTHOR_RULES, ""))


def type_of_collection(collection: Column) -> Column:
    return mapped(collection, TYPE_OF_COLLECTION, "document")


def title_of_stem(stem: Column) -> Column:
    """Underscores to blanks, first letters in upper case, the rest as it is."""
    parts = F.filter(F.split(stem, "_"), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def year_of_stem(stem: Column) -> Column:
    years = F.filter(F.split(stem, "_"), lambda p: p.rlike("^[0-9]{4}$") & p.between("1700", "2099"))
    return F.coalesce(F.get(years, 0), F.lit(""))


def first_year(date: Column) -> Column:
    """The first number of four digits from 1500 to 2199, or null."""
    numbers = F.filter(F.regexp_extract_all(date, F.lit(r"\d+"), F.lit(0)), lambda n: (F.length(n) == 4) & n.between("1500", "2199"))
    return F.get(numbers, 0).cast("int")


def leading_year(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")


def authors_of(author: Column) -> Column:
    return F.filter(F.transform(F.split(author, "[,&;]"), lambda a: F.trim(a)), lambda a: a != "")


def stable_id(prefix: str | Column, *parts: Column) -> Column:
    """prefix:first 16 hex digits of the SHA-1 of the parts, joined by bars."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(head, F.lit(":"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16))


@F.pandas_udf(T.StringType())
def fnv1a64(data: pd.Series) -> pd.Series:
    """The FNV-1a checksum of bytes, 16 hex digits."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        h = 0xCBF29CE484222325
        for x in bytes(b):
            h = ((h ^ x) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return data.map(one)


def roman(text: Column) -> Column:
    """The value of a roman numeral, or null; smaller letters before larger ones are taken off."""
    letters = F.reverse(F.split(F.upper(text), ""))
    value = lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).when(c == "C", 100).when(c == "D", 500).when(c == "M", 1000)
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top"))

    def step(acc: Column, c: Column) -> Column:
        v = value(c)
        return F.struct((acc["sum"] + F.when(v < acc["top"], -v).otherwise(v)).alias("sum"), F.greatest(acc["top"], v).alias("top"))

    return F.when(text.rlike("(?i)^[IVXLCDM]+$"), F.aggregate(F.filter(letters, lambda c: c != ""), start, step, lambda acc: acc["sum"]))


def numeral(token: Column) -> Column:
    """A number in digits or as a roman numeral, or null."""
    return F.coalesce(F.when(token.rlike("^[0-9]{1,9}$"), token.try_cast("int")), roman(token))


def coverage_label(in_manifest: Column, raw: Column, cleaned: Column, chunked: Column) -> Column:
    return F.when(~in_manifest, "no manifest").when(chunked, "ingested").when(cleaned, "cleaned").when(raw, "raw only").otherwise("pending")


COVERAGE_LABELS = ("ingested", "cleaned", "raw only", "pending", "no manifest")


def acquisition_status(authored: Column, survival: Column, good: int = 100, some: int = 5) -> Column:
    return F.when(authored >= good, "authored-good").when(authored >= some, "authored-partial").when(survival == "minimal", "minimal-surviving").otherwise("mentions-only")


def acquisition_priority(status: Column, have_corpus: Column, survival: Column, has_edition: Column) -> Column:
    return (
        F.when((status == "authored-good") | have_corpus, 0)
        .when((survival == "rich") & has_edition, 1)
        .when(survival.isin("rich", "moderate") & has_edition, 2)
        .when(survival.isin("rich", "moderate"), 3)
        .otherwise(4)
    )


def country_label(title: Column, document_id: Column) -> Column:
    """What stands before the word Constitution in a title, else the last part of the id in title case."""
    head = F.when(F.contains(title, F.lit("'s Constitution")), F.substring_index(title, "'s Constitution", 1)).when(F.contains(title, F.lit(" Constitution")), F.substring_index(title, " Constitution", 1))
    return F.coalesce(head, F.initcap(F.replace(F.regexp_replace(document_id, "^(?:world|eu)_constitution_", ""), F.lit("_"), F.lit(" "))))


def permalink_id(link: Column) -> Column:
    return F.when(F.contains(link, F.lit("/documents/")), F.regexp_replace(F.substring_index(link, "/documents/", -1), "^/+|/+$", "")).otherwise("")


def local_path(identifier: Column) -> Column:
    """The first part of an id as a folder, the rest joined by two underscores."""
    parts = F.split(identifier, "/")
    return F.when(F.size(parts) > 1, F.concat(F.get(parts, 0), F.lit("/"), F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 1), "__"))).otherwise(identifier)


def search_phrase(title: Column, name: Column) -> Column:
    """A title up to its first bracket or semicolon without a remark on its licence, if it has four words; else the name."""
    cut = F.trim(F.regexp_replace(F.regexp_extract(title, r"^([^(;]*)", 1), r"\bPD\b", ""))
    return F.when(F.size(F.filter(F.split(cut, r"\s+"), lambda w: w != "")) >= 4, cut).otherwise(name)


# references ---------------------------------------------------------------------


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _line(test: Column, *parts: Column) -> Column:
    return F.when(test, F.concat(*parts)).otherwise("")


def citation_key(author: Column, date: Column, title: Column, chunk_id: Column) -> Column:
    """Last word of the author, year, first telling word of the title, end of the chunk id."""
    last = F.get(F.filter(F.split(F.coalesce(author, F.lit("")), r"\s+"), lambda w: w != ""), F.size(F.filter(F.split(F.coalesce(author, F.lit("")), r"\s+"), lambda w: w != "")) - 1)
    telling = F.get(F.filter(F.split(F.coalesce(title, F.lit("")), r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(*KEY_STOP_WORDS)), 0)
    raw = F.concat_ws(
        "-",
        F.lower(F.coalesce(F.regexp_replace(last, ",+$", ""), F.lit("anon"))),
        F.coalesce(first_year(date).cast("string"), F.lit("nd")),
        F.lower(F.coalesce(telling, F.lit("doc"))),
        F.substring_index(chunk_id, "_", -1),
    )
    return F.regexp_replace(F.regexp_replace(raw, r"\s", "-"), r"[^A-Za-z0-9_:-]", "")


def _bib(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))


def bibtex(chunk_id: Column, title: Column, author: Column, date: Column, collection: Column, url: Column) -> Column:
    year = first_year(date)
    return F.concat(
        F.lit("@"), mapped(collection, BIBTEX_TYPES, "misc"), F.lit("{"), citation_key(author, date, title, chunk_id), F.lit(",\n"),
        F.lit("  title = {"), _bib(F.coalesce(title, F.lit(""))), F.lit("},\n"),
        _line(_filled(author), F.lit("  author = {"), _bib(author), F.lit("},\n")),
        _line(_filled(date) & year.isNotNull(), F.lit("  year = {"), year.cast("string"), F.lit("},\n")),
        _line(_filled(date), F.lit("  date = {"), _bib(date), F.lit("},\n")),
        F.lit("  note = {Chunk "), _bib(chunk_id), F.lit(' in collection "'), _bib(F.coalesce(collection, F.lit(""))), F.lit('"},\n'),
        _line(_filled(url), F.lit("  url = {"), url, F.lit("},\n")),
        F.lit("}\n"),
    )


def ris(chunk_id: Column, title: Column, author: Column, date: Column, collection: Column, url: Column) -> Column:
    year = first_year(date)
    return F.concat(
        F.lit("TY  - "), mapped(collection, RIS_TYPES, "GEN"), F.lit("\n"),
        F.lit("TI  - "), F.coalesce(title, F.lit("")), F.lit("\n"),
        F.when(_filled(author), F.array_join(F.transform(authors_of(author), lambda a: F.concat(F.lit("AU  - "), a, F.lit("\n"))), "")).otherwise(""),
        _line(year.isNotNull(), F.lit("PY  - "), year.cast("string"), F.lit("\n")),
        _line(_filled(date), F.lit("DA  - "), date, F.lit("\n")),
        _line(_filled(url), F.lit("UR  - "), url, F.lit("\n")),
        F.lit("N1  - Chunk "), chunk_id, F.lit(' in collection "'), F.coalesce(collection, F.lit("")), F.lit('"\n'),
        F.lit("ER  - \n"),
    )


def plain_reference(title: Column, author: Column, date: Column, collection: Column, url: Column) -> Column:
    return F.concat(
        _line(_filled(author), author, F.lit(". ")), F.lit('"'), F.coalesce(title, F.lit("")), F.lit('"'),
        _line(_filled(date), F.lit(", "), date),
        F.when(_filled(collection), F.concat(F.lit(" ("), F.replace(collection, F.lit("_"), F.lit(" ")), F.lit(")."))).otherwise("."),
        _line(_filled(url), F.lit(" "), url, F.lit(".")),
    )


def front_matter(chunk_id: Column, title: Column, author: Column, date: Column, collection: Column, url: Column, issues: Column, clauses: Column, text: Column) -> Column:
    """A chunk as Markdown with its fields in front; lines of empty fields are left out."""
    listed = lambda name, tags: F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"{name}: "), F.array_join(tags, ", "), F.lit("\n"))).otherwise("")
    field = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("")), F.lit("\n"))
    return F.concat(
        F.lit("---\n"), field("chunk_id", chunk_id), field("title", title), field("author", author), field("date", date), field("collection", collection),
        _line(_filled(url), F.lit("url: "), url, F.lit("\n")), listed("issues", issues), listed("clauses", clauses), F.lit("---\n\n"), F.coalesce(text, F.lit("")), F.lit("\n"),
    )


# state of a page in its link ------------------------------------------------------

STATE_KEYS = ("sel", "q", "col", "issue", "author", "doctype", "clause", "date")


def encode_state(fields: dict[str, Column]) -> Column:
    """Fields as key=value pairs of a link, in a fixed order, empty ones left out."""
    parts = [F.when(_filled(fields[k]), F.concat(F.lit(f"{k}="), F.url_encode(fields[k]))) for k in STATE_KEYS if k in fields]
    return F.concat_ws("&", *parts)


def decode_state(fragment: Column) -> Column:
    """A link's pairs as a map; keys that are none of the known ones are dropped."""
    pairs = F.filter(F.split(F.regexp_replace(fragment, "^#", ""), "&"), lambda p: F.contains(p, F.lit("=")) & F.substring_index(p, "=", 1).isin(*STATE_KEYS))
    return F.map_from_arrays(F.transform(pairs, lambda p: F.substring_index(p, "=", 1)), F.transform(pairs, lambda p: F.url_decode(F.substring_index(p, "=", -1))))
