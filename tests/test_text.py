"""Golden cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import records as R
from lectern.functions import text as X


def one(spark, f, *values, types=None):
    names = [f"v{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], types or ", ".join(f"{n} string" for n in names))
    return df.select(f(*map(F.col, names)).alias("r")).first().r


def test_archive_tokens(spark):
    assert one(spark, X.tokens_archive, "The People, in Order to form a more perfect Union…") == ["people", "order", "form", "more", "perfect", "union"]
    assert one(spark, X.tokens_archive, "résumé") == one(spark, X.tokens_archive, "résumé")
    assert one(spark, X.tokens_archive, "é x ﬁne") == ["é", "fine"]


def test_other_tokens(spark):
    assert one(spark, X.tokens_library, "the a an and or is was be") == []
    assert one(spark, X.tokens_library, "résumé of don't") == ["sum", "don't"]
    assert one(spark, X.tokens_browser, "The éa Senate shall") == ["éa", "senate", "shall"]
    assert one(spark, X.tokens_script, "The senate's 2d vote, of 12") == ["senate's", "vote"]
    assert X.query_terms("the Union, of it") == ["the", "union"]


def test_normalising(spark):
    assert one(spark, X.normalize_text, "  The   QUICK\n\nbrown  fox  ") == "the quick brown fox"
    assert one(spark, X.normalize_whitespace, "﻿a\r\nb  c\n\n\n\nd ") == "a\nb c\n\nd"
    assert one(spark, X.slug_plain, "The Federalist Papers 1787-1788") == "the-federalist-papers-1787-1788"
    assert [one(spark, X.slug, t) for t in ("Hamilton, Madison & Jay", "ACL_2024", "---")] == ["hamilton-madison-jay", "acl-2024", ""]
    assert one(spark, X.identifier, "Notes, of 1787!") == "notes_of_1787"


def test_splitting_and_counting(spark):
    assert len(one(spark, X.sentences, "One. Two! Three?")) == 3
    assert len(one(spark, X.paragraphs, "a\n\nb\n\nc")) == 3
    assert one(spark, X.word_count, "  two words ") == 2
    assert one(spark, X.word_count, None) == 0
    assert one(spark, lambda t: X.occurrences(t, "aa"), "aaaa a") == 2
    assert one(spark, lambda t: X.phrase_score(t, ["due process", "jury"]), "Due\nprocess of a JURY, a perjury") == 2


def test_previews(spark):
    assert one(spark, X.preview, "x" * 201) == "x" * 200 + "…"
    assert one(spark, lambda t: X.word_preview(t, 5), "This is a long text here") == "This is a long text…"
    assert "middle" in one(spark, lambda t: X.simple_snippet(t, "middle", 5), "a" * 300 + " middle " + "b" * 300)


def test_cleaning(spark):
    assert one(spark, X.strip_tags, "<p>One &amp; <b>two</b></p><p>“three”</p>") == 'One & two\n"three"'
    assert one(spark, X.strip_boilerplate, "head\n*** START OF THIS BOOK ***\nbody\n*** END OF THIS BOOK ***\ntail").strip() == "body"
    assert one(spark, lambda t: X.cut_markers(t, "B", "D"), "aBcD") == "Bc"
    assert one(spark, X.drop_footnotes, "text[12] here\n 44 \n[Source: x] end") == "text here\n\n end"
    page = "<html><header>top</header><script>x()</script><body><p>One</p><p>Two <i>three</i></p></body></html>"
    assert one(spark, X.html_body, page) == "One\nTwo three"
    assert one(spark, X.html_events, page) == "top\nOne\nTwo three"


def test_snippets():
    assert X.find_terms("preconstitutional debate is not constitutional debate", ["constitutional"]) == [(32, 46)]
    text = "word " * 30 + "liberty and liberty " + "word " * 30
    piece, marks, lead, trail = X.densest_snippet(text, ["liberty"], 60)
    assert len(marks) == 2 and lead and trail and len(piece) == 60
    assert X.densest_snippet("short", ["x"], 40) == ("short", [], False, False)
    piece, marks, *_ = X.densest_snippet("é liberty", ["liberty"], 40)
    assert piece.encode()[marks[0][0] : marks[0][1]] == b"liberty"


def test_marked(spark):
    row = spark.createDataFrame([("é liberty or death",)], "t string").withColumn("s", X.snippet(F.col("t"), ["liberty", "death"])).select(X.marked(F.col("s.text"), F.col("s.highlights")).alias("m")).first()
    assert row.m == "é <mark>liberty</mark> or <mark>death</mark>"


@pytest.mark.parametrize("roman,value", [("IV", 4), ("LI", 51), ("XLII", 42), ("VIII", 8), ("is", None), ("17", 17)])
def test_numerals(spark, roman, value):
    assert one(spark, R.numeral, roman) == value


def test_dates_and_authors(spark):
    got = [one(spark, R.first_year, d) for d in ("1787-09-17", "1787", "September 17, 1787", "undated", "c. 1789", "12")]
    assert got == [1787, 1787, 1787, None, 1789, None]
    assert one(spark, R.authors_of, "Hamilton, Madison & Jay") == ["Hamilton", "Madison", "Jay"]


def test_stems(spark):
    assert one(spark, R.collection_of_stem, "madison_debates_1787") == "madisons_notes"
    assert one(spark, R.collection_of_stem, "jefferson_letters") == "founders_correspondence"
    assert one(spark, R.title_of_stem, "the_old_McDonald") == "The Old McDonald"
    assert one(spark, R.year_of_stem, "debates_17870_1788_x") == "1788"


def test_states(spark):
    f = lambda a, b: R.acquisition_status(a.cast("int"), b)
    assert [one(spark, f, a, s) for a, s in (("100", "rich"), ("5", "rich"), ("0", "minimal"), ("4", "rich"))] == ["authored-good", "authored-partial", "minimal-surviving", "mentions-only"]


def test_references(spark):
    cols = "chunk_id string, title string, author string, date string, source_collection string, source_url string"
    df = spark.createDataFrame([("constitution_0001", "The {Constitution}", "Hamilton, Madison & Jay", "1787-09-17", "constitution", "")], cols)
    c = [F.col(x) for x in df.columns]
    bib = df.select(R.bibtex(*c).alias("r")).first().r
    assert bib.startswith("@book{jay-1787-constitution-0001,") and "year = {1787}" in bib and "The \\{Constitution\\}" in bib
    ris = df.select(R.ris(*c).alias("r")).first().r
    assert ris.count("AU  - ") == 3 and ris.startswith("TY  - BOOK\n") and ris.endswith("ER  - \n")
    assert df.select(R.plain_reference(*c[1:]).alias("r")).first().r == 'Hamilton, Madison & Jay. "The {Constitution}", 1787-09-17 (constitution).'


def test_checksum_and_ids(spark):
    df = spark.createDataFrame([(bytearray(b"hello"), "a", "b")], "b binary, x string, y string")
    row = df.select(R.fnv1a64("b").alias("f"), R.stable_id("author", F.col("x"), F.col("y")).alias("i")).first()
    assert row.f == "a430d84680aabd0b"
    import hashlib

    assert row.i == "author:" + hashlib.sha1(b"a|b").hexdigest()[:16]


def test_link_state(spark):
    df = spark.createDataFrame([("a b&c", "x=y")], "q string, author string")
    row = df.select(R.encode_state({"q": F.col("q"), "author": F.col("author")}).alias("s")).select(R.decode_state(F.col("s")).alias("m"), R.decode_state(F.lit("#q=z&bad=1")).alias("n")).first()
    assert row.m == {"q": "a b&c", "author": "x=y"} and row.n == {"q": "z"}
