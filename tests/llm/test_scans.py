"""Damage of scanned pages and its repair, on a small corpus whose words are known."""

from lectern.llm import scans as S

CLEAN = "the gentleman from wendiston moved that the committee be instructed to report upon the price of flour and the tide-water of the northern counties under the constant property"
SCHEMA = "chunk_id string, document_id string, title string, text string, id string, line_no int, word string"


def corpus(spark, *pages):
    rows = [(f"k{i}", "d0", "Records of Wendiston", CLEAN.capitalize() + ".") for i in range(40)]
    rows += [(f"p{i}", "d1", "The Papers of the Convention at Elvholm", t) for i, t in enumerate(pages)]
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


PAGE = "\n".join(
    [
        "The gentlernan from Wendiston moved that the commit-",  # 1 hyphen, misread
        "tee be instructed to report upon tbe price of",  # 2 misread
        "",
        "[Page 12]",  # 4 furniture
        "PAPFRS OF ELVHOLM. 12",  # 5 furniture
        "",
        "flour and the tide-",  # 7 the word's own hyphen
        "water of the northern counties under the con¬",  # 8 hyphen
        "stant pr0perty.",  # 9 misread
    ]
)


def found(spark, *pages):
    rows = S.Scans(corpus(spark, *pages)).damage().collect()
    return {(r.id, r.line_no, r.defect) for r in rows if r.id.startswith("p")}


def test_damage(spark):
    want = {("p0", 1, "hyphen"), ("p0", 1, "misread"), ("p0", 2, "misread"), ("p0", 4, "furniture"), ("p0", 5, "furniture"), ("p0", 8, "hyphen"), ("p0", 9, "misread")}
    assert found(spark, PAGE) == want


def test_copyists_are_no_scans(spark):
    assert found(spark, "The gentlman from Wendiston mooved taht the comittee report.") == set()


def test_numbers_in_sentences(spark):
    page = "The price of flour was moved in\n1772.\n\nThe committee report upon the\n115.\nconstant property."
    assert found(spark, page) == {("p0", 5, "furniture")}


def test_headings_are_text(spark):
    assert found(spark, "CHAPTER IV\n\nThe committee report.", "CHAPTER V\n\nThe property.", "CHAPTER IX\n\nThe price.") == set()


def furniture(spark, *pages, title="Sundry"):
    df = spark.createDataFrame([(f"p{i}", "d1", title, t) for i, t in enumerate(pages)], "chunk_id string, document_id string, title string, text string")
    scans = S.Scans(df)
    return {(r.id, r.line_no, r.why) for r in scans.furniture(scans.marks()).collect()}


def test_headers_by_repetition_alone(spark):
    """No title says what the header is; it is misread in one place and carries no number in another."""
    pages = ["The price of\n\nHISTORY OF THE NORTH 12\n\nflour rose.", "The clerk\n\nHlSTORY OF TBE N0RTH\n\nreported. And", "The end.\n\nHISTORY OF THE NORTH\n\nThe committee.", "The end.\n\nOF THE JUDGES\n\nThe committee."]
    assert furniture(spark, *pages) == {(f"p{i}", 3, "repeated") for i in range(3)}
    # the same place delivered in several chunks is one place
    assert furniture(spark, *[pages[0]] * 3) == set()


def test_one_word_headers_and_variants(spark):
    pages = ["The price of\nDEBATES [1781\nflour rose.", "The clerk was\nTHE DEBATES OF ELVHOLM\nheard and", "It was\nDEBATES OF ELVHOLM. 44\nmoved."]
    assert furniture(spark, *pages) == {(f"p{i}", 2, "repeated") for i in range(3)}


def test_page_numbers_are_runs(spark):
    page = "The price of\n17\nflour and\n\nxviii\n\nThe\n[ 20 ]\nend"
    assert furniture(spark, page) == {("p0", 2, "run"), ("p0", 5, "run"), ("p0", 8, "run")}
    assert S.in_runs([5, None, 9, 400, None]) == [True, False, True, False, False] and S.in_runs([]) == []
    assert [S.page_value(x) for x in ("- 12 -", "[p. xiv]", "IX", "Pg. 7", "iiii", "")] == [12, 14, 9, 7, None, None]


def test_words_that_end_paragraphs_are_text(spark):
    tails = ["The price was settled at\nElvholm.\n\n[12]\n\nThe clerk.", "It was struck out at\nElvholm in 1804.\n\nThe clerk.", "It ended at\nElvholm in 1790.\n\nThe price."]
    assert {(i, n) for i, n, _ in furniture(spark, *tails, title="Records of Elvholm")} == {("p0", 4)}


def test_title_decides_where_nothing_is_repeated(spark):
    assert furniture(spark, "The price of\n\nESSAYS OF DORAVALE\n\nflour.", title="Essays concerning Doravale") == {("p0", 3, "title")}
    assert furniture(spark, "The price of\n\nESSAYS OF DORAVALE\n\nflour.") == set()


def test_words_broken_over_pages(spark):
    page = "The com-\n\nESSAYS OF DORAVALE\n12\n\nmittee moved the prop-\nOF THE JUDGES\nerty."
    df = corpus(spark).union(spark.createDataFrame([("p0", "d1", "Essays of Doravale", page, "x", 1, "y")], SCHEMA))
    scans = S.Scans(df)
    marks = scans.marks()
    assert {(r.line_no, r.first, r.rest, r.rest_no) for r in scans.hyphens(marks, scans.furniture(marks)).collect()} == {(1, "com", "mittee", 6), (6, "prop", "of", 7)}


def test_vocabulary_counts_texts(spark):
    rows = [("Flour, flour. FLOUR", True), ("flour-", True), ("(flour)", False), ("the", True)]
    assert {tuple(r) for r in S.vocabulary(spark.createDataFrame(rows, "text string, first boolean")).collect()} == {("flour", 2, 1), ("the", 1, 1)}


def test_broken_word_with_confusion(spark):
    assert ("p0", 2, "misread") in found(spark, "the com-\nmittce report")
    assert ("p0", 1, "misread") in found(spark, "the eom-\nmittee report")


def test_repair(spark):
    text = {r.id: r.text for r in S.Scans(corpus(spark, PAGE)).repaired().collect()}["p0"]
    assert text.startswith("The gentleman from Wendiston moved that the committee be instructed to report upon the price of flour and the tide-water of")
    assert "Page" not in text and "ELVHOLM" not in text and "the constant property." in text


def test_special_rows(spark):
    df = corpus(spark, None, "", " \n \n", "x")
    assert {r.id for r in S.Scans(df).damage().collect()} == set()
    empty = S.Scans(df.limit(0))
    assert empty.damage().count() == 0 and empty.repaired().count() == 0
    twice = corpus(spark, PAGE).union(corpus(spark, PAGE))
    assert S.Scans(twice).damage().where("id = 'p0'").count() == 7
    assert S.Scans(twice).repaired().where("id = 'p0'").count() == 1


def test_long_line(spark):
    assert found(spark, "the price of flour " * 20_000) == set()


def test_repair_of_faces(spark):
    page = "The gent1eman frorn Wendiſton moved th@t\nthe c0mmi|ttee report upon the pr0perty. 5tatute\nand 0f flour—pr1ce, tbe\nC0NSTANT tidc-water of Fenn~wick A1."
    df = corpus(spark, page, *["The statute of that price."] * 20)
    text = {r.id: r.text for r in S.Scans(df).repaired().collect()}["p0"]
    assert text == "The gentleman from Wendiston moved that the committee report upon the property. Statute and of flour—price, the CONSTANT tide-water of Fennwick A1."


def test_repair_of_broken_words(spark):
    page = "The com-\nmittce report upon the property, the eom-\nmittee and GENTLE-\nM@N of the con¬\nst@nt pr0p-\nerty."
    text = {r.id: r.text for r in S.Scans(corpus(spark, page)).repaired().collect()}["p0"]
    assert text == "The committee report upon the property, the committee and GENTLEMAN of the constant property."


def test_repair_keeps_headers_and_own_hyphens(spark):
    text = {r.id: r.text for r in S.Scans(corpus(spark, PAGE)).repaired().collect()}["p0"]
    assert text.endswith("the tide-water of the northern counties under the constant property.")


def test_copies_do_not_hide_misreadings(spark):
    copied = "The gentleman reported upon\ntbe price of flour."
    whole = [f"In the {k}th year the price of flour rose." for k in range(20, 50)]
    df = corpus(spark, *[copied] * 60, *whole)
    scans = S.Scans(df)
    assert {(r.id, r.line_no) for r in scans.damage().where("defect = 'misread'").collect()} == {(f"p{k}", 2) for k in range(60)}
    assert {r.text for r in scans.repaired().where("id in ('p0', 'p59')").collect()} == {"The gentleman reported upon the price of flour."}
