"""Items together against brute force; spellings of names."""

import math
from collections import Counter
from itertools import combinations

import pytest

from lectern.llm import names as N
from lectern.llm import spellings as SP
from lectern.llm.spellings import attribute_records
from lectern.llm.together import co_occurrence, significant_pairs

TAGGED = "chunk_id string, issue_tags array<string>, constitutional_clause_tags array<string>, item string, n long"


def test_pairs_against_brute_force(spark):
    rows = [(f"c{k}", ["A b", "a_b", None, ""] + (["x"] if k % 3 else []), ["I.8"] if k % 2 else None, "", 0) for k in range(40)]
    rows += [rows[0], (None, ["a b", "x"], ["I.8"], "", 0), ("n", None, None, "", 0)]
    items = {}
    for i, a, b, *_ in rows:
        if i is not None:
            items[i] = {"".join(t.lower().replace("_", "").replace("-", "").split()) for t in (a or []) + (b or []) if t} - {""}
    single, both = Counter(x for s in items.values() for x in s), Counter(p for s in items.values() for p in combinations(sorted(s), 2))
    got = {(r.item_a, r.item_b): r for r in co_occurrence(spark.createDataFrame(rows, TAGGED), "chunk_id", ("issue_tags", "constitutional_clause_tags")).collect()}
    assert {p: r.n_ab for p, r in got.items()} == dict(both)
    n = len(items)
    for (a, b), r in got.items():
        assert (r.n_a, r.n_b, r.n_records) == (single[a], single[b], n) and math.isclose(r.lift, r.n_ab * n / (r.n_a * r.n_b))
        k = [[r.n_ab, r.n_a - r.n_ab], [r.n_b - r.n_ab, n - r.n_a - r.n_b + r.n_ab]]
        g = 2 * sum(k[i][j] * math.log(k[i][j] * n / (sum(k[i]) * (k[0][j] + k[1][j]))) for i in (0, 1) for j in (0, 1) if k[i][j])
        assert math.isclose(r.llr, max(g, 0), abs_tol=1e-6)


def test_pairs_of_nothing(spark):
    empty = spark.createDataFrame([], TAGGED)
    assert co_occurrence(empty, "chunk_id", ("issue_tags",)).count() == 0
    assert significant_pairs(empty, "chunk_id", ("issue_tags",)).count() == 0
    with pytest.raises(ValueError):
        co_occurrence(empty, "chunk_id; drop", ("issue_tags",))


def test_thresholds(spark):
    rows = [(f"c{k}", ["a", "b"] if k < 4 else ["c"], [], "", 0) for k in range(8)] + [(f"d{k}", ["d", "e"], [], "", 0) for k in range(3)]
    got = [tuple(r)[:2] for r in significant_pairs(spark.createDataFrame(rows, TAGGED), "chunk_id", ("issue_tags", "constitutional_clause_tags")).collect()]
    assert got == [("a", "b")]


@pytest.mark.parametrize("a,b,d", [("oskmont", "oskmont", 0), ("oskmont", "osmkont", 1), ("oskmont", "oskmnt", 1), ("oskmont", "osskmontt", 2), ("oskmont", "kittden", 3)])
def test_distance(a, b, d):
    assert N.distance(a, b, 2) == d


@pytest.mark.parametrize(
    "spelling,canonical,likely",
    [
        ("Oskmont, Benjamin E.", "Benjamin E. Oskmont", True),
        ("B. E. Oskmont", "Benjamin E. Oskmont", True),
        ("OSKMONT, B.", "Benjamin E. Oskmont", True),
        ("Benj. Oskmont", "Benjamin E. Oskmont", True),
        ("Ben  Osskmont (ed.)", "Benjamin E. Oskmont", True),
        ("Hon. Oskmont", "Benjamin E. Oskmont", True),
        ("Oskmont's Papers", "Benjamin E. Oskmont", True),
        ("S. E. Pemhurst", "Samuel E. Pemhurst", True),
        ("R. Oskmont", "Benjamin E. Oskmont", False),
        ("Anonymous", "Benjamin E. Oskmont", False),
        ("", "Benjamin E. Oskmont", False),
    ],
)
def test_person_likelihood(spelling, canonical, likely):
    assert (N.person_likelihood(spelling, canonical) > -8.5) is likely


def test_junior_is_somebody_else():
    assert N.person_likelihood("Crimlow, Timothy, Jr", "Timothy Crimlow Jr.") > N.person_likelihood("Crimlow, Timothy, Jr", "Timothy Crimlow")
    assert N.person_likelihood("T. Crimlow", "Timothy Crimlow") > N.person_likelihood("T. Crimlow", "Timothy Crimlow Jr.")


@pytest.mark.parametrize("spelling,likely", [("Provl. Assembly [Neviston]", True), ("Neviston. Provincial Assembly", True), ("Assembly (Provincial) of Neviston", True), ("Board of Trade of Neviston", False), ("Provincial Assembly of Elvmouth", False)])
def test_body_likelihood(spelling, likely):
    assert (N.body_likelihood(spelling, "Provincial Assembly of Neviston") > -8.5) is likely


def test_records(spark):
    register = spark.createDataFrame([("o", "Benjamin E. Oskmont", "person"), ("y1", "Susannah Yarhurst", "person"), ("y2", "Timothy Yarhurst", "person"), ("a", "Provincial Assembly of Neviston", "body"), (None, "Nobody", "person"), ("n", None, "person")], "entry_id string, name string, kind string")
    authors = ["Benjamin E. Oskmont", "Oskmont, B.", "Osmkont, Benjamin", "Yarhurst", "Susannah Yarhurst", "Susannah Yarhurst", "Prov. Assembly, Neviston", "Valentine Mardgate", None, "", "[n.a.]"]
    rows = [("document", str(k), a, "clash") for k, a in enumerate(authors)] + [("document", None, "Oskmont, B.", "clash"), ("document", "1", "Oskmont, B.", "clash")]
    records = spark.createDataFrame(rows, "record_kind string, record_id string, author string, name string").select("record_kind", "record_id", "author")
    got = {(r.record_id, r.entry_id) for r in attribute_records(records, register).collect()}
    assert got == {("1", "o"), ("2", "o"), ("3", "y1"), ("6", "a")}
    assert attribute_records(records.limit(0), register).count() == 0
    assert attribute_records(records, register.limit(0)).count() == 0


def test_bounds_are_exact(spark):
    """Of 3,000 records three are a thousandth, and twice as often as chance is enough."""
    rows = [(f"c{k}", ["a", "b"] if k < 3 else ["a"] if k < 1500 else [], [], "", 0) for k in range(3000)]
    df = spark.createDataFrame(rows, TAGGED)
    cols = ("issue_tags", "constitutional_clause_tags")
    assert significant_pairs(df, "chunk_id", cols, least=3).count() == 1
    assert significant_pairs(df, "chunk_id", cols, least=3, least_share=0.00101).count() == 0
    assert significant_pairs(df, "chunk_id", cols, least=3, least_lift=2.001).count() == 0


REGISTER = [("e1", "Benjamin Harwick", "person"), ("e2", "Assembly of Doravale", "body")]


@pytest.mark.parametrize("times", [1, 100])
def test_names_two_edits_off(spark, times):
    """Whether a word is a name or an error is told by the corpus, and the same at any size."""
    typed = [("Benjamin Harwick", 30), ("Benjamin Hrawik", 1), ("B. Hartwyck", 3), ("Hartwyck, Benjamin", 4), ("Hartwyck", 2), ("Benj. Harwick", 6), ("Assembly of Dorvale", 1), ("Peter Smith", 20), ("Peter Smyth", 1)]
    spellings = spark.createDataFrame([(s, n * times) for s, n in typed], "spelling string, n long")
    got = {r.spelling: r.entry_id for r in SP.attribute_spellings(spellings, spark.createDataFrame(REGISTER, "entry_id string, name string, kind string")).collect()}
    assert got == {"Benjamin Hrawik": "e1", "Benj. Harwick": "e1", "Assembly of Dorvale": "e2"}


def test_no_given_name_is_a_key():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["Benjamin Harwick", "Assembly of Doravale"])], ["form"])
    keys = {k for b in SP._form_keys(iter([batch])) for k in b.column(1).to_pylist()}
    assert "harwick" in keys and "doravale" in keys and not keys & {"benjamin", "assembly", "benjami"}
