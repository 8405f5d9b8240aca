"""Golden cases of the operators."""

import math
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import analytics as A
from lectern.operators import chunking as CH
from lectern.operators import citations as CI
from lectern.operators import filters as FL
from lectern.operators import graphs as G
from lectern.operators import search as S
from lectern.operators import tables as T
from lectern.operators import tagging as TG
from lectern.operators import vectors as V


def index(spark, *texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    return S.PostingIndex.build(df, "id", X.tokens_archive(F.col("text")))


# search ------------------------------------------------------------------------


def test_bm25_or(spark):
    i = index(spark, "The harbour master wrote home", "A lantern for the lantern keeper", "salt fish")
    got = S.top(i.bm25_or([("lantern", 1.0), ("keeper", 1.0)]), 5).collect()
    assert got[0].id == "1" and got[0].score > 0 and len(got) == 1
    assert i.bm25_or([]).count() == 0
    twice = i.bm25_or([("lantern", 1.0), ("lantern", 1.0)]).first()
    once = i.bm25_or([("lantern", 1.0)]).first()
    assert math.isclose(twice.score, 2 * once.score) and twice.matched_terms == ["lantern"]


def test_statistics_ignore_the_filter(spark):
    i = index(spark, "liberty charter", "liberty", "charter", "")
    allowed = spark.createDataFrame([("1",)], "id string")
    whole = {r.id: r.score for r in i.bm25_or([("liberty", 1.0)]).collect()}
    assert {r.id: r.score for r in i.bm25_or([("liberty", 1.0)], allowed).collect()} == {"1": whole["1"]}


def test_bm25_and(spark):
    i = index(spark, "granary emptied emptied", "granary rebuilt")
    assert [r.id for r in i.bm25_and(["granary", "emptied"]).collect()] == ["0"]
    assert i.bm25_and(["granary", "nowhere"]).count() == 0 and i.bm25_and([]).count() == 0
    assert i.bm25_and(["granary", "emptied"], parity=True).count() == 2


def test_scan_equals_index(spark):
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(["a liberty charter", "charter charter", None, "liberty"])], "id string, text string")
    i = S.PostingIndex.build(df, "id", X.tokens_archive(F.col("text")))
    a = {r.id: round(r.score, 9) for r in i.bm25_or([("charter", 2.0), ("liberty", 1.0)]).collect()}
    b = {r.id: round(r.score, 9) for r in S.bm25_scan(df, "id", X.tokens_archive(F.col("text")), ["charter", "liberty", "charter"]).collect()}
    assert a == b


def test_kept_index(spark, tmp_path):
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(["a liberty charter", "charter charter", None, "liberty", "", "oak"])], "id string, text string")
    own = S.PostingIndex.build(df, "id", X.tokens_archive(F.col("text")))
    kept = S.PostingIndex.kept(df, "id", X.tokens_archive(F.col("text")), str(tmp_path / "index"))
    assert kept.corpus() == own.corpus() == (6, 1.0)
    for name in ("postings", "stats", "terms"):
        assert set(map(tuple, getattr(own, name).collect())) == set(map(tuple, getattr(kept, name).select(getattr(own, name).columns).collect()))
    terms = [("charter", 2.0), ("liberty", 1.0)]
    found = kept.bm25_or(terms)
    assert {r.id: round(r.score, 9) for r in found.collect()} == {r.id: round(r.score, 9) for r in own.bm25_or(terms).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*In\(term, \[charter,liberty\]\)", plan) and "Join" not in plan


def test_fuzzy_and_suggest(spark):
    i = index(spark, "windmill orchard plaster plasters plastering plasterer")
    assert i.expand(["windmil"], 0) == [] and i.expand(["windmil"], 2) == [("windmill", 0.5)]
    assert [(r.term, r.distance) for r in S.fuzzy_terms(i.terms, "orchrd", 2, 5).collect()] == [("orchard", 1)]
    assert [r.term for r in S.suggest(i.terms, "Plas").collect()] == ["plaster", "plasterer", "plastering", "plasters"]
    with pytest.raises(ValueError):
        S.suggest(i.terms, "")
    short = spark.createDataFrame([("a", "0", 1), ("ab", "0", 1), ("abc", "0", 1)], "term string, id string, tf int")
    assert S.fuzzy_terms(short, "", 2, 9).count() == 2


@pytest.mark.parametrize("a,b,d", [("mitten", "fitting", 3), ("crab", "brace", 3), ("forêt", "foret", 1), ("", "oak", 3)])
def test_edit_distance(spark, a, b, d):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(F.levenshtein("a", "b").alias("d")).first().d == d


def test_facets(spark):
    row = ("Convention", "James Madison", ["Federalism"], ["I.8"], "1787-09-17", "essay")
    df = spark.createDataFrame([row, (None,) * 6], "source_collection string, author string, issue_tags array<string>, constitutional_clause_tags array<string>, date string, document_type string")
    n = lambda **k: df.where(FL.Facets(**k).column()).count()
    assert n(collections=["convention"], authors=["madison"], clauses=["i.8"], date_prefix="1787-09") == 1
    assert n(collections=["other"]) == 0 and n(issues=["federalism"]) == 1 and n() == 2
    r = FL.Request("x", 999, 9, 9999).capped()
    assert (r.limit, r.fuzzy, r.snippet) == (200, 3, 1024)
    with pytest.raises(ValueError):
        FL.Request("  ").capped()


def test_relevance(spark):
    df = spark.createDataFrame([("a", "Treaty papers", "the treaty and the treaty", ["treaty"], []), ("b", "Other", "treatyless", [], [])], "id string, title string, text string, c array<string>, i array<string>")
    got = {r.id: r.score for r in S.additive_relevance(df, "id", F.col("text"), F.col("c"), F.col("i"), ["treaty"]).collect()}
    assert got == {"a": 4.0, "b": 1.0}
    words = {r.id: r.score for r in S.keyword_relevance(df, "id", F.col("title"), F.col("text"), ["treaty"]).collect()}
    assert words == {"a": 6}
    assert S.keyword_relevance(df, "id", F.col("title"), F.col("text"), []).count() == 2


def test_histogram_fills_gaps(spark):
    df = spark.createDataFrame([("1787",), ("1789-01",), ("n.d.",), (None,)], "date string")
    assert [(r.bucket, r.n) for r in S.year_histogram(df, F.col("date")).orderBy("bucket").collect()] == [(1787, 1), (1788, 0), (1789, 1)]
    far = spark.createDataFrame([("1701",), ("1795",)], "date string")
    assert S.year_histogram(far, F.col("date")).count() == 10


# chunking and tagging --------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 79, 80, 300, 301, 320, 355, 700, 1000])
def test_window_counts(spark, n):
    df = spark.createDataFrame([("d", " ".join(f"w{i}" for i in range(n)))], "id string, text string")
    count = lambda kind: CH.windows(df, "id", "text", kind).count()
    assert count("library") == len(range(0, n - 79, 275))
    assert count("archive") == (0 if n == 0 else max(1, -(-(n - 300) // 200) + 1))
    assert count("expander") == len(range(0, n - 99, 350))
    if n == 355:
        assert [r.n_words for r in CH.windows(df, "id", "text", "library").orderBy("seq").collect()] == [320, 80]


def test_chunk_names(spark):
    assert spark.range(1).select(CH.chunk_name(F.lit("test_doc"), F.lit(5)).alias("n")).first().n == "test_doc_0005"


def test_paragraphs():
    p = lambda n, w: " ".join([w] * n)
    text = "\n\n".join([p(30, "a"), p(200, "b"), p(300, "c"), p(700, "d"), p(10, "e")])
    pieces = CH.pack_paragraphs(text)
    assert [len(x.split()) for x in pieces] == [230, 300, 320, 320, 150 + 10]
    assert CH.pack_paragraphs("") == [] and CH.pack_paragraphs("one two") == ["one two"]


def test_splits(spark):
    df = spark.createDataFrame([("con", "We the People\n\nArticle I\nbody one\n\nArticle II\nbody two\n\nArticle I\nagain"), ("plain", "no header here"), ("blank", " ")], "id string, text string")
    rows = {r.record_id: (r.seed_clause, r.n_words) for r in CH.constitution_records(df, "id", "text").collect()}
    assert rows == {"con_preamble": (None, 3), "con_article_i": ("I", 4), "con_article_ii": ("II", 4), "con_article_i_002": ("I", 3), "plain_preamble": (None, 3)}
    essays = spark.createDataFrame([("e", "front\nFEDERALIST No. 10\nMADISON\ntext\nFEDERALIST No. 51\nHAMILTON\nmore")], "id string, text string")
    assert {r.author for r in CH.essay_records(essays, "id", "text").collect()} == {"MADISON", "HAMILTON"}
    letters = spark.createDataFrame([("l", "TO JOHN JAY.\nMarch 1787 dear\nTO GEORGE MASON.\nno year")], "id string, text string")
    assert CH.letter_records(letters, "id", "text").count() == 1
    assert CH.build_records(df, "id", "text", "anything").count() == 2


def test_tags(spark):
    tax = {"I.1": ["legislative", "congress"], "I.8": ["commerce", "tax"], "II.1": ["president"]}
    df = spark.createDataFrame([("The legislative power and Congress; commerce.",), (None,)], "t string")
    assert [r.x for r in df.select(TG.keyword_tags(F.coalesce("t", F.lit("")), tax).alias("x")).collect()] == [["I.1", "I.8"], []]
    assert df.select(TG.clause_tags(F.col("t"), tax, F.array(F.lit("V"), F.lit("I.1"))).alias("x")).first().x == ["V", "I.1"]


# citations -----------------------------------------------------------------------


def cite(spark, *texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    return CI.extract(df, "id", "text")


@pytest.mark.parametrize(
    "text,targets",
    [
        ("Under Article I, Section 8 and Article III.", ["I.8", "III"]),
        ("The First Amendment, with Amendment IV and Amendment 5", ["Amend.1", "Amend.4", "Amend.5"]),
        ("Federalist No. 10, Federalist No. LI; Brutus, No. I", ["brutus:1", "federalist:10", "federalist:51"]),
        ("Federalist No. 999", []),
        ("carticle and the constitution", []),
        ("Twenty-First Amendment", ["Amend.1", "Amend.21"]),
        ("Madison and Hamilton wrote; Jefferson read", ["hamilton", "jefferson", "madison"]),
        (None, []),
    ],
)
def test_citations(spark, text, targets):
    assert sorted(r.target for r in cite(spark, text).collect()) == targets


def test_citation_offsets(spark):
    text = "É Madison, maddison, Madison"
    assert [(r.byte_offset, r.matched_text) for r in cite(spark, text).orderBy("byte_offset").collect()] == [(3, "Madison"), (22, "Madison")]


def test_co_citation(spark):
    nodes, edges = CI.co_citation(cite(spark, "Madison Hamilton", "Hamilton and Madison", "Jefferson"), 10)
    assert [(r.source, r.target, r.weight) for r in edges.collect()] == [("person:hamilton", "person:madison", 2)]
    assert nodes.count() == 3


def test_annotated_spans(spark):
    spans = CI.annotated_spans(cite(spark, "Twenty-First Amendment of Madison")).collect()
    assert [(r.start, r.key) for r in spans] == [(0, "clause:Amend.21"), (26, "person:madison")]


# graphs --------------------------------------------------------------------------


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "x", 1) for a, b in pairs], "source string, target string, type string, weight long")


def test_paths(spark):
    e = edges(spark, ("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("x", "y"))
    walk = lambda a, b: [r.node for r in G.shortest_path(e, a, b).orderBy("step").collect()]
    assert walk("a", "d") == ["a", "b", "d"] and walk("a", "x") == [] and walk("a", "a") == ["a"]


def test_long_paths(spark):
    names = [f"n{k:02}" for k in range(15)]
    found = G.shortest_path(edges(spark, *zip(names, names[1:])), names[0], names[-1])
    assert [r.node for r in found.orderBy("step").collect()] == names


def test_ego(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"))
    nodes, found = G.ego(e, "a", 2)
    assert {r.node: r.distance for r in nodes.collect()} == {"a": 0, "b": 1, "c": 2}
    assert {(r.source, r.target) for r in found.collect()} == {("a", "b"), ("b", "c")}
    assert G.ego(e, "a", 4, 2)[0].count() == 2
    assert G.strongest(e, "b", 5).count() == 2


# vectors -------------------------------------------------------------------------


def test_vectors(spark):
    df = spark.createDataFrame([("e1", [1.0, 0.0, 0.0]), ("e2", [0.0, 1.0, 0.0]), ("z", [0.0, 0.0, 0.0]), ("s", [1.0])], "id string, v array<float>")
    assert [r.id for r in V.nearest(df, "id", "v", [1, 0, 0], 2).collect()] == ["e1", "e2"]
    assert df.select(V.cosine(F.col("v"), F.array(F.lit(1.0))).alias("c")).collect()[3].c == 1.0
    with pytest.raises(Exception, match="expected 3 dimensions"):
        V.checked(df, "v", 3).collect()
    unit = {r.id: r.n for r in df.select("id", V.norm(V.normalised(F.col("v"))).alias("n")).collect()}
    assert unit == {"e1": 1.0, "e2": 1.0, "z": 0.0, "s": 1.0}
    first = spark.createDataFrame([("",), ("ab",)], "t string").select(V.byte_embedding("t").alias("v")).collect()
    assert first[0].v[0] == 1.0 and len(first[1].v) == 384


def test_tfidf_lengths(spark):
    texts = spark.createDataFrame([("1", "a a b c".split()), ("2", "a d".split()), ("3", []), ("4", None)], "id string, t array<string>")
    counts = V.term_counts(texts, "id", F.col("t"))
    w = V.tfidf(counts, V.vocabulary(counts, 2), 2).collect()
    assert {(r.id, r.term) for r in w} == {("1", "a"), ("1", "b"), ("2", "a"), ("2", "d")}
    assert all(math.isclose(sum(r.weight**2 for r in w if r.id == i), 1, abs_tol=1e-6) for i in "12")


# analyses and tables ----------------------------------------------------------------


def test_dossiers(spark):
    rows = [("c1", "d1", "James Madison", "x", "1788-02-10", 10, ["a"], []), ("c2", "d2", "James Madison", "x", "1791-12-15", 20, ["a", "b"], None), ("c3", "d2", "Unknown", "x", "1780", 5, [], []), ("c4", "d3", "", "y", "", 1, [], []), ("c5", "d4", "John Jay", "y", None, 7, None, ["I"])]
    df = spark.createDataFrame(rows, "chunk_id string, document_id string, author string, source_collection string, date string, word_count int, issue_tags array<string>, constitutional_clause_tags array<string>")
    got = {r.author: r for r in A.author_dossiers(df).collect()}
    assert set(got) == {"James Madison", "John Jay"}
    m = got["James Madison"]
    assert (m.chunks, m.documents, m.first_date, m.last_date, m.issues, m.samples) == (2, 2, "1788-02-10", "1791-12-15", "a:2|b:1", "c2|c1")


def test_empty_tables(spark):
    df = spark.createDataFrame([], "chunk_id string, document_id string, author string, source_collection string, date string, word_count int, issue_tags array<string>, constitutional_clause_tags array<string>, text string, title string, pos long")
    assert A.overview(df).first().chunks == 0
    for f in (A.author_dossiers, A.yearly_evolution, A.temporal_pivot, A.chunk_similarity, A.document_analysis, A.primary_clusters):
        assert f(df).count() == 0
    assert A.size_histogram(df, "word_count").count() == 4


def test_kept_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, T.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, T.insert_ignore(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, T.difference(old, new).collect())) == [(1, "a", "left"), (2, "b", "left"), (2, "c", "right"), (3, "d", "right")]
    assert T.missing_fields(old, ["k", "z"]) == ["z"]


@pytest.mark.parametrize("times", [(1, 2, 3), (1, 1, 3), (None, 2, 3), (None, None, None)])
def test_each_key_once(spark, times, tmp_path):
    df = spark.createDataFrame([("a", times[0], "x"), ("a", times[1], "x"), ("b", times[2], "y"), (None, 1, "z")], "k string, at int, text string")
    df.write.mode("overwrite").parquet(str(tmp_path / "t"))
    for table in (df, spark.read.parquet(str(tmp_path / "t"))):
        for delivered in (None, "at"):
            assert sorted(map(tuple, A.once(table, "k", "text", delivered=delivered).collect())) == [("a", "x"), ("b", "y")]


@pytest.mark.parametrize("listed", [75, 10_000])
def test_first_delivery_is_kept_and_no_text_moves(spark, listed, tmp_path):
    rows = [(f"k{i % 70}", i, f"text {i}" * 3) for i in range(200)] + [("hot", 1000 - i, f"hot {i}") for i in range(90)]
    spark.createDataFrame(rows, "k string, at int, text string").repartition(5).write.parquet(str(tmp_path / "t"))
    out = A.once(spark.read.parquet(str(tmp_path / "t")), "k", "text", delivered="at", listed=listed)
    want = {(f"k{i}", f"text {i}" * 3) for i in range(70)} | {("hot", "hot 89")}
    assert out.count() == len(want) and set(map(tuple, out.collect())) == want
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    moved = re.findall(r"\(\d+\) (\w*Exchange)\nInput \[\d+\]: (.*)", plan)
    assert moved and not any("text#" in columns for _, columns in moved)


def test_country_filter(spark):
    df = spark.createDataFrame([("Europe", "France", "fr"), ("Asia", "Japan", "jp")], "region string, country string, country_id string")
    assert df.where(FL.country_meta("Europe", "FRAN")).count() == 1 and df.where(FL.country_meta(None, "j")).count() == 1


def test_best_matches_equal_the_join(spark, monkeypatch):
    import random

    rng = random.Random(2)
    rows = lambda p, n: [(f"{p}{i}", f"t{t}", round(rng.random(), 2)) for i in range(n) for t in rng.sample(range(30), 6)]
    a, b = (spark.createDataFrame(rows(p, n), "id string, term string, weight double") for p, n in (("a", 13), ("b", 40)))
    left, right = ({}, {})
    for side, table in ((left, a), (right, b)):
        for r in table.collect():
            side.setdefault(r.id, {})[r.term] = r.weight
    scores = {i: sorted((-round(sum(w * v[t] for t, w in u.items() if t in v), 5), j) for j, v in right.items()) for i, u in left.items()}
    want = {(i, j, n + 1) for i, s in scores.items() for n, (x, j) in enumerate(s[:4]) if x < 0}
    assert {(r.id_a, r.id_b, r.rank) for r in V.best_matches(a, b, 4).collect()} == want
    monkeypatch.setattr("lectern.operators.blocks.SPARSE", 5)
    assert {(r.id_a, r.id_b, r.rank) for r in V.best_matches(a, b, 4).collect()} == want
    grouped = b.withColumn("g", F.substring("id", 2, 1))
    few = {}
    for i, s in scores.items():
        seen = {}
        for x, j in s:
            seen.setdefault(j[1], (x, j))
        few[i] = [j for x, j in sorted(seen.values()) if x < 0][:3]
    assert {(r.id_a, r.id_b) for r in V.best_matches(a, grouped, 3, group="g", per_group=1).collect()} == {(i, j) for i, js in few.items() for j in js}
    sums = {r.id_a: (r.n, r.best, r.mean) for r in V.similarity_summary(a, b).collect()}
    some = {i: x for i, s in scores.items() if (x := [-x for x, _ in s if x < 0])}
    assert sums.keys() == some.keys() and all(sums[i][:2] == (len(x), max(x)) and math.isclose(sums[i][2], sum(x) / len(x)) for i, x in some.items())
    assert V.best_matches(a.limit(0), b, 4).count() == 0 and V.similarity_summary(a, b.limit(0)).count() == 0


def test_nearest_to_each_and_cells(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 12)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, v[5].tolist()), (None, v[1].tolist()), (901, None)], "k long, e array<float>")
    queries = df.where("k % 50 = 0")
    whole = np.vstack([v, v[5:6]]).astype(np.float64)
    want = {i: sorted(range(901), key=lambda j: (-round(float(whole[i] @ whole[j]), 5), j))[:5] for i in range(0, 901, 50)}
    exact = V.nearest_to_each(df, "k", "e", queries, 5).collect()
    got = {i: [r.id for r in sorted((r for r in exact if r.query_id == i), key=lambda r: r.rank)] for i in want}
    assert got == want
    near = V.CellIndex(df, "k", "e", cells=16).nearest(queries.select(F.col("k").alias("id"), F.col("e").alias("v")), 5, probes=10).collect()
    hit = sum((r.query_id, r.id) in {(i, j) for i, js in want.items() for j in js} for r in near)
    assert len(near) == 5 * len(want) and hit / len(near) >= 0.9
    assert V.CellIndex(df.limit(0), "k", "e").nearest(queries.limit(0).select(F.col("k").alias("id"), F.col("e").alias("v")), 5).count() == 0
    assert V.nearest_to_each(df, "k", "e", queries.limit(0), 5).count() == 0


def test_names_in_one_pass_equal_patterns(spark):
    from lectern.operators import joins as J

    register = [("o", ["Ann B. Oak", "Oak"]), ("p", ["Pine"]), ("none", [])]
    texts = ["Ann B. Oak and OAK, oaks; Oakley", "pine-oak pine_ Pine", None, "", "Ann B.Oak"]
    df = spark.createDataFrame([(str(k), t, "z") for k, t in enumerate(texts)], "id string, t string, c string")
    table = spark.createDataFrame([*register, (None, ["x"]), ("null", None)], "entry string, names array<string>")
    a = sorted(map(tuple, J.names_in_texts(df, "id", F.col("t"), table, "c").collect()))
    assert a == sorted(map(tuple, J.names_in_texts(df, "id", F.col("t"), table, "c", block=1).collect()))
    assert J.names_in_texts(df, "id", F.col("t"), table.limit(0)).count() == 0
    b = sorted(map(tuple, J.mentions(df, "id", F.coalesce("t", F.lit("")), register, "c").collect()))
    assert a == b == [("0", "z", "o", 2), ("1", "z", "o", 1), ("1", "z", "p", 2), ("4", "z", "o", 1)]


def test_register_of_mentions_is_whole(spark, data):
    from lectern.plans.reporting import register_of_persons
    from lectern.runtime import read_table

    register = {r.entry: r.names for r in register_of_persons(spark, data).collect()}
    assert len(register) == read_table(spark, data, "delegates").where("kind = 'person' and name is not null").count()
    juniors = [names for names in register.values() if names[0].endswith(" Jr")]
    assert juniors and all(sur in full and sur != "Jr" for full, sur in juniors)


def test_neighbours_over_blocks(spark):
    rows = [(f"c{k:03}", f"d{k % 2}" if k % 7 else None, k // 3 if k % 5 else None) for k in range(90)]
    df = spark.createDataFrame(rows, "chunk_id string, document_id string, pos long")
    per = {}
    for i, d, p in rows:
        per.setdefault(d, []).append((p is not None, p or 0, i))
    want = set()
    for ids in ([i for *_, i in sorted(v)] for v in per.values()):
        want |= set(zip(ids, [None, *ids[:-1]], [*ids[1:], None]))
    for block in (4, 65_536):
        assert set(map(tuple, S.neighbours(df, "chunk_id", "pos", block=block).collect())) == want


def test_numbers_of_a_great_group(spark):
    rows = [("hot", k) for k in range(500)] + [(None, k) for k in range(5)] + [("b", 1)]
    got = T.numbered(spark.createDataFrame(rows, "g string, k int"), ["g"], F.col("k")).collect()
    assert {(r.g, r.k, r.occurrence) for r in got} == {(g, k, (k + 1) if g != "b" else 1) for g, k in rows}


def test_pairs_of_documents(spark):
    from itertools import combinations

    tags = {f"d{k}": ({f"c{j}" for j in range(k % 4)}, {f"i{j}" for j in range(k % 3)}) for k in range(9)} | {"none": (set(), set())}
    df = spark.createDataFrame([(d, sorted(i), sorted(c)) for d, (c, i) in tags.items()] * 2 + [(None, ["i0"], None), ("d1", None, [None])], "document_id string, issue_tags array<string>, constitutional_clause_tags array<string>")
    both = [(a, b, len(tags[a][0] & tags[b][0]), len(tags[a][1] & tags[b][1])) for a, b in combinations(sorted(tags), 2)]
    want = sorted((x for x in both if x[2] + x[3]), key=lambda x: (-x[2] - x[3], x))
    assert [tuple(r) for r in A.chunk_similarity(df, 1000).collect()] == want
    assert [tuple(r) for r in A.chunk_similarity(df, 7).collect()] == want[:7]


def test_broadcasts_are_bounded_by_bytes(spark):
    from lectern.runtime import at_most

    df = spark.createDataFrame([("x" * 1000, ["y" * 500], 1), (None, None, None)], "a string, b array<string>, c int")
    assert at_most(df, 2) and not at_most(df, 1) and not at_most(df, 2, size=1200) and at_most(df.limit(0), 0)


def test_offsets_of_citations(spark):
    text = "Ärticle I; see ARTICLE II, Section 3, and Madison, in the İ Twenty-First Amendment."
    rows = CI.extract(spark.createDataFrame([("a", text), ("n", None), ("e", "")], "id string, t string"), "id", "t").collect()
    low = text.lower().encode()
    assert {r.key for r in rows} == {"clause:II.3", "person:madison", "clause:Amend.21", "clause:Amend.1"}
    assert all(low[r.byte_offset :].startswith(r.matched_text.lower().encode()) for r in rows)
