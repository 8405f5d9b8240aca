"""Search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import analytics as A
from lectern.operators import filters as FL
from lectern.operators import search as S
from lectern.plans.common import CLAUSES, ISSUES, C, Registry, chunks, joined, sql_list, sql_tags, sql_tokens_all, sql_tokens_archive
from lectern.runtime import shared_folder

R = Registry()
TERMS = ["charter", "liberty", "treaty", "charter"]
NEAR = ["charter", "libberty", "tretaies", "veto"]
FACETS = FL.Facets(collections=("Convention_Records", "foundation_acts"), authors=("oskmont", "kittden", "ULLERBY"), issues=("General_Welfare", "jury_trial", "harbour_duties"), date_prefix="17")


_KEPT: dict[tuple[str, str], str] = {}


def built(spark: SparkSession, d: str) -> S.PostingIndex:
    return S.PostingIndex.build(chunks(spark, d, "text"), "chunk_id", X.tokens_archive(F.col("text")))


def index(spark: SparkSession, d: str) -> S.PostingIndex:
    """The index of a directory's chunks, written to the shared folder by the first query of an application that needs it and read by all."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _KEPT:
        path = shared_folder(spark, "index")
        S.PostingIndex.kept(chunks(spark, d, "text"), "chunk_id", X.tokens_archive(F.col("text")), path)
        _KEPT[key] = path
    return S.PostingIndex.open(spark, _KEPT[key])


def _ranked(df: DataFrame, k: int = 10) -> DataFrame:
    return S.top(df.select("id", "score"), k)


_BASE = f"""WITH {C}, t AS (SELECT chunk_id, {sql_tokens_archive('text')} AS toks FROM c),
dl AS (SELECT chunk_id, len(toks) AS dl FROM t), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM t) GROUP BY ALL),
f AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term)"""
_TF = "tf * 2.5 / greatest(tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0)), 1e-6)"
_IDF = "ln((n - df + 0.5) / (df + 0.5) + 1.0)"


def _or(weights: str, where: str = "true", k: int = 10, least: float = -1e9) -> str:
    return f"""{_BASE}, q(term, w) AS (VALUES {weights}),
r AS (SELECT p.chunk_id AS id, sum(w * {_IDF} * {_TF}) AS score FROM p JOIN q USING (term) JOIN f USING (term) JOIN dl ON dl.chunk_id = p.chunk_id JOIN c ON c.chunk_id = p.chunk_id, s WHERE {where} GROUP BY p.chunk_id)
SELECT id, round(score, 6) AS score FROM r WHERE score >= {least} ORDER BY score DESC, id LIMIT {k}"""


_W = "('charter', 2.0), ('liberty', 1.0), ('treaty', 1.0)"

R.add("bm25_or_top10", lambda s, d: _ranked(index(s, d).bm25_or([(t, 1.0) for t in TERMS])), _or(_W))
R.add("bm25_scan_top10", lambda s, d: _ranked(S.bm25_scan(chunks(s, d, "text"), "chunk_id", X.tokens_archive(F.col("text")), TERMS)), _or(_W))


def bm25_filtered(s: SparkSession, d: str) -> DataFrame:
    allowed = chunks(s, d, "source_collection", "author", ISSUES, "date").where(FACETS.column()).select(F.col("chunk_id").alias("id"))
    return _ranked(index(s, d).bm25_or([(t, 1.0) for t in TERMS], allowed, 0.5), 25)


_TAG_HIT = f"len(list_filter({sql_tags(ISSUES)}, lambda t: lower(t) IN ('general_welfare', 'jury_trial', 'harbour_duties'))) > 0"
_ALLOWED = f"lower(c.source_collection) IN ('convention_records', 'foundation_acts') AND (contains(lower(c.author), 'oskmont') OR contains(lower(c.author), 'kittden') OR contains(lower(c.author), 'ullerby')) AND {_TAG_HIT} AND starts_with(c.date, '17')"
R.add("bm25_filtered", bm25_filtered, _or(_W, _ALLOWED, 25, 0.5))


def bm25_scan_filtered(s: SparkSession, d: str) -> DataFrame:
    df = chunks(s, d, "text", "source_collection", "author", ISSUES, "date")
    return _ranked(S.bm25_scan(df, "chunk_id", X.tokens_archive(F.col("text")), TERMS, FACETS.column()), 25)


R.add("bm25_scan_filtered", bm25_scan_filtered, _or(_W, _ALLOWED, 25))

_AND = ["charter", "liberty"]
R.add(
    "bm25_and_top10",
    lambda s, d: _ranked(index(s, d).bm25_and(_AND)),
    f"""{_BASE}, r AS (SELECT p.chunk_id AS id, sum({_IDF} * {_TF}) AS score, count(*) AS k FROM p JOIN f USING (term) JOIN dl ON dl.chunk_id = p.chunk_id, s WHERE term IN ('charter', 'liberty') GROUP BY p.chunk_id)
SELECT id, round(score, 6) AS score FROM r WHERE k = 2 ORDER BY score DESC, id LIMIT 10""",
)
R.add(
    "bm25_and_as_counted",
    lambda s, d: index(s, d).bm25_and(_AND, parity=True).select("id", F.round("score", 6).alias("score")),
    f"""{_BASE}, r AS (SELECT p.chunk_id AS id, sum(ln((n + 1.0) / (cf + 0.5)) * {_TF}) AS score, count(*) AS k, max(CASE WHEN term = 'liberty' THEN tf END) AS again FROM p JOIN f USING (term) JOIN dl ON dl.chunk_id = p.chunk_id, s WHERE term IN ('charter', 'liberty') GROUP BY p.chunk_id)
SELECT id, round(score, 6) AS score FROM (SELECT *, unnest(range(again)) AS _ FROM r WHERE k = 2)""",
)


def fuzzy_expanded(s: SparkSession, d: str) -> DataFrame:
    i = index(s, d)
    return _ranked(i.bm25_or(i.expand(NEAR, 2)), 10)


def _expanded_sql() -> str:
    # near terms of the two misspelt words, three at most, each once in order of the query
    near = lambda q: f"(SELECT term FROM f WHERE levenshtein(term, '{q}') <= 2 AND regexp_full_match(term, '[ -~]+') ORDER BY levenshtein(term, '{q}'), term LIMIT 3)"
    return f"""{_BASE}, e AS (SELECT 1 AS at, 'charter' AS term, 1.0 AS w UNION ALL SELECT 2, term, 0.5 FROM {near('libberty')} UNION ALL SELECT 3, term, 0.5 FROM {near('tretaies')} UNION ALL SELECT 4, 'veto', 1.0),
x AS (SELECT * FROM e a WHERE w = 1.0 OR NOT EXISTS (SELECT 1 FROM e b WHERE b.term = a.term AND b.at < a.at)),
q AS (SELECT term, sum(w) AS w FROM x GROUP BY term),
r AS (SELECT p.chunk_id AS id, sum(w * {_IDF} * {_TF}) AS score FROM p JOIN q USING (term) JOIN f USING (term) JOIN dl ON dl.chunk_id = p.chunk_id, s GROUP BY p.chunk_id)
SELECT id, round(score, 6) AS score FROM r ORDER BY score DESC, id LIMIT 10"""


R.add("fuzzy_expanded_search", fuzzy_expanded, _expanded_sql())
R.add(
    "fuzzy_terms",
    lambda s, d: S.fuzzy_terms(index(s, d).terms, "libberty", 3, 40),
    f"{_BASE} SELECT term, levenshtein(term, 'libberty')::INTEGER AS distance FROM f WHERE levenshtein(term, 'libberty') <= 3 AND regexp_full_match(term, '[ -~]+') ORDER BY distance, term LIMIT 40",
)
R.add("suggest_prefix", lambda s, d: S.suggest(index(s, d).terms, "con", 50), f"{_BASE} SELECT term FROM f WHERE starts_with(term, 'con') ORDER BY term LIMIT 50")
R.add(
    "fuzzy_chunks",
    lambda s, d: S.fuzzy_chunks(chunks(s, d, "text", "pos"), "chunk_id", "pos", X.tokens_archive(F.col("text")), "tresury", 2, first_only=True),
    f"""WITH {C}, t AS (SELECT DISTINCT chunk_id, pos, unnest({sql_tokens_archive('text')}) AS term FROM c), n AS (SELECT *, levenshtein(term, 'tresury')::INTEGER AS distance FROM t WHERE regexp_full_match(term, '[ -~]+'))
SELECT arg_min(chunk_id, (pos, chunk_id)) AS id, term, distance, 1.0 - distance / 2.0 AS score FROM n WHERE distance <= 2 GROUP BY term, distance""",
)
R.add("inverted_index", lambda s, d: built(s, d).postings.select("term", "id", "tf"), f"{_BASE} SELECT term, chunk_id AS id, tf::INTEGER AS tf FROM p")
R.add("term_frequencies", lambda s, d: built(s, d).frequencies(), f"{_BASE} SELECT term, df, cf FROM f")
R.add("document_lengths", lambda s, d: built(s, d).stats, f"{_BASE} SELECT chunk_id AS id, dl::INTEGER AS dl FROM dl")


def presence_postings(s: SparkSession, d: str) -> DataFrame:
    df = chunks(s, d, "title", "text")
    tokens = df.select("chunk_id", F.explode(F.array_distinct(X.tokens_script(F.concat_ws(" ", "title", "text")))).alias("term"))
    return tokens.groupBy("term").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id"))


_BOTH = "concat_ws(' ', title, text)"
_SCRIPT = f"list_filter({sql_tokens_all(_BOTH)}, lambda t: len(t) > 2 AND t NOT IN ({sql_list(X.STOP_SCRIPT)}))"
R.add("presence_postings", presence_postings, f"WITH {C}, t AS (SELECT DISTINCT chunk_id, unnest({_SCRIPT}) AS term FROM c) SELECT term, count(*) AS n, min(chunk_id) AS first_id, max(chunk_id) AS last_id FROM t GROUP BY term")


def tokenizers(s: SparkSession, d: str) -> DataFrame:
    df = chunks(s, d, "text")
    kinds = {"archive": X.tokens_archive, "library": X.tokens_library, "browser": X.tokens_browser, "script": X.tokens_script}
    return df.select("chunk_id", *(F.md5(joined(F.coalesce(f(F.col("text")), F.array().cast("array<string>")), " ")).alias(n) for n, f in kinds.items()))


_LOW = "lower(coalesce(text, ''))"
_NFKC = "lower(replace(replace(coalesce(text, ''), 'ſ', 's'), 'ﬁ', 'fi'))"
R.add(
    "tokenizers",
    tokenizers,
    f"""WITH {C} SELECT chunk_id, md5(array_to_string({sql_tokens_archive('text')}, ' ')) AS archive,
md5(array_to_string(list_filter(regexp_extract_all({_NFKC}, '[a-z0-9'']+'), lambda t: len(t) BETWEEN 3 AND 50 AND t NOT IN ({sql_list(X.STOP_LIBRARY)})), ' ')) AS library,
md5(array_to_string(list_filter(regexp_split_to_array({_LOW}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) >= 3 AND t NOT IN ({sql_list(X.STOP_BROWSER)})), ' ')) AS browser,
md5(array_to_string(list_filter(regexp_extract_all({_LOW}, '[a-z0-9'']+'), lambda t: len(t) > 2 AND t NOT IN ({sql_list(X.STOP_SCRIPT)})), ' ')) AS script FROM c""",
)

# relevance by counting
R.add(
    "additive_relevance",
    lambda s, d: S.top(S.additive_relevance(chunks(s, d, "text", CLAUSES, ISSUES), "chunk_id", F.col("text"), F.col(CLAUSES), F.col(ISSUES), ["treaty", "power"]), 50),
    f"""WITH {C}, h AS (SELECT chunk_id AS id, lower(text) AS t, {sql_tags(CLAUSES)} AS k, {sql_tags(ISSUES)} AS i FROM c)
SELECT id, round((((len(t) - len(replace(t, 'treaty', ''))) // 6) + 2.0 * len(list_filter(k, lambda x: contains(lower(x), 'treaty'))) + 1.5 * len(list_filter(i, lambda x: contains(lower(x), 'treaty')))
+ ((len(t) - len(replace(t, 'power', ''))) // 5) + 2.0 * len(list_filter(k, lambda x: contains(lower(x), 'power'))) + 1.5 * len(list_filter(i, lambda x: contains(lower(x), 'power')))) / 2.0, 6) AS score
FROM h WHERE contains(t, 'treaty') AND contains(t, 'power') ORDER BY score DESC, id LIMIT 50""",
)
_COUNT = lambda t: f"len(regexp_extract_all(b, '\\b{t}\\b'))"
R.add(
    "keyword_relevance",
    lambda s, d: S.keyword_relevance(chunks(s, d, "title", "text"), "chunk_id", F.col("title"), F.col("text"), ["records", "treasury"]).orderBy(F.desc("score"), "title", "id").limit(40),
    f"""WITH {C}, h AS (SELECT chunk_id AS id, title, lower(coalesce(title, '')) AS w, lower(concat_ws(' ', title, text)) AS b FROM c)
SELECT id, title, ({_COUNT('records')} + {_COUNT('treasury')} + 3 * contains(w, 'records')::INTEGER + 3 * contains(w, 'treasury')::INTEGER)::INTEGER AS score FROM h
WHERE {_COUNT('records')} > 0 AND {_COUNT('treasury')} > 0 ORDER BY score DESC, title, id LIMIT 40""",
)


def snippet_hits(s: SparkSession, d: str) -> DataFrame:
    """The ranked hits with title and densest snippet; a handful of rows reach the vectorised function."""
    hits = _ranked(index(s, d).bm25_or([(t, 1.0) for t in TERMS]))
    rows = hits.join(chunks(s, d, "title", "author", "date", "source_collection", "text"), F.col("id") == F.col("chunk_id"))
    s1 = X.snippet(F.col("text"), ["charter", "liberty", "treaty"])
    return rows.withColumn("s", s1).select("id", "score", "title", "author", "date", "source_collection", X.marked(F.col("s.text"), F.col("s.highlights")).alias("snippet"), F.col("s.leading_ellipsis").alias("leading"), F.col("s.trailing_ellipsis").alias("trailing"))


R.add("snippet_hits", snippet_hits)


def hit_enrichment(s: SparkSession, d: str) -> DataFrame:
    hits = _ranked(index(s, d).bm25_or([(t, 1.0) for t in TERMS]), 25)
    c = chunks(s, d, "document_id", "title", "author", "date", "source_collection", "preview", "text")
    return F.broadcast(hits).join(c, F.col("id") == F.col("chunk_id")).select("chunk_id", "document_id", "title", "author", "date", "source_collection", "score", F.coalesce(F.nullif("preview", F.lit("")), X.preview(F.col("text"))).alias("preview"))


R.add(
    "hit_enrichment",
    hit_enrichment,
    f"""WITH hits AS ({_or(_W, k=25)}), {C} SELECT chunk_id, document_id, title, author, date, source_collection, score,
coalesce(nullif(preview, ''), CASE WHEN len(text) > 200 THEN text[:200] || '…' ELSE text END) AS preview FROM hits JOIN c ON chunk_id = id""",
)
_HITS = f"WITH h AS ({_or(_W, k=200)}), {C}, x AS (SELECT c.* FROM h JOIN c ON chunk_id = id)"


def hits200(s: SparkSession, d: str, *cols: str) -> DataFrame:
    return F.broadcast(_ranked(index(s, d).bm25_or([(t, 1.0) for t in TERMS]), 200)).join(chunks(s, d, *cols), F.col("id") == F.col("chunk_id"))


R.add("hit_collections", lambda s, d: hits200(s, d, "source_collection").groupBy("source_collection").agg(F.count("*").alias("n")), f"{_HITS} SELECT source_collection, count(*) AS n FROM x GROUP BY 1")
R.add(
    "hit_years",
    lambda s, d: S.year_histogram(hits200(s, d, "date"), F.col("date")),
    f"""{_HITS}, y AS (SELECT try_cast(date[:4] AS INTEGER) AS y FROM x WHERE try_cast(date[:4] AS INTEGER) IS NOT NULL), w AS (SELECT CASE WHEN max(y) - min(y) > 50 THEN 10 ELSE 1 END AS st, min(y) AS a, max(y) AS b FROM y),
g AS (SELECT unnest(range(a - a % st, b - b % st + 1, st))::INTEGER AS bucket FROM w), k AS (SELECT (y - y % st)::INTEGER AS bucket, count(*) AS n FROM y, w GROUP BY 1) SELECT g.bucket, coalesce(n, 0) AS n FROM g LEFT JOIN k USING (bucket)""",
)
R.add(
    "hits_by_place",
    lambda s, d: hits200(s, d, "document_id").select(F.regexp_extract("document_id", r"^[a-z]+_([a-z]+)_", 1).alias("place"), "chunk_id").groupBy("place").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_id")),
    f"{_HITS} SELECT regexp_extract(document_id, '^[a-z]+_([a-z]+)_', 1) AS place, count(*) AS n, min(chunk_id) AS first_id FROM x GROUP BY 1",
)
R.add("facet_values", lambda s, d: A.facet_values(chunks(s, d, "source_collection", "author", "document_type", ISSUES)), f"""WITH {C} SELECT DISTINCT facet, value FROM (
SELECT 'collection' AS facet, source_collection AS value FROM c UNION ALL SELECT 'author', author FROM c UNION ALL SELECT 'type', document_type FROM c UNION ALL SELECT 'issue', unnest({sql_tags(ISSUES)}) FROM c) WHERE value IS NOT NULL AND value <> ''""")  # fmt: skip

# filters
R.add("exact_facets", lambda s, d: chunks(s, d, "author", CLAUSES, ISSUES).where(FL.exact_facets(("records", "essays"), (), ("I.8", "III.1"), ("harbour_duties", "jury_trial"))).select("chunk_id"), f"""WITH {C} SELECT chunk_id FROM c
WHERE split_part(chunk_id, '_', 1) IN ('records', 'essays') AND list_has_any({sql_tags(CLAUSES)}, ['I.8', 'III.1']) AND list_has_any({sql_tags(ISSUES)}, ['harbour_duties', 'jury_trial'])""")  # fmt: skip
R.add("single_facets", lambda s, d: chunks(s, d, "source_collection", ISSUES).where((F.col("source_collection") == "court_records") & F.array_contains(ISSUES, "jury_trial")).select("chunk_id"), f"WITH {C} SELECT chunk_id FROM c WHERE source_collection = 'court_records' AND list_contains({sql_tags(ISSUES)}, 'jury_trial')")
R.add("date_range", lambda s, d: chunks(s, d, "date").where(FL.dates_between("1780", "1790-06-30")).select("chunk_id", "date"), f"WITH {C} SELECT chunk_id, date FROM c WHERE date >= '1780' AND date <= '1790-06-30'")
R.add("two_collections", lambda s, d: hits200(s, d, "source_collection").where(F.col("source_collection").isin("comparative_constitutions", "foundation_acts")).select("chunk_id"), f"{_HITS} SELECT chunk_id FROM x WHERE source_collection IN ('comparative_constitutions', 'foundation_acts')")
R.add("dropped_collections", lambda s, d: chunks(s, d, "source_collection").where(~F.col("source_collection").isin("convention_records", "foundation_acts", "convention_notes") & ~F.startswith("source_collection", F.lit("comparative_constitutions"))).groupBy("source_collection").agg(F.count("*").alias("n")), f"""WITH {C} SELECT source_collection, count(*) AS n FROM c
WHERE source_collection NOT IN ('convention_records', 'foundation_acts', 'convention_notes') AND NOT starts_with(source_collection, 'comparative_constitutions') GROUP BY 1""")  # fmt: skip
R.add("topic_in_place", lambda s, d: chunks(s, d, "document_id", "text", "pos").where(F.contains("document_id", F.lit("wendibury")) & F.contains(F.lower("text"), F.lit("treasury"))).orderBy("pos", "chunk_id").limit(3).select("chunk_id"), f"WITH {C} SELECT chunk_id FROM c WHERE contains(document_id, 'wendibury') AND contains(lower(text), 'treasury') ORDER BY pos, chunk_id LIMIT 3")
R.add("palette", lambda s, d: S.palette(chunks(s, d, "title", "source_collection").select("title", "source_collection").distinct(), "title", "source_collection", "notes of"), f"""WITH {C}, u AS (SELECT DISTINCT title, source_collection FROM c), k AS (SELECT *, lower(title) AS a, lower(coalesce(source_collection, '')) AS b FROM u),
v AS (SELECT title, source_collection, CASE WHEN a = 'notes of' THEN 1000 WHEN starts_with(a, 'notes of') THEN 600 - (len(a) - 8) WHEN contains(a, 'notes of') THEN 300 WHEN regexp_matches(a, 'n.*o.*t.*e.*s.* .*o.*f') THEN 100 ELSE -1 END AS x,
CASE WHEN b = 'notes of' THEN 1000 WHEN starts_with(b, 'notes of') THEN 600 - (len(b) - 8) WHEN contains(b, 'notes of') THEN 300 WHEN regexp_matches(b, 'n.*o.*t.*e.*s.* .*o.*f') THEN 100 ELSE -1 END AS y FROM k)
SELECT title, source_collection, greatest(x::DOUBLE, y / 2.0) AS score FROM v WHERE greatest(x::DOUBLE, y / 2.0) > 0 ORDER BY score DESC, title, source_collection LIMIT 40""")  # fmt: skip
R.add("neighbours", lambda s, d: S.neighbours(chunks(s, d, "document_id", "pos"), "chunk_id", "pos"), f"WITH {C} SELECT chunk_id AS id, lag(chunk_id) OVER w AS previous, lead(chunk_id) OVER w AS next FROM c WINDOW w AS (PARTITION BY document_id ORDER BY pos, chunk_id)")
