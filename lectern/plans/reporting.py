"""Queries of the analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import records as RC
from lectern.functions import text as X
from lectern.operators import analytics as A
from lectern.operators import joins as J
from lectern.operators import tables as T
from lectern.plans.common import CLAUSES, ISSUES, C, Registry, chunks, sql_list, sql_tags, sql_tokens_archive
from lectern.runtime import cut, read_table

R = Registry()
ONE, OTHER = "Benjamin E. Oskmont", "Ezekiel A. Kittden"
PLACES = ("Wendibury", "Caelhaven", "Fennland", "Hestia", "Ilmavale", "Neviston", "Quorholm", "Thurmouth")
CK, IK = sql_tags(CLAUSES), sql_tags(ISSUES)


def _six(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes))


def _base(s: SparkSession, d: str, *more: str) -> DataFrame:
    return chunks(s, d, "document_id", "source_collection", "author", "date", "word_count", CLAUSES, ISSUES, *more)


# overviews
_OVER = """SELECT count(*) AS chunks, count(DISTINCT document_id) AS documents, count(DISTINCT {coll}) AS collections, count(DISTINCT author) AS authors, sum(word_count)::BIGINT AS words,
round(avg(word_count), 6) AS mean_words, round(median(word_count), 6) AS median_words, min(word_count) AS min_words, max(word_count) AS max_words, round(coalesce(stddev_samp(word_count), 0), 6) AS stdev_words,
(SELECT count(DISTINCT t) FROM (SELECT unnest({ck}) AS t FROM c)) AS clauses, (SELECT count(DISTINCT t) FROM (SELECT unnest({ik}) AS t FROM c)) AS issues FROM c"""
R.add("corpus_overview", lambda s, d: _six(A.overview(_base(s, d))), f"WITH {C} " + _OVER.format(coll="source_collection", ck=CK, ik=IK))
R.add("overview_by_id", lambda s, d: _six(A.overview(_base(s, d), F.substring_index("chunk_id", "_", 1))), f"WITH {C} " + _OVER.format(coll="split_part(chunk_id, '_', 1)", ck=CK, ik=IK))


def index_stats(s: SparkSession, d: str) -> DataFrame:
    df = chunks(s, d, "document_id", "text", "word_count")
    terms = df.select(F.explode(X.tokens_archive(F.coalesce("text", F.lit(""))))).distinct().count()
    return _six(df.agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"), F.avg("word_count").alias("mean_words")).withColumn("terms", F.lit(terms).cast("bigint")))


R.add("index_stats", index_stats, f"""WITH {C} SELECT count(*) AS chunks, count(DISTINCT document_id) AS documents, round(avg(word_count), 6) AS mean_words,
(SELECT count(DISTINCT t) FROM (SELECT unnest({sql_tokens_archive('text')}) AS t FROM c)) AS terms FROM c""")  # fmt: skip

# tags
_TAG = """, t AS (SELECT document_id, unnest({tag}) AS tag, {rel} AS rel FROM c), k AS (SELECT tag, count(*) AS count, count(DISTINCT document_id) AS documents FROM t GROUP BY tag),
r AS (SELECT tag, string_agg(x, '|' ORDER BY x) AS related FROM (SELECT DISTINCT tag, unnest(rel) AS x FROM t) GROUP BY tag)
SELECT k.tag, count, documents, coalesce(related, '') AS related FROM k LEFT JOIN r USING (tag) ORDER BY count DESC, tag LIMIT {n}"""
R.add("clause_analysis", lambda s, d: A.tag_analysis(_base(s, d), CLAUSES, ISSUES, 30), f"WITH {C}" + _TAG.format(tag=CK, rel=IK, n=30))
R.add("issue_analysis", lambda s, d: A.tag_analysis(_base(s, d), ISSUES, CLAUSES, 20), f"WITH {C}" + _TAG.format(tag=IK, rel=CK, n=20))
R.add("clause_counts", lambda s, d: A.tag_analysis(_base(s, d), CLAUSES, ISSUES, 15).drop("related"), f"WITH {C}, t AS (SELECT document_id, unnest({CK}) AS tag FROM c) SELECT tag, count(*) AS count, count(DISTINCT document_id) AS documents FROM t GROUP BY tag ORDER BY count DESC, tag LIMIT 15")
_DIST = ", n AS (SELECT count(*) AS n FROM (SELECT unnest({tag}) AS t FROM c) GROUP BY t) SELECT count(*) AS total_unique, round(median(n), 6) AS median, round(avg(n), 6) AS mean FROM n"
R.add("clause_distribution", lambda s, d: _six(A.tag_distribution(_base(s, d), CLAUSES)), f"WITH {C}" + _DIST.format(tag=CK))
R.add("issue_distribution", lambda s, d: _six(A.tag_distribution(_base(s, d), ISSUES)), f"WITH {C}" + _DIST.format(tag=IK))

# rollups
_ROLL = """, b AS (SELECT {key} AS key, count(*) AS chunks, coalesce(sum(word_count), 0)::BIGINT AS words, count(DISTINCT document_id) AS documents, round(avg(word_count), 6) AS mean_words FROM c GROUP BY 1),
k AS (SELECT {key} AS key, count(DISTINCT t) AS n FROM (SELECT {key}, unnest({ck}) AS t FROM c) GROUP BY 1), i AS (SELECT {key} AS key, count(DISTINCT t) AS n FROM (SELECT {key}, unnest({ik}) AS t FROM c) GROUP BY 1)
SELECT b.key, b.chunks, b.words, b.documents, coalesce(k.n, 0) AS clauses, coalesce(i.n, 0) AS issues, b.mean_words FROM b LEFT JOIN k ON b.key IS NOT DISTINCT FROM k.key LEFT JOIN i ON b.key IS NOT DISTINCT FROM i.key"""
for _name, _key in (("collection_analysis", "source_collection"), ("author_analysis", "author")):
    R.add(_name, lambda s, d, k=_key: _six(A.rollup_by(_base(s, d), k)), f"WITH {C}" + _ROLL.format(key=_key, ck=CK, ik=IK))
R.add("document_analysis", lambda s, d: A.document_analysis(_base(s, d, "title", "pos")), f"WITH {C}, t AS (SELECT document_id, arg_min(title, (pos, chunk_id)) AS title FROM c GROUP BY 1), z AS (WITH x AS (SELECT 1){_ROLL.format(key='document_id', ck=CK, ik=IK)}) SELECT z.key AS document_id, title, chunks, words, clauses, issues FROM z JOIN t ON z.key = t.document_id")

# matrices and time
R.add("clause_issue_matrix", lambda s, d: A.tag_matrix(_base(s, d), CLAUSES, ISSUES), f'WITH {C}, r AS (SELECT unnest({CK}) AS "row", {IK} AS i FROM c) SELECT "row", col, count(*) AS n FROM (SELECT "row", unnest(i) AS col FROM r) GROUP BY ALL')
R.add("author_clause_matrix", lambda s, d: A.matrix(_base(s, d), F.col("author"), A.tags_of(CLAUSES)), f'WITH {C} SELECT "row", col, count(*) AS n FROM (SELECT author AS "row", unnest({CK}) AS col FROM c) GROUP BY ALL')
R.add("temporal_clauses", lambda s, d: A.temporal(_base(s, d)), f"WITH {C} SELECT date, tag, count(*) AS n FROM (SELECT date, unnest({CK}) AS tag FROM c) GROUP BY ALL")
R.add("yearly_evolution", lambda s, d: A.yearly_evolution(_base(s, d)), f"""WITH {C}, p AS (SELECT date[:4] AS year, tag, count(*) AS n FROM (SELECT date, unnest({CK}) AS tag FROM c) WHERE date[:4] IS NOT NULL AND date[:4] <> '' GROUP BY ALL)
SELECT year, string_agg(tag || ':' || n, '|' ORDER BY tag || ':' || n) AS tags, sum(n)::BIGINT AS mentions FROM p GROUP BY year""")  # fmt: skip
R.add("temporal_pivot", lambda s, d: A.temporal_pivot(_base(s, d)), f"""WITH {C}, p AS (SELECT date, tag, count(*) AS n FROM (SELECT date, unnest({CK}) AS tag FROM c) WHERE date IS NOT NULL GROUP BY ALL), b AS (SELECT tag FROM p GROUP BY tag ORDER BY sum(n) DESC, tag LIMIT 8),
g AS (SELECT date, tag FROM (SELECT DISTINCT date FROM p), b) SELECT date, tag, coalesce(n, 0) AS n FROM g LEFT JOIN p USING (date, tag)""")  # fmt: skip
_PAIRS = "e AS (SELECT chunk_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT chunk_id, {ck} AS t FROM c)), p AS (SELECT least(a.t[a.i], b.t[b.i]) AS source, greatest(a.t[a.i], b.t[b.i]) AS target FROM e a JOIN e b ON a.chunk_id = b.chunk_id AND a.i < b.i)"
R.add("clause_network", lambda s, d: A.pair_network(_base(s, d), A.tags_of(CLAUSES), 50), f"WITH {C}, {_PAIRS.format(ck=CK)} SELECT source, target, count(*) AS weight FROM p GROUP BY ALL ORDER BY weight DESC, source, target LIMIT 50")
R.add("clause_network_whole", lambda s, d: A.pair_network(_base(s, d), A.tags_of(CLAUSES), None), f"WITH {C}, {_PAIRS.format(ck=CK)} SELECT source, target, count(*) AS weight FROM p GROUP BY ALL")

# words and sizes
R.add("word_frequency", lambda s, d: A.word_frequency(chunks(s, d, "text"), "text"), f"""WITH {C}, w AS (SELECT regexp_replace(unnest(regexp_split_to_array(lower(text), '\\s+')), '[^a-z]', '', 'g') AS word FROM c)
SELECT word, count(*) AS n FROM w WHERE len(word) > 3 AND word NOT IN ({sql_list(X.STOP_FREQUENCY)}) GROUP BY word ORDER BY n DESC, word LIMIT 50""")  # fmt: skip
R.add("word_frequency_tokens", lambda s, d: A.token_frequency(chunks(s, d, "text"), X.tokens_browser(F.col("text")), 60), f"""WITH {C}, w AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) >= 3 AND t NOT IN ({sql_list(X.STOP_BROWSER)}))) AS word FROM c)
SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 60""")  # fmt: skip
R.add("size_histogram", lambda s, d: A.size_histogram(_base(s, d), "word_count"), f"""WITH {C} SELECT bucket, n FROM (SELECT unnest(['<200', '200-399', '400-599', '>=600']) AS bucket,
unnest([count(*) FILTER (word_count < 200), count(*) FILTER (word_count >= 200 AND word_count < 400), count(*) FILTER (word_count >= 400 AND word_count < 600), count(*) FILTER (word_count >= 600)]) AS n FROM c)""")  # fmt: skip

# authors
_MENT = f"m AS (SELECT author, sum(len({CK}))::BIGINT AS mentions, count(DISTINCT document_id) AS documents, coalesce(sum(word_count), 0)::BIGINT AS words, count(*) AS chunks FROM c WHERE author IS NOT NULL AND trim(author) <> '' GROUP BY author)"
R.add("author_influence", lambda s, d: A.author_influence(_base(s, d)), f"WITH {C}, {_MENT} SELECT author, mentions, documents, words, round(mentions * (1 + len(documents::VARCHAR)) * (words / 100.0::DOUBLE + 1.0), 2) AS score FROM m ORDER BY score DESC, author LIMIT 20")
R.add("author_influence_log", lambda s, d: A.author_influence_log(_base(s, d)), f"WITH {C}, {_MENT} SELECT author, mentions, documents, words // chunks AS mean_words, round(mentions * log10(documents::DOUBLE) + 1.0, 6) AS score FROM m ORDER BY score DESC, author LIMIT 20")
R.add("primary_clusters", lambda s, d: A.primary_clusters(_base(s, d)), f"WITH {C} SELECT ({CK})[1] AS cluster, count(*) AS size FROM c WHERE len({CK}) > 0 GROUP BY 1")
_PM = f"n AS (SELECT unnest({CK}) AS clause, list_filter([{sql_list(PLACES)}], lambda p: contains(lower(text), lower(p))) AS named FROM c), k AS (SELECT clause, place, count(*) AS n FROM (SELECT clause, unnest(named) AS place FROM n) GROUP BY ALL)"
R.add("place_mentions", lambda s, d: A.place_mentions(_base(s, d, "text"), "text", PLACES), f"WITH {C}, {_PM} SELECT clause, place, n, rank FROM (SELECT *, (row_number() OVER (PARTITION BY clause ORDER BY n DESC, place))::INTEGER AS rank FROM k) WHERE rank <= 5")
R.add("place_totals", lambda s, d: A.tag_totals(_base(s, d), A.place_mentions(_base(s, d, "text"), "text", PLACES, len(PLACES))), f"WITH {C}, {_PM} SELECT place, count(DISTINCT clause) AS clauses FROM k GROUP BY place")
_TOP = "(SELECT list(tag ORDER BY n DESC, tag)[:{k}] FROM (SELECT tag, count(*) AS n FROM (SELECT unnest({t}) AS tag FROM c WHERE author = '{a}') GROUP BY tag))"
_CMP = f"""WITH {C}, x AS (SELECT coalesce({_TOP.format(k=10, t=CK, a=ONE)}, []) AS ca, coalesce({_TOP.format(k=10, t=CK, a=OTHER)}, []) AS cb, coalesce({_TOP.format(k=8, t=IK, a=ONE)}, []) AS ia, coalesce({_TOP.format(k=8, t=IK, a=OTHER)}, []) AS ib,
(SELECT count(*) FROM c WHERE author = '{ONE}') AS chunks_a, (SELECT count(*) FROM c WHERE author = '{OTHER}') AS chunks_b, (SELECT coalesce(sum(word_count), 0)::BIGINT FROM c WHERE author = '{ONE}') AS words_a, (SELECT coalesce(sum(word_count), 0)::BIGINT FROM c WHERE author = '{OTHER}') AS words_b)
SELECT chunks_a, chunks_b, words_a, words_b, array_to_string(list_sort(list_intersect(ca, cb)), '|') AS shared_clauses, array_to_string(list_sort(list_intersect(ia, ib)), '|') AS shared_issues,
round((len(list_intersect(ca, cb)) + len(list_intersect(ia, ib))) / (len(ca) + len(cb) + len(ia) + len(ib) + 0.1::DOUBLE), 6) AS agreement FROM x"""
R.add("compare_authors", lambda s, d: A.compare_authors(_base(s, d), ONE, OTHER), _CMP)
_SET = "(SELECT coalesce(list(DISTINCT tag), []) FROM (SELECT unnest({t}) AS tag FROM c WHERE author = '{a}'))"
R.add("compare_author_sets", lambda s, d: A.compare_author_sets(_base(s, d), ONE, OTHER), f"""WITH {C}, x AS (SELECT {_SET.format(t=CK, a=ONE)} AS a, {_SET.format(t=CK, a=OTHER)} AS b)
SELECT array_to_string(list_sort(list_intersect(a, b)), '|') AS shared, array_to_string(list_sort(list_filter(a, lambda t: NOT list_contains(b, t))), '|') AS only_a, array_to_string(list_sort(list_filter(b, lambda t: NOT list_contains(a, t))), '|') AS only_b,
round(len(list_intersect(a, b))::DOUBLE / greatest(1, len(list_distinct(list_concat(a, b)))), 6) AS jaccard FROM x""")  # fmt: skip

_FAC = "(SELECT {g}, string_agg(v || ':' || n, '|' ORDER BY r) AS s FROM (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY n DESC, v) AS r FROM (SELECT {g}, v, count(*) AS n FROM ({src}) WHERE v IS NOT NULL AND v <> '' GROUP BY ALL)) WHERE r <= {k} GROUP BY {g})"
R.add("author_dossiers", lambda s, d: A.author_dossiers(_base(s, d)), f"""WITH {C}, n AS (SELECT * FROM c WHERE author IS NOT NULL AND trim(author) <> '' AND lower(trim(author)) <> 'unknown'),
b AS (SELECT author, count(*) AS chunks, count(DISTINCT document_id) AS documents, min(date) FILTER (date <> '') AS first_date, max(date) FILTER (date <> '') AS last_date FROM n GROUP BY author),
co AS {_FAC.format(g='author', src='SELECT author, source_collection AS v FROM n', k=10)}, i AS {_FAC.format(g='author', src=f'SELECT author, unnest({IK}) AS v FROM n', k=8)}, k AS {_FAC.format(g='author', src=f'SELECT author, unnest({CK}) AS v FROM n', k=8)},
m AS (SELECT author, string_agg(chunk_id, '|' ORDER BY r) AS s FROM (SELECT author, chunk_id, row_number() OVER (PARTITION BY author ORDER BY word_count DESC NULLS LAST, chunk_id) AS r FROM n) WHERE r <= 6 GROUP BY author)
SELECT b.author, chunks, documents, coalesce(co.s, '') AS collections, coalesce(i.s, '') AS issues, coalesce(k.s, '') AS clauses, coalesce(m.s, '') AS samples, first_date, last_date
FROM b LEFT JOIN co USING (author) LEFT JOIN i USING (author) LEFT JOIN k USING (author) LEFT JOIN m USING (author)""")  # fmt: skip
R.add("collection_dossiers", lambda s, d: A.collection_dossiers(_base(s, d)), f"""WITH {C}, n AS (SELECT * FROM c WHERE source_collection IS NOT NULL AND source_collection <> ''), b AS (SELECT source_collection, count(*) AS chunks, count(DISTINCT document_id) AS documents FROM n GROUP BY 1),
a AS {_FAC.format(g='source_collection', src='SELECT source_collection, author AS v FROM n', k=10)}, i AS {_FAC.format(g='source_collection', src=f'SELECT source_collection, unnest({IK}) AS v FROM n', k=8)}
SELECT b.source_collection, chunks, documents, coalesce(a.s, '') AS authors, coalesce(i.s, '') AS issues FROM b LEFT JOIN a USING (source_collection) LEFT JOIN i USING (source_collection)""")  # fmt: skip

# documents against each other
R.add("document_pairs", lambda s, d: A.chunk_similarity(_base(s, d), 200), f"""WITH {C}, t AS (SELECT DISTINCT document_id, kind, tag FROM (SELECT document_id, 1 AS kind, unnest({CK}) AS tag FROM c UNION ALL SELECT document_id, 0, unnest({IK}) FROM c))
SELECT a.document_id AS document_a, b.document_id AS document_b, sum(a.kind)::BIGINT AS clauses, sum(1 - a.kind)::BIGINT AS issues FROM t a JOIN t b ON a.kind = b.kind AND a.tag = b.tag AND a.document_id < b.document_id GROUP BY 1, 2 ORDER BY clauses + issues DESC, document_a, document_b LIMIT 200""")  # fmt: skip


# delegates, coverage, validation
def register_of_persons(s: SparkSession, d: str) -> DataFrame:
    """entry, names: all persons, each under the full name and the surname; a name's last full stop is left to the text, since no word ends behind it."""
    people = read_table(s, d, "delegates").where("kind = 'person' and name is not null")
    bare = F.regexp_replace("name", r" Jr\.$", "")
    return people.select(F.col("id").alias("entry"), F.array(F.regexp_replace("name", r" Jr\.$", " Jr"), F.substring_index(bare, " ", -1)).alias("names"))


def delegate_mentions(s: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ", "title", "author", "text")
    m = cut(J.names_in_texts(chunks(s, d, "title", "author", "text", "source_collection"), "chunk_id", text, register_of_persons(s, d), "source_collection"))
    total = m.groupBy("entry").agg(F.count("*").alias("chunks"), F.sum("n").alias("mentions"))
    per = m.where("source_collection is not null").groupBy("entry", "source_collection").agg(F.sum("n").alias("n"))
    best = A.top_n(per, ["entry"], 5, F.desc("n"), F.col("source_collection"))
    listed = best.groupBy("entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "source_collection", F.col("n").cast("string")).alias("s")))), lambda x: x["s"]), "|").alias("sources"))
    return total.join(listed, "entry", "left").select("entry", "chunks", "mentions", F.coalesce("sources", F.lit("")).alias("sources"))


R.add("delegate_mentions", delegate_mentions, f"""WITH {C}, g AS (SELECT id AS entry, regexp_replace(name, ' Jr\\.$', ' Jr') AS name, string_split(regexp_replace(name, ' Jr\\.$', ''), ' ')[-1] AS sur FROM delegates WHERE kind = 'person' AND name IS NOT NULL),
m AS (SELECT entry, source_collection, len(regexp_extract_all(concat_ws(' ', title, author, text), '(?i)\\b(?:' || replace(name, '.', '\\.') || '|' || sur || ')\\b')) AS n FROM c, g WHERE contains(lower(concat_ws(' ', title, author, text)), lower(sur))),
h AS (SELECT * FROM m WHERE n > 0), t AS (SELECT entry, count(*) AS chunks, sum(n)::BIGINT AS mentions FROM h GROUP BY entry), p AS (SELECT entry, source_collection, sum(n)::BIGINT AS n FROM h WHERE source_collection IS NOT NULL GROUP BY ALL),
l AS (SELECT entry, string_agg(source_collection || ':' || n, '|' ORDER BY r) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY n DESC, source_collection) AS r FROM p) WHERE r <= 5 GROUP BY entry)
SELECT t.entry, chunks, mentions, coalesce(sources, '') AS sources FROM t LEFT JOIN l USING (entry)""")  # fmt: skip


def acquisition(s: SparkSession, d: str) -> DataFrame:
    """Delegates with their chunks as authors, state of work and priority; the status column stands for how much survives."""
    authored = chunks(s, d, "author").groupBy("author").agg(F.count("*").alias("authored"))
    people = read_table(s, d, "delegates").where("kind = 'person'")
    survival = F.when(F.col("status") == "signed", "rich").when(F.col("status") == "left_before_signing", "moderate").otherwise("minimal")
    rows = people.join(authored, F.col("name") == F.col("author"), "left").select("id", "name", F.coalesce("authored", F.lit(0)).alias("authored"), survival.alias("survival"), F.col("manifest_entry").isNotNull().alias("edition"))
    status = RC.acquisition_status(F.col("authored"), F.col("survival"), 50, 5)
    return rows.select("id", "authored", status.alias("status"), RC.acquisition_priority(status, F.lit(False), F.col("survival"), F.col("edition")).alias("priority"))


_ACQ = f"""WITH {C}, a AS (SELECT author, count(*) AS authored FROM c GROUP BY author), r AS (SELECT id, coalesce(authored, 0) AS authored, CASE status WHEN 'signed' THEN 'rich' WHEN 'left_before_signing' THEN 'moderate' ELSE 'minimal' END AS survival, manifest_entry IS NOT NULL AS edition FROM delegates LEFT JOIN a ON name = author WHERE kind = 'person'),
x AS (SELECT *, CASE WHEN authored >= 50 THEN 'authored-good' WHEN authored >= 5 THEN 'authored-partial' WHEN survival = 'minimal' THEN 'minimal-surviving' ELSE 'mentions-only' END AS status FROM r),
z AS (SELECT id, authored, status, CASE WHEN status = 'authored-good' THEN 0 WHEN survival = 'rich' AND edition THEN 1 WHEN survival IN ('rich', 'moderate') AND edition THEN 2 WHEN survival IN ('rich', 'moderate') THEN 3 ELSE 4 END AS priority FROM x)"""
R.add("acquisition_matrix", acquisition, _ACQ + " SELECT * FROM z")
R.add("acquisition_counts", lambda s, d: acquisition(s, d).groupBy("status", "priority").agg(F.count("*").alias("n")), _ACQ + " SELECT status, priority, count(*) AS n FROM z GROUP BY ALL")


def coverage(s: SparkSession, d: str) -> DataFrame:
    """delegate, state of its manifest entry; chunked if a chunk's document is the entry or begins with it."""
    delegates = read_table(s, d, "delegates").select("id", "manifest_entry")
    manifest = read_table(s, d, "manifest").select(F.col("document_id").alias("entry"), F.lit(True).alias("listed"), (F.col("source_format") == "text").alias("text"))
    chunked = J.prefix_semi(delegates.where("manifest_entry is not null").select(F.col("manifest_entry").alias("key")).distinct(), "key", chunks(s, d, "document_id").select("document_id"), "document_id").withColumn("chunked", F.lit(True))
    rows = delegates.join(manifest, F.col("manifest_entry") == F.col("entry"), "left").join(chunked, F.col("manifest_entry") == F.col("key"), "left")
    no = F.lit(False)
    label = RC.coverage_label(F.coalesce("listed", no), F.coalesce("listed", no), F.coalesce("text", no), F.coalesce("chunked", no))
    return rows.select("id", label.alias("status"))


_COV = f"""WITH {C}, z AS (SELECT d.id, CASE WHEN m.document_id IS NULL THEN 'no manifest' WHEN EXISTS (SELECT 1 FROM c WHERE c.document_id = d.manifest_entry OR starts_with(c.document_id, d.manifest_entry || '_')) THEN 'ingested' WHEN m.source_format = 'text' THEN 'cleaned' ELSE 'raw only' END AS status FROM delegates d LEFT JOIN manifest m ON m.document_id = d.manifest_entry)"""
R.add("coverage", coverage, _COV + " SELECT * FROM z")
R.add("coverage_summary", lambda s, d: A.status_counts(coverage(s, d), "status"), _COV + ", l AS (SELECT unnest(['ingested', 'cleaned', 'raw only', 'pending', 'no manifest']) AS status) SELECT status, count(z.id) AS n FROM l LEFT JOIN z USING (status) GROUP BY status")
R.add("validate_corpus", lambda s, d: T.validation(read_table(s, d, "chunks")), r"""SELECT count(*) AS rows, count(DISTINCT chunk_id) AS chunks, count(DISTINCT document_id) AS documents, count(DISTINCT source_collection) AS collections, count(DISTINCT author) AS authors,
count(*) FILTER (trim(coalesce(text, '')) = '') AS empty_text, count(chunk_id) - count(DISTINCT chunk_id) AS repeated_ids, count(*) FILTER (word_count IS NULL) AS no_word_count,
count(*) FILTER (word_count <> len(regexp_extract_all(coalesce(text, ''), '[^\t\n\v\f\r ]+'))) AS wrong_word_count, count(*) FILTER (NOT regexp_matches(coalesce(source_url, ''), '^https?://')) AS bad_url FROM chunks""")  # fmt: skip
R.add("region_counts", lambda s, d: read_table(s, d, "nation").join(F.broadcast(read_table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "r_name"), "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
R.add("download_summary", lambda s, d: read_table(s, d, "documents").agg(F.count("*").alias("records"), F.count_if(F.coalesce("text", F.lit("")) != "").alias("downloaded"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("failed"), F.sum("n_chars").alias("chars"), F.count_if(F.col("source_url").isNull()).alias("no_url")), "SELECT count(*) AS records, count(*) FILTER (coalesce(text, '') <> '') AS downloaded, count(*) FILTER (coalesce(text, '') = '') AS failed, sum(n_chars)::BIGINT AS chars, count(*) FILTER (source_url IS NULL) AS no_url FROM documents")
R.add("work_states", lambda s, d: read_table(s, d, "orders").agg(*(F.count_if(F.col("o_orderstatus") == x).alias(n) for x, n in (("O", "open"), ("F", "done"), ("P", "partial")))), "SELECT count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS partial FROM orders")


def report(s: SparkSession, d: str) -> DataFrame:
    """section, key, n: the statistics of a report in one table."""
    base = _base(s, d)
    part = lambda name, df, k, n: df.select(F.lit(name).alias("section"), F.col(k).alias("key"), F.col(n).cast("bigint").alias("n"))
    return part("clauses", A.tag_analysis(base, CLAUSES, ISSUES, 10), "tag", "count").unionByName(part("issues", A.tag_analysis(base, ISSUES, CLAUSES, 10), "tag", "count")).unionByName(part("collections", A.rollup_by(base, "source_collection").where("key is not null"), "key", "chunks"))


R.add("report_statistics", report, f"""WITH {C} SELECT 'clauses' AS section, tag AS key, n FROM (SELECT tag, count(*) AS n FROM (SELECT unnest({CK}) AS tag FROM c) GROUP BY tag ORDER BY n DESC, tag LIMIT 10)
UNION ALL SELECT 'issues', tag, n FROM (SELECT tag, count(*) AS n FROM (SELECT unnest({IK}) AS tag FROM c) GROUP BY tag ORDER BY n DESC, tag LIMIT 10) UNION ALL SELECT 'collections', source_collection, count(*) FROM c WHERE source_collection IS NOT NULL GROUP BY 2""")  # fmt: skip
