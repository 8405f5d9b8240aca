"""Queries of scalar functions, chunking, tagging and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import records as RC
from lectern.functions import text as X
from lectern.operators import chunking as CH
from lectern.operators import tagging as TG
from lectern.operators import tables as T
from lectern.plans.common import CLAUSES, ISSUES, C, Registry, chunks, joined, sql_list, sql_tags
from lectern.runtime import read_table
from lectern.sources import sinks as SK

R = Registry()

# chunking: every document, its words cut at ASCII white space in either engine
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda w: w <> '')"
_STARTS = {"library": ("CASE WHEN n >= 80 THEN range(0, n - 79, 275) ELSE [] END", 320), "archive": ("CASE WHEN n > 0 THEN range(0, greatest(0, ceil((n - 300) / 200.0)::INTEGER) * 200 + 1, 200) ELSE [] END", 300), "expander": ("CASE WHEN n >= 100 THEN range(0, n - 99, 350) ELSE [] END", 400)}
for _kind, (_starts, _width) in _STARTS.items():
    R.add(
        f"chunk_windows_{_kind}",
        lambda s, d, k=_kind: CH.windows(read_table(s, d, "documents"), "doc_id", "text", k).select(F.col("id").alias("doc_id"), "seq", "start", "n_words", F.md5("text").alias("digest")),
        f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, w, len(w)::INTEGER AS n FROM w), x AS (SELECT doc_id, w, {_starts} AS st FROM s), y AS (SELECT doc_id, w, st, unnest(range(len(st))) AS seq FROM x)
SELECT doc_id, seq::INTEGER AS seq, st[seq + 1]::INTEGER AS start, len(w[st[seq + 1] + 1 : st[seq + 1] + {_width}])::INTEGER AS n_words, md5(array_to_string(w[st[seq + 1] + 1 : st[seq + 1] + {_width}], ' ')) AS digest FROM y""",
    )
R.add("chunk_names", lambda s, d: CH.windows(read_table(s, d, "documents"), "doc_id", "text", "library").select(CH.chunk_name(F.col("id").cast("string"), F.col("seq")).alias("chunk_id")), f"WITH w AS (SELECT doc_id, len({_WORDS})::INTEGER AS n FROM documents), x AS (SELECT doc_id, unnest(range(len({_STARTS['library'][0]}))) AS seq FROM w) SELECT doc_id || '_' || lpad(seq::VARCHAR, 4, '0') AS chunk_id FROM x")
R.add("chunk_paragraphs", lambda s, d: CH.assemble(read_table(s, d, "documents"), "doc_id", "text").select("chunk_id", "document_id", "seq", "word_count", F.md5("text").alias("digest")))
R.add("chunk_articles", lambda s, d: CH.constitution_records(chunks(s, d, "text"), "chunk_id", "text").select("record_id", "seed_clause", "n_words"))
R.add("chunk_records", lambda s, d: CH.build_records(chunks(s, d, "text").where("text is not null and trim(text) <> ''"), "chunk_id", "text", "whole").select("id", "n_words"), rf"WITH {C} SELECT chunk_id AS id, len({_WORDS})::INTEGER AS n_words FROM c WHERE text IS NOT NULL AND trim(text) <> ''")
R.add("chunk_sections", lambda s, d: CH.split_records(chunks(s, d, "text"), "chunk_id", "text", r"(?m)^(?=(?:CHAPTER|SECTION|ARTICLE) [IVXLC\d]+\.?$)").select("id", "seq", "header", "n_words"))

# tagging
CLAUSE_WORDS = {"I.1": ("legislature", "congress", "senate"), "I.8": ("treasury", "coinage", "bounty", "commerce"), "II.1": ("executive", "governor", "election"), "III.1": ("court", "judge", "tribunal")}
ISSUE_WORDS = {"debt": ("creditors", "loans", "debtors"), "trade": ("ports", "exports", "wharf"), "war": ("militia", "garrison", "regiments"), "none": ()}
_COUNT = lambda words: " + ".join(f"contains(t, '{w}')::INTEGER" for w in words)
_CASES = lambda tax, two=(): ", ".join(f"CASE WHEN {_COUNT(ws)} >= {2 if k in two else 1} THEN '{k}' END" for k, ws in tax.items() if ws)
R.add("tags_by_keyword", lambda s, d: chunks(s, d, "text", CLAUSES).select("chunk_id", joined(TG.clause_tags(F.coalesce("text", F.lit("")), CLAUSE_WORDS, F.col(CLAUSES))).alias("clauses"), joined(TG.keyword_tags(F.coalesce("text", F.lit("")), ISSUE_WORDS)).alias("issues")), f"""WITH {C}, l AS (SELECT chunk_id, lower(coalesce(text, '')) AS t, {sql_tags(CLAUSES)} AS seeds FROM c), x AS (SELECT chunk_id, list_concat(seeds, list_filter([{_CASES(CLAUSE_WORDS, TG.TWO_KEYWORDS)}], lambda z: z IS NOT NULL)) AS k, list_filter([{_CASES(ISSUE_WORDS)}], lambda z: z IS NOT NULL) AS i FROM l)
SELECT chunk_id, array_to_string(list_filter(k, lambda v, n: list_position(k, v) = n), '|') AS clauses, array_to_string(i, '|') AS issues FROM x""")  # fmt: skip
R.add("tags_sorted", lambda s, d: read_table(s, d, "documents").select("doc_id", joined(TG.keyword_tags(F.coalesce("text", F.lit("")), CLAUSE_WORDS | ISSUE_WORDS, ordered=True)).alias("tags")), f"WITH l AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) SELECT doc_id, array_to_string(list_sort(list_filter([{_CASES(CLAUSE_WORDS | ISSUE_WORDS)}], lambda z: z IS NOT NULL)), '|') AS tags FROM l")

# scalars over whole tables
_WS = r"[ \t\n\v\f\r]"
R.add("whitespace_normalised", lambda s, d: read_table(s, d, "documents").where("text is not null").select("doc_id", F.md5(X.normalize_whitespace(F.col("text"))).alias("digest")), rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(65279), ''), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL""")
R.add("identifiers", lambda s, d: read_table(s, d, "documents").select("doc_id", X.identifier(F.col("title")).alias("identifier"), X.slug(F.col("title"), "none").alias("slug"), X.slug_plain(F.col("title")).alias("plain")), r"""SELECT doc_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS identifier,
CASE WHEN regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = '' THEN 'none' ELSE regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS slug,
regexp_replace(regexp_replace(lower(trim(title)), '\s', '-', 'g'), '[^a-z0-9-]', '_', 'g') AS plain FROM documents""")  # fmt: skip
R.add("text_counts", lambda s, d: chunks(s, d, "text").select("chunk_id", X.word_count(F.col("text")).alias("words"), F.size(X.sentences(F.coalesce("text", F.lit("")))).alias("sentences"), F.size(X.paragraphs(F.coalesce("text", F.lit("")))).alias("paragraphs"), X.occurrences(F.lower(F.coalesce("text", F.lit(""))), "treaty").alias("hits"), X.phrase_score(F.coalesce("text", F.lit("")), ["the price of", "scarcity of paper"]).cast("int").alias("phrases")), rf"""WITH {C}, l AS (SELECT chunk_id, coalesce(text, '') AS t FROM c)
SELECT chunk_id, len(list_filter(regexp_split_to_array(t, '{_WS}+'), lambda w: w <> ''))::INTEGER AS words, len(list_filter(regexp_split_to_array(t, '[.!?]'), lambda w: regexp_matches(w, '[^ \t\n\v\f\r]')))::INTEGER AS sentences,
len(list_filter(string_split(t, chr(10) || chr(10)), lambda w: regexp_matches(w, '[^ \t\n\v\f\r]')))::INTEGER AS paragraphs, ((len(lower(t)) - len(replace(lower(t), 'treaty', ''))) // 6)::INTEGER AS hits,
(len(regexp_extract_all(lower(t), '\bthe{_WS}+price{_WS}+of\b')) + len(regexp_extract_all(lower(t), '\bscarcity{_WS}+of{_WS}+paper\b')))::INTEGER AS phrases FROM l""")  # fmt: skip
R.add("previews", lambda s, d: chunks(s, d, "text").where("text is not null").select("chunk_id", F.md5(X.preview(F.col("text"))).alias("chars"), F.md5(X.word_preview(F.col("text"))).alias("words"), F.md5(X.simple_snippet(F.col("text"), "treaty")).alias("snippet")), rf"""WITH {C}, l AS (SELECT chunk_id, text AS t, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda w: w <> '') AS w, strpos(lower(text), 'treaty') AS spot FROM c WHERE text IS NOT NULL)
SELECT chunk_id, md5(CASE WHEN len(t) > 200 THEN t[:200] || '…' ELSE t END) AS chars, md5(array_to_string(w[:40], ' ') || CASE WHEN len(w) > 40 THEN '…' ELSE '' END) AS words,
md5(CASE WHEN spot > 0 THEN substring(t, greatest(spot - 100, 1), 6 + (spot - greatest(spot - 100, 1)) + 100) ELSE t[:200] END) AS snippet FROM l""")  # fmt: skip
R.add("plain_ligatures", lambda s, d: read_table(s, d, "documents").where("text is not null").select("doc_id", F.length(X.plain_ligatures(F.col("text"))).alias("n")), rf"""SELECT doc_id, len(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'œ', 'oe'), '\r\n?', chr(10), 'g'), chr(65279), ''), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g'))::INTEGER AS n FROM documents WHERE text IS NOT NULL""")
R.add("dates", lambda s, d: chunks(s, d, "date").select("chunk_id", RC.first_year(F.col("date")).cast("string").alias("year"), RC.leading_year(F.col("date")).cast("string").alias("leading")), rf"""WITH {C} SELECT chunk_id, (list_filter(regexp_extract_all(date, '\d+'), lambda x: len(x) = 4 AND x BETWEEN '1500' AND '2199'))[1]::INTEGER::VARCHAR AS year, try_cast(date[:4] AS INTEGER)::VARCHAR AS leading FROM c""")
R.add("author_lists", lambda s, d: chunks(s, d, "author").where("author is not null").select("chunk_id", joined(RC.authors_of(F.col("author"))).alias("authors")), f"WITH {C} SELECT chunk_id, array_to_string(list_filter(list_transform(regexp_split_to_array(author, '[,&;]'), lambda a: trim(a)), lambda a: a <> ''), '|') AS authors FROM c WHERE author IS NOT NULL")
R.add("stable_ids", lambda s, d: chunks(s, d, "author", "title").select("chunk_id", RC.stable_id("author", F.coalesce("author", F.lit("")), F.coalesce("title", F.lit(""))).alias("stable")), f"WITH {C} SELECT chunk_id, 'author:' || sha1(coalesce(author, '') || '|' || coalesce(title, ''))[:16] AS stable FROM c")


def stems(s: SparkSession, d: str) -> DataFrame:
    stem = F.col("document_id")
    coll = RC.collection_of_stem(stem)
    return read_table(s, d, "manifest").select("document_id", RC.title_of_stem(stem).alias("title"), RC.year_of_stem(stem).alias("year"), coll.alias("collection"), RC.author_of_stem(stem, coll).alias("author"), RC.type_of_collection(coll).alias("type"))


R.add("file_stems", stems, r"""SELECT document_id, array_to_string(list_transform(list_filter(string_split(document_id, '_'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') AS title,
coalesce((list_filter(string_split(document_id, '_'), lambda p: regexp_full_match(p, '[0-9]{4}') AND p BETWEEN '1700' AND '2099'))[1], '') AS year, 'other' AS collection, '' AS author, 'document' AS type FROM manifest""")  # fmt: skip
R.add("link_states", lambda s, d: chunks(s, d, "author", "source_collection", "date").select("chunk_id", RC.encode_state({"sel": F.col("chunk_id"), "col": F.col("source_collection"), "author": F.col("author"), "date": F.col("date")}).alias("link")).select("chunk_id", RC.decode_state(F.col("link"))["author"].alias("author"), RC.decode_state(F.col("link"))["col"].alias("collection")), f"WITH {C} SELECT chunk_id, nullif(author, '') AS author, nullif(source_collection, '') AS collection FROM c")
R.add("search_phrases", lambda s, d: read_table(s, d, "manifest").select("document_id", RC.search_phrase(F.col("title"), F.col("author")).alias("phrase"), RC.country_label(F.col("title"), F.col("document_id")).alias("label"), RC.local_path(F.regexp_replace("document_id", "_", "/")).alias("path"), RC.permalink_id(F.concat(F.lit("https://x.example/documents/"), "document_id", F.lit("/"))).alias("permalink")), r"""WITH m AS (SELECT *, trim(regexp_replace(regexp_extract(title, '^([^(;]*)', 1), '\bPD\b', '', 'g')) AS cut, string_split(document_id, '_') AS p FROM manifest)
SELECT document_id, CASE WHEN len(list_filter(regexp_split_to_array(cut, '\s+'), lambda w: w <> '')) >= 4 THEN cut ELSE author END AS phrase,
array_to_string(list_transform(string_split(replace(document_id, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label, p[1] || '/' || array_to_string(p[2:], '__') AS path, document_id AS permalink FROM m""")  # fmt: skip

# exports
_KEYW = f"list_filter(regexp_split_to_array(coalesce(title, ''), '{_WS}+'), lambda w: w <> '' AND lower(w) NOT IN ({sql_list(RC.KEY_STOP_WORDS)}))[1]"
_AW = f"list_filter(regexp_split_to_array(coalesce(author, ''), '{_WS}+'), lambda w: w <> '')"
_Y = r"(list_filter(regexp_extract_all(date, '\d+'), lambda x: len(x) = 4 AND x BETWEEN '1500' AND '2199'))[1]"
_KEY = f"regexp_replace(regexp_replace(lower(coalesce(regexp_replace(({_AW})[-1], ',+$', ''), 'anon')) || '-' || coalesce({_Y}, 'nd') || '-' || lower(coalesce(({_KEYW}), 'doc')) || '-' || string_split(chunk_id, '_')[-1], '{_WS}', '-', 'g'), '[^A-Za-z0-9_:-]', '', 'g')"
_BIB = "replace(replace({0}, '{{', chr(92) || '{{'), '}}', chr(92) || '}}')"
_E = lambda c: f"coalesce({c}, '') <> ''"
_REF = f"""WITH {C}, k AS (SELECT *, {_KEY} AS key, {_Y} AS y FROM c), x AS (SELECT chunk_id, key,
'@misc{{' || key || ',' || chr(10) || '  title = {{' || {_BIB.format("coalesce(title, '')")} || '}},' || chr(10) || CASE WHEN {_E('author')} THEN '  author = {{' || {_BIB.format('author')} || '}},' || chr(10) ELSE '' END
|| CASE WHEN {_E('date')} AND y IS NOT NULL THEN '  year = {{' || y || '}},' || chr(10) ELSE '' END || CASE WHEN {_E('date')} THEN '  date = {{' || {_BIB.format('date')} || '}},' || chr(10) ELSE '' END
|| '  note = {{Chunk ' || {_BIB.format('chunk_id')} || ' in collection "' || {_BIB.format("coalesce(source_collection, '')")} || '"}},' || chr(10) || CASE WHEN {_E('source_url')} THEN '  url = {{' || source_url || '}},' || chr(10) ELSE '' END || '}}' || chr(10) AS bibtex,
'TY  - GEN' || chr(10) || 'TI  - ' || coalesce(title, '') || chr(10) || CASE WHEN {_E('author')} THEN coalesce(array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(author, '[,&;]'), lambda a: trim(a)), lambda a: a <> ''), lambda a: 'AU  - ' || a || chr(10)), ''), '') ELSE '' END
|| CASE WHEN y IS NOT NULL THEN 'PY  - ' || y || chr(10) ELSE '' END || CASE WHEN {_E('date')} THEN 'DA  - ' || date || chr(10) ELSE '' END || CASE WHEN {_E('source_url')} THEN 'UR  - ' || source_url || chr(10) ELSE '' END
|| 'N1  - Chunk ' || chunk_id || ' in collection "' || coalesce(source_collection, '') || '"' || chr(10) || 'ER  - ' || chr(10) AS ris,
CASE WHEN {_E('author')} THEN author || '. ' ELSE '' END || '"' || coalesce(title, '') || '"' || CASE WHEN {_E('date')} THEN ', ' || date ELSE '' END || CASE WHEN {_E('source_collection')} THEN ' (' || replace(source_collection, '_', ' ') || ').' ELSE '.' END || CASE WHEN {_E('source_url')} THEN ' ' || source_url || '.' ELSE '' END AS plain FROM k)
SELECT chunk_id, key, md5(bibtex) AS bibtex, md5(ris) AS ris, plain FROM x"""
R.add("references", lambda s, d: SK.references(chunks(s, d, "title", "author", "date", "source_collection", "source_url", ISSUES, CLAUSES, "text")).select("chunk_id", "key", F.md5("bibtex").alias("bibtex"), F.md5("ris").alias("ris"), "plain"), _REF.replace("{{", "{").replace("}}", "}"))
_JOIN = lambda c, by: f"array_to_string({sql_tags(c)}, '{by}')"
R.add("csv_rows", lambda s, d: SK.csv_rows(chunks(s, d, "document_id", "title", "author", "date", "source_collection", "source_url", "document_type", ISSUES, CLAUSES, "word_count", "text")).withColumn("word_count", F.col("word_count").cast("string")), f"WITH {C} SELECT chunk_id, document_id, title, author, date, source_collection, source_url, document_type, {_JOIN(ISSUES, '|')} AS issue_tags, {_JOIN(CLAUSES, '|')} AS constitutional_clause_tags, word_count::VARCHAR AS word_count, text FROM c")
R.add("client_rows", lambda s, d: SK.client_rows(chunks(s, d, "document_id", "title", "author", "date", "source_collection", ISSUES, CLAUSES, "text")), rf"WITH {C} SELECT chunk_id, document_id, title, author, date, source_collection, {_JOIN(ISSUES, '; ')} AS issues, {_JOIN(CLAUSES, '; ')} AS clauses, trim(regexp_replace(text, '{_WS}+', ' ', 'g')) AS text FROM c")
R.add("unique_tags", lambda s, d: chunks(s, d, ISSUES).select("chunk_id", joined(T.unique_in_order(F.coalesce(ISSUES, F.array().cast("array<string>")))).alias("tags")), f"WITH {C}, t AS (SELECT chunk_id, list_filter({sql_tags(ISSUES)}, lambda x: x <> '') AS t FROM c) SELECT chunk_id, array_to_string(list_filter(t, lambda v, n: list_position(t, v) = n), '|') AS tags FROM t")
R.add("combined_texts", lambda s, d: SK.combined_text(read_table(s, d, "documents").where("text is not null"), "source", "doc_id", "date", "title", "text").select("group", "occurrence", "id", "words", F.md5("section").alias("digest")), rf"""SELECT source AS "group", (row_number() OVER (PARTITION BY source ORDER BY coalesce(date, ''), doc_id))::INTEGER AS occurrence, doc_id AS id,
len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda w: w <> ''))::INTEGER AS words, md5('=== ' || coalesce(title, '') || ' (' || coalesce(date, '') || ') ===' || chr(10) || text) AS digest FROM documents WHERE text IS NOT NULL""")  # fmt: skip
