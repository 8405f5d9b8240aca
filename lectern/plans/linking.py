"""Queries of citations, graphs, joins, timelines and kept tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import analytics as A
from lectern.operators import citations as CI
from lectern.operators import filters as FL
from lectern.operators import graphs as G
from lectern.operators import joins as J
from lectern.operators import tables as T
from lectern.plans.common import CLAUSES, ISSUES, C, Registry, chunks, sql_tags
from lectern.runtime import read_table
from lectern.sources import readers as RD

R = Registry()
CK, IK = sql_tags(CLAUSES), sql_tags(ISSUES)

# citations: the passages cite articles by number, and persons and essays in no text, so sentences that do are added
SENTENCES = [
    ("s1", "Under Article I, Section 8 and again under Article III we read it so."),
    ("s2", "The First Amendment, Amendment IV and Amendment 5 were cited with the Twenty-First Amendment."),
    ("s3", "Federalist No. 10, Federalist No. LI, and Brutus, No. I answer each other."),
    ("s4", "Madison wrote to Hamilton, and Jefferson heard of Madison."),
    ("s5", "A particle of the constitution is no article is it; Federalist No. 999 is none."),
    ("s6", "Hamilton and Madison on Article II, section 2; Hamilton again."),
]


def citing(s: SparkSession, d: str) -> DataFrame:
    extra = s.createDataFrame(SENTENCES, "id string, text string")
    return chunks(s, d, "text").select(F.col("chunk_id").alias("id"), "text").unionByName(extra)


def citations(s: SparkSession, d: str) -> DataFrame:
    return CI.extract(citing(s, d), "id", "text")


def _numeral(x: str) -> str:
    """A number or roman numeral in SQL; roman values up to 85 are enough for what is cited."""
    return f"coalesce(CASE WHEN regexp_full_match({x}, '[0-9]{{1,9}}') THEN {x}::INTEGER END, (SELECT v FROM roman WHERE r = upper({x})))"


def _roman(n: int) -> str:
    out = ""
    for value, letters in ((50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while n >= value:
            out, n = out + letters, n - value
    return out


_ROMAN = "roman(r, v) AS (VALUES " + ", ".join(f"('{_roman(n)}', {n})" for n in range(1, 86)) + ")"
_SRC = f"{C}, src AS (SELECT chunk_id AS id, coalesce(text, '') AS text FROM c UNION ALL VALUES " + ", ".join(f"('{i}', '{t}')" for i, t in SENTENCES) + ")"
_ORD = "ord(w, n) AS (VALUES " + ", ".join(f"('{w}', {i + 1})" for i, w in enumerate(CI.ORDINALS)) + ")"
_CITE = f"""WITH RECURSIVE {_SRC}, {_ROMAN}, {_ORD},
m1 AS (SELECT id, unnest(regexp_extract_all(text, '(?i)\\barticle\\b[ \\t\\n\\f\\r]*([0-9A-Za-z]+)(?:[ ,\\t]*section[ \\t\\n\\f\\r]*([0-9A-Za-z]+))?', 1)) AS a, unnest(regexp_extract_all(text, '(?i)\\barticle\\b[ \\t\\n\\f\\r]*([0-9A-Za-z]+)(?:[ ,\\t]*section[ \\t\\n\\f\\r]*([0-9A-Za-z]+))?', 2)) AS s FROM src),
m2 AS (SELECT id, unnest(regexp_extract_all(text, '(?i)\\bamendment\\b[ \\t\\n\\f\\r]*([0-9A-Za-z]+)', 1)) AS a FROM src),
m3 AS (SELECT id, lower(unnest(regexp_extract_all(text, '(?i)\\b({'|'.join(o for o in CI.ORDINALS if '-' in o)})\\s+amendment\\b', 1))) AS w FROM src UNION ALL SELECT id, lower(unnest(regexp_extract_all(text, '(?i)\\b({'|'.join(o for o in CI.ORDINALS if '-' not in o)})\\s+amendment\\b', 1))) FROM src),
m4 AS (SELECT id, lower(unnest(regexp_extract_all(text, '(?i)\\b(federalist|brutus|cato|centinel)\\b[ ,\\t.]*(?:no\\.|no|number|paper|letter)[\\s.]*([0-9A-Za-z]+)', 1))) AS w, unnest(regexp_extract_all(text, '(?i)\\b(federalist|brutus|cato|centinel)\\b[ ,\\t.]*(?:no\\.|no|number|paper|letter)[\\s.]*([0-9A-Za-z]+)', 2)) AS a FROM src),
m5 AS (SELECT id, lower(unnest(regexp_extract_all(text, '(?i)\\b({'|'.join(CI.PERSONS)})\\b', 1))) AS w FROM src),
x1 AS (SELECT id, {_numeral('a')} AS n, CASE WHEN s <> '' THEN {_numeral('s')} END AS k FROM m1), x2 AS (SELECT id, {_numeral('a')} AS n FROM m2), x4 AS (SELECT id, w, {_numeral('a')} AS n FROM m4),
cit AS (SELECT id, 'clause' AS kind, ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII'][n] || coalesce('.' || k, '') AS target FROM x1 WHERE n BETWEEN 1 AND 7 UNION ALL SELECT id, 'clause', 'Amend.' || n FROM x2 WHERE n BETWEEN 1 AND 27
UNION ALL SELECT id, 'clause', 'Amend.' || ord.n FROM m3 JOIN ord USING (w) UNION ALL SELECT id, 'essay', w || ':' || n FROM x4 WHERE n BETWEEN 1 AND 85 UNION ALL SELECT id, 'person', w FROM m5),
k AS (SELECT id, kind, target, kind || ':' || target AS key FROM cit)"""
_CITE = _CITE.replace("WITH RECURSIVE", "WITH")
R.add("citations", lambda s, d: citations(s, d).groupBy("id", "kind", "target", "key").agg(F.count("*").alias("n")), _CITE + " SELECT id, kind, target, key, count(*) AS n FROM k GROUP BY ALL")
_PLACED = {
    "m1": (r"(?i)\barticle\b[ \t\n\f\r]*([0-9A-Za-z]+)(?:[ ,\t]*section[ \t\n\f\r]*([0-9A-Za-z]+))?", 2),
    "m2": (r"(?i)\bamendment\b[ \t\n\f\r]*([0-9A-Za-z]+)", 1),
    "m3": (rf"(?i)\b({'|'.join(o for o in CI.ORDINALS if '-' in o)})\s+amendment\b", 1),
    "m4": (rf"(?i)\b({'|'.join(o for o in CI.ORDINALS if '-' not in o)})\s+amendment\b", 1),
    "m5": (rf"(?i)\b({'|'.join(CI.SERIES)})\b[ ,\t.]*(?:no\.|no|number|paper|letter)[\s.]*([0-9A-Za-z]+)", 2),
    "m6": (rf"(?i)\b({'|'.join(CI.PERSONS)})\b", 1),
}


def _placed_sql() -> str:
    """Every match with its groups and place: the bytes of the lower-cased pieces and matches before it."""
    parts = []
    for name, (pattern, groups) in _PLACED.items():
        quoted = pattern.replace("'", "''")
        second = f"regexp_extract_all(text, '{quoted}', 2)" if groups > 1 else "NULL::VARCHAR[]"
        size = "strlen(lower(x))"
        parts.append(f"""{name}a AS (SELECT id, regexp_extract_all(text, '{quoted}', 0) AS m, regexp_extract_all(text, '{quoted}', 1) AS g, {second} AS h, regexp_split_to_array(text, '{quoted}') AS p FROM src),
{name} AS (SELECT id, m[i] AS whole, g[i] AS a, h[i] AS s, (coalesce(list_sum(list_transform(p[:i], lambda x: {size})), 0) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: {size})), 0))::INTEGER AS place FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}a))""")
    return f"""WITH {_SRC}, {_ROMAN}, {_ORD}, {', '.join(parts)},
x1 AS (SELECT *, {_numeral('a')} AS n, CASE WHEN s <> '' THEN {_numeral('s')} END AS k FROM m1), x2 AS (SELECT *, {_numeral('a')} AS n FROM m2), x5 AS (SELECT *, {_numeral('s')} AS n FROM m5),
k AS (SELECT id, 'clause' AS kind, ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII'][n] || coalesce('.' || k, '') AS target, place, whole FROM x1 WHERE n BETWEEN 1 AND 7 UNION ALL SELECT id, 'clause', 'Amend.' || n, place, whole FROM x2 WHERE n BETWEEN 1 AND 27
UNION ALL SELECT id, 'clause', 'Amend.' || ord.n, place, whole FROM (SELECT * FROM m3 UNION ALL SELECT * FROM m4) z JOIN ord ON ord.w = lower(a) UNION ALL SELECT id, 'essay', lower(a) || ':' || n, place, whole FROM x5 WHERE n BETWEEN 1 AND 85 UNION ALL SELECT id, 'person', lower(a), place, whole FROM m6)
SELECT id, kind, target, kind || ':' || target AS key, place AS byte_offset, whole AS matched_text FROM k"""


R.add("citation_places", lambda s, d: citations(s, d), _placed_sql())
R.add("citations_top", lambda s, d: CI.top_targets(citations(s, d), 12), _CITE + " SELECT key, count(*) AS n FROM k GROUP BY key ORDER BY n DESC, key LIMIT 12")
R.add("citations_to", lambda s, d: CI.cited_by(citations(s, d), "clause:II").join(chunks(s, d, "date"), F.col("id") == F.col("chunk_id")).select("id", "date").distinct().orderBy("date", "id").limit(80), _CITE + " SELECT id, date FROM (SELECT DISTINCT id, date FROM k JOIN c ON c.chunk_id = id WHERE key = 'clause:II') ORDER BY date NULLS FIRST, id LIMIT 80")
R.add("citation_graph", lambda s, d: CI.co_citation(citations(s, d), 30)[1], _CITE + ", top AS (SELECT key FROM k GROUP BY key ORDER BY count(*) DESC, key LIMIT 30), p AS (SELECT DISTINCT id, key FROM k JOIN top USING (key)) SELECT a.key AS source, b.key AS target, count(*) AS weight FROM p a JOIN p b ON a.id = b.id AND a.key < b.key GROUP BY ALL")
R.add("citation_kinds", lambda s, d: citations(s, d).groupBy(CI.key_kind(F.col("key")).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("texts")), _CITE + " SELECT kind, count(*) AS n, count(DISTINCT id) AS texts FROM k GROUP BY kind")
R.add("citations_from", lambda s, d: CI.outgoing(citations(s, d)).select("id", "key", "n"), _CITE + " SELECT id, key, count(*) AS n FROM k GROUP BY ALL")
_SPANS = _placed_sql().replace("WITH ", "WITH RECURSIVE ", 1)
_SPANS = _SPANS[: _SPANS.rindex("\nSELECT")] + """, sp AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY st, en, key) AS n FROM (SELECT id, place AS st, (place + strlen(whole))::INTEGER AS en, kind || ':' || target AS key FROM k)),
w AS (SELECT id, n, st, en, key, TRUE AS kept, en AS upto FROM sp WHERE n = 1 UNION ALL SELECT sp.id, sp.n, sp.st, sp.en, sp.key, sp.st >= w.upto, CASE WHEN sp.st >= w.upto THEN sp.en ELSE w.upto END FROM w JOIN sp ON sp.id = w.id AND sp.n = w.n + 1)
SELECT id, st AS start, en AS "end", key FROM w WHERE kept"""
R.add("annotated_spans", lambda s, d: CI.annotated_spans(citations(s, d)), _SPANS)

# graphs
_CH = ("document_id", "source_collection", "author", "title", "pos", CLAUSES, ISSUES)


def graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return G.property_graph(chunks(s, d, *_CH))


_SID = lambda p, c: f"'{p}:' || sha1({c})[:16]"
_EDGES = f"""WITH {C}, e AS (SELECT 'chunk:' || chunk_id AS source, 'document:' || coalesce(document_id, '') AS target, 'belongs_to_document' AS type FROM c UNION ALL SELECT 'document:' || coalesce(document_id, ''), 'collection:' || coalesce(source_collection, ''), 'belongs_to_collection' FROM c
UNION ALL SELECT 'document:' || coalesce(document_id, ''), {_SID('author', "coalesce(author, '')")}, 'authored_by' FROM c UNION ALL SELECT 'chunk:' || chunk_id, {_SID('issue', 't')}, 'has_issue' FROM (SELECT chunk_id, unnest({IK}) AS t FROM c) UNION ALL SELECT 'chunk:' || chunk_id, {_SID('clause', 't')}, 'mentions_clause' FROM (SELECT chunk_id, unnest({CK}) AS t FROM c))"""
R.add("graph_edges", lambda s, d: graph(s, d)[1], _EDGES + " SELECT source, target, type, count(*) AS weight FROM e GROUP BY ALL")
R.add("graph_nodes", lambda s, d: graph(s, d)[0].groupBy("type").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")), _EDGES + """, n AS (SELECT source AS id FROM e UNION SELECT target FROM e), t AS (SELECT id, split_part(id, ':', 1) AS type FROM n) SELECT type, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM t GROUP BY type""")


def tag_edges(s: SparkSession, d: str) -> DataFrame:
    return A.pair_network(chunks(s, d, CLAUSES), A.tags_of(CLAUSES), None).where("source <> target and weight >= 3 and trim(source) <> '' and trim(target) <> ''")


_PAIRS = f"e0 AS (SELECT chunk_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT chunk_id, {CK} AS t FROM c)), p AS (SELECT least(a.t[a.i], b.t[b.i]) AS source, greatest(a.t[a.i], b.t[b.i]) AS target FROM e0 a JOIN e0 b ON a.chunk_id = b.chunk_id AND a.i < b.i), e AS (SELECT source, target, count(*) AS weight FROM p WHERE source <> target AND trim(source) <> '' AND trim(target) <> '' GROUP BY ALL HAVING count(*) >= 3), u AS (SELECT source, target FROM e UNION SELECT target, source FROM e)"
R.add("graph_connections", lambda s, d: G.strongest(tag_edges(s, d), "I.8", 15), f"WITH {C}, {_PAIRS} SELECT source, target, weight FROM (SELECT source, target, weight FROM e UNION ALL SELECT target, source, weight FROM e) WHERE source = 'I.8' ORDER BY weight DESC, target LIMIT 15")
_EGO = f"WITH RECURSIVE {C}, {_PAIRS}, r(node, distance) AS (SELECT 'I.8', 0 UNION SELECT target, distance + 1 FROM r JOIN u ON u.source = r.node WHERE distance < 2), z AS (SELECT node, min(distance)::INTEGER AS distance FROM r GROUP BY node)"
R.add("graph_ego", lambda s, d: G.ego(tag_edges(s, d), "I.8", 2, 500)[0], _EGO + " SELECT node, distance FROM z")
R.add("graph_ego_edges", lambda s, d: G.ego(tag_edges(s, d), "I.8", 2, 500)[1], _EGO + " SELECT u.source, u.target FROM u JOIN z ON z.node = u.source WHERE z.distance < 2 AND u.source < u.target")
_FROM, _TO = "collection:court_records", "collection:correspondence"
_PATH = _EDGES.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + f""", u AS (SELECT source, target FROM e UNION SELECT target, source FROM e),
r(node, step) AS (SELECT '{_FROM}', 0 UNION SELECT target, step + 1 FROM r JOIN u ON u.source = r.node WHERE step < 8), z AS (SELECT node, min(step) AS step FROM r GROUP BY node),
p AS (SELECT b.node, b.step, min(a.node) AS parent FROM z b JOIN u ON u.target = b.node JOIN z a ON a.node = u.source AND a.step = b.step - 1 GROUP BY ALL),
w(node, step) AS (SELECT node, step FROM z WHERE node = '{_TO}' UNION ALL SELECT p.parent, w.step - 1 FROM w JOIN p ON p.node = w.node WHERE w.step > 0)
SELECT step::INTEGER AS step, node FROM w"""
R.add("graph_path", lambda s, d: G.shortest_path(G.property_graph(chunks(s, d, *_CH))[1], _FROM, _TO), _PATH)


def named_entities(s: SparkSession, d: str) -> DataFrame:
    """chunk_id, entities: the register's persons by surname, its bodies and the catalogue's titles by name, that stand in each chunk."""
    surname = F.substring_index(F.regexp_replace("name", r" Jr\.$", ""), " ", -1)
    people = read_table(s, d, "delegates").where("name is not null").select(F.when(F.col("kind") == "person", surname).otherwise(F.col("name")).alias("entry"))
    works = read_table(s, d, "manifest").where("title is not null").select(F.col("title").alias("entry"))
    register = people.union(works).distinct().select("entry", F.array("entry").alias("names"))
    found = J.names_in_texts(chunks(s, d, "text"), "chunk_id", F.col("text"), register)
    return found.groupBy(F.col("id").alias("chunk_id")).agg(F.collect_set("entry").alias("entities"))


R.add("entity_graph", lambda s, d: G.entity_co_occurrence(named_entities(s, d), "chunk_id", F.col("entities"))[1], rf"""WITH {C}, g AS (SELECT DISTINCT CASE WHEN kind = 'person' THEN string_split(regexp_replace(name, ' Jr\.$', ''), ' ')[-1] ELSE name END AS e FROM delegates WHERE name IS NOT NULL UNION SELECT title FROM manifest WHERE title IS NOT NULL),
t AS (SELECT DISTINCT chunk_id, e FROM c JOIN g ON contains(lower(text), lower(e)) AND regexp_matches(text, '(?i)\b' || replace(replace(replace(e, '.', '\.'), '(', '\('), ')', '\)') || '\b'))
SELECT a.e AS source, b.e AS target, count(*) AS weight FROM t a JOIN t b ON a.chunk_id = b.chunk_id AND a.e < b.e GROUP BY ALL HAVING count(*) >= 3""")  # fmt: skip

# timeline: five events
EVENTS = [
    ("e2", "1787-05-25", "convention", "The Convention opens", "Delegates meet at Wendibury.", ["Oskmont", "Kittden"], ["Wendibury"], 1),
    ("e1", "1786-09-11", "debate", "A meeting at Caelhaven", "Commerce is debated.", ["Ullerby"], ["Caelhaven"], 2),
    ("e3", "1787-09-17", "convention", "The signing", "The plan is signed.", ["Oskmont"], ["Wendibury"], 0),
    ("e4", "1788-06-21", "ratification", "Ninth state", "The plan takes effect.", [], ["Neviston"], 3),
    ("e5", "1791-12-15", "amendment", "Ten amendments", "The first ten are added.", ["Kittden"], [], 0),
]


def events(s: SparkSession, d: str) -> DataFrame:
    """The events, each with the first chunks of the archive as its sources and one id that no chunk has."""
    base = s.createDataFrame(EVENTS, "id string, date string, phase string, title string, summary string, actors array<string>, locations array<string>, k int")
    first = [r.chunk_id for r in chunks(s, d, "pos").orderBy("pos", "chunk_id").limit(3).collect()]
    return base.withColumn("source_chunks", F.concat(F.slice(F.array(*map(F.lit, first)), F.lit(1), F.col("k")), F.array(F.lit("no_such_chunk")))).drop("k")


_EV = f"{C}, f AS (SELECT list(chunk_id ORDER BY pos, chunk_id)[:3] AS f FROM (SELECT chunk_id, pos FROM c ORDER BY pos, chunk_id LIMIT 3)), ev AS (SELECT id, date, phase, title, summary, actors, locations, list_concat(f[:k], ['no_such_chunk']) AS source_chunks FROM (VALUES " + ", ".join(f"('{i}', '{dt}', '{ph}', '{ti}', '{su}', {a}::VARCHAR[], {lo}::VARCHAR[], {k})" for i, dt, ph, ti, su, a, lo, k in EVENTS) + ") v(id, date, phase, title, summary, actors, locations, k), f)"
R.add("timeline", lambda s, d: events(s, d).orderBy("date", "id").select("id", "date", "phase"), f"WITH {_EV} SELECT id, date, phase FROM ev")
R.add("timeline_phase", lambda s, d: events(s, d).where(F.col("phase") == "convention").select("id"), f"WITH {_EV} SELECT id FROM ev WHERE phase = 'convention'")
R.add("timeline_date", lambda s, d: events(s, d).where(F.startswith("date", F.lit("1787"))).select("id"), f"WITH {_EV} SELECT id FROM ev WHERE starts_with(date, '1787')")
R.add("timeline_text", lambda s, d: events(s, d).where(FL.event_text("KITTden")).select("id"), f"WITH {_EV} SELECT id FROM ev WHERE contains(lower(title), 'kittden') OR contains(lower(summary), 'kittden') OR len(list_filter(list_concat(actors, locations), lambda x: contains(lower(x), 'kittden'))) > 0")
R.add("timeline_by_phase", lambda s, d: A.status_counts(events(s, d), "phase", ("amendment", "convention", "debate", "implementation", "ratification")), f"WITH {_EV}, l AS (SELECT unnest(['amendment', 'convention', 'debate', 'implementation', 'ratification']) AS status) SELECT status, count(ev.id) AS n FROM l LEFT JOIN ev ON phase = status GROUP BY status")
R.add("event_chunks", lambda s, d: J.array_reference(events(s, d), "id", "source_chunks", chunks(s, d), "chunk_id").select(F.col("left_id").alias("event"), F.col("place").cast("int").alias("place"), F.col("right_id").alias("chunk_id")), f"WITH {_EV}, x AS (SELECT id, source_chunks AS s, unnest(range(len(source_chunks))) AS i FROM ev) SELECT id AS event, i::INTEGER AS place, s[i + 1] AS chunk_id FROM x WHERE s[i + 1] IN (SELECT chunk_id FROM c)")
R.add("chunk_events", lambda s, d: events(s, d).select("id", F.explode("source_chunks").alias("chunk_id")).join(chunks(s, d).select("chunk_id"), "chunk_id").groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_list("id")), "|").alias("events")), f"WITH {_EV}, x AS (SELECT id, unnest(source_chunks) AS chunk_id FROM ev) SELECT chunk_id, string_agg(id, '|' ORDER BY id) AS events FROM x WHERE chunk_id IN (SELECT chunk_id FROM c) GROUP BY chunk_id")

# joins
R.add("manifest_metadata", lambda s, d: chunks(s, d, "document_id", "title").join(read_table(s, d, "manifest").select("document_id", F.col("title").alias("listed"), "source_format"), "document_id", "left").select("chunk_id", F.coalesce("listed", "title").alias("title"), F.coalesce("source_format", F.lit("none")).alias("format")), f"WITH {C} SELECT chunk_id, coalesce(m.title, c.title) AS title, coalesce(source_format, 'none') AS format FROM c LEFT JOIN manifest m USING (document_id)")


def names(s: SparkSession, d: str) -> list[tuple[str, str]]:
    return [(r.id, r.name) for r in read_table(s, d, "delegates").select("id", "name").orderBy("id").collect()]  # the register of names, taken in blocks


R.add("author_names", lambda s, d: J.author_holds_name(chunks(s, d, "author"), "chunk_id", "author", names(s, d)), f"WITH {C} SELECT chunk_id AS id, g.id AS entry FROM c JOIN delegates g ON contains(lower(author), lower(name)) AND len(name) > 4")
R.add("phrase_hits", lambda s, d: J.phrase_hits(chunks(s, d, "text"), "chunk_id", F.coalesce("text", F.lit("")), [("paper", ["scarcity of paper", "the price of flour"]), ("roads", ["state of the roads"])]), rf"""WITH {C}, x AS (SELECT chunk_id AS id, 'paper' AS entry, len(regexp_extract_all(coalesce(text, ''), '(?i)\b(?:scarcity\s+of\s+paper|the\s+price\s+of\s+flour)\b'))::INTEGER AS score FROM c UNION ALL SELECT chunk_id, 'roads', len(regexp_extract_all(coalesce(text, ''), '(?i)\b(?:state\s+of\s+the\s+roads)\b'))::INTEGER FROM c) SELECT * FROM x WHERE score > 0""")


def author_dates(s: SparkSession, d: str) -> DataFrame:
    targets = read_table(s, d, "delegates").where("kind = 'person' and born is not null and died is not null").select(F.col("id").alias("target"), F.col("name").alias("author"), F.col("born").alias("start"), F.col("died").alias("end"))
    records = chunks(s, d, "author", "date").where("author is not null").withColumn("authors", F.array("author"))
    return J.author_in_range(records, "chunk_id", targets)


R.add("author_in_range", author_dates, f"WITH {C} SELECT DISTINCT chunk_id AS id, g.id AS target FROM c JOIN delegates g ON author = name AND date >= born AND date <= died WHERE kind = 'person' AND born IS NOT NULL AND died IS NOT NULL")
R.add("same_author", lambda s, d: J.same_author(read_table(s, d, "documents").withColumn("authors", F.array("author")).where("author is not null"), "doc_id", "authors", read_table(s, d, "delegates").select(F.col("id").alias("entry"), "name"), 5), "WITH m AS (SELECT DISTINCT g.id AS entry, doc_id AS id FROM documents JOIN delegates g ON lower(trim(documents.author)) = lower(trim(g.name))) SELECT entry, id, rank FROM (SELECT *, (row_number() OVER (PARTITION BY entry ORDER BY id))::INTEGER AS rank FROM m) WHERE rank <= 5")
R.add("chunks_by_place", lambda s, d: chunks(s, d, "document_id").select(F.explode(F.array_distinct(F.split("document_id", "_"))).alias("place"), "chunk_id").groupBy("place").agg(F.count("*").alias("n")), f"WITH {C} SELECT place, count(*) AS n FROM (SELECT chunk_id, unnest(list_distinct(string_split(document_id, '_'))) AS place FROM c) GROUP BY place")
R.add("missing_entries", lambda s, d: J.missing(read_table(s, d, "delegates"), "manifest_entry", read_table(s, d, "manifest"), "document_id"), "SELECT DISTINCT manifest_entry FROM delegates WHERE manifest_entry IS NOT NULL AND manifest_entry NOT IN (SELECT document_id FROM manifest)")
R.add("available_sources", lambda s, d: read_table(s, d, "manifest").join(chunks(s, d, "document_id", "text").where("trim(coalesce(text, '')) <> ''").select("document_id"), "document_id", "left_semi").groupBy("collection_id").agg(F.count("*").alias("n")), f"WITH {C} SELECT collection_id, count(*) AS n FROM manifest WHERE document_id IN (SELECT document_id FROM c WHERE trim(coalesce(text, '')) <> '') GROUP BY 1")
R.add("skipped_sources", lambda s, d: J.missing(read_table(s, d, "manifest"), "document_id", chunks(s, d, "document_id"), "document_id"), f"WITH {C} SELECT document_id FROM manifest WHERE document_id NOT IN (SELECT document_id FROM c WHERE document_id IS NOT NULL)")


def siblings(s: SparkSession, d: str) -> DataFrame:
    df = chunks(s, d, "document_id", "pos")
    first = df.where("document_id = 'records_wendibury_1801_000'").agg(F.min("chunk_id").alias("c")).first().c
    return J.siblings(df, first or "")


R.add("siblings", siblings, f"WITH {C}, o AS (SELECT min(chunk_id) AS own FROM c WHERE document_id = 'records_wendibury_1801_000') SELECT chunk_id, pos FROM c, o WHERE document_id = 'records_wendibury_1801_000' AND chunk_id <> own ORDER BY pos, chunk_id LIMIT 8")

# kept tables
R.add("latest_delivery", lambda s, d: T.latest(read_table(s, d, "documents"), ["id"], F.desc("ingested_at"), F.desc("doc_id")).select("id", "doc_id"), "SELECT id, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, doc_id DESC) = 1")
R.add("upserted", lambda s, d: T.upsert(read_table(s, d, "orders").select("o_orderkey", "o_orderstatus"), read_table(s, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", F.lit("N").alias("o_orderstatus")), ["o_orderkey"]), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders")
R.add("inserted", lambda s, d: T.insert_ignore(read_table(s, d, "supplier").where("s_acctbal >= 0").select("s_suppkey", "s_name"), read_table(s, d, "supplier").select("s_suppkey", F.lit("new").alias("s_name")), ["s_suppkey"]), "SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_name ELSE 'new' END AS s_name FROM supplier")
R.add("recency_list", lambda s, d: T.recency(read_table(s, d, "events"), "user_id", "event_type", "ts", 3), "SELECT user_id, event_type, ts, rank FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type))::INTEGER AS rank FROM (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY ALL)) WHERE rank <= 3")
R.add("occurrences", lambda s, d: T.numbered(chunks(s, d, "document_id", "pos", "title"), ["document_id", "title"], F.col("pos"), F.col("chunk_id")).select("chunk_id", "occurrence"), f"WITH {C} SELECT chunk_id, (row_number() OVER (PARTITION BY document_id, title ORDER BY pos, chunk_id))::INTEGER AS occurrence FROM c")
R.add("page_of_results", lambda s, d: T.page(chunks(s, d, "pos"), ["pos", "chunk_id"], 40, 20).select("chunk_id"), f"WITH {C} SELECT chunk_id FROM c ORDER BY pos, chunk_id OFFSET 40 LIMIT 20")
R.add("snapshot_diff", lambda s, d: T.difference(read_table(s, d, "documents").select("id", "n_chars"), T.latest(read_table(s, d, "documents"), ["id"], F.desc("ingested_at"), F.desc("doc_id")).select("id", "n_chars")), "WITH n AS (SELECT id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, doc_id DESC) = 1) SELECT id, n_chars, 'left' AS side FROM (SELECT id, n_chars FROM documents EXCEPT ALL FROM n) UNION ALL SELECT id, n_chars, 'right' FROM (FROM n EXCEPT ALL SELECT id, n_chars FROM documents)")
R.add("first_labels", lambda s, d: graph(s, d)[0].where("type = 'document'").select("id", "label"), f"WITH {C} SELECT 'document:' || coalesce(document_id, '') AS id, coalesce(arg_min(title, (pos, chunk_id)), '') AS label FROM c GROUP BY 1")
R.add("transcripts_flat", lambda s, d: RD.flatten_speech(read_table(s, d, "casetranscripts")).select("transcript_id", F.md5("text").alias("digest"), F.length("text").alias("n")), """WITH r AS (SELECT DISTINCT ON (seg_id) * FROM casetranscripts WHERE text IS NOT NULL AND text <> ''), x AS (SELECT transcript_id, string_agg('[' || coalesce(speakername, 'Unknown') || ']: ' || text, chr(10) || chr(10) ORDER BY start, seg_id) AS text FROM r GROUP BY 1)
SELECT transcript_id, md5(text) AS digest, len(text)::INTEGER AS n FROM x""")  # fmt: skip
R.add("pending_work", lambda s, d: RD.landing(read_table(s, d, "manifest"), chunks(s, d, "document_id").select("document_id"), "document_id").groupBy("status").agg(F.count("*").alias("n")), f"WITH {C} SELECT CASE WHEN document_id IN (SELECT document_id FROM c) THEN 'cached' ELSE 'pending' END AS status, count(*) AS n FROM manifest GROUP BY 1")
R.add("candidate_editions", lambda s, d: RD.candidates(read_table(s, d, "manifest"), "document_id", "title", ["wendibury", "Neviston", "hest"], s.createDataFrame([("records_wendibury_1801_000",)], "id string")).select("document_id"), "SELECT document_id FROM manifest WHERE (contains(lower(concat_ws(' ', document_id, title)), 'wendibury') OR contains(lower(concat_ws(' ', document_id, title)), 'neviston') OR contains(lower(concat_ws(' ', document_id, title)), 'hest')) AND document_id <> 'records_wendibury_1801_000'")
