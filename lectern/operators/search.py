"""Full-text search: postings, BM25, relevance by counting, fuzzy terms, suggestions, snippets.

There are two ways to a ranked result. ``PostingIndex`` keeps long tables of terms
(written once, clustered by term, and read by many queries: a query touches its terms
only). ``bm25_scan`` needs no index: one scan counts the query's terms for the corpus
statistics, one scores the texts; nothing is shuffled but the top rows.

Scores use statistics of the whole corpus; filters only drop rows from the scoring.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.runtime import keep

K1, B, FUZZY_WEIGHT, MOST_EXPANSIONS = 1.5, 0.75, 0.5, 3


def idf(n: float, df: Column) -> Column:
    return F.log((F.lit(n) - df + 0.5) / (df + 0.5) + 1.0)


def term_score(tf: Column, dl: Column, avgdl: Column) -> Column:
    """The saturation of a term's count, with the guards against empty corpora."""
    denominator = tf + K1 * (1 - B + B * dl / F.greatest(avgdl, F.lit(1.0)))
    return tf * (K1 + 1) / F.greatest(denominator, F.lit(1e-6))


@dataclass
class PostingIndex:
    """term, id, tf, dl (the length of the text, so that no search joins lengths); id, dl of every text (empty ones too); term, df, cf."""

    postings: DataFrame
    stats: DataFrame
    terms: DataFrame
    _cached: DataFrame | None = None
    _size: tuple[int, float] | None = None

    @staticmethod
    def build(df: DataFrame, id_col: str, tokens: Column, *, cached: bool = False) -> PostingIndex:
        """From a table with one row an id. Texts are tokenised once for all tables if they are cached; counts are added before the shuffle."""
        tokenised = df.select(F.col(id_col).alias("id"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))
        # a row without a term for each text; the outer generator keeps the tokenizer out of filters that would be inferred
        each = tokenised.select("id", F.size("tokens").alias("dl"), F.explode_outer(F.concat(F.array(F.lit(None).cast("string")), "tokens")).alias("term"))
        rows = each.groupBy("term", "id", "dl").agg(F.count("*").cast("int").alias("tf"))
        if cached:
            rows = keep(rows)
        postings = rows.where("term is not null").select("term", "id", "tf", "dl")
        return PostingIndex(postings, rows.where("term is null").select("id", "dl"), postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), rows if cached else None)

    def release(self) -> None:
        """Give up what ``build`` cached."""
        if self._cached is not None:
            self._cached.unpersist()

    def save(self, path: str) -> None:
        """Tables of a folder: postings in order of term and id (a frequent term is spread over files), lengths, terms in order."""
        for name, df, order in (("postings", self.postings, ["term", "id"]), ("lengths", self.stats, None), ("terms", self.terms, ["term"])):
            (df if order is None else df.repartitionByRange(*order).sortWithinPartitions(*order)).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def kept(df: DataFrame, id_col: str, tokens: Column, path: str) -> PostingIndex:
        """Built into a folder and opened: one pass over the texts, then one range shuffle of their postings."""
        index = PostingIndex.build(df, id_col, tokens, cached=True)
        index.save(path)
        index.release()
        return PostingIndex.open(df.sparkSession, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> PostingIndex:
        return PostingIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "terms")))

    def corpus(self) -> tuple[int, float]:
        if self._size is None:
            row = self.stats.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
            self._size = (row.n, row.avgdl or 0.0)
        return self._size

    def frequencies(self) -> DataFrame:
        """term, df, cf."""
        return self.terms

    def _known(self, terms: Sequence[str]) -> dict[str, tuple[int, int]]:
        """df, cf of those of a query's terms that the corpus has."""
        return {r.term: (r.df, r.cf) for r in self.terms.where(F.col("term").isin(*terms)).collect()} if terms else {}  # a row a term of the query

    def expand(self, terms: Sequence[str], distance: int) -> list[tuple[str, float]]:
        """Terms with weights: one that the corpus lacks gives way to at most three near terms, at half weight.

        Terms are taken in order; a near term that is already listed is skipped, an exact
        one that comes later is listed again.
        """
        near = self._near(list(dict.fromkeys(terms)), distance)
        out: list[tuple[str, float]] = []
        for t in terms:
            if t in near.get(t, ()):
                out.append((t, 1.0))
            elif distance > 0:
                out += [(x, FUZZY_WEIGHT) for x in near.get(t, ()) if x not in {y for y, _ in out}]
        return out

    def _near(self, terms: Sequence[str], distance: int) -> dict[str, list[str]]:
        """The three nearest terms of the corpus to each of the query's, itself first, in one pass over the vocabulary."""
        if not terms:
            return {}
        q = F.array(*(F.struct(F.lit(t).alias("asked"), F.lit(len(t)).alias("n")) for t in terms))
        met = self.terms.select("term", F.explode(F.filter(q, lambda x: F.abs(F.length("term") - x["n"]) <= distance)).alias("x"))
        far = met.select("term", "x.asked", F.expr(f"levenshtein(term, x.asked, {int(distance)})").alias("distance")).where("distance >= 0")
        best = far.withColumn("r", F.row_number().over(Window.partitionBy("asked").orderBy("distance", "term"))).where(F.col("r") <= MOST_EXPANSIONS)
        out: dict[str, list[str]] = {}
        for r in best.orderBy("asked", "r").collect():  # three rows a term
            out.setdefault(r.asked, []).append(r.term)
        return out

    def bm25_or(self, terms: Sequence[tuple[str, float]], allowed: DataFrame | None = None, min_score: float | None = None) -> DataFrame:
        """id, score, matched_terms of the texts with any of the terms; a repeated term counts as often as it is asked.

        The query's terms are a filter on the postings that reaches the scan.
        """
        total: dict[str, float] = {}
        for t, w in terms:
            total[t] = total.get(t, 0.0) + w
        n, avgdl = self.corpus()
        known = self._known([*total])
        rows = self.postings.where(F.col("term").isin(*known))
        if allowed is not None:
            rows = rows.join(allowed.select("id"), "id", "left_semi")
        part = _by_term({t: F.lit(total[t]) * idf(float(n), F.lit(float(df))) for t, (df, _) in known.items()}) * term_score(F.col("tf"), F.col("dl"), F.lit(float(avgdl)))
        out = rows.groupBy("id").agg(F.sum(part).alias("score"), F.array_sort(F.collect_set("term")).alias("matched_terms"))
        return out if min_score is None else out.where(F.col("score") >= min_score)

    def bm25_and(self, terms: Sequence[str], parity: bool = False) -> DataFrame:
        """id, score of the texts that hold every term.

        ``parity`` counts a term's occurrences instead of its texts in the idf (which can
        then be negative) and repeats a row as often as the last term stands in the text.
        """
        weight = Counter(terms)
        known = self._known([*weight])
        if not weight or len(known) < len(weight):
            return self.stats.select("id", F.lit(0.0).alias("score")).limit(0)
        n, avgdl = self.corpus()
        own = lambda df, cf: F.log((F.lit(float(n)) + 1) / (F.lit(float(cf)) + 0.5)) if parity else idf(float(n), F.lit(float(df)))
        part = _by_term({t: F.lit(float(weight[t])) * own(*f) for t, f in known.items()}) * term_score(F.col("tf"), F.col("dl"), F.lit(float(avgdl)))
        last = F.max(F.when(F.col("term") == terms[-1], F.col("tf")))
        hit = self.postings.where(F.col("term").isin(*weight))
        out = hit.groupBy("id").agg(F.sum(part).alias("score"), F.count("*").alias("found"), last.alias("last_tf")).where(F.col("found") == len(weight))
        if parity:
            out = out.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("last_tf"))))
        return out.select("id", "score")


def _by_term(values: dict[str, Column]) -> Column:
    """The value of each row's term; the terms of one query."""
    out = F.lit(None).cast("double")
    for t, v in values.items():
        out = F.when(F.col("term") == t, v).otherwise(out)
    return out


def bm25_scan(df: DataFrame, id_col: str, tokens: Column, terms: Sequence[str], where: Column | None = None) -> DataFrame:
    """id, score without an index: the query's words are counted in each text as it is read."""
    asked = Counter(terms)
    if not asked:
        return df.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    count = lambda t: F.size(F.filter("tokens", lambda x: x == t))
    tokenised = df.select(F.col(id_col).alias("id"), (F.lit(True) if where is None else where).alias("allowed"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))
    counted = F.struct(F.size("tokens").cast("double").alias("dl"), *(count(t).cast("double").alias(f"tf{i}") for i, t in enumerate(asked)))
    # through a generator, for a filter on counts would otherwise be pushed down with the tokenizer inside it
    row = tokenised.select("id", "allowed", F.explode(F.array(counted)).alias("x")).select("id", "allowed", "x.*")
    seen = row.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked)))).first()
    score = F.lit(0.0)
    for i, w in enumerate(asked.values()):
        score = score + float(w) * idf(float(seen.n), F.lit(float(seen[f"df{i}"]))) * term_score(F.col(f"tf{i}"), F.col("dl"), F.lit(float(seen.avgdl or 0.0)))
    any_term = " + ".join(f"tf{i}" for i in range(len(asked)))
    return row.where(f"allowed and {any_term} > 0").select("id", score.alias("score"))


def top(df: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best by rounded score, ties by id."""
    return df.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), "id").limit(k)


# terms -------------------------------------------------------------------------


def fuzzy_terms(terms: DataFrame, query: str, distance: int, limit: int) -> DataFrame:
    """term, distance of the terms (one row each) within an edit distance: nearest first, then by term.

    Lengths are compared before letters; the vocabulary is scanned, texts are not.
    """
    q = F.lit(query)
    near = terms.select("term").where(F.abs(F.length("term") - F.lit(len(query))) <= distance)
    d = F.levenshtein(F.col("term"), q, distance)
    return near.select("term", d.alias("distance")).where(F.col("distance") >= 0).orderBy("distance", "term").limit(limit)


def suggest(terms: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """The first terms (of one row each) with a beginning; the filter reaches the scan."""
    if not prefix:
        raise ValueError("empty prefix")
    return terms.where(F.startswith("term", F.lit(prefix.lower()))).select("term").orderBy("term").limit(min(limit, 50))


def fuzzy_chunks(df: DataFrame, id_col: str, pos_col: str, tokens: Column, query: str, distance: int, first_only: bool = False) -> DataFrame:
    """id, term, distance, score of the texts with a term near the query, which is taken as one word.

    ``first_only`` keeps the first text of each term alone.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(pos_col).alias("pos"), F.explode(F.array_distinct(tokens)).alias("term"))
    rows = rows.where(F.abs(F.length("term") - F.lit(len(query))) <= distance).withColumn("distance", F.levenshtein(F.col("term"), F.lit(query.lower()), distance)).where("distance >= 0")
    if first_only:
        rows = rows.groupBy("term", "distance").agg(F.min_by("id", F.struct("pos", "id")).alias("id"))
    return rows.select("id", "term", "distance", (1.0 - F.col("distance") / F.lit(float(max(1, distance)))).alias("score"))


# relevance by counting ---------------------------------------------------------


def additive_relevance(df: DataFrame, id_col: str, text: Column, clauses: Column, issues: Column, tokens: Sequence[str]) -> DataFrame:
    """id, score: (how often the tokens stand in the text + 2 a clause tag + 1.5 an issue tag that holds one) over the tokens; texts with all tokens.

    Best first (the browser's queue gives the lowest first; that is not kept).
    """
    low = F.lower(text)
    holds = lambda tags, t: F.size(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), F.lit(t))))
    total, every = F.lit(0.0), F.lit(True)
    for t in tokens:
        total = total + X.occurrences(low, t) + 2.0 * holds(clauses, t) + 1.5 * holds(issues, t)
        every = every & F.contains(low, F.lit(t))
    return df.where(every).select(F.col(id_col).alias("id"), (total / F.lit(float(max(1, len(tokens))))).alias("score"))


def keyword_relevance(df: DataFrame, id_col: str, title: Column, text: Column, tokens: Sequence[str]) -> DataFrame:
    """id, title, score: whole-word counts in title and text, 3 more for a title that holds a token; texts with every token, all texts for no tokens."""
    both = F.lower(F.concat_ws(" ", title, text))
    low = F.lower(F.coalesce(title, F.lit("")))
    score, every = F.lit(0), F.lit(True)
    for t in tokens:
        n = F.regexp_count(both, F.lit(rf"\b{t}\b"))
        score = score + n + F.when(F.contains(low, F.lit(t)), 3).otherwise(0)
        every = every & (n > 0)
    return df.where(every).select(F.col(id_col).alias("id"), title.alias("title"), score.cast("int").alias("score"))


def palette_score(label: Column, query: str) -> Column:
    """1000 for the query itself, 600 less the rest for a beginning, 300 inside, 100 for its letters in order, else -1."""
    low, q = F.lower(label), query.lower()
    spaced = ".*".join(map(_escaped, q))
    return (
        F.when(low == q, 1000)
        .when(F.startswith(low, F.lit(q)), F.lit(600) - (F.length(low) - len(q)))
        .when(F.contains(low, F.lit(q)), 300)
        .when(low.rlike(spaced), 100)
        .otherwise(-1)
    )


def _escaped(c: str) -> str:
    return c if c.isalnum() else "\\" + c


def palette(df: DataFrame, label: str, detail: str, query: str, limit: int = 40) -> DataFrame:
    score = F.greatest(palette_score(F.col(label), query).cast("double"), palette_score(F.coalesce(F.col(detail), F.lit("")), query) / 2.0)
    return df.select(label, detail, score.alias("score")).where("score > 0").orderBy(F.desc("score"), label, detail).limit(limit)


# facets of results --------------------------------------------------------------


def year_histogram(hits: DataFrame, date: Column) -> DataFrame:
    """bucket, n: hits a year, or a decade if they span more than fifty years; empty buckets in between are 0."""
    years = keep(hits.select(F.substring(date, 1, 4).try_cast("int").alias("y")).where("y is not null"))
    span = years.agg(F.min("y").alias("a"), F.max("y").alias("b")).first()
    if span.a is None:
        return years.select(F.col("y").alias("bucket"), F.lit(0).cast("bigint").alias("n"))
    step = 10 if span.b - span.a > 50 else 1
    low, high = span.a - span.a % step, span.b - span.b % step
    grid = years.sparkSession.range(low, high + 1, step).select(F.col("id").cast("int").alias("bucket"))
    counted = years.groupBy((F.col("y") - F.col("y") % step).alias("bucket")).agg(F.count("*").alias("n"))
    return grid.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def neighbours(df: DataFrame, id_col: str, pos_col: str, *, block: int = 65_536) -> DataFrame:
    """id, previous, next in archive order within documents.

    Rows are ordered in blocks of places of a document, and only the ends of blocks over
    a whole document, so no task orders a document that holds a great part of the rows.
    """
    rows = df.select(F.col(id_col).alias("id"), "document_id", F.col(pos_col).alias("pos"), F.coalesce(F.floor(F.col(pos_col) / block), F.lit(-1)).alias("block"))
    w = Window.partitionBy("document_id", "block").orderBy("pos", "id")
    inside = rows.withColumn("previous", F.lag("id").over(w)).withColumn("next", F.lead("id").over(w))
    place = F.struct("pos", "id")
    ends = rows.groupBy("document_id", "block").agg(F.min(place)["id"].alias("first"), F.max(place)["id"].alias("last"))
    over = Window.partitionBy("document_id").orderBy("block")
    ends = ends.select(F.col("document_id").alias("d"), F.col("block").alias("b"), F.lag("last").over(over).alias("before"), F.lead("first").over(over).alias("after"))
    met = inside.join(ends, F.col("document_id").eqNullSafe(F.col("d")) & (F.col("block") == F.col("b")))
    return met.select("id", F.coalesce("previous", "before").alias("previous"), F.coalesce("next", "after").alias("next"))


def dispatch(kind: str, engines: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The engine of a kind of search."""
    if kind not in engines:
        raise ValueError(f"unknown kind of search: {kind}")
    return engines[kind]()
