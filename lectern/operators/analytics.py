"""Analyses of an archive of chunks, one row a chunk: overviews, rollups, matrices, networks, comparisons, dossiers.

Tags are counted as they stand in the arrays; null arrays hold none. Ties are broken
by key, so every top list is defined.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.records import COVERAGE_LABELS
from lectern.operators.blocks import against, sparse
from lectern.runtime import cut

CLAUSES, ISSUES = "constitutional_clause_tags", "issue_tags"


#: Neighbouring rows of a file whose later deliveries are listed together, and how many later deliveries one broadcast lists.
PIECE, LISTED = 4096, 10_000_000


def _places(df: DataFrame) -> bool:
    """Whether rows have a place in files."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def once(df: DataFrame, key: str, *cols: str, delivered: str | None = None, listed: int = LISTED) -> DataFrame:
    """The needed columns of a table whose rows may be delivered twice, one row a key: that of the first delivery.

    With ``delivered`` (the time of delivery) rows of files are never shuffled, however many
    keys are repeated: keys, times and places alone find the later deliveries (of equal
    times the first in its file stays). These are listed as numbers of rows by file and
    drop out in the scan. One broadcast lists at most about ``listed`` of them (two bytes
    each); where there are more, the files are read in several scans, each file in one of
    them and with the list of its own files. Tables that are no files are grouped by key.
    """
    wanted = [key, *(c for c in cols if c != key)]
    rows = df.where(F.col(key).isNotNull())
    if delivered is None:
        return rows.select(*wanted).dropDuplicates([key])
    if not _places(df):
        firsts = rows.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*wanted), F.struct(delivered)).alias("__row"))
        return firsts.select("__row.*")
    file, row = F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")
    at = rows.select(F.col(key).alias("key"), F.struct(F.col(delivered).alias("when"), file.alias("file"), row.alias("row")).alias("at"))
    first = at.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    later = cut(at.join(first, "key").where("at.file <> first.file or at.row <> first.row").select("at.file", "at.row"))
    scans = -(-later.count() // listed)
    if not scans:
        return rows.select(*wanted)
    pieces = later.groupBy(F.col("file").alias("__file"), F.expr(f"row div {PIECE}").alias("__piece")).agg(F.collect_list((F.col("row") % PIECE).cast("smallint")).alias("__later"))
    out = None
    for k in range(scans):
        of = lambda c: F.pmod(c, F.lit(scans)) == k if scans > 1 else F.lit(True)
        own = rows.where(of(file)).select(*wanted, file.alias("__in"), F.expr(f"_metadata.row_index div {PIECE}").alias("__of"), (row % PIECE).cast("smallint").alias("__no"))
        drop = F.broadcast(pieces.where(of(F.col("__file"))))
        met = own.join(drop, (F.col("__in") == F.col("__file")) & (F.col("__of") == F.col("__piece")), "left")
        part = met.where(F.col("__later").isNull() | ~F.array_contains("__later", F.col("__no"))).select(*wanted)
        out = part if out is None else out.unionByName(part)
    return out


def tags_of(c: str) -> Column:
    return F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda t: t.isNotNull())


def top_n(df: DataFrame, group: Sequence[str], n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def overview(df: DataFrame, collection: Column | None = None) -> DataFrame:
    """One row: counts, word statistics (a single chunk deviates by 0), distinct tags."""
    collection = F.col("source_collection") if collection is None else collection
    tagged = df.select("document_id", collection.alias("collection"), "author", "word_count", tags_of(CLAUSES).alias("c"), tags_of(ISSUES).alias("i"))
    base = tagged.agg(
        F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"), F.countDistinct("collection").alias("collections"), F.countDistinct("author").alias("authors"),
        F.sum("word_count").alias("words"), F.avg("word_count").alias("mean_words"), F.median("word_count").alias("median_words"), F.min("word_count").alias("min_words"),
        F.max("word_count").alias("max_words"), F.coalesce(F.stddev_samp("word_count"), F.lit(0.0)).alias("stdev_words"),
    )
    kinds = tagged.select(F.explode(F.concat(F.transform("c", lambda t: F.struct(F.lit("clause").alias("kind"), t.alias("tag"))), F.transform("i", lambda t: F.struct(F.lit("issue").alias("kind"), t.alias("tag"))))).alias("t")).select("t.*").distinct()
    tags = kinds.agg(F.count_if(F.col("kind") == "clause").alias("clauses"), F.count_if(F.col("kind") == "issue").alias("issues"))
    found = tags.first()  # one row of two numbers
    return base.select("*", F.lit(found.clauses).alias("clauses"), F.lit(found.issues).alias("issues"))


def tag_analysis(df: DataFrame, tag: str, related: str, n: int | None) -> DataFrame:
    """tag, count, documents, the distinct related tags in order: the most frequent tags."""
    tagged = df.select("document_id", F.explode(tags_of(tag)).alias("tag"), tags_of(related).alias("rel"))
    counts = tagged.groupBy("tag").agg(F.count("*").alias("count"), F.countDistinct("document_id").alias("documents"))
    rel = tagged.select("tag", F.explode("rel").alias("r")).distinct().groupBy("tag").agg(F.array_join(F.array_sort(F.collect_set("r")), "|").alias("related"))
    out = counts.join(rel, "tag", "left").select("tag", "count", "documents", F.coalesce("related", F.lit("")).alias("related"))
    return out if n is None else out.orderBy(F.desc("count"), "tag").limit(n)


def tag_distribution(df: DataFrame, tag: str) -> DataFrame:
    counts = df.select(F.explode(tags_of(tag)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("total_unique"), F.median("n").alias("median"), F.avg("n").alias("mean"))


def rollup_by(df: DataFrame, key: str) -> DataFrame:
    """key, chunks, words, documents, clauses, issues (distinct), mean words: one pass, tags counted apart."""
    base = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("chunks"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), F.countDistinct("document_id").alias("documents"), F.avg("word_count").alias("mean_words"))
    pairs = df.select(F.col(key).alias("key"), F.explode(F.concat(F.transform(tags_of(CLAUSES), lambda t: F.struct(F.lit(1).alias("c"), t.alias("t"))), F.transform(tags_of(ISSUES), lambda t: F.struct(F.lit(0).alias("c"), t.alias("t"))))).alias("x"))
    kinds = pairs.select("key", "x.c", "x.t").distinct().groupBy("key").agg(F.sum("c").alias("clauses"), F.sum(1 - F.col("c")).alias("issues"))
    return base.join(kinds.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k")), "left").select(
        "key", "chunks", "words", "documents", F.coalesce("clauses", F.lit(0)).alias("clauses"), F.coalesce("issues", F.lit(0)).alias("issues"), "mean_words"
    )


def matrix(df: DataFrame, row: Column, col: Column) -> DataFrame:
    """row, col, n in long form."""
    return df.select(row.alias("row"), F.explode(col).alias("col")).groupBy("row", "col").agg(F.count("*").alias("n"))


def tag_matrix(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """How often each pair of a tag of one kind and one of the other share a chunk."""
    return matrix(df.select(F.explode(tags_of(rows)).alias("r"), tags_of(cols).alias("c")), F.col("r"), F.col("c"))


def word_frequency(df: DataFrame, text: str, n: int = 50, stop: Sequence[str] = X.STOP_FREQUENCY) -> DataFrame:
    """Words of more than three letters after all but letters is dropped."""
    w = df.select(F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("w")).select(F.regexp_replace("w", "[^a-z]", "").alias("word"))
    return w.where((F.length("word") > 3) & ~F.col("word").isin(*stop)).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n)


def token_frequency(df: DataFrame, tokens: Column, n: int) -> DataFrame:
    return df.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n)


def size_histogram(df: DataFrame, size: str, bounds: Sequence[int] = (200, 400, 600)) -> DataFrame:
    """bucket, n with every bucket; one row is spread into the buckets."""
    edges = [None, *bounds, None]
    label = lambda a, b: f"<{b}" if a is None else f">={a}" if b is None else f"{a}-{b - 1}"
    tests = [(label(a, b), (F.lit(True) if a is None else F.col(size) >= a) & (F.lit(True) if b is None else F.col(size) < b)) for a, b in zip(edges, edges[1:])]
    wide = df.agg(*(F.count_if(t).alias(name) for name, t in tests))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(name).alias("bucket"), F.col(f"`{name}`").alias("n")) for name, _ in tests))).alias("x")).select("x.*")


def temporal(df: DataFrame, tag: str = CLAUSES) -> DataFrame:
    return df.select("date", F.explode(tags_of(tag)).alias("tag")).groupBy("date", "tag").agg(F.count("*").alias("n"))


def yearly_evolution(df: DataFrame, tag: str = CLAUSES) -> DataFrame:
    """year, clauses as tag:count in order, mentions."""
    per = df.select(F.substring("date", 1, 4).alias("year"), F.explode(tags_of(tag)).alias("tag")).where("year is not null and year <> ''").groupBy("year", "tag").agg(F.count("*").alias("n"))
    listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "tag", F.col("n").cast("string")))), "|")
    return per.groupBy("year").agg(listed.alias("tags"), F.sum("n").alias("mentions"))


def pair_network(df: DataFrame, tags: Column, n: int | None = 50) -> DataFrame:
    """source, target, weight: unordered pairs by place in the array, repeats kept, smaller name first."""
    t = df.select(tags.alias("t"))
    pairs = t.select(F.explode(F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda b: F.struct(F.least(a, b).alias("source"), F.greatest(a, b).alias("target")))))).alias("p")).select("p.*")
    out = pairs.groupBy("source", "target").agg(F.count("*").alias("weight"))
    return out if n is None else out.orderBy(F.desc("weight"), "source", "target").limit(n)


def author_influence(df: DataFrame, n: int = 20) -> DataFrame:
    """mentions * (1 + digits of the number of documents) * (words / 100 + 1), to two digits."""
    per = rollup_mentions(df)
    score = F.col("mentions") * (1 + F.length(F.col("documents").cast("string"))) * (F.col("words") / 100.0 + 1.0)
    return per.select("author", "mentions", "documents", "words", F.round(score, 2).alias("score")).orderBy(F.desc("score"), "author").limit(n)


def author_influence_log(df: DataFrame, n: int = 20) -> DataFrame:
    """mentions * log10(documents) + 1; the words a chunk are a whole number."""
    per = rollup_mentions(df)
    score = F.col("mentions") * F.log10(F.col("documents").cast("double")) + 1.0
    return per.select("author", "mentions", "documents", F.floor(F.col("words") / F.col("chunks")).alias("mean_words"), F.round(score, 6).alias("score")).orderBy(F.desc("score"), "author").limit(n)


def rollup_mentions(df: DataFrame) -> DataFrame:
    return (
        df.where("author is not null and trim(author) <> ''")
        .groupBy("author")
        .agg(F.sum(F.size(tags_of(CLAUSES))).alias("mentions"), F.countDistinct("document_id").alias("documents"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), F.count("*").alias("chunks"))
    )


def primary_clusters(df: DataFrame, tag: str = CLAUSES) -> DataFrame:
    """cluster, size by the first tag; chunks without tags are in none."""
    return df.select(F.get(tags_of(tag), 0).alias("cluster")).where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("size"))


def place_mentions(df: DataFrame, text: str, places: Sequence[str], n: int = 5) -> DataFrame:
    """clause, place, n, rank: the places most often named in the chunks of a clause; places are few and given."""
    low = F.lower(F.col(text))
    named = F.filter(F.array(*(F.when(F.contains(low, F.lit(p.lower())), F.lit(p)) for p in places)), lambda p: p.isNotNull())
    counted = df.select(F.explode(tags_of(CLAUSES)).alias("clause"), named.alias("named")).select("clause", F.explode("named").alias("place")).groupBy("clause", "place").agg(F.count("*").alias("n"))
    return top_n(counted, ["clause"], n, F.desc("n"), F.col("place"))


def author_tags(df: DataFrame, tag: str) -> DataFrame:
    return df.select("author", F.explode(tags_of(tag)).alias("tag")).groupBy("author", "tag").agg(F.count("*").alias("n"))


def compare_authors(df: DataFrame, a: str, b: str, top_clauses: int = 10, top_issues: int = 8) -> DataFrame:
    """One row: counts of both, shared top clauses and issues, and their agreement
    shared / (lengths of the four lists + 0.1)."""
    two = df.where(F.col("author").isin(a, b))
    best = lambda tag, n: top_n(author_tags(two, tag), ["author"], n, F.desc("n"), F.col("tag")).groupBy("author").agg(F.collect_list("tag").alias(tag))
    base = two.groupBy("author").agg(F.count("*").alias("chunks"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))
    per = base.join(best(CLAUSES, top_clauses), "author", "left").join(best(ISSUES, top_issues), "author", "left")
    empty = F.array().cast("array<string>")
    pick = lambda who, c: F.max(F.when(F.col("author") == who, F.col(c)))
    one = per.agg(
        F.coalesce(pick(a, "chunks"), F.lit(0)).alias("chunks_a"), F.coalesce(pick(b, "chunks"), F.lit(0)).alias("chunks_b"), F.coalesce(pick(a, "words"), F.lit(0)).alias("words_a"), F.coalesce(pick(b, "words"), F.lit(0)).alias("words_b"),
        F.coalesce(pick(a, CLAUSES), empty).alias("ca"), F.coalesce(pick(b, CLAUSES), empty).alias("cb"), F.coalesce(pick(a, ISSUES), empty).alias("ia"), F.coalesce(pick(b, ISSUES), empty).alias("ib"),
    )
    shared_c, shared_i = F.array_sort(F.array_intersect("ca", "cb")), F.array_sort(F.array_intersect("ia", "ib"))
    shared = F.size(shared_c) + F.size(shared_i)
    total = F.size("ca") + F.size("cb") + F.size("ia") + F.size("ib")
    return one.select("chunks_a", "chunks_b", "words_a", "words_b", F.array_join(shared_c, "|").alias("shared_clauses"), F.array_join(shared_i, "|").alias("shared_issues"), F.round(shared / (total + 0.1), 6).alias("agreement"))


def compare_author_sets(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: shared clauses, those of one alone, and the Jaccard similarity over all clauses."""
    two = df.where(F.col("author").isin(a, b)).select("author", F.explode(tags_of(CLAUSES)).alias("t")).distinct()
    of = lambda who: F.array_sort(F.collect_set(F.when(F.col("author") == who, F.col("t"))))
    one = two.agg(of(a).alias("x"), of(b).alias("y"))
    union = F.size(F.array_union("x", "y"))
    join = lambda c: F.array_join(F.array_sort(c), "|")
    return one.select(
        join(F.array_intersect("x", "y")).alias("shared"), join(F.array_except("x", "y")).alias("only_a"), join(F.array_except("y", "x")).alias("only_b"),
        F.round(F.when(union > 0, F.size(F.array_intersect("x", "y")) / union).otherwise(0.0), 6).alias("jaccard"),
    )


def _facet(df: DataFrame, key: str, value: Column, n: int, name: str) -> DataFrame:
    counted = df.select(key, value.alias("v")).where("v is not null and v <> ''").groupBy(key, "v").agg(F.count("*").alias("n"))
    best = top_n(counted, [key], n, F.desc("n"), F.col("v"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "v", F.col("n").cast("string")).alias("s"))))
    return best.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "|").alias(name))


def author_dossiers(df: DataFrame) -> DataFrame:
    """author, chunks, documents, top collections, issues and clauses as value:count, first and last date, six longest chunks.

    Blank and unknown authors have none.
    """
    named = df.where("author is not null and trim(author) <> '' and lower(trim(author)) <> 'unknown'")
    base = named.groupBy("author").agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"), F.min(F.when(F.col("date") != "", F.col("date"))).alias("first_date"), F.max(F.when(F.col("date") != "", F.col("date"))).alias("last_date"))
    longest = top_n(named.select("author", "chunk_id", "word_count"), ["author"], 6, F.desc_nulls_last("word_count"), F.col("chunk_id"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
    samples = longest.groupBy("author").agg(F.array_join(F.transform(ordered, lambda x: x["chunk_id"]), "|").alias("samples"))
    issues, clauses = named.select("author", F.explode(tags_of(ISSUES)).alias("v")), named.select("author", F.explode(tags_of(CLAUSES)).alias("v"))
    out = base.join(_facet(named, "author", F.col("source_collection"), 10, "collections"), "author", "left")
    out = out.join(_facet(issues, "author", F.col("v"), 8, "issues"), "author", "left").join(_facet(clauses, "author", F.col("v"), 8, "clauses"), "author", "left")
    return out.join(samples, "author", "left").select("author", "chunks", "documents", *(F.coalesce(c, F.lit("")).alias(c) for c in ("collections", "issues", "clauses", "samples")), "first_date", "last_date")


def collection_dossiers(df: DataFrame) -> DataFrame:
    """collection, chunks, documents, top authors and issues."""
    named = df.where("source_collection is not null and source_collection <> ''")
    base = named.groupBy("source_collection").agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"))
    issues = named.select("source_collection", F.explode(tags_of(ISSUES)).alias("v"))
    out = base.join(_facet(named, "source_collection", F.col("author"), 10, "authors"), "source_collection", "left").join(_facet(issues, "source_collection", F.col("v"), 8, "issues"), "source_collection", "left")
    return out.select("source_collection", "chunks", "documents", F.coalesce("authors", F.lit("")).alias("authors"), F.coalesce("issues", F.lit("")).alias("issues"))


def temporal_pivot(df: DataFrame, n: int = 8) -> DataFrame:
    """date, tag, n for the n tags with the most mentions, over every date that has any, zeros filled in."""
    per = temporal(df).where("date is not null")
    best = [r.tag for r in per.groupBy("tag").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "tag").limit(n).collect()]
    grid = per.select("date").distinct().select("date", F.explode(X.words_literal(best)).alias("tag")) if best else per.select("date", "tag").limit(0)
    return grid.join(per, ["date", "tag"], "left").select("date", "tag", F.coalesce("n", F.lit(0)).alias("n"))


def tag_totals(df: DataFrame, places: DataFrame) -> DataFrame:
    """place, clauses: in how many clauses each place occurs."""
    return places.groupBy("place").agg(F.countDistinct("clause").alias("clauses"))


def facet_values(df: DataFrame) -> DataFrame:
    """facet, value: distinct collections, authors, types, issues."""
    facet = lambda name, c: F.struct(F.lit(name).alias("facet"), F.col(c).alias("value"))
    values = F.array(facet("collection", "source_collection"), facet("author", "author"), facet("type", "document_type"))
    tagged = F.transform(tags_of(ISSUES), lambda t: F.struct(F.lit("issue").alias("facet"), t.alias("value")))
    return df.select(F.explode(F.concat(values, tagged)).alias("f")).select("f.*").where("value is not null and value <> ''").distinct()


def document_analysis(df: DataFrame) -> DataFrame:
    """document_id, title of its first chunk, chunks, words, clauses, issues."""
    titles = df.groupBy("document_id").agg(F.min_by("title", F.struct("pos", "chunk_id")).alias("title"))
    return rollup_by(df, "document_id").withColumnRenamed("key", "document_id").join(titles, "document_id").select("document_id", "title", "chunks", "words", "clauses", "issues")


def status_counts(df: DataFrame, status: str, labels: Sequence[str] = COVERAGE_LABELS) -> DataFrame:
    """status, n for every label, also those that nothing has."""
    grid = df.sparkSession.createDataFrame([(x,) for x in labels], "status string")
    return F.broadcast(grid).join(df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def chunk_similarity(df: DataFrame, n: int = 200) -> DataFrame:
    """document_a, document_b, shared clauses and issues: the n pairs of documents that share most tags.

    Documents are compared over their distinct tags in blocks, and two blocks give their
    n best pairs, so a tag that many documents hold makes no rows. A shared clause counts
    a million, so that both counts come out of one sum.
    """
    million = 1_000_000
    kinds = F.concat(F.transform(tags_of(CLAUSES), lambda t: F.struct(F.lit(float(million**0.5)).alias("w"), F.concat(F.lit("c:"), t).alias("t"))), F.transform(tags_of(ISSUES), lambda t: F.struct(F.lit(1.0).alias("w"), F.concat(F.lit("i:"), t).alias("t"))))
    tags = df.where("document_id is not null").select(F.col("document_id").alias("id"), F.explode(kinds).alias("x")).select("id", F.col("x.t").alias("term"), F.col("x.w").alias("weight")).distinct()
    packed = cut(sparse(tags))

    def best(q, r, _, scores):
        i, j = np.nonzero((scores > 0) & (q[:, None].astype(str) < r[None, :].astype(str)))
        both = np.rint(scores[i, j]).astype(np.int64)
        clauses, issues = both // million, both % million
        first = np.lexsort((r[j].astype(str), q[i].astype(str), -(clauses + issues)))[:n]
        return q[i][first], r[j][first], clauses[first], issues[first]

    pairs = against(packed, packed, best, "document_a string, document_b string, clauses bigint, issues bigint", False)
    return pairs.orderBy(F.desc(F.col("clauses") + F.col("issues")), "document_a", "document_b").limit(n)
