"""Variant spellings of names: a noisy channel from canonical forms to what was typed.

Candidates for a canonical form are the entries of a register and, where the
register does not explain them, the frequent spellings of the corpus itself. A
spelling goes to the form with the largest posterior: the prior is how often the
form is written out in the corpus, the likelihood is a product of typing errors
(letters in, out, changed or swapped), initials, short forms, left-out parts,
reordered parts and added titles. A frequent form outside the register that
explains a spelling better takes it away from the register. A word two edits off a
surname is somebody else's name where the corpus says so: a typing error seldom comes
about twice, so a word that stands in several different spellings, or is written nearly
as often as the surname, is no misspelling of it.

Everything runs over distinct spellings with their counts (kept by checkpoints in the
shared folder, so that no plan contains the plans before it); candidates meet over
deletion keys of the form's surname (of a body's place), so no spelling is compared with
all forms and no given name is a key, and spellings return to their records by an
equi-join. All bounds on frequency are relative to the corpus.

Defined results: null and blank authors mean nobody; a spelling equal to a name of
the register is that name and no variant; among equal posteriors the smallest entry
id wins; an empty register or an empty table gives no rows; null entry ids or names
are left out of the register.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.names import body_likelihood, body_words, far_surname, keys_of, person_likelihood, read_person
from lectern.runtime import cut, keep, small_side

#: A spelling may be the form of somebody outside the register if it is written so many times as often as spellings are on average.
FREQUENT = 0.25
#: A word two edits off a surname is a name if it stands in so many spellings, and in so great a part of the number of the surname's ...
OWN_SPELLINGS, OWN_PART = 2, 0.05
#: ... or is written so great a part as often as the surname, and more often than spellings are on average.
OWN_OFTEN = 0.2
#: Least log-likelihood at which a form explains a spelling.
LEAST = -8.5
#: Forms outside the register have to explain a spelling better than the register by this much.
OUTSIDE_PRIOR = 0.0
BROADCAST_ROWS = 100_000


def _typed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spelling under the keys of all its words, any of which may be the surname."""
    for batch in batches:
        rows = [(name, k) for name in batch.column(0).to_pylist() for k in keys_of({*read_person(name).words, *body_words(name)})]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["name", "key"])


def _form_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A form under the keys of the one word that has to be met: a person's surname, a body's place."""
    for batch in batches:
        rows = [(name, k) for name in batch.column(0).to_pylist() for k in keys_of({*read_person(name).words[-1:], *body_words(name)[-1:]})]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["name", "key"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(w, n) for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in set(read_person(name).words)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["word", "n"])


def likelihood(spelling: str, canonical: str, kind: str | None) -> float:
    """Log-likelihood by the kind of the entry; of either kind where it is unknown."""
    if kind == "person":
        return person_likelihood(spelling, canonical)
    if kind == "body":
        return body_likelihood(spelling, canonical)
    return max(person_likelihood(spelling, canonical), body_likelihood(spelling, canonical))


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v, c, k = (batch.column(i).to_pylist() for i in range(3))
        s = [likelihood(x, y, z) for x, y, z in zip(v, c, k)]
        far = [far_surname(x, y) if n > -math.inf and z != "body" else None for x, y, z, n in zip(v, c, k, s)]
        surname = [read_person(y).words[-1] if f else None for y, f in zip(c, far)]
        columns = [*(batch.column(i) for i in range(3)), pa.array(s, pa.float64()), pa.array(far, pa.string()), pa.array(surname, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["spelling", "form", "kind", "loglik", "far", "surname"]).filter(pa.array([x > -math.inf for x in s]))


def names_of_their_own(pairs: DataFrame, spellings: DataFrame, average: float) -> DataFrame:
    """far, surname: those pairs of a word and the surname it may be a misspelling of, whose word is a name.

    ``spellings``: spelling, n. Both words are counted over all spellings, in how many of
    them they stand and how often these are written.
    """
    words = cut(spellings.select("spelling", "n").mapInArrow(_words, "word string, n bigint").groupBy("word").agg(F.count("*").alias("spellings"), F.sum("n").alias("records")))
    of = lambda c, p: words.select(F.col("word").alias(c), F.col("spellings").alias(f"{p}_spellings"), F.col("records").alias(f"{p}_records"))
    met = pairs.distinct().join(of("far", "far"), "far").join(of("surname", "own"), "surname", "left").fillna(0, ["own_spellings", "own_records"])
    several = (F.col("far_spellings") >= OWN_SPELLINGS) & (F.col("far_spellings") > OWN_PART * F.col("own_spellings"))
    often = (F.col("far_records") >= OWN_OFTEN * F.col("own_records")) & (F.col("far_records") > F.lit(average))
    return met.where(several | often).select("far", "surname")


def _candidates(spellings: DataFrame, forms: DataFrame) -> DataFrame:
    """spelling, form, kind, loglik for the forms that could explain each spelling."""
    typed = spellings.select("spelling").mapInArrow(_typed_keys, "spelling string, key string")
    meant = forms.select("form").mapInArrow(_form_keys, "form string, key string").join(forms.select("form", "kind"), "form")
    met = typed.join(meant, "key").where("spelling <> form").select("spelling", "form", "kind").distinct()
    return met.mapInArrow(_scores, "spelling string, form string, kind string, loglik double, far string, surname string")


def attribute_spellings(spellings: DataFrame, register: DataFrame) -> DataFrame:
    """spelling, entry_id, form, posterior for each distinct spelling that means an entry.

    ``spellings``: spelling, n (how often it is written). ``register``: entry_id,
    name, kind (person, body or null).
    """
    spellings = cut(spellings.where("spelling is not null and trim(spelling) <> ''").groupBy("spelling").agg(F.sum("n").alias("n")))
    entries = register.where("entry_id is not null and name is not null").groupBy(F.col("name").alias("form")).agg(F.min("entry_id").alias("entry_id"), F.min("kind").alias("kind"))
    forms = cut(entries.join(spellings.withColumnRenamed("spelling", "form"), "form", "left").select("form", "entry_id", "kind", F.coalesce("n", F.lit(0)).alias("n")))
    unnamed = cut(spellings.join(forms.select(F.col("form").alias("spelling")), "spelling", "left_anti"))

    average = spellings.agg(F.avg("n")).first()[0] or 0.0

    inside = cut(_candidates(unnamed, forms))
    own = names_of_their_own(inside.where("far is not null").select("far", "surname"), spellings, average)
    inside = cut(inside.join(own, ["far", "surname"], "left_anti"))
    explained = inside.where(F.col("loglik") >= LEAST).select("spelling").distinct()
    outside_forms = (
        unnamed.where((F.col("n") > 1) & (F.col("n") >= FREQUENT * average)).join(explained, "spelling", "left_anti").select(F.col("spelling").alias("form"), F.lit(None).cast("string").alias("kind"), "n")
    )
    # only spellings that a register entry would get can be taken away from it
    outside = _candidates(unnamed.join(explained, "spelling", "left_semi"), outside_forms)

    prior = lambda n: F.log(F.col(n) + F.lit(1.0))
    ranked = (
        inside.where(F.col("loglik") >= LEAST)
        .join(forms.select("form", "entry_id", "n"), "form")
        .select("spelling", "entry_id", "form", "loglik", (F.col("loglik") + prior("n")).alias("posterior"))
        .unionByName(
            outside.join(outside_forms.select("form", "n"), "form").select(
                "spelling", F.lit(None).cast("string").alias("entry_id"), "form", "loglik", (F.col("loglik") + prior("n") + F.lit(OUTSIDE_PRIOR)).alias("posterior")
            )
        )
    )
    best = Window.partitionBy("spelling").orderBy(F.desc("posterior"), F.asc_nulls_last("entry_id"), "form")
    return ranked.withColumn("r", F.row_number().over(best)).where("r = 1 and entry_id is not null").select("spelling", "entry_id", "form", "posterior")


def attribute_records(records: DataFrame, register: DataFrame) -> DataFrame:
    """record_kind, record_id, entry_id for each record whose author means an entry but is written differently.

    ``records``: record_kind, record_id, author; a record delivered twice counts once.
    """
    records = keep(records.where("record_id is not null and author is not null").distinct())
    spellings = records.groupBy(F.col("author").alias("spelling")).agg(F.count("*").alias("n"))
    meant = cut(attribute_spellings(spellings, register).select("spelling", "entry_id"))
    return records.join(small_side(meant, BROADCAST_ROWS), F.col("author") == F.col("spelling")).select("record_kind", "record_id", "entry_id").distinct()
