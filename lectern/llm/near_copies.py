"""Near-copies of passages: SuperMinHash signatures, banding, exact check, union-find groups.

Each text is the set of its runs of ``width`` neighbouring words (lower-cased runs
of letters and digits). Two texts are near copies if the Jaccard similarity of
these sets is at least ``threshold``.

* Signatures are SuperMinHash: every element visits the slots in an order of its
  own (a partial Fisher-Yates permutation) and offers slot number ``p[j]`` the
  value ``j + u``. A text is done at the first step ``j`` at which all of its
  slots hold less than ``j + 1``, for nothing later can lower them. The offers of
  one element to different slots are correlated, which lowers the variance of the
  estimate compared with independent permutations.
* Texts with one and the same set collapse to a class before anything is paired,
  so a passage delivered many times costs one signature in the joins.
* A band is a hash of ``rows`` slots. Classes that share a band are candidates;
  a 128-byte sketch of the signature drops candidates that are far below the
  threshold before any text is moved.
* The rest is checked exactly on the sets of hashed runs (64 bit).

With the defaults (96 bands of 4 rows) a pair at similarity 0.5 is missed with
probability 0.2 %, at 0.55 with 0.01 %, at 0.6 with 2e-6.

Defined results: rows with a null id, null or blank text, or fewer than ``width``
words are in no pair; a text delivered twice under one id counts once; empty input
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import connected_components
from lectern.runtime import cut, keep, small_side

WORD = re.compile(r"[^\W_]+")
_U64 = np.uint64
_GOLDEN, _M1, _M2 = _U64(0x9E3779B97F4A7C15), _U64(0xBF58476D1CE4E5B9), _U64(0x94D049BB133111EB)
_P1, _P2 = _U64(0xC2B2AE3D27D4EB4F), _U64(0x165667B19E3779F9)
#: Elements whose permutations are held at a time.
_ELEMENTS = 24_000
SKETCH = 128
#: Candidates below this estimate are dropped; at a true 0.5 that is 4.5 standard deviations away.
SKETCH_SLACK = 0.2
#: Classes of one band that one task pairs; more are spread in blocks of this size.
RUN = 2_000
#: Pairs of blocks in one batch.
BLOCK_ROWS = 32
#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 300_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U64(30))) * _M1
        x = (x ^ (x >> _U64(27))) * _M2
    return x ^ (x >> _U64(31))


class Shingler:
    """Texts to sorted arrays of distinct 64-bit hashes of word runs."""

    def __init__(self, width: int):
        self.width = width
        self.words: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        n = len(words) - self.width + 1
        if n < 1:
            return np.empty(0, _U64)
        known = self.words
        if len(known) > 1_000_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), _U64, len(words))
        with np.errstate(over="ignore"):
            acc = h[:n].copy()
            for i in range(1, self.width):
                acc = mix(acc * _P1 + h[i : i + n] + _P2)
        return np.unique(acc)


def superminhash(elements: np.ndarray, doc: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """Signatures of ``docs`` sets. ``doc[i]`` is the set of ``elements[i]``.

    A slot holds ``step << 32 | fraction``, so equal values mean the same element
    at the same step of its permutation.
    """
    sig = np.full((docs, slots), np.iinfo(np.uint64).max, _U64)
    flat, base, n = sig.reshape(-1), doc * slots, len(elements)
    # one row a slot, so that the values of a step lie side by side
    perm = np.repeat(np.arange(slots, dtype=np.uint16), n)
    row = np.arange(n)
    finished = 0
    for step in range(slots):
        with np.errstate(over="ignore"):
            rnd = mix(elements + _U64(step + 1) * _GOLDEN)
        at = ((((rnd & _U64(0xFFFFFFFF)) * _U64(slots - step)) >> _U64(32)).astype(np.int64) + step) * n + row
        taken = perm[at]
        # places up to this step are never looked at again, so a swap writes one of its two sides
        perm[at] = perm[step * n + row]
        np.minimum.at(flat, base + taken, _U64(step << 32) | (rnd >> _U64(32)))
        done = sig.max(axis=1) < _U64((step + 1) << 32)
        now = int(done.sum())
        if now == docs:
            break
        if now > finished:
            finished = now
            left = ~done[doc]
            if np.count_nonzero(left) < 0.7 * len(row):
                elements, doc, base, row = elements[left], doc[left], base[left], row[left]
    return sig


def signatures(elements: np.ndarray, doc: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """The same over any number of elements: parts of bounded size, the smaller offer of each slot kept. ``doc`` is sorted."""
    if len(elements) <= 2 * _ELEMENTS:
        return superminhash(elements, doc, docs, slots)
    sig = np.full((docs, slots), np.iinfo(np.uint64).max, _U64)
    for at in range(0, len(elements), _ELEMENTS):
        part = doc[at : at + _ELEMENTS]
        low, high = int(part[0]), int(part[-1]) + 1
        np.minimum(sig[low:high], superminhash(elements[at : at + _ELEMENTS], part - low, high - low, slots), out=sig[low:high])
    return sig


def _bands(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(np.arange(bands, dtype=_U64) * _GOLDEN, (len(sig), bands)).copy()
        shaped = sig[:, : bands * rows].reshape(len(sig), bands, rows)
        for i in range(rows):
            acc = mix(acc * _P1 + shaped[:, :, i])
    return acc.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    shingler, slots = Shingler(width), bands * rows
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = 0
        while at < len(ids):
            sets, kept, total = [], [], 0
            while at < len(ids) and total < _ELEMENTS:
                s = shingler(texts[at])
                if len(s):
                    sets.append(s)
                    kept.append(ids[at])
                    total += len(s)
                at += 1
            if not sets:
                continue
            doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            sig = signatures(np.concatenate(sets), doc, len(sets), slots)
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            sketch = (mix(sig[:, :SKETCH]) & _U64(0xFF)).astype(np.uint8)
            flat = pa.array(_bands(sig, bands, rows).reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(kept, pa.string()),
                    pa.array(digest[:, 0].copy()),
                    pa.array(digest[:, 1].copy()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), flat),
                    pa.array([r.tobytes() for r in sketch], pa.binary()),
                ],
                ["id", "s1", "s2", "bands", "sketch"],
            )


def _pairs_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs a1 < b1 of classes in one band, from rows sorted by band and class.

    A run of more than ``RUN`` classes is not paired here: it leaves as pairs of blocks
    (arrays of classes), to be spread over tasks and paired there.
    """
    carried_band, carried = None, []

    def emit(band: np.ndarray, cls: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
        sizes = np.diff(np.append(starts, len(band)))
        a, b, blocks = [], [], []
        for size in np.unique(sizes):
            if size < 2:
                continue
            at = starts[sizes == size]
            if size <= RUN:
                i, j = np.triu_indices(size, 1)
                # as many rows at a time as keep the arrays small
                for k in range(0, len(at), max(1, 2_000_000 // len(i))):
                    runs = cls[at[k : k + max(1, 2_000_000 // len(i)), None] + np.arange(size)]
                    a.append(runs[:, i].reshape(-1))
                    b.append(runs[:, j].reshape(-1))
            else:
                for start in at:
                    cut = [cls[k : min(k + RUN, start + size)] for k in range(start, start + size, RUN)]
                    blocks += [(cut[x], cut[y]) for x in range(len(cut)) for y in range(x, len(cut))]
        if a:
            x, y = np.concatenate(a), np.concatenate(b)
            differ = x != y
            none = pa.nulls(int(differ.sum()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x[differ]), pa.array(y[differ]), none, none], _PAIR)
        for k in range(0, len(blocks), BLOCK_ROWS):
            some = blocks[k : k + BLOCK_ROWS]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *(pa.array([pair[side] for pair in some], pa.list_(pa.int64())) for side in (0, 1))], _PAIR)

    for batch in batches:
        band, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(band):
            continue
        # the last run may go on in the next batch; a run is put together once, when it ends
        last = int(np.searchsorted(band, band[-1]))
        if carried and (last or carried_band != band[0]):
            bands, classes = [np.full(sum(map(len, carried)), carried_band)], carried
            carried = []
            yield from emit(np.concatenate([*bands, band[:last]]), np.concatenate([*classes, cls[:last]]))
        elif last:
            yield from emit(band[:last], cls[:last])
        carried_band = band[-1]
        carried.append(cls[last:].copy())
    if carried:
        classes = np.concatenate(carried)
        yield from emit(np.full(len(classes), carried_band), classes)


_PAIR = ["a1", "b1", "left", "right"]


def _pairs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x, y in zip(batch.column(0), batch.column(1)):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            a, b = np.repeat(x, len(y)), np.tile(y, len(x))
            yield pa.RecordBatch.from_arrays([pa.array(a[a < b]), pa.array(b[a < b])], ["a1", "b1"])


def _sketch_filter(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (4, 5))
        near = (a == b).mean(axis=1) >= least
        yield batch.select([0, 1, 2, 3]).filter(pa.array(near))


def _shingled(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(width)
    for batch in batches:
        sets = [shingler(t).view(np.int64) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], ["s1", "s2", "sh"])


def _jaccard(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.empty(batch.num_rows)
        a, b = batch.column(4), batch.column(5)
        for i in range(batch.num_rows):
            x, y = a[i].values.to_numpy(), b[i].values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            out[i] = both / (len(x) + len(y) - both)
        near = pa.array(out >= threshold)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(out)], ["a1", "a2", "b1", "b2", "similarity"]).filter(near)


class NearCopies:
    """The near copies of a table of texts, held as classes of equal sets and links between classes."""

    def __init__(self, df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", *, width: int = 3, threshold: float = 0.5, bands: int = 96, rows: int = 4):
        src = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null and trim(text) <> ''")
        sig = keep(src.mapInArrow(lambda b: _signed(b, width, bands, rows), "id string, s1 bigint, s2 bigint, bands array<bigint>, sketch binary"))
        #: id, s1, s2: the class of each text.
        self.members = sig.select("id", "s1", "s2").distinct()
        repeated = small_side(cut(sig.groupBy("s1", "s2").agg(F.count("*").alias("n")).where("n > 1").drop("n")), BROADCAST_ROWS)
        one = sig.join(repeated, ["s1", "s2"], "left_anti").select("s1", "s2", "id", "bands", "sketch")
        many = sig.join(repeated, ["s1", "s2"], "left_semi").select("s1", "s2", "id", "bands", "sketch").dropDuplicates(["s1", "s2"])
        reps = one.unionByName(many)

        # one shuffle of the bands, one sort, and pairs of neighbours in it; no side is joined
        banded = reps.select(F.explode("bands").alias("band"), "s1").repartition("band").sortWithinPartitions("band", "s1")
        met = banded.mapInArrow(_pairs_of_runs, "a1 bigint, b1 bigint, left array<bigint>, right array<bigint>")
        met = keep(met)
        blocks = met.where("left is not null").select("left", "right").repartition(F.xxhash64("left", "right")).mapInArrow(_pairs_of_blocks, "a1 bigint, b1 bigint")
        candidates = met.where("left is null").select("a1", "b1").unionByName(blocks).distinct()
        sketches = reps.select("s1", "s2", "sketch")
        near = (
            candidates.join(sketches.select(F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("sketch").alias("ka")), "a1")
            .join(sketches.select(F.col("s1").alias("b1"), F.col("s2").alias("b2"), F.col("sketch").alias("kb")), "b1")
            .select("a1", "a2", "b1", "b2", "ka", "kb")
            .mapInArrow(lambda b: _sketch_filter(b, threshold - SKETCH_SLACK), "a1 bigint, a2 bigint, b1 bigint, b2 bigint")
        )
        near = cut(near)

        ends = near.select(F.col("a1").alias("s1"), F.col("a2").alias("s2")).union(near.select("b1", "b2")).distinct()
        wanted = cut(reps.join(ends, ["s1", "s2"], "left_semi").select("id", "s1", "s2"))
        sets = (
            src.join(small_side(wanted, BROADCAST_ROWS), "id")
            .select("s1", "s2", "text")
            .dropDuplicates(["s1", "s2"])
            .mapInArrow(lambda b: _shingled(b, width), "s1 bigint, s2 bigint, sh array<bigint>")
        )
        of = lambda x: sets.select(F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2"), F.col("sh").alias(f"sh_{x}"))
        #: a1, a2, b1, b2, similarity: each link between two classes once.
        self.links = cut(
            near.join(of("a"), ["a1", "a2"])
            .join(of("b"), ["b1", "b2"])
            .select("a1", "a2", "b1", "b2", "sh_a", "sh_b")
            .mapInArrow(lambda b: _jaccard(b, threshold), "a1 bigint, a2 bigint, b1 bigint, b2 bigint, similarity double")
        )

    def pairs(self) -> DataFrame:
        """id_a, id_b, similarity: every pair of near copies, smaller id first."""
        a = self.members.select(F.col("id").alias("x"), F.col("s1").alias("a1"), F.col("s2").alias("a2"))
        b = self.members.select(F.col("id").alias("y"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
        across = self.links.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select("x", "y", "similarity")
        same = a.join(b, [F.col("a1") == F.col("b1"), F.col("a2") == F.col("b2"), F.col("x") < F.col("y")]).select("x", "y", F.lit(1.0).alias("similarity"))
        return across.unionByName(same).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")

    def groups(self) -> DataFrame:
        """id, class_id, group_id, links: one row per text that has a near copy.

        ``class_id`` is the smallest id with the same set, ``group_id`` the smallest
        id of all texts joined by links, ``links`` the number of other classes that
        the text's class is linked with. Exact copies are not expanded into pairs.
        """
        classes = self.members.groupBy("s1", "s2").agg(F.min("id").alias("class_id"), F.count("*").alias("size"))
        named = self.links.join(classes.select(F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("class_id").alias("src")), ["a1", "a2"]).join(
            classes.select(F.col("s1").alias("b1"), F.col("s2").alias("b2"), F.col("class_id").alias("dst")), ["b1", "b2"]
        )
        edges = keep(named.select("src", "dst"))
        roots = connected_components(edges)
        degree = edges.select(F.col("src").alias("node")).union(edges.select("dst")).groupBy("node").agg(F.count("*").alias("links"))
        per_class = (
            classes.join(degree, F.col("class_id") == F.col("node"), "left")
            .drop("node")
            .join(roots, F.col("class_id") == F.col("node"), "left")
            .where("size > 1 or links is not null")
            .select("s1", "s2", "class_id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
        )
        return self.members.join(per_class, ["s1", "s2"]).select("id", "class_id", "group_id", "links")
