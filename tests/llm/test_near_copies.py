"""Near copies against brute force."""

import random

import numpy as np
import pytest

from lectern.llm.components import connected_components
from lectern.llm.near_copies import NearCopies, Shingler, signatures, superminhash
from lectern.runtime import read_table

SCHEMA = "chunk_id string, text string, id string, s1 bigint, band string, source_collection string"


def table(spark, rows):
    """Rows of (id, text) with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, "clash", 1, "x", None) for i, t in rows], SCHEMA)


def brute(rows, threshold=0.5, width=3):
    sets = {i: set(Shingler(width)(t).tolist()) for i, t in rows if i is not None and t is not None}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def found(spark, rows):
    return {(r.id_a, r.id_b) for r in NearCopies(table(spark, rows)).pairs().collect()}


def variants(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.choice([8, 40, 150]))
        for v in range(rng.randint(1, 4)):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((f"c{g}_{v}", (" ".join(words) + rng.choice(["", ".", "  "])).title()))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = variants(seed)
    assert found(spark, rows) == brute(rows)


def test_on_the_tables(spark, data):
    rows = [(r.chunk_id, r.text) for r in read_table(spark, data, "chunks").collect()]
    pairs = {(r.id_a, r.id_b) for r in NearCopies(read_table(spark, data, "chunks")).pairs().collect()}
    assert pairs == brute(rows)


def test_special_rows(spark):
    rows = [("a", None), ("b", ""), ("c", " \n"), ("d", "two words"), ("e", "one two three"), ("f", "One, two: THREE!"), ("f", "One, two: THREE!"), (None, "one two three"), ("g", "two words")]
    assert found(spark, rows) == {("e", "f")}
    assert found(spark, []) == set()


def test_groups(spark):
    a = " ".join(f"w{k}" for k in range(60))
    b, c = a.replace("w3 ", "x3 "), a.replace("w3 ", "x3 ").replace("w50 ", "x50 ")
    got = {r.id: (r.class_id, r.group_id, r.links) for r in NearCopies(table(spark, [("p", a), ("q", a), ("r", b), ("s", c), ("t", "nothing like the others at all")])).groups().collect()}
    assert got == {"p": ("p", "p", 2), "q": ("p", "p", 2), "r": ("r", "p", 2), "s": ("s", "p", 2)}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    a, b = pool[:1000], pool[500:]
    sig = superminhash(np.concatenate([a, b]), np.repeat([0, 1], [1000, 1000]), 2, 384)
    assert abs((sig[0] == sig[1]).mean() - 500 / 1500) < 0.08


def test_parts_of_a_long_text_give_one_signature():
    rng = np.random.default_rng(6)
    e = np.unique(rng.integers(0, 2**63, 60_000, dtype=np.uint64))
    whole = superminhash(e, np.zeros(len(e), int), 1, 64)
    assert (signatures(e, np.zeros(len(e), int), 1, 64) == whole).all()


def test_components(spark):
    edges = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}") for k in range(120)] + [("x", "y"), ("y", "y"), (None, "z"), ("x", "y")], "src string, dst string")
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert {roots[f"n{k:03}"] for k in range(121)} == {"n000"} and roots["y"] == "x" and "z" not in roots
    assert connected_components(edges.limit(0)).count() == 0


def test_pairs_of_sorted_runs(monkeypatch):
    """Runs that span batches, and runs long enough to leave in blocks, give every pair once."""
    import pyarrow as pa

    from lectern.llm import near_copies as NC

    monkeypatch.setattr(NC, "RUN", 4)
    rng = random.Random(4)
    rows = sorted({(rng.randrange(6), rng.randrange(60)) for _ in range(90)} | {(9, k) for k in range(11)} | {(-3, 1), (-3, 2)})
    batches = [pa.RecordBatch.from_arrays([pa.array([b for b, _ in part], pa.int64()), pa.array([c for _, c in part], pa.int64())], ["band", "s1"]) for part in (rows[:0], rows[:7], rows[7:40], rows[40:])]
    got, blocks = [], []
    for out in NC._pairs_of_runs(iter(batches)):
        for a, b, x, y in zip(*(c.to_pylist() for c in out.columns)):
            (got.append((a, b)) if x is None else blocks.append((x, y)))
    part = pa.RecordBatch.from_arrays([pa.array([x for x, _ in blocks], pa.list_(pa.int64())), pa.array([y for _, y in blocks], pa.list_(pa.int64()))], ["left", "right"])
    for out in NC._pairs_of_blocks(iter([part])):
        got += zip(*(c.to_pylist() for c in out.columns))
    want = [(c, e) for b, c in rows for d, e in rows if b == d and c < e]
    assert sorted(got) == sorted(want)
