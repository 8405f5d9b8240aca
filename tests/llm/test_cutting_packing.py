"""Splitting, encoding, packing and cut-off texts."""

import os
import random

import pytest

from lectern.llm import split as SP
from lectern.llm import tokens as TK
from lectern.llm.cut_off import cut_shares, cut_texts, prefixes
from lectern.llm.pack import SPAN, mixture, pack_documents
from lectern.runtime import read_table

PATH = TK.vocabulary("byte_bpe_50k")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


# splitting -----------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(12))
def test_pieces(seed):
    rng = random.Random(seed)
    words = []
    for k in range(rng.choice([10, 649, 650, 651, 1300, 3000])):
        words.append(f"w{k}" + rng.choice(["", "", "", ",", "."] if seed % 3 else [""]) + ("\n\n" if seed % 3 and rng.random() < 0.01 else ""))
    text = " ".join(words)
    plain = text.split()
    pieces = SP.split_text(text, 650, 45)
    assert pieces[0][0] == 0 and pieces[-1][0] + pieces[-1][1] == len(plain)
    for (a, n, t), (b, *_) in zip(pieces, pieces[1:]):
        assert b == a + n - 45
    for a, n, t in pieces:
        assert t.split() == plain[a : a + n] and n <= 650
    if seed % 3:
        for a, n, t in pieces[:-1]:
            assert t.endswith(".") or "\n\n" in text[text.index(t) + len(t) :][:3]
    assert (len(pieces) > 1) == (len(plain) > 650)


def test_cuts_prefer_paragraphs():
    text = "\n\n".join([" ".join(["a."] * 500), " ".join(["b."] * 500)])
    assert [n for _, n, _ in SP.split_text(text, 650, 45)] == [500, 545]


def test_split_rows(spark):
    schema = "chunk_id string, document_id string, text string, id string, pieces int"
    long = "word " * 700
    rows = [("a", "d", long, "x", 0), ("a", "d", long, "x", 0), ("b", None, "short", "x", 0), ("c", "d", None, "x", 0), (None, "d", long, "x", 0), ("e", "d", "", "x", 0), ("f", "d", "w " * 650, "x", 0)]
    df = spark.createDataFrame(rows, schema)
    assert sorted((r.id, r.piece_no, r.n_words) for r in SP.split_long(df).collect()) == [("a", 0, 372), ("a", 1, 373)]
    assert {r.id for r in SP.split_long(df, only_long=False).collect()} == {"a", "b", "f"}
    assert SP.split_long(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        SP.split_long(df, overlap=650)


def test_a_very_long_word_and_text(spark):
    assert len(SP.split_text("x" * 1_000_000, 650, 45)) == 1
    assert all(n <= 650 for _, n, _ in SP.split_text("w " * 60_000, 650, 45))


# encoding ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def public():
    if not os.path.exists(PATH):
        pytest.skip("no vocabulary files")
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=TK.encoder(PATH).ranks, special_tokens={})


def test_encoding_is_the_public_one(public):
    rng = random.Random(3)
    alphabet = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "1", "²", "é", "Ω", " ", "!", "中", "🙂", "\x1c", "́", ".", "<|endoftext|>", "word"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 16))) for _ in range(4000)] + ["", "a" * 5000 + " " * 3000 + "b"]
    flat, sizes = TK.encoder(PATH).encode(texts)
    at = 0
    for text, n in zip(texts, sizes):
        assert flat[at : at + n].tolist() == public.encode_ordinary(text), repr(text)
        at += n


@needs_vocabulary
def test_encoded_rows_and_offsets(spark, data):
    rows = TK.encode(read_table(spark, data, "documents"), "doc_id", "text", PATH, offsets=True).collect()
    texts = {r.doc_id: r.text or "" for r in read_table(spark, data, "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert TK.decode(r.ids, PATH) == texts[r.doc_id]
        assert (r.ends or [0])[-1] == len(texts[r.doc_id].encode()) and list(r.ends) == sorted(r.ends)
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "x", 0), (2, "", 0)], "doc_id long, text string, id long")
    assert sorted((r.doc_id or 0, list(r.ids)) for r in TK.encode(odd, "doc_id", "text", PATH).collect())[1:] == [(1, []), (2, []), (2, [])]
    assert TK.encode(odd.limit(0), "doc_id", "text", PATH).count() == 0


# packing -------------------------------------------------------------------------


@needs_vocabulary
def test_packing(spark, data):
    from collections import Counter, defaultdict

    df = read_table(spark, data.replace("sf0.001", "sf0.01"), "documents")
    rows = pack_documents(df, PATH).collect()
    sizes = {r.id: r.n_tokens for r in TK.count_tokens(df, "text", PATH, "doc_id").withColumnRenamed("doc_id", "id").collect()}
    filled, per = Counter(), defaultdict(list)
    for r in rows:
        filled[r.container_no] += r.n_tokens
        per[r.id].append(r)
    assert max(filled.values()) <= 2048 and set(per) == set(sizes)
    for i, pieces in per.items():
        assert sum(p.n_tokens for p in pieces) == sizes[i]
        assert sorted(p.piece_no for p in pieces) == list(range(len(pieces))) and len(pieces) == max(1, -(-sizes[i] // 2048))
    used = [n for n in filled.values() if n]
    assert sum(used) / 2048 / len(used) > 0.97


@needs_vocabulary
def test_sources_keep_their_shares(spark, data):
    df = read_table(spark, data.replace("sf0.001", "sf0.1"), "documents")
    blocks = mixture(pack_documents(df, PATH)).orderBy("block").collect()
    full = [b for b in blocks if b.containers == 150]
    assert len(full) >= 9 and all(b.l1 < 0.1 and b.fill >= 0.99 for b in full)


def test_mixture_counts(spark):
    rows = [(1, "a", 1024, 1), (2, "b", 1024, 1), (3, "a", 2048, 2), (4, None, 0, 0), (5, "b", 2048, SPAN + 1)]
    got = mixture(spark.createDataFrame(rows, "id long, source string, n_tokens int, container_no long"), every=1).orderBy("shard", "block").collect()
    assert [(b.shard, b.block, b.containers, b.fill, b.l1) for b in got] == [(0, 0, 1, 1.0, 0.0), (0, 1, 1, 1.0, 1.0), (1, 0, 1, 1.0, 1.0)]


@needs_vocabulary
def test_packing_special_rows(spark):
    rows = [(1, None, "a", 0), (2, "", None, 0), (3, "word " * 5000, "b", 0), (4, "short", None, 0), (None, "x", "a", 0)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, shard long"), PATH).collect()
    assert sorted((r.id, r.piece_no, r.n_tokens, r.source) for r in got)[:2] == [(1, 0, 0, "a"), (2, 0, 0, None)]
    assert [r.n_tokens for r in sorted((r for r in got if r.id == 3), key=lambda r: r.piece_no)] == [2048, 2048, 905]
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string, source string"), PATH).count() == 0


# cut-off texts --------------------------------------------------------------------

WHOLE = [
    "A sentence ends here.", 'He said "so."', "A question?  \n", "The end.\nFINIS", "All are agreed.\nAyes 7, Noes 4, Absent 2", "It was done.\n* * *", "We met.\nI am, Sir,\nYour humble servant,\nArchibald Haskstead",
    "The list.\n- liberty\n- orders\n- fines", "The list.\n1. The colony\n2. The states", "It was so.\n[To be continued in our next]", "It was so.\nSigned at Brinmouth", "What then...?", "And so on, &c. &c.", "(See the printed papers.)",
]
CUT = ["Of the numbers then at Oskstow, scarc", "men prefer by exports what ", "a vigilant harbour was [...]", "until the clerk (more)", "the consent of the…", "which had been put o...", "With respect,\nRichard", "The list.\n1. The colony\n2. The"]


def docs(spark, texts):
    return spark.createDataFrame([(k, t, f"s{k % 2}", "clash", 1) for k, t in enumerate(texts)], "doc_id long, text string, source string, kind string, id long")


def test_cut_texts(spark):
    texts = WHOLE + CUT + [None, "", " \n"]
    got = {r.id for r in cut_texts(docs(spark, texts)).collect()}
    assert got == set(range(len(WHOLE), len(WHOLE) + len(CUT)))


def test_formulas_and_broken_closes(spark):
    texts = [f"The clerk rose on day {k}. He paused..." for k in range(6)] + ["He paused in the..."]
    assert {r.id for r in cut_texts(docs(spark, texts)).collect()} == {6}
    signed = [f"It was {k}.\nWith respect,\nRichard Pemcombe" for k in range(20)] + ["It was so.\nWith respect,\nRichard Pemc"]
    assert {(r.id, r.reason) for r in cut_texts(docs(spark, signed)).collect()} == {(20, "close")}


def test_copies_make_no_formula(spark):
    copied = ["The clerk rose. The ship sailed for Elvholm..."] * 5
    assert {r.id for r in cut_texts(docs(spark, copied)).collect()} == set(range(5))
    signed = [f"It was {k}.\nWith respect,\nRichard Pemcombe" for k in range(20)] + ["It was so.\nWith respect,\nRichard Pemc"] * 9
    assert {(r.id, r.reason) for r in cut_texts(docs(spark, signed)).collect()} == {(k, "close") for k in range(20, 29)}
    assert {r.source: r.cut for r in cut_shares(docs(spark, copied)).collect()} == {"s0": 3, "s1": 2}


def test_prefixes(spark):
    long = "This opening of the text is shared by many of the copies that were sent, " + "and more follows here " * 5
    texts = [long, long[:60], long[:60], long, long[:90] + "x", "short", "short one"] + [long + f"{k:02}" for k in range(30)]
    assert {r.id for r in prefixes(docs(spark, texts), "doc_id", "text").collect()} == {0, 1, 2, 3}
    got = {(r.id, r.reason) for r in cut_texts(docs(spark, texts[:5])).collect()}
    assert (1, "prefix") in got and (2, "prefix") in got


def test_shares(spark):
    rows = {r.source: (r.texts, r.cut) for r in cut_shares(docs(spark, ["Whole.", "cut off he", "Whole.", "Whole.", None])).collect()}
    assert rows == {"s0": (2, 0), "s1": (2, 1)}
    assert cut_texts(docs(spark, []).limit(0)).count() == 0 and cut_shares(docs(spark, []).limit(0)).count() == 0
