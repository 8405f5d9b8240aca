"""Transcripts: the parser's cases, and the operator against a sequential version."""

import pytest

from lectern.llm import speaker_turns as T
from lectern.runtime import read_table

SPEAKERS = [(1, "Margaret Crimmore", "Justice", "Chief Justice"), (2, "Oliver Lornforde", "Justice", "Associate Justice"), (3, "Valentine A. Vendington", "Mr.", "Advocate"), (4, "Philippa Wexridge", "Ms.", "Advocate")]


@pytest.mark.parametrize(
    "label,text,parts",
    [
        ("A", "[Crosstalk] uh, um...", []),
        ("A", None, []),
        ("A", "00:01:02,500 --> We um, agree -- eh -- here. (Laughter.)", [(0, "A", "We agree here.")]),
        ("SPEAKER", "MR. VENDINGTON: Am I right?", [(1, "MR. VENDINGTON", "Am I right?")]),
        (None, "Crimmore, C.J.: One.\nWEXRIDGE: Two.", [(1, "Crimmore, C.J.", "One."), (2, "WEXRIDGE", "Two.")]),
        ("A", "Said before. [Justice Lornforde] Said after.", [(0, "A", "Said before."), (1, "Justice Lornforde", "Said after.")]),
        ("A", "Justice Lornforde. -- The state may -- may act.", [(1, "Justice Lornforde", "The state may act.")]),
        ("A", "  OSKMORE:  {17.2}  Suppose  it.", [(1, "OSKMORE", "Suppose it.")]),
        ("A", "12\n00:00:01,000 --> 00:00:04,000\nThe case begins.\n\n13\n00:00:04,000 --> 00:00:06,000\nIt goes on.", [(0, "A", "The case begins. It goes on.")]),
        ("A", "WEBVTT\nKind: captions\n\n1\n00:01.000 --> 00:02.000 align:start\n<v John Smith>Hello there.", [(1, "John Smith", "Hello there.")]),
        ("A", "Q. Did you go?\nA. Yes.\nQ. When?", [(1, "Q", "Did you go?"), (2, "A", "Yes."), (3, "Q", "When?")]),
        ("A", "A. B. Carter said so.", [(0, "A", "A. B. Carter said so.")]),
        ("A", "John Smith: May it please.\n>> Mary Jones: It does.", [(1, "John Smith", "May it please."), (2, "Mary Jones", "It does.")]),
        ("A", "It fell at 10:30:15 (see Exhibit A), (Laughter.) not at 00:10:15 noon.", [(0, "A", "It fell at 10:30:15 (see Exhibit A), not at noon.")]),
        ("A", "What kind of, thing, as you know, you know, was it?", [(0, "A", "What kind of, thing, as you know, was it?")]),
        ("A", "The number was\n12\nand no more.\n63", [(0, "A", "The number was 12 and no more. 63")]),
        ("A", "NOTE made by hand\nand kept\n\nThe speech. WEBVTT", [(0, "A", "The speech. WEBVTT")]),
        ("A", "((door closes)) ♪ [bell] ♪ <cough> *applause*", []),
    ],
)
def test_parser(label, text, parts):
    assert T.parse(label, text) == parts
    assert [p[:2] for p in T.parse(label, text, with_text=False)] == [p[:2] for p in parts]


def test_every_state_knows_every_line():
    states, kinds = {s for s, _ in T.TRANSITIONS}, {k for _, k in T.TRANSITIONS}
    assert {(s, k) for s in states for k in kinds} == set(T.TRANSITIONS) and {to for _, to in T.TRANSITIONS.values()} == states


def test_spoken_agrees_with_clean(data):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{data}/casetranscripts.parquet", columns=["text"]).column(0).drop_null().to_pylist()
    for t in [*texts, "uh, um", "You know, I mean,", "I", "er 7", "[x] -- mm", "Uhm... ah", ""]:
        assert T.spoken(t) == (T._WORD.search(T.clean(t)) is not None), t


@pytest.mark.parametrize("label,who", [("Crimmore, C.J.", 1), ("The Chief Justice", 1), ("Hon. O. Lronforde", 2), ("lornforde", 2), ("VENDINGTON:", 3), ("Wexridge (for the petitioner)", 4), ("Unknown", None), ("AUDIENCE", None), ("[Speaker]", None), ("Somebody Else", None)])
def test_labels(spark, label, who):
    speakers = spark.createDataFrame(SPEAKERS, "speaker_id long, full_name string, title string, speaker_role string")
    got = T.resolve_labels(spark.createDataFrame([(label,)], "name string"), speakers).collect()
    assert [r.speaker_id for r in got] == ([who] if who else [])


def sequential(rows, speakers):
    """(transcript, turn, speaker, first, last) in plain Python."""

    def who(name):
        if name is None:
            return None
        words, chief = T.label_words(name)
        if not words:
            return next((i for i, _, _, role in speakers if role == "Chief Justice"), None) if chief else None
        scored = [(s, i) for i, full, *_ in speakers if (s := T.label_score(name, full)) is not None and s >= -2.2]
        best = [i for s, i in scored if s == max(scored)[0]]
        return best[0] if len(best) == 1 else None

    out, seen, state = [], set(), {}
    for r in sorted(rows, key=lambda r: (r.transcript_id, r.start, r.seg_id)):
        if r.seg_id in seen:
            continue
        seen.add(r.seg_id)
        for _, name, _ in T.parse(r.speakername, r.text):
            speaker = who(name) or state.get(r.transcript_id, (None,))[0]
            if speaker is None:
                continue
            last = state.get(r.transcript_id)
            if last and last[0] == speaker:
                out[last[1]][4] = r.seg_id
            else:
                n = out[last[1]][1] + 1 if last else 1
                out.append([r.transcript_id, n, speaker, r.seg_id, r.seg_id])
                state[r.transcript_id] = (speaker, len(out) - 1)
    return {tuple(x) for x in out}


@pytest.mark.parametrize("block", [20.0, 1800.0])
def test_against_sequential(spark, data, block):
    rows, speakers = read_table(spark, data, "casetranscripts"), read_table(spark, data, "speakers")
    got = {tuple(r) for r in T.speaker_turns(rows, speakers, block_seconds=block, with_text=False).select("transcript_id", "turn_no", "speaker_id", "first_seg_id", "last_seg_id").collect()}
    assert got == sequential(rows.collect(), [tuple(r) for r in speakers.collect()])


def test_special_rows(spark):
    speakers = spark.createDataFrame(SPEAKERS, "speaker_id long, full_name string, title string, speaker_role string")
    schema = "transcript_id long, seg_id long, speakername string, text string, start double, part int, block string"
    rows = [(1, 5, "Unknown", "Nobody yet.", 0.5, 0, ""), (1, 1, "wexridge", "First.", 1.0, 0, ""), (1, 1, "wexridge", "First.", 1.0, 0, ""), (1, 3, None, "Still.", 3.0, 0, ""), (1, 2, "Lornforde", "[noise]", 2.0, 0, ""), (1, 4, "", "Tie one.", 3.0, 0, ""), (None, 9, "wexridge", "x", 1.0, 0, ""), (2, None, "wexridge", "x", 1.0, 0, ""), (3, 6, "wexridge", "No time.", None, 0, "")]
    turns = T.speaker_turns(spark.createDataFrame(rows, schema), speakers).orderBy("transcript_id").collect()
    assert [(r.transcript_id, r.turn_no, r.speaker_id, r.first_seg_id, r.last_seg_id, r.text) for r in turns] == [(1, 1, 4, 1, 4, "First. Still. Tie one."), (3, 1, 4, 6, 6, "No time.")]
    assert T.speaker_turns(spark.createDataFrame([], schema), speakers).count() == 0
