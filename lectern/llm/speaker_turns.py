r"""Transcripts into clean, ordered speaker turns.

A finite-state parser goes through each row's text line by line. A line is of one
kind (``blank``, ``header`` of a caption file, cue ``number``, ``time``, ``question``
or ``answer`` of an examination, ``speech``), and ``TRANSITIONS`` says for each state
and kind what is done with it and which state follows. States: ``start`` of a cue or
paragraph, ``header``, ``numbered`` (a number alone, which is a cue's if a time comes
next and else was spoken), ``speech``, ``examined`` (speech after a question, where A. is a
label and no initial). Inside speech, layouts that open with a name (``JUSTICE X:``,
``X, J.:``, ``[Mr. X]``, ``Justice X. --``, ``John X:`` at a line's start, ``<v John X>``)
change the name in force. Times, sounds and marks in brackets of any kind, and
standalone hesitations are taken out; what is left is speech of the name in force.
Round brackets are only taken out around times and sounds, and times of the day stay
where they are spoken (``at 10:30:15``).

Labels and names met in texts are resolved against the register of speakers over
deletion keys of the surname (typing errors, initials, offices, reordered parts);
a label that names an office alone means its only holder.

Rows are put in order within blocks of ``block_seconds`` of a transcript, and only
one summary row a block (last speaker, number of turns) is carried on, so a very
long transcript is spread over many tasks.

Defined results: a row delivered twice counts once; rows without a spoken word are
left out, whoever they name; speech that no label or name explains belongs to the
last speaker before it, and is left out while nobody has been named in the
transcript; null ids are left out; ties in ``start`` are ordered by row id; a null
``start`` comes first; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.names import LETTERS, OFFICES, deletion_keys, distance, keys_of
from lectern.runtime import keep, small_side

BROADCAST_ROWS = 200_000

_OFFICE = r"(?:chief\s+justice|associate\s+justice|justice|judge|mr|mrs|ms|miss|dr|counsel)"
#: Layouts in which a text says who speaks from here on. The group holds the name.
INTRODUCTION = re.compile(
    rf"\[\s*(?P<bracket>(?i:{_OFFICE})\.?\s+[^\[\]:]{{2,40}}?)\s*\]:?"
    rf"|<v(?:\.[\w.]+)?\s+(?P<voice>[^<>]+)>"
    rf"|(?<![\w,])(?P<bench>[A-Za-z][\w'’-]+\s*,\s*(?i:c\.\s*)?[Jj]\.)\s*:(?=\s|$)"
    rf"|(?<![\w'-])(?P<title>(?i:{_OFFICE})\.?\s+[A-Za-z][\w'’-]+)\s*(?::(?=\s|$)|\.\s+--)"
    rf"|(?:^\s*|(?<=[.?!\])}}>*]\s)|(?<=[.?!\])}}>*]\s\s))(?P<capitals>[A-Z][A-Z'’-]{{2,}})\s*:(?=\s|$)"
    rf"|^\s*(?:>>\s*|[-–—]\s+)?(?P<full>[A-Z][\w'’-]*\.?(?:\s+[A-Z][\w'’-]*\.?){{1,3}})\s*:(?=\s|$)"
)
#: What every introduction has one of.
_MAY_INTRODUCE = re.compile(r"[:\[<]|--")
_CLOCK = r"(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d+)?"
_TIME = re.compile(
    rf"(?:{_CLOCK}\s*-->\s*)+(?:{_CLOCK}(?:[ \t]+(?:align|line|position|size|vertical):\S+)*)?"
    r"|\b0\d:\d{2}:\d{2}(?:[.,]\d+)?\b"
    r"|(?<!\bat )(?<!\bby )(?<!\buntil )(?<!\btill )(?<!\bbefore )(?<!\bafter )(?<!\babout )(?<!\baround )(?<!\bsince )\b\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?\b"
)
#: Words of notes on what is heard and not said. Fixed values.
SOUNDS = frozenset(
    "laughter laughs laugh laughing applause applauds inaudible unintelligible indiscernible crosstalk overlap overlapping pause pauses pausing silence noise noises "
    "cough coughs coughing sneeze sneezes sigh sighs sighing music bell bells rings ringing door doors closes opens slams gavel bang bangs chuckle chuckles chuckling murmurs "
    "murmuring whispers whispering shouting gasps crying sobbing recess interruption interposing microphone mic feedback static audio tape nods nodding indicating clears "
    "clearing throat knocking footsteps rustling shuffling thunder unclear garbled beep beeps buzzer gibberish foreign".split()
)
_AROUND = frozenset("in the of a an from and off on to his her their voice voices courtroom court audience paper papers no response phone telephone head shakes language short brief long".split())
_MARK = re.compile(r"\(\([^()]*\)?\)|\[[^\[\]]*\]|\((?P<round>[^()]*)\)|\{[^{}]*\}|<[^<>]*>|\*[^*\n]*\*|[♪♫♬]+|>>+")
_MAY_MARK = re.compile(r"[\[({<*♪♫♬>]")
_MAY_HESITATE = re.compile(r"(?i)(?<![\w'-])(?:[ueahmo][uehmr]|huh)")
_HESITATION = re.compile(r"(?i)(?:--\s*)?(?<![\w'-])(?:u+h+m*|u+m+|e+r+m?|e+h+|a+h+|h+m+|m+h*m+|o+h+|mm+|huh)(?![\w'-])(?:\.\.\.|,|\s*--)?")
#: Fillers, but not where the words before make them speech (what kind of, as you know).
_ASIDE = re.compile(r"(?i)(?<![\w'-])(?<!\bwhat )(?<!\bwhich )(?<!\bthis )(?<!\bany )(?:sort of|kind of),|(?<![\w'-])(?<!\bdo )(?<!\bdid )(?<!\bif )(?<!\bas )you know,|(?<![\w'-])i mean,")
_MAY_ASIDE = re.compile(r"(?i)mean,|know,|of,")
_STUTTER = re.compile(r"(?i)\b([\w']+)\s+--\s+\1\b")
_WORD = re.compile(r"\w")
_FIRST_WORDS = re.compile(r"[^\W\d_]{4,}")


def _unmarked(m: re.Match) -> str:
    """What stays of a mark: round brackets around anything but a time or a sound are speech."""
    inside = m.group("round")
    if inside is None:
        return " "
    words = LETTERS.findall(inside.lower())
    sound = not words or (any(w in SOUNDS for w in words) and all(w in SOUNDS or w in _AROUND for w in words))
    return " " if sound or re.fullmatch(r"[\d:.,\s]*|\d+m\d+s?", inside) else m.group()


def _plainer(text: str) -> str:
    if ":" in text:
        text = _TIME.sub(" ", text)
    return _MARK.sub(_unmarked, text) if _MAY_MARK.search(text) else text


def clean(text: str) -> str:
    """Speech without times, marks and hesitations, in single spaces."""
    text = _plainer(text)
    if _MAY_HESITATE.search(text):
        text = _HESITATION.sub(" ", text)
    if _MAY_ASIDE.search(text):
        text = _ASIDE.sub(" ", text)
    if "--" in text:
        text = _STUTTER.sub(r"\1", text)
    text = re.sub(r"\s+", " ", text)
    return re.sub(r"\s+([,.?!;])", r"\1", text).strip(" ,-")


def spoken(text: str) -> bool:
    """Whether ``clean`` leaves a word, without cleaning where that is plain."""
    text = _plainer(text)
    for m in _FIRST_WORDS.finditer(text):
        if not _HESITATION.fullmatch(m.group()) and m.group().lower() not in ("mean", "know", "sort", "kind"):
            return True
    return _WORD.search(clean(text)) is not None


_HEADER = re.compile(r"\s*(?:WEBVTT|NOTE|STYLE|REGION|X-TIMESTAMP-MAP)(?![\w'’])(?!\s*:)")
_TIME_LINE = re.compile(rf"\s*{_CLOCK}\s*-->\s*(?:{_CLOCK}(?:[ \t]+[a-z]+:\S+)*)?\s*")
_EXAMINED = re.compile(r"\s*([QA])\s*[.:]\s+(?=\S)")

#: (state, kind of line) -> (what is done, next state). ``say``: the line is speech; ``drop``: it
#: is none; ``hold``: a number that waits for the next line; ``cue``: the held number was a cue's;
#: ``release``: it was spoken, and the line is looked at again; ``ask``: speech behind Q. or A.
TRANSITIONS = {
    ("start", "blank"): ("drop", "start"), ("start", "header"): ("drop", "header"), ("start", "number"): ("hold", "numbered"), ("start", "time"): ("drop", "speech"),
    ("start", "question"): ("ask", "examined"), ("start", "answer"): ("say", "speech"), ("start", "speech"): ("say", "speech"),
    ("header", "blank"): ("drop", "start"), ("header", "time"): ("drop", "speech"), ("header", "header"): ("drop", "header"), ("header", "number"): ("drop", "header"),
    ("header", "question"): ("drop", "header"), ("header", "answer"): ("drop", "header"), ("header", "speech"): ("drop", "header"),
    ("numbered", "time"): ("cue", "speech"), ("numbered", "blank"): ("release", "speech"), ("numbered", "header"): ("release", "speech"), ("numbered", "number"): ("release", "speech"),
    ("numbered", "question"): ("release", "speech"), ("numbered", "answer"): ("release", "speech"), ("numbered", "speech"): ("release", "speech"),
    ("speech", "blank"): ("drop", "start"), ("speech", "number"): ("hold", "numbered"), ("speech", "time"): ("drop", "speech"), ("speech", "header"): ("say", "speech"),
    ("speech", "question"): ("ask", "examined"), ("speech", "answer"): ("say", "speech"), ("speech", "speech"): ("say", "speech"),
    ("examined", "blank"): ("drop", "examined"), ("examined", "number"): ("say", "examined"), ("examined", "time"): ("drop", "examined"), ("examined", "header"): ("say", "examined"),
    ("examined", "question"): ("ask", "examined"), ("examined", "answer"): ("ask", "examined"), ("examined", "speech"): ("say", "examined"),
}


def line_kind(line: str) -> str:
    s = line.strip()
    if not s:
        return "blank"
    if s.isdecimal():
        return "number"
    if "-->" in s and _TIME_LINE.fullmatch(line):
        return "time"
    if s[0] in "QA" and (m := _EXAMINED.match(line)):
        return "question" if m.group(1) == "Q" else "answer"
    return "header" if s[0] in "WNSRX" and _HEADER.match(line) else "speech"


def parse(label: str | None, text: str | None, with_text: bool = True) -> list[tuple[int, str | None, str]]:
    """(part, name in force or None, clean speech) for the parts of a row that hold speech; without the speech if it is not wanted.

    The name of part 0 is the label, unless the text opens with a name.
    """
    if not text:
        return []
    out: list[tuple[int, str | None, str]] = []
    part, name, speech, held, state = 0, label, [], None, "start"

    def close() -> None:
        said = " ".join(speech)
        if with_text:
            if (words := clean(said)) and _WORD.search(words):
                out.append((part, name, words))
        elif spoken(said):
            out.append((part, name, ""))

    def turn(to: str) -> None:
        nonlocal part, name, speech
        close()
        part, name, speech = part + 1, to, []

    def say(line: str) -> None:
        at = 0
        if _MAY_INTRODUCE.search(line):
            for m in INTRODUCTION.finditer(line):
                speech.append(line[at : m.start()])
                turn(m.group(m.lastgroup))
                at = m.end()
        speech.append(line[at:])

    for line in text.split("\n"):
        kind = line_kind(line)
        act, state = TRANSITIONS[state, kind]
        if act == "release":
            say(held)
            held = None
            act, state = TRANSITIONS[state, kind]
        if act == "say":
            say(line)
        elif act == "ask":
            m = _EXAMINED.match(line)
            turn(m.group(1))
            say(line[m.end() :])
        elif act == "hold":
            held = line
        elif act == "cue":
            held = None
    if held is not None:
        say(held)
    close()
    return out


def _parsed(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (t, i, s, part, name, words)
            for t, i, s, label, text in zip(*(batch.column(c).to_pylist() for c in range(5)))
            for part, name, words in parse(label, text, with_text)
        ]
        cols = list(zip(*rows)) if rows else [()] * 6
        types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["transcript_id", "seg_id", "start", "part", "name", "speech"])


def label_words(label: str) -> tuple[list[str], bool]:
    """The words of a label that may be names, and whether it names the chief justice's office."""
    low = [w for w in LETTERS.findall(label.lower())]
    return [w for w in low if w not in OFFICES], "chief" in low or re.search(r"\bc\.\s*j\b", label.lower()) is not None


def _label_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, keys = [], []
        for name in batch.column(0).to_pylist():
            words, chief = label_words(name)
            found = keys_of(words) or ({"#chief"} if chief else set())
            names += [name] * len(found)
            keys += found
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys, pa.string())], ["name", "key"])


def _speaker_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, full, role in zip(*(batch.column(c).to_pylist() for c in range(3))):
            words = LETTERS.findall(full.lower())
            for k in deletion_keys(words[-1]) if words else ():
                rows.append((i, full, k))
            if role and "chief" in role.lower():
                rows.append((i, full, "#chief"))
        cols = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], ["speaker_id", "full_name", "key"])


def label_score(label: str, full_name: str) -> float | None:
    """How well a label names a speaker: minus the edits of the surname, less a clash of other words."""
    words, chief = label_words(label)
    if not words:
        return 0.0 if chief else None
    own = LETTERS.findall(full_name.lower())
    best = None
    for i, w in enumerate(words):
        d = distance(w, own[-1], 2)
        if len(w) < 3 or d > 2 or d > len(own[-1]) // 3:
            continue
        clash = sum(min(distance(x, y, 2) / 3 if len(x) > 2 else float(x[0] != y[0]) for y in own[:-1] or [" "]) for x in words[:i] + words[i + 1 :])
        score = -d - 1.5 * clash
        best = score if best is None else max(best, score)
    return best


def _label_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, fulls = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        scores = pa.array([label_score(a, b) for a, b in zip(names, fulls)], pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], ["name", "speaker_id", "score"]).filter(scores.is_valid())


def resolve_labels(labels: DataFrame, speakers: DataFrame) -> DataFrame:
    """name, speaker_id for the labels of column ``name`` that name exactly one speaker best."""
    keys = labels.mapInArrow(_label_keys, "name string, key string")
    known = speakers.select("speaker_id", "full_name", "speaker_role").where("speaker_id is not null and full_name is not null")
    met = keys.join(known.mapInArrow(_speaker_keys, "speaker_id bigint, full_name string, key string"), "key").select("name", "speaker_id", "full_name").distinct()
    w = Window.partitionBy("name").orderBy(F.desc("score"))
    scored = met.mapInArrow(_label_scores, "name string, speaker_id bigint, score double").where("score >= -2.2").withColumn("r", F.rank().over(w))
    return scored.where("r = 1").groupBy("name").agg(F.min("speaker_id").alias("speaker_id"), F.count("*").alias("n")).where("n = 1").drop("n")


def speaker_turns(rows: DataFrame, speakers: DataFrame, *, block_seconds: float = 1800.0, with_text: bool = True) -> DataFrame:
    """transcript_id, turn_no, speaker_id, first_seg_id, last_seg_id and the clean text of every turn."""
    src = rows.select(F.col("transcript_id").cast("bigint"), F.col("seg_id").cast("bigint"), F.col("start").cast("double"), F.col("speakername"), F.col("text")).where(
        "transcript_id is not null and seg_id is not null and text is not null"
    )
    parts = src.mapInArrow(lambda b: _parsed(b, with_text), "transcript_id bigint, seg_id bigint, start double, part int, name string, speech string")
    if not with_text:
        parts = parts.drop("speech")
    parts = keep(parts)
    labels = resolve_labels(parts.select("name").where("name is not null").distinct(), speakers)
    named = parts.join(small_side(keep(labels), BROADCAST_ROWS), "name", "left").withColumn("block", F.coalesce(F.floor(F.col("start") / block_seconds), F.lit(-1)))

    in_block = Window.partitionBy("transcript_id", "block").orderBy("start", "seg_id", "part")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    once = named.withColumn("again", (F.lag("seg_id").over(in_block) == F.col("seg_id")) & (F.lag("part").over(in_block) == F.col("part"))).where("again is null or not again")
    told = keep(once.withColumn("who", F.last("speaker_id", ignorenulls=True).over(so_far)))
    blocks = told.groupBy("transcript_id", "block").agg(F.max_by("who", F.struct("start", "seg_id", "part")).alias("who"))
    before = Window.partitionBy("transcript_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("transcript_id", "block", F.last("who", ignorenulls=True).over(before).alias("carried"))
    spoken = told.join(carried, ["transcript_id", "block"]).withColumn("who", F.coalesce("who", "carried")).where("who is not null")
    opens = F.coalesce(F.lag("who").over(in_block), F.col("carried"))
    spoken = spoken.withColumn("opens", F.when(opens == F.col("who"), 0).otherwise(1))
    spoken = spoken.withColumn("turn", F.sum("opens").over(so_far))
    offsets = spoken.groupBy("transcript_id", "block").agg(F.sum("opens").alias("turns")).select("transcript_id", "block", F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("earlier"))
    numbered = spoken.join(offsets, ["transcript_id", "block"]).withColumn("turn_no", (F.col("earlier") + F.col("turn")).cast("int"))
    order = F.struct("start", "seg_id", "part")
    aggs = [F.min("who").alias("speaker_id"), F.min_by("seg_id", order).alias("first_seg_id"), F.max_by("seg_id", order).alias("last_seg_id")]
    if with_text:
        said = F.array_sort(F.collect_list(F.struct("start", "seg_id", "part", "speech")))
        aggs.append(F.array_join(F.transform(said, lambda x: x["speech"]), " ").alias("text"))
    return numbered.groupBy("transcript_id", "turn_no").agg(*aggs)
