"""Names as people type them: parsing, typing errors, and candidate keys for joins.

Shared by the transcript and the author operators. Names meet over the keys that
are left when up to two letters are deleted from a word (both sides), so that
candidates for a name are found by an equi-join and no list of names is compared
with all others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

#: English short forms that are no beginnings of the name. Fixed values.
NICKNAMES = {
    "abby": "abigail", "abe": "abraham abel", "aggie": "agnes agatha", "alec": "alexander", "archie": "archibald", "barney": "barnabas bernard", "becky": "rebecca", "bell": "isabella arabella", "bess": "elizabeth",
    "bessy": "elizabeth", "beth": "elizabeth", "betsey": "elizabeth", "betsy": "elizabeth", "betty": "elizabeth", "biddy": "bridget", "bill": "william", "billy": "william",
    "bob": "robert", "bobby": "robert", "carrie": "caroline", "charley": "charles", "charlie": "charles", "chuck": "charles", "cissy": "cecilia", "cy": "cyrus",
    "dick": "richard", "dickon": "richard", "dodie": "dorothy dorothea", "dolly": "dorothy dorothea", "dora": "dorothea theodora isidora", "dot": "dorothy dorothea", "eddy": "edward edmund", "effie": "euphemia",
    "essie": "esther", "etta": "henrietta", "fanny": "frances", "frank": "francis", "gerry": "gerald", "ginny": "virginia", "greta": "margaret", "gus": "augustus",
    "hal": "henry harold", "hank": "henry", "harry": "henry harold", "hattie": "harriet", "hetty": "henrietta hester", "hitty": "mehitable", "ike": "isaac", "issy": "isabella isidora",
    "izzy": "isabella isidore isidora", "jack": "john jonathan", "jamie": "james", "jem": "james jeremiah", "jemmy": "james jeremiah", "jenny": "jane janet jennifer", "jerry": "jeremiah gerald", "jim": "james",
    "jimmy": "james", "jock": "john", "johnny": "john jonathan", "kate": "katherine catherine", "kathy": "katherine catherine", "katie": "katherine catherine", "kit": "christopher katherine", "kitty": "katherine catherine",
    "larry": "lawrence", "lettie": "letitia", "lenny": "leonard", "libby": "elizabeth", "lina": "caroline", "lizzie": "elizabeth", "lizzy": "elizabeth", "lotty": "charlotte",
    "madge": "margaret", "maggie": "margaret", "maggy": "margaret", "mamie": "mary", "matty": "martha matilda matthew", "maud": "matilda", "meg": "margaret", "minnie": "wilhelmina", "moll": "mary",
    "molly": "mary", "nabby": "abigail", "nan": "ann anne", "nancy": "ann anne", "nate": "nathan nathaniel", "natty": "nathaniel", "ned": "edward edmund", "nell": "eleanor helen",
    "nelly": "eleanor helen", "nick": "nicholas", "noll": "oliver", "nolly": "oliver", "nora": "eleanor honora", "obie": "obadiah", "patsy": "martha patience", "patty": "martha patricia",
    "peg": "margaret", "peggy": "margaret", "phemie": "euphemia", "pippa": "philippa", "polly": "mary", "rick": "richard", "rob": "robert", "robin": "robert",
    "sadie": "sarah", "sal": "sarah", "sally": "sarah", "sandy": "alexander", "sukey": "susan susannah", "suky": "susan susannah", "susie": "susan susannah", "susy": "susan susannah",
    "tad": "thaddeus", "ted": "edward theodore", "teddy": "edward theodore", "tilly": "matilda", "toby": "tobias", "tom": "thomas", "tommy": "thomas", "tony": "anthony",
    "trudy": "gertrude", "vinny": "vincent", "wat": "walter", "winnie": "winifred", "zack": "zachariah zachary", "zeke": "ezekiel",
}
#: Words around a name that are no part of it. Fixed values.
TITLES = frozenset("mr mrs ms miss madam hon gen dr rev col capt maj gov judge esq esquire ed editor eds papers the by sir lady".split())
#: Words of a transcript's label that name an office. Fixed values.
OFFICES = frozenset("mr mrs ms miss madam hon justice chief j c cj counsel counselor for the petitioner petitioners respondent respondents appellant appellants appellee appellees associate judge esq unknown unidentified speaker audience voice on behalf of".split())
JUNIOR = re.compile(r"\b(?:jr|junr|jun|junior|the younger)\b\.?")
SENIOR = re.compile(r"\b(?:sr|senr|senior|the elder)\b\.?")
LETTERS = re.compile(r"[^\W\d_]+")


def distance(a: str, b: str, most: int) -> int:
    """Edits (a letter in, out, changed, or two neighbours swapped), or ``most + 1`` if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def deletion_keys(word: str) -> set[str]:
    """The word with up to two letters left out (one if it is short)."""
    n = len(word)
    out = {word}
    for k in range(1, (2 if n >= 6 else 1 if n >= 4 else 0) + 1):
        for gone in combinations(range(n), k):
            out.add("".join(c for i, c in enumerate(word) if i not in gone))
    return out


def keys_of(words: Iterable[str]) -> set[str]:
    return {k for w in words if len(w) >= 3 for k in deletion_keys(w)}


@dataclass(frozen=True)
class Person:
    """A name as written: words without titles, and whether it says junior."""

    words: tuple[str, ...]
    junior: bool = False
    comma: bool = False
    extra: frozenset = field(default=frozenset())


@lru_cache(maxsize=100_000)
def read_person(text: str) -> Person:
    low = text.lower().replace("’", "'")
    low = re.sub(r"'s\b", "", low)
    junior = bool(JUNIOR.search(low))
    low = SENIOR.sub(" ", JUNIOR.sub(" ", low))
    words = LETTERS.findall(low)
    return Person(tuple(w for w in words if w not in TITLES), junior, "," in text)


def _subsequence(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


def short_form(short: str, long: str) -> bool:
    """Whether ``short`` abbreviates ``long``: a beginning of it, or its first letter and others in order, as in benj, margt, chas, ct."""
    return 1 < len(short) < len(long) and short[0] == long[0] and (long.startswith(short) or (_subsequence(short, long) and len(short) <= max(5, len(long) - 2)))


#: Log-likelihoods of what may happen to a name on its way through a typist.
EDIT, INITIAL, SHORT, NO_GIVEN, CLASH = math.log(1 / 9), -1.0, -1.2, -2.5, -12.0


def _given(word: str, given: str) -> float:
    if word == given:
        return 0.0
    if len(word) == 1:
        return INITIAL if word == given[0] else CLASH
    if given in NICKNAMES.get(word, "").split():
        return SHORT
    if len(word) >= 4 and len(given) >= 4 and (d := distance(word, given, 2)) <= 2:
        typed = d * EDIT
        return max(typed, SHORT) if short_form(word, given) else typed
    return SHORT if short_form(word, given) else CLASH


def person_likelihood(spelling: str, canonical: str) -> float:
    """Log-likelihood that somebody who meant ``canonical`` wrote ``spelling``; -inf if nearly impossible."""
    v, c = read_person(spelling), read_person(canonical)
    if not v.words or len(c.words) < 2:
        return -math.inf
    given, surname, middle = c.words[0], c.words[-1], c.words[1:-1]
    best = -math.inf
    for at, word in enumerate(v.words):
        if len(word) < 3:
            continue
        d = distance(word, surname, 2)
        if d > 2 or d > len(surname) // 3:
            continue
        rest = v.words[:at] + v.words[at + 1 :]
        score = d * EDIT
        if not rest:
            score += NO_GIVEN
        else:
            score += _given(rest[0], given)
            left = list(rest[1:])
            for m in middle:
                if left and left[0][0] == m[0]:
                    left.pop(0)
                    score -= 0.2
                else:
                    score -= 0.3
            score -= 5.0 * len(left)
        best = max(best, score)
    if v.junior != c.junior:
        best -= 9.0 if v.junior else 4.0
    return best if best > -11 else -math.inf


def far_surname(spelling: str, canonical: str) -> str | None:
    """The word of ``spelling`` taken for the surname, where it is more than one edit from it."""
    surname = read_person(canonical).words[-1:]
    words = [w for w in read_person(spelling).words if len(w) > 2]
    if not surname or not words:
        return None
    d, word = min((distance(w, surname[0], 2), w) for w in words)
    return word if d > 1 else None


#: Words that join the parts of a body's name.
JOINING = frozenset("of the for at and in".split())


def body_words(text: str) -> tuple[str, ...]:
    return tuple(w for w in LETTERS.findall(re.sub(r"['’]s?\b", "", text.lower())) if w not in JOINING)


def body_likelihood(spelling: str, canonical: str) -> float:
    """The same for the name of a body, whose words come in any order; its last word is the place."""
    v, c = list(body_words(spelling)), body_words(canonical)
    if len(v) < 2 or len(c) < 2:
        return -math.inf
    score = 0.0
    for word in reversed(c):
        options = []
        for x in v:
            d = distance(x, word, 2)
            if d <= 2 and d <= len(word) // 3:
                options.append((d * EDIT, x))
            elif word != c[-1] and short_form(x, word):
                options.append((SHORT, x))
        if options:
            s, x = max(options)
            v.remove(x)
            score += s
        elif word == c[-1]:
            return -math.inf
        else:
            score -= 6.0
    score -= 5.0 * len(v)
    return score if score > -9.5 else -math.inf
