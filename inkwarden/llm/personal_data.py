"""Personal information in free text: candidates, weak labellers, reliabilities by expectation-maximisation, span classifier.

Lines of a document are read as one running text, so a value may go on on the next line. Broad patterns propose spans;
labellers (strict formats, check digits, gazetteers, words before and after) vote on each; expectation-maximisation
estimates how far each labeller can be trusted; a logistic span classifier is trained on the resulting probabilities and
decides alone. Gazetteers of given names and family names are induced from the text itself, from titles outwards.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np

from inkwarden.llm.unicode_forms import LOOKALIKES

KINDS = ("email", "phone", "national_id", "address", "name")
LABELLERS = {
    "email": ("tld", "local", "sign"), "phone": ("format", "cue", "bad"), "national_id": ("format", "cue", "bad", "tel"),
    "address": ("cue", "tail", "start", "number"), "name": ("family", "given", "title", "cue", "after", "ordinary"),
}
STATED = 3  # times each single vote is among what the classifier is fitted on
BREAK = "\x00"  # between documents; no pattern crosses it

# --- a copy of the text in which look-alike forms are plain, with the place of each character in the original ---

_TABLE = {ord(k): v for k, v in LOOKALIKES.items()}
_TABLE |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_TABLE |= {c: " " for c in (0xA0, 0x2007, 0x202F, 0x3000, 0x1680, *range(0x2000, 0x200B))}
_TABLE |= {0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0xAC: "-"}
_DROPPED = re.compile("[­​-‏⁠-⁤﻿̀-ͯ\x01-\x08\x0e-\x1f]")
_CYRILLIC_WORD = re.compile(r"[^\W\d_]+")


def _plain_word(m: re.Match) -> str:
    w = m.group()
    if w.isascii() or not any("a" <= c <= "z" or "A" <= c <= "Z" for c in w):
        return w
    return w.translate(_TABLE)


def scan_copy(text: str) -> str:
    """Same text for scanning. Look-alikes are mapped in mixed words only; invisible characters and accents are dropped."""
    if text.isascii() and not _DROPPED.search(text):
        return text
    wide = "".join(_TABLE[o] if (o := ord(c)) in _TABLE and (o > 0x2000 or o in (0xA0, 0xAC)) else c for c in text)
    return _CYRILLIC_WORD.sub(_plain_word, _DROPPED.sub("", wide))


def scan_places(text: str) -> list[int]:
    """Place in ``text`` of each character of its scanning copy, and the end."""
    return [i for i, c in enumerate(text) if not _DROPPED.match(c)] + [len(text)]


# --- checks ---


def nhs_valid(digits: str) -> bool:
    if len(digits) != 10:
        return False
    check = 11 - sum(int(d) * w for d, w in zip(digits, range(10, 1, -1), strict=False)) % 11
    return check != 10 and (0 if check == 11 else check) == int(digits[9])


def luhn_valid(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


# --- candidates ---

_AT = re.compile(r"@|[(\[{]\s?at\s?[)\]}]|(?<=\w)\s+at\s+(?=[\w-]+\s+dot\s|[\w-]+\s*[\[({]\s?dot|[\w-]+\s+\.\s+\w)", re.I)
_LOCAL = re.compile(r"(?:[\w.+%]+-\n)?[\w+%][\w.+%\-]*\s{0,2}$")
_DOT = r"(?:\.\n?|\s{1,2}\.\s{1,2}|\s{0,2}[\[({]\s?dot\s?[\])}]\s{0,2}|\s+dot\s+)"
_DOMAIN = re.compile(rf"\s{{0,2}}([\w-]+(?:{_DOT}[\w-]+)+)", re.I)
_TLD = frozenset("com org net edu gov int info biz io eu uk de fr us ca au nl be ch at es it co ie example test invalid localhost".split())

_NUMBER = re.compile(r"(?<![\w.,/#+-])(?:\+\s?|\()?\d(?:[\d()./-]|\s(?=[\d(]))*\d(?:,?\s+(?:ext|x|Durchwahl)\.?\s*\d{1,5})?(?!\w)")
_CODE = re.compile(r"\b[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b")
_NINO = re.compile(r"[ABCEGHJKLMNOPRSTWXYZ][ABCEGHJKLMNPRSTWXYZ]\d{6}[A-D]")
_SSN = re.compile(r"(?!000|666|9\d\d)\d{3}([- ])(?!00)\d{2}\1(?!0000)\d{4}")
_PHONES = [
    ("nanp", re.compile(r"(?:\+1[-. ])?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?:,? (?:ext|x)\.? ?\d+)?")),
    ("plus", re.compile(r"\+\d{1,3}[-. ]?(?:\(0\))?[\d ./()-]{6,16}\d")),
    ("00", re.compile(r"00 ?\d{2}[\d ./()-]{6,16}\d")),
    ("uk", re.compile(r"(?:\(0\d{3,4}\)|0\d{2,4})[- ]?\d{3,4}[- ]?\d{3,4}")),
    ("fr", re.compile(r"0\d(?:([. ])\d\d)(?:\1\d\d){3}")),
]
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{2,4}")
_SPLIT_NUMBER = re.compile(r"\s+")

_STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Way|Close|Crescent|Terrace|Place|Court|Square|Gardens|Hill|Row|Boulevard|Blvd)"
_WORDS = r"(?:[A-Z][\w'’]*\s){1,3}"
_ADDRESS = re.compile(
    rf"(?<![\w.,/-])(?:(?P<flat>(?i:flat|apt|unit|suite)\s\d+[A-Za-z]?,\s)?(?P<house>\d{{1,4}}\s?[A-Za-z]?),?\s(?!The\b){_WORDS}(?i:{_STREET})\b"
    r"|(?P<rue>\d{1,4}(?:\s?bis|\s?ter)?,?\s(?i:rue|avenue|boulevard|place|chemin|allée|quai|impasse)\s(?:(?i:de la|de l'|du|des|de|d')\s?)?[A-Z]\w+)"
    r"|(?P<str>\b[A-ZÄÖÜ][\wäöüß]*[\s-]?(?i:stra(?:ß|ss)e|strasse|str\.|weg|allee|gasse|platz)\s\d{1,4}\s?[a-z]?\b)"
    r"|(?P<box>(?i:p\.?\s?o\.?\s?box|post(?:al)?\s(?:office\s)?box|postfach|boîte\spostale)\s\d+))"
)
_TAIL = re.compile(r"(?:\.?,?\s(?:(?i:apt|flat|unit)\s\d+[A-Za-z]?,\s)?(?:\d{5}\s)?[A-Z][\w]+(?:,?\s[A-Z]{2}\s?\d{5}|\s[A-Z]{2}\d{1,2}\s\d[A-Z]{2})?)?")

_CAP = re.compile(r"(?<![\w@.+%-])[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:['’][^\W\d_]+)?(?:-\n?[A-ZÀ-ÖØ-Þ][^\W\d_]+)*(?![\w@])")
_GAP = re.compile(r"[.,]?\s{1,2}|\.\s?")
TITLES = frozenset("Mr Mrs Ms Miss Mx Dr Prof Sir Dame Rev Herr Frau Mme Mlle MR MRS MS DR PROF".split())

# Given names common in public name lists; the rest is induced.
GIVEN = frozenset(
    """anna maria elena nadia olga marta lena nora sofia laura julia sarah emma grace rose chloe zoe freya ingrid helga greta carla
    amara aisha priya mei yuki ewa sana tomas thomas stefan viktor pavel bruno rafael mateo diego hugo luc mark will jonas oskar
    anders ravi samir hamid idris kofi emre david peter paul john james robert michael daniel martin simon ivan carlos""".split()
)

_PLACE = re.compile(_STREET + r"|building|house|hall|office|centre|center|park|bridge|station", re.I)
_NEXT = re.compile(r"\W*(\w+)?\W*(\w+)?")
_BEFORE = re.compile(r"(\w+)?\W*(\w+)?([^\w\n]*\n?[^\w\n]*)$")


@dataclass
class Span:
    start: int
    end: int
    kind: str
    features: list[str]
    votes: dict[str, int] = field(default_factory=dict)


def _around(text: str, start: int, end: int) -> list[str]:
    m = _BEFORE.search(text, max(0, start - 40), start)
    w1, w2, gap = (m.group(1), m.group(2), m.group(3)) if m else (None, None, "")
    if w2 is None:
        w1, w2 = None, w1
    n = _NEXT.match(text, end, min(len(text), end + 40))
    norm = lambda w: "-" if w is None else re.sub(r"\d", "9", w.lower())
    at_start = "\n" in gap or BREAK in gap or start == 0
    out = [f"b1={norm(w2)}", f"b2={norm(w1)} {norm(w2)}", f"gap={gap.strip()[-2:]}", f"a1={norm(n.group(1))}", f"a2={norm(n.group(1))} {norm(n.group(2))}"]
    if at_start:
        out.append("line_start")
    return out


# Words of general use before (or after) a value that speak for or against it.
_ID_CUES = frozenset("ssn nhs ni nino number no identity id insurance social security national".split())
_ID_BAD = frozenset("order invoice part lot file item reference ref case ticket".split())
_PHONE_CUES = frozenset("tel telephone t phone dial call fax mobile cell ring reach reached contact".split())
_PHONE_BAD = frozenset("order invoice form part lot file item reference ref card account".split())
_PLACE_CUES = frozenset("to at in near from address visited lives".split())
_NAME_AFTER = frozenset("called and wrote said".split())
_NAME_CUES = frozenset("dear by with for from attendee signed regards sincerely cc".split())


def _emails(text: str) -> Iterable[Span]:
    for m in _AT.finditer(text):
        local = _LOCAL.search(text, max(0, m.start() - 70), m.start())
        domain = _DOMAIN.match(text, m.end(), min(len(text), m.end() + 120))
        if not local or not local.group().strip():
            continue
        if not domain:
            continue
        parts = re.split(_DOT, domain.group(1), flags=re.I)
        # a full stop at a line's end may belong to the sentence: keep the longest run that ends in a top-level name
        last = max((i for i, p in enumerate(parts) if i and p.lower() in _TLD), default=0)
        known = last > 0
        wrapped = "\n" in domain.group(1)
        if wrapped and not known:
            continue
        sign = "@" if m.group() == "@" else m.group().strip().lower()
        f = [f"sign={sign}", "tld" if known else "no_tld", f"parts={min(4, len(parts))}"]
        v = {"tld": 1 if known else -1, "local": 1 if len(local.group().strip()) > 2 else -1, "sign": 1 if sign != "at" or known else -1}
        start = local.start()
        if text[start : start + 1] == "-":
            start += 1
        yield Span(start, domain.end(), "email", f + _around(text, start, domain.end()), v)


_PIECE = re.compile(r"\S+")
_NHS = re.compile(r"\d{3}[ -]?\d{3}[ -]?\d{4}")


def _number_kind(t: str) -> tuple[str, str] | None:
    if _DATE.fullmatch(t):
        return None
    if _SSN.fullmatch(t):
        return "national_id", "ssn"
    if _NHS.fullmatch(t) and nhs_valid(re.sub(r"\D", "", t)):
        return "national_id", "nhs"
    shape = next((name for name, p in _PHONES if p.fullmatch(t)), None)
    return shape and ("phone", shape)


def _number_spans(text: str) -> Iterable[tuple[int, int, str, str, str]]:
    """Numbers of a known shape within a run of digits and separators, the longest first from each piece on."""
    for m in _NUMBER.finditer(text):
        raw, at = m.group(), m.start()
        if len(raw) < 8:
            continue
        pieces = [(p.start(), p.end()) for p in _PIECE.finditer(raw)]
        i = 0
        while i < len(pieces):
            for j in range(min(len(pieces), i + 7), i, -1):
                start, end = pieces[i][0], pieces[j - 1][1]
                t = raw[start:end]
                lean = t.rstrip(".,/-(")
                end -= len(t) - len(lean)
                if lean[:1] == "(" and ")" not in lean:
                    lean, start = lean[1:], start + 1
                if len(lean) < 9 or sum(map(str.isdigit, lean)) > 15:
                    continue
                lean = _SPLIT_NUMBER.sub(" ", lean)
                known = _number_kind(lean)
                if known:
                    yield at + start, at + end, lean, *known
                    i = j - 1
                    break
            i += 1


def _numbers(text: str) -> Iterable[Span]:
    for start, end, t, kind, shape in _number_spans(text):
        around = _around(text, start, end)
        before = {around[0][3:], *around[1][3:].split(" ")}
        digits = re.sub(r"\D", "", t)
        f = [f"fmt={shape}", f"digits={len(digits)}", f"form={re.sub(r'[0-9]', '9', t)[:22]}"]
        if kind == "national_id":
            votes = {"format": 1, "cue": 1 if before & _ID_CUES else 0, "bad": -1 if before & _ID_BAD else 0, "tel": -1 if around[0][3:] in ("tel", "phone", "fax") else 0}
            if shape == "nhs" and " " not in t and "-" not in t:
                votes["format"] = 0
        else:
            votes = {
                "format": 1 if not t.isdigit() or t.startswith("0") else -1,
                "cue": 1 if before & _PHONE_CUES else 0,
                "bad": -1 if before & _PHONE_BAD else 0,
            }
            if len(digits) >= 13 and luhn_valid(digits) and not t.startswith(("+", "00")):
                votes["bad"] = -1
        yield Span(start, end, kind, f + around, votes)


def _codes(text: str) -> Iterable[Span]:
    for m in _CODE.finditer(text):
        ok = bool(_NINO.fullmatch(re.sub(r"\s", "", m.group())))
        if not ok:
            continue
        around = _around(text, m.start(), m.end())
        before = {around[0][3:], *around[1][3:].split(" ")}
        votes = {"format": 1, "cue": 1 if before & _ID_CUES else 0, "bad": -1 if before & _ID_BAD else 0, "tel": 0}
        yield Span(m.start(), m.end(), "national_id", ["fmt=nino", *around], votes)


def _addresses(text: str) -> Iterable[Span]:
    for m in _ADDRESS.finditer(text):
        shape = next(k for k in ("house", "rue", "str", "box") if m.group(k))
        end = m.end()
        tail = _TAIL.match(text, end)
        if tail:
            end = tail.end()
        around = _around(text, m.start(), m.end())
        before = {around[0][3:], *around[1][3:].split(" ")}
        f = [f"shape={shape}", "flat" if m.group("flat") else "no_flat", "tail" if tail and tail.group() else "no_tail"]
        votes = {
            "cue": 1 if before & _PLACE_CUES else 0, "tail": 1 if tail and tail.group() else 0, "start": 1 if "line_start" in around else 0,
            "number": 1 if m.group("flat") or m.group("house") or m.group("box") else 0,
        }
        yield Span(m.start(), end, "address", f + around, votes)


@dataclass
class Gazetteer:
    given: set[str] = field(default_factory=lambda: set(GIVEN))
    family: set[str] = field(default_factory=set)
    endings: set[str] = field(default_factory=set)

    def role(self, word: str) -> str:
        """T title, I initial, G given, F family, O other."""
        if word in TITLES:
            return "T"
        if len(word) == 1:
            return "I"
        low = word.lower()
        if low in self.given:
            return "G"
        if low in self.family:
            return "F"
        parts = re.split(r"-\n?", low)
        if all(p in self.family or (len(p) > 5 and p[-4:] in self.endings) for p in parts):
            return "F"
        return "O"


def cap_tokens(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group()) for m in _CAP.finditer(text)]


def _parts(word: str) -> list[str]:
    return re.split(r"-\n?", word.lower())


def name_counts(text: str, own: Callable[[int], bool] = lambda _: True) -> tuple[Counter, Counter]:
    """Counts of capitalised words (parts, lower case) and of neighbouring ones (word, next word, mark between).

    ``own`` says by its place whether a word counts here; a pair counts where its first word does.
    """
    tokens = cap_tokens(text)
    total, linked = Counter(), Counter()
    for k, a in enumerate(tokens):
        if not own(a[0]):
            continue
        total.update(_parts(a[2]))
        if k + 1 < len(tokens):
            b = tokens[k + 1]
            if b[0] - a[1] <= 3 and _GAP.fullmatch(gap := text[a[1] : b[0]]):
                linked[a[2], b[2], gap.strip()] += 1
    return total, linked


def in_family_places(linked: Iterable[tuple[str, str, str, int]], g: Gazetteer) -> Counter:
    """How often each word stands where a family name would: after titles, initials and given names, or before them."""
    seen: Counter = Counter()
    for a, b, gap, n in linked:
        role = "T" if a in TITLES else "I" if len(a) == 1 else "G" if a.lower() in g.given else "O"
        if len(b) > 3 and b.lower() not in g.given and (role == "T" or role == "G" and not gap or role == "I" and gap == "."):
            for w in _parts(b):
                seen[w] += n
        if gap == "," and b.lower() in g.given and len(a) > 3:
            for w in _parts(a):
                seen[w] += n
    return seen


def before_families(linked: Iterable[tuple[str, str, str, int]], g: Gazetteer) -> Counter:
    """How often each word stands right before a family name."""
    seen: Counter = Counter()
    for a, b, gap, n in linked:
        if not gap and len(a) > 1 and a not in TITLES and "-" not in a and g.role(b.lower()) == "F":
            seen[a.lower()] += n
    return seen


class Counts:
    """Counts of one text, and what :func:`induce` asks of them."""

    def __init__(self, total: Counter, linked: Counter):
        self.total, self.linked = total, [(*k, n) for k, n in linked.items()]

    def families(self, g: Gazetteer) -> set[str]:
        return {w for w, n in in_family_places(self.linked, g).items() if n >= 0.4 * self.total[w] and len(w) > 3}

    def with_endings(self, endings: set[str], g: Gazetteer) -> dict[str, int]:
        """Number of longer words with each ending, given names aside."""
        return Counter(w[-4:] for w in self.total if len(w) > 5 and w[-4:] in endings and w not in g.given)

    def givens(self, g: Gazetteer) -> set[str]:
        return {w for w, n in before_families(self.linked, g).items() if n >= max(2, 0.25 * self.total[w]) and len(w) > 2}


def induce(counts: Counts, rounds: int = 3) -> Gazetteer:
    """Given and family names, from where capitalised words stand: after titles, initials and given names, or before them.

    A word is a family name if it mostly stands in such places; an ending is one of family names if most words with it
    are; a word that stands before family names often enough is a given name. ``counts``: see :class:`Counts`.
    """
    g = Gazetteer()
    for _ in range(rounds):
        old = (g.family, g.endings, len(g.given))
        g.family = counts.families(g)
        types = {e: n for e, n in Counter(w[-4:] for w in g.family if len(w) > 5).items() if n >= 4}
        whole = counts.with_endings(set(types), g) if types else {}
        g.endings = {e for e, n in types.items() if n >= 0.5 * whole.get(e, 0)}
        g.given |= {w for w in counts.givens(g) if g.role(w) != "F"}
        if old == (g.family, g.endings, len(g.given)):
            break
    return g


def _names(text: str, g: Gazetteer) -> Iterable[Span]:
    tokens = cap_tokens(text)
    roles = [g.role(t[2]) for t in tokens]
    n, i = len(tokens), 0

    def joined(k: int, comma: bool = False) -> bool:
        if k + 1 >= n or tokens[k + 1][0] - tokens[k][1] > 3:
            return False
        gap = text[tokens[k][1] : tokens[k + 1][0]]
        if comma:
            return gap.startswith(",") and gap[1:].isspace()
        if gap.isspace():
            return True
        return gap.startswith(".") and roles[k] in "TI" and (gap[1:].isspace() or not gap[1:])

    while i < n:
        r, j, got = roles[i], i, None
        if r == "O" or r == "I" and not joined(i):
            # an unknown capitalised word before a family name is a candidate too
            if r == "O" and joined(i) and roles[i + 1] == "F":
                got = (i, i + 1)
        elif r == "T":
            while joined(j) and roles[j + 1] in "GI" and j - i < 4:
                j += 1
            if joined(j) and roles[j + 1] in "FO":
                got = (i, j + 1)
            elif j > i:
                got = (i, j)
        elif r in "GI":
            while joined(j) and roles[j + 1] in "GI" and j - i < 3:
                j += 1
            if joined(j) and roles[j + 1] in "FO":
                got = (i, j + 1)
        elif r == "F":
            if joined(i, comma=True) and roles[i + 1] in "GI":
                got = (i, i + 1)
            elif joined(i) and roles[i + 1] == "G" and not (joined(i + 1) and roles[i + 2] == "F"):
                got = (i, i + 1)
        if not got:
            i += 1
            continue
        a, b = got
        start, end = tokens[a][0], tokens[b][1]
        shape = "".join(roles[a : b + 1])
        around = _around(text, start, end)
        upper = tokens[b][2].isupper() or tokens[a][2].isupper() and len(tokens[a][2]) > 1
        votes = {
            "family": 1 if "F" in shape else -1,
            "given": 1 if "G" in shape else (0 if "T" in shape or "I" in shape else -1),
            "title": 1 if shape[0] == "T" else 0,
            "cue": 1 if around[0][3:] in _NAME_CUES else 0,
            "after": 1 if around[3][3:] in _NAME_AFTER else (-1 if _PLACE.fullmatch(around[3][3:]) else 0),
            "ordinary": -1 if "O" in shape and (shape[0] == "O" or shape[0] == "G" and not tokens[b][2][1:].islower()) else 0,
        }
        yield Span(start, end, "name", [f"roles={shape}", f"upper={upper}", f"end={tokens[b][2][-4:].lower()}", *around], votes)
        i = b + 1 if "O" not in shape else i + 1


def candidates(text: str, g: Gazetteer) -> list[Span]:
    spans = [*_emails(text), *_numbers(text), *_codes(text), *_addresses(text), *_names(text, g)]
    spans.sort(key=lambda s: (s.start, -s.end))
    return spans


# --- reliabilities and classifier ---


def reliabilities(votes: np.ndarray, prior: float = 0.7, rounds: int = 30, trust: float = 0.85, strength: float = 20.0) -> np.ndarray:
    """Probability that each row is true, from votes in {-1, 0, 1}.

    Each labeller is right with its own probability when it votes; an abstention says nothing. The probabilities start
    at ``trust`` with the weight of ``strength`` votes and stay above one half.
    """
    right = np.full(votes.shape[1], trust)
    q = np.full(len(votes), prior)
    for _ in range(rounds):
        log = np.log(prior / (1 - prior)) + votes @ np.log(right / (1 - right))
        q = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        agree = (q[:, None] * (votes == 1) + (1 - q)[:, None] * (votes == -1)).sum(axis=0)
        right = np.clip((agree + trust * strength) / ((votes != 0).sum(axis=0) + strength), 0.55, 0.99)
    return q


@dataclass
class Model:
    gazetteer: Gazetteer
    weights: dict[str, dict[str, float]]

    def keeps(self, s: Span) -> bool:
        w = self.weights[s.kind]
        return w["bias"] + sum(w.get(f, 0.0) for f in s.features) + sum(w.get(f"{k}:{v}", 0.0) for k, v in s.votes.items() if v) > 0


def _fit_logistic(rows: list[list[str]], target: np.ndarray, rounds: int = 60, decay: float = 2e-3) -> dict[str, float]:
    count = Counter(f for r in rows for f in r)
    ids = {f: i + 1 for i, f in enumerate(sorted(f for f, n in count.items() if n >= 3))}
    who = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)]) if rows else np.zeros(0, int)
    what = np.array([ids.get(f, -1) for r in rows for f in r])
    who, what = who[what > 0].astype(int), what[what > 0]
    w = np.zeros(len(ids) + 1)
    grad2 = np.full(len(w), 1e-8)
    for _ in range(rounds):
        z = np.bincount(who, weights=w[what], minlength=len(rows)) + w[0]
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.bincount(what, weights=err[who], minlength=len(w))
        grad[0] = err.sum()
        grad = grad / len(rows) + decay * w * (np.arange(len(w)) > 0)
        grad2 += grad**2
        w -= 0.5 * grad / np.sqrt(grad2)
    return {"bias": float(w[0])} | {f: float(w[i]) for f, i in ids.items() if abs(w[i]) > 1e-3}


def train(text: str, g: Gazetteer | None = None) -> Model:
    """Fits the classifier on one sample text (documents separated by BREAK), and the gazetteers where none are given."""
    g = g or induce(Counts(*name_counts(text)))
    by_kind: dict[str, list[Span]] = defaultdict(list)
    for s in candidates(text, g):
        by_kind[s.kind].append(s)
    weights = {}
    for kind in KINDS:
        spans = by_kind[kind]
        names = LABELLERS[kind]
        # beside the spans, every way a single labeller can vote: what a kind of few spans is decided by
        alone = [{n: v} for n in names for v in (1, -1)] * STATED
        held = [s.votes for s in spans] + alone
        votes = np.array([[v.get(k, 0) for k in names] for v in held])
        q = reliabilities(votes)
        rows = [(s.features if s else []) + [f"{k}:{x}" for k, x in v.items() if x] for s, v in zip([*spans, *[None] * len(alone)], held, strict=True)]
        weights[kind] = _fit_logistic(rows, q)
    return Model(g, weights)


_COUNTED = re.compile(r"\d+|\b[ivxl]+\b")
_PAGE_MARK = re.compile(r"\W*(?:(?:page|seite|p\.?|pg\.?|blatt|sheet)\s*)?(?:\d{1,4}|[ivxl]{1,6})(?:\s*(?:/|of|von|de|sur)\s*\d{1,4})?\W*", re.I)


def furniture(texts: list[str], pages: list[int], from_top: list[int], from_foot: list[int], depth: int = 3) -> list[bool]:
    """Lines of one document at the head or foot of a page that repeat on another page, digits aside, or number it.

    Only to let a value go on over a page break; no line is lost to the search by it.
    """
    edge = [(a < depth or b < depth) and bool(t.strip()) for t, a, b in zip(texts, from_top, from_foot, strict=True)]
    key = [_COUNTED.sub("9", t.lower()).strip() if e else "" for t, e in zip(texts, edge, strict=True)]
    on = defaultdict(set)
    for k, e, p in zip(key, edge, pages, strict=True):
        if e:
            on[k].add(p)
    out = []
    for t, k, e, a, b in zip(texts, key, edge, from_top, from_foot, strict=True):
        out.append(e and (len(on[k]) > 1 or "|" in t and (a < 2 or b < 2) or bool(_PAGE_MARK.fullmatch(t)) or t.strip().isupper() and len(t.split()) <= 2))
    return out


def find(lines: list[str], model: Model) -> list[tuple[int, int, int, int, str]]:
    """(line, start, end line, end, kind) of the spans in lines (scanning copies). Spans of one kind don't overlap."""
    starts, at = [], 0
    for x in lines:
        starts.append(at)
        at += len(x) + 1
    text = "\n".join(lines)
    out, until = [], dict.fromkeys(KINDS, -1)
    taken = -1
    for s in candidates(text, model.gazetteer):
        if s.start < until[s.kind] or not model.keeps(s) or s.kind == "name" and s.start < taken:
            continue
        until[s.kind] = s.end
        if s.kind in ("address", "email"):
            taken = max(taken, s.end)
        a, b = bisect_right(starts, s.start) - 1, bisect_right(starts, s.end - 1) - 1
        out.append((a, s.start - starts[a], b, s.end - starts[b], s.kind))
    return out


def placeholder(kind: str) -> str:
    return f"[{kind.upper()}]"
