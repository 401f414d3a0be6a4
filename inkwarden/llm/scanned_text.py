"""Repairing text of scanned pages: broken words, misread characters, running heads and page numbers.

Misread words: the words of born-digital lines are the trusted vocabulary; every other word of a scanned line meets the
trusted words with which it shares character q-grams (an inverted join), and boosted trees trained on words garbled by
the usual confusions of character recognition decide which replacement, if any, is right. Lines: a classifier of line
pairs decides whether a broken word goes on on the next line of the running text, and one of page-edge lines what is
furniture.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd

from inkwarden.llm.boosting import Boosted
from inkwarden.llm.personal_data import scan_copy

# What character recognition reads for what is printed, as known from published confusion tables.
CONFUSIONS = (
    ("a", "@"), ("b", "6"), ("b", "h"), ("c", "e"), ("d", "cl"), ("d", "c1"), ("e", "c"), ("f", "t"), ("g", "9"), ("g", "q"), ("h", "b"), ("h", "li"),
    ("i", "l"), ("i", "1"), ("l", "1"), ("l", "i"), ("m", "rn"), ("m", "nn"), ("n", "ri"), ("n", "ii"), ("o", "0"), ("s", "5"), ("t", "f"),
    ("li", "h"), ("u", "ii"), ("w", "vv"), ("rn", "m"), ("cl", "d"), ("z", "2"), ("ri", "n"), ("y", "v"), ("o", "c"),
)
_INTO = defaultdict(list)
for _printed, _read in CONFUSIONS:
    _INTO[_read].append(_printed)

_TOKEN = re.compile(r"[^\W_][^\s]*")
_EDGE = re.compile(r"^[^\w@]+|[^\w@]+$")
CODE = r"^[a-z]?\d[\d.,/:-]*[a-z]?$|^\d+(?:st|nd|rd|th)$|^@|://|@.+\.|\.\w+@|\d{3}|\d[.,/:]\d|[+%<>]"
_CODE = re.compile(CODE)
MARKS = "-‐‑‒–¬­−=~"
_BROKEN = re.compile(rf"([^\W\d_][\w@]*(?:-\w+)*)[{MARKS}]\s*$")
_FIRST = re.compile(r"^\W{0,2}([^\W_][\w@]*)")


def word_of(token: str) -> str:
    return _EDGE.sub("", token).lower()


def is_wordlike(word: str) -> bool:
    """A word that can have been misread: mostly letters, no code, number, address or mention."""
    letters = sum(c.isalpha() for c in word)
    return len(word) > 2 and letters >= 2 and 2 * letters > len(word) and not _CODE.search(word) and "." not in word and "/" not in word


def words_of(text: str, broken_before: bool) -> list[str]:
    """Words of a line, without the parts of words broken over lines."""
    line = scan_copy(text)
    tokens = line.split()
    if tokens and _BROKEN.search(line):
        tokens.pop()
    if tokens and broken_before:
        tokens.pop(0)
    out = []
    for t in tokens:
        w = word_of(t)
        if is_wordlike(w):
            out.append(w)
    return out


def grams(word: str, q: int = 3) -> list[str]:
    padded = f"$${word}$$"
    return sorted({padded[i : i + q] for i in range(len(padded) - q + 1)})


def garbled_distance(read: str, printed: str, other: float = 1.0, usual: float = 0.25, limit: float = 3.0) -> float:
    """Edit distance in which the usual confusions cost ``usual``."""
    n, m = len(read), len(printed)
    if abs(n - m) > 3:
        return limit
    prev_rows: list[list[float]] = []
    for i in range(n + 1):
        row = [math.inf] * (m + 1)
        for j in range(m + 1):
            if i == 0 and j == 0:
                row[j] = 0.0
                continue
            best = math.inf
            if i and j:
                best = prev_rows[i - 1][j - 1] + (0.0 if read[i - 1] == printed[j - 1] else other)
            if i:
                best = min(best, prev_rows[i - 1][j] + other)
            if j:
                best = min(best, row[j - 1] + other)
            for a in (1, 2):
                if i >= a and (known := _INTO.get(read[i - a : i])):
                    for p in known:
                        b = len(p)
                        if j >= b and printed[j - b : j] == p:
                            best = min(best, prev_rows[i - a][j - b] + usual)
            row[j] = best
        prev_rows.append(row)
    return min(limit, prev_rows[n][m])


FEATURES = 9


def features(read: str, printed: str, shared: int, count: float, seen: int) -> list[float]:
    d = garbled_distance(read, printed)
    odd = sum(not c.isalpha() and c != "-" for c in read)
    return [
        d, d / max(3, len(read)), abs(len(read) - len(printed)), shared / max(1, len(read) + 2), math.log1p(count), len(read), odd,
        math.log1p(seen), float(read[:1] == printed[:1]),
    ]


class Ranker:
    """Boosted trees over (misread word, candidate) pairs."""

    def __init__(self, model: Boosted | None):
        self.model = model

    def scored(self, pairs: pd.DataFrame) -> pd.DataFrame:
        """(word, candidate, odds) of the pairs (word, ocr, candidate, count, shared) whose odds are even or better; a whole
        batch is scored at once."""
        rows = [features(*r) for r in pairs[["word", "candidate", "shared", "count", "ocr"]].itertuples(index=False, name=None)]
        if not rows or self.model is None:
            return pairs.iloc[:0][["word", "candidate"]].assign(odds=0.0)
        x = np.array(rows)
        odds = self.model.score(x)
        good = (x[:, 0] <= 2.0) & (odds > 0)
        return pairs.loc[good, ["word", "candidate"]].assign(odds=odds[good])


def garble(word: str, rng: np.random.Generator) -> str:
    for _ in range(1 + int(rng.random() < 0.3)):
        spots = [(i, p, r) for p, r in CONFUSIONS for i in range(len(word)) if word.startswith(p, i)]
        if not spots:
            break
        i, p, r = spots[rng.integers(len(spots))]
        word = word[:i] + r + word[i + len(p) :]
    return word


def train_ranker(vocabulary: dict[str, int], strange: list[str], seed: int = 5, most: int = 1500) -> Ranker:
    """Trains on garbled words (right: the word itself) and on whole words left out of the vocabulary (right: none).

    ``vocabulary`` and ``strange`` are samples; ``most`` bounds the words of each sort.
    """
    rng = np.random.default_rng(seed)
    known = sorted(w for w in vocabulary if len(w) > 2)
    if not known:
        return Ranker(None)
    index = defaultdict(list)
    for w in known:
        for g in grams(w):
            index[g].append(w)
    weight = np.array([math.log1p(vocabulary[w]) for w in known])
    picked = rng.choice(known, size=min(most, 2 * len(known)), p=weight / weight.sum())
    cases = [(g, w) for w in picked.tolist() if (g := garble(w, rng)) != w and g not in vocabulary]
    hidden = rng.choice(known, size=min(most, -(-len(known) // 3)), replace=False).tolist()
    cases += [(w, "") for w in hidden] + [(w, "") for w in strange[: most // 2]]
    rows, target = [], []
    for read, right in cases:
        shared = Counter(w for g in grams(read) for w in index[g] if w != read)
        for w, n in sorted(shared.items(), key=lambda x: (-x[1], x[0]))[:12] + ([(right, shared[right])] if right and right in shared else []):
            if abs(len(w) - len(read)) <= 3 and garbled_distance(read, w) <= 2:
                rows.append(features(read, w, n, vocabulary[w], 1))
                target.append(float(w == right))
    if not rows:
        return Ranker(None)
    return Ranker(Boosted().fit(np.array(rows), np.array(target)))


# --- lines ---


@dataclass
class Line:
    text: str
    page: int
    top: int
    foot: int
    scanned: bool
    confidence: float


_FOLD = str.maketrans({"@": "a", "c": "e", "0": "o", "1": "i", "l": "i", "f": "t", "6": "b", "h": "b", "9": "g", "q": "g", "5": "s", "v": "y"})


def fold(text: str) -> str:
    """A form in which usual confusions are equal, spaces made one."""
    t = " ".join(scan_copy(text).lower().split())
    for read, printed in (("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("c1", "d"), ("vv", "w"), ("li", "h")):
        t = t.replace(read, printed)
    return t.translate(_FOLD)


_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12, "xiii": 13, "xiv": 14}
_N = r"(?P<n>[0-9OolI|]{1,4}|[ivxl]{1,5})"
_NUMBERED = re.compile(
    rf"(?<![\w,.-])(?:(?P<word>(?i:page|pagc|paqe|pa9e|p@ge|seite|seife|scite|5eite|sheet|folio|pg\.?|p\.))\s*{_N}(?:\s*(?:of|0f|ot|von|de|sur|/)\s*\S{{1,4}})?"
    rf"|(?P<mark>[-–~=]\s{_N.replace('?P<n>', '?P<n2>')}\s[-–~=]|[\[(]\s?{_N.replace('?P<n>', '?P<n3>')}\s?[\])]|{_N.replace('?P<n>', '?P<n4>')}\s?/\s?[0-9OolI]{{1,4}})"
    rf"|(?P<bare>(?:^|(?<=\s\s)){_N.replace('?P<n>', '?P<n5>')}(?=\s\s|$)))(?![\w,/-]|\.\d)"
)


def _number(m: re.Match) -> int | None:
    raw = next(x for x in (m.group("n"), m.group("n2"), m.group("n3"), m.group("n4"), m.group("n5")) if x)
    if raw in _ROMAN:
        return _ROMAN[raw]
    digits = raw.translate(str.maketrans("OolI|", "00111"))
    return int(digits) if digits.isdigit() else None


def numbered(text: str) -> tuple[str, int, str, bool] | None:
    """(piece, number, kind, whether it stands alone) of the first piece that could be a page number, in a scanning copy."""
    for m in _NUMBERED.finditer(text):
        n = _number(m)
        if n is not None:
            kind = "word" if m.group("word") else "mark" if m.group("mark") else "bare"
            return m.group(), n, kind, m.group() == text
    return None


_LETTER = re.compile(r"[^\W\d_]")


def head_features(line: Line, key: str, place: int, pages: int, total: int) -> list[float]:
    text = line.text.strip()
    letters, tokens = _LETTER.findall(text), text.split()
    upper = sum(map(str.isupper, letters)) / max(1, len(letters))
    titled = sum(w[:1].isupper() for w in tokens) / max(1, len(tokens))
    return [
        float(place), float(pages), pages / max(1, total), float(len(key)), upper, titled, float(text[-1:] in ".,;"), float(text[:1].islower()),
        float("|" in text or " - " in text or "/" in text),
    ]


def head_piece(text: str, number: str | None) -> str | None:
    """What is printed besides the page number, if it has letters enough for a head."""
    if number:
        text = text.replace(number, "  ").strip()
    return text if len(_LETTER.findall(text)) >= 3 else None


def good_heads(rows: list[list[float]], model: Boosted | None) -> list[bool]:
    """Whether texts repeated at the edge look like heads, by their :func:`head_features`."""
    if model:
        return (model.score(np.array(rows)) > 0).tolist() if rows else []
    return [not (f[6] and not f[8]) and not f[7] for f in rows]


# Stated cases of head_features (without the counts of pages) and whether such a text is a head: a line that ends like a
# sentence or begins in lower case is none unless it is divided by marks.
HEAD_CASES = (
    [[float(place), 0.0, 0.0, float(size), up, up, float(end), float(low), float(bar)] for place in (0, 1) for size in (12, 40) for up in (0.2, 1.0) for end in (0, 1) for low in (0, 1) for bar in (0, 1)],
    [not (end and not bar) and not low for _ in (0, 1) for _ in (12, 40) for _ in (0.2, 1.0) for end in (0, 1) for low in (0, 1) for bar in (0, 1)],
)
JOINERS = ("and", "or", "und", "et", "to", "oder")
# Stated cases of the features of a break and whether the word goes on: if it is known as a whole, or its parts aren't words
# of their own and the second isn't a joining word.
BREAK_CASES = (
    [[w, c, a, b, 4.0, 4.0, 1.0, 0.95, float(j)] for w in (0.0, 2.0) for c in (0.0, 2.0) for a in (0.0, 2.0) for b in (0.0, 2.0) for j in (0, 1)] * 2,
    [bool(w or c or not (a and b) and not j) for w in (0.0, 2.0) for c in (0.0, 2.0) for a in (0.0, 2.0) for b in (0.0, 2.0) for j in (0, 1)] * 2,
)


def break_parts(text: str, after: str) -> tuple[str, str, str, bool] | None:
    """Of a line that ends in a broken word and (the scanning copy of) the next: the last part of the word and the next line's
    first word, in lower case, the mark, and whether a capital speaks against going on."""
    m, n = _BROKEN.search(text), _FIRST.search(after)
    if not m or not n:
        return None
    capital = n.group(1)[:1].isupper() and not m.group(1).isupper()
    return scan_copy(m.group(1).split("-")[-1]).lower(), n.group(1).lower(), text.rstrip()[-1], capital


def joined_word(text: str, b: str, f: list[float]) -> str:
    """The word over the break at the end of ``text``, with a hyphen where its features know it with one."""
    head = _BROKEN.search(text).group(1)
    last = head.split("-")[-1]
    low = scan_copy(last).lower()
    word = low + b if f[0] >= f[1] else f"{low}-{b}"
    return head[: len(head) - len(last)] + (word.capitalize() if last[:1].isupper() else word)


def repaired(text: str, fixes, ends: bool, joined: str | None) -> str:
    """A line with misread words replaced, the word joined over the break before it at its head, and without the part of a
    word that goes on on the next line. White space is made plain."""
    out = " ".join(_replaced(text.strip(), dict(fixes) if fixes is not None else {}).split())
    if joined:
        out = joined + _FIRST.sub("", out, count=1)
    if ends and (m := _BROKEN.search(out)):
        out = out[: m.start()].rstrip()
    return out


def _replaced(text: str, fixes: dict[str, str]) -> str:
    if not fixes:
        return text
    out = []
    for token in text.split(" "):
        plain = scan_copy(token)
        word = word_of(plain)
        new = fixes.get(word)
        if new and (at := plain.lower().find(word)) >= 0:
            old = plain[at : at + len(word)]
            new = new.upper() if old.isupper() and len(old) > 1 else new.capitalize() if old[:1].isupper() else new
            token = plain[:at] + new + plain[at + len(word) :]
        out.append(token)
    return " ".join(out)
