"""Captions out of spoken lines: rows by the widths of their letters, cues under a number of rows and of seconds.

Widths are whole thousandths of the letter height; a table of them comes from a rule over kinds of letters, or from a font.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The marks that end a sentence.
END_MARKS = ".!?…。！？；;"
CUE = "array<struct<start: double, end: double, text: string>>"
Width = Callable[[str], int]


def letter_width(c: str) -> int:
    """The width of a letter by its kind: marks none, full-width ones the height, capitals more than small ones."""
    base = unicodedata.normalize("NFD", c)[0] if not c.isascii() else c
    if unicodedata.combining(base):
        return 0
    if unicodedata.east_asian_width(base) in "WF":
        return 1000
    if base in "iljtfI.,;:'!|()[] ":
        return 300
    if base in "mwMW@%":
        return 880
    return 680 if base.isupper() else 560


class Widths(dict):
    """Widths of letters, each found once; other letters by letter_width()."""

    def __missing__(self, c: str) -> int:
        self[c] = letter_width(c)
        return self[c]

    def of(self, word: str) -> int:
        return sum(map(self.__getitem__, word))


@dataclass(frozen=True)
class Style:
    width: int = 18_000
    rows: int = 2
    least_s: float = 1.0
    most_s: float = 6.0


class Rows:
    """Rows that words fill one after another; a word wider than a row has one of its own."""

    def __init__(self, width: int, gap: int, count: int = 0, used: int = 0) -> None:
        self.width, self.gap, self.count, self.used = width, gap, count, used

    def add(self, size: int) -> int:
        if self.count and self.used + self.gap + size <= self.width:
            self.used += self.gap + size
        else:
            self.count, self.used = self.count + 1, size
        return self.count

    def copy(self) -> Rows:
        return Rows(self.width, self.gap, self.count, self.used)


def balanced(sizes: list[int], gap: int, width: int) -> list[int]:
    """Where each row ends, in as many rows as greedy filling needs, of the least sum of squared widths; no row but one of a
    single word is wider than `width`.

    Let f[b] be the rows that the first b words need and g[b] those of the rest. As many rows as both together need are
    used, so a row can only end at b if f[b] + g[b] is that number, and b then ends row f[b]: one place is kept a word, and
    a place looks back as far as a row is wide."""
    n = len(sizes)
    if not n:
        return []

    def needed(order: list[int]) -> list[int]:
        rows, out = Rows(width, gap), [0]
        for s in order:
            out.append(rows.add(s))
        return out

    front, back = needed(sizes), needed(sizes[::-1])[::-1]
    total, best, cut = front[n], [0] + [-1] * n, [0] * (n + 1)
    for b in range(1, n + 1):
        if front[b] + back[b] != total:
            continue
        used = -gap
        for a in range(b - 1, -1, -1):
            used += gap + sizes[a]
            if used > width and a < b - 1:
                break
            if best[a] >= 0 and front[a] == front[b] - 1 and front[a] + back[a] == total and (best[b] < 0 or best[a] + used * used <= best[b]):
                best[b], cut[b] = best[a] + used * used, a
    ends, b = [], n
    while b:
        ends.append(b)
        b = cut[b]
    return ends[::-1]


def shares(seconds: float, weights: list[int], least: float, most: float) -> list[float]:
    """`seconds` dealt by weight. All but the last are held between least and most; the last takes what is left, and if
    nothing is, the others give back in proportion to what they have over the least. What the last would have over the most
    goes to the others in proportion to what they have under it."""
    total = max(sum(weights), 1)
    out = [seconds * w / total for w in weights]
    head = [min(max(s, least), most) for s in out[:-1]]
    rest = seconds - sum(head) - out[-1]
    last = out[-1] + max(rest, 0.0)
    if rest < 0:
        over = sum(s - least for s in head if s > least)
        if over > 0:
            head = [s + rest * (s - least) / over if s > least else s for s in head]
        last = max(min(last, seconds - sum(head)), 0.0)
    room = sum(most - s for s in head if s < most)
    if last > most and room > 0:
        given = min(last - most, room)
        head, last = [s + given * (most - s) / room if s < most else s for s in head], last - given
    return [*head, last]


def _sentences(words: list[str]) -> list[list[str]]:
    out, now = [], []
    for w in words:
        now.append(w)
        if w[-1] in END_MARKS:
            out.append(now)
            now = []
    return out + [now] if now else out


def grouped(words: list[str], label: list[str], width: Width, seconds: float, style: Style) -> list[list[str]]:
    """Words of the cues: whole sentences as long as the rows hold them with the label, longer ones cut where the rows are
    full. If that makes fewer cues than the seconds need, sentences are dealt evenly; if there are too few of them, the
    cue with the most letters is halved until there are enough or all are single words."""
    gap, sizes, quote = width(" "), {w: width(w) for w in words}, width('"') if label else 0
    empty = Rows(style.width, gap)
    for w in label[:-1]:
        empty.add(width(w))

    def laid(rows: Rows, word: str, first: bool) -> bool:
        """Adds a word; whether a cue may end with it."""
        size = sizes[word] + (width(label[-1]) if first and label else 0)
        last = rows.copy().add(size + quote)
        rows.add(size)
        return last <= style.rows

    def full(pieces: list[list[str]]) -> list[list[str]]:
        """Pieces whose rows are too many, cut."""
        out = []
        for piece in pieces:
            rows, now = empty.copy(), []
            for w in piece:
                if not laid(rows, w, not now) and now:
                    out.append(now)
                    rows, now = empty.copy(), []
                    laid(rows, w, True)
                now.append(w)
            out.append(now)
        return out

    sentences = _sentences(words)
    cues: list[list[str]] = []
    rows = empty.copy()
    for piece in full(sentences):
        more = rows.copy()
        if cues and all([laid(more, w, False) for w in piece]):
            cues[-1] += piece
            rows = more
        else:
            cues.append(list(piece))
            rows = empty.copy()
            for k, w in enumerate(piece):
                laid(rows, w, not k)
    needed = max(1, -int(-seconds // style.most_s))
    if needed > len(cues):
        step = max(1, -(-len(sentences) // needed))
        cues = full([[w for s in sentences[k : k + step] for w in s] for k in range(0, len(sentences), step)])
        while len(cues) < needed:
            at = max((k for k in range(len(cues)) if len(cues[k]) > 1), key=lambda k: sum(map(len, cues[k])), default=-1)
            if at < 0:
                break
            half = (len(cues[at]) + 1) // 2
            cues[at : at + 1] = [cues[at][:half], cues[at][half:]]
    return cues


def split(text: str, start: float, end: float, label: str, width: Width, style: Style) -> list[tuple[float, float, str]]:
    """(start, end, text) of the cues of one line, each in balanced rows; a label stands before each cue's first word and
    a quote closes it."""
    words, head = text.split(), label.split()
    if not words:
        return []
    seconds = max(end - start, 0.001)
    cues = grouped(words, head, width, seconds, style)
    out, now = [], start
    for cue, share in zip(cues, shares(seconds, [sum(map(len, c)) for c in cues], style.least_s, style.most_s), strict=True):
        shown = [*head[:-1], head[-1] + cue[0], *cue[1:]] if head else list(cue)
        if head:
            shown[-1] += '"'
        ends = balanced([width(w) for w in shown], width(" "), style.width)
        rows = [" ".join(shown[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        out.append((now, min(now + share, end), "\n".join(rows)))
        now = out[-1][1]
    return out


def split_cues(text: Column, start: Column, end: Column, label: Column, style: Style = Style(), widths: dict[str, int] | None = None) -> Column:
    """The cues of a line as an array of start, end and text. widths: of letters, in thousandths of their height."""

    @F.pandas_udf(CUE)
    def run(texts: pd.Series, starts: pd.Series, ends: pd.Series, labels: pd.Series) -> pd.Series:
        own = Widths(widths or {})
        each = zip(texts, starts, ends, labels, strict=True)
        return pd.Series([[{"start": a, "end": b, "text": t} for a, b, t in split(text or "", first, last, name or "", own.of, style)] for text, first, last, name in each])

    return run(text, start.cast("double"), end.cast("double"), label)
