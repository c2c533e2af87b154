"""Scores in any notation as quantities of the dimension "score"."""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

from quern.functions.units import MULTIPLIERS, SCORE, WORDS, Reader, Unit, canonical

# Words between a value and its full scale, in six languages.
_OF = ("of", "de", "sur", "von", "sobre", "em", "van", "su")
_FULL, _HALF, _EMPTY = "★⭐✭*", "½⯪", "☆✩"
_GRADE = re.compile(r"(?:grade:?\s+)?([a-f])\s*(\+|-|−|–|plus|minus)?", re.IGNORECASE)


@dataclass(frozen=True)
class Score:
    """kind: 'scaled' with value and scale, 'bare' with a value alone, 'grade', or 'none'."""

    kind: str
    value: Fraction | None = None
    scale: Fraction | None = None
    grade: str | None = None

    @property
    def unit(self) -> Unit | None:
        """'Out of 5' is a unit of a fifth of the full score."""
        return Unit(1 / self.scale, SCORE) if self.kind == "scaled" else None

    @property
    def milli(self) -> int | None:
        """Thousandths of the full scale, half up; None without a scale or above it."""
        if self.unit is None or (share := canonical(self.value, self.unit)) > 1:
            return None
        return int(1000 * share + Fraction(1, 2))


NONE = Score("none")


def _stars(text: str) -> Score:
    full = sum(text.count(c) for c in _FULL)
    half = sum(text.count(c) for c in _HALF)
    empty = sum(text.count(c) for c in _EMPTY)
    return Score("scaled", full + Fraction(half, 2), Fraction(full + half + empty))


@lru_cache(maxsize=1 << 16)
def parse_score(text: str) -> Score:
    """What a score field says.

    score := [label ':'] value separator scale ['stars'] | value percent | stars | grade | value
    """
    t = text.strip()
    t = re.sub(r"^(?:score|rating|note|nota|wertung|punkte)\s*:?\s+", "", t, flags=re.IGNORECASE)
    if t and all(c in _FULL + _HALF + _EMPTY for c in t) and set(t) - set("*½"):
        return _stars(t)
    if g := _GRADE.fullmatch(t):
        mark = {"+": "+", "plus": "+", None: ""}.get(g[2] and g[2].lower(), "-")
        return Score("grade", grade=g[1].upper() + mark)
    r = Reader(t)
    value = r.number()
    if value is None:
        return NONE
    if r.take("pts") or r.take("pt") or r.take("points") or r.take("stars") or r.take("★"):
        pass
    if r.done:
        return Score("bare", value)
    if r.take("%") or r.take("pct") or r.take("percent") or r.take("per", "cent") or r.take("prozent"):
        return Score("scaled", value, Fraction(100)) if r.done else NONE
    bracket = r.take("[") and "]" or r.take("(") and ")" or ""
    if not (r.take("out", "of") or any(r.take(w) for w in _OF) or any(r.take(c) for c in "/⁄|÷") or bracket == ")"):
        return NONE
    scale = r.number()
    if scale is None or scale <= 0 or bracket and not r.take(bracket):
        return NONE
    if not r.done and not any(r.take(w) for w in ("stars", "star", "★", "points", "pts", "sterne", "estrellas", "étoiles", "estrelas", "sterren")):
        return NONE
    return Score("scaled", value, scale) if r.done else NONE


_N = r"(a\s+hundred|(?:%s)(?:-\w+)?|\d+(?:[.,]\d+)?)" % "|".join(sorted((w for w in WORDS if len(w) > 2), key=len, reverse=True))
# How a text states the full scale of its score.
_STATED = re.compile(
    "|".join(
        p.replace("N", _N)
        for p in (
            r"\bx\s*/\s*N\b",
            r"\b(?:rated|marks?|scored?|scores|points?|stars|given|rating)\b[^.!?]{0,30}?\bout\s+of\s+N\b",
            r"\bfrom\s+(?:zero|nought|0|one|1)\s+to\s+N\b",
            r"\bN\s+(?:as|is|being)\s+(?:the\s+)?(?:top|best|highest|maximum|perfect|full)\b",
            r"\bN-point\s+scale\b",
            r"\bscale\s+of\s+(?:\w+\s+to\s+)?N\b",
            r"\b(?:maximum|top mark|full marks?)\s+(?:of|is|are)\s+N\b",
        )
    ),
    re.IGNORECASE,
)


#: What every text that states a scale holds, for a test before it is read in full.
MAY_STATE = (
    r"(?i)\bx\s*/|out\s+of|\b(?:0|1|one|zero|nought)\s+to\s|\b(?:as|is|being)\s+(?:the\s+)?(?:top|best|highest|maximum|perfect|full)"
    r"|-point\s+scale|scale\s+of|\b(?:maximum|marks?)\s+(?:of|is|are)\s"
)


@lru_cache(maxsize=1 << 14)
def stated_scale(text: str) -> Fraction | None:
    """The full scale that a text states for its own score; None if none or several."""
    found = set()
    for m in _STATED.finditer(text):
        n = Reader(next(g for g in m.groups() if g).replace("a hundred", "one hundred")).number()
        if n is not None and n > 0:
            found.add(n)
    return found.pop() if len(found) == 1 else None


__all__ = ["MULTIPLIERS", "NONE", "Score", "parse_score", "stated_scale"]
