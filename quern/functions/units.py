"""Quantities with units: a grammar, dimensions as exponent vectors, canonical values.

A unit is a scale, an offset and a vector of exponents over the base dimensions; a
product of units multiplies the scales and adds the vectors. A canonical value is
``number * scale + offset`` in the coherent unit of its vector. Scores are quantities
too: "out of 5" names a unit of a fifth of the full score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

#: Base dimensions, in the order of the exponent vectors.
DIMENSIONS = ("length", "mass", "time", "temperature", "current", "amount", "luminosity", "money", "score")


def _vector(**exponents: int) -> tuple[int, ...]:
    return tuple(exponents.get(d, 0) for d in DIMENSIONS)


@dataclass(frozen=True)
class Unit:
    scale: Fraction
    dims: tuple[int, ...]
    offset: Fraction = Fraction(0)

    def times(self, other: Unit, sign: int = 1) -> Unit:
        if self.offset or other.offset:
            raise ValueError("a unit with an offset stands alone")
        return Unit(self.scale * other.scale**sign, tuple(a + sign * b for a, b in zip(self.dims, other.dims)))

    def power(self, n: int) -> Unit:
        if self.offset and n != 1:
            raise ValueError("a unit with an offset stands alone")
        return Unit(self.scale**n, tuple(a * n for a in self.dims), self.offset)


ONE = Unit(Fraction(1), _vector())
SCORE = _vector(score=1)
_L, _M, _T, _K = _vector(length=1), _vector(mass=1), _vector(time=1), _vector(temperature=1)
_AREA, _VOLUME, _SPEED = _vector(length=2), _vector(length=3), _vector(length=1, time=-1)
_FORCE, _PRESSURE = _vector(length=1, mass=1, time=-2), _vector(length=-1, mass=1, time=-2)
_ENERGY, _POWER = _vector(length=2, mass=1, time=-2), _vector(length=2, mass=1, time=-3)
_F = Fraction

# Units as symbols ; names, with scale to the coherent unit, dimensions, offset, and whether metric prefixes go with them.
_TABLE = [
    ("m ; metre metres meter meters", 1, _L, 0, True), ("in ; inch inches", "0.0254", _L, 0, False), ("ft ; foot feet", "0.3048", _L, 0, False),
    ("yd ; yard yards", "0.9144", _L, 0, False), ("mi ; mile miles", "1609.344", _L, 0, False), ("nmi ;", 1852, _L, 0, False),
    ("Å ; angstrom angstroms", "1e-10", _L, 0, False), ("au ;", 149597870700, _L, 0, False), ("ly ;", 9460730472580800, _L, 0, False), ("; mil mils thou", "0.0000254", _L, 0, False),
    ("g ; gram grams gramme grammes", "0.001", _M, 0, True), ("t ; tonne tonnes", 1000, _M, 0, True), ("lb lbs ; pound pounds", "0.45359237", _M, 0, False),
    ("oz ; ounce ounces", "0.028349523125", _M, 0, False), ("; stone", "6.35029318", _M, 0, False), ("; ton tons", "907.18474", _M, 0, False), ("ct ; carat carats", "0.0002", _M, 0, False),
    ("s sec secs ; second seconds", 1, _T, 0, True), ("min mins ; minute minutes", 60, _T, 0, False), ("h hr hrs ; hour hours", 3600, _T, 0, False),
    ("d ; day days", 86400, _T, 0, False), ("wk ; week weeks", 604800, _T, 0, False), ("yr yrs ; year years", 31557600, _T, 0, False), ("; fortnight fortnights", 1209600, _T, 0, False),
    ("K ; kelvin kelvins", 1, _K, 0, True), ("°C ℃ degC ; celsius centigrade", 1, _K, "273.15", False), ("°F ℉ degF ; fahrenheit", _F(5, 9), _K, _F(45967, 180), False), ("°R ; rankine", _F(5, 9), _K, 0, False),
    ("A ; amp amps ampere amperes", 1, _vector(current=1), 0, True), ("mol ; mole moles", 1, _vector(amount=1), 0, True), ("cd ; candela candelas", 1, _vector(luminosity=1), 0, True),
    ("Hz ; hertz", 1, _vector(time=-1), 0, True), ("rpm ;", _F(1, 60), _vector(time=-1), 0, False), ("Bq ; becquerel becquerels", 1, _vector(time=-1), 0, True),
    ("N ; newton newtons", 1, _FORCE, 0, True), ("lbf ;", "4.4482216152605", _FORCE, 0, False), ("kgf ;", "9.80665", _FORCE, 0, False), ("dyn ; dyne dynes", "0.00001", _FORCE, 0, False),
    ("Pa ; pascal pascals", 1, _PRESSURE, 0, True), ("bar ; bars", 100000, _PRESSURE, 0, True), ("psi ;", _F("4.4482216152605") / _F("0.0254") ** 2, _PRESSURE, 0, False),
    ("atm ; atmosphere atmospheres", 101325, _PRESSURE, 0, False), ("mmHg ;", "133.322387415", _PRESSURE, 0, False), ("inHg ;", "3386.388640341", _PRESSURE, 0, False), ("Torr torr ;", _F(101325, 760), _PRESSURE, 0, False),
    ("J ; joule joules", 1, _ENERGY, 0, True), ("cal ; calorie calories", "4.184", _ENERGY, 0, True), ("Wh ;", 3600, _ENERGY, 0, True), ("eV ; electronvolt electronvolts", "1.602176634e-19", _ENERGY, 0, True), ("BTU Btu ;", "1055.05585262", _ENERGY, 0, False), ("erg ; ergs", "1e-7", _ENERGY, 0, False),
    ("W ; watt watts", 1, _POWER, 0, True), ("hp bhp ; horsepower", "745.69987158227", _POWER, 0, False), ("PS ;", "735.49875", _POWER, 0, False),
    ("C ; coulomb coulombs", 1, _vector(current=1, time=1), 0, True), ("Ah ;", 3600, _vector(current=1, time=1), 0, True),
    ("V ; volt volts", 1, _vector(length=2, mass=1, time=-3, current=-1), 0, True), ("Ω ; ohm ohms", 1, _vector(length=2, mass=1, time=-3, current=-2), 0, True),
    ("F ; farad farads", 1, _vector(length=-2, mass=-1, time=4, current=2), 0, True), ("S ; siemens", 1, _vector(length=-2, mass=-1, time=3, current=2), 0, True),
    ("Wb ; weber webers", 1, _vector(length=2, mass=1, time=-2, current=-1), 0, True), ("T ; tesla teslas", 1, _vector(mass=1, time=-2, current=-1), 0, True), ("H ; henry henries henrys", 1, _vector(length=2, mass=1, time=-2, current=-2), 0, True),
    ("lm ; lumen lumens", 1, _vector(luminosity=1), 0, True), ("lx ; lux", 1, _vector(luminosity=1, length=-2), 0, True),
    ("Gy ; gray grays", 1, _vector(length=2, time=-2), 0, True), ("Sv ; sievert sieverts", 1, _vector(length=2, time=-2), 0, True), ("kat ; katal katals", 1, _vector(amount=1, time=-1), 0, True),
    ("l L ; litre litres liter liters", "0.001", _VOLUME, 0, True), ("gal ; gallon gallons", "0.003785411784", _VOLUME, 0, False), ("qt ; quart quarts", "0.000946352946", _VOLUME, 0, False),
    ("pt ; pint pints", "0.000473176473", _VOLUME, 0, False), ("; cup cups", "0.0002365882365", _VOLUME, 0, False), ("floz ;", "0.0000295735295625", _VOLUME, 0, False),
    ("tbsp ; tablespoon tablespoons", "0.00001478676478125", _VOLUME, 0, False), ("tsp ; teaspoon teaspoons", "0.00000492892159375", _VOLUME, 0, False), ("cc ccm ;", "1e-6", _VOLUME, 0, False), ("bbl ; barrel barrels", "0.158987294928", _VOLUME, 0, False),
    ("ha ; hectare hectares", 10000, _AREA, 0, False), ("ac ; acre acres", "4046.8564224", _AREA, 0, False),
    ("mph ;", "0.44704", _SPEED, 0, False), ("kph kmh kmph ;", _F(5, 18), _SPEED, 0, False), ("kn kts ; knot knots", _F(1852, 3600), _SPEED, 0, False), ("fps ;", "0.3048", _SPEED, 0, False),
    ("% pct ; percent", _F(1, 100), _vector(), 0, False), ("‰ ;", _F(1, 1000), _vector(), 0, False), ("ppm ;", _F(1, 10**6), _vector(), 0, False), ("ppb ;", _F(1, 10**9), _vector(), 0, False),
    ("$ USD ; dollar dollars", 1, _vector(money=1), 0, False), ("¢ ; cent cents", _F(1, 100), _vector(money=1), 0, False),
]
# The metric prefixes as symbols and names, with their powers of ten, and multipliers of numbers.
_PREFIX_POWERS = [
    ("Q quetta", 30), ("R ronna", 27), ("Y yotta", 24), ("Z zetta", 21), ("E exa", 18), ("P peta", 15), ("T tera", 12), ("G giga", 9), ("M mega", 6), ("k kilo", 3), ("h hecto", 2), ("da deca", 1),
    ("d deci", -1), ("c centi", -2), ("m milli", -3), ("µ micro", -6), ("n nano", -9), ("p pico", -12), ("f femto", -15), ("a atto", -18), ("z zepto", -21), ("y yocto", -24), ("r ronto", -27), ("q quecto", -30),
]
MULTIPLIERS = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9}

# Number words and vulgar fractions.
WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())} | {"a": 1, "an": 1} | {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
VULGAR = {"¼": _F(1, 4), "½": _F(1, 2), "¾": _F(3, 4), "⅓": _F(1, 3), "⅔": _F(2, 3), "⅛": _F(1, 8)}


def _all_units() -> tuple[dict[str, Unit], dict[str, Unit], dict[str, set[Unit]]]:
    """(by symbol as written, by name in small letters, by symbol in any case), each with its prefixes."""
    symbols: dict[str, Unit] = {}
    names: dict[str, Unit] = {}
    made: list[tuple[dict[str, Unit], str, Unit]] = []
    for written, scale, dims, offset, prefixed in _TABLE:
        unit = Unit(_F(scale), dims, _F(offset))
        for book, part, which in zip((symbols, names), written.split(";"), (0, 1)):
            for one in part.split():
                book[one] = unit
                if prefixed:
                    made += [(book, p.split()[which] + one, Unit(unit.scale * _F(10) ** n, dims)) for p, n in _PREFIX_POWERS]
    for book, one, unit in made:
        book.setdefault(one, unit)  # a unit of its own goes before a prefixed one: min, pt, ft, cd
    folded: dict[str, set[Unit]] = {}
    for one, unit in symbols.items():
        folded.setdefault(one.lower(), set()).add(unit)
    return symbols, names, folded


SYMBOLS, NAMES, _FOLDED = _all_units()


def base_unit(word: str) -> Unit | None:
    """The unit of one symbol or name, with its prefix.

    Symbols count as written: MPa is mega and mPa milli. One that none is written like, as KM
    or PSI, is taken in any case if that leaves one unit. Names have no case.
    """
    word = word.replace("μ", "µ")
    if word in SYMBOLS:
        return SYMBOLS[word]
    low = word.lower()
    if low in NAMES:
        return NAMES[low]
    any_case = _FOLDED.get(low, set())
    return next(iter(any_case)) if len(any_case) == 1 else None


_TOKEN = re.compile(r"\s*(\d+(?:[.,]\d+)*|[^\W\d_]+(?:-[^\W\d_]+)*|°[a-z]|\S)", re.IGNORECASE)


def number_of(digits: str) -> Fraction:
    """A written number: one comma or point before other than three digits is the decimal one."""
    marks = re.findall(r"[.,]", digits)
    if not marks:
        return Fraction(int(digits))
    last = max(digits.rfind("."), digits.rfind(","))
    tail = digits[last + 1 :]
    grouped = len(tail) == 3 and (len(set(marks)) == 1) and (len(marks) > 1 or digits[last] == ",") and digits[0] != "0"
    if grouped:
        return Fraction(int(re.sub(r"[.,]", "", digits)))
    return Fraction(int(re.sub(r"[.,]", "", digits[:last]) or "0")) + Fraction(int(tail), 10 ** len(tail))


class Reader:
    """A cursor over the tokens of one expression, with the number grammar.

    number := digits [digits '/' digits | vulgar] | vulgar | words ['and' 'a' 'half']
    """

    def __init__(self, text: str):
        self.tokens = [m.group(1) for m in _TOKEN.finditer(text)]
        self.i = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.i + ahead].lower() if self.i + ahead < len(self.tokens) else ""

    def take(self, *options: str) -> bool:
        """Step over the given tokens in a row, if they come next."""
        if all(self.peek(k) == o for k, o in enumerate(options)):
            self.i += len(options)
            return True
        return False

    @property
    def done(self) -> bool:
        return self.i >= len(self.tokens)

    def number(self) -> Fraction | None:
        t = self.peek()
        if t and t[0].isdigit():
            whole = number_of(self.tokens[self.i])
            if self.peek(1) in VULGAR:
                whole += VULGAR[self.peek(1)]
                self.i += 2
            elif self.peek(1) in ("1", "2", "3") and self.peek(2) in ("/", "⁄") and self.peek(3) in ("2", "3", "4") and "." not in t and "," not in t:
                whole += Fraction(int(self.peek(1)), int(self.peek(3)))
                self.i += 4
            elif t == "1" and self.peek(1) in ("/", "⁄") and self.peek(2) == "2" and self.peek(3) in ("/", "⁄"):
                whole = Fraction(1, 2)
                self.i += 3
            else:
                self.i += 1
            return whole
        if t in VULGAR:
            self.i += 1
            return VULGAR[t]
        return self.words()

    def words(self) -> Fraction | None:
        start, total, found = self.i, Fraction(0), False
        while True:
            parts = self.peek().split("-")
            if all(p in WORDS for p in parts) and parts != [""]:
                if self.peek() in ("a", "an") and self.peek(1) not in MULTIPLIERS:
                    break
                total += sum(WORDS[p] for p in parts)
                self.i += 1
            elif self.peek() in MULTIPLIERS and found:
                total *= MULTIPLIERS[self.peek()]
                self.i += 1
            elif found and self.take("and", "a", "half"):
                return total + Fraction(1, 2)
            elif not found and self.take("half"):
                return Fraction(1, 2)
            else:
                break
            found = True
        if not found:
            self.i = start
        return total if found else None


_SUPERSCRIPTS = str.maketrans("⁻⁰¹²³⁴⁵⁶⁷⁸⁹", "-0123456789")
_UNIT_TOKEN = re.compile(r"\*\*|\^|-?\d+|°\s?[a-zA-Z]|[℃℉%‰$¢Ω]|[^\W\d_]+|[/·⋅*×()-]")
# Words that raise the unit behind or before them.
_BEFORE = {"square": 2, "sq": 2, "cubic": 3, "cu": 3}
_AFTER = {"squared": 2, "cubed": 3}


#: Scales of inch and foot, their squares, and the pound itself.
_POUND_WITH = {_F("0.0254"), _F("0.3048"), _F("0.0254") ** 2, _F("0.3048") ** 2, _F("0.45359237")}


class _UnitReader:
    """unit := factor {['·' | '*' | '-' | ' '] factor | ('/' | 'per' | 'a' | 'an') factor}
    factor := ['square' | 'cubic'] (name | '(' unit ')') [power | 'squared' | 'cubed']
    """

    def __init__(self, tokens: list[str]):
        self.tokens, self.i = tokens, 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.i + ahead] if self.i + ahead < len(self.tokens) else ""

    def unit(self) -> Unit | None:
        out = self.factor()
        while out is not None and self.peek() not in ("", ")"):
            t = self.peek().lower()
            sign = -1 if t in ("/", "per") or t in ("a", "an") and self.peek() not in SYMBOLS else 1
            if sign < 0 or t in ("·", "⋅", "*", "×", "-"):
                self.i += 1
            other = self.factor()
            if other is not None and NAMES["pound"] in (out, other) and (other.dims, sign) in ((_AREA, -1), (_L, 1), (_M, 1)) and other.scale in _POUND_WITH:
                # a pound over an area, or along a length, is one of force
                out, other = (SYMBOLS["lbf"] if u == NAMES["pound"] else u for u in (out, other))
            out = out.times(other, sign) if other is not None else None
        return out

    def factor(self) -> Unit | None:
        power = _BEFORE.get(self.peek().lower().rstrip("."), 0)
        self.i += bool(power)
        if self.peek() == "(":
            self.i += 1
            base = self.unit()
            if self.peek() != ")":
                return None
        elif self.peek().lower() in ("degree", "degrees", "deg") and base_unit("°" + self.peek(1)[:1].upper()) and self.peek(1).lower() in ("c", "f", "r", "celsius", "fahrenheit", "centigrade", "rankine"):
            self.i += 1
            base = base_unit(self.peek()) if len(self.peek()) > 1 else base_unit("°" + self.peek().upper())
        elif self.peek().lower() in ("fl", "fluid") and self.peek(1).lower() in ("oz", "ounce", "ounces"):
            self.i += 1
            base = SYMBOLS["floz"]
        elif self.peek().lower() in ("nautical",) and self.peek(1).lower() in ("mile", "miles"):
            self.i += 1
            base = SYMBOLS["nmi"]
        else:
            base = base_unit(self.peek().replace(" ", "")) if self.peek() else None
        if base is None:
            return None
        self.i += 1
        if self.peek() in ("^", "**") and re.fullmatch(r"-?\d+", self.peek(1)):
            power, self.i = int(self.peek(1)), self.i + 2
        elif re.fullmatch(r"-?\d+", self.peek()):
            power, self.i = int(self.peek()), self.i + 1
        elif self.peek().lower() in _AFTER:
            power, self.i = _AFTER[self.peek().lower()], self.i + 1
        return base.power(power) if power else base


@lru_cache(maxsize=65536)
def unit_of(text: str) -> Unit | None:
    """The unit an expression names: 'km/h', 'miles per hour', 'm s^-2', 'J/(kg K)', 'square feet', '°F'; None if none."""
    plain = text.strip().translate(_SUPERSCRIPTS)
    tokens = _UNIT_TOKEN.findall(plain)
    if not tokens or "".join(tokens).replace(" ", "") != re.sub(r"[\s.]+", "", plain):
        return None
    reader = _UnitReader(tokens)
    try:
        unit = reader.unit()
    except ValueError:  # an offset inside a product
        return None
    return unit if unit is not None and reader.i == len(tokens) else None


def canonical(number: Fraction, unit: Unit) -> Fraction:
    """The value in the coherent unit of the unit's dimensions."""
    return number * unit.scale + unit.offset


_NUMBER = r"\d+(?:[.,]\d+)*(?:\s?[¼½¾⅓⅔⅛]|\s[1-9]/[2-9](?!\d)|/[2-9]\d?(?![\d/]))?(?:[eE][+-]?\d+|\s?[x×*]\s?10\s?(?:\^|\*\*)\s?-?\d+)?|[¼½¾⅓⅔⅛]"
_NAME = r"(?:[^\W\d_]+|°\s?[a-z]|[℃℉%‰Ω])(?:[²³]|\^-?\d+)?"
_QUANTITY = re.compile(
    rf"(?<![\w.,/-])(?P<sign>[-−+])?(?P<money>[$])?(?:(?P<low>{_NUMBER})\s*(?:-|–|to|and|or)\s*)?(?P<number>{_NUMBER})(?:\s+(?P<times>hundred|thousand|million|billion)\b)?"
    rf"(?P<gap>[\s-]?)(?P<unit>{_NAME}(?:(?:\.?\s+|\s?[/·⋅-]\s?){_NAME}){{0,4}})?",
    re.IGNORECASE,
)
# Words behind an inch that is one; before any other word "in" is a preposition. One-letter units that count directly behind a number.
_INCH_WORDS = set("long wide tall high deep thick diameter by x and or per of below above apart away off from short".split())
_ATTACHED = set("VWgLl")


def _written(text: str) -> Fraction:
    """A number with its fraction and power of ten."""
    t = re.sub(r"\s+", " ", text.strip())
    power = _F(1)
    if m := re.search(r"[eE]([+-]?\d+)$|\s?[x×*]\s?10\s?(?:\^|\*\*)\s?(-?\d+)$", t):
        power, t = _F(10) ** int(m[1] or m[2]), t[: m.start()]
    if t in VULGAR:
        return VULGAR[t] * power
    if t[-1] in VULGAR:
        return (number_of(t[:-1].strip()) + VULGAR[t[-1]]) * power
    if m := re.fullmatch(r"(?:(.+) )?(\d+)/(\d+)", t):
        return ((number_of(m[1]) if m[1] else 0) + _F(int(m[2]), int(m[3]))) * power
    return number_of(t) * power


def _unit_at(found: re.Match, rest: str) -> tuple[Unit, int] | None:
    """The longest unit behind a number in running text, and how much of the match it takes."""
    name = found["unit"] or ""
    words = [m.end() for m in re.finditer(r"\S+", name)]
    for end in reversed(words):
        part = name[:end].rstrip(".,;:")
        unit = unit_of(part)
        if unit is None:
            continue
        alone = re.sub(r"\s", "", part)
        if len(alone) == 1 and alone not in "℃℉%‰$¢Ω" and (found["gap"] or alone not in _ATTACHED or re.match(r"[-/]\w", name[end:] + rest)):
            continue  # in running text a letter is mostly a word or an initial
        if part.lower() == "in":
            after = re.match(r"\s+([^\W\d_]+)", name[end:] + rest)
            if after and after[1].lower() not in _INCH_WORDS:
                continue
        return unit, found.start("unit") + end
    return None


@lru_cache(maxsize=1 << 14)
def quantities(text: str) -> tuple[tuple[int, Fraction, tuple[int, ...]], ...]:
    """Every number with a unit in running text: (offset, canonical value, dimensions).

    Both ends of a range count, with one unit. Parts of one quantity, as in 6 ft 2 in or 1 h
    30 min, are added. One-letter units count only in a quotient, with a degree sign, or,
    for some, directly behind the number, as in running text they are mostly words.
    """
    out: list[tuple[int, Fraction, tuple[int, ...]]] = []
    last: tuple[int, Unit] | None = None  # end and unit of the quantity before
    at = 0
    while m := _QUANTITY.search(text, at):
        at = m.end("number")
        n = _written(m["number"]) * MULTIPLIERS.get((m["times"] or "").lower(), 1)
        found = _unit_at(m, text[m.end() : m.end() + 20])
        if found is None and m["money"]:
            found = SYMBOLS["$"], m.end("number")
        if found is None:
            if m["low"]:
                at = m.end("low")
            continue
        unit, at = found
        sign = -1 if m["sign"] in ("-", "−") else 1
        if m["low"]:
            out.append((m.start("low"), canonical(sign * _written(m["low"]), unit), unit.dims))
            sign = 1
        begin = m.start("number") if m["low"] else m.start()
        joined = last and not m["low"] and unit.dims in (_L, _M, _T) and unit.dims == last[1].dims and unit.scale < last[1].scale and not unit.offset and re.fullmatch(r"\s*(?:and\s+)?", text[last[0] : m.start()])
        if joined and n * unit.scale < last[1].scale:
            first, value, dims = out.pop()
            out.append((first, value + (n * unit.scale if value >= 0 else -n * unit.scale), dims))
        else:
            out.append((begin, canonical(sign * n, unit), unit.dims))
        last = at, unit
    return tuple(out)
