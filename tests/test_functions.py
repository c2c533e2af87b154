from fractions import Fraction as Fr

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.functions import bytewords as bw
from quern.functions.scores import parse_score, stated_scale
from quern.functions.units import canonical, number_of, quantities, unit_of


@pytest.mark.parametrize(
    ("text", "milli"),
    [
        ("3.5/5", 700), ("2,5 / 4", 625), ("3½/5", 700), ("½/4", 125), ("3 1/2 / 5", 700), ("1/2 / 5", 100), ("3.5|5", 700), ("2 [of 10]", 200),
        ("37 (100)", 370), ("13pts/20", 650), ("7.8 de 10", 780), ("Three and a half out of four stars", 875), ("66%", 660), ("64 per cent", 640),
        ("★★★½☆", 700), ("☆☆☆☆", 0), ("★★★★", 1000), ("04/5", 800), ("3⁄5", 600), ("Score: 4.5/5", 900), ("0.41/1", 410), ("3.5/6", 583),
    ],
)
def test_scaled_scores(text, milli):
    assert parse_score(text).milli == milli


@pytest.mark.parametrize("text", ["", " ", "-", "TBD", "N/A", "?", "Recommended", "see review", "5 of", "4/0", "/5"])
def test_entries_without_a_score(text):
    assert parse_score(text).milli is None


def test_scores_above_their_scale_and_grades_and_bare_numbers():
    assert parse_score("7/5").kind == "scaled" and parse_score("7/5").milli is None
    assert [parse_score(x).grade for x in ("B+", "a–", "Grade D plus", "F")] == ["B+", "A-", "D+", "F"]
    assert parse_score("12,5").kind == "bare" and parse_score("12,5").value == Fr(25, 2)


@given(st.integers(0, 200), st.sampled_from([4, 5, 6, 10, 20, 100]))
def test_every_notation_says_the_same(tenths, scale):
    value = Fr(tenths, 10)
    want = int(1000 * value / scale + Fr(1, 2)) if value <= scale else None
    text = f"{tenths // 10}.{tenths % 10}"
    for form in ("{}/{}", "{} / {}", "{} of {}", "{} out of {} stars", "{} [of {}]", "{} ({})", "{}pts/{}", "{} von {}"):
        assert parse_score(form.format(text, scale)).milli == want


def test_stated_scales():
    assert stated_scale("Fine. Scored from zero to ten.") == 10
    assert stated_scale("(x/20) Few pictures of 2007 look this brisk.") == 20
    assert stated_scale("The figure is on a five-point scale.") == 5
    assert stated_scale("Marks are given out of a hundred.") == 100
    assert stated_scale("That is with 4 as the top mark.") == 4
    assert stated_scale("Ten minutes out of town.") is None
    assert stated_scale("(x/10) That is with 4 as the top mark.") is None


def test_units_have_dimensions_scales_and_offsets():
    assert unit_of("km/h").dims == unit_of("miles per hour").dims == unit_of("m s^-1").dims
    assert unit_of("kg m²/s²").dims == unit_of("joule").dims
    assert float(canonical(Fr("98.6"), unit_of("°F"))) == pytest.approx(310.15)
    assert float(canonical(Fr(0), unit_of("°C"))) == pytest.approx(273.15)
    assert unit_of("parsecs per fortnight") is None and unit_of("degrees Celsius") == unit_of("°C") and unit_of("°F/s") is None


# expression, canonical value of one of it, and dimensions as exponents of length, mass, time, temperature, current
UNITS = """
MPa 1e6 -1,1,-2 | mPa 1e-3 -1,1,-2 | kPa 1e3 -1,1,-2 | MW 1e6 2,1,-3 | mW 1e-3 2,1,-3 | GW 1e9 2,1,-3 | MHz 1e6 0,0,-1 | GHz 1e9 0,0,-1 | MJ 1e6 2,1,-2 | Mg 1e3 0,1,0 | mg 1e-6 0,1,0
kg 1 0,1,0 | µg 1e-9 0,1,0 | μg 1e-9 0,1,0 | nm 1e-9 1,0,0 | µm 1e-6 1,0,0 | mm 1e-3 1,0,0 | cm 1e-2 1,0,0 | dm 0.1 1,0,0 | dam 10 1,0,0 | hm 100 1,0,0 | km 1e3 1,0,0 | Gm 1e9 1,0,0 | pm 1e-12 1,0,0
in 0.0254 1,0,0 | ft 0.3048 1,0,0 | yd 0.9144 1,0,0 | mi 1609.344 1,0,0 | nmi 1852 1,0,0 | inches 0.0254 1,0,0 | kilometre 1e3 1,0,0 | nanometers 1e-9 1,0,0 | megametres 1e6 1,0,0
lb 0.45359237 0,1,0 | oz 0.028349523125 0,1,0 | stone 6.35029318 0,1,0 | t 1e3 0,1,0 | kt 1e6 0,1,0 | tonnes 1e3 0,1,0 | tons 907.18474 0,1,0 | milligrams 1e-6 0,1,0
s 1 0,0,1 | ms 1e-3 0,0,1 | ns 1e-9 0,0,1 | min 60 0,0,1 | h 3600 0,0,1 | hrs 3600 0,0,1 | days 86400 0,0,1 | weeks 604800 0,0,1 | microseconds 1e-6 0,0,1
km/h 0.277777777778 1,0,-1 | m/s 1 1,0,-1 | mph 0.44704 1,0,-1 | MPH 0.44704 1,0,-1 | kph 0.277777777778 1,0,-1 | knots 0.514444444444 1,0,-1 | miles_per_hour 0.44704 1,0,-1 | miles_an_hour 0.44704 1,0,-1 | ft/s 0.3048 1,0,-1
m/s^2 1 1,0,-2 | m_s^-2 1 1,0,-2 | m_s⁻² 1 1,0,-2 | metres_per_second_squared 1 1,0,-2 | m·s**-2 1 1,0,-2 | m² 1 2,0,0 | m2 1 2,0,0 | km² 1e6 2,0,0 | cm^3 1e-6 3,0,0 | square_feet 0.09290304 2,0,0 | sq_ft 0.09290304 2,0,0 | ha 1e4 2,0,0 | acres 4046.8564224 2,0,0
cubic_metres 1 3,0,0 | l 1e-3 3,0,0 | L 1e-3 3,0,0 | mL 1e-6 3,0,0 | ml 1e-6 3,0,0 | cl 1e-5 3,0,0 | hl 0.1 3,0,0 | gal 0.003785411784 3,0,0 | fl_oz 2.95735295625e-5 3,0,0 | cc 1e-6 3,0,0 | tsp 4.92892159375e-6 3,0,0
N 1 1,1,-2 | kN 1e3 1,1,-2 | lbf 4.4482216152605 1,1,-2 | psi 6894.757293168 -1,1,-2 | pounds_per_square_inch 6894.757293168 -1,1,-2 | bar 1e5 -1,1,-2 | mbar 100 -1,1,-2 | hPa 100 -1,1,-2 | atm 101325 -1,1,-2 | mmHg 133.322387415 -1,1,-2
J 1 2,1,-2 | kWh 3.6e6 2,1,-2 | kilowatt-hours 3.6e6 2,1,-2 | cal 4.184 2,1,-2 | kcal 4184 2,1,-2 | eV 1.602176634e-19 2,1,-2 | ft-lb 1.3558179483314 2,1,-2 | N_m 1 2,1,-2 | W 1 2,1,-3 | hp 745.69987158227 2,1,-3 | J/(kg_K) 1 2,0,-2,-1 | kg/m/s 1 -1,1,-1
K 1 0,0,0,1 | V 1 2,1,-3,0,-1 | kV 1e3 2,1,-3,0,-1 | mA 1e-3 0,0,0,0,1 | Ω 1 2,1,-3,0,-2 | kΩ 1e3 2,1,-3,0,-2 | F 1 -2,-1,4,0,2 | µF 1e-6 -2,-1,4,0,2 | Ah 3600 0,0,1,0,1 | % 0.01 0,0,0 | ppm 1e-6 0,0,0 | kg_m²/s² 1 2,1,-2
"""


@pytest.mark.parametrize("row", [x.split() for x in UNITS.replace("\n", "|").split("|") if x.strip()], ids=lambda r: r[0])
def test_a_table_of_units(row):
    unit = unit_of(row[0].replace("_", " "))
    dims = [int(x) for x in row[2].split(",")]
    assert float(canonical(Fr(1), unit)) == pytest.approx(float(row[1])) and unit.dims == (*dims, *[0] * (9 - len(dims)))


def test_words_that_are_no_units():
    assert [unit_of(x) for x in ("", "mw", "Gbit", "per", "square", "m/", "/s", "m^x", "(m", "kkk", "the")] == [None] * 11


@pytest.mark.parametrize(
    "text, want",
    [
        ("5 in the morning", []), ("a pipe 5 in long", [0.127]), ("10-15 mph", [4.4704, 6.7056]), ("between 10 and 15 km/h", [2.7778, 4.1667]), ("6 ft 2 in", [1.8796]), ("2 hours and 30 minutes", [9000]),
        ("3 MW, 3 mW", [3e6, 0.003]), ("1/2 inch", [0.0127]), ("2 1/2 in.", [0.0635]), ("2½ inches", [0.0635]), ("32 pounds per square inch", [220632.2334]), ("3 x 10^5 Pa", [3e5]), ("1.5e3 Pa", [1500]), ("Recall 46V-791", []), ("12V battery", [12]),
        ("$4.50", [4.5]), ("-40 °C", [233.15]), ("9.8 m/s^2", [9.8]), ("200 square feet of it", [18.5806]), ("room 5 m", []), ("1,250.5 kg", [1250.5]), ("ward 3, bed 2", []), ("2 million tonnes", [2e9]), ("5 lb 3 oz", [2.3530]), ("70 km per hour the car", [19.4444]),
    ],
)
def test_quantities_as_people_write_them(text, want):
    assert [round(float(v), 4) for _, v, _ in quantities(text)] == want


def test_quantities_in_text():
    found = quantities("At about 59 miles per hour, with 25 thousand miles on it, at 52 psi on 2019-02-12.")
    assert [round(float(v), 2) for _, v, _ in found] == [26.38, 40233600.0, 358527.38]
    assert quantities("") == ()


def test_number_marks():
    assert number_of("1,234") == 1234 and number_of("2,5") == Fr(5, 2) and number_of("1.234.567") == 1234567 and number_of("0,125") == Fr(1, 8)


@settings(deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_words_of_any_texts(texts):
    import re

    seen = []
    for w in bw.words_of(pa.array(texts, pa.string())):
        assert w.row_words[-1] == len(w.starts)
        seen += [[w.text(i) for i in range(w.row_words[r], w.row_words[r + 1])] for r in range(w.rows)]
    assert len(seen) == len(texts)
    for text, words in zip(texts, seen):
        assert "".join(words) in "".join(text.split()) or all(x in text for x in words)
        if text.isascii():
            assert words == re.findall(r"[A-Za-z0-9]+", text)


def test_equal_words_have_equal_hashes_whatever_their_case_and_place():
    chunks = list(bw.words_of(pa.array(["Über alpha", None, "x ÜBER Alpha alpha", ""])))
    h = np.concatenate([c.hashes for c in chunks])
    assert h[1] == h[4] == h[5] and h[0] != h[1]
    plain = np.concatenate([c.hashes for c in bw.words_of(bw.without_accents(pa.array(["é E É é", "straße STRASSE", "cœur coeur"])))])
    assert len(set(plain[:4])) == 1 and plain[4] == plain[5] and plain[6] == plain[7]


def test_slices_nulls_and_long_texts():
    column = pa.array(["skip me", None, "a b", "word " * 300_000]).slice(1)
    chunks = list(bw.words_of(column))
    assert sum(len(c.starts) for c in chunks) == 300_002 and [c.first_row for c in chunks] == sorted(c.first_row for c in chunks)
