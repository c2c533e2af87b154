import random
from collections import Counter
from fractions import Fraction

import pytest

from quern.operators.measures import score_milli, source_scales, text_quantities, to_canonical
from quern.operators.packed import lattice, plain, split_packed
from quern.operators.skew import compress, heavy_keys, value_stats, weighted_percentiles

SCORES = "id string, score string, text string, source string, _s string, score_milli string"
GRADES = [("A", 95), ("B+", 88), ("F", 20)]


def _scores(spark, data):
    return spark.createDataFrame([(i, *row, "x", "y") for i, row in enumerate(data)], SCORES.replace("id string", "id int"))


def test_bare_numbers_take_their_scale_from_the_text_then_the_source(spark, rows):
    data = [("3/4", None, "Post"), ("2/4", "", "Post"), ("9/10", None, "Post"), ("1/4", None, "Post"), ("3", None, "Post"), ("3", "(x/5) Fine.", "Post"),
            ("9", None, "Post"), ("3", None, "Other"), ("3", None, None), ("B+", None, None), ("E", None, "Post"), (None, None, None), ("", "x", "Post"), ("4/5", None, "Mixed"), ("7/10", None, "Mixed"), ("5", None, "Mixed")]
    df = _scores(spark, data)
    out = score_milli(df, "score", "text", "source", spark.createDataFrame(GRADES, "grade string, pct int"))
    got = {r["id"]: r["score_milli"] for r in out.collect()}
    assert [got[i] for i in range(len(data))] == [750, 500, 900, 250, 750, 600, None, None, None, 880, None, None, None, 800, 700, None]
    assert sorted(out.columns) == sorted(df.columns) and out.count() == len(data)
    assert rows(source_scales(df, "score", "source")) == [("Post", 4.0)]


def test_scores_of_an_empty_table(spark):
    grades = spark.createDataFrame(GRADES, "grade string, pct int")
    assert score_milli(_scores(spark, []), "score", "text", "source", grades).count() == 0


def test_canonical_values(spark, rows):
    df = spark.createDataFrame([(1, 36.0, "km/h"), (2, 50.0, "°F"), (3, None, "km"), (4, 1.0, None), (5, 1.0, "smoots")], "id int, value double, unit string")
    got = rows(to_canonical(df, "value", "unit").select("id", "canonical"))
    assert got[0][1] == pytest.approx(10) and got[1][1] == pytest.approx(283.15) and [g[1] for g in got[2:]] == [None] * 3
    found = text_quantities(spark.createDataFrame([("at 10 km/h", "q"), (None, "q"), ("", "q")], "t string, _q string"), "t")
    assert found.columns == ["t", "_q", "starts_at", "value", "dims"] and found.count() == 1


def _keys(spark, n=4000):
    r = random.Random(5)
    data = [(r.choice(["hot", "hot", "hot", "b", "c", None]), r.choice([1, 2, 2, 3, None])) for _ in range(n)]
    return data, spark.createDataFrame(data, "key string, value int").repartition(5)


def test_value_frequency_compression_against_brute_force(spark):
    data, df = _keys(spark)
    assert {(r["key"], r["value"]): r["_weight"] for r in compress(df, "key", ["value"]).collect()} == Counter(data)
    for r in value_stats(df, "key", "value").collect():
        values = [v for k, v in data if k == r["key"]]
        known = Counter(v for v in values if v is not None)
        top = max(known.values())
        assert (r["n_rows"], r["n_values"], r["n_distinct"]) == (len(values), sum(known.values()), len(known))
        assert r["mode"] == min(v for v, n in known.items() if n == top)


def test_heavy_keys_count_all_rows_in_the_total(spark):
    data, df = _keys(spark)
    n = Counter(k for k, _ in data)
    got = {r["key"]: (r["n_rows"], r["total_rows"]) for r in heavy_keys(df, "key", "value", Fraction(1, 5)).collect()}
    assert got == {k: (c, len(data)) for k, c in n.items() if k is not None and c * 5 >= len(data)}
    exact = spark.createDataFrame([("a", 1)] + [(f"k{i}", 1) for i in range(49)], "key string, value int")
    assert heavy_keys(exact, "key", "value").count() == 50  # exactly one in fifty
    assert heavy_keys(exact.limit(0), "key", "value").count() == 0


def test_percentiles_of_a_heavy_key_are_exact(spark):
    r = random.Random(2)
    data = [("hot", r.randrange(1000)) for _ in range(5000)] + [("one", 7), ("none", None), (None, 3)] + [("tie", 4)] * 10
    df = spark.createDataFrame(data, "key string, value int").repartition(7)
    got = {(x["key"], x["share"]): x["value"] for x in weighted_percentiles(df, "key", "value", [0.0, 0.25, 0.5, 1.0]).collect()}
    for key in ("hot", "one", "tie"):
        values = sorted(v for k, v in data if k == key and v is not None)
        for share in (0.0, 0.25, 0.5, 1.0):
            assert got[key, share] == values[max(1, -(-int(share * 100) * len(values) // 100)) - 1]
    assert len(got) == 12


FIELDS = {
    "dented": ["dented"], "no_damage;": ["no_damage"], "dented;torn": ["dented", "torn"], "torn, dented": ["torn", "dented"], "dented|torn|dented": ["dented", "torn", "dented"],
    '"dented, hood";torn': ["dented, hood", "torn"], '["torn \\"hood\\"", "dented"]': ['torn "hood"', "dented"], 'torn;"dented ""hood"""': ["torn", 'dented "hood"'],
    "{torn; dented (hood; roof)}": ["torn", "dented (hood; roof)"], "dented - hood;torn": ["dented - hood", "torn"], "torn - roof": ["torn - roof"], "dented (hood)": ["dented (hood)"],
    "dented (roof)": ["dented (roof)"], "torn (roof);dented": ["torn (roof)", "dented"], "dented+ + torn": ["dented", "torn"], "torn & dented": ["torn", "dented"], "torn\tdented": ["torn", "dented"],
    "dented;;torn": ["dented", "torn"], "'torn' ; 'torn'": ["torn", "torn"], " ; ": [], "": [], '"dented': ['"dented'], "(torn;dented": ["(torn", "dented"], "torn / dented": ["torn", "dented"],
}


def test_packed_fields_are_split_by_what_the_column_teaches(spark):
    data = [(i, f, "x") for i, f in enumerate([*FIELDS, None])] + [(100 + i, x, "x") for i, x in enumerate(["dented", "torn", "dented;torn", "torn;dented", "torn (hood)", "dented (hood)", "torn (roof)"] * 5)]
    df = spark.createDataFrame(data, "id int, packed string, _field string")
    got: dict = {}
    for r in split_packed(df, "packed").collect():
        got.setdefault(r["id"], {})[r["pos"]] = r["value"]
    for i, (field, want) in enumerate(FIELDS.items()):
        assert [got.get(i, {})[p] for p in sorted(got.get(i, {}))] == want, field
    assert len(FIELDS) not in got
    assert split_packed(df.limit(0), "packed").count() == 0


def test_lattice_keeps_all_text():
    atoms, marks, gaps = lattice("a - b ; 'c;d' , (e, f)")
    assert atoms == ["a", "b", "'c;d'", "(e, f)"] and marks == ["-", ";", ","] and gaps == [" - ", " ; ", " , "]
    assert plain('"x ""y"""') == 'x "y"' and plain("'it\\'s'") == "it's" and plain('""') == ""
    assert len(lattice("x;" * 50_000)[0]) == 50_000
