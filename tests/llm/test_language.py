import numpy as np
import pytest

from quern.llm import language as lg

TEXTS = {
    "en": "The house on the hill was old and the people who lived there never spoke to anyone in the village. They went to the market once a week with their dog.",
    "es": "La casa de la colina era vieja y la gente que vivía allí nunca hablaba con nadie del pueblo. Iban al mercado una vez por semana con su perro.",
    "fr": "La maison sur la colline était vieille et les gens qui y vivaient ne parlaient jamais à personne du village. Ils allaient au marché une fois par semaine avec leur chien.",
    "de": "Das Haus auf dem Hügel war alt und die Leute, die dort wohnten, sprachen nie mit jemandem im Dorf. Sie gingen einmal in der Woche mit ihrem Hund zum Markt.",
    "pt": "A casa na colina era velha e as pessoas que lá viviam nunca falavam com ninguém da aldeia. Elas iam ao mercado uma vez por semana com o seu cão.",
    "nl": "Het huis op de heuvel was oud en de mensen die daar woonden spraken nooit met iemand in het dorp. Zij gingen een keer per week met hun hond naar de markt.",
}


def sentence(code, k):
    return TEXTS[code].split(". ")[k].rstrip(".") + "."


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(100 + 10 * i + k, TEXTS[c] + f" {k}.", label, c) for i, c in enumerate(TEXTS) for k in range(6) for label in [c if k else c.upper()]]
    rows += [
        (1, sentence("en", 0) + " " + sentence("en", 1), "en-US", "x"), (2, sentence("fr", 0), "de", "x"), (3, sentence("nl", 0), None, "x"),
        (4, sentence("en", 0) + " " + sentence("de", 0) + " " + sentence("de", 1) + " " + sentence("en", 1), "en", "x"), (5, "", "en", "x"), (6, None, "en", "x"), (7, "   ", "xx", "x"),
        (8, sentence("es", 0) + " (“Sturm und Drang”). " + sentence("es", 1), "español", "x"), (9, "4/5 ... 12", "en", "x"), (10, "Привет, как дела.", "russian", "x"),
        (13, sentence("en", 0) + " 这个村子里的人每周去一次市场。 " + sentence("en", 1), "en", "x"), (14, sentence("en", 0).rstrip(".") + ", " + sentence("de", 0), "en", "x"), (15, "Καλημέρα σε όλους.", None, "x"),
        (11, sentence("pt", 0).replace("í", "i").replace("é", "e").upper(), "pt", "x"), (None, sentence("fr", 0), None, "x"), (2, sentence("fr", 0), "de", "x"), (12, (sentence("de", 0) + " ") * 3000, "nl", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id string").repartition(3)


def test_wrong_and_missing_labels_and_mixed_texts(docs):
    got = sorted(tuple(r) for r in lg.mislabelled(docs, "doc_id", "text", "lang").filter("doc_id < 100").collect())
    assert got == [(2, 1, "fr"), (3, 1, "nl"), (4, 1, "en"), (4, 2, "de"), (4, 3, "en"), (12, 1, "de"), (13, 1, "en"), (13, 2, "zh"), (13, 3, "en"), (15, 1, "el")]


def test_segments_have_confidence_and_cover_all_words(docs):
    rows = lg.segments(docs, "doc_id", "text", "lang").collect()
    assert all(0 <= r["confidence"] <= 1 for r in rows) and min(r["confidence"] for r in rows if 99 < r["doc_id"]) > 0.9
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.filter("length(trim(text)) > 0").collect()} - {None}
    assert {r["doc_id"]: r["lang"] for r in rows if r["doc_id"] in (9, 10)} == {9: None, 10: "und-Cyrl"}


def test_spans_change_inside_a_sentence(docs):
    rows = sorted((r["span_no"], r["lang"], r["first_word"], r["n_words"]) for r in lg.spans(docs, "doc_id", "text", "lang").filter("doc_id = 14").collect())
    n = len(sentence("en", 0).split())
    assert [r[:2] for r in rows] == [(1, "en"), (2, "de")] and abs(rows[1][2] - n) <= 1 and sum(r[3] for r in rows) == n + len(sentence("de", 0).split())


def test_empty_table(docs):
    assert lg.segments(docs.limit(0), "doc_id", "text", "lang").count() == 0


def test_label_notations(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x,) for x in ("en", "EN-us", "English", "fra", "pt_BR", "Deutsch", "xx", "mul", "", None, "n/a")], "l string")
    assert [r[0] for r in df.select(lg.code_of(F.col("l"))).collect()] == ["en", "en", "en", "fr", "pt", "de", None, None, None, None, None]


def test_viterbi_against_brute_force():
    import itertools

    rng = np.random.default_rng(1)
    s, begins = rng.normal(scale=5, size=(30, 6, 3)), rng.random((30, 6)) < 0.5
    n = rng.integers(1, 7, 30)
    got = lg.path(s, begins, n)
    for k in range(30):
        cost = lambda p: sum(lg.SWITCH if begins[k, i] else lg.INSIDE for i in range(1, n[k]) if p[i] != p[i - 1])  # noqa: B023, E731
        value = lambda p: sum(s[k, i, x] for i, x in enumerate(p)) - cost(p)  # noqa: B023, E731
        assert value(got[k, : n[k]]) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=int(n[k]))))


def test_texts_that_are_not_mixed_have_one_state_on_their_path():
    rng = np.random.default_rng(2)
    lengths = rng.integers(0, 9, 300)
    rows = np.concatenate([[0], np.cumsum(lengths)])
    value = rng.normal(scale=1.5, size=(rows[-1], 4)) + rng.normal(scale=1.5, size=4)
    total = np.array([value[a:b].sum(axis=0) for a, b in zip(rows[:-1], rows[1:])])
    main = total.argmax(axis=1)
    mixed, one = lg.mixed(value, rows, main), 0
    for r in np.flatnonzero((lengths > 0) & ~mixed):
        p = lg.path(value[None, rows[r] : rows[r + 1]], np.ones((1, lengths[r]), bool), lengths[r : r + 1])[0]
        one += 1
        assert (p == main[r]).all()
    assert one > 20 and mixed.sum() > 20


def test_held_out_accuracy():
    scores = lg.fit([TEXTS[c].split(". ")[0] for c in TEXTS] * 3, list(TEXTS) * 3)
    hits = sum(lg.LANGUAGES[int(sum(scores.word(w) for w in TEXTS[c].split(". ")[1].split()).argmax())] == c for c in TEXTS)
    assert hits >= len(TEXTS) - 1  # from one sentence a language
