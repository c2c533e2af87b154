import numpy as np
import pyarrow as pa
import pytest

from quern.functions.bytewords import words_of
from quern.llm import truncation as t

ENDINGS = ["the film is long and the story is slow", "nobody in the room knows how it ends", "every scene is followed by a quiet one"]


def corpus():
    rows, n = [], 0
    for k in range(30):
        for a in ENDINGS:
            for b in ENDINGS:
                rows.append((f"r{n}", f"{a.capitalize()}. {b.capitalize()}.", f"s{k % 3}"))
                n += 1
    return rows


CASES = {
    "cut": "Nobody in the room knows how it ends. The film is long and the", "word": "Every scene is followed by a quiet one. The film is lo", "mark": "The film is long and the story is ...",
    "broken": "The film is long and the stor�", "whole": "The film is long and the story is slow.", "habit": "Nobody in the room knows how it ends", "smile": "The film is long and the story is slow. See it in town :)",
    "smile2": "Every scene is followed by a quiet one. See it in town :)", "title": "A triumph", "title2": "A triumph", "asks": "Who knows how it ends?", "dots": "The story is slow. Well well…", "dots2": "It ends. Well well…", "empty": "", "blank": "   ",
}


@pytest.fixture(scope="module")
def reviews(spark):
    data = corpus() + [(k, x, "case") for k, x in CASES.items()] + [("null", None, "case"), (None, "The film is long and the", "case"), ("cut", CASES["cut"], None)]
    df = spark.createDataFrame(data, "id string, body string, source string")
    return df.selectExpr("*", "1 AS row_id", "'x' AS text", "0 AS text_key", "0 AS run").repartition(3)


def test_cut_texts_come_out(reviews):
    got = {r["row_id"] for r in t.truncated(reviews, "id", "body").collect()}
    assert got == {"cut", "word", "mark", "broken"}


def test_cuts_behind_a_sentence_stay_cuts_however_many_there_are(spark):
    """The words before never go on, so many texts cut in the same first word look like one closing remark."""
    starts = [f"{a.capitalize()}. The film is long and the story is slow" for a in ENDINGS]
    ends = {"word": ". Nob", "letter": ". E", "mark": ". Ev ...", "whole": ". Every", "bracket": " (it ends) nob", "remark": ". Recommended", "marked": ". Enough..."}
    rows = [(r[0], r[1]) for r in corpus()] + [(f"{k}{i}", x + end) for k, end in ends.items() for i, x in enumerate(starts)]
    got = {r["row_id"] for r in t.truncated(spark.createDataFrame(rows, "id string, body string").repartition(3), "id", "body").collect()}
    assert got == {f"{k}{i}" for k in ("word", "letter", "mark", "whole", "bracket") for i in range(len(starts))}


def test_first_words_count_by_their_letters():
    texts = ["Alpha beta. GAMMA delta (epsilon) zeta 12. 34 eta", "Gamma gam", "x. gam", "", "y... 5", "no stop"]
    (w,) = words_of(pa.array(texts), digits_alike=True)
    words = t._first_words(w, t._gap_classes(w))
    assert [w.text(i) for i in words] == ["GAMMA", "zeta", "34", "gam", "5"]
    at, h = t._begun(w, words)
    of = [h[(at >= w.starts[i]) & (at < w.ends[i])].tolist() for i in words]
    assert [len(x) for x in of] == [5, 4, 2, 3, 1] and of[3] == of[0][:3] and of[4] == of[2][:1] and len({x for y in of for x in y}) == 5 + 4 + 2


def test_rates_per_source(reviews):
    got = {r["source"]: (r["n_rows"], r["n_cut"]) for r in t.source_rates(reviews, "id", "body", "source").collect()}
    assert got["s0"][1] == 0 and got["case"][1] == 4 and got[None] == (1, 1)


def test_a_copy_that_goes_on_decides(spark):
    base = "The quick brown fox jumps over the lazy dog while seven grey geese fly south past our old red barn and land near a pond"
    rows = [("full", base + " before the frost comes."), ("cut", base), ("whole", base + ". Then they rest."), ("other", "Nothing to see here.")]
    df = spark.createDataFrame(rows[:2] + rows[3:], "id string, body string")
    assert [tuple(r) for r in t.truncated(df, "id", "body").collect()] == [("cut", "copy")]
    df = spark.createDataFrame([rows[1], rows[2]], "id string, body string")
    assert t.truncated(df, "id", "body").count() == 0


@pytest.mark.parametrize("block", [t.BLOCK, 4])
def test_every_longer_text_of_a_bucket_is_met(spark, monkeypatch, block):
    """A near-copy decides also where the longest text of each shared bucket isn't one."""
    monkeypatch.setattr(t, "BLOCK", block)
    base = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    far = [f"{base} " + " ".join(f"other{chr(97 + k // 26)}{chr(97 + k % 26)}{chr(97 + i)}" for i in range(14)) + "." for k in range(60)]  # 36 of 50 shingles
    rows = [("cut", base), ("again", base), ("full", base + " and so on.")] + [(f"far{k}", x) for k, x in enumerate(far)]
    got = t.truncated(spark.createDataFrame(rows, "id string, body string"), "id", "body")
    assert sorted(tuple(r) for r in got.collect()) == [("again", "copy"), ("cut", "copy")]


def beginnings(texts):
    (w,) = words_of(pa.array(texts), digits_alike=True)
    return w, t.Beginnings(w)


def test_sketches_never_differ_by_more_than_the_shingles():
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + i)}" for i in range(12)]  # few words, so that shingles come twice
    texts = [" ".join(rng.choice(words, rng.integers(0, 90))) for _ in range(40)]
    texts += [" ".join(x.split()[: rng.integers(1, 90)]) for x in texts]
    _, b = beginnings(texts)
    sets = []
    for row, level in zip(b.row, b.level):
        x = texts[row].split()[: level or None]
        sets.append({tuple(x[i : i + 5]) for i in range(len(x) - 4)})
    assert {(r, n) for r, n in zip(b.row.tolist(), b.level.tolist()) if n} == {(r, int(n)) for r, x in enumerate(texts) for n in t._levels(len(x.split()))}
    assert len(sets) > 300 and all(len(a) <= b.shingles[i] for i, a in enumerate(sets))
    for i in rng.integers(0, len(sets), 60):
        for j, other in enumerate(sets):
            assert np.bitwise_count(b.sketch[i] ^ b.sketch[j]).sum() <= len(sets[i] ^ other)


def test_letters_that_two_ways_of_reading_may_split_bound_nothing():
    (w,) = words_of(pa.array(["plain – “words”, café…", "É", "a\u0301 b", "3 × 4", "plain"]))
    assert t._odd(w).tolist() == [False, True, True, True, False]


def test_a_level_of_a_text_is_that_of_any_text_that_goes_on():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    _, b = beginnings([" ".join(words[:n]) for n in (60, 47, 20, 14, 13, 7, 4)])
    keys = {(r, n): b.keys[k].tolist() for k, (r, n) in enumerate(zip(b.row.tolist(), b.level.tolist()))}
    own = {r: n for r, n, own in zip(b.row.tolist(), b.level.tolist(), b.own) if own and n}
    assert own == {r: max(t._levels(n - 1).tolist()) for r, n in enumerate((60, 47, 20, 14))}
    assert all(keys[r, own[r]] == keys[0, own[r]] for r in own) and (6, 0) not in keys and (5, 0) in keys


def test_short_texts_are_met_by_all_they_have():
    texts = ["Alpha beta, gamma delta epsilon zet", "alpha BETA gamma delta epsilon (zeta) eta", "Alpha beta gamma delta epsilon zeta", "beta gamma delta epsilon zeta eta", "alpha beta gamma delta epsilonzeta"]
    (w,) = words_of(pa.array(texts))
    at, h = t._so_far(w, t._short_words(w))
    ends = [set(h[(at >= w.row_bytes[r]) & (at < w.row_bytes[r + 1])].tolist()) for r in range(len(texts))]
    last = [h[at == w.ends[w.row_words[r + 1] - 1] - 1].tolist() for r in range(len(texts))]
    assert last[0][0] in ends[1] & ends[2] and last[2][0] in ends[1] and last[0][0] not in ends[3] and last[4] == []


def test_levels_grow_by_a_quarter():
    n = t._levels(100_000)
    assert n[0] == t.FIRST_LEVEL and (n[1:] <= np.maximum(n[:-1] + 1, n[:-1] * t.LEVEL_STEP)).all() and len(t._levels(4)) == 0


@pytest.mark.parametrize("share", [0.12, 0.3, 0.5, 0.7, 0.9])
def test_copies_that_keep_a_share_of_their_words_are_aligned(spark, share):
    """A tenth to nine tenths are lost; of longer parts the first word is another one."""
    rng = np.random.default_rng(int(100 * share))
    words = np.array([f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)])
    rows = []
    for k in range(60):
        full = list(rng.choice(words, 100))
        part = full[: int(100 * share)]
        if len(part) >= 30:
            part[0] = "another"
        rows += [(f"full{k}", " ".join(full) + "."), (f"cut{k}", " ".join(part)[:-1])]
    got = {r["row_id"] for r in t.truncated(spark.createDataFrame(rows, "id string, body string"), "id", "body").filter("by = 'copy'").collect()}
    assert len(got) >= 54 and all(x.startswith("cut") for x in got)


def test_one_text_in_a_third_of_the_rows(spark, monkeypatch):
    """Reposts of one text, and one last word behind many texts, give the same rows by either way to join."""
    base = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    rows = [(f"again{k}", base) for k in range(300)] + [("full", base + " and so on.")] + [(f"other{k}", f"Number {k} is a thing of the") for k in range(300)]
    df = spark.createDataFrame(rows, "id string, body string")
    one = sorted(tuple(r) for r in t.truncated(df, "id", "body").collect())
    monkeypatch.setattr(t, "HOT_ROWS", 10)
    monkeypatch.setattr(t, "BROADCAST_PAIRS", 0)
    assert sorted(tuple(r) for r in t.truncated(df, "id", "body").collect()) == one
    assert sum(by == "copy" for _, by in one) == 300


def test_alignment():
    long = "Alpha beta gamma delta epsilon zeta eta theta iota kappa. One two three four five six seven eight nine ten, and more follows here now."
    assert t.aligned_end(long[: long.index("re now")], long) is True
    assert t.aligned_end(long[: long.index(" here")].replace(",", ""), long) is True
    assert t.aligned_end("something else entirely that is long enough", long) is None
    assert t.aligned_end("one two three four five six seven eight nine", "One two three four five six seven eight nine. Ten.") is False


def test_empty_long_and_repeated(spark):
    schema = "id string, body string"
    assert t.truncated(spark.createDataFrame([], schema), "id", "body").count() == 0
    long = "word and another word. " * 40_000 + "word and"
    df = spark.createDataFrame([("long", long), ("long", long)], schema)
    assert [r["row_id"] for r in t.truncated(df, "id", "body").collect()] == ["long"]


def test_kinds_of_endings():
    got = {x: t.closing_kind(x) for x in (".", "", " ...", "…", ".)", " :)", '."', "!…", "�", "?", ",")}
    assert [got[x] for x in (".", ".)", '."', "!…", "?")] == [t.STOPPED] * 5
    assert [got[x] for x in ("", " :)", ",")] == [t.OPEN] * 3 and got[" ..."] == got["…"] == t.MARKED and got["�"] == t.BROKEN


def test_bands_find_similar_texts():
    rng = np.random.default_rng(0)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    found = 0
    for _ in range(200):
        a = list(rng.choice(words, 100))
        _, b = beginnings([" ".join(a), " ".join(a[:92])])  # 88 of 96 shingles
        whole = b.keys[b.level == 0]
        found += bool((whole[0] == whole[1]).any())
    assert found >= 198
