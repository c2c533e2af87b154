"""The language of documents and of the segments of mixed ones.

The script of a word narrows its candidates: one that only one language here is written in
decides alone. Every word of a shared script has a score per language, from its letter
groups and its whole form in a table of fixed size that is fitted on a bounded sample of
labelled texts. A Viterbi path over the words, with a penalty for each switch that is
greater inside a sentence, labels spans of mixed texts. Segments are whole sentences, each
in the language of most of its words on the path; words in brackets or quotes don't speak.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.bytewords import Words, without_accents, words_of
from quern.tables import spread

LANGUAGES = ("en", "es", "fr", "de", "pt", "nl")
#: Labelled texts per language for the fit, chosen by a hash of their id, and the longest text among them.
SAMPLE, SAMPLE_CHARS = 400, 4000
#: Rows of the score table.
BUCKETS = 1 << 16
#: What a switch of language costs where a sentence begins, and inside one, in units of a word's score.
SWITCH, INSIDE = 4.0, 12.0
CLIP, WHOLE_WORD = 3.0, 2.0

# Names and codes of the languages as labels give them.
NAMES = {
    "en": "en eng english inglés ingles anglais englisch inglês engels",
    "es": "es spa esp spanish español espanol castellano espagnol spanisch espanhol spaans",
    "fr": "fr fra fre french français francais francés französisch francês frans",
    "de": "de deu ger german deutsch alemán allemand alemão duits",
    "pt": "pt por portuguese português portugues portugués portugais portugiesisch portugees",
    "nl": "nl nld dut dutch nederlands holandés néerlandais niederländisch holandês flemish vlaams",
}

# Scripts by range of letters, with the languages written in each; where a script has many, a code of the script stands for them.
SCRIPTS = [
    (0x0041, 0x024F, LANGUAGES), (0x0370, 0x03FF, ("el",)), (0x0400, 0x052F, ("und-Cyrl",)), (0x0530, 0x058F, ("hy",)), (0x0590, 0x05FF, ("he",)),
    (0x0600, 0x077F, ("und-Arab",)), (0x0900, 0x097F, ("und-Deva",)), (0x0E00, 0x0E7F, ("th",)), (0x10A0, 0x10FF, ("ka",)), (0x1E00, 0x1EFF, LANGUAGES),
    (0x1F00, 0x1FFF, ("el",)), (0x3040, 0x30FF, ("ja",)), (0x4E00, 0x9FFF, ("zh", "ja")), (0xAC00, 0xD7AF, ("ko",)),
]
NAMES |= {
    "el": "el ell gre greek", "und-Cyrl": "ru rus russian uk ukr ukrainian bg bul bulgarian sr srp serbian", "hy": "hy hye armenian", "he": "he heb hebrew",
    "und-Arab": "ar ara arabic fa fas persian ur urd urdu", "und-Deva": "hi hin hindi mr mar marathi ne nep nepali", "th": "th tha thai", "ka": "ka kat georgian",
    "ja": "ja jpn japanese", "zh": "zh zho chi chinese", "ko": "ko kor korean",
}
_CODES = {name: code for code, names in NAMES.items() for name in names.split()}
#: The states of a path: the languages of the fit, then those that a script decides.
STATES = (*LANGUAGES, *[code for code in NAMES if code not in LANGUAGES])
#: Scripts without blanks between words; so many letters count as a word.
UNSPACED, LETTERS_A_WORD = {"th", "ja", "zh"}, 2


def code_of(label: Column) -> Column:
    """The language a label names, whatever its notation; null if none of ``STATES``."""
    key = F.lower(F.regexp_replace(F.trim(label), r"[-_ ](?:[A-Za-z]{2}|[A-Za-z]{4}|\d{3})$", ""))
    table = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    return F.try_element_at(table, key)


def _plain(word: str) -> str:
    return unicodedata.normalize("NFD", word.lower()).encode("ascii", "ignore").decode() or word


def candidates(word: str) -> tuple[str, ...]:
    """The languages that the script of a word leaves."""
    for c in word:
        if c.isalpha():
            return next((langs for lo, hi, langs in SCRIPTS if lo <= ord(c) <= hi), ())
    return ()


def _groups(word: str) -> np.ndarray:
    """Table rows of a word's letter groups of one to four, its ends marked, and last of the whole word."""
    w = f"^{word}$".encode()
    keys = [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1) if w[i : i + n] not in (b"^", b"$")]
    return np.array([zlib.crc32(k) % BUCKETS for k in [*keys, b"#" + w]], np.int64)


class Scores:
    """The fitted table, with the word scores worked out so far."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.cache: dict[int, np.ndarray] = {}

    def word(self, word: str) -> np.ndarray:
        """Score of a word per language of the fit, 0 on average; all 0 for what isn't a word of them."""
        if candidates(word) != LANGUAGES:
            return np.zeros(len(LANGUAGES))
        rows = self.table[_groups(_plain(word))]
        v = rows[:-1].mean(axis=0) + WHOLE_WORD * rows[-1]
        return np.clip(v - v.mean(), -CLIP, CLIP)

    def state(self, word: str) -> np.ndarray:
        """Score of a word per state: what its script leaves, by the fit where that is several languages."""
        of = candidates(word)
        out = np.zeros(len(STATES))
        if of == LANGUAGES:
            out[: len(LANGUAGES)] = self.word(word)
            out[len(LANGUAGES) :] = -CLIP
        elif of:
            weight = max(1.0, len(word) / LETTERS_A_WORD) if UNSPACED & set(of) else 1.0
            for k, code in enumerate(of):  # of several the first, unless other letters speak for another
                out[STATES.index(code)] = CLIP * weight - 0.1 * k
        return out

    def words(self, w: Words) -> np.ndarray:
        """Scores of all words of a chunk per state, each distinct one worked out once."""
        code, keys = pd.factorize(w.hashes)
        first = np.zeros(len(keys), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        if len(self.cache) > 1 << 18:
            self.cache.clear()
        out = np.zeros((len(keys), len(STATES)))
        for k, key in enumerate(keys.tolist()):
            if (v := self.cache.get(key)) is None:
                v = self.cache[key] = self.state(w.text(int(first[k])))
            out[k] = v
        return out[code]


def _table(counts: list[Counter]) -> np.ndarray:
    """Log ratios of smoothed frequencies to their mean over the languages."""
    table = np.full((BUCKETS, len(LANGUAGES)), 0.5)
    for k, c in enumerate(counts):
        for word, n in c.items():
            np.add.at(table[:, k], _groups(word), n)
    table = np.log(table / table.sum(axis=0))
    return (table - table.mean(axis=1, keepdims=True)).astype(np.float32)


_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»)\]]*\s+|\n\s*\n")


def fit(texts: list[str], labels: list[str]) -> Scores:
    """Scores from labelled texts; some labels may be wrong and some texts mixed.

    The first fit takes the labels as they are; the second takes each sentence under the
    language that the first gives it. A language without texts scores like the rest.
    """
    words = [[[_plain(w) for w in re.findall(r"[^\W\d_]+", s)] for s in _SENTENCE.split(t)] for t in texts]
    counts = [Counter() for _ in LANGUAGES]
    for sentences, label in zip(words, labels):
        for s in sentences:
            counts[LANGUAGES.index(label)].update(s)
    first = Scores(_table(counts))
    seen: dict[str, np.ndarray] = {}
    counts = [Counter() for _ in LANGUAGES]
    for sentences in words:
        for s in sentences:
            total = sum((seen[w] if w in seen else seen.setdefault(w, first.word(w)) for w in s), np.zeros(len(LANGUAGES)))
            best = np.sort(total)
            if len(s) >= 3 and best[-1] - best[-2] >= 1:
                counts[int(total.argmax())].update(s)
    return Scores(_table(counts))


def path(score: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Viterbi over the words of padded texts (text, place, state): the best states; of equal ones that without a switch, then the first."""
    n, m, k = score.shape
    best, back = score[:, 0].copy(), np.zeros((m, n, k), np.int8)
    rows, same = np.arange(n), np.arange(k, dtype=np.int8)
    for i in range(1, m):
        top = best.argmax(axis=1)
        other = (best[rows, top] - np.where(begins[:, i], SWITCH, INSIDE))[:, None]
        switch = (other > best) & (i < lengths)[:, None]
        back[i] = np.where(switch, top[:, None], same)
        best = np.where(switch, other, best) + np.where((i < lengths)[:, None], score[:, i], 0)
    out = np.zeros((n, m), np.int8)
    out[:, -1] = best.argmax(axis=1)
    for i in range(m - 1, 0, -1):
        out[:, i - 1] = back[i][rows, out[:, i]]
    return out


def mixed(value: np.ndarray, row_words: np.ndarray, main: np.ndarray) -> np.ndarray:
    """Which texts' best path may leave the state ``main`` that has the greatest sum.

    A path that leaves it for m states side by side switches m - 1 times at least, m if it
    has the main state beside them. Where no run of words gives another state half a switch
    more than the main one, that can't pay; the bound is exact.
    """
    n = np.diff(row_words)
    out = np.zeros(len(n), bool)
    filled = np.flatnonzero(n)
    if not len(filled):
        return out
    row = np.repeat(np.arange(len(n)), n)
    base = value[np.arange(len(row)), main[row]]
    for k in range(value.shape[1]):
        gain = np.cumsum(value[:, k] - base)
        before = np.concatenate([[0.0], gain[:-1]])
        apart = 2 * np.abs(gain).max() + 1.0  # rows further on lie lower, so a least value is one of the same row
        least = np.minimum.accumulate(before - apart * row) + apart * row
        out[filled] |= np.maximum.reduceat(gain - least, row_words[filled]) > SWITCH / 2
    return out


def labels_of(w: Words, value: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The state of each word on its text's best path; texts of like length go together."""
    n = np.diff(w.row_words)
    total = np.zeros((w.rows, value.shape[1]))
    filled = np.flatnonzero(n)
    if len(filled):
        total[filled] = np.add.reduceat(value, w.row_words[filled], axis=0)
    main = total.argmax(axis=1)
    labels = np.repeat(main, n).astype(np.int8)
    order = np.flatnonzero(mixed(value, w.row_words, main))
    order = order[np.argsort(n[order], kind="stable")]
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and j - i < 512 and n[order[j]] * (j - i + 1) < 1 << 16:
            j += 1
        rows, m = order[i:j], int(n[order[j - 1]])
        at = w.row_words[rows][:, None] + np.arange(m)
        ok = np.arange(m) < n[rows][:, None]
        at = np.where(ok, at, 0)
        labels[at[ok]] = path(value[at], begins[at], n[rows])[ok]
        i = j
    return labels


def _flags(w: Words, signs: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(signs)] = True
    return table[w.data]


def _wide(w: Words, last: int) -> np.ndarray:
    """Where the sign E2 80 ``last`` begins."""
    at = np.flatnonzero(w.data == 0xE2)
    at = at[at + 2 < len(w.data)]
    out = np.zeros(len(w.data), bool)
    out[at[(w.data[at + 1] == 0x80) & (w.data[at + 2] == last)]] = True
    return out


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x, dtype=np.int64)])


def _full_stop(w: Words) -> np.ndarray:
    """Which words end with a full-width stop, as these signs count as letters of the word before."""
    out = np.zeros(len(w.starts), bool)
    for sign in "。！？":
        a, b, c = sign.encode()
        at = np.flatnonzero(w.ends - w.starts >= 3)
        end = w.ends[at]
        out[at] |= (w.data[end - 3] == a) & (w.data[end - 2] == b) & (w.data[end - 1] == c)
    return out


def sentences(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: whether a sentence begins with it, and whether it stands in brackets or quotes."""
    n = len(w.starts)
    begins, aside = np.zeros(n, bool), np.zeros(n, bool)
    if not n:
        return begins, aside
    stops = _sums(_flags(w, b".!?") | _wide(w, 0xA6))
    lines = _sums(_flags(w, b"\n"))
    blanks = _sums(_flags(w, b" \t\r\n"))
    gap_from, gap_to = np.concatenate([[0], w.ends[:-1]]), w.starts
    stopped = (stops[gap_to] > stops[gap_from]) & (blanks[gap_to] > blanks[gap_from])
    stopped[1:] |= _full_stop(w)[:-1]
    begins = stopped | (lines[gap_to] - lines[gap_from] > 1)
    begins[w.row_words[:-1][np.diff(w.row_words) > 0]] = True
    opened, closed = _sums(_flags(w, b"([") | _wide(w, 0x9C)), _sums(_flags(w, b")]") | _wide(w, 0x9D))
    row = w.row_of()
    base = w.row_bytes[:-1][row]
    balanced = (opened[w.row_bytes[1:]] - opened[w.row_bytes[:-1]]) == (closed[w.row_bytes[1:]] - closed[w.row_bytes[:-1]])
    aside = balanced[row] & (opened[w.starts] - opened[base] > closed[w.starts] - closed[base])
    return begins, aside


_SEGMENT = pa.schema(
    [("id", pa.int64()), ("seg_no", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_words", pa.int64()), ("label_lang", pa.string()), ("main_lang", pa.string()), ("n_segments", pa.int64())]
)
_SPAN = pa.schema([("id", pa.int64()), ("span_no", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])


class Labelled:
    """The words of a chunk with their scores, states on the path, and sentences."""

    def __init__(self, w: Words, scores: Scores):
        self.words = w
        self.begins, aside = sentences(w)
        row = w.row_of()
        # words aside don't speak, unless the text has no others
        self.heard = ~aside | (np.bincount(row[~aside], minlength=w.rows)[row] == 0)
        self.value = scores.words(w) * self.heard[:, None]
        self.labels = labels_of(w, self.value, self.begins)

    def told(self, lo: int, hi: int, state: int) -> tuple[str | None, float]:
        """(language, confidence) of some words: none where no word speaks for any."""
        total = self.value[lo:hi].sum(axis=0)
        if total.max() <= 0:
            return None, 0.0
        odds = np.exp((total - total.max()) / max(1.0, np.sqrt(hi - lo)))
        return STATES[state], float(odds[state] / odds.sum())


def _each(model, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Labelled]]:
    scores = Scores(model.value)
    for batch in batches:
        for w in words_of(without_accents(batch.column(1))):
            yield batch.slice(w.first_row, w.rows), Labelled(w, scores)


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _segmenter(model):
    """Segments of (id, text, label language), each with its text's main language and number of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _each(model, batches):
            ids, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            yield _as_batch([row for r, found in enumerate(_segments(x)) for row in _with_main(ids[r], labels[r], found)], _SEGMENT)

    return run


def _with_main(doc: int, label: str | None, found: list[tuple]) -> Iterator[tuple]:
    n_by = Counter()
    for _, lang, _, n in found:
        n_by[lang] += n if lang else 0
    main = max(STATES, key=lambda x: n_by[x])
    for f in found:
        yield doc, *f, label, main if n_by[main] else None, len(found)


def _segments(x: Labelled) -> Iterator[list[tuple[int, str | None, float, int]]]:
    """Of each row (seg_no, lang, confidence, n_words) of its runs of sentences in one language."""
    w = x.words
    first = np.flatnonzero(x.begins)
    ends = np.append(first, len(w.starts))
    counts = np.zeros((len(first), len(STATES)))
    np.add.at(counts, (np.repeat(np.arange(len(first)), np.diff(ends)), x.labels), x.heard + 1e-6)  # a sentence of words aside has their state
    state = counts.argmax(axis=1) if len(first) else first
    at = np.searchsorted(first, w.row_words)
    for r in range(w.rows):
        lo, hi = at[r], at[r + 1]
        if lo == hi:
            yield [(1, None, 0.0, 0)]
            continue
        cuts = lo + np.flatnonzero(np.diff(state[lo:hi])) + 1
        yield [(no, *x.told(ends[a], ends[b], state[a]), int(ends[b] - ends[a])) for no, (a, b) in enumerate(zip([lo, *cuts], [*cuts, hi]), 1)]


def _spanner(model):
    """Spans of (id, text): runs of words in one state of the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _each(model, batches):
            rows, w = [], x.words
            for r, doc in enumerate(batch.column(0).to_pylist()):
                lo, hi = int(w.row_words[r]), int(w.row_words[r + 1])
                cuts = [lo, *(lo + 1 + np.flatnonzero(np.diff(x.labels[lo:hi]))).tolist(), hi] if lo < hi else []
                rows += [(doc, no, *x.told(a, b, x.labels[a]), a - lo, b - a) for no, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]), 1)]
            yield _as_batch(rows, _SPAN)

    return run


def training_rows(df: DataFrame, doc_id: str, text: str, label: str) -> pd.DataFrame:
    """The bounded sample for the fit: at most ``SAMPLE`` texts per named language, by a hash of the id.

    One pass counts the languages, a second takes about twice the sample of each by the
    hash; of those the first by hash are kept.
    """
    named = df.select(F.col(text).alias("text"), code_of(F.col(label)).alias("lang"), F.xxhash64(doc_id).alias("h"))
    named = named.filter(F.col("lang").isin(*LANGUAGES) & F.char_length("text").between(1, SAMPLE_CHARS))
    taken = F.lit(False)
    for lang, n in named.groupBy("lang").count().collect():  # one row per language
        taken = taken | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1 << 30)) < int(min(1.0, 2 * SAMPLE / n) * (1 << 30))))
    rows = named.filter(taken).limit(8 * SAMPLE * len(LANGUAGES)).toPandas()
    return rows.sort_values(["h", "text"]).groupby("lang").head(SAMPLE)


def _fitted(df: DataFrame, doc_id: str, text: str, label: str):
    """Broadcast table of the fit on a sample of the labelled texts."""
    sample = training_rows(df, doc_id, text, label)
    return df.sparkSession.sparkContext.broadcast(fit(list(sample["text"]), list(sample["lang"])).table)


def segments(df: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """One row per segment: (doc_id, seg_no, lang, confidence, n_words, label_lang, main_lang, n_segments).

    A segment is the longest run of whole sentences in one language; seg_no counts from 1.
    ``lang`` is one of ``STATES``, null where no word speaks for a language, ``label_lang``
    null where the label names none; ``main_lang`` is the language of most words of the
    text. Null and empty texts and null ids give no rows. Ids are BIGINT; a row delivered
    again comes out again. Beside the sample for the fit this is one pass without a shuffle.
    """
    model = _fitted(df, doc_id, text, label)
    known = df.filter(F.col(doc_id).isNotNull() & (F.char_length(F.trim(text)) > 0))
    known = known.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"), code_of(F.col(label)).alias("l"))
    schema = "id long, seg_no long, lang string, confidence double, n_words long, label_lang string, main_lang string, n_segments long"
    return spread(known).mapInArrow(_segmenter(model), schema).withColumnRenamed("id", doc_id)


def spans(df: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """One row per span of words in one language, also inside sentences: (doc_id, span_no, lang, confidence, first_word, n_words).

    span_no counts from 1 and words from 0. Nulls, empty texts and repeated rows as in ``segments``.
    """
    model = _fitted(df, doc_id, text, label)
    known = df.filter(F.col(doc_id).isNotNull() & (F.char_length(F.trim(text)) > 0)).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    schema = "id long, span_no long, lang string, confidence double, first_word long, n_words long"
    return spread(known).mapInArrow(_spanner(model), schema).withColumnRenamed("id", doc_id)


def mislabelled(df: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """The segments of every document whose label is missing or wrong, or that has several: (doc_id, seg_no, lang)."""
    found = segments(df, doc_id, text, label)
    wrong = F.col("label_lang").isNull() | (F.col("label_lang") != F.col("main_lang")) | (F.col("n_segments") > 1)
    return found.filter(wrong & F.col("lang").isNotNull()).select(doc_id, "seg_no", "lang").distinct()
