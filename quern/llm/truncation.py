"""Texts that lost their end.

Two sources of evidence. A near-copy that goes on where a text stops: a text that lost much
of its length is like the beginning of the longer one, not like the whole of it. So min-hash
bands are taken over beginnings of stated numbers of words, of the text as far as it goes and
of every longer text at all of these numbers, and over whole texts. Each text meets every
longer one of its buckets that has the shorter one's last whole words, about where it ends,
and pairs are aligned there: the longer one up to there must be a near-copy. Beginnings of up to eight shingles are only near-copies if they
are equal, so for these the bucket is the hash of the text itself, met where a longer one has
the same words so far, and what follows there is counted instead of pairs. For texts without
such a copy, the closing words: how often, over all texts, the same last words stand at the
end of a sentence, go on, or close a text. Words that close texts again and again are a remark
and no cut; of a last word behind the end of a sentence, what counts is how often sentences
begin with its letters and go on, as there the words before it never do.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.bytewords import _LOWER, Words, _powers, gram_rows, grams, mix, words_of
from quern.operators.bitmap import bitmap, member
from quern.staging import stage
from quern.tables import spread

SHINGLE, SIMILARITY = 5, 0.8
#: Nine bands of three for whole texts: a pair of similarity 0.8 meets with probability 0.998; four for beginnings: 0.943, and 0.995 from 0.9 on.
BANDS, LEVEL_BANDS, ROWS = 9, 4, 3
#: Numbers of words at which beginnings are compared: the first, with nine shingles, and how much more each next one has.
FIRST_LEVEL, LEVEL_STEP = SHINGLE + 8, 1.25
#: Lengths of the closing word runs; a run must be seen this often to decide, and the longest that is decides.
LENGTHS, LEAST = (1, 2, 3, 4, 6, 8), 4
ORDERS = len(LENGTHS)
TERMINAL = 0.5
#: A run that closes texts at least this often, and in this share of the places of the words before its last, is a closing remark.
CLOSER_COUNT, CLOSER_SHARE = 2, 0.2
#: A text of so few words whose last words are unknown is a headline unless they go on elsewhere.
HEADLINE_WORDS = 5
#: Pairs up to this number are broadcast to fetch their texts (16 bytes each); more are joined by shuffle.
BROADCAST_PAIRS = 1 << 20
#: Closing runs of more texts than this, and than one text in ``HOT_SHARE``, get their counts by a broadcast of at most ``HOT_SHARE`` x 8 rows.
HOT_ROWS, HOT_SHARE = 4096, 1 << 13
#: A bucket of more texts is met in blocks of about this many, each a task's key of its own.
BLOCK = 4096

#: Allows any difference: of a text whose words the profile may take apart otherwise than ``aligned_end``.
ANY_ROOM = 1 << 24

_rng = np.random.default_rng(20)
_A, _B = (_rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) for _ in range(2))
_A |= np.uint32(1)
_BEGIN, _STEP = np.uint64(0x5BF03635F0A31E4D), np.uint64(0x9E3779B97F4A7C15)

STOPPED, OPEN, MARKED, BROKEN = 0, 1, 2, 3
_STOP, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".!?")] = _CLOSE[list(b")]")] = True


def closing_kind(trail: str) -> int:
    """What stands behind the last word: a stop, nothing that ends a sentence, a cut mark or a broken character."""
    if "�" in trail:
        return BROKEN
    t = re.sub(r"[\s\"'”’»)\]]+$", "", trail)
    mark = re.search(r"(\.\.+|…)$", t)
    if mark:
        return STOPPED if re.search(r"[.!?]", t[: mark.start()]) else MARKED
    return STOPPED if re.search(r"[.!?。！？]", trail) else OPEN


def _ends(w: Words, rows: np.ndarray) -> np.ndarray:
    """What stands behind the last word of each of some rows that have one; the plain cases without making strings."""
    out = np.zeros(len(rows), np.int32)
    lo, hi = w.ends[w.row_words[rows + 1] - 1], w.row_bytes[rows + 1]
    if not len(rows):
        return out
    one = (hi - lo == 1) & _STOP[w.data[np.maximum(hi, 1) - 1]]
    out[hi == lo] = OPEN
    for i in np.flatnonzero((hi > lo) & ~one).tolist():
        out[i] = closing_kind(w.data[lo[i] : hi[i]].tobytes().decode("utf-8", "replace"))
    return out


def _gap_classes(w: Words) -> np.ndarray:
    """Of each word: 1 it ends a sentence, 2 another word follows in it, 4 it ends the text without a stop, 8 before a cut mark, 0 none."""
    n = len(w.starts)
    out = np.zeros(n, np.int8)
    if not n:
        return out
    stop = _STOP[w.data]
    dots = np.flatnonzero(w.data == 0xE2)
    dots = dots[dots + 2 < len(w.data)]
    stop[dots[(w.data[dots + 1] == 0x80) & (w.data[dots + 2] == 0xA6)]] = True
    stops, closes = (np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (stop, _CLOSE[w.data]))
    row_end = np.repeat(w.row_bytes[1:], np.diff(w.row_words))
    last = np.zeros(n, bool)
    filled = np.flatnonzero(np.diff(w.row_words) > 0)
    last[w.row_words[filled + 1] - 1] = True
    to = np.where(last, row_end, np.concatenate([w.starts[1:], [0]]))
    stopped = (stops[to] > stops[w.ends]) & (last | (to - w.ends > 1))
    closed = closes[to] > closes[w.ends]
    out[:] = np.where(stopped, 1, np.where(last, 4, np.where(closed, 0, 2)))
    some = np.flatnonzero(last & stopped)
    out[some[_ends(w, w.row_of()[some]) != STOPPED]] = 8  # a cut mark isn't a stop
    return out


def _line(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes with signs for the beginning before each text, and each word's place in that line."""
    pad = LENGTHS[-1]
    place = np.arange(len(w.starts)) + pad * (w.row_of() + 1)
    line = np.full(len(w.starts) + pad * w.rows, _BEGIN, np.uint64)
    line[place] = w.hashes
    return line, place


def _runs(line: np.ndarray, place: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of LENGTHS, (hashes of the runs of words that end at ``place``, which of the places they are).

    With ``wanted`` a place whose run isn't wanted is left out of the longer ones, as a
    run is only wanted together with its shorter ends.
    """
    at, h = np.arange(len(place)), np.zeros(len(place), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(LENGTHS[-1]):
            h = h * _STEP + line[place[at] - k]
            if k + 1 in LENGTHS:
                out = mix(h + np.uint64(k))
                if wanted is not None:
                    ok = wanted(out)
                    at, h, out = at[ok], h[ok], out[ok]
                yield out, at


def _so_far(w: Words, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash of all words of its text up to there) of each byte in the words that are ``wanted``."""
    n = np.where(_number(w) < FIRST_LEVEL, w.ends - w.starts, 0)  # no words beyond are wanted
    word = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(w.starts, n)
    power, inverse = _powers(len(word))
    with np.errstate(over="ignore"):
        sums = np.cumsum((_LOWER[w.data[at]].astype(np.uint64) + np.where(at == w.starts[word], np.uint64(257), np.uint64(1))) * power[: len(word)])
        first = np.concatenate([[0], np.cumsum(n)])[w.row_words[:-1]]  # of each row the first of these bytes
        before = np.where(first > 0, sums[np.maximum(first, 1) - 1], np.uint64(0)) if len(sums) else np.zeros(w.rows, np.uint64)
        some = np.flatnonzero(wanted[word])
        row = w.row_of()[word[some]]
        return at[some], mix((sums[some] - before[row]) * inverse[first[row]] + (some - first[row]).astype(np.uint64))


def _begun(w: Words, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash of the word's letters up to there, digits alike) of each byte of some words."""
    n = (w.ends - w.starts)[words]
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(first - w.starts[words], n)
    power, inverse = _powers(len(at))
    letters = np.where((w.data[at] >= 48) & (w.data[at] < 58), np.uint8(48), _LOWER[w.data[at]]).astype(np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((letters + np.uint64(1)) * power[: len(at)])])
        first = np.repeat(first, n)
        return at, mix(_BEGIN ^ mix((sums[1:] - sums[first]) * inverse[first] + (np.arange(len(at)) - first + 1).astype(np.uint64)))


def _first_words(w: Words, classes: np.ndarray) -> np.ndarray:
    """The words behind the end of a sentence or bracket, where none before them goes on; not the first of a text."""
    behind = np.concatenate([[2], classes[:-1]]) != 2
    return np.flatnonzero(behind[: len(classes)] & (_number(w) > 0))


def _number(w: Words) -> np.ndarray:
    """The number of words before each in its text."""
    return np.arange(len(w.starts)) - np.repeat(w.row_words[:-1], np.diff(w.row_words))


def _short_words(w: Words) -> np.ndarray:
    """Which words may be the last, whole or cut, of a text that is met by the hash of all it has."""
    no = _number(w)
    return (no >= SHINGLE) & (no < FIRST_LEVEL)


def _levels(most: int) -> np.ndarray:
    """The numbers of words of the beginnings of a text of ``most`` words."""
    out, n = [], FIRST_LEVEL
    while n <= most:
        out.append(n)
        n = max(n + 1, int(n * LEVEL_STEP))
    return np.array(out, np.int64)


# Bytes of texts whose words are the same to the profile and to ``aligned_end``: ASCII and the two bytes of small Latin letters; dashes, quotes and dots are told apart.
_PLAIN = np.zeros(256, bool)
_PLAIN[:128] = True


def _odd(w: Words) -> np.ndarray:
    """Which rows hold letters for which the two ways to find words may differ, so that their sketch bounds nothing."""
    odd = ~_PLAIN[w.data]
    for lead, low, high, width in ((0xC3, 0x9F, 0xBF, 2), (0xE2, 0x90, 0xA6, 3)):
        at = np.flatnonzero(w.data == lead)
        at = at[at + width - 1 < len(w.data)]
        last = w.data[at + width - 1]
        at = at[(last >= low) & (last <= high) & ((last != 0xB7) if width == 2 else (w.data[at + 1] == 0x80))]
        for k in range(width):
            odd[at + k] = False
    seen = np.concatenate([[0], np.cumsum(odd)])
    return np.diff(seen[w.row_bytes]) > 0


class Beginnings:
    """Buckets and sketches of every beginning of every text of five words or more, and of its whole.

    One entry per text and level, then one per text as a whole: ``row``, ``level`` (its
    number of words, 0 for the whole), ``own`` (whether it is one of a shorter copy: the
    whole, and the last level without the last word), ``keys`` (x BANDS, of a level only
    ``LEVEL_BANDS`` live), and ``sketch`` (x 2), 128 bits of
    which each tells whether an odd number of the distinct shingles falls on it; two sketches
    differ in at most as many bits as the sets of shingles in elements. All minima and sums
    of a level are those of the one before and of the words between.
    """

    def __init__(self, w: Words):
        self.words = w
        shingles, counts = gram_rows(w, SHINGLE)
        n_words = np.diff(w.row_words)
        some = np.flatnonzero(counts)
        self.levels = levels = _levels(int(n_words.max()) if w.rows else 0)
        per_row = np.searchsorted(levels, n_words[some], "right")
        last = np.where(per_row > 0, levels[per_row - 1] if len(levels) else 0, 0)
        parts = per_row + (last < n_words[some])  # the words behind the last level are a part of their own
        base = np.cumsum(parts) - parts
        at = np.arange(int(parts.sum())) - np.repeat(base, parts)
        begin = np.concatenate([[0], levels])[at] - np.where(at > 0, SHINGLE - 1, 0) if len(at) else at
        first = np.repeat((np.cumsum(counts) - counts)[some], parts) + begin
        deepest = int(parts.max()) if len(parts) else 0

        def upto(x: np.ndarray, join) -> np.ndarray:
            """Values of parts joined over all parts of a text up to each."""
            for k in range(1, deepest):
                i = base[parts > k] + k
                x[i] = join(x[i], x[i - 1])
            return x

        size, whole = len(first), base + parts - 1
        prefix = np.flatnonzero(at < np.repeat(per_row, parts))
        self.row = np.concatenate([np.repeat(some, parts)[prefix], some])
        self.level = np.concatenate([levels[at[prefix]] if len(prefix) else prefix, np.zeros(len(some), np.int64)])
        pick = np.concatenate([prefix, whole])
        self.own = np.concatenate([at[prefix] == (np.searchsorted(levels, n_words[self.row[: len(prefix)]] - 1, "right") - 1), np.ones(len(some), bool)])
        self.shingles = np.where(self.level > 0, self.level, n_words[self.row]) - SHINGLE + 1
        self.live = (np.arange(BANDS) < LEVEL_BANDS) | (self.level == 0)[:, None]
        self.keys, self.sketch = np.zeros((len(pick), BANDS), np.uint64), np.zeros((len(pick), 2), np.uint64)
        if not size:
            return
        halves = (shingles >> np.uint64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            begins = first[base]
            for b in range(BANDS):
                some_keys = slice(0 if b < LEVEL_BANDS else len(prefix), None)
                key = mix(self.level[some_keys].astype(np.uint64) * np.uint64(BANDS) + np.uint64(b + 1))
                for r in range(ROWS):
                    k = b * ROWS + r
                    halved = halves * _A[k] + _B[k]
                    least = upto(np.minimum.reduceat(halved, first), np.minimum)[pick] if b < LEVEL_BANDS else np.minimum.reduceat(halved, begins)
                    key = mix(key * _STEP + least.astype(np.uint64))
                self.keys[some_keys, b] = key
        row = np.repeat(np.arange(len(some), dtype=np.uint64), counts[some])  # rows of five words or more in a chunk: under 2^20
        keys = (row << np.uint64(44)) | (shingles >> np.uint64(20))
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[order[1:]] = keys[order[1:]] != keys[order[:-1]]  # the first place of each distinct shingle of a text
        bit, half = np.uint64(1) << (keys & np.uint64(63)), (keys >> np.uint64(6)) & np.uint64(1)
        for k in range(2):
            self.sketch[:, k] = upto(np.bitwise_xor.reduceat(np.where(new & (half == k), bit, np.uint64(0)), first), np.bitwise_xor)[pick]

    def leads(self) -> np.ndarray:
        """Of each word the hash of the ``SHINGLE`` - 1 words before it and its first letter; those of the first words of a text mean nothing."""
        w = self.words
        out = np.zeros(len(w.starts), np.uint64)
        lead = grams(w.hashes, SHINGLE - 1)[: max(0, len(out) - SHINGLE + 1)]
        with np.errstate(over="ignore"):
            out[SHINGLE - 1 :] = mix(lead * _STEP + _LOWER[w.data[w.starts[SHINGLE - 1 :]]])
        return out


_PROFILE = "row_id string, text_key long, n_words int, kind int, runs array<long>, n_bytes int, lead long, bands array<long>, ends array<long>, levels array<int>, rooms array<int>, s0 array<long>, s1 array<long>"


def _own_buckets(column: pa.Array) -> list[tuple[np.ndarray, ...]]:
    """Of each text as a shorter copy: (lead, number of ends, bands, ends, number of entries, levels, rooms, sketches, begun) by chunks of texts.

    ``begun`` is the hash of the letters of its last word if that is one of ``_first_words``, else 0.
    A text's level, if it has one, comes before its whole, so its first ``LEVEL_BANDS`` ends are of that.
    """
    out = []
    for w in words_of(column, digits_alike=True):
        b = Beginnings(w)
        lead = b.leads()[np.maximum(w.row_words[1:] - 1, 0)] if len(w.starts) else np.zeros(w.rows, np.uint64)
        mine = np.flatnonzero(b.own)
        mine = mine[np.argsort(b.row[mine], kind="stable")]
        entry, band = np.nonzero(b.live[mine])
        entry = mine[entry]
        rooms = np.where(_odd(w)[b.row[mine]], ANY_ROOM, b.shingles[mine])
        n_entries, n_ends = (np.bincount(b.row[x], minlength=w.rows) for x in (mine, entry))
        begun, row_of, firsts = np.zeros(w.rows, np.uint64), w.row_of(), _first_words(w, _gap_classes(w))
        firsts = firsts[firsts == w.row_words[row_of[firsts] + 1] - 1]
        at, so_far = _begun(w, firsts)
        begun[row_of[firsts]] = so_far[np.isin(at, w.ends[firsts] - 1)]
        out.append((lead, n_ends, b.keys[entry, band], mix(b.keys[entry, band] ^ lead[b.row[entry]]), n_entries, b.level[mine], rooms, b.sketch[mine], begun))
    return out


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each (id, key, text) without a stop: what stands at its end, its closing runs, 0 for one that it lacks, and its buckets as a shorter copy."""
    names = ["row_id", "text_key", "n_words", "kind", "runs", "n_bytes", "lead", "bands", "ends", "levels", "rooms", "s0", "s1"]

    def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))

    for batch in batches:
        for w in words_of(batch.column(2), digits_alike=True):
            n_words = np.diff(w.row_words)
            last = w.row_words[1:] - 1
            kinds = np.zeros(w.rows, np.int32)
            kinds[n_words > 0] = _ends(w, np.flatnonzero(n_words))
            open_rows = np.flatnonzero(kinds)
            tails = np.zeros((len(open_rows), ORDERS + 4), np.uint64)
            line, place = _line(w)
            ends = place[last[open_rows]]
            for m, (run, _) in enumerate(_runs(line, ends)):
                tails[:, m] = run
            for m, (run, _) in zip((0, 1), _runs(line, ends - 1)):
                tails[:, ORDERS + m] = run
            short = np.zeros(len(w.starts), bool)
            short[last[open_rows]] = True
            at, so_far = _so_far(w, short & _short_words(w))
            is_end = np.isin(at, w.ends[last[open_rows]] - 1)
            has = np.isin(w.ends[last[open_rows]] - 1, at[is_end])
            tails[has, ORDERS + 2] = so_far[is_end]
            own = _own_buckets(batch.column(2).slice(w.first_row, w.rows).take(pa.array(open_rows)))
            if not own:
                continue
            lead, n_ends, bands, ends, n_entries, levels, rooms, sketch, tails[:, ORDERS + 3] = (np.concatenate(x) for x in zip(*own))
            ids, keys = (batch.column(k).slice(w.first_row, w.rows).take(pa.array(open_rows)) for k in (0, 1))
            columns = [ids.cast(pa.string()), keys, pa.array(n_words[open_rows].astype(np.int32)), pa.array(kinds[open_rows])]
            long = lambda x: np.ascontiguousarray(x).view(np.int64)
            columns += [lists(long(tails).ravel(), np.full(len(tails), ORDERS + 4)), pa.array(np.diff(w.row_bytes)[open_rows].astype(np.int32)), pa.array(long(lead)), lists(long(bands), n_ends), lists(long(ends), n_ends)]
            columns += [lists(x.astype(np.int32), n_entries) for x in (levels, rooms)] + [lists(long(sketch[:, k]), n_entries) for k in range(2)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


_KINDS = ("stops", "goes_on", "closes", "marked")


def _counter(bits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of how the wanted word runs end, over all texts of a partition."""

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code, keys = pd.factorize(np.concatenate([p[0] for p in parts]))
        counts = np.concatenate([p[1] for p in parts])
        return keys, np.stack([np.bincount(code, counts[:, k], len(keys)) for k in range(4)], axis=1).astype(np.int64)

    def batch_of(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *[pa.array(np.ascontiguousarray(counts[:, k])) for k in range(4)]], names=["run", *_KINDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for w in words_of(batch.column(0), digits_alike=True):
                kinds = _gap_classes(w)
                some = np.flatnonzero(kinds)
                ways = np.log2(kinds[some]).astype(np.int64)
                line, place = _line(w)
                found = [(hashes, ways[at]) for hashes, at in _runs(line, place[some], lambda h: member(bits.value, h))]
                for at, so_far in (_so_far(w, _short_words(w)), _begun(w, _first_words(w, kinds))):
                    ok = np.flatnonzero(member(bits.value, so_far)) if len(so_far) else at
                    word = np.searchsorted(w.starts, at[ok], "right") - 1
                    way = np.where(at[ok] + 1 < w.ends[word], 2, kinds[word])  # inside a word the text goes on
                    found.append((so_far[ok][way > 0], np.log2(way[way > 0]).astype(np.int64)))
                for hashes, way in found:
                    code, keys = pd.factorize(hashes)
                    parts.append((keys, np.bincount(code * 4 + way, minlength=4 * len(keys)).reshape(-1, 4)))
            if sum(len(p[0]) for p in parts) > 1 << 20:
                parts = [merge(parts)]
                if len(parts[0][0]) > 1 << 19:
                    yield batch_of(*parts.pop())
        if parts:
            yield batch_of(*merge(parts))

    return run


def _verdict(kind: Column, n_words: Column, count: Callable[[str, int], Column]) -> Column:
    """Whether a text without a stop is cut.

    ``count(c, m)`` is count c of run m: the LENGTHS, those of 1 and 2 words before the last,
    the text as a whole if it is short, and the last word's letters if it is one of ``_first_words``.
    """

    def remark(m: int, least: Column) -> Column:
        plain, marked = ((count(c, m) >= CLOSER_COUNT) & (count(c, m) > count("goes_on", m)) & (count(c, m) >= least) for c in ("closes", "marked"))
        return F.when(kind == MARKED, marked & (count("marked", m) > count("stops", m))).otherwise(plain)

    first = count("closes", ORDERS + 3) + count("marked", ORDERS + 3) > 0  # the text's own end is counted
    runs = [remark(m, CLOSER_SHARE * count("goes_on", ORDERS + m - 1)) for m in (1, 2)]  # of two and three words, after one and two
    closer = F.when(first, remark(ORDERS + 3, F.lit(0))).otherwise(runs[0] | runs[1])
    unknown = (n_words > HEADLINE_WORDS) | (count("goes_on", ORDERS + 1) >= LEAST)
    words = unknown
    for m in range(ORDERS):
        seen = count("stops", m) + count("goes_on", m)
        words = F.when(seen >= LEAST, count("stops", m) < TERMINAL * seen).otherwise(words)
    return F.when(kind == BROKEN, True).when(closer, False).when(kind == MARKED, True).otherwise(words)


_WORDS = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1 << 10)
def _words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def aligned_end(short: str, long: str) -> bool | None:
    """Whether the longer copy goes on where the shorter one stops; None if it isn't a copy.

    The longer text up to the place of the shorter one's end, or as a whole, must have
    similarity ``SIMILARITY`` with the shorter one; its last word, that may be cut, is left
    out. Of several places with the same last words the one of like length counts.
    """
    aw, low = _words(short), long.lower()
    if len(aw) < SHINGLE or not all(word in low for word in aw[-SHINGLE:-1]):
        return None
    b = list(_WORDS.finditer(low))
    bw = [m.group() for m in b]
    shingles = lambda w: {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}
    near = lambda x, y: bool(x and y) and len(x & y) >= SIMILARITY * len(x | y)
    lead = aw[-SHINGLE:-1]
    places = [i for i in range(len(bw) - len(lead)) if bw[i : i + len(lead)] == lead]
    if not places:
        return None
    at = min(places, key=lambda i: abs(i + len(lead) - (len(aw) - 1))) + len(lead)
    if not near(shingles(aw), shingles(bw)) and not near(shingles(aw[:-1]), shingles(bw[:at])):
        return None
    if bw[at] != aw[-1]:
        return True if bw[at].startswith(aw[-1]) else None
    if at + 1 == len(bw):
        return None
    return not re.search(r"[.!?…]", long[b[at].end() : b[at + 1].start()])


_ENTRY = "text_key long, n_bytes int, bucket long, level int, room int, s0 long, s1 long"
_ENTRY_NAMES = [x.split()[0] for x in _ENTRY.split(", ")]


def _shorts(buckets) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row per bucket of a shorter text, from its (text_key, n_bytes, ends, levels, rooms, s0, s1), that the bitmap may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_ends, n_entries = (batch.column(k).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            ends = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            ok = np.flatnonzero(member(buckets.value, ends)) if len(ends) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(n_ends)), n_ends)[ok]
            no = ok - (np.cumsum(n_ends) - n_ends)[row]
            entry = pa.array((np.cumsum(n_entries) - n_entries)[row] + ((n_entries[row] > 1) & (no >= LEVEL_BANDS)))
            columns = [batch.column(k).take(pa.array(row)) for k in (0, 1)] + [pa.array(ends[ok])] + [batch.column(k).flatten().take(entry) for k in (3, 4, 5, 6)]
            yield pa.RecordBatch.from_arrays(columns, names=_ENTRY_NAMES)

    return run


def _longs(leads, bands, ends, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each (text_key, text) a row per bucket and end of some shorter text that the bitmaps may hold; equal texts of a batch count once.

    A text is in a bucket by every place with some text's last whole words where a near-copy
    of that level may end: up to there it has between four fifths and five fourths of the
    shingles of the other. Where a text without a stop ends itself, its own buckets matter
    only if they are ``shared`` with another such text, which may be cut earlier in the word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, once = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
            batch = batch.take(pa.array(np.sort(once)))
            for w in words_of(batch.column(1), digits_alike=True):
                b = Beginnings(w)
                lead, last = b.leads(), w.row_words[1:] - 1
                entry, band = np.nonzero(b.live)
                known = np.flatnonzero(member(bands.value, b.keys[entry, band])) if len(entry) else entry
                entry, band = entry[known], band[known]
                row, level = b.row[entry], b.level[entry]
                # words before the place: of a level of L words the shorter text has L to 5/4 L without its last
                lo = np.where(level > 0, np.ceil((level - SHINGLE + 1) * SIMILARITY).astype(np.int64), 0) + SHINGLE - 1
                hi = np.where(level > 0, ((level + 1) * LEVEL_STEP - SHINGLE + 1) // SIMILARITY, len(w.starts)).astype(np.int64) + SHINGLE - 1
                known = np.flatnonzero(member(leads.value, lead)) if len(lead) else np.zeros(0, np.int64)
                a = np.searchsorted(known, w.row_words[row] + lo)
                n = np.maximum(np.searchsorted(known, np.minimum(w.row_words[row] + hi, last[row]), "right") - a, 0)
                at = known[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - a, n)] if n.sum() else np.zeros(0, np.int64)
                which = np.repeat(np.arange(len(entry)), n)
                bucket = mix(b.keys[entry, band][which] ^ lead[at])
                ok = np.flatnonzero(member(ends.value, bucket)) if len(bucket) else which
                at_end = np.flatnonzero(at[ok] == last[row[which[ok]]])
                if len(at_end):
                    asked, back = np.unique(row[which[ok[at_end]]], return_inverse=True)
                    alone = (_ends(w, asked) != STOPPED)[back] & b.own[entry[which[ok[at_end]]]] & ~member(shared.value, bucket[ok[at_end]])
                    ok = np.delete(ok, at_end[alone])
                e = entry[which[ok]]
                columns = [
                    batch.column(0).slice(w.first_row, w.rows).take(pa.array(b.row[e])), pa.array(np.diff(w.row_bytes).astype(np.int32)[b.row[e]]), pa.array(bucket[ok].view(np.int64)),
                    pa.array(b.level[e].astype(np.int32)), pa.array(np.where(_odd(w)[b.row[e]], ANY_ROOM, b.shingles[e]).astype(np.int32)), *[pa.array(b.sketch[e, k].view(np.int64)) for k in range(2)],
                ]
                yield pa.RecordBatch.from_arrays(columns, names=_ENTRY_NAMES)

    return run


def _copies(profile: DataFrame, rows: DataFrame) -> DataFrame:
    """(text_key, goes_on) for texts without a stop whose end aligns with a longer near-copy.

    Only buckets that hold such a text matter, so entries are sifted by the bitmaps of these
    and of their ends. There each open text meets every longer one; exact copies count once,
    and a bucket of more than ``BLOCK`` rows is met in blocks, so no task has more than the
    open texts of a bucket against one block. Whole texts of similarity s differ in at most
    (1 - s) / (1 + s) of the shingles of both; beginnings of texts that do so up to the end
    of the shorter one differ in at most 2.6 times that, as words put in before the level
    shift as many shingles over it and the level has four fifths of the words. A pair whose
    sketches differ in more bits is dropped before its texts are fetched, which loses none.
    """
    texts = rows.select("text_key", "text").filter(F.col("text").isNotNull())
    leads, bands = bitmap(profile.filter(F.size("bands") > 0), "lead"), bitmap(profile.select(F.explode("bands").alias("bucket")), "bucket")
    ends = profile.select("text_key", F.explode("ends").alias("bucket"))
    shared = ends.groupBy("bucket").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).filter("a < b")
    longs = stage(texts.mapInArrow(_longs(leads, bands, bitmap(ends, "bucket"), bitmap(stage(shared.select("bucket"), "shared"), "bucket")), _ENTRY), "longs")
    hot = stage(longs.groupBy("bucket").count().filter(F.col("count") > BLOCK).select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot_buckets")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_PAIRS else hot
    shorts = profile.select("text_key", "n_bytes", "ends", "levels", "rooms", "s0", "s1").mapInArrow(_shorts(bitmap(longs, "bucket")), _ENTRY)
    blocks = lambda side: side.join(hot, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    sides = ["n_bytes", "room", "s0", "s1"]
    short = blocks(shorts).select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "text_key", "level", *sides)
    long = blocks(longs).select("bucket", F.pmod("text_key", "blocks").cast("int").alias("block"), F.col("text_key").alias("long_key"), *[F.col(c).alias(f"long_{c}") for c in sides])
    short, long = (side.repartition("bucket", "block").distinct() for side in (short, long))
    differ = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"long_{c}"))) for c in ("s0", "s1"))
    share = (1 - SIMILARITY) / (1 + SIMILARITY)
    near = differ <= (F.col("room") + F.col("long_room")) * F.when(F.col("level") == 0, F.lit(share)).otherwise(F.lit(2.6 * share)) + 1e-6
    pairs = short.join(long, ["bucket", "block"]).filter((F.col("n_bytes") < F.col("long_n_bytes")) & near).select("text_key", "long_key").distinct()
    pairs = stage(pairs, "pairs")
    keys = pairs.select(F.explode(F.array("text_key", "long_key")).alias("text_key")).distinct()
    few = pairs.count() <= BROADCAST_PAIRS
    found = rows.select("text_key", "text").join(F.broadcast(keys) if few else keys, "text_key", "left_semi")
    found = stage(found.groupBy("text_key").agg(F.min("text").alias("text")), "pair_texts")
    both = pairs.join(found, "text_key").join(found.select(F.col("text_key").alias("long_key"), F.col("text").alias("long_text")), "long_key")

    @F.pandas_udf("boolean")
    def align(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([aligned_end(x, y) for x, y in zip(a, b)], dtype=object)

    aligned = both.select("text_key", align("text", "long_text").alias("goes_on")).filter(F.col("goes_on").isNotNull())
    return aligned.groupBy("text_key").agg(F.max("goes_on").alias("goes_on"))


def _run_counts(tails: DataFrame, rows: DataFrame) -> DataFrame:
    """``tails`` (text_key, at, run) with how their runs end in all texts.

    A common last word closes many texts; runs of so many get their counts by a broadcast,
    and only the others by a shuffle on the run.
    """
    counts = rows.select("text").mapInArrow(_counter(bitmap(tails, "run")), "run long, " + ", ".join(f"{c} long" for c in _KINDS))
    counts = stage(counts.groupBy("run").agg(*[F.sum(c).alias(c) for c in _KINDS]), "counts")
    least = max(HOT_ROWS, tails.count() // (8 * HOT_SHARE))
    hot = stage(tails.groupBy("run").count().filter(F.col("count") > least).select("run"), "hot")
    known = F.broadcast(counts.join(F.broadcast(hot), "run"))
    rest = tails.join(F.broadcast(hot), "run", "left_anti").join(counts, "run")
    return rest.unionByName(tails.join(known, "run"))


def truncated(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """The rows whose text lost its end: (row_id STRING, by STRING), one per id.

    ``by`` is 'copy' where a longer near-copy goes on inside the sentence or word, else
    'closing'. Null and empty texts and null ids give no rows; of an id delivered
    several times any cut text counts. Ids come out as strings.
    """
    rows = spread(df.select(F.col(row_id).cast("string").alias("row_id"), F.col(text).alias("text")))
    rows = rows.select("row_id", F.xxhash64("text").alias("text_key"), "text")
    profile = stage(rows.filter(F.col("row_id").isNotNull()).mapInArrow(_profile, _PROFILE), "profile")
    once = profile.select("text_key", "kind", "n_words", "runs").dropDuplicates(["text_key"])
    tails = stage(once.select("text_key", "kind", "n_words", F.posexplode("runs").alias("at", "run")).filter("run != 0"), "tails")
    needed = [(c, m) for c in ("stops", "goes_on") for m in range(ORDERS)] + [(c, m) for c in ("closes", "marked") for m in (1, 2)]
    needed += [("goes_on", ORDERS), ("goes_on", ORDERS + 1), ("stops", ORDERS + 2), ("goes_on", ORDERS + 2)] + [(c, ORDERS + 3) for c in _KINDS]
    looked = (
        _run_counts(tails, rows)
        .groupBy("text_key", "kind", "n_words")
        .agg(*[F.max(F.when(F.col("at") == m, F.col(c))).alias(f"{c}{m}") for c, m in needed])
    )
    count = lambda c, m: F.coalesce(F.col(f"{c}{m}"), F.lit(0))
    equal = F.when(count("goes_on", ORDERS + 2) > 0, True).when(count("stops", ORDERS + 2) > 0, False)
    closing = looked.select("text_key", _verdict(F.col("kind"), F.col("n_words"), count).alias("cut"), equal.alias("equal"))
    both = closing.join(_copies(profile, rows), "text_key", "left").withColumn("goes_on", F.greatest("goes_on", "equal"))
    both = both.withColumn("by", F.when(F.col("goes_on").isNotNull(), "copy").otherwise("closing"))
    cut = stage(both.filter(F.coalesce("goes_on", "cut")).select("text_key", "by"), "cut")
    few = cut.count() <= BROADCAST_PAIRS
    # one text may be that of many rows: the table of cut texts is broadcast, or both sides are plain shuffles that adaptive execution splits
    found = profile.select("row_id", "text_key").join(F.broadcast(cut) if few else cut, "text_key")
    return found.groupBy("row_id").agg(F.max("by").alias("by"))


def source_rates(df: DataFrame, row_id: str, text: str, source: str) -> DataFrame:
    """Per source: n_rows, n_cut and share of its rows whose text lost its end; the null source is one of them."""
    cut = truncated(df, row_id, text).select(F.col("row_id").alias("_cut"))
    marked = df.select(F.col(source), F.col(row_id).cast("string").alias("_id")).distinct().join(cut, F.col("_id") == F.col("_cut"), "left")
    return marked.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("_cut").alias("n_cut"), F.round(F.count("_cut") / F.count(F.lit(1)), 6).alias("share")
    )
