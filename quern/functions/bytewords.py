"""Words of a column of texts, found and hashed with numpy over the column's UTF-8 bytes.

An Arrow string column holds all its texts in one buffer. Working on that buffer with
whole-array operations finds and hashes millions of words a second without making a
Python string of any; strings are only made of distinct words, where a caller asks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in chunks of about this many bytes, to bound memory.
CHUNK_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) <= n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_ODD, _INVERSE)):
                p = np.full(n + 1, base, np.uint64)
                p[0] = 1
                _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of some rows: byte spans in ``data``, hashes without case, and where each row's begin."""

    first_row: int
    data: np.ndarray
    row_bytes: np.ndarray  # n rows + 1 offsets into data
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    row_words: np.ndarray  # n rows + 1 offsets into starts

    @property
    def rows(self) -> int:
        return len(self.row_bytes) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.row_words))

    def text(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offsets between them; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words: ASCII letters and digits, and all beyond ASCII but punctuation and blanks."""
    inside = _WORD[data]
    wide = np.flatnonzero(data >= 0xC2)
    if len(wide):
        two = wide[(data[wide] == 0xC2) & (wide + 1 < len(data))]
        two = two[data[two + 1] < 0xC0]  # C2 80 to C2 BF: signs, except ª µ º
        two = two[~np.isin(data[two + 1], (0xAA, 0xB5, 0xBA))]
        inside[two] = inside[two + 1] = False
        three = wide[(data[wide] == 0xE2) & (wide + 2 < len(data))]
        three = three[(data[three + 1] >= 0x80) & (data[three + 1] <= 0xAF)]  # U+2000 to U+2BFF: punctuation and symbols
        for k in range(3):
            inside[three + k] = False
        lost = wide[(data[wide] == 0xEF) & (wide + 2 < len(data))]
        lost = lost[(data[lost + 1] == 0xBF) & (data[lost + 2] == 0xBD)]  # the replacement character
        for k in range(3):
            inside[lost + k] = False
    return inside


def words_of(column: pa.Array, digits_alike: bool = False) -> Iterator[Words]:
    """The words of each chunk of rows, in order. ``digits_alike``: every digit hashes as 0."""
    data, offsets = text_bytes(column)
    n, row = len(offsets) - 1, 0
    table = _LOWER.copy()
    if digits_alike:
        table[48:58] = 48
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield _chunk(row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], table)
        row = stop


def _chunk(first_row: int, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    inside = word_bytes(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power, inverse = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((table[data].astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return Words(first_row, data, offsets, starts, ends, hashes, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by its first word; the last n - 1 places run past the end."""
    out = np.zeros(len(hashes), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(n, len(hashes))):
            out[: len(hashes) - k] = out[: len(hashes) - k] * _ODD + hashes[k:]
    return mix(out)


def gram_rows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of n words inside a row, number of such runs per row)."""
    counts = np.maximum(np.diff(words.row_words) - n + 1, 0)
    row_first = words.row_words[:-1]
    index = np.repeat(row_first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))
    return grams(words.hashes, n)[index], counts


def char_index(data: np.ndarray) -> np.ndarray:
    """For each byte place, the number of characters that begin before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def _fold_table() -> np.ndarray:
    """For each pair of bytes of a Latin letter with a mark, its two plain letters (0: none), by lead byte and second byte."""
    table = np.zeros((4, 64, 2), np.uint8)
    # Letters that don't decompose.
    whole = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ı": "i", "þ": "th", "ð": "d"}
    for lead in range(4):
        for second in range(64):
            c = bytes([0xC2 + lead, 0x80 + second]).decode()
            base = whole.get(c.lower()) or unicodedata.normalize("NFD", c.lower()).encode("ascii", "ignore").decode()
            if c.isalpha() and base.isalpha():
                table[lead, second, : len(base)] = list(base.encode())
    return table


_FOLD = _fold_table()


def without_accents(column: pa.Array) -> pa.Array:
    """The texts with Latin letters made plain (ß as ss), combining marks dropped; nulls become empty."""
    data, offsets = text_bytes(column)
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC5))
    lead = lead[lead + 1 < len(data)]
    plain = _FOLD[data[lead] - 0xC2, data[lead + 1] & 63]
    some = plain[:, 0] > 0
    out, keep = data.copy(), np.ones(len(data), bool)
    out[lead[some]] = plain[some, 0]
    out[lead[some] + 1] = plain[some, 1]
    keep[lead[some & (plain[:, 1] == 0)] + 1] = False
    marks = np.flatnonzero((data == 0xCC) | (data == 0xCD))
    marks = marks[marks + 1 < len(data)]
    keep[marks] = keep[marks + 1] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(kept[offsets].astype(np.int64)), pa.py_buffer(out[keep]))
