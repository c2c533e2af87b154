"""Personal information in free text: found by a linear-chain CRF, replaced by placeholders.

Features are the forms and shapes of a token and its neighbours, the nearest words around
it, and the shape of the blank-delimited piece it stands in, each with the letter case of
the whole text. The model is trained on the labelled table of ``pii_labels``; its weights
are a table of fixed size, which bounds what is broadcast. Tokens are found and Viterbi is
run with numpy over whole batches of texts.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.bytewords import CHUNK_BYTES, _powers, char_index, mix, text_bytes, word_bytes
from quern.llm.pii_labels import GIVEN, KINDS, SURNAMES, labelled_table
from quern.tables import spread

LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
N = len(LABELS)
ROWS = 1 << 17
EPOCHS, BATCH, RATE, DECAY, DROPOUT = 10, 128, 0.05, 1e-4, 0.07
OFFSETS = (-3, -2, -1, 1, 2, 3)
_FORBIDDEN = -1e4

_LETTER, _DIGIT, _SIGN = 0, 1, 2


class Tokens:
    """Tokens of some texts: runs of letters, runs of digits, single signs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = word_bytes(data)
        digit = (data >= 48) & (data <= 57)
        blank = np.isin(data, np.frombuffer(b" \t\r\n\x0b\x0c", np.uint8))
        wide = np.flatnonzero((data == 0xC2) & np.append(data[1:] == 0xA0, False))
        blank[wide] = blank[np.minimum(wide + 1, len(data) - 1)] = True
        kind = np.where(blank, 9, np.where(digit, _DIGIT, np.where(inside, _LETTER, _SIGN))).astype(np.int8)
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        lead = (data & 0xC0) != 0x80
        new = np.ones(n, bool)
        if n:
            new[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == _SIGN) & lead[1:])
        new |= edge[:-1]
        self.starts = np.flatnonzero(new & (kind != 9))
        cut = np.append(np.flatnonzero(new), n)
        self.ends = cut[np.searchsorted(cut, self.starts, "right")] if len(self.starts) else self.starts
        self.kind = kind[self.starts]
        self.row_tokens = np.searchsorted(self.starts, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.row_tokens))
        upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
        count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
        n_upper, n_lower = count(upper), count(lower)
        self.case = np.where(n_upper == 0, 1, np.where(n_upper > n_lower, 2, 0))
        self._hash(upper, lower, digit, blank, edge)

    def _hash(self, upper: np.ndarray, lower: np.ndarray, digit: np.ndarray, blank: np.ndarray, edge: np.ndarray) -> None:
        data, n = self.data, len(self.data)
        power, inverse = _powers(n)

        def spans(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:n])])
                return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))

        same_digit = data.copy()
        same_digit[digit] = 48
        case = self.case[self.row].astype(np.uint64)
        with np.errstate(over="ignore"):
            self.forms = mix(spans(same_digit, self.starts, self.ends) + case)
        # the piece between blanks that each token stands in
        shape = data.copy()
        shape[digit], shape[upper], shape[lower] = 48, 65, 97
        filled = ~blank
        begin = np.flatnonzero(filled & (edge[:-1] | np.concatenate([[True], blank[:-1]]))) if n else np.zeros(0, np.int64)
        end = np.flatnonzero(filled & (edge[1:] | np.concatenate([blank[1:], [True]]))) + 1 if n else begin
        piece = np.searchsorted(begin, self.starts, "right") - 1
        self.pieces = spans(shape, begin, end)[piece] if len(begin) else np.zeros(0, np.uint64)
        self.piece_start, self.piece_end = begin[piece], end[piece]

    def text(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")

    def piece(self, i: int) -> str:
        return self.data[self.piece_start[i] : self.piece_end[i]].tobytes().decode("utf-8", "replace")


def _row(name: str) -> int:
    return 1 + zlib.crc32(name.encode()) % (ROWS - 1)


def shape_of(word: str) -> str:
    if word.isdigit():
        return f"9{min(len(word), 9)}"
    if not word[0].isalpha():
        return word
    return "A" if len(word) == 1 and word.isupper() else "AA" if word.isupper() else "Aa" if word[0].isupper() and word[1:].islower() else "a" if word.islower() else "aA"


# half of the names only, so that in the labelled table, as anywhere, many names are on no list
_GIVEN, _SURNAMES = ({x.lower() for x in names[::2]} for names in (GIVEN, SURNAMES))


def listed(word: str) -> str:
    """Whether a word is among the common given names or surnames."""
    low = word.lower()
    return "g" * (low in _GIVEN) + "s" * (low in _SURNAMES)


N_SELF, N_NEAR = 8, 2


def form_features(word: str, case: int) -> list[list[int]]:
    """Table rows of a form in each part it can play: itself, at each offset, and as the nearest words around."""
    low, shape = word.lower(), f"{case}{shape_of(word)}"
    # digits count by their number only: forms are told apart by it, whichever comes first
    value, head, tail, end = (shape_of(word), shape, shape, shape) if word.isdigit() else (low, low[:3], low[-3:], low[-2:])
    own = [f"w{value}", f"s{shape}", f"p{case}{head}", f"e{case}{tail}", f"e2{case}{end}", f"l{min(len(word), 12)}{shape[0]}", f"d{listed(word)}{case}", "bias"]
    parts = [[_row(x) for x in own]]
    for o in OFFSETS:
        parts.append([_row(f"{o}w{value}"), _row(f"{o}s{shape}") if abs(o) < 3 else 0])
    return parts + [[_row(f"{part}{value}"), 0] for part in ("pa", "ppa", "na")]


def piece_features(piece: str) -> int:
    """Table row of a piece's shape: of its letters only whether there are some."""
    body = piece.strip(".,;:!?()[]\"'")
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d", "9", body))
    if re.search(r"\w@\w", body):
        shape = "email"
    elif not re.search(r"\d", body):
        shape = "none"
    return _row("piece" + shape[:24])


class Features:
    """Table rows of the features of tokens; each distinct form and piece is worked out once."""

    EDGE = 0  # the form outside a text

    def __init__(self):
        self.forms: dict[int, int] = {}
        edge = [[_row(f"{o}edge"), 0] for o in OFFSETS] + [[_row(f"{part}edge"), 0] for part in ("pa", "ppa", "na")]
        self.parts = [[[0] * N_SELF, *edge]]
        self.shapes = [0]
        self.pieces: dict[int, int] = {}

    def index(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(form number of each token, table row of its piece)."""
        if len(self.parts) > 1 << 18 or len(self.pieces) > 1 << 20:
            self.__init__()
        code, keys = pd.factorize(t.forms)
        first = np.zeros(len(keys), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        number = np.zeros(len(keys), np.int64)
        for k, key in enumerate(keys.tolist()):
            if (v := self.forms.get(key)) is None:
                i = int(first[k])
                v = self.forms[key] = len(self.parts)
                word, case = t.text(i), int(t.case[t.row[i]])
                self.parts.append(form_features(word, case))
                self.shapes.append(_row(f"shape{case}{shape_of(word)}{listed(word)}"))
            number[k] = v
        pcode, pkeys = pd.factorize(t.pieces)
        pfirst = np.zeros(len(pkeys), np.int64)
        pfirst[pcode[::-1]] = np.arange(len(pcode))[::-1]
        rows = np.array([self.pieces[key] if key in self.pieces else self.pieces.setdefault(key, piece_features(t.piece(int(pfirst[k])))) for k, key in enumerate(pkeys.tolist())], np.int64)
        return number[code], rows[pcode]


def _neighbours(t: Tokens, number: np.ndarray) -> list[np.ndarray]:
    """Form numbers of each part of ``form_features``, for every token; outside its text the edge."""
    n = len(number)
    at = np.arange(n)
    lo, hi = t.row_tokens[:-1][t.row], t.row_tokens[1:][t.row]
    out = [number]
    for o in OFFSETS:
        j = at + o
        ok = (j >= lo) & (j < hi)
        out.append(np.where(ok, number[np.clip(j, 0, max(n - 1, 0))], Features.EDGE))
    word = t.kind == _LETTER
    last = np.maximum.accumulate(np.where(word, at, -1)) if n else at
    before = np.concatenate([[-1], last[:-1]]) if n else at
    before2 = np.where(before >= 0, np.concatenate([[-1], last])[np.maximum(before, 0)], -1) if n else at
    nxt = np.minimum.accumulate(np.where(word, at, n)[::-1])[::-1] if n else at
    after = np.concatenate([nxt[1:], [n]]) if n else at
    for j, ok in ((before, before >= lo), (before2, before2 >= lo), (after, after < hi)):
        out.append(np.where(ok, number[np.clip(j, 0, max(n - 1, 0))], Features.EDGE))
    return out


#: Runs of shapes around a token that are a feature each, by their offsets.
SHAPE_RUNS = ((-1, 0), (0, 1), (-1, 0, 1), (0, 1, 2), (-2, -1, 0))


def shape_runs(t: Tokens, number: np.ndarray, features: Features) -> list[np.ndarray]:
    """Of every token the table rows of the runs of shapes that it stands in."""
    at = np.arange(len(number))
    lo, hi = t.row_tokens[:-1][t.row], t.row_tokens[1:][t.row]
    shape = np.array(features.shapes, np.uint64)[number]
    by = {}
    for o in range(-2, 3):
        j = at + o
        by[o] = np.where((j >= lo) & (j < hi), shape[np.clip(j, 0, max(len(at) - 1, 0))], 0) if len(at) else shape
    out = []
    for k, run in enumerate(SHAPE_RUNS):
        h = np.full(len(at), k + 1, np.uint64)
        with np.errstate(over="ignore"):
            for o in run:
                h = mix(h * np.uint64(31) + by[o])
        out.append((h % np.uint64(ROWS - 1)).astype(np.int64) + 1)
    return out


def emissions(t: Tokens, features: Features, weights: np.ndarray) -> np.ndarray:
    number, piece = features.index(t)
    used, back = np.unique(number, return_inverse=True)
    table = np.concatenate([[Features.EDGE], used])
    local = np.zeros(int(used.max()) + 1 if len(used) else 1, np.int64)
    local[used] = np.arange(len(used)) + 1
    out = weights[piece].astype(np.float32)
    for rows in shape_runs(t, number, features):
        out += weights[rows]
    for k, who in enumerate(_neighbours(t, number)):
        rows = np.array([features.parts[i][k] for i in table])
        out += weights[rows].sum(axis=1)[np.where(who == Features.EDGE, 0, local[np.minimum(who, len(local) - 1)])]
    return out


def _transitions() -> np.ndarray:
    """0 where a label may follow another, else a large penalty: I only behind B or I of its kind."""
    a = np.zeros((N, N))
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            for i, of in enumerate(LABELS):
                if of[2:] != to[2:]:
                    a[i, j] = _FORBIDDEN
    return a


_START = np.array([_FORBIDDEN if x[0] == "I" else 0.0 for x in LABELS])


def viterbi(score: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Best labels of padded sequences (batch, time, labels)."""
    b, n, _ = score.shape
    back = np.zeros((n, b, N), np.int8)
    best = score[:, 0] + _START
    for k in range(1, n):
        cand = best[:, :, None] + transitions
        top = cand.argmax(axis=1)
        step = np.take_along_axis(cand, top[:, None], axis=1)[:, 0] + score[:, k]
        live = (k < lengths)[:, None]
        back[k] = np.where(live, top, np.arange(N))
        best = np.where(live, step, best)
    out = np.zeros((b, n), np.int8)
    out[:, -1] = best.argmax(axis=1)
    rows = np.arange(b)
    for k in range(n - 1, 0, -1):
        out[:, k - 1] = back[k][rows, out[:, k]]
    return out


def may_hold_items(t: Tokens, score: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Which texts' best path may differ from "O" throughout.

    Against that path an item gains at most its first token's best B over O and the way in,
    every I over O with its transition where that is positive, and the way out. A text where
    no beginning makes up for this has none; the bound is exact, so nothing is lost.
    """
    b, i = np.arange(1, N, 2), np.arange(2, N, 2)
    stay = transitions[0, 0]
    way_in = max(0.0, transitions[:, b].max() - stay)  # a text that begins with an item has no transition there, nor has the other path
    inside = max(transitions[b, i].max(), transitions[i, i].max()) - stay
    way_out = max(0.0, transitions[1:, 0].max() - stay)
    rows = len(t.row_tokens) - 1
    begin = np.full(rows, -np.inf)
    np.maximum.at(begin, t.row, score[:, b].max(axis=1) - score[:, 0] + way_in + way_out)
    more = np.bincount(t.row, np.maximum(score[:, i].max(axis=1) - score[:, 0] + inside, 0), rows)
    return begin + more >= 0


def decode(t: Tokens, score: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Labels of all tokens; texts of like length are decoded together."""
    lengths = np.diff(t.row_tokens)
    labels = np.zeros(len(t.starts), np.int8)
    order = np.argsort(lengths, kind="stable")
    order = order[(lengths[order] > 0) & may_hold_items(t, score, transitions)[order]]
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and j - i < 512 and lengths[order[j]] * (j - i + 1) < 1 << 16:
            j += 1
        rows, n = order[i:j], int(lengths[order[j - 1]])
        at = t.row_tokens[rows][:, None] + np.arange(n)
        ok = np.arange(n) < lengths[rows][:, None]
        padded = score[np.where(ok, at, 0)]
        labels[at[ok]] = viterbi(padded, lengths[rows], transitions)[ok]
        i = j
    return labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def _expected(score: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected label and transition counts of padded sequences, by the forward-backward recursion."""
    b, n, _ = score.shape
    alpha, beta = np.zeros((n, b, N)), np.zeros((n, b, N))
    alpha[0] = score[:, 0] + _START
    for k in range(1, n):
        alpha[k] = np.where((k < lengths)[:, None], _log_sum(alpha[k - 1][:, :, None] + trans, 1) + score[:, k], alpha[k - 1])
    for k in range(n - 2, -1, -1):
        beta[k] = np.where((k + 1 < lengths)[:, None], _log_sum(trans + (score[:, k + 1] + beta[k + 1])[:, None, :], 2), 0)
    z = _log_sum(alpha[-1], 1)
    live = np.arange(n)[:, None] < lengths
    node = np.exp(np.minimum(alpha + beta - z[:, None], 0)) * live[:, :, None]
    pair = np.zeros((N, N))
    for k in range(1, n):
        p = np.exp(np.minimum(alpha[k - 1][:, :, None] + trans + (score[:, k] + beta[k])[:, None, :] - z[:, None, None], 0))
        pair += (p * live[k][:, None, None]).sum(axis=0)
    return node.transpose(1, 0, 2), pair


def train(table: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transitions) by Adam on the conditional likelihood; the same table gives the same model."""
    t = Tokens(*text_bytes(pa.array([x for x, _ in table])))
    chars = char_index(t.data)
    gold = np.zeros(len(t.starts), np.int64)
    for r, (_, spans) in enumerate(table):
        lo, hi = t.row_tokens[r], t.row_tokens[r + 1]
        at = chars[t.starts[lo:hi]] - chars[t.offsets[r]]
        for a, b, kind in spans:
            inside = lo + np.flatnonzero((at >= a) & (at < b))
            gold[inside] = LABELS.index(f"I-{kind}")
            gold[inside[:1]] = LABELS.index(f"B-{kind}")
    features = Features()
    number, piece = features.index(t)
    columns = [np.array([p[k] for p in features.parts])[who] for k, who in enumerate(_neighbours(t, number))]
    feats = np.concatenate([piece[:, None], *[r[:, None] for r in shape_runs(t, number, features)], *columns], axis=1)
    used, back = np.unique(feats, return_inverse=True)
    feats = back.reshape(feats.shape)
    nothing = int(np.flatnonzero(used == 0)[0])
    w, trans = np.zeros((len(used), N)), np.zeros((N, N))
    fixed, moments = _transitions(), [np.zeros_like(w), np.zeros_like(w), np.zeros((N, N)), np.zeros((N, N))]
    lengths = np.diff(t.row_tokens)
    rng, step = np.random.default_rng(3), 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = np.argsort(lengths + rng.random(len(lengths)) * 6)
        batches = [b for k in range(0, len(order), BATCH) if len(b := order[k : k + BATCH][lengths[order[k : k + BATCH]] > 0])]
        for k in rng.permutation(len(batches)):
            rows = batches[k]
            n = int(lengths[rows].max())
            at = t.row_tokens[rows][:, None] + np.arange(n)
            ok = np.arange(n) < lengths[rows][:, None]
            flat = at[ok]
            score = np.zeros((len(rows), n, N))
            heard = np.where(rng.random((len(flat), feats.shape[1])) < DROPOUT, nothing, feats[flat])
            score[ok] = w[heard].sum(axis=1)
            node, pair = _expected(score, lengths[rows], trans + fixed)
            delta = node[ok]
            delta[np.arange(len(flat)), gold[flat]] -= 1
            index = heard.reshape(-1)
            spread_delta = np.repeat(delta, feats.shape[1], axis=0)
            gw = np.stack([np.bincount(index, spread_delta[:, c], len(used)) for c in range(N)], axis=1) / len(rows) + DECAY * w
            follows = (np.diff(t.row[flat]) == 0).nonzero()[0]
            np.add.at(pair, (gold[flat[follows]], gold[flat[follows + 1]]), -1)
            step += 1
            for x, g, m, v in ((w, gw, *moments[:2]), (trans, pair / len(rows), *moments[2:])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            w[nothing] = 0
    weights = np.zeros((ROWS, N), np.float32)
    weights[used] = w
    weights[0] = 0
    return weights, (trans + fixed).astype(np.float32)


#: The trained weights, kept beside the code; ``python -m quern.llm.pii`` trains and writes them anew.
WEIGHTS = Path(__file__).with_name("pii_weights.npz")


def _key(table: list) -> str:
    """What the weights follow from: the labelled table, the features of some forms, and how it is trained."""
    some = [form_features(x, k) for k, x in enumerate(("Anna", "7", "("))]
    return hashlib.sha256(repr((table, some, SHAPE_RUNS, EPOCHS, BATCH, RATE, DECAY, DROPOUT)).encode()).hexdigest()


def write_model(path: Path = WEIGHTS) -> None:
    table = labelled_table()
    weights, transitions = train(table)
    used = np.flatnonzero(np.abs(weights).max(axis=1) > 5e-3)
    np.savez_compressed(path, key=_key(table), used=used.astype(np.int32), weights=weights[used].astype(np.float16), transitions=transitions)


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray]:
    """The model of the labelled table: its kept weights if they follow from it, else trained once a process."""
    table = labelled_table()
    if WEIGHTS.exists():
        with np.load(WEIGHTS) as kept:
            if str(kept["key"]) == _key(table):
                weights = np.zeros((ROWS, N), np.float32)
                weights[kept["used"]] = kept["weights"]
                return weights, kept["transitions"]
    return train(table)


def genuine(kind: str, text: str) -> bool:
    """Whether a span has the parts that every item of its kind has."""
    digits = sum(c.isdigit() for c in text)
    if kind == "email":
        return bool(re.search(r"\w\s?(?:@|\(at\)|\[at\]|\bat\b)\s?\w", text, re.IGNORECASE)) and bool(re.search(r"\.|\bdot\b", text, re.IGNORECASE))
    if kind == "phone":
        return 7 <= digits <= 18
    if kind == "id_number":
        return digits >= 5
    words = re.findall(r"[^\W\d_]+", text)
    if kind == "address":
        return digits >= 1 and any(len(w) > 2 for w in words)
    return digits == 0 and len(words) >= 2


def _spans(t: Tokens, labels: np.ndarray) -> Iterator[tuple[int, int, int, str]]:
    """(row, first token, token behind the last, kind) of each labelled span."""
    some = np.flatnonzero(labels)
    i = 0
    while i < len(some):
        a = int(some[i])
        kind = LABELS[labels[a]][2:]
        inside = LABELS.index(f"I-{kind}")
        while i + 1 < len(some) and some[i + 1] == some[i] + 1 and labels[some[i + 1]] == inside and t.row[some[i + 1]] == t.row[a]:
            i += 1
        yield int(t.row[a]), a, int(some[i]) + 1, kind
        i += 1


_FOUND = pa.schema([("rec_id", pa.int64()), ("pii_kind", pa.string()), ("starts_at", pa.int64()), ("ends_at", pa.int64())])


def find_in(column: pa.Array, weights: np.ndarray, transitions: np.ndarray, features: Features) -> Iterator[tuple[int, str, int, int]]:
    """(row, kind, start, end) of every item, in characters of its text."""
    data, offsets = text_bytes(column)
    row = 0
    while row < len(offsets) - 1:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES // 2, "right")) - 1)
        t = Tokens(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])
        labels = decode(t, emissions(t, features, weights), transitions)
        chars = char_index(t.data)
        for r, a, b, kind in _spans(t, labels):
            lo, hi = int(t.starts[a]), int(t.ends[b - 1])
            if genuine(kind, t.data[lo:hi].tobytes().decode("utf-8", "replace")):
                base = chars[t.offsets[r]]
                yield row + r, kind, int(chars[lo] - base), int(chars[hi] - base)
        row = stop


def personal_items(df: DataFrame, rec_id: str, text: str) -> DataFrame:
    """(rec_id BIGINT, pii_kind, starts_at, ends_at): one row per personal item.

    Offsets count characters from 0. Rows with a null id, and null and empty texts, give
    none; a row delivered again gives its items once.
    """
    shared = df.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            rows = [(int(ids[r]), kind, lo, hi) for r, kind, lo, hi in find_in(b.column(1), *shared.value, features)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _FOUND)], schema=_FOUND)

    rows = spread(df.filter(F.col(rec_id).isNotNull() & (F.length(text) > 0)).select(F.col(rec_id).cast("long").alias("rec_id"), F.col(text).alias("t")))
    return rows.mapInArrow(run, "rec_id long, pii_kind string, starts_at long, ends_at long").distinct()


def masked(df: DataFrame, text: str, name: str = "masked") -> DataFrame:
    """``df`` with ``name``: the text with every personal item replaced by its kind in brackets, as in [PHONE].

    All else is unchanged, and so are null and empty texts.
    """
    shared = df.sparkSession.sparkContext.broadcast(model())

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features()
        for texts in batches:
            out = texts.astype(object).where(texts.notna(), None).tolist()
            found: dict[int, list[tuple[int, int, str]]] = {}
            for r, kind, lo, hi in find_in(pa.array(out, pa.string()), *shared.value, features):
                found.setdefault(r, []).append((lo, hi, kind))
            for r, items in found.items():
                for lo, hi, kind in sorted(items, reverse=True):
                    out[r] = f"{out[r][:lo]}[{kind.upper()}]{out[r][hi:]}"
            yield pd.Series(out, dtype=object)

    return df.withColumn(name, mask(F.col(text)))


if __name__ == "__main__":
    write_model()
