"""Evaluation passages that occur in training texts.

Winnowing: of every window of ``WINDOW`` consecutive word grams the least hash is kept, in
both corpora by the same rule, so any shared run of ``GRAM + WINDOW - 1`` = 5 words keeps
a fingerprint in common. A stretch with one word in eight changed, missing or added always
contains such a run: of n words with e edits some run has (n - e) / (e + 1) words or more,
and e <= n / 8 makes that at least 14 / 3. The fingerprints are joined, and each pair of a
text and a passage that meet is extended by an alignment around the grams they share.

The passages are a stated query set: they are taken in slabs of bounded size, each broadcast
with the index of its fingerprints and met by all texts where these are read. So no print,
however common, is the key of a shuffle, no text is sent anywhere, and the same way serves
item sets of every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.bytewords import gram_rows, grams, without_accents, words_of
from quern.operators.bitmap import member, membership
from quern.staging import stage
from quern.tables import spread

GRAM, WINDOW = 4, 2
#: A stretch: so many words of the passage, with at most one edit in so many.
LEAST_WORDS, PER_EDIT = 15, 8
#: The fewest 4-grams such a stretch keeps whole: 16 words with two edits keep 16 - 2 - 3 * 3.
LEAST_GRAMS = 5
#: Words of passages in a slab; with its index a slab takes about 40 bytes a word.
SLAB_WORDS = 1 << 20
#: Words beside a shared gram in which an alignment is looked for: more than a stretch without a shorter one inside can reach.
REACH = 64
#: A stretch without a shorter one inside has at most 48 words (see ``aligned_stretch``), so so many edits.
MOST_EDITS = 6


def plain_text(text: Column) -> Column:
    """Without markup, entities, invisible characters and hyphens at line ends."""
    t = F.when(text.contains("<"), F.regexp_replace(text, r"</?[a-zA-Z][^<>]*>", " ")).otherwise(text)
    t = F.when(t.contains("&"), F.regexp_replace(t, r"&[a-zA-Z]{2,8};|&#\d{1,6};", " ")).otherwise(t)
    return F.translate(t, "\u00ad\u200b\u200c\u200d\u2060\ufeff", "")


def _winnow(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places of the kept hashes: the least of each window inside a row, and a row's only one."""
    n = len(hashes)
    kept = np.zeros(n, bool)
    alone = np.ones(n, bool)
    if n > 1:
        same = row[1:] == row[:-1]
        first = hashes[:-1] <= hashes[1:]
        kept[:-1] |= same & first
        kept[1:] |= same & ~first
        alone[:-1] &= ~same
        alone[1:] &= ~same
    return np.flatnonzero(kept | alone)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, words) of each (item, passage); passages shorter than a stretch are left out."""
    for batch in batches:
        for w in words_of(without_accents(batch.column(1))):
            counts = np.diff(w.row_words)
            keep = counts >= LEAST_WORDS
            ends = np.concatenate([[0], np.cumsum(counts[keep])]).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(ends), pa.array(w.hashes[np.repeat(keep, counts)].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first_row, w.rows).filter(pa.array(keep)), words], names=["item", "words"])


class Grams:
    """The words of a text or passage and their grams, in order."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.all = grams(words, GRAM)[: max(0, len(words) - GRAM + 1)]


def aligned_stretch(passage: Grams, text: Grams) -> bool:
    """Whether the text holds a stretch, by a full alignment around the shared grams.

    For every place in passage and text, and every number of edits, the longest stretch that
    ends there. A stretch without a shorter one inside has at most ``MOST_EDITS`` edits: cut
    it at any gap; if the part before has 15 words or more it breaks the rate, and the part
    behind must make up for that with at most 14 words. So it is at most three parts of 14
    words with two gaps, 48 words in all with their edits.
    """
    a, b = passage.words, text.words
    at = np.flatnonzero(np.isin(text.all, passage.all))
    if not len(at):
        return False
    cuts = np.flatnonzero(np.diff(at) > 2 * REACH) + 1
    for near in np.split(at, cuts):
        part = b[max(0, near[0] - REACH) : near[-1] + GRAM + REACH]
        # a word that the part lacks is an edit wherever it is: only words inside some 15 or more that keep the rate by that matter
        room = np.concatenate([[0], np.cumsum(np.where(np.isin(a, part), 1, 1 - PER_EDIT))])
        starts = np.flatnonzero(np.maximum.accumulate(room[: LEAST_WORDS - 1 : -1])[::-1] >= room[: len(room) - LEAST_WORDS])
        if not len(starts):
            continue
        ends = LEAST_WORDS + np.flatnonzero(room[LEAST_WORDS:] >= np.minimum.accumulate(room)[: len(room) - LEAST_WORDS])
        words = a[starts[0] : ends[-1]]
        edits = min(MOST_EDITS, len(words) // PER_EDIT)
        last = np.full((edits + 1, len(part) + 1), -1 << 20)
        for word in words:
            same = part == word
            new = np.full_like(last, -1 << 20)
            for e in range(edits + 1):
                if e:
                    np.maximum(last[e - 1, :-1], last[e - 1, 1:], out=new[e, 1:])
                    new[e] += 1
                    np.maximum(new[e, 1:], new[e - 1, :-1], out=new[e, 1:])
                run = np.maximum(last[e, :-1] + 1, 1 if e == 0 else -1 << 20)
                new[e, 1:] = np.where(same, np.maximum(run, new[e, 1:]) if e else run, new[e, 1:])
                if (new[e, 1:][same] >= max(LEAST_WORDS, PER_EDIT * e)).any():
                    return True
            last = new
    return False


def holds(passage: Grams, text: Grams) -> bool:
    """Whether the text holds a stretch of the passage, which keeps ``LEAST_GRAMS`` grams at least."""
    return int(np.isin(passage.all, text.all).sum()) >= LEAST_GRAMS and aligned_stretch(passage, text)


class Slab:
    """Some passages with the index of their prints and of all their grams."""

    def __init__(self, items: np.ndarray, words: list[np.ndarray]):
        self.items = items
        self.ends = np.cumsum([0, *map(len, words)])
        self.words = np.concatenate(words)
        counts = np.maximum(np.diff(self.ends) - GRAM + 1, 0)
        row = np.repeat(np.arange(len(words)), counts)
        hashes = np.concatenate([grams(w, GRAM)[: len(w) - GRAM + 1] for w in words])
        kept = _winnow(hashes, row)
        self.prints, self.print_ends, self.print_rows = self._index(hashes[kept], row[kept])
        self.grams, self.gram_ends, self.gram_rows = self._index(hashes, row)
        self.bits = membership(self.prints)
        self.made: dict[int, Grams] = {}

    @staticmethod
    def _index(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes in order, where the rows of each begin, and the rows, one for every place."""
        order = np.lexsort((row, hashes))
        distinct, first = np.unique(hashes[order], return_index=True)
        return distinct, np.append(first, len(order)), row[order].astype(np.int32)

    def passage(self, row: int) -> Grams:
        if row not in self.made:
            if len(self.made) > 1 << 12:
                self.made.clear()
            self.made[row] = Grams(self.words[self.ends[row] : self.ends[row + 1]])
        return self.made[row]

    def candidates(self, prints: np.ndarray, all_grams: np.ndarray) -> np.ndarray:
        """Passages that share a print with a text, and ``LEAST_GRAMS`` places of theirs by their grams.

        The second count drops passages that meet a text in a common phrase only; it is one
        addition per place of the passages, whatever the phrase.
        """
        met = np.zeros(len(self.items), bool)
        for k in self._places(self.prints, prints):
            met[self.print_rows[self.print_ends[k] : self.print_ends[k + 1]]] = True
        if not met.any():
            return np.zeros(0, np.int64)
        shared = np.zeros(len(self.items), np.int64)
        for k in self._places(self.grams, all_grams):
            rows = self.gram_rows[self.gram_ends[k] : self.gram_ends[k + 1]]
            if len(rows) < 16:
                np.add.at(shared, rows, 1)
            else:
                shared += np.bincount(rows, minlength=len(shared))
        return np.flatnonzero(met & (shared >= LEAST_GRAMS))

    @staticmethod
    def _places(table: np.ndarray, hashes: np.ndarray) -> list[int]:
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        return np.unique(at[table[at] == hashes]).tolist()


def _finder(shared):
    """(text id, item) of the stretches of a slab's passages in each (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab: Slab = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found: set[tuple[int, int]] = set()
            for w in words_of(without_accents(batch.column(1))):
                hashes, counts = gram_rows(w, GRAM)
                row = np.repeat(np.arange(w.rows), counts)
                at = _winnow(hashes, row)
                at = at[member(slab.bits, hashes[at])]
                if not len(at):
                    continue
                ends = np.cumsum(np.append(0, counts))
                first = np.flatnonzero(np.diff(row[at], prepend=-1))
                for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(at)]):
                    r = int(row[at[lo]])
                    some = slab.candidates(hashes[at[lo:hi]], hashes[ends[r] : ends[r + 1]])
                    if len(some):
                        text = Grams(w.hashes[w.row_words[r] : w.row_words[r + 1]])
                        found.update((int(ids[w.first_row + r]), int(slab.items[k])) for k in some.tolist() if holds(slab.passage(k), text))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in (0, 1)], names=["id", "item"])

    return run


def _slabs(passages: DataFrame) -> Iterator[Slab]:
    """Slabs of about ``SLAB_WORDS`` words, or of one longer passage; a passage of an item counts once."""
    size = passages.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // SLAB_WORDS))
    for k in range(blocks):
        some = passages.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).toArrow()
        if some.num_rows:
            words = some.column("words").combine_chunks()
            flat, ends = words.flatten().to_numpy().view(np.uint64), words.offsets.to_numpy() - words.offsets[0].as_py()
            yield Slab(some.column("item").to_numpy(), [flat[a:b] for a, b in zip(ends[:-1], ends[1:])])


def leaked(texts: DataFrame, text_id: str, text: str, items: DataFrame, item_id: str, passage: str) -> DataFrame:
    """(text_id, item_id) of every text that holds a stretch of an item's passage.

    A stretch has ``LEAST_WORDS`` words or more of the passage in their order, with at
    most one word in ``PER_EDIT`` changed, missing or added; case, punctuation, accents,
    markup and line breaks don't count. Of an item id with several passages each is looked
    for. Null ids, null and shorter texts and passages give no rows; ids are BIGINT. Rows
    delivered again give their pairs once.
    """
    tests = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item"), plain_text(F.col(passage)).alias("t"))
    tests = stage(tests.mapInArrow(_passages, "item long, words array<long>").distinct(), "passages")
    docs = texts.filter(F.col(text_id).isNotNull() & F.col(text).isNotNull()).select(F.col(text_id).cast("long").alias("id"), F.col(text).alias("t"))
    docs = spread(docs).select("id", plain_text(F.col("t")).alias("t"))
    spark = texts.sparkSession
    parts = [docs.mapInArrow(_finder(spark.sparkContext.broadcast(slab)), "id long, item long") for slab in _slabs(tests)]
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "id long, item long")
    return found.distinct().select(F.col("id").alias(text_id), F.col("item").alias(item_id))
