"""Texts packed into containers of a fixed number of tokens.

Texts are measured with a public tokenizer; one longer than the capacity is cut into full
pieces and a rest. Pieces and texts are spread over groups of bounded size by a hash. In a
group the containers are filled one after the other by bin completion: around the largest
item left, a branch-and-bound search looks for the filling that wastes least, with the
best-fit filling as its incumbent; dominated fillings are passed over, and branches whose
remaining items can't fill enough to beat the incumbent are cut off. Full containers are closed, and all but the ``KEEP`` emptiest of the others; the
items of these go on to a next round of fewer groups, until one group is left.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.staging import stage
from quern.tables import spread

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Containers' worth of items in a group, and how many of a group's containers stay open at most:
#: each round has an eighth of the items of the one before, or less.
GROUP, KEEP = 512, 64
#: Steps of the search for one container if the caller names no other number; the incumbent stands when they are used up.
STEPS = 2000


@lru_cache(maxsize=4)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: list[str], path: str) -> list[int]:
    encoding = _encoding(path)
    return [len(t) for t in encoding.encode_ordinary_batch(texts, num_threads=1)]


def _measure(path: str, capacity: int):
    """(doc_id, piece_no, n_tokens) of each piece, from (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = b.column(0).to_numpy(zero_copy_only=False), np.array(token_counts(b.column(1).to_pylist(), path), np.int64)
            pieces = np.maximum(-(-n // capacity), 1)
            row = np.repeat(np.arange(len(n)), pieces)
            no = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(n[row] - no * capacity, capacity)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row].astype(np.int64)), pa.array(no + 1), pa.array(size)], names=["doc_id", "piece_no", "n_tokens"])

    return run


class Sizes:
    """A multiset of item sizes: the distinct ones in order, with the items of each."""

    def __init__(self, sizes: np.ndarray):
        self.items: dict[int, list[int]] = {}
        for i, s in enumerate(sizes.tolist()):
            self.items.setdefault(s, []).append(i)
        self.distinct = sorted(self.items)

    def take(self, size: int) -> int:
        """One item of a size, the first that came."""
        items = self.items[size]
        out = items.pop()
        if not items:
            del self.items[size]
            del self.distinct[bisect.bisect_left(self.distinct, size)]
        return out

    def at_most(self, size: int) -> int:
        """The largest size not above ``size``, or -1."""
        k = bisect.bisect_right(self.distinct, size)
        return self.distinct[k - 1] if k else -1


def best_fit(sizes: Sizes, room: int) -> list[int]:
    """The incumbent: ever the largest item that fits."""
    used: dict[int, int] = {}
    out: list[int] = []
    limit = room
    while room > 0:
        s = sizes.at_most(min(room, limit))
        while s > 0 and used.get(s, 0) >= len(sizes.items[s]):
            s = sizes.at_most(s - 1)
        if s <= 0:
            break
        used[s] = used.get(s, 0) + 1
        out.append(s)
        room -= s
        limit = s
    return out


def complete(sizes: Sizes, room: int, steps: int | None = STEPS) -> tuple[list[int], bool]:
    """The sizes of an undominated filling of ``room`` that wastes least, and whether that is certain.

    Depth first, sizes never growing, so a filling is reached in one order only. From each
    place the largest size that fits is tried, and then only those that leave room for
    another item: a smaller one with nothing behind it is dominated by the largest. A
    branch ends where all items left that fit, together, leave as much room as the
    incumbent wastes. The search ends when nothing is wasted or every branch is done;
    the incumbent stands, uncertain, if ``steps`` are used up before; None sets no limit.
    """
    best = best_fit(sizes, room)
    waste = room - sum(best)
    if waste <= 0 or not sizes.distinct:
        return best, True
    least, taken = sizes.distinct[0], 0
    upto = dict(zip(sizes.distinct, accumulate(s * len(sizes.items[s]) for s in sizes.distinct)))
    used: dict[int, int] = {}
    path: list[int] = []
    # a frame: room, the size to try next, and whether none was tried yet
    stack = [(room, sizes.at_most(room), True)]
    while stack and waste > 0:
        room, s, first = stack.pop()
        while s > 0 and used.get(s, 0) >= len(sizes.items[s]):
            s = sizes.at_most(s - 1)
        if s <= 0 or room - upto[s] >= waste:
            if stack:
                used[path.pop()] -= 1
            continue
        if steps is not None and taken >= steps:
            return best, False
        taken += 1
        left = room - s
        stack.append((room, sizes.at_most(min(s, room - least + 1) - 1 if first else s - 1), False))
        if left < waste:
            best, waste = [*path, s], left
        if left >= least:
            used[s] = used.get(s, 0) + 1
            path.append(s)
            stack.append((left, sizes.at_most(min(left, s)), True))
    return best, True


def fill(n_tokens: np.ndarray, capacity: int, steps: int | None = STEPS) -> tuple[list[list[int]], list[bool]]:
    """Items by container, for one group, and whether each filling is certain to waste least; the largest item left begins each."""
    sizes = Sizes(n_tokens)
    out, certain = [], []
    while sizes.distinct:
        largest = sizes.distinct[-1]
        items, sure = [sizes.take(largest)], True
        if largest < capacity:
            found, sure = complete(sizes, capacity - largest, steps)
            items += [sizes.take(s) for s in found]
        out.append(items)
        certain.append(sure)
    return out, certain


def _packer(capacity: int, level: int, last: bool, steps: int | None):
    """Fills the containers of one group; the items of containers that stay open have none yet."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece_no"], kind="stable", ignore_index=True)
        sizes = pdf["n_tokens"].to_numpy()
        filled, certain = fill(sizes, capacity, steps)
        totals = np.array([sizes[items].sum() for items in filled], np.int64)
        emptiest = set() if last else set(np.argsort(totals, kind="stable")[:KEEP].tolist())
        container, total, sure = np.empty(len(pdf), object), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
        for k, items in enumerate(filled):
            container[items] = None if k in emptiest and totals[k] < capacity else f"{level}-{key[0]}-{k}"
            total[items], sure[items] = totals[k], certain[k]
        return pdf[["doc_id", "piece_no", "n_tokens"]].assign(container=container, fill=total, certain=sure)

    return run


def pack(df: DataFrame, doc_id: str, text: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, steps: int | None = STEPS) -> DataFrame:
    """(doc_id, piece_no, first_token, n_tokens, container, fill, certain): each piece of each text and its container.

    Null and empty texts and null ids give no rows. piece_no counts from 1; only texts of
    more than ``capacity`` tokens have several pieces, all full but the last; a piece holds
    the ``n_tokens`` tokens of its text from ``first_token``, counted from 0, so the pieces
    put together are the text. ``fill`` are the tokens of the whole container. A row
    delivered twice is packed twice. ``tokenizer`` is the path of a rank file, the same on
    all machines. ``steps`` bounds the search for one container, None sets no bound;
    ``certain`` is false for the containers whose search used them up.
    """
    texts = df.filter(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    pieces = stage(spread(texts).mapInArrow(_measure(tokenizer, capacity), "doc_id long, piece_no long, n_tokens long"), "pieces")
    full = pieces.filter(F.col("n_tokens") == capacity).withColumns(
        {"container": F.concat(F.lit("full-"), F.col("doc_id").cast("string"), F.lit("-"), F.monotonically_increasing_id().cast("string")), "fill": F.col("n_tokens"), "certain": F.lit(True)}
    )
    open_items = pieces.filter(F.col("n_tokens") < capacity)
    schema = "doc_id long, piece_no long, n_tokens long, container string, fill long, certain boolean"
    closed, level = [full], 0
    while True:
        tokens = open_items.agg(F.sum("n_tokens")).first()[0] or 0
        groups = max(1, round(tokens / (capacity * GROUP)))
        key = F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(level)), F.lit(groups))
        packed = open_items.withColumn("_g", key).groupBy("_g").applyInPandas(_packer(capacity, level, groups == 1, steps), schema)
        packed = stage(packed, f"packed{level}")
        closed.append(packed.filter(F.col("container").isNotNull()))
        if groups == 1:
            break
        open_items = packed.filter(F.col("container").isNull()).select("doc_id", "piece_no", "n_tokens")
        level += 1
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    first = ((F.col("piece_no") - 1) * capacity).alias("first_token")
    return out.select(F.col("doc_id").alias(doc_id), "piece_no", first, "n_tokens", "container", "fill", "certain")


def summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_tokens, n_containers, the fewest containers that could hold them, the unused share, and how many searches used up their steps."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.bool_and("certain").alias("certain"))
    one = per.agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_containers"), F.max("n").alias("most"), F.count_if(~F.col("certain")).alias("n_uncertain"))
    return one.select(
        "n_tokens", "n_containers", F.ceil(F.col("n_tokens") / capacity).alias("least_containers"),
        (1 - F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("unused"), "most", "n_uncertain",
    )
