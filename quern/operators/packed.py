"""Fields that hold several values behind inconsistent delimiters.

Each distinct field is read once into atoms between candidate delimiters; quoted and
bracketed spans are atomic. Whether a delimiter separates values or only joins a remark
to one is not fixed by a rule: expectation maximisation over all distinct fields,
weighted by their frequency, learns how often each delimiter separates, which values
occur and which remarks. A Viterbi lattice then chooses each field's most likely split.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.staging import stage
from quern.tables import fresh

#: Candidate delimiters; a dash counts only with blanks around it.
DELIMITERS = ";,|/+&\t\n"
SMOOTHING = 0.5
#: EM ends when no share moves by more than this; its likelihood never falls, so it does end.
STILL = 1e-3
#: Fields of more rows than this, and than one row in ``HEAVY_SHARE``, are joined in ``SALTS`` parts; there are ``HEAVY_SHARE`` of them at most.
HEAVY_ROWS, HEAVY_SHARE, SALTS = 10_000, 1 << 13, 64
#: Log probability of a second remark in a row, against a value after a remark.
REMARK_AGAIN = math.log(0.1)

_OPEN, _QUOTES = {"(": ")"}, "\"'"


def _quoted(s: str, i: int) -> int:
    """End of the quoted span that begins at i, or -1: quotes doubled or behind a backslash don't end it."""
    q, j = s[i], i + 1
    while j < len(s):
        if s[j] == "\\" and j + 1 < len(s):
            j += 2
        elif s[j] == q:
            if s[j + 1 : j + 2] != q:
                return j + 1
            j += 2
        else:
            j += 1
    return -1


def _bracketed(s: str, i: int) -> int:
    depth = 0
    for j in range(i, len(s)):
        depth += (s[j] == "(") - (s[j] == ")")
        if not depth:
            return j + 1
    return -1


def lattice(field: str) -> tuple[list[str], list[str], list[str]]:
    """The non-empty atoms of a field as written; of each but the first, the delimiter and all text before it.

    Several delimiters in a row, with only blanks between, count as their first.
    """
    s = field.strip()
    while len(s) > 1 and (s[0], s[-1]) in (("[", "]"), ("{", "}")):
        s = s[1:-1].strip()
    atoms, marks, gaps, begin, i, mark, last = [], [], [], 0, 0, "", 0
    while i <= len(s):
        end = i == len(s)
        c = "" if end else s[i]
        width = 0
        if c in DELIMITERS:
            width = 1
        elif c in "-–—" and i and s[i - 1].isspace() and s[i + 1 : i + 2].isspace():
            width = 1
        if end or (width and c):
            atom = s[begin:i].strip()
            if atom:
                at = s.index(atom, begin)
                atoms.append(atom)
                marks.append(mark)
                gaps.append(s[last:at])
                mark, last = "", at + len(atom)
            if end:
                break
            mark = mark or ("-" if c in "-–—" else c)
            i += 1
            begin = i
        elif c in _QUOTES and not s[begin:i].strip() and (j := _quoted(s, i)) > 0:
            i = j
        elif c == '"' and (j := _quoted(s, i)) > 0:
            i = j
        elif c in _OPEN and (j := _bracketed(s, i)) > 0:
            i = j
        else:
            i += 1
    return atoms, marks[1:], gaps[1:]


def plain(atom: str) -> str:
    """A value as written, without the quotes around it and with escaped quotes inside made plain."""
    if atom[:1] in _QUOTES and _quoted(atom, 0) == len(atom):
        q, body = atom[0], atom[1:-1]
        return re.sub(r"\\(.)", r"\1", body.replace(q + q, q)).strip()
    return atom.strip()


def key_of(atom: str) -> tuple[str, str]:
    """The value that heads an atom, and the remark behind it, without case and blanks."""
    text = plain(atom).lower()
    m = re.match(r"[^\W]+(?:[ _-]?[^\W]+)*", text)
    head = m.group(0) if m else text
    rest = re.search(r"[^\W]+(?:[ _-]?[^\W]+)*", text[len(head) :])
    fold = lambda x: re.sub(r"[\s_-]+", "_", x)
    return fold(head), fold(rest.group(0)) if rest else ""


def split_by(atoms: list[str], gaps: list[str], odds: list[float]) -> list[str]:
    """Viterbi over the boundaries: state 0 begins a value, state 1 goes on with a remark."""
    if not atoms:
        return []
    score, back = [0.0, -math.inf], []
    for o in odds:
        # o: log odds that the delimiter separates and the atom is a value
        begin = max((score[0], 0), (score[1], 1))
        join = max((score[0], 0), (score[1] + REMARK_AGAIN, 1))
        back.append((begin[1], join[1]))
        score = [begin[0] + o, join[0]]
    state, states = int(score[1] > score[0]), []
    for b in reversed(back):
        states.append(state)
        state = b[state]
    values = [plain(atoms[0])]
    for atom, gap, joined in zip(atoms[1:], gaps, reversed(states)):
        if joined:
            values[-1] += gap + atom
        else:
            values.append(plain(atom))
    return values


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        read = [lattice(f) for f in pdf["_field"]]
        keys = [[key_of(a) for a in atoms] for atoms, _, _ in read]
        yield pd.DataFrame(
            {
                "_field": pdf["_field"],
                "_n": pdf["_n"],
                "_atoms": [a for a, _, _ in read],
                "_marks": [m for _, m, _ in read],
                "_gaps": [g for _, _, g in read],
                "_keys": [[h for h, _ in k] for k in keys],
                "_remarks": [[r for _, r in k if r] for k in keys],
            }
        )


def delimiter_model(read: DataFrame) -> DataFrame:
    """Log odds (mark, key, odds) that a delimiter before an atom separates, by EM.

    First atoms are values and bracketed or quoted tails are remarks for certain; the
    share of each (delimiter, atom) pair that separates is the hidden part. The counts
    are kept as tables, one row per distinct pair, and each round is written to shared
    storage, as the next reads it three times. Rounds end when the shares stand still.
    """
    first = read.filter(F.size("_keys") > 0).groupBy(F.col("_keys")[0].alias("key")).agg(F.sum("_n").alias("n"))
    remark = read.select(F.explode("_remarks").alias("key"), "_n").groupBy("key").agg(F.sum("_n").alias("n"))
    sure = first.select("key", F.col("n").alias("v"), F.lit(0).cast("long").alias("r")).union(
        remark.select("key", F.lit(0).cast("long"), F.col("n"))
    )
    sure = stage(sure.groupBy("key").agg(F.sum("v").cast("double").alias("v0"), F.sum("r").cast("double").alias("r0")), "sure")
    pairs = (
        read.select("_n", F.explode(F.arrays_zip("_marks", F.slice("_keys", 2, 1 << 30).alias("key"))).alias("p"))
        .groupBy(F.col("p._marks").alias("mark"), F.col("p.key").alias("key"))
        .agg(F.sum("_n").cast("double").alias("n"))
    )
    state = pairs.join(sure, "key", "left").fillna(0.0, ["v0", "r0"])
    # begin with what the sure places say of each atom; unknown atoms are undecided
    state = stage(state.withColumn("p", (F.col("v0") + SMOOTHING) / (F.col("v0") + F.col("r0") + 2 * SMOOTHING)), "em")
    moved = 1.0
    while moved > STILL:
        sep = F.sum(F.col("n") * F.col("p"))
        by_mark = state.groupBy("mark").agg(((sep + SMOOTHING) / (F.sum("n") + 2 * SMOOTHING)).alias("pi"))
        by_key = state.groupBy("key").agg(
            (sep + F.first("v0") + SMOOTHING).alias("v"), (F.sum(F.col("n") * (1 - F.col("p"))) + F.first("r0") + SMOOTHING).alias("r")
        )
        sums = by_key.agg(F.struct(F.sum("v").alias("v"), F.sum("r").alias("r")).alias("all"))
        missing = sure.join(by_key, "key", "left_anti").agg(F.struct(F.coalesce(F.sum("v0"), F.lit(0.0)).alias("v"), F.coalesce(F.sum("r0"), F.lit(0.0)).alias("r")).alias("all"))
        a, b = sums.scalar(), missing.scalar()
        odds = F.log(F.col("pi") / (1 - F.col("pi"))) + F.log(F.col("v") / (a["v"] + b["v"])) - F.log(F.col("r") / (a["r"] + b["r"]))
        now = 1 / (1 + F.exp(-F.col("odds")))
        state = stage(  # as many marks as DELIMITERS and the dash, so they are broadcast
            state.join(F.broadcast(by_mark), "mark").join(by_key, "key").withColumn("odds", odds)
            .select("mark", "key", "n", "v0", "r0", now.alias("p"), "odds", F.abs(now - F.col("p")).alias("moved")),
            "em",
        )
        moved = state.agg(F.max("moved")).first()[0] or 0.0
    return state.select("mark", "key", "odds")


def split_packed(df: DataFrame, column: str, least: int = 1) -> DataFrame:
    """One row per value packed in ``column``: pos BIGINT from 1 and ``value``, beside all columns.

    Fields of fewer than ``least`` values are left out.

    Empty values are passed over and have no position; repeated ones keep theirs. Null
    and blank fields give no rows. The same field is split the same way in every row.
    ``n_values`` is the number of values of the field; columns of these names are replaced.
    """
    fields = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_field")).agg(F.count(F.lit(1)).alias("_n"))
    schema = "_field string, _n long, _atoms array<string>, _marks array<string>, _gaps array<string>, _keys array<string>, _remarks array<string>"
    read = stage(fields.mapInPandas(_read, schema), "fields")
    model = delimiter_model(read)
    bound = (
        read.filter(F.size("_marks") > 0)
        .select("_field", F.posexplode(F.arrays_zip("_marks", F.slice("_keys", 2, 1 << 30).alias("key"))).alias("at", "p"))
        .join(model, (F.col("p._marks") == F.col("mark")) & (F.col("p.key") == F.col("key")))
        .groupBy("_field")
        .agg(F.array_sort(F.collect_list(F.struct("at", "odds"))).alias("_odds"))  # bounded by the length of one field
    )

    @F.pandas_udf("array<string>")
    def values(atoms: pd.Series, gaps: pd.Series, odds: pd.Series) -> pd.Series:
        return pd.Series([split_by(list(a), list(g), [] if o is None else list(np.asarray(o, dtype=float))) for a, g, o in zip(atoms, gaps, odds)])

    field, packed, at, salt, other, heavy_key = fresh(df.columns, "_packed_field", "_packed_values", "_packed_at", "_packed_salt", "_packed_other", "_packed_heavy")
    split = read.join(bound, "_field", "left").select(F.col("_field").alias(field), values("_atoms", "_gaps", F.col("_odds.odds")).alias(packed))
    kept = [c for c in df.columns if c not in ("n_values", "pos", "value")]
    split = split.filter(F.size(packed) >= least)
    n_rows = read.agg(F.sum("_n").alias("n")).first()["n"] or 0
    heavy = read.filter(F.col("_n") > max(HEAVY_ROWS, n_rows // HEAVY_SHARE)).select(F.xxhash64("_field").alias(heavy_key))
    if heavy.isEmpty():
        both = df.join(split, F.col(column) == F.col(field))
    else:  # the rows of a heavy field meet copies of its values, one per salt
        spread_over = lambda x: x.join(F.broadcast(heavy), F.xxhash64(column if x is df else field) == F.col(heavy_key), "left")
        salted = spread_over(df).withColumn(salt, F.when(F.col(heavy_key).isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0))
        copies = spread_over(split).withColumn(other, F.explode(F.sequence(F.lit(0), F.when(F.col(heavy_key).isNotNull(), SALTS - 1).otherwise(0)))).drop(heavy_key)
        both = salted.drop(heavy_key).join(copies, (F.col(column) == F.col(field)) & (F.col(salt) == F.col(other)))
    out = both.select(*kept, F.size(packed).alias("n_values"), F.posexplode(packed).alias(at, "value"))
    return out.select(*kept, "n_values", (F.col(at) + 1).cast("long").alias("pos"), "value")
