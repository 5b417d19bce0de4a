"""Periodic runs of words, found by a dictionary of basic factors.

For every power of two m the words' positions get the rank of the m words that begin there. Equal ranks at most 2m apart
propose a period. Successive occurrences no more than m/2 apart form an arithmetic progression, whose difference a shorter
length proposes already; so only the last member of a progression proposes, with the members of the next ones.

Why no run is lost: let a run of smallest period q begin at s and be at least 2q long, m the power of two with m <= q < 2m, and i
the last position whose m words return q later inside the run. If i were followed by an occurrence within m/2, both lie in one
stretch of a period p <= m/2. Were that stretch to reach p words beyond the first copy, it would overlap its own copy q later by p
words, the two would be one stretch and q a multiple of p; so it does not, and i is the last member. Its pair with i + q is proposed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 12
CHUNK_WORDS = 200_000  # words of whole documents searched together; a longer document is searched alone

_SCHEMA = "id {id}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def basic_factors(words: np.ndarray) -> list[np.ndarray]:
    """Per power of two m the rank of the m words at every position; equal ranks mean equal words.

    A stretch that occurs once has a number of its own and is not ordered again; levels end when nothing repeats.
    """
    n = len(words)
    names, levels, own = words.astype(np.int64), [], np.arange(n, dtype=np.int64)
    m = 1
    while True:
        order = np.argsort(names, kind="stable")
        ranked = names[order]
        same = np.zeros(n, bool)
        same[1:] = ranked[1:] == ranked[:-1]
        twice = same.copy()
        twice[:-1] |= same[1:]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(~same)
        again = np.zeros(n, bool)
        again[order] = twice
        levels.append(np.where(again, rank, n + 1 + own))
        if not twice.any() or 2 * m > n:
            return levels
        # the next level pairs the halves; only positions where both repeat are ordered
        left = levels[-1][: n - m]
        right = levels[-1][m:]
        both = np.flatnonzero((left <= n) & (right <= n))
        names = 2 * n + 2 + own
        _, pair = np.unique(left[both] * (n + 1) + right[both], return_inverse=True)
        names[both] = pair
        m *= 2


def _proposals(level: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) with equal factors of m words at both ends, m <= period < 2m, from the last member of each progression."""
    n = len(level)
    at = np.flatnonzero(level <= n)
    at = at[np.argsort(level[at], kind="stable")]
    name = level[at]
    gap = np.full(len(at), 2 * n + 2, np.int64)
    gap[:-1] = np.where(name[1:] == name[:-1], at[1:] - at[:-1], 2 * n + 2)
    live = np.flatnonzero((2 * gap > m) & (gap < 2 * m))
    found_at, found_q = [], []
    step = 1
    while len(live):
        live = live[live + step < len(at)]
        live = live[(name[live + step] == name[live]) & (at[live + step] - at[live] < 2 * m)]
        q = at[live + step] - at[live]
        found_at.append(at[live[q >= m]])
        found_q.append(q[q >= m])
        step += 1
    if not found_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found_q)


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """Number of equal words from positions a and b on, or before them; a < b."""
    n, done = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        m, level = 1 << k, levels[k]
        while True:
            x, y = (a - done - m, b - done - m) if back else (a + done, b + done)
            fits = np.flatnonzero((x >= 0) & (y < n))
            fits = fits[level[x[fits]] == level[y[fits]]]
            done[fits] += m
            # the largest level may fit more than once, each lower one once
            if k < len(levels) - 1 or not len(fits):
                break
    return done


def find_periods(words: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a sequence of word numbers, by start and period: stretches with smallest period q and a
    length of at least max(least, 2q) that no neighbouring word extends."""
    none = np.zeros(0, np.int64)
    if len(words) < 2:
        return none, none, none
    levels = basic_factors(words)
    starts, lengths, periods = [none], [none], [none]
    for k, level in enumerate(levels):
        i, q = _proposals(level, 1 << k)
        if not len(i):
            continue
        # neighbouring positions with one period lie in one run: the first of each such row is extended
        order = np.lexsort((i, q))
        i, q = i[order], q[order]
        first = np.ones(len(i), bool)
        first[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1] + 1)
        i, q = i[first], q[first]
        ahead, behind = _common(levels, i, i + q, False), _common(levels, i, i + q, True)
        length = ahead + behind + q
        good = length >= np.maximum(least, 2 * q)
        starts.append((i - behind)[good])
        lengths.append(length[good])
        periods.append(q[good])
    start, length, period = np.concatenate(starts), np.concatenate(lengths), np.concatenate(periods)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # a stretch is proposed again for multiples of its period; the smallest stays
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of every row) of consecutive rows."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        words = (text.as_py() or "").encode().split()
        if held and size + len(words) > CHUNK_WORDS:
            yield first, held
            first, held, size = k, [], 0
        held.append(words)
        size += len(words)
    if held:
        yield first, held


def _search(docs: list[list[bytes]], least: int) -> tuple[list[list[dict]], list[str]]:
    """Runs and collapsed text of every document. Words of different documents get different numbers, so no run leaves its document."""
    numbers, upto, base = [], [0], 0
    for words in docs:
        known: dict[bytes, int] = {}
        numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + base)
        base += len(known)
        upto.append(upto[-1] + len(words))
    start, length, period = find_periods(np.concatenate(numbers), least)
    cover = np.zeros(upto[-1] + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    stays = np.cumsum(cover) == 0
    cuts = np.searchsorted(start, upto)
    runs, texts = [], []
    for k, words in enumerate(docs):
        a, b = cuts[k], cuts[k + 1]
        runs.append([{"start": int(s) - upto[k], "length": int(n), "period": int(q)} for s, n, q in zip(start[a:b], length[a:b], period[a:b])])
        kept = words if a == b else [w for w, stay in zip(words, stays[upto[k]: upto[k + 1]]) if stay]
        texts.append(b" ".join(kept).decode())
    return runs, texts


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """(id, n_words, runs, collapsed) for every row: its runs by start and period, and the text without repetitions.

    A word is a run of characters other than space and 0x09-0x0D, capitals told from small letters; positions count from 0. A run is
    a stretch with smallest period q (words q apart are equal) of at least max(least, 2q) words that no neighbouring word extends.
    ``collapsed`` drops every word that some run contains after its first q words, and joins the others by one space.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Rows without an id and rows that repeat one get a row
    each. Other columns are ignored; an empty table gives no rows. Nothing is shuffled; a task holds one Arrow batch and the
    dictionary of ``CHUNK_WORDS`` words or of the longest document.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = _SCHEMA.format(id=own.schema["id"].dataType.simpleString())
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in _chunks(batch.column(1)):
                runs, texts = _search(rows, least)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(rows)), pa.array([len(r) for r in rows], pa.int64()), pa.array(runs, run_type), pa.array(texts, pa.string()),
                ], names=["id", "n_words", "runs", "collapsed"])

    return own.mapInArrow(run, schema)


def longest_run(runs: str = "runs") -> Column:
    """The run of greatest length (ties: smallest start, then period); null where there is none."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(ranked)
