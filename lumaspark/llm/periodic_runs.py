"""Periodic runs of words by online dyadic square catching.

A run is a stretch of words with a smallest period q, at least max(12, 2 q) long, that no neighbour extends. It is
a longest streak of places whose word equals the word q before. `SquareCatcher` takes words as they come:

* Periods below 15: a counter per period advances with each word and says since when words have repeated at that distance.
* Longer periods: a streak of q from 2 B - 1 to 4 B - 2 covers an aligned block of B words, B a power of two. Once a block
  is complete, a catcher is set up for each place at such a distance before it that holds the same B words; equal blocks
  are told by exact names of word sequences, doubled level by level, and only places whose name occurs again go on. The
  catcher's comparisons advance to the left at once and to the right with each word that is appended; blocks next
  to each other that repeat at one distance share a catcher. A streak of q words is a square, and squares of one streak
  merge into its run. Inside a known run of a short period nothing is set up, as it would only find multiples of that period.

Streaks with the same stretch belong to one run, whose period is the smallest. All comparisons are of words, none of
hashes. Documents are joined by words that occur nowhere else and go through one catcher together, as no streak can
cross such a word; a task holds one batch of words, or one document. One scan, no shuffle.

Words are runs of anything but the six ASCII blanks. Null and empty texts have no words and no runs. Rows of null
or repeated ids are treated one by one. An empty table gives an empty result. Texts of any length are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaspark.llm.tables import once, small_batches, text_of

LEAST = 12
SHORT = 14  # periods up to here have counters
STEPS = 32  # words that catchers advance together
FIRST_BLOCK = 8  # blocks for periods from 15 on
BATCH_WORDS = 400_000
RUNS_SQL = "array<struct<start: long, length: long, period: long>>"

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_NONE = np.empty(0, np.int64)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] times, for all i."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


class SquareCatcher:
    """The runs of a growing sequence of whole numbers."""

    def __init__(self, least: int = LEAST):
        self.least, self.n, self._data = least, 0, np.empty(1024, np.int64)
        self._found = [np.empty((0, 3), np.int64)]  # closed streaks: period, start, end
        self._counters = {}  # start of the streak that the last word is in, by short period
        self._open = np.empty((0, 2), np.int64)  # catchers whose streak the last word is in: period, start

    def append(self, words: np.ndarray) -> None:
        n0, self.n = self.n, self.n + len(words)
        if self.n > len(self._data):
            self._data = np.concatenate([self._data[:n0], np.empty(max(self.n, n0 * 2) - n0, np.int64)])
        self._data[n0:self.n] = words
        for q in range(1, SHORT + 1):
            self._count(q, max(n0, q))
        if len(self._open):
            q, start = self._open.T
            self._settle(q, start, self._right(np.full(len(q), n0), q))
        self._catch(n0)

    def runs(self) -> np.ndarray:
        """Runs of all words so far, with columns start, length and period, by start and length."""
        still = [(q, s, self.n) for q, s in [*self._counters.items(), *self._open.tolist()]]
        q, start, end = np.unique(np.concatenate([*self._found, np.array(still, np.int64).reshape(-1, 3)]), axis=0).T
        kept = self._enough(q, start, end)
        q, start, end = q[kept], start[kept] - q[kept], end[kept]
        order = np.lexsort((q, end, start))
        q, start, end = q[order], start[order], end[order]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        return np.stack([start, end - start, q], axis=1)[fresh]

    def _enough(self, q, start, end):
        return end - start >= np.maximum(self.least - q, q)

    def _count(self, q: int, n0: int) -> None:
        """Advances the counter of a short period over the words from n0 on."""
        t, n = self._data, self.n
        if n <= n0:
            return
        at = np.flatnonzero(t[n0:n] == t[n0 - q:n - q]) + n0
        before = self._counters.pop(q, None)
        if len(at):
            cut = np.flatnonzero(np.diff(at) != 1)
            start, end = at[np.concatenate(([0], cut + 1))], at[np.append(cut, len(at) - 1)] + 1
        else:
            start = end = _NONE
        if before is not None:
            if len(start) and start[0] == n0:
                start[0] = before
            else:
                start, end = np.append(start, before), np.append(end, n0)
                order = np.argsort(start)
                start, end = start[order], end[order]
        if len(end) and end[-1] == n:
            self._counters[q] = int(start[-1])
            start, end = start[:-1], end[:-1]
        kept = self._enough(q, start, end)
        self._found.append(np.stack([np.full(kept.sum(), q), start[kept], end[kept]], axis=1))

    def _settle(self, q: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Files streaks as closed or, where they reach the last word, as open."""
        still = end == self.n
        kept = ~still & self._enough(q, start, end)
        self._found.append(np.stack([q[kept], start[kept], end[kept]], axis=1))
        self._open = np.stack([q[still], start[still]], axis=1)

    def _right(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The first place from `at` on whose word differs from that q before."""
        return self._stretch(at, q, 1)

    def _left(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The start of the streak that `at` is in, or would be."""
        return self._stretch(at - 1, q, -1) + 1

    def _stretch(self, at: np.ndarray, q: np.ndarray, way: int) -> np.ndarray:
        t, n, at, live, painted = self._data, self.n, at.copy(), np.arange(len(at)), None
        while True:
            for _ in range(STEPS):  # all catchers together, a word at a time
                live = live[(at[live] < n) & (at[live] >= q[live])]
                live = live[t[at[live]] == t[at[live] - q[live]]]
                if not len(live):
                    return at
                at[live] += way
            if len(live) < STEPS:
                break
            live = live[(at[live] < n) & (at[live] >= q[live])]
            painted = self._paint() if painted is None else painted
            jump = self._jump(at[live], q[live], way, *painted)
            at[live] += way * jump
            if not jump.any():
                break
        for i in live.tolist():  # the rest one by one, in growing steps
            here, d, step = int(at[i]), int(q[i]), 64
            while True:
                lo, hi = (here, min(here + step, n)) if way > 0 else (max(here + 1 - step, d), here + 1)
                if lo >= hi:
                    break
                bad = np.flatnonzero(t[lo:hi] != t[lo - d:hi - d])
                if len(bad):
                    here = lo + int(bad[0] if way > 0 else bad[-1])
                    break
                here, step = (hi if way > 0 else lo - 1), min(step * 2, 1 << 16)
            at[i] = here
        return at

    def _paint(self) -> tuple[np.ndarray, np.ndarray]:
        """Known long runs of periods up to STEPS, and which of them each word is in."""
        still = [(q, s, self.n) for q, s in self._counters.items()]
        runs = np.concatenate([*self._found, np.array(still, np.int64).reshape(-1, 3)])
        runs = runs[(runs[:, 0] <= STEPS) & (runs[:, 2] - runs[:, 1] >= 2 * STEPS)]
        runs = runs[np.lexsort((-runs[:, 0], runs[:, 2] - runs[:, 1]))]
        where = np.full(self.n, -1, np.int32)
        for i, (q, start, end) in enumerate(runs.tolist()):
            where[start - q:end] = i
        return runs, where

    def _jump(self, at: np.ndarray, q: np.ndarray, way: int, runs: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Words that a catcher may pass at once: its last STEPS words agreed, so while both of its sides stay in runs of one period, they agree."""
        if not len(runs):
            return np.zeros(len(at), np.int64)
        a, b = where[at], where[at - q]
        fits = (a >= 0) & (b >= 0) & (runs[a, 0] == runs[b, 0])
        period, back = runs[a, 0], at - q
        if way > 0:
            fits &= (runs[a, 1] <= at) & (runs[b, 1] <= back)  # a run starts a period before its streak
            room = np.minimum(runs[a, 2] - at, runs[b, 2] - back)
        else:
            fits &= (runs[a, 2] > at + period) & (runs[b, 2] > back + period)
            room = np.minimum(at - runs[a, 1] + period, back - runs[b, 1] + period) + 1
        return np.where(fits, room, 0)

    def _covers(self, block: int, low: int) -> np.ndarray:
        """For each complete block from place `low` on, the leftmost start of a known run with a period of at most the block that holds it."""
        still = [(q, s, self.n) for q, s in [*self._counters.items(), *self._open.tolist()]]
        q, start, end = np.concatenate([*self._found, np.array(still, np.int64).reshape(-1, 3)]).T
        kept = (q <= block) & (end > low) & self._enough(q, start, end)
        start, end = start[kept] - q[kept], end[kept]
        first, last = np.maximum(-(-start // block), low // block), end // block
        count = np.maximum(last - first, 0)
        out = np.full(max(self.n // block - low // block, 0), self.n)
        np.minimum.at(out, _ranges(first, count) - low // block, np.repeat(start, count))
        return out

    def _catch(self, n0: int) -> None:
        """Catchers for the blocks that the words from n0 on complete."""
        t, n = self._data, self.n
        blocks, block = [], FIRST_BLOCK
        while 4 * block - 2 <= n:
            if n // block > n0 // block:
                blocks.append(block)
            block *= 2
        if not blocks:
            return
        top = blocks[-1]
        base = max(0, n0 // top * top - 4 * top + 2)
        name, at, width = t[base:n], np.arange(base, n), 1  # names of the places `at`; all others occur once
        table = np.full(n - base, -1)
        while True:
            _, name, count = np.unique(name, return_inverse=True, return_counts=True)
            again = count[name] > 1
            at, name = at[again], name[again]
            if not len(at):
                return
            if width in blocks:
                self._set_up(width, n0, at, name)
            if width == top:
                return
            table[:] = -1
            table[at - base] = name
            kept = at + width < n
            at, name = at[kept], name[kept]
            follow = table[at + width - base]
            kept = follow >= 0
            at, name, width = at[kept], name[kept] * (n - base) + follow[kept], width * 2

    def _set_up(self, block: int, n0: int, at: np.ndarray, name: np.ndarray) -> None:
        low = n0 // block * block
        mine = (at % block == 0) & (at >= low)
        if not mine.any():
            return
        n, start, mine = self.n, at[mine], name[mine]
        keys = np.sort(name * n + at)
        limit = np.minimum(start - 2 * block + 1, self._covers(block, low)[(start - low) // block] - 1)
        first = np.searchsorted(keys, mine * n + np.maximum(start - 4 * block + 2, 0), "left")
        last = np.searchsorted(keys, mine * n + limit, "right")
        count = np.where(limit >= 0, np.maximum(last - first, 0), 0)
        if not count.any():
            return
        start = np.repeat(start, count)
        q = start - keys[_ranges(first, count)] % n
        order = np.lexsort((start, q))
        q, start = q[order], start[order]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (start[1:] - start[:-1] != block)
        head, tail = np.flatnonzero(fresh), np.append(np.flatnonzero(fresh)[1:], len(q)) - 1
        q, left, right = q[head], self._left(start[head], q[head]), self._right(start[tail] + block, q[head])
        before = self._open
        self._settle(q, left, right)
        self._open = np.unique(np.concatenate([before, self._open]), axis=0)


def runs_of(words: list[bytes], least: int = LEAST, piece: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one document, read in pieces of so many words."""
    catcher, ids = SquareCatcher(least), _ids(words)
    for i in range(0, len(ids), piece or max(1, len(ids))):
        catcher.append(ids[i:i + (piece or len(ids))])
    return [tuple(r) for r in catcher.runs().tolist()]


def _ids(words: list[bytes]) -> np.ndarray:
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _solve(docs: list[tuple], least: int) -> pa.RecordBatch:
    """The rows of (doc_id, words) pairs."""
    size = np.array([len(words) for _, words in docs])
    base = np.cumsum(size + 1) - size - 1
    ids, high = np.empty(int(size.sum()) + len(docs), np.int64), 0
    for (_, words), b in zip(docs, base.tolist(), strict=True):
        ids[b:b + len(words)] = _ids(words) + high
        ids[b + len(words)] = high + len(words)  # a word of its own ends each document
        high += len(words) + 1
    catcher = SquareCatcher(least)
    catcher.append(ids)
    runs = catcher.runs()
    start, length, period = runs.T
    depth = np.zeros(len(ids) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    kept = np.cumsum(depth[:-1]) == 0
    doc = np.searchsorted(base, start, side="right") - 1
    cut = np.searchsorted(doc, np.arange(len(docs) + 1))
    runs[:, 0] -= base[doc]
    texts = []
    for (_, words), b, some in zip(docs, base.tolist(), np.diff(cut).tolist(), strict=True):
        if some:
            words = [words[i] for i in np.flatnonzero(kept[b:b + len(words)]).tolist()]
        texts.append(b" ".join(words))
    items = pa.StructArray.from_arrays([pa.array(c) for c in runs.T], fields=list(_RUNS.value_type))
    return pa.RecordBatch.from_arrays([
        pa.array([d for d, _ in docs], pa.int64()), pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), items).cast(_RUNS),
        pa.array(texts, pa.binary()).cast(pa.string()),
    ], names=["doc_id", "n_words", "runs", "collapsed"])


def _find(least: int, batch_words: int):
    def run(batches):
        docs, n = [], 0
        for batch in batches:
            for doc, body in zip(batch.column("doc").to_pylist(), batch.column("body").to_pylist(), strict=True):
                docs.append((doc, body.split()))
                n += len(docs[-1][1]) + 1
                if n >= batch_words:
                    yield _solve(docs, least)
                    docs, n = [], 0
        if docs:
            yield _solve(docs, least)

    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text", least: int = LEAST, batch_words: int = BATCH_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (structs of start, length and period, in words, by start, then
    period) and collapsed, the text with each run cut to its first period, words joined by single spaces."""
    small_batches(docs.sparkSession)
    text = text_of(text_col) if isinstance(text_col, str) else F.coalesce(text_col.cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.encode(text, "utf-8").alias("body"))
    found = rows.mapInArrow(_find(least, batch_words), f"doc_id long, n_words long, runs {RUNS_SQL}, collapsed string")
    return found.withColumn("runs", F.array_sort("runs", _by_start_and_period))


def _by_start_and_period(a: Column, b: Column) -> Column:
    def key(r):
        return F.struct(r["start"], r["period"])

    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def longest_run(runs: Column) -> Column:
    """The run of greatest length, on ties that of the smallest start, then period; null without runs."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))


def with_periodic_tail(doc_id: Column, text: Column) -> Column:
    """The text, for a tenth of all ids (by their CRC-32) with a tail that repeats: known runs for tests and the registered query."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def tail(words):
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        rest = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.concat_ws(" ", F.slice(words, F.lit(1), a.cast("int")), rest)).otherwise("")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, once(words, tail)).otherwise(text)
