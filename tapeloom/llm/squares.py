"""Runs of repeated word sequences in whole texts, found online by catchers over power-of-two blocks.

On level k a completed block of M = 2^(k-1) words (one word on the two lowest levels) has a catcher for the periods from
2^k to 2^(k+1) - 1. Whatever has such a period p and length 2p holds a whole block in its first p words, and the block
again p words later. So each appended word ends one window of M words per level, which asks the few catchers in reach
whether it equals their block. Equal neighbouring blocks of one period join; when the next block differs, word by word
suffix comparison at both ends gives the square's whole run. Windows are named by hashes of their halves, and the words
of every reported run are compared.

Multiples of a run's period lie inside that run, which a lower level reports no later than they end; so they are dropped.
All work is numpy over the words appended at once; how words are dealt over calls does not change the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import by_bytes

#: Words appended to the catchers of a stream at once.
APPEND = 65_536

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_HALF = np.uint64(32)


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    both = left * _A + (right ^ (right >> _HALF)) * _B
    return (both ^ (both >> _HALF)) * _C


class _Level:
    """Open stretches of one level: words [low, high) equal the words ``period`` later, all in whole blocks."""

    def __init__(self, k: int):
        self.least, self.block, self.name = 1 << k, 1 << max(0, k - 1), max(0, k - 1)
        self.period = self.low = self.high = np.empty(0, dtype=np.int64)


class Catchers:
    """Runs of a stream of word numbers: ``append`` words, then ``finish``; ``runs`` are (start, end, period).

    A run has length ``least_length`` or more, holds its smallest period ``exponent`` times or more, and no neighbouring
    word extends it. ``longest`` bounds its length, if that is known.
    """

    def __init__(self, least_length: int = 24, exponent: int = 3, longest: int | None = None):
        assert exponent >= 2, exponent
        self.least_length, self.exponent, self.longest = least_length, exponent, longest
        self.words, self.n = np.empty(1024, dtype=np.int64), 0
        self.names: list[np.ndarray] = []  # by size 2^j: hash of the window that starts at base + i
        self.base: list[int] = []
        self.levels: list[_Level] = []
        self.runs: list[tuple[int, int, int]] = []
        self._starts, self._reach, self._whose = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def append(self, words: np.ndarray) -> None:
        before, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            self.words = np.concatenate([self.words[:before], np.empty(max(self.n, 2 * before) - before, dtype=np.int64)])
        self.words[before : self.n] = words
        while self._wanted(len(self.levels)):
            self.levels.append(_Level(len(self.levels)))
        for level in self.levels:
            self._name(level.name, before)
            self._catch(level, before)
        for j, names in enumerate(self.names):
            old = max(0, self.n - (6 << j) - self.base[j])
            self.names[j], self.base[j] = names[old:].copy() if old else names, self.base[j] + old

    def finish(self) -> list[tuple[int, int, int]]:
        for level in self.levels:
            self._close(level, np.ones(len(level.period), dtype=bool))
        return sorted(self.runs)

    def _wanted(self, k: int) -> bool:
        least, block = 1 << k, 1 << max(0, k - 1)
        return least + block <= self.n and (self.longest is None or self.exponent * least <= self.longest)

    def _name(self, j: int, before: int) -> None:
        """Brings the names of windows of 2^j words up to the last complete window."""
        size = 1 << j
        if j == len(self.names):
            self.names.append(np.empty(0, dtype=np.uint64))
            self.base.append(0)
        known = self.base[j] + len(self.names[j])
        stop = self.n - size + 1
        if known >= stop:
            return
        if j == 0:
            fresh = _mix(self.words[known:stop].astype(np.uint64), np.uint64(1))
        else:
            halves, base, half = self.names[j - 1], self.base[j - 1], size // 2
            fresh = _mix(halves[known - base : stop - base], halves[known + half - base : stop + half - base])
        self.names[j] = np.concatenate([self.names[j], fresh])

    def _catch(self, level: _Level, before: int) -> None:
        """Asks the catchers in reach about each window that the appended words complete."""
        names, base, size, least = self.names[level.name], self.base[level.name], level.block, level.least
        at = np.arange(max(least, before - size + 1), self.n - size + 1, dtype=np.int64)
        parts = [(level.period, level.low, level.high)]
        for t in range(least // size):
            block = ((at - least) // size - t) * size
            here, there = (at, block) if t == 0 else (at[block >= 0], block[block >= 0])
            same = names[here - base] == names[there - base]
            here, there = here[same], there[same]
            parts.append((here - there, there, there + size))
        period, low, high = (np.concatenate(x) for x in zip(*parts))
        if len(period):
            order = np.lexsort((low, period))
            period, low, high = period[order], low[order], high[order]
            first = np.ones(len(period), dtype=bool)
            first[1:] = (period[1:] != period[:-1]) | (low[1:] != high[:-1])
            last = np.append(first[1:], True)
            level.period, level.low, level.high = period[first], low[first], high[last]
            # one block longer than the next block takes: by then every lower level has closed what ends here
            self._close(level, level.high + 2 * size + level.period <= self.n)

    def _close(self, level: _Level, done: np.ndarray) -> None:
        """Reports the runs of stretches that cannot grow by a whole block."""
        if not done.any():
            return
        period, low, high = level.period[done], level.low[done], level.high[done]
        level.period, level.low, level.high = level.period[~done], level.low[~done], level.high[~done]
        need = np.maximum(self.least_length, self.exponent * period)
        able = high - low + 2 * (level.block - 1) + period >= need
        period, low, high, need = period[able], low[able], high[able], need[able]
        if len(self._starts) and len(period):
            at = np.searchsorted(self._starts, low, side="right") - 1
            inside = (at >= 0) & (self._reach[at] >= high + period) & (period % self._whose[at] == 0)
            period, low, high, need = period[~inside], low[~inside], high[~inside], need[~inside]
        found = set()
        for p, a, b, least in zip(period.tolist(), low.tolist(), high.tolist(), need.tolist()):
            found.update(self._run(p, a, b, level.block, least))
        if found:
            ends = {(s, e) for s, e, _ in self.runs}
            self.runs.extend(x for x in sorted(found) if x[:2] not in ends)
            runs = np.array(sorted(self.runs), dtype=np.int64)
            self._starts, self._reach = runs[:, 0], np.maximum.accumulate(runs[:, 1])
            self._whose = runs[np.searchsorted(self._reach, self._reach, side="left"), 2]

    def _run(self, p: int, low: int, high: int, block: int, need: int) -> list[tuple[int, int, int]]:
        """The run of period ``p`` around words [low, high), extended by suffix comparisons of less than a block."""
        words = self.words
        after, partner = words[high : min(high + block, self.n - p)], words[high + p : min(high + p + block, self.n)]
        differs = np.flatnonzero(after != partner)
        high += int(differs[0]) if len(differs) else len(after)
        start = max(0, low - block)
        differs = np.flatnonzero(words[start:low] != words[start + p : low + p])
        low = start + int(differs[-1]) + 1 if len(differs) else start
        if high + p - low < need:
            return []
        unlike = np.flatnonzero(words[low:high] != words[low + p : high + p])  # none but where hashes collide
        edges = [low - 1, *(unlike + low).tolist(), high]
        return [(a + 1, b + p, p) for a, b in zip(edges, edges[1:]) if b + p - a - 1 >= need]


def numbers(words: list) -> np.ndarray:
    """Words as numbers, equal for equal words."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))


def runs_of(texts: list[list[bytes]], least_length: int = 24, exponent: int = 3, append: int = APPEND) -> list[list[tuple[int, int, int]]]:
    """Sorted (start, length, period) of each text's runs; texts of similar length share a stream, one after the other."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    classes: dict[int, list[int]] = {}
    for k, words in enumerate(texts):
        if len(words) >= max(least_length, exponent):
            classes.setdefault((len(words).bit_length() + 1) // 2, []).append(k)
    for members in classes.values():
        stream: list = []
        starts = []
        for k in members:
            starts.append(len(stream))
            stream.extend(texts[k])
            stream.append(k)  # no word equals it, so that no run passes it
        ids, catchers = numbers(stream), Catchers(least_length, exponent, max(len(texts[k]) for k in members))
        for low in range(0, len(ids), append):
            catchers.append(ids[low : low + append])
        for start, end, period in catchers.finish():
            at = int(np.searchsorted(starts, start, side="right")) - 1
            out[members[at]].append((start - starts[at], end - start, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 24, exponent: int = 3) -> DataFrame:
    """Per row: doc_id, ``n_words``, ``runs`` (start, length and period in words, by start, then period), ``collapsed``.

    A run is a longest stretch of words with smallest period q, of ``least_length`` words and ``exponent`` times q or
    more. ``collapsed`` is the text without the words that follow a run's first q words, joined by one space. Null and
    empty texts have no words and an empty one. Repeated rows come back as often as given; other columns are not read.
    One pass without a shuffle; a task holds a few megabytes of texts, or one text, and work grows with n log n words.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    key = rows.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            texts = [(value or "").encode().split() for value in batch.column(1).to_pylist()]
            runs = runs_of(texts, least_length, exponent)
            shown = pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs], run_type)
            left = pa.array([collapsed(w, r) for w, r in zip(texts, runs)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in texts], pa.int64()), shown, left], names=["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"doc_id {key}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
