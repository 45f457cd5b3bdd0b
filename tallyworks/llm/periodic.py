"""Runs of periodic words, found by longest common extensions on suffix trees.

Only stretches whose every word occurs often enough within the stretch can hold a run. For these, Ukkonen's algorithm
builds the suffix tree of the words and that of their reversal. The tour through a tree passes the leaves in suffix
order; the least depth it comes through between two leaves is that of their lowest common ancestor, which is how far
the two suffixes agree, and a table of minima over powers of two gives it in constant time. The longest Lyndon word at every
place, in an order of the words and in the opposite one, is the root of all runs there are: extended to both directions by
the two trees, the roots that repeat are the runs.

Trees take about a kilobyte per word, so a very long stretch has trees of overlapping windows. These find every period up
to an eighth of a window. For longer ones all subwords of 2, 4, 8... words are numbered, equal ones alike, by pairs of halves: a run of
period q, at least a power of two P and less than 2P, holds a subword of 2P words at a multiple of P that occurs next q words on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyworks.llm.tasks import for_workers

# A run has this many words at least, and this many times its period.
LEAST_LENGTH = 6
LEAST_PERIODS = 4
# Bytes of text that a task holds as words, and words of short stretches that share a tree.
PIECE = 1 << 21
TOGETHER = 1 << 14
# Rounds of cutting at rare words; what is left then goes to the trees.
ROUNDS = 8
# Words of the longest tree, a power of two; and the least number of periods for which windows find all runs.
WINDOW = 1 << 16
WINDOW_PERIODS = 4

RUNS = "ARRAY<STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>>"


class SuffixTree:
    """Ukkonen's suffix tree of a list of numbers from 1 up, and its leaves' order; 0 is put at the end."""

    def __init__(self, symbols: list[int]):
        self.symbols = [*symbols, 0]
        self.size = len(self.symbols)
        self.width = max(self.symbols) + 1
        self._build()
        self.leaves, self.shared = self._tour(False)
        self.rank = np.empty(self.size, np.int64)
        self.rank[self.leaves] = np.arange(self.size)
        self.minima = [self.shared]
        while 2 << (len(self.minima) - 1) <= self.size:
            last, step = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-step], last[step:]))

    def _build(self) -> None:
        symbols, size, width = self.symbols, self.size, self.width
        begins, ends, links, edges = [0], [0], [0], {}
        node = edge = length = waiting = 0
        for at, symbol in enumerate(symbols):
            unlinked = 0
            waiting += 1
            while waiting:
                if not length:
                    edge = at
                key = node * width + symbols[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(begins)
                    begins.append(at)
                    ends.append(size)
                    links.append(0)
                    if unlinked:
                        links[unlinked] = node
                        unlinked = 0
                else:
                    begin = begins[child]
                    along = min(ends[child], at + 1) - begin
                    if length >= along:
                        edge += along
                        length -= along
                        node = child
                        continue
                    if symbols[begin + length] == symbol:
                        if unlinked:
                            links[unlinked] = node
                        length += 1
                        break
                    middle = len(begins)
                    edges[key] = middle
                    begins += (begin, at)
                    ends += (begin + length, size)
                    links += (0, 0)
                    begins[child] = begin + length
                    edges[middle * width + symbols[begin + length]] = child
                    edges[middle * width + symbol] = middle + 1
                    if unlinked:
                        links[unlinked] = middle
                    unlinked = middle
                waiting -= 1
                if node:
                    node = links[node]
                elif length:
                    length -= 1
                    edge = at - waiting + 1
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        children = np.fromiter(edges.values(), np.int64, len(edges))
        self.parents, self.firsts = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
        self.parents[children], self.firsts[children] = keys // width, keys % width
        self.lengths = np.array(ends) - np.array(begins)

    def _tour(self, opposite: bool) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in order, and how far each agrees with the one before. The end is smallest in either order."""
        order = np.where(self.firsts == 0, 0, self.width - self.firsts) if opposite else self.firsts
        count = len(self.parents)
        # Children of a node side by side, the last one first, so that the first one is on top of the stack.
        held = np.lexsort((-order[1:], self.parents[1:])) + 1
        first = np.searchsorted(self.parents[held], np.arange(count + 1)).tolist()
        held, lengths, parents = held.tolist(), self.lengths.tolist(), self.parents.tolist()
        depths, stack = [0] * count, held[first[0] : first[1]]
        leaves, shared, turned = [], [], True
        while stack:
            node = stack.pop()
            parent = parents[node]
            depth = depths[node] = depths[parent] + lengths[node]
            if turned:
                shared.append(depths[parent])
            begin, end = first[node], first[node + 1]
            if begin == end:
                leaves.append(self.size - depth)
                turned = True
            else:
                stack += held[begin:end]
                turned = False
        return np.array(leaves), np.array(shared, np.int32)

    def agree(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """How far the suffixes at unequal places agree."""
        one, two = self.rank[one], self.rank[two]
        low, high = np.minimum(one, two) + 1, np.maximum(one, two)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        found = np.empty(len(low), np.int64)
        for step in np.unique(level).tolist():
            own = level == step
            found[own] = np.minimum(self.minima[step][low[own]], self.minima[step][high[own] - (1 << step) + 1])
        return found

    def lyndon_ends(self, opposite: bool) -> np.ndarray:
        """Where the longest Lyndon word at each place ends: at the next smaller suffix."""
        rank = self.rank
        if opposite:
            rank = np.empty(self.size, np.int64)
            rank[self._tour(True)[0]] = np.arange(self.size)
        rank, ends, stack = rank.tolist(), [0] * (self.size - 1), [self.size - 1]
        for at in range(self.size - 2, -1, -1):
            own = rank[at]
            while rank[stack[-1]] > own:
                stack.pop()
            ends[at] = stack[-1]
            stack.append(at)
        return np.array(ends, np.int64)


def runs_of(symbols: list[int], least: int = LEAST_LENGTH, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows ``start, length, period`` of all runs of a list of numbers from 1 up, in order of start, then period."""
    size = len(symbols)
    if size < 2:
        return np.empty((0, 3), np.int64)
    forth, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    found = []
    for opposite in (False, True):
        ends = forth.lyndon_ends(opposite)
        starts = np.arange(size)
        starts, ends = starts[ends < size], ends[ends < size]
        # From the places before both: the reversal has place at as size - 1 - at.
        left, right = back.agree(size - starts, size - ends), forth.agree(starts, ends)
        period = ends - starts
        length = period + left + right
        own = length >= np.maximum(least, max(periods, 2) * period)
        found.append(np.column_stack((starts - left, length, period))[own])
    found = np.unique(np.concatenate(found), axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def stretches(ids: np.ndarray, least: int, periods: int) -> Iterator[tuple[int, int]]:
    """Begin and end of the stretches that may hold runs: in a run, every word occurs ``periods`` times."""
    at = np.arange(len(ids))
    for _ in range(ROUNDS):
        part = np.concatenate(([0], np.cumsum(np.diff(at) > 1)))
        _, back, times = np.unique(part * (int(ids.max(initial=0)) + 1) + ids[at], return_inverse=True, return_counts=True)
        kept = (times[back] >= periods) & (np.bincount(part)[part] >= least)
        if kept.all():
            break
        at = at[kept]
        if not len(at):
            return
    cuts = np.flatnonzero(np.diff(at) > 1) + 1
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
        if end - begin >= least:
            yield int(at[begin]), int(at[end - 1]) + 1


def _ahead(ids: np.ndarray, at: int, period: int) -> int:
    """How many words from a place on equal the word a period later."""
    begin, step = at, 1 << 10
    while at < len(ids) - period:
        end = min(at + step, len(ids) - period)
        unlike = ids[at:end] != ids[at + period : end + period]
        if unlike.any():
            return at - begin + int(unlike.argmax())
        at, step = end, 2 * step
    return at - begin


def _numbered_subwords(ids: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each power of two from ``length`` to a third of the text: it, and numbers of the subwords of twice as many words."""
    _, numbers = np.unique(ids, return_inverse=True)
    half = 1
    while half <= len(ids) // 3:
        _, numbers = np.unique(numbers[:-half] * (int(numbers.max()) + 1) + numbers[half:], return_inverse=True)
        if half >= length:
            yield half, numbers
        half *= 2


def runs_of_long(ids: np.ndarray, least: int, periods: int, window: int) -> np.ndarray:
    """As ``runs_of`` for any numbers and ``WINDOW_PERIODS`` periods or more, with trees of ``window`` words at most."""
    size, backward = len(ids), ids[::-1]
    found: list[tuple[int, int, int]] = []
    last: dict[int, tuple[int, int]] = {}

    def add(start: int, period: int) -> None:
        """The whole run that has a period at a place, unless that was the last one found with the period."""
        begin, end = last.get(period, (0, 0))
        if begin <= start and start + period <= end:
            return
        begin, end = start - _ahead(backward, size - start - period, period), start + period + _ahead(ids, start, period)
        if end - begin >= max(least, periods * period):
            last[period] = begin, end
            found.append((begin, end - begin, period))

    for begin in range(0, size - window // 2, window // 2):
        for start, _, period in _runs_of_texts([ids[begin : begin + window]], min(least, window // 2), WINDOW_PERIODS, window)[0].tolist():
            add(begin + start, period)
    last.clear()
    for power, numbers in _numbered_subwords(ids, window // 8):
        order = np.argsort(numbers, kind="stable")
        following = np.full(len(numbers), -1)
        again = np.flatnonzero(np.diff(numbers[order]) == 0)
        following[order[again]] = order[again + 1]
        places = np.arange(0, len(numbers), power)
        period = following[places] - places
        own = (period >= power) & (period < 2 * power)
        for start, length in zip(places[own].tolist(), period[own].tolist()):
            add(start, length)
    return np.unique(np.array(found, np.int64).reshape(-1, 3), axis=0)


def _runs_of_texts(texts: list[np.ndarray], least: int, periods: int, window: int = WINDOW) -> list[np.ndarray]:
    """The runs of several texts, each an array of numbers from 0 up. Short stretches share a tree, with a number of its own after each.

    Rows are in order of start, then period.
    """
    found: list[list[np.ndarray]] = [[] for _ in texts]
    waiting: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def solve() -> None:
        free = max(int(ids.max()) for _, _, ids in waiting) + 2
        symbols, begins = [], []
        for number, (_, _, ids) in enumerate(waiting):
            begins.append(len(symbols))
            symbols += (ids + 1).tolist()
            symbols.append(free + number)
        runs = runs_of(symbols[:-1], least, periods)
        owner = np.searchsorted(begins, runs[:, 0], "right") - 1
        for number in np.unique(owner).tolist():
            text, begin, _ = waiting[number]
            found[text].append(runs[owner == number] + [begin - begins[number], 0, 0])
        waiting.clear()

    for text, ids in enumerate(texts):
        if len(ids) < least:
            continue
        for begin, end in stretches(ids, least, periods):
            if end - begin > window and periods >= WINDOW_PERIODS:
                found[text].append(runs_of_long(ids[begin:end], least, periods, window) + [begin, 0, 0])
                continue
            waiting.append((text, begin, ids[begin:end]))
            held += end - begin
            if held >= TOGETHER:
                solve()
                held = 0
    if waiting:
        solve()
    joined = [np.concatenate(rows) if rows else np.empty((0, 3), np.int64) for rows in found]
    return [rows[np.lexsort((rows[:, 2], rows[:, 0]))] for rows in joined]


def _numbers(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter([known.setdefault(word, len(known)) for word in words], np.int64, len(words))


def periodic_runs(docs: DataFrame, least: int = LEAST_LENGTH, periods: int = LEAST_PERIODS) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every document.

    ``docs`` has ``doc_id, text``; other columns are dropped. A run is a stretch of words with smallest period q
    and at least ``least`` words and ``periods`` (2 or more) times q that neither neighbour extends; ``runs`` has its ``start`` by word
    number, ``length`` and ``period``, by start, then period. ``collapsed`` is the text with one blank between words and without
    those that a run has after its first q. Null text, and text without words, has no runs and collapses to an empty text.
    Repeated rows and rows without ``doc_id`` are documents of their own; an empty table gives an empty one.

    A task holds some of a batch's texts as words, and trees of ``WINDOW`` words, however long a text is. With fewer than
    ``WINDOW_PERIODS`` periods asked for, trees are as long as the longest stretch that may hold runs.
    """
    for_workers(docs.sparkSession)
    if periods < 2:
        raise ValueError("a run repeats its period")
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else []
            begin, size = 0, 0
            for at, own in enumerate(sizes):
                size += int(own)
                if size >= PIECE or at == len(sizes) - 1:
                    yield piece(batch.column("doc_id")[begin : at + 1], texts[begin : at + 1].to_pylist())
                    begin, size = at + 1, 0

    def piece(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        # Bytes are split at the separators of words, and only there.
        words = [text.split() for text in texts]
        runs = _runs_of_texts([_numbers(own) for own in words], least, periods)
        for place, found in enumerate(runs):
            if len(found):
                edges = np.zeros(len(words[place]) + 1, np.int64)
                np.add.at(edges, found[:, 0] + found[:, 2], 1)
                np.add.at(edges, found[:, 0] + found[:, 1], -1)
                texts[place] = b" ".join(compress(words[place], np.cumsum(edges[:-1]) == 0))
            else:
                texts[place] = b" ".join(words[place])
        rows = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
        fields = [pa.array(np.ascontiguousarray(rows[:, at])) for at in range(3)]
        offsets = np.concatenate(([0], np.cumsum([len(found) for found in runs]))).astype(np.int32)
        held = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        counts = pa.array([len(own) for own in words], pa.int64())
        return pa.RecordBatch.from_arrays([ids, counts, held, pa.array(texts, pa.binary()).cast(pa.string())], names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(searched, f"doc_id BIGINT, n_words BIGINT, runs {RUNS}, collapsed STRING")
