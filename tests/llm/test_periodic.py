"""Periodic runs against trying every period, and the query against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallyworks.llm import periodic
from tallyworks.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def every_period(words, least=6, periods=4):
    """All runs, by comparing the words at every distance."""
    size, found = len(words), {}
    for period in range(1, size // periods + 1):
        at = 0
        while at + period < size:
            end = at
            while end + period < size and words[end] == words[end + period]:
                end += 1
            length = end + period - at
            if end > at and length >= max(least, periods * period) and (at, length) not in found:
                found[at, length] = period
            at = max(end, at + 1)
    return sorted(((start, length, period) for (start, length), period in found.items()), key=lambda run: (run[0], run[2]))


def collapsed(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(word for i, word in enumerate(words) if i not in gone)


def words_with_runs(draw):
    letters = draw.choice([1, 2, 3, 4, 30])
    words = [f"w{draw.randrange(letters)}" for _ in range(draw.randrange(0, 90))]
    for _ in range(draw.randrange(3)):
        if len(words) > 8:
            period, start = draw.randrange(1, 7), draw.randrange(len(words) - 6)
            for at in range(start + period, min(len(words), start + period * draw.randrange(3, 9))):
                words[at] = words[at - period]
    return words


@pytest.mark.parametrize("least, periods", [(6, 4), (2, 2), (5, 3)])
def test_runs_against_every_period(least, periods):
    draw = random.Random(least)
    for _ in range(600):
        words = words_with_runs(draw)
        ids = periodic._numbers([word.encode() for word in words])
        expected = every_period(words, least, periods)
        assert [tuple(run) for run in periodic.runs_of((ids + 1).tolist(), least, periods).tolist()] == expected
        both = periodic._runs_of_texts([ids, ids[::-1], ids[:0]], least, periods)
        assert [tuple(run) for run in both[0].tolist()] == expected and not len(both[2])


@pytest.mark.parametrize("least, periods, window", [(6, 4, 16), (6, 4, 32), (9, 4, 8), (30, 5, 16)])
def test_runs_of_texts_longer_than_a_tree(least, periods, window):
    draw = random.Random(window + least)
    for case in range(150):
        words = [word for _ in range(draw.randrange(1, 5)) for word in words_with_runs(draw)]
        if case % 2:
            period, start = draw.randrange(1, 60), draw.randrange(len(words) + 1)
            unit = [f"w{draw.randrange(3)}" for _ in range(period)]
            words[start:start] = unit * draw.randrange(3, 7) + unit[: draw.randrange(period)]
        ids = periodic._numbers([word.encode() for word in words])
        expected = every_period(words, least, periods)
        both = periodic._runs_of_texts([ids, ids[::-1]], least, periods, window)
        assert [tuple(run) for run in both[0].tolist()] == expected
        assert sorted((len(ids) - start - length, length, period) for start, length, period in both[1].tolist()) == sorted(expected)


def test_a_very_long_text_of_few_words():
    """Its only runs are planted: one of one word over several windows, one of a period longer than a window."""
    draw = np.random.default_rng(3)
    ids = draw.integers(0, 50, 500_000)
    ids[1000:151_000] = 60
    ids[200_000:460_000] = np.resize(ids[200_000:265_000], 260_000)
    ids[[199_999, 460_000]] = 61, 62
    found = [tuple(run) for run in periodic._runs_of_texts([ids], 24, 4, 1 << 14)[0].tolist()]
    assert found == [(1000, 150_000, 1), (200_000, 260_000, 65_000)]


def test_trees_agree_with_comparing():
    draw = random.Random(8)
    for _ in range(60):
        symbols = [draw.randrange(1, 4) for _ in range(draw.randrange(2, 60))]
        tree = periodic.SuffixTree(symbols)
        assert tree.leaves.tolist() == sorted(range(len(symbols) + 1), key=lambda at: [*symbols, 0][at:])
        one, two = np.array([(i, j) for i in range(len(symbols)) for j in range(i)], np.int64).T
        together = [next(k for k in range(len(symbols) + 1) if [*symbols, 0][i + k] != [*symbols, -1][j + k]) for i, j in zip(one, two)]
        assert tree.agree(one, two).tolist() == together


def test_documents(spark, odd, odd_rows):
    found = periodic.periodic_runs(odd).collect()
    assert len(found) == len(odd_rows)
    expected = []
    for doc_id, text, _ in odd_rows:
        words = WORD.findall(text or "")
        runs = [(0, 60_000, 1)] if len(words) == 60_000 else every_period(words)
        expected.append((doc_id, len(words), runs, collapsed(words, runs)))
    got = [(row.doc_id, row.n_words, [tuple(run) for run in row.runs], row.collapsed) for row in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_no_documents(spark, nothing):
    assert periodic.periodic_runs(nothing).collect() == []


def test_the_query_against_plain_python(spark, tmp_path):
    draw = random.Random(3)
    rows = [(row.doc_id, row.text) for row in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows += [(10_000 + i, " ".join(words_with_runs(draw))) for i in range(400)] + [(None, "a b " * 9), (20_000, None), (20_001, "a " * 50), (20_001, "a " * 50)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op12_periodic_runs"](spark, str(tmp_path)).drop("n_words").collect()
    expected, planted = [], 0
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [word if i < a else words[a + (i - a) % p] for i, word in enumerate(words)]
            planted += 1
        runs = every_period(words)
        top = min(runs, key=lambda run: (-run[1], run[0], run[2]), default=None)
        told = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
        digest = lambda held: hashlib.sha256(held.encode()).hexdigest()
        best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        expected.append((doc_id, len(runs), *best, digest(told), digest(collapsed(words, runs))))
    assert planted > 20 and sum(row[1] > 0 for row in expected) > 100
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
