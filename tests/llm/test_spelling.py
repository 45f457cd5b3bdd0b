"""Spelling variants against comparing all words, and the query against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyworks.llm import spelling
from tallyworks.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def one_edit(one, two):
    """Whether one code point inserted, deleted or replaced turns one word into the other."""
    if one == two or abs(len(one) - len(two)) > 1:
        return False
    if len(one) == len(two):
        return sum(x != y for x, y in zip(one, two)) == 1
    one, two = sorted((one, two), key=len)
    return any(two[:at] + two[at + 1 :] == one for at in range(len(two)))


def edits(word, alphabet):
    for at in range(len(word) + 1):
        if at < len(word):
            yield word[:at] + word[at + 1 :]
        for letter in alphabet:
            yield word[:at] + letter + word[at:]
            if at < len(word):
                yield word[:at] + letter + word[at + 1 :]


def by_editing(counts, times=5):
    """The result by trying every edit of every word."""
    alphabet, near, forms = sorted(set("".join(counts))), {}, {}
    for word, n in counts.items():
        near[word] = {other for other in edits(word, alphabet) if other in counts and other != word}
        best = min(near[word], key=lambda other: (-counts[other], other), default=None)
        forms[word] = best if best is not None and counts[best] >= times * n else None
    found = []
    for word, n in counts.items():
        root = word
        while forms[root] is not None:
            root = forms[root]
        form = forms[word]
        found.append((word, form, root, n, len(near[word]), counts[form] if form else None))
    return sorted(found)


def vocabulary(draw, size, letters="abc"):
    counts = {}
    while len(counts) < size:
        word = "".join(draw.choice(letters) for _ in range(draw.randrange(0, 9)))
        counts[word] = draw.choice([1, 2, 5, 25, 30, 125, 700, 4000])
    return counts


def found_for(spark, rows, **options):
    frame = spark.createDataFrame([(*row, "x") for row in rows], "word string, n bigint, form string").repartition(4)
    return sorted(map(tuple, spelling.spelling_variants(frame, **options).collect()))


def test_matrices_against_the_definition():
    draw = random.Random(1)
    for length, longer in [(0, 1), (1, 1), (1, 2), (4, 4), (4, 5), (7, 7), (7, 8)]:
        words = [sorted({"".join(draw.choice("ab") for _ in range(size)) for _ in range(60)}) for size in (length, longer)]
        i, j = spelling.near_pairs(*[spelling.code_points(held, len(held[0])) for held in words])
        expected = {(a, b) for a, one in enumerate(words[0]) for b, two in enumerate(words[1]) if one_edit(one, two)}
        assert set(zip(i.tolist(), j.tolist())) == expected and len(i) == len(expected)


@pytest.mark.parametrize("block", [4096, 3])
def test_against_all_edits(spark, block):
    """Also where every half is split into blocks of three words."""
    draw = random.Random(block)
    counts = vocabulary(draw, 500, "abcé漢") | vocabulary(draw, 100, "ab") | {"prefixed" + a + b: 7 for a in "abcdefgh" for b in "abcdefgh"}
    assert found_for(spark, counts.items(), block=block) == by_editing(counts)


def test_odd_words(spark):
    long = "x" * 100_000
    rows = [(None, 5), ("", 100), ("a", 10), ("a", 10), ("b", 0), ("c", None), ("d", -3), (long, 9), (long + "y", 60), (long[:-1] + "z", 9), ("𝄞ab", 5), ("𝄞a", 25)]
    expected = [
        ("", None, "", 100, 1, None),
        ("a", "", "", 20, 1, 100),
        (long, long + "y", long + "y", 9, 2, 60),
        (long[:-1] + "z", None, long[:-1] + "z", 9, 1, None),
        (long + "y", None, long + "y", 60, 1, None),
        ("𝄞a", None, "𝄞a", 25, 2, None),
        ("𝄞ab", "𝄞a", "𝄞a", 5, 1, 25),
    ]
    # "a" and the word of two code points differ by one as well.
    expected[1] = ("a", "", "", 20, 2, 100)
    assert found_for(spark, rows) == sorted(expected)
    assert found_for(spark, []) == []
    with pytest.raises(ValueError):
        found_for(spark, rows, times=1)


def test_roots_of_long_chains(spark):
    counts = {"a" * size: 5**size for size in range(1, 20)}
    found = found_for(spark, counts.items())
    assert {row[2] for row in found} == {"a" * 19} and found == by_editing(counts)


def test_the_query_against_plain_python(spark, tmp_path):
    rows = [(row.doc_id, row.text) for row in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows += [(None, "Wörterbuch ÀÉÎõü× " * 9), (5000, None), (5001, ""), (5002, "common" * 30_000 + " Commonly " * 400), (5002, "commonly9commonl " * 40)]
    rows += [(6000 + i, "variants " * 200) for i in range(20)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    counts, lost = Counter(), 0
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda letter: letter[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run, lost = run[: h % len(run)] + run[h % len(run) + 1 :], lost + 1
            counts[run] += 1
    counts = {word: n for word, n in counts.items() if len(word) >= 6 and n >= 5}
    found = sorted(map(tuple, QUERIES["op13_spelling_variants"](spark, str(tmp_path)).collect()))
    assert lost > 20 and len(counts) > 500 and found == by_editing(counts)


def test_a_half_that_many_words_share_is_split(spark):
    """No tile of a hot half holds more than two blocks of each of its classes of lengths."""
    draw = np.random.default_rng(2)
    words = sorted({"common" + "".join(draw.choice(list("abcdefghij"), 6)) for _ in range(400)})
    frame = spark.createDataFrame([(word, 5) for word in words], "word string, n bigint")
    sizes = spelling._tiles(frame, 1, 20).filter("side = 0 and a = b").groupBy("x", "y").count().collect()
    assert len(sizes) > 100 and max(row["count"] for row in sizes) <= 100
