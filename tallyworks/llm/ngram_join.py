"""Similarity join of documents on word n-grams by T-occurrence search.

Two sets of n-grams that are similar enough share at least T elements, so a partner of a document is found
in T of the inverted lists of its elements. The search follows DivideSkip: the longest lists are left aside,
the short ones are merged with a heap that skips what cannot reach the rest of T, and the long lists are
probed by binary search for the few candidates that do.

Before that, documents are left out that can have no partner, and the others are dealt into blocks that no
pair crosses, so that each block's lists are merged in one task:

1. Equal sets are one. Of every set the n-grams with the smallest hashes form its pool. Similar sets
   share a known number of n-grams within both pools, so a set with fewer pool n-grams that any other pool
   has is alone. Equal n-grams are combined per batch before they are shuffled.
2. The remaining sets' n-grams are counted. In an order from rare to common, similar sets share one of the first
   n - T + 1; sets that share one of these belong to one block.
3. A block too large for a task is split into parts, with its first set in every part. Then one set of each
   component found is searched in the same way, which connects what a large group of copies left in many parts.
   Sets that are still not connected with the block's largest component are searched in all parts, a
   bounded number of them at a time.

Everything is exact but for 64-bit hashes of n-grams, which begin with a random number of each call. Links are found as far as they connect
something that was not yet connected.
"""

from __future__ import annotations

import heapq
import math
import secrets
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyworks.llm.graph import components
from tallyworks.llm.hashing import mixed, shingle_sets
from tallyworks.llm.tasks import for_workers, partitions, written

WORDS = 5
PERCENT = 80
# The share of a set that its pool has beyond what similar sets may differ by.
POOL = 0.1
# N-grams of one batch, and of one block's part.
BATCH = 1 << 19
PART = 1 << 21
# The weight of a long list's length in DivideSkip's choice of the number of long lists.
SKIP = 0.01

U8 = np.uint64


def overlap(size: int, percent: int) -> int:
    """The least number of elements that a similar set has in common with one of this size."""
    return -(-percent * size // 100)


def pool_share(size: int) -> int:
    return max(1, math.floor(POOL * size))


def pool_size(size: int, percent: int) -> int:
    """With so many of the smallest hashes, two similar sets share ``pool_share`` of the smaller one at least.

    At most size - T elements of a set are not in the other, so the j-th common element is among the first
    size - T + j of either.
    """
    least = overlap(size, percent)
    return size - least + min(pool_share(size), least)


def pool_need(size: int, percent: int) -> int:
    """Pool elements shared with any similar set, whose size is the overlap at least."""
    least = overlap(size, percent)
    return min(pool_share(least), overlap(least, percent))


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed numbers."""
    first = np.add.reduce(mixed(found ^ U8(0xA5A5A5A5A5A5A5A5)), dtype=U8)
    second = np.add.reduce(mixed(found * U8(0xD6E8FEB86659FD93) + U8(len(found))), dtype=U8)
    return int(first.astype(np.int64)), int(second.astype(np.int64))


def _packed(arrays: list[np.ndarray], kind: str) -> bytes:
    return b"".join(np.ascontiguousarray(array, kind).tobytes() for array in arrays)


def _read(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of hashes by bucket, and where each bucket begins in it."""
    bucket = (hashes >> U8(32)) % U8(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U8))


# Step 1: profiles and pools


def profiles(docs: DataFrame, words: int, seed: int = 0) -> DataFrame:
    """``doc_id, n_shingles, first, second`` of every row: the size and the fingerprint of its set."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(found), *fingerprint(found)) for found in shingle_sets(batch.column("text"), words, seed)]
            columns = [pa.array(column, pa.int64()) for column in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_shingles", "first", "second"])

    return _input(docs).mapInArrow(profile, "doc_id BIGINT, n_shingles BIGINT, first BIGINT, second BIGINT")


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def shared_in_pools(docs: DataFrame, words: int, percent: int, seed: int = 0) -> DataFrame:
    """``first, shared``: for sets by fingerprint, how many pool elements other sets' pools have, at least.

    An element that two sets of a batch have is known to be shared, and goes on once; so no task gets
    more of a frequent element than one per batch.
    """
    buckets = partitions(docs.sparkSession)
    names = ["bucket", "hashes", "owners", "known", "local_owners", "local_counts"]
    kinds = [pa.int32(), *[pa.binary()] * 5]

    def rows(hashes: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
        _, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
        alone = times[back] == 1
        known = np.unique(hashes[~alone])
        local, counts = np.unique(owners[~alone], return_counts=True)
        hashes, owners = hashes[alone], owners[alone]
        order, at = _dealt(hashes, buckets)
        known_order, known_at = _dealt(known, buckets)
        local_order, local_at = _dealt(mixed(local.view(U8)), buckets)
        made = []
        for bucket in range(buckets):
            own = order[at[bucket] : at[bucket + 1]]
            seen = known_order[known_at[bucket] : known_at[bucket + 1]]
            here = local_order[local_at[bucket] : local_at[bucket + 1]]
            if len(own) or len(seen) or len(here):
                arrays = (hashes[own], owners[own], known[seen], local[here], counts[here].astype(np.int64))
                made.append((bucket, *[array.tobytes() for array in arrays]))
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*made), kinds)], names)

    def pools(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            for found in shingle_sets(batch.column("text"), words, seed):
                if len(found):
                    owner = fingerprint(found)[0]
                    if owner not in held:
                        held[owner] = found[: pool_size(len(found), percent)].copy()
                        size += len(held[owner])
                if size > BATCH:
                    yield rows(np.concatenate(list(held.values())), np.repeat(np.array(list(held), np.int64), [len(x) for x in held.values()]))
                    held, size = {}, 0
        if held:
            yield rows(np.concatenate(list(held.values())), np.repeat(np.array(list(held), np.int64), [len(x) for x in held.values()]))

    def count(table: pa.Table) -> pa.Table:
        hashes, owners = _read(table["hashes"], "<u8"), _read(table["owners"], "<i8")
        known = np.unique(_read(table["known"], "<u8"))
        order = np.lexsort((owners, hashes))
        hashes, owners = hashes[order], owners[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
        hashes, owners = hashes[new], owners[new]
        same = np.zeros(len(hashes), bool)
        same[1:] = hashes[1:] == hashes[:-1]
        shared = same.copy()
        shared[:-1] |= same[1:]
        if len(known) and len(hashes):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            shared |= known[at] == hashes
        found, counts = np.unique(owners[shared], return_counts=True)
        both = np.concatenate((found, _read(table["local_owners"], "<i8")))
        numbers = np.concatenate((counts.astype(np.int64), _read(table["local_counts"], "<i8")))
        order, at = _dealt(mixed(both.view(U8)), buckets)
        made = [
            (target, both[order[begin:end]].tobytes(), numbers[order[begin:end]].tobytes())
            for target, (begin, end) in enumerate(zip(at[:-1], at[1:]))
            if end > begin
        ]
        kinds = (pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(column, kind) for column, kind in zip(list(zip(*made)) or [()] * 3, kinds)], ["target", "found", "counts"])

    def add(table: pa.Table) -> pa.Table:
        owners, back = np.unique(_read(table["found"], "<i8"), return_inverse=True)
        totals = np.bincount(back, _read(table["counts"], "<i8"), len(owners)).astype(np.int64)
        return pa.table({"first": owners, "shared": totals})

    dealt = _input(docs).mapInArrow(pools, "bucket INT, " + ", ".join(f"{name} BINARY" for name in names[1:]))
    counted = dealt.groupBy("bucket").applyInArrow(count, "target INT, found BINARY, counts BINARY")
    return counted.groupBy("target").applyInArrow(add, "first BIGINT, shared BIGINT")


# Step 2: blocks


def sets_in_chunks(docs: DataFrame, chosen: DataFrame, words: int, seed: int = 0) -> DataFrame:
    """The sets of the chosen documents (``node, first, second``), some hundred thousand elements to a row."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        schema = ["chunk", "nodes", "sizes", "hashes"]

        def row() -> pa.RecordBatch:
            arrays = [pa.array([chunk], pa.int64())]
            arrays += [pa.array([data], pa.binary()) for data in (
                np.array([node for node, _ in held], "<i8").tobytes(),
                np.array([len(found) for _, found in held], "<i8").tobytes(),
                _packed([found for _, found in held], "<u8"),
            )]
            return pa.RecordBatch.from_arrays(arrays, schema)

        for batch in batches:
            wanted = zip(batch.column("doc_id").to_pylist(), batch.column("first").to_pylist(), batch.column("second").to_pylist())
            for (node, first, second), found in zip(wanted, shingle_sets(batch.column("text"), words, seed)):
                if fingerprint(found) != (first, second):
                    continue
                held.append((node, found))
                size += len(found)
                if size > BATCH:
                    yield row()
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield row()

    texts = _input(docs).join(chosen, F.col("doc_id") == F.col("node")).select("doc_id", "text", "first", "second")
    return texts.mapInArrow(gather, "chunk BIGINT, nodes BINARY, sizes BINARY, hashes BINARY")


def set_rows(chunks: DataFrame) -> DataFrame:
    """``node, size, hashes``, a row per set."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, sizes, hashes in zip(*[batch.column(name).to_pylist() for name in ("nodes", "sizes", "hashes")]):
                sizes = np.frombuffer(sizes, "<i8")
                ends = (8 * np.cumsum(sizes)).tolist()
                cut = [hashes[begin:end] for begin, end in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(nodes, "<i8")), pa.array(sizes), pa.array(cut, pa.binary())], ["node", "size", "hashes"]
                )

    return chunks.mapInArrow(split, "node BIGINT, size BIGINT, hashes BINARY")


def first_elements(chunks: DataFrame, percent: int) -> DataFrame:
    """``hash, node``: of every set that may have a partner, its first n - T + 1 elements from rare to common.

    Elements that only one set has are first in that order and need no row. Counts are summed per
    chunk before they are shuffled.
    """
    buckets = partitions(chunks.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("hashes").to_pylist()):
                hashes, times = np.unique(np.frombuffer(data, "<u8"), return_counts=True)
                order, at = _dealt(hashes, buckets)
                hashes, times = hashes[order], times[order].astype(np.uint32)
                rows = [(bucket, chunk, hashes[b:e].tobytes(), times[b:e].tobytes()) for bucket, (b, e) in enumerate(zip(at[:-1], at[1:])) if e > b]
                if rows:
                    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "chunk", "hashes", "times"])

    def total(table: pa.Table) -> pa.Table:
        hashes, times = _read(table["hashes"], "<u8"), _read(table["times"], "<u4")
        lengths = np.array([len(data) // 8 for data in table["hashes"].to_pylist()])
        _, back = np.unique(hashes, return_inverse=True)
        sums = np.bincount(back, times).astype(np.int64)[back]
        rows = []
        for chunk, end, length in zip(table["chunk"].to_pylist(), np.cumsum(lengths).tolist(), lengths.tolist()):
            shared = sums[end - length : end] > 1
            rows.append((chunk, hashes[end - length : end][shared].tobytes(), np.minimum(sums[end - length : end][shared], 2**32 - 1).astype("<u4").tobytes()))
        kinds = (pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["chunk", "shared", "counts"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, sizes, hashes, found in zip(*[batch.column(name).to_pylist() for name in ("nodes", "sizes", "hashes", "found")]):
                shared = np.concatenate([np.frombuffer(one["shared"], "<u8") for one in found])
                counts = np.concatenate([np.frombuffer(one["counts"], "<u4") for one in found])
                order = np.argsort(shared)
                shared, counts = shared[order], counts[order]
                nodes, sizes, hashes = np.frombuffer(nodes, "<i8"), np.frombuffer(sizes, "<i8"), np.frombuffer(hashes, "<u8")
                if not len(shared):
                    continue
                at = np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)
                times = np.where(shared[at] == hashes, counts[at], 1)
                made_hashes, made_nodes = [], []
                begin = 0
                for node, size in zip(nodes.tolist(), sizes.tolist()):
                    own, often = hashes[begin : begin + size], times[begin : begin + size]
                    begin += size
                    left = size - overlap(size, percent) + 1 - int((often == 1).sum())
                    if left > 0:
                        own, often = own[often > 1], often[often > 1]
                        chosen = own[np.lexsort((own, often))[:left]]
                        made_hashes.append(chosen)
                        made_nodes.append(np.full(len(chosen), node))
                if made_hashes:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made_hashes).view(np.int64)), pa.array(np.concatenate(made_nodes))], ["hash", "node"])

    counted = chunks.mapInArrow(count, "bucket INT, chunk BIGINT, hashes BINARY, times BINARY")
    totals = counted.groupBy("bucket").applyInArrow(total, "chunk BIGINT, shared BINARY, counts BINARY")
    found = totals.groupBy("chunk").agg(F.collect_list(F.struct("shared", "counts")).alias("found"))
    return chunks.join(found, "chunk").mapInArrow(first, "hash BIGINT, node BIGINT")


def blocks(elements: DataFrame) -> DataFrame:
    """``node, block``: sets that share one of their first elements, directly or through others."""
    lists = elements.groupBy("hash").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a < last").select("hash", "a")
    # Written, so that adaptive execution can split the rows of a frequent element.
    lists = written(lists, "lists")
    edges = elements.join(lists, "hash").select("a", F.col("node").alias("b"))
    return components(edges).withColumnRenamed("component", "block")


# Step 3: the search


def merge_skip(lists: list[list[int]], need: int) -> Iterator[tuple[int, int]]:
    """The numbers that are in at least ``need`` of the ascending lists, with how many those are."""
    heap = [(held[0], which, 0) for which, held in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= need:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            yield top, len(popped)
            target = top + 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            target = heap[0][0]
        for _, which, at in popped:
            at = bisect_left(lists[which], target, at)
            if at < len(lists[which]):
                heapq.heappush(heap, (lists[which][at], which, at))


def divided(lists: list[list[int]], least: int, need: Callable[[int], int], wanted: Callable[[int], bool]) -> Iterator[int]:
    """The numbers that are in ``need(number)`` of the lists, ``least`` being the smallest need there is.

    ``wanted`` is asked before the long lists are probed.
    """
    lists = sorted(lists, key=len)
    aside = min(least - 1, int(least / (SKIP * math.log2(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    for number, times in merge_skip(short, least - aside):
        if not wanted(number):
            continue
        missing = need(number) - times
        for place, held in enumerate(long):
            if missing <= 0 or missing > len(long) - place:
                break
            at = bisect_left(held, number)
            missing -= at < len(held) and held[at] == number
        if missing <= 0:
            yield number


class Block:
    """The inverted lists of some sets, ordered by size, and which of the sets are connected so far."""

    def __init__(self, sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None):
        self.percent = percent
        self.sizes = np.array([len(found) for found in sets], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        _, self.elements = np.unique(np.concatenate(sets), return_inverse=True)
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)
        self.labels = np.arange(len(sets)) if labels is None else labels.copy()
        self.all = self._index(np.ones(len(sets), bool))
        self._rest_of_largest()

    def _index(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kept = chosen[self.owners]
        elements, owners = self.elements[kept], self.owners[kept]
        lengths = np.bincount(elements, minlength=int(self.elements.max()) + 1)
        return owners[np.argsort(elements, kind="stable")], np.cumsum(lengths) - lengths, lengths

    def _rest_of_largest(self) -> None:
        """Lists without the largest component, for the queries from it."""
        names, counts = np.unique(self.labels, return_counts=True)
        self.largest = names[counts.argmax()]
        outside = self.labels != self.largest
        self.outside = int(outside.sum())
        self.rest = self._index(outside)

    def links(self, asked: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """Pairs of similar sets that connect what was not connected; with ``asked``, pairs with one of those."""
        for query in range(len(self.sizes)):
            size = int(self.sizes[query])
            least = -(-2 * self.percent * size // (100 + self.percent))
            last = int(np.searchsorted(self.sizes, 100 * size // self.percent, "right"))
            owners, starts, lengths = self.rest if self.labels[query] == self.largest else self.all
            elements = self.elements[self.starts[query] : self.starts[query + 1]]
            begins, counts = starts[elements], lengths[elements]
            total = int(counts.sum())
            if (counts > 0).sum() < least:
                continue
            ends = np.cumsum(counts)
            entries = owners[np.repeat(begins - (ends - counts), counts) + np.arange(total)]
            which = np.repeat(np.arange(len(elements)), counts)
            fit = (entries > query) & (entries < last) & (self.labels[entries] != self.labels[query])
            if asked is not None and not asked[query]:
                fit &= asked[entries]
            entries, which = entries[fit], which[fit]
            cuts = np.flatnonzero(np.diff(which)) + 1
            if len(entries) == 0 or len(cuts) + 1 < least:
                continue
            lists = [held.tolist() for held in np.split(entries, cuts)]

            def need(other: int) -> int:
                return -(-self.percent * (size + int(self.sizes[other])) // (100 + self.percent))

            for other in divided(lists, least, need, lambda other: self.labels[other] != self.labels[query]):
                yield query, other
                self.labels[self.labels == self.labels[other]] = self.labels[query]
            if (names := int((self.labels != self.largest).sum())) * 2 < self.outside or names > 2 * self.outside:
                self._rest_of_largest()


def _search(percent: int) -> Callable[[pa.Table], pa.Table]:
    def search(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.lexsort((table["node"].to_numpy(), table["size"].to_numpy()))))
        nodes = table["node"].to_numpy()
        sets = [np.frombuffer(data, "<u8") for data in table["hashes"].to_pylist()]
        _, labels = np.unique(table["label"].to_numpy(), return_inverse=True)
        pairs = list(Block(sets, percent, labels).links(table["asked"].to_numpy(zero_copy_only=False)))
        return pa.table({"a": pa.array([nodes[a] for a, _ in pairs], pa.int64()), "b": pa.array([nodes[b] for _, b in pairs], pa.int64())})

    return search


def links_in_blocks(sets: DataFrame, block_of: DataFrame, percent: int, part: int = PART) -> DataFrame:
    """``a, b``: links that connect all similar sets of the blocks.

    No task gets much more than two times ``part`` elements, or two sets if these are longer. Tables that are joined
    with a row per set are written first, so that adaptive execution can split a large block's rows.
    """
    sizes = written(sets.select("node", "size").join(block_of, "node"), "sizes")
    parts = _parts(sizes, part, "parts")
    placed = sizes.join(parts, "block")
    found = written(_searched(sets, _spread(placed, "block"), percent), "links")
    split = parts.filter("parts > 1")
    if split.isEmpty():
        return found
    # The parts of one group of copies meet in one set of each; all of the largest component's parts get its set.
    placed = written(placed.filter("parts > 1"), "placed")
    heads = _labelled(placed, found).filter("node = label and n > 1").drop("parts")
    heads = written(heads, "heads")
    met = _searched(sets, _spread(heads.join(_parts(heads, part, "head_parts"), "block"), "largest"), percent)
    found = found.unionByName(written(met, "head_links"))
    # Whoever is still not in the largest component of a split block has yet to meet the other parts.
    member = _labelled(placed, found).withColumn("asked", F.col("label") != F.col("largest"))
    member = written(member, "members")
    member = member.join(_parts(member.filter("asked"), part, "asks").withColumnRenamed("parts", "asks"), "block")
    asks, every = F.sequence(F.lit(0), F.col("asks") - 1), F.sequence(F.lit(0), F.col("parts") - 1)
    names = ["node", "block", "label"]
    asking = member.filter("asked").select(*names, _own("asks").alias("ask"), F.explode(every).alias("part"), F.lit(True).alias("asked"))
    others = member.select(*names, F.explode(asks).alias("ask"), _own("parts").alias("part"), F.lit(False).alias("asked"))
    return found.unionByName(_searched(sets, asking.unionByName(others), percent))


def _own(count: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(count)).cast("int")


def _parts(rows: DataFrame, part: int, label: str) -> DataFrame:
    """``block, parts``: how many parts of about ``part`` elements the rows of a block make."""
    total = rows.groupBy("block").agg(F.sum("size").alias("total"))
    return written(total.select("block", F.ceil(F.col("total") / F.lit(part)).cast("int").alias("parts")), label)


def _spread(rows: DataFrame, everywhere: str) -> DataFrame:
    """Rows in the part of their own, and the set that the column ``everywhere`` names in all parts; each set is a component."""
    all_parts = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = F.when(F.col("node") == F.col(everywhere), all_parts).otherwise(F.array(_own("parts")))
    return rows.select("node", "block", F.col("node").alias("label"), F.lit(0).alias("ask"), F.explode(dealt).alias("part"), F.lit(True).alias("asked"))


def _labelled(placed: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``label``, the component by the links found; ``n``, its number of sets; ``largest``, its block's largest one."""
    joined = written(components(found), "components")
    member = placed.join(joined, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    member = written(member, "labelled")
    by_label = written(member.groupBy("block", "label").agg(F.count("*").alias("n")), "by_label")
    largest = written(by_label.groupBy("block").agg(F.max_by("label", F.struct("n", "label")).alias("largest")), "largest")
    return member.join(by_label, ["block", "label"]).join(largest, "block")


def _searched(sets: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """``a, b``: the links that a search of each ``block, ask, part`` finds."""
    held = sets.join(written(rows, "dealt"), "node").select("block", "ask", "part", "node", "size", "hashes", "label", "asked")
    return held.groupBy("block", "ask", "part").applyInArrow(_search(percent), "a BIGINT, b BIGINT")


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, part: int = PART) -> DataFrame:
    """Every document with the size of its set and the smallest ``doc_id`` it is linked to: ``doc_id, n_shingles, component_id``.

    ``docs`` has ``doc_id, text``; other columns are dropped. A set is the distinct runs of ``words`` words,
    with A-Z lowered; a shorter text is one run of all its words. Two documents are linked when
    100 * intersection >= ``percent`` * union. Null text and text without words are empty and linked with nothing,
    so their component is their own id. Rows that share a ``doc_id`` are one node: what any of them is linked to is
    connected. A row without ``doc_id`` has a size and no component. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    for_workers(spark)
    # Hashes begin with a number of this call, so that no text can be written to collide with another.
    seed = secrets.randbits(63)
    profile = written(profiles(docs, words, seed), "profiles")
    node = profile.filter("n_shingles > 0 and doc_id is not null").groupBy("first", "second").agg(
        F.min("doc_id").alias("node"), F.max("n_shingles").alias("n")
    )
    node = written(node, "nodes")
    least = F.ceil(F.lit(percent) * F.col("n") / 100)
    share = F.greatest(F.lit(1), F.floor(F.lit(POOL) * least))
    need = F.least(share, F.ceil(F.lit(percent) * least / 100))
    chosen = node.join(shared_in_pools(docs, words, percent, seed), "first").filter(F.col("shared") >= need - 1).select("node", "first", "second")
    chunks = written(sets_in_chunks(docs, chosen, words, seed), "sets")
    block_of = written(blocks(first_elements(chunks, percent)), "blocks")
    found = links_in_blocks(set_rows(chunks), block_of, percent, part)
    # Equal doc_ids with other texts are one node as well.
    same = profile.filter("n_shingles > 0").join(node, ["first", "second"]).filter("doc_id <> node")
    repeated = profile.groupBy("doc_id").agg(F.count_distinct("first", "second").alias("n")).filter("n > 1 and doc_id is not null")
    ties = same.join(repeated.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    component = components(found.unionByName(ties))
    named = node.join(component, "node", "left").select("first", "second", F.coalesce("component", "node").alias("component"))
    left, right = profile.alias("p"), named.alias("m")
    joined = left.join(right, (F.col("p.first") == F.col("m.first")) & (F.col("p.second") == F.col("m.second")) & (F.col("p.n_shingles") > 0), "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
