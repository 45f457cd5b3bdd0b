"""Best-fit packing: token sequences of one length filled with whole documents.

Documents become pieces of token ids. Pieces are packed by bounded-space online best fit: a task
keeps a fixed number of open sequences, filed by their free space, with one bit per free space that
has any. A piece goes where it leaves the least room. Where it fits nowhere a sequence is opened,
and if that is one too many, the fullest one is closed. Nothing but that file is held, whatever
the number of pieces.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyworks.llm.tasks import for_workers, partitions, written

SEQUENCE = 2048
OPEN_SEQUENCES = 4096
# Pieces that arrive together are taken longest first.
ARRIVALS = 4096

PIECES = "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT"
PLACED = f"{PIECES}, sequence_id BIGINT, offset BIGINT"


# White space as the vocabulary's pattern has it; fixed values.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# So many of these in a row are encoded as the one piece that they are: the pattern looks back over
# all of them, for which its stack is too small at some hundred thousand.
_LONG_SPACE = 1 << 16


class Tokenizer:
    """Token ids of texts as little-endian 32-bit numbers, for byte-level BPE with public ranks."""

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.encode, self.encode_piece = encoding.encode_ordinary, whole.encode_ordinary
        self.spaces = re.compile(f"[{_SPACES}]{{{_LONG_SPACE},}}")

    def ids(self, text: str) -> bytes:
        found, begin = [], 0
        if len(text) >= _LONG_SPACE:
            for run in self.spaces.finditer(text):
                # The last one belongs to the word after it.
                end = run.end() - (run.end() < len(text))
                found += self.encode(text[begin : run.start()]) + self.encode_piece(text[run.start() : end])
                begin = end
        found += self.encode(text[begin:])
        return struct.pack(f"<{len(found)}I", *found)


@lru_cache(2)
def tokenizer(ranks_path: str) -> Tokenizer:
    return Tokenizer(ranks_path)


def ranks_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(
    docs: DataFrame, ranks_path: str | None = None, sequence: int = SEQUENCE, with_ids: bool = False, in_order: bool = False
) -> DataFrame:
    """Every document's ids, followed by the id 0, cut into pieces of at most ``sequence``.

    Only a longer document is cut, into full pieces after a first one that may be shorter. Null
    text is empty, so its only id is the 0. Repeated rows, and rows without ``doc_id``, are
    documents of their own. Columns: those of ``PIECES``, ``ids`` with ``with_ids``, and with ``in_order`` the ``place`` of the document.
    An empty table gives an empty one; other columns are dropped.
    """
    for_workers(docs.sparkSession)
    schema = PIECES + (", ids ARRAY<INT>" if with_ids else "") + (", place BIGINT" if in_order else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(ranks_path or ranks_file())
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                places = part.column("place").to_pylist() if in_order else [None] * part.num_rows
                for doc_id, text, place in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), places):
                    ids = encoder.ids(text or "") + b"\0\0\0\0"
                    count = len(ids) // 4
                    begin, end = 0, count % sequence or min(count, sequence)
                    number = 0
                    while begin < count:
                        held = ids[4 * begin : 4 * end]
                        rows.append((doc_id, number, begin, end - begin, zlib.crc32(held), held, place))
                        begin, end, number = end, end + sequence, number + 1
                columns = list(zip(*rows))
                arrays = [pa.array(column, kind) for column, kind in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(held, "<u4").astype(np.int32) for held in columns[5]], pa.list_(pa.int32())))
                    names.append("ids")
                if in_order:
                    arrays.append(pa.array(columns[6], pa.int64()))
                    names.append("place")
                yield pa.RecordBatch.from_arrays(arrays, names)

    place = [F.col("place").cast("bigint")] if in_order else []
    return docs.select(F.col("doc_id").cast("bigint"), "text", *place).mapInArrow(cut, schema)


class OpenSequences:
    """The open sequences of a task, filed by free space."""

    def __init__(self, sequence: int, most: int):
        self.sequence, self.most = sequence, most
        self.filed: list[list[int]] = [[] for _ in range(sequence + 1)]
        self.bits = 0
        self.open = 0
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """The number of the sequence a piece goes to, and its place there."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, free = self.made, self.sequence
            self.made += 1
        if free > length:
            self.filed[free - length].append(number)
            self.bits |= 1 << (free - length)
            self.open += 1
        return number, self.sequence - free

    def _take(self, free: int) -> int:
        number = self.filed[free].pop()
        if not self.filed[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return number


def best_fit(cut: DataFrame, sequence: int = SEQUENCE, most: int = OPEN_SEQUENCES, in_order: bool = False) -> DataFrame:
    """Assign pieces to sequences: adds ``sequence_id`` and ``offset``.

    ``cut`` has the columns of ``PIECES``; further ones are dropped. Only these numbers are
    shuffled, evenly by a hash, and put into an order that a repeated task meets again. Sequence
    numbers are unique, not consecutive. No piece may be longer than ``sequence``. An empty table
    gives no rows.

    With ``in_order`` pieces are dealt by ranges of ``place``, which is kept, and arrive in its order: the sequences of a range have
    smaller numbers than those of a later one, and hold nothing of it. Rows of one place are told apart by their other columns.
    """
    for_workers(cut.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        state = OpenSequences(sequence, most)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, len(batch), ARRIVALS):
                block = batch.iloc[at : at + ARRIVALS]
                lengths = block["length"].to_numpy()
                order = np.argsort(-lengths, kind="stable")
                placed = [state.place(length) for length in lengths[order].tolist()]
                block = block.iloc[order].copy()
                block["sequence_id"] = [base + number for number, _ in placed]
                block["offset"] = [offset for _, offset in placed]
                yield block

    if in_order:
        order = ["place", "doc_id", "piece", "ids_crc32"]
        dealt = cut.select(*names, "place").repartitionByRange(partitions(cut.sparkSession), *order).sortWithinPartitions(*order)
        return dealt.mapInPandas(pack, f"{PIECES}, place BIGINT, sequence_id BIGINT, offset BIGINT")
    mixed = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = cut.select(*names).repartition(mixed).sortWithinPartitions(mixed, "doc_id", "piece", "start", "length")
    return dealt.mapInPandas(pack, PLACED)


def pack_documents(docs: DataFrame, ranks_path: str | None = None, sequence: int = SEQUENCE, most: int = OPEN_SEQUENCES) -> DataFrame:
    """Pieces of all documents with their places in sequences. Columns: ``PLACED``."""
    return best_fit(pieces(docs, ranks_path, sequence), sequence, most)


def pack_in_order(docs: DataFrame, ranks_path: str | None = None, sequence: int = SEQUENCE, most: int = OPEN_SEQUENCES) -> DataFrame:
    """As ``pack_documents``, in the order of a column ``place`` that ``docs`` has; columns: ``PLACED`` and ``place``."""
    # Written: dealing by ranges reads the pieces twice, and texts are to be encoded once.
    cut = written(pieces(docs, ranks_path, sequence, in_order=True), "pieces")
    return best_fit(cut, sequence, most, in_order=True).select(*[name.split()[0] for name in PLACED.split(", ")], "place")


def sequences(docs: DataFrame, ranks_path: str | None = None, sequence: int = SEQUENCE, most: int = OPEN_SEQUENCES) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids`` and the ``doc_ids`` in their order.

    Every row is bounded by the sequence length.
    """
    cut = written(pieces(docs, ranks_path, sequence, with_ids=True), "pieces")
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    numbered = cut.withColumn("_same", F.lit(0))
    placed = best_fit(cut, sequence, most)
    # Equal rows are interchangeable: number them on both sides, so that each is joined once.
    from pyspark.sql import Window

    def ranked(frame: DataFrame, order: str) -> DataFrame:
        return frame.withColumn("_same", F.row_number().over(Window.partitionBy(*key).orderBy(order)))

    left, right = ranked(numbered, "ids"), ranked(placed, "sequence_id")
    on = [left[name].eqNullSafe(right[name]) for name in [*key, "_same"]]
    joined = left.join(right, [*on]).select(right["sequence_id"], right["offset"], left["doc_id"], left["ids"])
    grouped = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
