"""WARC archives: writing pages as segmented records, and putting the segments together again.

A response is an HTTP message with a chunked body. A long one is cut into segments: the first is the
response record, the others are continuation records that name the first one's id and their number, and
the last one gives the total length. Segments of a response may lie in different files, and do
where records are dealt over files by a hash. Reading parses each file by the records' lengths, groups continuations by the
id of their origin, orders them by number, verifies numbers and total length, and decodes the chunks.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyworks.llm.tasks import for_workers, partitions, written

# Payloads of this size or more are written once.
REVISIT_BYTES = 1000
SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
# The most that the blocks of one archive take before compression; reading holds an archive whole.
ARCHIVE_BYTES = 256 << 20

# Copies of one page that one task numbers.
COPIES = 1000

LINE_END = b"\r\n"
RECORD_END = LINE_END + LINE_END
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
# Types, profile and version as the format fixes them.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "record_id STRING, record_type STRING, page_id BIGINT, url STRING, digest STRING, refers_to_id STRING, "
    "origin_id STRING, segment INT, total_length BIGINT, block BINARY"
)


def chunked(payload: bytes, size: int) -> bytes:
    """A body in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, LINE_END]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, or None if its framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(LINE_END, at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(parts) if body[at:] == LINE_END else None
        if body[at + size : at + size + 2] != LINE_END:
            return None
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes | None) -> bytes | None:
    """The payload of an HTTP message, or None if it can't be read."""
    if block is None:
        return None
    head, end, body = block.partition(b"\r\n\r\n")
    if not end:
        return None
    lines = [line.lower().replace(b" ", b"") for line in head.split(LINE_END)]
    return dechunked(body) if b"transfer-encoding:chunked" in lines else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION, *[f"{name}: {value}".encode() for name, value in fields if value is not None]]
    return LINE_END.join([*lines, b"Content-Length: %d" % len(block), b"", block])


def _told(pages: DataFrame) -> DataFrame:
    payload = F.coalesce("html", F.lit(""))
    digest = F.sha1(payload.cast("binary")).alias("digest")
    return pages.select(F.col("page_id").cast("bigint"), "url", payload.alias("html"), digest, (F.octet_length(payload) >= REVISIT_BYTES).alias("long"))


def _numbered(told: DataFrame, counts: DataFrame) -> DataFrame:
    """The pages with ``number``, which tells equal ones apart: 0 but for copies.

    Copies are aggregated to one row each before they are shuffled, dealt out again ``COPIES`` at a time, and numbered there.
    """
    key = ["page_id", "url", "digest"]
    copied = counts.filter("n > 1").select(*key)
    if copied.isEmpty():
        return told.withColumn("number", F.lit(0).cast("bigint"))
    on = lambda right: [told[name].eqNullSafe(right[name]) for name in key]
    single = told.join(copied, on(copied), "left_anti").withColumn("number", F.lit(0).cast("bigint"))
    groups = told.join(copied, on(copied), "left_semi").groupBy(*key, "long").agg(F.first("html").alias("html"), F.count("*").alias("n"))
    begins = groups.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(COPIES).cast("bigint"))))
    dealt = begins.repartition(F.xxhash64(*key, "begin"))
    numbers = F.sequence(F.col("begin"), F.least(F.col("begin") + COPIES, F.col("n")) - 1)
    return single.unionByName(dealt.withColumn("number", F.explode(numbers)).drop("n", "begin"))


def record_rows(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, packed: bool = False) -> DataFrame:
    """A row per record, ``key`` to deal it out by and ``record`` with its bytes; see ``write_archives``.

    Record ids are derived from a random value of this call and from the page, so a repeated task
    makes the same ones, and another call makes others. With ``packed`` every record is a gzip member.
    """
    for_workers(pages.sparkSession)
    told, token = _told(pages), uuid.uuid4().hex
    # Counts of equal pages, without their payloads; what is repeated is told from these.
    counts = written(told.groupBy("page_id", "url", "digest", "long").agg(F.count("*").alias("n")), "page_counts")
    repeated = counts.filter("long").groupBy("digest").agg(F.max("page_id").alias("kept_id"), F.sum("n").alias("n")).filter("n > 1 and kept_id is not null")
    # Written, so that adaptive execution can split the pages of a payload that very many have.
    repeated = written(repeated, "repeated")
    joined = _numbered(told, counts).alias("p").join(repeated.alias("r"), (F.col("p.digest") == F.col("r.digest")) & F.col("p.long"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("kept_id")), F.col("kept_id"))
    rows = joined.select("page_id", "url", "p.digest", "number", refers.alias("refers_to"), F.when(refers.isNull(), F.col("html")).alias("html"))

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                url = None if row["url"] is None else row["url"].replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
                common = [("WARC-Target-URI", url), ("X-Page-Id", row["page_id"]), ("WARC-Payload-Digest", f"sha1:{row['digest']}")]
                own = repr((token, row["page_id"], row["url"], row["digest"], row["number"])).encode("utf-8", "backslashreplace")
                own_id = uuid.UUID(bytes=hashlib.sha256(own).digest()[:16], version=4)
                name = f"<urn:uuid:{own_id}>"
                made = []
                if row["refers_to"] is not None:
                    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", row["refers_to"])]
                    made.append(_record(fields, b""))
                else:
                    block = HTTP_HEAD + chunked(row["html"].encode("utf-8", "surrogatepass"), chunk_bytes)
                    cuts = range(0, len(block), segment_bytes)
                    for number, at in enumerate(cuts, 1):
                        fields = [("WARC-Type", "response" if number == 1 else "continuation")]
                        fields += [("WARC-Record-ID", name if number == 1 else f"<urn:uuid:{own_id}:{number}>")]
                        fields += common if number == 1 else [("WARC-Segment-Origin-ID", name)]
                        fields += [("WARC-Segment-Number", number)] if len(cuts) > 1 else []
                        fields += [("WARC-Segment-Total-Length", len(block))] if 1 < number == len(cuts) else []
                        made.append(_record(fields, block[at : at + segment_bytes]))
                keys = [f"{own_id}:{number}" for number in range(len(made))]
                if packed:
                    made = [gzip.compress(record + RECORD_END, mtime=0) for record in made]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(made, pa.binary())], ["key", "record"])

    return rows.mapInArrow(framed, "key STRING, record BINARY")


def write_archives(
    pages: DataFrame,
    path: str,
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    file_bytes: int | None = None,
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write compressed archives of ``pages`` (``page_id, url, html``), a record per row or more where it is long.

    The payload is the html in UTF-8; null is empty. Of pages with equal payloads of at least
    ``REVISIT_BYTES`` the one with the largest id is the response and the others are revisits of it. Rows that
    repeat that id with that payload are responses too. A page without id is a revisit where another
    page has its payload, and a response where no page with id has. Null urls are left out, line ends in
    urls are percent-encoded. Other columns are dropped. An empty table gives no record.

    Each record is a gzip member, which can be read by itself. Each partition of the pages fills one file after
    another. A file has so many records that their blocks, of ``segment_bytes`` at most, stay within ``archive_bytes``,
    however large the partition is. With ``file_bytes`` the records are dealt by a hash over files of about that size
    before compression, and over as many as the session has shuffle partitions at least.
    """
    records = record_rows(pages, segment_bytes, chunk_bytes, packed=True)
    if file_bytes:
        total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
        records = records.repartition(max(partitions(pages.sparkSession), -(-total // file_bytes)), F.xxhash64("key"))
    # Bytes are written as they are. The writer wants something between two lines: a member without content.
    lines = records.select(F.col("record").cast("string").alias("value"))
    most = max(1, archive_bytes // segment_bytes)
    between = gzip.compress(b"", mtime=0).decode("latin-1")
    lines.write.option("maxRecordsPerFile", most).option("lineSep", between).option("encoding", "ISO-8859-1").text(path)


def parsed(data: bytes) -> Iterator[dict]:
    """The records of one archive, compressed or not."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while version := stream.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {version[:20]!r}")
        fields: dict[str, str] = {}
        while line := stream.readline().strip(LINE_END):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("the archive ends inside a record")
        number = lambda name: int(fields[name]) if name in fields else None
        url = fields.get("warc-target-uri")
        yield {
            "record_id": fields["warc-record-id"],
            "record_type": fields["warc-type"],
            "page_id": number("x-page-id"),
            "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
            "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "refers_to_id": fields.get("x-refers-to-page-id"),
            "origin_id": fields.get("warc-segment-origin-id"),
            "segment": number("warc-segment-number"),
            "total_length": number("warc-segment-total-length"),
            "block": block,
        }


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every record of the archives at a path, or at several, segments as they are. A file is read by one task, so files are to be of bounded size."""
    for_workers(spark)
    from pyspark.sql.types import StructType

    names = [field.name for field in StructType.fromDDL(RECORDS).fields]
    kinds = dict(zip(names, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary())))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for record in parsed(content.as_py()):
                    held.append(record)
                    size += len(record["block"])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, pa.schema(list(kinds.items())))
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, pa.schema(list(kinds.items())))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORDS)


def reassembled(records: DataFrame) -> DataFrame:
    """Response and revisit records with their ``payload``, continuations put in place.

    Columns: ``record_id, record_type, page_id, url, digest, refers_to_id, payload, complete``. A response is
    complete when its segments are numbered from 1 without gap, exactly one of them gives a total length,
    that is the length of all, the chunk framing ends where the block ends, and the payload has
    the digest it was written with; else the payload is null. A record that was read twice
    counts once. Continuations without their origin are rows of type ``continuation`` that are not complete.
    """
    for_workers(records.sparkSession)
    names = ["record_id", "record_type", "page_id", "url", "digest", "refers_to_id"]
    cut = F.coalesce("origin_id", F.when(F.col("segment").isNotNull(), F.col("record_id")))
    whole = records.filter(cut.isNull()).select(*names, "block")
    part = F.struct(F.col("segment"), "total_length", "block")
    is_first = F.col("record_type") != "continuation"
    groups = (
        records.filter(cut.isNotNull())
        .groupBy(cut.alias("record_id"))
        .agg(
            F.coalesce(F.max(F.when(is_first, F.col("record_type"))), F.lit("continuation")).alias("record_type"),
            *[F.max(F.when(is_first, F.col(name))).alias(name) for name in names[2:]],
            F.array_sort(F.array_distinct(F.collect_list(part))).alias("parts"),
        )
    )
    length = F.aggregate("parts", F.lit(0).cast("bigint"), lambda total, one: total + F.octet_length(one["block"]))
    totals = F.filter("parts.total_length", lambda one: one.isNotNull())
    sound = (
        (F.col("record_type") != "continuation")
        & (F.col("parts.segment") == F.sequence(F.lit(1), F.size("parts")))
        & (totals == F.array(length))
    )
    # Concatenating bytes in one pass: joined as strings without separator, which leaves bytes as they are.
    joined = F.array_join(F.transform("parts.block", lambda block: block.cast("string")), "").cast("binary")
    together = groups.select(*names, F.when(sound, joined).alias("block"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = zip(part.column("record_type").to_pylist(), part.column("digest").to_pylist(), part.column("block").to_pylist())
                payloads, complete = [], []
                for kind, digest, block in rows:
                    payload = None if kind != "response" else payload_of(block)
                    if payload is not None and digest is not None and hashlib.sha1(payload).hexdigest() != digest:
                        payload = None
                    payloads.append(payload)
                    complete.append(kind == "revisit" or payload is not None)
                kept = [part.column(name) for name in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(payloads, pa.binary()), pa.array(complete, pa.bool_())], [*names, "payload", "complete"])

    schema = "record_id STRING, record_type STRING, page_id BIGINT, url STRING, digest STRING, refers_to_id STRING, payload BINARY, complete BOOLEAN"
    return whole.unionByName(together).mapInArrow(decoded, schema)


def read_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The pages of the archives: ``page_id, url, record_type, refers_to, payload_bytes, payload_digest``; none of archives without records.

    Length and digest are those of the decoded payload; a revisit has those of the response it refers to,
    found by page and digest.
    """
    found = reassembled(read_records(spark, path)).withColumn("refers_to", F.col("refers_to_id").cast("bigint"))
    told = found.select(
        "page_id", "url", "record_type", "refers_to", "digest", "complete", F.octet_length("payload").cast("bigint").alias("bytes"), F.sha1("payload").alias("sha1")
    )
    told = written(told, "pages_read")
    responses = told.filter("record_type = 'response' and complete").groupBy("page_id", "sha1").agg(F.max("bytes").alias("bytes"))
    revisits = told.filter("record_type = 'revisit'").alias("v").join(
        responses.alias("r"), (F.col("v.refers_to") == F.col("r.page_id")) & (F.col("v.digest") == F.col("r.sha1")), "left"
    ).select("v.page_id", "v.url", "v.record_type", "v.refers_to", F.col("r.bytes").alias("payload_bytes"), F.col("r.sha1").alias("payload_digest"))
    rest = told.filter("record_type <> 'revisit'").select(
        "page_id", "url", "record_type", "refers_to", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest")
    )
    return rest.unionByName(revisits)
