"""Zstandard WARC archives: written in bounded pieces by Spark, read back record by record.

An archive starts with a skippable frame that holds its dictionary, trained on its own first payloads; then comes one
frame for each record. The reader loads the dictionary, decodes frame by frame, and checks each record's version line,
headers, Content-Length, end mark and payload digest. Of records with equal payloads of MIN_REVISIT bytes or more, the
one of the least page is a response and the others are revisits that name it; smaller payloads are responses all.

Archives are rows of a table (archive, data) in the shared folder, written and read by Spark, so any store that Spark
reaches will do; ``read_files`` reads .warc.zst files by Spark's binary reader: records of all types, with any ids and
digests, and bad ones as rows with an error where that is asked for.

Defined cases. Null html: empty payload, a response. Null url: no target header. Null page_id: written without an id and
read back as null; such a page revisits its equals, or is a response where none has an id. Rows of equal page_id and
payload are one page: responses all if it is the least. An empty table gives no archives and no rows. Further columns of
pages are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.base import materialize, table

MIN_REVISIT = 100
#: Magic of the skippable frame and of zstd dictionaries.
SKIPPABLE, DICTIONARY = 0x184D2A5D, 0xEC30A437
#: Bytes of an archive that the reader decodes at a time.
PIECE_BYTES = 16 << 10
#: Bounds of an archive, and of what a dictionary is trained on.
ARCHIVE_RECORDS, ARCHIVE_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 8 << 20, 64, 1 << 20, 16 << 10
LINE, END = b"\r\n", b"\r\n\r\n"
VERSION, OWN_ID, BARE = re.compile(rb"WARC/\d+\.\d+"), re.compile(rb"<urn:page:(-?\d+)>"), re.compile(r"sha-?256:([0-9A-Fa-f]{64})", re.IGNORECASE)
#: The types of records.
TYPES = frozenset(["warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation"])
#: Digests that are checked, by the names that headers give them.
DIGESTS = frozenset(["md5", "sha1", "sha256", "sha384", "sha512"])


class BadRecord(ValueError):
    """What is wrong in an archive, and where."""


def write_record(kind: str, page: int | None, url: str | None, digest: str, size: int, refers: int | None, payload: bytes) -> bytes:
    """One record; a revisit carries the digest and size of the payload that it leaves out."""
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Payload-Digest: sha256:" + digest.encode(), b"X-Payload-Length: %d" % size]
    if page is not None:
        head.append(b"WARC-Record-ID: <urn:page:%d>" % page)
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass"))
    if refers is not None:
        head.append(b"WARC-Refers-To: <urn:page:%d>" % refers)
    head.append(b"Content-Length: %d" % len(payload))
    return LINE.join(head) + END + payload + END


def checked_digest(label: str, data: bytes) -> bool | None:
    """Whether a digest as headers give it (algorithm:value, in hex or base 32) is that of data; None for algorithms not known here."""
    algorithm, _, value = label.partition(":")
    name = algorithm.strip().lower().replace("-", "")
    if name not in DIGESTS:
        return None
    own = hashlib.new(name, data).digest()
    return value.strip().lower() == own.hex() or value.strip().upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def payload_of(fields: dict[bytes, bytes], block: bytes) -> tuple[bytes, bool]:
    """The payload of a block, and whether its bytes are those that a digest is made of: behind the headers of an HTTP
    message, if it isn't sent in chunks or coded; else the block."""
    if not fields.get(b"content-type", b"").lower().startswith(b"application/http"):
        return block, True
    head, mark, body = block.partition(END)
    return (body, b"transfer-encoding:" not in head.lower()) if mark else (b"", False)


def read_record(record: bytes) -> dict:
    """The fields of one decoded record of any type, after all checks.

    page_id and refers_to are numbers of this library's own ids and null for others, which record_id and refers_to_id hold.
    A digest is checked where its algorithm is known; that of a revisit is its original's. payload_digest is bare for
    SHA-256 in hex, and as the header has it for others.
    """
    head, mark, rest = record.partition(END)
    lines = head.split(LINE)
    if not mark or not VERSION.fullmatch(lines[0]):
        raise BadRecord("no version line")
    fields: dict[bytes, bytes] = {}
    name = b""
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and name:  # a folded header goes on
            fields[name] += b" " + line.strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadRecord(f"not a header: {line[:40]!r}")
        name = name.strip().lower()
        fields[name] = value.strip()
    if not fields.get(b"content-length", b"").isdigit():
        raise BadRecord("no Content-Length")
    length = int(fields[b"content-length"])
    if len(rest) != length + len(END) or rest[length:] != END:
        raise BadRecord(f"Content-Length {length} and {len(rest)} bytes of block")
    text = lambda key: fields[key].decode("utf-8", "surrogatepass") if key in fields else None
    block, kind = rest[:length], text(b"warc-type")
    if kind not in TYPES:
        raise BadRecord(f"type {kind!r}")
    payload, sound = payload_of(fields, block)
    digest = text(b"warc-payload-digest")
    if kind != "revisit":
        if digest and sound and checked_digest(digest, payload) is False:
            raise BadRecord("payload and digest differ")
        if not fields.get(b"x-payload-length", b"0").isdigit() or (b"x-payload-length" in fields and int(fields[b"x-payload-length"]) != len(payload)):
            raise BadRecord("payload and X-Payload-Length differ")
    if b"warc-block-digest" in fields and checked_digest(text(b"warc-block-digest"), block) is False:
        raise BadRecord("block and digest differ")
    own = lambda key: int(found[1]) if (found := OWN_ID.fullmatch(fields.get(key, b""))) else None
    size = int(fields[b"x-payload-length"]) if fields.get(b"x-payload-length", b"").isdigit() else None if kind == "revisit" else len(payload)
    bare = BARE.fullmatch(digest or "")
    return {
        "page_id": own(b"warc-record-id"), "url": text(b"warc-target-uri"), "payload_bytes": size, "payload_digest": bare[1].lower() if bare else digest, "record_type": kind,
        "refers_to": own(b"warc-refers-to"), "payload": payload, "record_id": text(b"warc-record-id"), "refers_to_id": text(b"warc-refers-to"), "date": text(b"warc-date"), "error": None,
    }


def write_archive(records: list[bytes]) -> bytes:
    """The dictionary's skippable frame, then a frame for each record; no dictionary frame where too little is there to train on."""
    sample, total = [], 0
    for r in records[:SAMPLE_RECORDS]:
        sample.append(r[: SAMPLE_BYTES - total])
        total += len(sample[-1])
        if total >= SAMPLE_BYTES:
            break
    head, trained = b"", None
    if len(sample) >= 8 and total >= 8 * DICTIONARY_BYTES:
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, sample)
        except zstandard.ZstdError:
            trained = None  # samples too much alike
    if trained:
        data = trained.as_bytes()
        head = struct.pack("<II", SKIPPABLE, len(data)) + data
    compressor = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=True)
    return head + b"".join(compressor.compress(r) for r in records)


def read_archive(data: bytes, strict: bool = True) -> Iterator[dict]:
    """The records of an archive, one frame each; not strict: a bad record is a row with an error."""
    at, trained = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        body = data[8 : 8 + size]
        if len(body) != size:
            raise BadRecord("the dictionary frame is cut off")
        if body[:4] == struct.pack("<I", 0xFD2FB528):  # the dictionary itself may be compressed
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        if body[:4] != struct.pack("<I", DICTIONARY):
            raise BadRecord("not a dictionary")
        trained, at = zstandard.ZstdCompressionDict(body), 8 + size
    decompressor, view = zstandard.ZstdDecompressor(dict_data=trained), memoryview(data)
    while at < len(data):
        if len(data) - at >= 8 and struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 == SKIPPABLE & 0xFFFFFFF0:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]  # a frame of no record
            continue
        frame, start, parts = decompressor.decompressobj(), at, []
        while not frame.eof:  # piece by piece: what a piece holds beyond the frame is little, however long the archive
            if at >= len(data):
                raise BadRecord(f"frame at {start} is cut off")
            try:
                parts.append(frame.decompress(view[at : at + PIECE_BYTES]))
            except zstandard.ZstdError as e:
                raise BadRecord(f"frame at {start}: {e}") from e
            at = min(len(data), at + PIECE_BYTES)
        at -= len(frame.unused_data)
        try:
            found = read_record(b"".join(parts))
        except BadRecord as e:
            if strict:
                raise
            found = {"error": f"record at {start}: {e}"}
        yield found


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, record_type and refers_to for each page.

    The least page of each digest is a partial aggregate; only digests that several pages share are joined back, an
    equi-join whose hot digests Spark splits.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sized = pages.select("page_id", "url", payload.alias("payload"))
    sized = sized.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    shared = (
        sized.filter(F.col("payload_bytes") >= MIN_REVISIT)
        .groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .filter((F.col("_n") > 1) & F.col("_first").isNotNull())
        .select("_digest", "_first")
    )
    shared = materialize(shared, "shared-payloads")  # a plain exchange on each side: Spark may split a digest of many pages
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return (
        sized.join(shared, F.col("payload_digest") == F.col("_digest"), "left")
        .withColumn("record_type", F.when(again, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(again, F.col("_first")))
        .drop("_digest", "_first")
    )


def write_archives(pages: DataFrame, name: str = "archives") -> DataFrame:
    """Write pages (page_id, url, html) as archives in the shared folder; the table (archive, data) as read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        records: list[bytes] = []
        held = 0

        def full() -> pa.RecordBatch:
            nonlocal number, held
            batch = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([write_archive(records)], pa.binary())], names=["archive", "data"])
            number, held = number + 1, 0
            records.clear()
            return batch

        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                for row in whole.slice(first, 256).to_pylist():
                    kept = row["payload"] if row["record_type"] == "response" else b""
                    records.append(write_record(row["record_type"], row["page_id"], row["url"], row["payload_digest"], row["payload_bytes"], row["refers_to"], kept))
                    held += len(records[-1])
                    if len(records) >= ARCHIVE_RECORDS or held >= ARCHIVE_BYTES:
                        yield full()
        if records:
            yield full()

    return materialize(plan_records(pages).mapInArrow(run, "archive long, data binary"), name, "uncompressed")


RECORD = [
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ("record_id", pa.string()), ("refers_to_id", pa.string()), ("date", pa.string()), ("error", pa.string()),
]


def read_archives(archives: DataFrame, with_payload: bool = True, data: str = "data", strict: bool = True) -> DataFrame:
    """A row for each record of each archive; payload is null for revisits, whose other fields are those of the full payload.

    strict: a bad record or frame stops the job. Else a bad record is a row with nothing but an error, and so is a frame
    that can't be decoded, with which its archive ends.
    """
    sql = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    schema, arrow = ", ".join(f"{name} {sql[kind]}" for name, kind in RECORD), pa.schema(RECORD)

    def records(archive: bytes) -> Iterator[dict]:
        try:
            yield from read_archive(archive, strict)
        except BadRecord as e:
            if strict:
                raise
            yield {"error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                rows: list[dict] = []
                for record in records(batch.column(0)[row].as_py()):
                    if not with_payload or record.get("record_type") == "revisit":
                        record["payload"] = None
                    rows.append(record)
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return archives.select(data).mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str, with_payload: bool = True, strict: bool = True) -> DataFrame:
    """The records of .warc.zst files at path, of any writer, which Spark's binary reader finds."""
    return read_archives(spark.read.format("binaryFile").load(path), with_payload, "content", strict)


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    archives = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
with sized as (
    select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
first_ as (select *, min(page_id) over (partition by payload_digest) as f from sized)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and f is not null and page_id is distinct from f then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id is distinct from f then f end as refers_to
from first_"""
