"""Media columns with content-defined chunking: payloads are stored as 8-bit audio whose chunks are kept once.

A payload is padded to 64 bytes and stored as a WAV file of unsigned 8-bit samples; its ``fact`` chunk keeps the unpadded
length. A gear hash that rolls over the bytes cuts the media where its top bits are zero, so equal passages give equal
chunks wherever they stand. Chunk digests meet in Spark joins: the first media (by id) that holds a chunk owns it, and
every other one refers to it. The store is a written table: a row for each media, with its ordered chunk list and the bytes
of the chunks that it owns, each chunk of the corpus once. A media is read back from the store alone: from its list, its
own chunks and those that its owners' rows give, checked against their digests and the media's own.

Media that share no chunk, most of them in a corpus, are stored where they are read: a filter of the shared digests (of
bounded size, broadcast) tells which media may share one. Where it is too small for the corpus it lets more media through
to the joins, which decide; the store is the same.

Shuffles: lists of digests and lengths; each marked media once, compressed, to its list; in reading, the chunks that
others asked for and the rows that ask. Copies of a payload share a media and travel as ids alone, one of them with its
bytes; a hot chunk is an equi-join key that Spark may split.

Defined cases. Null text: the empty payload, 64 zero bytes. Null keys are kept. Repeated rows and equal texts share a
media. Further columns are dropped. An empty table gives an empty result. Media and chunks are named by 128 bits of their
SHA-256; a false match of a chunk would fail the media's own check.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.base import materialize, table

PAD, RATE = 64, 8000
#: Chunk sizes in bytes: least, most, and the zero bits at a cut (2^10 bytes apart on average beyond the least).
LEAST, MOST, BITS = 256, 8192, 10
WINDOW = 32
HEADER = 56
#: Bits of the marks for a key, and their bounds (32 MB at most).
MARK_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    """A random 32-bit value for each byte, from its digest."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


def to_media(payload: bytes) -> bytes:
    """A WAV file of one channel, 8-bit samples: the payload, padded with zero bytes to a positive multiple of 64."""
    data = payload + b"\0" * ((-len(payload)) % PAD or (PAD if not payload else 0))
    return b"".join([
        struct.pack("<4sI4s", b"RIFF", HEADER - 8 + len(data), b"WAVE"),
        struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8),
        struct.pack("<4sII", b"fact", 4, len(payload)),
        struct.pack("<4sI", b"data", len(data)),
        data,
    ])


def from_media(media: bytes) -> tuple[int, bytes]:
    """Unpadded length and samples."""
    riff, size, wave = struct.unpack_from("<4sI4s", media)
    fact, _, length = struct.unpack_from("<4sII", media, 36)
    data, samples = struct.unpack_from("<4sI", media, 48)
    if (riff, wave, fact, data) != (b"RIFF", b"WAVE", b"fact", b"data") or size != len(media) - 8 or samples != len(media) - HEADER:
        raise ValueError("not a media of this store")
    return length, media[HEADER:]


def cut(data: bytes) -> list[int]:
    """Chunk lengths. The gear hash of a place depends on the WINDOW bytes before it: doubling sums them in five steps."""
    h = gear()[np.frombuffer(data, np.uint8)]
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step)) if len(h) > step else h[step:]
        step *= 2
    cuts, last = [], 0
    for place in [*(np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1).tolist(), len(data)]:
        while place - last > MOST:
            cuts.append(MOST)
            last += MOST
        if place - last >= LEAST or (place == len(data) and place > last):
            cuts.append(place - last)
            last = place
    return cuts


def _pieces(data: bytes, lengths: list[int]) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [data[e - n : e] for e, n in zip(ends, lengths, strict=True)]


def _media_of(text: str | None) -> bytes:
    return to_media((text or "").encode("utf-8", "surrogatepass"))


def media_digest(media: bytes) -> bytes:
    """128 bits: what names a media, or a chunk."""
    return hashlib.sha256(media).digest()[:16]


def chunk_lists(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, media_id (its digest), chunks (array of digest, length), of each row."""
    schema = df.select(key).schema.add("media_id", T.BinaryType()).add("chunks", T.ArrayType(T.StructType().add("digest", T.BinaryType()).add("length", T.IntegerType())))
    chunks = pa.list_(pa.struct([("digest", pa.binary()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                ids, lists = [], []
                for t in batch.column(1).to_pylist():
                    media = _media_of(t)
                    ids.append(media_digest(media))
                    lengths = cut(media)
                    lists.append([(media_digest(c), len(c)) for c in _pieces(media, lengths)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(lists, chunks)], names=[key, "media_id", "chunks"])

    return df.select(key, text).mapInArrow(run, schema)


class Marks:
    """A filter of keys (digests) that errs on one side only: what it doesn't hit is surely not among them."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, 64 * len(words)

    def hit(self, digests: list[bytes]) -> bool:
        return any(all(self.words[(at := int.from_bytes(d[i : i + 4], "big") % self.bits) >> 6] >> np.uint64(at & 63) & np.uint64(1) for i in (0, 4)) for d in digests)


def marks_of(keys: DataFrame) -> Marks:
    """The filter of a column of digests: MARK_BITS bits a key, within bounds; what reaches the driver is its words."""
    n = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, MARK_BITS * n - 1).bit_length()))
    part = lambda i: F.conv(F.hex(F.substring(F.col(keys.columns[0]), i, 4)), 16, 10).cast("long") % bits
    at = keys.select(F.explode(F.array(part(1), part(5))).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("set")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    return Marks(out)


#: A chunk list as stored. from: the chunk's place in the media (its own place: an owned chunk; an earlier one: a chunk
#: that the media holds twice), or null where `owner` holds it as its chunk `at`.
PLAN = "array<struct<seq:int,length:int,digest:binary,from:int,owner:binary,at:int>>"


def marked_media(df: DataFrame, text: str, marks: Marks) -> DataFrame:
    """media_id and the media, compressed for its one shuffle, of those that the marks hit; a batch gives each media once."""
    shared = df.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                media = {}
                for t in whole.column(0).slice(first, 256).to_pylist():
                    m = _media_of(t)
                    name = media_digest(m)
                    if name not in media and shared.value.hit([name, *map(media_digest, _pieces(m, cut(m)))]):
                        media[name] = m
                yield pa.RecordBatch.from_arrays([pa.array(media.keys(), pa.binary()), pa.array([pack.compress(m) for m in media.values()], pa.binary())], names=["media_id", "packed"])

    return df.select(text).mapInArrow(run, "media_id binary, packed binary")


def unmarked_rows(df: DataFrame, text: str, marks: Marks) -> DataFrame:
    """The store's rows of the media that the marks don't hit: they stand alone and own all their chunks."""
    shared = df.sparkSession.sparkContext.broadcast(marks)
    part = pa.struct([("seq", pa.int32()), ("length", pa.int32()), ("digest", pa.binary()), ("from", pa.int32()), ("owner", pa.binary()), ("at", pa.int32())])
    schema = pa.schema([("media_id", pa.binary()), ("plan", pa.list_(part)), ("wanted", pa.list_(pa.int32())), ("own", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 64):
                rows = []
                for t in whole.column(0).slice(first, 64).to_pylist():
                    m = _media_of(t)
                    name, lengths = media_digest(m), cut(m)
                    digests = [media_digest(c) for c in _pieces(m, lengths)]
                    if not shared.value.hit([name, *digests]):
                        rows.append((name, [(i, n, d, i, None, None) for i, (n, d) in enumerate(zip(lengths, digests, strict=True))], None, m))
                columns = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return df.select(text).mapInArrow(run, f"media_id binary, plan {PLAN}, wanted array<int>, own binary")


def _marked_lists(lists: DataFrame, marks: Marks) -> DataFrame:
    """media_id and chunks of the media that the marks hit, once each."""
    shared = lists.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [shared.value.hit([name, *(c["digest"] for c in chunks)]) for name, chunks in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield batch.filter(pa.array(hit, pa.bool_()))

    kept = lists.select("media_id", "chunks").mapInArrow(run, lists.select("media_id", "chunks").schema)
    return kept.groupBy("media_id").agg(F.min("chunks").alias("chunks"))


def _exploded(medias: DataFrame) -> DataFrame:
    return medias.select("media_id", F.posexplode("chunks").alias("seq", "c")).select("media_id", "seq", "c.digest", "c.length")


def _keep_owned(joined: DataFrame) -> DataFrame:
    """The store's rows, from media_id, plan, wanted and packed: of the media's bytes, only the owned chunks stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for whole in batches:
            for first in range(0, whole.num_rows, 64):
                batch = whole.slice(first, 64)
                own = []
                for plan, packed in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                    pieces = _pieces(unpack.decompress(packed.as_py()), [p["length"] for p in plan])
                    own.append(b"".join(pieces[p["seq"]] for p in plan if p["from"] == p["seq"]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.binary())], names=["media_id", "plan", "wanted", "own"])

    return joined.select("media_id", "plan", "wanted", "packed").mapInArrow(run, f"media_id binary, plan {PLAN}, wanted array<int>, own binary")


def write_store(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, media_id) of each row, and the chunk store: media_id, plan, wanted (owned chunks that others ask for), own (bytes).

    Both are written tables; nothing in them leads back to df.
    """
    lists = materialize(chunk_lists(df, key, text), "chunk-lists")
    medias = lists.groupBy("media_id").agg(F.min("chunks").alias("chunks"), F.count("*").alias("n"))
    # written, so that the join has a plain exchange on each side and Spark may split the media that share one chunk
    owners = _exploded(medias).groupBy(F.col("digest").alias("o_digest")).agg(F.min(F.struct("media_id", "seq")).alias("owner"), F.count("*").alias("n"))
    shared = materialize(owners.filter("n > 1").drop("n"), "shared-chunks")
    repeated = materialize(medias.filter("n > 1").select("media_id"), "repeated-media")
    marks = marks_of(shared.select("o_digest").union(repeated))
    chunks = _exploded(_marked_lists(lists, marks))
    refs = chunks.join(shared, F.col("digest") == F.col("o_digest"), "left")
    own = F.when(F.col("owner").isNull(), F.col("seq")).when(F.col("owner.media_id") == F.col("media_id"), F.col("owner.seq"))
    refs = refs.select("media_id", "seq", "length", "digest", own.alias("from"), "owner")
    foreign = F.col("from").isNull()
    asked = refs.filter(foreign).select(F.col("owner.media_id").alias("media_id"), F.col("owner.seq").alias("seq")).distinct()
    wanted = asked.groupBy("media_id").agg(F.sort_array(F.collect_list("seq")).alias("wanted"))
    part = F.struct("seq", "length", "digest", "from", F.when(foreign, F.col("owner.media_id")).alias("owner"), F.when(foreign, F.col("owner.seq")).alias("at"))
    plans = refs.groupBy("media_id").agg(F.sort_array(F.collect_list(part)).cast(PLAN).alias("plan"))
    plans = plans.join(wanted, "media_id", "left")  # a row for each media on all sides: dealt by media_id once
    packed = marked_media(df, text, marks).groupBy("media_id").agg(F.min("packed").alias("packed"))
    joined = _keep_owned(plans.join(packed, "media_id"))
    return lists.select(key, "media_id"), materialize(unmarked_rows(df, text, marks).unionByName(joined), "chunk-store")


def _checked(piece: bytes, part: dict) -> bytes:
    if media_digest(piece) != part["digest"]:
        raise ValueError(f"chunk {part['digest'].hex()} is damaged")
    return piece


def stored_chunks(plan: list[dict], own: bytes) -> dict[int, bytes]:
    """The owned chunks of a row of the store, by their place in the media; a chunk that isn't what its digest says is an error."""
    out, at = {}, 0
    for p in plan:
        if p["from"] == p["seq"]:
            out[p["seq"]] = _checked(own[at : at + p["length"]], p)
            at += p["length"]
    return out


def join_chunks(plan: list[dict], own: bytes, others: dict[int, bytes]) -> bytes:
    """The media, from its ordered chunk list, its owned chunks, and those of other media (by place in this one)."""
    mine = stored_chunks(plan, own)
    return b"".join(_checked(others[p["seq"]], p) if p["from"] is None else mine[p["from"]] for p in plan)


def _given(store: DataFrame) -> DataFrame:
    """The owned chunks that other media refer to: g_media, g_seq, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 64):
                rows = []
                for name, plan, wanted, own in zip(*(c.to_pylist() for c in whole.slice(first, 64).columns), strict=True):
                    mine = stored_chunks(plan, own)
                    rows += [(name, s, mine[s]) for s in wanted]
                names, seqs, data = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(seqs, pa.int32()), pa.array(data, pa.binary())], names=["g_media", "g_seq", "bytes"])

    return store.filter(F.col("wanted").isNotNull()).select("media_id", "plan", "wanted", "own").mapInArrow(run, "g_media binary, g_seq int, bytes binary")


def _rebuild(rows: DataFrame) -> DataFrame:
    """media_id and media, from plan, owned chunks and got; a media whose digest isn't its id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 64):
                batch = whole.slice(first, 64)
                media = []
                for name, plan, own, got in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    media.append(join_chunks(plan, own, {g["seq"]: g["bytes"] for g in got or ()}))
                    if media_digest(media[-1]) != name:
                        raise ValueError(f"media {name.hex()} is damaged")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["media_id", "media"])

    return rows.select("media_id", "plan", "own", "got").mapInArrow(run, "media_id binary, media binary")


def read_store(store: DataFrame) -> DataFrame:
    """media_id and media of every row of a chunk store, from the store alone.

    Media that own all their chunks are put together where they lie; the others are joined with the chunks they ask for.
    """
    asks = F.exists("plan", lambda p: p["from"].isNull())
    alone = store.filter(~asks).withColumn("got", F.array().cast("array<struct<seq:int,bytes:binary>>"))
    asked = store.filter(asks).select(F.col("media_id").alias("to_media"), F.explode(F.filter("plan", lambda p: p["from"].isNull())).alias("p"))
    asked = asked.select("to_media", F.col("p.seq").alias("to_seq"), F.col("p.owner").alias("of_media"), F.col("p.at").alias("of_seq"))
    sent = asked.join(_given(store), (F.col("of_media") == F.col("g_media")) & (F.col("of_seq") == F.col("g_seq")))
    got = sent.groupBy(F.col("to_media").alias("media_id")).agg(F.collect_list(F.struct(F.col("to_seq").alias("seq"), "bytes")).alias("got"))
    return _rebuild(alone.unionByName(store.filter(asks).join(got, "media_id")))


def media_features(medias: DataFrame) -> DataFrame:
    """n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of each media.

    feature: sum, least and greatest sample, and crossings of the middle value.
    """
    schema = "media_id binary, n_bytes long, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"
    arrow = pa.schema([("media_id", pa.binary()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.binary()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.binary()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                media = media.as_py()
                length, samples = from_media(media)
                a = np.frombuffer(samples, np.uint8)
                crossings = int(np.count_nonzero(np.diff(a >= 128)))
                feature = f"sum={int(a.sum(dtype=np.int64))} min={a.min()} max={a.max()} crossings={crossings}"
                rows.append((name, length, len(samples), hashlib.sha256(samples).digest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).digest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(arrow), arrow, strict=True)], schema=arrow)

    return medias.mapInArrow(run, schema)


def op1_content_defined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text written to the chunk store and read back from it."""
    rows, store = write_store(table(spark, sf_dir, "documents"))
    # each media once, and written: the join has a plain exchange on each side, and Spark may split the copies of one media
    features = materialize(media_features(read_store(store)), "media-features")
    hexed = {c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")}  # after the join, which moves half as many bytes
    return rows.join(features, "media_id").drop("media_id").withColumns(hexed)
