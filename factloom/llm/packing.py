"""Packing by power-of-two decomposition: documents are cut into pieces of binary lengths, and equal lengths share a bucket.

A document of L ids (its end id included) is cut into L div max_length pieces of max_length and one piece for each binary
digit of the rest, longest first. Every piece is a sequence of its own, of a power of two in length, so no sequence
crosses documents and none is padded; training draws its batches from the buckets of equal length.

Defined cases. A null text is an empty one: its end id alone. Repeated rows are documents of their own. Null keys are
kept. An empty table gives an empty result; columns other than key and text are dropped.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.base import gapless, materialize, spread, table

MAX_LENGTH = 4096
END_ID = 2
#: Buckets in which the sequences of one length are numbered.
NUMBER_BUCKETS = 2048

#: Texts of these characters alone are looked up word by word; all others go to the tokenizers library whole.
#: (Composed Latin letters only: normalization leaves them alone, and lower-casing has no context. U+0130 is left out.)
_SIMPLE = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u017f]*")
#: Bytes of a worker's table of words (it is emptied when full), what an entry takes besides its own bytes, and the longest word kept.
KEPT_BYTES, ENTRY_BYTES, LONGEST = 192 << 20, 160, 64


class WordTokenizer:
    """ids of whole texts as little-endian 32-bit bytes, by the tokenizers library.

    No token spans white space, so words that repeat are looked up; a text's new words go to the library in one call.
    Words of letters alone need neither its normalizer nor its pattern (they are lower-cased, one piece each).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.library, self.letters):
            t.no_truncation()
            t.no_padding()
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.kept: dict[str, bytes] = {}
        self.held = 0

    def _keep(self, word: str, ids: bytes) -> None:
        self.kept[word] = ids
        self.held += ENTRY_BYTES + 4 * len(word) + len(ids)

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ask(self, tokenizer, words: list[str]) -> None:
        """One call for many words; offsets tell their tokens apart."""
        found = tokenizer.encode(" ".join(words), add_special_tokens=False)
        data = np.array(found.ids, "<u4").tobytes()
        starts, first, place = [s for s, _ in found.offsets], 0, 0
        for word in words:
            place += len(word) + 1
            last = bisect_left(starts, place, first)
            self._keep(word, data[4 * first : 4 * last])
            first = last

    def _learn(self, words: list[str]) -> None:
        kept = self.kept
        if self.held >= KEPT_BYTES:
            kept.clear()
            self.held = 0
        # a word of letters and one mark is that word and that mark
        marked = [w for w in words if w[-1] in ".," and w[:-1].isalpha()]
        letters = list({w for w in [*(w[:-1] for w in marked), *(w for w in words if w.isalpha())] if w not in kept})
        others = [w for w in {".", ",", *words} - set(marked) if w not in kept and not w.isalpha()]
        for tokenizer, part in ((self.letters, letters), (self.library, others)):
            if part:
                self._ask(tokenizer, part)
        for w in marked:
            self._keep(w, kept[w[:-1]] + kept[w[-1]])

    def encode(self, text: str) -> bytes:
        if "<|" in text or not _SIMPLE.fullmatch(text):
            return self._ids(text)
        words = text.lower().split()
        try:
            return b"".join(map(self.kept.__getitem__, words))
        except KeyError:
            new = list({w for w in words if w not in self.kept})
            if max(map(len, new)) > LONGEST:  # words without end aren't kept
                return self._ids(text)
            for at in range(0, len(new), 2000):
                self._learn(new[at : at + 2000])
            try:
                return b"".join(map(self.kept.__getitem__, words))
            except KeyError:  # the table was emptied on the way
                return self._ids(text)


@lru_cache(maxsize=4)
def load(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def binary_pieces(length: int, max_length: int = MAX_LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces: as many of max_length as fit, then the powers of two of the rest, longest first."""
    out = [(s, max_length) for s in range(0, length - max_length + 1, max_length)]
    at = len(out) * max_length
    for bit in range(max_length.bit_length() - 1, -1, -1):
        if (length - at) >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def cut_documents(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", max_length: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens and, if asked for, ids (array of int)."""
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length must be a power of two")
    schema = df.select(key).schema.add("start", "long").add("length", "long").add("ids_crc32", "long").add("doc_tokens", "long")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = load(tokenizer), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                rows, numbers, ids = [], [], []
                for row, t in enumerate(batch.column(1).to_pylist()):
                    data = memoryview(model.encode(t or "") + end)
                    tokens = len(data) // 4
                    for start, length in binary_pieces(tokens, max_length):
                        part = data[4 * start : 4 * (start + length)]
                        rows.append(row)
                        numbers.append((start, length, zlib.crc32(part), tokens))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in np.array(numbers, np.int64).reshape(-1, 4).T)]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(key, text).mapInArrow(run, schema)


def pack(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", max_length: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """The pieces with sequence_id (gapless over all, lengths in falling order) and offset in the sequence (0: it is alone).

    The pieces are written once, because numbering reads them twice and tokenizing is dear. Lengths are 13 at most, so
    one length may hold a third of all pieces: its numbers are dealt in buckets of the piece's place in the written
    table, so documents that repeat, or have no key, are dealt out like all others.
    """
    cut = cut_documents(df, tokenizer, key, text, max_length, end_id, with_ids)
    pieces = materialize(cut.withColumn("_place", F.monotonically_increasing_id()), "pieces")
    bucket = F.pmod(F.xxhash64("_place"), F.lit(NUMBER_BUCKETS)).cast("int")
    numbered = gapless(pieces, ["length"], bucket, [F.col("_place")], "_slot", NUMBER_BUCKETS).drop("_place")
    totals = pieces.groupBy("length").agg(F.count("*").alias("_n"))
    longer = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)  # 13 rows: one for each length
    bases = totals.select("length", F.coalesce(F.sum("_n").over(longer), F.lit(0)).alias("_base"))
    return (
        numbered.join(F.broadcast(bases), "length")
        .withColumn("sequence_id", F.col("_slot") + F.col("_base"))
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("_slot", "_base")
    )


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of binary length; sequences of 4096 ids at most, unpadded."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = pack(docs, word_bpe_path(), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
