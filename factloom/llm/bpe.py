"""Byte-level BPE: encoding by a priority queue of merges over a doubly linked symbol list, decoding by concatenation.

A piece (the pre-tokenizer's unit) starts as its bytes' symbols. Every adjacent pair that has a rank waits in a heap as
(rank, place); the least is merged, its neighbours are linked anew and give new heap entries, and entries whose symbols
have changed meanwhile are skipped when they come up. Pieces repeat, so their ids are kept in a bounded table for each
Python worker. Texts are whole; work is O(n log n) even where one piece is the whole text.

Defined cases. A null text counts as empty: no ids, decoded ''. Added (special) token strings inside a text become their
own ids, as in the tokenizers library's default. Other columns are dropped but for the key. An empty table gives none.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.base import spread, table

#: Fixed value: white space as Unicode's White_Space property has it.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the byte-level pre-tokenizer's pattern, white space spelled out.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Bytes of a worker's table of pieces (it is emptied when full), what an entry takes besides its own bytes, and the longest piece kept.
KEPT_BYTES, ENTRY_BYTES, LONGEST = 96 << 20, 160, 64


def byte_alphabet() -> dict[int, str]:
    """Byte -> the character that stands for it: printable Latin-1 itself, the rest from U+0100 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        letters = byte_alphabet()
        self.byte_id = [ids[letters[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in letters.items()}
        names = {i: t for t, i in ids.items()} | {i: t for t, i in self.added.items()}
        self.strings = [bytes(back[c] for c in names[i]) if i in names else b"" for i in range(max(names) + 1)]
        self.pieces = regex.compile(PIECES)
        # longest first, so that no added token hides a longer one
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.kept: dict[str, bytes] = {}
        self.held = 0

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        symbol = [self.byte_id[b] for b in piece]
        n = len(symbol)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merges, queue = self.merges, []
        for at in range(n - 1):
            if found := merges.get((symbol[at], symbol[at + 1])):
                queue.append((found[0], at, symbol[at], symbol[at + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, at, left, right, whole = heapq.heappop(queue)
            other = after[at]
            if symbol[at] != left or other < 0 or symbol[other] != right:
                continue  # stale: one of the two has been merged since
            symbol[at], symbol[other] = whole, -1
            after[at] = after[other]
            if after[at] >= 0:
                before[after[at]] = at
                if found := merges.get((whole, symbol[after[at]])):
                    heapq.heappush(queue, (found[0], at, whole, symbol[after[at]], found[1]))
            if before[at] >= 0 and (found := merges.get((symbol[before[at]], whole))):
                heapq.heappush(queue, (found[0], before[at], symbol[before[at]], whole, found[1]))
        return [s for s in symbol if s >= 0]

    def _ids(self, word: str) -> bytes:
        """The ids of a piece; short ones are kept."""
        found = self.kept.get(word)
        if found is None:
            found = np.array(self.merge(word.encode("utf-8", "surrogatepass")), np.int32).tobytes()
            if len(word) <= LONGEST:
                if self.held >= KEPT_BYTES:
                    self.kept.clear()
                    self.held = 0
                self.kept[word] = found
                self.held += ENTRY_BYTES + 4 * len(word) + len(found)
        return found

    def _plain(self, text: str) -> bytes:
        words = self.pieces.findall(text)
        try:
            return b"".join(map(self.kept.__getitem__, words))
        except KeyError:
            return b"".join(map(self._ids, words))

    def encode(self, text: str) -> np.ndarray:
        if not self.split or not (found := list(self.split.finditer(text))):
            return np.frombuffer(self._plain(text), np.int32)
        parts, at = [], 0
        for m in found:
            parts += [self._plain(text[at : m.start()]), np.int32(self.added[m[0]]).tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*parts, self._plain(text[at:])]), np.int32)

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One model for each Python worker."""
    return Bpe(path)


def encode_decode(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int) and decoded (the text that these ids give back), for each row of df."""
    schema = df.select(key).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer)
        for whole in batches:
            for first in range(0, whole.num_rows, 256):  # small outputs: a long text's ids are many times its size
                batch = whole.slice(first, 256)
                ids = [model.encode(t or "") for t in batch.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.array([], np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([model.decode(x) for x in ids], pa.string())], names=[key, "ids", "decoded"])

    return df.select(key, text).mapInArrow(run, schema)


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded; the digests of both."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    coded = encode_decode(docs, byte_bpe_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
