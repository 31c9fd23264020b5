"""Language identification as a mixture: expectation-maximisation of each document's language proportions.

Training counts character trigrams (letters in lower case, everything else one blank) in FEATURES hash buckets for each
language, over labelled rows; where a language has more than TRAIN_ROWS of them, a hash of the key picks about that many
(a documented bound: the model doesn't grow with the rows). Every label is learned: the model holds the buckets that occur
in each language, and one number a language for the others; it grows with the number of languages alone, as does what one
text needs (its buckets by the languages). A document's trigrams are draws from a mixture of languages;
EM finds the proportions, and of the nested sets of the likeliest languages that with the best likelihood less PENALTY x
(languages) x ln(trigrams) is kept. Proportions are fitted again on the kept set: the prediction is its largest language,
the score that language's proportion in it.

Defined cases. Text null or without a letter: ``und``, score 0, no languages; so with no trained language. Null labels
aren't learned from. Ties go to the earlier name. Whole texts count, however long. Repeated rows count each. Other columns
of df are kept; those named as the three added ones are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.base import spread, table

FEATURES = 1 << 15
#: Documented bound of the model: training rows of a language, about. Languages whose counts a task holds at a time.
TRAIN_ROWS, HELD_LANGUAGES = 20_000, 256
SMOOTHING, PENALTY, SHARE, ROUNDS = 0.2, 3.0, 0.03, 40


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def trigram_buckets(text: str) -> np.ndarray:
    """Hash buckets of the trigrams; none where there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, 0)
    if not codes.any():
        return np.array([], np.int64)
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint64)
    kept = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    mixed = kept[:-2] * np.uint64(0x9E3779B97F4A7C15) + kept[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + kept[2:] * np.uint64(0x165667B19E3779F9)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """Likelihoods by bucket: `columns` and `values` from starts[bucket] on, `rest` of a language for buckets it doesn't have."""

    languages: list[str]
    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    rest: np.ndarray

    def likelihood(self, buckets: np.ndarray) -> np.ndarray:
        """buckets x languages."""
        out = np.tile(self.rest.astype(float), (len(buckets), 1))
        first, size = self.starts[buckets], self.starts[buckets + 1] - self.starts[buckets]
        rows = np.repeat(np.arange(len(buckets)), size)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        out[rows, self.columns[at]] = self.values[at]
        return out


def model_of(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
    """The smoothed likelihoods of (buckets, counts) of each language."""
    languages = sorted(counts)
    sums = np.array([counts[k][1].sum() + SMOOTHING * FEATURES for k in languages])
    columns = np.repeat(np.arange(len(languages), dtype=np.int32), [len(counts[k][0]) for k in languages])
    buckets, n = (np.concatenate([counts[k][i] for k in languages]) if languages else np.zeros(0, np.int64) for i in (0, 1))
    order = np.argsort(buckets, kind="stable")
    starts = np.searchsorted(buckets[order], np.arange(FEATURES + 1))
    values = ((n + SMOOTHING) / sums[columns]).astype(np.float32)
    return LanguageModel(languages, starts, columns[order], values[order], (SMOOTHING / sums).astype(np.float32))


def train(df: DataFrame, label: str, text: str, key: str, rows: int = TRAIN_ROWS) -> LanguageModel:
    """The model of all labels of df; the driver holds it, and a row for each label."""
    labelled = df.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    sizes = labelled.groupBy(F.col(label).alias("_label")).agg(F.least(F.lit(1.0), rows / F.count("*")).alias("_share"))
    known = sizes.collect()
    if not known:
        return model_of({})
    shares = F.broadcast(df.sparkSession.createDataFrame(known, sizes.schema))  # a row for each language, as in the model
    picked = labelled.join(shares, F.col(label) == F.col("_label")).filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < F.col("_share") * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def full() -> Iterator[pa.RecordBatch]:
            for language, n in totals.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["language", "bucket", "n"])
            totals.clear()

        for batch in batches:
            for language, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if language not in totals:
                    if len(totals) == HELD_LANGUAGES:
                        yield from full()
                    totals[language] = np.zeros(FEATURES, np.int64)
                totals[language] += np.bincount(trigram_buckets(t.as_py()), minlength=FEATURES)
        yield from full()

    counts = picked.select(label, text).mapInArrow(count, "language string, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    found = {r._label: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for r in known}
    for r in counts.groupBy("language").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("n")).toLocalIterator():  # a row for each language, FEATURES in it at most
        found[r.language] = (np.array([x.bucket for x in r.n], np.int64), np.array([x.n for x in r.n], np.int64))
    return model_of(found)


def mixture(likelihood: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the columns and the log likelihood, by EM from equal parts."""
    n, share = counts.sum(), np.full(likelihood.shape[1], 1.0 / likelihood.shape[1])
    for _ in range(ROUNDS):
        new = share * (likelihood.T @ (counts / (likelihood @ share))) / n
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(counts @ np.log(likelihood @ share))


def infer(model: LanguageModel, text: str | None) -> tuple[str, float, list[str]]:
    """Prediction, score and language set of one text."""
    at = trigram_buckets(text or "") if model.languages else []
    if not len(at):
        return "und", 0.0, []
    counts = np.bincount(at)
    seen = np.flatnonzero(counts)
    counts, likelihood = counts[seen].astype(float), model.likelihood(seen)
    share, _ = mixture(likelihood, counts)
    order = np.argsort(-share, kind="stable")
    best, kept, fitted, cost = -np.inf, order[:1], np.ones(1), PENALTY * np.log(counts.sum() + 1)
    for size in range(1, len(order) + 1):
        if size > 1 and share[order[size - 1]] < SHARE:
            break
        part = likelihood[:, order[:size]]
        parts, gain = (np.ones(1), float(counts @ np.log(part[:, 0]))) if size == 1 else mixture(part, counts)
        if gain - cost * size > best:
            best, kept, fitted = gain - cost * size, order[:size], parts
    first = min(range(len(kept)), key=lambda i: (-fitted[i], model.languages[kept[i]]))
    return model.languages[kept[first]], float(min(1.0, fitted[first])), sorted(model.languages[i] for i in kept)


ADDED = ("lang_pred", "score", "lang_set")


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """df with lang_pred, score and lang_set (array of names)."""
    df = df.drop(*ADDED)
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_set", T.ArrayType(T.StringType()))])
    shared, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                lang, score, kept = zip(*[infer(shared.value, t) for t in batch.column(at).to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(kept, pa.list_(pa.string()))], names=names)

    return df.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows whose checksum of the key as text leaves 2 when divided by 4 are never learned from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()), "lang", "text", "doc_id")
    out = identify(spread(docs.select("doc_id", "text")), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_set")
