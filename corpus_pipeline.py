"""The corpus pipeline: language identification, near-duplicate removal, redaction of personal data, and packing.

Each stage is one operator of factloom.llm, takes (spark, docs, sf_dir) and returns a DataFrame that the next one rereads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import jaccard, langid, packing, pii
from factloom.llm.base import materialize, spread, table
from factloom.session import share_code

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of texts that go to a Python worker at a time, about, unless the session says otherwise: Spark's own limits (10,000
#: rows, 64 MB) leave a batch of tens of MB in the JVM's direct memory and again, some times over, in each worker.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, of a language that the model knows; lang becomes the predicted one. The rest goes."""
    model = langid.train(docs.filter(~langid.held_out()), "lang", "text", "doc_id")
    found = langid.identify(spread(docs.select(*COLUMNS)), model)
    return found.filter(F.col("lang_pred") != "und").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the least by doc_id, then text digest. Five-word shingles, similarity
    0.8 or more. Repeated rows are one document; documents without words link with nothing and stay.
    """
    keyed = docs.select(*COLUMNS, F.struct("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")).alias("_key"))
    classes = jaccard.set_classes(keyed, "_key", "text", width=5, share=(80, 100))
    kept = classes.filter(F.col("_key") == F.col("component_id")).groupBy("_key").agg(F.count("*").alias("_n"))
    kept = materialize(kept, "kept")
    rows = keyed.join(kept, "_key")
    once = rows.select(*COLUMNS)
    if kept.filter("_n > 1").isEmpty():
        return once
    again = rows.filter("_n > 1").dropDuplicates(["_key"]).select(*COLUMNS)
    return rows.filter("_n = 1").select(*COLUMNS).unionByName(again)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose personal data are replaced by their kind in brackets; n_chars is the new length."""
    found, _ = pii.find_spans(spread(docs.select(*COLUMNS)), "text")
    return pii.redact(found, "text").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, in sequences of binary length, with its ids."""
    return packing.pack(spread(docs.select("doc_id", "text")), packing.word_bpe_path(), with_ids=True).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shared(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        share_code(spark)
        if spark.conf.get(BATCH_SETTING, None) is None:
            spark.conf.set(BATCH_SETTING, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language", _shared(identify_language)),
    ("near_duplicates", _shared(remove_near_duplicates)),
    ("personal_data", _shared(redact_personal_data)),
    ("packing", _shared(pack_sequences)),
]

#: Models are trained and spans classified on the way, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
