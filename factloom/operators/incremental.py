"""What a run has still to do, and answers that were given before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import relational as R


def pending(items: DataFrame, runs: DataFrame, key: str, version: str) -> DataFrame:
    """Items that have no succeeded run of any version, nor any run of this one. runs: key, version, status."""
    done = runs.filter((F.col("status") == "succeeded") | (F.col("version") == version)).select(key)
    return items.join(done, key, "left_anti")


def stale(items: DataFrame, runs: DataFrame, key: str, version: str) -> DataFrame:
    """Items that have a succeeded run, but none of this version; with their latest version."""
    succeeded = runs.filter("status = 'succeeded'")
    latest = R.latest_by(succeeded, [key], [F.col("run").desc()]).select(key, F.col("version").alias("latest"))
    return items.join(latest, key).join(succeeded.filter(F.col("version") == version).select(key), key, "left_anti")


def unsettled(evidence: DataFrame, judged: DataFrame, key: str, changed: str, at: str, settle: str) -> DataFrame:
    """Keys to judge again: never judged, or judged before their last change had settled."""
    joined = evidence.join(judged.select(key, at), key, "left")
    return joined.filter(F.col(at).isNull() | (F.col(at) < F.col(changed) + F.expr(f"interval {settle}")))


def changed_runs(runs: DataFrame, keys: Sequence[str], order: str, digest: str) -> DataFrame:
    """Runs whose digest differs from that of the nearest earlier run of the same keys."""
    before = F.lag(digest).over(Window.partitionBy(*keys).orderBy(order))
    return runs.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.col(digest))).drop("_b")


def recall_answers(asked: DataFrame, answers: DataFrame, key: str, digest: str) -> DataFrame:
    """asked with answer and told_by: by equal input (digest), else an earlier positive answer for the key, else null (to be asked).

    answers: key, digest, answer (boolean), at. The latest answer counts.
    """
    latest = [F.col("at").desc()]
    exact = R.latest_by(answers, [key, digest], latest).select(key, digest, F.col("answer").alias("_exact"))
    sticky = R.latest_by(answers.filter("answer"), [key], latest).select(key, F.col("answer").alias("_sticky"))
    joined = asked.join(exact, [key, digest], "left").join(sticky, key, "left")
    told = F.when(F.col("_exact").isNotNull(), "input").when(F.col("_sticky").isNotNull(), "key").otherwise("ask")
    return joined.withColumn("answer", F.coalesce("_exact", "_sticky")).withColumn("told_by", told).drop("_exact", "_sticky")


def done_marks(marks: DataFrame, news: DataFrame, key: str) -> DataFrame:
    """Marks (key, at) that no later news (key, at) has undone."""
    last = news.groupBy(key).agg(F.max("at").alias("_n"))
    return marks.join(last, key, "left").filter(F.col("_n").isNull() | (F.col("_n") <= F.col("at"))).drop("_n")
