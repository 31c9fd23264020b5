"""Candidates, findings, and reports folded to cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import relational as R
from factloom.operators.graph import components


def candidates(classified: DataFrame, active: DataFrame, matched: DataFrame, least: float = 0.7, statuses: tuple[str, ...] = ("NOT_MATCHED",)) -> DataFrame:
    """Active persons whose latest classification is POLITICAL with confidence `least` or more, by list status.

    classified: person, status, confidence, classified_at, id. active: person. matched: person, status. A person without a
    match row was never checked (NO_MATCH_RECORD): that is no absence.
    """
    latest = R.latest_by(classified, ["person"], [F.col("classified_at").desc_nulls_last(), F.col("id").desc()])
    political = latest.filter((F.col("status") == "POLITICAL") & (F.col("confidence") >= least)).select("person", "confidence")
    alive = political.join(active.select("person"), "person", "left_semi")
    checked = alive.join(matched.select("person", F.col("status").alias("list_status")), "person", "left")
    return checked.withColumn("list_status", F.coalesce("list_status", F.lit("NO_MATCH_RECORD"))).filter(F.col("list_status").isin(*statuses))


def upsert_findings(stored: DataFrame, found: DataFrame, run: int) -> DataFrame:
    """The findings after a run, with what happened to each (created, reactivated, kept, deactivated, inactive).

    stored: person, active, first_seen_run, last_seen_run. found: person. first_seen_run never changes.
    """
    now = found.select("person").distinct().withColumn("_now", F.lit(True))
    both = stored.join(now, "person", "full")
    is_now, was = F.col("_now").isNotNull(), F.col("first_seen_run").isNotNull()
    change = (
        F.when(is_now & ~was, "created").when(is_now & ~F.col("active"), "reactivated").when(is_now, "kept").when(F.col("active"), "deactivated").otherwise("inactive")
    )
    return both.select(
        "person", is_now.alias("active"), F.coalesce("first_seen_run", F.lit(run)).alias("first_seen_run"),
        F.when(is_now, run).otherwise(F.col("last_seen_run")).alias("last_seen_run"), change.alias("change"),
    )


def fold_cases(rows: DataFrame) -> DataFrame:
    """(id, case): reports of one person that share a reason or a term, transitively, are one case, named by its least id.

    rows: id (long), person, reason, term (null: none). Each (person, reason) and (person, term) ties its rows to the least
    of them; cases are the components.
    """
    keys = rows.select("id", "person", F.explode(F.array(F.concat(F.lit("r"), F.col("reason").cast("string")), F.concat(F.lit("t"), F.col("term").cast("string")))).alias("k")).filter("k is not null")
    hubs = keys.groupBy("person", "k").agg(F.min("id").alias("hub"))
    edges = keys.join(hubs, ["person", "k"]).select(F.col("id").alias("a"), F.col("hub").alias("b"))
    return components(edges).select(F.col("node").alias("id"), F.col("root").alias("case"))


def represent_cases(rows: DataFrame) -> DataFrame:
    """One row for each case: what its latest row tells, else the first other that tells it; the most common reason; the greatest fine.

    rows: case, id, on (date string), reason, region, fine. Ties: the smaller reason; the greater id is later.
    """
    latest = Window.partitionBy("case").orderBy(F.col("on").desc(), F.col("id").desc())
    whole = latest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = F.first(F.nullif("region", F.lit("")), ignorenulls=True).over(whole)
    shown = rows.withColumn("_r", F.row_number().over(latest)).withColumn("_region", told).filter("_r = 1").select("case", F.col("id").alias("shown"), F.col("on"), F.col("_region").alias("region"))
    reasons = R.mode_by(rows, ["case"], "reason").select("case", "reason")
    totals = rows.groupBy("case").agg(F.count("*").alias("reports"), F.max("fine").alias("fine"))
    return totals.join(shown, "case").join(reasons, "case")
