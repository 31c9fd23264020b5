"""Answers that models have given, kept by model and input, and what may be asked next within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.storage import materialize


def within_budget(asked: DataFrame, memo: DataFrame, budgets: DataFrame) -> DataFrame:
    """(model, input, priority, cost, spent): inputs without an answer that a model is asked next; spent: with all before it.

    asked: model, input (a digest), priority (of few levels, high first), cost (0 or more; null: 0). memo: model, input,
    of the answers that are kept. budgets: model, budget. An input that is asked several times counts once, with its
    highest priority and cost. Inputs go by priority, then by a hash of model and input, then by input, as long as their
    costs add up to the budget at most; what comes after the first one that doesn't fit waits. No budget: nothing is asked.

    Sums go by block (a priority and a part of the hash), so a model or a priority of most inputs is spread over many tasks,
    and only blocks that begin within the budget are looked into.
    """
    one = asked.groupBy("model", "input").agg(F.max("priority").alias("priority"), F.max(F.coalesce("cost", F.lit(0))).cast("long").alias("cost"))
    pending = one.join(memo.select("model", "input").distinct(), ["model", "input"], "left_anti")
    placed = materialize(pending.withColumn("place", F.md5(F.concat_ws(":", "model", "input").cast("binary"))).withColumn("part", F.left("place", F.lit(2))), "pending")
    block = ["model", "priority", "part"]
    before = Window.partitionBy("model").orderBy(F.col("priority").desc(), "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*block).agg(F.sum("cost").alias("sum")).withColumn("start", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    open_ = starts.join(budgets.select("model", "budget"), "model").filter(F.col("start") <= F.col("budget")).select(*block, "start", "budget")
    inside = Window.partitionBy(*block).orderBy("place", "input").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.join(open_, block).withColumn("spent", F.col("start") + F.sum("cost").over(inside))
    return summed.filter(F.col("spent") <= F.col("budget")).select("model", "input", "priority", "cost", "spent")
