"""How many rows the operators of a query's plan give out, to hold a query against growth that its input doesn't explain."""

from __future__ import annotations


def most_joined(df) -> int:
    """The most rows that a join or a generator of df's plan gave out; df is run for it."""
    df.collect()
    found, left = [0], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            left.append(node.plan())
            continue
        metric = node.metrics().get("numOutputRows")
        if ("Join" in name or "Generate" in name) and metric.isDefined():
            found.append(metric.get().value())
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return max(found)
