"""Dependencies between resources: resolution, cycles, levels, operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, written

TRIPLE = ["service", "type", "id"]
# The stages of a replay, in order.
STAGES = ("base", "mutable", "links", "data")


def resolved(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges whose target is selected: equal identity, and an equal ARN that is not empty."""
    on = [F.col(f"e.to_{c}") == F.col(f"s.{c}") for c in TRIPLE] + [F.col("e.to_arn") == F.col("s.arn"), F.col("s.arn") != ""]
    return edges.alias("e").join(selected.alias("s"), on, "left_semi")


def unresolved(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """The other edges: each is taken out and becomes a finding."""
    on = [F.col(f"e.to_{c}") == F.col(f"s.{c}") for c in TRIPLE] + [F.col("e.to_arn") == F.col("s.arn"), F.col("s.arn") != ""]
    return edges.alias("e").join(selected.alias("s"), on, "left_anti")


def extracted(resources: DataFrame, links: str = "notifications") -> DataFrame:
    """Edges from a column of target ARNs, one per resource and target."""
    arn = F.explode(links).alias("to_arn")
    edges = resources.select(*[F.col(c).alias(f"from_{c}") for c in TRIPLE], arn).dropDuplicates()
    parts = F.split("to_arn", ":", 6)
    return edges.withColumn("to_service", F.element_at(parts, 3)).withColumn("to_id", F.element_at(parts, 6))


def rewritten(rows: DataFrame, arn_map: DataFrame, column: str) -> DataFrame:
    """Captured ARNs replaced by local ones; those without one stay."""
    to = arn_map.select(F.col("captured").alias(column), "local")
    return rows.join(to, column, "left").withColumn(column, F.coalesce("local", column)).drop("local").select(*rows.columns)


#: Lengths stop here: only nodes behind a cycle, which get no level, come so far.
_FAR = 1 << 40


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): level 0 depends on nothing, the others on the longest way there; nodes on or behind a cycle get null.

    ``nodes``: node; ``edges``: node, needs. Each round settles the nodes all of whose
    needs are settled, and lets every edge to a node with one open need jump over it,
    taking that node's settled needs along. So a chain of n nodes takes about log2 n
    rounds; a node of several open needs stops jumps, and a ladder of such takes a
    round a rung. The first round that settles nothing is the last: what is left then
    lies on or behind a cycle.
    """
    all_ = written(nodes.select("node").distinct(), "graph-nodes")
    ends = all_.select(F.col("node").alias("needs"))
    open_ = written(edges.select("node", "needs").distinct().join(ends, "needs", "left_semi").join(all_, "node", "left_semi").select("node", "needs", F.lit(1).cast("long").alias("way")), "graph-edges")
    # What a node's settled needs come to so far; settled nodes have no open edge.
    least = written(all_.withColumn("level", F.lit(0).cast("long")), "graph-levels")
    settled = 0
    while True:
        counts = open_.groupBy("node").agg(F.count("*").alias("n"), F.min("needs").alias("to"), F.max("way").alias("step"))
        done = least.join(counts.select("node"), "node", "left_anti")
        now = done.count()
        if now == settled:
            break
        settled = now
        over = counts.where("n = 1 AND to <> node").select(F.col("node").alias("needs"), "to", "step").join(least.select(F.col("node").alias("needs"), F.col("level").alias("over")), "needs")
        told = open_.join(done.select(F.col("node").alias("needs"), F.col("level").alias("reached")), "needs", "left").join(over, "needs", "left")
        below = F.coalesce("reached", "over")
        onward = F.when(F.col("reached").isNull(), F.coalesce("to", "needs"))
        told = told.select("node", onward.alias("needs"), F.least(F.col("way") + F.coalesce("step", F.lit(0)), F.lit(_FAR)).alias("way"), F.when(below.isNotNull(), F.least(F.col("way") + below, F.lit(_FAR))).alias("found"))
        told = written(told, "graph-told")
        gained = told.groupBy("node").agg(F.max("found").alias("found"))
        older, open_old = least, open_
        least = written(older.join(gained, "node", "left").select("node", F.greatest("level", F.coalesce("found", F.lit(0))).alias("level")), "graph-levels")
        open_ = written(told.where("needs IS NOT NULL").groupBy("node", "needs").agg(F.max("way").alias("way")), "graph-edges")
        for table in (older, open_old, told):
            dropped(table)
    return all_.join(done, "node", "left").select("node", F.col("level").cast("int").alias("level"))


def in_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on a cycle or between cycles: what peeling from both ends leaves."""
    behind = levels(nodes, edges).where("level IS NULL").select("node")
    ahead = levels(nodes, edges.select(F.col("needs").alias("node"), F.col("node").alias("needs"))).where("level IS NULL").select("node")
    return behind.intersect(ahead)


def operations(snapshots: DataFrame, has_links: Column, has_data: Column) -> DataFrame:
    """The steps of each snapshot: ensure, apply, link if it has links, upsert if it has data."""
    step = lambda stage, action: F.struct(F.lit(stage).alias("stage"), F.lit(action).alias("action"))
    steps = F.array_compact(F.array(step("base", "ensure"), step("mutable", "apply"), F.when(has_links, step("links", "link")), F.when(has_data, step("data", "upsert"))))
    out = snapshots.select(*TRIPLE, F.explode(steps).alias("s")).select(*TRIPLE, "s.stage", "s.action")
    return out.withColumn("operation_id", F.concat_ws(":", "service", "type", "id", "action"))
