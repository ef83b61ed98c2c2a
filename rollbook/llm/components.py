"""Connected components of a table that says which members meet in which nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.llm.shared import join_groups, saved

MAX_ROUNDS = 100


def components(edges, member="rid", node="node"):
    """(member, label): the smallest member that can be reached. Nothing is collected; every round is written to the shared folder.

    A round takes the smallest label of each node back to its members, then follows each label to its own label, so long chains
    shrink by half. Aggregations combine before the shuffle, and a label that a third of all members bear is an ordinary key of a
    join that adaptive execution can split.
    """
    edges = saved(edges.select(F.col(member).alias("m"), F.col(node).alias("n")).distinct(), "edges")
    labels = saved(join_groups(edges, edges.groupBy("n").agg(F.min("m").alias("l")), "n").groupBy("m").agg(F.min("l").alias("l")), "labels")
    for _ in range(MAX_ROUNDS):
        of_node = labels.join(edges, "m").groupBy("n").agg(F.min("l").alias("l"))
        near = join_groups(edges, of_node, "n").groupBy("m").agg(F.min("l").alias("near"))
        jump = labels.select(F.col("m").alias("near"), F.col("l").alias("far"))
        moved = near.join(jump, "near").select("m", F.least("near", "far").alias("new"))
        after = saved(moved.join(labels, "m").select("m", F.least("new", "l").alias("l"), (F.least("new", "l") < F.col("l")).alias("moved")), "labels")
        labels = after.select("m", "l")
        if after.where("moved").isEmpty():
            return labels.select(F.col("m").alias(member), F.col("l").alias("label"))
    raise RuntimeError(f"Components did not settle in {MAX_ROUNDS} rounds.")
