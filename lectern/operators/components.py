"""Connected components by rounds of minimum labels with hooked roots, entirely in DataFrames.

Every node has a label (a node of its component that is not greater). In a round it sees the least label of
its neighbours' labels; the node takes it, and so does the node that was its label (the root is hooked, so a
smaller label takes a whole basin at once), and then labels move on to their labels. Chains in any order of ids
settle in about as many rounds as their length has binary digits; there is no limit of rounds, they end when nothing moves.

A round is written to the shared folder, which cuts lineage, and the one before is removed; only whether
something moved reaches the driver. Labels are minima, partially aggregated before the shuffle. Where
labels move on, a label that holds many nodes would be a hot key: only distinct labels are looked up, each
under SALTS keys, and the nodes are dealt over these.

edges may repeat, loop or come in either direction. Ids must not be null. No edges: no rows.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources import scratch

SALTS = 8


def connected_components(edges: DataFrame, path: str) -> DataFrame:
    """edges (a long, b long); path: a new folder in the shared folder. node, component (its least node) for every node of an edge."""
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))  # edges are evaluated once
    both = scratch.settled(edges.select(ends.alias("edge")).select("edge.*").distinct(), f"{path}/edges")
    first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    state = scratch.settled(first.withColumn("further", F.col("label")), f"{path}/round-0")
    for turn in count(1):
        near = both.join(state.select(F.col("node").alias("b"), "further"), "b").groupBy(F.col("a").alias("node")).agg(F.min("further").alias("near"))
        own = F.struct("node", F.least("label", "further", "near").alias("label"), F.col("label").alias("old"))
        hooked = F.struct(F.col("label").alias("node"), F.col("near").alias("label"), F.lit(None).cast("long").alias("old"))
        offers = F.when(F.col("near") < F.col("label"), F.array(own, hooked)).otherwise(F.array(own))
        moved = state.join(near, "node").select(F.inline(offers)).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        moved = scratch.settled(moved, f"{path}/moved-{turn}")
        used = moved.select(F.col("label").alias("at")).distinct().join(moved.select(F.col("node").alias("at"), F.col("label").alias("further")), "at")
        salted = used.select(F.col("at").alias("label"), "further", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
        dealt = moved.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        state = scratch.settled(dealt.join(salted, ["label", "salt"]).select("node", "label", "further", "old"), f"{path}/round-{turn}")
        scratch.removed(both.sparkSession, f"{path}/round-{turn - 1}")
        scratch.removed(both.sparkSession, f"{path}/moved-{turn}")
        if not state.where("old <> label OR further <> label").limit(1).count():
            return state.select("node", F.col("label").alias("component"))
