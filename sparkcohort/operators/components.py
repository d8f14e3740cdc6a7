"""Connected components by alternating large-star and small-star rounds.

Every round is a min-aggregate per node (combined before the shuffle) joined
back to the edges, so neither a hub node nor a long chain collects into one task
and nothing is gathered on the driver but one row of counters a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcohort.sources.storage import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b <= a")
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(low, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, ws: Workspace, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the component's smallest node.

    ``edges`` has two long columns, in any order, repeated or not; self-loops
    are ignored.  An empty input gives an empty result.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct()
    now = ws.save(now, "cc0")
    state = None
    for i in range(1, max_rounds + 1):
        nxt = ws.save(_star(_star(now, True), False), f"cc{i}")
        ws.drop(f"cc{i - 1}")
        now = nxt
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        state = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
