"""Connected components of an edge table by contraction.

Each round lets every node take the smallest of its neighbours and itself,
follows what was taken to its end by doubling, maps both ends of all edges there,
and drops loops and repeats. Only nodes smaller than all their neighbours are
left, at most half of them, so rounds are bounded by the logarithm of the number
of nodes, and doublings within a round by that of the longest descent.
Minima are pre-aggregated before the shuffle, so a hub costs no more than any
node; tables are written between rounds, so a lost executor repeats one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._store import written


def _ends(taken: DataFrame, size: int) -> DataFrame:
    """(node, to) with `to` followed until it takes itself."""
    while True:
        on = taken.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jumped = written(taken.join(on, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "taken", size)
        if not jumped.where("moved").limit(1).count():
            return taken
        taken = jumped.select("node", "to")


def components(edges: DataFrame, size: int | None = None) -> DataFrame:
    """(node, root) for all nodes of `edges` (a, b); root: the component's smallest node. `size`: a bound of how many nodes or edges there are, if known."""
    rest = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", size)
    maps: list[DataFrame] = []
    nodes = 2 * rest.count()
    while left := rest.count():
        both = rest.select(F.col("b").alias("node"), F.col("a").alias("to")).unionAll(rest.select("a", "a"))
        taken = written(both.groupBy("node").agg(F.min("to").alias("to")), "taken", 2 * left)
        taken = _ends(taken, 2 * left)
        maps.append(taken)
        one, two = (taken.select(F.col("node").alias(x), F.col("to").alias(f"{x}2")) for x in "ab")
        moved = rest.join(one, "a").join(two, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        rest = written(moved.where("a <> b").distinct(), "edges", left)
    if not maps:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].select("node", F.col("to").alias("root"))
    for k, step in enumerate(maps[1:]):
        out = out.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        if k % 3 == 2:
            out = written(out, "roots", nodes)
    return written(out, "roots", nodes)
