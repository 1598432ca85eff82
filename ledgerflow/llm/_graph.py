"""Connected components of a link table, as repeated contraction in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm._spark import saved, small


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node reachable.

    Each round maps every node to the least of itself and its neighbours (a partial minimum, so hubs cost no
    more than others) and replaces links by links between the images, until none are left. The order is that of the
    nodes, which folds a star in two rounds, and from the third round on every other time one of fresh
    hashes, which shrinks a chain by a constant factor whatever its numbering. Null ends are ignored; no links give no rows.
    """
    e = saved(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    for turn in range(max_rounds):
        if e.isEmpty():
            break
        rank = (lambda x: x) if turn < 2 or turn % 2 else (lambda x, t=turn: F.xxhash64(x, F.lit(t)))
        first = F.when(rank(F.col("a")) <= rank(F.col("b")), F.col("a")).otherwise(F.col("b"))
        ends = e.select(F.explode(F.array("a", "b")).alias("node"), first.alias("to"))
        to = small(saved(ends.groupBy("node").agg(F.min(F.struct(rank(F.col("to")).alias("r"), "to")).alias("x")).select("node", F.col("x.to").alias("to"))))
        maps.append(to)
        a, b = to.select(F.col("node").alias("a"), F.col("to").alias("ta")), to.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = e.join(a, "a").join(b, "b").where("ta <> tb")
        e = saved(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    else:
        raise RuntimeError("components: links left after the last round")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    out = maps[0].select("node", F.col("to").alias("component"))
    for m in maps[1:]:
        step = m.select(F.col("node").alias("component"), F.col("to").alias("next"))
        out = out.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    if len(maps) > 2:  # what a hashed order ends in need not be the smallest
        out = saved(out)
        least = small(saved(out.groupBy("component").agg(F.min("node").alias("least"))))
        out = out.join(least, "component").select("node", F.col("least").alias("component"))
    return saved(out)
