"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.operators.scale import cut


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for edges ``(a, b)`` of long ids: the smallest node reachable.

    Alternates two steps until nothing changes. Large star: each node links its larger neighbours
    to its smallest one; small star: each node links its smaller neighbours to the smallest.
    Smallest neighbours are summed up before the shuffle and joined back, so a node with a great
    many neighbours is a join key that adaptive execution can split, never a list in one task.
    Every step is a written table. Nodes without an edge to another node do not appear.
    """
    links = cut(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    size = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    while size["n"]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large.filter("u <> v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        ).select("e.*").filter("u <> v").distinct()
        links = cut(small)
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == size:
            break
        size = now
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
