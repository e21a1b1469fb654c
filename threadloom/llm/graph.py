"""Connected components of an undirected graph, by large-star and small-star rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over (u, v). Large: from each u, its larger neighbours go to its least one. Small: from each u, its lesser ones do.

    The least neighbour comes from a partial aggregate; the join that brings it back is one that Spark splits where
    a u has very many edges.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    got = both.join(least, "u")
    if large:
        return got.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return got.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component: the least node that it reaches. edges: (u, v), u <> v.

    Ends when a round changes nothing, that is when every node points at its component's least node.
    """
    edges = cut(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).select("u", "v").distinct())
    before = None
    for _ in range(most_rounds):
        edges = cut(_star(_star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v")).distinct()
