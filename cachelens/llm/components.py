"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.llm.common import dropped, release, workspace, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges`` (``u``, ``v``, any comparable type).

    Alternates large-star and small-star steps until the edges stop changing: each step links a node's neighbours to
    its least neighbour.  Self loops and repeated edges do no harm.  Every round is written to the shared folder.  Hub nodes
    are joined to their one least neighbour, so a large component costs rows in proportion to its edges; least neighbours are written before
    they are joined, so that Spark can split the edges of a hub.  Rounds grow with the logarithm of a component's length; ``most_rounds`` is far
    above what any table needs, and passing it is an error.
    """
    spark, home = edges.sparkSession, workspace(edges.sparkSession, "components")
    # each edge from its larger to its smaller end
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, last = written(down, f"{home}/0"), None
    for k in range(1, most_rounds + 1):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{home}/least-{k}")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, f"{home}/large-{k}")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{home}/low-{k}")
        small = large.join(low, "u")
        star = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        following = written(star, f"{home}/{k}")
        mark = following.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))").alias("s")).first()
        dropped(spark, *[f"{home}/{x}" for x in (k - 1, f"least-{k}", f"large-{k}", f"low-{k}")])
        current = following
        if mark == last or mark["n"] == 0:
            break
        last = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    release(spark)
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def smallest_of(members: DataFrame, groups: DataFrame, node: str, name: str) -> DataFrame:
    """``node, name`` for every row of ``members`` (``node, least``): the smallest ``least`` of the node's component, or its own where it has none.

    The table of components is written before it is joined with its members, so that Spark can split a component that very many are in.
    """
    spark = members.sparkSession
    own = members.join(groups.select(F.col("node").alias(node), "component"), node, "left").select(node, "least", F.coalesce("component", node).alias("component"))
    own = written(own, workspace(spark, "members"))
    smallest = written(own.groupBy("component").agg(F.min("least").alias(name)), workspace(spark, "smallest"))
    return own.join(smallest, "component").select(node, name)
