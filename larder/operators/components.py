"""Connected components of a graph that is given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.sources.staging import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, the root being the least node that it is connected with.

    Rounds of two steps hang each node's greater, then its lesser neighbours onto the
    least of them; a chain of n nodes takes about log n rounds. A step joins edges with
    one minimum for each node, so no list of neighbours is ever gathered, and a node of very many edges is
    split like any skewed join. Edges with a null end are left out, loops and repeated edges are harmless.
    """
    known = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = known
    now, seen = written(known.filter("u <> v").distinct(), "components"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        far = both.filter("v > u").join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).filter("x <> y")
        down = far.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        near = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = written(near.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "components")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen = mark
    everyone = nodes.select(F.col("u").alias("node")).union(nodes.select(F.col("v"))).distinct()
    return everyone.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
