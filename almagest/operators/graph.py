"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.session import cut


def components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) of each row of `nodes` (node), the component being
    its smallest node, from edges (a, b). In each round every node's
    larger neighbours are linked to its smallest one, then likewise its smaller
    ones, until the edges stay as they are: a logarithmic number of rounds,
    each cut in the shared checkpoint folder. Loops and repeated edges do no
    harm; a node without an edge is its own component."""
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        links = F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        edges = cut(large.join(least, "u").select(links.alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.select("node").join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
