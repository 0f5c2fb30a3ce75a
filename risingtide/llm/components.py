"""Connected components of a table of links.

Large-star and small-star rounds (Kiveris et al., 2014): every round rewires the
links towards the smallest neighbour, and the number of links never grows. Minima
are aggregated before the shuffle and written down, so the join that hands them
back reads both sides from a shuffle and adaptive execution can split a hot node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from risingtide.llm.tables import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and its smallest reachable ``root``, for every node that is not a root itself.

    ``links`` has two columns of ids, in any direction. Loops and repeats do no harm.
    """
    a, b = links.columns
    oriented = links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("node"), F.least(a, b).alias("root")
    ).distinct()
    edges = scratch.keep(oriented, "edges")
    while True:
        # Large star: every larger neighbour is linked to the smallest one.
        both = edges.union(edges.select("root", "node")).toDF("at", "other")
        least = scratch.keep(both.groupBy("at").agg(
            F.least("at", F.min("other")).alias("least"), F.count_if(F.col("other") < F.col("at")).alias("below"),
            F.count_if(F.col("other") > F.col("at")).alias("above")), "large")
        # A forest of stars is the end: one root for every node, and no root with a root itself.
        if least.where("below > 1 OR (below > 0 AND above > 0)").isEmpty():
            return edges
        large = scratch.keep(
            both.where("other > at").join(least.select("at", "least"), "at").select("other", "least")
            .where("other != least").distinct().toDF("node", "root"),
            "starred",
        )
        # Small star: smaller neighbours are linked to the smallest one.
        least = scratch.keep(large.groupBy("node").agg(F.min("root").alias("least")), "small")
        joined = large.join(least, "node")
        edges = scratch.keep(
            joined.select(F.col("root").alias("node"), F.col("least").alias("root"))
            .union(joined.select("node", F.col("least").alias("root")))
            .where("node != root").distinct(),
            "edges",
        )
