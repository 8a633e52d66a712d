"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.llm.common import dropped, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node that isn't the smallest of its component, that smallest node; a stored table.

    Edges with a null end and loops are ignored; repeated edges count once. Each round is written to the shared
    folder, so lineage stays short, and the one before is deleted; the driver sees a count and a checksum of each round.
    """
    big, small = F.greatest(a, b), F.least(a, b)
    e = stored(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(big.alias("node"), small.alias("root")).distinct(), "components")
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return e
        seen = mark
        both = e.select(F.col("node").alias("u"), F.col("root").alias("v")).union(e.select("root", "node"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pulled = large.join(least, "u").where("v != m").select(F.col("v").alias("node"), F.col("m").alias("root"))
        before, e = e, stored(pulled.union(least.select("u", "m")).distinct(), "components")
        dropped(before)
