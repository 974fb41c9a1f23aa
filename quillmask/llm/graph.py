"""Connected components by alternating large and small stars, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.common import written


def _mark(df: DataFrame):
    return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is the smallest node that can be reached.

    Rounds grow with the logarithm of the largest component; each is written to the shared folder.  Nodes without an
    edge to another node do not appear.
    """
    cur = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = _mark(cur)
    while seen[0]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        pairs = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        nxt = written(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
        now = _mark(nxt)
        if now == seen:
            break
        cur, seen = nxt, now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
