"""Connected components by alternating large-star and small-star steps.

Every step is a partial aggregation and a salted join, and writes its edges to
the shared folder; nothing is collected but a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, salted_join


def _star(towards: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sends every neighbour in ``pairs`` (u, v) to the least neighbour of u found in ``towards``."""
    least = towards.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return salted_join(pairs, least, "u", "v")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b); component is the least id reachable."""
    e = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.where("u <> v").distinct())
        small = _star(large, large)
        small = small.select("v", "m").union(small.select("u", "m")).toDF("u", "v")
        new = scratch.save(small.where("u <> v").distinct())
        scratch.free(e, large)
        e = new
        seen = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if seen == mark:
            break
        mark = seen
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return scratch.save(out.union(e.select("v", "v").distinct()))
