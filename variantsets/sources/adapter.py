"""Variant calls made from the lineitem and part tables, by pure expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    both = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    ref = F.expr("substr('ACGT', p_size % 4 + 1, 1)")
    alt = F.when(F.col("p_size") % 10 == 0, F.concat(ref, F.lit("T"))).when(F.col("l_returnflag") == "A", F.expr("substr('CGTA', p_size % 4 + 1, 1)")).otherwise(F.expr("substr('GTAC', p_size % 4 + 1, 1)"))
    q = F.col("l_quantity")
    return both.select(
        F.concat(F.lit("ch0"), F.col("l_linenumber").cast("string")).alias("chrom"),
        ((F.col("l_partkey") % 500) * 50 + 1).cast("long").alias("pos"),
        ref.alias("ref"),
        alt.alias("alt"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string")).alias("sample"),
        F.when(q <= 10, "0/0").when(q <= 30, "0/1").when(q <= 33, "./.").otherwise("1/1").alias("gt"),
    )


def sample_rows() -> list[tuple[int, str, int]]:
    return [(k, f"S{k}", k) for k in range(10)]
