"""Regions: 1-based inclusive ranges of positions, in the order given, not merged."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadBounds, UnknownChromosome


@dataclass(frozen=True)
class Region:
    chrom: str
    start: int
    end: int

    def column(self) -> Column:
        return (F.col("chrom") == self.chrom) & F.col("pos").between(self.start, self.end)


def parse_region(text: str, lengths: dict[str, int]) -> Region:
    """``chrom`` or ``chrom:start-end``; a name that the index has wins over its reading as a range."""
    if text in lengths:
        return Region(text, 1, lengths[text])
    chrom, colon, rest = text.rpartition(":")
    if not colon or chrom not in lengths:
        raise UnknownChromosome(f"Unknown chromosome: {text}")
    m = re.fullmatch(r"(\d+)-(\d+)", rest)
    if not m or int(m[1]) > int(m[2]) or int(m[1]) < 1:
        raise BadBounds(f"Invalid region: {text}")
    return Region(chrom, int(m[1]), int(m[2]))


def within(df: DataFrame, regions: list[Region] | None) -> DataFrame:
    """Rows in any region, as one predicate that reaches the scan; every position from 1 without regions."""
    if regions is None:
        return df.where(F.col("pos") >= 1)
    if not regions:
        return df.where(F.lit(False))
    return df.where(reduce(lambda a, b: a | b, [r.column() for r in regions]))


def region_rows(spark: SparkSession, regions: list[Region]) -> DataFrame:
    rows = [(k, r.chrom, r.start, r.end) for k, r in enumerate(regions)]
    return spark.createDataFrame(rows, "region_ord int, chrom string, region_start long, region_end long")


def by_region(df: DataFrame, regions: list[Region] | None) -> DataFrame:
    """Adds region_ord; a row in several regions comes once for each. The equality on chrom keeps this a hash join."""
    if regions is None:
        return df.withColumn("region_ord", F.lit(0))
    if len(regions) == 1:
        return df.withColumn("region_ord", F.lit(0))
    joined = df.join(region_rows(df.sparkSession, regions), "chrom").where(F.col("pos").between(F.col("region_start"), F.col("region_end")))
    return joined.select(*df.columns, "region_ord")


def bin_of(region: Region, size: int) -> Column:
    return F.floor((F.col("pos") - region.start) / F.lit(size)).cast("int")


def bin_count(region: Region, size: int) -> int:
    return -(-(region.end - region.start + 1) // size)
