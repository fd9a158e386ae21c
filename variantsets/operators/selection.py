"""Samples that carry all of given variants: relational division."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadVariant

Variant = tuple[str, int, str, str]


def parse_variants(texts: list[str] | None) -> list[Variant]:
    """``chrom:pos:ref:alt`` literals, several to a text parted by commas, without repeats."""
    out: dict[Variant, None] = {}
    for text in texts or []:
        for item in (text or "").split(","):
            if not item:
                continue
            cells = item.rsplit(":", 3)
            if len(cells) != 4 or not cells[1].isdigit() or not all(cells):
                raise BadVariant(f"Invalid variant: {item}")
            out[cells[0], int(cells[1]), cells[2].upper(), cells[3].upper()] = None
    return list(out)


def carrying_all(carriers: DataFrame, variants: list[Variant]) -> DataFrame:
    """(sample_id); a variant that nobody carries leaves none. The literals reach the scan as one predicate."""
    one = lambda v: (F.col("chrom") == v[0]) & (F.col("pos") == v[1]) & (F.upper("ref") == v[2]) & (F.upper("alt") == v[3])
    found = carriers.where(reduce(lambda a, b: a | b, [one(v) for v in variants]))
    key = F.struct("chrom", "pos", F.upper("ref").alias("ref"), F.upper("alt").alias("alt"))
    return found.groupBy("sample_id").agg(F.count_distinct(key).alias("n")).where(F.col("n") == len(variants)).select("sample_id")
