"""Text output: VCF, name lists, tables, PHYLIP and JSON matrices."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.variants import snv_type

VERSION = "1.0"
COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"


def vcf_header(command: str, regions: list[str] | None = None) -> list[str]:
    lines = ["##fileformat=VCFv4.3", f"##variantsetsVersion={VERSION}", f"##variantsetsCommand={command}"]
    if regions:
        lines.append(f"##variantsetsRegion={' '.join(regions)}")
    return [*lines, COLUMNS]


def vcf_lines(variants: DataFrame) -> DataFrame:
    """(region_ord, chrom, pos, ref, alt, line); changes of one base print in upper case."""
    one = snv_type(F.col("ref"), F.col("alt")) > 0
    text = lambda c: F.when(one, F.upper(c)).otherwise(F.col(c))
    dot = F.lit(".")
    return variants.withColumn("line", F.concat_ws("\t", "chrom", F.col("pos").cast("string"), dot, text("ref"), text("alt"), dot, dot, dot))


def vcf_ordered(variants: DataFrame, chroms: DataFrame) -> DataFrame:
    """The columns of vcf_lines in order of region, chromosome as stored (``chroms``: chrom, chrom_ord; a dictionary), position and alleles."""
    known = F.broadcast(chroms.select("chrom", "chrom_ord"))
    return vcf_lines(variants).join(known, "chrom", "left").orderBy("region_ord", "chrom_ord", "pos", "ref", "alt")


def vcf_body(variants: DataFrame, chroms: DataFrame) -> Iterator[str]:
    """Lines in order, streamed a partition at a time."""
    return (r["line"] for r in vcf_ordered(variants, chroms).select("line").toLocalIterator())


def _cells(matrix: DataFrame) -> tuple[list[str], list[str], dict]:
    rows = matrix.orderBy("bin", F.col("row_ord").desc(), F.col("col_ord").desc()).collect()
    names = lambda c: list(dict.fromkeys((r[f"{c}_ord"], r[f"{c}_name"]) for r in rows))
    return names("row"), names("col"), {(r["bin"], r["row_ord"], r["col_ord"]): r["distance"] for r in rows}


def phylip(matrix: DataFrame) -> Iterator[str]:
    """A square matrix: the number of rows, then each name and its distances. A matrix is as large as its output."""
    rows, cols, d = _cells(matrix)
    yield str(len(rows))
    for r, name in rows:
        yield " ".join([name, *(str(d[0, r, c]) for c, _ in cols)])


def phylip_rows(matrix: DataFrame) -> DataFrame:
    """(row_name, line) without the driver: each row's distances in order of columns."""
    cells = F.sort_array(F.collect_list(F.struct("col_ord", "distance")), asc=False)
    joined = F.concat_ws(" ", F.col("row_name"), F.array_join(F.transform("cells", lambda c: c["distance"].cast("string")), " "))
    return matrix.groupBy("row_name").agg(cells.alias("cells")).select("row_name", joined.alias("line"))


def matrix_json(matrix: DataFrame) -> str:
    """rows, columns and a matrix; a list of matrices where there are several bins."""
    rows, cols, d = _cells(matrix)
    bins = sorted({k[0] for k in d}) or [0]
    tables = [[[d[b, r, c] for c, _ in cols] for r, _ in rows] for b in bins]
    return json.dumps({"rows": [n for _, n in rows], "columns": [n for _, n in cols], "matrix": tables[0] if len(tables) == 1 else tables})
