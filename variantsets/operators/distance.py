"""Pairwise Hamming distances: w(a) + w(b) - 2 co(a, b).

Over the bitmap index, a task turns the bits of a batch of variants into a matrix and
adds up the product of its transpose with itself, for blocks of at most ``BLOCK`` by
``BLOCK`` samples; only these sums are shuffled, a row for each pair, bin and task,
and nothing is exploded to pairs. Over the long table, carriers are gathered by variant (one shuffle of the rows of the samples asked
for), the pairs of one variant are summed map-side, and so the second shuffle has
a row per pair, bin and task. The grid of all pairs is as large as the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .regions import Region, bin_count, bin_of, by_region, within


def weights(carriers: DataFrame) -> DataFrame:
    """(sample_id, weight): variants that each sample carries."""
    return carriers.groupBy("sample_id").agg(F.count(F.lit(1)).alias("weight"))


def matrix(carriers: DataFrame, rows: list[int], cols: list[int], places: list[Region] | None = None, bin_size: int | None = None) -> DataFrame:
    """(bin, row, col, distance) for every row, column and bin."""
    spark = carriers.sparkSession
    ids = sorted({*rows, *cols})
    some = by_region(within(carriers.where(F.col("sample_id").isin(ids)) if ids else carriers.limit(0), places), places)
    bin_ = bin_of(places[0], bin_size) if bin_size else F.lit(0)
    some = some.select("chrom", "pos", "ref", "alt", "region_ord", bin_.alias("bin"), "sample_id")
    per = some.groupBy("chrom", "pos", "ref", "alt", "region_ord", "bin").agg(F.collect_list("sample_id").alias("s"))
    symmetric = set(rows) == set(cols)
    x = per.select("bin", F.explode(F.filter("s", lambda i: i.isin(rows))).alias("row"), "s") if rows else per.select("bin", F.explode(F.array().cast("array<int>")).alias("row"), "s")
    # Within one set, half of the pairs are counted and mirrored.
    keep = (lambda i: i > F.col("row")) if symmetric else (lambda i: i.isin(cols))
    co = x.select("bin", "row", F.explode(F.filter("s", keep)).alias("col")).groupBy("bin", "row", "col").agg(F.count(F.lit(1)).alias("co"))
    if symmetric:
        co = co.unionByName(co.select("bin", F.col("col").alias("row"), F.col("row").alias("col"), "co"))
    w = some.groupBy("bin", "sample_id").agg(F.count(F.lit(1)).alias("w"))
    return _distances(co, w, rows, cols, places, bin_size)


def _distances(co: DataFrame, w: DataFrame, rows: list[int], cols: list[int], places: list[Region] | None, bin_size: int | None) -> DataFrame:
    spark = co.sparkSession
    bins = bin_count(places[0], bin_size) if bin_size else 1
    side = lambda xs, name: spark.createDataFrame([(i,) for i in xs], f"{name} int")
    grid = side(rows, "row").crossJoin(side(cols, "col")).crossJoin(spark.range(bins).select(F.col("id").cast("int").alias("bin")))
    of = lambda name: w.select("bin", F.col("sample_id").alias(name), F.col("w").alias(f"w_{name}"))
    all_ = grid.join(co, ["bin", "row", "col"], "left").join(of("row"), ["bin", "row"], "left").join(of("col"), ["bin", "col"], "left")
    zero = F.lit(0).cast("long")
    n = lambda c: F.coalesce(F.col(c), zero)
    d = F.when(F.col("row") == F.col("col"), zero).otherwise(n("w_row") + n("w_col") - 2 * n("co"))
    return all_.select("bin", "row", "col", d.alias("distance"))


#: Samples on a side of the blocks of a matrix that a task holds.
BLOCK = 2048


def _products(rows: list[int], cols: list[int], weigh: bool):
    """(bin, row, col, n): variants that both samples carry; col is -1 for the variants that row carries."""
    a, b = np.array(rows, np.int64), np.array(cols, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("bits").flatten().to_numpy().reshape(batch.num_rows, -1)
            bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
            bins = batch.column("bin").to_numpy()
            for k in np.unique(bins):
                here = bits[bins == k]
                x, y = here[:, a], here[:, b]
                held = sums.setdefault(int(k), [np.zeros((len(a), len(b)), np.int64), np.zeros(len(a), np.int64)])
                # Counts of a batch are below 2**24, so single precision is exact.
                held[0] += np.rint(x.T.astype(np.float32) @ y.astype(np.float32)).astype(np.int64)
                held[1] += x.sum(axis=0, dtype=np.int64)
        for k, (both, own) in sums.items():
            for lo in range(0, len(a), max(1, 200_000 // max(1, len(b)))):
                part = both[lo : lo + max(1, 200_000 // max(1, len(b)))]
                i, j = np.nonzero(part)
                yield _found(k, a[lo + i], b[j], part[i, j])
            if weigh:
                yield _found(k, a, np.full(len(a), -1), own)

    return run


def _found(k: int, row: np.ndarray, col: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    ints = [pa.array(x.astype(np.int32)) for x in (np.full(len(row), k), row, col)]
    return pa.RecordBatch.from_arrays([*ints, pa.array(n.astype(np.int64))], ["bin", "row", "col", "n"])


def bitmap_matrix(index: DataFrame, rows: list[int], cols: list[int], places: list[Region] | None = None, bin_size: int | None = None) -> DataFrame:
    """(bin, row, col, distance) from the index (chrom, pos, ref, alt, bits)."""
    bin_ = bin_of(places[0], bin_size) if bin_size else F.lit(0)
    some = by_region(within(index, places), places).select(bin_.cast("int").alias("bin"), "bits")
    schema = "bin int, row int, col int, n long"
    cut = lambda xs: [xs[i : i + BLOCK] for i in range(0, len(xs), BLOCK)]
    ids = sorted({*rows, *cols})
    symmetric = set(rows) == set(cols)
    row_blocks, col_blocks = (cut(ids), cut(ids)) if symmetric else (cut(rows), cut(cols))
    # Half of a symmetric matrix's blocks are counted and mirrored.
    pairs = [(p, q) for i, p in enumerate(row_blocks) for j, q in enumerate(col_blocks) if not symmetric or i <= j]
    empty = index.sparkSession.createDataFrame([], schema)
    parts = [some.mapInArrow(_products(p, q, False), schema) for p, q in pairs]
    if symmetric:
        off = [some.mapInArrow(_products(p, q, False), schema).select("bin", F.col("col").alias("row"), F.col("row").alias("col"), "n") for p, q in pairs if p is not q and p != q]
        parts += off
    own = [some.mapInArrow(_products(p, [], True), schema) for p in cut(ids)]
    add = lambda xs: reduce(DataFrame.unionByName, xs, empty).groupBy("bin", "row", "col").agg(F.sum("n").alias("n"))
    co = add(parts).select("bin", "row", "col", F.col("n").alias("co"))
    w = add(own).select("bin", F.col("row").alias("sample_id"), F.col("n").alias("w"))
    return _distances(co, w, rows, cols, places, bin_size)
