"""From a resolved set expression to one predicate over one pass.

Over the long table of carriers, a whole expression is one aggregation by variant
over the samples it names, and one filter. Over the bitmap index, it is a filter
alone. Every operator maps "no operand has it" to false, so restricting the
carriers to the samples named loses nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIANT = ["chrom", "pos", "ref", "alt"]


@dataclass(frozen=True)
class Genome:
    sample: int


@dataclass(frozen=True)
class Fold:
    """``union``, ``intersect`` or ``symdiff`` (carried by an odd number) of samples."""

    name: str
    samples: tuple[int, ...]


@dataclass(frozen=True)
class Op:
    op: str
    left: object
    right: object


def leaves(node) -> list:
    if isinstance(node, Op):
        return leaves(node.left) + leaves(node.right)
    return [node]


def referenced(node) -> set[int]:
    return {s for x in leaves(node) for s in ((x.sample,) if isinstance(x, Genome) else x.samples)}


def _truth(node, has) -> Column:
    if not isinstance(node, Op):
        return has(node)
    a, b = _truth(node.left, has), _truth(node.right, has)
    return {"&": lambda: a & b, "|": lambda: a | b, "\\": lambda: a & ~b, "^": lambda: a != b}[node.op]()


def _fold(fold: Fold, count: Column) -> Column:
    if fold.name == "union":
        return count >= 1
    if fold.name == "intersect":
        return count == len(fold.samples)
    return count % 2 == 1


def over_carriers(node, carriers: DataFrame, all_samples: set[int]) -> DataFrame:
    """Variants (chrom, pos, ref, alt) for which ``node`` holds; ``carriers`` has a row per variant and sample_id."""
    named = referenced(node)
    rows = carriers if named >= all_samples else carriers.where(F.col("sample_id").isin(sorted(named)))
    if isinstance(node, Genome):  # a variant and sample stand together once: nothing to aggregate
        return rows.select(*VARIANT)
    parts = {x: f"h{k}" for k, x in enumerate(dict.fromkeys(leaves(node)))}

    def measure(x) -> Column:
        if isinstance(x, Genome):
            return F.max(F.col("sample_id") == x.sample)
        if set(x.samples) >= named:
            return F.count(F.lit(1))
        return F.sum(F.col("sample_id").isin(list(x.samples)).cast("int"))

    table = rows.groupBy(*VARIANT).agg(*[measure(x).alias(name) for x, name in parts.items()])
    has = lambda x: F.col(parts[x]) if isinstance(x, Genome) else _fold(x, F.col(parts[x]))
    return table.where(_truth(node, has)).select(*VARIANT)


def _word_masks(samples) -> dict[int, int]:
    masks: dict[int, int] = {}
    for s in samples:
        masks[s // 64] = masks.get(s // 64, 0) | 1 << s % 64
    return {w: m - (1 << 64) if m >> 63 else m for w, m in masks.items()}


def over_bitmaps(node, index: DataFrame) -> DataFrame:
    """The same over the index (chrom, pos, ref, alt, bits), without a shuffle."""

    def has(x) -> Column:
        masks = _word_masks((x.sample,) if isinstance(x, Genome) else x.samples)
        hits = [F.col("bits")[w].bitwiseAND(F.lit(m)) for w, m in masks.items()]
        if isinstance(x, Genome):
            return hits[0] != 0
        return _fold(x, reduce(lambda a, b: a + b, [F.bit_count(h) for h in hits]))

    return index.where(_truth(node, has)).select(*VARIANT)
