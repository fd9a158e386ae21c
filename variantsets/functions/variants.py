"""Scalar functions over variants, genotypes and sample names, as Columns."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of single-nucleotide changes: fixed values, 1 to 12 by ref then alt in this order of bases.
BASES = "ACGT"
SNV_CODES = {pair: k for k, pair in enumerate(permutations(BASES, 2), 1)}


def snv_type(ref: Column, alt: Column) -> Column:
    """1 to 12 for a change of one base into another, whatever the case; 0 for anything else."""
    both = F.concat(F.upper(ref), F.lit(">"), F.upper(alt))
    table = F.create_map(*[F.lit(x) for (r, a), k in SNV_CODES.items() for x in (f"{r}>{a}", k)])
    return F.coalesce(table[both], F.lit(0))


def genotype_code(gt: Column) -> Column:
    """0 where both alleles are the reference, 1 where they are equal, 2 where they differ.

    Only the first and third character count, so a missing genotype ``./.`` is
    two equal alleles. A haploid genotype is taken as two equal alleles. An absent
    field, as on a line with fewer genotypes than samples, is no carrier.
    """
    a, b = F.substring(gt, 1, 1), F.substring(gt, 3, 1)
    b = F.when(b == "", a).otherwise(b)
    return F.when(gt.isNull() | (gt == "") | ((a == "0") & (b == "0")), 0).when(a == b, 1).otherwise(2)


def genotype_code_strict(gt: Column, ordinal: Column) -> Column:
    """Like genotype_code, for one ALT: only alleles that name its ordinal count, and a missing one is no carrier."""
    alleles = F.split(F.split(gt, ":")[0], "[/|]")
    own = F.filter(alleles, lambda x: x == ordinal.cast("string"))
    return F.when(gt.isNull() | (F.size(own) == 0), 0).when(F.size(own) == F.size(alleles), 1).otherwise(2)


def wildcard(name: Column, pattern: str, anchored: bool = False) -> Column:
    """Whether the parts of ``pattern`` between ``*`` stand in ``name`` from left to right.

    Each part is taken at its first place after the one before. Unless the
    pattern ends in ``*``, nothing may follow the last part. The start is open
    unless ``anchored``.
    """
    ok: Column = F.lit(True)
    after: Column = F.lit(1)
    parts = [p for p in pattern.split("*") if p]
    for k, part in enumerate(parts):
        at = F.call_function("locate", F.lit(part), name, after)
        ok = ok & (at > 0)
        if anchored and k == 0 and not pattern.startswith("*"):
            ok = ok & (at == 1)
        after = at + len(part)
    if not pattern.endswith("*"):
        ok = ok & (after == F.length(name) + 1)
    return ok


def wildcard_matches(name: str, pattern: str, anchored: bool = False) -> bool:
    """The same for a driver-side list of names."""
    at = 0
    for k, part in enumerate(p for p in pattern.split("*") if p):
        found = name.find(part, at)
        if found < 0 or (anchored and k == 0 and not pattern.startswith("*") and found):
            return False
        at = found + len(part)
    return pattern.endswith("*") or at == len(name)


def any_wildcard(name: Column, patterns: list[str] | None, anchored: bool = False) -> Column:
    """Whether any pattern matches; true without patterns."""
    given = [p for p in patterns or [] if p is not None]
    if not given:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [wildcard(name, p, anchored) for p in given])
