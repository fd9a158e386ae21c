"""The catalogue of samples, chromosomes, variants and carriers, in memory or on disk.

``build`` writes one Parquet folder; the index has a row per variant with a
bitmap of samples, partitioned by chromosome and sorted by position, so regions
prune files and row groups and set queries need no shuffle. Only the dictionaries
of samples and chromosomes come to the driver.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import BadNameFile, BinsNeedOneRegion, IndexExists, IndexNotOpen, NoNameFile, NoSuchGenome, UnknownVariantChromosome, VariantQueryError
from ..functions.variants import any_wildcard, genotype_code, genotype_code_strict, snv_type, wildcard_matches
from ..operators import distance, regions, selection
from ..plans import compile, language
from . import vcf

VARIANT = compile.VARIANT
SAMPLES = "sample_id int, name string, load_ord int"


def carrier_rows(calls: DataFrame, samples: DataFrame, homozygous: bool = False, genotype_mode: str = "reference") -> DataFrame:
    """(chrom, pos, ref, alt, sample_id), distinct: carried if any call of a sample carries."""
    code = genotype_code(F.col("gt")) if genotype_mode == "reference" else genotype_code_strict(F.col("gt"), F.col("alt_ord"))
    hit = calls.where((code == 1) if homozygous else (code != 0))
    named = hit.join(samples.select("sample_id", F.col("name").alias("sample")), "sample")
    return named.select(*VARIANT, "sample_id").distinct()


def variant_rows(calls: DataFrame) -> DataFrame:
    return calls.select(*VARIANT).distinct()


def chrom_rows(variants: DataFrame, calls: DataFrame) -> DataFrame:
    """Length (last position) and number of variants of each chromosome, in the order in which they are first seen."""
    have = set(calls.columns)
    first = F.min(F.struct("file_ord", "line_no")) if {"file_ord", "line_no"} <= have else F.min("chrom")
    seen = calls.groupBy("chrom").agg(first.alias("first"))
    sizes = variants.groupBy("chrom").agg(F.max("pos").alias("length"), F.count(F.lit(1)).alias("variant_count"))
    # One row per chromosome: a dictionary.
    return sizes.join(seen, "chrom").select("chrom", (F.row_number().over(Window.orderBy("first")) - 1).alias("chrom_ord"), "length", "variant_count")


def numbered(variants: DataFrame) -> DataFrame:
    """variant_idx: place in the order of (pos, ref, alt) within the chromosome."""
    order = Window.partitionBy("chrom").orderBy("pos", "ref", "alt")
    return variants.withColumn("variant_idx", F.row_number().over(order).cast("long") - 1)


def bitmap_rows(variants: DataFrame, carriers: DataFrame, samples: int) -> DataFrame:
    """One row per variant: bits[w] has bit b set if sample 64 * w + b carries it. One shuffle, summed map-side."""
    return bitmap_of(variants.select(*VARIANT, F.lit(None).cast("int").alias("sample_id")).unionByName(carriers), samples)


#: Words that are aggregates of one expression each; more are rows of (variant, word) first, as code generation has its limits.
WIDE = 16


def bitmap_of(all_: DataFrame, samples: int) -> DataFrame:
    """The same from rows (variant, sample_id), whose sample_id is null where only the variant is known."""
    words = max(1, -(-samples // 64))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("sample_id"), F.lit(64)))
    if words > WIDE:
        word = F.floor(F.col("sample_id") / 64).cast("int").alias("w")
        some = all_.groupBy(*VARIANT, word).agg(F.bit_or(F.coalesce(bit, F.lit(0).cast("bigint"))).alias("word"))
        held = F.map_from_entries(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("w", "word"))))
        bits = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.coalesce(F.try_element_at("held", w), F.lit(0).cast("bigint")))
        return some.groupBy(*VARIANT).agg(held.alias("held")).select(*VARIANT, snv_type(F.col("ref"), F.col("alt")).alias("vtype"), bits.alias("bits"))
    per = [F.bit_or(F.when(F.floor(F.col("sample_id") / 64) == w, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}") for w in range(words)]
    table = all_.groupBy(*VARIANT).agg(*per)
    return table.select(*VARIANT, snv_type(F.col("ref"), F.col("alt")).alias("vtype"), F.array(*[f"w{w}" for w in range(words)]).alias("bits"))


class Catalog:
    """One index. ``carriers`` and ``index`` are the long and the bitmap layout of the same relation."""

    def __init__(self, spark: SparkSession, samples: DataFrame, variants: DataFrame, carriers: DataFrame, chroms: DataFrame, index: DataFrame | None = None, path: str | None = None, match_mode: str = "reference"):
        self.spark, self.samples_table, self.variants, self.carriers, self.chroms_table, self.index, self.path = spark, samples, variants, carriers, chroms, index, path
        self.anchored = match_mode == "anchored"

    # --- making and opening ------------------------------------------------

    @classmethod
    def from_calls(cls, calls: DataFrame, samples: list[tuple[int, str, int]], homozygous: bool = False, types: str = "both", genotype_mode: str = "reference", match_mode: str = "reference") -> Catalog:
        spark = calls.sparkSession
        names = spark.createDataFrame(samples, SAMPLES)
        kept = calls.where(vcf.type_filter(types)) if types != "both" else calls
        variants = variant_rows(kept)
        cat = cls(spark, names, variants, carrier_rows(kept, names, homozygous, genotype_mode), chrom_rows(variants, kept), match_mode=match_mode)
        cat.sample_list = sorted(samples, key=lambda r: -r[2])
        return cat

    @classmethod
    def build(cls, spark: SparkSession, path: str, vcfs: list[str], types: str = "both", homozygous: bool = False, name_file: str | None = None, force: bool = False, genotype_mode: str = "reference") -> Catalog:
        names = vcf.headers(spark, vcfs)
        if not force and _exists(spark, path):
            raise IndexExists(f"{path} exists already")
        sites, rows = vcf.read_sites(spark, vcfs, types), vcf.sample_rows(names)
        index = bitmap_of(vcf.carried(sites, names, homozygous, genotype_mode), len(rows))
        cat = cls._stored(index, sites, spark.createDataFrame(rows, SAMPLES), path)
        if name_file:
            cat.rename_from(name_file)
        return cat

    @classmethod
    def write(cls, calls: DataFrame, samples: list[tuple[int, str, int]], path: str, homozygous: bool = False, force: bool = False, genotype_mode: str = "reference") -> Catalog:
        spark = calls.sparkSession
        if not force and _exists(spark, path):
            raise IndexExists(f"{path} exists already")
        cat = cls.from_calls(calls, samples, homozygous, genotype_mode=genotype_mode)
        index = bitmap_rows(cat.variants, cat.carriers.where("sample_id is not null"), len(samples))
        return cls._stored(index, calls, cat.samples_table, path)

    @classmethod
    def _stored(cls, index: DataFrame, seen: DataFrame, samples: DataFrame, path: str) -> Catalog:
        """Writes the folder; ``seen`` tells the order of chromosomes."""
        spark = index.sparkSession
        index.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos", "ref", "alt").write.mode("overwrite").partitionBy("chrom").parquet(f"{path}/index")
        opened = spark.read.schema(index.schema).parquet(f"{path}/index")
        chrom_rows(opened.select(*VARIANT), seen.select(*[c for c in ("chrom", "file_ord", "line_no") if c in seen.columns])).coalesce(1).write.mode("overwrite").parquet(f"{path}/chroms")
        samples.coalesce(1).write.mode("overwrite").parquet(f"{path}/samples")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, match_mode: str = "reference") -> Catalog:
        try:
            index = spark.read.parquet(f"{path}/index").select(*VARIANT, "vtype", "bits")
        except AnalysisException as e:
            raise IndexNotOpen(f"{path} cannot be opened as an index") from e
        return cls(spark, spark.read.parquet(f"{path}/samples"), index.select(*VARIANT), explode_bits(index), spark.read.parquet(f"{path}/chroms"), index, path, match_mode)

    # --- dictionaries ------------------------------------------------------

    @cached_property
    def sample_list(self) -> list[tuple[int, str, int]]:
        """(sample_id, name, load_ord), latest loaded first."""
        return [tuple(r) for r in self.samples_table.orderBy(F.col("load_ord").desc()).collect()]

    @cached_property
    def lengths(self) -> dict[str, int]:
        return {r["chrom"]: r["length"] for r in self.chroms_table.orderBy("chrom_ord").collect()}

    def parse_regions(self, texts: list[str] | None) -> list[regions.Region] | None:
        return [regions.parse_region(t, self.lengths) for t in texts] if texts else None

    def _variants(self, texts: list[str] | None) -> list[selection.Variant]:
        wanted = selection.parse_variants(texts)
        unknown = next((v[0] for v in wanted if v[0] not in self.lengths), None)
        if unknown is not None:
            raise UnknownVariantChromosome(f"Unknown chromosome of a variant: {unknown}")
        return wanted

    @property
    def sample_count(self) -> int:
        return len(self.sample_list)

    @property
    def chrom_count(self) -> int:
        return len(self.lengths)

    def chroms(self) -> DataFrame:
        return self.chroms_table.orderBy("chrom_ord").select("chrom", "length", "variant_count")

    def samples(self, match: list[str] | str | None = None, contains: list[str] | str | None = None) -> DataFrame:
        """Samples that match any pattern and carry all variants, latest loaded first."""
        patterns = [match] if isinstance(match, str) else match
        found = self.samples_table.where(any_wildcard(F.col("name"), patterns, self.anchored))
        wanted = self._variants([contains] if isinstance(contains, str) else contains)
        if wanted:
            found = found.join(selection.carrying_all(self.carriers, wanted), "sample_id", "left_semi")
        return found.orderBy(F.col("load_ord").desc()).select("name")

    # --- set queries -------------------------------------------------------

    def _match(self, patterns: tuple[str, ...]) -> list[int]:
        return [i for i, name, _ in self.sample_list if any(wildcard_matches(name, p, self.anchored) for p in patterns)]

    def resolve_list(self, node) -> list[int]:
        """Sample ids of a list, latest loaded first."""
        if isinstance(node, language.Names):
            found = self._match(node.patterns)
        elif isinstance(node, language.Having):
            wanted = self._variants(list(node.variants))
            have = {r["sample_id"] for r in selection.carrying_all(self.carriers, wanted).collect()}
            found = [i for i in self._match(node.names.patterns) if i in have]
        else:
            gone = set(self.resolve_list(node.right))
            return [i for i in self.resolve_list(node.left) if i not in gone]
        if not found:
            raise NoSuchGenome("no sample matches the list")
        return found

    def resolve(self, node):
        """A set expression over sample ids; a list of several samples stays a list at the top only."""
        if isinstance(node, language.Binary):
            return compile.Op(node.op, self.resolve(node.left), self.resolve(node.right))
        if isinstance(node, language.Function):
            ids = self.resolve_list(node.of)
            if not ids:
                raise NoSuchGenome("a list has no samples left")
            return compile.Fold(node.name, tuple(ids))
        ids = self.resolve_list(node)
        if not ids:
            raise NoSuchGenome("a list has no samples left")
        if len(ids) > 1:
            raise VariantQueryError("a list of genomes cannot be an operand")
        return compile.Genome(ids[0])

    def view(self, query: str, on: list[str] | None = None, layout: str | None = None) -> DataFrame:
        """Variants (chrom, pos, ref, alt, region_ord) of a set expression, or names (name) of a list of several samples."""
        tree = language.parse(query)
        if isinstance(tree, language.LISTS):
            ids = self.resolve_list(tree)
            if len(ids) > 1:
                names = self.samples_table.where(F.col("sample_id").isin(ids))
                return names.orderBy(F.col("load_ord").desc()).select("name")
        node = self.resolve(tree)
        places = self.parse_regions(on)
        if self.index is not None and layout != "long":
            found = compile.over_bitmaps(node, regions.within(self.index, places))
        else:
            found = compile.over_carriers(node, regions.within(self.carriers, places), {i for i, *_ in self.sample_list})
        return regions.by_region(found, places)

    # --- distances ---------------------------------------------------------

    def select(self, match: list[str] | None, contains: list[str] | None) -> list[int]:
        """Sample ids of one side of a distance matrix, latest loaded first; none is no error."""
        ids = self._match(tuple(match)) if match else [i for i, *_ in self.sample_list]
        wanted = self._variants(contains)
        if wanted:
            have = {r["sample_id"] for r in selection.carrying_all(self.carriers, wanted).collect()}
            ids = [i for i in ids if i in have]
        return ids

    def dist(self, match: list[str] | None = None, contains: list[str] | None = None, a: list[str] | None = None, b: list[str] | None = None, a_contains: list[str] | None = None, b_contains: list[str] | None = None, on: list[str] | None = None, bin_size: int | None = None, layout: str | None = None) -> DataFrame:
        """(bin, row_name, col_name, distance): variants that exactly one of the two samples carries, summed over regions."""
        side = lambda own, own_has: self.select([*(match or []), *(own or [])] or None, [*(contains or []), *(own_has or [])] or None)
        rows, cols = side(a, a_contains), side(b, b_contains)
        places = self.parse_regions(on)
        if bin_size is not None:
            if bin_size < 1:
                raise VariantQueryError("the size of a bin must be positive")
            if places is None:
                places = [regions.Region(c, 1, n) for c, n in self.lengths.items()]
            if len(places) != 1:
                raise BinsNeedOneRegion("bins need exactly one region")
        if self.index is not None and layout != "long":
            found = distance.bitmap_matrix(self.index, rows, cols, places, bin_size)
        else:
            found = distance.matrix(self.carriers, rows, cols, places, bin_size)
        name = lambda side: self.samples_table.select(F.col("sample_id").alias(side), F.col("name").alias(f"{side}_name"), F.col("load_ord").alias(f"{side}_ord"))
        return found.join(name("row"), "row").join(name("col"), "col").select("bin", "row_name", "col_name", "distance", "row_ord", "col_ord")

    # --- renaming ----------------------------------------------------------

    def _renamed(self, changes: list[tuple[str, str]], strict: bool) -> list[tuple[int, str, int]]:
        rows = {i: name for i, name, _ in self.sample_list}
        for old, new in changes:  # one after the other: A to B, then B to C
            hit = next((i for i, *_ in self.sample_list if rows[i] == old), None)
            if hit is None and strict:
                raise NoSuchGenome(f"No sample named {old}")
            if hit is not None:
                rows[hit] = new
        return [(i, rows[i], ord_) for i, _, ord_ in self.sample_list]

    def _store(self, rows: list[tuple[int, str, int]]) -> None:
        table = self.spark.createDataFrame(rows, SAMPLES).coalesce(1)
        self.sample_list = sorted(rows, key=lambda r: -r[2])
        if self.path:
            fresh = f"{self.path}/samples"
            table.write.mode("overwrite").parquet(fresh)
            table = self.spark.read.parquet(fresh)
        self.samples_table = table

    def rename(self, old: str, new: str, allow_duplicates: bool = False) -> None:
        rows = self._renamed([(old, new)], strict=True)
        if not allow_duplicates and len({n for _, n, _ in rows}) < len(rows):
            raise VariantQueryError(f"There is a sample named {new} already")
        self._store(rows)

    def rename_from(self, path: str) -> None:
        """Renames by a file of old and new names; names that the index lacks are passed over."""
        changes, bad = [], None
        try:
            lines = self.spark.read.text(path).collect()
        except AnalysisException as e:
            raise NoNameFile(f"{path} cannot be read") from e
        for k, r in enumerate(lines):
            cells = r["value"].split("\t")
            if len(cells) < 2 or not cells[0]:
                bad = k + 1
                break
            changes.append((cells[0], cells[1]))
        self._store(self._renamed(changes, strict=False))
        if bad:
            raise BadNameFile(f"Line {bad} of {path} has no two names")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def explode_bits(index: DataFrame) -> DataFrame:
    """Carriers of the bitmap layout."""
    word = index.select(*VARIANT, F.posexplode("bits").alias("w", "word")).where("word <> 0")
    set_ = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", F.col("word"), b) == 1)
    return word.select(*VARIANT, "w", F.explode(set_).alias("b")).select(*VARIANT, (F.col("w") * 64 + F.col("b")).alias("sample_id"))
