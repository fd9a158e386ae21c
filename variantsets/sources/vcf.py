"""VCF text to calls: one row per ALT and sample.

Headers (one short line per file) are read on the driver, since samples differ
between files; all variant lines stay in Spark. ``.gz`` files are read by their
suffix and are not splittable.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DuplicateSample, InputError, UnreadableVcf
from ..functions.variants import genotype_code, genotype_code_strict

FIXED = 9  # columns before the samples
CALLS = ["chrom", "pos", "ref", "alt", "sample", "gt", "file_ord", "line_no", "alt_ord"]


def _qualified(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """value, file and its place among ``paths``; a row keeps its order within a file by line_no."""
    plain = lambda uri: "file:/" + uri[5:].lstrip("/") if uri.startswith("file:/") else uri
    order = F.create_map(*[F.lit(x) for k, p in enumerate(paths) for x in (plain(_qualified(spark, p)), k)])
    try:
        text = spark.read.text(paths)
    except AnalysisException as e:
        raise UnreadableVcf(f"A file cannot be read: {', '.join(paths)}") from e
    return text.select("value", order[F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")].alias("file_ord"), F.monotonically_increasing_id().alias("line_no"))


def headers(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """The sample names of each file, in order."""
    twice = next((p for k, p in enumerate(paths) if p in paths[:k]), None)
    if twice:
        raise DuplicateSample(f"{twice} is given twice")
    found = {r["file_ord"]: r["value"].rstrip("\r\n").split("\t")[FIXED:] for r in _lines(spark, paths).where(F.col("value").startswith("#CHROM")).collect()}
    missing = [p for k, p in enumerate(paths) if k not in found]
    if missing:
        raise InputError(f"No VCF header in {missing[0]}")
    names = [n for k in sorted(found) for n in found[k]]
    if len(set(names)) < len(names):
        raise DuplicateSample("Duplicate sample: " + next(n for n in names if names.count(n) > 1))
    return [found[k] for k in range(len(paths))]


def type_filter(types: str) -> Column:
    """Keeps ``snps`` (one base on both sides), ``indels`` (anything else) or ``both``."""
    one = (F.length("ref") == 1) & (F.length("alt") == 1)
    return {"both": F.lit(True), "snps": one, "indels": ~one}[types]


def read_sites(spark: SparkSession, paths: list[str], types: str = "both") -> DataFrame:
    """A row per line and ALT with the genotypes (gts) of the file's samples; positions that are no numbers are dropped."""
    lines = _lines(spark, paths).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    parts = F.split("value", "\t")
    cut = lines.select("file_ord", "line_no", parts.alias("p")).where(F.size("p") >= FIXED)
    return cut.select(
        F.col("p")[0].alias("chrom"),
        F.col("p")[1].try_cast("bigint").alias("pos"),
        F.col("p")[3].alias("ref"),
        F.posexplode(F.split(F.col("p")[4], ",")).alias("alt_ord", "alt"),
        "file_ord",
        "line_no",
        F.expr(f"slice(p, {FIXED + 1}, greatest(size(p) - {FIXED}, 0))").alias("gts"),
    ).where("pos is not null").where(type_filter(types))


def read_calls(spark: SparkSession, paths: list[str], types: str = "both") -> DataFrame:
    """Calls of all files: a row per line, ALT and sample."""
    columns = spark.createDataFrame(list(enumerate(headers(spark, paths))), "file_ord int, names array<string>")
    per = read_sites(spark, paths, types).join(F.broadcast(columns), "file_ord")
    calls = per.select("chrom", "pos", "ref", "alt", "file_ord", "line_no", (F.col("alt_ord") + 1).alias("alt_ord"), F.explode_outer(F.arrays_zip("names", "gts")).alias("c"))
    return calls.select("chrom", "pos", "ref", "alt", F.col("c.names").alias("sample"), F.col("c.gts").alias("gt"), "file_ord", "line_no", "alt_ord")


def sample_rows(names: list[list[str]]) -> list[tuple[int, str, int]]:
    """(sample_id, name, load_ord) in load order."""
    return [(k, n, k) for k, n in enumerate(n for ns in names for n in ns)]


def carried(sites: DataFrame, names: list[list[str]], homozygous: bool = False, genotype_mode: str = "reference") -> DataFrame:
    """(chrom, pos, ref, alt, sample_id): a row per sample that carries a line's ALT, one with a null sample where none does.

    Genotypes are coded within the line's array, so calls that carry nothing never become rows.
    """
    first = [sum(len(n) for n in names[:k]) for k in range(len(names))]
    files = sites.sparkSession.createDataFrame([(k, at, len(names[k])) for k, at in enumerate(first)], "file_ord int, first_id int, held int")
    code = genotype_code if genotype_mode == "reference" else (lambda gt: genotype_code_strict(gt, F.col("alt_ord") + 1))
    hit = lambda gt: (code(gt) == 1) if homozygous else (code(gt) != 0)
    ids = F.transform(F.slice("gts", F.lit(1), F.col("held")), lambda gt, i: F.when(hit(gt), F.col("first_id") + i))
    per = sites.join(F.broadcast(files), "file_ord")
    return per.select("chrom", "pos", "ref", "alt", F.explode_outer(F.array_compact(ids)).alias("sample_id"))
