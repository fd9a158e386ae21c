"""Registered queries of the variant engine over the adapted tables, each with its SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.variants import genotype_code, snv_type
from .operators import distance
from .sources import adapter, sinks
from .sources.catalog import Catalog, bitmap_rows, explode_bits, numbered

CALLS = """
calls AS (
  SELECT concat('ch0', cast(l_linenumber AS varchar)) AS chrom,
         cast((l_partkey % 500) * 50 + 1 AS bigint) AS pos,
         substr('ACGT', p_size % 4 + 1, 1) AS ref,
         CASE WHEN p_size % 10 = 0 THEN concat(substr('ACGT', p_size % 4 + 1, 1), 'T')
              WHEN l_returnflag = 'A' THEN substr('CGTA', p_size % 4 + 1, 1)
              ELSE substr('GTAC', p_size % 4 + 1, 1) END AS alt,
         concat('S', cast(l_suppkey % 10 AS varchar)) AS sample,
         CASE WHEN l_quantity <= 10 THEN '0/0' WHEN l_quantity <= 30 THEN '0/1'
              WHEN l_quantity <= 33 THEN './.' ELSE '1/1' END AS gt
  FROM lineitem JOIN part ON l_partkey = p_partkey),
variants AS (SELECT DISTINCT chrom, pos, ref, alt FROM calls),
carriers AS (SELECT DISTINCT chrom, pos, ref, alt, sample FROM calls WHERE gt <> '0/0')
"""
V = "chrom, pos, ref, alt"


def _catalog(spark: SparkSession, sf_dir: str, **options) -> Catalog:
    return Catalog.from_calls(adapter.calls(spark, sf_dir), adapter.sample_rows(), **options)


def _view(query: str, on: list[str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _catalog(spark, sf_dir).view(query, on)

    return run


def _having(condition: str, where: str = "true") -> str:
    return f"WITH {CALLS} SELECT {V}, 0 AS region_ord FROM carriers WHERE {where} GROUP BY {V} HAVING {condition}"


def _has(name: str) -> str:
    return f"max(CASE WHEN sample = '{name}' THEN 1 ELSE 0 END) = 1"


def _count(names: str) -> str:
    return f"sum(CASE WHEN sample IN ({names}) THEN 1 ELSE 0 END)"


_NAMES = "SELECT DISTINCT sample AS name FROM calls"

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    Q[name], SQL[name] = run, sql


_add("genome_variants", _view("S1"), f"WITH {CALLS} SELECT {V}, 0 AS region_ord FROM carriers WHERE sample = 'S1'")
_add("set_intersect", _view("S1 & S2"), _having(f"{_has('S1')} AND {_has('S2')}"))
_add("set_union", _view("S1 | S2"), _having(f"{_has('S1')} OR {_has('S2')}"))
_add("set_difference", _view("S1 \\ S2"), _having(f"{_has('S1')} AND NOT ({_has('S2')})"))
_add("set_symdiff", _view("S1 ^ S2"), _having(f"({_has('S1')}) <> ({_has('S2')})"))
_add("nested_expr", _view("((S1 | S2) \\ S3) ^ (u(S4,S5) & 'S6')"), _having(f"((({_has('S1')}) OR ({_has('S2')})) AND NOT ({_has('S3')})) <> ({_count(chr(39) + 'S4' + chr(39) + ', ' + chr(39) + 'S5' + chr(39))} >= 1 AND {_has('S6')})"))
_add("fn_union", _view("u(*)"), f"WITH {CALLS} SELECT DISTINCT {V}, 0 AS region_ord FROM carriers")
_add("fn_intersect", _view("intersect(S1,S2,S3)"), _having(f"{_count(chr(39) + 'S1' + chr(39) + ',' + chr(39) + 'S2' + chr(39) + ',' + chr(39) + 'S3' + chr(39))} = 3"))
_add("fn_symdiff", _view("s(*)"), _having("count(*) % 2 = 1"))
_add("unique_to_sample", _view("S5 \\ u(* - S5)"), _having(f"{_has('S5')} AND count(*) = 1"))
_add("list_wildcard", _view("S*"), f"WITH {CALLS} {_NAMES}")
_add("list_append", _view("S1, S3, '7'"), f"WITH {CALLS} {_NAMES} WHERE sample IN ('S1', 'S3', 'S7')")
_add("list_remove", _view("* - S1,S2"), f"WITH {CALLS} {_NAMES} WHERE sample NOT IN ('S1', 'S2')")


def _dense_site(spark: SparkSession, sf_dir: str) -> str:
    """The variant with most carriers, first in order: always known to the index."""
    per = _catalog(spark, sf_dir).carriers.groupBy("chrom", "pos", "ref", "alt").count()
    top = per.orderBy(F.desc("count"), "chrom", "pos", "ref", "alt").first()
    return f"{top['chrom']}:{top['pos']}:{top['ref']}:{top['alt']}"


_DENSE = f"dense AS (SELECT {V} FROM carriers GROUP BY {V} ORDER BY count(*) DESC, {V} LIMIT 1), own AS (SELECT sample FROM carriers SEMI JOIN dense USING ({V}))"


def _on_dense(query: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _catalog(spark, sf_dir).view(query.format(_dense_site(spark, sf_dir)))

    return run


_add("list_superset", _on_dense("* > {0}"), f"WITH {CALLS}, {_DENSE} SELECT sample AS name FROM own")
_add("list_superset_minus", _on_dense("* > {0} - S1"), f"WITH {CALLS}, {_DENSE} SELECT sample AS name FROM own WHERE sample <> 'S1'")
_add("i_of_superset", _on_dense("i(* > {0})"), f"WITH {CALLS}, {_DENSE} SELECT {V}, 0 AS region_ord FROM carriers WHERE sample IN (SELECT sample FROM own) GROUP BY {V} HAVING count(*) = (SELECT count(*) FROM own)")
_add("region_single", _view("S1 | S2", ["ch01:1-5000"]), _having(f"{_has('S1')} OR {_has('S2')}", "chrom = 'ch01' AND pos BETWEEN 1 AND 5000"))
_REGIONS = "regions AS (SELECT * FROM (VALUES (0, 'ch01', 1, 5000), (1, 'ch02', 101, 9000), (2, 'ch01', 2501, 7500)) t(region_ord, c, a, b))"
_add("region_multi_overlap", _view("u(S1,S2)", ["ch01:1-5000", "ch02:101-9000", "ch01:2501-7500"]), f"WITH {CALLS}, {_REGIONS} SELECT DISTINCT {V}, region_ord FROM carriers JOIN regions ON chrom = c AND pos BETWEEN a AND b WHERE sample IN ('S1', 'S2')")
_add("region_whole_chrom", _view("S1 & S2", ["ch03"]), _having(f"{_has('S1')} AND {_has('S2')}", "chrom = 'ch03'"))

_add("samples_all", lambda s, d: _catalog(s, d).samples(), f"WITH {CALLS} {_NAMES}")
_add("samples_match", lambda s, d: _catalog(s, d).samples(match=["S1", "*7"]), f"WITH {CALLS} {_NAMES} WHERE sample IN ('S1', 'S7')")
_add("samples_contains", lambda s, d: _catalog(s, d).samples(contains=_dense_site(s, d)), f"WITH {CALLS}, {_DENSE} SELECT sample AS name FROM own")
_add("samples_match_contains", lambda s, d: _catalog(s, d).samples(match=["S1*", "S2", "S3", "S4"], contains=_dense_site(s, d)), f"WITH {CALLS}, {_DENSE} SELECT sample AS name FROM own WHERE sample IN ('S1', 'S2', 'S3', 'S4')")
_CHROMS = "SELECT chrom, max(pos) AS length, count(*) AS variant_count FROM {0} GROUP BY chrom"
_add("chroms", lambda s, d: _catalog(s, d).chroms(), f"WITH {CALLS} {_CHROMS.format('variants')}")
_add("variants_all", lambda s, d: _catalog(s, d).variants, f"WITH {CALLS} SELECT * FROM variants")
_add("build_snps_only", lambda s, d: _catalog(s, d, types="snps").chroms(), f"WITH {CALLS} {_CHROMS.format('(SELECT * FROM variants WHERE length(ref) = 1 AND length(alt) = 1)')}")
_add("build_indels_only", lambda s, d: _catalog(s, d, types="indels").chroms(), f"WITH {CALLS} {_CHROMS.format('(SELECT * FROM variants WHERE length(ref) > 1 OR length(alt) > 1)')}")


def _named(cat: Catalog) -> DataFrame:
    return cat.carriers.join(cat.samples_table, "sample_id").select("chrom", "pos", "ref", "alt", "name")


_add("build_homozygous", lambda s, d: _named(_catalog(s, d, homozygous=True)), f"WITH {CALLS} SELECT DISTINCT {V}, sample AS name FROM calls WHERE gt IN ('1/1', './.')")
_add("build_bitmap_index", lambda s, d: (lambda c: explode_bits(bitmap_rows(c.variants, c.carriers, 10)))(_catalog(s, d)), f"WITH {CALLS} SELECT {V}, cast(substr(sample, 2) AS int) AS sample_id FROM carriers")
_add("genotype_codes", lambda s, d: adapter.calls(s, d).groupBy("gt", genotype_code(F.col("gt")).alias("code")).agg(F.count(F.lit(1)).alias("n")), f"WITH {CALLS} SELECT gt, CASE gt WHEN '0/0' THEN 0 WHEN '0/1' THEN 2 ELSE 1 END AS code, count(*) AS n FROM calls GROUP BY gt")
_add("snv_types", lambda s, d: (lambda c: c.variants.groupBy(snv_type(F.col("ref"), F.col("alt")).alias("vtype")).agg(F.count(F.lit(1)).alias("n")))(_catalog(s, d)), f"WITH {CALLS} SELECT CASE WHEN length(ref) > 1 OR length(alt) > 1 THEN 0 ELSE (strpos('ACGT', ref) - 1) * 3 + strpos(replace('ACGT', ref, ''), alt) END AS vtype, count(*) AS n FROM variants GROUP BY 1")


def _multiallelic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALT alleles joined to one line a site, as a file has them, and split again."""
    sites = _catalog(spark, sf_dir).variants.groupBy("chrom", "pos", "ref").agg(F.array_join(F.sort_array(F.collect_set("alt")), ",").alias("alts"))
    return sites.select("chrom", "pos", "ref", F.posexplode(F.split("alts", ",")).alias("alt_ord", "alt"))


_add("multiallelic_split", _multiallelic, f"WITH {CALLS} SELECT chrom, pos, ref, row_number() OVER (PARTITION BY chrom, pos, ref ORDER BY alt) - 1 AS alt_ord, alt FROM variants")
_add("variant_index", lambda s, d: numbered(_catalog(s, d).variants), f"WITH {CALLS} SELECT {V}, row_number() OVER (PARTITION BY chrom ORDER BY pos, ref, alt) - 1 AS variant_idx FROM variants")


def _dist_sql(rows: str, cols: str, source: str = "SELECT *, 0 AS bin FROM carriers", bins: str = "SELECT 0 AS bin") -> str:
    return f"""WITH {CALLS}, src AS ({source}), bins AS ({bins}),
w AS (SELECT bin, sample, count(*) AS w FROM src GROUP BY bin, sample),
co AS (SELECT x.bin, x.sample AS r, y.sample AS c, count(*) AS co FROM src x JOIN src y USING (bin, {V}) GROUP BY 1, 2, 3),
names AS (SELECT DISTINCT sample FROM calls)
SELECT bins.bin, a.sample AS row_name, b.sample AS col_name,
       cast(coalesce(wa.w, 0) + coalesce(wb.w, 0) - 2 * CASE WHEN a.sample = b.sample THEN coalesce(wa.w, 0) ELSE coalesce(co, 0) END AS bigint) AS distance
FROM bins CROSS JOIN (SELECT sample FROM names WHERE {rows}) a CROSS JOIN (SELECT sample FROM names WHERE {cols}) b
LEFT JOIN w wa ON wa.bin = bins.bin AND wa.sample = a.sample
LEFT JOIN w wb ON wb.bin = bins.bin AND wb.sample = b.sample
LEFT JOIN co ON co.bin = bins.bin AND co.r = a.sample AND co.c = b.sample"""


def _dist(**options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: _catalog(s, d).dist(**options).select("bin", "row_name", "col_name", "distance")


_add("dist_symmetric", _dist(), _dist_sql("true", "true"))
_add("dist_a_vs_b", _dist(a=["S1", "S2", "S3"], b=["S3", "S4"]), _dist_sql("sample IN ('S1', 'S2', 'S3')", "sample IN ('S3', 'S4')"))
# Regions that overlap count twice: each gives rows of its own.
_SUMMED = "SELECT chrom, pos, concat(ref, cast(k AS varchar)) AS ref, alt, sample, 0 AS bin FROM carriers JOIN (VALUES (0, 'ch01', 1, 5000), (1, 'ch01', 2501, 7500)) t(k, c, a, b) ON chrom = c AND pos BETWEEN a AND b"
_add("dist_regions_sum", _dist(on=["ch01:1-5000", "ch01:2501-7500"]), _dist_sql("true", "true", _SUMMED))
_add("dist_binned", _dist(on=["ch01:1-24000"], bin_size=5000), _dist_sql("true", "true", "SELECT *, cast((pos - 1) // 5000 AS int) AS bin FROM carriers WHERE chrom = 'ch01' AND pos BETWEEN 1 AND 24000", "SELECT cast(range AS int) AS bin FROM range(5)"))
_add("dist_contains", lambda s, d: _catalog(s, d).dist(contains=[_dense_site(s, d)]).select("bin", "row_name", "col_name", "distance"), _dist_sql("sample IN (SELECT sample FROM own)", "sample IN (SELECT sample FROM own)").replace("names AS (", f"{_DENSE}, names AS ("))
_add("weights", lambda s, d: (lambda c: distance.weights(c.carriers).join(c.samples_table, "sample_id").select("name", "weight"))(_catalog(s, d)), f"WITH {CALLS} SELECT sample AS name, count(*) AS weight FROM carriers GROUP BY sample")


def _renamed(changes: list[tuple[str, str]]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cat = _catalog(spark, sf_dir)
        for old, new in changes:
            cat.rename(old, new)
        return cat.samples()

    return run


_add("rename_single", _renamed([("S3", "Third")]), f"WITH {CALLS} SELECT DISTINCT CASE sample WHEN 'S3' THEN 'Third' ELSE sample END AS name FROM calls")
_add("rename_chain", _renamed([("S3", "T"), ("T", "U"), ("S4", "S3")]), f"WITH {CALLS} SELECT DISTINCT CASE sample WHEN 'S3' THEN 'U' WHEN 'S4' THEN 'S3' ELSE sample END AS name FROM calls")
_add("vcf_lines", lambda s, d: sinks.vcf_lines(_catalog(s, d).view("S1 & S2", ["ch01"])).select("line"), f"WITH {CALLS} SELECT concat_ws(chr(9), chrom, cast(pos AS varchar), '.', ref, alt, '.', '.', '.') AS line FROM carriers WHERE chrom = 'ch01' GROUP BY {V} HAVING {_has('S1')} AND {_has('S2')}")
_add("phylip_lines", lambda s, d: sinks.phylip_rows(_catalog(s, d).dist()), f"SELECT row_name, concat(row_name, ' ', string_agg(cast(distance AS varchar), ' ' ORDER BY col_name DESC)) AS line FROM ({_dist_sql('true', 'true')}) GROUP BY row_name")


# --- by VCF text and a stored index ------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder where the cluster shares one, else of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='variantsets-')}"
    return f"{base.rstrip('/')}/variantsets/query-{uuid.uuid4().hex}"


def _one_file(lines: DataFrame, folder: str) -> str:
    """Writes lines as one text file and returns its path."""
    spark = lines.sparkSession
    lines.coalesce(1).write.text(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)[0].getPath().toString()


def vcf_text(calls: DataFrame, samples: list[str]) -> DataFrame:
    """(value): VCF lines of calls, chromosomes in descending order; of several calls of a sample the greatest that carries."""
    hit = F.max(F.when(F.col("gt") != "0/0", F.col("gt")))
    per = calls.groupBy("chrom", "pos", "ref", "alt").pivot("sample", samples).agg(hit)
    cells = [F.coalesce(F.col(f"`{s}`"), F.lit("0/0")) for s in samples]
    dot = F.lit(".")
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), dot, "ref", "alt", dot, dot, dot, F.lit("GT"), *cells)
    head = calls.sparkSession.createDataFrame([("##fileformat=VCFv4.3", 0), ("\t".join([sinks.COLUMNS, "FORMAT", *samples]), 1)], "value string, k int")
    body = per.select(line.alias("value"), F.lit(2).alias("k"), F.col("chrom"), F.col("pos"))
    return head.select("value", "k", F.lit(None).cast("string").alias("chrom"), F.lit(None).cast("long").alias("pos")).unionByName(body).orderBy("k", F.desc("chrom"), "pos").select("value")


def _built(spark: SparkSession, sf_dir: str, **options) -> Catalog:
    folder = _folder(spark)
    path = _one_file(vcf_text(adapter.calls(spark, sf_dir), [n for _, n, _ in adapter.sample_rows()]), f"{folder}/vcf")
    return Catalog.build(spark, f"{folder}/index", [path], **options)


_FIELDS = "fields AS (SELECT chrom, pos, ref, alt, sample, max(gt) FILTER (WHERE gt <> '0/0') AS gt FROM calls GROUP BY ALL)"
_add("vcf_build_carriers", lambda s, d: _named(_built(s, d)), f"WITH {CALLS} SELECT {V}, sample AS name FROM carriers")
_add("vcf_build_homozygous", lambda s, d: _named(_built(s, d, homozygous=True)), f"WITH {CALLS}, {_FIELDS} SELECT {V}, sample AS name FROM fields WHERE gt IN ('1/1', './.')")
_add("vcf_build_strict", lambda s, d: _named(_built(s, d, genotype_mode="strict")), f"WITH {CALLS}, {_FIELDS} SELECT {V}, sample AS name FROM fields WHERE gt IN ('0/1', '1/1')")
_add("vcf_build_chroms", lambda s, d: _built(s, d, types="snps").chroms(), f"WITH {CALLS} {_CHROMS.format('(SELECT * FROM variants WHERE length(ref) = 1 AND length(alt) = 1)')}")
_add("vcf_header_samples", lambda s, d: _built(s, d).samples_table.select("sample_id", "name"), f"WITH {CALLS} SELECT DISTINCT cast(substr(sample, 2) AS int) AS sample_id, sample AS name FROM calls")


def _body(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = _built(spark, sf_dir)
    ordered = sinks.vcf_ordered(cat.view("S1 & S2"), cat.chroms_table)
    place = Window.partitionBy("region_ord", "chrom_ord").orderBy("pos", "ref", "alt")
    return ordered.select("chrom_ord", F.row_number().over(place).alias("place"), "line")


_add("vcf_body_order", _body, f"WITH {CALLS}, found AS (SELECT {V} FROM carriers GROUP BY {V} HAVING {_has('S1')} AND {_has('S2')}) SELECT cast(7 - cast(substr(chrom, 3) AS int) AS int) AS chrom_ord, cast(row_number() OVER (PARTITION BY chrom ORDER BY pos, ref, alt) AS int) AS place, concat_ws(chr(9), chrom, cast(pos AS varchar), '.', ref, alt, '.', '.', '.') AS line FROM found")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = _built(spark, sf_dir)
    return spark.createDataFrame([(cat.sample_count, cat.chrom_count)], "samples long, chroms long")


_add("catalog_counts", _counts, f"WITH {CALLS} SELECT count(DISTINCT sample) AS samples, count(DISTINCT chrom) AS chroms FROM calls")
_of_index = lambda **options: lambda s, d: _built(s, d).dist(**options).select("bin", "row_name", "col_name", "distance")
_add("dist_bitmap", _of_index(), _dist_sql("true", "true"))
_add("dist_bitmap_a_vs_b", _of_index(a=["S1", "S2", "S3"], b=["S3", "S4"]), _dist_sql("sample IN ('S1', 'S2', 'S3')", "sample IN ('S3', 'S4')"))
_add("dist_bitmap_regions_sum", _of_index(on=["ch01:1-5000", "ch01:2501-7500"]), _dist_sql("true", "true", _SUMMED))
_add("dist_bitmap_binned", _of_index(on=["ch01:1-24000"], bin_size=5000), _dist_sql("true", "true", "SELECT *, cast((pos - 1) // 5000 AS int) AS bin FROM carriers WHERE chrom = 'ch01' AND pos BETWEEN 1 AND 24000", "SELECT cast(range AS int) AS bin FROM range(5)"))


def _renamed_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = _catalog(spark, sf_dir)
    names = spark.createDataFrame([("S3\tThird",), ("nobody\tx",), ("S4\tS3",)], "value string")
    cat.rename_from(_one_file(names, f"{_folder(spark)}/names"))
    return cat.samples()


_add("rename_from_file", _renamed_by_file, f"WITH {CALLS} SELECT DISTINCT CASE sample WHEN 'S3' THEN 'Third' WHEN 'S4' THEN 'S3' ELSE sample END AS name FROM calls")
