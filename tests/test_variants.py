import gzip
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from variantsets import cli
from variantsets.errors import BadBounds, BadNameFile, BadVariant, BinsNeedOneRegion, DuplicateSample, IndexExists, NoSuchGenome, IndexNotOpen, NoListFile, NoNameFile, UnknownChromosome, UnknownVariantChromosome, UnreadableVcf, VariantQueryError
from variantsets.functions.variants import genotype_code, genotype_code_strict, snv_type, wildcard, wildcard_matches
from variantsets.sources import sinks
from variantsets.sources.catalog import Catalog, numbered
from variantsets.streaming import ingest

A = """##fileformat=VCFv4.3
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA1\tA2
ch1\t100\t.\tA\tG\t.\t.\t.\tGT\t0/1\t0/0
ch1\t150\t.\tTCC\tTCCC,TCCCC\t.\t.\t.\tGT\t1/1\t0/1
ch1\t200\t.\tC\tT\t.\t.\t.\tGT\t0/0\t1/1
ch2\t50\t.\tG\tA\t.\t.\t.\tGT\t./.\t0/0
ch2\t80\t.\tT\tC\t.\t.\t.\tGT\t0/0\t0/0
"""
B = """#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tB1
ch1\t100\t.\tA\tG\t.\t.\t.\tGT\t1/1
ch1\t200\t.\tC\tA\t.\t.\t.\tGT\t0/1
ch2\t50\t.\tG\tA\t.\t.\t.\tGT\t0/1
ch2\t90\t.\tA\tAT\t.\t.\t.\tGT\t1/1
"""


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("vcf")
    (d / "a.vcf").write_text(A)
    with gzip.open(d / "b.vcf.gz", "wt") as f:
        f.write(B)
    return d, [str(d / "a.vcf"), str(d / "b.vcf.gz")]


@pytest.fixture(scope="module")
def cat(spark, files):
    return Catalog.build(spark, str(files[0] / "index"), files[1])


def shown(df):
    return sorted((r["chrom"], r["pos"], r["ref"], r["alt"]) for r in df.collect())


def short(text):
    return sorted((c, int(p), r, a) for c, p, r, a in (x.split(":") for x in text.split()))


def test_dictionaries(cat):
    assert [tuple(r) for r in cat.chroms().collect()] == [("ch1", 200, 5), ("ch2", 90, 3)]
    assert [r[0] for r in cat.samples().collect()] == ["B1", "A2", "A1"]
    assert dict(map(tuple, cat.carriers.join(cat.samples_table, "sample_id").groupBy("name").count().collect())) == {"A1": 4, "A2": 3, "B1": 4}


@pytest.mark.parametrize("layout", ["bitmap", "long"])
@pytest.mark.parametrize(
    "query, expected",
    [
        ("A1 & B1", "ch1:100:A:G ch2:50:G:A"),
        ("A1 ^ A2", "ch1:100:A:G ch1:200:C:T ch2:50:G:A"),
        ("s(*)", "ch1:200:C:A ch1:200:C:T ch2:90:A:AT"),
        ("i(*)", ""),
        ("u(*)", "ch1:100:A:G ch1:150:TCC:TCCC ch1:150:TCC:TCCCC ch1:200:C:A ch1:200:C:T ch2:50:G:A ch2:90:A:AT"),
        ("* > ch1:200:C:T", "ch1:150:TCC:TCCC ch1:150:TCC:TCCCC ch1:200:C:T"),
        ("A1 \\ u(* - A1)", ""),
        ("B1 \\ (A1 | A2)", "ch1:200:C:A ch2:90:A:AT"),
    ],
)
def test_sets(cat, query, expected, layout):
    assert shown(cat.view(query, layout=layout)) == short(expected)


def test_lists_and_regions(cat):
    assert [r["name"] for r in cat.view("* > ch1:100:A:G").collect()] == ["B1", "A1"]
    assert [r["name"] for r in cat.view("1").collect()] == ["B1", "A1"]
    assert shown(cat.view("A1 | B1", ["ch1:100-150"])) == short("ch1:100:A:G ch1:150:TCC:TCCC ch1:150:TCC:TCCCC")
    assert len(cat.view("A1", ["ch1:1-120", "ch1:90-150"]).where("pos = 100").collect()) == 2
    assert shown(cat.view("A1", ["ch1:900-1000"])) == []
    assert [r["name"] for r in cat.samples(match="A*", contains="ch1:150:TCC:TCCC").collect()] == ["A2", "A1"]
    assert cat.samples(contains="ch2:90:A:C").collect() == []
    with pytest.raises(UnknownVariantChromosome):
        cat.samples(contains="ch9:1:A:G")


def test_bitmap_needs_no_shuffle_and_prunes(cat):
    plan = cat.view("(A1 | B1) \\ A2", ["ch1:100-150"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [isnotnull(chrom" in plan and "PushedFilters" in plan
    plan = cat.view("(A1 | B1) \\ A2", layout="long")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1


def test_errors(cat, spark, files, tmp_path):
    for query, error in (("nobody", NoSuchGenome), ("A* & B1", VariantQueryError), ("u(A1 - A1)", NoSuchGenome), ("* > ch1:x:A:G", BadVariant)):
        with pytest.raises(error):
            cat.view(query)
    for region, error in (("ch7", UnknownChromosome), ("ch1:100", BadBounds), ("ch1:9-2", BadBounds)):
        with pytest.raises(error):
            cat.view("A1", [region])
    with pytest.raises(BinsNeedOneRegion):
        cat.dist(bin_size=10)
    with pytest.raises(VariantQueryError):
        cat.dist(on=["ch1"], bin_size=0)
    with pytest.raises(IndexExists):
        Catalog.build(spark, str(files[0] / "index"), files[1])
    with pytest.raises(DuplicateSample):
        Catalog.build(spark, str(tmp_path / "twice"), [files[1][0], files[1][0]])


def test_build_options(spark, files, tmp_path):
    def lengths(**o):
        return [tuple(r) for r in Catalog.build(spark, str(tmp_path / "o"), files[1], force=True, **o).chroms().collect()]

    assert lengths(types="snps") == [("ch1", 200, 3), ("ch2", 80, 2)]
    assert lengths(types="indels") == [("ch1", 150, 2), ("ch2", 90, 1)]
    cat = Catalog.build(spark, str(tmp_path / "h"), files[1], homozygous=True)
    assert dict(map(tuple, cat.carriers.join(cat.samples_table, "sample_id").groupBy("name").count().collect())) == {"A1": 3, "A2": 1, "B1": 2}
    assert [tuple(r) for r in cat.chroms().collect()] == [("ch1", 200, 5), ("ch2", 90, 3)]


def test_distances(cat):
    def d(**o):
        return {(r["bin"], r["row_name"], r["col_name"]): r["distance"] for r in cat.dist(**o).collect()}

    whole = d()
    assert (whole[0, "A1", "A2"], whole[0, "A1", "B1"], whole[0, "B1", "A2"], whole[0, "A1", "A1"]) == (3, 4, 7, 0)
    bins = d(on=["ch1:1-200"], bin_size=100)
    assert [bins[b, x, y] for b in (0, 1) for x, y in (("A1", "A2"), ("A1", "B1"), ("A2", "B1"))] == [1, 0, 1, 1, 3, 4]
    assert set(d(a=["A1"], b=["B*", "A2"])) == {(0, "A1", "B1"), (0, "A1", "A2")}
    assert d(match=["none"]) == {}
    twice = d(on=["ch1:100-200", "ch1:100-200"])
    assert twice[0, "A1", "B1"] == 2 * d(on=["ch1:100-200"])[0, "A1", "B1"]


def test_sinks(cat):
    assert list(sinks.phylip(cat.dist())) == ["3", "B1 0 7 4", "A2 7 0 3", "A1 4 3 0"]
    assert json.loads(sinks.matrix_json(cat.dist(a=["A1"], b=["B1"]))) == {"rows": ["A1"], "columns": ["B1"], "matrix": [[4]]}
    assert [r["line"] for r in sinks.phylip_rows(cat.dist()).orderBy("row_name").collect()] == ["A1 4 3 0", "A2 7 0 3", "B1 0 7 4"]
    assert list(sinks.vcf_body(cat.view("A1 & B1"), cat.chroms_table)) == ["ch1\t100\t.\tA\tG\t.\t.\t.", "ch2\t50\t.\tG\tA\t.\t.\t."]
    assert len(sinks.vcf_header("x")) == 4 and len(sinks.vcf_header("x", ["ch1"])) == 5


def test_cli_and_rename(files, tmp_path, spark):
    index = str(tmp_path / "i")

    def said(*argv):
        out = io.StringIO()
        cli.run(cli._parser().parse_args(argv), spark, out)
        return out.getvalue().splitlines()

    said("build", index, *files[1])
    assert said("samples", index) == ["Sample", "B1", "A2", "A1"]
    assert said("chroms", index, "--no-header") == ["ch1\t200\t5", "ch2\t90\t3"]
    assert said("view", index, "A*") == ["A2", "A1"]
    assert said("view", index, "A1 & B1", "ch2")[-1] == "ch2\t50\t.\tG\tA\t.\t.\t."
    assert said("dist", index)[0] == "3" and json.loads(said("dist", index, "-a", "A1")[0])["rows"] == ["A1"]
    said("rename", index, "A1", "Z")
    assert said("samples", index, "-n") == ["B1", "A2", "Z"]
    (tmp_path / "names").write_text("Z\tY\nY\tX\nnone\tW\n")
    said("rename", index, "-n", str(tmp_path / "names"))
    assert said("samples", index, "-n") == ["B1", "A2", "X"]
    (tmp_path / "bad").write_text("X\tV\nalone\n")
    cat = Catalog.open(spark, index)
    with pytest.raises(BadNameFile):
        cat.rename_from(str(tmp_path / "bad"))
    assert cat.sample_list[-1][1] == "V"
    with pytest.raises(NoSuchGenome):
        cat.rename("none", "x")
    with pytest.raises(VariantQueryError):
        cat.rename("V", "B1")


def test_functions(spark):
    rows = spark.createDataFrame([("A", "G"), ("g", "a"), ("A", "AT"), ("N", "A"), ("T", "G")], "ref string, alt string")
    assert [r[0] for r in rows.select(snv_type(F.col("ref"), F.col("alt"))).collect()] == [2, 7, 0, 0, 12]
    gts = ["0/0", "0|0:3", "0/1", "1/1", "./.", "./0", "1/2", "0", "1"]
    got = spark.createDataFrame([(g,) for g in gts], "gt string").select(genotype_code(F.col("gt")), genotype_code_strict(F.col("gt"), F.lit(1))).collect()
    assert [r[0] for r in got] == [0, 0, 2, 1, 1, 2, 2, 0, 1]
    assert [r[1] for r in got] == [0, 0, 2, 1, 0, 0, 2, 0, 1]
    names = ["S.gal LA1044", "ABA", "A", "", "S.lyc LA1", "xS.lyc LA1"]
    for pattern in ("LA1044", "A", "*", "S.lyc*", "%A", "S*LA*", "A*A", ""):
        for anchored in (False, True):
            got = spark.createDataFrame([(x,) for x in names], "n string").select(wildcard(F.col("n"), pattern, anchored)).collect()
            assert [r[0] for r in got] == [wildcard_matches(x, pattern, anchored) for x in names], (pattern, anchored)
    assert wildcard_matches("S.gal LA1044", "LA1044") and not wildcard_matches("ABA", "A") and not wildcard_matches("xS.lyc", "S.lyc*", True)


def test_random_sets_against_python(spark):
    rng = random.Random(5)
    calls = [("c%d" % rng.randint(1, 2), rng.randint(1, 30), "A", "G", "S%d" % rng.randint(0, 4), rng.choice(["0/0", "0/1", "1/1"])) for _ in range(300)]
    df = spark.createDataFrame(calls, "chrom string, pos long, ref string, alt string, sample string, gt string")
    cat = Catalog.from_calls(df, [(k, f"S{k}", k) for k in range(5)])
    has = {f"S{k}": {c[:4] for c in calls if c[4] == f"S{k}" and c[5] != "0/0"} for k in range(5)}
    for _ in range(6):
        names = rng.sample(sorted(has), 3)
        ops = rng.choices("&|\\^", k=2)
        python = {"&": set.__and__, "|": set.__or__, "\\": set.__sub__, "^": set.__xor__}
        want = python[ops[1]](python[ops[0]](has[names[0]], has[names[1]]), has[names[2]])
        assert shown(cat.view(f"({names[0]} {ops[0]} {names[1]}) {ops[1]} {names[2]}")) == sorted(want)
    d = {(r["row_name"], r["col_name"]): r["distance"] for r in cat.dist().collect()}
    assert all(d[x, y] == len(has[x] ^ has[y]) for x in has for y in has)
    idx = numbered(cat.variants).where("chrom = 'c1'").orderBy("variant_idx").collect()
    assert [r["variant_idx"] for r in idx] == list(range(len(idx))) and [r["pos"] for r in idx] == sorted(r["pos"] for r in idx)


def test_stream(spark, tmp_path):
    rows = [("c", 1, "A", "G", "S1", "0/1"), ("c", 1, "A", "G", "S1", "1/1"), ("c", 2, "A", "G", "S1", "0/0")]
    schema = "chrom string, pos long, ref string, alt string, sample string, gt string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    ingest.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [tuple(r) for r in ingest.carriers(spark, str(tmp_path / "out")).collect()] == [("c", 1, "A", "G", "S1")]


def test_absent_genotype_is_no_carrier(spark, tmp_path):
    (tmp_path / "s.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA1\tA2\nch1\t5\t.\tA\tG\t.\t.\t.\tGT\t0/1\nch1\t6\t.\tA\tG\t.\t.\t.\tGT\t0/0\t1/1\t1/1\n")
    for mode in ("reference", "strict"):
        cat = Catalog.build(spark, str(tmp_path / mode), [str(tmp_path / "s.vcf")], genotype_mode=mode)
        assert shown(cat.view("A1")) == [("ch1", 5, "A", "G")] and shown(cat.view("A2")) == [("ch1", 6, "A", "G")]


def test_vcf_keeps_the_order_of_chromosomes(spark, tmp_path):
    line = "{}\t{}\t.\tA\tG\t.\t.\t.\tGT\t1/1\n"
    (tmp_path / "o.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA1\n" + "".join(line.format(c, p) for c in ("chr2", "chr10", "chr1") for p in (9, 11)))
    cat = Catalog.build(spark, str(tmp_path / "index"), [str(tmp_path / "o.vcf")])
    body = [x.split("\t")[:2] for x in sinks.vcf_body(cat.view("A1"), cat.chroms_table)]
    assert body == [[c, p] for c in ("chr2", "chr10", "chr1") for p in ("9", "11")]


def test_codes_of_missing_files(spark, files, cat, tmp_path):
    from variantsets.cli import _patterns

    for code, error, call in (
        (701, IndexNotOpen, lambda: Catalog.open(spark, str(tmp_path / "none"))),
        (7100, UnreadableVcf, lambda: Catalog.build(spark, str(tmp_path / "new"), [str(tmp_path / "none.vcf")])),
        (9000, NoNameFile, lambda: cat.rename_from(str(tmp_path / "none.txt"))),
        (10001, NoListFile, lambda: _patterns(str(tmp_path / "none.txt"))),
        (5003, IndexExists, lambda: Catalog.build(spark, str(files[0] / "index"), files[1])),
    ):
        with pytest.raises(error) as e:
            call()
        assert e.value.code == code


def test_distances_on_bitmaps(spark, cat, monkeypatch):
    """Both layouts agree, in blocks of any size, and nothing is exploded to pairs."""
    from variantsets.operators import distance

    table = lambda layout, **o: sorted(map(tuple, cat.dist(layout=layout, **o).collect()))
    plan = cat.dist()._jdf.queryExecution().toString()
    assert "Generate" not in plan and "explode" not in plan
    for block in (2048, 2, 1):
        monkeypatch.setattr(distance, "BLOCK", block)
        for options in ({}, {"on": ["ch1:1-200"], "bin_size": 100}, {"a": ["A1"], "b": ["A*", "B1"]}, {"on": ["ch1:1-120", "ch1:90-150"]}):
            assert table("bitmap", **options) == table("long", **options)


def test_wide_bitmaps(spark):
    """More words than one aggregate each gives the same carriers."""
    from variantsets.sources.catalog import bitmap_of, explode_bits

    rows = [("c", p, "A", "G", (p * 37 + 11 * k) % 1500) for p in range(1, 30) for k in range(p)] + [("c", 99, "A", "G", None)]
    index = bitmap_of(spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, sample_id int"), 1500)
    assert index.count() == 30 and {len(r["bits"]) for r in index.collect()} == {24}
    assert {tuple(r) for r in explode_bits(index).collect()} == {r for r in rows if r[4] is not None}
