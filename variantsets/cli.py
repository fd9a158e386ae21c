"""Command line: build, chroms, dist, rename, samples, view."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .errors import NoListFile, VariantQueryError
from .sources import sinks
from .sources.catalog import Catalog


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="variantsets", description="Set algebra over genomic variants")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: tuple[str, dict]) -> argparse.ArgumentParser:
        c = sub.add_parser(name, allow_abbrev=True)
        for arg, options in positional:
            c.add_argument(arg, **options)
        return c

    index = ("index", {})
    c = command("build", index, ("vcf", {"nargs": "+"}))
    c.add_argument("-f", "--force", action="store_true")
    c.add_argument("-H", "--homozygous", action="store_true")
    c.add_argument("-n", "--name-file")
    c.add_argument("-t", "--types", choices=["snps", "indels", "both"], default="both")
    c.add_argument("-v", "--verbose", action="store_true")
    command("chroms", index).add_argument("-n", "--no-headers", action="store_true")
    c = command("samples", index)
    c.add_argument("-c", "--contains")
    c.add_argument("-m", "--match")
    c.add_argument("-n", "--no-headers", action="store_true")
    c = command("view", index, ("query", {}), ("region", {"nargs": "*"}))
    c.add_argument("-n", "--no-headers", action="store_true")
    c = command("dist", index, ("region", {"nargs": "*"}))
    for short, name in (("-a", "--a-match"), ("-b", "--b-match"), ("-m", "--match"), ("-c", "--contains")):
        c.add_argument(short, name)
    for name in ("--ac", "--bc", "--a-list-file", "--b-list-file", "--list-file"):
        c.add_argument(name)
    c.add_argument("-B", "--bin-size", type=int)
    c.add_argument("-j", "--json", action="store_true")
    c = command("rename", index, ("names", {"nargs": "*"}))
    c.add_argument("-n", "--name-file")
    return p


def _patterns(path: str | None) -> list[str]:
    if not path:
        return []
    try:
        with open(path) as f:
            return [line.rstrip("\n") for line in f if line.rstrip("\n")]
    except OSError as e:
        raise NoListFile(f"{path} cannot be read") from e


def _one(x: str | None) -> list[str]:
    return [x] if x else []


def run(args: argparse.Namespace, spark: SparkSession, out=sys.stdout) -> None:
    say = lambda line: print(line, file=out)
    if args.command == "build":
        Catalog.build(spark, args.index, args.vcf, args.types, args.homozygous, args.name_file, args.force)
        return
    cat = Catalog.open(spark, args.index)
    if args.command == "chroms":
        if not args.no_headers:
            say("Chromosome\tLength\tVariants")
        for r in cat.chroms().collect():
            say(f"{r['chrom']}\t{r['length']}\t{r['variant_count']}")
    elif args.command == "samples":
        if not args.no_headers:
            say("Sample")
        for r in cat.samples(args.match, args.contains).collect():
            say(r["name"])
    elif args.command == "view":
        found = cat.view(args.query, args.region or None)
        if found.columns == ["name"]:  # a list of genomes has no header
            for r in found.collect():
                say(r["name"])
            return
        if not args.no_headers:
            for line in sinks.vcf_header(f"view {args.query}", args.region):
                say(line)
        for line in sinks.vcf_body(found, cat.chroms_table):
            say(line)
    elif args.command == "dist":
        sided = any((args.a_match, args.b_match, args.ac, args.bc, args.a_list_file, args.b_list_file))
        both = _one(args.match) + _patterns(args.list_file)
        found = cat.dist(both, _one(args.contains), _one(args.a_match) + _patterns(args.a_list_file), _one(args.b_match) + _patterns(args.b_list_file), _one(args.ac), _one(args.bc), args.region or None, args.bin_size)
        if args.json or args.bin_size or sided:
            say(sinks.matrix_json(found))
        else:
            for line in sinks.phylip(found):
                say(line)
    elif args.name_file:
        cat.rename_from(args.name_file)
    else:
        old, new = args.names
        cat.rename(old, new, allow_duplicates=True)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("variantsets").getOrCreate()
    try:
        run(args, spark)
    except VariantQueryError as e:
        print(f"Error: {e}", file=sys.stderr)
        return e.code
    return 0


if __name__ == "__main__":
    sys.exit(main())
