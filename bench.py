"""Runs the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from variantsets.sources import adapter  # noqa: E402
from variantsets.sources.catalog import Catalog  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM = int(os.environ.get("BENCH_WARM", "3"))

VIEWS = {
    "intersect": ("S1 & S2", None),
    "difference": ("S1 \\ S2", None),
    "nested": ("((S1 | S2) \\ S3) ^ (u(S4,S5) & S6)", None),
    "fn_union": ("u(*)", None),
    "fn_intersect": ("i(S1,S2,S3)", None),
    "fn_symdiff": ("s(*)", None),
    "unique": ("S5 \\ u(* - S5)", None),
    "region": ("S1 | S2", ["ch01:1-250"]),
}


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="variantsets-bench-")
    took: dict[str, float] = {}

    def timed(name: str, run, warm: int = WARM) -> None:
        start = time.perf_counter()
        run()
        took[f"{name}_cold"] = round(time.perf_counter() - start, 4)
        laps = []
        for _ in range(warm):
            start = time.perf_counter()
            run()
            laps.append(time.perf_counter() - start)
        if laps:
            took[name] = round(statistics.median(laps), 4)

    try:
        timed("build", lambda: Catalog.write(adapter.calls(spark, SF), adapter.sample_rows(), f"{folder}/index", force=True), 1)
        cat = Catalog.open(spark, f"{folder}/index")
        long = Catalog.open(spark, f"{folder}/index")
        cat.carriers.write.parquet(f"{folder}/carriers")
        long.carriers = spark.read.parquet(f"{folder}/carriers")
        for layout, c in (("bitmap", cat), ("long", long)):
            for name, (query, on) in VIEWS.items():
                timed(f"{name}_{layout}", lambda c=c, query=query, on=on, layout=layout: drain(c.view(query, on, layout)))
        site = cat.variants.orderBy("chrom", "pos", "ref", "alt").first()
        timed("samples_contains", lambda: drain(cat.samples(contains=f"{site['chrom']}:{site['pos']}:{site['ref']}:{site['alt']}")))
        for layout, c in (("", long), ("_bitmap", cat)):
            timed(f"dist_all{layout}", lambda c=c, layout=layout: drain(c.dist(layout=layout.strip("_") or "long")))
            timed(f"dist_binned{layout}", lambda c=c, layout=layout: drain(c.dist(on=["ch01:1-25000"], bin_size=5000, layout=layout.strip("_") or "long")))
        warm = {k: v for k, v in took.items() if not k.endswith("_cold")}
        print(json.dumps({"metric": "variant_queries_total_warm", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/"))}))
    finally:
        shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
