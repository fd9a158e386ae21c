"""Line dedup over levelled sorted runs.

Documents are taken in batches of descending doc_id. A run is a table of line
keys, bucketed and sorted by hash, with the number of documents seen so far and
the largest doc_id. A batch's keys are merge-anti-joined with the runs' settled
keys (``MIN_DOCS`` documents seen: nothing can change for them any more); the
others, with the counts of the runs added, become a run of their own. When a
level holds ``FANOUT`` runs, they are compacted into one run of the next level.
At the end one run is left, and lines whose key is in at least ``MIN_DOCS``
documents stay only in the largest doc_id that holds them.

Runs are bucketed and sorted tables, so merging them moves no data; a key's rows
are summed map-side. A hot key is joined to its documents over salted tasks.

Defined results: a null or empty text is one empty line, which is never a key;
rows without doc_id count together as one document, smaller than any other;
repeated rows of a doc_id count as one document and are treated alike; an empty
table gives an empty result; all other columns are kept as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, Scratch, drop, fresh, partitions, salted_join

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 3
NO_ID = -(1 << 63)

_SPACE = " \t\n\x0b\x0c\r"


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """Hash of the stripped line with A-Z lower-cased; None where it is too short."""
    s = line.strip(_SPACE)
    return xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass").lower()) if len(s) >= min_chars else None


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, hashes = [], [], []
            for i, part, text in zip(batch.column("id").to_pylist(), batch.column("part").to_pylist(), batch.column("text").to_pylist()):
                keys = {k for x in (text or "").split("\n") if (k := line_key(x, min_chars))}
                hashes += keys
                ids += [i] * len(keys)
                parts += [part] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(hashes, pa.binary()), pa.array(ids, pa.int64())], ["part", "h", "id"])

    return run


def _without(min_chars: int, gone_name: str, n_lines: str, n_dropped: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column(gone_name).to_pylist()):
                all_ = (text or "").split("\n")
                if gone:
                    out = set(gone)
                    kept = [x for x in all_ if line_key(x, min_chars) not in out]
                else:
                    kept = all_
                texts.append("\n".join(kept))
                lines.append(len(all_))
                dropped.append(len(all_) - len(kept))
            names = [n for n in batch.schema.names if n != gone_name]
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, n_lines, n_dropped])

    return run


class Runs:
    """Levelled runs (h, n, top) kept as bucketed, sorted tables in the shared folder."""

    def __init__(self, scratch: Scratch, min_docs: int, fanout: int):
        self.scratch, self.spark, self.min_docs, self.fanout = scratch, scratch.spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.names: dict[int, str] = {}
        self.buckets = partitions(self.spark)

    def _write(self, df: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = df.select("h", "n", "top").repartition(self.buckets, "h")
        dealt.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.scratch.root}/{name}").saveAsTable(name)
        run = self.spark.table(name)
        self.names[id(run)] = name
        return run

    def _drop(self, run: DataFrame) -> None:
        name = self.names.pop(id(run))
        self.spark.sql(f"DROP TABLE {name}")
        drop(self.spark, f"{self.scratch.root}/{name}")  # a table with a path of its own leaves its files

    def all(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> None:
        """``batch``: (h, n, top) of new documents, all below those seen so far."""
        out = batch
        for run in self.all():
            out = out.join(run.where(F.col("n") >= self.min_docs), "h", "left_anti")
        for k, run in enumerate(self.all()):
            seen = run.select("h", F.col("n").alias("_n"), F.col("top").alias("_top"))
            # Counts in runs are running totals, so the largest one holds.
            out = out.join(seen, "h", "left").select("h", "n", "top", *[c for c in out.columns if c[0] == "_" and c not in ("_n", "_top")], F.col("_n").alias(f"_n{k}"), F.col("_top").alias(f"_top{k}"))
        ns, tops = [c for c in out.columns if c[:2] == "_n"], [c for c in out.columns if c[:4] == "_top"]
        if ns:
            zero = F.lit(0).cast("long")
            out = out.select("h", (F.col("n") + F.greatest(zero, *[F.coalesce(c, zero) for c in ns])).alias("n"), F.greatest("top", *tops).alias("top"))
        self.levels[0].append(self._write(out))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        runs = self.levels[level]
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(self._merge(runs))
        self.levels[level] = []

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        """Full outer merge of sorted runs: the largest running total of each key holds."""
        out = runs[0]
        for run in runs[1:]:
            other = run.select("h", F.col("n").alias("n2"), F.col("top").alias("top2"))
            out = out.join(other, "h", "full").select("h", F.greatest("n", "n2").alias("n"), F.greatest("top", "top2").alias("top"))
        new = self._write(out)
        for run in runs:
            self._drop(run)
        return new

    def merged(self) -> DataFrame:
        runs = self.all()
        out = self._merge(runs) if len(runs) > 1 else runs[0]
        self.levels = [[out]]
        return out


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, scratch: Scratch | None = None) -> DataFrame:
    """All columns of ``docs`` with the text cut, and __n_lines, __n_dropped (with more underscores after them where ``docs`` has such columns)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "line_dedup")
    id_, part_, gone_, n_lines, n_dropped = fresh(docs, "__id", "__part", "__gone", "__n_lines", "__n_dropped")
    # Only what is needed, under names of its own, so that no other column can clash.
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("id"), "text")
    shares = [k / batches for k in range(1, batches)]
    cuts = sorted({int(x) for x in keyed.approxQuantile("id", shares, 0.01)}, reverse=True) if shares else []
    part = sum([(F.col("id") < c).cast("int") for c in cuts], F.lit(0))
    staged = scratch.save(keyed.select("id", part.alias("part"), "text").mapInArrow(_keys(min_chars), "part int, h binary, id long"))
    runs = Runs(scratch, min_docs, FANOUT)
    for k in range(len(cuts) + 1):
        counted = staged.where(F.col("part") == k).distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
        runs.add(counted)
    hot = runs.merged().where(F.col("n") >= min_docs).select("h", "top")
    gone = salted_join(staged.select("h", "id").distinct(), hot, "h", "id").where("id < top").groupBy("id").agg(F.collect_list("h").alias(gone_))
    # Rows without doc_id share one key; they are dealt over tasks by their text.
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(F.col("id") == NO_ID, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    marked = docs.withColumn(id_, F.coalesce("doc_id", F.lit(NO_ID)).cast("long")).withColumn(part_, salt)
    side = gone.select(F.col("id").alias(id_), F.explode(salts).alias(part_), gone_)
    joined = marked.join(side, [id_, part_], "left").select(*[F.col(f"`{c}`") for c in docs.columns], gone_)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{n_lines}` long", f"`{n_dropped}` long"])
    return joined.mapInArrow(_without(min_chars, gone_, n_lines, n_dropped), schema)


def add_batch(runs: Runs, docs: DataFrame, min_chars: int = MIN_CHARS) -> None:
    """Adds a new batch to runs that are kept: its documents must be smaller than all that the runs have seen.

    ``runs.merged()`` then has each key's number of documents and the largest one; the runs can take further batches.
    """
    staged = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("id"), F.lit(0).alias("part"), "text").mapInArrow(_keys(min_chars), "part int, h binary, id long")
    runs.add(staged.select("h", "id").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")))
