"""Document fingerprints by one-permutation MinHash.

Each word shingle is hashed once: its high bits choose one of ``BINS`` bins, which
keeps the least of the rest. An empty bin takes the value of a bin that a
universal hash of (bin, attempt) picks, tried until a filled one is met (optimal
densification). The low ``BITS`` bits of every bin are packed into a hex string.
Two fingerprints agree by chance in 2**-BITS of the bins, so likeness is
(agreement - 2**-BITS) / (1 - 2**-BITS), within 0 to 1. A fingerprint of a text
without words is empty; it is like another empty one only.

Each document is compared with its edited text, whose end is the start of the
next document by descending doc_id, and with that next document. For this the
table is dealt by ranges of doc_id, sorted within them, and the largest document
of a range is also given to the range above it; no other row is copied. Rows
without doc_id, which may be many, are dealt by ranges of their texts' hashes.

Defined results: null or empty texts have empty fingerprints; rows without
doc_id come last; equal doc_ids are ordered by text; the document after the last
is the first, itself where the table has one row; an empty table gives an empty
result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, WordHash, grams, low_words, mix64, partitions

BINS = 128
BITS = 8
SHINGLE = 5
NO_ID = -(1 << 63)


def fill_order(bins: int) -> np.ndarray:
    """Row a: the bin that each bin looks at in attempt a."""
    place = mix64(np.arange(1, bins + 1, dtype=np.uint64))[None, :]
    attempt = mix64(np.arange(1, 4 * bins + 1, dtype=np.uint64))[:, None]
    return (mix64(place + attempt) % np.uint64(bins)).astype(np.int64)


class Fingerprints:
    def __init__(self, bins: int = BINS, bits: int = BITS, k: int = SHINGLE):
        self.bins, self.bits, self.k = bins, bits, k
        self.shift, self.order, self.hashed = np.uint64(64 - bins.bit_length() + 1), fill_order(bins), WordHash()

    def of_hashes(self, w: np.ndarray) -> np.ndarray | None:
        """The packed bits' values of each bin; None for a text without words."""
        if not len(w):
            return None
        h = grams(w, self.k)
        least = np.full(self.bins, np.uint64(0xFFFFFFFFFFFFFFFF))
        np.minimum.at(least, (h >> self.shift).astype(np.int64), h << np.uint64(self.bins.bit_length() - 1))
        empty = np.flatnonzero(least == np.uint64(0xFFFFFFFFFFFFFFFF))
        if len(empty):
            filled = least != np.uint64(0xFFFFFFFFFFFFFFFF)
            source = np.full(self.bins, -1, np.int64)
            open_ = empty
            for row in self.order:
                hit = filled[row[open_]]
                source[open_[hit]] = row[open_[hit]]
                open_ = open_[~hit]
                if not len(open_):
                    break
            source[open_] = np.flatnonzero(filled)[0]
            least[empty] = least[source[empty]]
        return (mix64(least) & np.uint64((1 << self.bits) - 1)).astype(np.uint16)

    def of_text(self, text: str) -> np.ndarray | None:
        return self.of_hashes(self.hashed(low_words(text)))

    def pack(self, values: np.ndarray | None) -> str:
        if values is None:
            return ""
        places = (values[:, None] >> np.arange(self.bits - 1, -1, -1, dtype=np.uint16)) & np.uint16(1)
        return np.packbits(places.astype(np.uint8).ravel()).tobytes().hex()

    def likeness(self, x: np.ndarray | None, y: np.ndarray | None) -> float:
        if x is None or y is None:
            return float(x is None and y is None)
        chance = 2.0**-self.bits
        return min(1.0, max(0.0, (float((x == y).mean()) - chance) / (1 - chance)))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(bins: int, bits: int, k: int):
    """Rows of one range in ascending order: the row before is the next one by descending doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(bins, bits, k)
        part, before, before_print = None, "", None
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for bucket, ghost, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "ghost", "doc_id", "text"))):
                text = text or ""
                own = prints.of_text(text)
                if not ghost:
                    # Without a ghost before it (which never happens), a row would be compared with an empty text.
                    if bucket != part:
                        before, before_print = "", None
                    cut = len(text) // 3
                    edited = text[: len(text) - cut] + before[:cut]
                    changed = prints.of_text(edited) if cut else own
                    row = (doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), prints.pack(own), prints.pack(changed), prints.likeness(own, changed), prints.likeness(own, before_print))
                    for col, x in zip(out, row):
                        col.append(x)
                part, before, before_print = bucket, text, own
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

    return run


def _range_of(x: Column, cuts: list[int]) -> Column:
    """The number of cuts at or below x; looked for among the heads of blocks of cuts, then in one block."""
    if not cuts:
        return F.lit(0)
    size = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    longs = lambda xs: F.array(*[F.lit(v).cast("long") for v in xs])
    block = F.size(F.filter(longs([b[0] for b in blocks]), lambda c: c <= x))
    inside = F.size(F.filter(F.array(*[longs(b) for b in blocks])[F.greatest(block - 1, F.lit(0))], lambda c: c <= x))
    return F.greatest(block - 1, F.lit(0)) * size + inside


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, k: int = SHINGLE, scratch: Scratch | None = None) -> DataFrame:
    """A row per document: its fingerprint and its edited text's, and the likeness to that and to the next document."""
    parts = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    named = rows.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("id"))
    cuts = sorted({int(x) for x in named.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    # The first ranges hold the rows without doc_id by the texts' hashes, the others the rest by doc_id.
    by_hash = F.least(F.floor((F.xxhash64("text").cast("double") / 2.0**64 + 0.5) * parts), F.lit(parts - 1)).cast("int")
    rows = rows.withColumn("part", F.when(F.col("id") == NO_ID, by_hash).otherwise(_range_of(F.col("id"), cuts) + parts).cast("int"))
    # The largest row of each range goes to the range above it as well; the largest of all to the lowest.
    tops = rows.groupBy("part").agg(F.max(F.struct("id", F.xxhash64("text").alias("h"))).alias("top"))
    line = Window.orderBy("part")  # a row per range
    lowest = F.min("part").over(Window.partitionBy())
    # Written, so that Spark knows how small it is and need not shuffle the texts for it.
    tops = (scratch or Scratch(docs.sparkSession, "fingerprints")).save(tops.select("top.*", F.coalesce(F.lead("part").over(line), lowest).alias("to")))
    hit = (rows["id"] == tops["id"]) & (F.xxhash64(rows["text"]) == tops["h"])
    ghosts = rows.join(tops, hit).select("doc_id", "text", rows["id"], F.col("to").alias("part"), F.lit(True).alias("ghost"))
    all_ = rows.withColumn("ghost", F.lit(False)).select("doc_id", "text", "id", "part", "ghost").unionByName(ghosts.select("doc_id", "text", "id", "part", "ghost"))
    dealt = all_.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", F.col("ghost").desc(), "id", F.xxhash64("text"))
    return dealt.mapInArrow(_compare(bins, bits, k), SCHEMA)
