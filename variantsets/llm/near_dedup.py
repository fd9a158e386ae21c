"""MinHash near-dedup with tensored banding.

Two collections of ``m`` half-keys (``HALF`` MinHashes each) are computed for a
document; the ``m * m`` table keys are the pairs of a half-key of the first and
one of the second collection. So ``2 * HALF * m`` MinHashes serve ``m * m``
tables. A half-key that no other document shares cannot be part of a shared
table key, so table keys are formed from shared half-keys only.

Equal sets are collapsed first. Candidates are checked on the full shingle sets.
Components do not need every pair of a bucket: each member is checked against
the least member. Buckets that then still lie in several components are joined
to families, and a family is compared in full, in blocks: a task holds the sets
of two blocks, counts all their intersections by one matrix product and hands on
a spanning forest of the links, never the pairs.

Two documents at similarity s share a table key with probability
(1 - (1 - s**HALF)**m)**2: 0.9999 at 0.8 and nearly 1 above it.

Defined results: texts without words have an empty set and link with nothing; a
row without doc_id links with nothing and is kept; repeated rows are copies of
one document; an empty table gives an empty result; columns besides doc_id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHash, fresh, grams, low_words, mix64, partitions, salted_join, texts_of
from .components import components

#: MinHashes in a half-key.
HALF = 2
#: Half-keys in each of the two collections.
TABLES = 10
#: Documents in a block of a family, about.
BLOCK = 512
#: Rows of one hub that one task verifies.
HUB_ROWS = 2000
#: Pairs whose MinHashes agree less than this share are no candidates (at 0.8, 40 values do so once in 1e6).
AGREE = 0.5

SKETCH = "id long, n long, key binary, halves array<long>, sig binary"


def _seeds(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(batch: pa.RecordBatch, k: int, hashed: WordHash) -> Iterator[np.ndarray]:
    for text in batch.column("text").to_pylist():
        yield np.unique(grams(hashed(low_words(text)), k))


def _lists(flat: np.ndarray, sizes, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64), kind))


def _sketcher(k: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, seeds = WordHash(), _seeds(2 * tables * HALF)
        odd = seeds | np.uint64(1)
        for batch in batches:
            sets = list(shingle_sets(batch, k, hashed))
            n = np.array([len(x) for x in sets], np.int64)
            full = np.flatnonzero(n)
            keys: list[bytes | None] = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            low = _minima(np.concatenate(sets), np.cumsum(n[full]) - n[full], seeds, odd) if len(full) else np.zeros((0, len(seeds)), np.uint64)
            bits = (mix64(low) & np.uint64(255)).astype(np.uint8)
            h = low.reshape(len(full), 2 * tables, HALF)
            acc = np.broadcast_to(np.arange(1, 2 * tables + 1, dtype=np.uint64), (len(full), 2 * tables))
            for j in range(HALF):
                acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) ^ h[:, :, j])
            # The lowest bit tells the collection.
            acc = acc & ~np.uint64(1) | (np.arange(2 * tables) >= tables).astype(np.uint64)
            sigs: list[bytes | None] = [None] * len(sets)
            for row, i in zip(bits, full):
                sigs[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(keys, pa.binary()), _lists(acc.ravel(), (n > 0) * 2 * tables, pa.int64()), pa.array(sigs, pa.binary())],
                ["id", "n", "key", "halves", "sig"],
            )

    return run


def _minima(flat: np.ndarray, starts: np.ndarray, seeds: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """MinHashes of each set in ``flat``: a row for a set, a column for a seed."""
    out = np.empty((len(starts), len(seeds)), np.uint64)
    for i, (seed, a) in enumerate(zip(seeds, odd)):
        x = flat ^ seed
        x *= a
        x ^= x >> np.uint64(32)
        x *= a
        out[:, i] = np.minimum.reduceat(x, starts)
    return out


def _setter(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHash()
        for batch in batches:
            sets = list(shingle_sets(batch, k, hashed))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), _lists(flat, [len(s) for s in sets], pa.int64())], ["id", "hashes"])

    return run


def _agreeing(share: float, threshold: float):
    """Keeps pairs whose set sizes allow the threshold and whose MinHashes agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            ok = (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9) & ((x == y).mean(axis=1) >= share)
            yield batch.filter(pa.array(ok)).select(["a", "b"])

    return run


def forest(sets: list[np.ndarray], left: int, percent: int) -> list[tuple[int, int]]:
    """Links (i, least of its component) among sets, found between the first ``left`` and the others (all with all if none)."""
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # a shingle of one set meets nothing
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    column = np.cumsum(np.r_[0, np.diff(column) != 0]) if len(column) else column
    a, b = (slice(0, left), slice(left, None)) if left < len(sets) else (slice(None), slice(None))
    common = np.zeros((len(sizes[a]), len(sizes[b])), np.float32)
    step = 4096
    total = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, total, step):
        lo, hi = np.searchsorted(column, [start, start + step])
        x = np.zeros((len(sets), step), np.float32)
        x[owner[lo:hi], column[lo:hi] - start] = 1
        common += x[a] @ x[b].T
    common = np.rint(common).astype(np.int64)
    union = sizes[a][:, None] + sizes[b][None, :] - common
    i, j = np.nonzero(common * 100 >= percent * union)
    j = j + (left if left < len(sets) else 0)
    label = np.arange(len(sets))
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(k), int(label[k])) for k in np.flatnonzero(label != np.arange(len(sets)))]


def _blocks(percent: int):
    """Rows arrive dealt and sorted by (family, p, q); a pair of blocks may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, left = None, [], [], 0

        def links() -> pa.RecordBatch:
            found = forest(sets, left, percent) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[x] for _, x in found], pa.int64()), pa.array([ids[x] for x, _ in found], pa.int64())], ["a", "b"])

        for batch in batches:
            hashes = batch.column("hashes")
            flat, offsets = hashes.values.to_numpy(zero_copy_only=False), hashes.offsets.to_numpy()
            rows = zip(*(batch.column(c).to_pylist() for c in ("family", "p", "q", "right", "id")))
            for k, (f, p, q, right, doc) in enumerate(rows):
                if (f, p, q) != key:
                    if key is not None:
                        yield links()
                    key, ids, sets, left = (f, p, q), [], [], 0
                ids.append(doc)
                sets.append(flat[offsets[k] : offsets[k + 1]].copy())
                left += not right
        if key is not None:
            yield links()

    return run


class NearDedup:
    """One run over a table: ``links()`` finds the classes, ``result()`` gives a row per input row."""

    def __init__(self, docs: DataFrame, k: int = 5, percent: int = 80, tables: int = TABLES, scratch: Scratch | None = None):
        self.scratch = scratch or Scratch(docs.sparkSession, "near_dedup")
        self.docs = docs.select("doc_id", "text")
        self.k, self.percent, self.tables = k, percent, tables

    def _sets(self, ids: DataFrame) -> DataFrame:
        """Full shingle sets of the documents named in ``ids`` (id)."""
        some = texts_of(self.docs, ids, self.scratch)
        return self.scratch.save(some.mapInArrow(_setter(self.k), "id long, hashes array<long>"))

    def _agree(self, pairs: DataFrame) -> DataFrame:
        """(a, b) pairs whose sketches allow the threshold."""
        sig = self.sketch.select("id", "n", "sig")
        side = lambda c: sig.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
        both = salted_join(pairs, side("a"), "a", "b", salts=4).join(side("b"), "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b")
        return both.mapInArrow(_agreeing(AGREE, self.percent / 100), "a long, b long")

    def _verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs whose full sets meet the threshold; a hub's set goes to as many tasks as its pairs need."""
        deal = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(HUB_ROWS)).cast("int").alias("parts"))
        dealt = salted_join(pairs, deal, "a", "b").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
        hubs = sets.join(deal.withColumnRenamed("a", "id"), "id").select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hashes").alias("x"))
        both = dealt.join(hubs, ["a", "part"]).join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y")).cast("long")
        counted = both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).cast("long").alias("total"))
        return self.scratch.save(counted.where(F.col("common") * 100 >= self.percent * (F.col("total") - F.col("common"))).select("a", "b").distinct())

    def _keys(self) -> DataFrame:
        """(key, id): the table keys that can be shared."""
        half = self.sketch.select("id", F.explode("halves").alias("h"))
        shared = half.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h")
        own = salted_join(half, shared, "h", "id", salts=8).groupBy("id").agg(F.collect_set("h").alias("s"))
        u, v = F.filter("s", lambda h: h.bitwiseAND(F.lit(1)) == 0), F.filter("s", lambda h: h.bitwiseAND(F.lit(1)) == 1)
        pairs = own.select("id", u.alias("u"), v.alias("v")).where("size(u) > 0 and size(v) > 0")
        return pairs.select("id", F.explode("u").alias("p"), "v").select("id", "p", F.explode("v").alias("q")).select(F.xxhash64("p", "q").alias("key"), "id")

    def _stars(self, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs of each bucket's least member with the others, and the buckets of three or more."""
        span = self.scratch.save(keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count(F.lit(1)).alias("n")).where("a < z"))
        many = self.scratch.save(salted_join(keys, span.where("n > 2").select("key", "a"), "key", "id", salts=8))
        stars = span.where("n = 2").select("a", F.col("z").alias("b")).union(many.where("id > a").select("a", F.col("id").alias("b")))
        return stars.distinct(), many.select("key", "id")

    def _apart(self, keys: DataFrame, comp: DataFrame) -> DataFrame:
        """(key, id, comp) of the buckets that hold several components."""
        placed = keys.join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
        mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
        return salted_join(placed, mixed.select("key", "n"), "key", "id", salts=8)

    def _within(self, apart: DataFrame) -> DataFrame:
        """Links (a, b) among the members of buckets that still hold several components."""
        scratch = self.scratch
        low = apart.groupBy("key").agg(F.min("id").alias("a"))
        family = components(salted_join(apart, low, "key", "id", salts=8).where("id > a").select("a", F.col("id").alias("b")), scratch).withColumnRenamed("component", "family")
        blocks = family.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
        placed = salted_join(family, blocks, "family", "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        met = placed.select("family", "id", "own", other.alias("other"))
        met = met.select("family", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).alias("right"), "id")
        sets = self._sets(family.select("id"))
        dealt = met.join(sets, "id").repartition(partitions(sets.sparkSession), "family", "p", "q").sortWithinPartitions("family", "p", "q", "right", "id")
        found = scratch.save(dealt.mapInArrow(_blocks(self.percent), "a long, b long"))
        scratch.free(sets)
        return found

    def links(self) -> DataFrame:
        """(id, component) of the representatives that have links."""
        scratch = self.scratch
        full = scratch.save(self.docs.where("doc_id is not null").mapInArrow(_sketcher(self.k, self.tables), SKETCH))
        reps = scratch.save(full.where("n > 0").groupBy("key").agg(F.min("id").alias("rep")))
        self.members = scratch.save(salted_join(full.where("n > 0").select("id", "key"), reps, "key", "id").select("id", "rep").distinct())
        self.sizes = scratch.save(full.select("id", "n"))
        self.sketch = scratch.save(full.join(reps.select("key", F.col("rep").alias("id")), ["key", "id"], "left_semi").dropDuplicates(["key"]).select("id", "n", "halves", "sig"))
        scratch.free(full, reps)
        keys = scratch.save(self._keys())
        stars, many = self._stars(keys)
        scratch.free(keys)
        candidates = scratch.save(self._agree(stars))
        ids = lambda p: p.select(F.col("a").alias("id")).union(p.select("b"))
        sets = self._sets(ids(candidates))
        first = candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        edges = self._verify(first, sets)
        comp = components(edges, scratch)
        c = lambda x: comp.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}"))
        open_ = candidates.join(first, ["a", "b"], "left_anti").join(c("a"), "a", "left").join(c("b"), "b", "left").where("coalesce(c_a, a) <> coalesce(c_b, b)")
        found = self._verify(scratch.save(open_.select("a", "b")), sets)
        if not found.isEmpty():
            edges = scratch.save(edges.union(found))
            comp = components(edges, scratch)
        scratch.free(sets)
        apart = scratch.save(self._apart(many, comp))
        if not apart.isEmpty():
            comp = components(edges.union(self._within(apart)), scratch)
        return comp

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept; one row for each input row."""
        comp = self.links()
        rep = self.members.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
        # A doc_id that names several texts joins their classes.
        place = rep.groupBy("id").agg(F.min("component").alias("component"))
        known = self.sizes.join(place, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
        out = known.withColumn("kept", F.col("doc_id") == F.col("component_id"))
        lost = self.docs.where("doc_id is null").mapInArrow(_sketcher(self.k, 1), SKETCH)
        return out.unionByName(lost.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    return NearDedup(docs, k, percent, scratch=scratch).result()


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """One row of the least doc_id of each class, all its columns, of several with that doc_id the one with the least text hash; rows without doc_id stay."""
    kept = near_dedup(docs, k, percent, scratch).where("kept and doc_id is not null")
    row, id_ = fresh(docs, "__row", "__id")
    named = docs.where("doc_id is not null").join(kept.select(F.col("doc_id").alias(id_)).distinct(), F.col("doc_id") == F.col(id_), "left_semi")
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = named.groupBy("doc_id").agg(F.min_by(columns, F.struct(F.xxhash64("text"), F.col("text"))).alias(row))
    return one.select(f"{row}.*").unionByName(docs.where("doc_id is null"))
