"""Shared helpers of the training-data operators: tables, scratch space, text.

Nothing here decides results; it holds what several operators need: reading a
corpus table, writing an intermediate table to the folder that all executors
share, salted joins for hot keys, and the byte-level word rules.
"""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are bounded by bytes, so that very long texts cannot pile up.
ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}
#: A join of texts to a few ids drops most texts before they are shuffled, by a Bloom filter of at most 8 MB.
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1b",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256MB",
}

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of all executors, by the shared folder, once for an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top, held = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/variantsets/code-{uuid.uuid4().hex}/variantsets_code.zip")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path)
    out.write(held.getvalue())
    out.close()
    spark.sparkContext.addPyFile(fs.makeQualified(path).toString())
    _SHIPPED.add(app)


def prepare(spark: SparkSession) -> SparkSession:
    ship(spark)
    for key, value in (ARROW | BLOOM).items():
        spark.conf.set(key, value)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by the driver and executors: ``spark.checkpoint.dir``.

    Only where it is unset, as in tests on one machine, a folder of its own is
    made and recorded.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="variantsets-")
        base = f"file://{_OWN[app]}"
    return base.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediate Parquet tables of one query, in the shared folder.

    ``save`` writes a frame and rereads it, which cuts its lineage: a lost
    executor costs a reread, not the plan above. ``free`` removes tables that
    nothing refers to any more; the rest go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = prepare(spark), 0
        self.root = f"{shared_dir(spark)}/variantsets/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        atexit.register(self.close)

    def save(self, df: DataFrame, **options) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def free(self, *frames: DataFrame | None) -> None:
        for df in frames:
            path = self.paths.pop(id(df), None)
            if path:
                drop(self.spark, path)

    def close(self) -> None:
        try:
            drop(self.spark, self.root)
        except Exception:  # the session has ended
            pass


def texts_of(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (id), with Spark's Bloom filter of the ids before the shuffle.

    Spark makes that filter for a join side with a condition of its own, hence the column ``named``.
    """
    some = scratch.save(ids.select(F.col("id").alias("doc_id"), F.lit(1).alias("named")).distinct())
    return docs.join(some.where("named = 1").select("doc_id"), "doc_id", "left_semi")


SALTS = 16


def salted_join(rows: DataFrame, few: DataFrame, key: str, salt_by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join ``rows`` to ``few`` (one row a key) with the rows of a hot key dealt over ``salts`` tasks.

    Always a merge join: Spark's estimate of ``few`` leaves its copies for each salt out, so it could broadcast too much.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as make it differ from all columns of ``df``, whatever their case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


# --- words -----------------------------------------------------------------


def low_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class WordHash:
    """64-bit hashes of words with a cache of bounded size."""

    def __init__(self, limit: int = 400_000):
        self.cache = _Hashes()
        self.limit = limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.cache) > self.limit:
            self.cache.clear()
        return np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, vectorised."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def grams(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words, in order (the whole sequence where it is shorter)."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    size = min(k, n)
    h = np.full(n - size + 1, np.uint64(size), np.uint64)
    for i in range(size):
        h = mix64((h ^ word_hashes[i : n - size + 1 + i]) + _M1)
    return h
