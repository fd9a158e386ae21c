"""Packing token sequences by minimum bin slack.

This tokenizer splits a text into runs of letters, single digits and runs of other
marks before it looks at its vocabulary, so the ids of these parts are looked up
in a cache of bounded size and joined; parts are learnt many at a time, told apart
by the ends of words that the ids carry. Texts beyond Latin-1, or with special
tokens, are cut at blanks instead, which no token spans. Whole windows of ``CAPACITY`` tokens are cut off a document's front; the
rests (at most ``CAPACITY - 1`` tokens) are packed. Only the histogram of their
lengths, at most ``CAPACITY - 1`` rows whatever the input, goes to the driver.
There, each window takes the longest rest left and then the multiset of rests
that a bitset subset-sum over the lengths finds closest to capacity; a fill is
repeated as often as its counts allow, so the number of fills depends on the
number of lengths and not on the number of documents. The rests are numbered
within their length over salted buckets and looked up in the list of fills.

Defined results: a null or empty text is the end id alone; rows without doc_id
and repeated rows are packed as documents of their own; an empty table gives an
empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

CAPACITY = 4096
END = 2
BUCKETS = 32
VOCABULARY = "word_bpe_49k.json"
#: Bounds of the cache: parts and bytes.
CACHE_PARTS, CACHE_BYTES = 500_000, 16_000_000
#: Parts in a string that is tokenised to learn them.
LEARN = 200

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


# In Latin-1: capitals to small letters, and the parts by classes of letters, numbers and blanks.
_LOW = bytes(ord(chr(b).lower()) if len(chr(b).lower()) == 1 and ord(chr(b).lower()) < 256 else b for b in range(256))
_LETTER, _NUMBER, _BLANK = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe", rb"\t-\r\x20\x85\xa0"
_PART = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[" + _LETTER + rb"]+|[" + _NUMBER + rb"]|[^" + _LETTER + _NUMBER + _BLANK + rb"]+")


class Encoder:
    """Token ids of texts by way of a cache of the parts that the tokenizer takes one by one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocabulary = self.tok.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes | str, int] = {}
        self.held, self.ids, self.first, self.size = 0, array("I"), array("q"), array("q")

    def _keep(self, key: bytes | str, ids: list[int]) -> None:
        self.at[key] = len(self.first)
        self.held += len(key)
        self.first.append(len(self.ids))
        self.size.append(len(ids))
        self.ids.extend(ids)

    def learn(self, keys: list[bytes | str]) -> None:
        chunks = [k for k in keys if isinstance(k, str)]
        for chunk, e in zip(chunks, self.tok.encode_batch(chunks, add_special_tokens=False)):
            self._keep(chunk, e.ids)
        parts = [k for k in keys if isinstance(k, bytes)]
        for i in range(0, len(parts), LEARN * 64):
            some = parts[i : i + LEARN * 64]
            joined = [b" ".join(some[j : j + LEARN]).decode("latin-1") for j in range(0, len(some), LEARN)]
            ids = np.concatenate([e.ids for e in self.tok.encode_batch_fast(joined, add_special_tokens=False)])
            stops = (np.flatnonzero(self.last[ids]) + 1).tolist()
            assert len(stops) == len(some)
            flat, a = ids.tolist(), 0
            for key, b in zip(some, stops):
                self._keep(key, flat[a:b])
                a = b

    @staticmethod
    def parts(text: str) -> list[bytes] | list[str]:
        if "<|" not in text:
            try:
                return _PART.findall(text.encode("latin-1").translate(_LOW))
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.at) > CACHE_PARTS or self.held > CACHE_BYTES:
            self.clear()
        split = [self.parts(t) for t in texts]
        keys = [k for s in split for k in s]
        new = set(keys).difference(self.at)
        if new:
            self.learn(list(new))
        which = np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))
        ids, first, size = (np.frombuffer(x, np.dtype("u4" if x.typecode == "I" else "i8")) if x else np.zeros(0, np.int64) for x in (self.ids, self.first, self.size))
        n = size[which]
        ends = np.r_[0, np.cumsum(n)]
        total = int(ends[-1])
        flat = ids[np.repeat(first[which] - ends[:-1], n) + np.arange(total)] if total else np.zeros(0, np.uint32)
        stops = ends[np.cumsum([len(s) for s in split])] if split else []
        out, a = [], 0
        for b in stops:
            out.append(np.append(flat[a:b], np.uint32(END)).astype("<u4"))
            a = b
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker, so that what it has learnt stays."""
    return Encoder(path)


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode([t or "" for t in batch.column("text").to_pylist()])):
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    for col, x in zip(out, (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece if with_ids else None)):
                        col.append(x)
            cols = [pa.array(c, pa.int64()) for c in out[:5]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols.append(pa.array(out[5], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Lengths and how often each: the longest one left, and those that leave the least slack beside it."""
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    seed = lengths[0]
    room = capacity - seed
    reach, steps = 1, []
    full = (1 << (room + 1)) - 1
    for n in lengths:
        if n > room:
            continue
        left = min(counts[n] - (n == seed), room // n)
        if not left:
            continue
        steps.append((n, reach))
        new, power = reach, 1
        while left:  # multiples of n by doubling
            take = min(power, left)
            new |= (new << (n * take)) & full
            left -= take
            power *= 2
        reach = new
        if reach >> room & 1:
            break
    target = reach.bit_length() - 1
    used = {seed: 1}
    for n, before in reversed(steps):
        while not before >> target & 1:
            target -= n
            used[n] = used.get(n, 0) + 1
    return used


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, rank from, rank to, pieces a window, first window, offset), and the number of windows."""
    left = dict(counts)
    taken = dict.fromkeys(left, 0)
    rows, windows = [], 0
    while left:
        used = fill(left, capacity)
        times = min(left[n] // k for n, k in used.items())
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            rows.append((n, taken[n], taken[n] + k * times, k, windows, offset))
            taken[n] += k * times
            offset += n * k
            left[n] -= k * times
            if not left[n]:
                del left[n]
        windows += times
    return rows, windows


def _placed(rows: list[tuple[int, int, int, int, int, int]], names: list[str]):
    """Looks up (length, rank) in the fills."""
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.int64(1) << 40
        keys = table[:, 0] * width + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            row = table[np.searchsorted(keys, length * width + rank, "right") - 1] if len(table) else np.zeros((len(rank), 6), np.int64)
            q = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(row[:, 4] + q // row[:, 3]), pa.array(row[:, 5] + q % row[:, 3] * length)], names + ["sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens (ids), sequence_id, offset."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    schema = PIECES + (", ids array<int>" if with_ids else "")
    cut = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(path or public_tokenizers.path(VOCABULARY), capacity, with_ids), schema)
    names = cut.columns
    pieces = scratch.save(cut.withColumn("__uid", F.monotonically_increasing_id()))
    rest = pieces.where(F.col("length") < capacity)
    counts = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}
    rows, windows = plan(counts, capacity)
    whole = pieces.where(F.col("length") == capacity).select(*names, (F.col("__uid") + F.lit(windows)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    small = rest.select("length", "__uid", F.pmod(F.xxhash64("__uid"), F.lit(BUCKETS)).alias("bucket"))
    per = small.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("c"))
    base = per.select("length", "bucket", (F.sum("c").over(Window.partitionBy("length").orderBy("bucket")) - F.col("c")).alias("base"))
    at = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("__uid")) - 1
    order = rest.withColumn("bucket", F.pmod(F.xxhash64("__uid"), F.lit(BUCKETS))).withColumn("__at", at).join(base, ["length", "bucket"]).select(*names, (F.col("base") + F.col("__at")).cast("long").alias("__rank"))
    placed = order.mapInArrow(_placed(rows, names), schema + ", sequence_id long, offset long")
    return whole.unionByName(placed)
