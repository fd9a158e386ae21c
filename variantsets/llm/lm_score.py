"""LM scoring by Brown class-based bigrams.

P(word | previous word) = P(class | previous class) * P(word | class). Counts of
words and of neighbouring symbols are gathered from all training documents. Classes
come from the exchange algorithm, which moves words to the class that raises the
mutual information of neighbouring classes most. The ``SEEDED`` commonest words are
exchanged one at a time on the driver until none moves; from there, all common
words (at most ``HEAD``) are exchanged in sweeps: the classes before and after each
word are counted by the tasks, each word is taken out of its class and put into the one that
gains most, all words of a sweep at once, as in distributed word clustering. Before the first
sweep, words that have no class yet stand in bands of their counts. The sweeps end
when the mutual information of the whole corpus rises by less than ``GAIN``, or after ``SWEEPS``;
the best classes stay. All rarer words form one class, in which an unseen word has the
Good-Turing mass of the words seen once. Transitions are
smoothed towards class frequencies. The probabilities of all words seen and one
unseen word sum to one after every history.

The tables sent to executors have at most ``HEAD`` words; every rarer token is
looked up by a join with the whole table of counts, so no count is dropped.

Defined results: a null or empty text is the end token alone; a null doc_id
counts as the empty string in the choice of training documents; repeated rows
are scored and learnt from as rows of their own; without training tokens every
score is that of an empty model (0 for the words known, so V + 1 = 1); an empty
table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, low_words, partitions

FOLDS, HELD_OUT = 7, 2
#: Words whose counts go to executors, at most.
HEAD = 200_000
#: Words that are exchanged one at a time to begin with, sweeps over these, and classes.
SEEDED, SEED_SWEEPS, CLASSES = 800, 3, 64
#: Sweeps over all head words, and the least rise of mutual information (a share of it) for which another is made.
SWEEPS, GAIN = 2, 0.005
#: Weight of class frequencies in a transition, in tokens.
SMOOTH = 20.0
#: Distinct words that a task counts before it hands its counts on.
FLUSH = 250_000
END = b""


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def _rows(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if not held_out(doc):
                counts.update(low_words(text))
                counts[END] += 1
        if len(counts) > FLUSH:
            yield _rows(counts)
            counts = Counter()
    yield _rows(counts)


def _symbols(shared):
    """The symbols of each training text with the end after it; numbers of head words, then rare and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[bytes, int] = shared.value[0]
        get, rare = ids.get, len(ids)
        for batch in batches:
            parts = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not held_out(doc):
                    words = low_words(text)
                    parts.append(np.fromiter((get(w, rare) for w in words), np.int32, len(words)))
                    parts.append(np.array([rare + 1], np.int32))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts).tobytes()], pa.binary())], ["symbols"])

    return run


def _streams(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[np.ndarray]:
    """Symbols of many texts, each with the end before and after it."""
    for batch in batches:
        held = [np.frombuffer(x, np.int32) for x in batch.column("symbols").to_pylist()]
        yield np.concatenate([np.array([end], np.int32), *held])


def _pairs(shared):
    """How often a class stands after another, for classes of symbols sent to the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, size = shared.value
        seen = np.zeros(size * size, np.int64)
        for s in _streams(batches, len(of) - 1):
            c = of[s]
            seen += np.bincount(c[:-1] * size + c[1:], minlength=size * size)
        at = np.flatnonzero(seen)
        for i in range(0, len(at), 100_000):
            k = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(seen[k])], ["pair", "n"])

    return run


#: Classes after a word (their numbers) and before it (``total`` more), with counts.
ENTRY = np.dtype([("column", "<u2"), ("n", "<u8")])
NEAR = "word long, entries binary"


def _near_rows(words: np.ndarray, columns: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per word of entries sorted by word."""
    entries = np.empty(len(n), ENTRY)
    entries["column"], entries["n"] = columns, n
    start = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    for i in range(0, len(start), 20_000):
        here = start[i : i + 20_000]
        stop = start[i + 20_000] if i + 20_000 < len(start) else len(words)
        offsets = (np.r_[here, stop] - here[0]).astype(np.int32) * ENTRY.itemsize
        buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(entries[here[0] : stop].tobytes())]
        yield pa.RecordBatch.from_arrays([pa.array(words[here].astype(np.int64)), pa.BinaryArray.from_buffers(pa.binary(), len(here), buffers)], ["word", "entries"])


def _neighbours(shared):
    """Counts of the classes after and before each symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = shared.value
        seen = np.zeros(len(of) * 2 * total, np.int32)
        for s in _streams(batches, len(of) - 1):
            for i in range(0, len(s) - 1, 2_000_000):
                t = s[i : i + 2_000_001]
                c, base = of.take(t), t.astype(np.int64) * (2 * total)
                np.add.at(seen, base[:-1] + c[1:], 1)
                np.add.at(seen, base[1:] + total + c[:-1], 1)
        at = np.flatnonzero(seen)
        if len(at):
            yield from _near_rows(at // (2 * total), at % (2 * total), seen[at].astype(np.int64))

    return run


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, column and count of each entry of a batch."""
    held = batch.column("entries").to_pylist()
    e = np.frombuffer(b"".join(held), ENTRY)
    words = np.repeat(batch.column("word").to_numpy(), [len(x) // ENTRY.itemsize for x in held])
    return words, e["column"].astype(np.int64), e["n"].astype(np.int64)


def _added(total: int):
    """Entries of all tasks added up by word; a word's rows are in one task, and there are at most HEAD words in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def add_up() -> None:
            nonlocal keys, counts, size
            k, n = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(k, kind="stable")
            k, n = k[order], n[order]
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
            keys, counts, size = [k[start]], [np.add.reduceat(n, start) if len(k) else n], 0

        for batch in batches:
            words, columns, n = _entries(batch)
            keys.append(words * 2 * total + columns)
            counts.append(n)
            size += len(n)
            if size > 4_000_000:
                add_up()
        add_up()
        if len(keys[0]):
            yield from _near_rows(keys[0] // (2 * total), keys[0] % (2 * total), counts[0])

    return run


def _class_pairs(shared):
    """How often a class stands after another, from the classes after each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = shared.value
        seen = np.zeros(total * total, np.int64)
        for batch in batches:
            words, columns, n = _entries(batch)
            after = columns < total
            np.add.at(seen, of[words[after]] * total + columns[after], n[after])
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["pair", "n"])

    return run


def moved(word: np.ndarray, column: np.ndarray, count: np.ndarray, old: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Best of the first ``k`` classes for each word, taken out of its class ``old``; entries are sorted by word and number words from 0.

    Sums run over the classes next to a word only, as all other cells of ``n`` stay as they are.
    """
    total, words = len(n), len(old)
    gain = np.zeros((words, k))
    right, left = n.sum(axis=1), n.sum(axis=0)
    d = np.arange(k)
    for side, table, sums in ((0, n, right), (1, n.T, left)):
        here = (column >= total) == bool(side)
        w, c, x = word[here], column[here] - side * total, count[here].astype(np.float64)
        # What the word has with its own class, on the other side: taken out of the cells of that class.
        other = np.zeros((words, total))
        there = (column >= total) != bool(side)
        other[word[there], column[there] - (1 - side) * total] = count[there]
        for i in range(0, len(w), 20_000):
            wi, ci, xi = w[i : i + 20_000], c[i : i + 20_000], x[i : i + 20_000, None]
            cells = table[:k, ci].T.copy()  # (entry, class): what stands in the cell that the entry is added to
            own = d == old[wi][:, None]
            cells -= own * xi
            at_old = ci == old[wi]
            cells[at_old] -= other[wi[at_old]][:, :k]
            cells = np.maximum(cells, 0)
            np.add.at(gain, wi, _xlogx(cells + xi) - _xlogx(cells))
        size = np.bincount(w, x, words)[:, None]
        rest = np.maximum(sums[:k] - (d == old[:, None]) * size, 0)
        gain -= _xlogx(rest + size) - _xlogx(rest)
    return gain.argmax(axis=1)


def _moved(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n, k = shared.value
        for batch in batches:
            words, columns, counts = _entries(batch)
            names, number = np.unique(words, return_inverse=True)
            keep = names < len(of) - 2
            best = moved(number, columns, counts, of[names], n, k)
            yield pa.RecordBatch.from_arrays([pa.array(names[keep]), pa.array(best[keep].astype(np.int32))], ["word", "class"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, words: int, classes: int, sweeps: int) -> np.ndarray:
    """Class of every symbol. The first ``words`` symbols may move; each other one is a class of its own."""
    size = len(pairs)
    fixed = size - words
    k = min(classes, max(1, words))
    # The commonest words start in classes of their own, all others together.
    of = np.r_[np.minimum(np.arange(words), k - 1), k + np.arange(fixed)].astype(np.int64)
    total = k + fixed
    n = np.zeros((total, total))
    np.add.at(n, (of[:, None], of[None, :]), pairs)
    right, left = pairs.sum(axis=1), pairs.sum(axis=0)
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            old, self_ = of[w], pairs[w, w]
            to, frm = np.bincount(of, pairs[w], total), np.bincount(of, pairs[:, w], total)
            to[old] -= self_
            frm[old] -= self_
            n[old] -= to
            n[:, old] -= frm
            n[old, old] -= self_
            f = _xlogx(n)
            rows = (_xlogx(n[:k] + to) - f[:k]).sum(axis=1)
            cols = (_xlogx(n[:, :k] + frm[:, None]) - f[:, :k]).sum(axis=0)
            d = np.arange(k)
            diag = n[d, d]
            both = _xlogx(diag + to[:k] + frm[:k] + self_) - _xlogx(diag + to[:k]) - _xlogx(diag + frm[:k]) + _xlogx(diag)
            # Totals of the words in each class but w; what they share with w counts too.
            others = np.arange(size) != w
            nr, nl = (np.bincount(of[others], x[others], total)[:k] for x in (right, left))
            lost = _xlogx(nr + right[w]) - _xlogx(nr) + _xlogx(nl + left[w]) - _xlogx(nl)
            new = int((rows + cols + both - lost).argmax())
            of[w] = new
            n[new] += to
            n[:, new] += frm
            n[new, new] += self_
            moved += new != old
        if not moved:
            break
    return of


def information(n: np.ndarray) -> float:
    """Mutual information of neighbouring classes, times their number."""
    return float(_xlogx(n).sum() - _xlogx(n.sum(axis=1)).sum() - _xlogx(n.sum(axis=0)).sum() + _xlogx(np.array([n.sum()]))[0])


class Model:
    """Log10 probabilities: ``move`` of classes and ``emit`` of head words; the rare class is scored by count."""

    def __init__(self, head: list[tuple[bytes, int]], of: np.ndarray, n: np.ndarray, tokens: int, vocabulary: int, once: int):
        """``of``: the class of each head word in order, of the rare class and of the end; ``n``: counts of class pairs."""
        total = len(n)
        self.tokens, self.vocabulary = tokens, vocabulary
        freq = (n.sum(axis=0) + 1) / (n.sum() + total)
        move = (n + SMOOTH * freq) / (n.sum(axis=1, keepdims=True) + SMOOTH)
        self.move = np.log10(move)
        self.class_of = of
        words = [w for w, _ in head if w != END]
        counts = np.array([c for w, c in head if w != END] + [0], np.float64)
        self.ids = {w: i for i, w in enumerate(words)}
        class_n = np.bincount(of[:-2], counts[:-1], total)
        self.emit = np.r_[np.log10(counts[:-1] / class_n[of[:-2]]), 0.0]
        self.base = np.r_[np.log10((counts[:-1] + 1) / (tokens + vocabulary + 1)), 0.0]
        end = next((c for w, c in head if w == END), 0)
        self.end_base, self.end_known = float(np.log10((end + 1) / (tokens + vocabulary + 1))), int(end > 0)
        self.rare_tokens = tokens - sum(c for _, c in head)
        # Good-Turing, kept off 0 and 1 so that seen and unseen rare words both have a share.
        self.unseen = min(0.9, max(once, 1) / self.rare_tokens) if self.rare_tokens else 1.0


SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, word binary, n long"


def _score(shared):
    """A row per document with what the head words and transitions give, and a row per rare word of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value[0]
        get, other = m.ids.get, len(m.ids)
        end = m.class_of[-1]
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]

            def put(*row, cols=cols):
                for col, x in zip(cols, row):
                    col.append(x)

            for uid, doc, text in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "text"))):
                words = low_words(text)
                ids = np.fromiter((get(w, other) for w in words), np.int64, len(words))
                c = np.r_[end, m.class_of[ids], end]
                rare = np.flatnonzero(ids == other)
                score = m.move[c[:-1], c[1:]].sum() + m.emit[ids].sum()
                put(uid, doc, held_out(doc), len(words) + 1, len(words) - len(rare) + m.end_known, float(m.base[ids].sum()) + m.end_base, float(score), None, None)
                for w, n in Counter([words[i] for i in rare]).items():
                    put(uid, None, None, None, None, None, None, w, n)
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(cols, kinds)], [x.split()[0] for x in SCORED.split(", ")])

    return run


def _matrix(rows: DataFrame, size: int) -> np.ndarray:
    """A table of class pairs (pair, n) from all tasks, at most the square of the number of classes."""
    out = np.zeros(size * size)
    seen = rows.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out[seen.column("pair").to_numpy()] = seen.column("n").to_numpy()
    return out.reshape(size, size)


def classes(symbols: DataFrame, counts: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Class of each head word (``counts``, commonest first), of the rare class and of the end, and the counts of class pairs."""
    spark = symbols.sparkSession
    words, first = len(counts), min(SEEDED, len(counts))
    bands = np.unique(np.floor(np.log2(counts[first:])), return_inverse=True)[1] if words > first else np.zeros(0, np.int64)
    of = np.r_[np.arange(first), first + bands]
    size = int(of.max(initial=-1)) + 3
    of = np.r_[of, size - 2, size - 1].astype(np.int64)
    pairs = _matrix(symbols.mapInArrow(_pairs(spark.sparkContext.broadcast((of, size))), "pair long, n long"), size)
    of = np.unique(exchange(pairs, first, CLASSES, SEED_SWEEPS), return_inverse=True)[1][of]
    k = len(np.unique(of[:first]))
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for sweep in range(SWEEPS + 1):
        total = int(of.max()) + 1
        known = spark.sparkContext.broadcast((of, total))
        if sweep == SWEEPS and words:  # nothing moves any more
            n = _matrix(symbols.mapInArrow(_pairs(known), "pair long, n long"), total)
            value = information(n)
            return (of, n) if not best or value > best[0] else best[1:]
        tasks = symbols.mapInArrow(_neighbours(known), NEAR)
        near = scratch.save(tasks.repartition(partitions(spark), "word").mapInArrow(_added(total), NEAR))
        n = _matrix(near.mapInArrow(_class_pairs(known), "pair long, n long"), total)
        value = information(n)
        placed = sweep > 0 or words == first
        if placed and best and value <= best[0] * (1 + GAIN):
            if value > best[0]:
                best = value, of, n
            break
        if placed:
            best = value, of, n
        if not words:
            break
        found = near.mapInArrow(_moved(spark.sparkContext.broadcast((of, n, k))), "word long, class int").toArrow()
        new = of.copy()
        new[found.column("word").to_numpy()] = found.column("class").to_numpy()
        new[-2:] = k, k + 1
        scratch.free(near)
        # Classes that lost all their words go, lest they keep a share of every transition.
        of = np.unique(new, return_inverse=True)[1]
        k = int(of[:-2].max()) + 1
    return best[1:]


def lm_score(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lm_score")
    some = docs.select(F.col("doc_id").cast("long"), "text")
    counts = scratch.save(some.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # Words by the size of their count: how high a count must be for at most HEAD words to reach it.
    step = F.least(F.col("n"), F.lit(4096)) + F.when(F.col("n") > 4096, F.floor(F.log2("n") * 64)).otherwise(F.lit(0))
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens"), F.min("n").alias("n")).orderBy(F.col("step").desc()).collect()
    tokens, vocabulary = sum(r["tokens"] for r in sizes), sum(r["words"] for r in sizes)
    once = sum(r["words"] for r in sizes if r["n"] == 1)
    least, room = (1 << 62), HEAD
    for r in sizes:
        room -= r["words"]
        if room < 0:
            break
        least = r["n"]
    # Words seen once or twice are always rare: they tell how likely unseen words are.
    least = max(least, 3)
    found = counts.where((F.col("n") >= least) | (F.col("word") == F.lit(END))).toArrow()
    head = sorted(zip(found.column("word").to_pylist(), found.column("n").to_pylist()), key=lambda x: (-x[1], x[0]))
    ids = {w: i for i, w in enumerate(w for w, _ in head if w != END)}
    symbols = scratch.save(some.mapInArrow(_symbols(spark.sparkContext.broadcast([ids])), "symbols binary"))
    of, n = classes(symbols, np.array([c for w, c in head if w != END], np.float64), scratch)
    scratch.free(symbols)
    model = Model(head, of, n, tokens, vocabulary, once)
    sent = spark.sparkContext.broadcast([model])
    scored = scratch.save(some.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_score(sent), SCORED))
    rare = scored.where("word is not null").select("uid", "word", F.col("n").alias("times"))
    c = F.coalesce("n", F.lit(0))
    seen_log = F.log10(F.lit(1 - model.unseen if model.unseen < 1 else 1.0) * c / F.lit(float(max(1, model.rare_tokens))))
    own = rare.join(counts.where(F.col("n") < least), "word", "left").groupBy("uid").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(F.lit(0))).alias("rare_known"),
        F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(tokens + vocabulary + 1)))).alias("rare_base"),
        F.sum(F.col("times") * F.when(c > 0, seen_log).otherwise(F.log10(F.lit(model.unseen)))).alias("rare_score"),
    )
    zero = F.lit(0.0)
    return scored.where("word is null").join(own, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("rare_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", zero)).alias("score"),
    )
