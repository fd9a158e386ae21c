"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text with a blank in front is cut where no piece of the vocabulary reaches
across: between runs of letters, digits and other marks (blanks before a run belong
to it). So the piece lattice falls into chunks that are independent of each other;
a vocabulary that has a piece across such a place is cut before blanks only.
Within a chunk, forward filtering sums the weights of all segmentations that end
at each place; backward sampling then draws the last piece, the one before it, and
so on. A chunk's draw uses one uniform number, made from the row's key, the seed
and the chunk's place, spread over the steps as in arithmetic decoding. A row's
segmentation therefore depends on its key and text only, not on partitions, and the
outcomes of a chunk are intervals of [0, 1): for chunks that occur often they are
listed once and looked up, which draws what the backward steps would. The other
chunks of a batch are filtered and sampled together, as arrays over a trie.

The vocabulary file orders pieces by merge rank and holds no probabilities; a
piece of rank r weighs 1 / (r + 2) ** ``alpha``. A character that no piece covers
is spelled by its bytes. No normalisation is applied, so decoding gives back the
very text.

Defined results: a null text gives null ids, an empty text an empty list; rows
without doc_id share the key of a null; repeated rows get the same ids; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, count, pairwise, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

VOCABULARY = "piece_bpe_32k.model"
ALPHA, SEED = 1.0, 1
#: A chunk is listed when a task has met it so often, if it has at most so many segmentations.
LISTED = {24: 64, 200: 512}
#: Chunks that a task counts, and lists.
COUNTED, CACHE = 500_000, 60_000
#: Longest piece of the trie, longest chunk and last character that are sampled as arrays.
REACH, LONG, LAST = 16, 32, 0x17F
BLANK = "▁"

BLANKS = re.compile(r"\n| *[^ \n]+| +")
RUNS = re.compile(r"\n| *[^\W\d_]+| *\d| *(?:[^\w \n]|_)+| +|.", re.S)


class Pieces:
    """Weights, ids and texts of the pieces of a vocabulary file."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.weight: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.starts: set[str] = set()
        self.bytes: list[int] = [0] * 256
        self.text: list[bytes] = [b""] * model.get_piece_size()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(piece[1:-1], 16)
                self.bytes[b], self.text[i] = i, bytes([b])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain = piece.replace(BLANK, " ")
                self.id[plain], self.text[i] = i, plain.encode()
                self.weight[plain] = (2.0 - model.get_score(i)) ** -alpha if model.get_score(i) > -1e8 else (2.0 + i) ** -alpha
                self.starts.update(plain[:k] for k in range(1, len(plain) + 1))
        across = any(len(RUNS.findall(p)) > 1 for p in self.id)
        self.chunk = BLANKS if across else RUNS


class Trie:
    """Pieces of plain characters as a table, and the lattices of many short chunks as arrays."""

    def __init__(self, pieces: Pieces):
        plain = [p for p in pieces.id if len(p) <= REACH and all(ord(c) <= LAST for c in p)]
        letters = sorted({p for p in plain if len(p) == 1})
        self.symbol = np.full(LAST + 1, -1, np.int64)
        self.symbol[[ord(c) for c in letters]] = np.arange(len(letters))
        self.cannot = re.compile("[^" + re.escape("".join(letters)) + "]")
        plain = [p for p in plain if not self.cannot.search(p)]
        node = {"": 0}
        for p in plain:
            for k in range(1, len(p) + 1):
                node.setdefault(p[:k], len(node))
        self.next = np.zeros((len(node), len(letters)), np.int32)
        self.piece = np.full(len(node), -1, np.int32)
        self.weight = np.zeros(len(node))
        for p, k in node.items():
            if p:
                self.next[node[p[:-1]], self.symbol[ord(p[-1])]] = k
        for p in plain:
            self.piece[node[p]], self.weight[node[p]] = pieces.id[p], pieces.weight[p]

    def draw(self, chunks: list[str], which: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of chunks[which], one after the other, and how many each has."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        code = self.symbol[np.frombuffer("".join(chunks).encode("utf-16-le"), "<u2")]
        ends = np.cumsum(size)
        chunk = np.repeat(np.arange(len(chunks)), size)
        # A chunk of n characters has n + 1 places; the place after a character is its index plus its chunk's plus 1.
        start = np.arange(len(code))
        stop, node = ends[chunk], np.zeros(len(code), np.int64)
        shift, hits = chunk + 1, []
        for n in range(REACH):
            live = start + n < stop
            start, stop, node, shift = start[live], stop[live], node[live], shift[live]
            node = self.next[node, code[start + n]]
            live = node > 0
            start, stop, node, shift = start[live], stop[live], node[live], shift[live]
            if not len(start):
                break
            hit = self.piece[node] >= 0
            if hit.any():
                hits.append((n, start[hit] + n + shift[hit], node[hit]))
        reach = hits[-1][0] + 1
        places = len(code) + len(chunks)
        # First weights of the pieces that end at a place, then running sums of their shares; the longest piece comes first, as its start does.
        sums, piece = np.zeros((places, reach)), np.zeros((places, reach), np.int32)
        for n, at, node in hits:
            sums[at, reach - 1 - n], piece[at, reach - 1 - n] = self.weight[node], self.piece[node]
        back = np.arange(reach, 0, -1)
        total = np.zeros(places)
        first = ends - size + np.arange(len(chunks))
        total[first] = 1.0
        order = np.argsort(-size, kind="stable")
        longest = size[order]
        for k in range(1, int(longest[0]) + 1):
            at = first[order[: np.searchsorted(-longest, -k, "right")]] + k
            some = slice(max(0, reach - k), reach)  # no piece that ends here is longer
            share = np.cumsum(total[at[:, None] - back[some]] * sums[at, some], axis=1)
            sums[at, some] = share
            total[at] = share[:, -1]
        at, who, first = (first + size)[which], np.arange(len(which)), first[which]
        owners, drawn = [], []
        while len(at):
            upto = sums[at]
            x = u * upto[:, -1]
            pick = np.minimum((upto <= x[:, None]).sum(axis=1), reach - 1)
            row = np.arange(len(at))
            below = np.where(pick > 0, upto[row, pick - 1], 0.0)
            u = np.clip((x - below) / (upto[row, pick] - below), 0.0, 0.9999999999999999)
            owners.append(who)
            drawn.append(piece[at, pick])
            at = at - back[pick]
            live = at > first[who]
            at, who, u = at[live], who[live], u[live]
        owner, last_first = np.concatenate(owners), np.concatenate(drawn)
        return last_first[::-1][np.argsort(owner[::-1], kind="stable")], np.bincount(owner, minlength=len(which))


class Lattice:
    """Forward sums of a chunk: for each place, the pieces that end there with their shares."""

    def __init__(self, chunk: str, pieces: Pieces):
        n = len(chunk)
        weight, starts = pieces.weight, pieces.starts
        into: list[list[tuple[int, str, float]]] = [[] for _ in range(n + 1)]
        alpha = [0.0] * (n + 1)
        alpha[0] = 1.0
        # Where sums run low, those that a piece can reach from here are scaled together; shares of one place stay.
        for i in range(n):
            a = alpha[i]
            if i and not into[i]:
                continue
            if a < 1e-200:
                for k in range(i, min(n, i + 64) + 1):
                    alpha[k] *= 1e200
                    into[k] = [(s, t, w * 1e200) for s, t, w in into[k]]
                a = alpha[i]
            covered = False
            for j in range(i + 1, n + 1):
                part = chunk[i:j]
                if part not in starts:
                    break
                w = weight.get(part)
                if w is not None:
                    into[j].append((i, part, a * w))
                    alpha[j] += a * w
                    covered = covered or j == i + 1
            if not covered:
                into[i + 1].append((i, chunk[i], a * 1e-9))
                alpha[i + 1] += a * 1e-9
        self.into, self.n = into, n

    def draw(self, u: float) -> list[str]:
        """Backward sampling with one uniform number."""
        out, at = [], self.n
        while at:
            steps = self.into[at]
            if len(steps) > 1:
                total = sum(s[2] for s in steps)
                x, acc = u * total, 0.0
                for start, part, w in steps:
                    if x < acc + w:
                        break
                    acc += w
                u = min(max((x - acc) / w, 0.0), 0.9999999999999999)
            else:
                start, part, _ = steps[0]
            out.append(part)
            at = start
        return out[::-1]

    def outcomes(self, most: int) -> list[tuple[float, list[str]]] | None:
        """All segmentations with their shares, in the order of u; None where there are more than ``most``."""
        out: list[tuple[float, list[str]]] = []
        totals = [sum([s[2] for s in steps]) for steps in self.into]
        stack: list[tuple[int, float, list[str]]] = [(self.n, 1.0, [])]
        while stack:
            at, p, tail = stack.pop()
            if not at:
                out.append((p, tail[::-1]))
                if len(out) > most:
                    return None
                continue
            steps = self.into[at]
            total = totals[at]
            stack += [(start, p * w / total, [*tail, part]) for start, part, w in reversed(steps)]
        return out


class Encoder:
    """Sampled ids of the texts of a batch."""

    def __init__(self, path: str, alpha: float, seed: int):
        self.pieces, self.seed = Pieces(path, alpha), seed
        self.trie = Trie(self.pieces)
        self.met: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}  # listed chunks
        self.upto, self.first, self.size, self.ids = array("d"), array("q"), array("q"), array("i")

    def spell(self, parts: list[str]) -> list[int]:
        try:
            return [*map(self.pieces.id.__getitem__, parts)]
        except KeyError:
            out = []
        for p in parts:
            i = self.pieces.id.get(p)
            if i is None:
                out += [self.pieces.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(i)
        return out

    def enlist(self, chunk: str, outcomes: list[tuple[float, list[str]]]) -> None:
        k, acc = len(self.at), 0.0
        self.at[chunk] = k
        for p, parts in outcomes:
            acc += p
            ids = self.spell(parts)
            self.upto.append(k + min(acc, 1.0))
            self.first.append(len(self.ids))
            self.size.append(len(ids))
            self.ids.extend(ids)
        self.upto[-1] = k + 1.0

    def count(self, chunks: list[str], times: np.ndarray) -> None:
        """Lists the chunks that have come often."""
        met = self.met
        had = np.fromiter(map(met.get, chunks, repeat(0)), np.int64, len(chunks))
        have = had + times
        met.update(zip(chunks, have.tolist()))
        for i in np.flatnonzero(have >= min(LISTED)).tolist():
            c, before, n = chunks[i], int(had[i]), int(have[i])
            for least, most in LISTED.items():
                if before < least <= n and len(c) <= LONG and c not in self.at and len(self.at) < CACHE:
                    found = Lattice(c, self.pieces).outcomes(most)
                    if found:
                        self.enlist(c, found)
        if len(met) > COUNTED:
            met.clear()
        if len(self.at) >= CACHE:
            self.clear()

    def uniform(self, key, n: int) -> np.ndarray:
        base = np.uint64(xxhash.xxh3_64_intdigest(f"{self.seed}:{key}"))
        return (mix64(base + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) * 2.0**-53

    def sample(self, chunks: list[str], which: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of chunks[which]."""
        cannot = self.trie.cannot.search
        plain = np.fromiter((len(c) <= LONG and not cannot(c) for c in chunks), bool, len(chunks))
        if plain.all():
            return self.trie.draw(chunks, which, u)
        can = plain[which]
        size = np.zeros(len(which), np.int64)
        odd = [self.spell(Lattice(chunks[k], self.pieces).draw(x)) for k, x in zip(which[~can].tolist(), u[~can].tolist())]
        size[~can] = [len(x) for x in odd]
        ids = np.zeros(0, np.int32)
        if can.any():
            place = np.cumsum(plain) - 1
            ids, size[can] = self.trie.draw([c for c, ok in zip(chunks, plain) if ok], place[which[can]], u[can])
        out = np.empty(int(size.sum()), np.int32)
        mask = np.repeat(can, size)
        out[mask], out[~mask] = ids, [i for x in odd for i in x]
        return out, size

    def __call__(self, keys: list, texts: list[str]) -> list[np.ndarray]:
        split = [self.pieces.chunk.findall(" " + t) if t else [] for t in texts]
        chunks = [c for s in split for c in s]
        if not chunks:
            return [np.zeros(0, np.int32) for _ in texts]
        u = np.concatenate([self.uniform(k, len(s)) for k, s in zip(keys, split)])
        which = np.fromiter(map(self.at.get, chunks, repeat(-1)), np.int64, len(chunks))
        known = which >= 0
        first, size = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        if known.any():
            row = np.searchsorted(np.frombuffer(self.upto, np.float64), which[known] + u[known], "right")
            first[known], size[known] = np.frombuffer(self.first, np.int64)[row], np.frombuffer(self.size, np.int64)[row]
        sampled = np.zeros(0, np.int32)
        others = list(compress(chunks, (~known).tolist()))
        rare = dict(zip(dict.fromkeys(others), count()))
        of = np.fromiter(map(rare.__getitem__, others), np.int64, len(others))
        if rare:
            sampled, size[~known] = self.sample(list(rare), of, u[~known])
        ends = np.cumsum(size)
        out = np.empty(int(ends[-1]), np.int32)
        mask = np.repeat(known, size)
        out[~mask] = sampled
        if known.any():
            place = np.repeat(first - (ends - size), size) + np.arange(len(out))
            out[mask] = np.frombuffer(self.ids, np.int32)[place[mask]]
        self.count(list(rare), np.bincount(of, minlength=len(rare)))
        stops = np.r_[0, ends][np.cumsum([len(s) for s in split])]
        return np.split(out, stops[:-1])


@lru_cache(maxsize=1)
def encoder(path: str, alpha: float, seed: int) -> Encoder:
    """One encoder for all tasks of a worker, so that what it has listed stays."""
    return Encoder(path, alpha, seed)


def _encode(path: str, alpha: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, alpha, seed)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = encode(batch.column("doc_id").to_pylist(), [t or "" for t in texts])
            ids = [None if t is None else x for t, x in zip(texts, ids)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), _lists(ids)], ["doc_id", "ids"])

    return run


def _lists(ids: list[np.ndarray | None]) -> pa.Array:
    sizes = [0 if x is None else len(x) for x in ids]
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), mask=np.array([x is None for x in ids] + [False]))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *[x for x in ids if x is not None]])))


def decode_ids(ids: np.ndarray | list[int], pieces: Pieces) -> str:
    """The text that was encoded; the blank put in front goes."""
    return b"".join(map(pieces.text.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


@lru_cache(maxsize=1)
def read_pieces(path: str) -> Pieces:
    """The pieces for all tasks of a worker."""
    return Pieces(path)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = read_pieces(path)
        for batch in batches:
            col = batch.column("ids")
            flat, offsets = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            null = col.is_null().to_pylist()
            texts = [None if x else decode_ids(flat[a:b].tolist(), pieces) for x, (a, b) in zip(null, pairwise(offsets))]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in [*batch.schema.names, "text"]], [*batch.schema.names, "text"])

    return run


def encode(docs: DataFrame, path: str | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id and the sampled piece ids of each text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode(path or public_tokenizers.path(VOCABULARY), alpha, seed), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds the text of ids."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path or public_tokenizers.path(VOCABULARY)), "doc_id long, ids array<int>, text string")
