"""Secret scans: a linear-chain conditional random field over tokens.

Tokens are maximal runs of non-blank characters, tagged B (a secret begins), I
(inside) or O. A token's score for a tag sums weights of its own shape, of the
two tokens before and the one after it, and of the whole file; tag transitions
have weights too. Weights are trained here by gradient ascent on the likelihood
of a bounded sample: at most ``WINDOWS`` windows of the corpus with and as many without
a secret by the base patterns, cut out of texts chosen by hash, and windows of the
latter kind into which made-up secrets or look-alikes are put (``secret_samples``), since
from the patterns alone a tagger learns no more than these. Decoding is by Viterbi over
every whole text.

Decoding is exact but skips plain stretches: where O beats the other tags by
more than transitions could ever return, the best path has O, so the chain is
cut there and only the stretches between are decoded.

Base patterns always report; spans of the tagger are added, where they overlap
these by their parts outside. Defined results: a null or empty text has no spans; repeated rows
give repeated results; an empty table gives an empty result (the tagger is then
trained on made-up windows alone); columns besides doc_id and text are not read, except
that masking keeps them.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .secret_samples import Maker

#: Base patterns, kind, least length of the reported part: fixed values.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones need not be matched
ASSIGN_CHARS, ACCESS_CHARS = 12, 18
KINDS = ("assign", "access", "hex", "crf")

#: Most windows of each sort that training takes from the corpus, and tokens on either side of a window's middle.
WINDOWS, SIDE = 1500, 6
#: Windows from one text, so that they come from many, and characters of a token that a window keeps.
PER_TEXT, CHARS = 2, 400
#: Made-up windows with a secret, and with a look-alike.
PLANTED, LOOK_ALIKES = 2000, 2000
ROUNDS, RATE, RIDGE, PLAIN = 180, 0.15, 1e-5, 8
MASK = "[SECRET]"

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
B, I, O = 0, 1, 2

_KEYWORD = re.compile(r"passw|passphrase|pwd|secret|token|api_?key|credential|bearer", re.I | re.A)
_NAMED = re.compile(_KEYWORD.pattern + "|auth|private|login|key|access", re.I | re.A)
_JOINS = {"is", "was", "=", ":", "->", "-", "now", "/"}
_PREFIX = re.compile(r"[A-Za-z]{2,8}(_[A-Za-z0-9]{1,5})?[_.-](?=[A-Za-z0-9._-]{12})")
_EDGE = "\"'`,;.()[]{}<>"


# --- base patterns ---------------------------------------------------------


def _hex_possible(text: bytes, table=np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))) -> bool:
    """A run of 16 holds a whole aligned block of 8."""
    ok = table[np.frombuffer(text, np.uint8)]
    n = len(ok) // 8 * 8
    return bool(ok[:n].reshape(-1, 8).all(axis=1).any())


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, start and end of the secret part), by start and kind; code points, ends exclusive."""
    out = []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    if b"passw" in low or b"secret" in low or b"token" in low or b"apikey" in low or b"api_key" in low:
        out += [(m.start(), 0, m.end(), m.start(2), m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_CHARS]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    if _hex_possible(raw):
        out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def show(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


# --- features --------------------------------------------------------------


def shape(body: str) -> list[int]:
    """Indices of the features of the shape of a token without its outer marks."""
    n = len(body)
    out = [0, 1 + min(5, n // 8)]
    plain = body.isalpha()
    if plain:
        out.append(20)
        if not body.isascii():
            out.append(23)
    if _NAMED.search(body) and _KEYWORD.search(body):
        out.append(19)
    if plain and n < 12:
        return out
    if not n:
        return [*out, 21]
    digits, upper, lower = (sum(map(f, body)) for f in (str.isdigit, str.isupper, str.islower))
    marks = n - digits - upper - lower
    if n >= 8:
        out.append(26 + min(3, 8 * (len(_STRETCH.findall(body)) - 1) // n))
        vowels = len(_VOWEL.findall(body))
        letters = upper + lower
        if letters >= 6:
            out.append(30 + (0 if 6 * vowels < letters else 1 if 4 * vowels < letters else 2))
        run = max(map(len, _LOWER_RUN.findall(body)), default=0)
        out.append(33 + (0 if run < 5 else 1 if run < 9 else 2))
    if n >= 12:
        out.append(14 + min(3, len(set(body)) // 6))
        if plain:
            out.append(25)
        elif _PREFIX.match(body):
            out.append(36)
    if plain:
        return out
    if digits:
        out.append(7 + min(2, 3 * digits // n))
    if upper and lower and digits:
        out.append(10)
    if digits and lower and not upper and not marks:
        out.append(11)
    if digits and upper and not lower and not marks:
        out.append(12)
    if n >= 12 and not marks and not body.strip("0123456789abcdefABCDEF"):
        out.append(13)
    if "=" in body or ":" in body:
        out.append(18)
    if "/" in body or "@" in body:
        out.append(22)
    if body.count(".") >= 2:
        out.append(24)
    if not upper and not lower:
        out.append(37)
    if body.count("-") >= 2:
        out.append(38)
    if "_" in body:
        out.append(39)
    if _URL.search(body):
        out.append(40 + ("@" in body))
    return out


_LOWER_RUN, _DIGIT, _VOWEL = re.compile(r"[a-z]+"), re.compile(r"\d"), re.compile(r"[aeiouyAEIOUY]")
#: Runs of one kind of character.
_STRETCH = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")
_URL = re.compile(r"://|^www\.")


def nearby(token: str, body: str) -> list[int]:
    """Indices of the features that a token, ``body`` without its outer marks, lends to its neighbours."""
    out = [0]
    if _NAMED.search(body):
        out.append(1 if _KEYWORD.search(body) else 7)
    if len(token) < 4 and token.lower() in _JOINS:
        out.append(8)
    if token == body and body.isalpha():
        return out
    if token and not body.strip("=:"):
        out.append(2)
    elif token[-1:] in ("=", ":"):
        out.append(3)
    if _DIGIT.search(body):
        out.append(4)
    if token[:1] in ("\"", "'"):
        out.append(5)
    if token[-1:] in (".", "!", "?"):
        out.append(6)
    if token[:5] == "-----" or token[-5:] == "-----":
        out.append(9)
    return out


def file_features(text: str, tokens: int) -> list[int]:
    low = text.lower()
    out = [0, 1 + min(2, int(math.log10(tokens + 1)))]
    if "password" in low or "token" in low or "secret" in low or "api_key" in low:
        out.append(4)
    return out


N_SHAPE, N_NEAR, N_FILE = 42, 10, 5


class Model:
    """Weights: own (shape), before1, before2, after (nearby), file, and move (from tag, to tag)."""

    PARTS = (("own", N_SHAPE), ("before1", N_NEAR), ("before2", N_NEAR), ("after", N_NEAR), ("file", N_FILE))

    def __init__(self):
        for name, n in self.PARTS:
            setattr(self, name, np.zeros((n, 3)))
        self.move = np.zeros((3, 3))

    def untrained(self) -> bool:
        return not self.own.any()


# --- training --------------------------------------------------------------


def tags_of(text: str, tokens: list[re.Match]) -> np.ndarray:
    """Tags by the base patterns: tokens that overlap the secret part of a span."""
    out = np.full(len(tokens), O, np.int8)
    spans = sorted((c, d) for _, _, _, c, d in base_spans(text))
    k = 0
    last = None
    for i, m in enumerate(tokens):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if k < len(spans) and spans[k][0] < m.end():
            out[i] = I if last == spans[k] else B
            last = spans[k]
        else:
            last = None
    return out


def _rows(indices: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros((len(indices), n))
    for row, k in zip(out, indices):
        row[k] = 1
    return out


WIDTH = 2 * SIDE + 1
#: The tokens of a window with the two before and the one after it, tags of the window, and features of its file.
WINDOW = "secret boolean, place long, tokens array<string>, tags array<int>, file array<int>"


def windows(text: str, most: int = PER_TEXT, seed: int = 0) -> list[tuple[bool, list[str], list[int], list[int]]]:
    """At most ``most`` windows of a text with a secret and as many without, at places chosen by ``seed``."""
    tokens = list(TOKEN.finditer(text))
    if len(tokens) < WIDTH:
        return []
    tags = tags_of(text, tokens)
    words = [""] * 2 + [m[0] for m in tokens] + [""]
    like = {i for i, w in enumerate(words[2:-1]) if tags[i] != O or len(w) >= 12 or _KEYWORD.search(w)}
    rng = random.Random(seed)
    first = sorted(like)
    rng.shuffle(first)
    file = file_features(text, len(tokens))
    out, some, taken = [], {True: 0, False: 0}, set()
    for i in first + [rng.randrange(len(tokens)) for _ in range(most)]:
        start = max(0, min(i - SIDE, len(tokens) - WIDTH))
        secret = bool((tags[start : start + WIDTH] != O).any())
        # One place in two for plain tokens, so that look-alikes do not take all.
        if some[secret] >= (most if secret or i not in like else max(1, most // 2)) or any(abs(start - t) < WIDTH for t in taken):
            continue
        some[secret] += 1
        taken.add(start)
        out.append((secret, [w[:CHARS] for w in words[start : start + WIDTH + 3]], tags[start : start + WIDTH].tolist(), file))
    return out


def planted(plain: list[tuple], secrets: int = PLANTED, look_alikes: int = LOOK_ALIKES, seed: int = 1, unseen: bool = False) -> list[tuple]:
    """Windows into whose middle a made-up secret or look-alike is put in place of as many tokens."""
    rng = random.Random(seed)
    maker = Maker(rng, unseen)
    out = []
    for k in range(secrets + look_alikes):
        if plain:
            _, words, _, file = plain[rng.randrange(len(plain))]
        else:
            words, file = [maker.word(1, 3) for _ in range(WIDTH + 3)], [0, 2]
        put = maker.secret() if k < secrets else maker.innocent()
        at = rng.randint(0, max(0, WIDTH - len(put)))
        put = put[: WIDTH - at]
        words, tags = list(words), [O] * WIDTH
        words[2 + at : 2 + at + len(put)] = [w for w, _ in put]
        tags[at : at + len(put)] = [t for _, t in put]
        if k < secrets or not base_spans(" ".join(words)):
            out.append((k < secrets, words, tags, file))
    return out


def _design(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Design rows (window, place, feature) and tags."""
    xs, cache = [], {}

    def of(w: str) -> tuple[np.ndarray, np.ndarray]:
        if w not in cache:
            body = w.strip(_EDGE)
            cache[w] = _rows([nearby(w, body)], N_NEAR)[0], _rows([shape(body)], N_SHAPE)[0]
        return cache[w]

    for _, words, _, file in rows:
        pairs = [of(w) for w in words]
        near, own = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        files = np.broadcast_to(_rows([file], N_FILE), (WIDTH, N_FILE))
        xs.append(np.hstack([own[2 : WIDTH + 2], near[1 : WIDTH + 1], near[:WIDTH], near[3 : WIDTH + 3], files]).astype(np.float32))
    return np.stack(xs), np.array([tags for _, _, tags, _ in rows], np.int64)


def train(sampled: list[tuple]) -> Model:
    """Maximum likelihood with a ridge, by Adam on sampled and made-up windows; the gradient by forward-backward."""
    model = Model()
    rows = sampled + planted([w for w in sampled if not w[0]])
    x, y = _design(rows)
    n, width, dim = x.shape
    hot = np.eye(3)[y]
    # Windows without secrets weigh PLAIN times as much together as those with: a false alarm spoils a clean text.
    secret = (y != O).any(axis=1)
    weight = np.where(secret, n / max(1, secret.sum()), PLAIN * n / max(1, (~secret).sum())) / (1 + PLAIN)
    w, move = np.zeros((dim, 3)), np.zeros((3, 3))
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, move)]
    flat = x.reshape(-1, dim)
    seen_moves = np.einsum("n,nti,ntj->ij", weight, hot[:, :-1], hot[:, 1:]) / n
    for k in range(1, ROUNDS + 1):
        e = (flat @ w.astype(np.float32)).astype(np.float64).reshape(n, width, 3)
        emit, step = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(move)
        # Forward and backward shares, each place scaled to one.
        fwd, bwd = np.empty_like(e), np.ones_like(e)
        fwd[:, 0] = emit[:, 0]
        for t in range(1, width):
            f = (fwd[:, t - 1] @ step) * emit[:, t]
            fwd[:, t] = f / f.sum(axis=1, keepdims=True)
        gm = seen_moves - RIDGE * move
        for t in range(width - 1, 0, -1):
            ahead = emit[:, t] * bwd[:, t]
            back = ahead @ step.T
            gm -= step * ((fwd[:, t - 1] * (weight / (fwd[:, t - 1] * back).sum(axis=1))[:, None]).T @ ahead) / n
            bwd[:, t - 1] = back / back.sum(axis=1, keepdims=True)
        p = fwd * bwd
        p /= p.sum(axis=2, keepdims=True)
        gw = flat.T @ ((hot - p) * weight[:, None, None]).reshape(-1, 3).astype(np.float32) / n - RIDGE * w
        for v, g, (mean, square) in zip((w, move), (gw, gm), moments):
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            v += RATE * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    at = 0
    for name, k in Model.PARTS:
        setattr(model, name, w[at : at + k].copy())
        at += k
    model.move = move
    return model


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(secret, place, words, tags, file) for place, text in zip(*(batch.column(c).to_pylist() for c in ("place", "text"))) for secret, words, tags, file in windows(text, seed=place)]
        kinds = [pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in WINDOW.split(", ")])


def sample(docs: DataFrame, limit: int = WINDOWS) -> list[tuple]:
    """At most ``limit`` windows with a secret and as many without, of texts by least hash; no more than that leave a task."""
    text = F.col("text")
    worded = text.contains("AKIA") | text.contains("password") | text.contains("token") | text.contains("secret") | text.contains("api_key")
    some = docs.where(text.isNotNull()).select("text", worded.alias("worded"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)).alias("place"))
    # Rows that repeat share a place and count once.
    sizes = {r["worded"]: r["n"] for r in some.groupBy("worded").agg(F.approx_count_distinct("place").alias("n")).collect()}
    cut = lambda kind: int(min(1.0, 1.2 * limit / max(1, sizes.get(kind, 0))) * (1 << 32))
    chosen = some.where(F.col("place") < F.when(F.col("worded"), F.lit(cut(True))).otherwise(F.lit(cut(False)))).select("place", "text")
    cuts = chosen.mapInArrow(_cut, WINDOW).distinct()
    out = []
    for kind in (True, False):
        rows = cuts.where(F.col("secret") == kind).orderBy("place", "tokens").limit(limit).collect()
        out += [(r["secret"], r["tokens"], r["tags"], r["file"]) for r in rows]
    return out


# --- decoding --------------------------------------------------------------


def viterbi(e: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best tags of one chain with scores ``e`` (place, tag). Chains are short, so plain numbers are faster than arrays."""
    rows, back = e.tolist(), []
    (bb, bi, bo), (ib, ii, io), (ob, oi, oo) = move.tolist()
    x, y, z = rows[0]
    for p, q, r in rows[1:]:
        best, whence = [], []
        for a, b, c in ((x + bb, y + ib, z + ob), (x + bi, y + ii, z + oi), (x + bo, y + io, z + oo)):
            k = 0 if a >= b and a >= c else 1 if b >= c else 2
            whence.append(k)
            best.append((a, b, c)[k])
        back.append(whence)
        x, y, z = best[0] + p, best[1] + q, best[2] + r
    last = 0 if x >= y and x >= z else 1 if y >= z else 2
    out = [last]
    for whence in reversed(back):
        last = whence[last]
        out.append(last)
    return np.array(out[::-1], np.int8)


class Tagger:
    """Viterbi tags of whole texts with a cache of the scores that a token gives itself and its neighbours."""

    CACHE = 400_000

    def __init__(self, model: Model):
        self.model = model
        m = model.move
        # What transitions through another tag can return over those through O, at most.
        self.edge = max(m[a, s] + m[s, b] - m[a, O] - m[O, b] for a in range(3) for b in range(3) for s in (B, I))
        self.ends = max(0.0, max(max(m[a, s] - m[a, O], m[s, a] - m[O, a]) for a in range(3) for s in (B, I)))
        self.kinds: dict[tuple, int] = {}  # tokens of equal features share a row; there are few such rows
        self.rows: list[np.ndarray] = []
        self.ids: dict[str, int] = {}
        self._learn([""])

    def _learn(self, words: list[str]) -> None:
        m, known = self.model, len(self.rows)
        for w in words:
            body = w.strip(_EDGE)
            own, near = shape(body), nearby(w, body)
            key = (*own, -1, *near)
            row = self.kinds.get(key)
            if row is None:
                row = self.kinds[key] = len(self.rows)
                self.rows.append(np.stack([m.own[own].sum(axis=0), m.before1[near].sum(axis=0), m.before2[near].sum(axis=0), m.after[near].sum(axis=0)]))
            self.ids[w] = row
        if len(self.rows) > known:
            self.table = np.stack(self.rows)

    def scores(self, words: list[str], file: list[int]) -> np.ndarray:
        if len(self.ids) > self.CACHE:
            self.ids.clear()
        new = set(words).difference(self.ids)
        if new:
            self._learn(list(new))
        g = self.table[np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))]
        e = g[:, 0] + self.model.file[file].sum(axis=0)
        e[1:] += g[:-1, 1]
        e[2:] += g[:-2, 2]
        e[:-1] += g[1:, 3]
        return e

    def tag(self, e: np.ndarray) -> np.ndarray:
        out = np.full(len(e), O, np.int8)
        open_ = np.maximum(e[:, B], e[:, I]) + max(self.edge, self.ends) >= e[:, O]
        at = np.flatnonzero(open_)
        if not len(at):
            return out
        breaks = np.flatnonzero(np.diff(at) > 1)
        starts, stops = at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]]
        for a, b in zip(starts, stops):
            lo, hi = max(0, a - 1), min(len(e), b + 2)
            chain = e[lo:hi].copy()
            if lo < a:  # known to be O
                chain[0, :2] = -1e9
            if hi > b + 1:
                chain[-1, :2] = -1e9
            out[lo:hi] = viterbi(chain, self.model.move)
        return out

    def spans(self, text: str) -> list[tuple[int, int, int, int, int]]:
        words = text.split() if text.isascii() else TOKEN.findall(text)
        if text.isascii() and any(c in text for c in "\x1c\x1d\x1e\x1f"):
            words = TOKEN.findall(text)
        if not words:
            return []
        e = self.scores(words, file_features(text, len(words)))
        tags = self.tag(e)
        if (tags == O).all():
            return []
        tokens = list(TOKEN.finditer(text))
        out, i = [], 0
        while i < len(tags):
            if tags[i] == O:
                i += 1
                continue
            j = i + 1
            while j < len(tags) and tags[j] == I:
                j += 1
            a, b = tokens[i].start(), tokens[j - 1].end()
            while a < b and text[a] in _EDGE:
                a += 1
            while a < b and text[b - 1] in _EDGE:
                b -= 1
            if a < b:
                out.append((a, 3, b, a, b))
            i = j
        return out


def all_spans(text: str, tagger: Tagger | None) -> tuple[list, list]:
    """The base spans, and all spans by start and kind."""
    base = base_spans(text)
    added = tagger.spans(text) if tagger else []
    return base, sorted(base + [x for s in added for x in outside(text, s, base)])


def outside(text: str, span: tuple, base: list[tuple]) -> list[tuple]:
    """The parts of a tagger's span that no base span covers, without outer marks; what a key word's name begins with is no part."""
    if all(span[2] <= x[0] or span[0] >= x[2] for x in base):
        return [span]
    out, at, cover = [], span[0], []
    for x in base:
        a = x[0]
        while x[1] == 0 and a > span[0] and text[a - 1] not in " \t\n\x0b\x0c\r":
            a -= 1
        cover.append((a, x[2]))
    for b, e in [*sorted(cover), (span[2], span[2])]:
        start, stop = at, min(b, span[2])
        at = max(at, e)
        while start < stop and not text[start].isalnum():
            start += 1
        while start < stop and not text[stop - 1].isalnum():
            stop -= 1
        if start < stop:
            out.append((start, 3, stop, start, stop))
    return out


def mask_text(text: str, spans: list[tuple]) -> str:
    """The secret part of every span replaced; parts that overlap are replaced together."""
    out, at = [], 0
    for a, b in sorted((s[3], s[4]) for s in spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], MASK]
        at = b
    return "".join(out) + text[at:]


SCAN = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scanner(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = None if model.untrained() else Tagger(model)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text in batch.column("text").to_pylist():
                base, spans = all_spans(text or "", tagger)
                kinds = [s[1] for s in base]
                row = (*(kinds.count(k) for k in range(3)), hashlib.sha256(show(base).encode()).hexdigest(), show(spans))
                for col, x in zip(cols, row):
                    col.append(x)
            kinds_ = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64())] + [pa.array(c, k) for c, k in zip(cols, kinds_)], [c.split()[0] for c in SCAN.split(", ")])

    return run


def _masker(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = None if model.untrained() else Tagger(model)
        for batch in batches:
            texts = [None if t is None else mask_text(t, all_spans(t, tagger)[1]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return run


def secret_scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row per document: counts and digest of the base spans, and all spans."""
    some = docs.select(F.col("doc_id").cast("long"), "text")
    return some.mapInArrow(_scanner(model or train(sample(some))), SCAN)


def mask_secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with the secret parts of all spans masked in the text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_masker(model or train(sample(docs.select("doc_id", "text")))), schema)
