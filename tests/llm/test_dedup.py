"""Near-dedup, line dedup and substring dedup against brute force."""

import hashlib
import itertools

import duckdb
import numpy as np
import pytest

from variantsets.llm import line_dedup, near_dedup, sql, substring_dedup
from variantsets.llm.components import components
from variantsets.llm.common import Scratch


def shingles(text, k):
    w = text.encode().lower().split() if text else []
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def classes(rows, k, percent):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, set()).add(shingles(t, k))
    least = {d: d for d in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            p, q = find(a), find(b)
            least[max(p, q)] = min(p, q)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_near_dedup(docs, corpus, k):
    got = near_dedup.near_dedup(docs, k).collect()
    want = classes(corpus, k, 80)
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = {(d, len(shingles(t, k))) for d, t in corpus}
    assert {(r["doc_id"], r["n_shingles"]) for r in got} == sizes


def test_near_dedup_family(spark):
    """A chain of edits: neighbours are alike, the ends are not; all lie in one class with blocks of any size."""
    w = [f"a{i}" for i in range(200)]
    rows = []
    for i in range(60):
        v = list(w)
        v[: 3 * i] = [f"b{j}" for j in range(3 * i)]
        rows.append((i, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in near_dedup.near_dedup(df, 4).collect()} == set(classes(rows, 4, 80).values())


def test_forest_blocks():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**60, 50).astype(np.int64)
    sets = [np.unique(np.r_[base[: 50 - i % 7], rng.integers(0, 2**60, i % 5)]) for i in range(30)]
    close = lambda x, y: 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y))
    whole = near_dedup.forest(sets, len(sets), 80)
    assert all(b < a for a, b in whole)
    linked = {i for i in range(30) if any(close(sets[i], sets[j]) for j in range(30) if i != j)}
    assert {i for p in whole for i in p} == linked
    parts = near_dedup.forest(sets, 12, 80)
    assert {i for p in parts for i in p} == {i for i in range(30) if any(close(sets[i], sets[j]) for j in range(30) if (i < 12) != (j < 12))}


def test_near_dedup_edges(empty, clashing, docs):
    assert near_dedup.near_dedup(empty).count() == 0
    as_ = lambda df: sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in near_dedup.near_dedup(df).collect())
    assert as_(clashing) == as_(docs)
    kept = near_dedup.keep_first(clashing)
    assert kept.columns == clashing.columns and kept.where("doc_id in (100, 101)").count() == 0


def test_components(spark):
    scratch = Scratch(spark, "test")
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(60, 50), (50, 55), (70, 71)], "a long, b long")
    got = dict(map(tuple, components(edges, scratch).collect()))
    assert got == {i: 0 for i in range(41)} | {50: 50, 55: 50, 60: 50, 70: 70, 71: 70}
    assert components(edges.limit(0), scratch).count() == 0


def lines_by_hand(rows, min_docs=3):
    key = lambda x: (lambda s: s.encode().lower() if len(s) >= 20 else None)(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if key(x):
                holders.setdefault(key(x), set()).add(-(1 << 63) if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        own = -(1 << 63) if d is None else d
        kept = [x for x in lines if not (key(x) and len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != own)]
        out.append((d or 0, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_line_dedup(docs, corpus, batches):
    got = sorted((r["doc_id"] or 0, r["__n_lines"], r["__n_dropped"], r["text"]) for r in line_dedup.line_dedup(docs, batches=batches).collect())
    assert got == lines_by_hand(corpus)
    assert sum(r[2] for r in got) >= 5


def test_line_dedup_sql(docs, corpus):
    rows = [(d, t) for d, t in dict((d, (d, t)) for d, t in corpus if d is not None).values()]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.execute(sql.LINE_DEDUP).fetchall())
    hand = sorted((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in lines_by_hand(rows))
    assert [tuple(r) for r in want] == hand


def test_line_dedup_edges(empty, clashing):
    assert line_dedup.line_dedup(empty).count() == 0
    cut = line_dedup.line_dedup(clashing)
    # The fixture has columns named as the two that are added.
    assert cut.columns == [*clashing.columns, "__n_lines_", "__n_dropped_"] and cut.count() == clashing.count()


def test_line_runs_take_further_batches(spark):
    """Runs that are kept take one batch after the other and then know what one pass over all rows finds; dropped runs leave no files."""
    import os

    line = "a line of more than twenty characters"
    scratch = Scratch(spark, "runs")
    runs = line_dedup.Runs(scratch, 3, 2)
    for ids in ([9, 8], [7], [5, 4, 3], [1]):
        rows = [(i, f"{line}\nsome other line that only document {i} has") for i in ids]
        line_dedup.add_batch(runs, spark.createDataFrame(rows, "doc_id long, text string"))
    found = {bytes(r["h"]): (r["n"], r["top"]) for r in runs.merged().collect()}
    assert found[line_dedup.line_key(line)][1] == 9 and found[line_dedup.line_key(line)][0] >= 3
    assert len(found) == 8 and sum(n >= 3 for n, _ in found.values()) == 1
    kept = [n for n in os.listdir(scratch.root.removeprefix("file://")) if n.startswith("line_run_")]
    assert len(kept) == 1


def test_keep_first_keeps_one_row(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (3, "x"), (3, "y"), (None, "x"), (None, "x"), (4, None), (4, None)]
    kept = near_dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 0, 1, 3, 4]


def test_substring_chain_against_brute_force():
    import random

    rng = random.Random(2)
    for _ in range(40):
        n = rng.randint(1, 12)
        pts = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(n)})
        x, y = [p[0] for p in pts], [p[1] for p in pts]
        best = [float(substring_dedup.K)] * len(pts)
        for i in range(len(pts)):
            for j in range(i):
                if x[j] < x[i] and y[j] < y[i]:
                    step, skipped = min(x[i] - x[j], y[i] - y[j]), x[i] - x[j] + y[i] - y[j]
                    best[i] = max(best[i], best[j] + substring_dedup.K - substring_dedup.GAP * max(0, skipped - 2 * substring_dedup.K) - max(0, substring_dedup.K - step))
        got = max(s for s, _ in substring_dedup.chain(x, y))
        assert got <= max(best) + 1e-9
        if all(b - a >= substring_dedup.K for v in (x, y) for a, b in itertools.pairwise(v)):
            assert got == pytest.approx(max(best))


def test_substring_dedup(spark, docs, empty, clashing):
    from .conftest import prose
    import random

    rng = random.Random(4)
    passage = prose(rng, 70).split()
    edited = list(passage)
    edited[30] = "changed"
    del edited[50]
    own = {k: prose(rng, 80) for k in range(4)}
    rows = [(0, f"{own[0]} {' '.join(passage)} {own[1]}"), (1, f"{own[2]} {' '.join(passage)}"), (2, f"{' '.join(edited)} {own[3]}"), (3, prose(rng, 200)), (4, " ".join(passage[:20]))]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} >= {(1, 0), (2, 0)} and {r["doc_id"] for r in got} == {1, 2}
    texts = dict(rows)
    for r in got:
        a = texts[r["doc_id"]].split()[r["start_word"] : r["end_word"]]
        b = texts[r["other_id"]].split()[r["other_start"] : r["other_end"]]
        assert a[0] == b[0] and a[-1] == b[-1] and 68 <= len(a) <= 72 and r["equal_words"] <= min(len(a), len(b)) and r["identity"] > 0.9
    assert substring_dedup.substring_dedup(empty).count() == 0
    # Which partner a copy is reported with depends on how rows are dealt, what is found does not.
    ids = lambda df: {d for r in substring_dedup.substring_dedup(df).collect() for d in (r["doc_id"], r["other_id"])}
    assert ids(clashing) == ids(docs) == ids(docs.repartition(7))
    found = ids(docs)
    assert {100, 101, 104, 200, -7, 2**60} <= found and not found & set(range(40))


def test_substring_dedup_goes_on_after_a_break(spark):
    """Passages in one order with other words between: all of them are found, each part that is equal enough."""
    new = iter(range(10**6))
    w = lambda n: [f"u{next(new)}" for _ in range(n)]
    one, two, head, copy, left, right = w(300), w(300), w(30), w(300), w(30), w(30)
    docs = [
        (0, one + w(100) + two),
        (1, one + w(200) + two),
        (2, head + w(60) + copy),
        (3, head + w(60) + copy),
        (4, w(60) + left + right + w(60)),
        (5, w(60) + left + w(13) + right + w(60)),
    ]
    got = substring_dedup.substring_dedup(spark.createDataFrame([(d, " ".join(x)) for d, x in docs], "doc_id long, text string")).collect()
    found = sorted((r["doc_id"], r["other_id"], r["start_word"], r["end_word"]) for r in got)
    assert found == [(1, 0, 0, 300), (1, 0, 500, 800), (3, 2, 0, 390), (5, 4, 60, 133)]
    assert all(r["identity"] >= substring_dedup.IDENTITY for r in got)


def test_substring_parts_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        pairs = list(zip(*(np.cumsum(1 + (rng.random(40) < 0.2) * rng.integers(0, 9, 40)).tolist() for _ in "ab")))
        good = set()
        for s, e in itertools.combinations_with_replacement(range(40), 2):
            d = [pairs[e][k] - pairs[s][k] + 1 for k in (0, 1)]
            if min(d) >= 10 and e - s + 1 >= 0.8 * max(d) - 1e-9:
                good.add((s, e))
        want = [(s, e) for s, e in good if not any(a <= s and e <= b and (a, b) != (s, e) for a, b in good)]
        assert substring_dedup.parts(pairs, 10, 0.8) == sorted(want)


def test_substring_dedup_of_common_phrases(spark):
    """A passage is found though smaller and larger documents hold each of its phrases, or most of it."""
    new = iter(range(10**6))
    w = lambda n: [f"u{next(new)}" for _ in range(n)]
    p, q = w(51), w(51)
    docs = [(1000 + i, w(40) + p + w(40)) for i in range(2)]
    docs += [(k + i, p[i : i + substring_dedup.K]) for k in (0, 2000) for i in range(52 - substring_dedup.K)]
    docs += [(5000, w(40) + q[:49] + w(40)), (7000, w(40) + q[2:] + w(40))] + [(6000 + i, w(40) + q + w(40)) for i in range(2)]
    got = substring_dedup.substring_dedup(spark.createDataFrame([(d, " ".join(x)) for d, x in docs], "doc_id long, text string")).collect()
    assert {(*sorted((r["doc_id"], r["other_id"])), r["start_word"], r["end_word"]) for r in got} == {(1000, 1001, 40, 91), (6000, 6001, 40, 91)}


def test_seeds_against_brute_force():
    """Runs of words lie in one text, equal ones have equal hashes, and every window's least one is chosen."""
    rng = np.random.default_rng(1)
    sizes = [0, 120, 3, 30, 70]
    w = rng.integers(0, 2**63, sum(sizes)).astype(np.uint64)
    w[60:112] = w[:52]
    doc = np.repeat(np.arange(5), sizes)
    for n in (substring_dedup.K, substring_dedup.LONG, substring_dedup.LEAST):
        h, whole = substring_dedup.runs_of(w, doc, n)
        assert len(h) == len(w) - n + 1 and whole.tolist() == [doc[i] == doc[i + n - 1] for i in range(len(h))]
        assert len(set(h.tolist())) == len(h) - (52 - n + 1) and (h[60 : 60 + 52 - n + 1] == h[: 52 - n + 1]).all()
        fits = doc[: len(h) - 6] == doc[n + 5 :]
        want = {i + int(h[i : i + 7].argmin()) for i in range(len(h) - 6) if fits[i]}
        assert np.unique(substring_dedup.least_at(h, fits, 7)[1]).tolist() == sorted(want)
    assert not len(substring_dedup.runs_of(w[:3], doc[:3], 4)[0])


def test_meeting_against_brute_force():
    """An occurrence meets the least document of its seed and, for short seeds, the one before."""
    rng = np.random.default_rng(6)
    rows = sorted({(int(rng.integers(5)), int(rng.integers(6)), int(rng.integers(30))) for _ in range(60)})
    want = set()
    for s, d, x in rows:
        docs = sorted({e for t, e, _ in rows if t == s})
        for other in {docs[0], docs[max(0, docs.index(d) - 1)] if s % 2 else docs[0]} - {d}:
            want.add((d, x, other, min(y for t, e, y in rows if (t, e) == (s, other))))
    seed, doc, pos = (np.array(c, np.int64) for c in zip(*rows))
    row, to, least = substring_dedup.meet(seed, doc, np.where(seed % 2, substring_dedup.K, substring_dedup.LONG))
    assert {(int(doc[i]), int(pos[i]), int(doc[j]), int(pos[j])) for i, j in zip(row, to)} == want
    assert {rows[i][:2] for i in least} == {(s, min(e for t, e, _ in rows if t == s)) for s, _, _ in rows}


def test_bridge_against_brute_force():
    import functools

    rng = np.random.default_rng(7)
    for _ in range(50):
        p, q = (rng.integers(0, 4, rng.integers(1, 9)) for _ in "ab")

        @functools.cache
        def most(i, j, p=p, q=q):
            if i == len(p) or j == len(q):
                return 0
            return max(most(i + 1, j), most(i, j + 1), (p[i] == q[j]) and 1 + most(i + 1, j + 1))

        path = substring_dedup.bridge(p, q)
        assert len(path) == most(0, 0) and all(p[i] == q[j] for i, j in path)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(path))


@pytest.mark.parametrize("gap", [0, 5, 12, 13, 30, 60, 90])
def test_substring_dedup_across_gaps(spark, gap):
    """A part before and a part after words put in between: the part after is found whatever the gap."""
    new = iter(range(10**6))
    w = lambda n: [f"u{next(new)}" for _ in range(n)]
    docs = []
    for k in range(40):
        p = w(20 + 3 * k + 55 + 2 * k)
        docs += [(2 * k, w(40) + p + w(40)), (2 * k + 1, w(30) + p[: 20 + 3 * k] + w(gap) + p[20 + 3 * k :] + w(30))]
    got = substring_dedup.substring_dedup(spark.createDataFrame([(d, " ".join(x)) for d, x in docs], "doc_id long, text string")).collect()
    found = set()
    for r in got:
        k = r["other_id"] // 2
        start, stop = 40 + 20 + 3 * k, 40 + 20 + 3 * k + 55 + 2 * k
        assert r["doc_id"] == r["other_id"] + 1
        if min(r["other_end"], stop) - max(r["other_start"], start) >= 55 + 2 * k - 2:
            found.add(k)
    assert len(found) == 40


def test_substring_dedup_of_edited_passages(spark):
    """Passages of 60 words with changed words: every fifth to every twentieth, evenly or at random places."""
    rng = np.random.default_rng(2)
    new = iter(range(10**6))
    w = lambda n: [f"u{next(new)}" for _ in range(n)]
    docs = []
    for k in range(80):
        p = w(60)
        every = (5, 8, 10, 20)[k % 4]
        at = range(every // 2, 60, every) if k % 8 < 4 else rng.choice(np.arange(1, 59), 60 // every, replace=False)
        edited = list(p)
        for i in at:
            edited[i] = next(iter(w(1)))
        docs += [(2 * k, w(50) + p + w(50)), (2 * k + 1, w(50) + edited + w(50))]
    got = substring_dedup.substring_dedup(spark.createDataFrame([(d, " ".join(x)) for d, x in docs], "doc_id long, text string")).collect()
    assert all(r["doc_id"] == r["other_id"] + 1 for r in got) and all(r["identity"] >= substring_dedup.IDENTITY for r in got)
    assert len({r["doc_id"] for r in got}) >= 72


def test_substring_dedup_of_crowded_seeds(spark):
    """An edited passage is found though many documents before and between hold parts of it: copies, inserted and deleted words."""
    new = iter(range(10**6))
    w = lambda n: [f"u{next(new)}" for _ in range(n)]
    docs, want = [], set()
    for k, shift in enumerate((0, 1, -1)):
        q = w(100)
        edited = list(q)
        for i in range(6, 100, 10):
            edited[i : i + 1] = w(1 + shift * (i % 20 == 6))
        base = 100_000 * k
        docs += [(base + z + i, q[i : i + 30]) for z in (0, 20_000) for i in range(0, 71, 2)]
        docs += [(base + z + i, edited[i : i + 30]) for z in (1000, 21_000) for i in range(0, 71, 2)]
        docs += [(base + 10_000, w(40) + q + w(40)), (base + 30_000, w(40) + edited + w(40))]
        want.add((base + 30_000, base + 10_000))
    got = substring_dedup.substring_dedup(spark.createDataFrame([(d, " ".join(x)) for d, x in docs], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} == want


def test_links_against_brute_force():
    """Links join the places that passages join, in one block and over two."""
    rng = np.random.default_rng(8)
    base = rng.integers(2, 2**16, (3, substring_dedup._WIDTH)).astype("<u2")
    rows = []
    for i in range(60):
        v = base[i % 3].copy()
        at = rng.choice(substring_dedup._WIDTH, int(rng.integers(0, 45)), replace=False)
        v[at] = rng.integers(2, 2**16, len(at))
        if i % 5 == 0:
            at = int(rng.integers(60, 90))
            v = np.r_[v[:at], v[at + 1 :], np.uint16(7)]
        v[substring_dedup.ASIDE : substring_dedup.ASIDE + substring_dedup.K] = 5
        rows.append(v)
    words, doc = np.array(rows, "<u2"), np.arange(60)

    def classes(pairs):
        least = list(range(60))
        for _ in range(60):
            for a, b in pairs:
                least[a] = least[b] = min(least[a], least[b])
        return least

    alike = [(a, b) for a in range(60) for b in range(a) if substring_dedup.straight(words[[a]], words[[b]])[0] or substring_dedup.aligned(words[a], words[b])]
    i, j, u, v = substring_dedup.links(words, doc, np.full(60, -1))
    assert set(zip(i.tolist(), j.tolist())) <= set(alike) and classes(zip(i.tolist(), j.tolist())) == classes(alike)
    assert all((words[a, p : p + substring_dedup.K] == words[b, q : q + substring_dedup.K]).all() for a, b, p, q in zip(i, j, u, v))
    assert 3 < len(set(classes(alike))) < 50
    found = []
    for x, y in ((0, 0), (0, 1), (1, 1)):
        k = np.flatnonzero((doc % 2 == x) | (doc % 2 == y))
        i, j, _, _ = substring_dedup.links(words[k], doc[k], np.full(len(k), -1) if x == y else doc[k] % 2)
        found += zip(k[i].tolist(), k[j].tolist())
    assert classes(found) == classes(alike)


def test_alignments_against_paths_of_single_pairs():
    """Pairs aligned at once are found as one by one, in a small part of the time."""
    import time

    S = substring_dedup
    rng = np.random.default_rng(10)
    some = rng.integers(2, 2**16, 30)
    p = some[rng.integers(0, 30, (1500, S._WIDTH))].astype("<u2")  # few words, so that any two rows have most in common
    q = p.copy()
    for k in range(len(q)):
        at = rng.choice(S._WIDTH, int(rng.integers(0, 60)), replace=False)
        q[k, at] = some[rng.integers(0, 30, len(at))]
        if k % 3 == 0:
            q[k, : S.ASIDE - 20] = q[k, 1 : S.ASIDE - 19]
        if k % 7 == 0:
            q[k, : int(rng.integers(0, S.ASIDE))] = 0
    p[:, S.ASIDE : S.ASIDE + S.K] = q[:, S.ASIDE : S.ASIDE + S.K] = 5
    began = time.process_time()
    to = S.alignments(p, q)
    took = time.process_time() - began
    began = time.process_time()
    for k in range(150):
        b = np.maximum(q[k], 1)
        left = S.bridge(p[k, : S.ASIDE], b[: S.ASIDE])
        right = [(S._WIDTH - 1 - i, S._WIDTH - 1 - j) for i, j in S.bridge(p[k, S.ASIDE + S.K :][::-1], b[S.ASIDE + S.K :][::-1])][::-1]
        pairs = left + [(S.ASIDE + t, S.ASIDE + t) for t in range(S.K)] + right
        good = S.parts(pairs, S.LEAST, S.IDENTITY)
        assert [(int(x), int(to[k, x])) for x in np.flatnonzero(to[k] >= 0)] == (pairs if good else [])
    assert took < time.process_time() - began
    assert 20 < (to[:150].max(axis=1) >= 0).sum() < 130


def test_links_of_many_seeds_are_those_of_each():
    S = substring_dedup
    rng = np.random.default_rng(11)
    words = rng.integers(2, 2**16, (90, S._WIDTH)).astype("<u2")
    for i in range(90):
        if i % 9:
            words[i] = words[i - i % 9]
            words[i, rng.choice(S._WIDTH, int(rng.integers(0, 30)), replace=False)] = 9
    words[:, S.ASIDE : S.ASIDE + S.K] = 5
    seed, doc, block = np.arange(90) // 30, np.arange(90) % 30, np.full(90, -1)
    want = set()
    for k in range(3):
        i, j, u, v = S.links(words[30 * k : 30 * k + 30], doc[:30], block[:30])
        want |= set(zip((i + 30 * k).tolist(), (j + 30 * k).tolist(), u.tolist(), v.tolist()))
    assert want and set(zip(*(c.tolist() for c in S.links(words, doc, block, seed)))) == want


def test_subsequence_against_brute_force():
    rng = np.random.default_rng(9)
    p, q = (rng.integers(0, 5, (40, 12)) for _ in "ab")
    got = substring_dedup.subsequence(p, q)
    for k in range(40):
        most = np.zeros((13, 13), int)
        for a, b in itertools.product(range(12), range(12)):
            most[a + 1, b + 1] = most[a, b] + 1 if p[k, a] == q[k, b] and p[k, a] else max(most[a, b + 1], most[a + 1, b])
        ends = [(a, b) for a, b in itertools.product(range(1, 13), repeat=2) if p[k, a - 1] == q[k, b - 1] and p[k, a - 1]]
        for found, words in zip(got, (lambda a, b: a + b, lambda a, b: a, lambda a, b: b)):
            want = [0] + [max([most[a, b] for a, b in ends if words(a, b) == n], default=-100) for n in range(1, found.shape[1])]
            assert found[k].tolist() == want


@pytest.mark.parametrize("kind", ["phrase", "repeated word"])
def test_links_of_many_places(kind):
    """Passages among many places that share a phrase, or lie in runs of one word, are found at a cost about in proportion to the places."""
    import time

    S = substring_dedup

    def places(n, rng):
        words = np.where(rng.random((n, S._WIDTH)) < 0.3, rng.integers(10, 60, (n, S._WIDTH)), rng.integers(60, 60_000, (n, S._WIDTH))).astype("<u2")
        words[:, S.ASIDE : S.ASIDE + S.K] = 5
        if kind == "phrase":
            words[:, S.ASIDE + S.K : S.ASIDE + 14] = np.arange(10) + 60_100
        else:
            left, run = rng.integers(0, 30, n), rng.integers(10, 41, n)
            at = np.arange(S._WIDTH)
            before, after = rng.integers(10, 60_000, (2, n, 1))
            words = np.where(at < (S.ASIDE - left)[:, None], before, np.where(at < (S.ASIDE - left + np.maximum(left + S.K, run))[:, None], 5, after)).astype("<u2")
        want = np.arange(50)
        words[want + n - 50] = words[want]
        words[want + n - 50, 0], words[want + n - 50, -1] = 3, 4  # edited
        return words, np.arange(n), np.full(n, -1), n, want

    took = []
    for n in (2000, 8000):
        words, doc, block, n, want = places(n, np.random.default_rng(12))
        began = time.process_time()
        i, j, _, _ = S.links(words, doc, block)
        took.append(time.process_time() - began)
        least = np.arange(n)
        for _ in range(3):
            for a, b in zip(i.tolist(), j.tolist()):
                least[a] = least[b] = min(least[a], least[b])
        assert (least[want + n - 50] == least[want]).all()
        assert len({*i.tolist(), *j.tolist()}) < n / 4
    assert took[1] < 9 * took[0]  # each with each: 16


def test_word_hashes_tell_words_apart():
    """Words of several texts are those of ``low_words``: equal ones have equal hashes, others have not, whatever their length."""
    import pyarrow as pa

    from variantsets.llm.common import low_words

    rng = np.random.default_rng(13)
    parts = [" ", "\t", "\n", "\x0b\x0c\r", "a", "A", "b", "É", "é", " ", "x" * 31, "Y" * 40, "0", "\0"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 30)))) for _ in range(300)] + [None, "", " ", "a", None]
    for got in (pa.array(texts), pa.array([*texts[:3], *texts]).slice(3)):
        w, n = substring_dedup.word_hashes(got)
        words = [low_words(t) for t in texts]
        assert n.tolist() == [len(x) for x in words]
        pairs = set(zip(w.tolist(), itertools.chain(*words)))
        assert len(pairs) == len({h for h, _ in pairs}) == len({x for _, x in pairs}) > 300
    assert [len(c) for c in substring_dedup.word_hashes(pa.array([], pa.string()))] == [0, 0]
    assert substring_dedup.word_hashes(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0]


@pytest.mark.parametrize("way", [1, 2, 3])
def test_links_by_each_way_are_the_same(way, monkeypatch):
    """Whatever way finds the pairs of places, they are joined alike."""
    S = substring_dedup
    rng = np.random.default_rng(14)
    words = rng.integers(2, 60, (150, S._WIDTH)).astype("<u2")
    for i in range(150):
        if i % 5:
            words[i] = words[i - i % 5]
            words[i, rng.choice(S._WIDTH, int(rng.integers(0, 40)), replace=False)] = rng.integers(2, 60)
    words[:, S.ASIDE : S.ASIDE + S.K] = 5
    doc, block, seed = np.arange(150) % 75, np.full(150, -1), np.arange(150) // 75

    def classes():
        i, j, _, _ = S.links(words, doc, block, seed)
        least = np.arange(150)
        for _ in range(150):
            for a, b in zip(i.tolist(), j.tolist()):
                least[a] = least[b] = min(least[a], least[b])
        return least.tolist()

    want = classes()
    none = (S._single_words, lambda h, there: there)  # dearer than any
    monkeypatch.setattr(S, "DEAR", -1)
    monkeypatch.setattr(S, "HELD", 20)
    monkeypatch.setattr(S, "PRODUCT", 1e12 if way == 3 else 1e-12)
    monkeypatch.setattr(S, "WAYS", tuple(S.WAYS[k] if k == way else none for k in range(3)))
    assert classes() == want and 20 < len(set(want)) < 120
