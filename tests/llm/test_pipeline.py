"""The pipeline stage by stage against brute force, and the registered queries."""

import os
import re
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from variantsets.llm import packing, queries, secrets

from .conftest import frame
from .test_dedup import classes, lines_by_hand
from .test_scans import base_by_hand

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, corpus, tmp_path_factory):
    """Each stage's rows, as the runner does it: written, and read again by the next one."""
    d = tmp_path_factory.mktemp("sf")
    frame(spark, corpus).write.parquet(str(d / "documents.parquet"))
    docs, out = spark.read.parquet(str(d / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, str(d))
        result.write.parquet(str(d / f"stage{k}"))
        docs = spark.read.parquet(str(d / f"stage{k}"))
        out.append(docs)
    return out, str(d)


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def test_stages(spark, stages, corpus):
    (good, cut, unique, masked, packed), d = stages
    assert all(x.columns == ["doc_id", "text", "lang", "source"] for x in (good, cut, unique, masked))

    def passes(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        c = Counter(win)
        return len(w) >= 10 and 100 * len({p for i, g in enumerate(win) if c[g] > 1 for p in range(i, i + 5)}) <= 20 * len(w)

    kept = rows(good)
    by_base = [(i, t) for i, t in corpus if passes(t)]
    assert set(kept) <= set(by_base) and {r for r in by_base if r[0] is not None and r[0] < 400} <= set(kept)

    lines = lines_by_hand(kept)
    assert sorted((i or 0, t) for i, t in rows(cut)) == [(i, t) for i, _, _, t in lines]

    want = classes(rows(cut), 5, 80)
    assert rows(unique) == [r for r in rows(cut) if r[0] is None or want[r[0]] == r[0]]

    before = dict(rows(unique))
    model = secrets.train(secrets.sample(unique))
    tagger = None if model.untrained() else secrets.Tagger(model)
    for i, t in rows(masked):
        spans = secrets.all_spans(before[i], tagger)
        assert [(a, k, b) for a, k, b, *_ in spans[0]] == base_by_hand(before[i]) and t == secrets.mask_text(before[i], spans[1])

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    tokens = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows(masked)}
    total = Counter()
    for r in packed.collect():
        total[r["doc_id"]] += r["length"]
        assert r["doc_tokens"] == tokens[r["doc_id"]]
    assert dict(total) == tokens

    # run() is the stages one after the other.
    again = corpus_pipeline.run(spark, d)
    key = lambda df: sorted((r["doc_id"] or 0, r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(again) == key(packed)


def test_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op2_line_dedup", "op5_license_scan", "op10_quality_rules"])
def test_query_covers_the_table(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r[0] for r in queries.queries()[name](spark, SF).select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
