"""The pipeline, stage by stage, against plain versions."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from backscope.llm import mixing, neardup, quality, secrets

from .test_llm import DOCS, odd_documents, plain_spans, shingles, words


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.collect()]
    for _, stage in p.STAGES:
        df = stage(spark, docs, folder)
        out.append(df.collect())
        docs = spark.createDataFrame(out[-1], df.schema)
    return out


def test_quality_stage(spark, folder, stages):
    before, after = stages[0], stages[1]
    scored = quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    keep = {r.doc_id for r in scored if r.kept}
    assert sorted(after) == sorted(r for r in before if r.doc_id in keep)
    good = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").collect()}
    assert len(good & keep) >= 0.95 * len(good & {r.doc_id for r in before})


def test_duplicate_stage(stages):
    before, after = sorted(stages[1]), stages[2]
    sets = [shingles(r.text, 5) for r in before]
    label = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert sorted(after) == [r for i, r in enumerate(before) if label[i] == i]


def test_duplicate_stage_of_repeated_ids(spark):
    """Near copies under one id leave one row; blank ones of that id, and rows without id, stay."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text + " b", "x"), (1, text + " a", "x"), (1, text + " a", "x"), (1, "", "x"), (2, text, "x"), (3, "other words", "x"), (3, "more of them", "x"), (None, text + " c", "x"), (None, text + " d", "x"), (None, None, "x")]
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    got = Counter((r.doc_id, r.text) for r in p.single(spark, df, "").collect())
    assert got == Counter([(1, text + " a"), (1, ""), (3, "other words"), (3, "more of them"), (None, text + " c"), (None, text + " d"), (None, None)])


def test_secret_stage(stages):
    before, after = {r.doc_id: r for r in stages[2]}, stages[3]
    assert {r.doc_id for r in after} == set(before)
    for r in after:
        spans = plain_spans(before[r.doc_id].text)
        assert (r.text == before[r.doc_id].text) == (not spans) and r.n_chars == (len(r.text) if spans else before[r.doc_id].n_chars)
        assert not any(before[r.doc_id].text[a:b] in r.text for _, a, b in spans)


def test_mixing_stage(spark, stages):
    facts = mixing.mix(spark.createDataFrame(stages[3], DOCS)).collect()
    taken, told = Counter(), Counter()
    for r in stages[4]:
        taken[r.doc_id] += len(words(r.text))
        told[r.source] += len(words(r.text))
    assert {k: v for k, v in taken.items() if v} == {r.doc_id: r.taken for r in facts if r.taken}
    targets = {r.source: r.target for r in facts}
    assert all(abs(told[s] - t) <= 64 + 0.02 * t for s, t in targets.items())
    whole = {r.doc_id: words(r.text) for r in stages[3]}
    for r in stages[4]:
        w = words(r.text)
        assert any(whole[r.doc_id][i : i + len(w)] == w for i in range(len(whole[r.doc_id]) - len(w) + 1))


def test_token_stage_and_run(spark, folder, stages):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, tuple(t.encode(r.text, add_special_tokens=False).ids)) for r in stages[4])
    got = Counter((r.doc_id, tuple(np.frombuffer(r.token_ids, "<u4").tolist())) for r in stages[5])
    assert got == want
    run = Counter((r.doc_id, tuple(np.frombuffer(r.token_ids, "<u4").tolist())) for r in p.run(spark, folder).collect())
    assert run == want


def test_stages_take_odd_input(spark, folder):
    import random

    rows = odd_documents(random.Random(8))
    for docs in (spark.createDataFrame(rows, DOCS), spark.createDataFrame([], DOCS)):
        for name, stage in p.STAGES:
            out = stage(spark, docs, folder)
            assert name and out.count() >= 0
            if name != p.STAGES[-1][0]:
                assert out.columns == list(p.COLUMNS)
    assert neardup and secrets
