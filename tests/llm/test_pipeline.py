"""The pipeline's stages against brute force, each on its own input."""

import hashlib

import corpus_pipeline
import pytest
from conftest import SMALL

from tessera.llm import bpe, decontaminate


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = {"documents": spark.read.parquet(f"{SMALL}/documents.parquet")}
    docs = out["documents"]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SMALL).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_columns(stages):
    names = list(stages)
    assert all(stages[n].columns == stages["documents"].columns for n in names[:-1])
    assert len(corpus_pipeline.STAGES) == 5 and stages[names[-1]].count() > 100


def test_language_stage(spark, stages):
    want = {r.doc_id for r in stages["documents"].collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in stages["language_id"].collect()} == want


def test_dedup_stage(stages):
    from test_ops import brute_components, brute_fingerprint

    rows = sorted((r.doc_id, r.text) for r in stages["language_id"].collect())
    roots = brute_components([brute_fingerprint(t or "") for _, t in rows])
    assert {r.doc_id for r in stages["simhash_dedup"].collect()} == {rows[k][0] for k in set(roots)}


def test_decontamination_stage(spark, stages):
    """Against greedy tiling of every pair that could reach the coverage at all."""
    from test_ops import tile_brute

    items = [decontaminate.tokens(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before = {r.doc_id: decontaminate.tokens(r.text or "") for r in stages["simhash_dedup"].collect()}
    after = {r.doc_id for r in stages["benchmark_decontamination"].collect()}
    want = set()
    for i, words in before.items():
        have = {tuple(words[k : k + 4]) for k in range(len(words) - 3)}
        for item in items:
            starts = sum(tuple(item[k : k + 4]) in have for k in range(len(item) - 3))
            if 4 * starts >= 0.6 * len(item) > 0 and sum(n for _, _, n in tile_brute(item, words, 4)) >= 0.6 * len(item):
                want.add(i)
    assert want and after == before.keys() - want


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated and null ids, extra columns, and an empty table, through every stage."""
    from test_ops import ODD

    rows = [(i, t, g, s, len(t) if t else None, "x", 5, 1) for i, t, g, s in ODD]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, fp long, n_tokens int")
    for name, docs in (("rows", odd), ("none", odd.limit(0))):
        columns = docs.columns
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            f(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}/{stage}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/{stage}")
            assert docs.columns == columns or k == 4
        assert {"doc_id", "row", "fp", "ids_le", "n_tokens"} <= set(docs.columns) and docs.count() == (7 if name == "rows" else 0)


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SMALL).select("doc_id", "ids_sha256").collect()
    assert sorted(got) == sorted(stages["byte_bpe"].select("doc_id", "ids_sha256").collect())


def test_secret_stage(stages):
    from test_ops import brute_secrets

    before = {r.doc_id: r.text for r in stages["benchmark_decontamination"].collect()}
    for r in stages["secret_scan"].collect():
        assert not brute_secrets(r.text) and r.n_chars == len(r.text)
        assert ("<SECRET>" in r.text) == (r.text != before[r.doc_id])
        if not brute_secrets(before[r.doc_id]):
            assert r.text == before[r.doc_id]


def test_last_stage(stages):
    texts = {r.doc_id: r.text for r in stages["secret_scan"].collect()}
    tokens = bpe.public_ranks()[0].tokens
    rows = stages["byte_bpe"].collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = [int.from_bytes(r.ids_le[k : k + 4], "little") for k in range(0, len(r.ids_le), 4)]
        assert b"".join(tokens[i] for i in ids).decode() == texts[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(ids)
