"""Pipeline stages on odd rows, clashing names and empty tables."""
from collections import Counter

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
CLASHING = ("score", "ids", "n_tokens", "_shard", "n_lines", "row", "_keep", "_hash", "_maybe", "leaks")


def widened(docs):
    for k, name in enumerate(CLASHING):
        docs = docs.selectExpr("*", f"{k} as {name}")
    return docs


def test_stages_keep_rows_columns_and_names(spark, make, odd):
    docs = widened(make(odd))
    columns, left = docs.columns, docs.count()
    before = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.checkpointed(stage(spark, docs, SF))
        rows = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
        assert all(r[c] == k for r in rows for k, c in enumerate(CLASHING) if c not in ("ids", "n_tokens")), name
        assert len(rows) <= left or name == "source_mixing"
        if name in ("toxicity", "near_dedup"):
            assert not Counter((r["doc_id"], r["text"]) for r in rows) - before, name
        if name == "toxicity":
            assert {i for i, t in odd if not t} <= {r["doc_id"] for r in rows}                 # without a word nothing is toxic
        if name == "source_mixing":
            assert not [r["text"] for r in rows if not (r["text"] or "").split()]
        if name == "sentencepiece":
            assert all(len(r["ids"]) == r["n_tokens"] > 1 and r["ids"][-1] == 2 for r in rows)
        left, before = len(rows), Counter((r["doc_id"], r["text"]) for r in rows)
    assert left


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, make, stage):
    assert corpus_pipeline.checkpointed(stage(spark, make([]), SF)).count() == 0
