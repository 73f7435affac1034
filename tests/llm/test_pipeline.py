import corpus_pipeline as cp
from lodestone.llm import bpe, common
from lodestone.llm.tokens import tokenizer_path

from ..conftest import SMALL
from .fixtures import awkward, empty
from .test_near_dedup import brute


def test_stages_one_after_another(spark):
    docs = common.documents(spark, SMALL)
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        docs = common.materialize(stage(spark, docs, SMALL), name)
        seen[name] = docs
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "bpe"]
    assert all(seen[n].columns == columns for n in ("language_id", "line_dedup", "near_dedup", "mixing"))
    told = seen["language_id"].count()
    assert told >= 0.97 * common.documents(spark, SMALL).count() and seen["line_dedup"].count() == told
    before = [(r["doc_id"], r["text"]) for r in seen["line_dedup"].collect()]
    assert {r["doc_id"] for r in seen["near_dedup"].collect()} == {c for _, c in brute(before, 5).values()}
    assert {r["doc_id"] for r in seen["mixing"].collect()} <= {r["doc_id"] for r in seen["near_dedup"].collect()}
    texts = sorted((r["doc_id"], r["decoded"]) for r in bpe.decode(seen["bpe"], tokenizer_path()).collect())
    assert texts == sorted((r["doc_id"], r["text"]) for r in seen["mixing"].collect())
    assert cp.run(spark, SMALL).count() == seen["bpe"].count() == seen["mixing"].count()


def test_awkward_tables(spark):
    """Exact rows of each stage, with columns that clash with names the operators use."""
    docs = awkward(spark, extra=True)
    given = {(r["doc_id"], r["text"]): r for r in docs.collect()}
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        docs = common.materialize(stage(spark, docs, SMALL), name)
        seen[name] = docs.collect()
    for name in ("language_id", "line_dedup", "near_dedup", "mixing"):
        assert seen[name] and all(r.__fields__ == columns for r in seen[name]), name
        for r in seen[name]:
            was = given[r["doc_id"], r["text"]]  # no line is repeated across these texts, so none is changed
            assert r.asDict() | {"lang": None, "n_chars": 0} == was.asDict() | {"lang": None, "n_chars": 0} and r["lang"] == (was["lang"] or r["lang"]), name
    told = {r["doc_id"] for r in seen["language_id"]}
    assert not told & {3, 4, 5} and {1, 2} <= told
    assert sorted(r["doc_id"] or 0 for r in seen["line_dedup"]) == sorted(r["doc_id"] or 0 for r in seen["language_id"])
    assert {r["doc_id"] for r in seen["near_dedup"]} == told - {2}
    assert {r["doc_id"] for r in seen["mixing"]} <= told - {2} and len(seen["bpe"]) == len(seen["mixing"])
    docs = empty(spark)
    for name, stage in cp.STAGES:
        docs = common.materialize(stage(spark, docs, SMALL), name)
    assert docs.count() == 0
