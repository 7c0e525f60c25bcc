"""No n-gram is left out of perplexity, however few workers hold."""

import numpy as np
import pytest
from test_ten_operators import BruteModel, texts_of

from tidemark.llm import perplexity


@pytest.fixture(scope="module")
def mixed(spark, docs, odd):
    """Texts of several scripts, copies, equal rows, nulls and a null key."""
    small = docs.select("doc_id", "text", "lang").where("length(text) < 2000").orderBy("doc_id").limit(60)
    extra = [(-1, "日本語のテキスト、日本語。", "ja"), (-2, "Привет, мир", None), (None, "zq xj " * 12, "en"), (None, "", "en")]
    copies = small.limit(5)
    return small.union(copies).union(copies.selectExpr("doc_id + 1000000", "text", "lang")).union(odd.where("length(text) < 200 or text is null").select("doc_id", "text", "lang")).union(spark.createDataFrame(extra, small.schema)).repartition(3).checkpoint()


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("most", [0, 40, 1000])
def test_rules_are_the_same_whatever_workers_hold(mixed, monkeypatch, most):
    want = told(perplexity.rules(mixed))
    monkeypatch.setattr(perplexity, "MOST", most)
    assert told(perplexity.rules(mixed)) == want and len(want) == mixed.count()


def test_perplexity_has_the_rare_n_grams(mixed, monkeypatch):
    monkeypatch.setattr(perplexity, "MOST", 40)
    brute = BruteModel([t for _, t in texts_of(mixed)])
    want = sorted(brute.log2_perplexity(t) for _, t in texts_of(mixed))
    got = sorted(r.log2_perplexity for r in perplexity.rules(mixed).collect())
    assert np.allclose(got, want, rtol=0, atol=1e-6)


def test_the_pipeline_keeps_the_same_documents_whatever_workers_hold(spark, mixed, monkeypatch):
    import corpus_pipeline

    want = told(corpus_pipeline.quality_rules(spark, mixed, ""))
    kept = [(r.doc_id,) for r in perplexity.rules(mixed).where("kept").collect()]
    monkeypatch.setattr(perplexity, "MOST", 40)
    got = corpus_pipeline.quality_rules(spark, mixed, "")
    assert got.columns == mixed.columns and told(got) == want
    assert told(got.select("doc_id")) == sorted(kept, key=repr)
