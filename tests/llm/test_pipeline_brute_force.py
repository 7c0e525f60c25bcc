"""The classifier against its definition, and every stage of the pipeline against a plain version of it."""

import math
import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from test_ten_operators import LOWER, WORD, BruteModel, base_spans, brute_counts, brute_terms

from tidemark.llm import quality, statistics
from tidemark.llm.queries import tokenizer_path


def profile(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return statistics.profile(data, np.array([0, len(data)]))[0]


def brute_scores(rows, labels):
    """{doc_id: probability} by densities of two normal laws, from rows (doc_id, text) and {doc_id: quality}."""
    x = {d: profile(t) for d, t in rows}
    train = [d for d in x if d in labels and zlib.crc32(str(d).encode()) % 3 != 1]
    a = np.array([x[d] for d in train])
    y = np.array([labels[d] for d in train])
    centre, scale = a.mean(axis=0), np.sqrt(np.maximum(a.var(axis=0), 1e-12))
    z = lambda v: quality.BOUND * np.tanh((v - centre) / scale / quality.BOUND)
    own = [np.cov(z(a[y == c]).T, bias=True) for c in (0, 1)]
    pooled = sum(np.mean(y == c) * own[c] for c in (0, 1))
    logs = []
    for c in (0, 1):
        mixed = (1 - quality.POOLED) * own[c] + quality.POOLED * pooled
        mixed = (1 - quality.ROUND) * mixed + quality.ROUND * (np.trace(mixed) / len(mixed) + 1e-6) * np.eye(len(mixed))
        mean, inverse, size = z(a[y == c]).mean(axis=0), np.linalg.inv(mixed), np.linalg.slogdet(mixed)[1]
        logs.append({d: math.log(np.mean(y == c)) - size / 2 - (z(v) - mean) @ inverse @ (z(v) - mean) / 2 for d, v in x.items()})
    return {d: 1 / (1 + math.exp(min(700, max(-700, logs[0][d] - logs[1][d])))) for d in x}


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_scores_are_those_of_the_definition(docs, labels):
    rows, marks = list(texts(docs).items()), {r.doc_id: r.quality for r in labels.collect()}
    want = brute_scores(rows, marks)
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert set(got) == set(want) and max(abs(got[d] - want[d]) for d in got) < 1e-9


@pytest.fixture(scope="module")
def small(spark, docs):
    """Short documents, with near copies, nulls and personal data beside them."""
    some = docs.where("length(text) < 2500").orderBy("doc_id").limit(90)
    first = [r for r in some.orderBy("doc_id").limit(12).collect()]
    near = [(r.doc_id + 100_000, (r.text or "") + " one more word at the end", r.lang, r.source, r.n_chars) for r in first if len((r.text or "").split()) > 60]
    more = [(200_001, None, "en", None, 0), (200_002, "", None, "s", 0), (200_003, "write to nobody@example.org about it " * 6, "en", "s", 1)]
    return some.unionByName(spark.createDataFrame(near + more, docs.schema)).repartition(3).checkpoint()


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def test_classifier_stage(spark, sf, small):
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    want = brute_scores(list(texts(small).items()), marks)
    got = texts(corpus_pipeline.quality_classifier(spark, small, sf))
    assert got == {d: t for d, t in texts(small).items() if want[d] >= 0.5}


def test_rules_stage(spark, sf, small):
    rows = {r.doc_id: r for r in small.collect()}
    model = BruteModel([r.text or "" for r in rows.values()])
    steps, told = defaultdict(list), {}
    for d, r in rows.items():
        n, _, _, _, again = brute_counts(r.text or "")
        told[d] = (model.log2_perplexity(r.text or ""), n < 10 or 100 * again > 20 * n, n, len("".join(WORD.findall(r.text or ""))))
        if n >= 10:
            steps[r.lang].append(math.floor(told[d][0] * 256 + 0.5))
    middle = lambda v: sorted(v)[(len(v) + 1) // 2 - 1]
    sure, near = set(), set()
    for d, (bits, failed, n, chars) in told.items():
        if failed or rows[d].lang not in steps:
            continue
        m = middle(steps[rows[d].lang])
        reach = max(middle([abs(x - m) for x in steps[rows[d].lang]]) / 256 * 1.4826 * 3.5, 0.1) + 1 / math.sqrt(chars + 1)
        off = abs(bits - m / 256) - reach
        (near if abs(off) < 0.01 else sure if off < 0 else set()).add(d)
    got = texts(corpus_pipeline.quality_rules(spark, small, sf))
    assert sure <= set(got) <= sure | near and all(got[d] == rows[d].text for d in got)


def test_near_duplicates_stage(spark, sf, small):
    rows = list(texts(small).items())
    words = {d: WORD.findall((t or "").translate(LOWER)) for d, t in rows}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for d, w in words.items()}
    first = {d: d for d in sets}

    def root(d):
        while first[d] != d:
            d = first[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                first[y] = x
    got = texts(corpus_pipeline.near_duplicates(spark, small, sf))
    assert set(got) == {d for d in sets if root(d) == d} and len(got) < len(rows) and all(got[d] == t for d, t in rows if d in got)


def test_personal_data_stage(spark, sf, small):
    rows = [(d, t or "") for d, t in texts(small).items()]
    kinds = brute_terms(rows)
    marks = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
    got = texts(corpus_pipeline.personal_data(spark, small, sf))
    for d, t in rows:
        spans = [(int(a), int(b), marks[k]) for k, a, b in (x.split(":") for x in base_spans(t))]
        found = [(m.start(), m.end(), kinds[m[0].lower()]) for m in re.finditer(r"[^\W_]+", t) if m[0].lower() in kinds]
        spans += [(a, b, "[TERM]" if k == 4 else "") for a, b, k in found if not any(x < b and a < y for x, y, _ in spans)]
        out, at = "", 0
        for a, b, mark in sorted(spans):
            if a >= at:
                out += t[at:a] + mark
            at = max(at, b)
        assert (got[d] or "") == out + t[at:]


def test_sequences_stage(spark, sf, small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    pieces = defaultdict(list)
    for r in corpus_pipeline.sequences(spark, small, sf).collect():
        pieces[r.doc_id].append(r)
    for d, text in texts(small).items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces.pop(d), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces


def test_run_is_stage_after_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
    told = lambda df: sorted((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert told(corpus_pipeline.run(spark, sf)) == told(corpus_pipeline.sequences(spark, docs, sf))


def test_stages_of_odd_and_of_no_documents(spark, sf, odd, nothing):
    base = odd.withColumnsRenamed({"score": "spans"}).selectExpr("*", "1 as `_row`", "2 as more", "3 as quality", "4 as held")
    for name, stage in corpus_pipeline.STAGES:
        for df in (base, base.where("false")):
            got = stage(spark, df, sf)
            assert got.columns == df.columns or name == "sequences"
            got.collect()
