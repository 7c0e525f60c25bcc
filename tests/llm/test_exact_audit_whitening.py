"""Recipes, the filter audit and whitening against SQL, brute force and on odd inputs."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import interaction, queries, recipes, whitening

WHITE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_groups(rows):
    """(doc_id, keep_id, group_size, text_sha256) of each row, and for each text how many of its rows are kept (one)."""
    texts = {}
    for doc, text in rows:
        texts.setdefault(WHITE.sub("", text or ""), []).append((-len(text or ""), doc is None, doc or 0, doc))
    return sorted((str(m[3]), str(min(g)[3]), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in texts.items() for m in g)


def check_groups(df, bits=64):
    rows = recipes.groups(df, bits).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows) == brute_groups([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert set(kept.values()) <= {1} and set(kept) == {r.text_sha256 for r in rows}
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_recipes(spark, docs, odd, nothing):
    check_groups(docs)
    check_groups(odd)
    assert recipes.groups(nothing).count() == 0
    # of equal texts the longest stays, then the smallest doc_id, nulls last; large doc_ids beside nulls stay what they are
    big = (1 << 53) + 1
    df = spark.createDataFrame([(None, "a b"), (big, "a b"), (big + 2, "ab "), (7, "ab"), (8, "a b"), (9, "A B"), (5, ""), (4, " \n"), (3, None)], "doc_id bigint, text string")
    check_groups(df)
    found = {r.doc_id: (r.keep_id, r.kept) for r in recipes.groups(df).collect()}
    assert found[None] == found[7] == (big, False) and found[big] == (big, True) and found[5] == (4, False)


def test_recipes_of_chunks_whose_identifiers_clash(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh ijkl\n") for _ in range(rng.choice([10, 3000, 20000]))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts + texts[:7] + ["x" * 50000] * 3)), "doc_id bigint, text string").repartition(4)
    check_groups(df, bits=3)


def test_chunks_are_cut_by_content_and_give_the_text_back(spark):
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdefghij klmnopqrst") for _ in range(60000))
    rows = [(0, shared), (1, "another beginning " + shared), (2, "é日本😀 " * 4000), (3, ""), (4, None), (5, "aaaa" * 20000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = df.select("doc_id", recipes.normalised(df.text).alias("t")).select("*", recipes.chunked(F.col("t")).alias("c"))
    cut = cut.select("*", recipes.joined("c").alias("back")).collect()
    assert all(r.t == r.back and all(0 < len(c) <= recipes.MOST for c in r.c) for r in cut)
    a, b = (set(r.c) for r in cut[:2])
    assert len(a & b) > 0.9 * len(a)  # what was put before does not move the other cuts
    assert len({c for r in cut[5:] for c in r.c}) <= 2


def test_one_text_of_most_rows(spark):
    text = "the same text again " * 50
    df = spark.range(3000).selectExpr("id as doc_id", f"case when id % 3 = 0 then concat('{text}', repeat(' ', int(id % 7))) else concat('x', id) end as text")
    check_groups(df.repartition(6))


def failing(text, seen):
    words = WORD.findall(text)
    fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), seen]
    return {letter for letter, f in zip("ABCDE", fails) if f}


def brute_audit(docs, labels):
    """Every order replayed over the documents themselves."""
    smallest, marks, parts = {}, {}, {}
    for doc, text, _ in docs:
        if doc is not None:
            smallest[text or ""] = min(doc, smallest.get(text or "", doc))
    for doc, quality, toxic in labels:
        old = marks.get(doc, (False, False))
        marks[doc] = (old[0] or quality == 1, old[1] or toxic == 1)
    for doc, text, source in docs:
        later = doc is not None and smallest[text or ""] < doc
        parts.setdefault(source or "", []).append((failing(text or "", later), *(marks.get(doc, (False, False)) if doc is not None else (False, False))))
    out = {}
    for part, rows in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, own in enumerate(order, 1):
                gone = [r for r in left if own in r[0]]
                left = [r for r in left if own not in r[0]]
                shapley[own] += len(gone)
                redundant = sum(own in r[0] for r in rows) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(r[0] == {own} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return out


def check_audit(docs, labels):
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in interaction.audit(docs, labels).collect()}
    assert got == brute_audit([(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_audit(spark, docs, labels, odd, nothing):
    check_audit(docs, labels)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    check_audit(odd, none)
    assert interaction.audit(nothing, labels).count() == 0
    # labels twice, with nulls and of no document; a text under two doc_ids, under one twice in two parts, and under none
    marks = spark.createDataFrame([(1, 1, None), (1, 0, 1), (2, None, None), (None, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = [(1, "same", "a"), (1, "same", "b"), (2, "same", "b"), (None, "same", None), (None, "same", ""), (3, None, "a"), (2, "", "a"), (4, "x# " * 300, "a"), (5, "LOUD " * 10, "a")]
    check_audit(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3), marks)


def brute_whitening(x, most=8):
    n, s = len(x), x.sum(axis=0)
    off = (n * x - s) / n
    cov = off.T @ off / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return off @ v / np.sqrt(e), e / np.trace(cov), ((n * x - s) ** 2).sum(axis=1)


def check_whitening(df, x, ids, most=8):
    rows = sorted(map(tuple, whitening.whiten(df, most).collect()), key=lambda r: (ids.index(r[0]), r[1]))
    want, explained, deviation = brute_whitening(x, most)
    found = want.shape[1]
    assert [(r[0], r[1]) for r in rows] == [(i, k + 1) for i in ids for k in range(found)]
    got = np.array([r[4] for r in rows]).reshape(len(ids), found)
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * sign).max() < 1e-8
    assert [r[3] for r in rows[::found]] == deviation.tolist() and {r[2] for r in rows} == {len(x)}
    assert np.allclose([r[5] for r in rows[:found]], explained, rtol=1e-10) and {r[6] for r in rows}.pop() < 1e-9 and len({r[6] for r in rows}) == 1


def test_whitening(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x = np.floor(1024 * np.array([r.embedding for r in rows])).astype(np.int64) + 100_000
    check_whitening(df, x, [r.vec_id for r in rows])
    # the tree has several levels, and the result does not follow the partitions
    check_whitening(df.repartition(70), x, [r.vec_id for r in rows], 3)


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(50, 5)).tolist()
    bad = [None, [], [1.0, 2.0], [1.0, None, 2.0, 3.0, 4.0], [1.0, float("nan"), 0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0, 0.0], [1e300, 0.0, 0.0, 0.0, 0.0]]
    big = (1 << 53) + 1
    rows = [(big + 2 * k, v, 1.0) for k, v in enumerate(good)] + [(None, v, 2.0) for v in bad]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, whitened double").repartition(3)
    x = np.floor(1024 * np.array(good)).astype(np.int64) + 100_000
    check_whitening(df, x, [big + 2 * k for k in range(50)])
    assert whitening.whiten(df.where("whitened > 1")).count() == 0 and whitening.whiten(df.where("false")).count() == 0
    assert whitening.whiten(df.where(f"vec_id = {big}")).count() == 0  # one vector has no variance
    assert whitening.whiten(df.limit(0).unionByName(df.where("whitened = 1"))).count() == 250
    with_null = spark.createDataFrame([(None, good[0]), (1, good[1]), (1, good[1]), (None, good[2])], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(with_null).collect()
    assert len(got) == 4 * 2 and sum(r.vec_id is None for r in got) == 4


def test_deviations_that_a_long_cannot_hold():
    x = np.array([[0, 0], [1 << 40, 1 << 40]])
    assert whitening.deviations(x, 2, x.sum(axis=0).tolist()) == [None, None]
    x = np.array([[0], [3_037_000_499]])
    assert whitening.deviations(x, 2, x.sum(axis=0).tolist()) == [3_037_000_499**2] * 2


@pytest.mark.parametrize("name", ["op11_chunk_recipes", "op12_walsh_audit"])
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = con.execute(queries.ORACLE_SQL[name]).fetchdf()[list(got.columns)]
    key = list(got.columns[:3])
    assert got.sort_values(key).reset_index(drop=True).equals(want.sort_values(key).reset_index(drop=True))
