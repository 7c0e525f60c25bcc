"""Without a window no pair of an entity and a word that one text holds goes unjudged."""

import math
import random
import re
from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_ten_operators import base_spans, brute_terms

from tidemark.llm import sanitising

WORDS = re.compile(r"[^\W_]+")


def brute_whole(rows):
    """{term: kind} of all words of all documents that hold an entity, straight from the definition."""
    words, held = [set(map(str.lower, WORDS.findall(t))) for _, t in rows], defaultdict(set)
    for i, (_, t) in enumerate(rows):
        for _, a, b in (x.split(":") for x in base_spans(t)):
            held[t[int(a) : int(b)].lower()].add(i)
    kinds = {}
    for at in held.values():
        prior = len(at) / len(rows)
        for t in set.union(*(words[i] for i in at)):
            both = [i for i in at if t in words[i]]
            more = 0 if len({rows[i][1] for i in both}) >= 3 else 1
            ratio = math.log((len(both) + more * prior) / (sum(t in w for w in words) + more) / prior) / -math.log(prior)
            if ratio >= 0.85:
                kinds[t] = max(kinds.get(t, 4), 5 if ratio >= 0.97 else 4)
    return kinds


@pytest.fixture(scope="module")
def rows():
    """Long texts with addresses that one text, its copies, two or many texts hold, some with two of them, and rare words anywhere."""
    random.seed(11)
    common, texts = [f"word{i}" for i in range(60)], []
    for i in range(220):
        text = random.choices(common, k=40)
        for _ in range(2):
            text.insert(random.randrange(len(text)), f"rare{random.randrange(90)}")
        if i % 4 == 0:
            text.insert(random.randrange(len(text)), f"p{i % 20}@mail.org")
        if i % 9 == 0:
            text[3:3] = [f"Own{i}@x.net"]
            text.append(f"far{i}")
        if i % 18 == 0:
            text.insert(30, f"second{i}@x.net")
        if i % 30 == 0:
            text.append("both@y.org")
        texts.append(" ".join(text))
    return list(enumerate(texts + texts[9:40:9] + texts[9:10] * 2))


def told(spark, rows, near):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return {r.hash: r.kind for r in sanitising.disclosing(df, near).collect()}


def hashed(spark, kinds):
    df = spark.createDataFrame(list(kinds.items()), "term string, kind int")
    return {r.hash: r.kind for r in df.select(F.xxhash64("term").alias("hash"), "kind").collect()}


def test_all_words_are_judged_without_a_window(spark, rows):
    sanitising.prepare(spark)
    whole, windowed = brute_whole(rows), brute_terms(rows)
    assert set(windowed) < set(whole) and "far9" in whole and "far9" not in windowed
    want = hashed(spark, whole)
    assert told(spark, rows, None) == want
    # one entity of a text stands for the others; a window wider than any text takes each by itself
    assert told(spark, rows, 1000) == want
    assert told(spark, rows, sanitising.NEAR) == hashed(spark, windowed)


def test_the_pipeline_can_take_out_words_beyond_the_window(spark):
    rows = [(0, f"call bob@x.com{' fare' * 20} zanzibarian"), (1, "plain zanzibarian fare"), (2, None)] + [(i, f"plain words fare {i % 9} call") for i in range(3, 1600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {near: {r.doc_id: r.text for r in corpus_pipeline.personal_data(spark, df, "", near).collect()} for near in (sanitising.NEAR, None)}
    assert got[sanitising.NEAR][0] == f"call [EMAIL]{' fare' * 20} zanzibarian" and all(got[sanitising.NEAR][d] == t for d, t in rows[1:])
    assert got[None][0] == f"call [EMAIL]{' fare' * 20} [TERM]" and got[None][1] == "plain [TERM] fare" and all(got[None][d] == t for d, t in rows[2:])
