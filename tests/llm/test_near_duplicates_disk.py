"""What near-duplicates put on disk: texts that stay and groups that lie in others aren't sent."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import jaccard


def written(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(e.totalShuffleWrite() for e in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))


def test_texts_that_stay_are_not_shuffled(spark, tmp_path):
    rng = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 60))
    texts = [" ".join(word() for _ in range(120)) for _ in range(300)]
    near = texts[7].rsplit(" ", 1)[0] + " other"
    spark.createDataFrame([*enumerate(texts), (300, texts[5]), (301, near), (4, texts[4]), (None, texts[9]), (None, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/d")
    before = written(spark)
    rows = jaccard.representatives(spark.read.parquet(f"{tmp_path}/d"), 5, 80).collect()
    assert written(spark) - before < 0.5 * sum(map(len, texts))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in rows if r.text) == list(enumerate(texts)) and len(rows) == 301


def test_uncovered_keeps_every_pair_of_nodes(spark):
    rng = np.random.default_rng(1)
    groups = {g: set(rng.integers(0, 60, rng.integers(2, 12)).tolist()) for g in range(80)}
    groups |= {100: {0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14}, 101: {1, 2, 3}, 102: {1, 2, 3}, 103: {70, 71}, 104: {70, 71}}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "pivot bigint, node bigint")
    left: dict = {}
    for r in jaccard.uncovered(df, "pivot").collect():
        left.setdefault(r.pivot, set()).add(r.node)
    pairs = lambda gs: {(x, y) for xs in gs.values() for x in xs for y in xs}
    assert all(left[g] == groups[g] for g in left) and pairs(left) == pairs(groups)
    assert 100 in left and not {101, 102} & set(left) and len({103, 104} & set(left)) == 1
    assert jaccard.uncovered(df.where(F.lit(False)), "pivot").count() == 0
