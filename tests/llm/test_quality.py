import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from standtally.llm import quality
from tests.llm.cases import documents, odd_documents, simple, words

LABELS = "doc_id bigint, quality int, toxic int"


def junk(rng, n):
    return " ".join(f"w{rng.randrange(400)}{rng.choice(['###', '$$$', '***'])}" for _ in range(n))


def corpus(seed, n):
    rng = random.Random(seed)
    good = [rng.random() < 0.7 for _ in range(n)]
    texts = [words(rng, rng.randrange(5, 80)) + "." if g else junk(rng, rng.randrange(5, 80)) for g in good]
    return texts, [int(g) for g in good]


def test_held_out_rows_and_accuracy(spark):
    texts, labels = corpus(1, 600)
    docs = simple(spark, texts)
    known = spark.createDataFrame([(i, q, 0) for i, q in enumerate(labels)] + [(None, 1, 0), (3, None, 0), (9**9, 1, 0)], LABELS)
    flags = {r.doc_id: r.h for r in docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()}
    assert flags == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(len(texts))}
    model = quality.train(docs, known)
    # Labels that are held out change nothing.
    turned = known.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs.repartition(5), turned)
    assert np.array_equal(model.value, again.value) and np.array_equal(model.threshold, again.threshold)
    rows = quality.score_quality(docs, model).collect()
    right = [(r.score >= quality.THRESHOLD) == bool(labels[r.doc_id]) for r in rows if flags[r.doc_id]]
    assert len(right) > 100 and sum(right) / len(right) > 0.97


def test_flat_trees_equal_walking_them():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    model = quality.fit(x, y, trees=20, depth=3)

    def walk(row):
        raw = model.base
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] + int(row[model.feature[node]] > model.threshold[node])
            raw += model.value[node]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose(model.score(x), [walk(r) for r in x])
    longer = quality.fit(x, y, trees=100, depth=4)
    assert ((longer.score(x) > 0.5) == y).mean() > 0.95


def test_odd_rows_and_missing_labels(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], LABELS)
    got = quality.score_quality(docs, quality.train(docs, none))
    assert got.columns == docs.columns and [r.score for r in got.collect()] == [1.0] * len(odd_documents())
    texts, labels = corpus(2, 200)
    model = quality.train(simple(spark, texts), spark.createDataFrame([(i, q, 0) for i, q in enumerate(labels)], LABELS))
    rows = quality.score_quality(docs, model, "q").collect()
    assert len(rows) == len(odd_documents()) and all(0 <= r.q <= 1 and r.score in (0.5, None) for r in rows)
    assert quality.score_quality(documents(spark, []), model).collect() == []
    assert len(quality.statistics("")) == len(quality.FEATURES)
