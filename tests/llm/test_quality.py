import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawl.llm import quality

SCHEMA = "doc_id long, text string, label int, x string, quality_score string, `a.b` int"


def corpus(n=600):
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for _ in range(n):
        words = ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 9))) for _ in range(rng.integers(1, 120))]
        bad = rng.random() < 0.3
        kind = rng.integers(0, 3)
        if bad:
            words = [w.upper() + "!!" if kind == 0 else w + "#$%" if kind == 1 else w + " |" for w in words]
        texts.append(" ".join(words) + ".")
        labels.append(int(not bad))
    return texts, labels


def test_held_out_accuracy_and_columns(spark):
    texts, labels = corpus()
    odd = [None, "", " \n\t", "x", "!" * 200_000, "Une phrase simple, écrite avec soin."]
    rows = [(i, t, 5, "x", "s", 1) for i, t in enumerate(texts + odd)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    marks = spark.createDataFrame([(i, x) for i, x in enumerate(labels)] + [(0, None), (None, 1), (7, 9), (10**6, 1)],
                                  "doc_id long, quality int")
    forest = quality.fit(docs, marks, F.col("doc_id") % 4 != 0)
    scored = quality.score(docs, forest)
    assert scored.columns == ["doc_id", "text", "label", "x", "a.b", "quality_score"]
    found = {r["doc_id"]: r["quality_score"] for r in scored.collect()}
    assert len(found) == len(rows) and all(0 <= s <= 1 for s in found.values())
    held = [i for i in range(len(texts)) if i % 4 == 0]
    assert np.mean([(found[i] >= 0.3) == labels[i] for i in held]) > 0.95
    assert found[len(texts)] == found[len(texts) + 1]
    assert quality.score(docs, forest, keep=["doc_id"]).columns == ["doc_id", "quality_score"]


def test_flat_trees_equal_a_walk_through_them():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    x[:, 4] = 1  # a feature without a split
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    forest = quality.grow(x, y)

    def walked(row):
        total = forest.base
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    scores = forest.score(x)
    assert scores == pytest.approx([walked(row) for row in x])
    assert np.mean((scores > 0.5) == y) > 0.97
    assert 4 not in forest.feature[np.isfinite(forest.threshold)]


def test_statistics_do_not_depend_on_the_batch():
    texts = ["Ab cd.", None, "", "x | y\nx | y\n", "é" * 30, "AAA!! bbb 12"]
    whole = np.concatenate([x for _, x in quality.statistics(pa.array(texts))])
    single = np.concatenate([x for t in texts for _, x in quality.statistics(pa.array([t], pa.string()))])
    assert (whole == single).all() and np.isfinite(whole).all()
    assert not whole[1].any() and not whole[2].any()
    named = dict(zip(quality.FEATURES, whole[3].tolist(), strict=True))
    assert named["repeated_lines"] == pytest.approx(0.5)
    assert named["bars"] == pytest.approx(2 / 6)


def test_without_labels_one_class_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    none = quality.fit(docs, marks.limit(0), F.lit(True))
    assert [r["quality_score"] for r in quality.score(docs, none).collect()] == [0.5] * 3
    one = quality.score(docs, quality.fit(docs, marks, F.lit(True))).collect()
    assert len(one) == 3 and all(r["quality_score"] > 0.5 for r in one)
    assert quality.score(docs.limit(0), none).count() == 0
