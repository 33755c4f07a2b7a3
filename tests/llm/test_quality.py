import zlib

import numpy as np

from shelfscope.llm import quality
from shelfscope.llm.queries import quality_trees


def walk(trees, x):
    """One row at a time, one node at a time."""
    out = []
    for row in x:
        total = trees.start
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        out.append(1 / (1 + np.exp(-total)))
    return np.array(out)


def test_fit_and_flat_traversal():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = quality.fit(x[:2000], y[:2000], rounds=40)
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    assert np.allclose(trees.score(x[:50]), walk(trees, x[:50]))


def test_query(spark, sf_dir, docs):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = quality_trees(spark, sf_dir).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    # the fold is small here: all labelled rows
    known = [r for r in got if r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in known]) > 0.9


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (3, 1), (6, 0), (9, None), (None, 1), (99, 0)], "doc_id long, quality int")
    trees = quality.learn(odd_docs, labels)
    got = quality.scored(odd_docs, trees).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    none = quality.learn(odd_docs, labels.limit(0))
    assert {r.score for r in quality.scored(odd_docs, none).collect()} == {0.5}
    assert quality.scored(no_docs, trees).count() == 0
    again = quality.learn(odd_docs.repartition(3), labels.repartition(2))
    assert np.array_equal(again.leaf, trees.leaf) and np.array_equal(again.cut, trees.cut)
