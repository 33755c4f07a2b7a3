"""Merkle manifest against a tree built node by node."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfscope.llm import merkle
from shelfscope.llm.queries import merkle_manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climbed(nodes):
    """The last node, and every node's siblings (left, right) per level."""
    paths, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + 16, len(nodes))) for a in range(0, len(nodes), 16)]
        for run in runs:
            for k in run:
                pair = "".join(nodes[i] for i in run if i < k), "".join(nodes[i] for i in run if i > k)
                for i in below[k]:
                    paths[i].append(pair)
        nodes, below = [h(*(nodes[i] for i in run)) for run in runs], [sum((below[i] for i in run), []) for run in runs]
    return nodes[0], paths


def brute(rows):
    """``[(key, leaf, subroot, root, path)]`` of ``(group, key, text)``."""
    groups = defaultdict(list)
    for g, k, t in rows:
        groups[g].append((k is not None, k or 0, h(field(k), field(t)), k))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climbed([x[2] for x in sorted(groups[g])]) for g in order}
    root, ways = climbed([trees[g][0] for g in order])
    return [
        (x[3], x[2], trees[g][0], root, path + way)
        for g, way in zip(order, ways)
        for x, path in zip(sorted(groups[g]), trees[g][1])
    ]


def run(spark, rows):
    df = spark.createDataFrame(rows, "g string, k long, t string").repartition(5)
    out = merkle.manifest(df, [F.col("k"), F.col("t")], F.col("g"), F.col("k"), F.struct("k"))
    return [(r.data.k, r.leaf, r.subroot, r.root, [(x.left, x.right) for x in r.path]) for r in out.collect()]


@pytest.mark.parametrize("sizes", [[1], [2], [16, 1], [17, 256, 257], [1] * 300, [4100, 3]])
def test_trees(spark, sizes):
    rows = [(f"s{g}" if g else None, i * 7 % n, f"text {g} {i}") for g, n in enumerate(sizes) for i in range(n)]
    assert sorted(run(spark, rows), key=repr) == sorted(brute(rows), key=repr)


def test_odd_rows(spark):
    rows = [(None, None, None), (None, None, None), ("", 1, ""), ("é", 1, "x"), ("z", 1, "x"), ("z", 1, "y"), ("Z", None, "é")]
    rows += [("hot", 5, "same")] * 700
    assert sorted(run(spark, rows), key=repr) == sorted(brute(rows), key=repr)
    assert run(spark, rows[:0]) == []


def test_changes_show(spark):
    rows = [(f"s{i % 3}", i, f"t{i}") for i in range(100)]
    before = {r[0]: r for r in run(spark, rows)}
    after = {r[0]: r for r in run(spark, [(g, k, t + "!" if k == 7 else t) for g, k, t in rows])}
    assert before[7][3] != after[7][3] and before[7][2] != after[7][2]
    assert before[7][4] == after[7][4] and before[8][2] == after[8][2]


def test_query_over_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for docs, n in ((odd_docs, odd_docs.count()), (no_docs, 0)):
        path = f"{tmp_path}/{n}"
        docs.write.parquet(f"{path}/documents.parquet")
        got = merkle_manifest(spark, path).collect()
        assert len(got) == n
        assert all(len(r.folded_root) == 64 and (r.verified or r.doc_id is not None) for r in got)
        assert len({r.root for r in got}) == min(n, 1)
