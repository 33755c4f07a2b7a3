"""What a task of the pipeline holds at once, on groups in which all texts are near copies."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfscope.llm import common, linerules, neardup, packing, secrets, simhash

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def measured(work, *args):
    """The result, and the MB held at the peak."""
    tracemalloc.start()
    try:
        return work(*args), tracemalloc.get_traced_memory()[1] / (1 << 20)
    finally:
        tracemalloc.stop()


def test_candidates_of_one_large_group():
    rows = np.zeros(2000, neardup._ROW)
    rows["key"], rows["n"] = np.arange(2000) - 1000, 100
    (node, root), mb = measured(neardup._candidates, rows, rows, neardup.RADIUS, neardup.AGREE)
    assert sorted(node) == list(range(-999, 1000)) and set(root) == {-1000}
    assert mb < 48


def test_links_of_one_large_group():
    rng = np.random.default_rng(3)
    common_part = rng.integers(0, 1 << 63, 60, np.uint64)
    sets = [np.unique(np.append(common_part, np.uint64(i))) for i in range(2000)]
    keys = np.arange(2000)
    (node, root), mb = measured(neardup.similar, keys, sets, keys, sets)
    assert sorted(node) == list(range(1, 2000)) and set(root) == {0}
    assert mb < 48


def test_fingerprints_of_one_large_group():
    fps = np.arange(3, dtype=np.uint64).repeat(1) ^ np.uint64(1 << 40)
    bits = np.array([(1 << i) ^ (1 << 40) for i in range(40)], np.uint64)
    many = np.unique(np.concatenate([fps, bits]))
    (node, root), mb = measured(simhash.linked, np.tile(many, 60), np.tile(many, 60), 2)
    assert sorted(node) == sorted(many.view(np.int64))[1:] and set(root) == {int(min(many))}
    assert mb < 48


def test_forests_equal_one_pass():
    rng = np.random.default_rng(4)
    parts = [(rng.integers(0, 90_000, n), rng.integers(0, 90_000, n)) for n in (0, 1, 30_000, 50_000, 7, 70_000)]
    want = common.spanning(*map(np.concatenate, zip(*parts, strict=True)))
    got = common.spanning_of(iter(parts))
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))
    assert [len(x) for x in common.spanning_of([])] == [0, 0]


@pytest.fixture()
def no_limit(spark):
    before = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    yield
    spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)


def test_batches_are_limited_by_bytes(spark, no_limit):
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('ab ', 1000)").alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    for make in (lambda: neardup.keep_one(docs), lambda: linerules.cleaned(docs), lambda: secrets.redacted(docs),
                 lambda: packing.pieces(docs, "doc_id", "text", packing.default_path())):
        spark.conf.unset(KEY)
        make()
        most = max(r.n for r in docs.mapInArrow(sizes, "n long").collect())
        assert most < 2 * common.BATCH_BYTES
    spark.conf.set(KEY, "12345")  # the session's own limit stays
    linerules.cleaned(docs)
    assert spark.conf.get(KEY) == "12345"


def test_plan_of_packing_needs_no_python_workers(spark):
    for rows in ([], [(2048, 3), (1, 1)]):
        table = packing._table(spark, rows, ("length", "n"))
        assert [tuple(r) for r in table.collect()] == rows and table.dtypes == [("length", "bigint"), ("n", "bigint")]
        assert "LocalTableScan" in table._jdf.queryExecution().executedPlan().toString()
