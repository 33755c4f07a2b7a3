"""The whole pipeline against a plain version without Spark."""

from collections import defaultdict

from test_native import shingles
from test_neardup import brute as near_copies_left

import corpus_pipeline
from shelfscope.llm import linerules, packing, secrets


def brute(docs, items):
    """``{doc_id: text}`` that reach the packing stage."""
    left = {}
    for own, text in docs:
        found = linerules.judge(text)
        if found[6]:
            left[own] = found[-1]
    # near copies: a similarity of 0.8 over shingles of five words, as for every stage
    left = {i: left[i] for i in near_copies_left(sorted(left.items()))}
    wanted = [s for x in items if (s := shingles(x))]
    left = {
        i: t for i, t in left.items()
        if not any(100 * len(s & shingles(t)) >= 80 * len(s) for s in wanted)
    }
    return {i: secrets.mask(t) for i, t in left.items()}


def test_run(spark, sf_dir, docs):
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = brute([(r.doc_id, r.text) for r in docs.collect()], items)
    encoder = packing.Encoder(packing.default_path())
    got = defaultdict(int)
    fill = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id] += r.length
        fill[r.sequence_id].append((r.offset, r.length))
    assert dict(got) == {i: len(encoder.ids(t)) + 1 for i, t in want.items()}
    assert all(sum(n for _, n in p) == max(o + n for o, n in p) <= 2048 for p in fill.values())


def test_stages_on_odd_rows(spark, sf_dir, odd_docs, no_docs):
    for source in (odd_docs, no_docs):
        df = source
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, sf_dir)
            assert df.dtypes == source.dtypes
        packed = corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in df.collect()}
    assert corpus_pipeline.ORACLE_SQL is None
