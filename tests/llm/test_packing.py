import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from shelfscope.llm import packing
from shelfscope.llm.queries import best_fit_packing


@pytest.fixture(scope="module")
def slow():
    return Tokenizer.from_file(packing.default_path())  # default settings


def test_same_ids_by_both_libraries(slow, docs):
    fast = packing.Encoder(packing.default_path())
    rng = random.Random(2)
    texts = [r.text for r in docs.limit(50).collect()]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000), 32, 10])) for _ in range(40)) for _ in range(1500)]
    texts += ["".join(chr(c) + (" " if c % 3 else "") for c in range(a, a + 500) if not 0xD800 <= c < 0xE000) for a in range(0, 0x32000, 500)]
    texts += ["<|endoftext|> a", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>y <|endof|>", " " * 30_000 + "x", "a" * 30_000, "I'll we've 'S\u2028 \u00a0\u00a0 x\n\n\n y  "]
    for text in texts:
        assert fast.ids(text) == slow.encode(text, add_special_tokens=False).ids, text[:50]
    assert 50256 in fast.ids("a <|endoftext|> b")


def laid_out(intervals, capacity):
    """Every piece's (length, rank) -> place; checks gaps and overlaps."""
    place, fill = {}, defaultdict(list)
    for length, lo, hi, first, per, at in intervals:
        for r in range(lo, hi):
            assert (length, r) not in place
            seq, off = first + (r - lo) // per, at + (r - lo) % per * length
            place[length, r] = seq, off
            fill[seq].append((off, length))
    for parts in fill.values():
        end = 0
        for off, length in sorted(parts):
            assert off == end
            end += length
        assert end <= capacity
    return place, fill


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    rng = random.Random(seed)
    top = rng.choice([40, 300, 2048])
    counts = Counter(min(top, int(rng.expovariate(1 / rng.choice([20, 500, 900]))) + 1) for _ in range(rng.randrange(1, 3000)))
    place, fill = laid_out(packing.plan(dict(counts), 2048, rng.choice([3, 64, 512])), 2048)
    assert Counter(length for length, _ in place) == counts
    assert set(place) == {(x, r) for x, n in counts.items() for r in range(n)}
    total = sum(x * n for x, n in counts.items())
    floor = max(-(-total // 2048), sum(n for x, n in counts.items() if x > 1024))
    assert len(fill) <= 1.12 * floor + 2
    if seed == 0:
        assert packing.plan({}) == []


def test_close_to_the_bound_at_full_groups():
    rng = random.Random(8)
    counts = Counter(max(1, min(2047, int(rng.lognormvariate(6.4, 0.9)))) for _ in range(20_000))
    fill = laid_out(packing.plan(dict(counts)), 2048)[1]
    assert len(fill) <= 1.01 * sum(x * n for x, n in counts.items()) / 2048


def check_packed(rows, texts, slow):
    by_doc = defaultdict(list)
    fill = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        fill[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for own, parts in by_doc.items():
        ids = slow.encode(texts[own] or "", add_special_tokens=False).ids + [0]
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // 2048)))
        assert sum(r.length for r in parts) == len(ids)
        assert all(r.length == 2048 for r in parts[1:])
        start = 0
        for r in parts:
            assert r.start == start
            assert r.ids_crc32 == zlib.crc32(np.array(ids[start : start + r.length], "<u4").tobytes())
            start += r.length
    for parts in fill.values():
        end = 0
        for off, length in sorted(parts):
            assert off == end
            end += length
        assert end <= 2048
    return len(fill)


def test_query(spark, sf_dir, docs, slow):
    rows = best_fit_packing(spark, sf_dir).collect()
    n = check_packed(rows, {r.doc_id: r.text for r in docs.collect()}, slow)
    assert n <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_salted_ranks(docs, monkeypatch, slow):
    monkeypatch.setattr(packing, "WINDOW_ROWS", 1)
    same = docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 10_000))
    rows = packing.packed(same).collect()
    check_packed(rows, {r.doc_id: r.text for r in same.collect()}, slow)


def test_odd_rows(odd_docs, no_docs):
    got = packing.packed(odd_docs).collect()
    assert sum(r.piece == 0 for r in got) == odd_docs.count()
    assert sorted(r.length for r in got if r.doc_id in (0, 1)) == [1, 1, 1]
    assert packing.packed(no_docs).count() == 0
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in p) == max(o + n for o, n in p) <= 2048 for p in fill.values())
