"""Near copies against a brute force over the Jaccard similarity of five-word shingles."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from shelfscope.llm import neardup


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The least id of every group of ``(id, text)``."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(sets.items(), 2):
        if a == b or 10 * len(a & b) >= 8 * len(a | b):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return sorted(i for i in root if root[i] == i)


def near_copies(seed=3):
    """Texts of 4 to 400 words with copies that differ in some words, around 0.8."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(4, 400))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            own = list(base)
            for _ in range(rng.randrange(1, 2 + len(own) // 35)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own if rng.random() < 0.7 else own[: int(len(own) * rng.uniform(0.75, 1))]).upper())
    return list(enumerate(rows))


@pytest.mark.parametrize("tile", [3, 1 << 18])
def test_stage_against_brute_force(spark, sf_dir, monkeypatch, tile):
    monkeypatch.setattr(neardup.links, "__defaults__", (tile,))
    monkeypatch.setattr(neardup.candidates, "__defaults__", (neardup.RADIUS, neardup.AGREE, min(tile, 4096)))
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert 60 <= len(want) < len(rows) - 30
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == want


def test_candidates_do_not_link(spark):
    """Sets that pass the sieve but are not similar enough stay apart."""
    rows = near_copies(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.keep_one(docs, radius=64, agree=0)
    assert sorted(r.doc_id for r in got.collect()) == brute(rows)


def test_odd_rows(odd_docs, no_docs):
    kept = neardup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [r.text for r in kept.collect()]
    assert sorted(map(tuple, map(sorted, map(shingles, texts)))) == sorted({tuple(sorted(shingles(r.text))) for r in odd_docs.collect()})
    assert neardup.keep_one(no_docs).count() == 0


def similar_pair(rng, n):
    """Two sets of hashes, the first of ``n``, with a similarity of 0.8 or just above."""
    import numpy as np

    pool = rng.choice(1 << 62, 3 * n + 8, replace=False).astype(np.uint64)
    a = pool[:n]
    most = [(both, extra) for both in range(n + 1) for extra in range(n + 1) if 10 * both >= 8 * (n + extra)]
    least = {}
    for both, extra in most:
        least[extra] = min(least.get(extra, both), both)
    extra = int(rng.choice(sorted(least)))
    b = np.concatenate([a[: least[extra]], pool[n : n + extra]])
    return np.sort(a), np.sort(b)


def test_no_pair_is_lost_at_any_size():
    """A band is shared and the sieve passes for pairs at the limit, of 1 to 400 shingles."""
    import numpy as np

    rng = np.random.default_rng(5)
    for n in [*range(1, 80), *range(80, 401, 20)]:
        for _ in range(20 if n < 80 else 60):
            a, b = similar_pair(rng, n)
            (row_a, bands_a), (row_b, bands_b) = neardup._sieve(a), neardup._sieve(b)
            assert (bands_a == bands_b).any(), n
            rows = [np.frombuffer(x, neardup._ROW) for x in (row_a, row_b)]
            assert neardup._near(*rows, neardup.RADIUS, neardup.AGREE).all(), n
            assert len(neardup._candidates(*rows, neardup.RADIUS, neardup.AGREE)[0]) or (a == b[: len(a)]).all()


def test_long_texts_are_split_in_pieces(monkeypatch):
    text = "  ".join(f"Word{i % 97}\n\u00c4{i}" for i in range(3000)) + "\t"
    whole = neardup.shingle_set(text)
    for piece in (1, 7, 1000):
        monkeypatch.setattr(neardup, "_PIECE", piece)
        assert (neardup.shingle_set(text) == whole).all()
    assert len(neardup.shingle_set(" \n ")) == len(neardup.shingle_set(None)) == 0
    assert len(whole) == len(shingles(text))


def test_shared_passages(spark):
    """Passages and words that most texts share."""
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [f"{text} {passage}" if rng.random() < 0.7 else text for _, text in near_copies(9)]
    rows += ["same few words here again"] * 5 + [f"{passage} x{i}" for i in range(30)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == brute(rows)


def test_components_with_hubs(spark, monkeypatch):
    from shelfscope.llm import common

    monkeypatch.setattr(common, "_HUB", 3)
    links = [(i, 0) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 130)] + [(7, 200), (200, 201), (55, 54)]
    got = dict(common.components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {i: 0 for i in [*range(40), 200, 201]} | {i: 100 for i in range(100, 131)} | {55: 54, 54: 54}
    assert got == want


def test_stage_uses_the_fingerprints(spark, sf_dir, monkeypatch):
    """Texts within two bits meet by the SimHash step alone; the exact comparison still decides."""
    from shelfscope.llm import simhash

    rng = random.Random(2)
    body = [f"w{rng.randrange(3000)}" for _ in range(4000)]
    rows = [(i, " ".join([*body, f"end{i}"])) for i in range(4)]
    # repeats count for SimHash, not for the sets: within two bits, but not similar
    rows += [(10 + i, "a b c " * 400 + " ".join(f"{i}x{k}" for k in range(12))) for i in range(2)]
    prints = [simhash.fingerprint(t) for _, t in rows]
    assert all((a ^ prints[0]).bit_count() <= 2 for a in prints[:4]) and (prints[4] ^ prints[5]).bit_count() <= 2
    own = neardup._sieve
    monkeypatch.setattr(neardup, "_sieve", lambda s: (own(s)[0], own(s)[1][:0]))  # no bands
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert want == [0, 10, 11]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == want
