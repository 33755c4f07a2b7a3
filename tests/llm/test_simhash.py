import random

import numpy as np
import pytest
import xxhash

from shelfscope.llm import simhash
from shelfscope.llm.common import components, spanning
from shelfscope.llm.queries import simhash_dedup


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", low)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, radius=2):
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    least = {}
    for i, own in enumerate(ids):
        if own is not None:
            least[top(i)] = min(least.get(top(i), own), own)
    return [least.get(top(i)) for i in range(len(prints))]


def test_query_against_brute_force(spark, sf_dir, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    prints = [brute_print(t) for _, t in rows]
    want = brute_components(prints, [i for i, _ in rows])
    got = sorted(simhash_dedup(spark, sf_dir).collect())
    assert [(r.doc_id, r.fingerprint, r.component_id) for r in got] == [
        (i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, want)
    ]


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(str(i * 31 % 17) for i in range(200))
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    assert simhash.fingerprint(text) % 2**64 == brute_print(text)


@pytest.mark.parametrize("tile", [3, 4096])
@pytest.mark.parametrize("parts", [1, 4, 8])
def test_links_lose_nothing(spark, tile, parts):
    rng = random.Random(parts)
    prints = {0, 2**64 - 1}
    for _ in range(12):
        own = rng.getrandbits(64)
        prints.add(own)
        for _ in range(8):
            own ^= 1 << rng.randrange(64)
            own ^= (1 << rng.randrange(64)) if rng.random() < 0.7 else 7
            prints.add(own)
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = simhash.links(df, parts=parts, tile=tile).collect()
    a, b = np.array([r.a for r in found]), np.array([r.b for r in found])
    node, root = spanning(a, b)
    label = {p: p for p in signed} | dict(zip(node.tolist(), root.tolist()))
    want = brute_components(prints, list(range(len(prints))))
    groups, expected = {}, {}
    for p, c in zip(signed, want):
        groups.setdefault(label[p], set()).add(p)
        expected.setdefault(c, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7)] + [(500, i) for i in range(501, 560)]
    random.Random(1).shuffle(chain)
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = {i: 0 for i in range(51)} | {100: 100, 200: 100, 300: 100} | {i: 500 for i in range(500, 560)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def component_ids(rows, roots):
    """The least id of every component, once for each component that has it."""
    prints = [brute_print(t) for _, t in rows]
    numbers = brute_components(prints, list(range(len(rows))))
    return [c for _, c in {(n, c) for n, c in zip(numbers, roots)}]


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = brute_components([brute_print(t) for _, t in rows], [i for i, _ in rows])
    got = simhash.near_duplicates(odd_docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(
        ((i, f"{brute_print(t):016x}", c) for (i, t), c in zip(rows, want)), key=key
    )
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(component_ids(rows, want))
    assert simhash.near_duplicates(no_docs).count() == simhash.keep_one(no_docs).count() == 0


def test_keep_one_of_unique_ids(docs):
    groups = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(groups)
