import zlib
from collections import Counter

import numpy as np
import pytest

from shelfscope.llm import langid
from shelfscope.llm.queries import language_id


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        p = f" {w} "
        out.update(w)
        out.update(p[i : i + 2] for i in range(len(p) - 1))
        out.update(p[i : i + 3] for i in range(len(p) - 2))
    return out


def key_of(gram):
    codes = [0 if c == " " else ord(c) for c in gram]
    if len(codes) == 1:
        return codes[0]
    if len(codes) == 2:
        return (codes[0] << 21 | codes[1]) - (1 << 63)
    return codes[0] << 42 | codes[1] << 21 | codes[2]


@pytest.mark.parametrize("text", ["The cat, the hat!", "Éa bß. 漢 c-d", "x", "a1b"])
def test_grams(text):
    keys, counts = np.unique(langid.gram_keys(text), return_counts=True)
    want = {key_of(g): n for g, n in brute_grams(text).items()}
    assert dict(zip(keys.tolist(), counts.tolist())) == want


def test_slices_keep_all():
    text = "ab cd " * 1000 + "x" * 700 + " end"
    parts = list(langid.slices(text, 64))
    assert "".join(parts) == text and max(map(len, parts)) <= 64


def test_profiles_and_distances_against_brute_force(docs):
    rows = [r for r in docs.select("doc_id", "text", "lang").collect()][:60]
    sub = docs.filter(docs.doc_id.isin([r.doc_id for r in rows]))
    learned = langid.profiles(sub, size=50)
    totals = {}
    for r in rows:
        totals.setdefault(r.lang, Counter()).update(brute_grams(r.text))
    for lang, grams in totals.items():
        want = sorted((-n, key_of(g)) for g, n in grams.items())[:50]
        assert learned[lang].tolist() == [k for _, k in want]
    got = {r.doc_id: r for r in langid.identify(sub, learned, size=50).collect()}
    for r in rows:
        own = [k for _, k in sorted((-n, key_of(g)) for g, n in brute_grams(r.text).items())[:50]]
        cost = {}
        for lang, prof in learned.items():
            rank = {k: i for i, k in enumerate(prof.tolist())}
            cost[lang] = sum(abs(rank[k] - i) if k in rank else 50 for i, k in enumerate(own))
        best = min(sorted(cost), key=cost.get)
        assert got[r.doc_id].lang_pred == best
        assert got[r.doc_id].score == pytest.approx(1 - cost[best] / (50 * len(own)))


def test_query(spark, sf_dir, docs):
    got = language_id(spark, sf_dir).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    away = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in away) >= 0.97 * len(away)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(odd_docs, no_docs):
    learned = langid.profiles(odd_docs)
    assert set(learned) == {"", "en", "de"}  # an empty value is a value
    got = langid.identify(odd_docs, learned).collect()
    assert len(got) == odd_docs.count()
    und = [r for r in got if r.lang_pred == "und"]
    assert len(und) == 7 and all(r.score == 0 for r in und)
    assert langid.profiles(no_docs) == {}
    assert {r.lang_pred for r in langid.identify(odd_docs, {}).collect()} == {"und"}
    assert langid.identify(no_docs, learned).count() == 0


def test_marks_alone_are_no_letters(spark):
    rows = [(1, "\u0301\u0302 \u0303", "en"), (2, "12 - \u0301", "en"), (3, "e\u0301t\u0301 la", "fr"), (4, "the end", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, langid.profiles(docs)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "fr", "en"]
    assert got[1].score == got[2].score == 0
