import random
import re
from collections import Counter

import pytest

from shelfscope.llm import linerules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeat(text):
    w = WORD.findall(text)
    n = Counter(zip(w, w[1:], w[2:]))
    return len({j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "x y z", "", "a b c d a b c e\u00a0f a b c"])
def test_repeat_words(text):
    assert linerules.repeat_words(linerules.utf8(text).split()) == brute_repeat(text)


def test_base_against_brute_force(docs):
    got = {r.doc_id: r for r in linerules.judged(docs, with_text=False).collect()}
    for r in docs.collect():
        words = WORD.findall(r.text)
        seen, dups = set(), 0
        for line in r.text.split("\n"):
            if WORD.search(line):
                dups += line in seen
                seen.add(line)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r.text)), dups, brute_repeat(r.text))
        own = got[r.doc_id]
        assert (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words) == want


def test_line_rules():
    def fault(s):
        raw = linerules.utf8(s)
        return linerules.line_fault(raw, raw.split(), linerules.ended_lines([raw.split()])[0])

    assert fault("Home | News | About us.") == "navigation"
    assert fault("Licensed under the Apache License, Version 2.0.") == "boilerplate"
    assert fault("No end here") == "punctuation"
    assert fault("BUY!! NOW!! CHEAP!! TODAY.") == "punctuation"
    assert fault("A good sentence, with a $5 price.") is None


CLEAN = {
    "hindi": "यह एक साफ वाक्य है जो यहाँ खत्म होता है{} और यह दूसरा है{}".format("।", "॥"),
    "urdu": "یہ ایک صاف جملہ ہے جو یہاں ختم ہوتا ہے۔",
    "arabic": "هل هذه جملة نظيفة تنتهي بعلامة استفهام؟",
    "chinese": "这 是 一个 干净 的 句子 ， 它 在 这里 结束 。",
    "quoted": "Er sagte leise zu ihr: »Das ist ein sauberer Satz.«",
}


@pytest.mark.parametrize("name", sorted(CLEAN))
def test_clean_lines_of_other_scripts_stay(name):
    text = "\n".join(f"{i} {CLEAN[name]}" for i in range(40))
    found = linerules.judge(text)
    assert found[8] == 0 and found[9] == 0


def test_wrapped_prose_stays():
    rng = random.Random(4)
    words = [f"word{rng.randrange(5000)}" for _ in range(240)]
    words[59::60] = [w + "." for w in words[59::60]]
    lines = [" ".join(words[i : i + 12]) for i in range(0, 240, 12)]
    found = linerules.judge("\n".join(lines))
    assert found[6] and found[8] == 0
    # a run that never ends, and lines that no line continues, do not pass
    open_end = linerules.judge("\n".join(x.replace(".", "") for x in lines))
    assert not open_end[6] and open_end[8] == 20
    headings = linerules.judge("\n".join(x.replace(".", "").capitalize() for x in lines))
    assert not headings[6] and headings[8] == 20


def test_removal_and_verdict():
    rng = random.Random(1)
    lines = [" ".join("w%d" % rng.randrange(10**6) for _ in range(9)) + "." for _ in range(8)]
    text = "\n".join(lines) + "\nHome | News | Shop\n\nAll rights reserved."
    out = linerules.judge(text)
    assert out[6] and out[8] == 2
    assert out[-1] == "\n".join(lines) + "\n"
    bad = "\n".join(f"menu{i} entry{i} more{i} and{i} so{i} on{i}" for i in range(20))
    assert not linerules.judge(bad)[6]


def test_odd_rows(odd_docs, no_docs):
    got = linerules.judged(odd_docs).collect()
    assert len(got) == odd_docs.count()
    nulls = [r for r in got if r.cleaned is None]
    assert len(nulls) == 2 and all(r.base_failed and not r.kept and r.n_words == 0 for r in nulls)
    kept = linerules.cleaned(odd_docs, chars_col="n_chars")
    assert kept.columns == odd_docs.columns and kept.dtypes == odd_docs.dtypes
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == [6, 6]
    assert all(r.n_chars == len(r.text) and r.kept == 1 for r in rows)
    assert linerules.judged(no_docs).count() == linerules.cleaned(no_docs).count() == 0
