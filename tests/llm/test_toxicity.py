"""Toxicity: the automaton against edit distances, context factors, held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfscope.llm import toxicity
from shelfscope.llm.queries import toxicity_automata


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_distances():
    rng = random.Random(1)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(3, 12))): 1.0 for _ in range(40)}
    automaton = toxicity.Automaton(toxicity.Lexicon(terms))
    hits = 0
    for _ in range(3000):
        word = rng.choice(list(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word = word[:at] + rng.choice(["", "a", "b", "x"]) + word[at + rng.randrange(2) :]
        near = [(d, t) for t in terms if (d := distance(word, t)) <= toxicity.allowed(t)]
        got = automaton.match(word)
        assert (got is None) == (not near), word
        if got:
            hits += 1
            assert (got[2], got[0]) == min(near), word
    assert 500 < hits < 2900


def test_stems_and_real_words():
    lexicon = toxicity.Lexicon({"moron": 2.0, "trash": 3.0}, {"idio": 4.0}, frozenset({"crash"}))
    match = toxicity.Automaton(lexicon).match
    assert match("trash") == ("trash", 3.0, 0) and match("trsh") == ("trash", 3.0, 1)
    assert match("crash") is None and match("thrash")[2] == 1
    assert match("idiotic") == ("idio", 4.0, 0) and match("idxotic") is None
    assert match("m0ron") == ("moron", 2.0, 1) and match("mormon")[2] == 1 and match("mo") is None


def test_states_are_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "_MAX_STATES", 5)
    automaton = toxicity.Automaton(toxicity.Lexicon({"worthless": 1.0, "pathetic": 1.0}))
    assert [automaton.match(w)[2] for w in ("worthless", "worthles", "pathetik", "wortles")] == [0, 1, 1, 2]


def test_context():
    automaton = toxicity.Automaton(toxicity.Lexicon({s: 3.0 for s in toxicity.SEEDS}))

    def factor(text):
        found, _ = toxicity.hits(text, automaton)
        assert len(found) == 1, text
        return found[0][3]

    plain = factor("what a moron that is")
    assert plain == 1.0
    assert factor("you are a moron") == toxicity.ADDRESSED
    assert factor("what a MORON that is") == factor("such a moron!! again") == toxicity.EMPHASIS
    assert factor('the sign read "moron" in red') == toxicity.QUOTED
    assert factor("auf dem Schild stand „moron“ in Rot") == toxicity.QUOTED
    assert factor("she wrote moron on the wall") == toxicity.REPORTED
    quoted = toxicity.statistics('he said "idiot" and the word "scum" was quoted', automaton)
    abuse = toxicity.statistics("you idiot, you are scum!!", automaton)
    assert quoted[0] < abuse[0] and quoted[1] < abuse[1]
    model = toxicity.Model(toxicity.Lexicon({}), toxicity.DEFAULT)
    import numpy as np

    low, high = model.score(np.array([quoted, abuse]))
    assert low < 0.5 < high


def test_fit_reaches_the_optimum():
    """Clean texts with many weak hits: whole Newton steps from the start run away."""
    rng = np.random.default_rng(0)
    y = (np.arange(6000) % 10 == 0).astype(float)
    x = np.zeros((6000, 5))
    hit = rng.random(6000) < np.where(y, 0.95, 0.5)
    base = rng.uniform(0.5, 1.5, (6000, 5)) * np.where(y, 1.0, 2.0)[:, None]
    x[hit] = (base * [3.0, 6.0, 4.0, 1.0, 2.0])[hit]
    weights = toxicity.fit(x, y)
    model = toxicity.Model(toxicity.Lexicon({}), weights)
    # the slope of the loss with its penalty is zero
    held = np.hstack([x, np.ones((6000, 1))])
    slope = held.T @ (y - model.score(x)) - (weights - toxicity.DEFAULT)
    assert np.abs(slope).max() < 1e-3
    assert not (model.score(x) >= 0.5).all()


def test_chosen_keys():
    counts = {"clown ": (60, 0), "clow": (60, 0), "clo": (90, 400), "the ": (100, 900)}
    counts |= {"bad": (80, 2), "badu": (20, 0), "bade": (25, 1), "badi": (30, 0), "badu ": (20, 0)}
    found = toxicity.choose(counts, (100.0, 900.0))
    assert set(found.stems) == {"bad"}
    assert "clown" in found.words and found.words["clown"] > toxicity.SEED_WEIGHT
    assert "badu" not in found.words and "the" not in found.words


def test_query(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = toxicity_automata(spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = got.join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    wrong = sum(r.predicted != r.toxic for r in rows)
    assert wrong <= 0.1 * len(rows)
    assert sum(r.predicted and not r.toxic for r in rows) <= 0.02 * len(rows)


@pytest.mark.parametrize("labelled", [0, 1])
def test_odd_rows(spark, odd_docs, no_docs, labelled):
    labels = spark.createDataFrame([(3, 1), (3, 0), (6, None), (None, 1), (99, 0), (5, 0)][: 6 * labelled], "doc_id long, toxic int")
    model = toxicity.learn(odd_docs, labels)
    got = toxicity.scored(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    assert all(0 <= r.score < 0.5 for r in got)
    assert toxicity.scored(no_docs, toxicity.learn(no_docs, labels)).count() == 0
    loud = spark.createDataFrame([(1, "You idiot, you worthless scum!!")], "doc_id long, text string")
    assert toxicity.scored(loud, model).first().score >= 0.5


def test_copies_count_once(spark):
    """Words of one copied text are no evidence, however many copies are labelled."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    text = lambda *more: " ".join([*(rng.choice(words) for _ in range(40)), *more])
    copied = text("strangeword", "oddword")
    rows = [(i, copied, 1) for i in range(100)]
    rows += [(1000 + i, text("badword", f"x{i}"), 1) for i in range(60)] + [(2000 + i, text(), 0) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    keys = set(model.lexicon.words) | set(model.lexicon.stems)
    assert any("badword".startswith(k) for k in keys)
    assert not any("strangeword".startswith(k) or "oddword".startswith(k) for k in keys)
    scores = toxicity.scored(df.select("doc_id", "text"), model).join(df.select("doc_id", "toxic"), "doc_id")
    clean = scores.filter("toxic = 0").agg(F.max("score")).first()[0]
    assert clean < 0.5
