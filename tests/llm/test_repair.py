"""Conversation repair against a plain program over rows and states."""

import hashlib
import random
from collections import defaultdict

import pytest

from shelfscope.llm import repair
from shelfscope.llm.queries import conversation_repair

SPACE = " \t\n\x0b\x0c\r"


def after(state, initial):
    """The state when a row with this initial is written: empty, s, u, a."""
    return {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(initial, {}).get(state)


def brute(rows):
    """``(blank, duplicate, truncated, illegal, cost, audit, lines)`` of ordered rows."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        faults.append(fault)
        seen.add((role, text))

    def offer(found, state, way):
        if state is not None and (state not in found or way[:2] < found[state][:2]):
            found[state] = way

    def inserts(found):
        for _ in range(4):
            for state, (c, a, w) in list(found.items()):
                for role in ("user", "assistant"):
                    offer(found, after(state, role[0]), (c + 2, a + "I", (*w, f"{role}:")))
        return found

    now = inserts({0: (0, "", ())})
    for (role, text), fault in zip(rows, faults):
        then = {}
        for state, (c, a, w) in now.items():
            offer(then, state, (c + 3, a + "D", w))
            if fault in ("blank", "duplicate"):
                continue
            c += fault == "truncated"
            offer(then, after(state, role[:1]), (c, a + "K", (*w, f"{role}:{text}")))
            for new in ("user", "assistant"):
                offer(then, after(state, new[0]), (c + 2, a + "R", (*w, f"{new}:{text}")))
        now = inserts(then)
    cost, audit, lines = min(now[s] for s in (0, 3) if s in now)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, list(lines))


def check(spark, rows):
    """``rows``: (conv, turn, role, text), turns all different within a conversation."""
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    done = repair.repair(df)
    lines = defaultdict(list)
    for r in done.rows.orderBy("at", "k").collect():
        lines[r.conv].append(f"{r.role}:{r.text}")
    hashes = {r.conv: r.sha256 for r in repair.written_sha256(done.rows).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[None if c is None else str(c)].append((t, role or "", text or ""))
    got = {r.conv: r for r in done.report.collect()}
    assert set(got) == set(by)
    for c, own in by.items():
        want = brute([x[1:] for x in sorted(own, key=lambda x: (x[0] is not None, x[0] or 0))])
        r = got[c]
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, lines[c]) == want, own[:20]
        if lines[c]:
            assert hashes[c] == hashlib.sha256("\n".join(lines[c]).encode()).hexdigest()
        else:
            assert c not in hashes


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, "", "supervisor", "agent"]
    texts = ["", None, " \n", "No end", "An end.", "Why?", "é!", "same.", "x. \t"]
    for c in range(conversations):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(roles[:2]) if rng.random() < 0.6 else rng.choice(roles)
            text = rng.choice(texts) if rng.random() < 0.4 else f"text {rng.randrange(50)}" + rng.choice([".", "", "!"])
            yield c, t, role, text


@pytest.mark.parametrize("rules", [0, 3, 128])
@pytest.mark.parametrize("bits", [2, 10])
def test_random_conversations(spark, monkeypatch, bits, rules):
    """With blocks of 4 rows every conversation crosses borders; 0 rules: nothing is shared."""
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    monkeypatch.setattr(repair, "MAX_RULES", rules)
    check(spark, list(random_rows(bits + rules, 120, 14)))


def test_long_conversation(spark):
    check(spark, list(random_rows(5, 1, 5000)) + [(None, i, "user" if i % 2 else "assistant", f"{i}.") for i in range(40)])


def test_matrices_against_the_program():
    """Every state to every state, for random symbol strings, by rules and without them."""
    rng = random.Random(3)
    grammar = repair.Grammar()
    pairs = [grammar.add(rng.choice(repair.PLAIN) + rng.choice(repair.CUT)) for _ in range(4)]
    pairs += [grammar.add(rng.choice(pairs) + rng.choice(pairs)) for _ in range(4)]

    def flat(s):
        return s if s not in grammar.rules else "".join(map(flat, grammar.rules[s]))

    for _ in range(60):
        packed = "".join(rng.choice([*pairs, *repair.PLAIN, *repair.GONE]) for _ in range(rng.randrange(1, 6)))
        symbols = "".join(map(flat, packed))
        one, two = grammar.prefixes(packed)[-1], grammar.prefixes(symbols)[-1]
        assert one.cost == two.cost
        for i in range(4):
            ways = []
            for j in range(4):
                if one.cost[i][j] < repair.FAR:
                    way = grammar.audit(packed, i, j)
                    assert way == grammar.audit(symbols, i, j) and len(way) == len(symbols)
                    ways.append((one.rank[i][j], "".join(way)))
            # ranks order the edits from one state as texts
            assert [w for _, w in sorted(ways)] == sorted(w for _, w in ways)


def test_ties_and_repeats(spark):
    rows = [(1, 0, "user", "a."), (1, 0, "user", "a."), (1, None, "assistant", "b."), (2, 5, "user", "x."), (2, 5, "assistant", "y.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv: r for r in repair.repair(df).report.collect()}
    assert got["1"].duplicate == 1 and got["1"].gaps == 0
    # equal turns: by role
    assert (got["2"].audit, got["2"].cost) == ("DKI", 5) or got["2"].cost == 4


def test_query_on_odd_rows(spark, tmp_path):
    columns = "conv_id long, turn long, role string, text string, c string, at int, fault string"
    rows = [(None, None, None, None, "x", 1, "y"), (None, 3, "user", "", "x", 1, "y"), (7, 1, None, "z" * 100_000, "x", 1, "y")]
    for n, own in enumerate((rows, [])):
        spark.createDataFrame(own, columns).write.parquet(f"{tmp_path}/{n}/conversations.parquet")
        got = conversation_repair(spark, f"{tmp_path}/{n}").collect()
        assert {r.conv_id for r in got} == {r[0] for r in own}
        assert all(None not in r[1:] for r in got)
