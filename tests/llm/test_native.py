"""Decontamination, URL rules and sharding."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfscope.llm import common, decontaminate, sharding, urlrules


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_decontamination_at_every_containment(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = []
    for k in range(0, 27):
        words = item.split()
        for j in range(k):  # break windows one after the other
            words[j * 29 // 26] += "x"
        docs.append((k, "intro. " + " ".join(words).upper() + " and a long tail " * 40))
    docs += [(100, item[: len(item) // 2] + " gap in it " + item[len(item) // 2 :]), (101, None), (102, "")]
    items = [(1, item), (2, "too short"), (3, None), (4, "totally other words that are nowhere else at all")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = {
        (a, b, len(shingles(t) & s), len(s))
        for b, x in items if (s := shingles(x)) for a, t in docs
        if 100 * len(shingles(t) & s) >= 80 * len(s)
    }
    got = decontaminate.contaminated(d, i).collect()
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got} == want and len(got) == len(want)
    assert 0 < len(want) < 27
    left = {r.doc_id for r in decontaminate.decontaminated(d, i).collect()}
    assert left == {a for a, _ in docs} - {w[0] for w in want}


def test_decontamination_with_shuffled_joins(spark, sf_dir, docs, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, decontaminate.contaminated(docs, items).collect())) == want
    assert decontaminate.decontaminated(docs, items).count() == docs.count() - len({w[0] for w in want})


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(None, "a b c d e f g h"), (7, "a b c d e f g h"), (7, None)], "item_id long, text string")
    got = decontaminate.contaminated(odd_docs, items).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in got) == [(9, 0), (9, 7)]
    left = decontaminate.decontaminated(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 1
    assert decontaminate.decontaminated(odd_docs, items.limit(0)).count() == odd_docs.count()
    assert decontaminate.contaminated(no_docs, items).count() == 0


def test_decontamination_runs_no_python(spark, sf_dir):
    from shelfscope.llm.queries import QUERIES

    for name in ("op8_benchmark_decontamination", "op10_lookup_sharding"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|ExistingRDD.*python", plan)


URLS = [
    None, "", "no scheme", "http://NET/x", "http://a.net", "http://a.net/", "https://example.net/en/1?q=/fr/",
    "https://www.Example.NET/en/", "http://notexample.com/de/1", "http://example.com/de/1#x", "http://x.org/fr/",
    "http://x.org/FR/", "ftp://spam-farm.example.org/en/1", "a://b://c.net/d", "http://x.com/ads/big-banner.gif",
    "http://buy-pills-online.example.com/", "http://casino-bonus.example.org/", "http://pills24.example.com/x",
    "http://x.com/Ad/1", "http://news.example.com/casino-opens-downtown", "http://adsworth.example.com/pillsbury",
    "http://BUY-now-online.com", "http://free--bets.org/", "http://x.com/adsorb/", "http://cheap-pillsx.example.com/", "://", "http://net?x/", "http://é.org/fr/é",
]


def brute_rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.partition("://")[2]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for _, rule in urlrules.PREFIXES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    verdicts = {p: v for v, p in urlrules.PREFIXES}
    for r in urlrules.filtered(pages).collect():
        assert (r.host, r.path, r.rule) == brute_rule(URLS[r.page_id])
        if r.rule:
            assert r.verdict == verdicts[r.rule] and r.pattern is None
        else:
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.path)
            every = [
                p for _, p in urlrules.PATTERNS
                if re.search(urlrules.expression(p), r.host + low if "/" in p else r.host, re.S)
            ]
            assert r.pattern == min(every, key=lambda p: (-len(p), p), default=None)
            assert r.verdict == ("block" if every else "allow")
    empty = pages.limit(0)
    assert urlrules.filtered(empty).count() == 0


def test_unwanted_hosts_that_no_list_names(spark):
    """General words decide, as whole words of a host or as path parts."""
    bad = ["casino-bonus.example.org", "pills24.example.com", "www.best-free-bets.net", "x.com/ad/1", "x.com/ADS/1/banner.gif"]
    good = ["news.example.org/casino-opens", "adsworth.example.org", "x.com/adsorb/", "pillsbury.example.com", "freebetsy.org"]
    pages = spark.createDataFrame([(i, "http://" + u) for i, u in enumerate(bad + good)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlrules.filtered(pages, prefixes=()).collect()}
    assert [got[i] for i in range(len(got))] == ["block"] * len(bad) + ["allow"] * len(good)


def test_index_chooses_among_shared_tokens():
    """Rules that share a token stand under their rarer one, so that few candidates run."""
    rules = [r for r in urlrules.PATTERNS if "online" in r[1]]
    counts = {t: 1 for _, p in rules for t in urlrules.literal_tokens(p)} | {"online": 100}
    index = urlrules.Index(rules, counts)
    assert "online" not in index.by_token and not index.always and len(rules) >= 5
    assert sorted(r[1] for rows in index.by_token.values() for r in rows) == sorted(p for _, p in rules)
    assert index.fit("online-poker.example.com", "/")[0] == "^online^poker^"


def test_rarest_token(spark):
    pages = spark.createDataFrame([(1, "http://Spam-farm.example.org/farm"), (2, "http://x.org/Farm")], "page_id long, url string")
    rules = (("block", "spam-farm.example"), ("block", "org/farm"))
    assert urlrules.token_counts(pages, rules) == {"farm": 2, "org": 2}
    index = urlrules.Index(rules, {"farm": 2, "org": 1})
    assert set(index.by_token) == {"farm", "org"}
    assert urlrules.Index((("block", "*"),), {}).always


def test_sharding_table():
    owner = sharding.table(sharding.names(48))
    counts = Counter(owner)
    assert len(counts) == 48 and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.table(sharding.names(47), len(owner))
    moved = sum(a != b for a, b in zip(owner, fewer))
    assert moved <= 2.2 * counts[47]
    with pytest.raises(ValueError):
        sharding.table(sharding.names(3), 100)


def test_sharding_rows(spark, odd_docs, no_docs, tmp_path):
    got = sharding.placed(odd_docs, shards=5).collect()
    assert len(got) == odd_docs.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_id.values())
    assert sharding.placed(no_docs).count() == 0
    path = str(tmp_path / "shards")
    sharding.write(odd_docs, path, shards=5, files=2)
    back = spark.read.parquet(path)
    assert back.count() == odd_docs.count()
    want = {(r.doc_id, r.shard) for r in got}
    assert {(r.doc_id, r.shard) for r in back.select("doc_id", F.col("shard")).collect()} == want
