"""URL filters: rules indexed by their rarest literal token.

A rule is ``(verdict, pattern)``. A pattern with a ``/`` that does not begin with one and has
no ``*`` or ``^`` is a host and path prefix, such as ``example.net/en/``: it fits that host and
its subdomains if the path starts with the prefix. Any other pattern is looked for in the host,
or, if it has a ``/``, in host and path, A-Z as a-z; ``*`` stands for any characters, ``^`` for
one or more characters that are no letters, or for an end.

Tokens are runs of letters and runs of digits. Of a rule's literal tokens, the one rarest in
the URLs at hand is its index entry (the rules' tokens are counted over all rows, in Spark). A
URL's tokens fetch candidate rules, and only their regular expressions run. The longest pattern
that fits wins, at equal length the first in code-point order.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: what
follows up to ``?``, ``#`` or the end. Null, or no ``://``: both empty, no rule, verdict of
``default``. Repeated rows each get their row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shelfscope.llm.common import arrow_map

Rule = tuple[str, str]
#: Host and path rules.
PREFIXES: tuple[Rule, ...] = (
    ("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"),
)
#: Words and word pairs that unwanted sites of a kind carry in their names, and path parts of
#: advertising: general vocabulary of each kind, no list of sites.
KINDS: dict[str, tuple[str, ...]] = {
    "gambling": (
        "^bet^bonus^", "^betting^", "^blackjack^", "^casino^", "^casinos^", "^free^bet^", "^free^bets^",
        "^free^spins^", "^jackpot^", "^online^bets^", "^online^lottery^", "^online^poker^", "^online^slots^",
        "^poker^bonus^", "^roulette^", "^sports^bets^",
    ),
    "adult": (
        "^adult^", "^adult^dating^", "^adult^video^", "^cam^girls^", "^escorts^", "^hentai^", "^nude^",
        "^porn^", "^porno^", "^sex^", "^sex^cams^", "^xxx^",
    ),
    "medicine": (
        "^buy^*^online^", "^cheap^meds^", "^cheap^pills^", "^cialis^", "^diet^pills^", "^discount^pharmacy^",
        "^online^pharmacy^", "^pills^", "^viagra^", "^xanax^",
    ),
    "money": (
        "^cheap^replica^", "^easy^money^", "^fast^cash^", "^free^money^", "^make^money^", "^payday^loan^",
        "^payday^loans^", "^quick^loans^", "^replica^watches^",
    ),
    "spam": (
        "^cracks^", "^free^download^", "^keygen^", "^link^farm^", "^malware^", "^phishing^", "^spam^", "^spam^farm^",
        "^spam^links^", "^torrents^", "^warez^",
    ),
    "advertising": (
        "/ad/", "/ads/", "/ads/*banner", "/adserver/", "/affiliate/", "/banners/", "/popunder/", "/popup/",
        "/sponsored/", "^ad^server^", "^ads^", "^ads^server^", "^ads^track^", "^adserver^", "^adservice^",
        "^banner^ads^", "^click^track^", "^pop^ads^", "^track^ads^", "^tracker^",
    ),
}
#: Patterns of unwanted sites for the URLs that no host and path rule fits.
PATTERNS: tuple[Rule, ...] = tuple(("block", p) for kind in KINDS.values() for p in kind)
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+")
_CASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_UPPER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    m = _URL.search(url) if url else None
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def is_prefix(pattern: str) -> bool:
    return "/" in pattern and not pattern.startswith("/") and not set("*^") & set(pattern)


def expression(pattern: str) -> str:
    """The regular expression of a pattern, in a form that SQL engines take as well."""
    if is_prefix(pattern):
        host, slash, path = pattern.partition("/")
        return rf"^(?:[^/]*\.)?{re.escape(host)}{slash}{re.escape(path)}"
    out = []
    for i, c in enumerate(pattern):
        if c == "^":
            edge = "^|" if i == 0 else "$|" if i == len(pattern) - 1 else ""
            out.append(f"(?:{edge}[^A-Za-z]+)")
        else:
            out.append(".*" if c == "*" else c if c.isalnum() else f"[{c}]")
    return "".join(out)


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that a URL must have whole if the pattern fits: those with another literal, a
    ``^``, or the bounds of a host rule on both sides."""
    bounded = f".{pattern}*" if is_prefix(pattern) else f"*{pattern}*"
    found = []
    for m in _TOKEN.finditer(bounded):
        beside = bounded[m.start() - 1], bounded[m.end()]
        digits = m.group().isdigit()
        if "*" not in beside and not (digits and "^" in beside):
            found.append(m.group())
    return found


def token_counts(urls: DataFrame, rules: Sequence[Rule], url_col: str = "url") -> dict[str, int]:
    """In how many URLs' host and path, as they are or in lower case, each literal token of the
    rules occurs; a row per token of the rules reaches the driver."""
    wanted = sorted({t for _, p in rules for t in literal_tokens(p)})
    rest = F.regexp_extract(F.col(url_col), r"(?s)://([^?#]*)", 1)
    host = F.translate(F.substring_index(rest, "/", 1), *_CASES)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    whole = F.concat(host, path)
    either = F.concat(whole, F.lit("\n"), F.translate(whole, *_CASES))
    tokens = F.regexp_extract_all(either, F.lit("[A-Za-z]+|[0-9]+"), F.lit(0))
    own = urls.select(F.explode(F.array_distinct(tokens)).alias("token")).filter(F.col("token").isin(wanted))
    return {r.token: r.n for r in own.groupBy("token").agg(F.count("*").alias("n")).collect()}


class Index:
    """Rules by their rarest token; those without a literal token run for every URL."""

    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]) -> None:
        self.by_token: dict[str, list] = {}
        self.always: list = []
        for verdict, pattern in sorted(set(rules), key=lambda r: (-len(r[1]), r[1], r[0])):
            rule = (len(pattern), pattern, verdict, re.compile(expression(pattern), re.DOTALL))
            tokens = literal_tokens(pattern)
            if tokens:
                rarest = min(tokens, key=lambda t: (counts.get(t, 0), t))
                self.by_token.setdefault(rarest, []).append(rule)
            else:
                self.always.append(rule)

    def fit(self, host: str, path: str) -> tuple[str, str] | None:
        """The pattern that decides, and its verdict."""
        whole = host + path
        found = [*self.always]
        for token in set(_TOKEN.findall(whole)):
            found += self.by_token.get(token, ())
        for _, pattern, verdict, rx in sorted(found, key=lambda r: (-r[0], r[1], r[2])):
            if rx.search(whole if "/" in pattern else host):
                return pattern, verdict
        return None


def filtered(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    prefixes: Sequence[Rule] = PREFIXES,
    patterns: Sequence[Rule] = PATTERNS,
    default: str = "allow",
) -> DataFrame:
    """``(id, host, path, rule, verdict, pattern)`` per row. ``rule`` is the host and path
    rule that decided, ``pattern`` the other one that did."""
    counts = token_counts(pages, [*prefixes, *patterns], url_col)
    first, second = Index(prefixes, counts), Index(patterns, counts)

    def work(ids: list, urls: list) -> tuple:
        out = []
        for url in urls:
            host, path = parts(url)
            rule = first.fit(host, path)
            other = None if rule else second.fit(host, path.translate(_UPPER))
            verdict = rule[1] if rule else other[1] if other else default
            out.append((host, path, rule and rule[0], verdict, other and other[0]))
        return ids, *([r[k] for r in out] for k in range(5))

    names = ("host", "path", "rule", "verdict", "pattern")
    schema = StructType([pages.schema[id_col], *(StructField(n, StringType()) for n in names)])
    return arrow_map(pages, [F.col(id_col), F.col(url_col)], work, schema)
