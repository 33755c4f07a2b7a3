"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the text alone. Trees are fitted on at most ``sample`` labelled rows
(those with the least hash of their id), with ``bins`` quantile bins per statistic and
logistic loss; levels are grown together, each split chosen from gradient histograms. The
fitted trees are complete binary trees in flat arrays, so that a batch of documents walks all
trees at once in numpy.

Null and empty texts have all statistics zero and are scored like any other; labels that are
null or whose document is missing are not used, an id with both labels counts as 1; with no label at all every score is 0.5, and
with labels of one kind only the score is near that label; repeated rows each get their row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from shelfscope.llm.common import arrow_map, utf8
from shelfscope.llm.linerules import repeat_words

SAMPLE = 20_000
THRESHOLD = 0.3
STATISTICS = (
    "log_words", "word_length", "symbol_share", "upper_share", "digit_share", "stop_share",
    "comma_share", "doubled_share", "bar_share", "distinct_share", "repeat_share", "log_lines",
    "line_words", "ended_lines", "distinct_lines", "longest_word",
)
_SYMBOL = re.compile(rb"[#*$%&<>]")
_UPPER = re.compile(rb"[A-Z]")
_DIGIT = re.compile(rb"[0-9]")
_DOUBLED = re.compile(rb"[!?#*$%&]{2}")
_ENDED = re.compile(rb"[.!?:;\"')][ \t\r]*(?:\n|\Z)")


def statistics(text: str | None) -> list[float]:
    raw = utf8(text or "")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    size = sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)),
        size / n,
        len(_SYMBOL.findall(raw)) / size,
        len(_UPPER.findall(raw)) / size,
        len(_DIGIT.findall(raw)) / size,
        raw.count(b".") / n,
        raw.count(b",") / n,
        len(_DOUBLED.findall(raw)) / n,
        raw.count(b"|") / n,
        len(set(words)) / n,
        repeat_words(words) / n,
        float(np.log1p(len(lines))),
        n / len(lines),
        len(_ENDED.findall(raw)) / len(lines),
        len(set(lines)) / len(lines),
        float(min(100, max(map(len, words)))),
    ]


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: split statistic and cut per inner node, value per leaf."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        trees = np.arange(len(self.leaf))[None, :]
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        for _ in range(int(np.log2(self.feature.shape[1] + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        margin = self.start + self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-margin))


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15,
    ridge: float = 1.0, least: float = 2.0,
) -> Trees:
    """Boosted trees for labels 0 and 1. ``least``: smallest sum of second derivatives."""
    inner, n, width = 2**depth - 1, len(y), x.shape[1]
    if not n:
        return Trees(np.zeros((1, inner), np.int64), np.zeros((1, inner)), np.zeros((1, inner + 1)), 0.0)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = (y.sum() + 0.5) / (n + 1.0)
    start = float(np.log(share / (1 - share)))
    margin = np.full(n, start)
    features, limits, leaves = [], [], []
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-12)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            size = 2**level
            at = node - (size - 1)
            gain = np.full(size, 1e-9)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                k = len(cuts[f]) + 1
                key = at * k + binned[:, f]
                gl = np.bincount(key, g, size * k).reshape(size, k).cumsum(axis=1)
                hl = np.bincount(key, h, size * k).reshape(size, k).cumsum(axis=1)
                gs, hs = gl[:, -1:], hl[:, -1:]
                gl, hl = gl[:, :-1], hl[:, :-1]
                won = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                won[(hl < least) | (hs - hl < least)] = 0.0
                best = won.argmax(axis=1)
                value = won[np.arange(size), best]
                better = value > gain
                gain[better] = value[better]
                own = np.flatnonzero(better)
                feature[size - 1 + own] = f
                cut[size - 1 + own] = cuts[f][best[own]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        margin += leaf[at]
        features.append(feature)
        limits.append(cut)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(limits), np.array(leaves), start)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
) -> Trees:
    """Trees from the documents of ``labels``; statistics of at most ``sample`` rows reach
    the driver."""
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .filter("id is not null and y in (0, 1)")
        .groupBy("id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    # at most ``sample`` rows of two numbers
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id")

    def work(ids: list, ys: list, texts: list) -> tuple:
        return ids, ys, [statistics(t) for t in texts]

    schema = StructType(
        [rows.schema["id"], StructField("y", IntegerType()), StructField("x", ArrayType(DoubleType()))]
    )
    known = arrow_map(rows, [F.col("id"), F.col("y"), F.col("text")], work, schema)
    # a repeated id would add rows beyond the bound: one row for each
    first = known.groupBy("id").agg(F.min_by("y", "x").alias("y"), F.min("x").alias("x"))
    found = sorted(first.collect())
    x = np.array([r.x for r in found], float).reshape(len(found), len(STATISTICS))
    return fit(x, np.array([r.y for r in found], float))


def scored(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row."""

    def work(ids: list, texts: list) -> tuple:
        return ids, trees.score(np.array([statistics(t) for t in texts]))

    schema = StructType([docs.schema[id_col], StructField("score", DoubleType())])
    return arrow_map(docs, [F.col(id_col), F.col(text_col)], work, schema)
