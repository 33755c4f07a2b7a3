"""Toxicity: a lexicon trie intersected with Levenshtein automata, hits weighed by context.

The lexicon has whole words and stems (beginnings of words). ``SEEDS`` are given; others are
learned from labels: keys (whole words, and word beginnings of 3 to 8 letters) are counted
over all labelled texts, copies once, and kept if far more toxic than clean texts hold them.

The trie and the Levenshtein automaton of all its words form one automaton: its states are
sets of (trie node, errors), found as texts need them. A word may have one error from 5
letters on and two from 9 on; stems must fit exactly. Misspellings that clean labelled texts
hold (real words that are near a term) do not count.

A hit's weight, the term's log-odds, is scaled by its context window: less in quotation marks
or after a word of reporting, more beside a second person, in capitals or before exclamation
marks. A logistic model over sums of the hits gives the score; it is fitted on the
statistics of at most ``sample`` labelled texts.

Special cases: null and empty texts have no hits and are scored like any other; labels that
are null or whose document is missing are not used, an id with both labels counts as 1;
without labels of both kinds the model has fixed coefficients and the seeds as lexicon; an
empty table gives an empty result; repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from shelfscope.llm.common import arrow_map, small_side, utf8
from shelfscope.llm.langid import slices
from shelfscope.session import durable, stored

SAMPLE = 20_000
THRESHOLD = 0.5
#: fixed: common mild insults, all with the same weight until labels say more
SEEDS = (
    "arsehole", "bastard", "clown", "crétin", "cretin", "degenerate", "despicable", "disgusting",
    "dumbass", "dummkopf", "estúpido", "filth", "garbage", "idiot", "idiota", "idiote", "imbecile",
    "imbécil", "imbécile", "jackass", "loser", "moron", "parasite", "pathetic", "repulsive", "scum",
    "scumbag", "stupid", "trash", "trottel", "vermin", "worthless", "wretch",
)
SEED_WEIGHT = 3.0
#: fixed: words that report somebody's speech, and second persons
REPORTING = frozenset(
    "said says wrote writes called calls quote quoted quotes word words term phrase insult slur "
    "dit écrit mot sagte schrieb wort dijo escribió palabra".split()
)
SECOND = frozenset("you your yours u ur youre tu toi vous du dich ihr sie tú eres usted".split())
QUOTED, REPORTED, ADDRESSED, EMPHASIS, MISSPELT = 0.4, 0.5, 1.5, 1.2, 0.7
WINDOW = 6
STEMS = range(3, 9)
#: a learned key: evidence (log-likelihood ratio) and log-odds it needs
EVIDENCE, ODDS = 25.0, 2.5
#: keys and spellings that may reach the driver, the strongest first
MAX_KEYS = 20_000
TOP_WEIGHT = 6.0
_WORD = re.compile(r"[^\W_]+(?:[*@$!][^\W_]+)*")
_OPENING, _CLOSING = "\"“„«‘", "\"”“»’"
_HELD = 400_000
_MAX_STATES = 50_000
_MAX_WORDS = 200_000


def allowed(term: str) -> int:
    """Errors that a spelling of a whole word may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Lexicon:
    """Weights of whole words and of stems; ``real``: spellings near a word that are none."""

    words: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    real: frozenset[str] = frozenset()


class Automaton:
    """The product of the trie and the Levenshtein automaton, states made when needed."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.child: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.bound = [0]  # errors that some word below a node may have
        for term in lexicon.words:
            self.word[self._node(term, allowed(term))] = term
        for term in lexicon.stems:
            self.stem[self._node(term, 0)] = term
        self._clear()

    def _node(self, term: str, errors: int) -> int:
        at = 0
        self.bound[0] = max(self.bound[0], errors)
        for c in term:
            if c not in self.child[at]:
                self.child[at][c] = len(self.child)
                self.child.append({})
                self.word.append(None)
                self.stem.append(None)
                self.bound.append(0)
            at = self.child[at][c]
            self.bound[at] = max(self.bound[at], errors)
        return at

    def _clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.step: list[dict[str, int]] = []
        self.final: list[tuple[str, int] | None] = []
        self.begun: list[str | None] = []
        self.start = self._state({0: 0})
        self.known: dict[str, tuple[str, float, int] | None] = {}

    def _state(self, found: dict[int, int]) -> int:
        # a letter of the term may be missing: one error more, as deep as that goes
        todo = list(found.items())
        while todo:
            node, errors = todo.pop()
            for child in self.child[node].values():
                if errors < self.bound[child] and found.get(child, 9) > errors + 1:
                    found[child] = errors + 1
                    todo.append((child, errors + 1))
        key = tuple(sorted(found.items()))
        at = self.states.get(key)
        if at is None:
            at = self.states[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            ends = [(e, self.word[n]) for n, e in key if self.word[n] and e <= allowed(self.word[n])]
            self.final.append(min(ends)[::-1] if ends else None)
            stems = [self.stem[n] for n, e in key if self.stem[n] and not e]
            self.begun.append(stems[0] if stems else None)
        return at

    def _next(self, state: int, c: str) -> int:
        found: dict[int, int] = {}
        for node, errors in self.sets[state]:
            exact = self.child[node].get(c)
            if exact is not None:
                found[exact] = min(errors, found.get(exact, 9))
            if errors < self.bound[node]:  # a letter too many
                found[node] = min(errors + 1, found.get(node, 9))
            for child in self.child[node].values():  # another letter
                if errors < self.bound[child]:
                    found[child] = min(errors + 1, found.get(child, 9))
        to = self.step[state][c] = self._state(found)
        return to

    def match(self, word: str) -> tuple[str, float, int] | None:
        """The term that a lower-case word spells, its weight and the errors."""
        if word in self.known:
            return self.known[word]
        if len(self.sets) > _MAX_STATES or len(self.known) > _MAX_WORDS:
            self._clear()
        at, stem = self.start, None
        for c in word:
            to = self.step[at].get(c)
            at = self._next(at, c) if to is None else to
            stem = self.begun[at] or stem
            if not self.sets[at]:
                break
        end, hit = self.final[at], None
        if end and end[1] and word in self.lexicon.real:
            end = None
        if end and (not end[1] or not stem):
            hit = (end[0], self.lexicon.words[end[0]], end[1])
        elif stem:
            hit = (stem, self.lexicon.stems[stem], 0)
        self.known[word] = hit
        return hit


def _quoted(text: str, start: int, end: int) -> bool:
    """Is the span inside quotation marks that open and close in its line, near it?"""
    left = text[max(0, start - 200) : start].rpartition("\n")[2]
    right = text[end : end + 200].partition("\n")[0]
    if left.count('"') % 2 and '"' in right:
        return True
    return any(
        left.rfind(a) > left.rfind(b) and b in right for a, b in zip(_OPENING[1:], _CLOSING[1:]) if a != b
    )


def hits(text: str, automaton: Automaton) -> tuple[list[tuple[str, float, int, float]], int]:
    """``(spelling, weight, errors, context factor)`` of every hit, and the number of words."""
    out, spans = [], [(m.start(), m.end()) for m in _WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    match = automaton.match
    for i, word in enumerate(words):
        hit = match(word)
        if hit is None:
            continue
        a, b = spans[i]
        factor = 1.0
        if _quoted(text, a, b):
            factor *= QUOTED
        if not REPORTING.isdisjoint(words[max(0, i - WINDOW) : i]):
            factor *= REPORTED
        if not SECOND.isdisjoint(words[max(0, i - WINDOW) : i + WINDOW + 1]):
            factor *= ADDRESSED
        if (b - a > 3 and text[a:b].isupper()) or text.startswith("!!", b):
            factor *= EMPHASIS
        out.append((word, hit[1] * (MISSPELT if hit[2] else 1.0), hit[2], factor))
    return out, len(words)


STATISTICS = ("log_sum", "strongest", "density", "spellings", "hits")


def statistics(text: str | None, automaton: Automaton) -> list[float]:
    found: list[tuple[str, float, int, float]] = []
    words = 0
    for part in slices(text or ""):
        own, n = hits(part, automaton)
        found += own
        words += n
    if not found:
        return [0.0] * len(STATISTICS)
    scores = [w * f for _, w, _, f in found]
    return [
        math.log1p(sum(scores)),
        max(scores),
        math.log1p(100.0 * sum(scores) / words),
        math.log1p(len({w for w, *_ in found})),
        math.log1p(len(found)),
    ]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray  # of the statistics, and the constant

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.coefficients[:-1] + self.coefficients[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


#: without labels: two seeds without special context make a score over a half
DEFAULT = np.array([1.5, 0.2, 0.2, 0.2, 0.2, -4.0])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method, drawn towards ``DEFAULT`` as if by one row.

    A step that does not lower the loss is halved: far from the optimum, where nearly all
    probabilities are 0 or 1, a whole one leads away from it.
    """
    if len(set(y.tolist())) < 2:
        return DEFAULT
    x = np.hstack([x, np.ones((len(x), 1))])
    weights = DEFAULT
    penalty = ridge * np.eye(x.shape[1])

    def loss(w: np.ndarray) -> float:
        margin = x @ w
        return float((np.logaddexp(0, margin) - y * margin).sum() + 0.5 * ridge * ((w - DEFAULT) ** 2).sum())

    now = loss(weights)
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ weights, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (y - p) - penalty @ (weights - DEFAULT))
        while (new := loss(weights + step)) > now and np.abs(step).max() >= 1e-8:
            step = step / 2
        if np.abs(step).max() < 1e-8:
            break
        weights, now = weights + step, new
    return weights


def keys_of(text: str) -> set[str]:
    """Whole words, marked by a blank, and word beginnings."""
    out = set()
    for word in {w.lower() for w in _WORD.findall(text)}:
        out.add(word[:40] + " ")
        out.update(word[:k] for k in STEMS if k < len(word))
    return out


def evidence(t: float, n: float, texts: tuple[float, float]) -> tuple[float, float]:
    """Log-likelihood ratio and log-odds of a key in ``t`` toxic and ``n`` clean texts."""
    total, share = t + n, texts[0] / (texts[0] + texts[1])
    ratio = sum(2 * a * math.log(a / (total * s)) for a, s in ((t, share), (n, 1 - share)) if a)
    odds = math.log((t + 0.5) / (texts[0] + 1)) - math.log((n + 0.5) / (texts[1] + 1))
    return ratio, odds


def choose(counts: dict[str, tuple[int, int]], texts: tuple[float, float]) -> Lexicon:
    """Words, and stems that many different words share, from counts per key."""
    good = {}
    for key, (t, n) in counts.items():
        ratio, odds = evidence(t, n, texts)
        if ratio >= EVIDENCE and odds >= ODDS:
            good[key] = odds
    words, stems = {s: SEED_WEIGHT for s in SEEDS}, {}
    by_stem: dict[str, float] = {}  # most texts that one longer key has
    for key in good:
        for k in STEMS:
            if k < len(key):
                by_stem[key[:k]] = max(by_stem.get(key[:k], 0), counts[key][0])
    for key in sorted(good, key=lambda k: (len(k), k)):
        if any(key[:k] in stems for k in STEMS):
            continue
        weight = min(TOP_WEIGHT, good[key])
        if key.endswith(" "):
            words[key[:-1]] = weight
        elif by_stem.get(key, 0) < 0.8 * counts[key][0]:
            stems[key] = weight
    for seed in SEEDS:
        t, n = counts.get(seed + " ", (0, 0))
        if n >= 5 and evidence(t, n, texts)[1] < 1.0:
            del words[seed]
    return Lexicon(words, stems)


def _signature(text: str) -> int:
    """The least hash of a text's three-word shingles: copies share it, near copies mostly."""
    words = utf8(text).split()
    if len(words) < 3:
        return xxhash.xxh3_64_intdigest(b" ".join(words)) >> 1
    h = xxhash.xxh3_64_intdigest
    return min(h(b"%b %b %b" % x) for x in zip(words, words[1:], words[2:])) >> 1


def _counts(texts: DataFrame, keys: str, lexicon: Lexicon | None) -> DataFrame:
    """``(key, t, n)``: toxic and clean texts that hold a key, summed in the tasks first."""
    schema = "key string, t long, n long"
    target = pa.schema([("key", pa.string()), ("t", pa.int64()), ("n", pa.int64())])

    def emit(held: dict[str, list[int]]) -> pa.RecordBatch:
        values = list(held.values())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([v[0] for v in values], pa.int64()),
             pa.array([v[1] for v in values], pa.int64())], schema=target,
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(lexicon) if lexicon else None
        held: dict[str, list[int]] = {}
        for batch in batches:
            for y, text in zip(batch[0], batch[1], strict=True):
                y, text = y.as_py(), text.as_py() or ""
                for part in slices(text) if len(text) > 1 << 18 else (text,):
                    if automaton:
                        own = {w for w, _, errors, _ in hits(part, automaton)[0] if errors}
                    else:
                        own = keys_of(part)
                    for key in own:
                        held.setdefault(key, [0, 0])[1 - y] += 1
                    if len(held) > _HELD:
                        yield emit(held)
                        held = {}
        if held:
            yield emit(held)

    found = texts.select("y", "text").mapInArrow(count, schema)
    return found.groupBy("key").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))


def learn(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
    text_col: str = "text", sample: int = SAMPLE,
) -> Model:
    """Lexicon and model from the documents of ``labels``."""
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    marked = rows.join(small_side(durable(known)), "id")
    schema = StructType([marked.schema["id"], StructField("y", IntegerType()), StructField("sig", LongType())])
    signed = arrow_map(
        marked, [F.col("id"), F.col("y"), F.col("text")],
        lambda ids, ys, texts: (ids, ys, [_signature(t) for t in texts]), schema,
    )
    once = durable(signed.groupBy("y", "sig").agg(F.min("id").alias("id")).select("id", "y"))
    texts = stored(rows.join(small_side(once), "id").select("id", "y", "text"), "labelled")
    sizes = dict(texts.groupBy("y").count().collect())
    both = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not all(both):
        return Model(Lexicon({s: SEED_WEIGHT for s in SEEDS}), DEFAULT)
    # few keys are near the limit: those in one or two toxic texts, or mostly clean, never are
    counts = _counts(texts, "key", None).filter(
        (F.col("t") >= 3) & (F.col("t") * both[1] >= F.col("n") * both[0]) | F.col("key").isin([s + " " for s in SEEDS])
    )
    strong = counts.orderBy(F.desc(F.col("t") / (F.col("n") + 1)), "key").limit(MAX_KEYS)
    lexicon = choose({r.key: (r.t, r.n) for r in strong.collect()}, both)
    # spellings near a term that clean texts hold, as far as they speak against it
    near = _counts(texts, "key", lexicon).filter(F.col("n") * both[0] * 5 >= F.col("t") * both[1])
    real = near.orderBy(F.desc("n"), "key").limit(MAX_KEYS).collect()
    lexicon = Lexicon(lexicon.words, lexicon.stems, frozenset(r.key for r in real))
    # the sample is chosen by id alone: at most ``sample`` rows of one column
    chosen = texts.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    measured = _measured(texts.join(F.broadcast(chosen), "id"), lexicon, ["id", "y"])
    # a repeated id would add rows beyond the bound: one row for each
    found = measured.groupBy("id").agg(F.min_by("y", "x").alias("y"), F.min("x").alias("x")).collect()
    x = np.array([r.x for r in found], float).reshape(len(found), len(STATISTICS))
    return Model(lexicon, fit(x, np.array([r.y for r in found], float)))


def _measured(texts: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    held: list[Automaton] = []

    def work(texts: list, *others: list) -> tuple:
        if not held:
            held.append(Automaton(lexicon))
        return *others, [statistics(t, held[0]) for t in texts]

    schema = StructType([*(texts.schema[c] for c in keep), StructField("x", ArrayType(DoubleType()))])
    return arrow_map(texts, [F.col("text"), *map(F.col, keep)], work, schema)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row."""
    held: list[Automaton] = []

    def work(ids: list, texts: list) -> tuple:
        if not held:
            held.append(Automaton(model.lexicon))
        x = np.array([statistics(t, held[0]) for t in texts]).reshape(len(texts), len(STATISTICS))
        return ids, model.score(x)

    schema = StructType([docs.schema[id_col], StructField("score", DoubleType())])
    return arrow_map(docs, [F.col(id_col), F.col(text_col)], work, schema)
