"""Toxicity: maximum-scoring segment search over token log-odds.

Words and beginnings of words get log-odds of toxic against other labelled documents under an
informative Dirichlet prior (the counts of all labelled documents together). A token scores by its
word where that is known, else by its longest telling beginning. A linear scan finds every maximal scoring run of
tokens of a text. Scores are calibrated by extreme-value statistics: the expected number of runs
that a text of n ordinary tokens has at a score S is K n exp(-lambda S).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedscope.llm.boosted_quality import train_labels
from deedscope.llm.common import extended, fold, parts
from deedscope.plans.lineage import cut_lineage

TOKEN = r"\w+"
# Lengths of the beginnings of words that count as terms; in tables they are marked by a caret.
BEGINNINGS = range(4, 9)


def terms_of(tokens: set[str]) -> set[str]:
    """The terms of a text: its words, and the beginnings of its longer words."""
    return tokens | {"^" + t[:n] for t in tokens for n in BEGINNINGS if len(t) > n}


class _Scores(dict):
    """Token to score (None: not telling), looked up once while it stays in this bounded cache."""

    def __init__(self, terms: dict[str, float]) -> None:
        super().__init__()
        self.terms = terms

    def __missing__(self, token: str) -> float | None:
        found = self.terms.get(token)
        if found is None:
            parts = ("^" + token[:n] for n in reversed(BEGINNINGS) if len(token) > n)
            found = next((self.terms[p] for p in parts if p in self.terms), None)
        if len(self) >= 200_000:
            self.clear()
        self[token] = found = found if found else None
        return found


@dataclass
class Lexicon:
    """Scores above 0 of telling terms, 0 of known words that are not; all others cost ``drift``."""

    scores: dict[str, float] = field(default_factory=dict)
    drift: float = 1.0
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    weights: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def expected(self, score: float, tokens: int) -> float:
        return self.scale * max(tokens, 1) * math.exp(-min(self.rate * score, 700.0))


def maximal_segments(places: list[int], gains: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring runs as (first token, end, score), by one scan.

    ``places`` are the tokens with a gain, in order; every other token costs ``drift``. The scan
    keeps candidate runs with the totals before and after them, and merges a run into an earlier
    one that starts lower and ends no higher.
    """
    runs: list[list[float]] = []  # first, end, total before, total after, index of the last lower start
    total, last = 0.0, -1
    for place, gain in zip(places, gains):
        before = total - drift * (place - last - 1)
        total, last = before + gain, place
        run = [place, place + 1, before, total, -1]
        while True:
            j = len(runs) - 1
            while j >= 0 and runs[j][2] >= run[2]:
                j = int(runs[j][4])
            run[4] = j
            if j < 0 or runs[j][3] >= run[3]:
                runs.append(run)
                break
            run = [runs[j][0], run[1], runs[j][2], run[3], -1]
            del runs[j:]
    return [(int(r[0]), int(r[1]), r[3] - r[2]) for r in runs]


def text_segments(text: str, scores: _Scores, lexicon: Lexicon) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens of a text, and its maximal scoring runs."""
    tokens = re.findall(TOKEN, text.lower())
    found = list(map(scores.__getitem__, tokens))
    places = [i for i, s in enumerate(found) if s is not None] if any(found) else []
    return len(tokens), maximal_segments(places, [found[i] for i in places], lexicon.drift)


def evidence(tokens: int, segments: list[tuple[int, int, float]], lexicon: Lexicon) -> tuple[float, float]:
    """-ln of the chance of the best run in ordinary text, and the sum over significant runs."""
    if not segments:
        return 0.0, 0.0
    expected = [lexicon.expected(s, tokens) for _, _, s in segments]
    best = min(expected)
    surprise = -math.log(max(-math.expm1(-best), 1e-300))
    return min(surprise, 50.0), math.log1p(sum(max(0.0, -math.log(max(e, 1e-300))) for e in expected))


def sampled_labels(labels: DataFrame, label: str, max_labelled: int) -> DataFrame:
    """Training labels, thinned by a hash of the id to about ``max_labelled`` rows."""
    rows = cut_lineage(train_labels(labels, label))
    share = max_labelled / max(rows.count(), 1)
    if share >= 1:
        return rows
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def fit_lexicon(
    docs: DataFrame, labels: DataFrame, *, label: str = "toxic", max_labelled: int = 200_000,
    least_z: float = 3.0, least_odds: float = 1.0, prior_weight: float = 500.0, least_prior: float = 0.5,
    known_documents: int = 8, drift: float = 1.0,
) -> Lexicon:
    """Learn scores and calibration from labelled training rows.

    A term counts once per document, so that a word repeated all through one text tells no more
    than in any other. The prior of a term is its share of all terms times ``prior_weight``, plus
    ``least_prior``. A word in ``known_documents`` or more stands for itself, not its beginning.

    ``max_labelled`` bounds the labelled rows that the classifier is fitted on (their ids are
    broadcast), and with them the terms: all whose z is at least ``least_z``, and all known plain
    words that begin like one of them, which keeps their beginning's score from them. Without
    toxic rows the lexicon is empty and every text scores the smoothed share of toxic rows.
    """
    chosen = sampled_labels(labels, label, max_labelled)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    train = rows.join(F.broadcast(chosen), "doc_id").select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()

        def counted() -> pa.RecordBatch:
            tokens = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array(tokens, pa.string()), *[pa.array([c[t] for t in tokens], pa.int64()) for c in seen]]
            return pa.RecordBatch.from_arrays(columns, names=["token", "other", "toxic"])

        for batch in parts(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[toxic].update(terms_of(set(re.findall(TOKEN, text.lower()))))
            # A task holds so many terms at a time; the sums are added up later anyway.
            if len(seen[0]) + len(seen[1]) > 1_000_000:
                yield counted()
                seen = Counter(), Counter()
        yield counted()

    counts = cut_lineage(
        train.mapInArrow(count, "token string, other long, toxic long")
        .groupBy("token")
        .agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    )
    whole = counts.agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).first()
    n_other, n_toxic = whole["other"] or 0, whole["toxic"] or 0
    of_label = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    prior_odds = math.log((of_label.get(1, 0) + 0.5) / (of_label.get(0, 0) + 0.5)) if of_label else -3.0
    lexicon = Lexicon(drift=drift, weights=(prior_odds, 0.0, 0.0))
    if not n_toxic or not n_other:
        return lexicon

    alpha = F.lit(prior_weight / (n_toxic + n_other)) * (F.col("toxic") + F.col("other")) + F.lit(least_prior)
    log_odds = lambda y, n: F.log((y + alpha) / (F.lit(n + prior_weight) - y))
    delta = log_odds(F.col("toxic"), n_toxic) - log_odds(F.col("other"), n_other)
    spread = F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("other") + alpha))
    terms = (
        counts.withColumn("delta", delta)
        .withColumn("z", F.col("delta") / spread)
        .filter((F.col("z") >= least_z) & (F.col("delta") >= least_odds))
        .collect()
    )
    if not terms:
        return lexicon
    lexicon.scores = {r["token"]: r["delta"] for r in terms}
    starts = sorted({t[1:] for t in lexicon.scores if t[0] == "^"})
    if starts:
        own = F.col("toxic") + F.col("other") >= known_documents
        begins = [F.substring("token", 1, n).isin([x for x in starts if len(x) == n]) for n in BEGINNINGS]
        for row in counts.filter(own & reduce(or_, begins)).select("token").collect():
            lexicon.scores.setdefault(row["token"], 0.0)

    # lambda: the positive root of sum p(w) exp(lambda s(w)) = 1 over ordinary tokens.
    gains = np.array([r["delta"] for r in terms])
    shares = np.array([r["other"] + 0.5 for r in terms]) / (n_other + 0.5 * len(terms))
    low, high = 1e-6, 20.0
    moment = lambda x: (shares * np.exp(x * gains)).sum() + (1 - shares.sum()) * math.exp(-x * drift)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if moment(middle) < 1 else (low, middle)
    lexicon.rate = max(low, 1e-3)

    scored = cut_lineage(_segment_rows(train, lexicon))
    ordinary = scored.filter("label = 0").agg(
        F.sum("tokens").alias("tokens"), F.sum(F.size("scores")).alias("runs"),
        F.min(F.array_min("scores")).alias("least"),
    ).first()
    if ordinary["runs"]:
        # As many runs of at least the lowest score as ordinary text has.
        at_least = math.exp(-lexicon.rate * ordinary["least"])
        lexicon.scale = ordinary["runs"] / max(ordinary["tokens"], 1) / at_least
    else:
        lexicon.scale = 1.0 / max(ordinary["tokens"] or 1, 1)
    lexicon.weights = _calibrate(scored, lexicon, prior_odds)
    return lexicon


def _segment_rows(train: DataFrame, lexicon: Lexicon) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Scores(lexicon.scores)
        for batch in parts(batches):
            found = [text_segments(x, known, lexicon) for x in batch.column(0).to_pylist()]
            scores = pa.array([[s for _, _, s in segments] for _, segments in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([n for n, _ in found], pa.int64()), scores], names=["label", "tokens", "scores"]
            )

    return train.mapInArrow(run, "label int, tokens long, scores array<double>")


def _calibrate(scored: DataFrame, lexicon: Lexicon, prior_odds: float, rounds: int = 12) -> tuple:
    """Logistic weights of (1, best surprise, all surprise), by Newton steps over sums of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            facts = [evidence(n, [(0, 0, s) for s in scores], lexicon) for n, scores in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([f[k] for f in facts], pa.float64()) for k in range(2)]], names=["y", "x1", "x2"]
            )

    # Equal facts count together: most texts have none.
    points = cut_lineage(
        scored.mapInArrow(run, "y int, x1 double, x2 double")
        .groupBy("y", F.round("x1", 2).alias("x1"), F.round("x2", 2).alias("x2"))
        .count()
    )
    x = [F.lit(1.0), F.col("x1"), F.col("x2")]
    w = np.array([prior_odds, 0.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-sum(F.lit(float(a)) * b for a, b in zip(w, x))))
        sums = points.agg(
            *[F.sum((F.col("y") - p) * F.col("count") * a) for a in x],
            *[F.sum(p * (1 - p) * F.col("count") * x[i] * x[j]) for i in range(3) for j in range(3)],
        ).first()
        gradient = np.array(sums[:3]) - 0.1 * w * [0, 1, 1]
        curvature = np.array(sums[3:]).reshape(3, 3) + np.diag([1e-6, 0.1, 0.1])
        step = np.linalg.solve(curvature, gradient)
        w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return tuple(float(v) for v in w)


def toxic_passages(
    docs: DataFrame, lexicon: Lexicon, *, most_expected: float = 0.01, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Every row of ``docs`` with its score and its significant passages.

    Returns ``doc_id``, ``tokens``, ``score`` and ``passages``: an array of (first token, end
    token, score, expected number of such runs in ordinary text of that length), those expected
    at most ``most_expected`` times. NULL and empty texts have no passage and the score of a text
    without evidence. Other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    passage = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, c = lexicon.weights
        known = _Scores(lexicon.scores)
        for batch in parts(batches):
            tokens, scores, passages = [], [], []
            for text in batch.column(1).to_pylist():
                n, segments = text_segments(text, known, lexicon)
                x1, x2 = evidence(n, segments, lexicon)
                tokens.append(n)
                scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * x1 + c * x2)))))
                with_e = [(f, e, s, lexicon.expected(s, n)) for f, e, s in segments]
                passages.append([dict(zip(("first", "end", "score", "expected"), p)) for p in with_e if p[3] <= most_expected])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64()), pa.array(passages, pa.list_(passage))],
                names=["doc_id", "tokens", "score", "passages"],
            )

    ddl = "tokens long, score double, passages array<struct<first:int,end:int,score:double,expected:double>>"
    return rows.mapInArrow(run, extended(rows.select("doc_id").schema, ddl))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and the passages of every document."""
    lexicon = fit_lexicon(docs, labels, **options)
    return toxic_passages(docs, lexicon).select(
        "doc_id", (fold("doc_id") == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("passages").alias("n_passages"), "passages",
    )
