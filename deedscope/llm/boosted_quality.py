"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are binned by quantiles of the labelled rows. Each level of each tree is one Spark
job: tasks sum gradients per (node, statistic, bin), Spark adds the sums, and the driver, which
sees only those sums, picks the splits. All labelled rows take part. Trees are flattened into
arrays that a task walks for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedscope.llm.common import extended, fold, parts
from deedscope.plans.lineage import cut_lineage

STATISTICS = [
    "log_words", "word_length", "log_longest_word", "upper", "digits", "stops", "marks", "bars", "symbols",
    "spaces", "newlines", "beyond_ascii", "distinct_words", "top_word", "repeated_word", "distinct_lines",
    "log_line_words", "distinct_pairs",
]
_CLASSES = [
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"!", b"|", b"#*$%&<>@^~_=+{}[]\\", b" \t", b"\n",
    bytes(range(128, 256)),
]
# Gradients are summed as whole numbers, so that a sum doesn't depend on its order.
_UNIT = 1 << 16


def text_statistics(text: str) -> list[float]:
    """The statistics of one whole text, all finite; an empty text has zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    from collections import Counter
    from operator import eq

    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    shares = [counts[np.frombuffer(c, np.uint8)].sum() / counts.sum() for c in _CLASSES]
    n, seen = len(words), Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log1p(n), sum(map(len, words)) / n, np.log1p(max(map(len, seen))), *shares, len(seen) / n,
        max(seen.values()) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / len(lines),
        np.log1p(n / len(lines)), len(set(zip(words, words[1:]))) / n,
    ]


def statistics(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``stats`` of every row; NULL texts count as empty."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            stats = [text_statistics(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(stats, pa.list_(pa.float32()))], names=["doc_id", "stats"]
            )

    return rows.mapInArrow(run, extended(rows.select("doc_id").schema, "stats array<float>"))


@dataclass
class Trees:
    """Complete trees of one depth as arrays: node i has the children 2i+1 and 2i+2."""

    edges: list[np.ndarray]
    depth: int
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    split: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def bins(self, stats: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(e, stats[:, j], side="left") for j, e in enumerate(self.edges)]
        return np.stack(columns, axis=1).astype(np.uint8) if len(stats) else np.zeros((0, len(self.edges)), np.uint8)

    def walk(self, bins: np.ndarray, tree: int, depth: int) -> np.ndarray:
        """The node each row has reached after ``depth`` steps."""
        node, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            node = 2 * node + 1 + (bins[row, self.feature[tree][node]] > self.split[tree][node])
        return node

    def margin(self, bins: np.ndarray, trees: int) -> np.ndarray:
        total = np.full(len(bins), self.base)
        for t in range(trees):
            total += self.leaf[t][self.walk(bins, t, self.depth) - (2**self.depth - 1)]
        return total


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fit(
    labelled: DataFrame, *, trees: int = 20, depth: int = 3, bins: int = 32, rate: float = 0.3, ridge: float = 1.0,
    least_rows: int = 5, rows_per_task: int = 50_000,
) -> Trees:
    """Fit on rows of ``stats`` and ``label`` (0 or 1); NULL labels are left out.

    Without rows, or with one class only, the model is the smoothed share of label 1.
    """
    width = len(STATISTICS)
    rows = labelled.filter(F.col("label").isNotNull()).select("stats", F.col("label").cast("int").alias("label"))
    cuts = [k / bins for k in range(1, bins)]
    found = rows.agg(
        F.count("*").alias("n"), F.sum("label").alias("ones"),
        *[F.percentile_approx(F.get("stats", j), cuts, 10_000).alias(f"q{j}") for j in range(width)],
    ).first()
    n, ones = found["n"], found["ones"] or 0
    edges = [np.unique(np.array(found[f"q{j}"] or [], np.float32)) for j in range(width)]
    model = Trees(edges, depth, base=float(np.log((ones + 0.5) / (n - ones + 0.5))))
    if ones in (0, n):
        return model

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = model.bins(_matrix(batch.column(0), width))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes() for x in packed], pa.binary()), batch.column(1)], names=["bins", "label"]
            )

    tasks = max(1, -(-n // rows_per_task))
    binned = cut_lineage(rows.mapInArrow(to_bins, "bins binary, label int").coalesce(tasks))
    for tree in range(trees):
        model.feature.append(np.zeros(2**depth - 1, np.int64))
        model.split.append(np.full(2**depth - 1, 255, np.int64))  # no split: all rows go left
        value = np.zeros(2 ** (depth + 1) - 1)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            sums = _histograms(binned, model, tree, level, bins)
            for node in range(nodes):
                _split(model, tree, first + node, sums[:, node], value, rate, ridge, least_rows)
        model.leaf.append(value[2**depth - 1 :])
    return model


def _histograms(binned: DataFrame, model: Trees, tree: int, level: int, bins: int) -> np.ndarray:
    """Sums of gradient, curvature and rows as [3, node, statistic, bin]."""
    width, nodes = len(STATISTICS), 2**level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, nodes * width * bins), np.int64)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width)
            y = batch.column(1).to_numpy()
            p = 1 / (1 + np.exp(-model.margin(x, tree)))
            slot = ((model.walk(x, tree, level) - (nodes - 1))[:, None] * width + np.arange(width)) * bins + x
            for k, v in enumerate((p - y, p * (1 - p), None)):
                w = np.ones(len(x)) if v is None else np.rint(v * _UNIT)
                added = np.bincount(slot.ravel(), np.repeat(w, width), minlength=total.shape[1])
                total[k] += np.rint(added).astype(np.int64)
        slots = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots), *[pa.array(total[k, slots]) for k in range(3)]], names=["slot", "g", "h", "n"]
        )

    rows = binned.mapInArrow(run, "slot long, g long, h long, n long").groupBy("slot")
    sums = np.zeros((3, nodes * width * bins))
    # At most nodes x statistics x bins rows.
    for row in rows.agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect():
        sums[:, row["slot"]] = row["g"] / _UNIT, row["h"] / _UNIT, row["n"]
    return sums.reshape(3, nodes, width, bins)


def _split(model, tree, node, sums, value, rate, ridge, least_rows) -> None:
    """Choose the node's best split, or none, and set its children's values."""
    g, h, n = sums  # [statistic, bin]
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    whole = sums.sum(axis=2)[:, :1]
    right = whole[:, :, None] - left
    worth = lambda s: s[0] ** 2 / (s[1] + ridge)
    gain = worth(left) + worth(right) - worth(whole)[:, None]
    gain[(left[2] < least_rows) | (right[2] < least_rows)] = 0
    best = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[best] > 1e-6:
        model.feature[tree][node], model.split[tree][node] = best
        sides = left[(slice(None), *best)], right[(slice(None), *best)]
    else:
        sides = whole[:, 0], np.zeros(3)
    for child, s in zip((2 * node + 1, 2 * node + 2), sides):
        value[child] = -rate * s[0] / (s[1] + ridge)


def score(stats: DataFrame, model: Trees) -> DataFrame:
    """``doc_id`` and ``score``, the probability of label 1, by flattened trees."""
    width = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = model.bins(_matrix(batch.column(1), width))
            p = 1 / (1 + np.exp(-model.margin(bins, len(model.leaf))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    rows = stats.select("doc_id", "stats")
    return rows.mapInArrow(run, extended(rows.select("doc_id").schema, "score double"))


def train_labels(labels: DataFrame, label: str) -> DataFrame:
    """One label per id from the training folds; ids labelled twice count with the greater label."""
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id") != 0))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )


def classify(
    docs: DataFrame, labels: DataFrame, *, label: str = "quality", threshold: float = 0.3, **options
) -> DataFrame:
    """Score every document: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    Learns from labelled rows whose crc32(doc_id) modulo 5 is not 0. Inputs of the score are the
    text's statistics only. One row per row of ``docs``; NULL texts count as empty, NULL ids are
    scored and have no label. Without labels the score is one half.
    """
    stats = cut_lineage(statistics(docs))
    model = fit(stats.join(train_labels(labels, label), "doc_id"), **options)
    return score(stats, model).select(
        "doc_id", (fold("doc_id") == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns as they are.

    The verdict is taken on the way, so that the texts are not shuffled.
    """
    model = fit(cut_lineage(statistics(docs)).join(train_labels(labels, "quality"), "doc_id"), **options)
    columns = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            text = batch.column(columns.index("text")).to_pylist()
            stats = np.array([text_statistics(x or "") for x in text], np.float32).reshape(-1, len(STATISTICS))
            p = 1 / (1 + np.exp(-model.margin(model.bins(stats), len(model.leaf))))
            yield batch.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
