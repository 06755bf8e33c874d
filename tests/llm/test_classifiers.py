import random
import zlib

import numpy as np
import pytest

from deedscope.llm import boosted_quality, toxicity
from deedscope.llm.toxicity import maximal_segments
from tests.llm.fixtures import SCHEMA, clashing, frame, odd_rows, words

LABELS = "doc_id long, quality int, toxic int"


def labelled(n=400, seed=7):
    """Half of the rows carry rude words, a fifth are junk."""
    rng = random.Random(seed)
    rows, marks = [], []
    for k in range(1000, 1000 + n):
        w = words(rng, rng.randint(30, 120))
        toxic, good = int(k % 2), int(k % 5 != 1)
        if toxic:
            at = rng.randrange(len(w) - 10)
            for i in range(at, at + 8, 2):
                w[i] = rng.choice(["vile", "rotten", "Filthy,"])
        text = " ".join(w) if good else " | ".join(w).upper() + " !!" * 20
        rows.append((k, text, "en", "s", 1))
        marks.append((k, good, toxic))
    return rows, marks


def held_out_accuracy(got, marks, column):
    truth = {d: (q, t)[column] for d, q, t in marks}
    out = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    return sum(a == b for a, b in out) / len(out)


@pytest.mark.parametrize("module, column", [(boosted_quality, 0), (toxicity, 1)])
def test_held_out_accuracy_and_odd_rows(spark, module, column):
    rows, marks = labelled()
    docs = clashing(frame(spark, rows + odd_rows()), "label", "score", "stats", "tokens")
    marks_df = spark.createDataFrame(marks + [(None, 1, 0), (1, None, None), (1000, *marks[0][1:])], LABELS)
    got = module.classify(docs, marks_df).collect()
    assert len(got) == len(rows) + len(odd_rows())
    assert held_out_accuracy(got, marks, column) > 0.95
    for r in got:
        text = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(text.encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1


@pytest.mark.parametrize("module", [boosted_quality, toxicity])
def test_held_out_labels_are_not_read(spark, module):
    rows, marks = labelled(120)
    turned = [(d, 1 - q, 1 - t) if zlib.crc32(str(d).encode()) % 5 == 0 else (d, q, t) for d, q, t in marks]
    scores = []
    for m in (marks, turned):
        got = module.classify(frame(spark, rows), spark.createDataFrame(m, LABELS)).collect()
        scores.append(sorted((r["doc_id"], r["score"]) for r in got))
    assert scores[0] == scores[1]


@pytest.mark.parametrize("module", [boosted_quality, toxicity])
def test_empty_tables_and_one_class(spark, module):
    rows, marks = labelled(40)
    none = spark.createDataFrame([], LABELS)
    assert module.classify(spark.createDataFrame([], SCHEMA), none).collect() == []
    assert len(module.classify(frame(spark, rows), none).collect()) == 40
    zeros = spark.createDataFrame([(d, 0, 0) for d, *_ in marks], LABELS)
    assert all(r["score"] < 0.3 for r in module.classify(frame(spark, rows), zeros).collect())


def plain_trees(model, stats):
    """The flattened trees walked row by row."""
    out = []
    for row in stats:
        total = model.base
        for t in range(len(model.leaf)):
            node = 0
            for _ in range(model.depth):
                f = model.feature[t][node]
                bin_of = sum(float(row[f]) > float(e) for e in model.edges[f])
                node = 2 * node + 1 + (bin_of > model.split[t][node])
            total += model.leaf[t][node - (2**model.depth - 1)]
        out.append(total)
    return np.array(out)


def test_trees_against_a_plain_walk(spark):
    rng = np.random.default_rng(0)
    stats = rng.random((600, len(boosted_quality.STATISTICS))).astype(np.float32)
    y = ((stats[:, 0] > 0.5) ^ (stats[:, 3] > 0.3)).astype(int)
    rows = spark.createDataFrame([(s.tolist(), int(k)) for s, k in zip(stats, y)], "stats array<float>, label int")
    model = boosted_quality.fit(rows, trees=8)
    margin = model.margin(model.bins(stats), len(model.leaf))
    assert np.allclose(margin, plain_trees(model, stats))
    assert ((margin > 0) == y).mean() > 0.97
    again = boosted_quality.fit(rows.repartition(5), trees=8)
    assert np.allclose(margin, again.margin(again.bins(stats), len(again.leaf)), atol=1e-4)


def brute_segments(scores):
    """All maximal runs: recursively the best run, then left and right of it."""

    def solve(low, high):
        best = None
        for i in range(low, high):
            total = 0.0
            for j in range(i, high):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[2] + 1e-12):
                    best = (i, j + 1, total)
        return [] if best is None else solve(low, best[0]) + [best] + solve(best[1], high)

    return solve(0, len(scores))


def test_segments_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 40)
        gains = {i: rng.uniform(0.1, 6) for i in range(n) if rng.random() < 0.4}
        scores = [gains.get(i, -1.0) for i in range(n)]
        got = maximal_segments(sorted(gains), [gains[i] for i in sorted(gains)], 1.0)
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))


def test_passages_are_spans_of_tokens(spark):
    rows, marks = labelled()
    lexicon = toxicity.fit_lexicon(frame(spark, rows), spark.createDataFrame(marks, LABELS))
    assert {"vile", "rotten", "filthy"} <= set(lexicon.scores)
    text = " ".join(["plain"] * 40 + ["vile", "rotten", "so", "filthy"] + ["plain"] * 40)
    got = toxicity.toxic_passages(frame(spark, [(1, text, "en", "s", 1), (2, None, "en", "s", 1)]), lexicon).collect()
    by = {r["doc_id"]: r for r in got}
    assert [(p["first"], p["end"]) for p in by[1]["passages"]] == [(40, 44)]
    assert by[2]["passages"] == [] and by[2]["tokens"] == 0 and by[1]["score"] > 0.5 > by[2]["score"]
