import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from deedscope.llm.lm_score import END, Hashed, cold_id, fit, fit_whole, score_documents, seat, words_of
from tests.llm.fixtures import SCHEMA, clashing, frame, odd_rows, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["\n"]


def corpus():
    """Two kinds of text with words of their own, so that a word tells the next ones."""
    rng = random.Random(5)
    kinds = [words(rng, 40, "abcd"), words(rng, 40, "wxyz")]
    rows = [
        (k, " ".join(rng.choices(kinds[k % 2][:8], k=60) + rng.choices(kinds[k % 2], k=60)), "en", "s", 1)
        for k in range(100, 260)
    ]
    for k, (doc, text, *rest) in enumerate(rows):
        parts = text.split()
        rng.shuffle(parts)
        rows[k] = (doc, " ".join(parts), *rest)
    return rows


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1


@pytest.mark.parametrize("options", [{}, {"known": 12, "dishes": 5, "contexts": 3}, {"known": 0}])
def test_base_against_brute_force(spark, options):
    rows = odd_rows() + corpus()
    docs = clashing(frame(spark, rows), "word", "n", "u", "w", "base", "score")
    got = score_documents(docs, sweeps=2, burn_in=1, **options).collect()
    seen = Counter(t for d, x, *_ in rows if not held(d) for t in tokens(x))
    n, v = sum(seen.values()), len(seen)
    want = []
    for doc, text, *_ in rows:
        ts = tokens(text)
        base = sum(math.log10((seen[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        want.append((str(doc), held(doc), len(ts), sum(t in seen for t in ts), n, round(base, 4)))
    names = ("held_out", "n_tokens", "n_known", "train_tokens")
    assert sorted((str(r["doc_id"]), *[r[c] for c in names], round(r["base_score"], 4)) for r in got) == sorted(want)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)


def test_model_beats_the_base_on_held_out_rows(spark):
    got = score_documents(frame(spark, corpus()), dishes=40, contexts=16).filter("held_out").collect()
    per_token = [sum(r[c] for r in got) / sum(r["n_tokens"] for r in got) for c in ("score", "base_score")]
    assert per_token[0] > per_token[1] + 0.1
    for r in got:
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]))


def test_probabilities_sum_to_one_and_score_is_their_product(spark):
    rows = corpus()
    texts = frame(spark, rows).select("doc_id", "text")
    model, _ = fit(texts, dishes=30, contexts=6, sweeps=3, burn_in=1)
    p = 10.0 ** model.log_p.astype(float)
    assert p.shape == (7, 31) and np.allclose(p.sum(axis=1), 1, atol=1e-4)
    # The words that are no dishes, and one more that is in no text, share one.
    rare = model.counts[model.dishes :]
    of_rare, of_unseen = model.rare_count(rare)
    assert (of_rare.sum() + of_unseen) / model.rare_size() == pytest.approx(1)

    options = dict(dishes=30, contexts=6, sweeps=3, burn_in=1)
    got = {r["doc_id"]: r["score"] for r in score_documents(frame(spark, rows, 2), held_out=9, **options).collect()}
    for doc, text, *_ in rows:
        total, context = 0.0, 0
        for t in words_of(text) + [END]:
            at = model.words.get(t, -1)
            if 0 <= at < model.dishes:
                total += model.log_p[context, at]
            else:
                share = model.rare_count(model.counts[at])[0] if at >= 0 else of_unseen
                total += model.log_p[context, model.dishes] + math.log10(share / model.rare_size())
            context = at + 1 if 0 <= at < model.contexts else context
        assert got[doc] == pytest.approx(total, rel=1e-5)


def test_held_out_rows_are_not_learned_from(spark):
    rows = corpus()
    changed = [(d, "zz " * 50, *rest) if held(d) else (d, t, *rest) for d, t, *rest in rows]
    scores = []
    for r in (rows, changed):
        got = score_documents(frame(spark, r), sweeps=2, burn_in=1).filter(~F.col("held_out")).collect()
        scores.append(sorted((r["doc_id"], round(r["score"], 6)) for r in got))
    assert scores[0] == scores[1]


def test_seating_has_the_mean_of_the_restaurant():
    """A dish alone in its restaurant: tables of c customers against the recursion of the mean."""
    d, strength, base, tables, c = 0.5, 1.0, 0.1, 20.0, 40
    weight = (strength + d * tables) * base
    law = np.zeros(c + 2)
    law[1] = 1.0
    for i in range(1, c):
        p = weight / (weight + i - d * np.arange(len(law)))
        p[: 1] = 0
        p = np.clip(p, 0, 1)
        law = law * (1 - p) + np.concatenate([[0], (law * p)[:-1]])
    mean = (law * np.arange(len(law))).sum()
    rng = np.random.default_rng(0)
    n = 4000
    drawn = seat(np.full(n, c), np.full(n, base), np.full(n, tables), d, strength, rng)
    assert drawn.min() >= 1 and drawn.max() <= c
    assert drawn.mean() == pytest.approx(mean, rel=0.05)
    assert (seat(np.array([0, 1]), np.full(2, base), np.full(2, tables), d, strength, rng) == [0, 1]).all()


def test_same_seed_same_scores(spark):
    rows = corpus()
    runs = [
        sorted((r["doc_id"], round(r["score"], 5)) for r in score_documents(frame(spark, rows, p), sweeps=3, burn_in=1).collect())
        for p in (2, 5)
    ]
    assert runs[0] == runs[1]


def test_empty_tables(spark):
    assert score_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    only_held = [(k, "a b", "en", "s", 1) for k in range(200) if held(k)][:3]
    got = score_documents(frame(spark, only_held)).collect()
    assert [(r["n_known"], r["train_tokens"], r["score"]) for r in got] == [(0, 0, 0.0)] * 3


def test_every_word_is_a_context(spark):
    """A rare word tells the next one, between words that are far more frequent."""
    rng = random.Random(3)
    rows = []
    for k in range(400, 700):
        pair = rng.randrange(300)
        rows.append((k, " ".join(f"{w} a{pair} b{pair}" for w in rng.choices("pqrstuvw", k=6)), "en", "s", 1))
    p = {}
    for name, options in (("whole", {}), ("table", {"contexts": 8, "dishes": 16_383})):
        got = score_documents(frame(spark, rows), sweeps=3, burn_in=1, held_out=9, **options).collect()
        p[name] = sum(r["score"] for r in got) / sum(r["n_tokens"] for r in got)
    assert p["whole"] > p["table"] + 0.3


@pytest.mark.parametrize("options", [{}, {"known": 12}, {"known": 0}, {"known": 30, "hot": 20}])
def test_whole_model_sums_to_one_and_score_is_its_product(spark, options):
    rows = corpus()[:60]
    texts = frame(spark, rows).select("doc_id", "text")
    model, counts = fit_whole(texts, sweeps=3, burn_in=1, **options)
    names = [bytes(r["word"]) for r in counts.collect()]
    number = {w: model.words.get(w, cold_id(w)) for w in names}
    cold = {r["id"]: r for r in model.cold.collect()}
    own = {(r["u"], r["w"]): r["own"] for r in model.pairs.collect()}

    def of(u, w):
        n, share = (model.customers[u], model.share[u]) if u >= 0 else (cold[u]["n"], cold[u]["share"])
        return own.get((u, w), 0) / (n + 1.0) + share * (model.p[w] if w >= 0 else cold[w]["p"])

    for u in [len(model.words), *[number[w] for w in names if w != END][::7]]:
        share = model.share[u] if u >= 0 else cold[u]["share"]
        assert sum(of(u, number[w]) for w in names) + share * model.unseen == pytest.approx(1)
    got = {r["doc_id"]: r["score"] for r in score_documents(frame(spark, rows), held_out=9, sweeps=3, burn_in=1, **options).collect()}
    for doc, text, *_ in rows:
        ids = [len(model.words), *[number[t] for t in words_of(text) + [END]]]
        assert got[doc] == pytest.approx(sum(math.log10(of(u, w)) for u, w in zip(ids, ids[1:])), rel=1e-5)


def test_hashed_draws_have_the_law_of_the_generator():
    n, c = 4000, 300
    args = np.full(n, c), np.full(n, 0.1), np.full(n, 20.0), 0.5, 1.0
    by_hash = seat(*args, Hashed(1, 2, np.arange(n), -np.arange(n)))
    drawn = seat(*args, np.random.default_rng(0))
    assert by_hash.mean() == pytest.approx(drawn.mean(), rel=0.03) and by_hash.std() == pytest.approx(drawn.std(), rel=0.1)


def test_pairs_seen_once_in_their_own_row_meet_no_join(spark, monkeypatch):
    """All repeated pairs are known to tasks: what else a learned row has was seen once; held-out rows still ask."""
    from deedscope.llm import lm_score as lm

    rows, asked, whole = corpus(), [], lm._open_pairs

    def open_pairs(texts, shared):
        asked.append(whole(texts.filter("__learned"), shared).count())
        asked.append(whole(texts.filter("NOT __learned"), shared).count())
        return whole(texts, shared)

    monkeypatch.setattr(lm, "_open_pairs", open_pairs)
    got = {}
    for name, options in (("all", {}), ("some", {"hot": 20})):
        found = lm.score_documents(frame(spark, rows), sweeps=3, burn_in=1, **options).collect()
        got[name] = [r["score"] for r in sorted(found, key=lambda r: r["doc_id"])]
    assert asked[0] == 0 and min(asked[1:]) > 0
    assert got["all"] == pytest.approx(got["some"], rel=1e-5)


def test_sweeps_that_are_not_averaged_are_not_written(spark, monkeypatch):
    from deedscope.llm import lm_score as lm

    written, whole = [], lm._scratch
    monkeypatch.setattr(lm, "_scratch", lambda df, label: written.append(label) or whole(df, label))
    lm.fit_whole(frame(spark, corpus()[:20]).select("doc_id", "text"), sweeps=4, burn_in=3)
    assert written.count("seated") == 1


@pytest.mark.parametrize("options", [{}, {"known": 12}, {"known": 0}, {"known": 30, "hot": 20}, {"known": 12, "warm": 3, "warm_pairs": 9}])
def test_what_tasks_look_up_does_not_change_scores(spark, monkeypatch, options):
    """Learned rows ask for nothing where the tables have all that was seen twice; copies that were replaced are gone."""
    import os

    from deedscope.llm import lm_score as lm

    asked, whole, written, copy = [], lm._open_pairs, [], lm._scratch

    def open_pairs(texts, shared):
        asked.append(whole(texts, shared).count())
        return whole(texts, shared)

    def scratch(df, label):
        written.append((label, copy(df, label)))
        return written[-1][1]

    monkeypatch.setattr(lm, "_open_pairs", open_pairs)
    monkeypatch.setattr(lm, "_scratch", scratch)
    rows, got = corpus()[:60], []
    for more in ({}, {"hot": 0, "warm": 0, "warm_pairs": 0}):
        found = lm.score_documents(frame(spark, rows), held_out=9, sweeps=4, burn_in=1, **{**options, **more}).collect()
        got.append(sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 4)) for r in found))
    assert got[0] == got[1]
    assert asked[1] > 0 and (asked[0] == 0) == ("hot" not in options and "warm" not in options)
    left = [label for label, df in written if all(os.path.exists(f.removeprefix("file:")) for f in df.inputFiles())]
    assert sorted(left) == sorted(2 * ["words", "pairs", "seated", "contexts", "facts", "sums", "sums"])


def test_the_driver_fetches_the_tables_of_tasks_in_slices(spark, monkeypatch):
    from functools import partial

    from deedscope.llm import lm_score as lm

    texts, fetched = frame(spark, corpus()).select("doc_id", "text"), []
    kind = type(texts)
    whole, gathered = kind.toArrow, lm._gathered

    def to_arrow(df):
        fetched.append(whole(df))
        return fetched[-1]

    monkeypatch.setattr(kind, "toArrow", to_arrow)
    monkeypatch.setattr(lm, "_gathered", partial(gathered, slice_rows=50))
    options = {"known": 12, "sweeps": 2, "burn_in": 1}
    model, _ = lm.fit_whole(texts, **options)
    near, far, warm = len(model.hot), len(model.far), len(model.warm[0])
    assert far > 1_000 and near > 10 and warm > 50
    assert max(x.num_rows for x in fetched) < 150 and sum(x.num_rows for x in fetched) >= near + far + warm
    pairs, facts = model.pairs.collect(), {r["id"]: r for r in model.cold.collect()}
    for keys, *values in ((model.hot, model.hot_log), (model.far, model.far_own), model.warm):
        assert (np.diff(keys) > 0).all() and all(len(x) == len(keys) + 1 and x[-1] == 0 for x in values)
    own = {int(lm._pair_key(np.array([r["u"]]), np.array([r["w"]]))[0]): r["own"] for r in pairs}
    assert [own[k] for k in model.far.tolist()] == pytest.approx(model.far_own[:-1].tolist())
    assert [tuple(facts[k][c] for c in ("n", "share", "p")) for k in model.warm[0].tolist()] == list(zip(*(x[:-1].tolist() for x in model.warm[1:])))
