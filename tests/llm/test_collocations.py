import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from deedscope.llm import collocations as co
from tests.llm.fixtures import clashing, frame, odd_rows


def pieces_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[ \t]+", piece) if w] for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered)]


def plainly(rows, least, top):
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for words in pieces_of(text):
            totals[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    key = lang, tuple(words[i : i + size])
                    counts[key] = counts.get(key, 0) + 1
    frequent = {key: f for key, f in counts.items() if f >= least}
    out = {}
    for (lang, words), a in frequent.items():
        if len(words) < 2:
            continue
        inside = any(
            other == lang and len(longer) > len(words) and 100 * f >= 100 * a
            and any(longer[i : i + len(words)] == words for i in range(len(longer)))
            for (other, longer), f in frequent.items()
        )
        if inside:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)
    )


def busy_rows(seed, n=150):
    """Texts over few words, with shared passages, runs of one word, and all kinds of separators."""
    rng = random.Random(seed)
    names = ["a", "B", "cé", "d-d", "über", "ff", "日本", "x" * 300]
    passage = "the Passage that, many documents share; and share again"
    out = []
    for i in range(n):
        words = [rng.choices(names, [8, 6, 4, 3, 2, 2, 1, 1])[0] for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\r\n", " ! "]) for w in words)
        if i % 3 == 0:
            text += passage
        out.append((i, text, rng.choice(["en", "en", "de", None, "und"]), "s", 1))
    out.append((900, "same " * 5_000, "en", "s", 1))
    out.append((901, "one,two " * 3_000, "en", "s", 1))
    return out + odd_rows(seed)


@pytest.mark.parametrize("least, top, settings", [
    (5, 2000, {}), (3, 4, {"chunk_words": 1}), (20, 2000, {"chunk_words": 3, "filter_sizes": 0}),
    (5, 50, {"chunk_words": 8, "filter_sizes": 2, "max_filter_bytes": 32}),
])
def test_rows_equal_the_plain_form(spark, least, top, settings):
    rows = busy_rows(least)
    found = co.mine(frame(spark, rows), least=least, top=top, **settings)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plainly(rows, least, top)


def test_chunks_overlap_and_own_every_word_once(spark):
    rows = busy_rows(2)
    found = co.parse(clashing(frame(spark, rows), "chunk", "own", "times"), chunk_words=4).collect()
    n = sum(len(words) for _, text, *_ in rows for words in pieces_of(text))
    assert sum(r.own * r.times for r in found) == n
    assert len({(r.lang, r.chunk, r.own) for r in found}) == len(found) and max(r.times for r in found) > 40
    for r in found:
        assert r.own <= len(re.split(r"[ \n]", r.chunk)) <= r.own + co.OVERLAP


def test_words_of_a_slice():
    words = co.words_of(pa.array([" A b.C", None, "", "\n\n", "d\te"]), co.np.zeros(5, co.np.int64))
    assert words.text.tobytes() == b"a b\nc\nd e\n"
    assert words.row.tolist() == [0, 0, 0, 4, 4] and words.left.tolist() == [2, 1, 1, 2, 1]
    assert len(co.words_of(pa.array([None, "", " ,"]), co.np.zeros(3, co.np.int64)).row) == 0


def test_products_beyond_64_bits_are_exact(spark):
    n, a, left, right = 9_000_000_000_000_000, 900_000_000_000_001, 3_000_000_000_000_007, 2_000_000_000_000_003
    rows = [("en", 1, "x", left), ("en", 1, "y", right), ("en", 2, "x y", a)]
    phrases = spark.createDataFrame(rows, "lang string, size int, phrase string, f long")
    words = spark.createDataFrame([("en", n)], "lang string, n long")
    [row] = co.weakest_cuts(phrases, words).collect()
    assert row.score == 1000 * a * n // (left * right) and (row.l, row.r, row.n) == (left, right, n)


def test_empty_tables(spark):
    assert co.mine(frame(spark, [])).collect() == []
    assert co.mine(frame(spark, [(1, None, None, None, None), (2, " . ", "en", "a", 1)])).collect() == []
