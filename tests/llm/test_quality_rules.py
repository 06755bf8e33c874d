import re

from deedscope.llm.quality_rules import Rule, cascade, first_failure, judged_measures, measures, order_rules, text_rules
from tests.llm.fixtures import SCHEMA, clashing, frame, odd_rows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    from collections import Counter

    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def more_rows():
    import random

    rng = random.Random(3)
    few = words(rng, 4, "ab")
    return [(100 + k, " ".join(rng.choices(few, k=rng.randint(0, 60))), "en", "a", 1) for k in range(60)] + [
        (200, "a\nb\na\n\n\nb # $", "en", "a", 1), (201, "x | y | z & %" * 5, "en", "a", 1), (202, "w! " * 40, "en", "a", 1),
    ]


def test_measures_against_brute_force(spark):
    rows = odd_rows() + more_rows()
    docs = clashing(frame(spark, rows), "body", "tokens", "n_words")
    got = measures(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((str(r["doc_id"]), *[r[c] for c in names]) for r in got) == sorted(
        (str(d), *brute(t)) for d, t, *_ in rows
    )


def test_verdicts(spark):
    rows = odd_rows() + more_rows()
    docs = clashing(frame(spark, rows), "kept", "failed_rule")
    measured = sorted((str(r["doc_id"]), r["n_words"], r["base_failed"], r["kept"]) for r in judged_measures(docs).collect())
    for r in measured:
        assert not (r[2] and r[3])
    raw = sorted((str(r["doc_id"]), r["kept"]) for r in cascade(docs).collect())
    assert [(r[0], r[3]) for r in measured] == raw
    assert any(r[3] for r in measured) and not all(r[3] for r in measured)


def test_order_never_changes_a_verdict(spark):
    rows = frame(spark, odd_rows() + more_rows()).selectExpr("doc_id", "coalesce(text, '') AS body")
    rules = text_rules()
    there = rows.select("doc_id", first_failure(rules).isNull().alias("kept")).collect()
    back = rows.select("doc_id", first_failure(rules[::-1]).isNull().alias("kept")).collect()
    assert sorted(map(str, there)) == sorted(map(str, back))


def test_order_is_by_rejection_per_cost(spark):
    from pyspark.sql import functions as F

    sample = frame(spark, more_rows()).selectExpr("text AS body")
    never, always = Rule("never", F.lit(False)), Rule("always", F.length("body") >= 0)
    assert [r.name for r in order_rules(sample, [never, always])] == ["always", "never"]
    assert order_rules(sample.limit(0), [never, always]) == [never, always]


def test_empty_table(spark):
    assert judged_measures(spark.createDataFrame([], SCHEMA)).collect() == []
    assert cascade(spark.createDataFrame([], SCHEMA)).collect() == []
