import hashlib
import math
from collections import Counter

import pytest

from deedscope.llm.mixing import mix, source_rates
from tests.llm.fixtures import SCHEMA, clashing, frame, odd_rows


def draw(seed, doc, rate):
    """The Poisson number of a document, by inverting the distribution."""
    draws = max(1, math.ceil(rate / 32))
    mean, n = rate / draws, 0
    for j in range(1, draws + 1):
        digest = hashlib.md5(f"{seed}|count|{'' if doc is None else doc}|{j}".encode()).hexdigest()
        u = int(digest[:13], 16) / 2**52
        term = total = math.exp(-mean)
        k = 0
        while total < u and k < 500:
            k += 1
            term *= mean / k
            total += term
        n += k
    return n


def rates_of(rows, power=0.5, total=None):
    n = Counter(r[3] for r in rows)
    weight = {s: c**power for s, c in n.items()}
    scale = (len(rows) if total is None else total) / sum(weight.values())
    return {s: scale * weight[s] / n[s] for s in n}


@pytest.mark.parametrize("options", [{}, {"max_broadcast_sources": 0}, {"total": 4_000}])
def test_against_brute_force(spark, options):
    rows = odd_rows() + [(k, f"t {k}", "en", "big" if k % 3 else f"s{k % 17}", 1) for k in range(100, 500)]
    docs = clashing(frame(spark, rows), "copy", "rate", "cdf")
    got = mix(docs, **options).collect()
    rates = rates_of(rows, total=options.get("total"))
    want = Counter()
    for doc, text, lang, source, n in rows:
        want[(doc, text, lang, source, n)] += draw(42, doc, rates[source])
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in got) == +want
    assert len({(r["doc_id"], r["text"], r["copy"]) for r in got if r["doc_id"] and r["doc_id"] >= 100}) == sum(
        1 for r in got if r["doc_id"] and r["doc_id"] >= 100
    )


def test_rates_meet_the_target(spark):
    rows = [(k, "t", "en", "hot" if k % 3 else f"s{k % 4}", 1) for k in range(6_000)]
    weights = spark.createDataFrame([("hot", 1.0), ("s0", 1.0), ("s3", 0.5), ("s3", 0.5), ("absent", 9.0)], "source string, weight double")
    got = Counter(r["source"] for r in mix(frame(spark, rows), weights=weights, total=9_000).collect())
    assert set(got) == {"hot", "s0", "s3"}  # a source without a weight is not in the mix
    for n in got.values():
        assert abs(n - 3_000) < 5 * math.sqrt(3_000)
    rates = {r["source"]: r["rate"] for r in source_rates(frame(spark, rows), weights=weights, total=9_000).collect()}
    assert rates["hot"] == pytest.approx(0.75) and rates["s1"] == 0


def test_another_document_changes_no_count(spark):
    rows = [(k, "t", "en", "a", 1) for k in range(300)]
    weights = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    count = lambda rows, total: Counter(r["doc_id"] for r in mix(frame(spark, rows), weights=weights, total=total).collect())
    one, two = count(rows, 600), count(rows[:150], 300)
    assert {k: v for k, v in one.items() if k < 150} == two


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []
