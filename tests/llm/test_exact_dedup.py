import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from deedscope.llm.exact_dedup import deduplicate, exact_duplicates
from tests.llm.fixtures import SCHEMA, clashing, frame, odd_rows


def brute(rows):
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[norm(text)].append(doc)
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, best, len(ids), i == best, sha) for i in ids]
    return sorted(out, key=str)


def weak(text):
    """Many texts share this digest."""
    return F.substring(F.sha2(text, 256), 1, 1)


@pytest.mark.parametrize("digest", [None, weak])
def test_against_brute_force(spark, digest):
    rows = odd_rows() + [(100 + k, f"Text {k % 7}", "en", "a", 1) for k in range(60)]
    options = {"digest": digest} if digest else {}
    docs = clashing(frame(spark, rows), "keep_id", "digest", "norm", "salt", "n", "kept")
    got = exact_duplicates(docs, **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_that_stay(spark):
    rows = [(1, "a b", "en", "s", 3), (2, "A b", "en", "s", 3), (3, "c", "en", "s", 1)]
    kept = deduplicate(clashing(frame(spark, rows), "doc"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert "doc" in kept.columns


def test_one_row_of_each_group_stays(spark):
    rows = [(9, "A"), (9, "B"), (10, "b"), (11, "C"), (11, "C"), (None, "D"), (None, "d"), (None, "A"), (12, None), (3, "")]
    docs = clashing(frame(spark, [(i, t, "en", "s", 1) for i, t in rows]), "__own", "keep_id")
    kept = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in deduplicate(docs).collect()), key=str)
    assert kept == sorted([(9, "a"), (10, "b"), (11, "c"), (None, "d"), (12, "")], key=str)
    odd = odd_rows()
    stay = deduplicate(frame(spark, odd)).collect()
    assert len(stay) == len({(t or "").lower() if (t or "").isascii() else t for _, t, *_ in odd})
    assert deduplicate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_salts_do_not_change_the_result(spark):
    rows = [(k, f"t{k % 5}", "en", "s", 1) for k in range(200)]
    one, many = (exact_duplicates(frame(spark, rows), salts=n).collect() for n in (1, 62))
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
