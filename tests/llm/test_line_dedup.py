import random

import pytest

from deedscope.llm.line_dedup import deduplicate_lines
from tests.llm.fixtures import SCHEMA, clashing, frame, odd_rows


def brute(rows, least):
    """Lines of runs of ``least`` words or more that an earlier place has too, by comparing places."""
    docs = sorted({(d, t) for d, t, *_ in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    places = [(k, i) for k, (_, t) in enumerate(docs) for i in range(len(t.split("\n")))]
    lines = [t.split("\n") for _, t in docs]
    size = [[len(x.encode().split()) for x in ls] for ls in lines]
    gone = [set() for _ in docs]
    for at, (k, i) in enumerate(places):
        longest = 0
        for j, q in places[:at]:
            n = 0
            while i + n < len(lines[k]) and q + n < len(lines[j]) and lines[k][i + n] == lines[j][q + n]:
                n += 1
            longest = max(longest, n)
        if longest and sum(size[k][i : i + longest]) >= least:
            gone[k].update(range(i, i + longest))
    return {
        d: "\n".join(x for i, x in enumerate(ls) if i not in g) for d, ls, g in zip(docs, lines, gone)
    }


def cleaned(spark, rows, least, partitions=3):
    got = deduplicate_lines(frame(spark, rows, partitions).withColumnRenamed("n_chars", "before"), least_words=least).collect()
    return got


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices("abcde", k=rng.randint(0, 9))) for _ in range(12)]
    rows = []
    for k in range(40):
        lines = [rng.choice(pool) if rng.random() < 0.8 else f"own {k} {i}" for i in range(rng.randint(1, 14))]
        if rows and rng.random() < 0.4:  # a passage of an earlier document
            other = rng.choice(rows)[1].split("\n")
            a = rng.randrange(len(other))
            lines[rng.randint(0, len(lines)) : 0] = other[a : a + rng.randint(1, 6)]
        rows.append((k, "\n".join(lines), "en", "s", k))
    want = brute(rows, 12)
    got = {(r["doc_id"], rows[r["doc_id"]][1]): r for r in cleaned(spark, rows, 12, 1 + seed)}
    assert {k: r["text"] for k, r in got.items()} == want
    assert sum(r["n_removed_lines"] for r in got.values()) > 20


def test_odd_rows(spark):
    rows = odd_rows()
    docs = clashing(frame(spark, rows), "n_lines", "start", "length", "later", "name0")
    got = deduplicate_lines(docs).collect()
    want = brute([r for r in rows if r[0] is not None], 50)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] == 3:
            assert r["text"] is None and r["n_lines"] == 0
        elif r["doc_id"] is None:
            assert r["n_removed_lines"] == 0
        elif r["doc_id"] != 9:
            text = next(t for d, t, *_ in rows if d == r["doc_id"])
            assert r["text"] == want[(r["doc_id"], text)]
            assert r["n_lines"] == len(text.split("\n")) and r["later"] == "own"
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_removed_lines"] == 1  # the passage that document 1 has
    assert by[12]["text"] == ""  # a copy of document 1
    assert by[10]["n_removed_lines"] == 4  # one line five times


def test_threshold(spark):
    line = " ".join(["word"] * 49)
    for n, gone in ((49, 0), (50, 1)):
        text = " ".join(["word"] * n)
        got = cleaned(spark, [(1, text, "en", "s", 1), (2, "other\n" + text, "en", "s", 1)], 50)
        assert sum(r["n_removed_lines"] for r in got) == gone, line


def test_a_long_run_everywhere(spark):
    passage = "\n".join(f"line {k} of the passage that all documents share" for k in range(300))
    rows = [(k, f"top {k}\n{passage}\nend {k}", "en", "s", 1) for k in range(50)]
    got = {r["doc_id"]: r for r in cleaned(spark, rows, 50, 7)}
    assert got[0]["n_removed_lines"] == 0
    assert all(got[k]["text"] == f"top {k}\nend {k}" for k in range(1, 50))


def test_empty_table(spark):
    assert deduplicate_lines(spark.createDataFrame([], SCHEMA)).collect() == []
