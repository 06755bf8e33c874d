"""The pipeline's stages and contract on a small folder of tables."""

import random
import re

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from deedscope.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.fixtures import SCHEMA, odd_rows, words

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    rows, marks = [], []
    passage = " ".join(words(rng, 70))
    for k in range(1000, 1300):
        good = k % 6 > 0
        text = " ".join(words(rng, rng.randint(40, 120)))
        if k % 10 == 1:
            text += "\n" + passage
        if not good:
            text = " | ".join(words(rng, 60)).upper() + " ###" * 30
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
        marks.append((k, int(good), 0))
    near = words(rng, 200)
    for k in range(1300, 1310):
        copy = list(near)
        copy[rng.randrange(200)] = f"changed{k}"
        rows.append((k, " ".join(copy), "en", "s0", 1))
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows + odd_rows(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, marks


def test_stages(spark, folder, tmp_path):
    path, rows, marks = folder
    docs, seen = spark.read.schema(SCHEMA).parquet(f"{path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = [{r["doc_id"] for r in rows} for rows in seen]
    junk = {d for d, q, _ in marks if not q}
    good = {d for d, q, _ in marks if q}
    assert not ids[0] & junk and len(ids[0] & good) > 0.97 * len(good)
    text = {r["doc_id"]: r["text"] for r in seen[1]}
    # The passage stays in one document, and no document of its own words goes.
    passage = {d: t.split("\n")[1] for d, t, *_ in rows if d % 10 == 1 and d in good}
    assert sum(t is not None and re.search(re.escape(passage[min(passage)]), t) is not None for t in text.values()) == 1
    assert ids[1] >= ids[0] & good
    assert len(ids[2] & set(range(1300, 1310))) == 1 and ids[2] & good == ids[1] & good
    assert ids[3] <= ids[2] and len(seen[3]) > len(ids[3])  # some are repeated
    assert len(seen[4]) == len(seen[3]) and all(r["n_tokens"] is not None for r in seen[4])


def test_run_and_registration(spark, folder):
    path, *_ = folder
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    assert len(corpus_pipeline.STAGES) == 5
    names = driver.queries()
    assert {**QUERIES, "pipeline": corpus_pipeline.run}.items() <= names.items()
    assert ORACLE_SQL.items() <= driver.oracle_sql().items()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_sql(spark):
    """The queries that SQL can state, beside their SQL."""
    from tests import compare
    from tests.conftest import SF

    con = compare.duck(SF)
    for name in ORACLE_SQL:
        df = QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        order = ", ".join(columns)
        want = con.execute(f"SELECT {order} FROM ({ORACLE_SQL[name]})").fetchall()
        got = [tuple(r) for r in df.select(*columns).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), name
