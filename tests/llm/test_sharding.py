import zlib
from collections import Counter, defaultdict

from deedscope.llm.sharding import shuffle_into_shards, write_shards
from tests.llm.fixtures import SCHEMA, clashing, frame, odd_rows


def test_laws(spark):
    rows = odd_rows() + [(k, f"text {k}", "en", "a", 1) for k in range(20, 520)]
    docs = clashing(frame(spark, rows), "bucket", "shard", "slot", "copy", "size")
    got = shuffle_into_shards(docs, shards=7, bucket_bytes=2_000).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_order_is_random_and_repeats(spark):
    rows = [(k, f"text {k}", "en", "a", 1) for k in range(2_000)]
    runs = []
    for partitions, seed in ((2, 42), (5, 42), (5, 43)):
        got = shuffle_into_shards(frame(spark, rows, partitions), shards=1, bucket_bytes=4_000, seed=seed).collect()
        runs.append([r["doc_id"] for r in sorted(got, key=lambda r: r["slot"])])
    assert runs[0] == runs[1] != runs[2]
    ups = sum(a < b for a, b in zip(runs[0], runs[0][1:]))
    assert 850 < ups < 1150  # half of the steps go up in a random order
    # Every tenth of the order holds about a tenth of each tenth of the ids.
    for part in range(10):
        held = Counter(i // 200 for i in runs[0][part * 200 : part * 200 + 200])
        assert max(held.values()) < 45


def test_fewer_rows_than_shards_and_none(spark):
    got = shuffle_into_shards(frame(spark, [(1, "a", "en", "s", 1), (2, "b", "en", "s", 1)])).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (1, 0)]
    assert shuffle_into_shards(spark.createDataFrame([], SCHEMA)).collect() == []


def test_written_shards_hold_whole_records(spark, tmp_path):
    rows = [(k, f"text {k}", "en", "a", k) for k in range(100)]
    write_shards(frame(spark, rows), str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in back.collect()) == rows
    assert {r["count"] for r in back.groupBy("__shard").count().collect()} == {25}


def test_written_shards_keep_rows_without_an_id_and_repeated_ones(spark, tmp_path):
    rows = odd_rows() + [(9, "ONE two three", "en", "a", 1)] * 40
    docs = frame(spark, rows)
    write_shards(docs, str(tmp_path / "out"), shards=3, bucket_bytes=2_000)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    names = ("doc_id", "text", "lang", "source", "n_chars")
    assert Counter(tuple(r[c] for c in names) for r in back) == Counter(rows)
    # Every record lies where the query says.
    told = shuffle_into_shards(docs, shards=3, bucket_bytes=2_000).collect()
    crc = lambda text: zlib.crc32((text or "").encode())
    assert Counter((r["doc_id"], crc(r["text"]), r["__shard"], r["__slot"]) for r in back) == Counter(
        (r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in told
    )


def test_buckets_hold_texts(spark, tmp_path):
    """The bytes that bound a bucket lie in it."""
    from deedscope.llm.sharding import _placed

    rows = [(k, f"text {k} " * 50, "en", "a", k) for k in range(50)]
    placed = _placed(frame(spark, rows), 4, 42, 2_000, "text")
    assert sorted(tuple(r["record"]) for r in placed.collect()) == rows
    assert all("buckets-" in f for f in placed.inputFiles()) and placed.inputFiles()


def test_a_task_holds_one_bucket(spark):
    from deedscope.llm.sharding import _placed

    rows = [(k, f"text {k} " * 50, "en", "a", k) for k in range(400)]
    files = _placed(frame(spark, rows), 4, 42, 8_000, "text").inputFiles()
    held = [spark.read.parquet(f).select("bucket").distinct().count() for f in files]
    assert len(held) > 20 and set(held) == {1}
    assert spark.read.parquet(*files).select("bucket").distinct().count() == len(files)
