"""Global shuffle into shards: a two-pass external shuffle.

Pass one scatters whole records uniformly into buckets that fit in memory, by a seeded hash. Pass
two shuffles each bucket by Fisher-Yates (Spark's ``shuffle`` of an array), writes it, and lays the
buckets end to end; the shards are equal cuts of that order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedscope.plans.lineage import scratch_path
from deedscope.plans.ordinal import with_running_totals


def _size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 16).cast("long")


def _placed(docs: DataFrame, shards: int, seed: int, bucket_bytes: int, text_column: str) -> DataFrame:
    """``record`` (all columns of a row), ``shard`` and ``slot``, read from the written buckets."""
    total = docs.agg(F.count("*").alias("n"), F.sum(_size(F.col(text_column))).alias("bytes")).first()
    n, total_bytes = total["n"], total["bytes"] or 0
    buckets = max(1, math.ceil(total_bytes / bucket_bytes), math.ceil(n / 4096))
    counted = docs.select(F.struct("*").alias("record")).groupBy("record").agg(F.count("*").alias("copies"))
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    # A hash tells records apart in a bucket; equal hashes fall back on the records themselves.
    keyed = copies.withColumn("key", F.xxhash64(F.lit(seed), "record", "copy"))
    scattered = keyed.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    # A stated number of partitions is not changed at run time, so the draw of ``shuffle``, which
    # follows the partition and the rows' order in it, is the same in every run.
    tasks = min(buckets, 20_000)
    # The bucket's number is the partition: by a hash of it some tasks would hold several buckets, others none.
    gathered = (
        scattered.withColumn("task", F.pmod("bucket", F.lit(tasks)).cast("int"))
        .repartitionById(tasks, F.col("task"))
        .groupBy("task", "bucket")
        .agg(F.sort_array(F.collect_list(F.struct("key", "copy", "record"))).alias("records"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle("records", seed).alias("records"))
    )
    path = scratch_path(docs.sparkSession, "buckets")
    shuffled = gathered.select("bucket", F.posexplode("records").alias("place", "r"))
    shuffled.select("bucket", "place", "r.record").write.option("compression", "zstd").parquet(path)
    written = docs.sparkSession.read.parquet(path)
    ends = with_running_totals(
        written.groupBy("bucket").agg(F.count("*").alias("held")), [F.col("bucket")], {"end": F.col("held")}
    )
    starts = ends.select("bucket", (F.col("end") - F.col("held")).alias("start"))
    # One row per bucket of ``bucket_bytes``.
    placed = written.join(F.broadcast(starts), "bucket").withColumn("at", F.col("start") + F.col("place"))
    # The first ``longer`` shards hold one row more.
    least, longer = divmod(n, shards)
    cut = longer * (least + 1)
    shard = F.when(F.col("at") < cut, F.floor(F.col("at") / (least + 1))).otherwise(
        longer + F.floor((F.col("at") - cut) / F.lit(max(least, 1)))
    )
    first = F.col("shard") * least + F.least(F.col("shard"), F.lit(longer))
    slot = (F.col("at") - first).cast("long").alias("slot")
    return placed.withColumn("shard", shard.cast("int")).select("record", "shard", slot)


def shuffle_into_shards(
    docs: DataFrame,
    *,
    shards: int = 40,
    seed: int = 42,
    bucket_bytes: int = 8 << 20,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Place every record in a shard and a slot, after one random order of all records.

    The law is ``rows``: shard sizes differ by one row at most. Returns one row per row of
    ``docs``: ``doc_id``, ``size`` (UTF-8 bytes of the text, NULL none, plus 16),
    ``text_crc32`` (NULL counts as empty), ``law``, ``shard``, ``slot`` (gapless from 0 within a
    shard), ``grown_shard`` (NULL under this law). Whole records move and are read back from the
    written buckets, so all columns must be of types that can be grouped. A bucket holds
    about ``bucket_bytes`` of records; equal rows are counted first and their copies scattered
    like other rows, so no bucket grows with them. The same seed and number of buckets give the
    same order on any cluster. No rows give no rows.
    """
    placed = _placed(docs, shards, seed, bucket_bytes, text_column)
    text = F.col("record").getField(text_column)
    return placed.select(
        F.col("record").getField(id_column).alias("doc_id"), _size(text).alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(
    docs: DataFrame, path: str, *, shards: int = 40, seed: int = 42, bucket_bytes: int = 8 << 20,
    id_column: str = "doc_id", text_column: str = "text",
) -> None:
    """Write the records of ``docs``, whole, into one folder per shard, each in its slots' order.

    Shards and slots are those of :func:`shuffle_into_shards`. No id is needed: records carry
    their places.
    """
    placed = _placed(docs, shards, seed, bucket_bytes, text_column)
    (
        placed.select("record.*", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
        .repartitionByRange("__shard", "__slot")
        .sortWithinPartitions("__shard", "__slot")
        .write.mode("overwrite")
        .partitionBy("__shard")
        .parquet(path)
    )
