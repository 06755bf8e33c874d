"""URL filters: a blocked Bloom filter of listed URLs in front of an exact hash join.

A list holds rules and single URLs. A rule ``host/path`` fits its host, all subdomains, and every
path that starts with its own; of several the longest wins. A single URL fits the URLs of the same
canonical form and counts where no rule fits. Both are looked up as keys of a URL: for rules the
host's endings with the path's beginnings of the listed lengths, for single URLs the canonical form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deedscope.llm.blocked_bloom import build, passes
from deedscope.llm.common import UPPER
from deedscope.plans.lineage import scratch_path
from deedscope.plans.sizing import bounded_rows, bytes_of

# Fixed values of the query: its rules, and the words of host names whose pages it lists.
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
LISTED_WORDS = ["ads", "adult", "bets", "casino", "pills", "spam"]


def _rest(url: Column) -> Column:
    """What follows the first ``://``; '' without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Up to the first ``/``, ``?`` or ``#``, with A-Z lower-cased; '' for NULL."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to the first ``?`` or ``#``; '' for NULL."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One form for URLs that differ in scheme, ``www.``, query, fragment, and slashes at the end."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "entry string, verdict string").withColumn("kind", F.lit("rule"))


def listed_pages(pages: DataFrame, words: list[str]) -> DataFrame:
    """The canonical URLs of all pages with one of ``words`` in a part of their host's name, to be blocked."""
    host = host_of(F.col("url"))
    named = host.rlike(r"(^|[.-])(" + "|".join(words) + r")([.-]|$)")
    entry = canonical(host, path_of(F.col("url"))).alias("entry")
    return pages.filter(named).select(entry).distinct().select("entry", F.lit("block").alias("verdict"), F.lit("url").alias("kind"))


def _entries(listed: DataFrame) -> DataFrame:
    """The list with one row per key: of equal entries with different verdicts, ``block`` wins."""
    return listed.filter("entry IS NOT NULL AND kind IN ('rule', 'url')").groupBy("kind", "entry").agg(
        F.max("verdict").alias("verdict")
    )


def _shapes(entries: DataFrame, most: int) -> list[tuple[int, int]]:
    """(parts of the host, length of the path) of the listed rules: which keys a URL is asked for."""
    entry = F.col("entry")
    host = F.regexp_extract(entry, r"^[^/]*", 0)
    shape = entries.filter("kind = 'rule'").select(
        F.size(F.split(host, r"\.")).alias("parts"), (F.length(entry) - F.length(host)).alias("path")
    )
    return sorted((row.parts, row.path) for row in bounded_rows(shape.distinct(), most, "shapes of rules"))


def judge(
    pages: DataFrame, listed: DataFrame, *, max_filter_bytes: int = 32 << 20, max_shapes: int = 4096,
    max_broadcast_bytes: int = 8 << 20,
) -> DataFrame:
    """Each page's host, path, the longest rule that fits, and a verdict.

    ``listed`` has entry, verdict (``allow`` or ``block``) and kind (``rule`` or ``url``). Returns
    page_id, host, path, rule, verdict and listed_url (the single URL that decided, else NULL). The
    verdict is that of the rule, else that of a listed URL, else ``allow``. NULL URLs and those
    without ``://`` have an empty host and path and fit no rule. Pages with repeated or NULL ids
    keep a row each; further columns are not read; an empty list lets all pages pass, an empty
    table gives no rows.

    Keys that the filter lets pass go to the join with the list, once per URL; all others are known
    to be in no list and are joined with nothing. The filter is bounded by ``max_filter_bytes``,
    the list is broadcast up to ``max_broadcast_bytes`` and joined by shuffle beyond.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "listed-urls")
    key = F.concat(F.col("kind"), F.lit(" "), F.col("entry"))
    _entries(listed).select("kind", "entry", "verdict", key.alias("key"), F.xxhash64(key).alias("hash")).write.parquet(path)
    entries = spark.read.parquet(path)
    shapes = _shapes(entries, max_shapes)
    words = build(entries, "hash", entries.count(), max_bytes=max_filter_bytes)
    asked = scratch_path(spark, "possible-urls")
    _possible(pages, shapes, words).write.parquet(asked)
    rows = spark.read.parquet(asked)

    possible = rows.filter(F.size("keys") > 0)
    each = possible.select("host", "path", "keys").distinct().select("host", "path", F.explode("keys").alias("key"))
    known = entries.select("key", "kind", "entry", "verdict")
    known = F.broadcast(known) if bytes_of(known) <= max_broadcast_bytes else known.hint("shuffle_hash")
    best = F.struct((F.col("kind") == "rule").alias("is_rule"), F.length("entry").alias("long"), "entry", "verdict")
    met = each.join(known, "key").groupBy("host", "path").agg(F.max(best).alias("best"))
    judged = possible.join(met, ["host", "path"], "left").select("page_id", "host", "path", "best")
    none = rows.filter(F.size("keys") == 0).select("page_id", "host", "path", F.lit(None).cast(met.schema["best"].dataType).alias("best"))
    return judged.unionByName(none).select(
        "page_id", "host", "path", F.when(F.col("best.is_rule"), F.col("best.entry")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.when(~F.col("best.is_rule"), F.col("best.entry")).alias("listed_url"),
    )


def _possible(pages: DataFrame, shapes: list[tuple[int, int]], words: np.ndarray) -> DataFrame:
    """Of each page the keys that may be listed: all true ones, and a few false ones."""
    held = pages.sparkSession.sparkContext.broadcast(words)
    host, path = F.col("host"), F.col("path")
    parts = F.size(F.split(host, r"\."))
    keys = [
        F.when(
            (host != "") & (parts >= n) & (F.length(path) >= size),
            F.concat(F.lit("rule "), F.substring_index(host, ".", -n), F.substring(path, 1, size)),
        )
        for n, size in shapes
    ]
    keys.append(F.when(host != "", F.concat(F.lit("url "), canonical(host, path))))
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = parsed.withColumn("keys", F.array_compact(F.array(*keys)))
    rows = rows.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
    names = ["page_id", "host", "path", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            keys, hashes = batch.column(3), batch.column(4)
            may = passes(held.value, hashes.flatten().to_numpy(zero_copy_only=False))
            ends = np.concatenate([[0], np.cumsum(may)])[keys.offsets.to_numpy() - keys.offsets[0].as_py()]
            left = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys.flatten().filter(pa.array(may)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], left], names=names)

    return rows.mapInArrow(run, "page_id long, host string, path string, keys array<string>")


def filter_pages(pages: DataFrame) -> DataFrame:
    """All pages judged by the fixed rules and the list of all pages on hosts with listed words."""
    spark = pages.sparkSession
    return judge(pages, rules_table(spark, RULES).select("entry", "verdict", "kind").unionByName(listed_pages(pages, LISTED_WORDS)))
