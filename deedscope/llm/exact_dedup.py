"""Exact deduplication: skew-safe combining of equal texts.

Texts are equal when identical after lower-casing A-Z. Copies are combined within each input
partition, then per (digest, salt), then over the salts; every step compares whole texts, so two
texts that share a digest stay apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedscope.llm.common import lower_ascii
from deedscope.plans.lineage import cut_lineage


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def exact_duplicates(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = 32,
) -> DataFrame:
    """Which document stays of each group of equal texts: the one with the largest id.

    Returns one row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256`` (of the normalised text). Other columns are not read, so their names cannot
    clash. A NULL text counts as empty. A NULL id never wins against another id; in a group
    without any id ``keep_id`` is NULL and ``kept`` is true. Rows that share text and id cannot be
    told apart and are kept or dropped alike; ``group_size`` counts each. No rows give no rows.
    ``digest`` only decides where copies meet: a weak one costs time, not correctness.
    """
    if not 1 <= salts <= 62:
        raise ValueError("salts must fit the bits of a long")
    rows = docs.select(
        F.col(id_column).alias("doc_id"), lower_ascii(F.col(text_column)).alias("norm")
    ).select(
        "doc_id", "norm", digest(F.col("norm")).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    # Spark combines each aggregate within the input partition before it shuffles.
    per_salt = rows.groupBy("digest", "salt", "norm").agg(
        F.max("doc_id").alias("best"), F.count("*").alias("n")
    )
    winners = per_salt.groupBy("digest", "norm").agg(
        F.max("best").alias("keep_id"),
        F.sum("n").alias("group_size"),
        F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"),
    )
    # Texts no longer travel: a digest of one text stands for it. Only digests of several texts,
    # which a good digest has none of, take their texts along once more.
    groups = cut_lineage(winners.select("digest", "keep_id", "group_size", "salts"))
    shared = groups.groupBy("digest").count().filter("count > 1").select("digest")
    present = F.filter(
        F.sequence(F.lit(0), F.lit(salts - 1)),
        lambda s: F.col("salts").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), s)) != 0,
    )
    if shared.isEmpty():
        spread = groups.select("digest", "keep_id", "group_size", F.explode(present).alias("salt"))
        found = rows.select("doc_id", "digest", "salt", sha256(F.col("norm")).alias("text_sha256"))
        found = found.join(spread, ["digest", "salt"])
    else:
        spread = winners.select(
            "digest", "norm", "keep_id", "group_size", F.explode(present).alias("salt")
        )
        found = rows.join(spread, ["digest", "salt", "norm"]).withColumn(
            "text_sha256", sha256(F.col("norm"))
        )
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts.

    It is the row of the largest id; a NULL id is below all others. Rows equal in id and
    normalised text are copies: one of them stays, and which of their other columns is not said.
    A losing text that shares its id with a winner goes. No rows give no rows.
    """
    own = {"__id": F.col(f"`{id_column}`"), "__norm": lower_ascii(F.col(f"`{text_column}`"))}
    rows = docs.withColumns(own).withColumn("__digest", sha256(F.col("__norm")))
    facts = exact_duplicates(docs, id_column=id_column, text_column=text_column).filter("kept")
    # Per id and digest how many rows stay; more than one are copies, or texts of one digest.
    winners = cut_lineage(facts.groupBy(F.col("doc_id").alias("__win"), F.col("text_sha256").alias("__sha")).agg(F.count("*").alias("__n")))
    same = F.col("__id").eqNullSafe(F.col("__win")) & (F.col("__digest") == F.col("__sha"))
    once = rows.join(winners.filter("__n = 1"), same, "left_semi")
    copies = winners.filter("__n > 1")
    if not copies.isEmpty():
        # Partial aggregates leave one row of a key in each task before anything is shuffled.
        once = once.unionByName(rows.join(copies, same, "left_semi").dropDuplicates(["__id", "__norm"]))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])
