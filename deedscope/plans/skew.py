"""Joins in which a few keys hold a large part of the rows.

AQE splits skewed partitions only where the join shuffles. A bucketed join does not, so its
hot keys are taken out and joined apart, with the rows of each key spread over salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedscope.plans.sizing import broadcast_if_small


def hot_keys(df: DataFrame, key: str, share: float) -> list:
    """Keys that hold about ``share`` of the rows or more.

    A frequent-items sketch finds them in one pass without shuffling the keys. Its counts are
    off by a small part of the rows at most, which does not matter here: the keys only decide
    how rows are spread, never which rows there are.
    """
    wanted = min(int(2 / share) + 1, 1_000)
    row = df.agg(
        F.expr(f"approx_top_k(`{key}`, {wanted}, {max(10_000, 10 * wanted)})").alias("top"),
        F.count("*").alias("n"),
    ).first()
    return [t["item"] for t in row["top"] if t["item"] is not None and t["count"] >= share * row["n"]]


def spread_salt(df: DataFrame, salts: int) -> Column:
    """A salt by a hash of the whole row: a task that is run again deals its rows alike."""
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.lit(salts)), F.lit(salts)).cast("int")


def join_split_hot(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str,
    *,
    share: float = 0.05,
    salts: int = 64,
    max_broadcast_rows: int = 100_000,
) -> DataFrame:
    """Inner or left join whose hot left keys are spread over ``salts`` tasks each.

    All other keys keep the plain join, and with it the bucketing of both tables.
    """
    if how not in ("inner", "left"):
        raise ValueError("the hot side is the left side: only inner and left joins")
    condition = F.col(left_key) == F.col(right_key)
    hot = hot_keys(left, left_key, share)
    if not hot:
        return left.join(right, condition, how)

    is_hot = F.col(left_key).isin(hot)
    plain = left.filter(~is_hot | F.col(left_key).isNull()).join(right, condition, how)

    hot_right = right.filter(F.col(right_key).isin(hot))
    small = broadcast_if_small(hot_right, max_broadcast_rows)
    if small is not hot_right:
        spread = left.filter(is_hot).join(small, condition, how)
    else:
        copies = hot_right.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = left.filter(is_hot).withColumn("__t", spread_salt(left, salts))
        spread = salted.join(copies, condition & (F.col("__t") == F.col("__s")), how)
        spread = spread.drop("__t", "__s")
    return plain.unionByName(spread)
