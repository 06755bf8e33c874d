"""Mixing sources to target weights by Poisson replication.

A document of a source with repetition rate r is repeated as often as a Poisson variable of mean
r says, found by inverting the distribution at a uniform number hashed from seed and id. So a
rerun, another cluster or one more document change no other document's count. Copies are then
shuffled globally by a hashed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedscope.functions.scalars import _let
from deedscope.plans.lineage import cut_lineage
from deedscope.plans.sizing import has_at_most

# A rate above this is the sum of draws of equal smaller rates, so exp(-rate) stays in range.
RATE_PER_DRAW = 32


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash of the parts."""
    digest = F.md5(F.encode(F.concat_ws("|", *[p.cast("string") for p in parts]), "UTF-8"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(
    docs: DataFrame, *, weights: DataFrame | None = None, power: float = 0.5, total: int | None = None,
    source_column: str = "source",
) -> DataFrame:
    """``source``, ``rows``, ``rate``: the mean number of copies of a document of each source.

    ``weights`` has rows of ``source`` and ``weight``; a source that it lacks weighs nothing, and
    one with several rows weighs their sum. Without it a source weighs its number of rows to the
    ``power``, which lifts small sources. NULL is a source of its own. ``total`` is the expected
    number of rows of the mix, by default that of ``docs``.
    """
    counts = docs.groupBy(F.col(source_column).alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("rows").cast("double"), F.lit(power)))
    else:
        given = weights.groupBy(F.col("source").alias("__source")).agg(F.sum("weight").cast("double").alias("weight"))
        weighed = counts.join(given, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
        weighed = weighed.fillna(0.0, ["weight"])
    weighed = cut_lineage(weighed)
    whole = weighed.agg(F.sum("weight").alias("weight"), F.sum("rows").alias("rows")).first()
    wanted = float(whole["rows"] or 0) if total is None else float(total)
    scale = wanted / whole["weight"] if whole["weight"] else 0.0
    return weighed.select("source", "rows", (F.lit(scale) * F.col("weight") / F.col("rows")).alias("rate"))


def _distributions(rates: DataFrame) -> DataFrame:
    """Adds ``draws`` and the distribution function of one draw, up to where doubles end."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / RATE_PER_DRAW)).cast("int")
    most = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 30).cast("int")
    start = F.struct(
        F.exp(-F.col("mean")).alias("term"), F.exp(-F.col("mean")).alias("total"),
        F.array(F.exp(-F.col("mean"))).alias("cdf"),
    )

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * F.col("mean") / k
        total = state["total"] + term
        return F.struct(term.alias("term"), total.alias("total"), F.concat(state["cdf"], F.array(total)).alias("cdf"))

    summed = F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["cdf"])
    return (
        rates.withColumn("draws", draws)
        .withColumn("mean", F.col("rate") / F.col("draws"))
        .select("source", "draws", summed.alias("cdf"))
    )


def mix(
    docs: DataFrame, *, weights: DataFrame | None = None, power: float = 0.5, total: int | None = None, seed: int = 42,
    id_column: str = "doc_id", source_column: str = "source", max_broadcast_sources: int = 4096, salts: int = 64,
) -> DataFrame:
    """Copies of the rows of ``docs``, their sources in the target weights, in a random order.

    Adds ``copy`` (1, 2 ...), ``copies`` (how often the row was drawn) and ``shuffle_key``, by
    which each output partition is sorted; columns of these names are replaced. A row of count 0
    is not in the mix: this is a sampling operator. Rows of equal id are drawn alike, NULL ids
    count as empty. No rows give no rows. The distributions, about 1 KB a source, are broadcast
    up to ``max_broadcast_sources`` of them; beyond that they are joined by shuffle, with the
    rows of each source spread over ``salts``.
    """
    columns = [c for c in docs.columns if c not in ("copy", "copies", "shuffle_key")]
    rates = source_rates(docs, weights=weights, power=power, total=total, source_column=source_column)
    distributions = cut_lineage(_distributions(rates).withColumnsRenamed({c: f"__{c}" for c in ("source", "draws", "cdf")}))
    key = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], key.alias("__key"))
    same = F.col(f"`{source_column}`").eqNullSafe(F.col("__source"))
    if has_at_most(distributions, max_broadcast_sources):
        found = rows.join(F.broadcast(distributions), same)
    else:
        spread = distributions.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = rows.withColumn("__at", F.pmod(F.xxhash64("__key"), F.lit(salts)).cast("int"))
        found = salted.join(spread, same & (F.col("__at") == F.col("__salt")))
    uniforms = F.transform(
        F.sequence(F.lit(1), F.col("__draws")), lambda j: uniform(F.lit(seed), F.lit("count"), F.col("__key"), j)
    )

    def passed(us: Column) -> Column:
        below = lambda u: F.size(F.filter("__cdf", lambda c: c < u))
        return F.aggregate(us, F.lit(0), lambda n, u: n + below(u))

    # Each number is hashed once: it is bound before the steps are compared with it, and no filter
    # repeats the draw where the rows are joined.
    counted = found.withColumn("__n", _let(uniforms, passed))
    copies = F.explode_outer(F.when(F.col("__n") > 0, F.sequence(F.lit(1), F.col("__n"))))
    copied = counted.select(
        *[F.col(f"`{c}`") for c in columns], "__key", copies.alias("copy"), F.col("__n").alias("copies")
    ).filter("copy IS NOT NULL")
    order = F.md5(F.encode(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), "__key", F.col("copy").cast("string")), "UTF-8"))
    keyed = copied.withColumn("shuffle_key", order).drop("__key")
    # The key is a hash already: any partition holds a uniform sample, in an order of its own.
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
