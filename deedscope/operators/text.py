"""Text operators: chunks and lexicon polarity."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedscope.functions.scalars import _let, word_chunks
from deedscope.plans.lineage import cut_lineage
from deedscope.plans.sizing import broadcast_if_small, has_at_most

# A small general lexicon of review words and their polarity.
LEXICON = {
    "amazing": 0.6, "average": -0.15, "awful": -1.0, "bad": -0.7, "best": 1.0, "boring": -1.0,
    "cheap": 0.4, "disappointing": -0.6, "durable": 0.3, "excellent": 1.0, "fine": 0.4,
    "good": 0.7, "great": 0.8, "happy": 0.8, "horrible": -1.0, "improvement": -0.1, "nice": 0.6,
    "perfect": 1.0, "poor": -0.4, "reliable": 0.4, "sleek": 0.3, "terrible": -1.0, "worst": -1.0,
}


def split_documents(df: DataFrame, *, key: str, text: str, size: int = 512) -> DataFrame:
    """One row per chunk of ``size`` words: key, chunk number from 0, chunk."""
    return df.select(key, F.posexplode(word_chunks(text, size)).alias("chunk_no", "chunk"))


def polarity(text: Column | str, lexicon: Mapping[str, float] = LEXICON) -> Column:
    """The mean weight of a text's lexicon words, 0 without any, NULL for a NULL text.

    The lexicon is a literal, and a text is scored in its own row: no explode, no shuffle. Each
    token is looked for in the whole lexicon, so use :func:`polarity_join` for a long one.
    """
    column = F.col(text) if isinstance(text, str) else text
    weights = F.create_map(*[F.lit(x) for word, w in lexicon.items() for x in (word, float(w))])
    tokens = F.split(F.lower(column), r"[^\p{L}]+")
    scored = F.filter(F.transform(tokens, lambda w: F.try_element_at(weights, w)), lambda x: x.isNotNull())

    def mean(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
        return F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)

    return F.when(column.isNotNull(), _let(scored, mean))


# Words that change the weight of what follows them; a negation turns and halves it.
MODIFIERS = {
    "no": -0.5, "not": -0.5, "never": -0.5, "hardly": -0.5, "without": -0.5, "very": 1.3, "really": 1.3,
    "extremely": 1.5, "absolutely": 1.5, "so": 1.2, "quite": 1.1, "rather": 0.9, "somewhat": 0.7, "slightly": 0.5,
}


def polarity_modified(
    text: Column | str, lexicon: Mapping[str, float] = LEXICON, modifiers: Mapping[str, float] = MODIFIERS, *, reach: int = 2
) -> Column:
    """The mean weight of a text's lexicon words, each changed by the modifiers right before it.

    Of the ``reach`` words before a lexicon word every modifier multiplies its weight, which stays
    between -1 and 1: "not very good" is a little bad. 0 without a lexicon word, NULL for a NULL text.
    """
    column = F.col(text) if isinstance(text, str) else text

    def table(words: Mapping[str, float]) -> Column:
        return F.create_map(*[F.lit(x) for word, w in words.items() for x in (word, float(w))])

    weights, factors = table(lexicon), table(modifiers)

    def scored(tokens: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.map_contains_key(weights, F.element_at(tokens, i)))

        def changed(i: Column) -> Column:
            begin = F.greatest(i - reach, F.lit(1))
            before = F.slice(tokens, begin, i - begin)
            factor = F.aggregate(before, F.lit(1.0), lambda f, w: f * F.coalesce(F.try_element_at(factors, w), F.lit(1.0)))
            return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.element_at(weights, F.element_at(tokens, i)) * factor))

        return F.transform(places, changed)

    def mean(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
        return F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)

    tokens = F.filter(F.split(F.lower(column), r"[^\p{L}]+"), lambda w: w != "")
    found = _let(tokens, lambda words: F.when(F.size(words) > 0, scored(words)).otherwise(F.array().cast("array<double>")))
    return F.when(column.isNotNull(), _let(found, mean))


def texts_with_word(df: DataFrame, *, keys: list[str], text: str) -> DataFrame:
    """``word`` and in how many texts, as told apart by ``keys``, it is found: ``texts``.

    A text's words are made distinct in its own row and counted before the shuffle. Only texts
    whose keys another row has too are made distinct across rows.
    """
    tokens = F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}]+"))
    words = df.select(*keys, F.explode(tokens).alias("word")).filter("word <> ''")
    again = df.groupBy(*keys).agg(F.count("*").alias("__rows")).filter("__rows > 1").select(*[F.col(k).alias(f"__{k}") for k in keys])
    again = cut_lineage(again)
    if again.isEmpty():
        return words.groupBy("word").agg(F.count("*").alias("texts"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    side = broadcast_if_small(again)
    once = words.join(side, same, "left_anti").select("word")
    more = words.join(side, same, "left_semi").distinct().select("word")
    return once.union(more).groupBy("word").agg(F.count("*").alias("texts"))


def polarity_join(
    df: DataFrame, lexicon: DataFrame, *, keys: list[str], text: str, max_broadcast_rows: int = 200_000, frequency: str | None = None
) -> DataFrame:
    """The polarity of each text with a lexicon of any length: rows of ``word`` and ``weight``.

    A lexicon of up to ``max_broadcast_rows`` words, as counted, is broadcast and meets the words
    before anything is shuffled. Of a longer one the words that come first by the column
    ``frequency``, if it is named, are broadcast; the words that are none of these are counted per
    text and meet the rest of the lexicon by shuffle. ``keys`` tell the texts apart; NULL texts score NULL.
    """
    tokens = F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("word")
    words, listed = df.select(*keys, tokens).filter("word <> ''"), lexicon.select("word", "weight")

    def summed(known: DataFrame, n: Column) -> DataFrame:
        own = [F.col(k).alias(f"__{k}") for k in keys]
        return known.groupBy(*own).agg(F.sum(n * F.col("weight")).alias("__sum"), F.sum(n).alias("__n"))

    if has_at_most(listed, max_broadcast_rows):
        scored = summed(words.join(F.broadcast(listed), "word"), F.lit(1))
    else:
        rare, parts = words, []
        if frequency:
            first = cut_lineage(lexicon.orderBy(F.desc(frequency), "word").limit(max_broadcast_rows).select("word", "weight"))
            parts.append(summed(words.join(F.broadcast(first), "word"), F.lit(1)))
            rare = words.join(F.broadcast(first), "word", "left_anti")
        counted = rare.groupBy(*keys, "word").agg(F.count("*").alias("n"))
        parts.append(summed(counted.join(listed, "word"), F.col("n")))
        scored = functools.reduce(DataFrame.union, parts)
    found = scored.groupBy(*[f"__{k}" for k in keys]).agg((F.sum("__sum") / F.sum("__n")).alias("__mean"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    # The texts themselves stay out of the join.
    rows = df.select(*keys, F.col(text).isNotNull().alias("__there"))
    score = F.when(F.col("__there"), F.coalesce("__mean", F.lit(0.0)))
    return rows.join(found, same, "left").select(*keys, score.alias("polarity"))
