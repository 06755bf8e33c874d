"""Small documents with every odd case the operators must have a result for."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters="abcdefgh"):
    return ["".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n)]


def odd_rows(seed=1):
    """NULLs in any column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(seed)
    line = lambda n: " ".join(words(rng, n))
    shared = line(60)
    rows = [
        (1, line(40) + "\n" + shared, "en", "a", 5),
        (2, shared + "\n" + line(30), "en", "a", 5),
        (3, None, "en", "b", None),
        (4, "", None, None, 0),
        (5, "   \n\n \t", "de", "b", 7),
        (6, " ".join(words(rng, 30_000)), "en", "c", 1),
        (7, "x" * 50_000, "en", "c", 1),
        (8, "one two three", "en", "a", 1),
        (9, "ONE two three", "en", "a", 1),
        (9, "ONE two three", "en", "a", 1),
        (None, line(80), "en", "a", 1),
        (None, line(80), "en", "a", 1),
        (10, "\n".join([line(60)] * 5), None, "d", 1),
        (11, "çà été über 日本語 😀 1234's", "fr", "d", 1),
    ]
    rows.append((12, rows[0][1], "en", "a", 5))
    return rows


def frame(spark, rows, partitions=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def clashing(docs, *names):
    """The same rows with further columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("own").alias(n) for n in names])
