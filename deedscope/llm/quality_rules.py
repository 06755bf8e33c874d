"""Quality rules: a short-circuit cascade in the order of rejection per cost.

Every rule has a measure of a text and a bound. Its cost and selectivity are estimated on a
sample; the rules then stand in one CASE, the best rejection per cost first, so that a text
rejected early is not measured by the later rules. The order never changes a verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedscope.llm.common import WORD
from deedscope.plans.lineage import cut_lineage

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``, also inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def filled(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.translate(text, WHITE, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, WHITE, "")) > 0)


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(lines_with_words(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(tokens: Column, width: int = 5) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the text.

    Windows are compared by a 64-bit hash of their words' hashes. The windows are sorted by hash;
    those equal to a neighbour are repeated. Sorted by place, each repeated window adds the words
    after the end of the one before it.
    """
    window = lambda h, i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])
    hashes = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: window(h, i))

    def covered(places: Column) -> Column:
        """Places of repeated windows in order: each covers ``width`` words, less the overlap."""
        gap = lambda i: F.least(F.get(places, i) - F.get(places, i - 1), F.lit(width))
        gaps = F.transform(F.sequence(F.lit(1), F.size(places) - 1), gap)
        more = F.aggregate(gaps, F.lit(0), lambda total, g: total + g)
        return F.when(F.size(places) > 1, more + width).otherwise(F.size(places) * width)

    def repeated(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda a, b: F.get(s, a)["h"].eqNullSafe(F.get(s, b)["h"])
            hit = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda j: same(j, j + 1) | ((j > 0) & same(j, F.greatest(j - 1, F.lit(0)))),
            )
            return F.array_sort(F.transform(hit, lambda j: F.get(s, j)["i"]))

        return let(let(placed, places), covered)

    count = let(
        F.transform(tokens, lambda t: F.xxhash64(t)),
        lambda h: F.when(F.size(h) <= width, F.lit(0)).otherwise(
            let(
                hashes(h),
                lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(repeated(w)),
            )
        ),
    )
    return count.cast("long")


def measures(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The contract's measures of each whole text, one row per row of ``docs``.

    NULL texts count as empty and measure 0 throughout. Other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), filled(text_column).alias("body"))
    split = rows.select("*", words(F.col("body")).alias("tokens"))
    return split.select(
        "doc_id", "body", F.size("tokens").cast("long").alias("n_words"), word_chars(F.col("body")).alias("word_chars"),
        n_symbols(F.col("body")).alias("n_symbols"), n_dup_lines(F.col("body")).alias("n_dup_lines"),
        n_repeat_words(F.col("tokens")).alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """``fails`` is true or false for any text, empty ones too; never NULL."""

    name: str
    fails: Column


def text_rules(text: str = "body") -> list[Rule]:
    """The production rules, each measuring the raw text by itself."""
    body = F.col(text)
    n_words = F.size(words(body)).cast("long")
    marks = F.length(body) - F.length(F.translate(body, "!", ""))
    return [
        Rule("few_words", n_words < 10),
        Rule("symbols", 10 * n_symbols(body) > 3 * n_words),
        Rule("exclamations", 10 * marks > 5 * n_words),
        Rule("word_length", let(n_words, lambda n: (word_chars(body) < 2 * n) | (word_chars(body) > 20 * n))),
        Rule("dup_lines", let(lines_with_words(body), lambda x: 2 * n_dup_lines(body) > F.size(x))),
        Rule("repeats", let(words(body), lambda t: 100 * n_repeat_words(t) > 20 * F.size(t))),
    ]


def measured_rules() -> list[Rule]:
    """The same rules over the columns of :func:`measures`, where those are needed anyhow."""
    own = {r.name: r.fails for r in text_rules()}
    n = F.col("n_words")
    return [
        Rule("few_words", n < 10),
        Rule("symbols", 10 * F.col("n_symbols") > 3 * n),
        Rule("exclamations", own["exclamations"]),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("dup_lines", 2 * F.col("n_dup_lines") > F.size(lines_with_words(F.col("body")))),
        Rule("repeats", 100 * F.col("n_repeat_words") > 20 * n),
    ]


def order_rules(sample: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """Rules by rejection per second, as measured on a sample; an empty sample keeps the order."""
    n = sample.count()
    if n == 0:
        return list(rules)

    floor = _timed(lambda: sample.agg(F.count("*")).first())[0]
    worth = {}
    for rule in rules:
        took, row = _timed(lambda rule=rule: sample.agg(F.avg(rule.fails.cast("int"))).first())
        worth[rule.name] = row[0] / max(took - floor, 1e-4)
    return sorted(rules, key=lambda rule: -worth[rule.name])


def _timed(run: Callable[[], object]) -> tuple[float, object]:
    run()  # compiled and read once before the clock starts
    began = time.perf_counter()
    row = run()
    return time.perf_counter() - began, row


def first_failure(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, NULL if none: a CASE stops at its first hit."""
    if not rules:
        return F.lit(None).cast("string")
    case = F.when(rules[0].fails, F.lit(rules[0].name))
    for rule in rules[1:]:
        case = case.when(rule.fails, F.lit(rule.name))
    return case


def sample_of(docs: DataFrame, sample_rows: int, seed: int = 42) -> DataFrame:
    """About ``sample_rows`` rows, drawn from all; used for estimates only."""
    n = docs.count()
    if n > sample_rows:
        docs = docs.sample(fraction=sample_rows / n, seed=seed)
    return cut_lineage(docs)


def cascade(
    docs: DataFrame, *, sample_rows: int = 500, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``docs`` judged by the production rules: ``doc_id``, ``failed_rule`` (NULL: kept), ``kept``.

    Which rule is named for a text that fails several follows the measured order; ``kept`` does
    not. One row per row of ``docs``; NULL texts count as empty, and fail.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), filled(text_column).alias("body"))
    rules = order_rules(sample_of(rows, sample_rows), text_rules())
    return rows.select("doc_id", first_failure(rules).alias("failed_rule")).withColumn(
        "kept", F.col("failed_rule").isNull()
    )


def judged_measures(docs: DataFrame, *, sample_rows: int = 500) -> DataFrame:
    """The measures of every text with the cascade's verdict over them."""
    measured = measures(docs)
    # Drawn before it is measured, so that only the sample is.
    sample = cut_lineage(measures(sample_of(docs.select("doc_id", "text"), sample_rows)))
    rules = order_rules(sample, measured_rules())
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = measured.withColumn("base_failed", base_failed).withColumn("failed_rule", first_failure(rules))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("failed_rule").isNull()).alias("kept"),
    )
