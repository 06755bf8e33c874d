"""LM scoring: a hierarchical Pitman-Yor model with seatings drawn anew in sweeps.

This is not a Gibbs sampler: no customer is taken out and seated again given the others. A sweep draws
all seatings forward, with the totals that the sweep before left.

``score_documents`` has two models. The whole one, which is the default, has every word of the
training texts as a context and as a dish: a token's context is the word right before it, and
restaurants are rows of Spark (``fit_whole``). With ``contexts`` or ``dishes`` given, the model
is a table of that size (``fit``), as follows.

A token's context is the last frequent word before it. Every context is a Chinese restaurant
whose dishes are the model's words and one dish that stands for all rarer words; all contexts
share one parent restaurant, whose base is uniform. Each sweep seats the customers of every
(context, dish) anew, given the tables of the context and the parent's predictive probabilities,
and then those of the parent, whose customers are the contexts' tables. Predictive probabilities
are averaged over the sweeps after the first ones. Which rare word it is comes from one further
restaurant, of all rare words with a table each.

Counts cover every training document. What is broadcast has stated bounds: ``known`` words with
their counts, and contexts x dishes probabilities. Words beyond those meet their counts by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedscope.llm.common import UPPER, extended, fold, parts
from deedscope.plans.lineage import cut_lineage, discard, scratch_path, written

END = b"\n"  # no word holds it
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode().translate(_LOWER).split()


@dataclass
class Seating:
    """Discounts and strengths of the contexts, their parent, and the rare words' restaurant."""

    discount: float = 0.5
    strength: float = 1.0
    parent_discount: float = 0.5
    parent_strength: float = 1.0
    rare_discount: float = 0.5
    rare_strength: float = 1.0


@dataclass
class Model:
    words: dict[bytes, int] = field(default_factory=dict)  # known words, most frequent first
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    dishes: int = 0  # words of the model; the next number stands for the rare ones
    contexts: int = 0
    tokens: int = 0  # N
    types: int = 0  # V
    rare_tokens: int = 0
    rare_types: int = 0
    log_p: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.float32))
    seating: Seating = field(default_factory=Seating)

    def rare_count(self, c):
        """Share of a rare word of count ``c`` times the restaurant's size: numpy or Column."""
        d, types = self.seating.rare_discount, self.rare_types
        common = (self.seating.rare_strength + d * types) / (types + 1)
        return c - d + common, common

    def rare_size(self) -> float:
        return self.rare_tokens + self.seating.rare_strength


def _mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 of unsigned numbers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashed:
    """Binomial draws that depend on seed, sweep, context, dish and customers seated, on nothing else."""

    def __init__(self, seed: int, sweep: int, u: np.ndarray, w: np.ndarray):
        start = _mix(np.array([seed * 1_000 + sweep], np.int64).view(np.uint64))
        self.key = _mix(_mix(u.astype(np.int64).view(np.uint64) ^ start) + w.astype(np.int64).view(np.uint64))

    def __call__(self, left: np.ndarray, i: np.ndarray, step: np.ndarray, p: np.ndarray) -> np.ndarray:
        key = _mix(self.key[left] ^ _mix(i.astype(np.int64).view(np.uint64)))
        x = (key >> np.uint64(11)) * 2.0**-53
        drawn = (x < p).astype(np.int64)
        # Several at a time: the distribution inverted, or a generator where that takes long.
        few = np.flatnonzero((step > 1) & (step * p <= 30))
        n, odds, x = step[few], p[few] / np.maximum(1 - p[few], 1e-12), x[few]
        term = (1 - p[few]) ** n
        total, out = term.copy(), np.zeros(len(few), np.int64)
        going = np.flatnonzero((x >= total) & (out < n))
        while len(going):
            k = out[going]
            term[going] *= (n[going] - k) / (k + 1) * odds[going]
            total[going] += term[going]
            out[going] = k + 1
            going = going[(x[going] >= total[going]) & (out[going] < n[going])]
        drawn[few] = out
        for at in np.flatnonzero((step > 1) & (step * p > 30)):
            drawn[at] = np.random.default_rng(int(key[at])).binomial(step[at], p[at])
        return drawn


def seat(customers: np.ndarray, base: np.ndarray, tables: np.ndarray, d: float, strength: float, rng) -> np.ndarray:
    """Tables of each dish when its customers are seated one by one.

    ``base`` is the parent's probability of the dish, ``tables`` all tables of the restaurant as
    of the last sweep. A customer opens a table with probability proportional to
    (strength + d x tables) x base, and joins one of the dish's i customers at its t tables with
    i - d t. Beyond eight customers an eighth more sit down at a time.
    """
    opened = np.minimum(customers, 1)
    seated = opened.copy()
    weight = (strength + d * tables) * base
    left = np.flatnonzero(seated < customers)
    while len(left):
        i, t = seated[left], opened[left]
        step = np.minimum(np.maximum(1, i // 8), customers[left] - i)
        p = weight[left] / (weight[left] + i - d * t)
        opened[left] = t + (rng(left, i, step, p) if isinstance(rng, Hashed) else rng.binomial(step, p))
        seated[left] = i + step
        left = left[seated[left] < customers[left]]
    return opened


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (bytes) and ``n`` over all rows, ends of texts included; summed per partition first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for batch in parts(batches):
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
            seen[END] += batch.num_rows
            if len(seen) > 500_000:  # bounds the memory of a task, not what is counted
                yield out()
        yield out()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _places(text: str, model: Model) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Known numbers of a text's tokens (-1: not known), their contexts, and the tokens."""
    tokens = words_of(text)
    tokens.append(END)
    known = np.fromiter(map(model.words.get, tokens, repeat(-1)), np.int64, len(tokens))
    # The last place at or before each token that holds a context word; 0 is the start.
    is_context = (known >= 0) & (known < model.contexts)
    place = np.maximum.accumulate(np.where(is_context, np.arange(1, len(tokens) + 1), 0))
    context = np.where(place > 0, known[np.maximum(place - 1, 0)] + 1, 0)
    return known, np.concatenate([[0], context[:-1]]), tokens


def _pairs(texts: DataFrame, model: Model, blocks: int = 64) -> DataFrame:
    """``u``, ``w``, ``c``: how often each dish follows each context, and a ``block`` of dishes."""
    # Plain values: tasks get this module with the function, not by import.
    shared = texts.sparkSession.sparkContext.broadcast({f.name: getattr(model, f.name) for f in fields(model) if f.name != "seating"})
    seating = model.seating

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value, seating=seating)
        width = model.dishes + 1
        counts = np.zeros((model.contexts + 1) * width, np.int64)
        for batch in parts(batches):
            slots = []
            for text in batch.column(0).to_pylist():
                known, context, _ = _places(text, model)
                dish = np.where((known < 0) | (known >= model.dishes), model.dishes, known)
                slots.append(context * width + dish)
            slot, n = np.unique(np.concatenate(slots), return_counts=True)
            counts[slot] += n
        slot = np.flatnonzero(counts)
        columns = [pa.array((slot // width).astype(np.int32)), pa.array((slot % width).astype(np.int32)), pa.array(counts[slot])]
        yield pa.RecordBatch.from_arrays(columns, names=["u", "w", "c"])

    rows = texts.select("text").mapInArrow(run, "u int, w int, c long")
    summed = rows.groupBy("u", "w").agg(F.sum("c").alias("c"))
    # Given tables and parent, dishes are seated independently: any split of them will do.
    return summed.withColumn("block", F.pmod("w", F.lit(blocks)))


def _sample(pairs: DataFrame, model: Model, sweeps: int, burn_in: int, seed: int) -> np.ndarray:
    """Averaged predictive probabilities [context, dish]; a sweep is a job over the restaurants."""
    s, width = model.seating, model.dishes + 1
    customers = np.zeros(model.contexts + 1)
    tables = np.zeros(model.contexts + 1)
    for row in pairs.groupBy("u").agg(F.sum("c").alias("c"), F.count("*").alias("k")).collect():
        customers[row["u"]], tables[row["u"]] = row["c"], row["k"]
    parent = np.full(width, 1.0 / width)
    parent_tables = width
    kept: list[tuple[int, np.ndarray, np.ndarray]] = []

    def seated(group: pd.DataFrame, sweep: int, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        u, w = group["u"].to_numpy(), group["w"].to_numpy()
        rng = np.random.default_rng([seed, sweep, int(group["block"].iloc[0])])
        return seat(group["c"].to_numpy(), parent[w], tables[u], s.discount, s.strength, rng)

    def sweeper(sweep: int, tables: np.ndarray, parent: np.ndarray) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["u", "w"])
            return group[["u", "w"]].assign(t=seated(group, sweep, tables, parent))

        return run

    for sweep in range(sweeps):
        opened = pairs.groupBy("block").applyInPandas(sweeper(sweep, tables, parent), "u int, w int, t long")
        before, tables, arrived = tables, tables.copy(), np.zeros(width, np.int64)
        # One row for each context and each dish.
        for row in opened.groupingSets([["u"], ["w"]], "u", "w").agg(F.sum("t").alias("t")).collect():
            if row["u"] is not None:
                tables[row["u"]] = row["t"]
            else:
                arrived[row["w"]] = row["t"]
        if sweep >= burn_in:
            kept.append((sweep, before, tables, parent))
        rng = np.random.default_rng([seed, sweep])
        own = seat(arrived, np.full(width, 1.0 / width), parent_tables, s.parent_discount, s.parent_strength, rng)
        parent_tables = own.sum()
        spare = s.parent_strength + s.parent_discount * parent_tables
        parent = (arrived - s.parent_discount * own + spare / width) / (arrived.sum() + s.parent_strength)

    def averaged(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["u", "w"])
        u, c = group["u"].to_numpy(), group["c"].to_numpy()
        # The same draws as in those sweeps.
        t = np.mean([seated(group, sweep, before, parent) for sweep, before, _, parent in kept], axis=0)
        p = (c - s.discount * t) / (customers[u] + s.strength)
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], "p": [p.tobytes()], "at": [(u.astype(np.int64) * width + group["w"].to_numpy()).tobytes()]})

    # What a context leaves to its parent; one that no training text has leaves all.
    p = np.zeros((model.contexts + 1, width))
    for _, _, after, parent in kept:
        share = (s.strength + s.discount * after) / (customers + s.strength) / len(kept)
        for u in range(len(p)):
            p[u] += share[u] * parent
    flat = p.ravel()
    for row in pairs.groupBy("block").applyInPandas(averaged, "block int, p binary, at binary").collect():
        flat[np.frombuffer(row["at"], np.int64)] += np.frombuffer(row["p"], np.float64)
    return np.log10(p, out=p).astype(np.float32)


def _most_frequent(counts: DataFrame, known: int) -> tuple[pa.Table, int, int]:
    """The rows of at most ``known`` most frequent words, all tokens, all words."""
    # Counts fall into few classes of like size; the least class that still fits is the bound.
    size = F.floor(F.log2("n") * 32)
    classes = counts.groupBy(size.alias("size")).agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()
    classes.sort(key=lambda r: -r["size"])
    fits, least = 0, None
    for row in classes:
        fits += row["k"]
        if fits > known:
            break
        least = row["size"]
    # At most ``known`` rows, as columns: rows as objects would take ten times the memory.
    table = counts.filter(size >= least if least is not None else F.lit(False)).toArrow()
    return table, sum(r["n"] or 0 for r in classes), sum(r["k"] for r in classes)


def fit(
    texts: DataFrame, *, known: int = 150_000, dishes: int = 16_383, contexts: int = 255, sweeps: int = 6, burn_in: int = 3,
    seed: int = 42, seating: Seating | None = None,
) -> tuple[Model, DataFrame]:
    """The model of the rows' ``text``, and the counts of all their words.

    ``known``, ``dishes`` and ``contexts`` are the model's size: how many of the most frequent
    words have their counts broadcast, are dishes, are contexts. No rows give a model in which
    every token has probability one.
    """
    counts = cut_lineage(word_counts(texts))
    table, tokens, types = _most_frequent(counts, known)
    chosen = sorted(zip((-n for n in table.column("n").to_pylist()), table.column("word").to_pylist()))
    model = Model(seating=seating or Seating())
    model.words = {word: i for i, (_, word) in enumerate(chosen)}
    model.counts = np.array([-n for n, _ in chosen], np.int64)
    model.dishes, model.contexts = min(dishes, len(chosen)), min(contexts, len(chosen))
    model.tokens, model.types = tokens, types
    model.rare_tokens = model.tokens - int(model.counts[: model.dishes].sum())
    model.rare_types = model.types - model.dishes
    if model.tokens:
        pairs = cut_lineage(_pairs(texts, model))
        model.log_p = _sample(pairs, model, sweeps, burn_in, seed)
    else:
        model.log_p = np.zeros((1, 1), np.float32)
    return model, counts


def _known_sums(texts: DataFrame, model: Model) -> DataFrame:
    """What a task can sum of each row by itself, without the words it does not know."""
    # Plain values: tasks get this module with the function, not by import.
    shared = texts.sparkSession.sparkContext.broadcast({f.name: getattr(model, f.name) for f in fields(model) if f.name != "seating"})
    seating = model.seating

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value, seating=seating)
        base_log = np.log10(model.counts + 0.5)
        rare_log = np.log10(model.rare_count(model.counts)[0])
        for batch in parts(batches):
            rows = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                known, context, tokens = _places(text, model)
                rare = (known < 0) | (known >= model.dishes)
                seen = known[known >= 0]
                inner = rare_log[known[rare & (known >= 0)]].sum()
                outer = model.log_p[context, np.where(rare, model.dishes, known)].sum(dtype=np.float64)
                unknown = len({tokens[i] for i in np.flatnonzero(known < 0)})
                rows.append((len(tokens), len(seen), base_log[seen].sum(), inner + outer, int(rare.sum()), unknown))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *names])

    names = ["n", "known", "base", "own", "rare", "unknown"]
    ddl = "n long, known long, base double, own double, rare long, unknown long"
    return texts.mapInArrow(run, extended(texts.drop("text").schema, ddl))


def _unknown_words(texts: DataFrame, model: Model) -> DataFrame:
    """``__doc``, ``__row``, ``word``, ``times`` of the words that tasks do not know."""
    shared = texts.sparkSession.sparkContext.broadcast(set(model.words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in parts(batches):
            found = [Counter(w for w in (*words_of(text), END) if w not in known) for text in batch.column(2).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            words = pa.array([w for x in found for w in x], pa.binary())
            times = pa.array([n for x in found for n in x.values()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), words, times],
                names=["__doc", "__row", "word", "times"],
            )

    rows = texts.select("__doc", "__row", "text")
    return rows.mapInArrow(run, "__doc long, __row long, word binary, times long")


# --- every word a context and a dish ---------------------------------------------------------------


def cold_id(word: bytes) -> int:
    """The number, below zero, of a word that is not known to tasks."""
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little", signed=True) | -(1 << 63)


def _ids(text: str, words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers of a text's tokens, those of the words right before them (start: one past the known), tokens."""
    tokens = words_of(text)
    tokens.append(END)
    ids = np.fromiter(map(words.get, tokens, repeat(-1)), np.int64, len(tokens))
    for i in np.flatnonzero(ids < 0):
        ids[i] = cold_id(tokens[i])
    return ids, np.concatenate([[len(words)], ids[:-1]]), tokens


@dataclass
class Whole:
    """The model of all contexts: arrays of the known words, rows of the others and of the pairs."""

    words: dict[bytes, int]
    counts: np.ndarray
    tokens: int
    types: int
    customers: np.ndarray  # of known contexts, the start last
    share: np.ndarray  # what these leave to the parent
    p: np.ndarray  # the parent's probability of known words
    unseen: float  # and of a word that no training text has
    cold: DataFrame  # id, n, share, p
    pairs: DataFrame  # u, w, own: a seen pair's part of its probability before the parent's
    hot: np.ndarray  # numbers u x (known + 1) + w of the most frequent pairs, in order
    hot_log: np.ndarray  # values of tables end with a spare one, for keys that are not found
    complete: bool = False  # whether these are all known pairs seen more than once
    warm: tuple = (np.zeros(0, np.int64), np.zeros(1), np.zeros(1), np.zeros(1))  # id, n, share, p of the most frequent of ``cold``
    all_warm: bool = False  # whether these are all of them seen more than once
    once: tuple = (1.0, 1.0)  # share and p of a word seen once
    far: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # _pair_key of the most frequent pairs that are not hot for their words
    far_own: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    all_far: bool = False  # whether these are all such pairs seen more than once


def _scratch(df: DataFrame, label: str) -> DataFrame:
    return written(df, scratch_path(df.sparkSession, label), compression="zstd")


def _pair_counts(texts: DataFrame, words: dict[bytes, int]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [_ids(text, shared.value)[:2] for text in batch.column(0).to_pylist()]
            columns = [pa.array(np.concatenate([x[k] for x in found])) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["u", "w"])

    return texts.select("text").mapInArrow(run, "u long, w long").groupBy("u", "w").agg(F.count("*").alias("c"))


def _with_cold(rows: DataFrame, cold: DataFrame, key: str, *columns: str) -> DataFrame:
    """Left join of what ``cold`` knows of the number ``key``; known numbers meet nothing and are spread."""
    at = F.when(F.col(key) < 0, F.col(key)).otherwise(F.xxhash64("u", "w").bitwiseAND(F.lit(2**63 - 1)))
    facts = cold.select(F.col("id").alias("__at"), *[F.col(c).alias(f"{key}_{c}") for c in columns])
    return rows.withColumn("__at", at).join(facts, "__at", "left").drop("__at")


def _sides(rows: DataFrame, what) -> DataFrame:
    """``id``, ``fu``, ``fw``: sums of ``what`` over the rows with the number as context, as dish."""
    sides = rows.groupingSets([["u"], ["w"]], "u", "w").agg(what.cast("long").alias("k"))
    return sides.select(
        F.coalesce("u", "w").alias("id"), F.when(F.col("u").isNotNull(), F.col("k")).alias("fu"),
        F.when(F.col("u").isNull(), F.col("k")).alias("fw"),
    ).groupBy("id").agg(F.sum("fu").alias("fu"), F.sum("fw").alias("fw")).na.fill(0)


def _known_sides(sides: DataFrame, known: int) -> tuple[np.ndarray, np.ndarray]:
    found = sides.filter("id >= 0").toArrow()
    out = np.zeros((2, known + 1))
    for k, name in enumerate(("fu", "fw")):
        out[k, found.column("id").to_numpy()] = found.column(name).to_numpy()
    return out[0], out[1]


def _most_counted(rows: DataFrame, count: str, limit: int) -> tuple[DataFrame, int, bool]:
    """At most ``limit`` rows, as many classes of like counts as fit, how many, and whether these are all."""
    size_class = F.floor(F.log2(count) * 8)
    classes = rows.groupBy(size_class.alias("size")).agg(F.count("*").alias("k")).collect()
    fits, least = 0, None
    for row in sorted(classes, key=lambda r: -r["size"]):
        fits += row["k"]
        if fits > limit:
            break
        least = row["size"]
    chosen = rows.filter(size_class >= least if least is not None else F.lit(False))
    return chosen, sum(r["k"] for r in classes if least is not None and r["size"] >= least), fits <= limit


def _gathered(rows: DataFrame, n: int, slice_rows: int = 1_000_000) -> tuple[np.ndarray, ...]:
    """The columns of the ``n`` rows as arrays, ascending by the first; the others end with a spare 0, for keys that are not found.

    The driver fetches a slice at a time, so that beside the arrays it holds no second copy of them.
    """
    key, *names = rows.columns
    slices = -(-n // slice_rows)
    copy = _scratch(rows.withColumn("__slice", F.pmod(F.xxhash64(key), F.lit(max(slices, 1))).cast("int")), "gathered")
    kinds = {"bigint": np.int64, "float": np.float32, "double": np.float64}
    keys, values = np.empty(n, np.int64), [np.zeros(n + 1, kinds[kind]) for _, kind in rows.dtypes[1:]]
    at = 0
    for part in range(slices):
        for batch in copy.filter(F.col("__slice") == part).select(key, *names).toArrow().to_batches():
            for column, out in zip(batch.columns, (keys, *values), strict=True):
                out[at : at + batch.num_rows] = column.to_numpy()
            at += batch.num_rows
    discard(copy)
    order = np.argsort(keys)
    for value in values:
        value[:-1] = value[order]
    return keys[order], *values


def _pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a pair of numbers."""
    return _mix(_mix(u.astype(np.int64).view(np.uint64)) + w.astype(np.int64).view(np.uint64)).view(np.int64)


def fit_whole(
    texts: DataFrame, *, known: int = 150_000, hot: int = 4_000_000, warm: int = 2_000_000, warm_pairs: int = 4_000_000, sweeps: int = 6, burn_in: int = 3, seed: int = 42,
    seating: Seating | None = None,
) -> tuple[Whole, DataFrame]:
    """The model whose contexts and dishes are all words of ``text``, and the counts of all words.

    ``known`` words and ``hot`` pairs of them are broadcast, for scoring also ``warm`` further
    words and ``warm_pairs`` pairs with a word that is not known; the others meet by joins, with the same
    result. A pair seen once has one table whatever else is seated, so sweeps pass over the pairs
    seen more often. The parent's base is uniform over all words and one that was never seen. The
    averages over the sweeps from ``burn_in`` on are of a pair's tables, of what a context leaves
    to the parent, and of the parent's probabilities.
    """
    s = seating or Seating()
    counts = cut_lineage(word_counts(texts))
    table, tokens, types = _most_frequent(counts, known)
    chosen = sorted(zip((-n for n in table.column("n").to_pylist()), table.column("word").to_pylist()))
    words = {word: i for i, (_, word) in enumerate(chosen)}
    held = np.array([-n for n, _ in chosen], np.int64)
    size, spark = len(words), texts.sparkSession
    ends = counts.filter(F.col("word") == F.lit(END)).first()
    customers = np.append(held, ends["n"] if ends else 0).astype(float)
    shared_words = spark.sparkContext.broadcast(words)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(cold_id(w), n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w not in shared_words.value]
            columns = [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n"])

    ids = _scratch(counts.select("word", "n").mapInArrow(number, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")), "words")
    # A word seen once is one customer at one table, as context and as dish.
    once = ids.filter("n = 1").count()
    pairs = _scratch(_pair_counts(texts, words), "pairs")
    single = _scratch(_sides(pairs.filter("c = 1"), F.count("*")), "sides")
    su, sw = _known_sides(single, size)
    cold = ids.filter("n > 1").join(single.select("id", F.col("fu").alias("su"), F.col("fw").alias("sw")), "id", "left").na.fill(0)
    cold = cold.select("*", *[F.lit(0.0).alias(c) for c in ("share", "p")])
    opened = pairs.filter("c > 1").select("u", "w", "c", F.lit(0).cast("long").alias("kept"), F.lit(1).cast("long").alias("t"))
    base, parent_tables, kept_sweeps = 1.0 / (types + 1), float(types), 0
    share, p, unseen = np.zeros(size + 1), np.zeros(size), 0.0
    # Copies that the next of their kind replaces; the disk holds one of each.
    used, last_seated = [single], None

    def seater(sweep: int, state, keep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables, parent = state.value
            for batch in batches:
                u, w, c, kept = (batch.column(k).to_numpy() for k in range(4))
                of_u, of_w = tables[np.maximum(u, -1)], parent[np.maximum(w, -1)]
                if batch.num_columns > 4:
                    of_u = np.where(u < 0, batch.column(4).to_numpy(zero_copy_only=False), of_u)
                    of_w = np.where(w < 0, batch.column(5).to_numpy(zero_copy_only=False), of_w)
                t = seat(c, of_w, of_u, s.discount, s.strength, Hashed(seed, sweep, u, w))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (u, w, c, kept + t * keep, t))], names=["u", "w", "c", "kept", "t"])

        return run

    def parent_seater(sweep: int, parent_tables: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                number, arrived = batch.column(0).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
                t = seat(arrived, np.full(len(arrived), base), np.full(len(arrived), parent_tables), s.parent_discount, s.parent_strength, Hashed(seed, -1 - sweep, number, number))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t)], names=[*batch.schema.names, "own"])

        return run

    for sweep in range(-1, sweeps if types else -1):
        keep = sweep >= burn_in
        if sweep >= 0:
            # Of a context its tables, of a dish the parent's probability, as the last sweep left them.
            state = spark.sparkContext.broadcast((np.append(tables, 0.0), np.append(parent, 0.0)))
            both = (F.col("u") >= 0) & (F.col("w") >= 0)
            near = opened.filter(both).select("u", "w", "c", "kept").mapInArrow(seater(sweep, state, keep), opened.schema)
            now = cold.select("id", "tables", "parent")
            far = _with_cold(_with_cold(opened.filter(~both).select("u", "w", "c", "kept"), now, "u", "tables"), now, "w", "parent")
            far = far.select("u", "w", "c", "kept", F.col("u_tables").cast("double"), "w_parent")
            seated = near.union(far.mapInArrow(seater(sweep, state, keep), opened.schema))
            # Of a sweep that is not averaged nothing but the tables' sums goes on.
            if keep:
                opened = _scratch(seated, "seated")
                if last_seated is not None:
                    discard(last_seated)
                last_seated = opened
        free = _scratch(_sides(opened if keep or sweep < 0 else seated, F.sum("t")), "sides")
        fu, fw = _known_sides(free, size)
        tables, arrived = su + fu, (sw + fw)[:size].astype(np.int64)
        number = np.arange(size)
        own = seat(arrived, np.full(size, base), np.full(size, parent_tables), s.parent_discount, s.parent_strength, Hashed(seed, -1 - sweep, number, number))
        merged = cold.select("id", "n", "su", "sw", "share", "p").join(free, "id", "left").na.fill(0)
        merged = merged.select(
            "id", "n", "su", "sw", "share", "p", (F.col("su") + F.col("fu")).alias("tables"), (F.col("sw") + F.col("fw")).alias("arrived")
        )
        schema = extended(merged.schema, "own long")
        cold = _scratch(merged.mapInArrow(parent_seater(sweep, parent_tables), schema), "contexts")
        for copy in (free, *used):
            discard(copy)
        used = [cold]
        sums = cold.agg(F.sum("arrived").alias("c"), F.sum("own").alias("t")).first()
        parent_tables = float(own.sum() + (sums["t"] or 0) + once)
        total = float(arrived.sum() + (sums["c"] or 0) + once) + s.parent_strength
        spare = (s.parent_strength + s.parent_discount * parent_tables) * base
        parent = (arrived - s.parent_discount * own + spare) / total
        single_p = (1 - s.parent_discount + spare) / total
        cold = cold.withColumn("parent", (F.col("arrived") - s.parent_discount * F.col("own") + spare) / total)
        if sweep < 0:
            once_p = 0.0
        if keep:
            kept_sweeps += 1
            share += (s.strength + s.discount * tables) / (customers + s.strength)
            p += parent
            unseen += spare / total
            once_p += single_p
            left = (s.strength + s.discount * F.col("tables")) / (F.col("n") + s.strength)
            cold = cold.withColumn("share", F.col("share") + left).withColumn("p", F.col("p") + F.col("parent"))
    if not kept_sweeps:  # no training text: every token has probability one
        rows = pairs.select("u", "w", F.lit(0.0).alias("own"))
        facts = ids.select("id", "n", F.lit(1.0).alias("share"), F.lit(1.0).alias("p"))
        return Whole(words, held, tokens, types, customers, np.ones(size + 1), np.ones(size), 1.0, facts, rows, np.zeros(0, np.int64), np.zeros(1)), counts

    share, p, unseen, once_p = (x / kept_sweeps for x in (share, p, unseen, once_p))
    facts = cold.select("id", "n", (F.col("share") / kept_sweeps).alias("share"), (F.col("p") / kept_sweeps).alias("p"))
    alone = F.lit((s.strength + s.discount) / (1 + s.strength))
    facts = _scratch(facts.union(ids.filter("n = 1").select("id", "n", alone, F.lit(once_p))), "facts")
    seen = pairs.filter("c = 1").select("u", "w", "c", F.lit(float(1 - s.discount)).alias("own")).union(
        opened.select("u", "w", "c", F.col("c") - s.discount * F.col("kept") / kept_sweeps)
    )
    repeated = seen.filter("c > 1")
    known_facts = spark.sparkContext.broadcast((customers, share, p))

    def near_logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        customers, share, p = known_facts.value
        for batch in batches:
            u, w, own = (batch.column(k).to_numpy() for k in range(3))
            log = np.log10(own / (customers[u] + s.strength) + share[u] * p[w]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(u * (size + 1) + w), pa.array(log)], names=["key", "log"])

    def far_owns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, w, own = (batch.column(k).to_numpy() for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(_pair_key(u, w)), pa.array(own.astype(np.float32))], names=["key", "own"])

    top, n, complete = _most_counted(repeated.filter("u >= 0 AND w >= 0"), "c", hot)
    keys, logs = _gathered(top.select("u", "w", "own").mapInArrow(near_logs, "key long, log float"), n)
    top, n, all_far = _most_counted(repeated.filter("u < 0 OR w < 0"), "c", warm_pairs)
    far_keys, far_own = _gathered(top.select("u", "w", "own").mapInArrow(far_owns, "key long, own float"), n)
    top, n, all_warm = _most_counted(facts.filter("n > 1"), "n", warm)
    warm_facts = _gathered(top, n)
    seen = seen.select("u", "w", "own")
    once_share = (s.strength + s.discount) / (1 + s.strength)
    return Whole(
        words, held, tokens, types, customers, share, p, unseen, facts, seen, keys, logs, complete,
        warm_facts, all_warm, (once_share, once_p), far_keys, far_own, all_far,
    ), counts


def _lookups(model: Whole, seating: Seating) -> dict:
    """What tasks look up, as plain values, none of them a copy of a table."""
    return {
        "words": model.words, "counts": model.counts, "hot": model.hot, "hot_log": model.hot_log, "complete": model.complete,
        "warm": model.warm, "all_warm": model.all_warm, "once": model.once,
        "far": model.far, "far_own": model.far_own, "all_far": model.all_far,
        "customers": model.customers, "share": model.share, "p": np.append(model.p, 0.0), "unseen": model.unseen,
        "single": 1 - seating.discount, "strength": seating.strength,
    }


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in a sorted table, one past its end if they are not there, and which are."""
    at = np.searchsorted(table, keys)
    hit = np.zeros(len(keys), bool)
    inside = at < len(table)
    hit[inside] = table[at[inside]] == keys[inside]
    return np.where(hit, at, len(table)), hit


def _batch_ids(texts: list[str], words: dict[bytes, int]) -> tuple[np.ndarray, ...]:
    """Of all tokens of the texts: their text's place, the number of the word before them, their own; and the tokens."""
    tokens, lengths = [], []
    for text in texts:
        own = words_of(text)
        tokens += own
        tokens.append(END)
        lengths.append(len(own) + 1)
    w = np.fromiter(map(words.get, tokens, repeat(-1)), np.int64, len(tokens))
    for i in np.flatnonzero(w < 0):
        w[i] = cold_id(tokens[i])
    u = np.concatenate([[len(words)], w[:-1]])
    u[np.cumsum(lengths[:-1], dtype=np.int64)] = len(words)
    return np.repeat(np.arange(len(texts)), lengths), u, w, tokens


def _cold_facts(ids: np.ndarray, learned: np.ndarray, of: dict) -> tuple[np.ndarray, ...]:
    """n, share, p of words that are not known, and for which this is sure.

    If the warm words are all that were seen more than once, another word of a learned row was seen once, there.
    """
    table, n, share, p = of["warm"]
    at, hit = _found(table, ids)
    once_share, once_p = of["once"]
    facts = np.where(hit, n[at], 1.0), np.where(hit, share[at], once_share), np.where(hit, p[at], once_p)
    return *facts, hit | (learned & of["all_warm"])


def _judged(u: np.ndarray, w: np.ndarray, learned: np.ndarray, of: dict) -> tuple[np.ndarray, np.ndarray]:
    """Log10 probabilities of the pairs, and which of them a task cannot look up (there they are 0).

    ``learned``: the pair is of a row that was learned from, so training has seen it once at least.
    If the tables have all pairs seen more often, the others of such a row were seen once.
    """
    log, left, single, strength = np.zeros(len(u)), np.ones(len(u), bool), of["single"], of["strength"]
    is_near = (u >= 0) & (w >= 0)
    near = np.flatnonzero(is_near)
    at, hit = _found(of["hot"], u[near] * (len(of["words"]) + 1) + w[near])
    log[near] = of["hot_log"][at]
    left[near] = ~hit
    if of["complete"]:
        once = near[~hit & learned[near]]
        log[once] = np.log10(single / (of["customers"][u[once]] + strength) + of["share"][u[once]] * of["p"][w[once]])
        left[once] = False
    far = np.flatnonzero(~is_near)
    u, w, learned = u[far], w[far], learned[far]
    at, hit = _found(of["far"], _pair_key(u, w))
    own, sure = np.where(hit, of["far_own"][at], single), hit | (learned & of["all_far"])
    n, share, p = of["customers"][np.maximum(u, 0)], of["share"][np.maximum(u, 0)], of["p"][np.maximum(w, -1)]
    cold = np.flatnonzero(u < 0)
    n[cold], share[cold], _, known = _cold_facts(u[cold], learned[cold], of)
    sure[cold] &= known
    cold = np.flatnonzero(w < 0)
    _, _, p[cold], known = _cold_facts(w[cold], learned[cold], of)
    sure[cold] &= known
    log[far[sure]] = np.log10(own[sure] / (n[sure] + strength) + share[sure] * p[sure])
    left[far[sure]] = False
    return log, left


def _whole_sums(texts: DataFrame, shared) -> DataFrame:
    """What a task can sum of each row by itself; ``unknown`` distinct words and ``open`` pairs it cannot look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        base_log = np.log10(of["counts"] + 0.5)
        for batch in parts(batches):
            rows = batch.num_rows
            row, u, w, _ = _batch_ids(batch.column(batch.num_columns - 1).to_pylist(), of["words"])
            learned = batch.column(batch.schema.get_field_index("__learned")).to_numpy(zero_copy_only=False)[row]
            log, left = _judged(u, w, learned, of)
            near, cold = np.flatnonzero(w >= 0), np.flatnonzero(w < 0)
            n, _, _, known = _cold_facts(w[cold], learned[cold], of)
            base = np.bincount(row[near], base_log[w[near]], rows).astype(float)  # none gives whole numbers
            base += np.bincount(row[cold[known]], np.log10(n[known] + 0.5), rows)
            seen = np.bincount(row[near], minlength=rows) + np.bincount(row[cold[known]], minlength=rows)
            asked = np.stack([row[cold[~known]], w[cold[~known]]], axis=1)
            unknown = np.bincount(np.unique(asked, axis=0)[:, 0], minlength=rows)
            sums = [np.bincount(row, minlength=rows), seen, base, np.bincount(row, log, rows), unknown, np.bincount(row[left], minlength=rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, sums)], names=[*batch.schema.names[:-1], *names])

    names = ["n", "known", "base", "own", "unknown", "open"]
    ddl = "n long, known long, base double, own double, unknown long, open long"
    return texts.mapInArrow(run, extended(texts.drop("text").schema, ddl))


def _open_words(texts: DataFrame, shared) -> DataFrame:
    """``__doc``, ``__row``, ``word``, ``times`` of the words that tasks cannot look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in parts(batches):
            row, _, w, tokens = _batch_ids(batch.column(2).to_pylist(), of["words"])
            cold = np.flatnonzero(w < 0)
            learned = batch.column(3).to_numpy(zero_copy_only=False)[row[cold]]
            cold = cold[~_cold_facts(w[cold], learned, of)[3]]
            found = Counter((int(row[i]), tokens[i]) for i in cold)
            at = pa.array([k for k, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array([x for _, x in found], pa.binary()), pa.array(list(found.values()), pa.int64())],
                names=["__doc", "__row", "word", "times"],
            )

    rows = texts.select("__doc", "__row", "text", "__learned")
    return rows.mapInArrow(run, "__doc long, __row long, word binary, times long")


def _open_pairs(texts: DataFrame, shared) -> DataFrame:
    """``__doc``, ``__row``, ``u``, ``w`` of the pairs that tasks cannot look up, as often as they are in a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in parts(batches):
            row, u, w, _ = _batch_ids(batch.column(2).to_pylist(), of["words"])
            left = np.flatnonzero(_judged(u, w, batch.column(3).to_numpy(zero_copy_only=False)[row], of)[1])
            at = pa.array(row[left])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(u[left]), pa.array(w[left])],
                names=["__doc", "__row", "u", "w"],
            )

    rows = texts.select("__doc", "__row", "text", "__learned")
    return rows.mapInArrow(run, "__doc long, __row long, u long, w long")


def _open_sums(rows: DataFrame, model: Whole, shared) -> DataFrame:
    """``o_own``, ``o_rows`` of each row: the log10 probability of its open pairs, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        customers, share, p, unseen, strength = (shared.value[k] for k in ("customers", "share", "p", "unseen", "strength"))
        for batch in batches:
            u, w, own, of_n, of_share, of_p = (batch.column(k).to_numpy(zero_copy_only=False).astype(kind) for k, kind in zip(range(2, 8), (np.int64,) * 2 + (float,) * 4))
            near_u, near_w = np.maximum(u, -1), np.maximum(w, -1)
            # A context of no training text leaves all to the parent.
            n = np.where(u < 0, np.nan_to_num(of_n), customers[near_u])
            left = np.where(u < 0, np.where(np.isnan(of_share), 1.0, of_share), share[near_u])
            parent = np.where(w < 0, np.where(np.isnan(of_p), unseen, of_p), p[near_w])
            log = np.log10(np.nan_to_num(own) / (n + strength) + left * parent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(log)], names=["__doc", "__row", "log"])

    # Written once: near and far pairs would each read and split all texts.
    asked = _scratch(_open_pairs(rows, shared), "open")
    near = (F.col("u") >= 0) & (F.col("w") >= 0)
    met, far = (asked.filter(side).join(model.pairs.filter(side), ["u", "w"], "left") for side in (near, ~near))
    far = _with_cold(_with_cold(far, model.cold, "u", "n", "share"), model.cold, "w", "p")
    none = [F.lit(None).cast("double").alias(c) for c in ("u_n", "u_share", "w_p")]
    columns = ["__doc", "__row", "u", "w", "own"]
    sides = [met.select(*columns, *none), far.select(*columns, F.col("u_n").cast("double"), "u_share", "w_p")]
    # One after the other: the disk holds what one of the two shuffles.
    logs = [side.mapInArrow(run, "__doc long, __row long, log double").groupBy("__doc", "__row") for side in sides]
    logs = [_scratch(side.agg(F.sum("log").alias("log"), F.count("*").alias("n")), "sums") for side in logs]
    discard(asked)
    return logs[0].union(logs[1]).groupBy("__doc", "__row").agg(F.sum("log").alias("o_own"), F.sum("n").alias("o_rows"))


def _score_whole(texts: DataFrame, held_out: int, options: dict) -> DataFrame:
    seating = options.get("seating") or Seating()
    model, counts = fit_whole(texts.filter(fold("doc_id") != held_out), **options)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    learned = (fold("doc_id") != held_out).alias("__learned")
    rows = texts.select("doc_id", doc.alias("__doc"), F.xxhash64("text").alias("__row"), learned, "text")
    shared = texts.sparkSession.sparkContext.broadcast(_lookups(model, seating))
    # Where the tables have all that was seen more than once, tasks know all of a learned row.
    asking = rows.filter("NOT __learned") if model.complete and model.all_warm and model.all_far else rows
    met = _open_words(asking, shared).join(counts.select("word", F.col("n").alias("c")), "word", "left")
    c, times = F.coalesce("c", F.lit(0)), F.col("times")
    per_row = met.groupBy("__doc", "__row").agg(
        F.sum(times * F.log10(c + 0.5)).alias("t_base"),
        F.sum(F.when(F.col("c").isNull(), 0).otherwise(times)).alias("t_known"), F.count("*").alias("t_rows"),
    )
    # Equal rows have met their words together: each takes its share.
    share = F.col("unknown") / F.col("t_rows")
    found = _whole_sums(rows, shared).join(per_row, ["__doc", "__row"], "left")
    found = found.join(_open_sums(asking, model, shared), ["__doc", "__row"], "left")
    zero = lambda value: F.coalesce(value, F.lit(0.0))
    base_size = float(np.log10(model.tokens + 0.5 * (model.types + 1)))
    out = found.select(
        "doc_id", (fold("doc_id") == held_out).alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce(F.round(F.col("t_known") * share), F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero(F.col("t_base") * share) - F.col("n") * base_size).alias("base_score"),
        (F.col("own") + zero(F.col("o_own") * F.col("open") / F.col("o_rows"))).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def score_documents(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", held_out: int = 1, **options
) -> DataFrame:
    """Log10 probability of every document under the model and under the smoothed unigram base.

    Learns from rows whose crc32(id) modulo 5 is not ``held_out``. Returns ``doc_id``,
    ``held_out``, ``n_tokens`` (words and one end), ``n_known`` (tokens seen in training),
    ``train_tokens``, ``base_score``, ``score``, ``perplexity``. NULL and empty texts are one end.
    Rows equal in id and text have equal results. Other columns are not read. ``options`` are
    those of :func:`fit_whole`, or with ``contexts`` or ``dishes`` among them those of :func:`fit`.
    """
    texts = _texts(docs, id_column, text_column)
    if "contexts" not in options and "dishes" not in options:
        return _score_whole(texts, held_out, options)
    model, counts = fit(texts.filter(fold("doc_id") != held_out), **options)
    # Rows of one id are told apart by their texts.
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = texts.select("doc_id", doc.alias("__doc"), F.xxhash64("text").alias("__row"), "text")
    seen, unseen = model.rare_count(F.col("c"))
    met = _unknown_words(rows, model).join(counts.select("word", F.col("n").alias("c")), "word", "left")
    c, times = F.coalesce("c", F.lit(0)), F.col("times")
    per_row = met.groupBy("__doc", "__row").agg(
        F.sum(times * F.log10(c + 0.5)).alias("t_base"),
        F.sum(times * F.log10(F.when(F.col("c").isNull(), F.lit(unseen)).otherwise(seen))).alias("t_own"),
        F.sum(F.when(F.col("c").isNull(), 0).otherwise(times)).alias("t_known"),
        F.count("*").alias("t_rows"),
    )
    # Equal rows have met their words together: each takes its share.
    share = F.col("unknown") / F.col("t_rows")
    found = _known_sums(rows, model).join(per_row, ["__doc", "__row"], "left")
    found = found.select(
        "*", (F.col("t_base") * share).alias("s_base"), (F.col("t_own") * share).alias("s_own"),
        F.round(F.col("t_known") * share).alias("s_known"),
    )
    zero = lambda name: F.coalesce(name, F.lit(0.0))
    base_size = float(np.log10(model.tokens + 0.5 * (model.types + 1)))
    rare_size = float(np.log10(model.rare_size()))
    out = found.select(
        "doc_id", (fold("doc_id") == held_out).alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("s_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("s_base") - F.col("n") * base_size).alias("base_score"),
        (F.col("own") + zero("s_own") - F.col("rare") * rare_size).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
