"""Phrase collocations counted in a prefix-free parse.

Texts are cut where a window of four words hashes to a trigger. Each chunk begins with its
trigger's window and ends with the next one's, so neighbours overlap by four words and every phrase
of up to five words lies whole in one chunk. Equal chunks of all texts become one entry of a
dictionary with the number of its parses. Phrases are counted in the entries, by that weight, each
at the chunk that owns its first word: the overlap is counted once.

Rare phrases are kept from the count by what they consist of: a phrase is no more frequent than
its words and its pairs. Filters of the frequent words and pairs (by hash, never missing one) tell
which phrases to count at all; the count itself is of whole phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deedscope.llm.blocked_bloom import build, passes, spread
from deedscope.llm.common import text_parts
from deedscope.plans.lineage import scratch_path

LONGEST = 5
OVERLAP = LONGEST - 1
WORD_BYTE, BLANK, BREAK = 0, 1, 2
NO_LANG = "und"

KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
# A number for each byte value, and the factor of a byte's place in its word.
BYTE_VALUES = spread(np.arange(1, 257))
PLACE_FACTOR = np.uint64(0x9E3779B97F4A7C15)
GRAM_FACTOR = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Words:
    """The words of the texts of a slice, laid end to end.

    ``text`` holds them lower-cased, each followed by one byte: a blank, or a line end where a piece
    ends; word i is ``text[at[i] : at[i] + size[i]]``. ``row`` is the text it comes from, ``left``
    how many words its piece has from it on, itself included.
    """

    text: np.ndarray
    at: np.ndarray
    size: np.ndarray
    row: np.ndarray
    left: np.ndarray
    hashes: np.ndarray

    def keys(self, longest: int) -> list[np.ndarray]:
        """For each size up to ``longest`` the hash of the phrase that begins at each word."""
        found = [self.hashes]
        for more in range(1, longest):
            longer = found[-1] * GRAM_FACTOR
            longer[: len(longer) - more] += self.hashes[more:]
            found.append(spread(longer.view(np.int64)))
        return found


def words_of(texts: pa.Array, seeds: np.ndarray) -> Words:
    """The words of ``texts``; ``seeds`` makes equal words of different rows' languages differ."""
    ended = pc.binary_join_element_wise(pc.fill_null(texts, ""), "", "\n").cast(pa.large_binary())
    offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    data = np.frombuffer(ended.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = KIND[data]
    inside = kind == WORD_BYTE
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(data[:0], none, none, none, none, none.view(np.uint64))
    # Every text ends in a line end, so each word has a byte after it.
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    size = ends - starts
    row = np.repeat(np.arange(len(ended)), np.diff(np.searchsorted(starts, offsets)))
    piece = np.cumsum(kind == BREAK)[starts]
    last = np.append(np.flatnonzero(piece[1:] != piece[:-1]), len(starts) - 1)
    run = np.diff(last, prepend=-1)
    left = np.repeat(last, run) - np.arange(len(starts)) + 1
    lowered = LOWER[data]
    kept = inside.copy()
    kept[ends] = True
    lowered[ends] = ord(" ")
    lowered[ends[last]] = ord("\n")
    spans = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    factors = np.cumprod(np.full(int(place.max()) + 1, PLACE_FACTOR))
    values = BYTE_VALUES[lowered[starts[0] :]] * factors[place]
    values[~inside[starts[0] :]] = 0
    hashes = np.add.reduceat(values, starts - starts[0]) + seeds[row].astype(np.int64).view(np.uint64)
    at = np.cumsum(size + 1) - size - 1
    return Words(lowered[kept], at, size, row, left, spread(hashes.view(np.int64)))


def parse(docs: DataFrame, *, chunk_words: int = 64) -> DataFrame:
    """The dictionary of the parse: distinct chunks per language, with the number of their parses.

    Returns lang, chunk (words joined by a space, or by a line end where a piece ends), own (how
    many of its words are its own, not the next chunk's) and times. A chunk has ``chunk_words`` words
    on average; a text without a trigger is one chunk, whole. NULL texts count as empty, NULL
    languages as ``und``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_parts(batches, 1):
            words = words_of(batch.column(1), np.zeros(batch.num_rows, np.int64))
            n = len(words.row)
            if not n:
                continue
            # First words of texts, and words whose window of the same text is a trigger.
            starts = np.ones(n, bool)
            starts[1:] = words.row[1:] != words.row[:-1]
            window = words.keys(OVERLAP)[-1]
            text_end = np.append(np.flatnonzero(starts)[1:], n)[np.cumsum(starts) - 1]
            starts |= (window % np.uint64(chunk_words) == 0) & (np.arange(n) + OVERLAP <= text_end)
            begin = np.flatnonzero(starts)
            end = np.append(begin[1:], n)
            last = np.minimum(end + OVERLAP, text_end[begin]) - 1
            text = words.text.tobytes()
            spans = zip(words.at[begin].tolist(), (words.at + words.size)[last].tolist(), strict=True)
            chunks = pa.array([text[at:to] for at, to in spans], pa.binary()).cast(pa.string())
            lang = batch.column(0).take(pa.array(words.row[begin]))
            yield pa.RecordBatch.from_arrays([lang, chunks, pa.array(end - begin, pa.int64())], names=["lang", "chunk", "own"])

    rows = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    chunks = rows.mapInArrow(run, "lang string, chunk string, own long")
    return chunks.groupBy("lang", "chunk", "own").agg(F.count("*").alias("times"))


@dataclass
class Slice:
    """Words of some dictionary entries, which of them are counted, and by what weight."""

    words: Words
    own: np.ndarray
    times: np.ndarray
    lang: pa.Array


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    """Batches of (lang, chunk, own, times, seed) as words."""
    for batch in text_parts(batches, 1):
        seeds = batch.column(4).to_numpy(zero_copy_only=False)
        words = words_of(batch.column(1), seeds)
        own, times = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        first = np.searchsorted(words.row, np.arange(batch.num_rows))
        place = np.arange(len(words.row)) - first[words.row]
        yield Slice(words, place < own[words.row], times[words.row], batch.column(0))


def may_be_frequent(words: Words, keys: list[np.ndarray], filters: list[np.ndarray], size: int) -> np.ndarray:
    """At which words a phrase of ``size`` words begins, all of whose parts the filters let pass."""
    alive = words.left >= size
    for part, known in enumerate(filters[: size - 1], 1):
        passed = np.zeros(len(alive), bool)
        # Only parts of phrases that are still alive are looked up.
        asked = np.zeros(len(alive), bool)
        for shift in range(size - part + 1):
            asked[shift:] |= alive[: len(alive) - shift]
        at = np.flatnonzero(asked)
        passed[at] = passes(known, keys[part - 1][at].view(np.int64))
        for shift in range(size - part + 1):
            alive[: len(alive) - shift] &= passed[shift:]
    return alive


def totals(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct key a place where it stands, and the sum of its weights."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, np.int64)
    return order[first], np.add.reduceat(weights[order], first) if len(keys) else weights[:0]


def frequent_keys(entries: DataFrame, filters: list[np.ndarray], least: int) -> DataFrame:
    """Hashes of the phrases one word longer than the filters go, with a count of ``least`` or more."""
    size, held = len(filters) + 1, entries.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keys = part.words.keys(size)
            at = np.flatnonzero(may_be_frequent(part.words, keys, held.value, size) & part.own)
            first, n = totals(keys[-1][at], part.times[at])
            found = [pa.array(keys[-1][at][first].view(np.int64)), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(found, names=["key", "n"])

    return entries.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def frequent_phrases(entries: DataFrame, filters: list[np.ndarray], least: int) -> DataFrame:
    """All phrases of up to five words found ``least`` times or more: lang, size, phrase, f."""
    held = entries.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, keys = part.words, part.words.keys(LONGEST)
            text, ends = words.text.tobytes(), words.at + words.size
            for size in range(1, LONGEST + 1):
                alive = may_be_frequent(words, keys, held.value, size) & part.own
                if size <= len(held.value):
                    at = np.flatnonzero(alive)
                    alive[at] = passes(held.value[size - 1], keys[size - 1][at].view(np.int64))
                at = np.flatnonzero(alive)
                first, n = totals(keys[size - 1][at], part.times[at])
                at = at[first]
                spans = zip(words.at[at].tolist(), ends[np.minimum(at + size, len(ends)) - 1].tolist(), strict=True)
                columns = [
                    part.lang.take(pa.array(words.row[at])),
                    pa.array(np.full(len(at), size), pa.int32()),
                    pa.array([text[x:y] for x, y in spans], pa.binary()).cast(pa.string()),
                    pa.array(n, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "size", "phrase", "f"])

    rows = entries.mapInArrow(run, "lang string, size int, phrase string, f long")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def count_phrases(
    docs: DataFrame, *, least: int = 100, chunk_words: int = 64, filter_sizes: int = 3, max_filter_bytes: int = 32 << 20
) -> tuple[DataFrame, DataFrame]:
    """The frequent phrases (lang, size, phrase, f) and the words of each language (lang, n).

    The dictionary and the phrases are written to the shared folder, so a lost executor costs its
    tasks only. Filters hold the frequent phrases of up to ``filter_sizes`` words; a filter that
    its bound makes too small lets more rare phrases be counted, and none be missed.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "parse")
    parse(docs, chunk_words=chunk_words).write.parquet(path)
    dictionary = spark.read.parquet(path)
    entries = dictionary.select("lang", "chunk", "own", "times", F.xxhash64("lang").alias("seed"))
    filters: list[np.ndarray] = []
    while len(filters) < filter_sizes:
        kept = scratch_path(spark, "frequent-keys")
        frequent_keys(entries, filters, least).write.parquet(kept)
        keys = spark.read.parquet(kept)
        filters.append(build(keys, "key", keys.count(), max_bytes=max_filter_bytes))
    path = scratch_path(spark, "frequent-phrases")
    frequent_phrases(entries, filters, least).write.parquet(path)
    words = dictionary.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n"))
    return spark.read.parquet(path), words


def weakest_cuts(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Each phrase of two words or more with its lowest-scoring cut, the earliest of equal ones."""
    cuts = phrases.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    found = cuts.select(
        "*", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - size)").alias("right")
    )
    parts = phrases.select("lang", "phrase", "f")
    left = parts.withColumnsRenamed({"phrase": "left", "f": "l"})
    right = parts.withColumnsRenamed({"phrase": "right", "f": "r"})
    exact = lambda x: F.expr(f"cast({x} as decimal(19, 0))")  # noqa: E731 - two of them make 38 digits
    met = found.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(F.broadcast(words), "lang")
    met = met.withColumn("top", exact("1000 * a") * exact("n")).withColumn("below", exact("l") * exact("r"))
    met = met.withColumn("score", F.expr("top div below"))
    least = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return met.groupBy("lang", "phrase", "size", "a", "n").agg(least).select(
        "lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score"
    )


def inside_longer(phrases: DataFrame) -> DataFrame:
    """Phrases that a longer one of the same count contains, as lang, phrase, a.

    What lies between a phrase and a longer one has a count between theirs, so if any longer one
    counts as often, one that is a single word longer does.
    """
    longer = phrases.filter(F.col("size") > 2)
    sides = [
        F.expr("substring_index(phrase, ' ', size - 1)"),
        F.expr("substring_index(phrase, ' ', 1 - size)"),
    ]
    return longer.select("lang", F.explode(F.array(*sides)).alias("phrase"), F.col("f").alias("a")).distinct()


def mine(docs: DataFrame, *, least: int = 100, top: int = 2000, **counting) -> DataFrame:
    """The ``top`` collocations of each language.

    A candidate is a phrase of 2 to 5 words with ``least`` occurrences or more; its score is that of
    its weakest cut, floor(1000 a n / (l r)). Candidates that a longer one contains as often as
    they occur are dropped. Returns lang, rank, phrase, a, l, r, n, score. NULL and empty texts
    have no words, NULL languages count as ``und``, repeated rows count as often as they stand;
    further columns are not read; an empty table gives no rows.
    """
    phrases, words = count_phrases(docs, least=least, **counting)
    kept = weakest_cuts(phrases, words).join(inside_longer(phrases), ["lang", "phrase", "a"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
