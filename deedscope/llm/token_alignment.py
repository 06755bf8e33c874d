"""Alignment of two tokenizers' tokens by a galloping intersection of where they end.

Tokens of both tokenizers tile the same bytes. Their end offsets are two ascending lists; the
shorter one drives an exponential and then a binary search into the longer. Offsets in both cut
the tokens into groups, and the difference of two neighbouring ranks is the range of tokens that
one token overlaps. Texts of an Arrow slice are laid end to end, so that one search serves them all.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deedscope.llm.common import extended, parts, text_parts
from deedscope.plans.lineage import scratch_path, written

SPACE_MARK = "▁"
FANOUT = 8


def search_from(targets: np.ndarray, into: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each target the number of elements of ``into`` below it, at least ``low`` of them.

    The distance from ``low`` is doubled until it passes the target, then halved: the cost is the
    logarithm of how far the target lies from where its search begins.
    """
    low, high = low.copy(), low.copy()
    going, jump = np.arange(len(targets)), 1
    while going.size:
        at = high[going]
        inside = at < len(into)
        inside[inside] = into[at[inside]] < targets[going[inside]]
        going = going[inside]
        low[going] = high[going] + 1
        high[going] = np.minimum(low[going] + jump, len(into))
        jump *= 2
    going = np.flatnonzero(low < high)
    while going.size:
        middle = (low[going] + high[going]) >> 1
        below = into[middle] < targets[going]
        low[going] = np.where(below, middle + 1, low[going])
        high[going] = np.where(below, high[going], middle)
        going = going[low[going] < high[going]]
    return low


def gallop(drive: np.ndarray, into: np.ndarray) -> np.ndarray:
    """For each element of ``drive`` the number of elements of ``into`` below it; both ascend.

    Every 8^k-th element is placed first; those between begin where the one before them landed,
    so that all of a level go on at once and each has only a short way.
    """
    rank = np.zeros(len(drive), np.int64)
    stride = 1
    while stride * FANOUT < len(drive):
        stride *= FANOUT
    at = np.arange(0, len(drive), stride)
    rank[at] = search_from(drive[at], into, np.zeros(len(at), np.int64))
    while stride > 1:
        anchors, stride = stride, stride // FANOUT
        at = np.arange(0, len(drive), stride)
        at = at[at % anchors != 0]
        rank[at] = search_from(drive[at], into, rank[at // anchors * anchors])
    return rank


@dataclass
class Crossing:
    """Two tilings of the same bytes: ``shared`` ends by index in each, and links as index pairs."""

    shared: tuple[np.ndarray, np.ndarray]
    links: tuple[np.ndarray, np.ndarray]


def cross(ends_a: np.ndarray, ends_b: np.ndarray) -> Crossing:
    """Where two tilings end together, and every pair of tokens whose byte ranges overlap."""
    swapped = len(ends_b) < len(ends_a)
    drive, into = (ends_b, ends_a) if swapped else (ends_a, ends_b)
    rank = gallop(drive, into)
    together = into[np.minimum(rank, len(into) - 1)] == drive if len(into) else np.zeros(0, bool)
    # A token overlaps from the first token that ends past its own begin to the first that ends at
    # its end or later.
    begin = np.concatenate([[0], (rank + together)[:-1]]) if len(rank) else rank
    many = rank - begin + 1
    driver = np.repeat(np.arange(len(drive)), many)
    other = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - begin, many)
    shared, links = (np.flatnonzero(together), rank[together]), (driver, other)
    return Crossing(shared[::-1], links[::-1]) if swapped else Crossing(shared, links)


class Tokens:
    """The ids of texts and the bytes each id stands for."""

    def __init__(self, entries: list[bytes]) -> None:
        self.every = np.frombuffer(b"".join(entries), np.uint8)
        self.size = np.array([len(x) for x in entries], np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        place = np.arange(size.sum()) + np.repeat(self.begin[ids] - (np.cumsum(size) - size), size)
        return self.every[place].tobytes()


def letter_bytes() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones are themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe(Tokens):
    """Space and text by a byte-level BPE in JSON form; special tokens' strings are plain text.

    A vocabulary whose ids are the ranks of its merges is run by the library that takes ranks,
    four times as fast; others, and texts that it gives up on, by the library of the format.
    """

    def __init__(self, config: str, pattern: str) -> None:
        from tokenizers import Tokenizer

        def slow() -> Tokenizer:
            made = Tokenizer.from_str(config)
            made.encode_special_tokens = True
            return made

        self.slow = cache(slow)  # made when a text needs it: most tasks never do
        read = json.loads(config)
        special = {x["content"] for x in read.get("added_tokens", [])}
        letters = letter_bytes()
        vocabulary = read["model"]["vocab"]
        entries = [b""] * (1 + max([*vocabulary.values(), *[x["id"] for x in read.get("added_tokens", [])]]))
        for token, at in vocabulary.items():
            entries[at] = token.encode() if token in special else bytes(letters[c] for c in token)
        super().__init__(entries)
        ranks = {entries[at]: at for token, at in vocabulary.items() if token not in special}
        pairs = [x.split(" ") if isinstance(x, str) else x for x in read["model"]["merges"]]
        merged = [vocabulary["".join(pair)] for pair in pairs]
        self.fast = None
        if merged == sorted(merged) and len(merged) + 256 == len(ranks) and min(merged) == 256:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            try:
                ids = self.fast.encode_to_numpy(" " + text, disallowed_special=()) if self.fast else None
            except BaseException as gave_up:  # the pattern's engine stops at very long runs of white space
                if not isinstance(gave_up, Exception) and type(gave_up).__name__ != "PanicException":
                    raise
                ids = None
            if ids is None:
                ids = np.array(self.slow().encode(" " + text, add_special_tokens=False).ids)
            out.append(ids.astype(np.int64))
        return out


class Pieces(Tokens):
    """Text by a sentence-piece model, which puts the space in front itself."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__(
            [
                bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace(SPACE_MARK, " ").encode()
                for i, name in enumerate(names)
            ]
        )

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


@dataclass
class Aligned:
    """The tokens of several texts, laid end to end, and how the two sides cross.

    ``rows_a`` and ``rows_b`` are the numbers of tokens of each text; texts without tokens have none.
    """

    a: np.ndarray
    b: np.ndarray
    rows_a: np.ndarray
    rows_b: np.ndarray
    crossing: Crossing


def align_texts(texts: list[str | None], first: Tokens, second: Tokens) -> Aligned:
    """Both sides' tokens of all texts; none where they don't join to a space and the text."""
    wanted = [b" " + text.encode() if text else b"" for text in texts]
    sides = []
    for side in (first, second):
        full = iter(side.encode([text for text in texts if text]))
        sides.append([next(full) if text else np.zeros(0, np.int64) for text in texts])
    right = np.ones(len(texts), bool)
    for side, rows in zip((first, second), sides, strict=True):
        joined, at = side.joined(np.concatenate([*rows, np.zeros(0, np.int64)])), 0
        for i, (ids, text) in enumerate(zip(rows, wanted, strict=True)):
            to = at + int(side.size[ids].sum())
            right[i] &= joined[at:to] == text
            at = to
    a, b = ([ids if ok else ids[:0] for ids, ok in zip(rows, right, strict=True)] for rows in sides)
    flat_a, flat_b = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
    crossing = cross(np.cumsum(first.size[flat_a]), np.cumsum(second.size[flat_b]))
    return Aligned(flat_a, flat_b, np.array([*map(len, a)], np.int64), np.array([*map(len, b)], np.int64), crossing)


def group_of(shared: np.ndarray, n: int) -> np.ndarray:
    """The group of each of ``n`` tokens: how many shared ends lie before it."""
    ends = np.zeros(n + 1, np.int64)
    ends[shared + 1] = 1
    return np.cumsum(ends)[:n]


def group_digests(found: Aligned) -> list[str]:
    """Per text the SHA-256 of its groups, written ``a1,a2|b1;a3|b2,b3``; '' for texts without tokens."""
    (end_a, end_b), n_a, n_b = found.crossing.shared, len(found.a), len(found.b)
    # A token's place among both sides' tokens: groups in order, in each the first side's tokens first.
    before_b = np.concatenate([[0], end_b + 1])
    place_a = np.arange(n_a) + before_b[group_of(end_a, n_a)]
    place_b = np.arange(n_b) + (end_a + 1)[group_of(end_b, n_b)] if n_b else np.zeros(0, np.int64)
    width = max(len(str(x)) for x in (found.a.max(initial=0), found.b.max(initial=0)))
    ids = np.empty(n_a + n_b, np.int64)
    ids[place_a], ids[place_b] = found.a, found.b
    text = np.zeros((n_a + n_b, width + 1), np.uint8)
    rest = ids.copy()
    for column in range(width - 1, -1, -1):
        rest, digit = np.divmod(rest, 10)
        text[:, column] = digit + ord("0")
    # Leading zeros are zero bytes, which are left out at the end.
    for column in range(width - 1):
        text[ids < 10 ** (width - 1 - column), column] = 0
    text[:, width] = ord(",")
    text[place_a[end_a], width] = ord("|")
    text[place_b[end_b], width] = ord(";")
    rows = np.cumsum(found.rows_a + found.rows_b)
    text[rows[rows > 0] - 1, width] = 0
    used = text != 0
    sizes = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
    flat, ends = text[used].tobytes(), sizes[np.concatenate([[0], rows])]
    return [
        hashlib.sha256(flat[at:to]).hexdigest() if to > at else "" for at, to in zip(ends[:-1], ends[1:], strict=True)
    ]


def tokenizers_of(docs: DataFrame, first_file: str, second_file: str):
    """Both vocabularies, read where the driver has them and sent to the workers."""
    with open(first_file, encoding="utf-8") as one, open(second_file, "rb") as two:
        return docs.sparkSession.sparkContext.broadcast((one.read(), two.read()))


def list_column(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind))


def align(docs: DataFrame, first_file: str, second_file: str, pattern: str, *, text_column: str = "text") -> DataFrame:
    """``docs`` with both sides' ids and the groups they fall into.

    Adds ``a_ids``, ``b_ids`` (array<int>) and, per group, the number of its tokens on each side,
    ``a_counts`` and ``b_counts``. NULL and empty texts, and texts whose tokens don't join to a space
    and the text, have empty arrays. Columns of these names are replaced; all others pass through.
    """
    names = ["a_ids", "b_ids", "a_counts", "b_counts"]
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    at, files = kept.index(text_column), tokenizers_of(docs, first_file, second_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = ByteBpe(files.value[0], pattern), Pieces(files.value[1])
        for batch in text_parts(batches, at):
            found = align_texts(batch.column(at).to_pylist(), first, second)
            columns = [list_column(found.a, found.rows_a, pa.int32()), list_column(found.b, found.rows_b, pa.int32())]
            groups = None
            for ends, sizes in zip(found.crossing.shared, (found.rows_a, found.rows_b), strict=True):
                text = np.repeat(np.arange(len(sizes)), sizes)[ends]
                groups = np.bincount(text, minlength=len(sizes)) if groups is None else groups
                columns.append(list_column(np.diff(ends, prepend=-1), groups, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, *names])

    added = "a_ids array<int>, b_ids array<int>, a_counts array<int>, b_counts array<int>"
    return rows.mapInArrow(run, extended(rows.schema, added))


def linked_pairs(docs: DataFrame, first_file: str, second_file: str, pattern: str) -> DataFrame:
    """Per document its counts, the digest of its groups, and its distinct linked id pairs.

    ``pairs`` holds (A id) * 2^32 + (B id), ``times`` how many links are of that pair.
    """
    files = tokenizers_of(docs, first_file, second_file)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = ByteBpe(files.value[0], pattern), Pieces(files.value[1])
        for batch in text_parts(batches, 1):
            found = align_texts(batch.column(1).to_pylist(), first, second)
            n, many_b = len(found.rows_a), len(second.size)
            text_a = np.repeat(np.arange(n), found.rows_a)
            link_a, link_b = found.crossing.links
            of = text_a[link_a]
            # A slice's texts and both vocabularies leave room: 2^12 * 2^16 * 2^15.
            every = (of * len(first.size) + found.a[link_a]) * many_b + found.b[link_b]
            pairs, times = np.unique(every, return_counts=True)
            a, b = np.divmod(pairs % (len(first.size) * many_b), many_b)
            distinct = np.bincount(pairs // (len(first.size) * many_b), minlength=n)
            counts = [found.rows_a, found.rows_b, np.bincount(text_a[found.crossing.shared[0]], minlength=n)]
            counts.append(np.bincount(of, minlength=n))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(x, pa.int64()) for x in counts],
                    pa.array(group_digests(found), pa.string()),
                    list_column(a << 32 | b, distinct, pa.int64()),
                    list_column(times, distinct, pa.int32()),
                ],
                names=names,
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return rows.mapInArrow(run, schema)


def pair_counts(linked: DataFrame) -> DataFrame:
    """Of each id pair: how many documents hold it linked, and whether that is its A id's highest."""
    counts = linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """What runs inside sends Python at most ``rows`` rows at a time: texts and pair lists are wide."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def score_links(
    docs: DataFrame, first_file: str, second_file: str, pattern: str, *, max_broadcast_pairs: int = 4_000_000
) -> DataFrame:
    """Per document how its links fare corpus-wide.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many documents as
    the best one of its A id), count_sum (documents of its pair, over all links), groups_sha256.
    Each text is encoded once: its pairs are written to the shared folder, counted, and met by the
    counts, which are sent to the workers up to ``max_broadcast_pairs`` of them and joined by
    shuffle beyond. The result is written there, too, in small batches. NULL, empty and unaligned texts have zeros and ''; rows are not told apart by
    their id, so repeated and NULL ids keep a row each; further columns are not read. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "linked-pairs")
    with small_batches(spark):
        linked_pairs(docs, first_file, second_file, pattern).write.parquet(path)
    linked = spark.read.parquet(path)
    counted = scratch_path(spark, "pair-counts")
    pair_counts(linked).write.parquet(counted)
    counts = spark.read.parquet(counted)
    known = counts.count()
    met = _met_by_broadcast(linked, counts) if known <= max_broadcast_pairs else _met_by_join(linked, counts)
    with small_batches(spark):
        return written(met, scratch_path(spark, "scored-links"))


KEPT = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]


def _met_by_broadcast(linked: DataFrame, counts: DataFrame) -> DataFrame:
    table = counts.sort("pair").toArrow()
    held = linked.sparkSession.sparkContext.broadcast(
        tuple(table.column(c).to_numpy() for c in ("pair", "n_docs", "best"))
    )
    names = [*KEPT, "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n_docs, best = held.value
        for batch in parts(batches):
            lists = batch.column(len(names) - 2)
            ends = lists.offsets.to_numpy()
            times = batch.column(len(names) - 1).flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(pair, lists.flatten().to_numpy())
            sums = [np.concatenate([[0], np.cumsum(times * x[at])]) for x in (best, n_docs)] if len(at) else []
            rows = ends - ends[0]
            added = [pa.array(x[rows[1:]] - x[rows[:-1]], pa.int64()) for x in sums]
            added = added or [pa.array(np.zeros(batch.num_rows, np.int64))] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(KEPT)], *added, batch.column(len(KEPT))], names=names)

    rows = linked.select(*KEPT, "groups_sha256", "pairs", "times")
    schema = ", ".join(f"{c} long" for c in names[:-1]) + ", groups_sha256 string"
    return rows.mapInArrow(run, schema)


def _met_by_join(linked: DataFrame, counts: DataFrame) -> DataFrame:
    # Numbered in a table that is written already, so a rerun numbers alike.
    rows = linked.withColumn("row", F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")))
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    met = each.join(counts.withColumnRenamed("pair", "pairs"), "pairs")
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"),
    )
    both = rows.join(sums, "row", "left")
    return both.select(*KEPT, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
