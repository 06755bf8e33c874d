"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of all new pre-tokens of a batch are laid end to end as one linked list with borders.
Adjacent parts that make a token wait in the bucket of its rank, a list of positions. A two-level
bitmap of the non-empty buckets gives the least rank by find-first-set; entries that a merge has
made stale are skipped. Each merge costs a few operations whatever the length, so a pre-token of a
whole document is no problem, and what a queue costs at all is shared by thousands of short ones.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import sys
from array import array
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deedscope.llm.common import extended, parts, text_parts


class Vocabulary:
    """Ranks of tokens, and of all pairs of tokens that make one.

    ``first`` has the rank of every pair of bytes (-1: none), ``pairs`` that of (left id, right id):
    a token of n bytes is cut in n - 1 ways, so there are few.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.first = np.full(1 << 16, -1, np.int64)
        self.pairs: dict[int, int] = {}
        find = ranks.get
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first[token[0] << 8 | token[1]] = rank
            for cut in range(1, len(token)):
                left, right = find(token[:cut]), find(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank


def merge_all(pieces: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Token ids of each pre-token: the least rank is merged first, the leftmost of equal ones.

    No pair crosses a border, so pre-tokens don't touch each other and one queue serves them all.
    ``low`` holds a bit for each waiting rank of a group of 256, ``top`` one for each group that
    has any. A rank's whole bucket is merged at once, unless a merge makes a lower rank wait.
    """
    whole = [vocabulary.ranks.get(piece) for piece in pieces]
    held = [piece for piece, rank in zip(pieces, whole, strict=True) if rank is None and piece]
    data = np.frombuffer(b"".join(held), np.uint8)
    n = len(data)
    ends = np.cumsum([0, *map(len, held)])
    start = np.full(n, -1, np.int64)
    if n > 1:
        start[:-1] = vocabulary.first[data[:-1].astype(np.int64) << 8 | data[1:]]
        start[ends[1:] - 1] = -1
    following, preceding = np.arange(1, n + 1), np.arange(-1, n - 1)
    following[ends[1:] - 1] = -1
    preceding[ends[:-1][ends[:-1] < n]] = -1
    ids, wanted = vocabulary.single[data].tolist(), start.tolist()
    after, before = following.tolist(), preceding.tolist()
    waiting = np.flatnonzero(start >= 0)
    waiting = waiting[np.argsort(start[waiting], kind="stable")]
    at = np.flatnonzero(np.diff(start[waiting], prepend=-1))
    places, cuts = waiting.tolist(), [*at.tolist(), len(waiting)]
    buckets, low, top = {}, {}, 0
    for rank, x, y in zip(start[waiting[at]].tolist(), cuts[:-1], cuts[1:], strict=True):
        buckets[rank] = places[x:y]
        low[rank >> 8] = low.get(rank >> 8, 0) | 1 << (rank & 255)
        top |= 1 << (rank >> 8)
    pair, waiting_at = vocabulary.pairs.get, buckets.get
    while top:
        group = (top & -top).bit_length() - 1
        bits = low[group]
        rank = group << 8 | (bits & -bits).bit_length() - 1
        low[group] = bits = bits & (bits - 1)
        if not bits:
            top &= top - 1
        bucket = buckets.pop(rank)
        if len(bucket) > 1:
            bucket.sort()
        least = rank
        for done, i in enumerate(bucket, 1):
            if wanted[i] != rank:
                continue  # stale: a neighbour has been merged since
            ids[i] = rank
            gone = after[i]
            wanted[gone] = -1
            stop = after[i] = after[gone]
            if stop >= 0:
                before[stop] = i
                wanted[i] = found = pair(rank << 32 | ids[stop], -1)
                if found >= 0:
                    place = waiting_at(found)
                    if place is None:
                        buckets[found] = [i]
                        low[found >> 8] = low.get(found >> 8, 0) | 1 << (found & 255)
                        top |= 1 << (found >> 8)
                    else:
                        place.append(i)
                    if found < least:
                        least = found
            else:
                wanted[i] = -1
            j = before[i]
            if j >= 0:
                wanted[j] = found = pair(ids[j] << 32 | rank, -1)
                if found >= 0:
                    place = waiting_at(found)
                    if place is None:
                        buckets[found] = [j]
                        low[found >> 8] = low.get(found >> 8, 0) | 1 << (found & 255)
                        top |= 1 << (found >> 8)
                    else:
                        place.append(j)
                    if found < least:
                        least = found
            if least < rank and done < len(bucket):
                # The rest of the bucket waits until that lower rank is merged.
                buckets[rank] = buckets.get(rank, []) + bucket[done:]
                low[group] = low.get(group, 0) | 1 << (rank & 255)
                top |= 1 << group
                break
    out = []
    for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        found, i = [], x
        while 0 <= i < y:
            found.append(ids[i])
            i = after[i]
        out.append(found)
    rest = iter(out)
    return [[] if not piece else [rank] if rank is not None else next(rest) for piece, rank in zip(pieces, whole, strict=True)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token."""
    return merge_all([piece], Vocabulary(ranks))[0]


class Pieces(dict):
    """Pre-token to ids, merged once while it stays in this bounded cache.

    Half of the ``entries`` are of the pre-tokens met since the last change of generation, half of
    those met before; one that is met again moves on to the new generation.
    """

    def __init__(
        self, ranks: dict[bytes, int], entries: int, piece_chars: int = 64, pack: Callable[[list[int]], object] = list
    ) -> None:
        super().__init__()
        self.ranks, self.half, self.piece_chars, self.pack = ranks, max(1, entries // 2), piece_chars, pack
        self.vocabulary = Vocabulary(ranks)
        self.older: dict[str, object] = {}

    def of(self, rows: list[list[str]], together: int = 500) -> dict[str, object]:
        """The ids of all pre-tokens of ``rows``. Those not known yet are merged, ``together`` in a queue."""
        table, new = {}, []
        for piece in set().union(*rows):
            ids = self.get(piece)
            if ids is None:
                ids = self.older.get(piece)
                if ids is None:
                    new.append(piece)
                    continue
                self.keep(piece, ids)
            table[piece] = ids
        # The queue's lists hold no cycles; looking for some takes an eighth of the time.
        collecting = gc.isenabled()
        gc.disable()
        for at in range(0, len(new), together):
            some = new[at : at + together]
            for piece, ids in zip(some, merge_all([p.encode() for p in some], self.vocabulary), strict=True):
                table[piece] = packed = self.pack(ids)
                self.keep(piece, packed)
        if collecting:
            gc.enable()
        return table

    def keep(self, piece: str, ids: object) -> None:
        if len(piece) <= self.piece_chars:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[piece] = ids

    @classmethod
    def of_worker(cls, rank_lines: bytes, entries: int) -> Pieces:
        """The cache of this Python worker, which outlives the task: its next tasks find it filled.

        Ids are packed as the bytes of 32-bit numbers, so that a text's are joined, not listed.
        """
        # Functions reach tasks by value, with globals that are new for each task; what the
        # interpreter itself lists as a module stays with the process.
        kept = sys.modules.setdefault("_byte_bpe_of_worker", ModuleType("_byte_bpe_of_worker")).__dict__
        key = hashlib.sha256(rank_lines).digest(), entries
        if kept.get("key") != key:
            kept.update(key=key, pieces=cls(parse_ranks(rank_lines), entries, pack=lambda ids: array("i", ids).tobytes()))
        return kept["pieces"]


def parse_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The rank file, read where the driver has it; a vocabulary is of bounded size."""
    with open(path, "rb") as file:
        return file.read()


class Decoder:
    """Ids to bytes, all rows of an array column at a time."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.every = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(x) for x in tokens])
        self.begin = np.cumsum(self.size) - self.size

    def decode(self, ids: pa.Array) -> pa.Array:
        held = ids.flatten().to_numpy()
        rows = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
        ends = np.concatenate([[0], np.cumsum(self.size[held])])
        # The place in ``every`` of each byte.
        place = np.repeat(self.begin[held] - ends[:-1], self.size[held]) + np.arange(ends[-1])
        offsets = pa.py_buffer(ends[rows].astype(np.int32).tobytes())
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, offsets, pa.py_buffer(self.every[place].tobytes())])


def encode(
    docs: DataFrame, rank_file: str, pattern: str, *, text_column: str = "text", ids_column: str = "ids",
    decoded_column: str | None = None, cache_entries: int = 500_000,
) -> DataFrame:
    """``docs`` with its text replaced by the ids of its tokens, an array of int.

    Each match of ``pattern`` is encoded by itself; characters that it matches nowhere are left
    out. NULL and empty texts have no ids. Texts are encoded whole. Columns other than the text
    pass through as they are; a column that already bears the name of the ids is replaced. With
    ``decoded_column`` the ids are also decoded again, in the same task.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(docs.sparkSession, rank_file))
    kept = [c for c in docs.columns if c not in (text_column, ids_column, decoded_column)]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text_column), F.lit("")).alias(ids_column))
    added = f"`{ids_column}` array<int>" + (f", `{decoded_column}` binary" if decoded_column else "")
    names = [*kept, ids_column] + ([decoded_column] if decoded_column else [])
    schema = extended(rows.drop(ids_column).schema, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        pieces = Pieces.of_worker(ranks.value, cache_entries)
        decoder = Decoder(pieces.ranks) if decoded_column else None
        for batch in text_parts(batches, len(kept), size=1 << 20):
            rows = [find(text) for text in batch.column(len(kept)).to_pylist()]
            table = pieces.of(rows)
            packed = [b"".join(map(table.__getitem__, row)) for row in rows]
            ends = np.cumsum([0, *map(len, packed)]) // 4
            values = pa.array(np.frombuffer(b"".join(packed), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            out = [*batch.columns[: len(kept)], ids] + ([decoder.decode(ids)] if decoder else [])
            yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.mapInArrow(run, schema)


def decode(tokens: DataFrame, rank_file: str, *, ids_column: str = "ids", bytes_column: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes its ids stand for in a new column; NULL ids give no bytes."""
    ranks = tokens.sparkSession.sparkContext.broadcast(read_ranks(tokens.sparkSession, rank_file))
    names = [c for c in tokens.columns if c != bytes_column]
    rows = tokens.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(parse_ranks(ranks.value))
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, decoder.decode(batch.column(at))], names=[*names, bytes_column])

    return rows.mapInArrow(run, extended(rows.schema, f"`{bytes_column}` binary"))


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Per document the number and digest of its ids, and the digest of what they decode to."""
    tokens = encode(docs.select("doc_id", "text"), rank_file, pattern, decoded_column="decoded")
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), " "), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
