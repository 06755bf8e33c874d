"""Line dedup: later copies of repeated runs of lines are deleted.

Lines are names (128-bit hashes); a document is a sequence of names. Prefix doubling gives every
run of 2^k lines a name from its two halves, and any run the name of the two such blocks that
cover it. Suffixes are ordered by the name of their shortest prefix of ``least_words`` words; the
suffixes of equal name are one LCP interval, with a common prefix of that many words or more. In
each interval all but the first suffix, in the order of documents and lines, are later copies.

A line of a repeated run of ``least_words`` or more lies in such a prefix of a suffix that starts
in the run, or in the run's shortest end of that many words, whose names are compared as well. So
the deleted lines are those of all maximal repeated runs of at least ``least_words`` words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deedscope.llm.common import extended, parts
from deedscope.plans.lineage import cut_lineage

_LEAST = -(2**63)


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A well mixed 64-bit value of two."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x += np.uint64(salt)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _join_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names [n, 2] of runs from the names of their two parts; both halves mix all four words."""
    first = _mix(_mix(a[:, 0], b[:, 0], 1), _mix(a[:, 1], b[:, 1], 2), 3)
    second = _mix(_mix(a[:, 1], b[:, 0], 4), _mix(a[:, 0], b[:, 1], 5), 6)
    return np.stack([first, second], axis=1)


def named_runs(documents: list[list[bytes]], least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, starts, lengths and names of their shortest runs of ``least_words`` words.

    For each line there is the run that starts and the run that ends with it. All documents' lines
    are named as one sequence; runs that would cross from one document into the next are left out.
    """
    sizes = np.array([len(x) for x in documents])
    lines = [x for d in documents for x in d]
    n = len(lines)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    words = np.concatenate([[0], np.cumsum([len(x.split()) for x in lines])])
    at = np.arange(n)
    ends = np.searchsorted(words, words[:-1] + least_words, side="left")
    starting = np.stack([at, ends], axis=1)[ends <= (first + sizes)[owner]]
    starts = np.searchsorted(words, words[1:] - least_words, side="right") - 1
    ending = np.stack([starts, at + 1], axis=1)[(starts >= first[owner])]
    runs = np.concatenate([starting, ending])
    if not len(runs):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros((0, 2), np.uint64),)
    start, length = np.divmod(np.unique(runs[:, 0] * (n + 1) + runs[:, 1] - runs[:, 0]), n + 1)

    digests = b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in lines])
    level = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    names = np.zeros((len(start), 2), np.uint64)
    order = np.frexp(length.astype(np.float64))[1] - 1  # floor of log2
    for k in range(int(order.max()) + 1):
        if k:
            half = 1 << (k - 1)
            level = _join_names(level[:-half], level[half:])
        of = order == k
        if of.any():
            s, m = start[of], length[of]
            covered = _join_names(level[s], level[s + m - (1 << k)])
            names[of] = _join_names(covered, np.repeat(m.astype(np.uint64)[:, None], 2, axis=1))
    return owner[start], start - first[owner[start]], length, names


def _keys(id_column: str, text_column: str) -> list[Column]:
    """What tells documents apart: id and text, so that rows of equal id keep their own lines."""
    doc = F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(_LEAST))
    return [doc.alias("__doc"), F.xxhash64(F.coalesce(F.col(f"`{text_column}`"), F.lit(""))).alias("__hash")]


def later_copies(
    docs: DataFrame, *, least_words: int = 50, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Runs of lines that an earlier place has too: ``__doc``, ``__hash``, ``start``, ``length``.

    Places are ordered by id, then text hash, then line; NULL ids come first. Each input
    partition sends only its first place of each run, so a run that is everywhere comes to one
    task as often as there are partitions, not documents.
    """
    rows = docs.select(*_keys(id_column, text_column), F.col(f"`{text_column}`").alias("text")).filter("text IS NOT NULL")
    schema = "__doc long, __hash long, start int, length int, name0 long, name1 long, later boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for batch in parts(batches):
            texts = [x.encode().split(b"\n") for x in batch.column(2).to_pylist()]
            owner, start, length, names = named_runs(texts, least_words)
            doc, key = (batch.column(k).to_numpy()[owner] for k in range(2))
            found.append((doc, key, start, length, names[:, 0].view(np.int64), names[:, 1].view(np.int64)))
        if not found:
            return
        doc, key, start, length, name0, name1 = (np.concatenate(x) for x in zip(*found))
        found.clear()
        order = np.lexsort((start, key, doc, name1, name0))
        doc, key, start, length, name0, name1 = (x[order] for x in (doc, key, start, length, name0, name1))
        same = np.zeros(len(doc), bool)
        same[1:] = (name0[1:] == name0[:-1]) & (name1[1:] == name1[:-1])
        # A place that several rows of equal id and text share is no copy of itself.
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
        itself = (doc == doc[first]) & (key == key[first]) & (start == start[first])
        # What is known to be a later copy needs no company: it goes where its place leads.
        name0 = np.where(same, _mix(doc.view(np.uint64), key.view(np.uint64), 7).view(np.int64), name0)
        name1 = np.where(same, start << np.int64(32) | length, name1)
        for at in range(0, len(doc), 100_000):
            cut = slice(at, at + 100_000)
            keep = ~(same & itself)[cut]
            values = [doc, key, start.astype(np.int32), length.astype(np.int32), name0, name1, same]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v[cut][keep]) for v in values],
                names=["__doc", "__hash", "start", "length", "name0", "name1", "later"],
            )

    places = rows.mapInArrow(run, schema)
    interval = Window.partitionBy("name0", "name1")
    placed = places.withColumn("place", F.struct("__doc", "__hash", "start"))
    copies = placed.withColumn("first", F.min("place").over(interval)).filter("later OR place > first")
    return copies.select("__doc", "__hash", "start", "length")


def deduplicate_lines(
    docs: DataFrame, *, least_words: int = 50, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``docs`` without the later copies of repeated runs of lines of ``least_words`` words.

    All columns pass through; the text loses the deleted lines, ``n_lines`` and
    ``n_removed_lines`` are added (columns of these names are replaced). Every deleted line stays
    at an earlier place. NULL texts stay NULL and have no lines; an empty text has one line. Rows
    equal in id and text are one document: their lines are kept or deleted alike. Runs end with
    their document.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], *_keys(id_column, text_column))
    runs = later_copies(docs, least_words=least_words, id_column=id_column, text_column=text_column)
    # Distinct first: equal rows report the same runs, so a list is as long as its document at most.
    deleted = cut_lineage(
        runs.distinct().groupBy("__doc", "__hash").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("__runs"))
    )
    found = rows.join(deleted, ["__doc", "__hash"], "left").select(
        *[F.col(f"`{c}`") for c in columns],
        F.transform("__runs", lambda r: r["start"]).alias("__starts"),
        F.transform("__runs", lambda r: r["length"]).alias("__lengths"),
    )
    at = columns.index(text_column)
    schema = extended(docs.select(*[F.col(f"`{c}`") for c in columns]).schema, "n_lines int, n_removed_lines int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts, n_lines, n_removed = [], [], []
            places = [batch.column(len(columns) + k).to_pylist() for k in range(2)]
            for text, starts, lengths in zip(batch.column(at).to_pylist(), *places):
                lines = [] if text is None else text.split("\n")
                n_lines.append(len(lines))
                if not starts:
                    texts.append(text)
                    n_removed.append(0)
                    continue
                change = np.zeros(len(lines) + 1, np.int64)
                np.add.at(change, np.array(starts), 1)
                np.add.at(change, np.array(starts) + np.array(lengths), -1)
                gone = np.cumsum(change[:-1]) > 0
                texts.append("\n".join(x for x, out in zip(lines, gone) if not out))
                n_removed.append(int(gone.sum()))
            out = list(batch.columns[: len(columns)])
            out[at] = pa.array(texts, pa.string())
            counts = [pa.array(x, pa.int32()) for x in (n_lines, n_removed)]
            yield pa.RecordBatch.from_arrays([*out, *counts], names=[*columns, "n_lines", "n_removed_lines"])

    return found.mapInArrow(run, schema)
