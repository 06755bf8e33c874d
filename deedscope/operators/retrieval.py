"""Exact nearest-neighbour retrieval over an array column, by squared Euclidean distance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deedscope.plans.sizing import has_at_most
from deedscope.plans.skew import spread_salt

# Distances held at a time: few enough to stay near the processor.
_BLOCK_VALUES = 1 << 18


def _closest(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int):
    """Candidates (query position, id, distance): the ``k`` nearest of each query, ties by id.

    A matrix product gives all distances with a small rounding error. The rows go by in blocks: the
    k-th smallest distance of a query so far bounds what a further block can add, so nearly all of it
    falls out by one comparison. Rows within the error of the bound are measured again by
    differences, so the choice is exact.
    """
    squares, q_squares = np.einsum("ij,ij->i", vectors, vectors), np.einsum("ij,ij->i", queries, queries)
    slack = 1e-10 * (squares.max() + q_squares) if len(vectors) else q_squares
    rows = min(len(vectors), 1024)
    step = max(1, _BLOCK_VALUES // max(rows, 1))
    found = []
    for start in range(0, len(queries), step):
        q = queries[start : start + step]
        scaled = -2.0 * q
        bound = np.full((len(q), 1), np.inf)
        nearest = np.full((len(q), k), np.inf)
        held, many = [], 0
        for at in range(0, len(vectors), rows):
            # Without the query's own square, which is the same in all of its distances.
            rough = scaled @ vectors[at : at + rows].T
            rough += squares[at : at + rows]
            if at == 0:
                first = np.partition(rough, min(k, rows) - 1, axis=1)[:, :k]
                nearest[:, : first.shape[1]] = first
                bound = nearest.max(axis=1, keepdims=True) + slack[start : start + step, None]
            col, row = np.nonzero(rough <= bound)
            if not len(col):
                continue
            if at:
                # The k least of a query's new distances beside its nearest so far.
                value = rough[col, row]
                order = np.lexsort((value, col))
                place = np.arange(len(col)) - np.searchsorted(col, col[order])
                some = order[place < k]
                fresh = np.full((len(q), k), np.inf)
                fresh[col[some], place[place < k]] = value[some]
                nearest = np.partition(np.concatenate([nearest, fresh], axis=1), k - 1, axis=1)[:, :k]
                bound = nearest.max(axis=1, keepdims=True) + slack[start : start + step, None]
            exact = ((vectors[row + at] - q[col]) ** 2).sum(axis=1)
            held.append(pd.DataFrame({"q": col + start, "id": ids[row + at], "distance": exact}))
            many += len(col)
            if many > _BLOCK_VALUES:
                # Many rows as near as the bound: copies, of which the least ids stay.
                held, many = [_keep(pd.concat(held), k)], 0
        found.append(_keep(pd.concat(held), k) if held else pd.DataFrame({"q": [], "id": [], "distance": []}))
    return pd.concat(found)


def _keep(candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    return candidates.sort_values(["q", "distance", "id"], kind="stable").groupby("q").head(k)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _rank(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    # The rank filter is applied before the shuffle too, so a task sends k rows per query.
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    docs: DataFrame, queries: DataFrame, *, doc_id: str, doc_vector: str, query_id: str,
    query_vector: str, k: int = 3, batch_bytes: int = 64 * 1024 * 1024,
) -> DataFrame:
    """The ``k`` nearest documents of every query: (query_id, doc_id, distance, rank).

    A query batch of at most ``batch_bytes``, counted first, travels to the tasks, and the
    documents are scanned where they lie, each task keeping k rows per query. A larger batch is
    cut into blocks; documents and queries then meet block by block, and the k best of the
    blocks are merged.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_vector).alias("vector")).filter(
        F.col("vector").isNotNull()
    )
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("vector")).filter(
        F.col("vector").isNotNull()
    )
    size = q.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    id_types = f"query_id {q.schema['query_id'].dataType.simpleString()}, doc_id {d.schema['doc_id'].dataType.simpleString()}"
    schema = f"{id_types}, distance double"
    fitting_rows = max(1, batch_bytes // (8 * (size["dims"] or 1)))
    if size["n"] <= fitting_rows:
        candidates = _scan_with_batch(d, q, k, schema)
    else:
        candidates = _meet_in_blocks(d, q, k, schema, size["n"], fitting_rows)
    return _rank(candidates, k).select(
        "query_id", "doc_id", "distance", F.col("rank").cast("int").alias("rank")
    )


def _scan_with_batch(docs: DataFrame, queries: DataFrame, k: int, schema: str) -> DataFrame:
    rows = queries.collect()  # at most batch_bytes, counted by the caller
    sent = docs.sparkSession.sparkContext.broadcast(
        (
            np.array([r["query_id"] for r in rows]),
            np.array([r["vector"] for r in rows], dtype=np.float64),
        )
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, matrix = sent.value
        best = None
        for batch in batches:
            if len(batch) == 0 or len(matrix) == 0:
                continue
            fresh = _closest(batch["doc_id"].to_numpy(), _matrix(batch["vector"]), matrix, k)
            best = fresh if best is None else _keep(pd.concat([best, fresh]), k)
        if best is not None:
            yield pd.DataFrame(
                {"query_id": query_ids[best["q"]], "doc_id": best["id"], "distance": best["distance"]}
            )

    return docs.mapInPandas(scan, schema)


def _meet_in_blocks(
    docs: DataFrame, queries: DataFrame, k: int, schema: str, num_queries: int, block_rows: int
) -> DataFrame:
    query_blocks = max(1, math.ceil(num_queries / block_rows))
    doc_blocks = max(1, math.ceil(docs.count() / block_rows))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # Blocks follow a hash of the row, which a task that is run again repeats.
    left = docs.withColumn("doc_block", spread_salt(docs, doc_blocks)).withColumn(
        "query_block", every(query_blocks)
    )
    right = queries.withColumn("query_block", spread_salt(queries, query_blocks)).withColumn(
        "doc_block", every(doc_blocks)
    )

    def meet(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if len(d) == 0 or len(q) == 0:
            return pd.DataFrame({"query_id": [], "doc_id": [], "distance": []})
        best = _closest(d["doc_id"].to_numpy(), _matrix(d["vector"]), _matrix(q["vector"]), k)
        ids = q["query_id"].to_numpy()
        return pd.DataFrame({"query_id": ids[best["q"]], "doc_id": best["id"], "distance": best["distance"]})

    blocks = ["query_block", "doc_block"]
    return left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInPandas(meet, schema)


def retrieve_context(
    neighbours: DataFrame, documents: DataFrame, queries: DataFrame, *, doc_id: str, doc_text: str,
    query_id: str, query_text: str, k: int = 3, max_broadcast_rows: int = 100_000,
) -> DataFrame:
    """Per query the texts of its nearest documents in rank order, then the query, as one text.

    There are at most ``k`` neighbours per query. While the queries, as counted, keep them few,
    they are broadcast, and the corpus is read without being shuffled.
    """
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("doc_text"))
    kept = neighbours.filter(F.col("rank") <= k)
    few = has_at_most(queries, max_broadcast_rows // k)
    found = texts.join(F.broadcast(kept) if few else kept, "doc_id")
    # At most k texts per query are gathered.
    joined = found.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc_text"))).alias("ranked")
    )
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_text).alias("query_text"))
    context = F.array_join(F.transform("ranked", lambda r: r["doc_text"]), " ")
    return joined.join(asked, "query_id").select(
        "query_id",
        F.size("ranked").alias("num_documents"),
        F.concat(context, F.lit(" "), F.col("query_text")).alias("context"),
    )
