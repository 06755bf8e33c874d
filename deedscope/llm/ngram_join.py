"""N-gram Jaccard join: chosen-path join over sets of word shingles.

Equal sets form a class first; one set of each class goes on. A set is split over the tokens of
its min-hash sketch: at every node of a random tree a token is chosen with probability
1 / (branching share x sketch size), by a hash of node and token, so that two sets choose the same
tokens among those they share. In a small node all sets are compared by sketch; a node that a
further token hardly splits is dealt into parts, and what the parts leave apart meets in blocks,
any two sets of it. Enough independent trees are run for the target recall. Those that look similar
make components, which keep few links of many: any two sets that meet and look similar are in one.
In a component every two sets are then compared once, on the whole sets, and only each set's number
of links and its group leave the task.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedscope.llm.common import WORD, parts, salted_left_join, text_parts, with_group_facts
from deedscope.llm.components import components
from deedscope.plans.lineage import cut_lineage
from deedscope.plans.sizing import broadcast_if_small

_LEAST = -(2**63)
_ODD = np.uint64(0x9E3779B97F4A7C15)
SKETCH = 128


def _finish(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Word to a 64-bit hash, in a bounded cache."""

    def __missing__(self, word: str) -> int:
        value = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        if len(self) >= 200_000:
            self.clear()
        self[word] = value
        return value


def shingles(words: list[str], width: int, hashes: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the runs of ``width`` words; fewer words make one run."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - width + 1, np.uint64(width))
        for k in range(width):
            total = (total + h[k : len(h) - width + 1 + k]) * _ODD
            total ^= total >> np.uint64(32)
    return np.unique(_finish(total))


def _sketcher(seed: int):
    rng = np.random.default_rng(seed)
    a = (rng.integers(0, 2**32, SKETCH, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
    b = rng.integers(0, 2**32, SKETCH, dtype=np.uint64).astype(np.uint32)[:, None]

    slot = np.arange(SKETCH, dtype=np.uint64) * _ODD

    def sketch(tokens: np.ndarray) -> bytes:
        if not len(tokens):
            return bytes(4 * SKETCH)
        low = (tokens >> np.uint64(32)).astype(np.uint32)
        least, chosen = np.full(SKETCH, np.uint32(0xFFFFFFFF)), np.zeros(SKETCH, np.int64)
        for at in range(0, len(low), 4096):
            drawn = a * low[None, at : at + 4096] + b
            place = drawn.argmin(axis=1)
            value = np.take_along_axis(drawn, place[:, None], axis=1)[:, 0]
            lower = value < least
            least[lower], chosen[lower] = value[lower], place[lower] + at
        # The chosen token itself, not its draw: draws are small numbers, which soon agree by chance.
        return (_finish(tokens[chosen] + slot) >> np.uint64(32)).astype(np.uint32).tobytes()

    return sketch


def token_sets(docs: DataFrame, width: int, seed: int, id_column: str, text_column: str) -> DataFrame:
    """Per row: document, text digest, its set's two-word name, size, sketch and a byte of each sketch token.

    The bytes are what sets are compared by first: unequal tokens agree in them once in 256.
    """
    doc = F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(_LEAST)).alias("doc")
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    rows = docs.select(doc, text.alias("text"), F.xxhash64(text).alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketch, find = _WordHashes(), _sketcher(seed), re.compile(WORD).findall
        for batch in text_parts(batches, 1):
            names, sizes, sketches, briefs = [], [], [], []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = shingles(find(text), width, hashes)
                # Texts without a word are similar to nothing: each is a class of its own.
                named = tokens.tobytes() if len(tokens) else b"none" + str(own).encode()
                names.append(np.frombuffer(hashlib.blake2b(named, digest_size=16).digest(), np.int64))
                sizes.append(len(tokens))
                sketches.append(sketch(tokens))
                briefs.append(sketches[-1][::4])
            name = np.array(names, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(sizes, pa.int32()),
                 pa.array(sketches, pa.binary()), pa.array(briefs, pa.binary()), batch.column(2)],
                names=["doc", "node", "node1", "size", "sketch", "brief", "digest"],
            )

    return rows.mapInArrow(run, "doc long, node long, node1 long, size int, sketch binary, brief binary, digest long")


def least_alike(recall: float, similarity: float, share: float) -> int:
    """Places of two sketches that must agree, so that trees and sketches together keep ``recall``.

    The places that agree are binomial. What :func:`runs_for` trees may miss is taken from the
    recall's allowance first; a pair falls below the places returned with what is left at most.
    """
    missed = _missed(similarity, share) ** runs_for(recall, similarity, share)
    allowed = 1 - recall / (1 - missed)
    below = 0.0
    for k in range(SKETCH + 1):
        below += math.comb(SKETCH, k) * similarity**k * (1 - similarity) ** (SKETCH - k)
        if below > allowed:
            return k
    return SKETCH


def _missed(similarity: float, share: float) -> float:
    """Probability that a pair of ``similarity`` does not meet in one tree."""
    mean, alive = similarity / share, 1.0
    if mean <= 1:
        raise ValueError("share must be below the similarity")
    for _ in range(200):
        alive = 1 - math.exp(-mean * alive)
    return 1 - alive


def runs_for(recall: float, similarity: float, share: float) -> int:
    """Trees needed so that a pair of ``similarity`` meets with probability ``recall``.

    The tokens two sets both choose at a node are Poisson of mean similarity / share; the pair
    survives all levels with the branching process's survival probability.
    """
    return max(1, math.ceil(math.log(1 - recall) / math.log(_missed(similarity, share))))


def _children(rows: DataFrame, share: float, roots: list[int] | None = None) -> DataFrame:
    """Paths one token longer: ``path``, ``node``, ``parent`` (members of the path before).

    ``rows`` has node, sketch and, unless ``roots`` are given, path and members.
    """
    limit = np.uint64(int(2**64 / (share * SKETCH)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = (np.arange(SKETCH, dtype=np.uint64) + np.uint64(1)) << np.uint64(32)
        for batch in parts(batches, 1024):
            node = batch.column(0).to_numpy()
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, SKETCH)
            token = sketch.astype(np.uint64) | slot
            paths, nodes, parents = [], [], []
            size = np.full(len(node), np.iinfo(np.int64).max) if roots else batch.column(3).to_numpy()
            given = batch.column(2).to_numpy().view(np.uint64)[:, None] if roots is None else None
            for root in roots or [0]:
                at = given if given is not None else _finish(np.full((len(node), 1), root, np.uint64))
                with np.errstate(over="ignore"):
                    drawn = _finish(at + token * _ODD)
                row, chosen = np.nonzero(drawn < limit)
                child = _finish(drawn[row, chosen] ^ np.broadcast_to(at, drawn.shape)[row, chosen])
                paths.append(child.view(np.int64))
                nodes.append(node[row])
                parents.append(size[row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (paths, nodes, parents)], names=["path", "node", "parent"]
            )

    columns = ["node", "sketch"] + ([] if roots else ["path", "members"])
    return rows.select(*columns).mapInArrow(run, "path long, node long, parent long")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where each group begins and the last one ends.

    A group is a run of rows of equal leading ``keys`` columns; one that crosses the border of
    batches is held back until it is whole.
    """
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        key = np.stack([held.column(k).to_numpy() for k in range(keys)], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        if len(cuts):
            yield held.slice(0, cuts[-1]).combine_chunks(), np.concatenate([[0], cuts])
            held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def _agreement(s: np.ndarray) -> np.ndarray:
    """In how many places each two rows agree, a few rows against all at a time."""
    found = np.empty((len(s), len(s)), np.int16)
    step = max(1, (1 << 22) // s.size)
    for i in range(0, len(s), step):
        found[i : i + step] = np.count_nonzero(s[i : i + step, None, :] == s[None, :, :], axis=2)
    return found


def _forest(alike: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Groups that begin as ``group`` joined where members are alike, and a link for each joining."""
    group, links = group.copy(), []
    for i in np.flatnonzero(np.tril(alike, -1).any(axis=1)):
        near = np.flatnonzero(alike[i, :i])
        met, at = np.unique(group[near], return_index=True)
        other = met != group[i]
        if other.any():
            links += [(int(i), int(near[k])) for k in at[other]]
            group[np.isin(group, met[other])] = group[i]
    return group, links


def _met(rows: DataFrame, least: int) -> DataFrame:
    """Of each part (path, chunk) links (path, u, v) that join its sets, alike in ``least`` places, to groups.

    Rows have path, chunk, node, brief and root, the group that a set is known to be of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, 2):
            paths, nodes, roots = (table.column(c).to_numpy() for c in ("path", "node", "root"))
            briefs = np.frombuffer(b"".join(table.column("brief").to_pylist()), np.uint8).reshape(-1, SKETCH)
            u, v = [], []
            for a, b in zip(starts[:-1], starts[1:]):
                group = np.unique(roots[a:b], return_inverse=True)[1].ravel()
                if group.max() > 0:
                    links = _forest(_agreement(briefs[a:b]) >= least, group)[1]
                    u += [a + i for i, _ in links]
                    v += [a + j for _, j in links]
            at, to = np.array(u, np.int64), np.array(v, np.int64)
            columns = [pa.array(paths[at]), pa.array(nodes[at]), pa.array(nodes[to])]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "u", "v"])

    dealt = rows.select("path", "chunk", "node", "root", "brief").repartition("path", "chunk")
    return dealt.sortWithinPartitions("path", "chunk", "node").mapInArrow(run, "path long, u long, v long")


def _in_blocks(rows: DataFrame, part: str) -> DataFrame:
    """Rows (node, blocks) dealt to the pairs of their ``part``'s blocks: any two meet in the ``chunk`` of their own blocks."""
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    each = rows.withColumn("own", own).withColumn("other", every)
    pair = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    return each.select(part, pair.alias("chunk"), *[c for c in rows.columns if c != part], "own").drop("other")


def _hung(large: DataFrame, bucket: int) -> DataFrame:
    """Large nodes dealt to parts (``chunk``) of about ``bucket`` sets, each of which has the node's first set too."""
    chunks = F.ceil(F.col("members") / bucket)
    dealt = large.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), chunks))
    return dealt.select("path", F.col("first").alias("node"), "chunk").union(dealt.select("path", "node", "chunk")).distinct()


def _with_strays(large: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of large nodes with ``root``, the group that ``links`` make their set be of.

    ``top`` is the group that most of the node are of, ``strays`` how many are not. Of one group
    no two need a further link, so a node without strays is done and left out.
    """
    known = large.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = known.groupBy("path", "root").agg(F.count("*").alias("n"))
    tops = groups.groupBy("path").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"))
    tops = tops.select("path", F.col("most.root").alias("top"), (F.col("all") - F.col("most.n")).alias("strays"))
    return cut_lineage(known.join(tops.filter("strays > 0"), "path"))


def _blocks(half: int) -> tuple[Column, Column]:
    """Of how many blocks a node's strays are, and its top group."""
    return F.ceil(F.col("strays") / half), F.ceil((F.col("members") - F.col("strays")) / half)


def _repeats(half: int) -> Column:
    """Rows that :func:`_across` makes of a node."""
    of_strays, of_top = _blocks(half)
    return F.col("members") * of_strays + F.col("strays") * of_top


def _across(known: DataFrame, half: int) -> DataFrame:
    """Rows of large nodes dealt to pairs of blocks of about ``half`` sets: any two not of one group meet.

    Strays meet all; those of the node's top group meet the strays alone, not each other.
    """
    stray = F.col("root") != F.col("top")
    of_strays, of_top = _blocks(half)
    at = F.xxhash64("node", F.lit(1))
    own = F.when(stray, F.pmod(at, of_strays)).otherwise(of_strays + F.pmod(at, of_top))
    last = F.when(stray, of_strays + of_top).otherwise(of_strays) - 1
    each = known.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    chunk = F.least("own", "other") * (of_strays + of_top) + F.greatest("own", "other")
    return each.select("path", chunk.alias("chunk"), "node", "root")


def candidate_edges(sets: DataFrame, similarity: float, recall: float, share: float, bucket: int, depth: int, seed: int) -> DataFrame:
    """Links (u, v) that join to components what the trees bring together and is similar by sketch."""
    runs, least, half = runs_for(recall, similarity, share), least_alike(recall, similarity, share), max(1, bucket // 2)
    briefs = sets.select("node", "brief")

    def met(rows: DataFrame) -> DataFrame:
        return _met(rows.join(briefs, "node"), least)

    rows, small, parted, dense, found = _children(sets, share, [seed * 1_000 + r for r in range(runs)]), [], [], [], []
    for level in range(1, depth + 1):
        sized = with_group_facts(rows, ["path"], "node", "min", "first", "members", combined=False).filter("members > 1")
        # A token of near copies is in most of them: each further level would repeat their rows.
        unsplit = (F.col("members") / F.col("parent") >= 0.5) | F.lit(level >= depth)
        way = F.when(F.col("members") <= bucket, "small").when(unsplit, "dense").otherwise("split")
        sized = cut_lineage(sized.select("path", "node", "parent", "members", "first", way.alias("way")))
        ways = {r["way"] for r in sized.select("way").distinct().collect()}
        if "small" in ways:
            small.append(sized.filter("way = 'small'").select("path", "node", F.lit(0).cast("long").alias("chunk")))
        if "dense" in ways:
            parted.append(sized.filter("way = 'dense'").select("path", "node", "members", "first"))
        if "split" not in ways:
            break
        large = sized.filter("way = 'split'").select("path", "node", "members", "first")
        if level == 1:
            # No level before tells near copies here, but the links of a node's parts: half as many as sets, or not.
            links = cut_lineage(met(_hung(large, bucket).withColumn("root", F.col("node"))))
            close = links.groupBy("path").agg(F.count("*").alias("links"))
            large = cut_lineage(large.join(close, "path", "left").withColumn("close", F.expr("coalesce(links >= members / 2, false)")))
            found.append(links.select("u", "v").distinct())
            dense.append(large.filter("close").select("path", "node", "members"))
            large = large.filter("NOT close")
        wide = large.select("node", "path", "members").join(sets.select("node", "sketch"), "node")
        # Written once: the facts of groups and the rows they are joined to would each compute it.
        rows = cut_lineage(_children(wide, share))
    if parted:
        parted = functools.reduce(DataFrame.union, parted)
        small.append(_hung(parted, bucket))
        dense.append(parted.select("path", "node", "members"))
    if small:
        found.append(cut_lineage(met(functools.reduce(DataFrame.union, small).withColumn("root", F.col("node"))).select("u", "v").distinct()))
    if not found:
        return sets.sparkSession.createDataFrame([], "u long, v long")
    found = functools.reduce(DataFrame.union, found)
    if not dense:
        return found
    known = _with_strays(functools.reduce(DataFrame.union, dense), found)
    return cut_lineage(found.union(met(_across(known, half)).select("u", "v").distinct()))


def _compared(members: DataFrame, tokens: DataFrame, similarity: tuple[int, int], least: int, part: int = 256) -> DataFrame:
    """Every two sets of a component compared once: ``node``, ``links``, ``root`` of those with a link.

    ``members`` has root (the component), node, size, copies and brief. A component is dealt to
    blocks of about ``part`` sets, of at most 4,000,000 tokens or so; two blocks meet in a task.
    ``links`` counts the rows of the similar sets; ``root`` is the least set of those linked by chains.
    """
    p, q = similarity  # similar at p / q or more

    def judged(own: np.ndarray, sizes: np.ndarray, held: list[np.ndarray], briefs: np.ndarray) -> np.ndarray:
        """Which pairs are similar: of one block, or, where two meet, of different ones."""
        alike = np.tril(_agreement(briefs) >= least, -1)
        if own.min() < own.max():
            alike &= own[:, None] != own[None, :]
        for i in np.flatnonzero(alike.any(axis=1)):
            mine, near = held[i], np.flatnonzero(alike[i])
            # Sizes alone rule some out; the rest go through in slices of bounded length.
            near_sizes = sizes[near]
            possible = np.minimum(near_sizes, len(mine)) * (p + q) >= p * (near_sizes + len(mine))
            alike[i, near[~possible]] = False
            near = near[possible]
            ends = np.cumsum(sizes[near])
            for some in np.split(near, np.searchsorted(ends, np.arange(1 << 20, ends[-1], 1 << 20)) if len(ends) else []):
                if not len(some):
                    continue
                others = np.concatenate([held[j] for j in some])
                at = np.minimum(np.searchsorted(mine, others), len(mine) - 1)
                shared = np.add.reduceat(mine[at] == others, np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
                # I / (x + y - I) >= p / q, in whole numbers.
                alike[i, some] = shared * (p + q) >= p * (sizes[some] + len(mine))
        return alike

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, 2):
            nodes, copies, own, blocks = (table.column(c).to_numpy() for c in ("node", "copies", "own", "blocks"))
            briefs = np.frombuffer(b"".join(table.column("brief").to_pylist()), np.uint8).reshape(-1, SKETCH)
            held = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens")]
            sizes = np.array([len(x) for x in held], np.int64)
            out = []
            for a, b in zip(starts[:-1], starts[1:]):
                alike = judged(own[a:b], sizes[a:b], held[a:b], briefs[a:b])
                both = alike | alike.T
                links, group = both @ copies[a:b], _forest(alike, np.arange(b - a))[0]
                for i in np.flatnonzero(links):
                    out.append((nodes[a + i], links[i], nodes[a:b][group == group[i]].min(), blocks[a + i] == 1))
            columns = list(zip(*out)) if out else [[]] * 4
            types = [pa.int64()] * 3 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["node", "links", "root", "whole"]
            )

    facts = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / part), F.ceil(F.sum("size") / 4_000_000)).alias("blocks"))
    dealt = _in_blocks(salted_left_join(members.drop("size"), facts, "root", "node"), "root").join(tokens, "node")
    dealt = dealt.select("root", "chunk", "node", "copies", "own", "blocks", "brief", "tokens")
    dealt = dealt.repartition("root", "chunk").sortWithinPartitions("root", "chunk", "node")
    found = cut_lineage(dealt.mapInArrow(run, "node long, links long, root long, whole boolean"))
    whole = found.filter("whole").select("node", "links", "root")
    parted = found.filter("NOT whole")
    if parted.isEmpty():
        return whole
    linked = parted.groupBy("node").agg(F.sum("links").alias("links"))
    # The least set of a part's group stands for it: links to it join the parts.
    return whole.union(linked.join(components(parted.select(F.col("node").alias("u"), F.col("root").alias("v"))), "node"))


def _grouped_rows(
    docs: DataFrame, similarity: tuple[int, int], width: int, recall: float, share: float, bucket: int, depth: int, seed: int,
    id_column: str, text_column: str, max_broadcast_rows: int,
) -> DataFrame:
    """Every row's doc, digest, set and class, with its number of links and its group's ``root``."""
    base = cut_lineage(token_sets(docs, width, seed, id_column, text_column))
    keys = base.select("doc", "digest", "node", "node1", "size")
    grouped = cut_lineage(with_group_facts(keys, ["node", "node1"], "doc", "min", "class_doc", "copies", combined=False).drop("node1"))
    firsts = grouped.filter("size > 0 AND doc = class_doc").select("node", "doc", "size", "copies").dropDuplicates(["node"])
    sketches = base.select("node", "doc", "sketch", "brief").dropDuplicates(["node", "doc"])
    sets = cut_lineage(firsts.join(sketches, ["node", "doc"]))
    p, q = similarity
    edges = candidate_edges(sets, p / q, recall, share, bucket, depth, seed)
    facts = sets.select("node", "doc", "size", "copies", "brief")
    wanted = cut_lineage(components(edges).join(facts, "node"))
    tokens = _tokens_of(docs, wanted, width, id_column, text_column, max_broadcast_rows)
    facts = _compared(wanted.drop("doc"), tokens, similarity, least_alike(recall, p / q, share))
    columns = grouped.select("doc", "digest", "node", "size", "class_doc", "copies")
    return cut_lineage(salted_left_join(columns, facts, "node", "doc").withColumn("root", F.coalesce("root", "node")))


def near_duplicates(
    docs: DataFrame, *, similarity: tuple[int, int] = (4, 5), width: int = 5, recall: float = 0.9995, share: float = 0.5,
    bucket: int = 512, depth: int = 8, seed: int = 42, id_column: str = "doc_id", text_column: str = "text",
    max_broadcast_rows: int = 500_000,
) -> DataFrame:
    """Documents whose sets of ``width``-word runs have a Jaccard similarity of 4/5 or more.

    Returns one row per row of ``docs``: ``doc_id``; ``class_id``, the least id of the documents
    with the same set; ``class_size``; ``n_links``, the number of other documents it was found
    similar to, copies too; ``group_id``, the least id of those linked by a chain of similar pairs.
    A pair meets with probability ``recall`` at least, and no pair that meets is left out: every two
    sets of a component are compared on the whole sets. A component's rows grow with its members, or,
    above 256 of them, with its pairs of blocks; its comparisons grow with its pairs.

    Texts of fewer than ``width`` words have one run, all their words; texts without a word, NULL
    ones too, are similar to nothing. NULL ids are one id below all others in ``class_id`` and
    ``group_id``, which are then NULL. Rows equal in id and text are documents like others. Other
    columns are not read; an empty table gives no rows.
    """
    rows = _grouped_rows(
        docs, similarity, width, recall, share, bucket, depth, seed, id_column, text_column, max_broadcast_rows
    )
    # The least document of a group, known to its rows without their meeting.
    found = with_group_facts(rows, ["root"], "doc", "min", "group_doc", "__n", combined=False)
    real = lambda c: F.when(F.col(c) != _LEAST, F.col(c))
    alone = F.col("size") == 0
    return found.select(
        real("doc").alias("doc_id"), real("class_doc").alias("class_id"),
        F.when(alone, 1).otherwise(F.col("copies")).cast("long").alias("class_size"),
        F.when(alone, 0).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        real("group_doc").alias("group_id"),
    )


def _tokens_of(docs, wanted, width, id_column, text_column, max_broadcast_rows) -> DataFrame:
    """The whole sets of the wanted nodes: ``node``, ``tokens`` (sorted 64-bit hashes)."""
    doc = F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(_LEAST)).alias("doc")
    rows = docs.select(doc, F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    ids = broadcast_if_small(wanted.select("doc").distinct(), max_broadcast_rows)
    texts = rows.join(ids, "doc", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, find = _WordHashes(), re.compile(WORD).findall
        for batch in text_parts(batches, 1):
            sets = [shingles(find(x), width, hashes).tobytes() for x in batch.column(1).to_pylist()]
            names = [np.frombuffer(hashlib.blake2b(x, digest_size=16).digest(), np.int64)[0] for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["node", "tokens"])

    # Rows of one id can have other texts, or the same text twice.
    return texts.mapInArrow(run, "node long, tokens binary").dropDuplicates(["node"])


def drop_near_duplicates(
    docs: DataFrame, *, similarity: tuple[int, int] = (4, 5), width: int = 5, recall: float = 0.9995, share: float = 0.5,
    bucket: int = 512, depth: int = 8, seed: int = 42, id_column: str = "doc_id", text_column: str = "text",
    max_broadcast_rows: int = 500_000,
) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the least id, all columns kept.

    NULL ids come before all others. Of rows that share the least id the one with the least text
    digest stays, of rows equal in both one. Texts without a word are similar to nothing: all stay.
    """
    rows = _grouped_rows(
        docs, similarity, width, recall, share, bucket, depth, seed, id_column, text_column, max_broadcast_rows
    )
    worded = rows.filter("size > 0").select("root", F.struct("doc", "digest").alias("row"))
    judged = cut_lineage(with_group_facts(worded, ["root"], "row", "min", "first", "n", combined=False).filter("n > 1"))
    row = [F.col("row.doc").alias("__doc"), F.col("row.digest").alias("__digest")]
    dropped = judged.filter("row <> first").select(*row).distinct()
    repeated = judged.filter("row = first").groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select(*row)
    repeated = cut_lineage(repeated)
    doc = F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(_LEAST))
    digest = F.xxhash64(F.coalesce(F.col(f"`{text_column}`"), F.lit("")))
    named = docs.withColumns({"__doc": doc, "__digest": digest})
    kept = named.join(broadcast_if_small(cut_lineage(dropped), max_broadcast_rows), ["__doc", "__digest"], "left_anti")
    if not repeated.isEmpty():
        again = broadcast_if_small(repeated, max_broadcast_rows)
        # Partial aggregates leave one row of a key in each task before anything is shuffled.
        single = kept.join(again, ["__doc", "__digest"], "left_semi").dropDuplicates(["__doc", "__digest"])
        kept = kept.join(again, ["__doc", "__digest"], "left_anti").unionByName(single)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
