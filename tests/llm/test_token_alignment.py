import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from deedscope.llm import token_alignment as ta
from tests.llm.fixtures import clashing, frame, odd_rows

JSON = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN


def plainly(texts):
    """Tokens by the libraries of both formats, groups and links token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    first.encode_special_tokens = True
    letters = ta.letter_bytes()
    found = []
    for text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in first.id_to_token(x)) for x in a]
        bytes_b = [
            bytes([int(p[3:5], 16)]) if second.is_byte(x) else p.replace("▁", " ").encode()
            for x, p in ((x, second.id_to_piece(x)) for x in b)
        ]
        if not text or b"".join(bytes_a) != b" " + text.encode() or b"".join(bytes_b) != b" " + text.encode():
            found.append(([], [], [], []))
            continue
        spans = []
        for side in (bytes_a, bytes_b):
            at, of = 0, []
            for token in side:
                of.append((at, at + len(token)))
                at += len(token)
            spans.append(of)
        links = [
            (x, y)
            for (s, e), x in zip(spans[0], a, strict=True)
            for (t, f), y in zip(spans[1], b, strict=True)
            if s < f and t < e
        ]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, begin = [], 0
        for end in ends:
            groups.append(
                [[x for (s, e), x in zip(of, ids, strict=True) if begin < e <= end] for of, ids in zip(spans, (a, b), strict=True)]
            )
            begin = end
        found.append((a, b, groups, links))
    return found


def expected(rows):
    found = plainly([text for _, text, *_ in rows])
    held = Counter(pair for *_, links in found for pair in set(links))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (doc_id, *_), (a, b, groups, links) in zip(rows, found, strict=True):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (
                doc_id, len(a), len(b), len(groups), len(links), sum(held[p] == most[p[0]] for p in links),
                sum(held[p] for p in links), hashlib.sha256(written.encode()).hexdigest() if a else "",
            )
        )
    return sorted(out, key=str)


def rows_of(seed=1):
    rows = odd_rows(seed)
    # The plain form compares all tokens of a text with all others, so long texts are cut for it here.
    rows = [(i, text if text is None else text[:3_000], *rest) for i, text, *rest in rows]
    odd = ["<|endoftext|> </s> <unk>", "▁ a mark", "a  b   c\n\n\td ", " ", "ﬁ ligature ①", "naïve 🇩🇪 👩‍👩‍👧", "\u0000x", "é"]
    return rows + [(100 + i, text, "en", "a", 1) for i, text in enumerate(odd)]


@pytest.mark.parametrize("bound", [4_000_000, 0])
def test_scores_equal_the_plain_form(spark, bound):
    rows = rows_of()
    found = ta.score_links(frame(spark, rows), JSON, MODEL, PATTERN, max_broadcast_pairs=bound).collect()
    assert sorted(map(tuple, found), key=str) == expected(rows)


def test_empty_tables_clashing_columns_and_only_unaligned_texts(spark):
    assert ta.score_links(frame(spark, []), JSON, MODEL, PATTERN).collect() == []
    rows = [(1, None, "en", "a", 1), (2, "", "en", "a", 1), (3, "▁", "en", "a", 1)]
    found = ta.score_links(clashing(frame(spark, rows), "pairs", "times", "n_a", "row"), JSON, MODEL, PATTERN).collect()
    assert sorted(map(tuple, found)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_align_keeps_columns_and_its_groups_cover_all_tokens(spark):
    rows = rows_of()
    found = ta.align(clashing(frame(spark, rows), "a_ids", "own"), JSON, MODEL, PATTERN).collect()
    plain = {(i, text): x for (i, text, *_), x in zip(rows, plainly([r[1] for r in rows]), strict=True)}
    assert len(found) == len(rows)
    for row in found:
        a, b, groups, _ = plain[row.doc_id, row.text]
        assert (row.a_ids, row.b_ids, row.own) == (a, b, "own")
        assert row.a_counts == [len(x) for x, _ in groups] and row.b_counts == [len(y) for _, y in groups]


def test_whole_long_texts_have_an_alignment():
    first, second = ta.ByteBpe(open(JSON).read(), PATTERN), ta.Pieces(open(MODEL, "rb").read())
    assert first.fast is not None
    for text in ("x" * 300_000, "word " * 200_000, "a" + " " * 1_500_000 + "b"):
        found = ta.align_texts([text, None, text], first, second)
        size = len(text) + 1
        assert found.rows_a[1] == 0 and found.rows_a[0] == found.rows_a[2] > 0
        assert int(first.size[found.a].sum()) == int(second.size[found.b].sum()) == 2 * size


def test_ranks_and_format_encode_alike():
    config = open(JSON).read()
    fast = ta.ByteBpe(config, PATTERN)
    slow = ta.ByteBpe(config, PATTERN)
    slow.fast = None
    texts = [text for _, text, *_ in rows_of(3) if text] + ["".join(map(chr, range(at, at + 500))) for at in range(1, 50_000, 500)]
    for x, y in zip(fast.encode(texts), slow.encode(texts), strict=True):
        assert x.tolist() == y.tolist()


@given(st.lists(st.integers(1, 400), unique=True, max_size=150), st.lists(st.integers(1, 400), unique=True, max_size=150))
def test_gallop_counts_what_lies_below(one, other):
    one, other = np.array(sorted(one), np.int64), np.array(sorted(other), np.int64)
    assert ta.gallop(one, other).tolist() == np.searchsorted(other, one).tolist()


def test_python_gets_wide_rows_in_small_batches(spark, monkeypatch):
    from deedscope.llm import token_alignment as ta

    def sizes(docs, *_):
        def run(batches):
            for batch in batches:
                n = [batch.num_rows] * batch.num_rows
                yield pa.RecordBatch.from_pylist(
                    [{**dict.fromkeys(("doc_id", "n_a", "n_b", "n_groups", "n_links"), k), "groups_sha256": "", "pairs": [1], "times": [1]} for k in n],
                    pa.schema([*[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]),
                )

        schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
        return docs.mapInArrow(run, schema)

    monkeypatch.setattr(ta, "linked_pairs", sizes)
    before = spark.conf.get(ta._BATCH)
    found = ta.score_links(spark.range(3_000).repartition(1), "", "", "").collect()
    assert len(found) == 3_000 and max(r["n_a"] for r in found) <= 1024 and {r["count_sum"] for r in found} == {3_000}
    assert spark.conf.get(ta._BATCH) == before
