import hashlib
import random

import pytest

from deedscope.llm.byte_bpe import Pieces, decode, encode, merge, parse_ranks, round_trip
from tests.llm.fixtures import SCHEMA, clashing, frame, odd_rows

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return parse_ranks(file.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip_against_the_library(spark, library):
    rows = odd_rows()
    docs = clashing(frame(spark, rows), "ids", "decoded", "n_tokens")
    got = sorted(tuple(map(str, r)) for r in round_trip(docs, PATH, P.PATTERN).collect())
    want = []
    for doc, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (text or "").encode())]
        want.append((str(doc), str(len(ids)), *digests))
    assert got == sorted(want)


def test_every_kind_of_character(library, ranks):
    import regex

    find, pieces = regex.compile(P.PATTERN).findall, Pieces(ranks, 1_000)
    for code in list(range(0x3000)) + list(range(0x3000, 0x110000, 251)):
        if 0xD800 <= code < 0xE000:
            continue
        text = f"a{chr(code)}b {chr(code)} {chr(code) * 2}1\n{chr(code)}"
        found = pieces.of([find(text)])
        assert [i for p in find(text) for i in found[p]] == library.encode_ordinary(text), hex(code)


def plain_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_against_the_plain_rule(ranks):
    rng = random.Random(5)
    for letters in ("ab", "thersing", "abcdefghijklmnopqrstuvwxyz", "\x00\xff\xc3\xa9 "):
        for _ in range(60):
            piece = "".join(rng.choices(letters, k=rng.randint(1, 60))).encode("latin-1")
            got = merge(piece, ranks)
            assert got == plain_merge(piece, ranks) or got == [ranks.get(piece)]


def test_merges_to_a_lower_rank_after_a_higher(ranks):
    # "bc" merges first here, which makes "abc", of lower rank than "cd" still waiting.
    own = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 299, b"cd": 301, b"xy": 302}
    assert merge(b"abcdxyabc", own) == plain_merge(b"abcdxyabc", own)


def test_long_pre_token(ranks, library):
    text = "ab" * 50_000 + "c"
    assert merge(text.encode(), ranks) == library.encode_ordinary(text)


def test_columns_pass_and_cache_is_bounded(spark, library):
    rows = odd_rows()
    got = encode(frame(spark, rows), PATH, P.PATTERN, cache_entries=2).collect()
    assert set(got[0].asDict()) == {"doc_id", "lang", "source", "n_chars", "ids"}
    want = sorted((str(d), library.encode_ordinary(t or "")) for d, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want


def test_decode_null_and_empty(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [64, 65])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in decode(rows, PATH).collect()}
    assert got[1] == got[2] == b"" and len(got[3]) == 2


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN).collect() == []
