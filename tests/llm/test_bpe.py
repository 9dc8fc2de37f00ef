"""Byte-level BPE against the tiktoken library."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken

from awardlake.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts():
    rng = random.Random(7)
    alphabet = ["a", "b", "é", "ß", "ñ", " ", "\n", "'s", "1", "!", "th", "ing", "漢", "🙂", "é", "lo"]
    yield from ("".join(rng.choices(alphabet, k=rng.randint(1, 400))) for _ in range(200))
    yield from ("".join(rng.choices("abenrst", k=rng.randint(20, 3000))) for _ in range(60))
    yield from ("a" * n for n in (1, 7, 100, 5000, 20001))
    yield from (" " * 3000, "\n" * 999 + "x", "", "aab" * 4000, "!" * 2500)


def test_encoding_matches_the_library(library):
    merges = bpe.Merges(bpe.read_ranks(RANKS))
    pieces = bpe.Pieces(merges)
    import regex

    find = regex.compile(public_tokenizers.PATTERN).findall
    for text in random_texts():
        got = b"".join(map(pieces.__getitem__, find(text)))
        want = library.encode_ordinary(text)
        assert got == b"".join(i.to_bytes(4, "little") for i in want)
        assert merges.decode(want) == text.encode()


def test_every_token_joins_with_itself_and_others(library):
    merges = bpe.Merges(bpe.read_ranks(RANKS))
    rng = random.Random(3)
    some = rng.sample(sorted(merges.ranks), 800)
    for left, right in zip(some, some[1:]):
        whole = left + right
        assert merges.join(merges.merge(left), merges.merge(right)) == merges.merge(whole) == merges._merge_long(whole)


def test_rows_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "y"), (2, None, "z"), (None, "", None), (3, "ab " * 50000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, ("doc_id", "n_tokens")).collect()
    assert len(got) == 5
    for r in got:
        text = {1: "Hello world", 3: "ab " * 50000}.get(r.doc_id, "")
        want = library.encode_ordinary(text)
        assert (r.n_tokens, bytes(r.decoded)) == (len(want), text.encode())
    empty = bpe.digests(docs.limit(0), RANKS, public_tokenizers.PATTERN)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_a_round_trip_is_encoding_and_then_decoding(spark):
    docs = spark.createDataFrame([*enumerate([*random_texts()][::9]), (None, "no id"), (7, None), (7, "")], "doc_id long, text string")
    two = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, keep=("doc_id", "n_tokens"))
    once = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    assert once.columns == two.columns and sorted(map(str, once.collect())) == sorted(map(str, two.collect()))


def test_a_frequent_piece_is_encoded_once_among_many_rare_ones(monkeypatch, library):
    # a full cache used to start anew: frequent pieces were merged again each time it was full
    monkeypatch.setattr(bpe, "CACHE", 8)
    merges = bpe.Merges(bpe.read_ranks(RANKS))
    seen, ids = [], merges.ids
    monkeypatch.setattr(merges, "ids", lambda piece: seen.append(piece) or ids(piece))
    pieces = bpe.Pieces(merges)
    for i in range(200):
        for piece in (" frequently", f"rare{i}", "y" * 70):
            assert pieces[piece] == b"".join(x.to_bytes(4, "little") for x in library.encode_ordinary(piece)) or piece.startswith("rare")
    assert seen.count(b" frequently") == 1 and len(pieces) <= 8 and len(pieces.older) <= 8
