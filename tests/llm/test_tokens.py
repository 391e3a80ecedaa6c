"""Operators 7 and 9 against the libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from quadrille.llm import byte_bpe, pretokens, token_counts

from .conftest import ODD

PIECES = ["a", "s", "t", "re", "ve", "ll", "'", "'s", "'re", " ", "  ", "\n", "\t", "\r\n", "1", "٣", "é", "中", "😀", ".", "!", " ", "　", "\0", "\x1c", "<|endoftext|>", "Ⅷ", "ʼ", "\U000105c0", "a" * 40]


def texts(n=1500):
    rng = random.Random(3)
    return ["".join(rng.choices(PIECES, k=rng.choice([0, 1, 2, 3, 5, 40, 300]))) for _ in range(n)] + [t or "" for t in ODD] + ["ab" * 3000 + "!" * 3000]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_is_the_library(library):
    codec = byte_bpe.Codec(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), pretokens.class_table())
    every = texts()
    for text, ids in zip(every, codec.encode(every), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
        assert codec.token_offsets(ids)[-1] == len(text.encode())


def test_merges_agree():
    ranks = byte_bpe.parse_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    rng = random.Random(5)
    for _ in range(300):
        piece = "".join(rng.choices("theraningof", k=rng.randrange(2, 60))).encode()
        assert byte_bpe._merge_short(piece, ranks) == byte_bpe._merge_long(piece, ranks)


def test_boundaries_across_blocks(library):
    table = pretokens.class_table()
    for n in (63, 64, 65, 127, 128, 129):
        for tail in ("'re x", "  x", "\n\nx", "1a"):
            text = "b" * n + tail
            data, a, b, count = pretokens.pieces([text], table)
            assert b"".join(data[x:y] for x, y in zip(a, b, strict=True)) == text.encode() and count.sum() == len(a)
            assert [data[x:y].decode() for x, y in zip(a, b, strict=True)] == __import__("regex").findall(P.PATTERN, text)


def test_counts_are_the_library():
    counter = token_counts.PieceCounter(open(P.path("byte_bpe_50k.json"), "rb").read(), pretokens.class_table())
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    every = texts()
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in every]
    assert counter.of_texts(every).tolist() == want
    assert counter.of_texts(every[::-1]).tolist() == want[::-1]  # from the memo
    assert counter.of_texts([]).tolist() == [] and counter.of_texts(["", ""]).tolist() == [0, 0]


def test_queries_rows(make_docs, library):
    rows = [*enumerate(ODD), (3, "again"), (3, "again"), (None, "no id")]
    docs = make_docs(rows)
    got = token_counts.token_counts(docs, P.path("byte_bpe_50k.json")).collect()
    assert len(got) == len(rows) and got[0].asDict() == {"doc_id": 0, "n_bytes": 0, "n_tokens": 0, "over_limit": False}
    enc = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.encode_digests(docs, P.path("byte_bpe_50k.tiktoken")).collect()}
    want = set()
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        want.add((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert enc == want
    whole = byte_bpe.encode(docs.filter("doc_id = 8"), P.path("byte_bpe_50k.tiktoken")).first()
    assert bytes(whole.decoded).decode() == ODD[8] and len(whole.ids) == len(whole.byte_offsets)


def test_empty(make_docs):
    assert token_counts.token_counts(make_docs([]), P.path("byte_bpe_50k.json")).count() == 0
    assert byte_bpe.encode_digests(make_docs([]), P.path("byte_bpe_50k.tiktoken")).count() == 0
