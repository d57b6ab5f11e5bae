import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from quire.llm import byte_bpe as bpe

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rnd = random.Random(4)
    alphabet = "a b\n\t '\x1c\x1d\x85\xa0 ​﻿ß́é漢字١2½🙂's're'LL<|endoftext|>\r\x00_-...Zz"
    out = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    letters = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 200))) for _ in range(200)]  # long pre-tokens
    return out + letters + ["", " ", "\n", "aaaa" * 3000, "the cat " * 3000, "x" * 63, "x" * 64, "x" * 65, "don't  stop\n\n now "]


def test_ids_and_bytes_are_the_librarys(spark, ranks, library):
    texts = odd_texts() + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    encoder, decoder = bpe.Encoder(bpe.Vocabulary(ranks), P.PATTERN), bpe.Decoder(ranks)
    for at in range(0, len(texts), 300):
        for text, ids in zip(texts[at:at + 300], encoder.encode_all(texts[at:at + 300])):
            ids = np.frombuffer(ids, "<u4")
            assert ids.tolist() == library.encode_ordinary(text or ""), (text or "")[:60]
            assert decoder.decode_all(ids)[0].tobytes() == (text or "").encode()


def test_side_by_side_equals_one_tree_at_a_time(ranks):
    rnd = random.Random(9)
    pieces = [bytes(rnd.choice(b"abcehnrst ") for _ in range(rnd.randint(1, 64))) for _ in range(2000)]
    got = bpe.Vocabulary(ranks).merge_all(pieces)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [bpe.merge_parts(p, ranks) for p in pieces]


def test_segment_tree_gives_the_leftmost_minimum():
    rnd = random.Random(1)
    for n in (1, 2, 3, 7, 8, 9):
        keys = [rnd.randint(0, 3) << 32 | i for i in range(n)]
        tree = bpe.PairTree(list(keys))
        for _ in range(30):
            i = rnd.randrange(n)
            keys[i] = rnd.choice([bpe._NONE, rnd.randint(0, 3) << 32 | i])
            tree.set(i, keys[i])
            assert tree.node[1] == min(keys)


def test_windows_and_caches_do_not_change_ids(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW_CHARS", 50)
    encoder = bpe.Encoder(bpe.Vocabulary(ranks), P.PATTERN)
    encoder.of_segment.bound = encoder.of_piece.bound = 500
    texts = ["one two\nthree  four five,six " * 40, "no blanks" * 60] * 5
    for _ in range(3):
        assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode_all(texts)] == [library.encode_ordinary(t) for t in texts]


def test_rows_nulls_and_clashing_columns(spark, ranks, library):
    rows = [(1, "a b", "keep", 9), (1, "a b", "keep", 9), (None, None, None, None), (2, "", "", 0), (3, "word " * 3000, "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, n_tokens int")
    ids = bpe.encode(docs, PATH, P.PATTERN)
    assert ids.columns == ["doc_id", "text", "decoded", "ids", "n_tokens"]
    out = bpe.decode(ids, PATH)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    for r in out.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(r.ids) // 4 and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.decode(bpe.encode(docs.limit(0), PATH, P.PATTERN), PATH).count() == 0
    null = spark.createDataFrame([(None,)], "ids binary")
    assert bytes(bpe.decode(null, PATH).first().decoded) == b""


def test_ids_outside_the_vocabulary_are_an_error(ranks):
    with pytest.raises(ValueError, match="outside"):
        bpe.Decoder(ranks).decode_all(np.array([10**6]))


def test_query_against_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = bpe.op13_byte_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
