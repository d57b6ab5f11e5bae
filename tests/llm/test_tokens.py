"""Token operators against the tokenizer libraries."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer, models

from quire.llm import packing, token_records
from quire.llm.token_counts import UnigramCounter, piece_scores, token_counts
from quire.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
ODD = ["i'm it's don't  we'll\n\n  x \n y  ", " lead", "trail ", "a\r\nb", "x <|endoftext|> y", "é x", "\x00 a\x00b",
       "▁ a  ▁▁b ▁", "<0x41> A", "x" * 3000, "中文 😀 ß", " ", "\n"]


def texts(spark):
    rnd = random.Random(3)
    alphabet = "ab cdé\n\t ß▁12.,'\"’  st \x1c中😀\x00"
    fuzz = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(400)]
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ODD + fuzz


def whole(file, end):
    t = Tokenizer.from_file(P.path(file))
    t.encode_special_tokens = True
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("file,style", [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_segments_give_the_ids_of_whole_texts(spark, file, style):
    t, e = whole(file, 0), encoder(P.path(file), style)
    for x in texts(spark):
        assert np.frombuffer(e.encode(x), "<u4").tolist() == t(x)[:-1], x[:80]


def test_long_texts_are_cut_into_windows(monkeypatch):
    from quire.llm import tokens
    text = "one two\nthree  four " * 50
    want = encoder(P.path("byte_bpe_50k.json"), "bytes").encode(text)
    real = tokens.windows
    monkeypatch.setattr(tokens, "windows", lambda x: real(x, 64))
    assert "".join(tokens.windows(text)) == text and len(list(tokens.windows(text))) > 5
    assert encoder(P.path("byte_bpe_50k.json"), "bytes").encode(text) == want


def test_unigram_counts_match_the_library(spark):
    pieces = piece_scores(P.path("piece_bpe_32k.model"))
    lib, own = Tokenizer(models.Unigram(pieces, 0, True)), UnigramCounter(pieces)
    for x in texts(spark):
        want = len(lib.encode("▁" + x.replace(" ", "▁"), add_special_tokens=False).ids) if x else 0
        assert own.count(x)[0] == want, x[:80]


def test_unigram_ties_keep_the_longest_last_piece():
    own = UnigramCounter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0)])
    lib = Tokenizer(models.Unigram([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0)], None, False))
    for x in ("▁ab", "▁abab", "▁aabb"):
        assert own.viterbi(x)[0] == len(lib.encode(x).ids)


def rows(spark):
    return spark.createDataFrame(
        [(3, "b b", "x"), (1, None, "x"), (2, "", "x"), (None, "word", "x"), (3, "b b", "y"), (7, "long text " * 3000, "z")],
        "doc_id long, text string, ids string")


def test_token_counts_cases(spark):
    got = token_counts(rows(spark), P.path("piece_bpe_32k.model")).collect()
    assert len(got) == 6 and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert token_counts(rows(spark).limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_best_fill_is_the_largest_reachable_sum():
    rnd = random.Random(5)
    for _ in range(300):
        lengths = [rnd.randint(1, 20) for _ in range(rnd.randint(0, 9))]
        capacity = rnd.randint(1, 40)
        counts = {n: lengths.count(n) for n in lengths}
        got = packing.best_fill(counts, sorted(counts), capacity)
        assert all(got[n] <= counts[n] for n in got)
        sums = {0}
        for n in lengths:
            sums |= {s + n for s in sums}
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= capacity)


def check_packing(pieces, docs, encode, window):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for doc_id, text in docs.items():
        want, got = encode(text), sorted(by_doc.pop(doc_id), key=lambda p: p.start)
        assert [p.start for p in got] == [sum(q.length for q in got[:i]) for i in range(len(got))]
        assert np.frombuffer(b"".join(p.ids for p in got), "<u4").tolist() == want
        assert {p.doc_tokens for p in got} == {len(want)}
    assert not by_doc
    padding = total = 0
    for s in by_seq.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == [sum(q.length for q in s[:i]) for i in range(len(s))]
        n = sum(p.length for p in s)
        assert n <= window
        total += n
        padding += 0 if n & (n - 1) == 0 else window - n
    return padding / max(1, total)


@pytest.mark.parametrize("buffer", [500, 1 << 22])
def test_packing_places_every_id_once(spark, buffer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    pieces = packing.pack_documents(docs, P.path("word_bpe_49k.json"), "words", 2, window=256, buffer_tokens=buffer).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check_packing(pieces, texts, whole("word_bpe_49k.json", 2), 256) == 0


def test_packing_cases(spark):
    d = rows(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = packing.packed_digest(d).collect()
    assert {r.doc_id: r.doc_tokens for r in got}[1] == 1
    assert zlib.crc32(np.array([2], "<u4").tobytes()) in {r.ids_crc32 for r in got if r.doc_id == 2}
    assert len(packing.packed_digest(rows(spark)).filter("doc_id is null").collect()) == 1
    assert packing.packed_digest(d.limit(0)).count() == 0


def test_records_round_trip(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    m = token_records.write_records(docs, str(tmp_path / "r"), P.path("byte_bpe_50k.json"), "bytes", 0, width=2, files=3)
    got = {r.doc_id: r for r in token_records.read_records(m, slice_records=7).collect()}
    encode, at = whole("byte_bpe_50k.json", 0), 0
    for r in docs.orderBy("doc_id").collect():
        want = encode(r.text)
        assert np.frombuffer(got[r.doc_id].ids, "<u4").tolist() == want
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens) == (at, len(want))
        at += len(want)
    assert len(got) == docs.count()


def test_records_cases(spark, tmp_path):
    m = token_records.write_records(rows(spark), str(tmp_path / "r"), P.path("byte_bpe_50k.json"), "bytes", 0, files=2)
    got = token_records.read_records(m).collect()
    assert len(got) == 6 and {r.doc_id: r.start for r in got}[None] == 0
    m = token_records.write_records(rows(spark).limit(0), str(tmp_path / "e"), P.path("byte_bpe_50k.json"), "bytes", 0)
    assert token_records.read_records(m).count() == 0


def test_damaged_frames_are_refused():
    data = token_records.frame(b"payload")
    assert bytes(token_records.unframe(memoryview(data))[0]) == b"payload"
    for i in range(len(data)):
        bad = bytearray(data)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe(memoryview(bytes(bad)))
    with pytest.raises(ValueError):
        token_records.unframe(memoryview(data[:-1]))


@pytest.mark.parametrize("file,style", [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_special_tokens_are_the_librarys_on_demand(file, style):
    lib, own = Tokenizer.from_file(P.path(file)), encoder(P.path(file), style, plain_specials=False)
    for x in (" <|endoftext|>", "a<|endoftext|>b", "a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|>\n\ny", "<|startoftext|>word, <|END|>"):
        assert np.frombuffer(own.encode(x), "<u4").tolist() == lib.encode(x, add_special_tokens=False).ids, x


def test_files_of_an_id_of_very_many_rows(spark, tmp_path):
    """One id for half of the rows: several files share it, and rows come back whole and ascending."""
    rnd = random.Random(8)
    data = [(5 if i % 2 else i, " ".join(rnd.choice("abc") for _ in range(6))) for i in range(2000)] + [(None, "n"), (None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    m = token_records.write_records(docs, str(tmp_path / "r"), P.path("byte_bpe_50k.json"), "bytes", 0, width=2, files=8)
    sizes = [r.n_records for r in m.collect()]
    assert max(sizes) < 800 and sum(sizes) == len(data)
    got = sorted(token_records.read_records(m, slice_records=100).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted((d for d, _ in data), key=lambda d: (d is not None, d))
    t = whole("byte_bpe_50k.json", 0)
    assert sorted(r.ids for r in got) == sorted(np.array(t(x), "<u4").tobytes() for _, x in data)
