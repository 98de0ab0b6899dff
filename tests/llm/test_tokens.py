"""op1, op7, op10: ids and counts equal the libraries' on whole texts; packing loses nothing and needs no padding."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, packing, queries, token_count

TEXTS = st.text(st.sampled_from(list("aAbeé 'sl\n\t.,!12_▁<|>ΣςİḰ  你\U0001f600")), max_size=60)


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_cut_encoding_is_the_whole_encoding(text):
    enc = bpe.encoding(None)
    assert bpe.encode_text(text, enc, 3).tolist() == enc.encode_ordinary(text)


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_cut_counting_is_the_whole_count(text):
    sp, safe = token_count.model(None)
    assert safe and token_count.count_texts([text], None, 2)[0] == len(sp.encode(text))


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_word_table_is_the_tokenizer(text):
    got = np.frombuffer(packing.encode_texts([text])[0], packing.table(None).dtype).tolist()
    assert got == packing.table(None).tokenizer.encode(text, add_special_tokens=False).ids + [packing.END_ID]


def test_another_tokenizer_encodes_whole_texts():
    path = public.path("byte_bpe_50k.json")
    t = packing.table(path)
    assert packing.table(None).by_words and not t.by_words
    for text in ("Hello World, It is 2024 fine", "", " a\n\nB  c ", "é<|endoftext|>x"):
        got = np.frombuffer(packing.encode_texts([text], path)[0], t.dtype).tolist()
        assert got == t.tokenizer.encode(text, add_special_tokens=False).ids + [packing.END_ID]


def test_byte_bpe_round_trip_on_edge_rows(edge):
    enc = bpe.encoding(None)
    ids = bpe.encode(edge).collect()
    want = sorted((str(r.doc_id), np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes()) for r in edge.collect())
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in ids) == want
    back = bpe.decode(bpe.encode(edge)).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back) == sorted((str(r.doc_id), (r.text or "").encode()) for r in edge.collect())


def test_decode_gives_raw_bytes_of_part_characters(spark):
    enc = bpe.encoding(None)
    half = enc.encode_single_token("é".encode()[:1])
    df = spark.createDataFrame([(1, np.array([half], "<u4").tobytes()), (2, None)], "doc_id long, ids binary")
    assert [bytes(r.decoded) for r in bpe.decode(df).orderBy("doc_id").collect()] == ["é".encode()[:1], b""]


def test_query_digests(spark, sf, small):
    enc = bpe.encoding(None)
    texts = {r.doc_id: r.text or "" for r in small.collect()}
    for r in queries.QUERIES["op1_byte_bpe"](spark, sf).collect():
        ids = np.array(enc.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_counts_on_edge_rows_and_query(spark, sf, edge, small):
    sp, _ = token_count.model(None)
    for rows, got in ((edge.collect(), token_count.count(edge).collect()), (small.collect(), queries.QUERIES["op10_token_count"](spark, sf).collect())):
        want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 4096) for r in rows)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


@pytest.mark.parametrize("seed", range(12))
def test_pack_is_complete_and_unpadded(seed):
    r = random.Random(seed)
    length = r.choice([16, 64, 2048])
    sizes = [r.randint(1, 3 * length) for _ in range(r.randint(0, 300))]
    out = packing.pack(sizes, length)
    seen = [[] for _ in sizes]
    for seq in out:
        n = sum(x[2] for x in seq)
        assert n == length or (n & (n - 1)) == 0
        for d, start, k in seq:
            assert k > 0
            seen[d].append((start, k))
    for size, pieces in zip(sizes, seen):
        at = 0
        for start, k in sorted(pieces):
            assert start == at
            at += k
        assert at == size
    assert len(out) <= sum(sizes) // length + length.bit_length()


def test_tournament_finds_the_first_fit():
    r = random.Random(3)
    t, room = packing.Tournament(37), [0] * 37
    for _ in range(2000):
        i, n = r.randrange(37), r.randint(0, 50)
        room[i] = n
        t.set(i, n)
        want = r.randint(1, 50)
        assert t.first(want) == next((k for k, x in enumerate(room) if x >= want), -1)


def check_pieces(rows, pieces):
    tok = packing.table(None).tokenizer
    by = {}
    for p in pieces:
        by.setdefault(str(p.doc_id), []).append(p)
    want = {}
    for r in rows:
        want.setdefault(str(r.doc_id), []).append(np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4"))
    assert set(by) == set(want)
    for k, texts in want.items():
        assert sum(p.length for p in by[k]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for p in sorted(by[k], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(texts[0]) and p.ids_crc32 == zlib.crc32(texts[0][at : at + p.length].tobytes())
                at += p.length
    seqs = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048 and (at == 2048 or not at & (at - 1))


def test_packing_on_edge_rows_and_query(spark, sf, edge, small):
    check_pieces(edge.collect(), packing.sequences(edge, group_bytes=100_000).collect())
    check_pieces(small.collect(), queries.QUERIES["op7_packing"](spark, sf).collect())


def test_empty_tables(empty):
    assert bpe.decode(bpe.encode(empty)).count() == token_count.count(empty).count() == packing.sequences(empty).count() == 0


def test_vocabulary_path_is_a_parameter(edge):
    other = public.path("byte_bpe_50k.tiktoken")
    assert bpe.encode(edge, ranks=other).count() == edge.count()
