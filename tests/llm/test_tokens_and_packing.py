"""Merge rounds and packing against the tokenizers library and brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hedgewatch.llm import bpe, packing, queries


def library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def noise(n, seed=3):
    draw = random.Random(seed)
    signs = "abSB '’sé\n\t 1!日 😀<|İΣ.,'#ß"
    return ["".join(draw.choice(signs) for _ in range(draw.randint(0, 60))) for _ in range(n)]


def test_encoder_matches_the_library(byte_file):
    texts = [*noise(1500), "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "aaaa aaaaaaaaa aaa", " \n x\n\n y ", "x" * 20_000]
    tokenizer, encoder = library(byte_file), bpe.Encoder(bpe.load_vocabulary(byte_file))
    ids, counts = encoder.encode(texts)
    for own, expected, text in zip(np.split(ids, np.cumsum(counts)[:-1]), tokenizer.encode_batch(texts, add_special_tokens=False), texts, strict=True):
        assert own.tolist() == expected.ids
        assert bpe.decode_ids(own, encoder.vocabulary).decode() == tokenizer.decode(expected.ids, skip_special_tokens=False) == text


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(max_size=40), max_size=5))
def test_encoder_on_any_text(byte_file, texts):
    tokenizer, encoder = library(byte_file), bpe.Encoder(bpe.load_vocabulary(byte_file))
    ids, counts = encoder.encode(texts)
    assert ids.tolist() == [i for e in tokenizer.encode_batch(texts, add_special_tokens=False) for i in e.ids]


def test_a_small_cache_changes_nothing(byte_file):
    encoder = bpe.Encoder(bpe.load_vocabulary(byte_file))
    small = bpe.Encoder(encoder.vocabulary)
    small.cache.most = 20
    for text in noise(200) * 2:
        assert small.encode([text])[0].tolist() == encoder.encode([text])[0].tolist()


def test_documents_round_trip(spark, odd_docs, no_docs, byte_file):
    rows = bpe.encode_documents(odd_docs, byte_file, decoded=True).collect()
    texts = collections.Counter((r["doc_id"], r["text"] or "") for r in odd_docs.collect())
    assert collections.Counter((r["doc_id"], r["decoded"]) for r in rows) == texts
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)
    again = bpe.decode_documents(bpe.encode_documents(odd_docs, byte_file), byte_file).collect()
    assert collections.Counter(map(tuple, again)) == texts
    assert bpe.encode_documents(no_docs, byte_file).count() == 0


def test_op3_against_the_library(spark, sf_dir, byte_file):
    tokenizer = library(byte_file)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op3_bpe_encoding(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = tokenizer.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_piece_ids_match_the_library(word_file):
    with open(word_file, encoding="utf-8") as file:
        own = packing.RememberedIds(file.read())
    texts = [*noise(2000), "É́ ́a", "'s x's İ ΑΣ ΑΣ Σ", "<|ENDoftext|> K ſ", "a b c", "Straße. ÀÉ!! don't"]
    expected = [e.ids for e in library(word_file).encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in own.encode(texts)] == expected


@settings(max_examples=150, deadline=None)
@given(lengths=st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=6), room=st.integers(0, 60))
def test_fullest_is_the_best_sum(lengths, room):
    reach = {0}
    for n, c in lengths.items():
        reach = {s + k * n for s in reach for k in range(c + 1) if s + k * n <= room}
    used = packing.fullest(sorted(lengths.items(), reverse=True), room)
    assert sum(n * c for n, c in used) == max(reach)
    assert all(0 < c <= lengths[n] for n, c in used)


def packed_well(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_op7_pieces_and_sequences(spark, sf_dir, word_file):
    tokenizer = library(word_file)
    rows = queries.op7_bin_slack_packing(spark, sf_dir).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert set(by) == set(docs)
    for doc, own in by.items():
        ids = np.array([*tokenizer.encode(docs[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        own.sort(key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == [
            (i, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes())) for i, s in enumerate(range(0, len(ids), 4096))]
    assert packed_well(rows, 4096) <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_packing_small_and_odd(spark, odd_docs, no_docs, word_file):
    rows = packing.pack_documents(odd_docs, word_file, capacity=64).collect()
    assert packed_well(rows, 64) <= -(-sum(r["length"] for r in rows) // 64) + 2
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd_docs.collect()}
    assert packing.pack_documents(no_docs, word_file).count() == 0


def test_one_length_holds_all_rows(spark):
    pieces = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "5L AS length", "id AS ids_crc32")
    rows = packing.pack(pieces, 12).collect()
    assert packed_well(rows, 12) == 1500
