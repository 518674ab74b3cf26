from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from huntline.llm import token_files
from huntline.llm.queries import QUERIES, tokenizer_path


def expected(rows):
    """rows: (key, text) in order -> key, start, n_tokens, crc by the library itself, whole texts."""
    tok, start = Tokenizer.from_file(tokenizer_path()), 0
    for key, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        yield key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_query_against_the_library(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in QUERIES["op8_token_files"](spark, small).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == list(expected([(r.doc_id, r.text) for r in rows]))


ODD = ["It's we'll DON'T  a b c", "<|endoftext|>x <|startoftext|> y<|endoftext|>", "é ́x café\ńz", "a\x1cb\x1db\x85c d", "한국어 中文字 \U0001f600\U0001f468‍\U0001f469", "İΣ ΣΣ Éàß 12345 ٤٥", "A,B c.d e?! f|g \x01 a\x01b \x01\x01", "<|ENDOFTEXT|>. THE, the; THE. don't's I'd! won'T", "x\x00y \x0b\x0c\r\n\t z", "﻿#!/usr ²½"]


def test_words_encode_like_whole_texts(small):
    import pyarrow.parquet as pq

    tok, enc = Tokenizer.from_file(tokenizer_path()), token_files.WordEncoder(tokenizer_path(), cached=3)
    texts = [*ODD, " ".join(ODD), "", " ", *pq.read_table(f"{small}/documents.parquet").column("text").to_pylist()[:60]]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    for _ in range(2):
        assert list(enc.encode(pa.array(texts))) == want
    assert list(token_files.TextEncoder(tokenizer_path()).encode(pa.array(texts))) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_each_tokenizer_gives_what_the_library_gives(spark, name):
    texts = [*ODD, "It's we'll DON'T  a b c", "plain lower words, and tails!!! été,,, ß÷ñ"]
    manifest = token_files.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer_path(name), 2)
    tok = Tokenizer.from_file(tokenizer_path(name))
    want = [zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for t in texts]
    assert [r.ids_crc32 for r in token_files.read(manifest).orderBy("key").collect()] == want
    assert token_files.words_apart(tokenizer_path(name)) == (name == "word_bpe_49k.json")


def test_latin_words_with_tails(small):
    tok, enc = Tokenizer.from_file(tokenizer_path()), token_files.WordEncoder(tokenizer_path())
    words = [f"{a}{c}{b}{t}" for c in map(chr, range(0xA0, 0x180)) for a in ("", "x", "é") for b in ("", "z") for t in ("", "###", ".&&&", "'s", ",'", "<|>", "~`^", "́")]
    assert list(enc.encode(pa.array(words))) == [np.array(tok.encode(w, add_special_tokens=False).ids, "<u2").tobytes() for w in words]


def test_odd_rows_and_single_records(spark):
    rows = [(3, None, 1), (1, "", 2), (2, "word " * 40000, 3), (None, "first", 4), (4, "same", 5), (4, "same", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    manifest = token_files.write(docs, tokenizer_path(), 2, file_bytes=50_000)
    got = sorted((tuple(r) for r in token_files.read(manifest).collect()), key=lambda r: r[1])
    assert got == list(expected([(None, "first"), (1, ""), (2, "word " * 40000), (3, None), (4, "same"), (4, "same")]))
    files = manifest.orderBy("part").collect()
    assert len(files) > 1
    keys = [token_files.read_at(f.folder, f.file, f["index"], i)[0] for f in files for i in reversed(range(f.records))]
    assert sorted(keys, key=str) == sorted([None, 1, 2, 3, 4, 4], key=str)
    assert token_files.read(token_files.write(docs.limit(0), tokenizer_path(), 2)).count() == 0


def test_damage_is_noticed(spark):
    manifest = token_files.write(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), tokenizer_path(), 2).collect()[0]
    store, root = token_files.open_folder(manifest.folder)
    path = f"{root}/{manifest.file}"
    data = bytearray(store.open_input_file(path).read())
    data[-6] ^= 1
    with store.open_output_stream(path) as f:
        f.write(bytes(data))
    with pytest.raises(ValueError):
        token_files.read_at(manifest.folder, manifest.file, manifest["index"], 0)
