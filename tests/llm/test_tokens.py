"""Packing and the token store against plain encoding."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheafwork.llm import common, packing, token_store
from sheafwork.llm.tokens import BulkEncoder

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def plain(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("path", "spaced"), [(WORD, False), (BYTE, True)])
def test_bulk_encoder_equals_plain(path, spaced, rows):
    bulk, one = BulkEncoder(path, spaced), plain(path)

    @settings(max_examples=120, deadline=None)
    @given(st.lists(st.text(st.sampled_from("aéÉ İßx.,'sS! \n\t \x01\x1c中́9<|endoftext|>")), max_size=6))
    def check(texts):
        ids, counts = bulk.encode(pa.array(texts, pa.string()))
        expected = [one(t) for t in texts]
        assert counts.tolist() == [len(e) for e in expected]
        assert ids.tolist() == [i for e in expected for i in e]

    check()
    texts = [r[1] or "" for r in rows]
    ids, counts = bulk.encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in one(t)]


@pytest.mark.parametrize(("path", "spaced"), [(WORD, False), (BYTE, True)])
def test_added_tokens_are_matched(path, spaced):
    one = Tokenizer.from_file(path)
    texts = ["plain words", "a<|endoftext|>b", "", "x <|endoftext|> y<|startoftext|>", "A<|ENDOFTEXT|>b. c", "end <|endoftext", "|> a"]
    ids, counts = BulkEncoder(path, spaced).encode(pa.array(texts))
    expected = [one.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def test_packing_covers_every_id_once(docs, rows, empty):
    length, one = 128, plain(WORD)
    pieces = packing.pack(docs, WORD, length).collect()
    expected = sorted((-1 if i is None else i, one(t) + [1]) for i, t, *_ in rows)
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, own in by_sequence.items():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == length or s == len(by_sequence) - 1
    # A document's pieces follow each other, so a start of 0 begins one.
    got, current = [], []
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        if p["start"] == 0 and current:
            got.append(current)
            current = []
        current.append(p)
    got.append(current)
    found = []
    for own in got:
        match = next(e for e in expected if e[0] == (-1 if own[0]["doc_id"] is None else own[0]["doc_id"]) and len(e[1]) == own[0]["doc_tokens"] and crc(e[1][: own[0]["length"]]) == own[0]["ids_crc32"])
        for p in own:
            assert p["ids_crc32"] == crc(match[1][p["start"] : p["start"] + p["length"]])
        assert sum(p["length"] for p in own) == len(match[1])
        found.append(match)
    assert sorted(found) == expected
    assert packing.pack(empty, WORD).count() == 0


def test_token_store_round_trip(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_IDS", 500)
    monkeypatch.setattr(token_store, "_TOGETHER", 300)
    path = common.new_path(spark, "store")
    token_store.write_tokens(docs, path, BYTE)
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    one, at, expected, flat = plain(BYTE), 0, [], []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[0], r[1]])):
        ids = one(t) + [2]
        expected.append((i, at, len(ids), crc(ids)))
        at += len(ids)
        flat += ids
    got = sorted(map(tuple, token_store.read_documents(spark, path).collect()), key=lambda r: r[1])
    assert got == expected
    asked = spark.range(-3, at + 3).withColumnRenamed("id", "position").unionByName(spark.createDataFrame([(None,), (5,)], "position long"))
    read = token_store.read_tokens(spark, path, asked)
    assert "NestedLoop" not in (plan := read._jdf.queryExecution().toString()) and "Cartesian" not in plan
    assert sorted(map(tuple, read.collect())) == list(enumerate(flat))
    path = common.new_path(spark, "store")
    token_store.write_tokens(empty, path, BYTE)
    assert token_store.read_documents(spark, path).count() == 0
    assert token_store.read_tokens(spark, path, asked).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), st.data())
def test_codes_are_directly_addressable(values, data):
    ids = np.array(values, np.uint32)
    reader = token_store.DacReader(token_store.dac_encode(ids))
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert reader.slice(a, b).tolist() == values[a:b]
    assert all(reader.get(k) == values[k] for k in range(a, min(b, a + 5)))
    some = np.array(data.draw(st.lists(st.integers(0, len(ids) - 1), max_size=20)) if len(ids) else [], np.int64)
    assert reader.take(some).tolist() == [values[k] for k in some]
