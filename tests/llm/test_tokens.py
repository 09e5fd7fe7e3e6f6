import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from keyloom.llm import packing, token_files, tokens
from keyloom.llm.tokens import Encoder

from .conftest import EDGE

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.mark.parametrize("name", NAMES)
def test_pieces_equal_whole_texts(name):
    path = public_tokenizers.path(name)
    ours, whole = Encoder(path), Tokenizer.from_file(path)
    letters = st.text(st.sampled_from("abB'st .,\n\t\r é\xa0　\x1c\x85ß9<|#́İΣς漢"), max_size=20)
    words = st.lists(st.sampled_from(["a", "ab.", "c", '"x', "it's", "é", "", "\n", "x\ny", "<|endoftext|>", "’"]), max_size=9).map(" ".join)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(letters | words, max_size=4))
    def check(texts):
        got = [x.tolist() for x in ours.encode_all(texts)]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]

    check()
    texts = [t or "" for _, t, _ in EDGE]
    assert [x.tolist() for x in ours.encode_all(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_pieces_are_looked_up_once_for_all_their_places(name):
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    path = public_tokenizers.path(name)
    ours, whole = Encoder(path), Tokenizer.from_file(path)
    ours.bare.pieces, ours.spaced.pieces = Counted(), Counted()
    texts = ["the cat, the dog.\nthe cat's hat\n(a) the " + "the cat " * 5000 + "x", None, "", "\n", " the\nthe"]
    got = [x.tolist() for x in ours.encode_all(texts)]
    assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert Counted.asked < 100


@pytest.mark.parametrize("name", NAMES)
def test_little_memory_changes_no_ids(name, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 6)
    monkeypatch.setattr(tokens, "CHARACTERS", 40)
    path = public_tokenizers.path(name)
    ours, whole = Encoder(path), Tokenizer.from_file(path)
    texts = [" ".join(f"{w}{m}" for w in ("ab", "cd" * (i % 4 + 1), "é", "3x", "z" * 60)[: i % 6] for m in ("", ",", "'s", "?!")) + "\n" * (i % 2) + "ab" for i in range(60)]
    assert [x.tolist() for x in ours.encode_all(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_an_encoder_keeps_to_the_entries_it_may_remember():
    small = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), remembered=50)
    large = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" ".join(f"w{chr(97 + (i * k) % 26)}{chr(97 + i % 23)}{chr(97 + k % 19)}" for i in range(20)) for k in range(40)]
    for text in texts:
        assert small.encode(text).tolist() == large.encode(text).tolist()
        assert max(len(small.spaced.pieces), len(small.spaced.old_pieces), len(small.spaced.words)) <= 50
    assert len(large.spaced.pieces) > 50


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=30), max_size=8))
def test_values_round_trip(documents):
    packed = [token_files.pack_values(np.array(d, np.uint32)) for d in documents]
    control = np.frombuffer(b"".join(c for c, _ in packed), np.uint8)
    data = np.frombuffer(b"".join(d for _, d in packed), np.uint8)
    out = token_files.unpack_values(control, data, np.array([len(d) for d in documents], np.int64))
    assert out.tolist() == list(itertools.chain(*documents))


def files(df, tmp_path, **options):
    path = str(tmp_path / "out")
    token_files.write_token_files(df, path, public_tokenizers.path(NAMES[0]), 2, **options)
    return df.sparkSession, path


def test_token_files_round_trip(documents, texts, tmp_path):
    spark, path = files(documents, tmp_path, block_tokens=5000)
    whole = Tokenizer.from_file(public_tokenizers.path(NAMES[0]))
    start = 0
    want = []
    for i in sorted(texts):
        ids = whole.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        want.append((i, start, ids))
        start += len(ids)
    got = sorted((r["doc_id"], r["start"], r["ids"]) for r in token_files.read_token_files(spark, path).collect())
    assert got == want
    sums = {r["doc_id"]: tuple(r)[1:] for r in token_files.read_checksums(spark, path).collect()}
    assert sums == {i: (s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, s, x in want}
    ranks = [r["token"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    counts = np.bincount(list(itertools.chain(*[x for _, _, x in want])))
    assert [counts[t] for t in ranks] == sorted(counts[counts > 0], reverse=True)


def test_token_files_edge_cases(edge, empty, tmp_path):
    spark, path = files(edge, tmp_path)
    got = token_files.read_checksums(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 1
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    spark, path = files(empty, tmp_path / "none")
    assert token_files.read_checksums(spark, path).count() == 0


def check_packing(rows, want, tokens, documents=10**9, attention=10**18):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= tokens and len(pieces) <= documents and sum(r["length"] ** 2 for r in pieces) <= attention
    for i, ids in want.items():
        pieces = sorted(by_doc.pop(i), key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert all(r["length"] == min(tokens, int(attention**0.5)) for r in pieces[1:])
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        assert sum(r["length"] for r in pieces) == len(ids)
    assert not by_doc
    return len(by_sequence)


def test_packing(documents, texts):
    path = public_tokenizers.path(NAMES[1])
    whole = Tokenizer.from_file(path)
    want = {i: whole.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}
    rows = packing.pack_documents(documents, path, 0).collect()
    n = check_packing(rows, want, 2048)
    assert n <= -(-sum(map(len, want.values())) // 2048) * 1.03 + 4
    rows = packing.pack_documents(documents, path, 0, tokens=512, documents=3, attention=400 * 400, rule="dot").collect()
    check_packing(rows, want, 512, 3, 400 * 400)


def test_packing_edge_cases(edge, empty):
    path = public_tokenizers.path(NAMES[1])
    rows = packing.pack_documents(edge, path, 0).collect()
    assert sum(r["doc_id"] == 4 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert packing.pack_documents(empty, path, 0).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80), st.sampled_from(["norm", "dot"]), st.integers(1, 9))
def test_best_fit_meets_every_capacity(lengths, rule, documents):
    lengths = np.array(lengths, np.int64)
    bins, offset = packing.best_fit(lengths, 100, documents, 6000 + 4000, rule)
    for b in set(bins.tolist()):
        mine = np.flatnonzero(bins == b)
        mine = mine[np.argsort(offset[mine])]
        assert lengths[mine].sum() <= 100 and len(mine) <= documents and (lengths[mine] ** 2).sum() <= 10_000
        assert offset[mine].tolist() == (np.cumsum(lengths[mine]) - lengths[mine]).tolist()
