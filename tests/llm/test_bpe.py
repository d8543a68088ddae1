import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from listingmill.llm import bpe, queries

public = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    spec = open(queries.vocabulary(), encoding="utf-8").read()
    return bpe.Tokenizer(spec), public.Tokenizer.from_str(spec)


def test_ids_and_text_equal_the_library(both):
    own, library = both
    r = random.Random(1)
    pools = ["abcdefghij '!s", "<|startoftext|>endof</w>", "".join(map(chr, range(0x250))), "ΣςσİıßẞÅ가각한국日本テスト🎉👍🏽ȩ́́\x1c\x85​﻿0１२½Ⅷ", "'s't're've'm'll'dS'T"]
    texts = ["", " ", "hello<|endoftext|>World", "aaaaaaaaaaaaaaaaaaaaaaaa", "don't  STOP\n1234 £5.60"]
    texts += ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(chr(r.choice([r.randint(0, 0xD7FF), r.randint(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(300)]
    for t, ids in zip(texts, own.encode_batch(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_memory_bound_changes_nothing(both, monkeypatch):
    own, _ = both
    r = random.Random(4)
    texts = [" ".join(r.choice(("alpha", "beta", "gamma", "delta")) + str(r.randint(0, 40)) for _ in range(30)) for _ in range(60)]
    want = own.encode_batch(texts)
    for bound in (1, 1000, 5000):
        monkeypatch.setattr(bpe, "REMEMBERED", bound)
        own.met, own.met_before, own.met_bytes = {}, {}, 0
        assert [own.encode_batch([t])[0] for t in texts] == want
        assert own.met_bytes <= bound + 30 * 300  # one text more than the bound at most


def test_a_task_that_ended_leaves_no_pieces(both, monkeypatch):
    """A worker outlives its task, and what it holds counts while other stages run."""
    own, _ = both
    monkeypatch.setattr(bpe, "_TEXTS", 2)
    spec = SimpleNamespace(value=own.spec)
    texts = ["one two", "", "three", "two one", "four"]
    (rows,) = bpe._encoded(spec, True)([pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "text": texts})])
    assert rows.column("ids").to_pylist() == own.encode_batch(texts)
    tok = bpe._tokenizer(spec)
    assert not tok.met and not tok.met_before and not tok.met_bytes


def test_long_texts_are_cut_at_spaces(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(bpe, "_AT_ONCE", 50)
    text = " ".join(["don't", "\t x<|endoftext|>y ", "ΣΑΣ.", "caf\u0065\u0301", "12.5%", "  ", "it's"] * 60)
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert list(own.encode_all(["a", text, "b c", text])) == own.encode_batch(["a", text, "b c", text])
    word = "x" * 3000
    assert np.frombuffer(own.encode(word), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids


def test_unknown_ids_are_left_out(both):
    own, _ = both
    ids = np.frombuffer(own.encode("one two"), "<u4")
    assert own.decode(np.r_[ids[:1], [10**6], ids[1:]].astype("<u4").tobytes()) == own.decode(ids.tobytes())


def test_all_documents_against_the_library(spark, sf_dir, both):
    _, library = both
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op2_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_frames(spark, odd, empty):
    rows = bpe.encode(odd, queries.vocabulary(), decoded=True).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3, None)} == {0}
    again = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd, queries.vocabulary()), queries.vocabulary()).collect()}
    assert again[5] == "one</w>" and again[1] == ""
    assert bpe.encode(empty, queries.vocabulary()).count() == 0
