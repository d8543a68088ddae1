"""Op 11 against both libraries, over whole tables and odd texts, with links and groups found token by token."""

import hashlib
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest

from listingmill.llm import alignment, queries

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def spans(parts):
    out, at = [], 0
    for i, raw in parts:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def slowly(rows):
    import public_tokenizers as tokens
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(tokens.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokens.path("piece_bpe_32k.model"))
    decoder = {v: k for k, v in alignment.byte_alphabet().items()}
    assert "".join(decoder[x] for x in "é ".encode()) == "Ã©Ġ" and decoders.ByteLevel().decode(["Ã©Ġ"]) == "é "
    back = alignment.byte_alphabet()
    found, counts = [], Counter()
    for i, text in rows:
        raw = (" " + (text or "")).encode()
        ta = [(x, bytes(back[c] for c in a.id_to_token(x))) for x in a.encode(" " + (text or ""), add_special_tokens=False).ids] if text else []
        tb = []
        for x in b.encode(text or "") if text else []:
            piece = b.id_to_piece(x)
            tb.append((x, bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()))
        if b"".join(r for _, r in ta) != raw or b"".join(r for _, r in tb) != raw:
            found.append((i, [], [], [], []))
            continue
        sa, sb = spans(ta), spans(tb)
        links, low = [], 0
        for x, s, e in sa:
            while sb[low][2] <= s:
                low += 1
            k = low
            while k < len(sb) and sb[k][1] < e:
                links.append((x, sb[k][0]))
                k += 1
        both = sorted({e for *_, e in sa} & {e for *_, e in sb})
        groups = [([x for x, s, e in sa if lo <= s and e <= hi], [y for y, s, e in sb if lo <= s and e <= hi]) for lo, hi in zip([0, *both], both, strict=False)] if len(sa) < 3000 else None
        counts.update(links)
        found.append((i, sa, sb, links, groups))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for i, sa, sb, links, groups in found:
        written = None if groups is None else ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        sha = "" if not sa else None if written is None else hashlib.sha256(written.encode()).hexdigest()
        n_groups = len({e for *_, e in sa} & {e for *_, e in sb})
        out.append((i, len(sa), len(sb), n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return out


def plain(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def agree(got, want):
    want = sorted(want, key=repr)
    assert len(got) == len(want)
    left = {}
    for r in want:
        left.setdefault(r[:-1], []).append(r[-1])
    for r in got:
        shas = left[r[:-1]]
        hit = r[-1] if r[-1] in shas else None
        shas.remove(hit)  # None where the text is too long for the slow way to write its groups


def vocabularies():
    return queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")


@pytest.mark.parametrize("chars", [2000, alignment.BLOCK_CHARS])
def test_documents(spark, sf_dir, chars):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = slowly([tuple(r) for r in docs.select("doc_id", "text").collect()])
    agree(plain(alignment.align(docs, *vocabularies(), block_chars=chars)), want)


def test_query(spark, sf_dir):
    got = queries.op11_alignment(spark, sf_dir)
    assert got.columns == COLUMNS
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  b", "one two", "one two", "tab\tand\nline\r\n", "it's  we'll' 'x 's", "Zürich – ½ ﬁ é ́x", "日本語 テキスト", "🙂🙃 a🙂 b", "▁ under ▁low", "<|endoftext|> <s> </s> <unk> <0x41>", "a b   c", "x" * 5000, "nul\x00 \x00 z", "﻿ start", "१२३ 456 ٣", "ß SS ǅ ǆ", "-- == ..\n\n ##", "a ‍ b", "w\x1c x \x85 y"]


def test_odd_texts(spark):
    rows = [(i if i != 3 else None, t, "k", 1) for i, t in enumerate(TEXTS)] + [(9, "one two", "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, pairs int")
    agree(plain(alignment.align(docs, *vocabularies(), block_chars=30)), slowly([r[:2] for r in rows]))


def test_cut_texts_as_whole_ones():
    with open(vocabularies()[0], encoding="utf-8") as a, open(vocabularies()[1], "rb") as b:
        pair = alignment.Pair(a.read(), b.read())
    assert pair.cuts
    texts = [t or "" for t in TEXTS] + ["The quick brown fox, it's jumping over 12 lazy dogs. " * 20, "mixed ünï wörds­with soft hyphens and_more 3.14 http://a.b/c?d=e&f"]
    cut = alignment.align_block(pair, texts)
    pair.cuts = False
    whole = alignment.align_block(pair, texts)
    for c in ("n_a", "n_b", "n_groups", "n_links", "sha"):
        assert list(cut[c]) == list(whole[c]), c
    assert list(cut["pairs"]) == list(whole["pairs"]) and list(cut["pair_n"]) == list(whole["pair_n"])


def test_a_task_that_ended_leaves_no_pieces(monkeypatch):
    """A worker outlives its task, and what it holds counts while other stages run."""
    with open(vocabularies()[0], encoding="utf-8") as a, open(vocabularies()[1], "rb") as b:
        files = SimpleNamespace(value=(a.read(), b.read()))
    monkeypatch.setattr(alignment, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two three", "two three four"]})
    blocks = list(alignment._blocks(files, 10)([batch]))
    pair = alignment._pair(files)
    assert len(blocks) == 2 and not pair.met and not pair.before and not pair.held


def test_long_text(spark):
    text = "Überlange Texte, words and 12345 numbers\n" * 20000
    docs = spark.createDataFrame([(1, text), (2, text + "x")], "doc_id long, text string")
    one, two = sorted(alignment.align(docs, *vocabularies()).collect())
    assert one.n_a * one.n_b * one.n_groups > 0 and one.count_sum > 0 and two.n_links > one.n_links


def test_empty(spark, empty):
    assert alignment.align(empty, *vocabularies()).collect() == []
