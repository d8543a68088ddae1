"""BPE encoding and decoding by dynamic programming over the prefixes of each piece.

An automaton over the vocabulary gives, for every prefix of a piece, all tokens that are a
suffix of it. The BPE encoding of a prefix has exactly one last token: the token ``t`` such
that the prefix before it ends in a token with which ``t`` is compatible, i.e. BPE over the
two tokens' characters would keep both. That one token is stored for every prefix; following
the stored tokens back from the end gives the ids. (See the linear-time BPE literature; the
proof that the last token is unique rests on merges being applied in the order of their rank.)

Pieces recur, so each task keeps the ids of those it has met lately, in two generations
of bounded size: when the younger is full it becomes the older, whose pieces return to the younger
where they are met again, so frequent ones stay. New pieces are taken in sorted order: they
begin like the one before and share its prefixes. No piece holds white space, so a long text is
taken in parts that end before a space.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from listingmill.llm.common import id_text

#: Bytes of one generation of remembered pieces, about, and pairs of tokens before they are forgotten.
REMEMBERED, PAIRS = 16 << 20, 200_000
#: Steps of the automaton that are stored; others are found through failure links.
STEPS = 300_000
#: Bytes that a remembered piece takes beside its own characters and ids.
_ENTRY = 200
#: Characters of text that are taken at once, about, and texts that are taken out of a batch at once.
_AT_ONCE, _TEXTS = 1 << 20, 256
#: Where all characters of a text are below U+0250, these classes hold what the properties do.
_LATIN = ((r"\p{L}", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"), (r"\p{N}", "0-9\xb2\xb3\xb9\xbc-\xbe"), (r"\s", "\t-\r \x85\xa0"))


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable bytes stand for
    themselves, the others in order for the characters from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class SuffixAutomaton:
    """States over the vocabulary's atoms; ``out[state]`` lists all tokens that are suffixes of what was read."""

    def __init__(self, tokens: dict[int, str]):
        self.step: dict[int, int] = {}
        self.out: list[tuple[tuple[int, int], ...]] = [()]
        self.fail = [0]
        children: list[dict[int, int]] = [{}]
        for token, atoms in tokens.items():
            at = 0
            for c in map(ord, atoms):
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = children[at][c] = len(children)
                    children.append({})
                    self.out.append(())
                    self.fail.append(0)
                at = nxt
            self.out[at] = ((token, len(atoms)),)
        level = list(children[0].values())
        self.step.update(children[0])
        while level:
            deeper = []
            for at in level:
                self.out[at] += self.out[self.fail[at]]
                for c, nxt in children[at].items():
                    self.step[at << 9 | c] = nxt
                    self.fail[nxt] = self.go(self.fail[at], c)
                    deeper.append(nxt)
            level = deeper

    def go(self, state: int, c: int) -> int:
        step = self.step
        while (nxt := step.get(state << 9 | c)) is None:
            if not state:
                return 0
            state = self.fail[state]
        return nxt


class Tokenizer:
    """A byte-level BPE vocabulary whose words end in a suffix, with its normalizer and splitter.

    Built from the JSON text of a ``tokenizers`` file: NFC, white space to one space, lower case;
    pieces by the file's pattern; bytes; merges with ``end_of_word_suffix``. Special tokens of
    the file are found in the raw text first, as that library does.
    """

    def __init__(self, spec: str):
        import re

        import regex

        self.spec, self.library = spec, None
        d = json.loads(spec)
        model, suffix = d["model"], d["model"]["end_of_word_suffix"]
        split = d["pre_tokenizer"]["pretokenizers"][0]
        if not suffix or model.get("dropout") or model.get("ignore_merges") or [n["type"] for n in d["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or not split["invert"]:
            raise ValueError("not a vocabulary of the supported kind")
        pattern = split["pattern"]["Regex"]
        self.any_pieces = regex.compile(pattern).findall
        for name, plain in _LATIN:
            pattern = pattern.replace(f"[{name}]", f"[{plain}]").replace(name, plain)
        self.latin_pieces = re.compile(pattern).findall
        self.beyond_latin = re.compile("[^\x00-\u024f]").search
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        marks = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.cut = regex.compile(f"({marks})").split if marks else lambda text: [text]
        byte = byte_alphabet()
        vocab = model["vocab"]
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        # atoms: 0-255 a byte inside a word, 256-511 the last byte of a word
        atoms = {vocab[c]: chr(b) for c, b in byte.items() if c in vocab} | {vocab[c + suffix]: chr(256 + b) for c, b in byte.items() if c + suffix in vocab}
        self.rank = {i: -1 for i in atoms}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, new = vocab[left], vocab[right], vocab[left + right]
            if new in self.rank:
                raise ValueError(f"token {new} has two merges")
            self.rank[new], self.parts[new], self.merged[a, b] = r, (a, b), new
            atoms[new] = atoms[a] + atoms[b]
        self.atoms, self.size = atoms, {i: len(s) for i, s in atoms.items()}
        self.by_atom = {ord(s): i for i, s in atoms.items() if len(s) == 1}
        self.suffixes = SuffixAutomaton(atoms)
        self.known: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.met: dict[str, bytes] = {}
        self.met_before: dict[str, bytes] = {}
        self.met_bytes = 0
        last = max(self.names, default=-1) + 1
        self.name_list = pa.array([self.names.get(i) for i in range(last)], pa.string())

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE over the characters of tokens ``a`` and ``b`` ends with exactly these two.

        Merges are undone from the latest back. At every stage the two tokens that then met at
        the border must not have a merge that would have come first.
        """
        rank, parts, merged = self.rank, self.parts, self.merged
        before = 1 << 60  # a merge over the border of a lower rank than this would have happened
        while True:
            new = merged.get((a, b))
            if new is not None and rank[new] < before:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                # the left token was made later; its merge lies left of the border and goes first at equal ranks
                before, a = ra, parts[a][1]
            else:
                # the right token's merge lies right of the border, which goes first at equal ranks
                before, b = rb + 1, parts[b][0]

    def stands(self, token: int) -> bool:
        """Whether BPE over the characters of ``token`` gives that token."""
        if token not in self.whole:
            seq = [self.by_atom[ord(c)] for c in self.atoms[token]]
            while len(seq) > 1:
                made = [(self.rank[m], i) for i, p in enumerate(zip(seq[:-1], seq[1:], strict=True)) if (m := self.merged.get(p)) is not None]
                if not made:
                    break
                _, i = min(made)
                seq[i : i + 2] = [self.merged[seq[i], seq[i + 1]]]
            self.whole[token] = seq == [token]
        return self.whole[token]

    def encode_pieces(self, pieces) -> dict[str, bytes]:
        """Ids (little-endian unsigned 32-bit integers) of different pieces.

        Sorted pieces share beginnings with the one before, whose stored last tokens hold for them too.
        """
        out_of, step, go, known, size = self.suffixes.out, self.suffixes.step.get, self.suffixes.go, self.known, self.size
        if len(known) > PAIRS:
            self.known = known = {}
        steps = self.suffixes.step
        done: dict[str, bytes] = {}
        before, last, states = b"", [0], [0]  # last[i], states[i]: last token and state of the prefix of i atoms
        for piece in sorted(pieces):
            word = piece.encode()
            n = len(word)
            k, most = 0, min(n, len(before)) - 1
            while k < most and word[k] == before[k]:
                k += 1
            del last[k + 1 :], states[k + 1 :]
            state = states[k]
            for end in range(k + 1, n + 1):
                c = word[end - 1] if end < n else 256 + word[-1]
                nxt = step(state << 9 | c)
                if nxt is None:
                    nxt = go(state, c)
                    if len(steps) < STEPS:
                        steps[state << 9 | c] = nxt
                state = nxt
                for token, length in out_of[state]:
                    if length == end:
                        good = self.stands(token)
                    else:
                        key = last[end - length] << 20 | token
                        good = known.get(key)
                        if good is None:
                            good = known[key] = self.compatible(key >> 20, token)
                    if good:
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                last.append(token)
                states.append(state)
            ids, at = [], n
            while at:
                token = last[at]
                ids.append(token)
                at -= size[token]
            done[piece] = pack(f"<{len(ids)}I", *ids[::-1])
            before = word
        return done

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text, normalized.

        Unicode versions differ in which characters are letters. Where a text holds one that is
        not in the oldest version that Python knows, the library's normalizer and splitter decide.
        """
        plain = self.normalize(text)
        if not self.beyond_latin(plain) and not self.beyond_latin(text):
            return self.latin_pieces(plain)
        if any(unicodedata.ucd_3_2_0.category(c) == "Cn" for c in set(text)):
            if self.library is None:
                from tokenizers import Tokenizer as Library

                self.library = Library.from_str(self.spec)
            text = self.library.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.any_pieces(plain)

    def normalize(self, text: str) -> str:
        # one character at a time: the final sigma has no rule of its own
        return (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [[(p, None) if p in self.special else (p, self.pieces(p)) for p in self.cut(t) if p] for t in texts]
        met = self._recall(set().union(*(pieces for parts in cut for _, pieces in parts if pieces)))
        get = met.__getitem__
        return [b"".join(pack("<I", self.special[p]) if pieces is None else b"".join(map(get, pieces)) for p, pieces in parts) for parts in cut]

    def _recall(self, pieces: set[str]) -> dict[str, bytes]:
        """A dictionary that holds the ids of all these pieces."""
        if self.met_bytes > REMEMBERED:
            self.met, self.met_before, self.met_bytes = {}, self.met, 0
        met, before = self.met, self.met_before
        missing = pieces - met.keys()
        found = {p: before[p] for p in missing & before.keys()}
        new = self.encode_pieces(missing - found.keys())
        for more in (found, new):
            met.update(more)
            self.met_bytes += sum(map(len, more)) + sum(map(len, more.values())) + _ENTRY * len(more)
        return met

    def forget(self) -> None:
        """Ids of pieces are kept for a task: a worker that waits holds its tokenizer and no more."""
        self.met, self.met_before, self.met_bytes = {}, {}, 0

    def encode_all(self, texts: Iterable[str]):
        """Ids of each text in turn, a bounded number of characters at a time."""
        held, size = [], 0
        for text in texts:
            if len(text) > 2 * _AT_ONCE:
                yield from self.encode_batch(held)
                held, size = [], 0
                yield b"".join(self.encode_batch([part])[0] for part in _parts(text))
                continue
            held.append(text)
            size += len(text)
            if size > _AT_ONCE:
                yield from self.encode_batch(held)
                held, size = [], 0
        yield from self.encode_batch(held)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode_batch(self, encoded: list[bytes]) -> pa.Array:
        """Names of the tokens, joined by one space, special ones included; unknown ids are left out."""
        ids = np.frombuffer(b"".join(encoded), "<u4").astype(np.int64)
        sizes = np.fromiter((len(x) // 4 for x in encoded), np.int64, len(encoded))
        known = ids < len(self.name_list)
        if not known.all() or self.name_list.null_count:
            known[known] = self.name_list.is_valid().to_numpy(zero_copy_only=False)[ids[known]]
            kept = np.r_[0, np.cumsum(known)]
            ids, offsets = ids[known], kept[np.r_[0, np.cumsum(sizes)]]
        else:
            offsets = np.r_[0, np.cumsum(sizes)]
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), self.name_list.take(pa.array(ids))), " ")

    def decode(self, ids: bytes) -> str:
        return self.decode_batch([ids])[0].as_py()


def _parts(text: str):
    at = 0
    while at < len(text):
        end = text.find(" ", at + _AT_ONCE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


_loaded: dict[int, Tokenizer] = {}


def _tokenizer(spec) -> Tokenizer:
    """One tokenizer for each Python worker and vocabulary."""
    key = hash(spec.value)
    if key not in _loaded:
        _loaded[key] = Tokenizer(spec.value)
    return _loaded[key]


def _share(spark, vocabulary: str):
    with open(vocabulary, encoding="utf-8") as f:  # a file on the driver, of bounded size, sent to every worker once
        return spark.sparkContext.broadcast(f.read())


def _texts(array: pa.Array):
    for at in range(0, len(array), _TEXTS):
        yield from array.slice(at, _TEXTS).to_pylist()


def _encoded(spec, decoded: bool):
    def run(batches):
        tok = _tokenizer(spec)
        for batch in batches:
            start, held, size = 0, [], 0
            for i, ids in enumerate(tok.encode_all(_texts(batch.column(1)))):
                held.append(ids)
                size += len(ids)
                if size > _AT_ONCE or i == batch.num_rows - 1:
                    cols = [batch.column(0).slice(start, len(held)), pa.array([len(x) // 4 for x in held], pa.int64()), pa.array(held, pa.binary())]
                    cols += [tok.decode_batch(held).cast(pa.string())] if decoded else []
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids", "decoded"][: len(cols)])
                    start, held, size = i + 1, [], 0
        tok.forget()

    return run


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of every row, and their ``decoded`` text if asked for.

    ``vocabulary`` is the path of the file on the driver. Defined cases: a null text has no
    tokens; a text of any length is encoded whole; repeated rows and null ids each get a
    result; other columns, of any name, are not read; an empty table gives an empty result.
    """
    spec = _share(docs.sparkSession, vocabulary)
    return id_text(docs, id_col, text_col).mapInArrow(_encoded(spec, decoded), "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded text of every row of encoded ids (null ids: the empty text)."""
    spec = _share(encoded.sparkSession, vocabulary)

    def run(batches):
        tok = _tokenizer(spec)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = tok.decode_batch([x or b"" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), texts.cast(pa.string())], names=["doc_id", "text"])

    return encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")
