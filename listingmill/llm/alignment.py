"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of linked token ids.

Tokens of A and B whose byte ranges overlap are linked. In the bipartite graph of a text's tokens
the connected components, found by union-find, are the minimal groups in which both tokenizers cover
the same bytes; their members, in order, are written out as the text's groups.

Texts are worked on in blocks of bounded size. Neither tokenizer joins bytes across a single space between
visible characters (checked when they are loaded), so a text is cut there into pieces, and
each different piece of a block is tokenized, linked and grouped once. A block is written as one row: what
its texts are made of, and how often each pair of ids is linked in it. Pairs are summed over the
blocks with Spark, each block gets back the counts of its own pairs, and its texts' figures follow.
A pair is shuffled once a block and not once a link, however often it occurs. There are few different pairs beside the texts, so
their counts go to the blocks, which stay where they are; only beyond a bound are both shuffled.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmill.llm.common import id_text, materialize

#: Characters of text and rows of a block; a longer text is a block of its own. Blocks that are written, and read again, at once.
BLOCK_CHARS, BLOCK_ROWS, AT_ONCE = 2 << 20, 20_000, 2
#: Different pairs whose counts are sent to every worker, 17 bytes each; more of them are shuffled to the blocks.
SENT_PAIRS = 1_000_000
#: Bytes of pieces that a task remembers in each of two generations, and characters of the longest one.
REMEMBERED, LONG = 16 << 20, 64
#: Characters that are tokenized at once; bytes that remembering a piece takes besides its own.
_AT_ONCE, _ENTRY = 1 << 16, 300
#: Where a text is cut: a single space, with a letter, digit or visible ASCII character on both sides.
_CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
_EDGES = re.compile(r"[!-~\w](?:.*[!-~\w])?\Z", re.S)
#: A space that is no cut, seen from either side.
_NO_CUTS = re.compile(r" (?![!-~\w])"), re.compile(r"[^!-~\w] ")
_SPACE = "▁"
#: What follows a member of a group: others of its side, the other side, the next group.
_AFTER = (",", "|", ";")
_B_BITS = 32


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Bytes that are visible in Latin-1 stand for themselves; the others, in order, are characters from 256 on.
    """
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


def groups_of(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """Union-find: the smallest node of the component of every node, over links from ``a`` to ``b``.

    All links at once: every root is hung below the smaller root that a link ties it to, and paths are
    halved to their roots, until no link joins two roots.
    """
    root = np.arange(nodes)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


class Pair:
    """Both tokenizers, loaded once in each Python worker from the bytes of their files."""

    def __init__(self, byte_level: str, pieces: bytes):
        import sentencepiece
        import tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = tokenizers.Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        alphabet = byte_alphabet()
        # an added token is plain text here and its id never comes out, so its name need not be in the alphabet
        names = {i: bytes(alphabet[c] for c in name) for name, i in self.a.get_vocab(False).items() if all(c in alphabet for c in name)}
        self.a_bytes = [names.get(i, b"") for i in range(max(names, default=-1) + 1)]
        marks = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-Fa-f]{2}>", m) else m.replace(_SPACE, " ").encode() for m in marks]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in names], np.int64) for names in (self.a_bytes, self.b_bytes))
        # every id as it is written, with each of what may follow it
        self.written = np.array([f"{i}{after}".encode() for i in range(max(len(self.a_bytes), len(self.b_bytes))) for after in _AFTER], object)
        self.written_sizes = np.array([len(x) for x in self.written], np.int64)
        self.met: dict[str, tuple] = {}
        self.before: dict[str, tuple] = {}
        self.held = 0
        # A's splitter begins a word at a single space; a piece of B with a space behind another character could join both sides of a cut
        spec = json.loads(byte_level)
        splits = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items() <= (spec["pre_tokenizer"] or {}).items()
        self.cuts = splits and spec["normalizer"] is None and not any(re.search(f"[^{_SPACE}]{_SPACE}", m) for m in marks)

    def pieces(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        return _CUT.split(text) if any(p.search(text) for p in _NO_CUTS) else text.split(" ")

    def encode(self, texts: list[str], size: np.ndarray, joined: bool) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Of each tokenizer: ids of all texts, each behind a space, and how many each text has.

        Texts that begin and end as a cut does (``joined``) go through as one, and are told apart by their bytes; ``size`` has those of each.
        """
        a = b = None
        if joined:
            text = " ".join(texts)
            a, b = self._told_apart(self._a([" " + text])[0].ids, self.a_sizes, size), self._told_apart(self.b.encode(text), self.b_sizes, size)
        if a is None:
            a = _flat([x.ids for x in self._a([" " + t for t in texts])])
        return a, b or _flat(self.b.encode(texts, num_threads=1))

    @staticmethod
    def _told_apart(ids: list[int], sizes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and how many each text has, or nothing where no token ends with a text."""
        flat, to = np.array(ids, np.int64), np.cumsum(size)
        ends = np.cumsum(sizes[flat])
        last = np.searchsorted(ends, to)
        return (flat, np.diff(last, prepend=-1)) if len(ends) and ends[-1] == to[-1] and (ends[last] == to).all() else None

    def _a(self, texts: list[str]):
        # places in the text are not needed
        return getattr(self.a, "encode_batch_fast", self.a.encode_batch)(texts, add_special_tokens=False)

    def aligned(self, texts: list[str]) -> dict[str, tuple]:
        """The figures of different texts (``align_texts``), most of them remembered from earlier blocks."""
        if self.held > REMEMBERED:
            self.met, self.before, self.held = {}, self.met, 0
        met, before = self.met, self.before
        out = {t: met[t] for t in texts if t in met}
        missing = [t for t in texts if t not in out] if len(out) < len(texts) else []
        again = [t for t in missing if t in before]
        if again:
            found = [before[t] for t in again]
            out.update(zip(again, found, strict=True))
            self._remember(again, found)
            missing = [t for t in missing if t not in out]
        plain = [t for t in missing if t.isalnum() or _EDGES.match(t)] if self.cuts else []
        others = list(set(missing).difference(plain))
        for some, joined in ((plain, True), (others, False)):
            until, at = np.cumsum(np.fromiter(map(len, some), np.int64, len(some))), 0
            while at < len(some):
                end = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + _AT_ONCE)))
                found = align_texts(self, some[at:end], joined)
                out.update(zip(some[at:end], found, strict=True))
                self._remember(some[at:end], found)
                at = end
        return out

    def forget(self) -> None:
        """What pieces are made of is kept for a task: a worker that waits holds its tokenizers and no more."""
        self.met, self.before, self.held = {}, {}, 0

    def _remember(self, texts: list[str], found: list[tuple]) -> None:
        short = {t: f for t, f in zip(texts, found, strict=True) if len(t) <= LONG}
        self.met.update(short)
        self.held += _ENTRY * len(short) + sum([len(t) + len(f[4]) + len(f[5]) for t, f in short.items()])


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))


def align_texts(pair: Pair, texts: list[str], joined: bool = False) -> list[tuple]:
    """Of each text: whether both tokenizers give back its bytes, n_a, n_b, n_groups, links (A's id above, B's below 32 bits; as bytes), groups as written.

    Texts that do not come back have no tokens.
    """
    together = " " + " ".join(texts)
    raw = together.encode()
    size = np.fromiter(map(len, texts) if together.isascii() else [len(t.encode()) for t in texts], np.int64, len(texts)) + 1
    (a, of_a), (b, of_b) = pair.encode(texts, size, joined)
    flat, lengths, names = (a, b), (of_a, of_b), (pair.a_bytes, pair.b_bytes)
    sums = [np.diff(np.cumsum(sizes[ids])[np.cumsum(n) - 1], prepend=0) if n.all() else 0 for sizes, ids, n in zip((pair.a_sizes, pair.b_sizes), flat, lengths, strict=True)]
    if all((n == size).all() for n in sums) and all(b"".join(map(of.__getitem__, ids.tolist())) == raw for of, ids in zip(names, flat, strict=True)):
        whole = np.ones(len(texts), bool)
    else:
        own = np.split(np.frombuffer(raw, np.uint8), np.cumsum(size)[:-1])
        back = [[b"".join(map(of.__getitem__, x.tolist())) for x in np.split(ids, np.cumsum(n)[:-1])] for of, ids, n in zip(names, flat, lengths, strict=True)]
        whole = np.array([x == y == z.tobytes() for x, y, z in zip(*back, own, strict=True)], bool)
        a, b = (ids[np.repeat(whole, n)] for ids, n in zip(flat, lengths, strict=True))
    n_a, n_b = (np.where(whole, n, 0) for n in lengths)
    # ends of all tokens, all texts behind one another, in bytes
    end_a, end_b = np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b])
    # between two neighbouring ends of either kind lies the overlap of exactly one token of A and one of B
    ends = np.union1d(end_a, end_b)
    at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    text_a = np.repeat(np.arange(len(texts)), n_a)
    n_links = np.bincount(text_a[at_a], minlength=len(texts))
    root = groups_of(at_a, at_b + len(a), len(a) + len(b))
    # tokens of A are the smaller nodes, so a root is the first token of A in its group
    first = root[: len(a)] == np.arange(len(a))
    n_groups = np.bincount(text_a[first], minlength=len(texts))
    number = np.cumsum(first) - 1
    # members in order of group, side and place, each with what follows it: a comma, or | and ; at the ends of sides
    group = np.r_[number[root[: len(a)]], number[root[len(a) :]]]
    side = np.repeat([0, 1], [len(a), len(b)])
    order = np.lexsort((np.arange(len(group)), side, group))
    key = (group * 2 + side)[order]
    last = np.ones(len(key), bool)
    last[:-1] = key[1:] != key[:-1]
    follows = np.where(last, 1 + side[order], 0)
    members = np.r_[a, b][order] * len(_AFTER) + follows
    written = b"".join(pair.written[members].tolist())
    place = np.r_[0, np.cumsum(pair.written_sizes[members])][np.r_[0, np.cumsum(n_a + n_b)]].tolist()
    links = (a[at_a] << _B_BITS | b[at_b]).tobytes()
    to = (8 * np.r_[0, np.cumsum(n_links)]).tolist()
    return [(w, x, y, g, links[to[i] : to[i + 1]], written[place[i] : max(place[i], place[i + 1] - 1)]) for i, (w, x, y, g) in enumerate(zip(whole.tolist(), n_a.tolist(), n_b.tolist(), n_groups.tolist(), strict=True))]


def align_block(pair: Pair, texts: list[str]) -> dict:
    """What a block's row holds of some texts: figures by text, pieces by text, links by piece, and the block's pairs."""
    cut = [pair.pieces(t) if t else [] for t in texts]
    n_pieces = np.fromiter(map(len, cut), np.int64, len(texts))
    names = list(dict.fromkeys(chain.from_iterable(cut)))
    place = dict(zip(names, range(len(names)), strict=True))
    at = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int32, int(n_pieces.sum()))
    # from here on a piece is its place among the names
    del cut, place
    found = list(map(pair.aligned(names).__getitem__, names))
    of_text = np.repeat(np.arange(len(texts)), n_pieces)
    # where a piece does not come back byte for byte, the text as a whole decides, as one more piece
    failed = np.fromiter((not f[0] for f in found), bool, len(found))
    odd = np.unique(of_text[failed[at]])
    odd = odd[n_pieces[odd] > 1]
    if len(odd):
        whole = list({texts[i] for i in odd.tolist()})
        more = dict(zip(whole, range(len(names), len(names) + len(whole)), strict=True))
        found += map(pair.aligned(whole).__getitem__, whole)
        first = np.cumsum(n_pieces) - n_pieces
        at[first[odd]] = [more[texts[i]] for i in odd.tolist()]
        stays = ~np.isin(of_text, odd)
        stays[first[odd]] = True
        at, of_text = at[stays], of_text[stays]
        # pieces that only these texts had are not linked
        used = np.bincount(at, minlength=len(found)) > 0
        found = [f if u else (*f[:4], b"", b"") for f, u in zip(found, used.tolist(), strict=True)]
    columns = list(zip(*found, strict=True)) or [()] * 6
    del found
    whole, n_a, n_b, n_groups = (np.array(c, np.int64) for c in columns[:4])
    links = np.frombuffer(b"".join(columns[4]), np.int64)
    n_links = np.fromiter(map(len, columns[4]), np.int64, len(whole)) // 8
    # what does not come back is now a text's only piece
    lost = whole[at] == 0
    at, of_text = at[~lost], of_text[~lost]
    written, ends = columns[5], np.searchsorted(of_text, np.arange(len(texts) + 1)).tolist()
    shas = [hashlib.sha256(b";".join(map(written.__getitem__, at[s:e].tolist()))).hexdigest() if s < e else "" for s, e in zip(ends[:-1], ends[1:], strict=True)]
    del columns, written
    # every text's different pieces and how often it has each
    key, n = np.unique(of_text * len(whole) + at, return_counts=True)
    of_text, word = np.divmod(key, max(len(whole), 1))
    bounds = np.searchsorted(of_text, np.arange(len(texts) + 1))
    totals = [np.diff(np.r_[0, np.cumsum(of[word] * n)][bounds]) for of in (n_a, n_b, n_groups, n_links)]
    pairs, link = np.unique(links, return_inverse=True)
    often = np.bincount(word, n, len(whole)).astype(np.int64)
    pair_n = np.bincount(link, np.repeat(often, n_links), len(pairs)).astype(np.int64)
    return {"n_a": totals[0], "n_b": totals[1], "n_groups": totals[2], "n_links": totals[3], "sha": shas, "bounds": bounds, "word": word, "times": n, "link_bounds": np.r_[0, np.cumsum(n_links)], "link": link, "pairs": pairs, "pair_n": pair_n}


_BLOCK = {"block": pa.int64(), "doc_id": pa.list_(pa.int64()), **{c: pa.list_(pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}, "sha": pa.list_(pa.string()), **{c: pa.list_(pa.int32()) for c in ("bounds", "word", "times", "link_bounds", "link")}, "pairs": pa.list_(pa.int64()), "pair_n": pa.list_(pa.int64())}
_BLOCK_SQL = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, bounds array<int>, word array<int>, times array<int>, link_bounds array<int>, link array<int>, pairs array<long>, pair_n array<long>"
_loaded: dict[int, Pair] = {}


def _one_list(values, kind: pa.ListType) -> pa.ListArray:
    """A column of one row, a list, without an object for each member."""
    flat = pa.array(values if isinstance(values, list) else values.astype(kind.value_type.to_pandas_dtype(), copy=False), kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _pair(files) -> Pair:
    key = hash(files.value)
    if key not in _loaded:
        _loaded[key] = Pair(*files.value)
    return _loaded[key]


def _blocks(files, block_chars: int):
    def run(batches):
        pair, number = _pair(files), 0
        ids, texts, size = [], [], 0

        def block():
            nonlocal number
            row = align_block(pair, texts) | {"doc_id": ids, "block": TaskContext.get().partitionId() << 32 | number}
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([row[c]], kind) if c == "block" else _one_list(row[c], kind) for c, kind in _BLOCK.items()], names=list(_BLOCK))

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if texts and (size + len(text) > block_chars or len(texts) >= BLOCK_ROWS):
                    yield block()
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text)
        if texts:
            yield block()
        pair.forget()

    return run


def _figures(sent=None):
    """The rows of texts of every block, from the block's row and the counts of its pairs: those ``sent`` (pairs in order, counts, which are best), or its own, each with its place."""

    def counted(pairs: np.ndarray, found) -> tuple[np.ndarray, np.ndarray]:
        if sent is not None:
            every, often, most = sent.value
            at = np.searchsorted(every, pairs)
            return often[at], most[at].astype(np.int64)
        count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        if found.values is not None:
            place = found.values.field("place").to_numpy()
            count[place], best[place] = found.values.field("count").to_numpy(), found.values.field("best").to_numpy(zero_copy_only=False)
        return count, best

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at] for name in batch.schema.names}
                get = {c: row[c].values.to_numpy(zero_copy_only=False) for c in ("bounds", "word", "times", "link_bounds", "link", "pairs")}
                count, best = counted(get["pairs"], row.get("found"))
                sums = []
                for of in (best, count):
                    by_piece = np.diff(np.r_[0, np.cumsum(of[get["link"]])][get["link_bounds"]])
                    sums.append(np.diff(np.r_[0, np.cumsum(by_piece[get["word"]] * get["times"])][get["bounds"]]))
                cols = [row[c].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(s) for s in sums] + [row["sha"].values]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


_FIGURES_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair (A's id above, B's below 32 bits) and count: how many links of the corpus hold it."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "pair_n")).alias("x"))
    return each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.pair_n").alias("count"))


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    ``byte_level`` and ``pieces`` are paths of the two vocabularies on the driver, of bounded size, sent
    to every worker once. Defined cases: a null or empty text, and one that either tokenizer does not give
    back byte for byte behind its space, has zeros and an empty digest; a text of any length is aligned
    whole; names of special tokens inside texts are plain text; equal counts are all best; repeated rows
    and null ids each get a result and count as often as they come; other columns, of any name, are not
    read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with open(byte_level, encoding="utf-8") as a, open(pieces, "rb") as b:
        files = spark.sparkContext.broadcast((a.read(), b.read()))
    blocks = materialize(id_text(docs, id_col, text_col).mapInArrow(_blocks(files, block_chars), _BLOCK_SQL), "aligned-blocks", {"parquet.block.row.count.limit": str(AT_ONCE)})
    counts = materialize(pair_counts(blocks), "pair-counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1).cast("long"))
    # a row for each id of B at most, so its vocabulary bounds what is broadcast
    most = materialize(counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("most")), "best-counts")
    ranked = counts.withColumn("b", b_id).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    if counts.count() <= SENT_PAIRS:
        table = ranked.toArrow()
        order = np.argsort(table["pair"].to_numpy())
        sent = spark.sparkContext.broadcast(tuple(table[c].to_numpy()[order] for c in ("pair", "count", "best")))
        return blocks.drop("block", "pair_n").mapInArrow(_figures(sent), _FIGURES_SQL)
    own = blocks.select("block", F.posexplode("pairs").alias("place", "pair")).join(ranked, "pair")
    # no more rows a block than it has pairs of its own
    found = own.groupBy("block").agg(F.collect_list(F.struct("place", "count", "best")).alias("found"))
    return blocks.drop("pair_n").join(found, "block", "left").mapInArrow(_figures(), _FIGURES_SQL)
