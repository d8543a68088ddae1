"""Toxicity by weak supervision.

1. Voters. Lexicon: words, and word beginnings of four to ten bytes, that Spark finds far oftener in toxic training
   texts. Patterns, the same for every corpus: a second person beside a lexicon word, several
   lexicon words, letters in capitals, runs of marks, drawn-out letters. One voter speaks for
   clean texts: no lexicon word at all. Every voter fires or abstains.
2. Label model: a two-class latent model estimates by EM, from the votes alone, how often each voter fires
   in either class; labels give only the share of toxic texts. Voters that fire together beyond what the class
   explains are correlated; a vote counts by one over the total correlation of its voter with
   those that fired beside it, so ten voters that say the same do not outvote two others.
3. A logistic regression is trained on the model's posteriors, and it scores every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmill.llm import rolling
from listingmill.llm.common import fit_logistic, held_out, id_text, labelled_frame, materialize

#: Bounds of the training sample, of the voters, and the least support of a voter.
PER_CLASS, MOST_BYTES, VOTERS, SUPPORT = 6000, 24 << 20, 96, 4
_BEGINNINGS = (4, 5, 6, 7, 8, 10)
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: Pattern voters, and what each speaks for; the last speaks for clean texts.
PATTERNS = ((b"!person", 1), (b"!several", 1), (b"!capitals", 0), (b"!marks", 0), (b"!drawn", 0), (b"!none", -1))
#: Words of the second person in the languages these corpora are expected in.
_PERSON = frozenset(w.encode() for w in "you your yours youre u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
_MARKS = re.compile(rb"[!?]{3}")
_DRAWN = re.compile(rb"([a-z])\1{3}")
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def features(text: bytes) -> set[bytes]:
    """Words of letters, and beginnings of longer words marked by a leading ``^``."""
    words = set(text.decode("utf-8", "replace").lower().encode().translate(_LETTERS).split())
    out = set(words)
    for n in _BEGINNINGS:
        out.update(b"^" + w[:n] for w in words if len(w) > n)
    return out


def lexicon_sides(n: int) -> np.ndarray:
    """What each voter speaks for: the lexicon for toxic texts, then the patterns."""
    return np.r_[np.ones(n), [side for _, side in PATTERNS]]


@dataclass
class ToxicModel:
    """``lexicon`` and the patterns vote; ``weights`` are those of all voters, of the number of lexicon votes, and the intercept."""

    lexicon: list[bytes]
    weights: list[float] = field(default_factory=list)
    fires: list[tuple[float, float]] = field(default_factory=list)
    correlation: list[list[float]] = field(default_factory=list)

    def __post_init__(self):
        self.words = {v: i for i, v in enumerate(self.lexicon) if not v.startswith(b"^")}
        self.starts = [(n, {v[1:]: i for i, v in enumerate(self.lexicon) if v.startswith(b"^") and len(v) == n + 1}) for n in _BEGINNINGS]
        self.starts = [(n, d) for n, d in self.starts if d]

    @property
    def voters(self) -> list[bytes]:
        return self.lexicon + [p for p, _ in PATTERNS] if self.lexicon else []

    def _lexicon_votes(self, words) -> dict[bytes, list[int]]:
        """The lexicon's voters by the word that makes them fire."""
        out: dict[bytes, list[int]] = {w: [self.words[w]] for w in self.words.keys() & words}
        for n, d in self.starts:
            for w in words:
                if len(w) > n and w[:n] in d:
                    out.setdefault(w, []).append(d[w[:n]])
        return out

    def votes(self, text: bytes) -> list[int]:
        low = text.decode("utf-8", "replace").lower().encode()
        row = low.translate(_LETTERS).split()
        found = self._lexicon_votes(set(row))
        out = sorted({i for v in found.values() for i in v})
        at = len(self.lexicon)
        if not found:
            out.append(at + 5)
        else:
            if any(row[j] in _PERSON for i, w in enumerate(row) if w in found for j in range(max(0, i - 2), min(len(row), i + 3)) if j != i):
                out.append(at)
            if len(found) > 1:
                out.append(at + 1)
        letters = len(text) - len(text.translate(None, _UPPER + _LOWER))
        if letters >= 20 and 3 * (len(text) - len(text.translate(None, _UPPER))) > letters:
            out.append(at + 2)
        if _MARKS.search(text):
            out.append(at + 3)
        if _DRAWN.search(low):
            out.append(at + 4)
        return out

    def row(self, votes: list[int]) -> np.ndarray:
        x = np.zeros(len(self.voters) + 1)
        x[votes] = 1
        x[-1] = np.log1p(sum(v < len(self.lexicon) for v in votes))
        return x

    def score(self, text: bytes) -> float:
        w = self.weights
        if not self.lexicon:
            z = w[-1]
        else:
            votes = self.votes(text)
            z = w[-1] + sum(w[i] for i in votes) + w[-2] * np.log1p(sum(v < len(self.lexicon) for v in votes))
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def label_model(votes: np.ndarray, prior: float, sides: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row of a 0/1 vote matrix; rates each voter fires at (class 0, class 1); correlations.

    ``sides`` says what each voter speaks for (1, -1, or 0 for none known); it decides where EM
    starts and that a voter never counts for the other side. The share of class 1 is ``prior``.
    """
    n, k = votes.shape
    lead = votes @ (sides > 0) - votes @ (sides < 0)
    post = 1 / (1 + np.exp(-np.clip(2 * lead + np.log(prior / (1 - prior)) / 2, -6, 6)))
    corr = np.eye(k)
    rate = np.full((2, k), 0.5)
    for _ in range(rounds):
        on, off = post.sum(), n - post.sum()
        mean = votes.mean(0)
        # one row's worth of the voter's overall rate in each class
        rate = np.vstack([((1 - post) @ votes + mean) / (off + 1), (post @ votes + mean) / (on + 1)])
        rate = np.clip(rate, 1e-6, 1 - 1e-6)
        rest = votes - np.outer(1 - post, rate[0]) - np.outer(post, rate[1])
        cov = rest.T @ rest / n
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        corr = np.abs(cov / np.outer(sd, sd))
        corr[corr < 0.1] = 0
        np.fill_diagonal(corr, 1)
        odds = np.log(rate[1] / rate[0])
        odds = np.where(sides > 0, np.maximum(odds, 0), np.where(sides < 0, np.minimum(odds, 0), odds))
        z = np.log(prior / (1 - prior)) + (votes / np.maximum(votes @ corr, 1.0)) @ odds
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return post, rate, corr


def choose_lexicon(sample: DataFrame, n1: int, n0: int, most: int = VOTERS, support: int = SUPPORT) -> list[bytes]:
    """Words and beginnings far oftener in toxic texts of a sample (text, y), best first.

    The sample is bounded, and so is the answer. Of a word and its beginnings one is taken,
    unless the shorter one fires in half as many toxic texts again.
    """

    def seen(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                keys, ys = [], []
                for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    f = features(t.encode())
                    keys += f
                    ys += [y] * len(f)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ys, pa.int32())], names=["f", "y"])

    n1, n0 = max(1, n1), max(1, n0)
    counts = sample.select("text", "y").mapInArrow(seen, "f binary, y int").groupBy("f").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    odds = F.log((F.col("n1") + 0.5) / n1) - F.log((F.col("n0") + 0.5) / n0)
    gain = F.col("n1") * odds
    best = counts.where((F.col("n1") >= max(support, n1 // 50)) & (odds > 2.5) & (F.col("n0") / n0 < 0.02)).orderBy(F.desc(F.round(gain, 6)), "f").limit(32 * most)
    taken: dict[bytes, int] = {}
    for r in best.collect():
        stem = bytes(r["f"]).lstrip(b"^")
        if len(taken) < most and not any(o.lstrip(b"^") and (stem.startswith(o.lstrip(b"^")) or (o.lstrip(b"^").startswith(stem) and r["n1"] < 1.5 * m)) for o, m in taken.items()):
            taken[bytes(r["f"])] = r["n1"]
    return list(taken)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> ToxicModel:
    """Fit on a bounded sample of the labelled rows outside the held-out fifth.

    Labels choose the lexicon and tell the share of toxic texts in the sample; the label model and the regression see
    votes and no row's label. The intercept is then moved to the share among all training labels. Without
    labels of one class the model has no voters and scores every text by the share of the other.
    """
    frame, counts = labelled_frame(docs, labels, label_col, per_class, most_bytes, id_col, text_col)
    frame = materialize(frame, "sample")
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    share = (n1 + 0.5) / (n1 + n0 + 1)
    sizes = {r["y"]: r["count"] for r in frame.groupBy("y").count().collect()}
    model = ToxicModel(choose_lexicon(frame, sizes.get(1, 0), sizes.get(0, 0)) if n1 and n0 else [])
    if not model.lexicon:
        model.weights = [0.0, float(np.log(share / (1 - share)))]
        return model
    lexicon = model.lexicon

    def vote(batches):
        own = ToxicModel(lexicon)
        for batch in batches:
            found = [own.votes(t.encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "votes"])

    # the votes of a bounded sample come to the driver, not its texts
    found = [r["votes"] for r in frame.select("doc_id", "text").mapInArrow(vote, "doc_id long, votes array<int>").orderBy("doc_id").collect()]
    votes = np.zeros((len(found), len(model.voters)))
    for i, v in enumerate(found):
        votes[i, v] = 1
    in_sample = (sizes.get(1, 0) + 0.5) / (len(found) + 1)
    post, rate, corr = label_model(votes, in_sample, lexicon_sides(len(lexicon)))
    model.fires, model.correlation = [tuple(map(float, r)) for r in rate.T], corr.tolist()
    x = np.vstack([model.row(v) for v in found])
    model.weights = [float(v) for v in fit_logistic(x, post, ridge=2e-5)]
    model.weights[-1] += float(np.log(share / (1 - share)) - np.log(in_sample / (1 - in_sample)))
    return model


def _scores(model: ToxicModel):
    def run(batches):
        for batch in batches:
            buf, bounds = rolling.text_buffer(batch.column(1))
            x = np.fromiter((model.score(buf[s:e].tobytes()) for s, e in zip(bounds[:-1], bounds[1:], strict=True)), float, len(bounds) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: more toxic), predicted (1 if score >= threshold) of every row.

    Defined cases: a null or empty text has no vote and the score of that; a null id is not
    held out; repeated rows each get a result; other columns, of any name, are not read; an
    empty table gives an empty result.
    """
    out = id_text(docs, id_col, text_col).mapInArrow(_scores(model), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
