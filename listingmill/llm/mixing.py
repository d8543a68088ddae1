"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by source, language and topic. Only values with a target are told apart, so
the table has at most (sources + 1) x (languages + 1) x (topics + 1) cells, whatever the corpus
holds: that product of parameter sizes bounds what the driver fits. Raking scales the cells
until all three marginals hold. A document stays with a probability in proportion to its
cell's raked over its observed tokens, decided by a hash of its id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingmill.llm.common import WORD, materialize

OTHER = "*"


@dataclass(frozen=True)
class Targets:
    """Shares of tokens by value; a marginal's shares are scaled to what its other values leave.

    Values without a target, and nulls, count as one further value that keeps its own share.
    """

    source: tuple[tuple[str, float], ...]
    lang: tuple[tuple[str, float], ...]
    topic: tuple[tuple[str, float], ...]

    def of(self, kind: str) -> dict[str, float]:
        return dict(getattr(self, kind))


#: Twenty sources alike, English at half, and mostly running prose.
DEFAULT = Targets(
    source=tuple((f"src{i}", 0.05) for i in range(20)),
    lang=(("en", 0.5), ("de", 0.2), ("fr", 0.2), ("es", 0.1)),
    topic=(("prose", 0.9), ("table", 0.05), ("symbols", 0.025), ("shouting", 0.025)),
)


def topic_of(text: Column) -> Column:
    """A rule of form that stands in for a topic model: tables, symbols, shouting, or prose.

    Share of characters: bars over 1 in 50, marks (``#$%&*``) over 1 in 20, exclamation marks
    over 1 in 50. Characters are counted by removing them, which is a plain byte search.
    """
    n = F.length(text)
    count = lambda c: n - F.length(F.replace(text, F.lit(c), F.lit("")))
    marks = sum((count(c) for c in "#$%&*"), F.lit(0))
    return F.when(count("|") * 50 > n, "table").when(marks * 20 > n, "symbols").when(count("!") * 50 > n, "shouting").otherwise("prose")


def rake(cells: np.ndarray, shares: list[np.ndarray], rounds: int = 200, close: float = 1e-10) -> np.ndarray:
    """Scale a table of weights until each marginal has these shares of the total, as far as its zeros allow."""
    out = cells.astype(float)
    total = out.sum()
    for _ in range(rounds):
        far = 0.0
        for axis, share in enumerate(shares):
            others = tuple(i for i in range(out.ndim) if i != axis)
            have = out.sum(others)
            factor = np.divide(share * total, have, out=np.ones_like(have), where=have > 0)
            far = max(far, float(np.abs(factor - 1)[have > 0].max(initial=0)))
            out *= factor.reshape([-1 if i == axis else 1 for i in range(out.ndim)])
        if far < close:
            break
    return out


def _shares(cells: np.ndarray, axis: int, targets: list[float]) -> np.ndarray:
    """Target shares along an axis whose last place is for other values; empty places share out to the rest."""
    have = cells.sum(tuple(i for i in range(cells.ndim) if i != axis))
    other = have[-1] / have.sum() if have.sum() else 0.0
    want = np.r_[np.where(have[:-1] > 0, targets, 0.0), 0.0]
    want *= (1 - other) / want.sum() if want.sum() else 0.0
    want[-1] = other if want.sum() else 1.0
    return want


def rake_within(cells: np.ndarray, weight: np.ndarray, wanted: list[np.ndarray], rounds: int = 200, close: float = 1e-7) -> tuple[np.ndarray, bool]:
    """Weights of at most 1, ``weight`` scaled along each axis and cut there, at which the kept mass has these marginals.

    Also whether it has them: under that bound they may be out of reach. ``wanted`` are masses by axis.
    """
    w = weight.copy()
    total = max(wanted[0].sum(), 1e-300)
    for _ in range(rounds):
        for axis, want in enumerate(wanted):
            t, v = (np.moveaxis(x, axis, 0).reshape(len(want), -1) for x in (cells, w))
            low, high = np.full(len(want), -5.0), np.full(len(want), 5.0)
            for _ in range(40):
                middle = (low + high) / 2
                less = (t * np.minimum(1, v * np.exp(middle)[:, None])).sum(1) < want
                low, high = np.where(less, middle, low), np.where(less, high, middle)
            by = np.exp((low + high) / 2)
            w = np.clip(w * by.reshape([-1 if i == axis else 1 for i in range(w.ndim)]), 1e-100, 1e100)
        kept = cells * np.minimum(1, w)
        far = max(np.abs(kept.sum(tuple(i for i in range(w.ndim) if i != a)) - want).max() for a, want in enumerate(wanted))
        if far < close * total:
            return np.minimum(1, w), True
    return np.minimum(1, w), False


def _capped(want: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Masses wanted, none over what there is; the others share out the rest in proportion."""
    total, out = want.sum(), want
    for _ in range(len(want)):
        full = out >= have
        rest = want[~full].sum()
        out = np.where(full, have, want * ((total - have[full].sum()) / rest if rest > 0 else 0.0))
        if (out <= have).all():
            break
    return np.minimum(out, have)


def _within(table: np.ndarray, weight: np.ndarray, keep_share: float | None) -> tuple[np.ndarray, float]:
    """Weights, and the factor that makes them probabilities: see ``mix_sources``."""
    some = table > 0
    if not some.any():
        return weight, 1.0
    if keep_share is None:
        return weight, 1 / weight[some].max()
    sums = lambda x, axis: x.sum(tuple(i for i in range(x.ndim) if i != axis))
    wanted = [_capped(sums(table * weight, axis) * keep_share, sums(table, axis)) for axis in range(table.ndim)]
    kept, met = rake_within(table, np.where(some, weight, 0.0) * keep_share, wanted)
    if met and keep_share > 0:
        return np.where(some, kept / keep_share, 1.0), keep_share
    low, high, factor = 0.0, 1 / max(weight[some & (weight > 0)].min(), 1e-300), 0.0
    for _ in range(200):
        factor = (low + high) / 2
        low, high = (factor, high) if (table * np.minimum(1, weight * factor)).sum() < keep_share * table.sum() else (low, factor)
    return weight, factor


@dataclass(frozen=True)
class Mix:
    """Fitted weights by cell, and the expression that finds a row's cell."""

    cell: Column
    n_tokens: Column
    weights: tuple[float, ...]
    factor: float
    seed: int

    def weight(self, cell: Column) -> Column:
        return F.get(F.array(*[F.lit(x) for x in self.weights]), cell)

    def probability(self, cell: Column) -> Column:
        return F.least(F.lit(1.0), self.weight(cell) * self.factor)

    def draw(self, doc_id: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(doc_id.cast("long").cast("string"), F.lit(self.seed)), 11).cast("double") / float(1 << 53)


def _fit(docs: DataFrame, targets: Targets, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None, seed: int, keep_share: float | None) -> tuple[Mix, DataFrame]:
    """The fitted mix, and (doc_id, cell, n_tokens) of every row, written."""
    text = F.coalesce(docs[text_col], F.lit(""))
    kinds = {"source": docs[source_col], "lang": docs[lang_col], "topic": topic if topic is not None else topic_of(text)}
    values = {k: [*targets.of(k), OTHER] for k in kinds}
    place = lambda k, c: F.coalesce(*[F.when(c == v, F.lit(i)) for i, v in enumerate(values[k][:-1])], F.lit(len(values[k]) - 1))
    strides = np.cumprod([1, *(len(values[k]) for k in list(kinds)[::-1][:-1])])[::-1]
    cell = sum((place(k, c) * int(s) for (k, c), s in zip(kinds.items(), strides, strict=True)), F.lit(0)).cast("int")
    n_tokens = F.regexp_count(text, F.lit(WORD)).cast("long")
    own = materialize(docs.select(docs[id_col].cast("long").alias("doc_id"), cell.alias("cell"), n_tokens.alias("n_tokens")), "cells")  # three numbers a row

    shape = [len(values[k]) for k in kinds]
    table = np.zeros(int(np.prod(shape)))
    for r in own.groupBy("cell").agg(F.sum("n_tokens").alias("n")).collect():  # at most as many rows as the table has cells
        table[r["cell"]] = r["n"]
    table = table.reshape(shape)
    if table.sum():
        raked = rake(table, [_shares(table, i, [targets.of(k)[v] for v in values[k][:-1]]) for i, k in enumerate(kinds)])
        weight = np.divide(raked, table, out=np.ones_like(raked), where=table > 0).ravel()
    else:
        weight = np.ones(table.size)
    weight, factor = _within(table, weight.reshape(shape), keep_share)
    return Mix(cell, n_tokens, tuple(float(x) for x in weight.ravel()), float(factor), seed), own


def mix_sources(docs: DataFrame, targets: Targets = DEFAULT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, seed: int = 17, keep_share: float | None = 0.5) -> DataFrame:
    """doc_id, n_tokens, weight (raked over observed tokens of its cell), probability, draw, sampled of every row.

    ``probability`` is ``weight`` times a factor, at most 1. ``keep_share`` sets the expected share
    of all tokens kept. Weights are raked under the bound of 1, so the kept tokens meet all
    targets where that share allows it. A value with fewer tokens than its target is kept whole and
    the other values share out the rest; where even that has no solution, weights are cut to a probability of 1 and fall
    short. With None the factor makes the largest weight just certain to stay, which keeps all
    targets exact in expectation but may keep little.
    ``draw`` is a number in [0, 1) from a hash of the id; a row is sampled if it is less than
    the probability. Tokens are words between white space.

    Defined cases: a null text has no tokens and topic prose; its row is drawn like others of
    its cell (with weight 1 where the cell has no tokens); null source or language counts as a
    value without target; rows that share an id are drawn alike; a null id is drawn as such;
    other columns, of any name, are not read; an empty table gives an empty result.
    """
    mix, own = _fit(docs, targets, id_col, text_col, source_col, lang_col, topic, seed, keep_share)
    out = own.select("doc_id", "n_tokens", mix.weight(F.col("cell")).alias("weight"), mix.probability(F.col("cell")).alias("probability"), mix.draw(F.col("doc_id")).alias("draw"))
    return out.withColumn("sampled", F.coalesce(F.col("draw") < F.col("probability"), F.lit(False)))


def sampled(docs: DataFrame, targets: Targets = DEFAULT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, seed: int = 17, keep_share: float | None = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``mix_sources`` marks as sampled: a filter, without a join."""
    mix, _ = _fit(docs, targets, id_col, text_col, source_col, lang_col, topic, seed, keep_share)
    return docs.where(mix.draw(docs[id_col]) < mix.probability(mix.cell))
