"""Quality by compression: how much better a dictionary of good text compresses a text than one of bad text.

Two Zstandard dictionaries are built from labelled texts. A text is compressed with each, in
independent chunks so that a long text cannot adapt away from the dictionary. The difference
of the compressed sizes, divided by their sum, and the ratio of compressed to full size are
calibrated by a quadratic logistic curve into the probability that the text is good (the
ratio tells runs of one word, which any dictionary compresses alike, from prose).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmill.llm import rolling
from listingmill.llm.common import fit_logistic, held_out, id_text, labelled_sample

#: Bounds of the training sample: rows of each class, and bytes of their texts.
PER_CLASS, MOST_BYTES = 3000, 16 << 20
DICT_BYTES, CHUNK, LEVEL = 112_640, 1024, 3


class CompressionModel:
    """Two dictionaries and the calibration; small (two dictionaries), so it ships to tasks by value."""

    def __init__(self, good: bytes, bad: bytes, curve: tuple[float, ...] = (0.0,) * 6):
        self.good, self.bad, self.curve = good, bad, curve
        self._tools = None

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "curve": self.curve, "_tools": None}

    def _compressors(self):
        if self._tools is None:
            import zstandard as z

            frame = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
            self._tools = []
            for data in (self.good, self.bad):
                d = z.ZstdCompressionDict(data) if data else None
                if d is not None:
                    d.precompute_compress(compression_params=frame)
                self._tools.append(z.ZstdCompressor(compression_params=frame, dict_data=d).compress)
        return self._tools

    def sizes(self, text: bytes) -> tuple[float, float]:
        """Normalised compressed-size difference (over zero if the good dictionary fits better), and mean ratio."""
        good, bad = self._compressors()
        a = b = 0
        for at in range(0, len(text), CHUNK):
            part = text[at : at + CHUNK]
            a += len(good(part))
            b += len(bad(part))
        return ((b - a) / (a + b), (a + b) / 2 / len(text)) if text else (0.0, 0.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(expand(x) @ np.array(self.curve), -30, 30)))


def expand(x: np.ndarray) -> np.ndarray:
    """Quadratic terms of (difference, ratio), scaled to like sizes, and a constant."""
    d, r = np.clip(10 * x[:, 0], -10, 10), np.clip(x[:, 1], 0, 3)
    return np.column_stack([d, r, d * d, r * r, d * r, np.ones(len(x))])


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself serves as one."""
    import zstandard as z

    parts = [t[i : i + CHUNK] for t in texts for i in range(0, len(t), CHUNK)]
    try:
        return z.train_dictionary(DICT_BYTES, parts).as_bytes()
    except z.ZstdError:
        return b"".join(parts)[-DICT_BYTES:]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> CompressionModel:
    """Fit on a bounded sample of the labelled rows outside the held-out fifth.

    Two thirds of the sample build the dictionaries and a third sets the curve, weighted to
    the share of each class among all training labels. Without labelled documents of both classes
    nothing can be told apart, and every score is one half.
    """
    rows, counts = labelled_sample(docs, labels, label_col, per_class, most_bytes, id_col, text_col)
    by = {y: [t.encode() for _, t, label in rows if label == y] for y in (0, 1)}
    if not by[0] or not by[1]:
        return CompressionModel(b"", b"")
    build = {y: [t for i, t in enumerate(v) if i % 3] or v for y, v in by.items()}
    curve = {y: v[::3] for y, v in by.items()}
    model = CompressionModel(_dictionary(build[1]), _dictionary(build[0]))
    x = np.array([model.sizes(t) for y in (0, 1) for t in curve[y]])
    y = np.repeat([0.0, 1.0], [len(curve[0]), len(curve[1])])
    total = counts[0] + counts[1]
    weight = np.where(y > 0, counts[1] / total / len(curve[1]), counts[0] / total / len(curve[0])) * len(y)
    model.curve = tuple(float(v) for v in fit_logistic(expand(x)[:, :-1], y, weight, ridge=1e-6))
    return model


def _probabilities(model: CompressionModel, texts) -> pa.Array:
    buf, bounds = rolling.text_buffer(texts)
    x = np.array([model.sizes(buf[s:e].tobytes()) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]).reshape(-1, 2)
    return pa.array(model.score(x))


def _scores(model: CompressionModel):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _probabilities(model, batch.column(1))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better), predicted (1 if score >= threshold) of every row.

    Defined cases: a null or empty text counts as one that neither dictionary fits better, halved by either; a null
    id is not held out; repeated rows each get a result; other columns, of any name, are not
    read; an empty table gives an empty result.
    """
    out = id_text(docs, id_col, text_col).mapInArrow(_scores(model), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: CompressionModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``threshold``: one pass, without a join."""
    probability = F.arrow_udf(lambda texts: _probabilities(model, texts), "double")
    return docs.where(probability(F.coalesce(docs[text_col], F.lit(""))) >= threshold)
