"""Shared pieces: the shared folder, checked broadcasts, held-out split, text access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when counted to have at most this many (narrow) rows.
BROADCAST_ROWS = 200_000

#: A text of more bytes than this gives a training sample only this many pieces, evenly spaced, of this many characters.
LONGEST, PIECES, PIECE = 256 << 10, 16, 4000

#: White space that separates words in every operator here: space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode (tests) a folder of our own is made where that setting is absent; on a
    cluster that is an error, since its machines share no local folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet (with ``options`` of its writer) in the shared folder and read it back.

    It cuts the lineage, survives the loss of executors, and lets several later
    steps use the rows without computing them again.
    """
    path = new_path(df.sparkSession, label)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(table: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Hint a materialized, narrow table for broadcast if it is small; else leave it to a shuffle join."""
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    return F.broadcast(table) if table.count() <= max_rows else table


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, how: str, max_rows: int | None = None) -> DataFrame:
    """Join narrow rows with a materialized table of their groups, each key once, of which ``size`` counts the rows.

    ``how`` is left, left_semi or left_anti. Few groups are broadcast. Of many, the large ones are: over a limit
    of (all rows / ``max_rows``) rows there can be at most ``max_rows`` of them. The others are shuffled, and none of
    their keys holds more rows than that limit.
    """
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    if groups.count() <= max_rows:
        return rows.join(F.broadcast(groups), on, how)
    limit = (groups.agg(F.sum(size)).first()[0] or 0) // max(1, max_rows)
    large, small = groups.where(F.col(size) > limit), groups.where(F.col(size) <= limit)
    if how == "left_anti":
        return rows.join(F.broadcast(large), on, how).join(small, on, how)
    of_large = rows.join(F.broadcast(large), on, "left_semi" if how == "left_semi" else "inner")
    return of_large.unionByName(rows.join(F.broadcast(large), on, "left_anti").join(small, on, how))


def with_row_key(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with a column that tells all rows apart, and that column's name.

    Where every id is there once, it is the id; else the table is written once more with its rows numbered.
    """
    name = "_row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    odd = docs.groupBy(docs[id_col].alias("_id")).count().where("_id IS NULL OR count > 1").limit(1).count()
    if odd:
        return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name
    return docs.withColumn(name, docs[id_col].cast("long")), name


def drop_rows(docs: DataFrame, row_col: str, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in the one column of ``gone``, and without the key.

    A counted short list of keys is broadcast. A longer one meets the rows in one shuffle on
    the key, of which every value is there once.
    """
    side = checked_broadcast(materialize(gone.toDF("_gone"), "gone"))
    return docs.join(side, docs[row_col] == side["_gone"], "left_anti").drop(row_col)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the ids that no model may learn labels from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names, whatever else the table holds."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def _pieces(text: Column) -> Column:
    n = F.length(text)
    return F.concat_ws(" ", *[F.substring(text, F.floor((n - PIECE) * i / (PIECES - 1)).cast("int") + 1, F.lit(PIECE)) for i in range(PIECES)])


def labelled_frame(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, most_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """A bounded, written training sample (doc_id, text, y) and how many training labels each class has.

    Only ids outside the held-out fifth are used. Of each class at most ``per_class`` rows come
    in the order of a hash of their ids, and of those, in that order, each text that still fits in ``most_bytes`` bytes
    together. The result is at most two times these bounds, whatever the input holds. A text of
    up to ``LONGEST`` bytes comes whole; a longer one gives ``PIECES`` pieces (not more bytes than
    that), so no text can take the place of all others. An id whose labels disagree is left out;
    of documents that share an id the one whose text has the smallest hash counts. Labels that belong to
    no document are neither picked nor counted. A class that has labelled documents and ends without a sample is an error.
    """
    known = labels.where(labels[label_col].isin(0, 1) & labels[id_col].isNotNull() & ~held_out(id_col))
    known = known.select(labels[id_col].cast("long").alias("_id"), labels[label_col].cast("int").alias("_y"))
    known = materialize(known.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_most")).where("_y = _most").select("_id", "_y"), "labels")
    # ids alone are read here, and labels may reach far beyond these documents
    ids = docs.select(docs[id_col].cast("long").alias("_doc"))
    known = materialize(ids.join(checked_broadcast(known), F.col("_doc") == F.col("_id")).select("_id", "_y").distinct(), "known")
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    order = [F.xxhash64(F.col("_id"), F.lit(7)), F.col("_id")]
    picked = known.where("_y = 0").orderBy(*order).limit(per_class).unionByName(known.where("_y = 1").orderBy(*order).limit(per_class))
    # at most 2 * per_class rows of two numbers: a bound on what is broadcast
    own = id_text(docs, id_col, text_col)
    rows = own.join(F.broadcast(materialize(picked, "picked")), own["doc_id"] == F.col("_id"))
    rows = rows.select("doc_id", F.col("_y").alias("y"), F.xxhash64("text").alias("h"), F.when(F.octet_length("text") <= LONGEST, F.col("text")).otherwise(_pieces(F.col("text"))).alias("text"))
    rows = materialize(rows.groupBy("doc_id", "y").agg(F.min_by("text", "h").alias("text")), "picked-texts")
    # the ids and sizes of the rows picked, three numbers each, decide which fit
    fits, filled, room = [], set(), {0: most_bytes, 1: most_bytes}
    for r in rows.select("doc_id", "y", F.octet_length("text").alias("n")).orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").collect():
        if r["n"] <= room[r["y"]]:
            room[r["y"]] -= r["n"]
            filled.add(r["y"])
            fits.append((r["doc_id"],))
    if counts.keys() - filled:
        raise ValueError(f"{label_col}: no text of class {sorted(counts.keys() - filled)} fits in a sample of {per_class} rows and {most_bytes} bytes")
    kept = docs.sparkSession.createDataFrame(fits, "_id long")
    return rows.join(F.broadcast(kept), rows["doc_id"] == kept["_id"], "left_semi").select("doc_id", "text", "y"), counts


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, most_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[int, str, int]], dict[int, int]]:
    """The rows of ``labelled_frame`` on the driver, in the order of their ids, and the counts."""
    frame, counts = labelled_frame(docs, labels, label_col, per_class, most_bytes, id_col, text_col)
    return sorted(tuple(r) for r in frame.collect()), counts


def fit_logistic(x, y, weight=None, ridge: float = 1e-3, rounds: int = 50):
    """Weights (last: intercept) of a logistic regression on soft labels, by damped Newton steps."""
    import numpy as np

    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x.shape[1])
    pull = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6] * max(1.0, float(weight.sum()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + pull * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w -= step / max(1.0, float(np.abs(step).max()) / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w
