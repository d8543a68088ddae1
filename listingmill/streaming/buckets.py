"""A keyed Parquet table that micro-batches upsert into: buckets that split as they grow, deltas beside base files, compaction.

Under the table's folder, all by the number of the batch that wrote them:

* ``deltas/batch_no=N``: the batch's own rows, one a key, with their bucket
* ``bases/batch_no=N/depth=D/prefix=P``: all rows of the buckets that batch N compacted
* ``buckets/batch_no=N``: the buckets in force after batch N. It is written last, so a batch that failed half way is not seen, and one that is
  tried again starts from the same buckets and writes the same folders.

A bucket is the keys whose hash begins with ``prefix`` in ``depth`` bits, so splitting one touches no other.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BITS = 20
BUCKETS = "depth int, prefix int, base_no int, base_rows long, delta_rows long"
_AT = ["depth", "prefix"]


def _slot(key: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - BITS).cast("int")


def _prefix(slot: Column, depth: Column) -> Column:
    return F.floor(slot / F.pow(F.lit(2), BITS - depth)).cast("int")


def _placed(schema: StructType, *more: str) -> StructType:
    return StructType([*schema.fields, *[StructField(c, IntegerType()) for c in (*more, *_AT)]])


def buckets(spark: SparkSession, table: str, before: int | None = None) -> tuple[int, DataFrame] | None:
    """The number and the buckets of the newest batch (before a number) that was finished; None if there is none."""
    try:
        every = spark.read.schema(BUCKETS + ", batch_no int").parquet(f"{table}/buckets")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # before the first batch
    every = every if before is None else every.where(F.col("batch_no") < before)
    newest = every.agg(F.max("batch_no")).first()[0]
    return None if newest is None else (newest, every.where(F.col("batch_no") == newest).drop("batch_no"))


def _latest(rows: DataFrame, key: str, order: list[str], names: list[str], within: list[str]) -> DataFrame:
    """The last row of each key; of rows that tie, one of the newest batch."""
    by = F.struct(*order, *(["batch_no"] if "batch_no" in rows.columns else []))
    return rows.groupBy(*within, key).agg(F.max_by(F.struct(*names), by).alias("r")).select("r.*", *within)


def _rows(spark: SparkSession, table: str, schema: StructType, some: DataFrame, upto: int) -> DataFrame:
    """All versions of the rows of some buckets: base rows, and deltas that came after the base."""
    want = some.select(*_AT, "base_no")
    lowest = want.agg(F.min("base_no")).first()[0]
    deltas = spark.read.schema(_placed(schema).add("batch_no", IntegerType())).parquet(f"{table}/deltas").where((F.col("batch_no") > lowest) & (F.col("batch_no") <= upto))
    deltas = deltas.join(want, _AT).where("batch_no > base_no").select(*schema.names, "batch_no", *_AT)
    return _bases(spark, table, schema, want).unionByName(deltas) if want.where("base_no >= 0").limit(1).count() else deltas


def _bases(spark: SparkSession, table: str, schema: StructType, want: DataFrame) -> DataFrame:
    base = spark.read.schema(_placed(schema, "batch_no")).parquet(f"{table}/bases")
    return base.join(want.where("base_no >= 0").withColumnRenamed("base_no", "batch_no"), [*_AT, "batch_no"], "left_semi").select(*schema.names, "batch_no", *_AT)


def upsert(df: DataFrame, number: int, table: str, key: str, order: list[str], most_rows: int, share: float) -> None:
    """Put a batch's rows into the table.

    What is written is the batch's own rows, and those of buckets whose deltas have reached ``share`` of their base: each is merged, and split into
    as many as hold ``most_rows`` rows or fewer. So a row is rewritten once for every ``share`` of its bucket that arrives, however large the table is.
    """
    spark, schema = df.sparkSession, df.schema
    found = buckets(spark, table, number)
    known = found[1] if found else spark.createDataFrame([(0, 0, -1, 0, 0)], BUCKETS)
    if number == 0 or found is None:
        spark.createDataFrame([(key, order)], "key string, order array<string>").coalesce(1).write.mode("overwrite").parquet(f"{table}/meta")
    depths = sorted(r[0] for r in known.select("depth").distinct().collect())  # at most BITS + 1 numbers
    rows = _latest(df, key, order, schema.names, []).withColumn("_slot", _slot(key)).withColumn("depth", F.explode(F.array(*[F.lit(x) for x in depths])))
    rows = rows.withColumn("prefix", _prefix(F.col("_slot"), F.col("depth"))).join(known.select(*_AT), _AT, "left_semi")
    rows.select(*schema.names, *_AT).write.mode("overwrite").parquet(f"{table}/deltas/batch_no={number}")

    new = spark.read.schema(_placed(schema)).parquet(f"{table}/deltas/batch_no={number}").groupBy(*_AT).agg(F.count("*").alias("_new"))
    state = known.join(new, _AT, "left").select(*_AT, "base_no", "base_rows", (F.col("delta_rows") + F.coalesce("_new", F.lit(0))).alias("delta_rows"))
    is_due = (F.col("delta_rows") > 0) & (F.col("delta_rows") >= F.col("base_rows") * share)
    due = state.where(is_due)
    after = state
    if due.limit(1).count():
        versions = _rows(spark, table, schema, due, number)
        sizes = versions.groupBy(*_AT).agg(F.count_distinct(F.xxhash64(key)).alias("n"))
        more = F.least(F.greatest(F.ceil(F.log2(F.col("n") / most_rows)), F.lit(0)), BITS - F.col("depth")).cast("int")
        cut = sizes.select(*_AT, more.alias("more"))
        merged = _latest(versions, key, order, schema.names, _AT).join(cut, _AT).withColumn("depth", F.col("depth") + F.col("more"))
        merged = merged.withColumn("prefix", _prefix(_slot(key), F.col("depth"))).select(*schema.names, *_AT)
        merged.repartition(*_AT).write.mode("overwrite").partitionBy(*_AT).parquet(f"{table}/bases/batch_no={number}")
        held = spark.read.schema(_placed(schema)).parquet(f"{table}/bases/batch_no={number}").groupBy(*_AT).agg(F.count("*").alias("base_rows"))
        # all parts of a bucket that was split, those without rows too
        parts = cut.withColumn("i", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2), F.col("more")) - 1).cast("int"))))
        parts = parts.select((F.col("depth") + F.col("more")).alias("depth"), (F.col("prefix") * F.pow(F.lit(2), F.col("more")) + F.col("i")).cast("int").alias("prefix"))
        parts = parts.join(held, _AT, "left").select(*_AT, F.lit(number).alias("base_no"), F.coalesce("base_rows", F.lit(0)).alias("base_rows"), F.lit(0).cast("long").alias("delta_rows"))
        after = state.where(~is_due).unionByName(parts)
    after.write.mode("overwrite").parquet(f"{table}/buckets/batch_no={number}")


def current(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """The rows of the table, each key's last. Base files without deltas are read as they are; only buckets with deltas are merged."""
    number, at = buckets(spark, table)
    meta = spark.read.parquet(f"{table}/meta").first()
    clean, dirty = at.where("delta_rows = 0"), at.where("delta_rows > 0")
    parts = []
    if clean.where("base_no >= 0").limit(1).count():
        parts.append(_bases(spark, table, schema, clean.select(*_AT, "base_no")).select(*schema.names))
    if dirty.limit(1).count():
        parts.append(_latest(_rows(spark, table, schema, dirty, number), meta["key"], meta["order"], schema.names, _AT).select(*schema.names))
    if not parts:
        return spark.createDataFrame([], schema)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
