"""Writers: snapshot documents, CSV exports, the catalog's summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CSV_COLUMNS = ("title", "source", "sub_source", "nickname", "city", "state", "county", "business_model_type", "revenue", "ebitda", "sde", "asking", "earnings_basis", "sources", "url", "needs_llm", "times_seen")


def snapshot_rows(view: DataFrame) -> DataFrame:
    """Deals under the snapshot's names; old and blank model labels are null."""
    model = F.when(~F.trim(F.coalesce("business_model_type", F.lit(""))).isin("", "AMBIGUOUS", "LOCATION_AGNOSTIC"), F.col("business_model_type"))
    return view.withColumn("business_model_type", model).withColumnsRenamed({"ext_id": "extId", "sub_source": "subSource", "business_model_type": "businessModelType", "needs_llm": "needsLlm", "last_seen": "lastSeen", "times_seen": "timesSeen"})


def write_snapshot(view: DataFrame, verdicts: DataFrame, path: str) -> None:
    """Deals and verdicts as JSON lines in two folders: a document for all of them would pass through one task."""
    snapshot_rows(view).write.mode("overwrite").json(f"{path}/deals")
    verdicts.write.mode("overwrite").json(f"{path}/verdicts")


def write_csv(view: DataFrame, path: str) -> None:
    """The export's columns, ordered by earnings (range-partitioned files, each with a header)."""
    cols = [F.to_json("needs_llm").alias("needs_llm") if c == "needs_llm" else F.col(c) for c in CSV_COLUMNS if c in view.columns]
    view.orderBy(F.desc_nulls_last("earnings"), "id").select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_survey(matched: DataFrame, path: str) -> None:
    """Matched messages as JSON lines and as CSV, without their bodies."""
    slim = matched.drop("body")
    slim.write.mode("overwrite").json(f"{path}/json")
    slim.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def catalog_maps(formats: DataFrame) -> DataFrame:
    """One row with by_email (address to format) and by_domain (domain to its formats) of the catalog (id, source, sub_source), which is configuration."""
    address = F.when(F.contains("sub_source", F.lit("@")) & ~F.startswith("sub_source", F.lit("*")), F.lower("sub_source"))
    by_email = formats.withColumn("_a", address).where("_a IS NOT NULL").groupBy("_a").agg(F.max("id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("_a", "id"))).alias("by_email"))
    by_domain = formats.where("source <> ''").groupBy(F.lower("source").alias("_d")).agg(F.sort_array(F.collect_list("id")).alias("ids")).agg(F.map_from_entries(F.collect_list(F.struct("_d", "ids"))).alias("by_domain"))
    return by_email.join(by_domain)


def write_catalog(formats: DataFrame, subcategories: DataFrame, path: str) -> None:
    """The catalog's slim JSON: formats, subcategories, and the two maps, each in a folder of JSON lines."""
    formats.write.mode("overwrite").json(f"{path}/formats")
    subcategories.write.mode("overwrite").json(f"{path}/subcategories")
    catalog_maps(formats).write.mode("overwrite").json(f"{path}/maps")
