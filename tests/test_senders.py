"""Senders by a catalog as a table: the steps in their order, and a plan of equality joins alone."""

from pyspark.sql import functions as F

from listingmill.operators import formats, senders


def test_chain_of_the_sample_catalog(spark):
    entries = senders.entries_of(spark, formats.SAMPLE, {"alpha": "Alpha Marketplace"})
    cases = {
        "alerts@alpha.example": ("Alpha Marketplace", "alpha_alerts"), "x@notice.beta.example": ("Beta", "beta_any"), "x@beta.example": ("Beta", "beta_any"), "x@notbeta.example": ("Notbeta", None),
        "ed@letters.example": ("Letters", None), "ed@a.weekly.example": ("Newsletter", None), "a@b.deal-flow.example": ("Ruled", None), "": ("Unknown", None), None: ("Unknown", None), "x@acme.example": ("Acme", None),
    }
    m = spark.createDataFrame([(a, "") for a in cases for _ in range(2)], "address string, hay string").withColumn("domain", F.coalesce(F.substring_index("address", "@", -1), F.lit("")))
    out = senders.label_senders(m, entries, (("deal-flow", "Ruled"),)).collect()
    assert len(out) == 2 * len(cases) and {r.address: (r.nickname, r.subcategory) for r in out} == cases


def test_large_catalog_is_joined_by_equality(spark):
    entries = spark.range(100_000).selectExpr("2 AS step", "id AS place", "'under' AS match", "concat('d', id, '.example') AS key", "concat('L', id) AS label", "CAST(NULL AS STRING) AS subcategory")
    asked = spark.range(2000).selectExpr("concat('a@', CASE WHEN id % 2 = 0 THEN 'm.' ELSE '' END, 'd', id * 60, '.example') AS address")
    found = senders.known_senders(asked, entries)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert {(r.address, r.label) for r in found.collect()} == {(f"a@{'m.' if i % 2 == 0 else ''}d{i * 60}.example", f"L{i * 60}") for i in range(2000) if i * 60 < 100_000}
