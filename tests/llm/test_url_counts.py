from pyspark.sql import functions as F

from tessera.llm import urls


def test_statistics_cover_urls_that_are_not_sampled(spark):
    """Sections alone tell the labels, and have fewer than 20 URLs each in the sample."""
    section = F.concat(F.lit("k"), F.lpad(F.conv((F.col("id") % 60) * 7919 % 4096, 10, 16), 3, "0"))
    df = spark.range(3000).select(
        F.concat(F.lit("http://a.com/"), section, F.lit("/"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("url"),
        (F.xxhash64(F.col("id") % 60) % 2 == 0).cast("int").alias("label"),
    )
    rows = urls.scored(df, urls.fit(df, train_rows=500)).collect()
    assert len(rows) == 3000 and 500 < sum(r["label"] for r in rows) < 2500
    assert sum((r["_url_score"] > 0) == (r["label"] == 1) for r in rows) > 2950
