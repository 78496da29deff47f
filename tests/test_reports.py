from millrace.operators import reports
from pyspark.sql import functions as F


def test_fetch_report_of_a_large_catalog(spark):
    n = 10_500
    source = F.concat(F.lit("f"), F.col("id").cast("string")).alias("source")
    catalog = spark.range(n).select(source, F.lit("any-https").alias("mode"), F.array(F.lit("x.example")).alias("hosts"))
    rows = spark.range(n).select(source, F.lit("https://a.example/1").alias("url"))
    got = reports.fetch_report(rows, catalog).agg(F.count("*"), F.sum("fetched"), F.sum("kept"), F.sum("dropped_host")).first()
    assert tuple(got) == (n, n, n, 0)
