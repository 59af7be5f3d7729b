"""The first filter keeps every wanted row and leaves most others out."""

from pyspark.sql import functions as F

from foldwise.llm.likely import likely_among
from foldwise.session import settle


def test_likely_among(spark):
    df = spark.range(200_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("node"), F.expr("if(id % 7 = 0, null, id)").alias("doc_id"), "id")
    few = settle(df.filter("id % 50 < 2").select("node", "doc_id"))
    for on in (["node"], ["node", "doc_id"]):
        kept = likely_among(df, few, on)
        assert kept.columns == df.columns
        assert kept.filter("id % 50 < 2").count() == 8_000
        assert kept.count() < 25_000
    # more keys than the bitmap has room for: nothing is lost
    assert likely_among(df, few, ["node"], most_bits=1 << 15).filter("id % 50 < 2").count() == 8_000
    assert likely_among(df, few.limit(0), ["node"]).count() == 0
