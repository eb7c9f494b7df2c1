"""Spellings of languages are brought to their two-letter code."""

from pyspark.sql import functions as F

from locusmith.llm.tokens import language_code

SPELLED = {"hu": "hu", " HU ": "hu", "hu-HU": "hu", "HUN": "hu", "Magyar": "hu", "eng": "en", "English": "en", "en_US": "en", "Latina": "la", "la": "la", "xx": "xx", "": None, "  ": None, "12": None}


def test_language_codes(spark):
    df = spark.createDataFrame([*SPELLED.items(), (None, None)], "spelled string, code string")
    assert all(r["got"] == r["code"] for r in df.withColumn("got", language_code(F.col("spelled"))).collect())
