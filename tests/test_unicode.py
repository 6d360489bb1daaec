"""IDNA, IPv6 and NFKC forms."""

import pytest
from pyspark.sql import functions as F

from vigilake.functions import unicode, urls


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("https://BÜCHER.example/a?b#c", "https://xn--bcher-kva.example/a?b#c"), ("http://[2001:DB8:0:0::1]:80/x", "http://[2001:db8::1]/x"),
            ("http://[2001:db8::1]:8080", "http://[2001:db8::1]:8080/"),
        ("http://[nonsense]/", None), ("http://ü@example.org/", None), ("HTTP://Example.COM", "http://example.com/"), (None, None),
            ("http://bücher.example:/", None),
    ],
)
def test_canonical(spark, given, expected):
    assert spark.createDataFrame([(given,)], "u string").select(unicode.canonical(F.col("u"))).first()[0] == expected


def test_canonical_is_idempotent(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(urls.canonical(F.col("url")).alias("c"))
    assert pages.where(~urls.canonical(F.col("c")).eqNullSafe(F.col("c"))).count() == 0


def test_nfkc_names(spark):
    df = spark.createDataFrame([("ＡＣＭＥ　ｔｏｏｌ",), (" Plain  Name ",), (None,)], "n string")
    assert [r[0] for r in df.select(unicode.software_name(F.col("n"))).collect()] == ["acme tool", "plain name", None]
