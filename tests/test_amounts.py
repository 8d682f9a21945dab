import pytest
from pyspark.sql import functions as F

from poolscope.functions import base_units, rate_per_second


def parse(spark, values, **options):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, a string")
    rows = df.select("k", base_units(F.col("a"), name="Supply.assets", **options).alias("n")).orderBy("k").collect()
    return [r.n for r in rows]


def test_accepted_forms(spark):
    values = ["123", " 1,234 ", "", None, "0x1F", "0XFF", "-5", "\t7\n", "0x0", "0x00000000000000000000000000000000000000ff"]
    assert parse(spark, values) == [123, 1234, 0, 0, 31, 255, -5, 7, 0, 255]


def test_beyond_64_bits_needs_a_decimal(spark):
    text = "0x" + "f" * 20
    assert parse(spark, [text], amount_type="decimal(38,0)") == [int(text, 16)]
    wide = [2**120, 10**38 - 1, 2**64, 2**60 - 1, 2**60]
    assert parse(spark, [hex(v) for v in wide], amount_type="decimal(38,0)") == wide
    assert parse(spark, ["0x" + "0" * 1000 + "ff", "+7", "1,000"]) == [255, 7, 1000]
    with pytest.raises(Exception, match="OVERFLOW|out of range|overflow"):
        parse(spark, [text])


@pytest.mark.parametrize("value, message", [
    ("1.5", "Supply.assets: expected a whole number, found '1.5'"),
    ("15e-1", "expected a whole number"),
    ("1e5", "expected a whole number"),
    ("--1", "expected a whole number"),
    ("0x", "bad hex value"),
    ("0xZZ", "bad hex value"),
    ("0x" + "f" * 33, "more than 38 decimal digits"),
    ("0x" + "f" * 32, "NUMERIC_VALUE_OUT_OF_RANGE|overflow"),
    ("abc", "expected a whole number"),
])
def test_refused_forms(spark, value, message):
    with pytest.raises(Exception, match=message):
        parse(spark, [value])


def test_rate(spark):
    df = spark.createDataFrame([("1000000000",), (None,)], "r string")
    assert [r[0] for r in df.select(rate_per_second(F.col("r"))).collect()] == [1e-9, 0.0]


def test_short_amounts_skip_the_wide_arithmetic(spark):
    plan = spark.createDataFrame([("1",)], "a string").select(base_units(F.col("a"), name="x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "[0-9]{1,18}" in plan and plan.index("[0-9]{1,18}") < plan.index("decimal(38,0)")
    assert parse(spark, ["0", "007", "9" * 18, "0x" + "f" * 15, "0x7" + "f" * 15, "0X0a", "7\n", "0xff\n"]) == [
        0, 7, 10**18 - 1, 2**60 - 1, 2**63 - 1, 10, 7, 255]
