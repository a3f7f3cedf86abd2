from datetime import date

import pytest
from pyspark.sql import functions as F

from helpers import bag
from kicknet.functions.conversions import (
    serial_to_clock, serial_to_date, to_number, typed_clock, typed_date,
)
from kicknet.functions.missing import divide, spreading_sum, zero_if_missing
from kicknet.functions.names import clean_name_list
from kicknet.operators.selection import ColumnRoles, bind_roles, numeric_counts


def test_clean_names():
    names = ["Monitoring Location ID", "% EPT", "2nd Count", "Result.Value", "result value", "#", "x"]
    assert clean_name_list(names) == [
        "monitoring_location_id", "percent_ept", "x2nd_count", "result_value", "result_value_2",
        "number", "x",
    ]
    assert clean_name_list(["a", "a", "a_2", "a"]) == ["a", "a_2", "a_2_2", "a_3"]


def test_numbers_dates_and_times(spark):
    df = spark.createDataFrame(
        [("12",), ("1.5",), ("n/a",), (None,), ("45000.4375",), ("10:30",), ("2023-03-15",),
         ("12F",), ("7d",), ("20230315123456",), ("9:05",), ("10:30:00",), ("25:00",)], "x string"
    )
    got = [tuple(r) for r in df.select(to_number(F.col("x")), typed_clock(F.col("x"), df.schema["x"].dataType)).collect()]
    assert got == [
        (12.0, "00:00"), (1.5, "12:00"), (None, None), (None, None), (45000.4375, "10:30"),
        (None, "10:30"), (None, None), (None, None), (None, None), (20230315123456.0, None),
        (None, "09:05"), (None, "10:30"), (None, None),
    ]
    dates = [r[0] for r in df.select(typed_date(F.col("x"), df.schema["x"].dataType)).collect()]
    assert dates[4] == date(2023, 3, 15) == dates[6] and dates[2] is None


def test_serials(spark):
    df = spark.createDataFrame([(45000.0,), (0.4375,), (0.999999999,), (None,)], "x double")
    got = [tuple(r) for r in df.select(serial_to_date(F.col("x")), serial_to_clock(F.col("x"))).collect()]
    assert got[0] == (date(2023, 3, 15), "00:00")
    assert got[1][1] == "10:30" and got[2][1] == "00:00" and got[3] == (None, None)


def test_division_never_raises(spark):
    pairs = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (None, 0.0), (1.0, None), (float("nan"), 0.0)]
    df = spark.createDataFrame(pairs, "a double, b double")
    got = [r[0] for r in df.select(divide(F.col("a"), F.col("b"))).collect()]
    assert got[0] == float("inf") and got[1] == float("-inf") and got[3] == 2.0
    assert got[2] != got[2] and got[4] is None and got[5] is None and got[6] != got[6]
    zeroed = df.select(zero_if_missing(divide(F.col("a"), F.col("b"))).alias("v")).collect()
    assert [r.v for r in zeroed][2:] == [0.0, 2.0, 0.0, 0.0, 0.0]


def test_sum_spreads_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "k string, x double")
    assert bag(df.groupBy("k").agg(spreading_sum(F.col("x")))) == {("a", None): 1, ("b", 5.0): 1}


ROLES = ColumnRoles("site", "day", "clock", "gear", "bug", "label", "n")


def test_roles_are_checked():
    columns = ["site", "day", "clock", "gear", "bug", "label", "n", "other"]
    assert ROLES.check(columns) is ROLES
    for bad in (
        ColumnRoles("site", "site", "clock", "gear", "bug", "label", "n"),
        ColumnRoles("", "day", "clock", "gear", "bug", "label", "n"),
        ColumnRoles("nowhere", "day", "clock", "gear", "bug", "label", "n"),
    ):
        with pytest.raises(ValueError):
            bad.check(columns)
    with pytest.raises(ValueError):
        ColumnRoles("family", "day", "clock", "gear", "bug", "label", "n").check([*columns, "family"])


def test_binding_renames_the_id(spark):
    df = spark.createDataFrame([("A", 1, "x", "jar", "7", "l", "3", "?")], ["site", "day", "clock", "gear", "bug", "label", "n", "other"])
    assert bind_roles(df, ROLES).columns == ["site", "day", "clock", "gear", "id", "label", "n"]


def test_counts_that_are_text(spark):
    text = spark.createDataFrame([("1",), (" 2.5",), ("-1",), ("",), (None,)], "n string")
    assert bag(numeric_counts(text, "n")) == {(1.0,): 1, (2.5,): 1}
    odd = spark.createDataFrame([("1",), ("7d",)], "n string")
    refused = numeric_counts(odd, "n")  # nothing runs before the rows are asked for
    with pytest.raises(Exception, match="7d"):
        refused.collect()
    assert numeric_counts(odd, "n", mixed="empty").count() == 0
    number = spark.createDataFrame([(0.0,), (-1.0,), (None,), (-0.5,)], "n double")
    assert bag(numeric_counts(number, "n")) == {(0.0,): 1, (-0.5,): 1}
