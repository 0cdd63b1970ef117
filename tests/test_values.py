"""Transforms, validators and value keys on edge cases."""

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import validators, values


def one(spark, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(list(enumerate(rows)), "i int, s string").orderBy("i").select(*(c(F.col("s")) for c in columns)).collect()]


@pytest.mark.parametrize(
    ("name", "cases"),
    [
        ("money", {"$24.99": 24.99, "USD 24,99": 24.99, "GBP 1,234.56": 1234.56, "1.234,56": 1234.56, "$1,234,567.89": 1234567.89, "1,234": 1234.0, "1,23": 1.23, "-5.50": -5.5, "£0.01": 0.01, "1 234,56": 1234.56, "1 234,56": 1234.56, "1e5": None, "": None, "no digits": None, "..": None, "$1.00 $2.00": 1.0, None: None}),
        ("iso_date", {"2024-03-12": "2024-03-12", "12 March 2024": "2024-03-12", "March 12, 2024": "2024-03-12", "2024-02-29": "2024-02-29", "2024-13-45": None, "2024-02-30": None, "not a date": None, "on 2024-01-05 at noon": "2024-01-05", None: None}),
        ("int", {"a-12b3": -12, "": None, "9" * 400: None, "7": 7}),
        ("digits", {"a1b2": "12", "x": None}),
        ("text", {" a  \n b ": "a b", "  ": None, None: None}),
        ("unknown name", {" a  b": "a b"}),
    ],
)
def test_transforms(spark, name, cases):
    found = one(spark, list(cases), lambda c: values.transformed(c, name).alias("v"))
    assert [x[0] for x in found] == list(cases.values())


def test_transforms_never_raise(spark):
    hostile = ["", " ", "\x00", "١٢٣", "—", "9" * 400, "nan", "inf", "-", ",", ".", "1/0", "1e999", None]
    assert len(one(spark, hostile, *(lambda c, f=f: f(c) for f in set(values.TRANSFORMS.values())))) == len(hostile)


def test_validators(spark):
    rows = spark.createDataFrame([("12", 12.0), ("abc", None), ("", None), (None, None), ("https://x", None)], "s string, n double")
    check = lambda rule: [r[0] for r in rows.select(validators.check(rule, F.col("s"), F.col("n"))).collect()]
    assert check({"type": "number", "min": 1, "max": 12}) == [True, False, False, False, False]
    assert check({"type": "nonempty"}) == [True, True, False, False, True]
    assert check({"type": "regex", "pattern": "b"}) == [False, True, False, False, False]
    assert check({"type": "regex"}) == [False] * 5
    assert check({"type": "enum", "values": ["abc"]}) == [False, True, False, False, False]
    assert check({"type": "max_len", "max_len": 2}) == [True, False, True, False, False]
    assert check({"type": "max_len"}) == [True, True, True, False, True]
    assert check({"type": "url"}) == [False, False, False, False, True]
    assert check({"type": "else"}) == [True, True, True, False, True]


def test_keys(spark):
    assert one(spark, ["37732000.0"], lambda c: values.value_key(c, c.cast("double"))) == [("37732000",)]
    assert one(spark, ["37,732,000"], lambda c: values.core_key(c)) == [("37732000",)]


@pytest.mark.parametrize(("link", "want"), [("b", "http://h/a/b"), ("../b", "http://h/b"), ("/x", "http://h/x"), ("?q", "http://h/a/c?q"), ("#f", "http://h/a/c?y=1#f"), ("//g/x", "http://g/x"), ("https://z", "https://z"), (".", "http://h/a/"), ("../../../b", "http://h/b"), ("", "http://h/a/c?y=1")])
def test_url_join(spark, link, want):
    assert one(spark, [link], lambda c: values.url_join(F.lit("http://h/a/c?y=1"), c)) == [(want,)]


def test_sql_functions(spark):
    values.register(spark)
    assert spark.sql("select fl_text('  a  b '), fl_int('x7'), fl_digits('a1b2')").first() == ("a b", 7, "12")
