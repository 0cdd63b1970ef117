"""Value functions of the extraction engine as Catalyst expressions.

Every transform takes and gives a string or number column and never raises: what it cannot read is
null.  ``TRANSFORMS`` is the closed list a spec may name; an unknown name means ``text``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Date formats in the order they are tried.
DATE_FORMATS = ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d MMMM yyyy", "MMMM d, yyyy", "yyyy/M/d")
#: Class names made by styling tools, and names of layout helpers.
HASHED_CLASS = r"^(css-|sc-|jsx-|_)[a-z0-9]{4,}$|^[a-z]{1,3}[-_]?[0-9a-f]{6,}$"
LAYOUT_CLASS = r"^(col|row|grid|flex|container|wrapper|inner|outer|layout|mt|mb|ml|mr|px|py|p|m)[-_]?\d*$"
ISO_DATE = r"\d{4}-\d{2}-\d{2}"


def normal_text(c: Column) -> Column:
    """White space (Unicode) runs as one space, trimmed; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def money(c: Column) -> Column:
    """An amount with either separator convention; null if unreadable or in exponent notation."""
    # Fixed value: blanks that part thousands
    joined = F.regexp_replace(c, r"(?<=\d)[ \u00A0\u202F](?=\d{3}(?!\d))", "")
    number = F.regexp_extract(joined, r"-?\d[\d.,]*", 0)
    comma = F.length(number) - F.instr(F.reverse(number), ",")
    point = F.length(number) - F.instr(F.reverse(number), ".")
    has_comma, has_point = F.contains(number, F.lit(",")), F.contains(number, F.lit("."))
    european = F.replace(F.replace(number, F.lit(".")), F.lit(","), F.lit("."))
    plain = F.replace(number, F.lit(","))
    lone = F.replace(number, F.lit(","), F.when(number.rlike(r",\d{2}$"), F.lit(".")).otherwise(F.lit("")))  # several decimal commas are unreadable
    chosen = F.when(has_comma & has_point, F.when(comma > point, european).otherwise(plain)).when(has_comma, lone).otherwise(number)
    return F.when(~joined.rlike(r"\d[eE][+-]?\d"), F.round(chosen.try_cast("double"), 4))


def int_value(c: Column) -> Column:
    return F.regexp_extract(c, r"-?\d+", 0).try_cast("bigint")


def digits(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"\D", ""), F.lit(""))


def iso_date(c: Column) -> Column:
    """The date as yyyy-MM-dd text, by the first format that reads the whole text, else a date inside it."""
    text = normal_text(c)
    tries = [F.try_to_date(text, f) for f in DATE_FORMATS]
    inside = F.try_to_date(F.nullif(F.regexp_extract(text, ISO_DATE, 0), F.lit("")), "yyyy-MM-dd")
    return F.date_format(F.coalesce(*tries, inside), "yyyy-MM-dd")


TRANSFORMS: dict[str, Callable[[Column], Column]] = {"text": normal_text, "strip": normal_text, "url": normal_text, "money": money, "float": money, "int": int_value, "digits": digits, "iso_date": iso_date}
NUMERIC = frozenset({"money", "float", "int"})


def transformed(c: Column, name: str) -> Column:
    return TRANSFORMS.get(name, normal_text)(c)


def url_join(base: Column, url: Column) -> Column:
    """RFC 3986 reference resolution for http(s) bases, without parsing in Python."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][\w+.-]*):", 1)
    authority = F.regexp_extract(base, r"^([A-Za-z][\w+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"[^/]*$", "")
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    tail = F.regexp_extract(url, r"([?#].*)$", 1)
    head = F.regexp_replace(url, r"[?#].*$", "")
    parts = F.split(F.when(head.startswith("/"), head).otherwise(F.concat(folder, head)), "/")
    walked = F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)),
        F.array().cast("array<string>"),
        lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(p == ".", a).otherwise(F.concat(a, F.array(p))),
    )
    closed = F.element_at(parts, -1).isin(".", "..")
    resolved = F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(closed & (F.size(walked) > 0), "/").otherwise(""))
    return (
        F.when(F.coalesce(base, F.lit("")) == "", url)
        .when(url.rlike(r"^[A-Za-z][\w+.-]*:"), url)
        .when(url.startswith("//"), F.concat(scheme, F.lit(":"), url))
        .when(url == "", base)
        .when(url.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), url))
        .when(url.startswith("?"), F.concat(authority, path, url))
        .otherwise(F.concat(authority, resolved, tail))
    )


def value_key(text: Column, number: Column | None = None) -> Column:
    """One text for equal values: integral numbers without a fraction, text with single spaces."""
    plain = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    if number is None:
        return plain
    integral = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(number.isNull(), plain).when(integral, number.cast("bigint").cast("string")).otherwise(number.cast("string"))


def core_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[^a-z0-9]", "")


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))


def register(spark: SparkSession) -> None:
    """The transforms as SQL functions ``fl_<name>(text)``, by SQL definitions that Catalyst inlines."""
    sql = {
        "text": "nullif(trim(regexp_replace(s, '(?U)\\\\s+', ' ')), '')",
        "int": "try_cast(regexp_extract(s, '-?\\\\d+', 0) AS BIGINT)",
        "digits": "nullif(regexp_replace(s, '\\\\D', ''), '')",
    }
    for name, body in sql.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fl_{name}(s STRING) RETURN {body}")
