"""Taking few rows out of a table of long texts without shuffling the rest.

Rows are told apart by (id, mark), the mark being a hash of the text.  A bitmap of hashed keys, about 16
bits for each key and 32 MB at most, is broadcast; rows it excludes pass untouched, and only the
others meet the keys themselves in a shuffled join.  With more keys than the bitmap holds it lets
more rows through to that join, which decides in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS = 28
_PAGE = 32768


def mark_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _place(key: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), *key), F.lit(1 << bits))


def possible(rows: DataFrame, keys: DataFrame, key: list[str], most: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key of keys, rows that certainly have none)."""
    bits = min(most, max(15, (16 * keys.count()).bit_length()))
    maps = keys.select(_place([F.col(k) for k in key], bits).alias("place")).groupBy(F.shiftright("place", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("place") % _PAGE).alias("map"))
    byte = F.expr("cast(conv(hex(substring(map, cast(shiftright(place % 32768, 3) as int) + 1, 1)), 16, 10) as int)")
    bit = F.coalesce(F.call_function("shiftright", byte, F.expr("cast(place % 8 as int)")).bitwiseAND(1), F.lit(0))
    told = rows.withColumn("place", _place([F.col(k) for k in key], bits)).join(F.broadcast(maps), F.shiftright("place", 15) == F.col("page"), "left").withColumn("maybe", bit == 1)
    return told.where("maybe").select(*rows.columns), told.where("not maybe").select(*rows.columns)


def without(docs: DataFrame, touched: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows of touched (id, mark, drop); of rows of one (id, mark) with drop false one stays."""
    columns = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    id_at, text_at = f"c{columns.index(id_col)}", f"c{columns.index(text_col)}"
    rows = plain.withColumns({"id": F.col(id_at), "mark": mark_of(F.col(text_at))})
    maybe, clear = possible(rows, touched, ["id", "mark"])
    told = touched.select(F.col("id").alias("i"), F.col("mark").alias("m"), "drop")
    maybe = maybe.join(told, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left")
    stay = maybe.where("drop is null").select(*plain.columns)
    one = maybe.where("not drop").dropDuplicates(["id", "mark"]).select(*plain.columns)
    return clear.select(*plain.columns).unionByName(stay).unionByName(one).toDF(*columns)
