"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  Each window
of ``width`` consecutive item words (an item of fewer words, but not none, is one window) must lie
whole in a document, so containment is 1 and the necessary prefix is one token: its rarest, by the
global count of the window's words over all documents.  Document words join the windows on that
token only; the token's place in the window gives the start, which must leave room on both sides
(the positional and length bounds), and the words there must equal the window's.

Rarity counts and windows are broadcast only while all windows take at most ``broadcast_bytes``, by a
bound over all items: a word lies in at most ``width`` windows, with its bytes and 24 more; beyond that the same steps run as shuffled joins, with the candidates of each document
verified against its words in a second pass.

Rows of the result, one for each document row: id, ``n_words``, ``n_hit`` (words inside any occurrence
of a window), ``n_items`` (items with occurring windows), ``items_sha256`` (of those item ids, sorted as
strings, comma-joined; of the empty string if none), ``contaminated``.  Null, empty and wordless
texts have no words and no hits; wordless items have no windows.  Repeated document rows give equal
result rows; null ids are carried; repeated item rows count as one item.  An item with a null id
still marks words, but is not counted.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .rows import mark_of

WIDTH = 10
BROADCAST_BYTES = 128 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def windows_of(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Distinct (item, window words) of the benchmark."""
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return words.withColumn("at", F.explode(at)).select("item", F.slice("w", F.col("at"), width).alias("window")).distinct()


def hits(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(id, mark, n_hit, items) of the documents that hold a window; the mark is a hash of the text."""
    words = docs.select(F.col(id_col).alias("id"), mark_of(F.col(text_col)).alias("mark"), words_of(F.col(text_col)).alias("w"))
    windows = windows_of(items, item_id_col, item_text_col, width)
    window_words = windows.select(F.explode("window").alias("word")).distinct()
    text = F.col(item_text_col)
    bound = F.octet_length(text).cast("long") + 24 * F.size(words_of(text))
    small = width * (items.select(F.sum(bound).alias("n")).first()["n"] or 0) <= broadcast_bytes
    sized = F.broadcast if small else (lambda df: df)

    counts = words.select(F.explode("w").alias("word")).join(sized(window_words), "word", "left_semi").groupBy("word").agg(F.count("*").alias("c"))
    tokens = windows.select("item", "window", F.posexplode("window").alias("offset", "word")).join(counts, "word")
    full = tokens.groupBy("item", "window").agg(F.min(F.struct("c", "word", "offset")).alias("r"), F.count_distinct("word").alias("seen"))
    # a window with a word that no document holds has no place to look for
    rare = stored(full.where(F.col("seen") == F.size(F.array_distinct("window"))).select(F.col("r.word").alias("word"), F.col("r.offset").alias("offset"), "item", "window"), "windows")

    if small:
        found = words.select("id", "mark", "w", F.posexplode("w").alias("pos", "word")).join(F.broadcast(rare), "word")
        found = found.withColumn("start", F.col("pos") - F.col("offset"))
        found = found.where((F.col("start") >= 0) & (F.col("start") + F.size("window") <= F.size("w")))
        found = found.where(F.slice("w", F.greatest(F.col("start"), F.lit(0)) + 1, F.size("window")) == F.col("window"))
        found = found.select("id", "mark", "item", "start", (F.col("start") + F.size("window")).alias("stop"))
    else:
        places = words.select("id", "mark", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word")).join(rare, "word")
        places = places.withColumn("start", F.col("pos") - F.col("offset")).where((F.col("start") >= 0) & (F.col("start") + F.size("window") <= F.col("n")))
        places = places.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "item", "window")).alias("places")).withColumnsRenamed({"id": "i", "mark": "m"})
        back = words.join(places, F.col("i").eqNullSafe(F.col("id")) & (F.col("m") == F.col("mark")))
        held = F.filter("places", lambda p: F.slice(F.col("w"), p["start"] + 1, F.size(p["window"])) == p["window"])
        found = back.select("id", "mark", F.explode(held).alias("p")).select("id", "mark", F.col("p.item").alias("item"), F.col("p.start").alias("start"), (F.col("p.start") + F.size("p.window")).alias("stop"))

    spans = F.array_sort(F.collect_set(F.struct("start", "stop")))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["stop"] - F.greatest(s["start"], a["reach"]), F.lit(0))).alias("n"), F.greatest(a["reach"], s["stop"]).alias("reach")),
        lambda a: a["n"],
    )
    return found.groupBy("id", "mark").agg(covered.cast("long").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))


def benchmark_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """What each row of docs shares with the benchmark; the columns are described above, further arguments at ``hits``."""
    found = hits(docs, items, id_col, text_col, **how).withColumnsRenamed({"id": "i", "mark": "m"})
    rows = docs.select(F.col(id_col).alias("id"), mark_of(F.col(text_col)).alias("mark"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    told = rows.join(found, F.col("i").eqNullSafe(F.col("id")) & (F.col("m") == F.col("mark")), "left")
    n_hit, items_found = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return told.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items_found).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items_found), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
