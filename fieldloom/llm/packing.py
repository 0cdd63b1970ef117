"""Packing into optimal length buckets.

The global histogram of lengths gives the bucket boundaries: dynamic programming, exact for the
histogram, chooses at most ``buckets`` boundaries that minimise the padded tokens.  Within a bucket,
rows are numbered and cut into batches of ``budget // boundary`` rows (one row at least),
so that a batch never holds more than ``budget`` padded tokens unless a single row does.

The histogram has one entry for each distinct length, of which a corpus of T tokens has at most
sqrt(2 T); the driver holds it as two arrays, and a layer of the programme is a few array operations.

Numbering does not gather a bucket in one task: rows fall into shards of a bucket by a hash of their
place in a stored table, so that no id fills a shard; shards of some ten thousand rows are numbered each
by itself in the order of (id, length, place), and their totals give the offsets.

Rows of the result, one for each input row: id, ``n_tokens``, ``bucket`` (0-based), ``padded`` (the
bucket's boundary), ``batch`` (within the bucket), ``slot`` (within the batch).  Rows of length 0 (null, empty
or blank texts) form part of the smallest bucket; a longer row than the budget has a batch to itself.  Ids may
repeat or be null; rows of one id and length follow each other by their place within a shard.  An empty
table gives no rows.  Kept columns of the result's names are left out, and other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import spread, stored

BUCKETS = 16
BUDGET = 65_536
SHARD_ROWS = 10_000


def _layer(best: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least padded tokens of the first j lengths with one bucket more, and where that bucket begins.

    The best beginning never falls as j grows, so the middle j of a range halves it and its beginnings; all
    ranges of one depth go together.
    """
    n = len(lengths)
    new, cut = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int32)
    first, last, low, high = (np.array([x]) for x in (1, n, 0, n - 1))
    while len(first):
        at = (first + last) // 2
        size = np.minimum(at - 1, high) - low + 1
        begin = np.repeat(low, size) + spread(size)
        cost = best[begin] - rows[begin] * np.repeat(lengths[at - 1], size)
        heads = np.cumsum(size) - size
        least = np.minimum.reduceat(cost, heads)
        chosen = np.minimum.reduceat(np.where(cost == np.repeat(least, size), begin, n), heads)
        new[at], cut[at] = least + lengths[at - 1] * rows[at], chosen
        first, last, low, high = np.concatenate([first, at + 1]), np.concatenate([at - 1, last]), np.concatenate([low, chosen]), np.concatenate([chosen, high])
        some = first <= last
        first, last, low, high = first[some], last[some], low[some], high[some]
    return new, cut


def optimal_boundaries(lengths, counts, buckets: int) -> list[int]:
    """Boundaries (ascending, the last is the largest length) of least total padding, at most so many; exact.

    A bucket of lengths i + 1 to j costs lengths[j] * (rows[j] - rows[i]); ``_layer`` adds one bucket.
    """
    n = len(lengths)
    if not n:
        return []
    lengths, rows = np.asarray(lengths, np.int64), np.concatenate(([0], np.cumsum(np.asarray(counts, np.int64))))
    best, cuts = np.concatenate(([0], lengths * rows[1:])), [np.zeros(n + 1, np.int32)]
    for _ in range(1, min(buckets, n)):
        new, cut = _layer(best, rows, lengths)
        if new[n] >= best[n]:
            break
        best = new
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
        if not j:
            break
    return out[::-1]


def token_count(text: Column) -> Column:
    """White-space separated words of a text; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x09-\x0D\x20]+"), "")).cast("long")


def packed(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, keep: list[str] | None = None) -> DataFrame:
    """Every row of docs with its bucket, batch and slot; ``keep`` names further columns to carry."""
    spark = docs.sparkSession
    length = token_count(F.col("text")) if length is None else length
    keep = [c for c in keep or [] if c not in (id_col, "n_tokens", "bucket", "padded", "batch", "slot")]
    rows = stored(docs.select(F.col(id_col).alias("id"), length.cast("long").alias("n_tokens"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep))).withColumn("place", F.monotonically_increasing_id()), "lengths")
    seen = rows.groupBy("n_tokens").agg(F.count("*").alias("c")).toArrow()
    lengths, counts = seen.column("n_tokens").to_numpy(), seen.column("c").to_numpy()
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order]
    bounds = optimal_boundaries(lengths, counts, buckets)
    totals = np.bincount(np.searchsorted(bounds, lengths), counts, len(bounds)).astype(np.int64).tolist() if bounds else []
    shape = T.StructType([T.StructField(k, T.LongType(), False) for k in ("bucket", "padded", "shards")])
    plan = [(i, b, -(-t // SHARD_ROWS)) for i, (b, t) in enumerate(zip(bounds, totals, strict=True))]
    edges = F.array(*(F.lit(b).cast("long") for b in bounds[:-1])) if bounds[:-1] else F.array().cast("array<long>")
    bucket = F.size(F.filter(edges, lambda b: b < F.col("n_tokens"))).cast("long")
    rows = rows.withColumn("bucket", bucket).join(F.broadcast(spark.createDataFrame(plan, shape)), "bucket")  # at most `buckets` rows
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("place"), F.greatest("shards", F.lit(1))))
    offsets = rows.groupBy("bucket", "shard").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = offsets.select("bucket", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("id", "n_tokens", "place"))
    numbered = rows.withColumn("at", number - 1).join(offsets, ["bucket", "shard"]).withColumn("at", F.col("at") + F.col("before"))
    room = F.greatest(F.floor(F.lit(budget) / F.greatest("padded", F.lit(1))), F.lit(1)).cast("long")
    return numbered.select(
        F.col("id").alias(id_col), *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)), "n_tokens", "bucket", "padded", F.floor(F.col("at") / room).cast("long").alias("batch"), (F.col("at") % room).cast("long").alias("slot")
    )
