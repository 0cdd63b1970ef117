"""Exact top-k search of binary codes by incremental multi-index hashing, as joins.

A vector's code has one bit for each dimension, its sign (positive: 1).  Codes are cut into m segments
of about log2(codes / 16) bits, 16 at most, and each code is posted under (segment, value).  All queries
advance in rounds of a growing radius r: a query asks for the values that differ from its own in exactly r
bits of a segment, meets the postings of those values in a shuffled join, and verifies the whole
codes there.  A code counts only where its least distance within a segment is r, and only in the first
such segment, so every (query, code) is met once in all.  After radius r every code within
m * (r + 1) - 1 bits has been met; a query ends once its (k + 1)-th best distance so far is within
that (one row may be the query's own) or all codes have been met.  Codes beyond that distance are not kept,
and at its last radius a query asks only in the first segments that are needed: with a of them searched,
every code within m * r + a - 1 bits has been met.

Rows of one code are one posting with their k + 1 least ids (more can never be among the k best), so a
common vector is no hot posting.  A query is not its own neighbour: of rows with the query's id
none is returned.  Codes have as many bits as most vectors have elements (of equally common numbers the
larger).  Vectors that are null or of another length, and rows of null id, take no part; null
elements and NaN count as not positive.  Repeated (id, vector) rows count once; ids may be of any type
with an order; other columns are ignored.  An empty table gives no rows; fewer than k other rows give
fewer neighbours.

Result: ``query_id``, ``rank`` (1 to k, ties by id), id of the neighbour, ``distance`` in bits.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stored

K = 10
SEGMENT = 16


def sign_code(vector: Column, dims: int) -> list[Column]:
    """The code as longs of 64 bits each."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    bit = lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", one, i)).otherwise(none)
    return [F.aggregate(F.transform(F.slice(vector, lo + 1, min(64, dims - lo)), bit), none, lambda a, b: a.bitwiseOR(b)) for lo in range(0, dims, 64)]


def flips(bits: int, radius: int) -> list[int]:
    """All masks of ``bits`` bits with ``radius`` of them set."""
    return [sum(1 << b for b in c) for c in combinations(range(bits), radius)]


def cuts(dims: int, codes: int) -> list[tuple[int, int]]:
    """First bit and width of each segment: as even as can be, about log2(codes / 16) bits each."""
    m = -(-dims // min(SEGMENT, max(4, (codes - 1).bit_length() - 4)))
    ends = [dims * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def segment(words: list[Column], lo: int, bits: int) -> Column:
    """Some bits of a code as an int."""
    value = F.shiftrightunsigned(words[lo // 64], lo % 64) if lo % 64 else words[lo // 64]
    if lo % 64 + bits > 64:
        value = value.bitwiseOR(F.shiftleft(words[lo // 64 + 1], 64 - lo % 64))
    return value.bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")


def segments(words: list[Column], at: list[tuple[int, int]]) -> Column:
    """Rows of (segment, its width, value)."""
    return F.explode(F.array(*(F.struct(F.lit(i).alias("seg"), F.lit(bits).alias("bits"), segment(words, lo, bits).alias("value")) for i, (lo, bits) in enumerate(at))))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def nearest_codes(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int | None = None, k: int = K) -> DataFrame:
    """The k nearest rows of vectors for each row of queries, by Hamming distance of their sign codes."""
    spark = vectors.sparkSession
    if dims is None:
        sizes = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0)).groupBy(F.size(vector_col).alias("size")).agg(F.count("*").alias("n"))
        most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
        dims = most["size"] if most else 1
    words = [f"w{i}" for i in range(-(-dims // 64))]

    def coded(df: DataFrame) -> DataFrame:
        held = df.where(F.col(id_col).isNotNull() & (F.size(vector_col) == dims))
        return held.select(F.col(id_col).alias("id"), *(c.alias(w) for c, w in zip(sign_code(F.col(vector_col), dims), words, strict=True)))

    # the least ids of each code, first within parts of a common code
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    rows = coded(vectors).distinct().withColumn("part", part)
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(*words, "part").orderBy("id"))).where(F.col("r") <= k + 1)
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*words).orderBy("id"))).where(F.col("r") <= k + 1)
    entries = stored(ranked.groupBy(*words).agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("entry", F.monotonically_increasing_id()), "codes")
    size = entries.agg(F.count("*").alias("codes"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("rows")).first()
    at = cuts(dims, size["codes"])
    postings = stored(entries.select("entry", F.size("ids").alias("n"), *words, segments([F.col(w) for w in words], at).alias("s")).select("entry", "n", *words, "s.seg", "s.value"), "postings")
    mine = [f"q{w}" for w in words]
    asked = coded(queries).distinct().select(F.monotonically_increasing_id().alias("query"), F.col("id").alias("query_id"), *(F.col(w).alias(q) for w, q in zip(words, mine, strict=True)), F.lit(dims).alias("bound"))
    asked = stored(asked, "queries")
    active, hits = asked, []
    by_distance = Window.partitionBy("query").orderBy("distance").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for radius in range(max(bits for _, bits in at) + 1):
        masks = spark.createDataFrame([(bits, mask) for bits in sorted({bits for _, bits in at}) for mask in flips(bits, radius)], "bits int, mask int")  # a few thousand
        probes = active.select("query", "bound", *mine, segments([F.col(q) for q in mine], at).alias("s")).select("query", "bound", *mine, "s.seg", "s.bits", "s.value").where(F.col("seg") <= F.col("bound") - len(at) * radius)
        probes = probes.join(F.broadcast(masks), "bits").select("query", "bound", *mine, F.col("seg").alias("s"), F.col("value").bitwiseXOR(F.col("mask")).alias("v"))
        xor = [F.col(q).bitwiseXOR(F.col(w)) for q, w in zip(mine, words, strict=True)]
        distance = reduce(lambda a, b: a + b, (F.bit_count(x) for x in xor))
        apart = [F.bit_count(segment(xor, lo, bits)) >= F.lit(radius) + F.when(F.lit(i) < F.col("seg"), 1).otherwise(0) for i, (lo, bits) in enumerate(at)]
        met = probes.join(postings, _all([F.col("s") == F.col("seg"), F.col("v") == F.col("value"), distance <= F.col("bound"), *apart]))
        hits.append(stored(met.select("query", "entry", "n", distance.alias("distance")), "hits"))
        found = reduce(DataFrame.unionByName, hits).join(active.select("query"), "query", "left_semi")
        near = found.groupBy("query", "distance").agg(F.sum("n").alias("n")).withColumn("n", F.sum("n").over(by_distance))
        near = near.groupBy("query").agg(F.min(F.when(F.col("n") > k, F.col("distance"))).alias("kth"), F.max("n").alias("met"))
        ended = (F.col("kth") <= len(at) * (radius + 1) - 1) | F.col("kth").isNull() & (F.coalesce("met", F.lit(0)) >= size["rows"])
        more = active.join(near, "query", "left").where(~F.coalesce(ended, F.lit(False))).select("query", "query_id", *mine, F.coalesce("kth", F.lit(dims)).alias("bound"))
        more = stored(more, "queries")
        if active is not asked:
            discard(active)
        active = more
        if active.isEmpty():
            break
    found = reduce(DataFrame.unionByName, hits)
    near = found.groupBy("query", "distance").agg(F.sum("n").alias("n")).withColumn("n", F.sum("n").over(by_distance))
    kth = near.groupBy("query").agg(F.min(F.when(F.col("n") > k, F.col("distance"))).alias("kth"))
    best = found.join(kth, "query").where(F.col("kth").isNull() | (F.col("distance") <= F.col("kth"))).join(asked.select("query", "query_id"), "query")
    best = best.join(entries.select("entry", "ids"), "entry").select("query_id", "distance", F.explode("ids").alias("id")).where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    best = best.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias(id_col), F.col("distance").cast("long").alias("distance"))
