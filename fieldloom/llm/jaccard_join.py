"""Set-similarity self-join of documents on word shingles, by chosen paths.

Each distinct shingle set becomes one node with 64 min-wise samples of its shingles.  A run splits
the nodes by sampled shared tokens: under a path, a node picks each of its samples with probability
BRANCH / (threshold * 64), and each pick names a child bucket.  Buckets of few nodes and those at the
last depth are leaves, and so is a bucket whose nodes are so alike that its children would need more
comparisons than it does itself: a group of near copies is a leaf at once.  All others split again.
How alike the nodes of a bucket are comes from sums of signs of their samples, gathered with its
size (the square of such a sum estimates the number of agreeing pairs).  Runs repeat until the miss
rate of the branching process is below 1 - recall.  Leaves are compared in full: samples first, then
the shingle sets themselves.  A pair counts in the smallest leaf that both nodes share, so links add
up without listing pairs; leaves of many nodes are cut into tiles of chunk pairs, so that no task
holds a whole hot group.

Rows of the result, one for each row of the input (key column, ``class_id``, ``n_links``):
``class_id`` is the smallest id in the connected component, ``n_links`` the number of other rows
whose shingle set has at least the wanted Jaccard similarity.  Rows without words (null, empty or
blank text) have no shingles: their class is their own id and they have no links.  A text of one to
four words is one shingle.  Repeated rows and equal texts are links of each other.  Ids may repeat
or be null (``class_id`` is null only where all ids of a class are) and be of any type with an order.
Texts of any length are taken whole, a few hundred kilobytes at a time, and other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, discard, fixed_rows, group_bounds, grouped, hash_words, matrix_of, mix, signed, small_batches, steps, stored, text_bytes, words_of
from .rows import mark_of, possible

SAMPLES = 64
BRANCH = 3.0
LEAF = 48
CHUNK = 320
#: Samples whose signs tell how alike the nodes of a bucket are.
SIGNS = 16
#: Bytes of text that are sketched at a time.
SKETCH_BYTES = 1 << 19
#: Shingles of all nodes in a chunk, about.
CHUNK_SHINGLES = 1_500_000
DEPTH = 5
WIDTH = 5
_LOW48 = U64((1 << 48) - 1)
_RNG = np.random.default_rng(20240607)
_MULTIPLIERS = (_RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint64) | U64(1)).astype(np.uint32)
_ADDENDS = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_PLACES = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def runs_for(recall: float, branch: float = BRANCH, depth: int = 3) -> int:
    """How often to repeat so that a pair at the threshold is missed with probability 1 - recall at most.

    A pair at the threshold shares a Poisson number of children of mean ``branch`` under each shared
    path; the run misses it when that branching process dies out.
    """
    miss = 0.0
    for _ in range(depth):
        miss = math.exp(branch * (miss - 1))
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 48-bit hashes of each row's distinct shingles, and n + 1 offsets.  At most 65,536 rows."""
    data = LOWER[data]
    starts, lengths, ends = words_of(data, offsets)
    h = hash_words(data, starts, lengths)
    counts = np.diff(ends)
    docs = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(ends[1:], counts) - np.arange(len(h))  # words from here to the row's end
    s = h.copy()
    for k in range(1, width):
        s *= U64(0x9E3779B97F4A7C15 | 1)
        inside = left > k
        s[inside] += h[np.flatnonzero(inside) + k]
    keep = (left >= width) | (np.repeat(counts, counts) < width) & (left == np.repeat(counts, counts))
    s = (mix(s) >> U64(16)) | docs.astype(U64) << U64(48)
    s = np.sort(s[keep])
    if len(s):
        s = s[np.append(True, s[1:] != s[:-1])]
    rows = np.searchsorted(s, np.arange(len(counts) + 1, dtype=np.uint64) << U64(48)) if len(counts) < 65536 else np.append(np.searchsorted(s, np.arange(len(counts), dtype=np.uint64) << U64(48)), len(s))
    return s & _LOW48, rows


def set_keys(s: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free hashes for each non-empty set."""
    if not len(filled):
        return np.zeros(0, U64), np.zeros(0, U64)
    return mix(np.add.reduceat(mix(s), filled)), mix(np.add.reduceat(mix(s ^ U64(0xA5A5A5A5A5A5)), filled))


def samples_of(s: np.ndarray, filled: np.ndarray) -> np.ndarray:
    out = np.empty((len(filled), SAMPLES), np.uint32)
    if len(filled):
        x = (mix(s + U64(0x51ED27)) >> U64(32)).astype(np.uint32)
        for k in range(SAMPLES):
            out[:, k] = np.minimum.reduceat(x * _MULTIPLIERS[k] + _ADDENDS[k], filled)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for lo, hi in steps(offsets, SKETCH_BYTES):
            s, rows = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            n = np.diff(rows)
            has = n > 0
            filled = rows[:-1][has]
            keys, twins = set_keys(s, filled)
            place = np.cumsum(has) - 1
            take = pa.array(np.where(has, place, 0), mask=~has)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(lo, hi - lo), batch.column("mark").slice(lo, hi - lo), signed(keys).take(take), signed(twins).take(take), pa.array(n), fixed_rows(samples_of(s, filled)).take(take)],
                ["id", "mark", "node", "twin", "n", "samples"],
            )


def _children(path: np.ndarray, samples: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of the children of each (path, node)."""
    picked = samples.astype(U64)
    picked += _PLACES
    picked = mix(picked ^ path[:, None])
    chosen = (mix(picked ^ U64(0x5BF03635)) >> U64(32)) < U64(int(min(1.0, BRANCH / (threshold * SAMPLES)) * 2**32))
    rows, places = np.nonzero(chosen)
    return rows, picked[rows, places]


def _signs(samples: np.ndarray) -> np.ndarray:
    """A sign bit of each of the first samples."""
    bits = mix(samples[:, :SIGNS].astype(U64) + _PLACES[:SIGNS] + U64(0x51)) & U64(1)
    return (bits << np.arange(SIGNS, dtype=U64)).sum(1).astype(np.int32)


def _split(threshold: float, runs: int):
    """First level where runs is given; else below the path in column ``bucket``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                node, n, samples = part.column("node").to_numpy(), part.column("n").to_numpy(), matrix_of(part.column("samples"), np.uint32, SAMPLES)
                signs = _signs(samples)
                paths = [np.full(len(node), mix(np.array([r + 1], U64))[0]) for r in range(runs)] or [part.column("bucket").to_numpy().astype(np.int64).view(U64)]
                for path in paths:
                    rows, bucket = _children(path, samples, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(node[rows]), signed(bucket), pa.array(n[rows]), pa.array(signs[rows])], ["node", "bucket", "n", "signs"])

    return split


def likeness(signs: Column, count: Column) -> Column:
    """The mean share of samples in which two rows of a group agree, from the signs: an aggregate."""
    sums = [F.sum(F.shiftright(signs, k).bitwiseAND(1) * 2 - 1).cast("double") for k in range(SIGNS)]
    squares = sum((x * x for x in sums[1:]), sums[0] * sums[0]) / SIGNS
    return (squares - count) / F.greatest(count * (count - 1), F.lit(1))


def _tile_pairs(sides: np.ndarray, self_tile: bool) -> np.ndarray:
    """Which pairs (row, column) of a tile's members are its own: across the two chunks, or within the one."""
    upper = np.triu(np.ones((len(sides), len(sides)), bool), 1)
    return upper if self_tile else upper & (sides[:, None] != sides[None, :])


def _first_here(leaf: int, leaves: list[np.ndarray]) -> np.ndarray:
    """Whether two members share no leaf smaller than this one."""
    lower = [x[x < leaf] for x in leaves]
    if not sum(map(len, lower)):
        return np.ones((len(leaves), len(leaves)), bool)
    names, where = np.unique(np.concatenate(lower), return_inverse=True)
    owner = np.repeat(np.arange(len(leaves)), [len(x) for x in lower])
    seen = np.bincount(where, minlength=len(names)) > 1
    has = np.zeros((len(leaves), int(seen.sum())), np.float32)
    keep = seen[where]
    has[owner[keep], (np.cumsum(seen) - 1)[where[keep]]] = 1
    return has @ has.T == 0


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    return column.values.to_numpy(), ends


def _alike(least: int):
    """Keeps the members of a tile that have a partner whose samples agree in so many places."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["leaf", "low", "high"]):
            bounds = group_bounds(table, ["leaf", "low", "high"])
            marks = matrix_of(table.column("marks"), np.uint8, SAMPLES)
            sides, leaf, low, high = (table.column(k).to_numpy() for k in ("side", "leaf", "low", "high"))
            values, ends = _lists(table.column("leaves"))
            keep = np.zeros(table.num_rows, bool)
            sizes = np.diff(bounds)
            pair = bounds[:-1][sizes == 2]
            match = pair[(marks[pair] == marks[pair + 1]).sum(1) >= least]
            for a in match:
                one, two = values[ends[a] : ends[a + 1]], values[ends[a + 1] : ends[a + 2]]
                if (low[a] == high[a] or sides[a] != sides[a + 1]) and min(set(one.tolist()) & set(two.tolist())) == leaf[a]:
                    keep[a] = keep[a + 1] = True
            for a, size in zip(bounds[:-1][sizes > 2], sizes[sizes > 2], strict=True):
                m = marks[a : a + size]
                near = np.zeros((size, size), bool)
                for r in range(0, size, 32):
                    near[r : r + 32] = (m[r : r + 32, None, :] == m[None, :, :]).sum(2, dtype=np.uint8) >= least
                near &= _tile_pairs(sides[a : a + size], low[a] == high[a])
                if near.any():
                    near &= _first_here(leaf[a], [values[ends[i] : ends[i + 1]] for i in range(a, a + size)])
                    keep[a : a + size] = near.any(0) | near.any(1)
            if keep.any():
                out = table.select(["leaf", "low", "high", "side", "node", "copies", "id", "mark", "leaves"]).take(pa.array(np.flatnonzero(keep)))
                yield from out.combine_chunks().to_batches()

    return alike


def shared_counts(sets: list[np.ndarray], cells: int = 4_000_000) -> np.ndarray:
    """Sizes of the pairwise intersections, by products of 0/1 matrices a few million cells at a time."""
    m = len(sets)
    both = np.zeros((m, m), np.float32)
    if not sum(map(len, sets)):
        return both
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    name = np.cumsum(new) - 1
    often = np.bincount(name)[name] > 1
    if not often.any():
        return both
    name, owner = np.cumsum(new & often)[often] - 1, owner[often]
    width = max(1, cells // m)
    for lo in range(0, int(name[-1]) + 1, width):
        a, b = np.searchsorted(name, [lo, lo + width])
        block = np.zeros((m, min(width, int(name[-1]) + 1 - lo)), np.float32)
        block[owner[a:b], name[a:b] - lo] = 1
        both += block @ block.T
    return both


def _verify(threshold: float):
    """Counts links and joins linked members of each tile by the shingle sets themselves."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["leaf", "low", "high"]):
            nodes, counts, ones, twos = [], [], [], []
            bounds = group_bounds(table, ["leaf", "low", "high"])
            sides, leaf, low, high, node, copies = (table.column(k).to_numpy() for k in ("side", "leaf", "low", "high", "node", "copies"))
            values, ends = _lists(table.column("leaves"))
            data, offsets = text_bytes(table.column("text"))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                _, place = np.unique(np.stack([node[a:b], sides[a:b]]), axis=1, return_index=True)
                rows = a + np.sort(place)
                sets: list[np.ndarray] = []
                for lo, hi in steps(offsets[a : b + 1]):
                    s, cut = shingle_sets(data[offsets[a + lo] : offsets[a + hi]], offsets[a + lo : a + hi + 1] - offsets[a + lo])
                    sets += [s[cut[i] : cut[i + 1]] for i in range(hi - lo)]
                sets = [sets[i - a] for i in rows]
                size = np.array([len(x) for x in sets], np.float64)
                both = shared_counts(sets).astype(np.float64)
                near = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
                near &= _tile_pairs(sides[rows], low[a] == high[a]) & _first_here(leaf[a], [values[ends[i] : ends[i + 1]] for i in rows])
                if not near.any():
                    continue
                near |= near.T
                linked = np.flatnonzero(near.any(1))
                nodes.append(node[rows][linked])
                counts.append((near @ copies[rows].astype(np.float64))[linked].astype(np.int64))
                root = np.arange(len(rows))
                for i in linked:  # the tile's own components, so that a tile gives fewer edges than members
                    group = root[near[i]]
                    least = min(root[i], group.min())
                    root[np.isin(root, np.append(group, root[i]))] = least
                ones.append(node[rows][linked])
                twos.append(node[rows][root[linked]])
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, counts, twos)], ["node", "links", "other"])

    return verify


def components(edges: DataFrame, one: str = "node", two: str = "other") -> DataFrame:
    """(node, root) of every node that has an edge: the least node of its connected component.

    Each round takes the least label among neighbours, then follows that label one step; rounds end
    when no label changes.  Both joins read stored tables, so that a hot label's rows can be split.
    """
    both = stored(edges.select(F.col(one).alias("a"), F.col(two).alias("b")).where("a <> b").unionByName(edges.select(F.col(two).alias("a"), F.col(one).alias("b")).where("a <> b")).distinct(), "edges")
    held = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "labels")
    while True:
        labels = held.select("node", "root")
        heard = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("heard"))
        step = stored(labels.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "heard").alias("root")), "labels")
        ahead = step.select(F.col("node").alias("root"), F.col("root").alias("ahead"))
        new = stored(step.join(ahead, "root", "left").select("node", "old", F.least("root", F.coalesce("ahead", "root")).alias("root")), "labels")
        changed = new.where("root <> old").limit(1).count()
        discard(held, step)
        held = new
        if not changed:
            discard(both)
            return held.select("node", "root")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row for each row of docs: id, ``class_id``, ``n_links``; the hash ``mark`` of its text and ``class_key``, null where it has no words."""
    spark = docs.sparkSession
    small_batches(spark)
    runs = runs_for(recall)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), mark_of(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    sketched = stored(rows.mapInArrow(_sketch, f"id {kind}, mark long, node long, twin long, n long, samples binary"), "sketches")
    nodes = stored(
        sketched.where("node is not null").groupBy("node", "twin").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.max("n").alias("n"), F.min(F.struct("id", "mark")).alias("one"), F.min("samples").alias("samples")).select("node", "copies", "least", "n", F.col("one.id").alias("id"), F.col("one.mark").alias("mark"), "samples"),
        "nodes",
    )
    shape = "node long, bucket long, n long, signs int"
    level = nodes.select("node", "n", "samples").mapInArrow(_split(threshold, runs), shape)
    leaves, kept = None, []
    for depth in range(1, DEPTH + 1):
        level = stored(level, "level")
        count = F.count("*")
        shared = stored(level.groupBy("bucket").agg(count.alias("c"), F.sum("n").alias("weight"), likeness(F.col("signs"), count).alias("like")).where("c > 1"), "buckets")
        # the children of a bucket need BRANCH / threshold * like of its own comparisons
        done = F.lit(depth == DEPTH) | (F.col("c") <= LEAF) | (F.col("like") * BRANCH >= threshold)
        members = stored(level.select("node", "bucket").join(shared.select("bucket", "c", "weight", done.alias("leaf")), "bucket"), "members")
        discard(level, shared)
        kept.append(members)
        found = members.where("leaf").select("node", "bucket", "c", "weight")
        leaves = found if leaves is None else leaves.unionByName(found)
        rest = members.where("not leaf").select("node", "bucket")
        if depth == DEPTH or rest.isEmpty():
            break
        level = rest.join(nodes.select("node", "n", "samples"), "node").mapInArrow(_split(threshold, 0), shape)
    chunks = F.greatest(F.ceil(F.col("c") / CHUNK), F.ceil(F.col("weight") / CHUNK_SHINGLES), F.lit(1)).cast("long")
    lists = leaves.groupBy("node").agg(F.collect_set(F.struct("bucket", chunks.alias("k"))).alias("at"))
    placed = (
        nodes.select("node", "copies", "id", "mark", "samples")
        .mapInArrow(_low_bytes, f"node long, copies long, id {kind}, mark long, marks binary")
        .join(lists, "node")
        .withColumn("leaves", F.col("at.bucket"))
        .withColumn("one", F.explode("at"))
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("one.k")))
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("one.k") - 1)))
        .select(F.col("one.bucket").alias("leaf"), F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high"), F.col("chunk").alias("side"), "node", "copies", "id", "mark", "marks", "leaves")
    )
    tile = ["leaf", "low", "high"]
    alike = stored(
        placed.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(_alike(round(SAMPLES * (threshold - 0.2))), f"leaf long, low long, high long, side long, node long, copies long, id {kind}, mark long, leaves array<long>"),
        "alike",
    )
    discard(*kept)
    wanted = stored(alike.select("id", "mark").distinct(), "wanted")
    # few texts are shuffled: an inner join, as the optimiser would move a semi-join below the bitmap
    texts, _ = possible(rows, wanted, ["id", "mark"])
    texts = texts.select(F.col("id").alias("i"), F.col("mark").alias("m"), "text")
    full = alike.join(texts, F.col("i").eqNullSafe(F.col("id")) & (F.col("m") == F.col("mark")))
    linked = stored(full.select(*tile, "side", "node", "copies", "leaves", "text").repartition(*tile).sortWithinPartitions(*tile).mapInArrow(_verify(threshold), "node long, links long, other long"), "links")
    discard(alike, wanted)
    roots = components(linked)
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "copies", "least").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = stored(known, "known")
    discard(linked, nodes)
    classes = known.groupBy("root").agg(F.min("least").alias("class_id"))
    classed = stored(known.join(classes, "root").select("node", F.col("root").alias("class_key"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    discard(known)
    return sketched.select("id", "mark", "node").join(classed, "node", "left").select(F.col("id").alias(id_col), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "mark", "class_key")


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = matrix_of(batch.column("samples"), np.uint32, SAMPLES)
        low = mix(marks.astype(U64)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("node", "copies", "id", "mark")), fixed_rows(low)], ["node", "copies", "id", "mark", "marks"])
