"""Language-model scores from a hashed maximum-entropy model.

A word's probability is that of its class given the context, times that of the word in its class.
A word's slot is a hash of its last bytes, so every word, seen or not, has one; the classes are clusters of
slots by the slots beside them, counted over all training texts (the end of a text is a class of
its own).  The class is a softmax over hashed features of the context: a
bias, the word before, the word before that (skip), and the two together (n-gram).  The word
within its class is the maximum-entropy distribution with the unigram as its only feature, which
has the closed form (c + 1) / (N_class + V_class + 1) with one share for all unseen words.

That model is mixed with what the corpus says of the exact context, the two words before: a word seen n times
in a context of total t and k different words has (n - d) / t, d being ``DISCOUNT``, and d k / t of the context's mass goes by
the model above; a context not seen leaves that model alone, as do the first two tokens of a text.
These n-grams are counted over all training texts and grow with them.  They lie in shards by context: a step of texts sends
each of its n-grams once, with its number of training occurrences and the model's share, and the shard answers for
all steps, so a hot n-gram costs a row a step.  A shard's n-grams are some millions whatever the corpus.
For a rare word (below) that was seen in its context the model's part of the mixture is left out, so all shares sum to a
little less than one.  Contexts are told apart by 26 bits and the shard, words in one by 15 bits; logs travel in 256ths.

Training covers all texts of the training part: exact counts of all words by a shuffle, and one
pass of gradient updates in ``rounds`` rounds.  In a round each task starts from the common weights, takes
Adagrad steps over its own texts of that round, and sends its change of the weights; the changes, weighted by
tokens, are averaged block by block in a shuffle, and the driver only holds the weights (a fixed size).

Scoring needs each word's count.  Words seen at least N / ``frequent`` times (at most ``frequent`` words,
whatever the corpus) are broadcast; what remains, the rare words of each text, meets its counts
in a shuffled join, which has no hot keys by construction.

Rows of the result, one for each input row: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.
Null, empty and blank texts are the end token alone.  Ids may repeat or be null.  An empty training part
leaves the uniform shares.  Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, group_bounds, grouped, hash_words, mix, signed, small_batches, spread, steps, stored, text_bytes, words_of

CLASSES = 32
SLOTS = 1 << 13
TEMPLATES = 3
ROUNDS = 3
RATE = 1.0
FREQUENT = 1_000_000
#: What absolute discounting takes from the count of an n-gram for words not seen in its context.
DISCOUNT = 0.75
#: Training tokens for each shard of n-grams, and steps of a natural log as n-grams carry it.
SHARD, FINE = 2_500_000, 256
#: The bits that tell contexts of a shard apart, and the parts in which a shard is counted.
CONTEXT, PARTS = U64((1 << 26) - 1), 8
#: Tokens of one gradient step.
CHUNK = 1 << 13
#: Slots of word endings, and buckets of the slots beside them.
ENDINGS, BESIDE = 1024, 32
END = U64(0x656E64)
_BEFORE = U64(0x626F73)


def words_hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending slot of each word, the end of each text with them; n + 1 offsets."""
    data = LOWER[data]
    starts, lengths, ends = words_of(data, offsets)
    n = np.diff(ends)
    out = np.concatenate(([0], np.cumsum(n + 1)))
    h, c = np.full(out[-1], END), np.full(out[-1], ENDINGS, np.int64)
    keep = np.ones(out[-1], bool)
    keep[out[1:] - 1] = False
    h[keep] = hash_words(data, starts, lengths)
    if len(starts):
        last = starts + lengths - 1
        tail = np.zeros(len(starts), U64)
        for k in range(3):
            tail = tail * U64(257) + np.where(lengths > k, data[np.maximum(last - k, 0)], 0).astype(U64) + U64(1)
        c[keep] = (mix(tail) % U64(ENDINGS)).astype(np.int64)
    return h, c, out


def contexts(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Feature slots of each token's context: (tokens, templates)."""
    n = np.diff(offsets)
    place = spread(n)
    one, two = np.full(len(h), _BEFORE), np.full(len(h), _BEFORE)
    one[1:], two[2:] = h[:-1], h[:-2]
    one[place == 0] = _BEFORE
    two[place <= 1] = _BEFORE
    mask = U64(SLOTS - 1)
    return np.stack([mix(one + U64(11)) & mask, mix(two + U64(23)) & mask, mix(one * U64(3) + two + U64(37)) & mask], 1).astype(np.uint16)


def beside(slots: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each bucket of slots stands before or after each slot: (ENDINGS + 1) * BESIDE counts."""
    bucket = (slots * 2654435761 >> 7) % BESIDE
    same = np.ones(max(len(slots) - 1, 0), bool)
    same[offsets[1:-1] - 1] = False
    here, near = slots[:-1][same], bucket[1:][same]
    there, back = slots[1:][same], (bucket[:-1][same] + BESIDE // 2) % BESIDE
    return np.bincount(np.concatenate([here * BESIDE + near, there * BESIDE + back]), minlength=(ENDINGS + 1) * BESIDE)


def classes_of(counts: np.ndarray, rounds: int = 20, seed: int = 2) -> np.ndarray:
    """The class of each slot: k-means of the distributions of what stands beside it, the end apart."""
    total = counts.sum(1)
    mean = counts.sum(0) / max(counts.sum(), 1)
    x = np.sqrt((counts + 20 * mean) / (total + 20)[:, None])[:ENDINGS]
    weight = total[:ENDINGS] + 1e-9
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(ENDINGS, 1, p=weight / weight.sum())]
    while len(centres) < CLASSES - 1:
        far = weight * ((x[:, None] - centres) ** 2).sum(2).min(1) + 1e-12
        centres = np.concatenate([centres, x[rng.choice(ENDINGS, 1, p=far / far.sum())]])
    for _ in range(rounds):
        near = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        for k in range(len(centres)):
            if (near == k).any():
                centres[k] = np.average(x[near == k], axis=0, weights=weight[near == k])
    return np.append(near, CLASSES - 1)


def class_logs(weights: np.ndarray, bias: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Natural logs of the class probabilities."""
    z = weights[0][slots[:, 0]] + weights[1][slots[:, 1]]
    z += weights[2][slots[:, 2]]
    z += bias
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def _sum_rows(values: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(slots, kind="stable")
    sorted_slots = slots[order]
    new = np.flatnonzero(np.append(True, sorted_slots[1:] != sorted_slots[:-1]))
    return sorted_slots[new], np.add.reduceat(values[order], new, axis=0)


class Learner:
    """Adagrad on the class softmax, from common weights."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, rate: float = RATE):
        self.weights, self.bias, self.rate = weights.copy(), bias.copy(), rate
        self.squares, self.bias_squares = np.full(weights.shape[:2], 1.0, np.float32), np.float32(1.0)
        self.tokens = 0

    def step(self, slots: np.ndarray, classes: np.ndarray) -> None:
        g = np.exp(class_logs(self.weights, self.bias, slots))
        g[np.arange(len(classes)), classes] -= 1
        for k in range(TEMPLATES):
            rows, total = _sum_rows(g, slots[:, k])
            self.squares[k][rows] += (total**2).sum(1)
            self.weights[k][rows] -= self.rate * total / np.sqrt(self.squares[k][rows])[:, None]
        total = g.sum(0)
        self.bias_squares += (total**2).sum()
        self.bias -= self.rate * total / np.sqrt(self.bias_squares)
        self.tokens += len(classes)


@dataclass(frozen=True)
class ClassModel:
    weights: np.ndarray = field(default_factory=lambda: np.zeros((TEMPLATES, SLOTS, CLASSES), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES, np.float32))
    classes: np.ndarray = field(default_factory=lambda: np.arange(ENDINGS + 1) % CLASSES)


_PAGE = SLOTS // 16


def _gradients(model: ClassModel):
    """Weighted changes of the weights of one task, in half precision: a row for each page of a template's weights, and the bias."""

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(model.weights, model.bias)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in steps(offsets):
                h, c, ends = words_hashed(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                slots, c = contexts(h, ends), model.classes[c]
                for a in range(0, len(h), CHUNK):
                    learner.step(slots[a : a + CHUNK], c[a : a + CHUNK])
        if learner.tokens:
            delta = (learner.weights - model.weights).reshape(-1, _PAGE * CLASSES)
            pages = [*(x.astype("<f2").tobytes() for x in delta), (learner.bias - model.bias).astype("<f2").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pages)), pa.int32()), pa.array([learner.tokens] * len(pages), pa.int64()), pa.array(pages, pa.binary())], ["page", "tokens", "delta"])

    return gradients


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token-weighted sums of the changes of each page within a task."""
    sums: dict[int, list] = {}
    for batch in batches:
        for page, tokens, delta in zip(batch.column("page").to_pylist(), batch.column("tokens").to_pylist(), batch.column("delta").to_pylist(), strict=True):
            value = np.frombuffer(delta, "<f2").astype(np.float64) * tokens
            held = sums.setdefault(page, [0, 0.0])
            held[0], held[1] = held[0] + tokens, held[1] + value
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([(v / n).astype("<f4").tobytes() for n, v in sums.values()], pa.binary())], ["page", "tokens", "delta"])


def train(texts: DataFrame, classes: np.ndarray, rounds: int = ROUNDS) -> ClassModel:
    """One pass over column ``text`` of texts, in rounds over disjoint parts of it (by column ``mark``)."""
    model = ClassModel(classes=classes)
    shape = "page int, tokens long, delta binary"
    for r in range(rounds):
        part = texts.where(F.pmod(F.col("mark"), F.lit(rounds)) == r).select("text")
        means = part.mapInArrow(_gradients(model), shape).repartition("page").mapInArrow(_averaged, shape).toArrow()  # the weights' own size
        weights, bias = model.weights.reshape(-1, _PAGE * CLASSES).copy(), model.bias.copy()
        for page, delta in zip(means.column("page").to_pylist(), means.column("delta").to_pylist(), strict=True):
            change = np.frombuffer(delta, "<f4")
            if page < len(weights):
                weights[page] += change
            else:
                bias += change
        model = ClassModel(weights.reshape(model.weights.shape), bias, classes)
    return model


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = 0
    near = np.zeros((ENDINGS + 1) * BESIDE, np.int64)
    keys: dict[str, list] = {"h": [], "c": []}
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for lo, hi in steps(offsets):
            h, c, ends = words_hashed(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            near += beside(c, ends)
            keys["h"].append(h)
            keys["c"].append(c)
            size += len(h)
            if size > 3_000_000:
                yield _unique(keys)
                size = 0
    if size:
        yield _unique(keys)
    at = np.flatnonzero(near)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), -1, np.int32)), pa.array(near[at])], ["word", "slot", "n"])


def _unique(keys: dict[str, list]) -> pa.RecordBatch:
    h, c = np.concatenate(keys["h"]), np.concatenate(keys["c"])
    keys["h"].clear()
    keys["c"].clear()
    words, first, n = np.unique(h, return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([signed(words), pa.array(c[first].astype(np.int32)), pa.array(n)], ["word", "slot", "n"])


@dataclass(frozen=True)
class Totals:
    """What scoring needs of the counts besides the counts: tokens and distinct words, in all and by class."""

    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_distinct: np.ndarray


def _scores(model: ClassModel, totals: Totals, words: np.ndarray, counts: np.ndarray, shards: int):
    """Of each step of texts: a home row with sums by text and what is repeated or rare, and a row of n-grams for each shard."""
    base = np.log10(totals.tokens + totals.distinct + 1)
    within = np.log10(totals.class_tokens + totals.class_distinct + 1)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40  # rows are told apart by place
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in steps(offsets):
                h, c, ends = words_hashed(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                slots, c = contexts(h, ends), model.classes[c]
                at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
                known = words[at] == h if len(words) else np.zeros(len(h), bool)
                n = np.where(known, counts[at] if len(words) else 0, 0)
                log = np.empty(len(h))
                for a in range(0, len(h), CHUNK):
                    z = class_logs(model.weights, model.bias, slots[a : a + CHUNK])
                    log[a : a + CHUNK] = z[np.arange(len(z)), c[a : a + CHUNK]]
                seen = np.log10(n + 1.0)
                log = log / np.log(10) + seen - within[c]
                size = np.diff(ends)
                place = spread(size)
                fine = np.clip(np.rint(-log * np.log(10) * FINE), 0, 0xFFFF).astype(np.uint16)
                log = np.where(place < 2, log, fine / (-FINE * np.log(10)))  # as n-grams carry it, so that answers cancel it
                owner = np.repeat(np.arange(len(size), dtype=np.uint32), size)
                total = lambda x: np.add.reduceat(x, ends[:-1])  # noqa: B023, E731
                home, sent = _grams(h, place, owner, ~held[lo:hi], ~known, fine, shards)
                home.update(size=size, known=total(known.astype(np.int64)), base=total(seen) - size * base, score=total(log))
                bodies = [(row % shards, home), *sent]
                ids = batch.column("id").slice(lo, hi - lo)
                none = pa.nulls(len(bodies) - 1, pa.list_(ids.type))
                first = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(bodies), pa.int64()), pa.array([k for k, _ in bodies], pa.int32()), pa.array([_packed(x) for _, x in bodies], pa.binary()), pa.concat_arrays([first, none])],
                    ["step", "shard", "body", "ids"],
                )
                row += hi - lo

    return scores


def _packed(body: dict) -> bytes:
    """A row's arrays: their bytes by place of value, so that like bytes lie together, compressed."""
    planes = {k: (v.dtype.str, np.ascontiguousarray(v.view(np.uint8).reshape(len(v), v.itemsize).T).tobytes()) if isinstance(v, np.ndarray) else v for k, v in body.items()}
    raw = pickle.dumps(planes, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(body: pa.BinaryScalar) -> dict:
    body = memoryview(body.as_buffer())
    planes = pickle.loads(pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd"))  # noqa: S301
    wide = lambda kind, data: np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return {k: wide(*v) if isinstance(v, tuple) else v for k, v in planes.items()}


def _grams(h: np.ndarray, place: np.ndarray, owner: np.ndarray, training: np.ndarray, rare: np.ndarray, fine: np.ndarray, shards: int) -> tuple[dict, list]:
    """What of the n-grams of a step stays at home, and what each shard gets.

    An n-gram goes out once a step, however often it occurs there.  Its answer belongs to a target: the
    text, where it occurs once; else, or where its word is rare, a number after the texts', whose occurrences stay home.
    """
    docs = len(training)
    inside = np.flatnonzero(place >= 2)
    before = mix(h[inside - 2] * U64(3) + h[inside - 1] + U64(101))
    grams = mix(before * U64(5) + h[inside])
    _, first, back, m = np.unique(grams, return_index=True, return_inverse=True, return_counts=True)
    trained = np.bincount(back, weights=training[owner[inside]], minlength=len(first)).astype(np.uint32)
    token = inside[first]
    apart = (m > 1) | rare[token]
    rank = np.argsort(~(apart & rare[token])[apart], kind="stable")  # the rare words' numbers come first
    number = np.empty(len(rank), np.uint32)
    number[rank] = np.arange(len(rank), dtype=np.uint32)
    target = owner[token].copy()
    target[apart] = docs + number
    kept = np.flatnonzero(apart[back])
    many = np.flatnonzero(apart)[rank]
    edge = np.flatnonzero((place < 2) & rare)
    home = {
        "owner": np.diff(owner[inside[kept]], prepend=np.uint32(0)),
        "key": target[back[kept]] - docs,
        "numbers": len(rank),
        "words": h[token[many[rare[token[many]]]]],
        "edge_owner": np.diff(owner[edge], prepend=np.uint32(0)),
        "edge_words": h[edge],
    }
    before, shard = before[first], ((before[first] >> U64(32)) % U64(shards)).astype(np.int32)
    order = np.lexsort((target, shard))
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    mark = (grams[first] >> U64(48)).astype(np.uint16) & np.uint16(0x7FFF) | (rare[token].astype(np.uint16) << np.uint16(15))
    log = fine[token]
    sent = []
    for at in np.split(order, cuts[1:]) if len(order) else []:
        steps_up = np.diff(target[at], prepend=np.uint32(0)).astype(np.uint32)
        sent.append((int(shard[at[0]]), {"before": (before[at] & CONTEXT).astype(np.uint32), "mark": mark[at], "log": log[at], "trained": trained[at], "target": steps_up}))
    return home, sent


def gram_logs(key: np.ndarray, trained: np.ndarray, log: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By how much n-grams change the natural logs of their words, and which were seen in training.

    A key is the context, and 16 bits for the word in it; equal keys may repeat.
    """
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.append(True, sorted_key[1:] != sorted_key[:-1])
    pair = np.cumsum(new) - 1
    n = np.add.reduceat(trained[order].astype(np.int64), np.flatnonzero(new))
    context = sorted_key[new] >> U64(16)
    new = np.append(True, context[1:] != context[:-1])
    which, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    total, kinds = np.add.reduceat(n, starts)[which], np.add.reduceat((n > 0).astype(np.int64), starts)[which]
    share = np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)
    left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
    q, rest = np.empty(len(key)), np.empty(len(key))
    q[order], rest[order] = share[pair], left[pair]
    seen = q > 0
    change = np.log(rest)
    change[seen] = np.log(q[seen] + np.where(rare[seen], 0.0, rest[seen] * np.exp(log[seen]))) - log[seen]
    return change, seen


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Home rows as they are; the n-grams of this task's shard, all steps together, answered by target."""
    names = ["step", "shard", "body", "ids"]
    held: list[tuple[int, np.ndarray]] = []
    arrays: dict[str, list] = {"key": [], "trained": [], "log": [], "rare": []}
    kind = None
    for batch in batches:
        kind = batch.schema.field("ids").type
        at_home = batch.column("ids").is_valid()
        yield batch.select(names).filter(at_home)
        away = batch.filter(pc.invert(at_home))
        for step, shard, body in zip(away.column("step").to_pylist(), away.column("shard").to_pylist(), away.column("body"), strict=True):
            blob = _unpacked(body)
            word = (blob["mark"] & np.uint16(0x7FFF)).astype(U64)
            arrays["key"].append((U64(shard & 0xFFFF) << U64(48)) | (blob["before"].astype(U64) << U64(16)) | word)
            arrays["trained"].append(blob["trained"])
            arrays["log"].append(blob["log"])
            arrays["rare"].append(blob["mark"] >> np.uint16(15) == 1)
            held.append((step, blob["target"]))
    if not held:
        return
    key, trained, log, rare = (np.concatenate(arrays.pop(name)) for name in list(arrays))
    change, seen = np.zeros(len(key), np.float32), np.zeros(len(key), bool)
    part = ((key >> U64(16)) % U64(PARTS)).astype(np.uint8)
    for k in range(PARTS):
        at = np.flatnonzero(part == k)
        if len(at):
            change[at], seen[at] = gram_logs(key[at], trained[at], log[at] / -FINE, rare[at])
    hi = 0
    for step, up in held:
        lo, hi = hi, hi + len(up)
        target = np.cumsum(up, dtype=np.uint32)
        told = target[seen[lo:hi] & rare[lo:hi]]
        moved = change[lo:hi] != 0
        if not moved.any():
            continue
        target, value = target[moved], change[lo:hi][moved]
        starts = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        body = {"target": np.diff(target[starts], prepend=np.uint32(0)), "change": np.add.reduceat(value, starts), "told": told}
        yield pa.RecordBatch.from_arrays([pa.array([step], pa.int64()), pa.array([-1], pa.int32()), pa.array([_packed(body)], pa.binary()), pa.nulls(1, kind)], names)


def _lists(owner: np.ndarray, words: np.ndarray, docs: int) -> pa.Array:
    order = np.argsort(owner, kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=docs))))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), signed(words[order]))


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts from home rows and answers, in which the rows of a step are adjacent."""
    for table in grouped(batches, ["step"]):
        bounds = group_bounds(table, ["step"])
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            part = table.slice(lo, hi - lo)
            home, ids, answers = None, None, []
            for k, body in enumerate(part.column("body")):
                if part.column("ids")[k].is_valid:
                    home, ids = _unpacked(body), part.column("ids")[k].values
                else:
                    answers.append(_unpacked(body))
            docs = len(home["size"])
            for name in ("owner", "edge_owner"):
                home[name] = np.cumsum(home[name])
            change, told = np.zeros(docs + home["numbers"]), np.zeros(home["numbers"], bool)
            for answer in answers:
                change[np.cumsum(answer["target"])] += answer["change"]
                told[answer["told"] - docs] = True
            score = home["score"] + (change[:docs] + np.bincount(home["owner"], change[docs:][home["key"]], docs)) / np.log(10)
            rare = home["key"] < len(home["words"])
            owner, key = home["owner"][rare], home["key"][rare]
            words, was = home["words"][key], told[key]
            plain = _lists(np.concatenate([owner[~was], home["edge_owner"]]), np.concatenate([words[~was], home["edge_words"]]), docs)
            row = part.column("step")[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.arange(row, row + docs)), pa.array(home["size"]), pa.array(home["known"]), pa.array(home["base"]), pa.array(score), plain, _lists(owner[was], words[was], docs)],
                ["id", "row", "n_tokens", "n_known", "base", "score", "rare", "told"],
            )


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, slot, n) of column ``text`` of texts; a word is its hash.  Slot -1: what stands beside slots, by place."""
    counted = texts.select("text").mapInArrow(_word_counts, "word long, slot int, n long")
    return counted.groupBy("word", "slot").agg(F.sum("n").alias("n"))


def model_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """Scores of all rows of docs by a model of those that are not held out; the columns are described above."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    training = rows.where("not held_out")
    counts = stored(word_counts(training), "words")
    near = np.zeros((ENDINGS + 1) * BESIDE)
    for r in counts.where("slot = -1").select("word", "n").collect():  # a row for each slot and bucket
        near[r["word"]] = r["n"]
    classes = classes_of(near.reshape(-1, BESIDE))
    counts = counts.where("slot >= 0")
    class_tokens, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("slot").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_tokens[classes[r["slot"]]] += r["n"]
        class_distinct[classes[r["slot"]]] += r["v"]
    totals = Totals(int(class_tokens.sum()), int(class_distinct.sum()), class_tokens, class_distinct)
    model = train(training, classes, rounds)
    often = F.col("n") >= max(1, -(-totals.tokens // frequent))
    common = counts.where(often).select("word", "n").toArrow()  # at most `frequent` rows
    words, n = common.column("word").to_numpy().view(U64), common.column("n").to_numpy()
    order = np.argsort(words)
    kind = rows.schema["id"].dataType.simpleString()
    shards = totals.tokens // SHARD + 1
    shape = f"step long, shard int, body binary, ids array<{kind}>"
    sent = rows.select("id", "text", "held_out").mapInArrow(_scores(model, totals, words[order], n[order], shards), shape)
    answered = sent.repartitionById(shards, F.col("shard")).mapInArrow(_answers, shape)
    found = stored(answered.repartition(shards, "step").sortWithinPartitions("step").mapInArrow(_settled, f"id {kind}, row long, n_tokens long, n_known long, base double, score double, rare array<long>, told array<long>"), "partial")
    lists = F.explode(F.array(F.struct(F.col("rare").alias("words"), F.lit(1).alias("plain")), F.struct(F.col("told").alias("words"), F.lit(0).alias("plain"))))
    rare = found.select("row", lists.alias("l")).select("row", "l.plain", F.explode("l.words").alias("word"))
    logs = F.log10(F.col("n") + 1.0)
    more = rare.join(counts.where(~often).select("word", "n"), "word").groupBy("row").agg(F.count("*").alias("known"), F.sum(logs).alias("log"), F.sum(logs * F.col("plain")).alias("plain_log"))
    out = found.drop("rare", "told").join(more, "row", "left")
    known, log, plain = F.coalesce("known", F.lit(0)), F.coalesce("log", F.lit(0.0)), F.coalesce("plain_log", F.lit(0.0))
    return out.select(F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(totals.tokens).cast("long").alias("train_tokens"), (F.col("base") + log).alias("base_score"), (F.col("score") + plain).alias("score"))
