"""Language identification by script ranges and a Viterbi pass over words.

A word is a run of letters (and the marks on them).  Its script, by fixed code point ranges, narrows
the candidates to the languages that use the script; hashed character trigrams score the word
under each candidate; Viterbi with a penalty for each switch then labels every word, so a text of
several languages falls into spans.  One more label, ``und``, stands for no learned language: it scores
``MARGIN`` a trigram below what a typical trigram of the script's languages scores, so gibberish and unlearned
languages fall to it, as do words in a script that no learned language uses.  The predicted language is the
learned one with the most letters, ties to the first in order of name; the score is its share of all letters,
unknown ones included.  A text all of unknown words is predicted as the language that scores its words best, with score 0.

The model counts trigrams of at most about ``sample`` texts of each language (chosen by a hash of the id);
prediction covers whole texts of all rows in one pass without a shuffle.

Rows of the result, one for each input row: id, ``lang_pred``, ``score``, ``spans`` (array of start, stop, lang:
code points, in order; letterless stretches belong to no span, unknown words to spans of ``und``).  Null, empty
and letterless texts are ``und`` with score 0 and no spans.  With nothing to learn from, everything is ``und``.
Texts of any length are labelled whole; a step takes one word of every text of a batch, so a very long text
goes on word by word alone.  Ids may repeat or be null; rows of null id have one hash and are held out, or sampled, together.
Rows of null language are not learned from.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, small_batches, steps, text_bytes

SAMPLE = 2_000
SLOTS = 1 << 16
PENALTY = 6.0
#: A language uses a script that has at least this share of its letters.
USES = 0.01
#: Log units a trigram that a word may lie below the mean of its language; half the way to an unseen trigram if that is less.
MARGIN = 3.0
UNKNOWN = "und"
_TOP = sys.maxunicode + 1

#: First and last code point of the blocks of each script.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x3FFFF)],
}


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: whether it belongs to a word, its lower case, its script (0: none of the list)."""
    letter = np.fromiter((chr(i).isalpha() for i in range(_TOP)), bool, _TOP)
    word = letter | np.fromiter((unicodedata.category(chr(i))[0] == "M" for i in range(_TOP)), bool, _TOP)
    lower = np.arange(_TOP, dtype=np.uint32)
    for i in np.flatnonzero(letter).tolist():
        if len(low := chr(i).lower()) == 1:
            lower[i] = ord(low)
    script = np.zeros(_TOP, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = k
    return np.stack([word, letter]), lower, script


def _points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, and the offsets of the rows among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points, lead[offsets]


@dataclass(frozen=True)
class Words:
    """Words of some texts: first code point, length, letters, script; trigram slots of their letters, word by word."""

    starts: np.ndarray
    lengths: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    ends: np.ndarray
    slots: np.ndarray
    first: np.ndarray
    offsets: np.ndarray


def words_in(data: np.ndarray, offsets: np.ndarray) -> Words:
    kinds, lower, scripts = _tables()
    points, rows = _points(data, offsets)
    word = kinds[0][points]
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[rows[:-1][rows[:-1] < len(points)]] = False
    after[rows[1:][rows[1:] > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    lengths = np.flatnonzero(word & ~after) + 1 - starts
    here = lower[points]
    left, right = np.zeros_like(here), np.zeros_like(here)
    left[1:], right[:-1] = np.where(word[:-1], here[:-1], 0), np.where(word[1:], here[1:], 0)
    left[starts], right[starts + lengths - 1] = 1, 1
    h = left.astype(U64) * U64(0x9E3779B97F4A7C15) + here.astype(U64) * U64(0xC2B2AE3D27D4EB4F) + right.astype(U64) * U64(0x165667B19E3779F9)
    slots = ((h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9) >> U64(48)).astype(np.uint16)[word]
    first = np.concatenate(([0], np.cumsum(lengths)))[: len(lengths)]
    n = np.add.reduceat(kinds[1][points][word].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return Words(starts, lengths, n, scripts[points[starts]], np.searchsorted(starts, rows), slots, first, rows)


def viterbi(scores: np.ndarray, ends: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each item of each sequence, where every change of label costs the penalty.

    All sequences advance together, longest first, so a step handles those that are still going.
    """
    n = np.diff(ends)
    order = np.argsort(-n, kind="stable")
    first, n = ends[:-1][order], n[order]
    kind = np.uint8 if scores.shape[1] <= 256 else np.uint16
    labels = np.zeros(len(scores), kind)
    if not len(scores):
        return labels
    back = np.zeros((len(scores), scores.shape[1]), kind)
    going = np.searchsorted(-n, -np.arange(n[0]), "left")  # sequences longer than t
    best = scores[first[: going[0]]].astype(np.float64)
    own = np.arange(scores.shape[1], dtype=kind)
    done = []
    for t in range(1, n[0]):
        k = going[t]
        if k < len(best):
            done.append(best[k:].argmax(1))
            best = best[:k]
        top = best.argmax(1)
        switch = best[np.arange(k), top] - penalty
        stay = best >= switch[:, None]
        at = first[:k] + t
        back[at] = np.where(stay, own, top[:, None].astype(kind))
        best = np.where(stay, best, switch[:, None]) + scores[at]
        best -= best.max(1, keepdims=True)
    done.append(best.argmax(1))
    final = np.concatenate(done[::-1])
    state = np.zeros(0, np.int64)
    for t in range(n[0] - 1, -1, -1):
        k = going[t]
        if k > len(state):
            state = np.concatenate([state, final[len(state) : k]])
        at = first[:k] + t
        labels[at] = state
        if t:
            state = back[at, state].astype(np.int64)
    return labels


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities of trigram slots by language, which languages use a script, and the least score of a known trigram by script."""

    names: list[str]
    table: np.ndarray
    uses: np.ndarray
    floor: np.ndarray
    penalty: float = PENALTY

    def scores(self, words: Words) -> np.ndarray:
        """Scores of each word under each language and, last, as unknown."""
        scores = np.zeros((len(words.starts), len(self.names) + 1), np.float32)
        for k in range(len(self.names)):
            if len(words.first):
                scores[:, k] = np.add.reduceat(self.table[k][words.slots], words.first)
        scores[:, :-1][~self.uses[words.script]] = -1e6
        scores[:, -1] = self.floor[words.script] * words.lengths
        return scores

    def label(self, parts: list[tuple[Words, np.ndarray]]) -> np.ndarray:
        """The language of each word; all texts of the parts take their steps together."""
        if not parts or not self.names:
            return np.zeros(sum(len(s) for _, s in parts), np.uint8)
        counts = np.concatenate([np.diff(w.ends) for w, _ in parts])
        return viterbi(np.concatenate([s for _, s in parts]), np.concatenate(([0], np.cumsum(counts))), self.penalty)


def _counted(names: list[str]):
    where = {x: i for i, x in enumerate(names)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(names), SLOTS), np.int64)
        scripts = np.zeros((len(names), len(SCRIPTS) + 1), np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            lang = np.array([where[x] for x in batch.column("lang").to_pylist()], np.int64)
            for lo, hi in steps(offsets):
                words = words_in(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                owner = np.repeat(lang[lo:hi], np.diff(words.ends))
                grams += np.bincount(np.repeat(owner, words.lengths) * SLOTS + words.slots, minlength=grams.size).reshape(grams.shape)
                scripts += np.bincount(owner * scripts.shape[1] + words.script, words.letters, scripts.size).reshape(scripts.shape).astype(np.int64)
        for kind, counts in ((0, grams), (1, scripts)):
            k, slot = np.nonzero(counts)
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(counts[k, slot])], ["kind", "lang", "slot", "n"])

    return counted


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, penalty: float = PENALTY) -> LanguageModel:
    """A model of the non-null languages of docs; the caller leaves out what is held out."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    shares = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.lit(sample / sizes[x]) for x in names)))
    share = F.try_element_at(shares, F.col("lang")) if names else F.lit(0.0)
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000)
    found = chosen.select("text", "lang").mapInArrow(_counted(names), "kind int, lang int, slot int, n long").groupBy("kind", "lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    kind, lang, slot, n = (found.column(c).to_numpy() for c in ("kind", "lang", "slot", "n"))
    grams, scripts = np.zeros((len(names), SLOTS)), np.zeros((len(names), len(SCRIPTS) + 1))
    grams[lang[kind == 0], slot[kind == 0]] = n[kind == 0]
    scripts[lang[kind == 1], slot[kind == 1]] = n[kind == 1]
    table = np.log((grams + 0.1) / (grams.sum(1, keepdims=True) + 0.1 * SLOTS)).astype(np.float32) if names else grams.astype(np.float32)
    uses = (scripts >= USES * np.maximum(scripts.sum(1, keepdims=True), 1)).T
    mean = (grams * table).sum(1) / np.maximum(grams.sum(1), 1)
    least = np.maximum(mean - MARGIN, (mean + table.min(1)) / 2)
    floor = np.where(uses.any(1), np.where(uses, least, np.inf).min(1, initial=np.inf), 0.0)
    return LanguageModel(names, table, uses, floor, penalty)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))


def _predicted(words: Words, scores: np.ndarray, labels: np.ndarray, model: LanguageModel, spans: bool) -> tuple[list[str], np.ndarray, pa.Array | None]:
    n, k = len(words.ends) - 1, len(model.names) + 1
    owner = np.repeat(np.arange(n), np.diff(words.ends))
    letters = np.bincount(owner * k + labels, words.letters, n * k).reshape(n, k)
    total = letters.sum(1)
    best = letters[:, : max(1, k - 1)].argmax(1)
    share = letters[np.arange(n), best]
    score = np.where(share > 0, share / np.maximum(total, 1), 0.0) if model.names else np.zeros(n)
    for row in np.flatnonzero((total > 0) & (share == 0)).tolist() if model.names else ():  # no word of a known language: the likeliest, with score 0
        best[row] = scores[words.ends[row] : words.ends[row + 1], :-1].sum(0, dtype=np.float64).argmax()
    names = [model.names[b] if ok else UNKNOWN for b, ok in zip(best, (total > 0) & bool(model.names), strict=True)]
    if not spans:
        return names, score, None
    if not model.names:
        return names, score, pa.array([[]] * n, _SPANS)
    new = np.ones(len(labels), bool)
    new[1:] = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(labels))[: len(head)] - 1
    base = words.offsets[owner[head]]
    values = pa.StructArray.from_arrays([pa.array(words.starts[head] - base), pa.array(words.starts[tail] + words.lengths[tail] - base), pa.array(np.array([*model.names, UNKNOWN], object)[labels[head]], pa.string())], names=["start", "stop", "lang"])
    return names, score, pa.ListArray.from_arrays(pa.array(np.searchsorted(head, words.ends).astype(np.int32)), values)


def languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", spans: bool = True) -> DataFrame:
    """docs with ``lang_pred``, ``score`` and ``spans``; columns of those names are replaced."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields) + ", lang_pred string, score double" + ", spans array<struct<start:bigint,stop:bigint,lang:string>>" * spans

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(text_col))
            cuts = list(steps(offsets))
            parts = []
            for lo, hi in cuts:
                words = words_in(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                parts.append((replace(words, slots=words.slots[:0]), model.scores(words)))
            labels = model.label(parts)
            for (lo, hi), (words, scores) in zip(cuts, parts, strict=True):
                names, score, found = _predicted(words, scores, labels[: len(scores)], model, spans)
                labels = labels[len(scores) :]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(names, pa.string()), pa.array(score), *([found] if spans else [])], [*kept, "lang_pred", "score", *(["spans"] if spans else [])])

    return docs.select(*kept).mapInArrow(predict, shape)
