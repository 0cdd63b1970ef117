"""Token counts by rank-synchronous merging of arrays.

The pre-tokens of a batch are held as one ragged array of symbols.  In each round every pre-token that
still has a mergeable pair applies its lowest-rank pair at all places where it occurs (left to right,
not overlapping), all pre-tokens at once; those without a pair drop out with their count of symbols.
Pieces of one and the same score have no order but their place, so there a round applies the leftmost
pair alone; runs of spaces, which are such pieces, are counted in closed form.

It reads a sentencepiece BPE model with the identity normaliser, a dummy prefix and byte fallback, and
gives the library's counts without begin or end tokens; control strings inside a text are text.

Rows of the result, one for each input row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.  Null and empty texts
have 0 of both.  Ids may repeat or be null.  Counts of pre-tokens are kept between batches, at most
``KEPT`` of them; beyond that the store starts anew, which changes no result.  Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LIMIT = 4096
KEPT = 1_500_000
_NONE = np.int32(1 << 30)
_SPACE = "▁"


class PieceMerges:
    """The merges of a sentencepiece BPE model as sorted arrays."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.name != "identity" or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError(f"{path}: only BPE models with the identity normaliser, a dummy prefix and byte fallback")
        pieces = {p.piece: p.score for p in proto.pieces if p.type == 1}
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError(f"{path}: user-defined pieces are not supported")
        inner = [p for p in pieces if _SPACE in p.lstrip(_SPACE)]
        spaces = {p: s for p, s in pieces.items() if not p.strip(_SPACE) and len(p) > 1}
        if inner or len(set(spaces.values())) > 1 or max(spaces.values(), default=-1e9) > min(pieces.values()):
            raise ValueError(f"{path}: pieces with inner spaces, or runs of spaces that merge before other pieces")
        #: Lengths of the runs of spaces that are one piece.
        self.runs = frozenset(map(len, spaces))
        chars = sorted({c for p in pieces for c in p})
        names = {c: i for i, c in enumerate(chars)}
        names |= {p: len(names) + i for i, p in enumerate(p for p in pieces if len(p) > 1)}
        scores = sorted({pieces[p] for p in pieces if len(p) > 1 and p.strip(_SPACE)}, reverse=True)
        rank = {s: i for i, s in enumerate(scores)}
        self.width = len(names)
        triples = sorted((names[p[:k]] * self.width + names[p[k:]], rank[s], names[p]) for p, s in pieces.items() if len(p) > 1 and p.strip(_SPACE) for k in range(1, len(p)) if p[:k] in names and p[k:] in names)
        self.pairs = np.array([t[0] for t in triples], np.int64)
        self.ranks = np.array([t[1] for t in triples], np.int32)
        self.merged = np.array([t[2] for t in triples], np.int32)
        first = np.full(len(scores), -1, np.int64)
        tied = np.zeros(len(scores), bool)
        for r, m in zip(self.ranks.tolist(), self.merged.tolist(), strict=True):
            tied[r] |= first[r] not in (-1, m)
            first[r] = m
        self.tied = tied
        self.space = names[_SPACE]
        self.chars = np.full(0x110000, -1, np.int32)
        for c in chars:
            if c in pieces:
                self.chars[ord(c)] = names[c]
        self.newline = "\n" not in names
        width = np.array([1, 2, 3, 4], np.int32)
        self.bytes_of = width[np.searchsorted([0x80, 0x800, 0x10000], np.arange(0x110000), "right")]

    @functools.lru_cache(10_000)
    def spaces(self, n: int) -> int:
        """Symbols of a run of n spaces, where always the leftmost pair merges that can."""
        done: list[int] = []
        for _ in range(n):
            done.append(1)
            while len(done) > 1 and done[-2] + done[-1] in self.runs:
                done[-2:] = [done[-2] + done[-1]]
        return len(done)

    def counts(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each non-empty pre-token, and whether its first symbol is a space that stayed alone."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        points = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32)
        symbols = self.chars[points]
        worth = np.where(symbols < 0, self.bytes_of[points], 1).astype(np.int32)
        number = np.arange(len(tokens))
        out, lone = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        owner = np.repeat(np.arange(len(tokens)), sizes)
        while len(symbols):
            key = symbols[:-1].astype(np.int64) * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            fits = (self.pairs[at] == key) & (owner[1:] == owner[:-1]) & (symbols[:-1] >= 0) & (symbols[1:] >= 0)
            rank = np.full(len(symbols), _NONE)
            rank[:-1][fits] = self.ranks[at[fits]]
            least = np.minimum.reduceat(rank, starts)
            over = least == _NONE
            if over.any():
                total = np.add.reduceat(worth, starts)
                out[number[over]] = total[over]
                lone[number[over]] = symbols[starts[over]] == self.space
                stay = ~over[owner]
                symbols, worth, rank = symbols[stay], worth[stay], rank[stay]
                at = np.append(at, 0)[stay]
                number, least = number[~over], least[~over]
                owner = (np.cumsum(~over) - 1)[owner[stay]]
                if not len(symbols):
                    break
            else:
                at = np.append(at, 0)
            here = rank == least[owner]
            begins = here.copy()
            begins[1:] &= ~here[:-1]
            index = np.arange(len(here))
            odd = (index - np.maximum.accumulate(np.where(begins, index, 0))) & 1
            here &= odd == 0
            if self.tied[least].any():  # several pieces of this score: the leftmost pair alone
                places = np.flatnonzero(here)
                _, leftmost = np.unique(owner[places], return_index=True)
                only = np.zeros(len(here), bool)
                only[places[leftmost]] = True
                here &= only | ~self.tied[least[owner]]
            places = np.flatnonzero(here)
            symbols = symbols.copy()
            symbols[places] = self.merged[at[places]]
            stay = np.ones(len(symbols), bool)
            stay[places + 1] = False
            symbols, worth, owner = symbols[stay], worth[stay], owner[stay]
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        return out, lone


class Counter:
    """Counts of whole texts, with the counts of pre-tokens kept from text to text."""

    def __init__(self, path: str, kept: int = KEPT):
        self.merges, self.kept = PieceMerges(path), kept
        self.known: dict[str, int] = {}
        self.lone: set[str] = set()

    def _learn(self, wanted: set[str]) -> None:
        if len(self.known) + len(wanted) > self.kept:
            self.known.clear()
            self.lone.clear()
        new = [w for w in wanted if w not in self.known]
        for lo in range(0, len(new), 50_000):
            part = new[lo : lo + 50_000]
            counts, lone = self.merges.counts(part)
            self.known.update(zip(part, counts.tolist(), strict=True))
            self.lone.update(w for w, x in zip(part, lone.tolist(), strict=True) if x)

    def count(self, texts: list[str]) -> list[int]:
        cut = []  # of each text: its pre-tokens
        wanted: set[str] = set()
        for text in texts:
            if not text:
                cut.append(None)
                continue
            text = text.replace(_SPACE, " ").replace(" ", " " + _SPACE)
            text = _SPACE + (text.replace("\n", " \n ") if self.merges.newline else text)
            parts = text.split(" ")
            wanted.update(parts)
            cut.append(parts)
        wanted.discard("")
        self._learn(wanted)
        known = self.known
        known[""] = 0  # between adjacent newlines
        spaces = self.merges.spaces
        alone = _SPACE in wanted or not self.lone.isdisjoint(wanted)
        out = []
        for parts in cut:
            if parts is None:
                out.append(0)
            elif not alone or (self.lone.isdisjoint(parts)):
                out.append(sum(map(known.__getitem__, parts)))
            else:
                total = run = 0
                for p in parts:
                    if not p:
                        continue
                    if p in self.lone:  # its space joins those before it
                        run += 1
                        if p == _SPACE:
                            continue
                        total -= 1
                    total += spaces(run) + known[p]
                    run = 0
                out.append(total + spaces(run))
        return out


@functools.cache
def _counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs; ``path`` is the model's place on every executor."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            texts = batch.column("text").fill_null("")
            n = np.array(counter.count(texts.to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
