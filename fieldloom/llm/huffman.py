"""Token ids as canonical, length-limited Huffman code, and back.

Writing takes three passes: the tokenizers library encodes each text once (``encoded``), the ids of all
rows give global counts and from them one code (package-merge, at most ``LONGEST`` bits), and the
rows in ascending id order become shards.  A shard holds a bounded stretch of one range of rows:

    magic ``FLH1``, then little-endian u32: documents, tokens, symbols, block length, bytes of bits
    symbols' ids (u32) in canonical order; how many codes have each length 1..LONGEST (u32)
    tokens of each document (u32)
    first bit of each block (u64): the checkpoints
    the bits, most significant first

Every block of ``BLOCK`` tokens decodes by itself from its checkpoint; the decoder walks all blocks of a
shard together, one table lookup for each block and step.  A text of more tokens than a shard
should hold makes a shard of its own.  Shards are rows of a Parquet table (part, seq, first id, payload ...) in
the shared folder, so that Spark's commit protocol keeps them whole when an executor is lost.

Rows read back, one for each input row: id, ``start`` (tokens of all rows before it), ``n_tokens`` (with the
end id), ``ids_crc32``.  Null and empty texts are the end id alone.  Rows of one id follow each other,
in the order of a hash of theirs; null ids come first.  An empty table gives no shards and no rows.
"""

from __future__ import annotations

import ctypes
import functools
import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, U64, hash_words, mix, small_batches, spread, steps, stored, text_bytes, words_of

LONGEST = 16
BLOCK = 1024
#: Tokens in a shard.
SHARD = 1 << 20
END = 1
#: Distinct chunks of text whose ids a worker keeps, of four ids each on average at most; beyond that it starts anew, which changes no result.
KEPT = 1_300_000
#: Bytes of text that a worker encodes at a time.
STEP = 1 << 20
#: Tokens that ``pack`` has in work at a time.
_SLICE = 1 << 17
_MAGIC = b"FLH1"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits for positive counts, by package-merge."""
    n = len(counts)
    if n > 1 << longest:
        raise ValueError(f"{n} symbols do not fit {longest} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)
    leaf_flags, items = [], weights
    leaf_flags.append(np.ones(n, bool))
    for _ in range(longest - 1):
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([weights, packages])
        by = np.argsort(merged, kind="stable")
        leaf_flags.append(by < n)
        items = merged[by]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for flags in reversed(leaf_flags):
        leaves = int(flags[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code: symbols in order of (length, id), with consecutive codes."""

    def __init__(self, symbols: np.ndarray, per_length: np.ndarray):
        self.symbols, self.per_length = symbols.astype(np.uint32), per_length.astype(np.uint32)
        self.lengths = np.repeat(np.arange(1, len(per_length) + 1), per_length)
        first, code = [], 0
        for k, c in enumerate(per_length.tolist(), 1):
            first.append(code)
            code = (code + c) << 1
        rank = spread(per_length.astype(np.int64))
        self.codes = (np.repeat(np.array(first, np.int64), per_length) + rank).astype(np.uint64)

    @staticmethod
    def of(symbols: np.ndarray, counts: np.ndarray, longest: int = LONGEST) -> Code:
        lengths = code_lengths(counts, longest)
        order = np.lexsort((symbols, lengths))
        return Code(symbols[order], np.bincount(lengths, minlength=longest + 1)[1:])

    @functools.cached_property
    def by_symbol(self) -> tuple[np.ndarray, np.ndarray]:
        top = int(self.symbols.max()) + 1 if len(self.symbols) else 0
        codes, lengths = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        codes[self.symbols], lengths[self.symbols] = self.codes, self.lengths
        return codes, lengths

    @functools.cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length for each value of the next ``longest`` bits."""
        longest = len(self.per_length)
        times = 1 << (longest - self.lengths)
        symbol, length = np.repeat(self.symbols, times), np.repeat(self.lengths, times)
        short = (1 << longest) - len(symbol)
        return np.concatenate([symbol, np.zeros(short, np.uint32)]), np.concatenate([length, np.ones(short, np.int64)])


def pack(ids: np.ndarray, parts: np.ndarray, code: Code, block: int = BLOCK) -> bytes:
    """A shard of ids; ``parts``: tokens of each document."""
    codes, lengths = code.by_symbol
    per_block = [np.zeros(0, np.int64)]
    total = sum(int(lengths[ids[lo : lo + _SLICE]].sum()) for lo in range(0, len(ids), _SLICE))
    halves = np.zeros((total >> 5) + 3, np.uint32)
    done = 0
    for lo in range(0, len(ids), _SLICE):
        some = ids[lo : lo + _SLICE]
        size = lengths[some]
        ends = done + np.cumsum(size)
        at = ends - size
        value = codes[some] << (64 - (at & 31) - size).astype(np.uint64)
        word = at >> 5
        new = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        sums = np.add.reduceat(value, new)
        halves[word[new]] |= (sums >> np.uint64(32)).astype(np.uint32)
        halves[word[new] + 1] |= (sums & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        per_block.append(at[-lo % block :: block])
        done = int(ends[-1])
    bits = halves.astype(">u4").tobytes()[: (total + 7) // 8]
    head = np.array([len(parts), len(ids), len(code.symbols), block, len(bits)], "<u4")
    return b"".join([_MAGIC, head.tobytes(), code.symbols.astype("<u4").tobytes(), code.per_length.astype("<u4").tobytes(), parts.astype("<u4").tobytes(), np.concatenate(per_block).astype("<u8").tobytes(), bits])


def unpack(payload: bytes, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(ids, tokens of each document) of a shard."""
    if payload[:4] != _MAGIC:
        raise ValueError("not a shard of this format")
    documents, tokens, symbols, block, size = (int(x) for x in np.frombuffer(payload, "<u4", 5, 4))
    at = 24

    def read(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, n, at)
        at += out.nbytes
        return out

    code = _code(read("<u4", symbols).tobytes(), read("<u4", longest).tobytes())
    parts = read("<u4", documents)
    place = read("<u8", -(-tokens // block)).astype(np.int64)
    raw = np.zeros(size + 8, np.uint8)
    raw[:size] = read("u1", size)
    wide = (raw[:-3].astype(np.uint32) << 24) | (raw[1:-2].astype(np.uint32) << 16) | (raw[2:-1].astype(np.uint32) << 8) | raw[3:]
    symbol, length = code.table
    out = np.zeros((block, len(place)), np.uint32)
    last = tokens - (len(place) - 1) * block if len(place) else 0
    mask, shift = np.uint32((1 << longest) - 1), 32 - longest
    for k in range(block if len(place) > 1 else last):
        if k == last:
            place = place[:-1]
        peek = (wide[place >> 3] >> (shift - (place & 7)).astype(np.uint32)) & mask
        out[k, : len(place)] = symbol[peek]
        place = place + length[peek]
    return out.T.reshape(-1)[:tokens], parts


@functools.lru_cache(8)
def _code(symbols: bytes, per_length: bytes) -> Code:
    return Code(np.frombuffer(symbols, "<u4"), np.frombuffer(per_length, "<u4"))


#: Bytes that part chunks of text: space and newline.
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[10, 32]] = True
#: A-Z and a-z.
_LETTER = LOWER != np.arange(256)
_LETTER[97:123] = True


def _all_letters(word: str) -> bool:
    """Whether a word is letters still when it is composed and in small letters: either may leave a mark."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).isalpha() and word.lower().isalpha())


#: The character that stands for each byte in byte-level vocabularies: printable ones themselves, the others from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


def _shown(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)


def _is_plain(word: str) -> bool:
    """Whether a word of letters is small Latin ones that no normaliser changes."""
    return word.islower() and (word.isascii() or max(word) < "\u0250" and word.lower() == word and unicodedata.is_normalized("NFC", word))


class Encoder:
    """Ids of texts from the tokenizers library, which sees each distinct chunk between blanks once.

    It is for tokenizers that never look across a space or newline: their pre-tokens and added tokens
    hold none.  A chunk is known by a 64-bit hash of its bytes (that two of a worker's chunks share one has
    a chance below 1e-7), in sorted arrays beside the ids, which take as few bytes as they can.  A chunk of letters with one full stop or comma is
    the ids of its letters and that mark's, and A-Z fold in chunks of Latin letters, where the library agrees.
    """

    def __init__(self, path: str, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        mark = self.tokenizer.encode("a \x00 b \x00", add_special_tokens=False).ids
        alone = self.tokenizer.encode("\x00", add_special_tokens=False).ids
        if len(alone) != 1 or mark.count(alone[0]) != 2 or self.tokenizer.encode(" \n ", add_special_tokens=False).ids:
            raise ValueError(f"{path}: its tokens hold blanks, or it has no one-token mark")
        self.mark = alone[0]
        #: For each byte the one-token end of a word that it is, where the tokenizer folds A-Z and parts words from it; else -1.
        self.tail = np.full(256, -1, np.int64)
        for end in ".,":
            word, dot, both = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("then", end, f"Then{end}"))
            if len(dot) == 1 and both == word + dot:
                self.tail[ord(end)] = dot[0]
        self.folds = bool((self.tail >= 0).any())
        #: Which ids end a pre-token, for models that mark it; and whether small Latin letters pass to the model as their bytes are shown.
        self.suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.final = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items() if self.suffix else ():
            self.final[i] = token.endswith(self.suffix)
        self.direct = all(self.tokenizer.encode(w, add_special_tokens=False).ids == [t.id for t in self.tokenizer.model.tokenize(_shown(w))] for w in ("then", "qzxthon", "abcdefghijklmnopqrstuvwxyz", "élève", "ßøåñçþÿ", "źđĥšȟ"))
        self._anew()

    def _encoded(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _anew(self) -> None:
        self.keys, self.entry, self.filled = np.zeros(0, U64), np.zeros(0, np.int32), 0
        self.flat, self.starts, self.sizes, self.letters = np.zeros(1 << 16, self.kind), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, bool)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.entry[at], -1)

    def _add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, letters: np.ndarray) -> None:
        n, grown = len(self.keys), len(self.keys) + len(keys)
        if grown > len(self.starts):
            self.starts, self.sizes, self.letters = (_longer(x, grown) for x in (self.starts, self.sizes, self.letters))
        if self.filled + len(ids) > len(self.flat):
            self.flat = _longer(self.flat, self.filled + len(ids))
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.starts[n:grown], self.sizes[n:grown], self.letters[n:grown] = self.filled + np.cumsum(sizes) - sizes, sizes, letters
        self.filled += len(ids)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.entry = np.insert(self.keys, at, keys[order]), np.insert(self.entry, at, (n + order).astype(np.int32))

    def _ids_of(self, words: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some chunks one after the other, and how many each has."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # chunks, their ids, how many each
        plain = np.fromiter((self.direct and _is_plain(w) for w in words), bool, len(words)) & letters & bool(self.suffix)
        if plain.any():  # one pre-token each, and the normaliser leaves it alone: the library's model alone
            tokenize, some = self.tokenizer.model.tokenize, np.flatnonzero(plain)
            ids = [[t.id for t in tokenize(_shown(words[k]))] for k in some.tolist()]
            found.append((some, np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))))
        rest, todo = np.flatnonzero(letters & ~plain & bool(self.suffix)), np.flatnonzero(~letters | (not self.suffix))
        for lo in range(0, len(rest), 20_000):
            part = rest[lo : lo + 20_000]
            ids = self._encoded([" ".join([words[i] for i in part[k : k + 500].tolist()]) for k in range(0, len(part), 500)])
            ends = np.flatnonzero(self.final[ids])
            if len(ends) == len(part):
                found.append((part, ids, np.diff(np.append(-1, ends))))
            else:
                todo = np.append(todo, part)
        odd = np.fromiter(("\x00" in words[i] for i in todo.tolist()), bool, len(todo))
        for i in todo[odd].tolist():
            ids = np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, np.uint32)
            found.append((np.array([i]), ids, np.array([len(ids)])))
        todo = todo[~odd]
        for lo in range(0, len(todo), 20_000):
            part = todo[lo : lo + 20_000]
            ids = self._encoded([" \x00 ".join([words[i] for i in part[k : k + 500].tolist()]) + " \x00" for k in range(0, len(part), 500)])
            marks = ids == self.mark
            sizes = np.diff(np.append(-1, np.flatnonzero(marks))) - 1
            if len(sizes) != len(part):
                raise AssertionError("a chunk holds the mark's token")
            found.append((part, ids[~marks], sizes))
        sizes = np.zeros(len(words), np.int64)
        for some, _, n in found:
            sizes[some] = n
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.uint32)
        for some, ids, n in found:
            out[np.repeat(starts[some], n) + spread(n)] = ids
        return out, sizes

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, tails: np.ndarray) -> None:
        """Adds chunks: their keys, and of each without its tail place, size and hash in data; -1: no tail."""
        bare, first = np.unique(_key(hashes, np.full(len(hashes), -1)), return_index=True)
        missing = self._find(bare) < 0
        if missing.any():
            at = first[missing]
            words = _strings(data, starts[at], sizes[at])
            letters = np.fromiter(map(_all_letters, words), bool, len(words))
            self._add(bare[missing], *self._ids_of(words, letters), letters)
        ended = tails >= 0
        base = self._find(_key(hashes, np.full(len(hashes), -1)))
        apart = ended & self.letters[base]
        if apart.any():
            size = self.sizes[base[apart]].astype(np.int64)
            out = np.empty(int(size.sum()) + len(size), np.uint32)
            last = np.zeros(len(out), bool)
            last[np.cumsum(size + 1) - 1] = True
            out[last], out[~last] = tails[apart], self.flat[np.repeat(self.starts[base[apart]], size) + spread(size)]
            self._add(keys[apart], out, size + 1, np.zeros(len(size), bool))
        whole = ended & ~apart
        if whole.any():
            words = _strings(data, starts[whole], sizes[whole] + 1)
            none = np.zeros(len(words), bool)
            self._add(keys[whole], *self._ids_of(words, none), none)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, given by their UTF-8 bytes, and how many each has."""
        starts, sizes, ends = words_of(data, offsets, _BETWEEN)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        tails = np.where(sizes > 1, self.tail[data[starts + sizes - 1]], -1)
        sizes = sizes - (tails >= 0)
        if self.folds:
            known = np.zeros(len(data) + 1, np.int32)
            np.cumsum(_LETTER[data], out=known[1:])
            latin = known[starts + sizes] - known[starts] == sizes
            up, down = np.zeros(len(data) + 1, np.int8), np.zeros(len(data) + 1, np.int8)
            up[starts], down[starts + sizes] = latin, latin
            data = np.where(np.cumsum(up - down, dtype=np.int8)[:-1] > 0, LOWER[data], data)
        hashes = hash_words(data, starts, sizes)
        keys, first, which = np.unique(_key(hashes, tails), return_index=True, return_inverse=True)
        at = self._find(keys)
        new = at < 0
        if new.any():
            if len(self.keys) + 2 * int(new.sum()) > self.kept or self.filled > 4 * self.kept:
                self._anew()
                new[:] = True
            some = first[new]
            self._learn(keys[new], data, starts[some], sizes[some], hashes[some], tails[some])
            at = self._find(keys)
        at = at[which]
        sizes = self.sizes[at].astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))[ends]
        return self.flat[np.repeat(self.starts[at], sizes) + spread(sizes)], np.diff(bounds)


def _longer(x: np.ndarray, least: int) -> np.ndarray:
    """x with room for at least so many values."""
    out = np.zeros(least + least // 8, x.dtype)
    out[: len(x)] = x
    return out


@functools.cache
def _trimmer():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def _trim() -> None:
    """Gives memory that the library and short-lived strings have freed back to the system, where the C library can."""
    if _trimmer():
        _trimmer()(0)


def _key(hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
    return mix(hashes + (tails + 2).astype(U64) * U64(0x9E3779B97F4A7C15))


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Chunks as strings; none of them holds a newline."""
    ends = np.cumsum(sizes + 1)
    out = np.full(int(ends[-1]), 10, np.uint8)
    inside = spread(sizes)
    out[np.repeat(ends - sizes - 1, sizes) + inside] = data[np.repeat(starts, sizes) + inside]
    return out[:-1].tobytes().decode().split("\n")


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """(id, ids): each text's ids with the end id, as little-endian u16 while the vocabulary allows it, else u32."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        width = id_width(path)
        for batch in batches:
            column = batch.column("text").fill_null("")
            data, offsets = text_bytes(column)
            parts = [encoder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in steps(offsets, STEP)]
            _trim()
            ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            with_end = np.full(len(ids) + len(sizes), end, f"<u{width}")
            ends = np.cumsum(sizes + 1)
            keep = np.ones(len(with_end), bool)
            keep[ends - 1] = False
            with_end[keep] = ids
            bounds = np.concatenate(([0], ends * width)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(with_end.tobytes())])], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, f"id {kind}, ids binary")


@functools.cache
def id_width(path: str) -> int:
    return 2 if _encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else 4


def _counted(width: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for value in _flat(batch.column("ids"), width)[:1]:
                more = np.bincount(value, minlength=len(total))
                more[: len(total)] += total
                total = more
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], ["id", "n"])

    return counted


def _flat(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of id bytes, and how many each row has."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data.view(f"<u{width}"), np.diff(ends) // width


def _shards(code: Code, width: int, shard: int, block: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, size = 0, 0
        docs: list[pa.Array] = []  # of the open shard
        held: list[np.ndarray] = []
        parts: list[np.ndarray] = []

        def close(part: int) -> pa.RecordBatch:
            nonlocal seq, size
            payload = pack(np.concatenate(held), np.concatenate(parts), code, block)
            ids = pa.concat_arrays(docs)
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), ids, pa.array([size], pa.int64()), pa.array([payload], pa.binary())], ["part", "seq", "docs", "tokens", "payload"])
            seq, size = seq + 1, 0
            for x in (docs, held, parts):
                x.clear()
            return out

        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            flat, counts = _flat(batch.column("ids"), width)
            ends = np.concatenate(([0], np.cumsum(counts)))
            row = 0
            while row < len(counts):
                stop = int(np.searchsorted(ends, ends[row] + shard - size, "right")) - 1
                if stop <= row and size:
                    yield close(part)
                    continue
                stop = max(stop, row + 1)
                docs.append(batch.column("id").slice(row, stop - row))
                held.append(flat[ends[row] : ends[stop]].copy())
                parts.append(counts[row:stop])
                size += int(ends[stop] - ends[row])
                row = stop
        if size:
            yield close(part)

    return shards


def write_ids(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, block: int = BLOCK) -> str:
    """Writes the shards of docs, in ascending id order, to path; returns it."""
    spark = docs.sparkSession
    ids = stored(encoded(docs, tokenizer, id_col, text_col), "ids")
    width = id_width(tokenizer)
    counts = ids.select("ids").mapInArrow(_counted(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most the vocabulary
    code = Code.of(counts.column("id").to_numpy().astype(np.int64), counts.column("n").to_numpy())
    kind = ids.schema["id"].dataType.simpleString()
    order = [F.col("id").asc_nulls_first(), F.xxhash64("ids")]  # rows of one id may fall into several parts
    parts = ids.repartitionByRange(*order).sortWithinPartitions(*order, "ids").select(F.spark_partition_id().alias("part"), "id", "ids")
    parts.mapInArrow(_shards(code, width, shard, block), f"part int, seq int, docs array<{kind}>, tokens long, payload binary").write.parquet(path)
    return path


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            ids, parts = unpack(batch.column("payload")[row].as_py())
            ends = np.cumsum(parts.astype(np.int64))
            data = ids.astype("<u4")
            crc = [zlib.crc32(data[e - n : e].tobytes()) for e, n in zip(ends.tolist(), parts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("docs")[row].values, pa.array(batch.column("before")[row].as_py() + ends - parts), pa.array(parts.astype(np.int64)), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row for each document of the shards at path; the columns are described above."""
    small_batches(spark)
    shards = spark.read.parquet(path)
    kind = shards.schema["docs"].dataType.elementType.simpleString()
    index = shards.select("part", "seq", "tokens")
    totals = index.groupBy("part").agg(F.sum("tokens").alias("total"))
    ahead = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row for each part
    within = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    index = index.select("part", "seq", within.alias("within")).join(ahead, "part").select("part", "seq", (F.col("ahead") + F.col("within")).alias("before"))
    found = shards.select("part", "seq", "docs", "payload").join(index, ["part", "seq"]).select("docs", "before", "payload")
    return found.mapInArrow(_documents, f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
