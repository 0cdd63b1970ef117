"""Main text of HTML pages by a recurrent block labeller.

A page is cut into leaf blocks: the text between the boundaries of block elements, character references
decoded and white space made single spaces.  Each block has a vector of its tag path (tags, classes, ids and
roles of the open elements, hashed), of its hashed words and of a few sizes.  A bidirectional LSTM
in numpy reads the blocks of the whole page in order and labels every block; the labelled ones,
joined by newlines, are the main text.

The network is trained here, on pages from a seeded generator of layouts whose blocks are known to be article
or not (menus, headers, footers, sidebars, notices, adverts, forms and reader comments around and
inside articles of various markup); words are random, so that layout and not vocabulary decides.
Contents of script, style, title, textarea, template and frames are never blocks, nor are comments; xmp is text as it
stands; noscript, svg and math are markup.  Character references are decoded in each run of text by itself.

Rows of the result, one for each input row: its kept columns, ``text`` (empty if none) and ``n_chars`` (code points); kept
columns of these two names are replaced.  Null, empty and blank pages give an empty text.  Unclosed and
misnested tags follow the usual implied ends; an unclosed comment or script runs to the end, and from the
first tag with a quote that never closes quotes no longer hide ``>``.  Time and memory are linear in the
page, however it is built: long pages are read whole, in vectors of blocks that name their features.
Repeated pages give repeated rows; keys may repeat or be null; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, hash_words, small_batches, steps, text_bytes, words_of

PATH, WORDS = 512, 256
#: Numbers of the weighed inputs that a run of the network holds at a time.
CELLS = 1 << 20
#: Elements that bound a block of text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul noscript xmp".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is neither markup nor text of the page.
RAW = frozenset("script style title textarea template iframe noembed noframes".split())
#: What a start tag closes if it is open, and where the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
#: Comments, declarations and tags; each alternative takes what it has seen and never goes back over it.
_MARKUP = re.compile(r"<!--(?:.*?-->|.*+)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_PLAIN = re.compile(r"<!--(?:.*?-->|.*+)|<[!?][^>]*+>|" + _OPEN.pattern, re.S)
_START = re.compile(r"<(?=[!?/a-zA-Z])")
_NAMES = re.compile(r"(class|id|role|itemprop)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_TOKENS = re.compile(r"[a-z]+")


@functools.lru_cache(1 << 16)
def _names(attributes: str) -> tuple[int, ...]:
    """Path features of an element's class, id, role and itemprop."""
    out = set()
    for m in _NAMES.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        out.update(zlib.crc32(t.encode()) % PATH for t in _TOKENS.findall(value))
    return tuple(out)


@functools.lru_cache(1 << 12)
def _tag(name: str, kind: str) -> int:
    return zlib.crc32(f"<{kind}{name}>".encode()) % PATH


def markup_of(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Start, end, whether it ends an element, name and attributes of each piece of markup; the name of comments is empty.

    After an element is sent back by its name, the next piece is its end tag.  Quotes hide ``>`` until one of them turns out never to close;
    from there on they are plain, so no stretch is searched twice and the time is linear in the page.
    """
    at, last, pattern, ends = 0, page.rfind(">"), _MARKUP, {}
    while True:
        m = _START.search(page, at)
        if not m:
            return
        at = m.start()
        if at > last:  # no tag ends any more; a comment without an end takes the rest
            at = page.find("<!--", at)
            if at >= 0:
                yield at, len(page), False, "", ""
            return
        m = pattern.match(page, at)
        if not m and pattern is _MARKUP and page[at + 1] not in "!?" and _OPEN.match(page, at):
            pattern = _PLAIN
            m = pattern.match(page, at)
        if not m:
            at += 1
            continue
        at, name = m.end(), (m[2] or "").lower()
        skip = yield m.start(), at, bool(m[1]), name, m[3] or ""
        if skip:  # the content of an element that is not markup: to its end tag, or all the rest
            if skip not in ends or ends[skip] is not None and ends[skip].start() < at:
                ends[skip] = re.compile(rf"</{re.escape(skip)}(?=[\s/>])[^>]*+>", re.I).search(page, at)
            end = ends[skip]
            stop, at = end.span() if end else (len(page), len(page))
            yield stop, at, False, "", ""


def blocks_of(page: str) -> tuple[list[str], list[tuple[int, ...]], list[tuple[int, int, int]]]:
    """Texts of the leaf blocks; path features; (link characters, depth, raw tags since the last block)."""
    texts: list[str] = []
    paths: list[tuple[int, ...]] = []
    sizes: list[tuple[int, int, int]] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    where: dict[str, list[int]] = {}  # places in the stack of each open name
    bounds: list[str] = []  # open elements that bound blocks
    open_features: dict[int, int] = {}
    shared: dict[tuple[int, ...], tuple[int, ...]] = {}
    pieces: list[str] = []
    links, tags = 0, 0

    def flush() -> None:
        nonlocal links, tags
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                own = _tag(bounds[-1] if bounds else "", "own ")
                path = tuple(open_features) if own in open_features else (*open_features, own)
                texts.append(text)
                paths.append(shared.setdefault(path, path))
                sizes.append((min(links, len(text)), len(stack), tags))
                tags = 0
        links = 0

    def pop() -> None:
        name, features = stack.pop()
        where[name].pop()
        if name in BLOCKS:
            bounds.pop()
        for f in features:
            open_features[f] -= 1
            if not open_features[f]:
                del open_features[f]

    def top(names) -> int:
        return max((where[x][-1] for x in names if where.get(x)), default=-1)

    def close(names: set[str], until: set[str]) -> None:
        least = top(until)
        while (k := top(names)) > least:
            while len(stack) > k:
                pop()

    def add(run: str) -> None:
        nonlocal links
        if run:
            pieces.append(run)
            if where.get("a"):
                links += len(run)

    at, markup, skip = 0, markup_of(page), None
    while True:
        try:
            start, end, ends, name, attributes = markup.send(skip)
        except StopIteration:
            break
        skip = None
        add(html.unescape(page[at:start]))
        at = end
        if not name:
            continue
        tags += 1
        if name in BLOCKS:
            flush()
        elif name == "br":
            pieces.append(" ")
        if ends:
            if where.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in RAW or name == "xmp":
            begin = at
            stop, at, *_ = markup.send(name)
            if name == "xmp":  # text, as it stands
                add(page[begin:stop])
                flush()
            continue
        if name in BLOCKS and name not in VOID:
            close({"p"}, {"article", "section", "div", "td", "li", "button", "body", "aside", "nav", "main", "header", "footer", "form", "blockquote"})
        if name in CLOSES:
            close(*CLOSES[name])
        if name not in VOID and not attributes.endswith("/"):
            features = (_tag(name, ""), *_names(attributes)) if attributes else (_tag(name, ""),)
            where.setdefault(name, []).append(len(stack))
            stack.append((name, features))
            if name in BLOCKS:
                bounds.append(name)
            for f in features:
                open_features[f] = open_features.get(f, 0) + 1
    add(html.unescape(page[at:]))
    flush()
    return texts, paths, sizes


@dataclass(frozen=True)
class Blocks:
    """Blocks of some pages: their texts by page, and over all blocks the distinct paths and which of them each
    has, word slots with n + 1 offsets, and sizes; with the offsets of the pages among the blocks."""

    texts: list[list[str]]
    paths: list[tuple[int, ...]]
    path: np.ndarray
    slots: np.ndarray
    ends: np.ndarray
    more: np.ndarray
    offsets: np.ndarray

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """Path features and word shares as matrices; for training."""
        path = np.zeros((len(self.paths), PATH), np.float32)
        for k, features in enumerate(self.paths):
            path[k, list(features)] = 1
        n = np.diff(self.ends)
        owner = np.repeat(np.arange(len(n)), n)
        words = np.bincount(owner * WORDS + self.slots, minlength=len(n) * WORDS).reshape(len(n), WORDS).astype(np.float32)
        return path[self.path], words / np.maximum(n, 1)[:, None]

    def inputs(self, paths: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Sums of the paths' rows of one table, means of the words' rows of another, and sizes."""
        sums = np.stack([paths[list(x)].sum(0) for x in self.paths]) if self.paths else np.zeros((0, paths.shape[1]), np.float32)
        means = np.zeros((len(self.path), words.shape[1]), np.float32)
        n = np.diff(self.ends)
        for lo, hi in steps(self.ends, 1 << 17):
            some = lo + np.flatnonzero(n[lo:hi])
            if len(some):
                means[some] = np.add.reduceat(words[self.slots[self.ends[lo] : self.ends[hi]]], self.ends[some] - self.ends[lo]) / n[some][:, None]
        return np.concatenate([sums[self.path], means, self.more], 1)


def block_vectors(pages: list[str]) -> Blocks:
    """The blocks of some pages with what the labeller reads of them."""
    texts, path, names, sizes = [], [], {}, []
    for page in pages:
        t, p, s = blocks_of(page)
        texts.append(t)
        path += [names.setdefault(x, len(names)) for x in p]
        sizes.append(np.array(s, np.float32).reshape(-1, 3))
    flat = [t for page in texts for t in page]
    raw = [t.encode("utf-8", "replace") for t in flat]
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))))
    data = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    del raw
    starts, lengths, ends = words_of(data, offsets)
    n_words = np.diff(ends)
    slots = (hash_words(data, starts, lengths) % np.uint64(WORDS)).astype(np.int16)
    s = np.concatenate([*sizes, np.zeros((0, 3), np.float32)])
    chars = np.fromiter(map(len, flat), np.float32, len(flat))
    stops = np.fromiter((t.count(".") + t.count(",") for t in flat), np.float32, len(flat))
    more = np.stack([np.log1p(chars) / 5, np.log1p(n_words) / 3, s[:, 0] / np.maximum(chars, 1), np.log1p(s[:, 1]), np.log1p(s[:, 2]), np.minimum(stops / np.maximum(n_words, 1), 1)], 1).astype(np.float32)
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    return Blocks(texts, list(names), np.array(path, np.int64), slots, ends, more, np.concatenate(([0], np.cumsum(counts))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Bidirectional LSTM over the blocks of a page, with a logistic output for each block."""

    def __init__(self, seed: int = 3, path_dims: int = 20, word_dims: int = 8, hidden: int = 20):
        r = np.random.default_rng(seed)
        d = path_dims + word_dims + 6
        w = lambda *s: (r.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32)
        self.hidden = hidden
        self.p = {"path": (0.3 * r.normal(size=(PATH, path_dims))).astype(np.float32), "words": w(WORDS, word_dims), "out": w(2 * hidden), "skip": w(d), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": w(d, 4 * hidden), f"h{side}": w(hidden, 4 * hidden), f"c{side}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{side}"][hidden : 2 * hidden] = 1

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """x: (steps, pages, inputs).  Hidden states, and what the backward pass needs."""
        t, n, _ = x.shape
        k = self.hidden
        wide = t if keep else max(1, CELLS // (4 * k * max(n, 1)))  # steps whose inputs are weighed at a time
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out = np.zeros((t, n, k), np.float32)
        tape = [None] * t if keep else []
        z, base = None, 0
        for s in range(t) if side == "f" else range(t - 1, -1, -1):
            if z is None or not base <= s < base + len(z):
                base = s // wide * wide
                z = x[base : base + wide] @ self.p[f"x{side}"] + self.p[f"c{side}"]
            g = z[s - base] + h @ self.p[f"h{side}"]
            gates = _sigmoid(g[:, : 3 * k])
            i, f, o, u = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :], np.tanh(g[:, 3 * k :])
            m = mask[s][:, None]
            new = f * c + i * u
            squashed = np.tanh(new)
            if keep:
                tape[s] = (h, c, i, f, o, u, squashed, m)
            c = np.where(m, new, c)
            h = np.where(m, o * squashed, h)
            out[s] = h
        return out, tape

    def _back(self, grad_out: np.ndarray, x: np.ndarray, tape: list, side: str, grads: dict) -> np.ndarray:
        t, n, _ = x.shape
        k = self.hidden
        dz = np.zeros((t, n, 4 * k), np.float32)
        dh, dc = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        wh = self.p[f"h{side}"]
        gh = np.zeros_like(wh)
        for s in range(t - 1, -1, -1) if side == "f" else range(t):
            h, c, i, f, o, u, squashed, m = tape[s]
            dh = dh + grad_out[s]
            now = np.where(m, dh, 0)
            dnew = np.where(m, dc, 0) + now * o * (1 - squashed**2)
            dg = np.concatenate([dnew * u * i * (1 - i), dnew * c * f * (1 - f), now * squashed * o * (1 - o), dnew * i * (1 - u**2)], 1)
            dz[s] = dg
            gh += h.T @ dg
            dh = np.where(m, dg @ wh.T, dh)
            dc = np.where(m, dnew * f, dc)
        grads[f"h{side}"] = gh
        grads[f"x{side}"] = np.einsum("tni,tnj->ij", x, dz, optimize=True)
        grads[f"c{side}"] = dz.sum((0, 1))
        return dz @ self.p[f"x{side}"].T

    @staticmethod
    def _padded(offsets: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = offsets[pages + 1] - offsets[pages]
        steps = np.arange(n.max() if len(n) else 0)
        mask = steps[:, None] < n[None, :]
        return np.where(mask, offsets[pages][None, :] + steps[:, None], 0), mask

    def scores(self, blocks: Blocks, cells: int = 50_000) -> np.ndarray:
        """The probability of each block that it is main text; pages of like length run together."""
        x = blocks.inputs(self.p["path"], self.p["words"])
        offsets = blocks.offsets
        out = np.zeros(len(x), np.float32)
        n = np.diff(offsets)
        order = np.argsort(n, kind="stable")
        order = order[n[order] > 0]
        hi, k = len(order), self.hidden
        while hi:
            lo = max(0, hi - max(1, cells // int(n[order[hi - 1]])))
            at, mask = self._padded(offsets, order[lo:hi])
            steps = x[at]
            y = steps @ self.p["skip"] + self.p["bias"]
            y += self._run(steps, mask, "f", False)[0] @ self.p["out"][:k]
            y += self._run(steps, mask, "b", False)[0] @ self.p["out"][k:]
            out[at[mask]] = _sigmoid(y[mask])
            hi = lo
        return out

    def train(self, blocks: Blocks, labels, rounds: int = 6, size: int = 48, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on the mean logistic loss over blocks."""
        (path, words), more, offsets = blocks.dense(), blocks.more, blocks.offsets
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(rounds):
            for chosen in np.array_split(r.permutation(len(offsets) - 1), max(1, (len(offsets) - 1) // size)):
                chosen = chosen[np.diff(offsets)[chosen] > 0]
                if not len(chosen):
                    continue
                at, mask = self._padded(offsets, chosen)
                x = np.concatenate([path[at] @ self.p["path"], words[at] @ self.p["words"], more[at]], 2)
                hf, tf = self._run(x, mask, "f", True)
                hb, tb = self._run(x, mask, "b", True)
                both = np.concatenate([hf, hb], 2)
                y = both @ self.p["out"] + x @ self.p["skip"] + self.p["bias"]
                dy = np.where(mask, _sigmoid(y) - labels[at], 0).astype(np.float32) / mask.sum()
                grads = {"out": np.einsum("tn,tnk->k", dy, both), "skip": np.einsum("tn,tnk->k", dy, x), "bias": dy.sum(keepdims=True).reshape(1)}
                dboth = dy[..., None] * self.p["out"]
                dx = dy[..., None] * self.p["skip"]
                dx = dx + self._back(dboth[..., : self.hidden], x, tf, "f", grads) + self._back(dboth[..., self.hidden :], x, tb, "b", grads)
                dx = np.where(mask[..., None], dx, 0)
                a, b = self.p["path"].shape[1], self.p["words"].shape[1]
                grads["path"] = np.einsum("tni,tnj->ij", path[at], dx[..., :a], optimize=True)
                grads["words"] = np.einsum("tni,tnj->ij", words[at], dx[..., a : a + b], optimize=True)
                step += 1
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


class Layouts:
    """Seeded pages with known labels."""

    OUTSIDE = ["nav", "menu", "header", "footer", "sidebar", "notice", "advert", "form", "comments", "related"]
    #: Names that sites give to such parts, beside the elements made for them.
    NAMES = {
        "nav": "nav navbar navigation menu topnav breadcrumb breadcrumbs pagination pager links tabs toc skip", "menu": "menu mainmenu dropdown submenu hamburger", "header": "header masthead topbar branding logo tagline site banner", "footer": "footer bottom colophon copyright legal credits",
        "sidebar": "sidebar aside widget rail secondary right left column tags archive popular trending", "notice": "notice cookie cookies consent gdpr alert banner modal popup overlay message warning newsletter subscribe paywall", "advert": "ad ads advert advertisement sponsored sponsor promo promoted promotion banner dfp outbrain taboola",
        "form": "form search login signup subscribe contact poll", "comments": "comments comment reply replies discussion disqus respond responses thread reader", "related": "related recommended more share sharing social author bio meta byline readnext",
    }
    INSIDE = "content main article post entry story body text page copy single hentry prose richtext".split()

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        syllables = ["".join(x) for x in zip("bcdfghjklmnprstvwz" * 5, "aeiouaeioueaoiu" * 6, strict=False)]
        self.syllables = syllables + ["th", "er", "on", "qu", "é", "ß", "ción", "en", "ou"]

    def pick(self, options):
        return options[int(self.r.integers(len(options)))]

    def words(self, low: int, high: int) -> str:
        n = int(np.exp(self.r.uniform(np.log(low), np.log(high + 1))))
        cut = self.r.integers(len(self.syllables), size=(n, 3))
        size = self.r.integers(1, 4, n)
        out = ["".join(self.syllables[k] for k in row[:s]) for row, s in zip(cut.tolist(), size.tolist(), strict=True)]
        if self.r.random() < 0.1:
            mark = self.pick([" |", "!!", "***", "&amp;&amp;"])
            out = [w + mark for w in out]
        text = " ".join(out).capitalize()
        return text + self.pick([".", ".", ".", ",", "", ".\n" + text[:40] + "."])

    def inline(self, text: str) -> str:
        k = self.r.random()
        if k < 0.15:
            return f"<b>{text}"
        if k < 0.3:
            cut = len(text) // 2
            return f"{text[:cut]}<{(t := self.pick(['em', 'a href=x', 'strong', 'span', 'code', 'math', 'svg']))}>{text[cut:]}</{t.split()[0]}>"
        return text + "<br>" * (k > 0.9)

    def name(self, options: str | list[str], kind: str = "class") -> str:
        options = options.split() if isinstance(options, str) else options
        value = self.pick(options) + self.pick(["", "", "-" + self.pick(["box", "wrap", "inner", "list", "area", "block"]), " " + self.pick(options), str(self.r.integers(9))])
        return f' {self.pick(["class", "class", "id"]) if kind == "class" else kind}="{value}"'

    def outside(self, kind: str) -> str:
        """A part that is not article; its blocks have the label 0."""
        element = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "notice": "div", "advert": "div", "form": "form", "comments": "section", "related": "div"}[kind]
        named = self.r.random() < (0.5 if element not in ("div", "section") else 1.0)
        element = element if not named or self.r.random() < 0.6 else self.pick(["div", "section", "div", "ul"])
        attrs = self.name(self.NAMES[kind]) if named else ""
        if kind in ("nav", "menu") or kind in ("sidebar", "related", "footer") and self.r.random() < 0.4:
            n = int(self.r.integers(2, 12))
            inner = "<ul>" + "".join(f"<li><a href='/{i}'>{self.words(1, 4)}</a>" + "</li>" * (self.r.random() < 0.9) for i in range(n)) + "</ul>"
            if self.r.random() < 0.2:
                inner = " ".join(f"<a href='/{i}'>{self.words(1, 3)}</a>" for i in range(n))
        elif kind == "form":
            inner = "".join(f"<label>{self.words(1, 4)}</label><input name=q>" for _ in range(2)) + f"<button>{self.words(1, 3)}</button>" + f"<p>{self.words(2, 20)}</p>" * (self.r.random() < 0.4)
        elif kind == "comments":
            inner = f"<h3>{self.words(1, 4)}</h3>" + "".join(f"<div{self.name('comment reply user')}><p>{self.inline(self.words(2, 60))}</p></div>" if self.r.random() < 0.6 else f"<{(t := self.pick(['article', 'li', 'div', 'p']))}{self.name('comment reply')}>{self.words(2, 60)}</{t}>" for _ in range(int(self.r.integers(1, 7))))
        else:
            inner = self.pick(["", f"<h4>{self.words(1, 5)}</h4>", "&copy; "]) + self.pick(["<p>{}</p>", "{}", "<div>{}</div>", "<p>{}"]).format(self.inline(self.words(2, 40)))
            if kind == "header" and self.r.random() < 0.5:
                inner = f"<{(t := self.pick(['h1', 'h2', 'p', 'div']))}>{self.words(1, 5)}</{t}>" + (f"<p>{self.words(2, 10)}</p>" if self.r.random() < 0.5 else "")
            inner *= 1 + (self.r.random() < 0.2)
        if kind == "notice" and self.r.random() < 0.2:
            element = "noscript"
        return f"<{element}{attrs}>{inner}</{element}>"

    def article(self) -> str:
        """Markup of an article, where each block of it begins with a mark, and parts inside that are none."""
        element = self.pick(["article", "article", "main", "div", "section"])
        attrs = self.name(self.INSIDE) if element in ("div", "section") or self.r.random() < 0.3 else ""
        out = [f"<{(t := self.pick(['h1', 'h1', 'h2']))}>\x01{self.words(1, 12)}</{t}>"] if self.r.random() < 0.8 else []
        for _ in range(int(np.exp(self.r.uniform(0, 3)))):
            k = self.r.random()
            if k < 0.75:
                out.append(f"<p>\x01{self.inline(self.words(1, 120))}" + "</p>" * (self.r.random() < 0.9))
            elif k < 0.8:
                out.append("<ul>" + "".join(f"<li>\x01{self.words(1, 20)}</li>" for _ in range(int(self.r.integers(1, 6)))) + "</ul>")
            elif k < 0.84:
                out.append(f"<h{(d := int(self.r.integers(2, 5)))}>\x01{self.words(1, 8)}</h{d}>")
            elif k < 0.88:
                out.append(f"<blockquote>\x01{self.words(2, 40)}</blockquote>")
            elif k < 0.9:
                out.append("<table>" + "".join(f"<tr><td>\x01{self.words(1, 4)}</td><td>\x01{self.words(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif k < 0.92:
                out.append(f"<{(t := self.pick(['pre', 'pre', 'pre', 'xmp']))}>\x01{self.words(1, 30)}</{t}>")
            else:
                out.append(self.outside(self.pick(["advert", "related", "sidebar", "form", "notice", "comments"])))
        if self.r.random() < 0.2:
            out.append(self.outside("comments"))
        return f"<{element}{attrs}>" + "".join(out) + f"</{element}>"

    def page(self) -> str:
        before = [self.outside(k) for k in ("notice", "header", "nav", "menu", "advert", "form", "sidebar") if self.r.random() < 0.35]
        after = [self.outside(k) for k in ("related", "comments", "sidebar", "advert", "form", "footer", "notice") if self.r.random() < 0.35]
        body = before + ([self.article()] if self.r.random() < 0.97 else []) + after
        text = "".join(body)
        if self.r.random() < 0.3:
            text = f"<div{self.name('wrapper container page site layout row')}>{text}</div>"
        end = self.pick(["</body></html>", "</body></html>", ""])
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><style>p{{}}</style></head><body>{text}{end}"


@functools.cache
def trained(pages: int = 1200, seed: int = 11) -> BlockLabeller:
    """The labeller, trained on so many generated pages."""
    made = Layouts(seed)
    blocks = block_vectors([made.page() for _ in range(pages)])
    labels = np.fromiter((t.startswith("\x01") for page in blocks.texts for t in page), np.float32, int(blocks.offsets[-1]))
    model = BlockLabeller()
    model.train(blocks, labels)
    return model


def main_texts(pages: list[str], model: BlockLabeller) -> list[str]:
    blocks = block_vectors(pages)
    keep = model.scores(blocks) >= 0.5
    return ["\n".join(t for t, k in zip(page, keep[a:b], strict=True) if k) for page, a, b in zip(blocks.texts, blocks.offsets[:-1], blocks.offsets[1:], strict=True)]


def extracted(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, model: BlockLabeller | None = None, step: int = 1 << 20) -> DataFrame:
    """The kept columns of each page with its main text and the text's length; ``step``: bytes of pages that are read together."""
    small_batches(pages.sparkSession)
    model = model or trained()
    keep = [c for c in keep or [] if c not in ("text", "n_chars")]
    held = [f"kept_{i}" for i in range(len(keep))]
    read = pages.select(*(F.col(c).alias(k) for c, k in zip(keep, held, strict=True)), F.col(html_col).alias("page_html"))
    shape = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in read.schema.fields[:-1]) + "text string, n_chars long"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column("page_html"))
            for lo, hi in steps(offsets, step):
                part = batch.slice(lo, hi - lo)
                texts = main_texts(part.column("page_html").fill_null("").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in held), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*held, "text", "n_chars"])

    return read.mapInArrow(extract, shape).toDF(*keep, "text", "n_chars")
