"""Decontamination, packing, similarity, quality and language against brute force, with the odd cases of each."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import jaccard_join, language, packing, quality
from fieldloom.llm.common import text_bytes
from fieldloom.llm.decontaminate import benchmark_hits
from fieldloom.llm.jaccard_join import similar_documents

DOCS = "doc_id long, text string, lang string, score double, mark string, node long, bucket long"


def made_documents(n=120, seed=4):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 80))) for _ in range(n)]
    long = " ".join(r.choice(words) for _ in range(60))
    for k in range(40):  # a group of near copies
        w = long.split()
        w[r.randrange(60)] = f"x{k}"
        texts.append(" ".join(w))
    texts += [long] * 30 + [long.upper()] + ["", None, "  \n", "one", "One", "one two", "é" * 5, " ".join(r.choice(words) for _ in range(6000))]
    return texts


def rows_of(texts):
    return [(i, t, None if i % 9 == 0 else "en", 0.5, "m", 1, 2) for i, t in enumerate(texts)]


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_classes(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x09-\x0D\x20]+", low(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inverted[x].append(i)
    shared = Counter((a, b) for held in inverted.values() for k, b in enumerate(held) for a in held[:k])
    root, links = list(range(len(texts))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), k in shared.items():
        if k >= 0.8 * (len(sets[a]) + len(sets[b]) - k) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(i, find(i), links[i]) for i in range(len(texts))]


@pytest.mark.parametrize("chunk", [jaccard_join.CHUNK, 8])
def test_similar_documents_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)  # 8: the hot group falls into many tiles
    texts = made_documents()
    found = similar_documents(spark.createDataFrame(rows_of(texts), DOCS).repartition(3)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == brute_classes(texts)


def test_similar_documents_of_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "q r s t u v"), (1, "q r s t u v"), (3, None)]
    found = similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"], r["n_links"]) for r in found) == [(-1, 1, 2), (1, 1, 1), (1, 1, 2), (1, 1, 2), (2, 1, 1), (3, 3, 0)]


def test_similar_documents_of_an_empty_table(spark):
    assert similar_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_similar_documents_of_text_ids(spark):
    rows = [("b", "a b c d e f"), ("a", "A b c d e f"), ("c", "x y"), (None, None)]
    found = similar_documents(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in found} == {("b", "a", 1), ("a", "a", 1), ("c", "c", 0), (None, None, 0)}


def near_copies(n, width, edits, seed):
    """Copies of one text, each with its own changed words, and their exact links by a product of 0/1 matrices."""
    r = np.random.default_rng(seed)
    words = [f"w{k}" for k in r.permutation(width)]
    texts = []
    for k in range(n):
        w = list(words)
        for at in r.integers(0, width, r.integers(0, edits + 1)):
            w[at] = f"x{k}y{at}"
        texts.append(" ".join(w))
    names, owner, place = {}, [], []
    for k, t in enumerate(texts):
        w = t.split()
        for s in {tuple(w[i : i + 5]) for i in range(width - 4)}:
            owner.append(k)
            place.append(names.setdefault(s, len(names)))
    often = np.flatnonzero(np.bincount(place) > 1)
    matrix = np.zeros((n, len(names)), np.float32)
    matrix[owner, place] = 1
    size, both = matrix.sum(1), matrix[:, often] @ matrix[:, often].T
    near = both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-6
    np.fill_diagonal(near, False)
    return texts, near


def test_a_hot_group_of_near_copies_keeps_its_links(spark):
    texts, near = near_copies(2500, 110, 4, 3)
    r = random.Random(5)
    others = [" ".join(f"o{r.randrange(400)}" for _ in range(30)) for _ in range(500)]
    found = similar_documents(spark.createDataFrame(list(enumerate(texts + others)), "doc_id long, text string").repartition(4)).collect()
    links = {x["doc_id"]: x["n_links"] for x in found}
    wanted = near.sum(1)
    assert sum(links[k] for k in range(2500)) >= 0.9999 * wanted.sum() and all(links[k] <= wanted[k] for k in range(2500))
    reach, todo = {0}, [0]
    while todo:
        new = set(np.flatnonzero(near[todo.pop()]).tolist()) - reach
        reach |= new
        todo += new
    assert {x["doc_id"] for x in found if x["class_id"] == 0} == reach


def test_recall_of_pairs_at_the_threshold(spark):
    r = random.Random(11)
    rows = []
    for k in range(3000):  # 45 shingles a side, of which one changed word takes 5: 40 of 50, just the threshold
        w = [f"p{k}q{r.randrange(10**6)}" for _ in range(49)]
        other = list(w)
        other[r.randrange(5, 44)] = "other"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    found = similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sum(x["n_links"] for x in found) >= 2 * 2997


def test_buckets_of_like_nodes_are_leaves(spark):
    r = np.random.default_rng(1)
    common = r.integers(0, 1 << 32, 64, dtype=np.uint64).astype(np.uint32)
    like = np.where(r.random((600, 64)) < 0.8, common, r.integers(0, 1 << 32, (600, 64), dtype=np.uint64).astype(np.uint32))
    unlike = r.integers(0, 1 << 32, (600, 64), dtype=np.uint64).astype(np.uint32)
    rows = [(name, int(s)) for name, m in (("like", like), ("unlike", unlike)) for s in jaccard_join._signs(m)]
    got = spark.createDataFrame(rows, "name string, signs int").groupBy("name").agg(jaccard_join.likeness(F.col("signs"), F.count("*")).alias("share")).collect()
    got = {x["name"]: x["share"] for x in got}
    assert abs(got["like"] - 0.64) < 0.05 and abs(got["unlike"]) < 0.01


def test_runs_follow_recall():
    assert jaccard_join.runs_for(0.9999) > jaccard_join.runs_for(0.9) >= 1


def brute_hits(texts, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].add(item)
    out = []
    for i, t in enumerate(texts):
        w, hit, held = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    held |= windows[tuple(w[k : k + n])]
        names = ",".join(sorted(str(x) for x in held if x is not None))
        out.append((i, len(w), len(hit), len({x for x in held if x is not None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("broadcast_bytes", [10**8, 0])
def test_decontamination_matches_brute_force(spark, broadcast_bytes):
    texts = made_documents(60)
    source = [t for t in texts if t and len(t.split()) > 30]
    items = [(1, " ".join(source[0].split()[5:25])), (10, " ".join(source[1].split()[:12]).upper()), (2, "one"), (3, None), (4, " -- "), (5, "words that nobody wrote in any document at all here"), (1, " ".join(source[0].split()[5:25])), (7, "a a a a a a a a a a a a")]
    texts += ["b " + "a " * 15, source[0] + "-" + source[0], "the one, and ONE"]
    found = benchmark_hits(spark.createDataFrame(rows_of(texts), DOCS), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=broadcast_bytes).collect()
    assert sorted(tuple(r) for r in found) == brute_hits(texts, items)


def test_decontamination_with_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in benchmark_hits(docs, none).collect()} == {0}
    assert benchmark_hits(docs.limit(0), none).count() == 0


def test_boundaries_are_optimal():
    r = random.Random(1)
    for _ in range(60):
        lengths = sorted(r.sample(range(60), r.randint(1, 9)))
        counts = [r.randint(1, 9) for _ in lengths]
        k = r.randint(1, 5)
        cost = lambda cuts: sum(c * min(b for b in cuts if b >= x) for x, c in zip(lengths, counts, strict=True))  # noqa: B023, E731
        best = {(): 0}

        def every(at, left, lengths=lengths):
            if at == len(lengths) - 1:
                yield (lengths[at],)
                return
            for rest in every(at + 1, left):
                yield rest
                if len(rest) < left:
                    yield (lengths[at], *rest)

        best = min(cost(c) for c in every(0, k) if len(c) <= k)
        found = packing.optimal_boundaries(lengths, counts, k)
        assert len(found) <= k and found[-1] == lengths[-1] and cost(found) == best


def test_boundaries_of_many_lengths_are_optimal():
    r = np.random.default_rng(4)
    lengths = np.sort(r.choice(5000, 700, False))
    counts = r.integers(1, 50, 700)
    rows = np.concatenate(([0], np.cumsum(counts)))
    best = np.concatenate(([0], lengths * rows[1:]))
    for _ in range(7):  # the plain quadratic programme
        best = np.array([0, *(min(best[i] + lengths[j] * (rows[j + 1] - rows[i]) for i in range(j + 1)) for j in range(700))])
    bounds = packing.optimal_boundaries(lengths, counts, 8)
    assert len(bounds) == 8 and (np.array(bounds)[np.searchsorted(bounds, lengths)] * counts).sum() == best[-1]
    many = np.arange(1, 300_001)
    bounds = packing.optimal_boundaries(many, np.ones(len(many), np.int64), 4)
    assert bounds == [75_000, 150_000, 225_000, 300_000]


def test_packing_of_one_id_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 7)
    rows = [(None, "a b c", 1, 2)] * 50 + [(1, "a b", 3, 4)]
    found = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, bucket int, more int"), buckets=3, budget=12, keep=["bucket", "more"])
    assert found.columns == ["doc_id", "more", "n_tokens", "bucket", "padded", "batch", "slot"]
    found = found.collect()
    places = {(r["bucket"], r["batch"], r["slot"]) for r in found}
    assert len(places) == len(found) == 51 and sum(r["padded"] for r in found) == 152


def test_packing_holds_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 7)
    texts = made_documents()
    found = packing.packed(spark.createDataFrame(rows_of(texts), DOCS), buckets=5, budget=256).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(range(len(texts)))
    batches = defaultdict(list)
    for r in found:
        assert r["n_tokens"] == len(re.findall(r"[^\x09-\x0D\x20]+", texts[r["doc_id"]] or "")) <= r["padded"]
        batches[r["bucket"], r["batch"]].append(r)
    partial = Counter()
    for (bucket, _), rows in batches.items():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and (len(rows) * rows[0]["padded"] <= 256 or len(rows) == 1)
        partial[bucket] += len(rows) < max(1, 256 // max(1, rows[0]["padded"]))
    assert max(partial.values()) <= 1
    assert packing.packed(spark.createDataFrame([], DOCS)).count() == 0


def test_quality_ranking_learns_and_takes_anything(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeioustn") for _ in range(r.randint(2, 7)))
    good = [" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(80)]
    bad = [" ".join(word() + r.choice(["$$$", "!!", " |"]) for _ in range(r.randint(5, 60))) for _ in range(40)]
    texts = good + bad + [None, "", " ", "\x00", "é" * 100_000]
    docs = spark.createDataFrame(rows_of(texts), DOCS)
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(120)] + [(5, None), (None, 1), (6, 7)], "doc_id long, quality int")
    held = labels.where("doc_id % 3 <> 1 or doc_id is null")
    model = quality.learn(docs, held)
    found = {row["doc_id"]: row for row in quality.scored(docs, model).collect()}
    assert len(found) == len(texts) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in found.values())
    test = [i for i in range(120) if i % 3 == 1]
    assert np.mean([found[i]["predicted"] == (i < 80) for i in test]) > 0.95
    nothing = quality.learn(docs, labels.limit(0))
    assert {x["score"] for x in quality.scored(docs, nothing).collect()} == {0.5}
    assert quality.scored(docs.limit(0), model).count() == 0


def test_newton_orders_pairs():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 5))
    y = (x @ [2, -1, 0.5, 0, 0] + r.normal(size=300) * 0.1 > 0).astype(int)
    s = quality.fit(x, y).raw(x)
    assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() > 0.98


def test_languages_and_spans(spark):
    r = random.Random(3)
    make = {"aa": lambda: "".join(r.choice(["ba", "lo", "mi"]) for _ in range(3)), "bb": lambda: "".join(r.choice(["zt", "rk", "üs"]) for _ in range(3)), "cc": lambda: "".join(r.choice("абвгд") for _ in range(4))}
    rows = [(i, " ".join(make[k]() for _ in range(30)), k) for i, k in enumerate(list(make) * 40)]
    mixed = " ".join(make["aa"]() for _ in range(30)) + ". " + " ".join(make["bb"]() for _ in range(20))
    extra = [(1000, mixed, None), (1001, None, "aa"), (1002, "123 !!", "aa"), (1003, "", None), (None, "漢字", None), (1001, "абв", None)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    model = language.learn(docs.where("doc_id % 4 <> 2"))
    found = language.languages(docs.withColumnRenamed("lang", "spans"), model).collect()
    assert len(found) == len(rows) + len(extra)
    known = {r["doc_id"]: r for r in found if r["doc_id"] is not None and r["doc_id"] < 1001}
    assert all(known[i]["lang_pred"] == k and known[i]["score"] == 1 for i, _, k in rows)
    assert [(s["lang"], mixed[s["start"] : s["stop"]]) for s in known[1000]["spans"]] == [("aa", mixed.split(". ")[0]), ("bb", mixed.split(". ")[1])]
    rest = {(r["doc_id"], r["lang_pred"]) for r in found if r["doc_id"] is None or r["doc_id"] > 1000}
    assert {(1001, "und"), (1002, "und"), (1003, "und"), (1001, "cc")} <= rest
    assert {r["lang_pred"] for r in language.languages(docs, language.learn(docs.limit(0))).collect()} == {"und"}


def test_unknown_scripts_and_gibberish_score_low(spark):
    r = random.Random(6)
    word = lambda alphabet: "".join(r.choice(alphabet) for _ in range(r.randint(2, 7)))
    known = {"aa": ["ba", "lo", "mi", "ten"], "bb": ["zu", "rki", "üs", "ch"]}
    rows = [(i, " ".join(word(known[k]) for _ in range(40)), k) for i, k in enumerate(list(known) * 60)]
    odd = ["漢字" * 20, "привет мир " * 9, " ".join(word("bcdfghjklmnpqrstvwxz") for _ in range(50)), "漢字" * 8 + " " + rows[0][1][:16]]
    docs = spark.createDataFrame(rows + [(1000 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    found = {x["doc_id"]: x for x in language.languages(docs, language.learn(docs.where("doc_id % 4 <> 2"))).collect()}
    assert all(found[i]["lang_pred"] == k and found[i]["score"] == 1 for i, _, k in rows)
    assert all(found[1000 + i]["lang_pred"] in known for i in range(3)) and found[1000]["score"] == 0 and max(found[1001]["score"], found[1002]["score"]) < 0.3
    assert {s["lang"] for s in found[1000]["spans"]} == {"und"}
    letters = sum(c.isalpha() for c in rows[0][1][:16])
    assert found[1003]["lang_pred"] == "aa" and found[1003]["score"] == pytest.approx(letters / (16 + letters))


def test_letters_of_the_highest_planes_many_languages_and_long_texts(spark):
    word = lambda k: chr(0x4E00 + 7 * k) * 3
    rows = [(k, f"{word(k)} {word(k)}", f"l{k:03}") for k in range(300)]
    docs = spark.createDataFrame(rows + [(900, chr(0x30001) * 3, None), (901, " ".join([word(280)] * 30_000), None)], "doc_id long, text string, lang string")
    found = {x["doc_id"]: x for x in language.languages(docs, language.learn(docs)).collect()}
    assert all(found[k]["lang_pred"] == name for k, _, name in rows)
    assert found[900]["lang_pred"] != "und" and found[901]["lang_pred"] == "l280" and found[901]["score"] == 1


def test_word_scores_are_sums_of_trigram_logs(spark):
    docs = spark.createDataFrame([(1, "Abc abd", "x"), (2, "zzz", "y")], "doc_id long, text string, lang string")
    model = language.learn(docs)
    data, offsets = text_bytes(pa.array(["abc q", "\u4e00"]))
    words = language.words_in(data, offsets)
    got = model.scores(words)
    count = Counter()  # trigrams of language x, the ends of a word marked
    for w in ("abc", "abd"):
        count.update(zip("<" + w, w, w[1:] + ">", strict=False))
    total = sum(count.values()) + 0.1 * language.SLOTS
    assert got[0, 0] == pytest.approx(sum(np.log((count[g] + 0.1) / total) for g in zip("<ab", "abc", "bc>", strict=True)), rel=1e-5)
    assert got[1, 0] == pytest.approx(np.log(0.1 / total), rel=1e-5) and (got[2, :2] == -1e6).all()


def test_quality_learns_from_both_labels_of_repeated_ids(spark):
    r = random.Random(2)
    texts = [" ".join("word" + r.choice(["", "s"]) + ("$$$" if k % 2 else "") for _ in range(20)) for k in range(10)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts) for _ in range(10)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(10)], "doc_id long, quality int")
    scores = {x["doc_id"]: x["score"] for x in quality.scored(docs, quality.learn(docs, labels, sample=10)).collect()}
    assert min(scores[k] for k in range(0, 10, 2)) > max(scores[k] for k in range(1, 10, 2))


def test_quality_fit_takes_all_pairs():
    r = np.random.default_rng(1)
    x = r.normal(size=(520, 4))
    y = (x @ [2, -1, 0.5, 0] + r.normal(size=520) > 0.3).astype(int)
    model = quality.fit(x, y)
    z = model.scaled(x)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 4)
    assert len(d) > 40_000
    slope = (1 / (1 + np.exp(d @ model.weights))) @ d / len(d) - model.weights / 40_000
    assert np.abs(slope).max() < 3e-5


def test_quality_learns_from_all_labelled_rows(spark):
    words = np.array(["aa", "Bbb", "c,", "dddd.", "E!"])
    r = np.random.default_rng(4)
    texts = [" ".join(words[r.integers(0, 5, k % 7)]) + "!" * (k % 3 == 0) for k in range(20_500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(20_500)], "doc_id long, quality int")
    model = quality.learn(rows, labels)
    x = quality.features(*text_bytes(pa.array(texts)))
    assert np.allclose(model.mean, x.mean(0), rtol=1e-12, atol=1e-14)
    y = (np.arange(20_500) % 3 > 0).astype(int)
    assert model.threshold == np.quantile(model.raw(x), (y == 0).mean())
    assert np.allclose(quality.fit(x, y).weights, model.weights, atol=1e-6)


def test_viterbi_matches_brute_force():
    from itertools import product

    r = np.random.default_rng(5)
    lengths = [0, 1, 4, 6, 3, 0]
    scores = r.normal(size=(sum(lengths), 3)) * 2
    ends = np.concatenate(([0], np.cumsum(lengths)))
    found = language.viterbi(scores, ends, 1.5)
    worth = lambda path, s: sum(s[i, k] for i, k in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:], strict=False))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        best = max((worth(p, scores[a:b]) for p in product(range(3), repeat=b - a)), default=0)
        assert np.isclose(worth(tuple(found[a:b]), scores[a:b]), best)


def test_text_bytes_of_slices_and_nulls():
    column = pa.array(["ab", None, "é", ""]).slice(1)
    data, offsets = text_bytes(column)
    assert bytes(data) == "é".encode() and offsets.tolist() == [0, 0, 2, 2]
