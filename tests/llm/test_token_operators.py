"""Token counts, Huffman-coded ids, maximum-entropy scores, HTML blocks and Hamming search."""

import math
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import hamming, html_blocks, huffman, maxent, token_counts
from fieldloom.llm.common import held_out, text_bytes

ODD = ["", None, " ", "  ", "\n", "a  b\n\nc  ", " hello", "\ttab é 漢<s>", "</s><unk> x", "▁x ▁", "x" + " " * 40, "漢 漢  漢", "😀  🤖", "aaaa abab", "\x00 \x00", "İ, Σς", "<|endoftext|> a", "it's THEN. Then, don't"]


def made_texts(n=80, seed=1):
    r = random.Random(seed)
    pool = ["the", "of", "and", "thion", "Éclair", "straße", "漢字", "x1", "end.", "a,b", "\n", " "]
    return [" ".join(r.choice(pool) + r.choice(["", "s", "ing"]) for _ in range(r.randint(1, 60))) for _ in range(n)]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")


def test_token_counts_match_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD + made_texts() + ["word " * 5000]
    found = {r["doc_id"]: r for r in token_counts.token_counts(table(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert (found[i]["n_tokens"], found[i]["n_bytes"], found[i]["over_limit"]) == (n, len((t or "").encode()), n > 4096), repr(t)
    assert token_counts.token_counts(table(spark, texts).limit(0), path).count() == 0


def test_token_counts_of_random_strings_and_a_small_store():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, counter = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.Counter(path, kept=50)
    r = random.Random(7)
    texts = ["".join(r.choice("abcdetheinerß  \n▁漢é.,0123") for _ in range(r.randint(1, 60))) for _ in range(600)]
    assert [counter.count([t])[0] for t in texts] == [len(x) for x in library.encode(texts)]


@pytest.mark.parametrize("shard", [huffman.SHARD, 50])
def test_ids_round_trip(spark, tmp_path, shard):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ODD + made_texts()
    out = huffman.write_ids(table(spark, texts).repartition(3), path, f"file://{tmp_path}/ids", shard=shard, block=16)
    found = sorted(huffman.read_ids(spark, out).collect(), key=lambda r: r["doc_id"])
    start = 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(found[i]) == (i, start, len(ids), zlib.crc32(ids.tobytes())), repr(t)
        start += len(ids)
    empty = huffman.write_ids(table(spark, texts).limit(0), path, f"file://{tmp_path}/none")
    assert huffman.read_ids(spark, empty).count() == 0


def test_code_is_optimal_and_limited():
    import heapq

    r = np.random.default_rng(1)
    for n in (2, 3, 10, 300):
        counts = r.integers(1, 50, n)
        lengths, heap, cost = huffman.code_lengths(counts), [int(x) for x in counts], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            cost += (both := heapq.heappop(heap) + heapq.heappop(heap))
            heapq.heappush(heap, both)
        assert int((lengths * counts).sum()) == cost
    limited = huffman.code_lengths(2 ** np.arange(30), 6)
    assert limited.max() == 6 and (2.0**-limited).sum() <= 1


def test_shard_round_trip():
    r = np.random.default_rng(2)
    symbols, counts = np.sort(r.choice(49_000, 500, replace=False)), r.zipf(1.3, 500).clip(1, 10**6)
    code = huffman.Code.of(symbols, counts)
    for n in (0, 1, 15, 16, 17, 4_000):
        ids = r.choice(symbols, n)
        back, parts = huffman.unpack(huffman.pack(ids, np.array([n]), code, 16))
        assert (back == ids).all() and parts.tolist() == [n]


def test_long_shard_round_trip():
    r = np.random.default_rng(3)
    symbols, counts = np.arange(500), r.zipf(1.3, 500).clip(1, 10**6)
    code = huffman.Code.of(symbols, counts)
    for block in (16, 1_000):  # which do or do not part the slices that packing works on
        ids = r.choice(symbols, 300_001)
        assert (huffman.unpack(huffman.pack(ids, np.array([len(ids)]), code, block))[0] == ids).all()


def test_store_of_chunks_takes_few_bytes():
    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(6)
    encode = lambda made, texts: made.encode(*text_bytes(pa.array(texts)))
    made = huffman.Encoder(path)
    for _ in range(10):
        encode(made, [" ".join("".join(r.choice("bcdfghjklmnpqrstvwxyz") for _ in range(7)) for _ in range(15_000))])
    assert len(made.keys) > 140_000 and sum(x.nbytes for x in (made.keys, made.entry, made.starts, made.sizes, made.letters, made.flat)) < 48 * len(made.keys)
    few = huffman.Encoder(path, kept=100)
    for k in range(40):  # long chunks: few, yet of many ids
        text = "".join(r.choice("xyz0123") for _ in range(1_500)) + f" a{k}"
        ids, _ = encode(few, [text])
        assert ids.tolist() == few.tokenizer.encode(text, add_special_tokens=False).ids
        assert few.filled <= 400 + 2 * len(ids)


def test_scores(spark):
    texts = made_texts(200) + ["", None, " ", "new words only", "word " * 30_000]
    out = held_out(F.col("doc_id"), 7, 2)
    for frequent in (maxent.FREQUENT, 20):  # 20: most words take the shuffled way
        found = {r["doc_id"]: r for r in maxent.model_scores(table(spark, texts), out, frequent=frequent).collect()}
        low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        tokens = [re.findall(r"[^\x20\x09-\x0D]+", low(t)) + ["\n"] for t in texts]
        counts = Counter(w for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
        n, v = sum(counts.values()), len(counts)
        for i, t in enumerate(tokens):
            r = found[i]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), n)
            assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
            assert r["score"] < 0
    assert maxent.model_scores(table(spark, texts).limit(0), out).count() == 0


def _changed(texts, training, common, shards, monkeypatch):
    """Scores by the operator's three steps, with untrained weights, and what stays to be joined."""
    monkeypatch.setattr(maxent, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)}))}))
    totals = maxent.Totals(1000, 100, np.full(maxent.CLASSES, 500.0), np.full(maxent.CLASSES, 20.0))
    words = np.array(sorted(common), np.uint64)
    counts = np.array([common[w] for w in words.tolist()], np.int64)
    half = len(texts) // 2
    made = []
    for part in (slice(0, half), slice(half, None)):
        made.append(pa.RecordBatch.from_pydict({"id": pa.array(list(range(len(texts)))[part]), "text": pa.array(texts[part], pa.string()), "held_out": pa.array([not x for x in training[part]])}))
    sent = pa.Table.from_batches(list(maxent._scores(maxent.ClassModel(), totals, words, counts, shards)(iter(made))))
    answered = []
    for shard in range(shards):
        mine = sent.filter(pa.compute.equal(sent["shard"], shard))
        answered += list(maxent._answers(iter(mine.to_batches())))
    whole = pa.Table.from_batches(answered).sort_by("step").combine_chunks()
    return pa.Table.from_batches(list(maxent._settled(iter(whole.to_batches())))).sort_by("id").to_pylist()


def test_ngrams_against_brute_force(monkeypatch):
    texts = made_texts(60) * 2 + ["a b", None, "a b c d", "a b c e", "x y z " * 50]
    training = [i % 7 != 2 for i in range(len(texts))]
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"] for t in texts]
    grams, contexts = Counter(), {}
    for t, w in enumerate(tokens):
        for a in zip(w, w[1:], w[2:]) if training[t] else ():
            grams[a] += 1
            contexts.setdefault(a[:2], Counter())[a[2]] += 1
    data = np.frombuffer("\n".join(sorted({x for w in tokens for x in w} - {"\n"})).encode(), np.uint8)
    starts, lengths, _ = maxent.words_of(data, np.array([0, len(data)]))
    hashes = dict(zip([bytes(data[a : a + n]).decode() for a, n in zip(starts, lengths)], maxent.hash_words(data, starts, lengths).tolist()))
    hashes["\n"] = int(maxent.END)
    seen = Counter(x for w in tokens for x in w)
    for least in (0, 5):
        common = {hashes[w]: n for w, n in seen.items() if n >= least}
        for shards in (1, 3):
            for i, r in enumerate(_changed(texts, training, common, shards, monkeypatch)):
                score, plain, told = 0.0, [], []
                for j, w in enumerate(tokens[i]):
                    rare = hashes[w] not in common
                    p = (1 if rare else seen[w] + 1) / maxent.CLASSES / 521
                    n = grams[tuple(tokens[i][j - 2 : j + 1])] if j >= 2 else 0
                    after = contexts.get(tuple(tokens[i][j - 2 : j]), {}) if j >= 2 else {}
                    t = sum(after.values())
                    rest = 0.75 * len(after) / t if t else 1.0
                    if rare:
                        (told if n else plain).append(hashes[w])
                    score += math.log10((n - 0.75) / t + (0 if rare else rest * p) if n else rest * p)
                assert math.isclose(r["score"], score, abs_tol=2e-3 * len(tokens[i])), (i, least, shards)
                assert (r["id"], r["n_tokens"]) == (i, len(tokens[i]))
                assert Counter(x % 2**64 for x in r["rare"]) == Counter(plain) and Counter(x % 2**64 for x in r["told"]) == Counter(told)


def test_shares_of_a_context_sum_to_one():
    trained = np.array([3, 1, 0, 0])  # four words of one context, the last two not seen there
    p = np.array([0.4, 0.3, 0.2, 0.1])
    change, seen = maxent.gram_logs(np.uint64(7 << 16) + np.arange(4, dtype=np.uint64), trained, np.log(p), np.zeros(4, bool))
    assert seen.tolist() == [True, True, False, False] and math.isclose((p * np.exp(change)).sum(), 1)


def test_class_probabilities_sum_to_one():
    r = np.random.default_rng(3)
    weights, bias = r.normal(size=(maxent.TEMPLATES, maxent.SLOTS, maxent.CLASSES)).astype(np.float32), r.normal(size=maxent.CLASSES).astype(np.float32)
    slots = r.integers(0, maxent.SLOTS, (50, 3)).astype(np.uint16)
    assert np.allclose(np.exp(maxent.class_logs(weights, bias, slots)).sum(1), 1, atol=1e-4)


def test_learning_lowers_the_loss():
    r = np.random.default_rng(4)
    learner = maxent.Learner(maxent.ClassModel().weights, maxent.ClassModel().bias)
    classes = r.integers(0, 8, 20_000)
    slots = np.stack([classes * 7 % 97, r.integers(0, 50, 20_000), r.integers(0, 50, 20_000)], 1).astype(np.uint16)
    loss = lambda: -maxent.class_logs(learner.weights, learner.bias, slots)[np.arange(20_000), classes].mean()
    before = loss()
    for a in range(0, 20_000, 1000):
        learner.step(slots[a : a + 1000], classes[a : a + 1000])
    assert loss() < before / 3


PAGE = "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav><div class='ad'>Buy now</div><article><h1>A &amp; B</h1><p><b>First  part\nof it.<br><p>Second &eacute; part.</p><div class='comments'><p>Nice one</p></div></article><aside class=sidebar><p>More</p></aside><form><label>Mail</label><input></form><footer>&copy; me</footer>"


def test_main_text_of_a_page(spark):
    pages = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<!-- open"), (None, "u", "<nav>Home</nav>"), (6, "u", "<p>" * 3000), (7, "u", "<div>" * 1500 + "x")]
    found = {r["page_id"]: r for r in html_blocks.extracted(spark.createDataFrame(pages, "page_id long, url string, html string"), keep=["page_id", "url"]).collect()}
    assert found[1]["text"] == "A & B\nFirst part of it.\nSecond é part." and found[1]["n_chars"] == len(found[1]["text"])
    assert all(found[k]["text"] == "" for k in (2, 3, 4, None, 6)) and len(found) == len(pages)


def test_labeller_on_unseen_layouts():
    made = html_blocks.Layouts(77)
    blocks = html_blocks.block_vectors([made.page() for _ in range(150)])
    labels = np.array([t.startswith("\x01") for page in blocks.texts for t in page])
    assert ((html_blocks.trained().scores(blocks) >= 0.5) == labels).mean() > 0.98


def test_main_text_of_generated_pages_against_a_plain_reading(spark):
    """Articles of known paragraphs between menus, adverts and footers, many of them, and none of it lost or added."""
    r, rows, wanted = random.Random(3), [], {}
    words = lambda a, b: " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b)))
    for k in range(200):
        title, parts = words(2, 9).capitalize(), [words(6, 80).capitalize() + "." for _ in range(r.randint(2, 12))]
        menu = "".join(f"<li><a href=/{i}>{words(1, 2)}</a></li>" for i in range(5))
        body = "".join(f"<p>{p[:9]}<b>{p[9:]}</b></p>" if r.random() < 0.3 else f"<p>{p} &eacute;&#33;<br>ok</p>" for p in parts)
        rows.append((k, f"<html><head><title>{title}</title></head><body><nav><ul>{menu}</ul></nav><div class='ad'>{words(4, 9)}</div><article><h1>{title}</h1>{body}</article><footer>&copy; {words(2, 9)}</footer></body></html>"))
        wanted[k] = "\n".join([title, *(p if f"<b>{p[9:]}" in body else f"{p} é! ok" for p in parts)])
    found = {x["page_id"]: x["text"] for x in html_blocks.extracted(spark.createDataFrame(rows, "page_id long, html string"), keep=["page_id"]).collect()}
    assert sum(found[k] != wanted[k] for k in wanted) <= 1


def test_kept_columns_of_clashing_names(spark):
    pages = spark.createDataFrame([(1, "t", "h", 5, "<article><p>Some words of it, here.</p></article>")], "page_id long, text string, page_html string, n_chars int, html string")
    found = html_blocks.extracted(pages, keep=["page_id", "page_html", "text", "n_chars"])
    assert found.columns == ["page_id", "page_html", "text", "n_chars"] and found.first()["page_html"] == "h" and found.first()["n_chars"] == 23
    assert html_blocks.extracted(pages.limit(0), keep=["page_id"]).count() == 0


@pytest.mark.parametrize("page", ["<a" * 500_000, '<a "><a" "' * 100_000 + "'", "<!" * 500_000, "<svg>" * 200_000, "<script " * 130_000, "<p><button>" + "<b>" * 150_000 + "<div></div>" * 50_000, "<a '" * 250_000, '<p class="' + "a " * 400_000 + '">x', "<p class" + "= " * 400_000 + ">", "&" * 10**6, "<!--" * 250_000, "<li>" * 250_000, "<xmp>" * 200_000], ids=range(13))
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html_blocks.blocks_of(page)
    assert time.process_time() - began < 20


def test_long_pages_take_bounded_memory():
    code = "import resource as r; from fieldloom.llm import html_blocks as h; use = lambda: r.getrusage(r.RUSAGE_SELF).ru_maxrss; m = h.BlockLabeller(); a = use(); h.main_texts(['<p>word other <b>x</b></p>' * 100_000], m); print((use() - a) // 1024)"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 300


def test_text_of_odd_markup():
    texts = lambda page: html_blocks.blocks_of(page)[0]
    assert texts("<p>a &am<b>p; b</b> &amp; c</p>") == ["a &amp; b & c"]
    assert texts("<p>x <math><mi>y</mi></math> <svg><text>z</text></svg></p><noscript><p>n</p></noscript><xmp><b> &amp;</xmp>") == ["x y z", "n", "<b> &amp;"]
    assert texts("<script>a<p></script>b<style>c</style><textarea>d</textarea><!-- e --><p title='>'>f <template>g") == ["b", "f"]
    assert texts('<p title="a>b">c</p><p title="d>e</p>f') == ["c", "e", "f"]  # the last quote never closes


def brute_nearest(bits, queries, k=hamming.K):
    want = set()
    for q in queries:
        near = sorted((int((bits[q] != b).sum()), i) for i, b in bits.items() if i != q)[:k]
        want |= {(q, rank, i, d) for rank, (d, i) in enumerate(near, 1)}
    return want


def test_hamming_search_matches_brute_force(spark):
    r = np.random.default_rng(6)
    vectors = r.normal(size=(400, 20)).astype(float)
    vectors[50:150] = vectors[50]  # a common vector
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)] + [(7, vectors[7].tolist(), "y"), (None, vectors[0].tolist(), "x"), (900, None, "x"), (901, [1.0], "x"), (902, [float("nan")] * 20, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    bits = {i: np.array(v) > 0 for i, v, _ in rows if i is not None and v is not None and len(v) == 20}
    found = hamming.nearest_codes(table, table.where("vec_id % 25 = 0")).collect()
    want = brute_nearest(bits, [i for i in bits if i % 25 == 0])
    assert {tuple(x) for x in found} == want and len(found) == len(want)
    assert hamming.nearest_codes(table.limit(0), table.limit(0)).count() == 0


@pytest.mark.parametrize("dims", [64, 100])
def test_hamming_queries_end_by_coverage(spark, monkeypatch, dims):
    """Codes of families of near ones: queries end at a small radius, long before all codes are met."""
    radii, plain = [], hamming.flips
    monkeypatch.setattr(hamming, "flips", lambda bits, radius: radii.append(radius) or plain(bits, radius))
    r = np.random.default_rng(7)
    base = r.normal(size=(100, dims))
    vectors = np.repeat(base, 15, 0)
    for v in vectors:
        v[r.integers(0, dims, 3)] *= -1
    table = spark.createDataFrame([(f"v{i:05}", v.tolist()) for i, v in enumerate(vectors)], "vec_id string, embedding array<double>")
    found = hamming.nearest_codes(table, table.where("vec_id like '%00'")).collect()
    assert {tuple(x) for x in found} == brute_nearest({f"v{i:05}": v > 0 for i, v in enumerate(vectors)}, [f"v{i:05}" for i in range(0, len(vectors), 100)])
    assert max(radii) <= 1  # six bits at most, and m * 2 - 1 are covered


def test_segments_cut_codes_wherever_they_begin(spark):
    value = (0x9F3A << 56) | 0x17
    row = spark.range(1).select(F.lit(value & (2**64 - 1)).cast("decimal(20)").alias("x"))
    low = value & (2**64 - 1)
    words = [F.lit(low - 2**64 if low >= 2**63 else low).cast("long"), F.lit(value >> 64).cast("long")]
    got = row.select(*(hamming.segment(words, lo, bits).alias(f"s{lo}") for lo, bits in [(0, 8), (56, 16), (60, 7)])).first()
    assert tuple(got) == tuple(value >> lo & (1 << bits) - 1 for lo, bits in [(0, 8), (56, 16), (60, 7)])
