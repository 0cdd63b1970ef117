"""The pipeline's stages one by one and together, on a small corpus with known cases."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, mark string"


def corpus(tmp_path, spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeioustnrl") for _ in range(r.randint(2, 8)))
    clean = [" ".join(word() for _ in range(r.randint(30, 90))) for _ in range(90)]
    junk = [" ".join(word() + "$$$" for _ in range(40)) for _ in range(30)]
    near = clean[0].split()
    near[3] = "changed"
    leak = clean[1] + " " + (item := " ".join(word() for _ in range(14))) + " " + word()
    texts = clean + junk + [" ".join(near), clean[2], clean[2], leak]
    rows = [(i, t, None if i % 11 == 0 else "en", "s", len(t), 0.1, "m") for i, t in enumerate(texts)]
    rows += [rows[5], (None, clean[7] + " tail words", None, None, None, None, None), (500, None, "en", None, None, None, None), (501, "", "en", None, 0, None, None), (502, "123 456", "en", None, 7, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 90), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, texts


def test_stages(spark, tmp_path):
    d, texts = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns, name
    good = ids(corpus_pipeline.good_quality(spark, docs, d))
    assert not good & set(range(90, 120)) and len(good & set(range(90))) >= 88
    assert not ids(corpus_pipeline.known_language(spark, docs, d)) & {500, 501, 502}
    one = corpus_pipeline.one_of_similar(spark, docs, d)
    kept = [r["doc_id"] for r in one.select("doc_id").collect()]
    assert 120 not in kept and 121 not in kept and 122 not in kept and {0, 2, 500, 501} <= set(kept) and kept.count(5) == 1
    assert ids(docs) - ids(corpus_pipeline.decontaminated(spark, docs, d)) == {123}


def test_language_stage_rejects_foreign_scripts_and_gibberish(spark, tmp_path):
    d, texts = corpus(tmp_path, spark)
    r = random.Random(9)
    gibberish = " ".join("".join(r.choice("bcdfghjkmpqvwxyz") for _ in range(6)) for _ in range(50))
    odd = [(900, "漢字" * 40), (901, "привет мир " * 9), (902, gibberish), (903, texts[3])]
    docs = spark.read.parquet(f"{d}/documents.parquet").unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    kept = {x["doc_id"] for x in corpus_pipeline.known_language(spark, docs, d).collect()}
    assert not kept & {900, 901, 902} and {903, *range(90)} <= kept


def test_run_and_empty_tables(spark, tmp_path):
    d, _ = corpus(tmp_path / "full", spark)
    found = corpus_pipeline.run(spark, d).collect()
    kept = {r["doc_id"] for r in found}
    assert len(found) == len(kept) and not kept & {120, 121, 122, 123, 500, 501, 502} and len(kept & set(range(90))) >= 86
    none = str(tmp_path / "none")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{none}/{name}.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0
