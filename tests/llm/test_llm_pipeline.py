"""The corpus pipeline, stage by stage, on a small table."""

import random
from collections import Counter

import corpus_pipeline
from tessera.llm.simhash_dedup import fingerprint


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(7)
    words = {"aa": [f"tala{x}" for x in "bcdfgh"], "bb": [f"xwyz{x}" for x in "jkqvzr"]}
    rows = []
    for i in range(60):
        lang = "ab"[i % 2] * 2
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(30, 200))), lang, f"s{i % 3}", 0))
    rows += [(100, rows[0][1].replace(" ", "  "), "aa", "s0", 0), (101, rows[1][1].upper(), "bb", "s1", 0), (102, "1 2 3", "aa", "s2", 0), (103, None, "aa", "s2", 0)]
    path = f"{tmp_path}/documents.parquet"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(path)
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language_id", "exact_dedup", "simhash_dedup", "mixing", "packing"]

    def ids(df):
        return Counter(r.doc_id for r in df.collect())

    read = spark.read.parquet(path)
    known = stage["language_id"](spark, read, str(tmp_path))
    assert ids(known) == Counter([*range(60), 100, 101]) and known.columns == read.columns
    exact = stage["exact_dedup"](spark, known, str(tmp_path))
    assert ids(exact) == Counter([*range(1, 60), 100, 101]) and exact.columns == read.columns
    near = stage["simhash_dedup"](spark, exact, str(tmp_path))
    fps = {i: fingerprint(t) for i, t, *_ in rows}
    left = sorted(ids(exact))
    linked = {(a, b) for a in left for b in left if a < b and (fps[a] ^ fps[b]).bit_count() <= 3}
    assert linked == {(1, 101)} and ids(near) == Counter([*range(1, 60), 100])
    mixed = stage["mixing"](spark, near, str(tmp_path))
    assert set(ids(mixed)) <= set(ids(near)) and mixed.columns == read.columns and max(ids(mixed).values()) <= 2
    packed = stage["packing"](spark, mixed, str(tmp_path))
    assert ids(packed.filter("piece = 0")) == ids(mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_pipeline_on_empty_null_and_repeated_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __tessera_file string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    text = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor"
    rows = [(1, text, "aa", "s", 1, "x"), (1, text, "aa", "s", 1, "x"), (None, text + " more", "aa", None, None, None), (2, None, "aa", "s", 0, ""), (3, "", None, None, None, None), (4, text.replace(" ", "\n"), "aa", "s", 1, "x"), (5, "other words " * 50, "aa", "t", 1, "x"), (6, "1 2 3", None, None, None, None), (7, "zzz qqq", "aa", "t", 1, "x")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/some/documents.parquet")
    read = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    for name in ("language_id", "exact_dedup", "simhash_dedup"):
        found = stage[name](spark, read, str(tmp_path))
        assert found.columns == read.columns
        found.write.parquet(f"{tmp_path}/{name}")
        read = spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted((r.doc_id or 0) for r in read.collect()) in ([1, 5, 7], [0, 1, 5, 7])
    assert set(r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()) <= {1, 5, 7, None}
