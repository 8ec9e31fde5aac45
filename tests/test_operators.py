"""Operators on small tables of their own and on edge cases; fusion and filters stand in test_weak_spots.py."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import messages as M
from tessera.functions import text as T
from tessera.functions.vectors import METRICS, l2_normalised, max_sim
from tessera.operators import chunking, embedding, pipeline, post, relational, retrieval
from tessera.sources import files, points
from tessera.streaming import events as S

# --- search ---------------------------------------------------------------------


def test_vector_search(spark, monkeypatch):
    pts = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(-3, 4)] + [(9, [0.0, 0.0])], "chunk_id long, vector array<double>")
    queries = spark.createDataFrame([(100, [1.0, 0.0]), (101, [0.0, 1.0])], "query_id long, query_vector array<double>")

    def top(query, **c):
        return [r.chunk_id for r in retrieval.vector_search(pts, queries, retrieval.RetrievalConfig(**c)).filter(F.col("query_id") == query).orderBy("result_rank").collect()]

    assert top(100, top_k=2) == [3, 2] and top(101, top_k=3) == [0, -1, 1]
    assert top(100, metric="dot", top_k=1) == [3] and top(100, metric="euclidean", top_k=2) == [1, 9]
    assert top(100, min_score=0.8) == [3, 2] and top(100, top_k=1, min_score=0.99, threshold_stage="after") == []
    assert top(100, top_k=3, filters={"chunk_id": [1, -1]}) == [1, -1]
    whole = sorted(map(tuple, retrieval.vector_search(pts, queries).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 1)
    assert sorted(map(tuple, retrieval.vector_search(pts, queries).collect())) == whole
    for bad in ({"top_k": 0}, {"metric": "x"}, {"threshold_stage": "x"}, {"min_score": -1}):
        with pytest.raises(ValueError):
            retrieval.RetrievalConfig(**bad)


def test_search_honours_every_declared_filter(spark):
    rows = [(i, [1.0, i / 10], f"{'pdf' if i % 2 else 'md'}", i % 3, f"2024-01-{i + 1:02d} 00:00:00") for i in range(12)]
    pts = spark.createDataFrame(rows, "chunk_id long, vector array<double>, file_type string, source_id long, uploaded_at string").withColumn("uploaded_at", F.to_timestamp("uploaded_at"))
    asked = spark.createDataFrame([(100, [1.0, 0.0])], "query_id long, query_vector array<double>")

    def top(**c):
        return [r.chunk_id for r in retrieval.vector_search(pts, asked, retrieval.RetrievalConfig(**c)).orderBy("result_rank").collect()]

    assert top(file_types=("pdf",)) == [1, 3, 5, 7, 9, 11] and top(source_ids=(0,)) == [0, 3, 6, 9]
    assert top(date_from="2024-01-05", date_to="2024-01-07") == [4, 5, 6]
    assert top(file_types=("pdf",), source_ids=(0, 1), date_from="2024-01-03", filters={"chunk_id": lambda c: c < 9}) == [3, 7]
    assert retrieval.vector_search(pts.drop("uploaded_at"), asked, retrieval.RetrievalConfig(date_from="2024-01-05")).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_are_cut_before_the_exchange(spark):
    pts = spark.createDataFrame([(i, [float(i), 1.0], "a b") for i in range(9)], "chunk_id long, vector array<double>, text string")
    asked = spark.createDataFrame([(100, [1.0, 0.0], "a")], "query_id long, query_vector array<double>, query_text string")
    results = spark.createDataFrame(DOCS, RESULTS)
    terms = spark.createDataFrame([(1, "a", 1.0)], "chunk_id long, term string, weight double")
    plans = [retrieval.vector_search(pts, asked), retrieval.sparse_search(terms, terms.withColumnRenamed("chunk_id", "query_id")), retrieval.keyword_search_many(pts, asked), post.rerank(results)]
    for df in plans:
        assert plan_of(df).count("WindowGroupLimit") >= 2, plan_of(df)  # below and above the exchange


def test_keyword_hybrid_and_multi_query_search(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "red red car"), (3, "blue sky"), (4, None)], "chunk_id long, text string")
    pts = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [-1.0, 0.0])], "chunk_id long, vector array<double>")
    asked = spark.createDataFrame([(100, "red car", [1.0, 0.1]), (101, "sky", [0.0, 1.0]), (102, None, [0.0, 1.0])], "query_id long, query_text string, query_vector array<double>")
    one = {r.chunk_id: r.keyword_score for r in retrieval.keyword_search(docs, "red car").collect()}
    many = retrieval.keyword_search_many(docs, asked).collect()
    assert {r.chunk_id: r.keyword_score for r in many if r.query_id == 100} == pytest.approx(one, abs=1e-6) and {(r.query_id, r.chunk_id) for r in many if r.query_id > 100} == {(101, 3)}
    config = retrieval.RetrievalConfig(top_k=2)
    both = {(r.query_id, r.fused_rank): (r.id, r.rrf_score) for r in retrieval.search("hybrid", pts, docs, asked, config).collect()}
    assert both[100, 0] == ("1", pytest.approx(1 / 61 + 1 / 62)) and both[101, 0] == ("3", pytest.approx(1 / 62 + 1 / 61)) and both[102, 0] == ("2", None)
    variants = retrieval.expand(asked.filter("query_id = 100"), lambda q: F.array(F.lit("sky"), q)).orderBy("variant").collect()
    assert [(r.variant, r.query_text) for r in variants] == [(0, "red car"), (1, "sky")]
    vectors = spark.createDataFrame([(100, 0, [1.0, 0.1]), (100, 1, [0.0, 1.0])], "query_id long, variant int, query_vector array<double>")
    fused = retrieval.search("multi_query", pts, docs, vectors, retrieval.RetrievalConfig(top_k=1)).collect()
    assert [(r.query_id, r.id, r.rrf_score) for r in fused] == [(100, "1", pytest.approx(1 / 61 + 1 / 63))]
    with pytest.raises(ValueError):
        retrieval.search("none", pts, docs, asked)


def test_rerank_isolates_a_failed_set(spark):
    rows = some_results(12, 20)
    df = spark.createDataFrame(rows, RESULTS)
    scorer = lambda q, c: F.when(c.isNotNull(), post.overlap_score(q, c))
    failed = {r[0] for r in rows if r[2] is None}
    assert 0 < len(failed) < 20
    found = lists_of(post.rerank(df, top_k=2, scorer=scorer, isolate=True), "new_rank")
    best = wanted_lists(rows, lambda r: -overlap(r[5], r[2]), k=2)
    assert found == {q: wanted_lists(rows, lambda r: 0)[q] if q in failed else ids for q, ids in best.items()}


def test_filter_reaches_the_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = retrieval.metadata_filter(docs, {"lang": ["fr", "es"]}).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(lang" in plan and "text" not in plan.split("ReadSchema")[1]


def test_keyword_and_sparse_search(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "red red car"), (3, "blue sky"), (4, None)], "chunk_id long, text string")
    assert [r.chunk_id for r in retrieval.keyword_search(docs, "red car").collect()] == [2, 1]
    with pytest.raises(ValueError):
        retrieval.keyword_search(docs, " ")
    terms = embedding.sparse_terms(docs, "chunk_id")
    asked = embedding.sparse_terms(spark.createDataFrame([(7, "red red")], "query_id long, text string"), "query_id")
    assert [(r.chunk_id, r.score) for r in retrieval.sparse_search(terms, asked).orderBy("result_rank").collect()] == [(2, 4.0), (1, 2.0)]


def test_vector_functions(spark):
    row = spark.range(1).select(F.array(F.lit(3.0), F.lit(4.0)).alias("a"), F.array(F.lit(0.0), F.lit(0.0)).alias("z"))
    got = row.select(
        METRICS["cosine"].score(F.col("a"), F.col("a")).alias("c"), METRICS["cosine"].score(F.col("a"), F.col("z")).alias("n"), l2_normalised(F.col("a")).alias("u"), l2_normalised(F.col("z")).alias("v"),
        max_sim(F.array("a", "z"), F.array("a", "a")).alias("m"),
    ).first()
    assert (got.c, got.n, got.u, got.v, got.m) == (1.0, None, [0.6, 0.8], [0.0, 0.0], 25.0)


# --- after retrieval ---------------------------------------------------------------

RESULTS = "query_id int, chunk_id string, contents string, similarity_score double, result_rank int, query_text string"


def some_results(seed=11, queries=6):
    """Random result lists: contents of few words, scores that tie and are missing."""
    rng = random.Random(seed)
    words = ["oak", "elm", "fir", "Ash", "yew"]
    rows = []
    for query in range(queries):
        asked = " ".join(rng.sample(words, rng.randint(1, 3)))
        for rank in range(rng.randint(1, 12)):
            contents = " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))
            rows.append((query, f"c{query}-{rank}", rng.choice([contents, contents, contents, None]), rng.choice([None, 0.25, 0.5, 0.75, rng.random()]), rank, asked))
    return rows


DOCS = some_results()


def overlap(asked, contents):
    asked = set(asked.lower().split())
    return len(asked & set((contents or "").lower().split())) / len(asked)


def lists_of(df, order):
    found = {}
    for r in df.orderBy("query_id", order).collect():
        found.setdefault(r.query_id, []).append(r.chunk_id)
    return found


def wanted_lists(rows, key, keep=lambda r: True, k=None):
    """Per query the ids of the rows that are kept, by key and then rank, cut to k."""
    found = {}
    for r in sorted(rows, key=lambda r: (r[0], key(r), r[4])):
        if keep(r) and len(found.get(r[0], ())) < (k or len(rows)):
            found.setdefault(r[0], []).append(r[1])
    return found


def test_post_retrieval(spark):
    df = spark.createDataFrame(DOCS, RESULTS)
    score = lambda r: r[3] or 0.0
    lexical = lambda r: -overlap(r[5], r[2])
    for k in (1, 3, 10):
        assert lists_of(post.rerank(df, top_k=k), "new_rank") == wanted_lists(DOCS, lexical, k=k)
        assert lists_of(post.apply_top_k(df, k), "result_rank") == wanted_lists(DOCS, lambda r: 0, k=k)
    assert lists_of(post.apply_top_k(df, -3), "result_rank") == wanted_lists(DOCS, lambda r: 0, k=1)
    for least in (0.3, 0.5, 1.0):
        assert lists_of(post.rerank(df, top_k=99, score_threshold=least), "new_rank") == wanted_lists(DOCS, lexical, lambda r: -lexical(r) >= least)
        assert lists_of(post.filter_by_score(df, least), "result_rank") == wanted_lists(DOCS, lambda r: 0, lambda r: score(r) >= least)
    assert post.filter_by_score(df, 7).count() == len(DOCS)
    assert lists_of(post.sort_by_score(df), "new_rank") == wanted_lists(DOCS, lambda r: -score(r))
    assert lists_of(post.sort_by_score(df, descending=False), "new_rank") == wanted_lists(DOCS, score)
    for bad in ({"top_k": 0}, {"score_threshold": 2}):
        with pytest.raises(ValueError):
            post.rerank(df, **bad)
    length = lambda q, c: F.length(F.coalesce(c, F.lit(""))) / 100
    assert lists_of(post.rerank(df, top_k=99, score_threshold=0.05, scorer=length), "new_rank") == wanted_lists(DOCS, lambda r: -len(r[2] or ""), lambda r: len(r[2] or "") >= 5)


def test_dedup_and_group(spark):
    long = "x" * 500
    rows = [(0, "a", long + "1", 0.9, 0, ""), (0, "b", long + "2", 0.8, 1, ""), (0, "c", None, 0.7, 2, ""), (1, "a", long, 0.6, 0, "")]
    df = spark.createDataFrame(rows, RESULTS)
    once = post.dedup_results(df)
    assert sorted((r.query_id, r.chunk_id) for r in once.collect()) == [(0, "a"), (0, "c"), (1, "a")]
    assert sorted(map(tuple, post.dedup_results(once).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    grouped = post.group_by_source(df.withColumn("source_id", F.when(F.col("chunk_id") == "b", "s1").otherwise("s0"))).orderBy("query_id", "group_rank").collect()
    assert [(g.query_id, g.source_id, g.top_score, g.chunk_count) for g in grouped] == [(0, "s0", 0.9, 2), (0, "s1", 0.8, 1), (1, "s0", 0.6, 1)]
    assert [c.chunk_id for c in grouped[0].chunks] == ["a", "c"]


# --- text -------------------------------------------------------------------------

ROUTED = [("oats and barley", True, None), ("tea or coffee", True, None), ("compare two kettles", True, None), ("bike vs tram", True, None), ("leaf " * 20, True, None), ("bread recipes", False, None), ("What is rye?", None, True), ("Why do leaves fall?", None, True), ("How to sharpen knives?", None, True), ("Explain tides", None, True), ("Describe a lighthouse", None, True), ("garden notes", None, False), ("sort", True, None)]


def test_router(spark):
    df = spark.createDataFrame(ROUTED, "q string, c boolean, o boolean").select("c", "o", T.is_complex_query(F.col("q")).alias("gc"), T.is_open_ended(F.col("q")).alias("go"))
    for r in df.collect():
        assert r.c in (None, r.gc) and r.o in (None, r.go)
    asked = spark.createDataFrame([("",), ("   ",), (None,), ("Why",), ("a or b",), ("fine",)], "q string")
    assert [r[0] for r in asked.select(T.route(F.col("q"), F.lit("auto"))).collect()] == ["none", "none", "none", "hyde", "decomposition", "expansion"]


def test_expansion(spark):
    df = spark.createDataFrame([("q", "x one\nx two\nx three"), ("again", "again\nagain\nagain"), ("q", "\n".join(map(str, range(20)))), ("q", " \n\t")], "q string, t string")
    found = [r[0] for r in df.select(T.expanded(F.col("q"), T.split_lines(F.col("t")))).collect()]
    assert found[0] == ["q", "x one", "x two", "x three"] and found[1] == ["again"] and len(found[2]) == 15 and found[3] == ["q"]


def test_formatting(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(T.context_line(F.lit(1), F.lit("notes_a.txt"), F.lit("c"))) == "[#1 RANKED CHUNK: FILE NAME: notes_a.txt CHUNK CONTENT: c]"
    assert value(T.context_line(F.lit(None).cast("int"), F.lit("f"), F.lit("c"))).startswith("[#N/A RANKED")
    assert value(T.cdata(F.lit("a]]>b"))) == "<![CDATA[a]]]]><![CDATA[>b]]>"
    assert value(T.json_string(F.lit('a "b"\n\\'))) == '"a \\"b\\"\\n\\\\"'
    assert value(T.ulid_millis(F.lit("01KE0KFK42ABCDEFGHJKMNPQRS"))) == 1767399476354 and value(T.ulid_millis(F.lit("not one"))) is None
    assert [value(T.media_type(F.lit(p))) for p in ("a.PDF", "b/c.md", "x", ".md", "d.e/f")] == ["application/pdf", "text/markdown", "unknown", "unknown", "unknown"]
    assert value(T.model_string(F.lit("OpenAI"), F.lit("m"), F.lit(None))) == "openai/m" and value(T.model_string(F.lit("Own"), F.lit("m"), F.lit(""))) == "own/m"
    assert value(T.model_string(F.lit("x"), F.lit("m"), F.lit("mine"))) == "mine/m" and value(T.model_string(F.lit(""), F.lit("m"), F.lit(None))) is None
    assert [value(T.normal_role(F.lit(r))) for r in (" USER", "assistant", "bot")] == ["user", "assistant", "user"]
    assert value(T.or_original(F.lit("  "), F.lit("q"))) == "q" and value(T.or_original(F.lit(" x "), F.lit("q"))) == "x"


# --- chunks ------------------------------------------------------------------------


def chunks_of(spark, chunker, content, size, overlap):
    df = spark.createDataFrame([(1, content)], "source_id long, content string")
    return chunking.chunk_sources(df, chunker, chunking.ChunkerConfig(size, overlap)).orderBy("pos").collect()


@pytest.mark.parametrize("chunker", sorted(chunking.CHUNKERS))
def test_chunkers(spark, chunker):
    for empty in ("", "   \n\t  ", None):
        assert chunks_of(spark, chunker, empty, 512, 128) == []
    assert len(chunks_of(spark, chunker, "Rain fell all night. Roads are wet.", 100, 20)) == 1
    for content, size, overlap in [("aaaa " + "b" * 200, 5, 1), ("ash birch cedar. elm fir hazel larch maple", 5, 1), ("x y. " * 500, 5, 5)]:
        found = chunks_of(spark, chunker, content, size, overlap)
        assert found and [r.pos for r in found] == list(range(len(found)))
        for r in found:
            assert r.start_index >= 0 and r.end_index > r.start_index and r.token_count > 0 and r.text == r.text.strip()
            assert chunker == "token" or content[r.start_index : r.end_index].strip() == r.text
    with pytest.raises(ValueError):
        chunks_of(spark, "none", "x", 1, 0)


def test_chunk_rules(spark):
    df = spark.createDataFrame([(0, 30, 7), (68, 68, 0), (None, 3, 1)], "start_index int, end_index int, token_count int")
    assert [r.valid for r in chunking.validate_chunks(df).collect()] == [True, False, False]
    assert spark.range(1).select(chunking.page_count(F.lit("A" * 6500)), chunking.page_count(F.lit(None).cast("string"))).first()[:] == (3, 1)
    sources = spark.createDataFrame([(1, "a b"), (2, None)], "source_id long, content string")
    assert sorted(map(tuple, chunking.chunk_stats(sources, chunking.chunk_fixed(sources)).collect())) == [(1, 1, 1), (2, 0, 0)]


def test_embedding(spark):
    chunks = spark.createDataFrame([("s", "Tides follow the moon."), ("s", ""), ("t", " ")], "source_id string, text string")
    found = embedding.embed_chunks(chunks)
    assert [r.dense_vector is None for r in found.collect()] == [False, True, True]
    coverage = {r.source_id: (r.status, r.message) for r in embedding.embedding_coverage(found).collect()}
    assert coverage == {"s": ("partial", "1/2 chunks embedded"), "t": ("failed", "0/1 chunks embedded")}
    vector = embedding.embed_query(spark, "when do tides turn")
    assert len(vector) == 32 and sum(x * x for x in vector) == pytest.approx(1)
    with pytest.raises(ValueError):
        embedding.embed_query(spark, "  ")
    with pytest.raises(ValueError):
        embedding.embedder("none")


# --- files and points ----------------------------------------------------------------


def test_ingest_and_parse(spark, tmp_path):
    md = "# Garden guide\n\nWater *early* **daily** & sparsely.\n\n## Beds\n\n- a\n- b"
    (tmp_path / "guide.md").write_text(md)
    read = files.read_files(spark, str(tmp_path), "*.md").first()
    assert bytes(read.content).decode() == md
    html = spark.createDataFrame([(md,)], "c string").select(files.markdown_to_html(F.col("c")).alias("h")).first().h
    assert html == "<h1>Garden guide</h1>\n<p>Water <em>early</em> <strong>daily</strong> &amp; sparsely.</p>\n<h2>Beds</h2>\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>"
    parts = spark.createDataFrame([("a", "t", "aGk="), ("b", "t", "***"), ("c", "t", "/w==")], "file_name string, media_type string, data string")
    assert [r.content for r in files.ingest(parts).collect()] == ["hi", None, None]
    kinds = spark.createDataFrame([("text/plain", "x"), ("text/html", "<p>y</p>"), ("text/html", "<p></p>"), ("application/pdf", "z")], "media_type string, content string")
    parsed = files.parse_with_fallback(kinds, "markdown", ("missing", "html")).collect()
    assert [(r.parsed, r.parser_used) for r in parsed] == [("<p>x</p>", "markdown"), ("y", "html"), ("", None), ("", None)] and parsed[3].errors
    choose = lambda kind, wanted, path: spark.range(1).select(files.select_parser(F.lit(kind), F.lit(wanted), F.lit(path))).first()[0]
    assert [choose("unknown", None, "a.md"), choose("text/html", "markdown", ""), choose("text/plain", "markdown", ""), choose("unknown", "pypdf", "a.pdf")] == ["markdown", "html", "markdown", None]
    assert files.parsers_of("text/markdown") == ["markdown"] and files.parser_types("none") == () and files.capabilities(spark).count() == 3


def test_points_store(spark, tmp_path):
    rows = [("p1", [0.1, 0.2, 0.3], "old"), ("p2", [0.4, 0.5, 0.6], "old")]
    schema = "id string, vector array<double>, payload string"
    store = points.PointsStore(spark, f"file://{tmp_path}", "c", 3)
    assert not store.exists()
    with pytest.raises(FileNotFoundError):
        store.read()
    store.upsert(spark.createDataFrame(rows, schema))
    store.upsert(spark.createDataFrame([("p2", [0.0, 0.0, 1.0], "new"), ("p3", [1.0, 0.0, 0.0], "new")], schema))
    assert sorted((r.id, r.payload) for r in store.read().collect()) == [("p1", "old"), ("p2", "new"), ("p3", "new")]
    store.upsert(spark.createDataFrame(rows[:1], schema), mode="append")
    assert store.info().first()[:] == ("c", 4, 3, "ok") and store.read().select("id").distinct().count() == 4  # a new identity
    store.delete(spark.createDataFrame([("p1",), ("none",)], "id string"))
    assert store.read().count() == 3
    assert points.PointsStore(spark, f"file://{tmp_path}", "c", 3).read().count() == 3
    for other in ((4, "cosine"), (3, "dot")):
        with pytest.raises(ValueError):
            points.PointsStore(spark, f"file://{tmp_path}", "c", *other)
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([("p", [1.0], "x")], schema))


# --- relational and trees ---------------------------------------------------------------


def test_relational(spark):
    users = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "id int, name string, score int")
    spaces = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, None)], "space int, owner int")
    counted = relational.with_child_count(users, spaces, "id", "owner", "n").orderBy("id").collect()
    assert [r.n for r in counted] == [2, 1]
    changed = relational.partial_update(users, spark.createDataFrame([(1, None, 7)], "id int, name string, score int"), "id").orderBy("id").collect()
    assert [tuple(r) for r in changed] == [(1, "a", 7), (2, "b", 5)]
    left = relational.cascade_delete([(users, "id", None), (spaces, "space", "owner")], spark.createDataFrame([(1,)], "id int"))
    assert [df.count() for df in left] == [1, 2]
    assert sorted(r.owner or 0 for r in relational.set_null_on_delete(spaces, "owner", spark.createDataFrame([(1,)], "id int")).collect()) == [0, 0, 0, 2]
    ids = spark.range(1).select(relational.archived(F.lit(None).cast("array<long>"), F.lit(1).cast("long")), relational.restored(F.array(F.lit(1), F.lit(2)), F.lit(1))).first()
    assert ids[:] == ([1], [2])


TREE = [("0001", "c", None, "", "user"), ("0002", "c", "0001", "", "assistant"), ("0003", "c", "0001", "", "assistant"), ("0004", "c", "0002", "0001", "user"), ("0005", "d", "0001", "", "user")]


def test_message_tree(spark):
    df = spark.createDataFrame(TREE, "message_id string, convo_id string, parent_id string, root_id string, role string")
    up = relational.ancestors(df.select("message_id", "parent_id"), df.filter("message_id = '0004'").select("message_id"))
    assert [r.ancestor_id for r in up.orderBy(F.col("distance").desc()).collect()] == ["0001", "0002"]
    branch = {r.message_id: (r.branch_index, r.branch_count) for r in relational.branches(df).collect()}
    assert (branch["0002"], branch["0003"]) == ((0, 2), (1, 2))
    roots = {r.message_id: r.root_id for r in relational.message_root_ids(df).collect()}
    assert roots == {"0001": None, "0002": "0001", "0003": "0001", "0004": "0002", "0005": None}
    cycle = spark.createDataFrame([("a", "b"), ("b", "a")], "message_id string, parent_id string")
    assert relational.ancestors(cycle, cycle.select("message_id").limit(1), max_depth=5).count() == 5
    with pytest.raises(ValueError):
        relational.ancestors(cycle, cycle.select("message_id").limit(1))
    chain = spark.range(150).select(F.col("id").cast("string").alias("message_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"))
    above = relational.ancestors(chain, chain.filter("message_id = '149'").select("message_id"))
    assert sorted((int(r.ancestor_id), r.distance) for r in above.collect()) == [(149 - k, k) for k in range(149, 0, -1)]
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 2, 2), (None, 9, 3)], "id string, t int, p int")
    assert [(r.id, r.p) for r in relational.latest_per_id(rows, "id", "t", "p").collect()] == [("a", 1)]


# --- streams ----------------------------------------------------------------------------


def test_sse(spark):
    text = 'data: {"type":"text-delta","delta":"a"}\nstatus:{"status":"x"}\r\nsource: []\ndata: {broken\n: comment\nother'
    got = S.decode_sse(spark.createDataFrame([(1, text)], "id long, text string")).orderBy("pos").collect()
    assert [(r.channel, r.malformed) for r in got] == [("data", False), ("status", False), ("source", False), ("data", True)]
    assert got[0].event.delta == "a" and got[3].event is None
    chunks = spark.createDataFrame([(1, 0, "data: {}\n\nda"), (1, 1, "ta: 1\n\ntail"), (2, 0, "no end")], "s int, i int, text string")
    assert {r.s: (r.text, r.tail) for r in S.carry_tails(chunks, "s", "i").collect()} == {1: ("data: {}\n\ndata: 1\n\n", "tail"), 2: ("", "no end")}


def test_tokens_progress_and_errors(spark):
    deltas = spark.createDataFrame([("m", 1, "b"), ("m", 0, "a"), ("m", 2, None), ("m", 3, "")], "m string, i int, d string")
    assert [tuple(r) for r in S.assemble_text(deltas, "m", "i", "d").collect()] == [("m", "ab", 2)]
    stages = spark.createDataFrame([(1, "chunking"), (1, "fetching"), (1, "other"), (2, "complete")], "c int, s string")
    assert sorted(map(tuple, S.latest_progress(stages, "c", "s").collect())) == [(1, "chunking", 0.35), (2, "complete", 1.0)]
    assert S.error_events(stages, F.col("s") == "other", F.col("s")).first().event == '{"type":"error","error":"other"}'


def test_stream_appends_closed_windows_and_drops_late_rows(spark, tmp_path):
    batches = [[(1, "2024-01-01 00:10:00", 1.0), (2, "2024-01-01 03:00:00", 1.0)], [(6, "2024-01-01 04:00:00", 1.0)], [(3, "2024-01-01 00:20:00", 1.0), (4, "2024-01-01 02:30:00", 1.0), (5, "2024-01-01 09:00:00", 1.0)]]
    for rows in batches:
        spark.createDataFrame(rows, "id int, ts string, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    files = spark.readStream.schema("id int, ts string, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = S.run_to_table(S.tumbling(S.event_time(files, delay="1 hour"), "1 hour"))
    # Row 3 comes after the watermark (02:00) has passed its window; row 4 is in time; the window of 09:00 is open.
    assert sorted((str(r.window_start)[11:16], r.n) for r in found.collect()) == [("00:00", 1), ("02:00", 1), ("03:00", 1), ("04:00", 1)]


def test_stream_carries_tails_between_batches(spark, tmp_path):
    batches = [[(1, 0, "data: {}\n\nda"), (2, 0, "no end")], [(1, 2, "tail"), (1, 1, "ta: 1\n\n"), (2, 1, None)], [(1, 3, "\n\n")]]
    for rows in batches:
        spark.createDataFrame(rows, "s long, i long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    files = spark.readStream.schema("s long, i long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = S.run_to_table(S.carry_tails_stream(files, "s", "i"))
    assert sorted((r.s, r.text) for r in found.collect()) == [(1, "data: 1\n\n"), (1, "data: {}\n\n"), (1, "tail\n\n")]


# --- end to end -------------------------------------------------------------------------


def test_index_and_answer(spark):
    uploads = spark.createDataFrame([(1, "h1", "text/plain", "red apples and green pears"), (2, "h2", "text/html", "<p>blue cars drive fast</p>"), (3, "h3", "application/pdf", "x"), (4, "", "text/plain", "no hash"), (5, "h5", "text/plain", None)], "source_id long, source_hash string, media_type string, content string")
    pts = pipeline.index_files(uploads)
    assert sorted(r.payload.source_id for r in pts.collect()) == [1, 2]
    questions = spark.createDataFrame([(1, "green pears"), (2, "fast blue cars"), (3, " "), (4, None)], "query_id long, query_text string")
    best = {r.query_id: r.source_id for r in pipeline.answer(pts, questions).filter("new_rank = 0").collect()}
    assert best == {1: 1, 2: 2}
    empty = pts.limit(0)
    assert pipeline.or_fallback(empty, lambda: pts).count() == 2 and pipeline.or_fallback(pts, lambda: empty).count() == 2


def test_messages_and_registries(spark):
    df = spark.createDataFrame([("PRIMARY_LLM", 1), ("x", 2)], "tool_role string, created_at int")
    assert [r[0] for r in df.select(M.tool_category(F.col("tool_role"))).collect()] == ["llm", None]
    assert M.camel_columns(df).columns == ["ToolRole", "CreatedAt"] and M.only(df, ["created_at", "secret"]).columns == ["created_at"]
    assert M.renamed(df, {"tool_role": "role", "created_at": "tool_role", "z": "y"}).columns == ["role", "created_at"]
    assert post.available_rerankers() == ["lexical"] and post.reranker("lexical") is post.overlap_score
    with pytest.raises(ValueError):
        post.reranker("none")
