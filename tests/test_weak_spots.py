"""Hashes against published vectors, ownership rules, cycles, media types, column names that clash."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import blake3
from tessera.functions.text import BASE64_BLOCK, DOCUMENT_TYPES, base64_in_blocks, from_template, known_type
from tessera.operators import post, relational, retrieval
from tessera.sources import files

#: Published test vectors of BLAKE3, by length of the input 0, 1, ..., 250, 0, 1, ...
HASHES = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
    2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
    102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
}
CONTEXT = "BLAKE3 2019-12-27 16:29:52 test vectors context"
KEYS = {0: "2cc39783c223154fea8dfb7c1b1660f2ac2dcbd1c1de8277b0b0dd39b7e50d7d", 1: "b3e2e340a117a499c6cf2398a19ee0d29cca2bb7404c73063382693bf66cb06c"}


def pattern(n):
    return bytes(i % 251 for i in range(n))


def test_blake3_against_published_vectors(spark, monkeypatch):
    import numpy as np

    found = blake3.digests([pattern(n) for n in HASHES], np.tile(blake3.IV, (len(HASHES), 1)), 0)
    assert [row.astype("<u4").tobytes().hex() for row in found] == list(HASHES.values())
    assert blake3.derived([CONTEXT] * 2, [pattern(n) for n in KEYS]) == list(KEYS.values())
    rng = random.Random(1)
    materials = [rng.randbytes(rng.choice([0, 63, 64, 65, 1023, 1024, 1025, 5000])) for _ in range(40)]
    contexts = [rng.choice(["a, b", "", "é" * 900]) for _ in materials]
    alone = [blake3.derived([c], [m])[0] for c, m in zip(contexts, materials)]
    monkeypatch.setattr(blake3, "BATCH_BYTES", 3000)
    assert blake3.derived(contexts, materials) == alone and blake3.derived([], []) == []
    rows = spark.createDataFrame([(CONTEXT, bytearray(pattern(1))), (CONTEXT, None), (None, bytearray(b"x"))], "c string, m binary")
    assert [r[0] for r in rows.select(blake3.blake3_derived(F.col("c"), F.col("m"))).collect()] == [KEYS[1], None, None]
    parts = spark.createDataFrame([("n", "t", "aGk="), ("n", None, "aGk=")], "file_name string, media_type string, data string")
    assert [r.file_hash for r in files.ingest(parts, files.content_key).collect()] == blake3.derived(["n, t", "n, "], [b"aGk="] * 2)


def test_cycles_are_seen_at_once(spark):
    rows = [(str(i), str(i - 1)) for i in range(1, 3000)] + [("0", None), ("loop", "loop"), ("a", "b"), ("b", "c"), ("c", "a"), ("in", "a"), ("z", "zz")]
    messages = spark.createDataFrame(rows, "message_id string, parent_id string")
    start = lambda *ids: spark.createDataFrame([(i,) for i in ids], "message_id string")
    for first in ("loop", "a", "in"):
        with pytest.raises(ValueError, match="own ancestor"):
            relational.ancestors(messages, start(first, "5"))
    found = relational.ancestors(messages, start("5", "40", "z", "none", "0")).collect()
    assert sorted((r.message_id, r.ancestor_id, r.distance) for r in found) == sorted([(str(m), str(m - d), d) for m in (5, 40) for d in range(1, m + 1)] + [("z", "zz", 1)])
    assert relational.ancestors(messages, start("a"), max_depth=7).count() == 7


def test_requests_of_other_tenants_find_nothing(spark):
    table = spark.createDataFrame([(1, 10), (2, 20), (2, 20), (3, None)], "id int, owner int")
    asked = spark.createDataFrame([(1, 10, "x"), (1, 20, "x"), (2, 20, "x"), (3, None, "x"), (9, 10, "x")], "id int, asked_by int, why string")
    assert {(r.id, r.asked_by): r.found for r in relational.owned(table, asked, "id", "owner").collect()} == {(1, 10): True, (1, 20): False, (2, 20): True, (3, None): False, (9, 10): False}


def test_rules_of_new_messages(spark):
    convos = spark.createDataFrame([("c", 1), ("d", 2)], "convo_id string, user_id int")
    stored = spark.createDataFrame([("m1", "c", None), ("m2", "c", "m1"), ("n1", "d", "")], "message_id string, convo_id string, root_id string")
    schema = "message_id string, convo_id string, user_id int, parent_id string, root_id string, attached_files array<string>, attached_sources array<string>, text string"
    rows = [("a", "c", 1, None, "given", ["f"], ["s"], "t"), ("b", "c", 1, "m2", "given", [], ["s"], "t"), ("e", "c", 1, "m1", None, None, [], None), ("f", "c", None, None, None, None, None, ""), ("g", "c", 2, None, None, None, None, ""), ("h", "x", 1, None, None, None, None, ""), ("i", "c", 1, "n1", None, None, None, ""), ("j", "c", 1, "zz", None, None, None, "")]
    added, refused = relational.add_messages(convos, stored, spark.createDataFrame(rows, schema))
    assert sorted((r.message_id, r.root_id, r.attached_files, r.attached_sources) for r in added.collect()) == [("a", "given", ["f"], None), ("b", "m1", None, ["s"]), ("e", "m1", None, None)]
    assert dict(refused.collect()) == {"f": relational.MISSING_USER, "g": relational.NOT_OWNED, "h": relational.NOT_OWNED, "i": relational.OTHER_CONVO, "j": relational.NO_PARENT}
    assert added.columns == [x.split()[0] for x in schema.split(", ")]


def test_media_types(spark):
    assert len(DOCUMENT_TYPES) == 20
    rows = spark.createDataFrame([("TEXT/CSV; header=present",), ("text/none",), (None,), ("",)], "k string")
    assert [r[0] for r in rows.select(known_type(F.col("k"))).collect()] == ["text/csv", "unknown", "unknown", "unknown"]


def test_payload_of_any_name_stays(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0], 5, 6, 7)], "chunk_id long, vector array<double>, __norm int, __query_norm int, __block int")
    asked = spark.createDataFrame([(9, [1.0, 1.0])], "query_id long, query_vector array<double>")
    found = retrieval.vector_search(points, asked).first()
    assert (found["__norm"], found["__query_norm"], found["__block"]) == (5, 6, 7)


def plain_fusion(lists, k=60):
    """Reciprocal rank fusion of {list: [(id, payload)]}, in plain Python."""
    if len(lists) == 1:
        return [(i, None, p) for i, p in next(iter(lists.values()))]
    scores, first = {}, {}
    for n in sorted(lists):
        for rank, (i, p) in enumerate(lists[n]):
            scores[i] = scores.get(i, 0) + 1 / (k + rank + 1)
            first.setdefault(i, (n, rank, p))
    order = sorted(scores, key=lambda i: (-round(scores[i], 12), first[i][:2]))
    return [(i, scores[i], first[i][2]) for i in order]


def test_fusion_of_random_lists(spark):
    rng = random.Random(9)
    rows, wanted = [], {}
    for query in range(25):
        lists = {n: [(f"d{i}", f"{query}/{n}/{i}") for i in rng.sample(range(14), rng.randint(1, 9))] for n in rng.sample(range(5), rng.randint(1, 4))}
        rows += [(query, n, rank, i, "", {"p": p}) for n, found in lists.items() for rank, (i, p) in enumerate(found)]
        wanted[query] = plain_fusion(lists)
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "query_id int, list_idx int, rank int, id string, content string, extra map<string,string>")  # maps have no order
    for top_k in (None, 3):
        found = {}
        for r in post.reciprocal_rank_fusion(table, top_k=top_k).orderBy("query_id", "fused_rank").collect():
            found.setdefault(r.query_id, []).append((r.id, r.rrf_score, r.extra["p"]))
        for query, rows_ in wanted.items():
            cut = rows_[:top_k]
            assert [(i, p) for i, _, p in found[query]] == [(i, p) for i, _, p in cut]
            assert [s for _, s, _ in found[query]] == pytest.approx([s for _, s, _ in cut]) if cut[0][1] is not None else all(s is None for _, s, _ in found[query])
    plan = post.reciprocal_rank_fusion(table)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ExistingRDD") == 1


def test_filters_of_random_rows(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice(["x", "y", None]), rng.choice([None, 1.0, 2.0, 3.0])) for i in range(60)]
    table = spark.createDataFrame(rows, "id int, kind string, score double")
    for filters, keep in [
        ({"kind": "x"}, lambda r: r[1] == "x"),
        ({"kind": ["x", "y"], "score": lambda c: c >= 2}, lambda r: r[1] is not None and r[2] is not None and r[2] >= 2),
        ({"score": {1.0, 3.0}}, lambda r: r[2] in (1.0, 3.0)),
        ({"kind": "x", "none": 1}, lambda r: False),
        ({}, lambda r: True),
    ]:
        assert sorted(r.id for r in retrieval.metadata_filter(table, filters).collect()) == [r[0] for r in rows if keep(r)]


def test_templates(spark):
    rows = spark.createDataFrame([("x {b} }", 3), (None, 4)], "a string, b int")
    made = from_template("{{<{a}|{b}>}} {a}", a=F.col("a"), b=F.col("b"))
    assert [r[0] for r in rows.select(made).collect()] == ["{<x {b} }|3>} x {b} }", "{<|4>} "]
    assert rows.select(from_template("plain")).first()[0] == "plain"
    for bad in ({"a": F.col("a")}, {"a": F.col("a"), "b": F.col("b"), "c": F.col("b")}):
        with pytest.raises(ValueError):
            from_template("{a} {b}", **bad)


def test_base64_in_blocks(spark):
    import base64

    rng = random.Random(4)
    data = [rng.randbytes(n) for n in (0, 1, 2, 3, 5, 6, 7, 100)]
    rows = spark.createDataFrame([(bytearray(x),) for x in data] + [(None,)], "x binary")
    for block in (3, 6, BASE64_BLOCK):
        assert [r[0] for r in rows.select(base64_in_blocks(F.col("x"), block)).collect()] == [base64.b64encode(x).decode() for x in data] + [None]
    with pytest.raises(ValueError, match="three"):
        base64_in_blocks(F.col("x"), 4)


def test_eager_loading(spark):
    convos = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id int, owner int")
    users = spark.createDataFrame([(10, "a"), (10, "b")], "user int, name string")
    said = spark.createDataFrame([(1, 2, "y"), (1, 1, "x"), (9, 1, "z"), (None, 1, "n")], "convo int, turn int, text string")
    found = relational.eager(convos, "id", {"user": (users, "user", "owner")}, {"messages": (said, "convo", "turn")}).orderBy("id").collect()
    assert [(r.id, r.user and r.user.name, [m.text for m in r.messages]) for r in found] == [(1, "a", ["x", "y"]), (2, None, []), (3, None, [])]
