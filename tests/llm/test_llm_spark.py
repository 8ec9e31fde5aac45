"""The training-data operators on Spark against brute force, with nulls, ties, repeats and empty tables."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, chat_quotes, embedding_dedup, exact_dedup, html_extract, language_id, mixing, packing, simhash_dedup, token_counts, token_output
from tessera.llm.common import identified
from tessera.llm.components import Forest, components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp int, rank string, component_id double"


def documents(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), "x", 1, "r", 0.5) for i, t, lang, source in rows], DOCS)


ROWS = [
    (3, "Hello  world again", "en", "a"),
    (1, "Helloworld again", "en", "a"),
    (2, "Hello\tworld\nagain ", "en", None),
    (2, "Hello\tworld\nagain ", "en", None),
    (None, "Helloworldagain!", None, ""),
    (None, "Hello world again !", None, ""),
    (4, None, "de", "b"),
    (5, "", "de", "b"),
    (6, " \r\n", None, "b"),
    (7, "é" * 30, "fr", "b"),
    (8, "word " * 4000, "en", "c"),
    (9, "Word " * 4000, "en", "c"),
]


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def from_sql(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    found = con.sql(sql)
    return found.columns, Counter(found.fetchall())


def pandas_docs(rows):
    frame = pd.DataFrame([(i, t, lang, s) for i, t, lang, s in rows], columns=["doc_id", "text", "lang", "source"])
    return frame.astype({"doc_id": "Int64"})


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    forest = Forest()
    for a, b in edges:
        if a is not None:
            forest.join(a, b)
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()))
    linked = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    assert found == {x: forest.find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_groups_match_sql(spark):
    found = exact_dedup.exact_groups(documents(spark, ROWS))
    names, wanted = from_sql(exact_dedup.EXACT_SQL, documents=pandas_docs(ROWS))
    assert rows_of(found.select(*names)) == wanted
    assert exact_dedup.exact_groups(documents(spark, ROWS[:0])).count() == 0


def test_exact_groups_tell_contents_apart_that_share_a_digest(spark):
    weak = lambda content: exact_dedup.sha256(F.substring(content, 1, 2))
    names, wanted = from_sql(exact_dedup.EXACT_SQL, documents=pandas_docs(ROWS))
    assert rows_of(exact_dedup.exact_groups(documents(spark, ROWS), weak).select(names)) == wanted
    assert rows_of(exact_dedup.exact_dedup(documents(spark, ROWS), weak).select("text")) == rows_of(exact_dedup.exact_dedup(documents(spark, ROWS)).select("text"))


def test_saved_index_inserts_and_deletes(spark, tmp_path):
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    index = exact_dedup.SavedIndex(spark, f"file://{tmp_path}/index", buckets=3)
    asked = docs((9, "a b"), (8, "c"), (7, None), (6, "new"))
    owners = lambda: {r.doc_id: r.owner_id for r in index.owners(asked).collect()}
    assert owners() == {9: None, 8: None, 7: None, 6: None}
    index.update(inserted=docs((2, "ab"), (1, "a\tb"), (3, "c"), (4, ""), (None, "c")))
    assert owners() == {9: 1, 8: 3, 7: 4, 6: None}
    index.update(deleted=docs((3, "c"), (None, "c"), (0, "ab"), (0, "never held")), inserted=docs((5, " ab"), (6, "new")))
    assert owners() == {9: 1, 8: None, 7: 4, 6: 6}  # no document 0 was held
    assert {(r.content, r.doc_id, r.copies) for r in index.live().collect()} == {("ab", 1, 1), ("ab", 2, 1), ("ab", 5, 1), ("", 4, 1), ("new", 6, 1)}
    index.update(inserted=docs((11, "c")))
    assert owners()[8] == 11


def test_saved_index_deletes_one_copy_at_a_time_and_verifies_content(spark, tmp_path):
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    same = lambda content: F.unhex(F.lit("00" * 16))  # noqa: E731  every content shares this digest
    for name, options in (("own", {}), ("one", {"digest": same})):
        index = exact_dedup.SavedIndex(spark, f"file://{tmp_path}/{name}", buckets=2, **options)
        owner = lambda text: index.owners(docs((0, text))).first().owner_id  # noqa: B023, E731
        index.update(inserted=docs((1, "a b"), (2, "ab"), (2, "a  b"), (3, "longer")))
        index.update(deleted=docs((1, "a b")))
        assert (owner("ab"), owner("longer")) == (2, 3)
        index.update(deleted=docs((2, "ab")))
        assert owner("ab") == 2  # the other copy
        index.update(deleted=docs((2, "ab"), (3, "other text")), inserted=docs((4, "x")))
        assert (owner("ab"), owner("longer"), owner("x")) == (None, 3, 4)


def test_saved_index_against_a_plain_one(spark, tmp_path):
    rng = random.Random(12)
    index, held = exact_dedup.SavedIndex(spark, f"file://{tmp_path}/index", buckets=3), Counter()
    for _ in range(4):
        gone, come = ([(rng.randint(0, 4), rng.choice("abc ")) for _ in range(n)] for n in (12, 15))
        for key in gone:
            held[key] = max(0, held[key] - 1)
        held.update(come)
        index.update(*(spark.createDataFrame(rows, "doc_id long, text string") for rows in (come, gone)))
        wanted = Counter()
        for (i, text), n in held.items():
            wanted[i, text.strip()] += n
        assert {(r.doc_id, r.content): r.copies for r in index.live().collect()} == {k: n for k, n in wanted.items() if n}


def test_rows_of_files_that_are_listed_twice(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([(i, f"text {i // 2} of some words and more", "s") for i in range(6)], "doc_id long, text string, source string").coalesce(1).write.parquet(path)
    twice = spark.read.parquet(path, path)
    inside = spark.read.parquet(path, *spark.read.parquet(path).inputFiles())
    for df in (twice, inside):
        assert df.count() == 12
        known, row = identified(df)
        assert known.select(*row).distinct().count() == 12
        groups = exact_dedup.exact_groups(df).collect()
        assert sum(r.kept for r in groups) == 3 and {r.group_size for r in groups} == {4}
        assert exact_dedup.exact_dedup(df).count() == 3 and simhash_dedup.simhash_dedup(df).count() <= 3
    assert mixing.mixed_documents(twice).count() == mixing.mix(twice).count()
    once = spark.read.parquet(path)
    assert "__tessera_file" in identified(once)[0].columns and not identified(once)[0].inputFiles()[0].count("rows-")


def test_grouping_by_parts_of_an_index(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_ENTRIES", 3)
    wanted = rows_of(exact_dedup.exact_groups(documents(spark, ROWS)))
    monkeypatch.setattr(exact_dedup, "MAX_ENTRIES", 10**6)
    assert wanted == rows_of(exact_dedup.exact_groups(documents(spark, ROWS)))


def test_rows_of_a_parquet_scan_keep_their_identity(spark, tmp_path):
    rows = [(1, "same", 5), (1, "same", 5), (None, "same", None), (2, None, 7)]
    spark.createDataFrame(rows, "doc_id long, text string, __tessera_file long").repartition(3).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for source in (df, df.filter("text = 'same'"), df.unionByName(df)):
        known, row = identified(source)
        assert known.select(*row).distinct().count() == source.count() and not set(row) & set(df.columns)
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns and sorted(r.text or "" for r in kept.collect()) == ["", "same"]
    assert simhash_dedup.near_dedup(df).count() == 2
    mixed = mixing.mixed_documents(df.withColumn("source", F.lit("s")))
    assert mixed.count() == 4


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    kept = exact_dedup.exact_dedup(documents(spark, ROWS))
    assert kept.columns == documents(spark, ROWS).columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(2, ROWS[2][1]), (None, ROWS[5][1]), (6, " \r\n"), (7, ROWS[9][1]), (8, ROWS[10][1]), (9, ROWS[11][1])])


def _components(ids, linked):
    forest = Forest()
    for i in range(len(ids)):
        forest.find(i)
        for j in range(i):
            if linked(i, j):
                forest.join(i, j)
    least = defaultdict(list)
    for i in range(len(ids)):
        if ids[i] is not None:
            least[forest.find(i)].append(ids[i])
    return [min(least[forest.find(i)], default=None) for i in range(len(ids))]


@pytest.mark.parametrize(("short_list", "long_list"), [(64, 512), (2, 512), (1, 2)])
@pytest.mark.parametrize("max_bits", [3, 2, 1, 0])
def test_links_find_all_components(spark, short_list, long_list, max_bits):
    rng = random.Random(max_bits)
    fps = {0, 2**64 - 1}
    for _ in range(12):
        one = rng.getrandbits(64)
        fps.add(one)
        for _ in range(rng.choice([1, 10])):
            for _ in range(rng.randint(1, 4)):
                one ^= 1 << rng.randint(0, 63)
            fps.add(one)
    base = rng.getrandbits(40) << 24
    fps |= {base | rng.getrandbits(6) for _ in range(15)}  # a dense group in one posting list
    fps = sorted(fps)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    edges = [tuple(r) for r in simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), max_bits, short_list, long_list).collect()]
    back = {s: i for i, s in enumerate(signed)}
    assert all((fps[back[a]] ^ fps[back[b]]).bit_count() <= max_bits for a, b in edges)
    pairs = {frozenset((back[a], back[b])) for a, b in edges}
    wanted = _components(list(range(len(fps))), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= max_bits)
    assert _components(list(range(len(fps))), lambda i, j: frozenset((i, j)) in pairs) == wanted


def test_simhash_groups(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [*ROWS, (20, text, "en", "a"), (21, text.upper() + " w400", "en", "a"), (22, text + " other words here that move many bits " * 30, "en", "a"), (23, "\t", "en", "a")]
    found = simhash_dedup.simhash_groups(documents(spark, rows)).collect()
    fps = [simhash_dedup.fingerprint(t) for _, t, _, _ in rows]
    wanted = _components([i for i, *_ in rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == Counter((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, wanted, strict=True))
    kept = simhash_dedup.simhash_dedup(documents(spark, rows)).collect()
    assert {r.doc_id for r in kept} >= {1, 4, 7, 8, 20} and not {r.doc_id for r in kept} & {5, 6, 9, 21, 23}
    assert simhash_dedup.simhash_groups(documents(spark, [])).count() == 0


def test_language_id(spark):
    words = {"aa": "tala mura keno", "bb": "xwyz qvqv jjkk", "cc": "öäü ßöä üüäö"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randint(2, 30))), lang, "s") for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    odd = [(1000, None, "aa", "s"), (1001, "12 -- !", "aa", "s"), (None, "tala mura", "aa", "s"), (1002, "tala " * 20000, None, "s"), (1002, "tala " * 20000, None, "s")]
    found = language_id.language_id(documents(spark, rows + odd), per_language=20).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(rows) + len(odd)
    assert all(by_id[i].lang_pred == lang for i, _, lang, _ in rows)
    assert all(by_id[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert (by_id[1000].lang_pred, by_id[1000].score, by_id[1001].lang_pred) == ("und", 0, "und")
    assert by_id[None].lang_pred == "aa" and not by_id[None].held_out and by_id[1002].lang_pred == "aa" and 0 <= by_id[1002].score <= 1
    kept = language_id.keep_identified(documents(spark, rows + odd), per_language=20)
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").replace(" double", "").split(", ")
    assert kept.count() == len(rows) + 3
    assert language_id.language_id(documents(spark, [])).count() == 0
    assert {r.lang_pred for r in language_id.language_id(documents(spark, odd[:2])).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.language_id(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = found.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert n > 150 and right / n > 0.97


def test_mixing_matches_sql(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), "en", s) for i, s in enumerate([None] * 4 + [""] * 5 + ["big"] * 60 + ["small"] * 9 + ["mid"] * 20)]
    rows += [(500, None, "en", "none"), (501, " ", "en", "none"), (None, "a b", "en", "mid"), (5, rows[5][1], "en", "")]
    names, wanted = from_sql(mixing.MIX_SQL, documents=pandas_docs(rows))
    found = mixing.mix(documents(spark, rows)).selectExpr(*[f"round({n}, 9) as {n}" if n == "target_weight" else n for n in names])
    assert rows_of(found) == wanted
    taken = Counter((r[names.index("doc_id")], r[names.index("source")]) for r in wanted.elements())
    mixed = mixing.mixed_documents(documents(spark, rows))
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == taken and mixed.columns == documents(spark, []).columns
    assert mixing.mix(documents(spark, [])).count() == 0


def test_mixing_budget_blocks_and_limit(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "ab"[i % 5 == 0]) for i in range(400)]
    options = {"budget": 3000, "max_repetition": 3.0, "block_docs": 16}
    found = mixing.mix(documents(spark, rows), **options).toPandas()
    plan = {r["source"]: r for r in mixing.mix_plan(documents(spark, rows), [], 3000, 3.0)[1]}
    for source, part in found.groupby("source"):
        p = plan[source]
        assert p["source_budget"] - 7 < part.n_tokens.sum() <= p["source_budget"] and part.groupby("doc_id").size().max() <= 3
        assert (part.groupby("epoch").block.nunique() > 1).all()
        part = part.sort_values("source_start")
        assert ((part.source_start + part.n_tokens).values[:-1] <= part.source_start.values[1:]).all()
    again = mixing.mix(documents(spark, rows).repartition(7), **options).toPandas()
    assert set(map(tuple, found.values)) == set(map(tuple, again.values))


def _ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_path())
    return [[*x.ids, 2] for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark):
    found = packing.pack(documents(spark, ROWS), capacity=64, parts=3).collect()
    wanted = Counter()
    for (doc_id, *_), ids in zip(ROWS, _ids([r[1] for r in ROWS]), strict=True):
        cuts = [0, *range(len(ids) - (len(ids) - 1) // 64 * 64, len(ids) + 1, 64)]
        wanted.update((doc_id, k, a, b - a, _crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= sum(r.length for r in found) / 64 + 2
    assert packing.pack(documents(spark, [])).count() == 0


def test_token_round_trip(spark):
    rows = sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0])
    found = token_output.token_round_trip(documents(spark, ROWS).repartition(3)).collect()
    ids = _ids([r[1] for r in rows])
    assert len(found) == len(rows) and [r.n_tokens for r in sorted(found, key=lambda r: r.start)] == [len(x) for x in ids]
    starts = np.cumsum([0, *map(len, ids)])
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.start for r in ordered][0] == 0 and sum(r.n_tokens for r in ordered) == starts[-1]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:], strict=False))
    assert [r.doc_id for r in ordered] == [r[0] for r in rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((r[0], len(x), _crc(x)) for r, x in zip(rows, ids, strict=True))
    assert token_output.token_round_trip(documents(spark, [])).count() == 0


def test_token_shards(spark, tmp_path):
    uri = f"file://{tmp_path}/set"
    shards = token_output.write_tokens(documents(spark, ROWS), uri, shards=2, id_width=4)
    table = [r.asDict() for r in shards.collect()]
    back = token_output.read_tokens(spark, uri, shards, with_ids=True).collect()
    assert sorted(bytes(r.ids) for r in back) == sorted(np.array(x, "<u4").tobytes() for x in _ids([r[1] for r in ROWS]))
    shard = token_output.Shard(uri, table[0]["shard"])
    assert len(shard.ids(0)) == 4 * int(shard.index["n_tokens"][0])
    (tmp_path / "set" / "dictionary").write_bytes(b"another one")
    with pytest.raises(ValueError, match="another dictionary"):
        token_output.Shard(uri, table[0]["shard"])


def test_length_histogram(spark):
    found = token_counts.length_histogram(documents(spark, ROWS))
    lengths = [len(x) - 1 for x in _ids([r[1] for r in ROWS])]
    rows = {r.length: r for r in found.collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert r.truncated_total == sum(min(x, n) for x in lengths) and r.share_at_most == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    assert token_counts.quantile(found, 0.5).first()[0] == sorted(lengths)[len(lengths) // 2 - 1]
    totals = {r.context_limit: r for r in token_counts.totals_at(found, [1, 10, 99999]).collect()}
    assert [totals[k].tokens_left for k in (1, 10, 99999)] == [sum(min(x, k) for x in lengths) for k in (1, 10, 99999)]
    assert totals[10].docs_cut == sum(x > 10 for x in lengths)
    assert token_counts.length_histogram(documents(spark, [])).count() == 0


def test_lengths_far_apart(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCH", 3)
    found = token_counts.length_histogram(documents(spark, ROWS)).collect()
    lengths = [len(x) - 1 for x in _ids([r[1] for r in ROWS])]
    assert all(r.docs_at_least == sum(x >= r.length for x in lengths) for r in found)


def test_limits_of_the_length_histogram(spark):
    lengths = [len(x) - 1 for x in _ids([r[1] for r in ROWS])]
    found = {r.length: r for r in token_counts.length_histogram(documents(spark, ROWS), limits=(3, 100_000)).collect()}
    assert set(found) == {*lengths, 3, 100_000} and found[100_000].n_docs == 0
    for limit in (3, 100_000):
        assert found[limit].truncated_total == sum(min(x, limit) for x in lengths)
    kept = {r.context_limit: r for r in token_counts.totals_at(token_counts.length_histogram(documents(spark, ROWS)), [3, 4, 100_000]).collect()}
    for limit, r in kept.items():
        assert (r.docs_whole, r.docs_cut, r.tokens_left) == (sum(x <= limit for x in lengths), sum(x > limit for x in lengths), sum(min(x, limit) for x in lengths))


PAGES = "page_id long, url string, html string, text int, host string, lines double"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "h", 0.5) for i, u, h in rows], PAGES)


def test_main_text(spark):
    wrap = "<html><body><div>top line</div>{}<div>bottom line</div></body></html>"
    rows = [
        (1, "http://a.b/x/1", wrap.format("<p>first &amp; own</p>")),
        (2, "http://a.b/x/2", wrap.format("<p>second own</p><div>also here</div>")),
        (2, "http://a.b/x/2", wrap.format("<p>second own</p><div>also here</div>")),
        (3, "http://c.d/only", wrap.format("<p>alone</p>")),
        (4, "http://a.b/x/3", "<nav>n</nav><article><p>top line</p><p>marked</p></article><div>bottom line</div>"),
        (5, None, None),
        (None, "http://e.f", "<article>" + "<p>long</p>" * 20000 + "</article>"),
    ]
    found = html_extract.main_text(pages(spark, rows))
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in found.collect())
    texts = {1: "first & own", 2: "second own\n\nalso here", 3: "top line\n\nalone\n\nbottom line", 4: "top line\n\nmarked", 5: "", None: "\n\n".join(["long"] * 20000)}
    assert got == Counter((i, u, texts[i], len(texts[i])) for i, u, _ in rows)
    assert html_extract.main_text(pages(spark, [])).count() == 0


def test_articles_of_test_pages_are_whole(spark):
    """Every page of the test table has one article; its text is what plain parsing of it gives."""
    import html
    import re

    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r.text for r in html_extract.main_text(table).collect()}
    for r in table.collect():
        inner = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        parts = [html.unescape(re.sub(r"<[^>]*>", " ", p)) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert found[r.page_id] == "\n\n".join(" ".join(p.split()) for p in parts if p.split())


CHAT = [
    (1, 0, "user", "Hello there friend\nsecond line here"),
    (1, 1, "assistant", "> Hello there friend\nI answer so."),
    (1, 2, "user", ">> Hello there friend\n> I  answer SO.\nthanks, more\n\nanother para"),
    (1, 3, "user", "unrelated"),
    (1, 3, "user", "unrelated"),
    (1, 4, "assistant", "> another\n> para\nok\r\n> unrelated"),
    (2, 0, "user", None),
    (2, 1, None, ">\n> > \n"),
    (None, 1, "user", "> x"),
    (3, None, "user", "> Hello there friend"),
    (3, 0, "u", ">not known\n" + "long line\n" * 3000),
    (4, 0, "user", "a"),
    *[(4, i, "user", f"> {'a' if i == 1 else i - 1}\n{i}") for i in range(1, 12)],
]


def test_chat_threads(spark):
    table = spark.createDataFrame([(c, t, r, x, "k", 1) for c, t, r, x in CHAT], "conv_id long, turn long, role string, text string, lines string, position int")
    found = chat_quotes.chat_threads(table)
    by = {(r.conv_id, r.turn): r for r in found.collect()}
    assert [by[1, t].parent_turn for t in range(5)] == [None, 0, 1, None, 2]
    assert [by[1, t].depth for t in range(5)] == [0, 1, 2, 0, 3] and by[1, 4].thread_turn == 0 and by[1, 4].text == "ok"
    assert by[4, 11].depth == 11 and by[4, 11].thread_turn == 0 and by[4, 11].position == 12
    frame = pd.DataFrame(CHAT, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    names, wanted = from_sql(chat_quotes.CHAT_SQL, conversations=frame)
    assert rows_of(found.select(*names)) == wanted
    assert chat_quotes.chat_threads(table.limit(0)).count() == 0
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("tile", [40, 4096])
def test_embedding_groups(spark, tile):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(30, 16)), 8, 0) + rng.normal(size=(240, 16)) * rng.choice([0, 0.05, 0.2, 0.3], size=(240, 1))
    x = np.vstack([x, x[:30], 2 * x[:5]])
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 3), (904, [2.0] * 3), (905, []), (906, [1.0, None]), (907, [float("inf"), 1.0]), (None, [5.0, 6.0])]
    rows = [(i, v.tolist(), "l") for i, v in enumerate(x)] + [(i, v, "l") for i, v in odd]
    found = embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string"), tile=tile).toPandas()
    got = found[found.vec_id < 900].sort_values("vec_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    assert (got.n_links.to_numpy() == linked.sum(1) - 1).all()
    assert got.component_id.tolist() == _components(list(range(len(x))), lambda i, j: linked[i, j])
    assert (got.kept == (got.vec_id == got.component_id)).all()
    rest = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found.itertuples() if r.vec_id >= 900}
    assert rest == {**{i: (0, i, True) for i in (900, 901, 902, 905, 906, 907)}, 903: (1, 903, True), 904: (1, 903, False)}
    assert len(found) == len(rows)


def test_no_embeddings(spark):
    assert embedding_dedup.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
