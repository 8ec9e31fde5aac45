"""Operator 7: neighbours in path order, wherever the ranges are cut."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.html_extract import main_text, neighbours


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_neighbours_are_those_of_the_whole_order(spark, ranges):
    rng = random.Random(5)
    keys = sorted({(f"h{rng.randint(0, 2)}", f"/{rng.randint(0, 60):03d}", rng.randint(-9, 9)) for _ in range(150)})
    mates = spark.createDataFrame([(*k, [k[2]]) for k in keys], "host string, path string, content long, hashes array<long>")
    found = {(r.host, r.path, r.content): (r.before, r.after) for r in neighbours(mates, ranges).collect()}
    assert len(found) == len(keys)
    for at, key in enumerate(keys):
        sides = [range(at - 1, at - 3, -1), range(at + 1, at + 3)]
        for near, side in zip(found[key], sides, strict=True):
            assert [(x.host, x.path, x.content) for x in near] == [keys[i] for i in side if 0 <= i < len(keys) and keys[i][0] == key[0]]


def test_large_host_loses_the_menu_of_each_section(spark):
    """More pages than one hashed class held; two neighbours share a menu that no other page has."""
    number = F.format_string("%06d", F.floor(F.col("id") / 2))
    page = F.concat(F.lit("<p>menu "), number, F.lit("</p><p>text "), F.col("id").cast("string"), F.lit("</p>"))
    pages = spark.range(20_400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), number, F.lit("/"), F.col("id").cast("string")).alias("url"), page.alias("html"))
    wrong = main_text(pages).join(pages.select("page_id"), "page_id").filter(F.col("text") != F.concat(F.lit("text "), F.col("page_id").cast("string")))
    assert wrong.count() == 0


def test_markup_protects_text_and_differencing_takes_shared_containers(spark):
    """Class names that only contain a telling word stay; a small container that the neighbour has too goes; copies are no mates."""
    body = "<p>{0} opening words of this very article</p><div class='related-work'>{0} related</div><div class='notice-board'>{0} board</div><table class='banner-data'><tr><td>{0} data</td></tr></table><div class='share-price'>{0} price</div>"
    promo = "<section class='promo'><p>buy this now</p></section>"
    article = lambda word, extra="": f"<article>{body.format(word)}{extra}</article>"
    rows = [(1, "http://a/1", article("one", promo)), (2, "http://a/2", article("two", promo)), (3, "http://a/3", article("two", promo)), (4, "http://b/1", article("six", promo))]
    rows += [(5, "http://a/4", "<article><p>own</p><article><p>a reader says</p></article></article>")]
    found = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = lambda word: "\n\n".join(f"{word} {x}" for x in ("opening words of this very article", "related", "board", "data", "price"))
    assert found[1] == whole("one") and found[2] == whole("two")
    assert found[4] == whole("six") + "\n\nbuy this now"  # no neighbour on its host
    assert found[5] == "own"
