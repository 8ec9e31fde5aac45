"""Main text of web pages: article zones, and differencing against the page of nearest URL (operator 7).

A page is read into blocks, one line of text each. Elements that HTML itself says
hold no article (``nav``, ``footer``, ``aside``, ``form``, scripts, an ``article``
inside an article, which is a reader's comment, and ARIA roles for the same) are
not read, nor are containers whose whole class or id is one of the plain names in
KINDS; headings and paragraphs never go by name, and no form or named container
that holds more than half of the page's text does.

Every page is paired with the page of nearest URL path on its host, their lines
are aligned by longest common subsequence, and shared lines go. Neighbours stand
next to each other in path order; of the two on either side the one with the
longest common path prefix comes first. A copy of the page is no mate for it, then
the next one is tried. What tells a copy is what the pages share beside the lines that
nearly all of the host's pages hold (``WIDE_SHARE``): more than ``MIRROR`` of the page's other characters. A page
whose ``SIDE`` neighbours are all copies tries those 4, 8, 16 ... pages away on either
side, up to the ends of the host. The order is cut into ranges, which may split a
host, so no task holds a whole large host; the pages at the ends of a range are
handed to the ranges beside it, so the pairs are the same.

Markup protects text from that: where a page marks its article (``article``,
``main``), nothing else is text, and of the article's lines only those go that
stand in a classed container (``div``, ``section``, lists, tables) of a kind that
holds less than half of the article, since paragraphs are shared by pages that
carry the same article, or one passage of it, and would be lost.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import matching, prepare, written

#: Elements whose content is no text of a page, and is not markup either.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
#: Elements that hold no part of the article.
OUTSIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "template", "svg", "button", "select", "head", "object", "canvas", "audio", "video", "math"}
#: Elements that begin and end a block.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without content.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Whole names of a class or id that say what an element is, of the kinds which are no article. Never parts of a name.
KINDS = {"ad", "ads", "advert", "adverts", "advertisement", "comment", "comments", "footer", "menu", "notice", "sidebar"}
#: Roles of what surrounds an article.
OUTSIDE_ROLES = {"navigation", "banner", "comment", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
#: Elements that never go by their name alone.
NAMELESS = {"html", "body", "main", "article", "p", "h1", "h2", "h3", "h4", "h5", "h6", "a", "b", "i", "em", "strong", "span", "td", "th", "tr", "li"}
#: Elements whose class or id makes them a container of their own inside an article.
CONTAINER = {"div", "section", "ul", "ol", "dl", "table", "figure", "details"}
#: A neighbour that shares more than this part of a page's characters, beside lines of nearly all the host, is a copy of it.
MIRROR = 0.8
#: A line belongs to the host, not to a page, if this share of its distinct pages hold it, and so many at least.
WIDE_SHARE = 0.75
WIDE = 3
#: Neighbours that are tried on each side.
SIDE = 2

_token = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)""", re.S)
_attribute = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in _attribute.findall(text)}


def _surrounds(tag: str, attributes: dict[str, str], in_article: bool, in_tag: bool) -> int:
    """2 if an element holds no part of the article, 1 if so unless it holds most of the page, else 0; ``in_tag``: it lies in an ``article`` element."""
    if tag == "form":
        return 1
    if tag in OUTSIDE or tag == "header" and not in_article or tag == "article" and in_tag:
        return 2
    if not attributes or tag in ("html", "body", "main"):
        return 0
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in OUTSIDE_ROLES:
        return 2
    return int(tag not in NAMELESS and any(name.lower() in KINDS for key in ("class", "id") for name in attributes.get(key, "").split()))


def blocks(page: str | None) -> tuple[list[str], list[bool], list[str | None]]:
    """Lines of a page in order, for each whether it lies in a marked article, and the kind of classed container around it there."""
    spared: set[int] = set()
    while True:
        lines, inside, kinds, whole, held = _blocks(page or "", spared)
        largest = max(held, key=held.get, default=None)
        if largest is None or 2 * held[largest] <= whole:
            return lines, inside, kinds
        spared.add(largest)  # a form or named container around the page itself


def _blocks(page: str, spared: set[int]) -> tuple[list[str], list[bool], list[str | None], int, dict[int, int]]:
    """As ``blocks``, with the page's characters, and those inside of each form and named container that was left out, by its place among the tags."""
    lines: list[str] = []
    inside: list[bool] = []
    kinds: list[str | None] = []
    text: list[str] = []
    held: dict[int, int] = {}
    stack: list[tuple[str, int, bool, str | None]] = []  # tag, left out, article, kind of container
    out = articles = tagged = at = whole = opened = 0
    outer: int | None = None  # the form or named container that is left out here

    def close() -> None:
        if text:
            line = " ".join("".join(text).split())
            text.clear()
            if line:
                lines.append(line)
                inside.append(articles > 0)
                kinds.append(next((x[3] for x in reversed(stack) if x[3]), None) if articles else None)

    def pop() -> None:
        nonlocal out, articles, tagged
        tag, left_out, article, _ = stack.pop()
        out -= left_out > 0
        articles -= article
        tagged -= article and tag == "article"

    def read(part: str) -> None:
        nonlocal whole
        size = len(part) - part.count(" ") - part.count("\n") - part.count("\t")
        whole += size
        if not out:
            text.append(entities.unescape(part))
        elif outer is not None:
            held[outer] += size

    size = len(page)
    while at < size:
        found = _token.search(page, at)
        if found is None:
            rest = page[at:]
            cut = re.search(r"<[/!?A-Za-z][^>]*\Z", rest)  # a tag that the end of the page cuts off
            read(rest[: cut.start()] if cut else rest)
            break
        if found.start() > at:
            read(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            close()
        elif tag == "br" and not out:
            text.append(" ")
        if found[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                while len(stack) > depth:
                    pop()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID or found[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK and stack and stack[-1][0] == "p":  # a block ends an open paragraph
            pop()
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            pop()
        opened += 1
        attributes = _attributes(found[3]) if found[3] else {}
        left_out = 0 if out else _surrounds(tag, attributes, articles > 0, tagged > 0)
        if left_out == 1 and opened in spared:
            left_out = 0
        if left_out:
            outer = opened if left_out == 1 else None
            if outer is not None:
                held[outer] = 0
        article = not out and not left_out and (tag in ("article", "main") or attributes.get("role") == "main")
        kind = f"{tag} {attributes.get('class', '')} {attributes.get('id', '')}" if articles and tag in CONTAINER and (attributes.get("class") or attributes.get("id")) else None
        stack.append((tag, left_out, article, kind))
        out += left_out > 0
        articles += article
        tagged += article and tag == "article"
    close()
    return lines, inside, kinds, whole, held


def shown_and_open(lines: list[str], inside: list[bool], kinds: list[str | None]) -> tuple[list[int], list[int]]:
    """Positions of the lines that can be text, and of those among them that differencing may delete."""
    if not any(inside):
        every = list(range(len(lines)))
        return every, every
    shown = [i for i, x in enumerate(inside) if x]
    held: dict[str | None, int] = {}
    for i in shown:
        held[kinds[i]] = held.get(kinds[i], 0) + len(lines[i])
    whole = sum(held.values())
    return shown, [i for i in shown if kinds[i] is not None and 2 * held[kinds[i]] < whole]


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (Hunt and Szymanski)."""
    shared: set[int] = set()
    start, end_a, end_b = 0, len(a), len(b)
    while start < min(end_a, end_b) and a[start] == b[start]:
        shared.add(start)
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
        shared.add(end_a)
    places: dict[int, list[int]] = {}
    for j in range(end_b - 1, start - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple[int, int]] = []  # (position in a, link before) of each step
    tops: list[int] = []
    for i in range(start, end_a):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            links.append((i, tops[k - 1] if k else -1))
            if k == len(ends):
                ends.append(j)
                tops.append(len(links) - 1)
            else:
                ends[k], tops[k] = j, len(links) - 1
    at = tops[-1] if tops else -1
    while at >= 0:
        shared.add(links[at][0])
        at = links[at][1]
    return shared


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def host_and_path(url: str | None) -> tuple[str, str]:
    """Lower-cased host and the rest from the path on; a URL without a host counts as path of the empty host."""
    found = re.match(r"(?:[A-Za-z][\w+.-]*:)?//([^/?#]*)([^#]*)", url or "")
    return (found[1].lower(), found[2] or "/") if found else ("", url or "")


_PARSED = "page_id long, url string, host string, path string, lines array<string>, places array<int>, hashes array<long>, sizes array<int>, open array<int>, content long"


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lines`` stand at ``places`` of the page, whose lines have ``hashes`` and ``sizes``; those at ``open`` may be deleted."""
    import xxhash

    names = [x.split()[0] for x in _PARSED.split(", ")]
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), ints, longs, ints, ints, pa.int64()]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            rows = []
            part = batch.slice(at, 512)
            for page_id, url, page in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("html"), strict=True):
                lines, inside, kinds = blocks(page.as_py())
                shown, loose = shown_and_open(lines, inside, kinds)
                hashes = [signed(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"))) for x in lines]
                content = signed(xxhash.xxh64_intdigest(repr((hashes, loose))))
                rows.append((page_id, url, *host_and_path(url), [lines[i] for i in shown], shown, hashes, [len(x) for x in lines], loose, content))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def is_copy(page: dict, near: dict, shared: set[int]) -> bool:
    """Whether ``shared``, lines of ``page``, are more than ``MIRROR`` of it beside lines of nearly all its host; where it has no others, of the whole page."""
    if near["content"] == page["content"]:
        return True
    wide = set(page["wide"] or ())
    own = [i for i, x in enumerate(page["hashes"]) if x not in wide] or range(len(page["hashes"]))
    return sum(page["sizes"][i] for i in own if i in shared) > MIRROR * sum(page["sizes"][i] for i in own)


def shared_lines(page: dict, near: list[dict]) -> set[int] | None:
    """Lines of ``page`` that its mate has as well: of ``near``, by URL, the first that is no copy of it; None without such a page."""
    order = sorted(range(len(near)), key=lambda k: (-_prefix(near[k]["path"], page["path"]), k))
    for k in order:
        shared = common_lines(page["hashes"], near[k]["hashes"])
        if not is_copy(page, near[k], shared):
            return shared
    return None


_GONE = "host string, path string, content long, gone array<int>"


def _difference(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, content, gone) of the pages that can lose lines: those lines, or null without a mate among ``before`` and ``after``."""
    names = ["host", "path", "content", "gone"]
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            # Nearest first; between equally near pages the one before.
            near = [x for pair in itertools.zip_longest(row["before"], row["after"]) for x in pair if x]
            shared = shared_lines(row, near)
            if row["open"]:
                rows.append((row["host"], row["path"], row["content"], None if shared is None else sorted(shared.intersection(row["open"]))))
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32())], strict=True)], names=names)


def wide_lines(mates: DataFrame, hosts: DataFrame) -> DataFrame:
    """``(host, wide array<long>)``: lines that ``WIDE_SHARE`` of the distinct pages of a host of ``hosts`` hold, and ``WIDE`` at least."""
    own = mates.join(hosts, "host", "left_semi")
    pages = own.groupBy("host").agg(F.count("*").alias("pages"))
    lines = own.select("host", F.explode(F.array_distinct("hashes")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    held = lines.join(pages, "host").filter((F.col("n") >= WIDE) & (F.col("n") >= WIDE_SHARE * F.col("pages")))
    return held.groupBy("host").agg(F.collect_list("line").alias("wide"))  # hardly more than the lines of a page


def farther(mates: DataFrame, left: DataFrame, distance: int) -> DataFrame:
    """The pages of ``left``, rows of ``mates`` with their ``place`` in the order of all, with those ``distance`` places before and after on their host."""
    other = lambda name, step: mates.select("host", (F.col("place") + step).alias("place"), F.struct("host", "path", "content", "hashes").alias(name))
    found = left.join(other("before", distance), ["host", "place"], "left").join(other("after", -distance), ["host", "place"], "left")
    listed = lambda x: F.filter(F.array(x), lambda y: y.isNotNull()).alias(x)
    return found.select(*left.columns, listed("before"), listed("after"))


def in_order(mates: DataFrame, keys: list[str], ranges: int) -> DataFrame:
    """``mates`` with their ``place`` in the order of ``keys`` from 0, counted range by range."""
    ranged = written(mates.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)), "page-ranges")
    first = ranged.groupBy("range").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # one row a range
    first = first.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n") - F.col("first")).alias("begin"))
    return ranged.join(F.broadcast(first), "range").select(*mates.columns, (F.col("begin") + F.col("at")).alias("place"))


def neighbours(mates: DataFrame, ranges: int, side: int = SIDE) -> DataFrame:
    """``mates (host, path, content, hashes, ...)``, distinct in the first three, with the ``side`` nearest pages ``before`` and ``after`` in that order on the host, nearest first."""
    keys = ["host", "path", "content"]
    ranged = written(mates.repartitionByRange(ranges, *keys).withColumn("range", F.spark_partition_id()), "page-ranges")
    page = F.struct(*keys, "hashes")
    order, whole, across = Window.partitionBy("range").orderBy(*keys), Window.partitionBy("range"), Window.orderBy(*keys)
    ranked = ranged.withColumns({"rank": F.row_number().over(order), "last": F.count("*").over(whole)})
    edges = ranked.filter((F.col("rank") <= side) | (F.col("rank") > F.col("last") - side))  # 2 * side rows a range
    edges = edges.withColumns({"range_before": F.collect_list(page).over(across.rowsBetween(-side, -1)), "range_after": F.collect_list(page).over(across.rowsBetween(1, side))})
    ends = edges.filter("rank = 1").select("range", "range_before").join(edges.filter("rank = last").select("range", "range_after"), "range")
    inside = ranked.withColumns({"before": F.collect_list(page).over(order.rowsBetween(-side, -1)), "after": F.collect_list(page).over(order.rowsBetween(1, side))}).join(ends, "range")
    before = F.reverse(F.concat(F.when(F.col("rank") <= side, F.col("range_before")).otherwise(F.array()), "before"))
    after = F.concat("after", F.when(F.col("rank") > F.col("last") - side, F.col("range_after")).otherwise(F.array()))
    same_host = lambda x: F.filter(F.slice(x, 1, side), lambda y: y["host"] == F.col("host"))
    return inside.select(*mates.columns, same_host(before).alias("before"), same_host(after).alias("after"))


def main_text(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per row of ``pages (page_id, url, html, ...)``: page_id, url, text, n_chars.

    Character references are decoded, white space inside a block is one space,
    blocks are joined by two line feeds in page order. A null or empty page has
    the empty text. A null URL counts as a path of the empty host. Repeated rows
    stay repeated. An empty table gives no rows. Pages stay where they were read:
    only hashes of lines are sorted, and only pages that lose lines are joined.
    """
    spark = prepare(pages)
    parsed = written(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_parse, _PARSED), "pages")
    mates = parsed.groupBy("host", "path", "content").agg(*(F.first(x).alias(x) for x in ("hashes", "sizes", "open")))  # equal content, equal lines
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["host", "path", "content"]
    loose = written(parsed.filter(F.size("open") > 0).select("host").distinct(), "open-hosts")
    wide = None
    if not loose.isEmpty():  # else no page can lose a line
        mates = written(mates, "mates")
        wide = written(wide_lines(mates, loose), "wide-lines")
    paired = neighbours(mates, ranges)
    paired = paired.withColumn("wide", F.lit(None).cast("array<long>")) if wide is None else paired.join(wide, "host", "left")
    gone = tried = written(paired.mapInArrow(_difference, _GONE), "shared-lines")
    if wide is not None:
        placed = written(in_order(mates, keys, ranges), "places")
        size = placed.groupBy("host").agg((F.max("place") - F.min("place")).alias("span"))
        farthest = size.join(loose, "host", "left_semi").agg(F.max("span")).first()[0]
        distance = 2 * SIDE
        while distance <= farthest:  # rounds are as many as the number of pages of a host has binary digits
            left = tried.filter("gone is null").select(*keys)
            if left.isEmpty():
                break
            again = placed.join(left, keys, "left_semi").join(wide, "host", "left")
            tried = written(farther(placed, again, distance).mapInArrow(_difference, _GONE), "shared-lines")
            gone = gone.unionByName(tried)
            distance *= 2
    gone = written(gone.filter(F.size("gone") > 0), "gone-lines")
    found = matching(parsed.drop("hashes", "sizes", "open"), gone, ["host", "path", "content"], "left")
    kept = F.filter("lines", lambda x, i: F.col("gone").isNull() | ~F.array_contains("gone", F.get("places", i)))
    return found.select("page_id", "url", F.array_join(kept, "\n\n").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
