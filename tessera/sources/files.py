"""Files to sources: decoding, hashes, type detection, parser choice and fallback."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.blake3 import blake3_derived
from tessera.functions.text import MEDIA_TYPES, UNKNOWN_TYPE, media_type
from tessera.operators.isolation import Outcome, applied, guarded

Parser = Callable[[Column], Column]

#: Parsers in order of preference.
PREFERENCE = ["markdown", "unstructured", "docling", "pypdf"]

_parsers: dict[str, tuple[Parser, tuple[str, ...]]] = {}


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files below ``path``: path, length, content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "content")


def ingest(parts: DataFrame, hashed: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Uploaded parts ``(file_name, media_type, data)`` with base64 ``data`` to file contents.

    Adds file_hash (by ``hashed``: ``content_hash``, or ``content_key`` for BLAKE3), content, and valid; content is null
    where the data is no base64 or its bytes are no UTF-8.
    """
    hashed = hashed or content_hash
    raw = F.try_to_binary("data", F.lit("base64"))
    decoded = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return parts.withColumns({"file_hash": hashed(F.col("file_name"), F.col("media_type"), F.col("data")), "content": decoded}).withColumn("valid", F.col("content").isNotNull())


def content_hash(name: Column, kind: Column, data: Column) -> Column:
    """SHA-256 of the encoded data in the context of name and type, hexadecimal."""
    return F.sha2(F.concat_ws("\n", F.concat_ws(", ", name, kind), data), 256)


def content_key(name: Column, kind: Column, data: Column) -> Column:
    """The BLAKE3 key derived from the encoded data in the context ``name, type``, hexadecimal; a null name or type counts as empty."""
    return blake3_derived(F.concat(F.coalesce(name, F.lit("")), F.lit(", "), F.coalesce(kind, F.lit(""))), data)


def register_parser(name: str, *types: str) -> Callable[[Parser], Parser]:
    """Make a parser (content column to text column) available for media types."""

    def add(parser: Parser) -> Parser:
        _parsers[name] = (parser, types)
        return parser

    return add


def available_parsers() -> list[str]:
    return sorted(_parsers)


def parser_types(name: str) -> tuple[str, ...]:
    return _parsers[name][1] if name in _parsers else ()


def parsers_of(kind: str) -> list[str]:
    return sorted(n for n, (_, types) in _parsers.items() if kind in types)


@register_parser("markdown", "text/markdown", "text/plain")
def markdown_to_html(text: Column) -> Column:
    """Headings, lists, paragraphs and emphasis of Markdown as HTML; a block ends at a blank line."""
    blocks = F.filter(F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n[ \t]*\n\s*"), lambda b: F.btrim(b, F.lit(" \t\n"))), lambda b: b != "")
    return F.array_join(F.transform(blocks, _block), "\n")


def _inline(text: Column) -> Column:
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    strong = F.regexp_replace(safe, r"\*\*([^*\n]+)\*\*", "<strong>$1</strong>")
    return F.regexp_replace(F.regexp_replace(strong, r"\*([^*\n]+)\*", "<em>$1</em>"), "`([^`\n]+)`", "<code>$1</code>")


def _block(block: Column) -> Column:
    marks = F.regexp_extract(block, r"^(#{1,6})[ \t]+[^\n]*$", 1)
    level = F.length(marks).cast("string")
    heading = F.concat(F.lit("<h"), level, F.lit(">"), _inline(F.regexp_extract(block, r"^#{1,6}[ \t]+([^\n]*?)[ \t]*#*$", 1)), F.lit("</h"), level, F.lit(">"))
    items = F.transform(F.split(block, "\n"), lambda x: F.concat(F.lit("<li>"), _inline(F.regexp_replace(x, r"^[ \t]*[-*+][ \t]+", "")), F.lit("</li>")))
    listed = F.concat(F.lit("<ul>\n"), F.array_join(items, "\n"), F.lit("\n</ul>"))
    return F.when(marks != "", heading).when(block.rlike(r"^[-*+][ \t]"), listed).otherwise(F.concat(F.lit("<p>"), _inline(block), F.lit("</p>")))


@register_parser("html", "text/html")
def html_to_text(text: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags, white space collapsed; references stay."""
    bare = F.regexp_replace(text, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def select_parser(kind: Column, preferred: Column, path: Column) -> Column:
    """The preferred parser if it reads the type, else the first of PREFERENCE that does; null if none does.

    An unknown or missing type is detected from the path first.
    """
    known = F.when(F.coalesce(kind, F.lit(UNKNOWN_TYPE)) == UNKNOWN_TYPE, media_type(path)).otherwise(kind)

    def reads(name: str) -> Column:
        types = parser_types(name)
        return known.isin(*types) if types else F.lit(False)

    asked = reduce(lambda found, n: F.when((preferred == n) & reads(n), n).otherwise(found), available_parsers(), F.lit(None).cast("string"))
    order = PREFERENCE + [n for n in available_parsers() if n not in PREFERENCE]
    return F.coalesce(asked, *[F.when(reads(n), n) for n in order if n in _parsers])


def parse_with_fallback(files: DataFrame, primary: str, fallbacks: tuple[str, ...] = (), content: str = "content") -> DataFrame:
    """Adds parsed, parser_used and errors: the first parser of the row of parsers that gives text.

    A parser that is not registered, or does not read the row's ``media_type``, is passed over; where none
    gives text, parsed is empty and errors says so. A row never fails its neighbours.
    """
    tried = [n for n in dict.fromkeys((primary, *fallbacks)) if n in _parsers]
    filled = lambda x: F.get(F.filter(F.array(x), lambda t: t != ""), F.lit(0))  # null for an empty text; a nullif here would parse twice
    results = [F.when(F.col("media_type").isin(*_parsers[n][1]), filled(F.btrim(_parsers[n][0](F.coalesce(content, F.lit("")))))) for n in tried]
    text = F.coalesce(*results, F.lit(""))
    used = F.coalesce(*[F.when(r.isNotNull(), n) for n, r in zip(tried, results, strict=True)]) if tried else F.lit(None).cast("string")
    return files.withColumns({"parsed": text, "parser_used": used}).withColumn("errors", F.when(F.col("parsed") == "", F.array(F.lit("no parser gave text"))).otherwise(F.array().cast("array<string>")))


#: Fixed value: seconds that a parser may take for a file.
PARSE_SECONDS = 300.0


def parse_many(files: DataFrame, parse: Callable[[str], str], seconds: float = PARSE_SECONDS, content: str = "content", source: str = "source_id") -> Outcome:
    """``files`` with ``parsed`` by a plug-in of one file's content.

    A file on which it raises, or takes over ``seconds``, is an error row of stage ``parsing``; the others are parsed.
    """
    return applied(files, parse, content, "parsed", "string", source, "parsing", seconds)


def timed_parser(parse: Callable[[str], str], seconds: float = PARSE_SECONDS) -> Parser:
    """A plug-in of one file's content as a parser for ``register_parser``: null where it raises or takes over ``seconds``, so the next parser is tried."""
    made = guarded(parse, "string", seconds)
    return lambda content: made(content)["value"]


def capabilities(spark: SparkSession) -> DataFrame:
    """(parser, media_type) of every registered parser."""
    return spark.createDataFrame([(n, t) for n in available_parsers() for t in parser_types(n)], "parser string, media_type string")


def media_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(MEDIA_TYPES.items()), "extension string, media_type string")
