"""Column expressions for query understanding, prompts and message text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a strip of a string removes here.
BLANKS = " \t\n\r\f\v"

#: Parts of a text that make a query complex.
COMPLEX_MARKS = ["and", "or", "also", "compare", "difference", "vs"]
#: Beginnings of an open question.
OPEN_STARTS = ["what", "why", "how", "explain", "describe"]
#: More words than this make a query complex; most queries of an expansion.
COMPLEX_WORDS = 15
MOST_QUERIES = 15

#: File extension to media type.
MEDIA_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "html": "text/html",
    "htm": "text/html",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "txt": "text/plain",
    "text": "text/plain",
}
UNKNOWN_TYPE = "unknown"
#: All known media types.
DOCUMENT_TYPES = [
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/msword",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/manifest+json",
    "application/xml",
    "text/html",
    "text/markdown",
    "text/plain",
    "text/css",
    "text/csv",
    "text/javascript",
    "text/x-python",
    "text/x-rst",
    "application/rtf",
    "text/richtext",
    "text/tab-separated-values",
    "text/vtt",
    "text/x-vcard",
]

#: Provider name to the prefix of its models.
MODEL_PREFIXES = {
    "OPENAI": "openai",
    "ANTHROPIC": "anthropic",
    "COHERE": "cohere",
    "GROQ": "groq",
    "TOGETHER": "together_ai",
    "MISTRAL": "mistral",
    "REPLICATE": "replicate",
    "HUGGINGFACE": "huggingface",
    "BEDROCK": "bedrock",
    "VERTEX_AI": "vertex_ai",
    "PALM": "palm",
    "OPENROUTER": "openrouter",
}

#: Roles of a message.
ROLES = ["user", "assistant", "system"]


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    """Non-empty words between white space."""
    return F.filter(F.split(stripped(c), r"\s+"), lambda w: w != "")


def is_complex_query(q: Column) -> Column:
    """Contains a complexity mark anywhere, or has many words."""
    return F.lower(q).rlike("|".join(COMPLEX_MARKS)) | (F.size(words(q)) > COMPLEX_WORDS)


def is_open_ended(q: Column) -> Column:
    return F.lower(q).rlike(f"^({'|'.join(OPEN_STARTS)})")


def route(q: Column, requested: Column) -> Column:
    """The strategy that ``requested`` comes to: auto decides by the query, a blank query needs none."""
    auto = F.when(is_complex_query(q), "decomposition").when(is_open_ended(q), "hyde").otherwise("expansion")
    return F.when(stripped(F.coalesce(q, F.lit(""))) == "", "none").when(requested == "auto", auto).otherwise(requested)


def split_lines(t: Column) -> Column:
    """Lines of an answer, stripped, without blank ones."""
    return F.filter(F.transform(F.split(t, "\n"), stripped), lambda x: x != "")


def expanded(q: Column, alternatives: Column) -> Column:
    """The query, then its alternatives, each once, at most MOST_QUERIES."""
    return F.slice(F.array_distinct(F.concat(F.array(q), alternatives)), 1, MOST_QUERIES)


def or_original(rewritten: Column, q: Column) -> Column:
    """The rewritten query unless it is null or blank."""
    return F.coalesce(F.nullif(stripped(rewritten), F.lit("")), q)


def context_line(rank: Column, name: Column, contents: Column) -> Column:
    return F.concat(F.lit("[#"), F.coalesce(rank.cast("string"), F.lit("N/A")), F.lit(" RANKED CHUNK: FILE NAME: "), F.coalesce(name, F.lit("")), F.lit(" CHUNK CONTENT: "), F.coalesce(contents, F.lit("")), F.lit("]"))


#: Fixed value: the end of a formatted context.
CONTEXT_END = "END OF RETRIEVED CONTEXT"


def cdata(c: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def json_string(c: Column) -> Column:
    """A text as a JSON string literal, quotes included."""
    body = F.get_json_object(F.to_json(F.struct(F.struct(c.alias("s")).alias("o"))), "$.o")
    return F.regexp_extract(body, r'(?s)^\{"s":(.*)\}$', 1)


def tagged(role: Column, text: Column) -> Column:
    """``<role>text</role>`` and a line feed for a known role, else nothing."""
    tag = F.lower(stripped(role))
    return F.when(tag.isin(ROLES), F.concat(F.lit("<"), tag, F.lit(">"), F.coalesce(text, F.lit("")), F.lit("</"), tag, F.lit(">\n"))).otherwise("")


def normal_role(role: Column) -> Column:
    tag = F.lower(stripped(role))
    return F.when(tag.isin(ROLES), tag).otherwise("user")


def media_type(path: Column) -> Column:
    """By the extension of the last part of a path; a name that starts with its only dot has none."""
    extension = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(table, extension), F.lit(UNKNOWN_TYPE))


def known_type(kind: Column) -> Column:
    """A declared media type without parameters, in lower case, if it is one of DOCUMENT_TYPES, else unknown."""
    plain = F.lower(F.btrim(F.substring_index(kind, ";", 1)))
    return F.when(plain.isin(*DOCUMENT_TYPES), plain).otherwise(UNKNOWN_TYPE)


def model_string(provider: Column, model: Column, custom: Column) -> Column:
    """``prefix/model``; null where provider or model is missing."""
    table = F.create_map(*[F.lit(x) for pair in MODEL_PREFIXES.items() for x in pair])
    prefix = F.when(F.coalesce(custom, F.lit("")) != "", custom).otherwise(F.coalesce(F.element_at(table, F.upper(provider)), F.lower(provider)))
    return F.when((F.coalesce(provider, F.lit("")) != "") & (F.coalesce(model, F.lit("")) != ""), F.concat(prefix, F.lit("/"), model))


def without_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull())


def text_of_parts(parts: Column) -> Column:
    """Texts of the parts of type ``text`` (struct<type, text>), a line each."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")


#: Fixed value: the digits of a ULID, base 32.
ULID_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid_millis(u: Column) -> Column:
    """Milliseconds since 1970 in the first ten digits; null unless they are ten digits of the alphabet."""
    head = F.upper(F.substring(u, 1, 10))
    value = F.aggregate(F.split(head, ""), F.lit(0).cast("long"), lambda a, d: a * 32 + F.call_function("instr", F.lit(ULID_DIGITS), d) - 1)
    return F.when(head.rlike(f"^[{ULID_DIGITS}]{{10}}$"), value)


_field = re.compile(r"\{\{|\}\}|\{([A-Za-z_][A-Za-z0-9_]*)\}")


def from_template(template: str, **fields: Column) -> Column:
    """``template`` with ``{name}`` replaced by the column of that name; ``{{`` and ``}}`` are braces.

    A null value is empty text. Values are put in as they are: braces in them are no fields.
    A field without a column, or a column without a field, is a ValueError.
    """
    parts, at, used = [], 0, set()
    for found in _field.finditer(template):
        parts.append(F.lit(template[at : found.start()]))
        at = found.end()
        if found[1] is None:
            parts.append(F.lit(found[0][0]))
        elif found[1] in fields:
            used.add(found[1])
            parts.append(F.coalesce(fields[found[1]].cast("string"), F.lit("")))
        else:
            raise ValueError(f"no value for {{{found[1]}}}")
    if unused := set(fields) - used:
        raise ValueError(f"the template has no field {sorted(unused)}")
    return F.concat(*parts, F.lit(template[at:]))


#: Bytes that are encoded together; a multiple of three, so that the codes of blocks can be joined.
BASE64_BLOCK = 32_766


def base64_in_blocks(data: Column, block: int = BASE64_BLOCK) -> Column:
    """Base64 of binary ``data``, encoded ``block`` bytes at a time and without line ends; null stays null."""
    if block % 3:
        raise ValueError("a block must be a multiple of three bytes")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.octet_length(data) - 1), F.lit(block))
    codes = F.transform(starts, lambda at: F.regexp_replace(F.base64(F.substring(data, at + 1, F.lit(block))), r"\s", ""))
    return F.when(data.isNotNull(), F.array_join(codes, ""))
