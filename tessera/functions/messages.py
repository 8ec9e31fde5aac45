"""Messages, their parts and their egress form."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The job a tool does, to the kind of tool it is.
ROLE_CATEGORIES = {
    "primary_llm": "llm",
    "fast_llm": "llm",
    "heavy_llm": "llm",
    "strategic_llm": "llm",
    "default_vector_store": "vector_store",
    "default_embedder": "embedder",
    "default_parser": "parser",
    "default_reranker": "reranker",
    "default_storage": "storage",
}


def has_part(parts: Column, kind: str) -> Column:
    """Whether a message (array<struct<type, ...>>) has a part of a type; false for no parts."""
    return F.coalesce(F.exists(parts, lambda p: p["type"] == kind), F.lit(False))


def parts_of(parts: Column, kind: str) -> Column:
    return F.filter(parts, lambda p: p["type"] == kind)


def camel_name(name: str) -> str:
    """``created_at`` as ``CreatedAt``."""
    return "".join(w[:1].upper() + w[1:] for w in re.split("_+", name))


def camel_columns(df: DataFrame) -> DataFrame:
    """Egress names of all columns."""
    return df.select(*[F.col(f"`{c}`").alias(camel_name(c)) for c in df.columns])


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under other names; those that are not there are passed over, an existing target is kept."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})


def only(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns that are there; nothing else leaves."""
    return df.select(*[c for c in allowed if c in df.columns])


def tool_category(role: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ROLE_CATEGORIES.items() for x in pair])
    return F.element_at(table, F.lower(role))
