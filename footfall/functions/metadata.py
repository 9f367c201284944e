"""Reading the JSON object in `metadata`."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that a JSON number, boolean, null, array or object could also be read as.
LITERAL_LIKE = re.compile(r"[\[{\-+0-9.].*|true|false|null|nan|inf.*", re.S | re.I)


def text_at(metadata: Column, key: str) -> Column:
    """Text under a top-level key, NULL where the key is missing or JSON null.

    The key is taken literally: a dot in it is not a path.
    """
    only = T.StructType([T.StructField(key, T.StringType())])
    return F.from_json(metadata, only).getField(key)


def has_text(metadata: Column, key: str, value: str) -> Column:
    """True where ``key`` holds the JSON *string* ``value``; 69 is not "69".

    Parsing is what costs, and most documents need none. One without escapes that
    does not spell the value out cannot hold it. One that is flat besides, and has the
    key once, holds it where key and value stand together. The others are parsed.
    """
    escaped = F.contains(metadata, F.lit("\\"))
    spelled = F.contains(metadata, F.lit(f'"{value}"'))
    flat = (F.locate("{", metadata, 2) == 0) & ~F.contains(metadata, F.lit("["))
    name = f'"{key}"'
    rest = F.replace(metadata, F.lit(name), F.lit(""))
    once = F.length(metadata) - F.length(rest) == len(name)
    together = F.contains(metadata, F.lit(f'{name}:"{value}"'))
    if '"' in value or "\\" in value:
        # Such a value is never spelled out as it is.
        together = F.lit(False)
    return (
        F.when(~escaped & ~spelled, False)
        .when(~escaped & flat & together & once, True)
        .otherwise(F.coalesce(_parsed_text_is(metadata, key, value), F.lit(False)))
    )


def _parsed_text_is(metadata: Column, key: str, value: str) -> Column:
    if not LITERAL_LIKE.fullmatch(value):
        # No other JSON type reads as this text, so the type need not be looked at.
        return text_at(metadata, key) == value
    held = F.try_variant_get(F.try_parse_json(metadata), f"$['{key}']", "variant")
    is_string = F.schema_of_variant(held) == "STRING"
    return is_string & (F.try_variant_get(held, "$", "string") == value)


def contains(metadata: Column, wanted: dict[str, str]) -> Column:
    """JSON containment of a flat object of strings."""
    return reduce(and_, (has_text(metadata, key, value) for key, value in wanted.items()))


def canonical(document: Column) -> Column:
    """One value per key, the last one given; NULL unless it is a JSON object."""
    return F.regexp_substr(F.to_json(document), F.lit(r"(?s)^\{.*"))
