"""Blank tests, trimming, lengths and hashes with the service's exact meaning."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that make a text blank. Unicode white space without
# the three no-break spaces, plus the four ASCII separators. Spark's trim() takes
# off plain spaces only, and \s in its regular expressions is ASCII only.
WHITESPACE = (
    r"\t-\r\x1c-\x20\u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000"
)
BLANK = f"^[{WHITESPACE}]*$"

# Keys and parameters lose the control characters and spaces around them.
CONTROLS = "".join(map(chr, range(0x21)))

API_KEY_PREFIX_LENGTH = 11


def is_blank(text: str | None) -> bool:
    return text is None or re.fullmatch(f"[{WHITESPACE}]*", text) is not None


def trim_controls(text: str) -> str:
    return text.strip(CONTROLS)


def blank(text: Column) -> Column:
    """True for NULL, for the empty text and for white space alone."""
    return text.isNull() | text.rlike(BLANK)


def blank_to_null(text: Column) -> Column:
    return F.when(~text.rlike(BLANK), text)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, the unit in which size limits are stated."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def api_key_hash(key: Column) -> Column:
    """Lower-case hex SHA-256 of the trimmed key, as stored with its tenant."""
    return F.sha2(F.regexp_replace(key, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), 256)


def api_key_prefix(key: Column) -> Column:
    """The part of a key that may be shown."""
    return F.substring(key, 1, API_KEY_PREFIX_LENGTH)
