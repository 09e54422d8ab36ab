"""Shared definitions of white space, words and case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: [\x20\x09-\x0D], which is also what bytes.split() splits at.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER_TABLE = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, other letters left; the fast built-in serves texts of ASCII alone."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ in UTF-8, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split() if text else []
