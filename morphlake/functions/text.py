"""Column functions: tokens, lower case, byte prefixes. All of them are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six white-space characters of the C locale; no-break space is none of them.
C_SPACE = r"[ \t\n\x0B\f\r]+"
NOT_SPACE = r"[^ \t\n\x0B\f\r]"


def tokens_whitespace(text: Column) -> Column:
    """Runs of anything but C white space; no empty tokens."""
    return F.filter(F.split(text, C_SPACE, -1), lambda t: t != "")


def tokens_single_space(text: Column) -> Column:
    """Pieces between single spaces; neighbouring, leading and trailing spaces give empty tokens."""
    return F.split(text, " ", -1)


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def byte_prefix(text: Column, most: int) -> Column:
    """The first bytes of the UTF-8 form, as binary; a letter may be cut."""
    return F.substring(F.encode(text, "UTF-8"), 1, most)


def cut_text(text: Column, most: int) -> Column:
    """The first bytes as a string, which is not valid UTF-8 where a letter is cut (see ``valid_text``)."""
    return F.when(F.octet_length(text) <= most, text).otherwise(byte_prefix(text, most).cast("string"))


def valid_text(text: Column) -> Column:
    """Broken letters replaced."""
    return F.make_valid_utf8(text)


def lines_of(text: Column) -> Column:
    """Pieces between line feeds; a line feed at the end starts no further line, and an empty text has none."""
    pieces = F.split(text, "\n", -1)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
