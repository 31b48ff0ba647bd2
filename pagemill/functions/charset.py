"""Bytes to text by the charset a server named."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Spellings of the charsets decoded in the JVM; those of more bytes a character with `_` for `-`.
UTF_8 = ["utf-8", "utf8", "utf_8"]
LATIN_1 = ["iso-8859-1", "iso8859-1", "latin-1", "latin1", "l1"]
ASCII = ["us-ascii", "ascii"]
WIDE = {2: ["utf_16", "utf16"], 4: ["utf_32", "utf32"]}
WIDE_BIG = {2: ["utf_16_be", "utf_16be"], 4: ["utf_32_be", "utf_32be"]}
WIDE_LITTLE = {2: ["utf_16_le", "utf_16le"], 4: ["utf_32_le", "utf_32le"]}

# Bytes in hexadecimal that are whole characters and pairs of surrogates, the high byte first or last.
_CLEAN = {
    (2, "BE"): r"\A(?:(?!D[89A-F])[0-9A-F]{4}|D[89AB][0-9A-F]{2}D[C-F][0-9A-F]{2})*+\z",
    (2, "LE"): r"\A(?:[0-9A-F]{2}(?!D[89A-F])[0-9A-F]{2}|[0-9A-F]{2}D[89AB][0-9A-F]{2}D[C-F])*+\z",
    (4, "BE"): r"\A(?:00(?:00(?!D[89A-F])|0[1-9A-F]|10)[0-9A-F]{4})*+\z",
    (4, "LE"): r"\A(?:[0-9A-F]{2}(?!D[89A-F]0000)[0-9A-F]{2}(?:0[0-9A-F]|10)00)*+\z",
}
_MARKS = {(2, "BE"): "FEFF", (2, "LE"): "FFFE", (4, "BE"): "0000FEFF", (4, "LE"): "FFFE0000"}


def charset(content_type: Column) -> Column:
    """Lower-cased charset of a Content-Type header, `utf-8` if it names none."""
    named = F.lower(F.regexp_extract(content_type, r"(?i)charset=([\w-]+)", 1))
    return F.when(F.coalesce(named, F.lit("")) != "", named).otherwise("utf-8")


@F.pandas_udf(T.StringType())
def _decode_other(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
    def decode(body, name):
        if body is None:
            return None
        try:
            return bytes(body).decode(name, errors="replace")
        except LookupError:
            return bytes(body).decode("utf-8", errors="replace")

    return pd.Series([decode(b, n) for b, n in zip(bodies, charsets)], dtype=object)


def _wide(body: Column, name: Column) -> Column:
    """Text of UTF-16 and UTF-32, where all of it is well-formed, else NULL. Where the name tells no order, a mark does,
    and little-endian counts without one."""
    plain, digits = F.translate(name, "-", "_"), F.hex(body)
    found = []
    for width in (2, 4):
        told = {"BE": plain.isin(WIDE_BIG[width]), "LE": plain.isin(WIDE_LITTLE[width])}
        for order in ("BE", "LE"):
            mark = _MARKS[width, order]
            marked = plain.isin(WIDE[width]) & digits.startswith(mark)
            rest = F.when(marked, F.substring(body, width + 1, 2147483647)).otherwise(body)
            any_mark = digits.startswith(_MARKS[width, "BE"]) | digits.startswith(_MARKS[width, "LE"])
            own = told[order] | marked | (plain.isin(WIDE[width]) & ~any_mark if order == "LE" else F.lit(False))
            # Given a mark, the one name that UTF-32 has here tells the order.
            text = F.decode(rest, f"UTF-16{order}") if width == 2 else F.decode(F.concat(F.unhex(F.lit(mark)), rest), "UTF-32")
            found.append(F.when(own & digits.rlike(_CLEAN[width, order]), text))
    return F.coalesce(*found)


def decode(body: Column, content_type: Column) -> Column:
    """Text of `body`; bytes outside the charset become U+FFFD, unknown charsets count as UTF-8.

    UTF-8, Latin-1, and what is well-formed of ASCII, UTF-16 and UTF-32 stay in the JVM: the UDF is handed NULL for them.
    """
    name = charset(content_type)
    sure = (
        F.when(name.isin(UTF_8), F.make_valid_utf8(body.cast("string")))
        .when(name.isin(LATIN_1), F.decode(body, "ISO-8859-1"))
        .when(name.isin(ASCII), F.when(F.hex(body).rlike(r"\A(?:[0-7][0-9A-F])*+\z"), body.cast("string")))
        .otherwise(_wide(body, name))
    )
    return F.coalesce(sure, _decode_other(F.when(sure.isNull(), body), name))
