"""Text normalisation with Python's notion of white space, evaluated in the JVM.

Regexes keep to two rules. Repeated groups are possessive: Java recurses on any other kind and would
overflow the stack on a long page. Alternatives share their first character, so that most positions of a
text are ruled out by one comparison.
"""

from __future__ import annotations

import html.entities
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exactly what str.strip(), str.split() and the class \s of str patterns take for white space.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Fixed value: the line ends str.splitlines() breaks at; visible ASCII is ruled out first.
LINE_END = r"[[^ -~]&&[\n-\r\x1c-\x1e\x85\u2028\u2029]](?:(?<=\r)\n)?+"

# References decoded in the JVM: the names of HTML 4 and `apos` with what HTML 5 makes of them, taken from the
# standard library, and numbers of ordinary characters.
ENTITIES = {name: html.entities.html5[f"{name};"] for name in ["apos", *html.entities.name2codepoint]}
_DECIMAL = r"#(?:3[2-9]|[4-9]\d|1[01]\d|12[0-6]|1[6-9]\d|[2-9]\d\d|[1-9]\d{3}|[1-4]\d{4}|5[0-4]\d{3})"
_HEX = (
    r"#[xX](?:[2-6][0-9A-Fa-f]|7[0-9A-Ea-e]|[A-Fa-f][0-9A-Fa-f]|[1-9A-Fa-f][0-9A-Fa-f]{2}"
    r"|[1-9A-Ca-c][0-9A-Fa-f]{3}|1[0-9A-Ea-e][0-9A-Fa-f]{3}|1[Ff][0-9A-Ea-e][0-9A-Fa-f]{2})"
)
_PLAIN = rf"(?:{'|'.join(ENTITIES)}|{_DECIMAL}|{_HEX});"
# Everything else that html.unescape might change: unknown names, names without a semicolon, odd numbers;
# and a reference cut off at the end, which the parser would hold back with the text around it.
_LOOSE_NAMES = "|".join(n for n in html.entities.html5 if not n.endswith(";"))
ODD_REFERENCE = rf"&(?!{_PLAIN})(?:#[0-9xX]|[A-Za-z][A-Za-z0-9]*+;|{_LOOSE_NAMES}|[^\s;<]{{0,40}}+\z)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` worked out once, however often `use` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def collapse(c: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    blanks = F.translate(c, WHITE_SPACE, " " * len(WHITE_SPACE))
    return F.trim(F.regexp_replace(blanks, "  ++", " "))


def strip(c: Column) -> Column:
    """White space removed at both ends only."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE_SPACE))


def no_commas(c: Column) -> Column:
    """Commas to blanks, so that the value can stand in an unquoted CSV line."""
    return F.replace(c, F.lit(","), F.lit(" "))


def clean_field(c: Column) -> Column:
    """`collapse`, then `no_commas`; NULL becomes the empty string."""
    return no_commas(collapse(F.coalesce(c, F.lit(""))))


def truncate(c: Column, limit: Column | int | None) -> Column:
    """First `limit` code points; everything if the limit is NULL or not positive."""
    if limit is None:
        return c
    n = F.lit(limit) if isinstance(limit, int) else limit
    return F.when(n > 0, F.left(c, n)).otherwise(c)


def strip_bom(c: Column) -> Column:
    """Byte-order marks removed at the start."""
    return F.regexp_replace(c, r"^\ufeff++", "")


def split_lines(c: Column) -> Column:
    """Lines as str.splitlines() gives them: no empty last element after a final line end."""

    def without_end(lines: Column) -> Column:
        return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)

    return let(F.split(c, LINE_END), without_end)


def output_lines(c: Column) -> Column:
    """Lines of captured output: empty ones are dropped before each line is right-trimmed."""
    unix = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    kept = F.filter(F.split(unix, "\n"), lambda line: line != "")
    return F.transform(kept, rstrip)


def _decode(piece: Column) -> Column:
    """Text that followed an ampersand, with the reference it starts with (if any) replaced."""
    name = F.substring_index(piece, ";", 1)
    tail = F.substr(piece, F.length(name) + 2)
    digits = F.regexp_replace(name, "^#[xX]?", "")
    code = F.when(name.rlike(rf"^{_DECIMAL}\z"), F.conv(digits, 10, 16)).when(name.rlike(rf"^{_HEX}\z"), digits)
    names = F.str_to_map(
        F.lit("\n".join(f"{name}\t{char}" for name, char in ENTITIES.items())), F.lit("\n"), F.lit("\t")
    )
    char = F.when(name.startswith("#"), F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")).otherwise(
        F.try_element_at(names, name)
    )
    ampersand = F.lit("&")
    return (
        F.when(piece.startswith("amp;"), F.concat(ampersand, F.substr(piece, F.lit(5))))
        .when(piece.contains(";"), F.coalesce(F.concat(char, tail), F.concat(ampersand, piece)))
        .otherwise(F.concat(ampersand, piece))
    )


def unescape(c: Column) -> Column:
    """One round of HTML reference decoding, for text without ODD_REFERENCE (that needs `functions.parser`)."""

    def decoded(text: Column) -> Column:
        # A one-character separator keeps `split` off the regex engine, which it would start anew for each row.
        pieces = F.split(text, "&")
        return F.array_join(F.transform(pieces, lambda piece, i: F.when(i == 0, piece).otherwise(_decode(piece))), "")

    # Most texts, and nearly all of a second round, have no reference.
    return let(c, lambda text: F.when(text.contains("&"), decoded(text)).otherwise(text))
