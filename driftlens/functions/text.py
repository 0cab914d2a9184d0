"""Text matching, lines and rendering."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def contains_ascii_nocase(text: Column, needle: str) -> Column:
    """Literal substring test that folds the case of ASCII letters only."""
    escaped = "".join("\\" + c if re.match(r"[!-/:-@\[-`{-~]", c) else c for c in needle)
    return text.rlike("(?i)" + escaped)


def escape_like(text: Column) -> Column:
    """Escape backslash, ``%`` and ``_`` for use inside a LIKE pattern."""
    for char in ("\\", "%", "_"):
        text = F.replace(text, F.lit(char), F.lit("\\" + char))
    return text


def normalise_newlines(text: Column) -> Column:
    """CRLF and lone CR become LF. Works on bytes, so text that is not valid UTF-8 stays as it is."""
    text = text.cast("string")
    # Looking for a character is far quicker than replacing, and most texts have none.
    unified = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(text.contains("\r"), unified).otherwise(text)


def split_lines(text: Column) -> Column:
    """Lines including blank ones, without the empty piece after a final newline."""
    pieces = F.split(text, "\n", -1)
    return F.when(text.endswith("\n"), F.slice(pieces, F.lit(1), F.size(pieces) - 1)).when(
        text == "", F.array().cast("array<string>")
    ).otherwise(pieces)


def count_lines(text: Column) -> Column:
    """Number of ``split_lines`` results, without building them."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return breaks + ((text != "") & ~text.endswith("\n")).cast("int")


def csv_field(text: Column) -> Column:
    """Quote a CSV field where it holds a comma, quote or line break, or starts with white space."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike(r'(?U)[,"\r\n]|^\s|^\\\.$'), quoted).otherwise(text)


def alert_message(name: Column, count: Column, last: Column) -> Column:
    return F.concat(F.lit("alert: "), name, F.lit(" ("), count.cast("string"), F.lit(" events) — "), last)


def render_line(clock: Column, source: Column, message: Column, length: int | None = None) -> Column:
    """One display line; with a ``length`` longer messages are cut to so many characters."""
    return F.concat_ws(" ", clock, source, message if length is None else F.substring(message, 1, length))


def heat_ratio(count: Column, top: Column) -> Column:
    return F.when((top > 0) & (count > 0), count / top)


def heat(count: Column, top: Column) -> Column:
    """Colour of a node: struct(hue, lightness, css); the base colour where there is nothing to show."""
    ratio = heat_ratio(count, top)
    hue, light = F.lit(200.0) - ratio * 100, F.lit(50.0) - ratio * 20
    # The base colour is a fixed value.
    css = F.concat(F.lit("hsl("), _number(hue), F.lit(", 80%, "), _number(light), F.lit("%)"))
    return F.struct(
        hue.alias("hue"),
        light.alias("lightness"),
        F.coalesce(css, F.lit("rgba(56,189,248,0.08)")).alias("css"),
    )


def _number(value: Column) -> Column:
    # A whole number prints without its fraction.
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def bar_pct(count: Column, total: Column) -> Column:
    """Bar width in percent, at least 2; 0 where the total is 0."""
    return F.when(total == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(2), F.round(count * 100.0 / total).cast("int"))
    )
