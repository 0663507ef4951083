"""Text building and clean-up as column expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fundweave import fixed_values as fv


def number_text(value: Column, places: int) -> Column:
    """Thousands separators, half-even on the binary value, ``inf``/``nan`` spelled out."""
    inf = float("inf")
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(value == F.lit(inf), F.lit("inf"))
        .when(value == F.lit(-inf), F.lit("-inf"))
        .otherwise(F.format_number(value, places))
    )


def field_text(column: Column, data_type: T.DataType) -> Column:
    """How a cell reads inside a sentence: missing text is ``nan``, a missing date ``NaT``."""
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.date_format(column, "yyyy-MM-dd HH:mm:ss"), F.lit("NaT"))
    return F.coalesce(column.cast("string"), F.lit("nan"))


def places(template: str) -> list[str]:
    """The columns that a row template names."""
    return list(dict.fromkeys(name for _, name, _, _ in Formatter().parse(template) if name is not None))


def render(template: str, df: DataFrame, inside: str = "") -> Column:
    """Fill ``{Column}`` and ``{Column:,.2f}`` places of a row template from ``df``'s columns; ``inside`` ("row.") is where
    they lie by the time the text is made."""
    pieces: list[Column] = []
    for literal, name, spec, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is None:
            continue
        column = F.col(inside + name)
        if spec:
            digits = int(spec.removeprefix(",.").removesuffix("f"))
            text = F.coalesce(number_text(column.cast("double"), digits), F.lit("nan"))
        else:
            text = field_text(column, df.schema[name].dataType)
        pieces.append(text)
    return F.concat(*pieces)


def fill(template: str, **values: Column) -> Column:
    """Put columns into a template once; braces inside the values stay untouched."""
    pieces: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            pieces.append(values[name])
    return F.concat(*pieces)


def holdings_text(df: DataFrame, inside: str = "") -> Column:
    return render(fv.HOLDINGS_ROW, df, inside)


def trades_text(df: DataFrame, inside: str = "") -> Column:
    return render(fv.TRADES_ROW, df, inside)


def stored_text(text: Column, chars: int | None = None) -> Column:
    """The whole text, or its first ``chars`` characters where the store has such a limit."""
    return text if chars is None else F.substring(text, 1, chars)


def chunk_id(namespace: Column, fund: Column, chunk_no: Column) -> Column:
    return F.concat_ws("_", namespace, fund, chunk_no.cast("string"))


def strip(text: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def clean_answer(text: Column) -> Column:
    """Drop control characters other than the line feed, then trim."""
    return strip(F.regexp_replace(text, fv.CONTROL_CHARS, ""))


def clean_reply(text: Column) -> Column:
    """Second pass for replies: also drops the 0x80-0x9F controls."""
    return F.regexp_replace(text, fv.CONTROL_CHARS_WIDE, "")
