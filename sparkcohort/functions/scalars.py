"""Scalar expressions shared by the feature operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is zero."""
    return column(a) / F.nullif(column(b).cast("double"), F.lit(0.0))


def tidy(c: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison across engines; never negative zero."""
    return F.round(column(c).cast("double"), digits) + F.lit(0.0)


def flag(condition: Column) -> Column:
    """1 or 0."""
    return condition.cast("int")


def days_in_year(date: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31)))


def phase(position: Column, period: Column | int) -> tuple[Column, Column]:
    """Sine and cosine of a position in a cycle."""
    angle = F.lit(2 * math.pi) * position / period
    return F.sin(angle), F.cos(angle)


def from_end(text: Column, place: int, separator: str = ",") -> Column:
    """The place-th token from the end (1: the last), trimmed; null if the text is shorter or the token empty."""
    tokens = F.transform(F.split(text, separator), lambda t: F.trim(t))
    return F.nullif(F.try_element_at(tokens, F.lit(-place)), F.lit(""))


def hex_id(number: Column) -> Column:
    """ID_ and eight upper-case hex digits."""
    return F.concat(F.lit("ID_"), F.lpad(F.upper(F.hex(number)), 8, "0"))


def hex_value(identifier: Column) -> Column:
    return F.conv(F.regexp_replace(identifier, "^ID_", ""), 16, 10).cast("bigint")
