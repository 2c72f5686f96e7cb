"""Text forms of labels and places, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decapitalised(c: Column) -> Column:
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def humanised(label: Column) -> Column:
    """A class name as a reader would write it: blanks for underscores, a spaced slash for pipes, representation for encoder."""
    return F.replace(F.replace(F.replace(label, F.lit("_"), F.lit(" ")), F.lit("|"), F.lit(" / ")), F.lit("encoder"), F.lit("representation"))


def grid_place(token: Column) -> Column:
    """`r2c3` as "row 2, column 3"; anything else is null."""
    row, column = F.regexp_extract(token, r"^r(\d+)c(\d+)$", 1), F.regexp_extract(token, r"^r(\d+)c(\d+)$", 2)
    return F.when(row != "", F.concat(F.lit("row "), row, F.lit(", column "), column))


def piped(c: Column) -> Column:
    """The parts of a list written with pipes, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def whole_numbers(c: Column) -> Column:
    """The whole numbers of a list written with commas; what is none is left out."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def seed(*parts: Column) -> Column:
    """The number that the first eight hex digits of the parts' SHA-1 make."""
    return F.conv(F.substring(F.sha1(F.encode(F.concat_ws(":", *parts), "UTF-8")), 1, 8), 16, 10).cast("bigint")
