"""Lenient casts: what cannot be read becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE, FALSE = ("1", "true", "t", "yes", "y"), ("0", "false", "f", "no", "n")


def safe_float(x: Column) -> Column:
    return F.regexp_replace(F.trim(x.cast("string")), ",", "").try_cast("double")


def safe_int(x: Column) -> Column:
    """Whole part of a number, so that ``"28.0"`` is 28."""
    return safe_float(x).try_cast("bigint")


def dollars(x: Column) -> Column:
    return safe_float(F.regexp_replace(x, r"^\s*\$", ""))


def truthy(x: Column) -> Column:
    word = F.lower(F.trim(x.cast("string")))
    return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)


def dash_null(x: Column, kind: str = "double") -> Column:
    """A lone dash stands for no value."""
    return F.nullif(F.trim(x), F.lit("-")).try_cast(kind)


def lenient(x: Column, kind: str) -> Column:
    """Cast by a type's name; booleans and whole numbers read text forms as well."""
    if kind == "boolean":
        return truthy(x)
    if kind in ("bigint", "int"):
        return safe_int(x).cast(kind)
    if kind == "double":
        return safe_float(x)
    return x.try_cast(kind)
