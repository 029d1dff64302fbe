"""Column expressions that have no single built-in function."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def cents(price: str) -> Column:
    """A price as whole cents."""
    return F.round(F.col(price) * 100).cast("long")


def change_key(*parts: Column, separator: str = "") -> Column:
    """MD5 over the parts as text, nulls as empty. An empty separator keeps keys of older data valid."""
    return F.md5(F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
