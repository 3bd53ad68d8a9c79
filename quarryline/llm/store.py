"""Shared-folder tables and the folds of the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..store import materialize, new_path, scratch, shared_dir

__all__ = ["crc32_mod", "materialize", "new_path", "scratch", "shared_dir"]


def crc32_mod(column: str, modulus: int):
    """crc32 of a column's text, modulo ``modulus``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
