"""Deterministic, partitioning-independent row hashing.

Every random choice in the library (split, folds, permutations) is a function of
the md5 of a row key, never of ``rand()``: the result must not change when the
data is re-partitioned or a task is retried after an executor loss.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_string(cols: Sequence[str | Column], salt: str | None = None) -> Column:
    """``a|b|c`` text form of a composite key (``|salt`` appended when given)."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    if salt is not None:
        parts.append(F.lit(salt))
    return F.concat_ws("|", *parts)


def hash_hex(cols: Sequence[str | Column], salt: str | None = None) -> Column:
    """md5 of the key text as 32 lower-case hex digits."""
    return F.md5(key_string(cols, salt))


def hash_bucket(cols: Sequence[str | Column], modulo: int, salt: str | None = None) -> Column:
    """First 32 bits of the key's md5, modulo ``modulo`` (a bigint in [0, modulo))."""
    h = hash_hex(cols, salt)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % F.lit(modulo)
