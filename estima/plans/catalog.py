"""Registered queries: one per operator, each over the test tables.

``QUERIES[name](spark, base) -> DataFrame`` and ``ORACLE[name]`` (DuckDB SQL over
the same tables) when the operator has an SQL statement of its result. Floating
results that come out of different summation orders are rounded to 6
significant digits on both sides (``round_sig`` / ``rs``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estima.functions.stats import round_sig

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def q(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rsig(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: round_sig(F.col(c), digits) for c in cols})


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    from estima.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_KEY_SQL = "l_orderkey, l_partkey, l_suppkey, l_linenumber"

from estima.plans import catalog_sources  # noqa: E402,F401  (registers)
from estima.plans import catalog_stats  # noqa: E402,F401
from estima.plans import catalog_models  # noqa: E402,F401
from estima.plans import catalog_charts  # noqa: E402,F401
