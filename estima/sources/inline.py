"""Inline feature values ``name:value,name:value`` as typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inline_source(df: DataFrame, request_col: str, feature_types: dict[str, str],
                  keep: list[str] | None = None, problem_col: str | None = None) -> DataFrame:
    """Parse a column of request strings into one typed column per feature.

    Pairs split on ``,``; name and value on the *first* ``:``; a name given twice
    keeps its last value. Pairs without ``:`` and unknown names are listed in
    ``problem_col`` (null where there are none) if it is given. Values are
    ``try_cast`` to the trained Spark types, so a bad number becomes null (and is
    then reported by ``score_guard``) instead of failing the job. A single request
    is simply a one-row frame.
    """
    pairs = F.transform(
        F.split(F.col(request_col), ","),
        lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"),
                           F.substring(x, F.instr(x, ":") + 1, F.length(x)).alias("v"),
                           (F.instr(x, ":") > 0).alias("ok")))
    cols = [F.col(k) for k in (keep or [])]
    for name, typ in feature_types.items():
        hit = F.filter(pairs, lambda p: p["ok"] & (p["k"] == F.lit(name)))
        v = F.when(F.size(hit) > 0, F.element_at(hit, -1)["v"])
        cols.append(v.try_cast(typ).alias(name) if typ != "string" else v.alias(name))
    if problem_col:
        known = F.array(*[F.lit(n) for n in feature_types])
        bad = F.filter(F.split(F.col(request_col), ","), lambda x: (F.instr(x, ":") == 0) | ~F.array_contains(known, F.substring_index(x, ":", 1)))
        cols.append(F.when(F.size(bad) > 0, F.array_join(bad, ",")).alias(problem_col))
    return df.select(*cols)
