"""DuckDB text for the oracle queries: shared CTEs and expression builders.

These are independent re-statements of each operator's definition in plain
SQL (closed forms for the linear models), used only to check the Spark results.
"""

from __future__ import annotations

from estima.functions.tokens import NA_TOKENS


def rs(e: str, d: int = 6) -> str:
    """Round to ``d`` significant digits (same scheme as ``functions.round_sig``)."""
    k = f"({d - 1} - floor(log10(abs({e}))))"
    return (f"(CASE WHEN ({e}) IS NULL THEN NULL "
            f"WHEN ({e}) = 0 OR isinf({e}) OR isnan({e}) THEN CAST({e} AS DOUBLE) "
            f"WHEN {k} >= 0 THEN round(({e}) * pow(10e0, {k})) / pow(10e0, {k}) "
            f"ELSE round(({e}) / pow(10e0, -{k})) * pow(10e0, -{k}) END)")


def bucket(key_sql: str, modulo: int) -> str:
    return f"CAST(('0x' || substr(md5({key_sql}), 1, 8)) AS BIGINT) % {modulo}"


LI_KEY_SQL = "concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)"

LM = f"""lm AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
         l_returnflag, l_linestatus,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
         {bucket(LI_KEY_SQL, 100)} < 20 AS is_test
  FROM lineitem)"""

# ridge (alpha 1) of charge on population-standardised l_extendedprice, closed form
RIDGE_LI = LM + """,
tr AS (SELECT * FROM lm WHERE NOT is_test),
st AS (SELECT avg(l_extendedprice) AS mx, stddev_pop(l_extendedprice) AS sx, count(*) AS n,
              avg(charge) AS my, covar_pop(l_extendedprice, charge) AS cxy FROM tr),
cf AS (SELECT mx, sx, my AS b0, cxy / sx * n / (n + 1e0) AS b1 FROM st),
al AS (SELECT lm.*, cf.b0 + cf.b1 * ((lm.l_extendedprice - cf.mx) / cf.sx) AS prediction
       FROM lm, cf),
te AS (SELECT * FROM al WHERE is_test)"""

OM = f"""om AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority,
         {bucket("concat_ws('|', o_orderkey)", 100)} < 20 AS is_test
  FROM orders)"""

# ridge (alpha 1) of o_totalprice on one-hot o_orderpriority (all slots kept)
RIDGE_OR = OM + """,
g AS (SELECT o_orderpriority AS category, count(*) AS nk, avg(o_totalprice) AS yk
      FROM om WHERE NOT is_test GROUP BY o_orderpriority),
b AS (SELECT sum(nk * yk / (nk + 1e0)) / sum(nk / (nk + 1e0)) AS b0 FROM g),
w AS (SELECT CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS slot,
             'o_orderpriority_' || category AS slot_name, 'o_orderpriority' AS feature, category,
             nk * (yk - b0) / (nk + 1e0) AS weight
      FROM g, b)"""

DL = """dl AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(l.quality AS VARCHAR) AS quality,
         coalesce(CAST(l.toxic AS VARCHAR), '#N/A') AS toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

NA_LIST = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)


def p_value(t: str, dof: str, n: int = 1000) -> str:
    """Two-sided Student-t p-value by Simpson's rule in the angle variable."""
    th0 = f"atan(abs({t}) / sqrt({dof}))"
    th1 = f"least(pi() / 2, 12e0 / sqrt({dof}))"

    def simpson(a: str, b: str) -> str:
        h = f"((({b}) - ({a})) / {n})"
        w = f"(CASE WHEN i = 0 OR i = {n} THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END)"
        return (f"(list_sum(list_transform(range({n + 1}), lambda i: {w} * "
                f"pow(greatest(cos(({a}) + i * {h}), 0e0), ({dof}) - 1))) * {h} / 3)")

    return (f"(CASE WHEN ({t}) IS NULL OR ({dof}) IS NULL OR ({dof}) <= 0 THEN NULL "
            f"WHEN {th0} >= {th1} THEN 0e0 ELSE {simpson(th0, th1)} / {simpson('0e0', th1)} END)")


def metrics_select(y: str, p: str, seg: list[str]) -> str:
    """n, mae, r2, t_stat, dof, p_value of actual ``y`` vs predicted ``p``
    (expects a FROM clause after it, grouped by ``seg``)."""
    segs = "".join(f"{s}, " for s in seg)
    return f"""SELECT {segs}n, mae, r2, t_stat, dof, {p_value('t_stat', 'dof')} AS p_value FROM (
  SELECT {segs}n, mae,
         CASE WHEN vy > 0 THEN 1 - sse / (n * vy) END AS r2,
         CASE WHEN 2 * n - 2 > 0 AND ((n - 1) * sy + (n - 1) * sp) / (2 * n - 2) * (2e0 / n) > 0
              THEN (my - mp) / sqrt(((n - 1) * sy + (n - 1) * sp) / (2 * n - 2) * (1e0 / n + 1e0 / n)) END AS t_stat,
         CAST(2 * n - 2 AS DOUBLE) AS dof
  FROM (SELECT {segs}count(*) AS n, avg(abs({y} - {p})) AS mae, sum(({y} - {p}) * ({y} - {p})) AS sse,
               var_pop({y}) AS vy, avg({y}) AS my, avg({p}) AS mp, var_samp({y}) AS sy, var_samp({p}) AS sp
        FROM __SRC__ {('GROUP BY ' + ', '.join(seg)) if seg else ''}))"""


def solve(n: int, source: str, name: str = "gj") -> str:
    """CTEs that solve the linear system of the one-row ``source`` (columns a0_0 ... and b0 ...) by elimination
    in order; the last one, ``name``, has the solution as w0 ... ."""
    out, at = [], source
    for k in range(n):
        cells = []
        for i in range(n):
            for j in range(k + 1, n):
                cells.append(f"a{i}_{j} / a{k}_{k} AS a{i}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} * (a{k}_{j} / a{k}_{k}) AS a{i}_{j}")
            cells.append(f"b{i} / a{k}_{k} AS b{i}" if i == k else f"b{i} - a{i}_{k} * (b{k} / a{k}_{k}) AS b{i}")
        out.append(f"{name}{k} AS (SELECT {', '.join(cells)} FROM {at})")
        at = f"{name}{k}"
    out.append(f"{name} AS (SELECT {', '.join(f'b{i} AS w{i}' for i in range(n))} FROM {at})")
    return ",\n".join(out)


def normal_equations(columns: list[str], target: str, source: str, penalty: float, name: str = "ne") -> str:
    """CTE of the normal equations of ``target`` on ones and ``columns`` (expressions over ``source``), with
    ``penalty`` on all but the intercept."""
    x = ["1e0", *columns]
    cells = [f"sum(({p}) * ({q})){f' + {penalty}' if i == j > 0 else ''} AS a{i}_{j}" for i, p in enumerate(x) for j, q in enumerate(x)]
    cells += [f"sum(({p}) * ({target})) AS b{i}" for i, p in enumerate(x)]
    return f"{name} AS (SELECT {', '.join(cells)} FROM {source})"


def walked(source: str, n: str, walks: int = 8) -> str:
    """SELECT over ``source`` (columns x: a rank, k0 ... k7: a key, n rows) with ``x`` where the keyed bijection
    sends it, a and b being the sides of the least rectangle."""
    mix = lambda x, i: f"((({x} + k{2 * i}) * ({x} + k{2 * i})) % 2147483647 * k{2 * i + 1}) % 2147483647"
    sql = f"SELECT *, CAST(floor(sqrt({n} - 1)) AS BIGINT) + 1 AS a FROM {source}"
    sql = f"SELECT *, ({n} + a - 1) // a AS b, false AS done FROM ({sql})"
    for _ in range(1 + walks):
        sql = f"SELECT * REPLACE (CAST(x AS BIGINT) AS x), x // b AS l, x % b AS h FROM ({sql})"
        for i in range(4):
            sql = f"SELECT * REPLACE ((l + {mix('h', i)}) % a AS l) FROM ({sql})" if i % 2 == 0 else f"SELECT * REPLACE ((h + {mix('l', i)}) % b AS h) FROM ({sql})"
        sql = f"SELECT * EXCLUDE (l, h) REPLACE (CASE WHEN done THEN x ELSE l * b + h END AS x, done OR l * b + h < {n} AS done) FROM ({sql})"
    return sql
