"""Registered queries: encoding, models, importance, tuning, evaluation, scoring."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from estima.operators import encode as E
from estima.operators import evaluate as V
from estima.operators import importance as I
from estima.operators import score as R
from estima.operators.models import pipeline_fit
from estima.operators.tuning import grid_search
from estima.plans import sqltext as S
from estima.plans.catalog import LI_KEY_SQL, q, rsig, scratch
from estima.plans.frames import (LI_KEY, lineitem_frame, lineitem_predictions, lineitem_test_predictions, orders_frame, ridge_lineitem,
                                 ridge_orders)
from estima.sources.registry import model_load, model_metadata, model_save, score_sink
from estima.sources.tables import scan_table

SEG = ["l_returnflag", "l_linestatus"]
TREE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

# ----------------------------------------------------------------- encoding

_STD_SQL = "WITH " + S.LM + f""", st AS (SELECT avg(l_extendedprice) AS m1, stddev_pop(l_extendedprice) AS s1,
  avg(l_quantity) AS m2, stddev_pop(l_quantity) AS s2 FROM lm WHERE NOT is_test)
SELECT {LI_KEY_SQL}, {S.rs('(l_extendedprice - m1) / s1')} AS l_extendedprice_z,
       {S.rs('(l_quantity - m2) / s2')} AS l_quantity_z FROM lm, st"""


@q("standardise", _STD_SQL)
def standardise_q(spark, base):
    lf = lineitem_frame(spark, base)
    out = E.standardise(lf, ["l_extendedprice", "l_quantity"], fit_on=lf.where(~F.col("is_test")))
    return rsig(out.select(*LI_KEY, "l_extendedprice_z", "l_quantity_z"), "l_extendedprice_z", "l_quantity_z")


@q("one_hot", "WITH " + S.OM + """, c AS (SELECT o_orderpriority AS category,
  CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS slot
  FROM (SELECT DISTINCT o_orderpriority FROM om WHERE NOT is_test AND o_orderpriority IS NOT NULL))
SELECT o_orderkey, o_orderpriority AS value, c.slot FROM om LEFT JOIN c ON om.o_orderpriority = c.category""")
def one_hot_q(spark, base):
    of = orders_frame(spark, base)
    return E.one_hot(of, "o_orderpriority", ["o_orderkey"], fit_on=of.where(~F.col("is_test")))


_PRE_SQL = "WITH " + S.LM + f""", st AS (SELECT avg(l_extendedprice) AS m1, stddev_pop(l_extendedprice) AS s1
  FROM lm WHERE NOT is_test),
c AS (SELECT l_returnflag AS category, CAST(row_number() OVER (ORDER BY l_returnflag) AS INTEGER) AS slot
      FROM (SELECT DISTINCT l_returnflag FROM lm WHERE NOT is_test))
SELECT {LI_KEY_SQL}, 0 AS slot, {S.rs('(l_extendedprice - m1) / s1')} AS value FROM lm, st
WHERE (l_extendedprice - m1) / s1 <> 0
UNION ALL
SELECT {LI_KEY_SQL}, c.slot, 1e0 FROM lm JOIN c ON lm.l_returnflag = c.category"""


def _fit_pre(spark, base):
    lf = lineitem_frame(spark, base)
    pipe = E.preprocess_pipeline(["l_extendedprice"], ["l_returnflag"])
    return lf, pipe.fit(lf.where(~F.col("is_test")))


@q("preprocess", _PRE_SQL)
def preprocess_q(spark, base):
    lf, model = _fit_pre(spark, base)
    arr = model.transform(lf).select(*LI_KEY, F.posexplode(vector_to_array("features")).alias("slot", "value"))
    return rsig(arr.where(F.col("value") != 0), "value")


@q("slot_names", "WITH " + S.LM + """
SELECT 0 AS slot, 'l_extendedprice' AS slot_name, 'l_extendedprice' AS feature, CAST(NULL AS VARCHAR) AS category
UNION ALL
SELECT CAST(row_number() OVER (ORDER BY l_returnflag) AS INTEGER), 'l_returnflag_' || l_returnflag, 'l_returnflag', l_returnflag
FROM (SELECT DISTINCT l_returnflag FROM lm WHERE NOT is_test)""")
def slot_names_q(spark, base):
    _, model = _fit_pre(spark, base)
    return E.slot_names(model, spark)


@q("known_categories", "WITH " + S.OM + """
SELECT 'o_orderpriority' AS feature, category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS position
FROM (SELECT DISTINCT o_orderpriority AS category FROM om WHERE NOT is_test)""")
def known_categories_q(spark, base):
    return E.known_categories(ridge_orders(spark, base), spark)


@q("model_features", "SELECT 'l_extendedprice' AS feature, 'Numerical' AS kind UNION ALL "
   "SELECT 'l_returnflag', 'Categorical' UNION ALL SELECT 'charge', 'Target'")
def model_features_q(spark, base):
    tr = lineitem_frame(spark, base).where(~F.col("is_test"))
    model = pipeline_fit(tr, ["l_extendedprice", "l_returnflag"], "charge", "ridge")
    return R.model_features(model, spark, "charge")


# ----------------------------------------------------------------- models

_RIDGE_TERMS = "WITH " + S.RIDGE_LI + f"""
SELECT 'intercept' AS term, {S.rs('b0')} AS value FROM cf
UNION ALL SELECT 'l_extendedprice', {S.rs('b1')} FROM cf"""


def _terms(model):
    from estima.operators.models import linear_terms
    slots = E.slot_rows(model)
    b0, coef = linear_terms(model, len(slots))
    return [("intercept", b0)] + [(n, w) for (_, n, _, _), w in zip(slots, coef)]


@q("ridge", _RIDGE_TERMS)
def ridge_q(spark, base):
    m = ridge_lineitem(spark, base)
    return rsig(spark.createDataFrame(_terms(m), "term string, value double"), "value")


_RIDGE2 = "WITH " + S.LM + f""",
tr AS (SELECT * FROM lm WHERE NOT is_test),
st AS (SELECT count(*) AS n, avg(charge) AS my,
              stddev_pop(l_extendedprice) AS s1, stddev_pop(l_quantity) AS s2,
              covar_pop(l_extendedprice, l_quantity) AS c12,
              covar_pop(l_extendedprice, charge) AS c1y, covar_pop(l_quantity, charge) AS c2y FROM tr),
ne AS (SELECT my, n + 1e0 AS a, n * c12 / (s1 * s2) AS r, n * c1y / s1 AS b1, n * c2y / s2 AS b2 FROM st)
SELECT 'intercept' AS term, {S.rs('my')} AS value FROM ne
UNION ALL SELECT 'l_extendedprice', {S.rs('(a * b1 - r * b2) / (a * a - r * r)')} FROM ne
UNION ALL SELECT 'l_quantity', {S.rs('(a * b2 - r * b1) / (a * a - r * r)')} FROM ne"""


@q("ridge_two_features", _RIDGE2)
def ridge_two_features_q(spark, base):
    """Ridge on two standardised numeric features: the 2x2 normal equations."""
    tr = lineitem_frame(spark, base).where(~F.col("is_test"))
    m = pipeline_fit(tr, ["l_extendedprice", "l_quantity"], "charge", "ridge")
    return rsig(spark.createDataFrame(_terms(m), "term string, value double"), "value")


_Z = ["l_extendedprice", "l_quantity"]
_HOT = [("l_returnflag", v) for v in "ANR"] + [("l_linestatus", v) for v in "FO"]
_ZST = "zs AS (SELECT avg(charge) AS my, " + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(["l_extendedprice", "l_quantity", "l_discount", "l_tax"])) \
    + " FROM lm WHERE NOT is_test),\nzt AS (SELECT lm.*, charge - my AS yc, " \
    + ", ".join(f"({c} - m{i}) / s{i} AS z{i}" for i, c in enumerate(["l_extendedprice", "l_quantity", "l_discount", "l_tax"])) + " FROM lm, zs WHERE NOT is_test)"


# two numbers and two one-hot blocks: all eight normal equations, solved in SQL
_PIPELINE = "WITH " + S.LM + ",\n" + _ZST + ",\n" + S.normal_equations(
    ["z0", "z1", *[f"CAST({c} = '{v}' AS INTEGER)" for c, v in _HOT]], "yc", "zt", 1.0) + ",\n" + S.solve(8, "ne") + """
SELECT term, round(value, 4) AS value FROM (
SELECT 'intercept' AS term, w0 + my AS value FROM gj, zs""" + "".join(
    f" UNION ALL SELECT '{n}', w{i} FROM gj" for i, n in enumerate([*_Z, *[f"{c}_{v}" for c, v in _HOT]], 1)) + ")"


@q("pipeline_fit", _PIPELINE)
def pipeline_fit_q(spark, base):
    tr = lineitem_frame(spark, base).where(~F.col("is_test"))
    m = pipeline_fit(tr, ["l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus"], "charge", "ridge")
    return spark.createDataFrame(_terms(m), "term string, value double").withColumn("value", F.round("value", 4))


# ridge on one number and a one-hot block of every order (more categories than a normal-equation solver takes): the
# block is diagonal and goes, the two equations left have a closed form
_WIDE = "WITH " + S.LM + f""",
z AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, avg(charge) AS my FROM lm),
r AS (SELECT l_orderkey AS k, (l_quantity - m) / s AS x, charge - my AS y FROM lm, z),
c AS (SELECT k, count(*) AS n, sum(x) AS x, sum(y) AS y FROM r GROUP BY k),
a AS (SELECT sum(n - n * n / (n + 1e0)) AS a00, sum(x - n * x / (n + 1e0)) AS a01, sum(y - n * y / (n + 1e0)) AS b0,
             sum(x * x / (n + 1e0)) AS e11, sum(x * y / (n + 1e0)) AS e1 FROM c),
f AS (SELECT a00, a01, b0, sum(r.x * r.x) - any_value(e11) + 1 AS a11, sum(r.x * r.y) - any_value(e1) AS b1 FROM a, r GROUP BY a00, a01, b0),
w AS (SELECT (b0 * a11 - b1 * a01) / (a00 * a11 - a01 * a01) AS w0, (b1 * a00 - b0 * a01) / (a00 * a11 - a01 * a01) AS w1 FROM f)
SELECT CAST(k AS VARCHAR) AS category, n, round((y - n * w0 - x * w1) / (n + 1e0), 3) AS weight, round(w0 + my, 3) AS intercept, {S.rs('w1')} AS l_quantity
FROM c, w, z"""


@q("ridge_wide", _WIDE)
def ridge_wide_q(spark, base):
    """Ridge of charge on l_quantity and one category an order, weights as a DataFrame."""
    from estima.operators.ridge import wide_ridge
    lf = lineitem_frame(spark, base)
    intercept, numbers, weights = wide_ridge(lf, "l_orderkey", ["l_quantity"], "charge")
    out = weights.select("category", "n", F.round("weight", 3).alias("weight"), F.round(F.lit(intercept), 3).alias("intercept"),
                         F.lit(numbers["l_quantity"]).alias("l_quantity"))
    return rsig(out, "l_quantity")


def _tree_metrics(spark, base, algorithm, **params):
    lf = lineitem_frame(spark, base)
    m = pipeline_fit(lf.where(~F.col("is_test")), TREE_FEATURES, "charge", algorithm, **params)
    preds = R.predict(m, lf.where(F.col("is_test")))
    return V.metrics(preds, "charge")


@q("boosted_trees")
def boosted_trees_q(spark, base):
    return _tree_metrics(spark, base, "xgboost")


def _rounds_sql() -> str:
    """One boosting round of depth 1 and of depth 2 on three numbers: the best cut by the second-order gain
    over all cuts of all values, per node."""
    xs = ["l_quantity", "l_discount", "l_tax"]
    sql = ["lx AS (SELECT *, 0.5e0 - charge AS g, 0 AS n0 FROM lm)"]
    for level in (0, 1):
        long = " UNION ALL ".join(f"SELECT n{level} AS node, {i} AS f, CAST({c} AS DOUBLE) AS v, g FROM lx{level or ''} WHERE NOT is_test" for i, c in enumerate(xs))
        value = "CASE f " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(xs)) + " END"
        sql += [f"h{level} AS (SELECT node, f, v, sum(g) AS g, count(*) AS n FROM ({long}) GROUP BY node, f, v)",
                f"""c{level} AS (SELECT node, f, v, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER p AS gt, sum(n) OVER p AS nt FROM h{level}
                  WINDOW w AS (PARTITION BY node, f ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY node, f))""",
                f"""s{level} AS (SELECT node, f, v FROM (SELECT *, row_number() OVER (PARTITION BY node
                  ORDER BY gl * gl / (nl + 1) + (gt - gl) * (gt - gl) / (nt - nl + 1) DESC, f, v) AS k FROM c{level} WHERE nl < nt) WHERE k = 1)""",
                f"""lx{level + 1} AS (SELECT lx{level or ''}.*, CASE WHEN s.node IS NULL THEN 2 * n{level} WHEN {value} <= s.v THEN 2 * n{level} ELSE 2 * n{level} + 1 END AS n{level + 1}
                  FROM lx{level or ''} LEFT JOIN s{level} s ON s.node = n{level})""",
                f"""p{level + 1} AS (SELECT n{level + 1} AS node, 0.5e0 - 0.3e0 * sum(g) / (count(*) + 1) AS p FROM lx{level + 1} WHERE NOT is_test GROUP BY 1)"""]
    return "WITH " + S.LM + ",\n" + ",\n".join(sql) + f"""
SELECT {LI_KEY_SQL}, {S.rs('p1.p')} AS depth_1, {S.rs('p2.p')} AS depth_2 FROM lx2 JOIN p1 ON p1.node = n1 JOIN p2 ON p2.node = n2"""


@q("boosted_rounds", _rounds_sql())
def boosted_rounds_q(spark, base):
    """One round of depth 1 and of depth 2, scored on all rows."""
    lf, xs = lineitem_frame(spark, base), ["l_quantity", "l_discount", "l_tax"]
    out = lf
    for depth in (1, 2):
        m = pipeline_fit(lf.where(~F.col("is_test")), xs, "charge", "xgboost", n_estimators=1, max_depth=depth)
        out = R.predict(m, out).withColumnRenamed("prediction", f"depth_{depth}")
    return rsig(out.select(*LI_KEY, "depth_1", "depth_2"), "depth_1", "depth_2")


@q("random_forest")
def random_forest_q(spark, base):
    return _tree_metrics(spark, base, "random_forest")


@q("lasso")
def lasso_q(spark, base):
    tr = lineitem_frame(spark, base).where(~F.col("is_test"))
    m = pipeline_fit(tr, TREE_FEATURES, "charge", "lasso")
    return spark.createDataFrame(_terms(m), "term string, value double")


@q("train_expert", "WITH " + S.RIDGE_LI + f"""
SELECT 0 AS slot, 'l_extendedprice' AS slot_name, 'l_extendedprice' AS feature, CAST(NULL AS VARCHAR) AS category,
       {S.rs('b1')} AS weight FROM cf""")
def train_expert_q(spark, base):
    from estima.operators.training import train_expert
    tr = lineitem_frame(spark, base).where(~F.col("is_test"))
    _, weights = train_expert(tr, ["l_extendedprice"], "charge", "ridge")
    return rsig(weights, "weight")


@q("train_auto")
def train_auto_q(spark, base):
    from estima.operators.training import train_auto
    lf = lineitem_frame(spark, base)
    tr = lf.where(~F.col("is_test")).select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "charge")
    model, chosen, _ = train_auto(tr, "charge", 2)
    preds = R.predict(model, lf.where(F.col("is_test")))
    return V.quality_grade(V.metrics(preds, "charge")).select(
        "n", "mae", "r2", "p_value", "score", "grade", F.lit(",".join(chosen)).alias("features"))


@q("train_plan")
def train_plan_q(spark, base):
    from estima.plans.train import train
    lf = lineitem_frame(spark, base).drop("is_test")
    res = train(lf, "charge", LI_KEY, features=["l_extendedprice", "l_discount", "l_returnflag"],
                algorithm="ridge", expert=True)
    return res.metrics.select("n", "mae", "r2", "p_value", "score", "grade")


# four numbers: with the signs of their weights, the subgradient conditions are linear equations. The SQL solves
# them for the signs of the plain covariances and keeps the result only if its weights have these signs
_LASSO4 = "WITH " + S.LM + ",\n" + _ZST + """,
cv AS (SELECT """ + ", ".join(f"covar_pop(z{i}, z{j}) AS a{i}_{j}" for i in range(4) for j in range(4)) + ", " + ", ".join(
    f"sign(covar_pop(z{i}, yc)) AS s{i}, covar_pop(z{i}, yc) - sign(covar_pop(z{i}, yc)) * 1e0 AS b{i}" for i in range(4)) + """ FROM zt),
""" + S.solve(4, "cv") + """
SELECT term, round(value, 4) AS value FROM (SELECT 'intercept' AS term, my AS value FROM zs
""" + "".join(f"UNION ALL SELECT '{c}', CASE WHEN sign(w{i}) = s{i} THEN w{i} END FROM gj, cv\n" for i, c in enumerate(
    ["l_extendedprice", "l_quantity", "l_discount", "l_tax"])) + ")"


@q("lasso_numbers", _LASSO4)
def lasso_numbers_q(spark, base):
    """Lasso on all four numbers."""
    tr = lineitem_frame(spark, base).where(~F.col("is_test"))
    m = pipeline_fit(tr, ["l_extendedprice", "l_quantity", "l_discount", "l_tax"], "charge", "lasso")
    return spark.createDataFrame(_terms(m), "term string, value double").withColumn("value", F.round("value", 4))


@q("lasso_certificate", """SELECT f AS slot_name, true AS holds FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) t(f)
UNION ALL SELECT DISTINCT 'l_returnflag_' || l_returnflag, true FROM lineitem
UNION ALL SELECT DISTINCT 'l_linestatus_' || l_linestatus, true FROM lineitem""")
def lasso_certificate_q(spark, base):
    """The optimality conditions of the lasso over all features, measured on the training rows: all hold."""
    from estima.operators.lasso import certificate
    from estima.operators.models import LABEL_COL, linear_terms
    tr = lineitem_frame(spark, base).where(~F.col("is_test"))
    m = pipeline_fit(tr, TREE_FEATURES, "charge", "lasso")
    data = tr
    for stage in m.stages[:-1]:
        data = stage.transform(data)
    names = E.slot_names(m, spark)
    b0, w = linear_terms(m, names.count())
    got = certificate(data, w, b0, 1.0, "features", LABEL_COL)
    return got.join(names, "slot").select("slot_name", (F.col("violation") < 1e-6).alias("holds"))


_LASSO1 = "WITH " + S.RIDGE_LI + f""",
lc AS (SELECT cf.b0, st.cxy / st.sx AS c FROM st, cf)
SELECT 'intercept' AS term, {S.rs('b0', 4)} AS value FROM lc
UNION ALL SELECT 'l_extendedprice', {S.rs('sign(c) * greatest(abs(c) - 100e0, 0e0)', 4)} FROM lc"""


@q("lasso_single", _LASSO1)
def lasso_single_q(spark, base):
    tr = lineitem_frame(spark, base).where(~F.col("is_test"))
    m = pipeline_fit(tr, ["l_extendedprice"], "charge", "lasso", alpha=100.0)
    return rsig(spark.createDataFrame(_terms(m), "term string, value double"), "value", digits=4)


# ----------------------------------------------------------------- weights & importance

@q("model_weights", "WITH " + S.RIDGE_LI + f" SELECT 0 AS slot, {S.rs('b1')} AS weight FROM cf")
def model_weights_q(spark, base):
    return rsig(I.model_weights(ridge_lineitem(spark, base), spark), "weight")


@q("named_weights", "WITH " + S.RIDGE_OR + f" SELECT slot, slot_name, feature, category, {S.rs('weight')} AS weight FROM w")
def named_weights_q(spark, base):
    return rsig(I.named_weights(ridge_orders(spark, base), spark), "weight")


def _in_order(df):
    """The rows with their place in the frame's order (one row per slot or feature)."""
    rows = [(i, *r) for i, r in enumerate(df.collect(), 1)]
    return df.sparkSession.createDataFrame(rows, "position long, " + ", ".join(f"{c} {t}" for c, t in df.dtypes))


@q("sort_abs_weight", "WITH " + S.RIDGE_OR + f""" SELECT slot, slot_name, {S.rs('weight')} AS weight,
   row_number() OVER (ORDER BY abs(weight) DESC, slot) AS position FROM w""")
def sort_abs_weight_q(spark, base):
    w = I.named_weights(ridge_orders(spark, base), spark).orderBy("slot_name")
    return rsig(_in_order(I.sort_abs_weight(w).select("slot", "slot_name", "weight")), "weight")


@q("importance_by_feature", "WITH " + S.RIDGE_OR + f" SELECT feature, {S.rs('sum(abs(weight))')} AS importance FROM w GROUP BY feature")
def importance_by_feature_q(spark, base):
    w = I.named_weights(ridge_orders(spark, base), spark).withColumn("weight", F.abs("weight"))
    return rsig(I.importance_by_feature(w), "importance")


_SHARE = "WITH " + S.RIDGE_OR + """
SELECT slot_name AS feature, round(100 * abs(weight) / sum(abs(weight)) OVER (), 2) AS importance_pct FROM w"""


def _slot_importance(spark, base):
    w = I.named_weights(ridge_orders(spark, base), spark)
    return w.select(F.col("slot_name").alias("feature"), F.abs("weight").alias("importance"))


@q("importance_share", _SHARE)
def importance_share_q(spark, base):
    return I.importance_share(_slot_importance(spark, base)).select("feature", "importance_pct")


@q("sort_importance", "SELECT *, row_number() OVER (ORDER BY importance_pct DESC, feature) AS position FROM (" + _SHARE + ")")
def sort_importance_q(spark, base):
    return _in_order(I.sort_importance(I.importance_share(_slot_importance(spark, base)), "importance_pct").select("feature", "importance_pct"))


@q("top_k_features", "WITH " + S.RIDGE_OR + " SELECT slot_name AS feature FROM w ORDER BY abs(weight) DESC, slot_name LIMIT 2")
def top_k_features_q(spark, base):
    return I.top_k_features(_slot_importance(spark, base), 2).select("feature")


@q("importance_table", "WITH " + S.RIDGE_OR + """
SELECT slot_name AS feature, CAST(round(abs(weight) / sum(abs(weight)) OVER () * 100, 2) AS VARCHAR) || '%' AS importance FROM w""")
def importance_table_q(spark, base):
    imp = _slot_importance(spark, base)
    share = imp.withColumn("importance", F.col("importance") / F.sum("importance").over(Window.partitionBy()))
    return I.importance_table(share)


@q("dedupe", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def dedupe_q(spark, base):
    o = scan_table(spark, base, "orders", ["o_orderstatus", "o_orderpriority"])
    return I.dedupe(o, ["o_orderstatus", "o_orderpriority"])


@q("unique_names", "WITH " + S.RIDGE_OR + " SELECT DISTINCT feature FROM w WHERE weight <> 0")
def unique_names_q(spark, base):
    w = I.named_weights(ridge_orders(spark, base), spark)
    return I.unique_names(w.where(F.col("weight") != 0))


@q("rank_features")
def rank_features_q(spark, base):
    tr = lineitem_frame(spark, base).where(~F.col("is_test"))
    return I.rank_features(tr, "charge", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])


@q("select_lasso")
def select_lasso_q(spark, base):
    tr = lineitem_frame(spark, base).where(~F.col("is_test"))
    return I.select_lasso(tr, "charge", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])


@q("select_rfe")
def select_rfe_q(spark, base):
    tr = lineitem_frame(spark, base).where(~F.col("is_test"))
    return I.select_rfe(tr, "charge", 2, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])


def _perm_sql(model: str, parts: dict[str, str], repeats: int = 10) -> str:
    """Permutation importance of a linear model: ``model`` ends with te (the test rows with prediction),
    ``parts`` has each feature's share of the prediction as an expression over te. Values go where the
    keyed bijection sends their rank."""
    from estima.functions.bijection import keys
    rows = ", ".join(f"({i}, {r}, {', '.join(map(str, keys(f'{f}|0|{r}')))})" for i, f in enumerate(parts) for r in range(repeats))
    share = "CASE f " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(parts.values())) + " END"
    names = "CASE f " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(parts)) + " END"
    return f"""{model},
base AS (SELECT *, row_number() OVER (ORDER BY md5({S.LI_KEY_SQL}), {LI_KEY_SQL}) - 1 AS ra, count(*) OVER () AS n FROM te),
ks AS (SELECT * FROM (VALUES {rows}) t(f, r, {', '.join(f'k{i}' for i in range(8))})),
go AS (SELECT f, r, ra AS x, n, {share} AS v, {', '.join(f'k{i}' for i in range(8))} FROM base, ks),
gone AS ({S.walked('go', 'n')}),
perm AS (SELECT gone.f, gone.r, base.charge, base.prediction - {share} + gone.v AS prediction FROM gone JOIN base ON base.ra = gone.x),
r2p AS (SELECT f, r, 1 - sum((charge - prediction) * (charge - prediction)) / (count(*) * var_pop(charge)) AS r2 FROM perm GROUP BY f, r),
r2b AS (SELECT 1 - sum((charge - prediction) * (charge - prediction)) / (count(*) * var_pop(charge)) AS r2 FROM te),
im AS (SELECT f, avg(r2b.r2 - r2p.r2) AS m FROM r2p, r2b GROUP BY f)
SELECT {names} AS feature, {S.rs('m')} AS importance_mean, {S.rs('m / sum(m) OVER ()')} AS importance FROM im"""


_PERM_SQL = _perm_sql("WITH " + S.RIDGE_LI, {"l_extendedprice": "(prediction - (SELECT b0 FROM cf))"})
_ALL_HOT = {c: [(i, v) for i, (d, v) in enumerate(_HOT, 5) if d == c] for c in ("l_returnflag", "l_linestatus")}
_ALL_X = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]
_PERM_PARTS = {c: f"w{i + 1} * ({c} - m{i}) / s{i}" for i, c in enumerate(_ALL_X)} | {
    c: f"CASE {c} " + " ".join(f"WHEN '{v}' THEN w{i}" for i, v in slots) + " ELSE 0 END" for c, slots in _ALL_HOT.items()}
_PERM_ALL_SQL = _perm_sql("WITH " + S.LM + ",\n" + _ZST + ",\n" + S.normal_equations(
    ["z0", "z1", "z2", "z3", *[f"CAST({c} = '{v}' AS INTEGER)" for c, v in _HOT]], "yc", "zt", 1.0) + ",\n" + S.solve(10, "ne") + f""",
te AS (SELECT lm.*, zs.*, gj.*, my + w0 + {' + '.join(_PERM_PARTS.values())} AS prediction FROM lm, zs, gj WHERE is_test)""",
    {c: _PERM_PARTS[c] for c in TREE_FEATURES})


@q("permutation_importance", _PERM_SQL)
def permutation_importance_q(spark, base):
    te = lineitem_frame(spark, base).where(F.col("is_test"))
    out = I.permutation_importance(ridge_lineitem(spark, base), te, ["l_extendedprice"], "charge", LI_KEY, repeats=10)
    return rsig(out, "importance_mean", "importance")


@q("permutation_importance_features", _PERM_ALL_SQL)
def permutation_importance_features_q(spark, base):
    """Importance of every feature of a ridge model on all features."""
    lf, features = lineitem_frame(spark, base), TREE_FEATURES
    model = pipeline_fit(lf.where(~F.col("is_test")), features, "charge", "ridge")
    out = I.permutation_importance(model, lf.where(F.col("is_test")), features, "charge", LI_KEY, repeats=10)
    return rsig(out, "importance_mean", "importance")


_GRID_SQL = "WITH " + S.LM + f""",
d AS (SELECT *, CAST({S.bucket("concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, 'fold')", 3)} AS INTEGER) AS fold FROM lm WHERE NOT is_test),
a AS (SELECT * FROM (VALUES (0.5e0, '{{"alpha": 0.5}}'), (1e0, '{{"alpha": 1.0}}'), (2e0, '{{"alpha": 2.0}}')) t(alpha, params)),
f AS (SELECT * FROM range(3) t(k)),
st AS (SELECT f.k, avg(l_extendedprice) AS mx, stddev_pop(l_extendedprice) AS sx, count(*) AS n, avg(charge) AS my,
              covar_pop(l_extendedprice, charge) AS cxy FROM d, f WHERE d.fold <> f.k GROUP BY f.k),
cf AS (SELECT k, alpha, params, mx, sx, my AS b0, cxy / sx * n / (n + alpha) AS b1 FROM st, a),
ev AS (SELECT cf.params, cf.k, 1 - sum((charge - (b0 + b1 * ((l_extendedprice - mx) / sx))) * (charge - (b0 + b1 * ((l_extendedprice - mx) / sx))))
              / (count(*) * var_pop(charge)) AS r2
       FROM d JOIN cf ON d.fold = cf.k GROUP BY cf.params, cf.k),
m AS (SELECT params, avg(r2) AS mean_r2 FROM ev GROUP BY params)
SELECT 'ridge' AS model, params, {S.rs('mean_r2')} AS mean_r2, mean_r2 = max(mean_r2) OVER () AS is_best FROM m"""


@q("grid_search", _GRID_SQL)
def grid_search_q(spark, base):
    lf = lineitem_frame(spark, base).where(~F.col("is_test"))  # the search never sees the test rows
    table, _ = grid_search(lf, ["l_extendedprice"], "charge", LI_KEY, models=("ridge",))
    return rsig(table, "mean_r2")


@q("grid_search_models")
def grid_search_models_q(spark, base):
    """The whole search: all grid points of the three models on all features."""
    lf = lineitem_frame(spark, base).where(~F.col("is_test"))
    table, _ = grid_search(lf, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"], "charge", LI_KEY)
    return rsig(table, "mean_r2")


# ----------------------------------------------------------------- evaluation

def _seg_metrics(spark, base):
    return V.metrics(lineitem_test_predictions(spark, base), "charge", segments=SEG)


_MET = "WITH " + S.RIDGE_LI + ", m AS (" + S.metrics_select("charge", "prediction", SEG).replace("__SRC__", "te") + ")"


@q("mae", _MET + f" SELECT l_returnflag, l_linestatus, {S.rs('mae')} AS mae FROM m")
def mae_q(spark, base):
    return rsig(V.mae(lineitem_test_predictions(spark, base), "charge", segments=SEG), "mae")


@q("r2", _MET + f" SELECT l_returnflag, l_linestatus, {S.rs('r2')} AS r2 FROM m")
def r2_q(spark, base):
    return rsig(V.r2(lineitem_test_predictions(spark, base), "charge", segments=SEG), "r2")


@q("t_test", _MET + f" SELECT l_returnflag, l_linestatus, {S.rs('t_stat')} AS t_stat, dof, {S.rs('p_value')} AS p_value FROM m")
def t_test_q(spark, base):
    return rsig(V.t_test(lineitem_test_predictions(spark, base), "charge", segments=SEG), "t_stat", "p_value")


_SCORE = "100 * (0.6e0 * least(r2, 1e0) + 0.2e0 * (1 - least(p_value, 1e0)) + 0.2e0 / (1 + mae))"
_GRADE = f"CASE WHEN {_SCORE} > 80 THEN 'Excellent' WHEN {_SCORE} > 60 THEN 'Good' ELSE 'Needs Improvement' END"


@q("quality_score", _MET + f" SELECT l_returnflag, l_linestatus, {S.rs(_SCORE)} AS score FROM m")
def quality_score_q(spark, base):
    return rsig(V.quality_score(_seg_metrics(spark, base)).select(*SEG, "score"), "score")


@q("quality_grade", _MET + f" SELECT l_returnflag, l_linestatus, {_GRADE} AS grade FROM m")
def quality_grade_q(spark, base):
    return V.quality_grade(_seg_metrics(spark, base)).select(*SEG, "grade")


_NOTES = ("array_to_string(list_filter([CASE WHEN p_value < 0.05 THEN '" + V.MSG_SIGNIFICANT.replace("'", "''") + "' END, "
          + ", ".join(f"CASE WHEN NOT p_value < 0.05 THEN '{t.replace(chr(39), chr(39) * 2)}' END" for t in V.MSG_NOT_SIGNIFICANT)
          + f", CASE WHEN ({_GRADE}) = 'Good' AND NOT p_value < 0.05 THEN '{V.MSG_CAUTION}' END"
          + f", CASE WHEN ({_GRADE}) = 'Needs Improvement' OR NOT p_value < 0.05 THEN '{V.MSG_RECOMMEND}' END], lambda x: x IS NOT NULL), ' | ')")


@q("significance_notes", _MET + f" SELECT l_returnflag, l_linestatus, p_value < 0.05 AS significant, {_NOTES} AS notes FROM m")
def significance_notes_q(spark, base):
    s = V.significance_notes(_seg_metrics(spark, base))
    return s.select(*SEG, "significant", F.array_join("notes", " | ").alias("notes"))


@q("metric_report", _MET + f"""
SELECT l_returnflag, l_linestatus, {_GRADE} AS grade, round({_SCORE}, 1) AS score,
       round(r2 * 100, 1) AS r2_pct, round(mae, 2) AS mae FROM m""")
def metric_report_q(spark, base):
    return V.metric_report(_seg_metrics(spark, base), "auto", SEG)


@q("evaluate_segments", _MET + f"""
SELECT l_returnflag, l_linestatus, n, {S.rs('mae')} AS mae, {S.rs('r2')} AS r2, {S.rs('t_stat')} AS t_stat, dof,
       {S.rs('p_value')} AS p_value, {S.rs(_SCORE)} AS score, {_GRADE} AS grade FROM m""")
def evaluate_segments_q(spark, base):
    g = V.quality_grade(_seg_metrics(spark, base))
    return rsig(g, "mae", "r2", "t_stat", "p_value", "score")


# ----------------------------------------------------------------- scoring

_PRED = "WITH " + S.RIDGE_LI + f" SELECT {LI_KEY_SQL}, l_extendedprice, charge, l_returnflag, l_linestatus, {S.rs('prediction')} AS prediction FROM al"


@q("predict", _PRED)
def predict_q(spark, base):
    return rsig(lineitem_predictions(spark, base).drop("is_test"), "prediction")


@q("append_prediction", "WITH " + S.RIDGE_LI + f" SELECT {LI_KEY_SQL}, l_extendedprice, charge, {S.rs('prediction')} AS prediction FROM al")
def append_prediction_q(spark, base):
    te = lineitem_frame(spark, base).select(*LI_KEY, "l_extendedprice", "charge")
    scored = R.scoring_model(ridge_lineitem(spark, base)).transform(te)
    from estima.operators.columns import append_prediction
    return rsig(append_prediction(scored, te.columns), "prediction")


@q("score_batch", "WITH " + S.RIDGE_LI + f" SELECT {LI_KEY_SQL}, l_extendedprice, {S.rs('prediction')} AS charge FROM al")
def score_batch_q(spark, base):
    te = lineitem_frame(spark, base).select(*LI_KEY, "l_extendedprice", "charge")
    return rsig(R.score_batch(ridge_lineitem(spark, base), te, "charge", replace=True), "charge")


@q("score_inline", "WITH " + S.RIDGE_LI + f" SELECT {LI_KEY_SQL}, l_extendedprice, {S.rs('prediction')} AS prediction FROM al")
def score_inline_q(spark, base):
    te = lineitem_frame(spark, base)
    req = te.select(*LI_KEY, F.concat(F.lit("l_extendedprice:"), F.col("l_extendedprice").cast("string")).alias("request"))
    return rsig(R.score_inline(ridge_lineitem(spark, base), req, "request", keep=LI_KEY), "prediction")


@q("format_prediction", "WITH " + S.RIDGE_LI + f" SELECT {LI_KEY_SQL}, printf('%.2f', prediction) AS prediction_text FROM al")
def format_prediction_q(spark, base):
    return R.format_prediction(lineitem_predictions(spark, base)).select(*LI_KEY, "prediction_text")


_GUARD = """SELECT c_custkey, 'c_mktsegment' AS feature, 'unseen_category' AS problem, c_mktsegment AS value
FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT c_custkey, 'c_acctbal', 'null_value', NULL FROM customer WHERE c_acctbal < 0
UNION ALL SELECT NULL, 'c_rating', 'missing_column', NULL"""


@q("score_guard", _GUARD)
def score_guard_q(spark, base):
    """All customers against a model that never saw one segment; negative balances are taken
    as missing, and one column of the model isn't there."""
    c = scan_table(spark, base, "customer", ["c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"])
    seen = c.where(F.col("c_mktsegment") != "BUILDING").withColumn("c_rating", F.col("c_custkey") % 7)
    model = pipeline_fit(seen, ["c_mktsegment", "c_acctbal", "c_rating"], "c_nationkey", "ridge")
    rows = c.select("c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"))
    return R.score_guard(model, rows, ["c_custkey"])


# ----------------------------------------------------------------- registry

@q("model_metadata", "WITH " + S.RIDGE_LI + f"""
SELECT 'ridge' AS model_name, 'charge' AS target_feature, 'l_extendedprice' AS features,
       {S.rs('1 - sum((charge - prediction) * (charge - prediction)) / (count(*) * var_pop(charge))')} AS r2 FROM te""")
def model_metadata_q(spark, base):
    """What is recorded of the fitted model, its r2 on the test rows; the dates and versions left out."""
    r2 = V.r2(lineitem_test_predictions(spark, base), "charge").first()["r2"]
    m = model_metadata(spark, "ridge", ["l_extendedprice"], "charge", r2)
    m = m.select("model_name", "target_feature", F.concat_ws(",", "features").alias("features"), F.col("r2").cast("double").alias("r2"))
    return rsig(m, "r2")


@q("model_save", _PRED.replace(", l_returnflag, l_linestatus", ""))
def model_save_q(spark, base):
    path = scratch(spark, "model")
    model_save(ridge_lineitem(spark, base), model_metadata(spark, "ridge", ["l_extendedprice"], "charge", None), path)
    b = model_load(spark, path)
    te = lineitem_frame(spark, base).select(*LI_KEY, "l_extendedprice", "charge")
    return rsig(R.predict(b.model, te), "prediction")


@q("model_load", "SELECT 'charge' AS target_feature, 'ridge' AS model_name, 1 AS n_features")
def model_load_q(spark, base):
    path = scratch(spark, "model")
    model_save(ridge_lineitem(spark, base), model_metadata(spark, "ridge", ["l_extendedprice"], "charge", None), path)
    b = model_load(spark, path)
    return spark.createDataFrame([(b.metadata["target_feature"], b.metadata["model_name"], len(b.metadata["features"]))],
                                 "target_feature string, model_name string, n_features int")


@q("score_sink", _PRED.replace(", l_returnflag, l_linestatus", "").replace(", charge,", ","))
def score_sink_q(spark, base):
    te = lineitem_frame(spark, base).select(*LI_KEY, "l_extendedprice")
    path = scratch(spark, "scored")
    score_sink(R.predict(ridge_lineitem(spark, base), te), path)
    return rsig(spark.read.parquet(path), "prediction")


# ----------------------------------------------------------------- streaming

@q("score_stream", _PRED.replace(", l_returnflag, l_linestatus", "").replace(", charge,", ","))
def score_stream_q(spark, base):
    """Score lineitem as a file stream (every file the folder holds, then stop)
    with the fitted ridge; the sink is read back as a table."""
    from estima.streaming import start_scoring
    schema = scan_table(spark, base, "lineitem").schema
    # a glob path: the table may be a single file, and a file source wants a folder or a pattern
    stream = (spark.readStream.schema(schema).parquet(f"{base.rstrip('/')}/lineitem.parque[t]")
              .select(*LI_KEY, "l_extendedprice"))
    out = scratch(spark, "stream-out")
    q_ = start_scoring(ridge_lineitem(spark, base), stream, out, available_now=True)
    q_.awaitTermination()
    if q_.exception() is not None:
        raise RuntimeError(str(q_.exception()))
    return rsig(spark.read.parquet(out), "prediction")
