"""Feature encoding as a Spark ML pipeline, and the slot table.

Layout of the feature vector (as in the reference): the standardised numeric
block first, then one one-hot block per categorical feature with one slot per
known category in alphabetical order. Unseen and null categories encode as all
zeros. Every fitted stage is a built-in Spark ML stage (``SQLTransformer``,
``StringIndexerModel``, ``OneHotEncoderModel``, ``VectorAssembler``), so a
fitted pipeline is saved and loaded by Spark ML itself and runs unchanged on a
streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES_COL = "features"
Z_PREFIX, S_PREFIX, I_PREFIX, O_PREFIX = "__z_", "__s_", "__i_", "__o_"


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _dbl(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


class PopulationScaler(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / std with the *population* std, learned in one aggregate.

    A zero std scales by 1 (the column becomes x - mean). The fitted form is a
    ``SQLTransformer`` with the parameters as double literals."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        cols, outs = self.getInputCols(), self.getOutputCols()
        aggs = []
        for i, c in enumerate(cols):
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
        r = df.agg(*aggs).first() if cols else None
        exprs = []
        for i, (c, o) in enumerate(zip(cols, outs)):
            m = r[f"m{i}"] or 0.0
            s = r[f"s{i}"] or 0.0
            scale = s if s > 0 else 1.0
            exprs.append(f"(CAST({_q(c)} AS DOUBLE) - {_dbl(m)}) / {_dbl(scale)} AS {_q(o)}")
        stmt = "SELECT *" + "".join(", " + e for e in exprs) + " FROM __THIS__"
        return SQLTransformer(statement=stmt)


def preprocess(numeric: Sequence[str], categorical: Sequence[str],
               features_col: str = FEATURES_COL) -> list:
    """Stages: text form of categoricals, index (alphabetical; unseen and null get
    the extra last index), one-hot with that last slot dropped (unseen -> zeros,
    and no always-zero slot that would make the normal equations singular),
    population scaling of numerics, assembly."""
    numeric, categorical = list(numeric), list(categorical)
    stages: list = []
    if categorical:
        casts = ", ".join(f"CAST({_q(c)} AS STRING) AS {_q(S_PREFIX + c)}" for c in categorical)
        stages.append(SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__"))
        stages.append(StringIndexer(inputCols=[S_PREFIX + c for c in categorical],
                                    outputCols=[I_PREFIX + c for c in categorical],
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[I_PREFIX + c for c in categorical],
                                    outputCols=[O_PREFIX + c for c in categorical],
                                    dropLast=True))
    if numeric:
        stages.append(PopulationScaler(inputCols=numeric, outputCols=[Z_PREFIX + c for c in numeric]))
    stages.append(VectorAssembler(inputCols=[Z_PREFIX + c for c in numeric] + [O_PREFIX + c for c in categorical],
                                  outputCol=features_col, handleInvalid="keep"))
    return stages


def preprocess_pipeline(numeric: Sequence[str], categorical: Sequence[str]) -> Pipeline:
    return Pipeline(stages=preprocess(numeric, categorical))


def standardise(df: DataFrame, columns: Sequence[str], suffix: str = "_z", fit_on: DataFrame | None = None) -> DataFrame:
    """Append ``{c}{suffix}`` = population-standardised ``c``; parameters learned on
    ``fit_on`` (the training rows) when given."""
    model = PopulationScaler(inputCols=list(columns), outputCols=[c + suffix for c in columns]).fit(fit_on or df)
    return model.transform(df)


def one_hot(df: DataFrame, column: str, key_cols: Sequence[str], fit_on: DataFrame | None = None,
            max_categories: int = 100_000) -> DataFrame:
    """Sparse one-hot form ``(key..., value, slot)``: the index of the row's hot
    slot among the known categories (alphabetical, from ``fit_on``), null for an
    unseen or missing value (all-zero row). One row per input row, no pairs.

    The category table is one row per category; it is broadcast only when its
    size is within ``max_categories`` (checked), else joined by shuffle."""
    from estima.operators.split import sorted_rank
    src = fit_on or df
    cats = (src.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("__cat"))
            .distinct())
    n_cats = cats.count()
    # slot = alphabetical rank of the category, ranked without a single-task sort
    cats = sorted_rank(cats, "__cat", "slot", n_rows=n_cats)
    if n_cats <= max_categories:
        cats = F.broadcast(cats)
    vals = df.select(*key_cols, F.col(column).cast("string").alias("value"))
    return vals.join(cats, vals["value"] == cats["__cat"], "left").select(*key_cols, "value", "slot")


# --------------------------------------------------------------------------- slot table

def _assembler(model: PipelineModel) -> VectorAssembler:
    return [s for s in model.stages if isinstance(s, VectorAssembler)][-1]


def fitted_roles(model: PipelineModel) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature names of a fitted preprocessing pipeline."""
    cols = _assembler(model).getInputCols()
    num = [c[len(Z_PREFIX):] for c in cols if c.startswith(Z_PREFIX)]
    cat = [c[len(O_PREFIX):] for c in cols if c.startswith(O_PREFIX)]
    return num, cat


def category_labels(model: PipelineModel) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for s in model.stages:
        if isinstance(s, StringIndexerModel):
            for inp, labels in zip(s.getInputCols(), s.labelsArray):
                out[inp[len(S_PREFIX):]] = list(labels)
    return out


def slot_rows(model: PipelineModel) -> list[tuple]:
    """``(slot, slot_name, feature, category)`` for every vector position."""
    num, cat = fitted_roles(model)
    labels = category_labels(model)
    rows = [(i, c, c, None) for i, c in enumerate(num)]
    for c in cat:
        for lab in labels.get(c, []):
            rows.append((len(rows), f"{c}_{lab}", c, lab))
    return rows


def slot_names(model: PipelineModel, spark) -> DataFrame:
    """The slot table: which original feature (and category) each vector slot
    encodes. Drives every slot -> feature mapping; no name parsing."""
    return spark.createDataFrame(slot_rows(model), "slot int, slot_name string, feature string, category string")


def known_categories(model: PipelineModel, spark) -> DataFrame:
    """``(feature, category, position)`` of a fitted model, categories sorted."""
    rows = [(f, lab, i) for f, labs in category_labels(model).items() for i, lab in enumerate(labs)]
    return spark.createDataFrame(rows, "feature string, category string, position int")
