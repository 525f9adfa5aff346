"""Low-review risk: pipelines, tuning, evaluation and batch scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.exprs import PLACES, ratio, rows_where
from storelens.models import forest
from storelens.models.curves import roc_auc
from storelens.models.features import (
    CATEGORY,
    LABEL,
    NUMERIC_V1,
    NUMERIC_V2,
    grouped_category,
    levels,
    top_categories,
    with_weights,
)
from storelens.models.forest import Forest, Packed, StoredForest
from storelens.session import materialize

# The tuning grid; None is no limit of depth.
FULL_GRID = {"numTrees": (200, 400), "maxDepth": (None, 10, 20), "minInstancesPerNode": (1, 5)}
# Fixed value: the default penalty of the logistic regressions.
L2_STRENGTH = 1.0
#: The rows' id, whose order and hash decide what a forest draws.
KEY = "order_id"


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


@dataclass(frozen=True)
class Indicator:
    """A 0/1 column: its name, the level it stands for, and its SQL condition."""

    name: str
    label: str
    test: str


@dataclass(frozen=True)
class Encoding:
    """Category levels learnt on the training rows."""

    top: tuple[str, ...]
    categories: tuple[str, ...]
    payments: tuple[str, ...]

    @classmethod
    def learn(cls, train: DataFrame, k: int = 10) -> Encoding:
        top = top_categories(train, k)
        return cls(
            tuple(sorted(top)),
            tuple(levels(train, grouped_category(top))),
            tuple(levels(train, F.col("payment_type"))),
        )

    def indicators(self) -> list[Indicator]:
        """One per level but the first of each column; names are numbered, so no two levels share one."""
        known = ", ".join(_quoted(c) for c in self.top)
        group = f"CASE WHEN {CATEGORY} IN ({known}) THEN {CATEGORY} ELSE 'other' END" if known else "'other'"
        return [
            Indicator(f"{column}_{number}", f"{column}_{value}", f"({source}) = {_quoted(value)}")
            for column, source, values in (
                ("category_grouped", group, self.categories),
                ("payment_type", "payment_type", self.payments),
            )
            for number, value in enumerate(values[1:], 1)
        ]

    def stage(self) -> SQLTransformer:
        columns = [f"CASE WHEN {i.test} THEN 1 ELSE 0 END AS `{i.name}`" for i in self.indicators()]
        return SQLTransformer(statement=f"SELECT {', '.join(['*', *columns])} FROM __THIS__")


def _numeric_only() -> list:
    return [VectorAssembler(inputCols=list(NUMERIC_V1), outputCol="features")]


def _encoded(encoding: Encoding, scaled: bool) -> list:
    numeric = VectorAssembler(inputCols=list(NUMERIC_V2), outputCol="numeric")
    stages = [encoding.stage(), numeric]
    if scaled:
        stages.append(StandardScaler(inputCol="numeric", outputCol="scaled", withMean=True, withStd=True))
    indicators = [i.name for i in encoding.indicators()]
    source = "scaled" if scaled else "numeric"
    stages.append(VectorAssembler(inputCols=[source, *indicators], outputCol="features"))
    return stages


def feature_names(encoding: Encoding) -> list[str]:
    return [*NUMERIC_V2, *[i.label for i in encoding.indicators()]]


def fit_lr(
    train: DataFrame, encoding: Encoding | None = None, balanced: bool = False, strength: float = L2_STRENGTH
) -> PipelineModel:
    """Logistic regression: raw numeric features, or scaled and encoded ones with ``encoding``.

    ``strength`` weighs the squared coefficients against the sum of losses over all rows; Spark weighs
    them against the mean. Coefficients are penalised as they are, not in standard units.
    """
    stages = _encoded(encoding, scaled=True) if encoding else _numeric_only()
    reg = strength / max(1, train.count())
    lr = LogisticRegression(featuresCol="features", labelCol=LABEL, maxIter=1000, regParam=reg, standardization=False)
    if balanced:
        lr = lr.setWeightCol("weight")
        train = with_weights(train)
    fitted = Pipeline(stages=[*stages, lr]).fit(train)
    # The training summary holds the session, which no task can be sent once an observation was made in it.
    fitted.stages[-1]._java_obj.setSummary(train.sparkSession._jvm.scala.Option.empty())
    return fitted


@dataclass(frozen=True)
class RiskForest:
    """A forest on unscaled features, with the encoding it was learnt with."""

    forest: Forest | StoredForest
    encoding: Encoding

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability_low`` and ``prediction``."""
        scored = self.forest.scored(df, feature_array(self.encoding), "probability_low")
        return scored.withColumn("prediction", (F.col("probability_low") > 0.5).cast("double"))


def feature_array(encoding: Encoding) -> Column:
    """The features of a row, in the order of ``feature_names``."""
    numeric = [F.col(c).cast("double") for c in NUMERIC_V2]
    return F.array(*numeric, *[F.expr(f"CASE WHEN {i.test} THEN 1D ELSE 0D END") for i in encoding.indicators()])


def packed(train: DataFrame, encoding: Encoding, rows: int | None = None) -> Packed:
    """The training rows as forests read them: all of them, or about ``rows``."""
    return forest.packed(train, feature_array(encoding), LABEL, KEY, rows)


def grown(train: Packed, encoding: Encoding, params: Mapping[str, int | None]) -> RiskForest:
    """A balanced forest, whose trees are stored."""
    nodes = materialize(forest.grow(train, trees=params["numTrees"], max_depth=params["maxDepth"], min_leaf=params["minInstancesPerNode"]))
    return RiskForest(forest.finished(nodes, len(feature_names(encoding))), encoding)


def fit_rf(train: DataFrame, encoding: Encoding, params: Mapping[str, int | None] | None = None, rows: int | None = None) -> RiskForest:
    """Balanced random forest on unscaled features; 200 trees without a depth limit unless ``params`` say otherwise.

    It learns from all rows, or with ``rows`` from about so many.
    """
    p = {"numTrees": 200, "maxDepth": None, "minInstancesPerNode": 1} | dict(params or {})
    return grown(packed(train, encoding, rows), encoding, p)


@dataclass(frozen=True)
class Tuned:
    """The refitted best forest, its settings, and the score of every grid point."""

    model: RiskForest
    params: dict[str, int | None]
    scores: DataFrame


def tune_rf(
    train: DataFrame,
    encoding: Encoding,
    grid: Mapping[str, Sequence[int | None]] = FULL_GRID,
    folds: int = 3,
    rows: int | None = None,
) -> Tuned:
    """Grid search by cross-validated recall of the low-review class, over the whole grid.

    For each leaf size and fold one forest is grown, of the most trees and without a depth limit; all
    other grid points are parts of it (``models/forest.py``). Folds come from the ``fold`` column of
    the stratified split. Of equal scores the first grid point counts. All training rows take part, in the
    search and in the refit of the best point; with ``rows`` about so many in both.
    """
    table = packed(train, encoding, rows)
    hits = forest.grid_hits(table, trees=grid["numTrees"], depths=grid["maxDepth"], leaves=grid["minInstancesPerNode"], folds=folds)
    # One row per grid point.
    found = {(r["trees"], r["depth"], r["leaf"]): r["cv_recall"] for r in forest.recalls(hits).collect()}
    names = list(grid)
    points = [dict(zip(names, values, strict=True)) for values in product(*grid.values())]
    score = lambda p: found[p["numTrees"], -1 if p["maxDepth"] is None else p["maxDepth"], p["minInstancesPerNode"]]
    best = max(points, key=score)
    data = [(*[p[n] for n in names], float(score(p))) for p in points]
    scores = train.sparkSession.createDataFrame(data, ", ".join([f"{n} long" for n in names] + ["cv_recall double"]))
    return Tuned(grown(table, encoding, best), best, scores)


# --- evaluation -------------------------------------------------------------------------


def confusion(predictions: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    return predictions.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("orders"))


def class_report(predictions: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of each class, of their plain mean, and of their mean by support.

    A class that is never predicted, or has no rows, counts as 0 in the means.
    """
    cells = confusion(predictions, label, prediction)
    known = F.col(label).isin(0, 1) & F.col(prediction).isin(0, 1)
    counts = cells.filter(known).select(
        F.col(label).cast("int").alias("real"), F.col(prediction).cast("int").alias("said"), "orders"
    )
    # At most two rows from here on.
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("real").alias("class"), F.lit(0).alias("claimed"), F.col("orders").alias("support"), F.lit(0).alias("hits")),
        F.struct(F.col("said").alias("class"), F.col("orders").alias("claimed"), F.lit(0).alias("support"), F.when(F.col("real") == F.col("said"), F.col("orders")).otherwise(0).alias("hits")),
    )).alias("s")).select("s.*")
    codes = predictions.sparkSession.range(2).select(F.col("id").cast("int").alias("class"))
    per_class = codes.join(F.broadcast(sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("claimed", "support", "hits")])), "class", "left").na.fill(0)
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    hits, claimed, support = F.col("hits"), F.col("claimed"), F.col("support")
    scores = {"precision": share(hits, claimed), "recall": share(hits, support), "f1": share(2 * hits, claimed + support)}
    rows = per_class.select(F.col("class").cast("string").alias("class"), *[s.alias(n) for n, s in scores.items()], "support")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    plain = rows.agg(F.lit("macro avg").alias("class"), *[F.avg(zero(n)).alias(n) for n in scores], F.sum("support").alias("support"))
    weighted = rows.agg(
        F.lit("weighted avg").alias("class"),
        *[share(F.sum(zero(n) * F.col("support")), F.sum("support")).alias(n) for n in scores],
        F.sum("support").alias("support"),
    )
    every = rows.unionByName(plain).unionByName(weighted)
    return every.select("class", *[F.round(n, PLACES).alias(n) for n in scores], "support")


def evaluate(
    predictions: DataFrame,
    name: str,
    label: str = LABEL,
    prediction: str = "prediction",
    score: str | None = None,
) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class, and ROC-AUC, in one row."""
    said, real = F.col(prediction) == 1, F.col(label) == 1
    hits, claimed, actual = rows_where(said & real), rows_where(said), rows_where(real)
    auc = None
    if score is not None:
        auc = roc_auc(predictions, label, score)
    return predictions.agg(
        F.lit(name).alias("model"),
        ratio(rows_where(said == real), F.count(F.lit(1))).alias("accuracy"),
        ratio(hits, claimed).alias("precision"),
        ratio(hits, actual).alias("recall"),
        ratio(2 * hits, claimed + actual).alias("f1"),
        F.round(F.lit(auc).cast("double"), PLACES).alias("roc_auc"),
    )


def compare(rows: Sequence[DataFrame]) -> DataFrame:
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def choose(models: DataFrame, metrics: Sequence[str] = ("f1", "roc_auc")) -> DataFrame:
    """The best model by the named metrics, each breaking ties of the one before."""
    return models.orderBy(*[F.col(m).desc_nulls_last() for m in metrics], "model").limit(1)


def importances(model: RiskForest, names: Sequence[str], spark: SparkSession, k: int = 10) -> DataFrame:
    """The ``k`` most important features of a fitted forest."""
    rows = [(n, float(w)) for n, w in zip(names, model.forest.importances(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    ).limit(k)


# --- scoring ------------------------------------------------------------------------------

RiskModel = PipelineModel | RiskForest


def with_probability(model: RiskModel, df: DataFrame) -> DataFrame:
    if isinstance(model, RiskForest):
        return model.transform(df)
    return model.transform(df).withColumn("probability_low", vector_to_array("probability")[1])


def score_orders(model: RiskModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Probability of a low review per order, and whether it reaches the threshold."""
    scored = with_probability(model, df)
    return scored.select(
        "order_id",
        F.round("probability_low", PLACES).alias("probability_low"),
        (F.col("probability_low") >= threshold).cast("int").alias("at_risk"),
    )


def save_model(model: RiskModel, path: str, spark: SparkSession | None = None) -> None:
    """Encoding, scaler, assembler and classifier in one artifact; a forest as its encoding and its trees."""
    if isinstance(model, PipelineModel):
        model.write().overwrite().save(path)
        return
    spark = spark or SparkSession.active()
    e, f = model.encoding, model.forest
    learnt = spark.createDataFrame([(list(e.top), list(e.categories), list(e.payments), f.features)], _LEARNT)
    learnt.write.mode("overwrite").parquet(f"{path}/encoding")
    f.table(spark).write.mode("overwrite").parquet(f"{path}/trees")


_LEARNT = "top array<string>, categories array<string>, payments array<string>, features int"


def load_model(path: str, spark: SparkSession | None = None) -> RiskModel:
    spark = spark or SparkSession.active()
    try:
        learnt = spark.read.schema(_LEARNT).parquet(f"{path}/encoding").head()
    except AnalysisException:  # no forest
        return PipelineModel.load(path)
    encoding = Encoding(*[tuple(learnt[c]) for c in ("top", "categories", "payments")])
    return RiskForest(forest.finished(spark.read.schema(forest.NODES).parquet(f"{path}/trees"), learnt["features"]), encoding)
