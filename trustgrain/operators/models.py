"""Built-in text models for use where no model of your own is registered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_path, written


def _counting(text: str, features: int) -> list:
    return [
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=features),
    ]


def term_counts(df: DataFrame, text: str = "text", features: int = 1 << 16) -> DataFrame:
    """``df`` with a column ``_counts`` in place of ``text``: its terms, counted once for all models, and stored."""
    counted = PipelineModel(_counting(text, features)).transform(df)
    return written(counted.drop(text, "_tokens"), "term-counts")


def fit_classifier(labelled: DataFrame, label: str, text: str = "text", features: int = 1 << 16) -> PipelineModel:
    """Logistic regression over weighted term counts, trained on a table with a numeric ``label`` column.

    A table of ``term_counts`` gives a model that reads such counts; any other is read by its ``text``. The model is stored
    in the shared folder and read back: a stored model carries no training summary, which would tie it to the session that
    trained it.
    """
    counting = [] if "_counts" in labelled.columns else _counting(text, features)
    fitted = Pipeline(
        stages=[
            *counting,
            IDF(inputCol="_counts", outputCol="_features"),
            LogisticRegression(featuresCol="_features", labelCol=label, maxIter=20, regParam=0.01),
        ]
    ).fit(labelled)
    path = work_path(labelled.sparkSession, f"model-{label}")
    fitted.write().save(path)
    return PipelineModel.load(path)


def classify(model: PipelineModel, df: DataFrame, names: list[str], slot: str) -> DataFrame:
    """Add ``<slot>_label`` and ``<slot>_conf``; ``names`` are the labels in class order."""
    labels = F.array(*[F.lit(n) for n in names])
    scored = model.transform(df)
    return scored.select(
        *df.columns,
        F.get(labels, F.col("prediction").cast("int")).alias(f"{slot}_label"),
        F.array_max(vector_to_array("probability")).alias(f"{slot}_conf"),
    )


@dataclass(frozen=True)
class RatingModel:
    """An ordinal model: the weighted term counts of a text, and for each level but the last the chance of more."""

    features: PipelineModel
    above: list[LogisticRegressionModel]
    levels: tuple[int, ...]


def fit_rating(labelled: DataFrame, label: str = "rating", text: str = "text", levels: tuple[int, ...] = (1, 2, 3, 4, 5), features: int = 1 << 16) -> RatingModel:
    """Stars from text, learnt from a table with a whole number in ``label``.

    Levels have an order, which a model of unrelated classes would not know: for each level but the last, a logistic
    regression tells texts above it from the others (Frank and Hall, "A Simple Approach to Ordinal Classification",
    2001). All share one set of term counts. Levels that no text is above, or all, keep a constant chance.
    """
    steps = Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[\p{L}\p{N}_]{2,}|[^\p{L}\p{N}_\s]+", gaps=False),
            HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=features),
            IDF(inputCol="_counts", outputCol="_features"),
        ]
    ).fit(labelled)
    path = work_path(labelled.sparkSession, "model-rating")
    steps.write().save(f"{path}/features")
    known = written(steps.transform(labelled).select("_features", F.col(label).cast("int").alias("_level")), "rating-features")
    above = []
    for level in levels[:-1]:
        target = known.withColumn("_above", (F.col("_level") > level).cast("double"))
        one = LogisticRegression(featuresCol="_features", labelCol="_above", maxIter=20, regParam=0.01).fit(target)
        one.write().save(f"{path}/above-{level}")
        above.append(LogisticRegressionModel.load(f"{path}/above-{level}"))
    return RatingModel(PipelineModel.load(f"{path}/features"), above, levels)


def rate(model: RatingModel, df: DataFrame) -> DataFrame:
    """Add ``rating_label`` and ``rating_conf``: the likeliest level as text, the lower one of equals, and its chance.

    The chance of a level is that of more than the level below without that of more than itself; where the separate
    models do not fall from level to level, the lower of the two counts.
    """
    own = df.columns
    scored = model.features.transform(df)
    chances = []
    for k, one in enumerate(model.above):
        name = f"_above_{k}"
        out = one.copy({one.rawPredictionCol: f"_raw_{k}", one.probabilityCol: f"_p_{k}", one.predictionCol: f"_y_{k}"}).transform(scored)
        p = vector_to_array(f"_p_{k}")
        # A level that no example is above has a model with one class.
        scored = out.withColumn(name, F.coalesce(F.get(p, F.lit(1)), F.lit(0.0))).drop(f"_raw_{k}", f"_p_{k}", f"_y_{k}")
        chances.append(name)
    falling = [F.lit(1.0), *[F.least(*chances[: k + 1]) if k else F.col(chances[0]) for k in range(len(chances))], F.lit(0.0)]
    each = F.array(*[
        F.struct((a - b).alias("chance"), F.lit(-level).alias("order"), F.lit(str(level)).alias("level"))
        for a, b, level in zip(falling, falling[1:], model.levels, strict=False)
    ])
    best = F.array_max(each)
    return scored.select(*own, best["level"].alias("rating_label"), best["chance"].alias("rating_conf"))
