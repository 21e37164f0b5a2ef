"""Clustering, reduction, training and prediction by named algorithms of the ML package."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification, clustering, evaluation, feature, tuning
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CLUSTERS = {"KMeans": clustering.KMeans, "BisectingKMeans": clustering.BisectingKMeans, "GaussianMixture": clustering.GaussianMixture}
_CLASSIFIERS = {"LogisticRegression": classification.LogisticRegression, "RandomForestClassifier": classification.RandomForestClassifier, "GBTClassifier": classification.GBTClassifier, "DecisionTreeClassifier": classification.DecisionTreeClassifier, "NaiveBayes": classification.NaiveBayes, "LinearSVC": classification.LinearSVC}


def skcluster(df: DataFrame, id_: str, columns: list[str], algorithm: str = "KMeans", **params) -> DataFrame:
    """(id, label) by a named algorithm; rows with a NULL among `columns` are left out."""
    stages = [feature.VectorAssembler(inputCols=columns, outputCol="_f", handleInvalid="skip"), _CLUSTERS[algorithm](featuresCol="_f", predictionCol="label", **params)]
    plain = df.select(id_, *columns)
    return Pipeline(stages=stages).fit(plain).transform(plain).select(F.col(id_).alias("id"), "label")


def skdimred(df: DataFrame, id_: str, columns: list[str], k: int = 2) -> DataFrame:
    """(id, eig1..eigk): principal components of the standardised columns."""
    stages = [feature.VectorAssembler(inputCols=columns, outputCol="_f", handleInvalid="skip"), feature.StandardScaler(inputCol="_f", outputCol="_s", withMean=True), feature.PCA(k=k, inputCol="_s", outputCol="_p")]
    made = Pipeline(stages=stages).fit(df).transform(df)
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("_p")
    return made.select(F.col(id_).alias("id"), *[p[i].alias(f"eig{i + 1}") for i in range(k)])


def sktrain(df: DataFrame, path: str, algorithm: str, id_: str, label: str, columns: list[str], folds: int = 3, **params) -> DataFrame:
    """Fits, with cross-validated choice where folds > 1, saves the model at `path` and returns its predictions (id, predicted_label)."""
    estimator = _CLASSIFIERS[algorithm](featuresCol="_f", labelCol=label, **params)
    pipeline = Pipeline(stages=[feature.VectorAssembler(inputCols=columns, outputCol="_f", handleInvalid="skip"), estimator])
    if folds > 1:
        judge = evaluation.MulticlassClassificationEvaluator(labelCol=label)
        model = tuning.CrossValidator(estimator=pipeline, estimatorParamMaps=tuning.ParamGridBuilder().build(), evaluator=judge, numFolds=folds, seed=0).fit(df).bestModel
    else:
        model = pipeline.fit(df)
    model.write().overwrite().save(path)
    return skpredict(df, path, id_).withColumnRenamed("prediction", "predicted_label")


def skpredict(df: DataFrame, path: str, id_: str) -> DataFrame:
    """(id, prediction) of a saved model."""
    return PipelineModel.load(path).transform(df).select(F.col(id_).alias("id"), "prediction")
