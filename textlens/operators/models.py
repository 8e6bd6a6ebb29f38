"""Classifier training on Spark ML (M04, M05) and checkpoint choice (M06 in metrics).

Transformer fine-tuning is a single-machine GPU loop and is not rebuilt; the
distributed equivalent is a Spark ML pipeline over hashed term features,
optionally fused with the knowledge features, fitted once and reused.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Hashed term space.  The optimiser aggregates a dense gradient of this width
# every iteration, so it is sized to the vocabulary, not to the data volume.
NUM_FEATURES = 1 << 14


def feature_stages(text_col: str = "text", extra_cols: Sequence[str] = (), num_features: int = NUM_FEATURES):
    """Tokenise (Unicode word characters), hash, IDF, then fuse extra
    numeric/vector columns (e.g. the knowledge features)."""
    tok = RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"[\p{L}\p{N}_]+", gaps=False,
                         toLowercase=True)
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="_tfidf", minDocFreq=1)
    stages = [tok, tf, idf]
    if extra_cols:
        stages.append(VectorAssembler(inputCols=["_tfidf", *extra_cols], outputCol="features"))
    else:
        stages.append(VectorAssembler(inputCols=["_tfidf"], outputCol="features"))
    return stages


def train_classifier(train: DataFrame, text_col: str = "text", label_col: str = "label",
                     extra_cols: Sequence[str] = (), max_iter: int = 50, reg: float = 0.01,
                     num_features: int = NUM_FEATURES) -> PipelineModel:
    """Fit features + binary logistic regression; kept by :func:`save_model`.
    :func:`textlens.operators.training.train_joint` trains with evaluation
    steps and checkpoints instead."""
    lr = LogisticRegression(featuresCol="features", labelCol=label_col, maxIter=max_iter, regParam=reg)
    data = train.where(F.col(label_col).isNotNull()).withColumn(label_col, F.col(label_col).cast("double"))
    cols = [text_col, label_col, *extra_cols]
    data = data.select(*cols).persist()  # several passes: IDF fit, then the optimiser
    try:
        return Pipeline(stages=[*feature_stages(text_col, extra_cols, num_features), lr]).fit(data)
    finally:
        data.unpersist()


def save_model(model: PipelineModel, path: str) -> None:
    """Write the fitted pipeline, all its stages, to a folder; an older one there is replaced."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """The pipeline that :func:`save_model` wrote, ready to predict."""
    return PipelineModel.load(path)


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns + ``p_positive`` and ``prediction`` (0/1)."""
    out = model.transform(df)
    return out.select(*keep, F.get(vector_to_array("probability"), 1).alias("p_positive"),
                      F.col("prediction").cast("int").alias("prediction"))


def train_multitask(train: DataFrame, label_cols: Mapping[str, str], text_col: str = "text",
                    extra_cols: Sequence[str] = (), max_iter: int = 50, reg: float = 0.01,
                    num_features: int = NUM_FEATURES):
    """Shared features fitted once, one logistic head per task.  Returns
    ``(feature_model, {task: head})``."""
    feats = Pipeline(stages=feature_stages(text_col, extra_cols, num_features)).fit(train)
    # Every head reads the same features: compute them once.
    x = feats.transform(train).select("features", *label_cols.values()).persist()
    heads = {}
    try:
        for task, col in label_cols.items():
            lr = LogisticRegression(featuresCol="features", labelCol="_y", maxIter=max_iter, regParam=reg)
            heads[task] = lr.fit(x.where(F.col(col).isNotNull()).withColumn("_y", F.col(col).cast("double")))
    finally:
        x.unpersist()
    return feats, heads


def predict_multitask(feats: PipelineModel, heads: Mapping, df: DataFrame, label_cols: Mapping[str, str],
                      id_col: str) -> DataFrame:
    """Long predictions ``(id, task, y, p, yhat)`` for the metric operators."""
    x = feats.transform(df)
    # one pass: every head adds its columns to the same rows
    given = []
    for i, (task, head) in enumerate(heads.items()):
        head = head.copy({head.probabilityCol: f"_p{i}", head.predictionCol: f"_yhat{i}", head.rawPredictionCol: f"_raw{i}"})
        x = head.transform(x)
        given.append(F.struct(F.lit(task).alias("task"), F.col(label_cols[task]).cast("int").alias("y"),
                              F.get(vector_to_array(f"_p{i}"), 1).alias("p"), F.col(f"_yhat{i}").cast("int").alias("yhat")))
    return x.select(id_col, F.inline(F.array(*given)))
