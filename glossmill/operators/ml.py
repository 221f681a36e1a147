"""Text classifier of Spark ML as a trainable scorer."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.functions.labels import LABELS, code
from glossmill.functions.text import round_at
from glossmill.operators.metrics import class_weights


def fit(train: DataFrame, text: str, label: str, features: int = 1 << 14, rounds: int = 20) -> PipelineModel:
    """Logistic regression over hashed words, classes weighted by inverse frequency."""
    weights = class_weights(train, label).select(F.col("label").alias(label), "weight")
    rows = train.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).join(F.broadcast(weights), label).select(F.col(text).alias("text"), code(F.col(label)).cast("double").alias("y"), "weight")
    stages = [
        RegexTokenizer(inputCol="text", outputCol="w", pattern=r"(?U)[^\w'-]+"), HashingTF(inputCol="w", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="f"),
        LogisticRegression(featuresCol="f", labelCol="y", weightCol="weight", maxIter=rounds, family="multinomial"),
    ]
    return Pipeline(stages=stages).fit(rows)


def predict(model: PipelineModel, rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, model_label, model_confidence, prob_*), probabilities rounded to four places; a NULL text counts as empty."""
    out = model.transform(rows.select(key, F.coalesce(text, F.lit("")).alias("text")))
    p = out.withColumn("p", vector_to_array("probability")).withColumn("p", F.concat("p", F.array_repeat(F.lit(0.0), len(LABELS) - F.size("p"))))
    names = F.array(*map(F.lit, LABELS))
    return p.select(key, F.get(names, (F.array_position("p", F.array_max("p")) - 1).cast("int")).alias("model_label"), round_at(F.array_max("p")).alias("model_confidence"),
                    *(round_at(F.get("p", F.lit(i))).alias(f"prob_{c}") for i, c in enumerate(LABELS)))
