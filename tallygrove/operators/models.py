"""Fits with Spark ML: feature assembly, classifiers, ranking by pairs, calibration, portable scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, IDF, NGram, OneHotEncoder, RegexTokenizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assembly(categorical: list[str], numeric: list[str], text: str | None = None, terms: int = 20_000) -> list:
    """One-hot (unknown kept apart), numbers scaled without centring, TF-IDF of words and word pairs, in one vector ``features``."""
    stages, parts = [], []
    if categorical:
        stages.append(StringIndexer(inputCols=categorical, outputCols=[f"{c}_ix" for c in categorical], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}_ix" for c in categorical], outputCols=[f"{c}_oh" for c in categorical], handleInvalid="keep"))
        parts += [f"{c}_oh" for c in categorical]
    if numeric:
        stages.append(VectorAssembler(inputCols=numeric, outputCol="_num", handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="_num", outputCol="_scaled", withMean=False))
        parts.append("_scaled")
    if text:
        stages += [
            RegexTokenizer(inputCol=text, outputCol="_tok", gaps=False, pattern="[A-Za-z][A-Za-z0-9_]+"),
            NGram(inputCol="_tok", outputCol="_bi", n=2),
            CountVectorizer(inputCol="_tok", outputCol="_tf", vocabSize=terms, minDF=2.0), IDF(inputCol="_tf", outputCol="_tfidf"),
            CountVectorizer(inputCol="_bi", outputCol="_btf", vocabSize=terms, minDF=2.0), IDF(inputCol="_btf", outputCol="_btfidf"),
        ]
        parts += ["_tfidf", "_btfidf"]
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")]


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Rows weighted by n / (classes * rows of the class)."""
    c = df.groupBy(label).agg(F.count("*").alias("_c"))
    t = c.agg(F.sum("_c").alias("_t"), F.count("*").alias("_k"))
    w = c.crossJoin(F.broadcast(t)).select(F.col(label).alias("_l"), (F.col("_t") / (F.col("_k") * F.col("_c"))).alias(out))
    return df.join(F.broadcast(w), F.col(label) == F.col("_l")).drop("_l")


def classifier(kind: str, label: str = "label", weight: str | None = "weight", seed: int = 7):
    more = {"weightCol": weight} if weight else {}
    if kind == "logistic":
        return LogisticRegression(labelCol=label, maxIter=30, regParam=0.01, **more)
    if kind == "svm":
        return OneVsRest(classifier=LinearSVC(maxIter=20, regParam=0.01), labelCol=label, **more)
    if kind == "forest":
        return RandomForestClassifier(labelCol=label, numTrees=30, maxDepth=8, seed=seed, **more)
    if kind == "boosted":
        return GBTClassifier(labelCol=label, maxIter=20, seed=seed, **more)
    raise ValueError(kind)


def fit(df: DataFrame, stages: list, model):
    return Pipeline(stages=[*stages, model]).fit(df)


def pair_differences(rows: DataFrame, query: str, features: list[str], label: str, rank: str, most: int = 10) -> DataFrame:
    """Mirrored differences of each query's best positive to its hardest negatives, weighted by 1 / sqrt(rank)."""
    pos = rows.where(F.col(label) == 1).groupBy(query).agg(F.min(F.struct(rank, *features)).alias("p"))
    neg = rows.where(F.col(label) == 0).where(F.col(rank) <= most).join(pos, query)
    diff = [(F.col(f"p.{f}") - F.col(f)).alias(f) for f in features]
    one = neg.select(query, *diff, F.lit(1.0).alias("label"), (1 / F.sqrt(rank)).alias("weight"))
    return one.unionByName(one.select(query, *[(-F.col(f)).alias(f) for f in features], F.lit(0.0).alias("label"), "weight"))


def portable(coefficients: list[float], intercept: float, features: list[str], means=None, scales=None) -> Column:
    """A fitted logistic model as a column expression."""
    z = F.lit(float(intercept))
    for i, f in enumerate(features):
        x = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        if means is not None:
            x = (x - float(means[i])) / (float(scales[i]) or 1.0)
        z = z + float(coefficients[i]) * x
    return 1 / (1 + F.exp(-z))


def isotonic(df: DataFrame, score: str, label: str):
    return IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="calibrated").fit(df)


def platt(df: DataFrame, score: str, label: str):
    return Pipeline(stages=[VectorAssembler(inputCols=[score], outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol=label)]).fit(df)


def positive(df: DataFrame, out: str = "p") -> DataFrame:
    return df.withColumn(out, F.get(vector_to_array("probability"), F.lit(1)))
