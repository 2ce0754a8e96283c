"""Features, training and prediction of a score model, with pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions.text import check_amounts_compat

# Fixed values.
STAGE_CODES = {"pre-seed": 0, "seed": 1, "series-a": 2, "series a": 2, "series-b": 3, "series b": 3, "growth": 4, "late-stage": 5}
ROLE_CODES = (("partner", 4), ("gp", 4), ("managing director", 4), ("principal", 3), ("vp", 3), ("director", 3), ("associate", 2), ("analyst", 2), ("coordinator", 1), ("intern", 0), ("admin", 1))
SECTORS = {"sector_ai": ("ai", "artificial", "machine learning"), "sector_saas": ("saas", "software"), "sector_fintech": ("fintech", "financial"), "sector_health": ("health", "bio", "medical")}
CHECK_SCALE = 10_000_000

#: The features in order.
FEATURES = [
    "stage_encoded", "sector_count", *SECTORS, "sector_other", "has_email", "email_verified", "email_catch_all", "has_linkedin", "role_encoded", "check_size_min_normalized", "check_size_max_normalized", "times_seen",
    "days_since_scraped", "has_website",
]


def stage_code(stage: Column) -> Column:
    """Place of a stage, -1 if unknown."""
    out = None
    for k, v in STAGE_CODES.items():
        out = (F if out is None else out).when(F.lower(F.trim(stage)) == k, v)
    return out.otherwise(-1)


def role_code(role: Column) -> Column:
    """Rank of the first title, in order, that the role contains; -1 if none."""
    out = None
    for k, v in ROLE_CODES:
        out = (F if out is None else out).when(F.contains(F.lower(role), F.lit(k)), v)
    return out.otherwise(-1)


def lead_features(leads: DataFrame, key: str, as_of: str) -> DataFrame:
    """The 17 features of leads (stage, focus_areas, email, email_status, linkedin, role, check_size, times_seen,
    scraped_at, website), missing values null."""
    areas = F.transform(F.coalesce("focus_areas", F.array().cast("array<string>")), F.lower)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    sector = {k: F.exists(areas, _has(words)) for k, words in SECTORS.items()}
    amounts = check_amounts_compat(F.coalesce("check_size", F.lit("")))
    size = lambda f: F.when(F.size(amounts) > 0, f(amounts) / CHECK_SCALE).otherwise(-1.0)
    none = ~sector["sector_ai"] & ~sector["sector_saas"] & ~sector["sector_fintech"] & ~sector["sector_health"]
    return leads.select(
        key, stage_code(F.coalesce("stage", F.lit(""))).cast("double").alias("stage_encoded"), F.size(areas).cast("double").alias("sector_count"), *[flag(c).alias(k) for k, c in sector.items()],
        flag((F.size(areas) > 0) & none).alias("sector_other"), flag(F.contains("email", F.lit("@"))).alias("has_email"), flag(F.col("email_status") == "verified").alias("email_verified"),
        flag(F.col("email_status") == "catch_all").alias("email_catch_all"), flag(F.contains("linkedin", F.lit("linkedin"))).alias("has_linkedin"), role_code(F.coalesce("role", F.lit(""))).cast("double").alias("role_encoded"),
        size(F.array_min).alias("check_size_min_normalized"), size(F.array_max).alias("check_size_max_normalized"), F.coalesce("times_seen", F.lit(1)).cast("double").alias("times_seen"),
        F.coalesce(F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("scraped_at").cast("timestamp"))) / 86400), F.lit(-1)).cast("double").alias("days_since_scraped"),
        flag(F.col("website").isNotNull()).alias("has_website"),
    )


def _has(words: tuple[str, ...]):
    """A predicate of texts: whether one of the words is in it."""

    def test(text: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(text, F.lit(w))
        return out

    return test


def target(score: Column, least: float = 60) -> Column:
    """The training label of a stored score."""
    return (score >= least).cast("int")


def split(df: DataFrame, label: str, key: str, part: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, by a hash of the key within each label, so the same rows every time."""
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(label), F.col(key)), F.lit(1000))
    return df.where(h >= int(part * 1000)), df.where(h < int(part * 1000))


def train(df: DataFrame, features: list[str], label: str, key: str, rounds: int = 100, trees: int = 100) -> tuple[PipelineModel, dict[str, float]]:
    """The model of best area under the ROC curve of three, and all areas."""
    fit, test = split(df, label, key)
    fit, test = fit.cache(), test.cache()
    try:
        return _best(fit, test, makers(label, rounds, trees), features, label)
    finally:
        fit.unpersist()
        test.unpersist()


def accuracy(df: DataFrame, features: list[str], label: str, key: str, which: str = "gbt", folds: int = 5, **sizes: int) -> float:
    """Mean accuracy over folds, which are dealt by a hash of the key within each label."""
    fold, right = F.pmod(F.xxhash64(F.lit(7), F.col(label), F.col(key)), F.lit(folds)), []
    df = df.withColumn("_fold", fold).cache()
    for k in range(folds):
        model = pipeline(makers(label, **sizes)[which], features).fit(df.where(F.col("_fold") != k))
        right.append(model.transform(df.where(F.col("_fold") == k)).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0])
    df.unpersist()
    known = [r for r in right if r is not None]
    return sum(known) / len(known)


def pipeline(maker, features: list[str]) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True), maker])


def makers(label: str, rounds: int = 100, trees: int = 100) -> dict:
    return {
        "gbt": GBTClassifier(labelCol=label, featuresCol="scaled", maxIter=rounds, maxDepth=5, stepSize=0.1, seed=42),
        "logistic": LogisticRegression(labelCol=label, featuresCol="scaled", maxIter=1000),
        "forest": RandomForestClassifier(labelCol=label, featuresCol="scaled", numTrees=trees, maxDepth=10, seed=42),
    }


def _best(fit: DataFrame, test: DataFrame, makers: dict, features: list[str], label: str) -> tuple[PipelineModel, dict[str, float]]:
    evaluator = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
    models, areas = {}, {}
    for name, maker in makers.items():
        models[name] = pipeline(maker, features).fit(fit)
        areas[name] = evaluator.evaluate(models[name].transform(test))
    return models[max(areas, key=areas.get)], areas


def predict(model: PipelineModel, df: DataFrame, least: float = 0.3) -> DataFrame:
    """C14: ml_score (100 times the probability of the last class) and confidence; -1 where the model is too unsure."""
    p = vector_to_array(F.col("probability"))
    out = model.transform(df).withColumn("_p", p)
    confidence = F.array_max("_p")
    return out.withColumns({"confidence": F.round(confidence, 6), "ml_score": F.when(confidence < least, -1.0).otherwise(F.round(F.element_at("_p", -1) * 100, 4))}).drop("_p", "features", "scaled", "rawPrediction", "probability")
