"""Boosted trees on feature rows, split by group, to tell how much the features hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.scoring import auc_single, precision_at_recall, ranked_quantiles


def grouped_split(df: DataFrame, group: str, held_out: float, seed: int = 0) -> DataFrame:
    """Adds ``held_out``, the same for all rows of a group: about that share of the groups, by a seeded hash of their name."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(group).cast("string"), F.lit(""))).cast("binary"))
    return df.withColumn("held_out", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1000 < int(held_out * 1000))


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    plain = df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features})
    return VectorAssembler(inputCols=features, outputCol="_features").transform(plain)


def rise_classifier(df: DataFrame, features: list[str], rise: str, size: float, rounds: int = 60, depth: int = 5, seed: int = 0) -> DataFrame:
    """Whether a rise over ``size`` can be told from the features: a row per recall with the AUC on the held-out groups and the
    precision there. ``df`` has ``held_out``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    d = _assembled(df, features).withColumn("label", (F.col(rise) > size).cast("double"))
    model = GBTClassifier(featuresCol="_features", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed).fit(d.where("NOT held_out"))
    told = model.transform(d.where("held_out")).select((F.col("label") > 0).alias("y"), vector_to_array("probability")[1].alias("score"))
    auc = auc_single(told, ["score"], F.col("y")).select("auc", "positives", "negatives")
    return precision_at_recall(told, "score", F.col("y"), [0.5, 0.7, 0.8, 0.9]).join(auc, how="left")  # one row


def rise_regressor(df: DataFrame, features: list[str], rise: str, size: float, rounds: int = 60, depth: int = 5, seed: int = 0) -> DataFrame:
    """How large a rise over ``size`` will be: one row with the held-out MAE, that of the training median, and R²."""
    from pyspark.ml.regression import GBTRegressor

    d = _assembled(df, features).withColumn("label", F.col(rise).cast("double")).where(F.col(rise) > size)
    train = d.where("NOT held_out")
    median = ranked_quantiles(train.withColumn("_all", F.lit(1)), ["_all"], "label", median=0.5).select("median")
    model = GBTRegressor(featuresCol="_features", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed).fit(train)
    told = model.transform(d.where("held_out")).select("label", "prediction").join(median, how="left")  # one row
    off = F.sum((F.col("label") - F.col("prediction")) ** 2)
    return told.agg(
        F.count("*").alias("n"), F.avg("label").alias("mean_rise"), F.avg(F.abs(F.col("label") - F.col("prediction"))).alias("mae"), F.avg(F.abs(F.col("label") - F.col("median"))).alias("median_mae"),
        (1 - off / F.greatest(F.var_pop("label") * F.count("*"), F.lit(1e-9))).alias("r2"),
    )
