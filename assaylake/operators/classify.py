"""Linear classification of sequence features with stratified folds: one-vs-rest linear SVM in Spark ML.

Folds are dealt in turn along a hash of the key within each class, numbered by range partitions, so no class is gathered
and no row moves to the driver; training scales by the standard deviation of its folds and weighs classes by their
inverse frequency.
Metrics are one grouped count of (label, prediction).
"""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.operators.relational import numbered
from assaylake.session import cut_lineage

SEED = 42


def fold_count(rows: DataFrame, label: str) -> int:
    """The size of the smallest class of two rows or more, but five at most; two without such a class."""
    least = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").agg(F.min("n")).first()[0]
    return min(least or 2, 5)


def encoded(df: DataFrame, label: str, name: str = "y") -> DataFrame:
    """Text labels as numbers from 0 in alphabet order."""
    return StringIndexer(inputCol=label, outputCol=name, stringOrderType="alphabetAsc", handleInvalid="skip").fit(df).transform(df)


def folded(df: DataFrame, label: str, key: str, folds: int) -> DataFrame:
    """Adds ``fold``, so dealt that every class stands in two folds at least, and so in every training part.

    Classes of one row are dropped, as they cannot be tested.
    """
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    dealt = numbered(df.join(n, label).drop("_n"), [F.col(label), F.xxhash64(F.lit(SEED), key), F.col(key)], "_at")
    return dealt.withColumn("fold", (F.col("_at") % folds).cast("int")).drop("_at")


def cross_validated(df: DataFrame, label: str, features: str, key: str, folds: int | None = None) -> DataFrame:
    """(key, label, prediction) out of fold; labels are class indices from 0.

    Where fewer than two classes are left nothing can be learned: the only class is predicted, and no rows give none.
    """
    folds = folds or fold_count(df, label)
    rows = folded(df, label, key, folds).select(key, F.col(label).cast("double").alias("label"), array_to_vector(features).alias("raw"), "fold")
    rows = cut_lineage(rows)  # read by every iteration of every fold
    classes = sorted(r.label for r in rows.select("label").distinct().collect())
    if len(classes) < 2:
        return rows.select(key, "label", F.col("label").alias("prediction"))
    kept = F.array(*map(F.lit, classes))  # learned by their place, since dropped classes leave gaps
    rows = rows.withColumn("place", (F.array_position(kept, F.col("label")) - 1).cast("double"))
    out = None
    for k in range(folds):
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        sizes = train.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
        total = sizes.agg(F.sum("_n").alias("t"), F.count(F.lit(1)).alias("c")).first()
        train = train.join(F.broadcast(sizes), "label").withColumn("weight", F.lit(float(total.t) / total.c) / F.col("_n"))
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(train)
        svc = LinearSVC(labelCol="place", maxIter=20, regParam=0.01, weightCol="weight")
        model = (svc if len(classes) == 2 else OneVsRest(classifier=svc, labelCol="place", weightCol="weight")).fit(scaler.transform(train))
        part = model.transform(scaler.transform(test)).select(key, "label", F.get(kept, F.col("prediction").cast("int")).alias("prediction"))
        out = part if out is None else out.unionByName(part)
    return out


def metrics(predictions: DataFrame) -> DataFrame:
    """(metric, value): accuracy, and macro precision, recall and F1, four digits; null without predictions."""
    c = predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    by_label = c.groupBy(F.col("label").alias("k")).agg(hit.alias("tp"), F.sum("n").alias("real"))
    by_guess = c.groupBy(F.col("prediction").alias("k")).agg(F.sum("n").alias("said"))
    k = by_label.join(by_guess, "k", "full").fillna(0)
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("said")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("real")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    one = k.agg(F.round(F.sum("tp") / F.sum("real"), 4).alias("accuracy"), F.round(F.avg(p), 4).alias("macro_precision"), F.round(F.avg(r), 4).alias("macro_recall"), F.round(F.avg(f1), 4).alias("macro_f1"))
    return one.unpivot([], one.columns, "metric", "value")
