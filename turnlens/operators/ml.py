"""Models on Spark ML (M07–M11): standardised PCA, group-wise splits,
gradient-boosted win classifier with a per-group argmax."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from turnlens.functions.columns import hash_number
from turnlens.operators.rank import flag_group_argmax
from turnlens.session import scratch_dir


def group_split(df: DataFrame, group: str, train_pct: int = 75, seed: int = 42,
                out: str = "split") -> DataFrame:
    """Split by group id, not by row: every row of a group lands on the
    same side (hash of the id, so no driver-side id list)."""
    bucket = hash_number(F.lit(seed), F.col(group)) % 100
    return df.withColumn(out, F.when(bucket < train_pct, "train").otherwise("test"))


def pca_loadings(df: DataFrame, array_col: str, k: int = 3) -> DataFrame:
    """Impute 0, standardise (mean 0, unit sd), PCA(k). Returns one row
    per (component, dim) with the loading and the component's explained
    variance ratio. The fitted d×k matrix is small (d = vector width)."""
    vec = df.select(array_to_vector(F.transform(F.col(array_col),
                                                lambda x: F.coalesce(x, F.lit(0.0))))
                    .alias("features"))
    scaler = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True)
    pca = PCA(k=k, inputCol="z", outputCol="pcs")
    model = Pipeline(stages=[scaler, pca]).fit(vec)
    pcm = model.stages[-1]
    mat = pcm.pc.toArray()            # d × k
    ev = pcm.explainedVariance.toArray()
    rows = [(int(c), float(ev[c]), int(d), float(mat[d, c]))
            for c in range(mat.shape[1]) for d in range(mat.shape[0])]
    schema = T.StructType([T.StructField("component", T.IntegerType()),
                           T.StructField("explained_variance", T.DoubleType()),
                           T.StructField("dim", T.IntegerType()),
                           T.StructField("loading", T.DoubleType())])
    return df.sparkSession.createDataFrame(rows, schema)


def period_features(facts: DataFrame, entity: Sequence[str], period: str, measures: dict[str, Column],
                    attributes: DataFrame, on: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Per (entity, period) the sums of ``measures`` from the first period
    through this one (one row for every period from the entity's first to the
    last of all), joined to the attributes of the entity. Measures start as
    ``f_``; the running sums stay within an entity's few periods."""
    entity = list(entity)
    names = [f"f_{m}" for m in measures]
    per = facts.groupBy(*entity, period).agg(*[F.sum(c).cast("double").alias(n) for n, c in
                                               zip(names, measures.values(), strict=True)])
    last = facts.select(F.max(period)).scalar()
    spine = per.groupBy(*entity).agg(F.min(period).alias("__lo")).select(
        *entity, F.explode(F.sequence("__lo", last)).alias(period))
    so_far = W.partitionBy(*entity).orderBy(period).rowsBetween(W.unboundedPreceding, 0)
    filled = spine.join(per, [*entity, period], "left").fillna(0.0, names)
    out = filled.select(*entity, period, *[F.sum(n).over(so_far).alias(n) for n in names])
    return out.join(attributes, list(on), "left").fillna(fill, [c for c in attributes.columns if c not in on])


def gbt_per_period(df: DataFrame, period: str, label: str, features: Sequence[str], group: str, id_col: str,
                   split_col: str = "split", max_iter: int = 10, max_depth: int = 5, seed: int = 1,
                   at_once: int = 4) -> tuple[DataFrame, DataFrame]:
    """M10 + W20: one boosted-tree classifier per value of ``period``, fitted
    on its training rows. The rows are written once, a folder per period, and
    ``at_once`` models are fitted side by side, each by Spark over its own
    folder. A period whose training rows hold one class only has no model.

    Returns (scores: the test rows with ``p_win`` and, per (period, group), the
    most probable one flagged ``is_group_top``; importance: period, feature,
    weight). Periods are few (the eras of a game)."""
    spark = df.sparkSession
    path = scratch_dir(spark, "periods")
    wanted = [period, id_col, group, label, split_col, *features]
    df.select(*dict.fromkeys(wanted)).withColumn("__p", F.col(period)).write.partitionBy("__p").parquet(path)
    stored = spark.read.schema(df.select(*dict.fromkeys(wanted)).schema.add("__p", df.schema[period].dataType)) \
        .parquet(path)
    periods = [r[0] for r in stored.groupBy("__p").agg(
        F.count_distinct(F.when(F.col(split_col) == "train", F.col(label))).alias("n"))
        .filter("n > 1").select("__p").orderBy("__p").collect()]
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")

    def fit(p):
        rows = asm.transform(stored.filter(F.col("__p") == F.lit(p)))
        model = GBTClassifier(labelCol=label, featuresCol="features", maxIter=max_iter, maxDepth=max_depth,
                              seed=seed).fit(rows.filter(F.col(split_col) == "train"))
        test = model.transform(rows.filter(F.col(split_col) != "train")) \
            .withColumn("p_win", vector_to_array("probability")[1])
        return test.select(period, id_col, group, label, "p_win"), [
            (p, f, float(w)) for f, w in zip(features, model.featureImportances.toArray(), strict=True)]

    with ThreadPoolExecutor(at_once) as pool:
        fitted = list(pool.map(fit, periods))
    kind = T.StructType([T.StructField(period, df.schema[period].dataType), T.StructField("feature", T.StringType()),
                         T.StructField("weight", T.DoubleType())])
    importance = spark.createDataFrame([row for _, rows in fitted for row in rows], kind)
    if not fitted:
        none = stored.filter(F.lit(False)).select(period, id_col, group, label, F.lit(0.0).alias("p_win"))
        return none.withColumn("is_group_top", F.lit(0)), importance
    scores = reduce(DataFrame.unionByName, [t for t, _ in fitted])
    return flag_group_argmax(scores, [period, group], "p_win", id_col, "is_group_top"), importance


def gbt_group_winner(df: DataFrame, label: str, numeric: Sequence[str],
                     categorical: Sequence[str], group: str, id_col: str,
                     split_col: str = "split", max_iter: int = 20, seed: int = 1) -> DataFrame:
    """M10 + W20: fit a boosted-tree classifier on the train side, score
    every row, flag the most probable row per group."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep")
           for c in categorical]
    asm = VectorAssembler(inputCols=list(numeric) + [f"{c}__idx" for c in categorical],
                          outputCol="features", handleInvalid="keep")
    gbt = GBTClassifier(labelCol=label, featuresCol="features", maxIter=max_iter, seed=seed)
    pipe = Pipeline(stages=[*idx, asm, gbt])
    model = pipe.fit(df.filter(F.col(split_col) == "train"))
    scored = model.transform(df).withColumn("p_win", vector_to_array("probability")[1])
    out = flag_group_argmax(scored.select(id_col, group, split_col, label, "p_win"),
                            [group], "p_win", id_col, "is_group_top")
    return out


def area_under_roc(scored: DataFrame, label: str, prob: str) -> float:
    """AUC of a probability column (Spark ML evaluator, distributed)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    ev = BinaryClassificationEvaluator(rawPredictionCol=prob, labelCol=label,
                                       metricName="areaUnderROC")
    return ev.evaluate(scored.select(F.col(prob).cast("double").alias(prob),
                                     F.col(label).cast("double").alias(label)))


def classification_metrics(scored: DataFrame, label: str, prob: str,
                           threshold: float = 0.5) -> DataFrame:
    """Accuracy, recall and balanced log loss in one aggregate."""
    p = F.least(F.greatest(F.col(prob), F.lit(1e-15)), F.lit(1 - 1e-15))
    y = F.col(label)
    pred = (F.col(prob) >= threshold).cast("int")
    g = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(y == 0).alias("n0"),
                   F.count_if(y != 0).alias("n1"),
                   F.sum(F.when(y == 0, F.log(1 - p)).otherwise(0.0)).alias("s0"),
                   F.sum(F.when(y != 0, F.log(p)).otherwise(0.0)).alias("s1"),
                   F.avg((pred == y).cast("double")).alias("accuracy"),
                   (F.count_if((pred == 1) & (y == 1)) / F.count_if(y == 1)).alias("recall"))
    w0, w1 = F.col("n") / F.col("n0"), F.col("n") / F.col("n1")
    loss = (-w0 / F.col("n0") * F.col("s0") - w1 / F.col("n1") * F.col("s1")) / (w0 + w1)
    return g.select("n", "n0", "n1", "accuracy", "recall", loss.alias("log_loss"))


def class_reweighted_probability(scored: DataFrame, prob: str, out: str = "p_weighted") -> DataFrame:
    """Divide each class probability by its column sum (estimated class
    size) and renormalise per row; returns the positive-class share. The two
    column sums are one scalar subquery."""
    sums = scored.select(F.struct(F.sum(1 - F.col(prob)).alias("s0"),
                                  F.sum(F.col(prob)).alias("s1"))).scalar()
    a = (1 - F.col(prob)) / sums["s0"]
    b = F.col(prob) / sums["s1"]
    return scored.withColumn(out, b / (a + b))
