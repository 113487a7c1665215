"""Vectors: centroids, nearest centroids, splits and fitted heads."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.functions.vectors import normalise, squared_distance
from skyfold.operators.stored import running_sums


def centroids(rows: DataFrame, by: str, vector: str = "v") -> DataFrame:
    """(by, n, centroid): the mean vector of each group, from sums by dimension."""
    d = rows.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    g = d.groupBy(by).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"))
    return g.select(by, "n", F.transform("p", lambda x: x["m"]).alias("centroid"))


def nearest(rows: DataFrame, refs: DataFrame, ref: str, score: Column, best: str = "max") -> DataFrame:
    """``rows`` with the reference of best score; ties go to the lower reference.

    ``refs`` (a handful of centroids) becomes one array that goes along with
    every row; the best is folded over it without a join.
    """
    all_refs = refs.agg(F.array_sort(F.collect_list(F.struct(F.col(ref).alias("ref"), F.col("centroid")))).alias("__refs")).first()["__refs"]
    lit = F.array(*[F.struct(F.lit(r["ref"]).alias("ref"), F.array(*[F.lit(float(x)) for x in r["centroid"]]).alias("centroid")) for r in all_refs])
    scored = F.transform(lit, lambda r: F.struct((score(r["centroid"]) * (-1 if best == "max" else 1)).alias("s"), r["ref"].alias("ref")))
    return rows.withColumn("__best", F.array_min(scored)).withColumn(ref, F.col("__best.ref")).withColumn("score", F.col("__best.s") * (-1 if best == "max" else 1)).drop("__best")


def lloyd_step(rows: DataFrame, refs: DataFrame, ref: str) -> DataFrame:
    """One step of k-means: assign to the nearest centroid, then take means."""
    return centroids(nearest(rows, refs, ref, lambda c: squared_distance(F.col("v"), c), "min"), ref)


def min_max(rows: DataFrame, by: str, value: str) -> DataFrame:
    w = Window.partitionBy(by)
    return rows.withColumn("heat", (F.col(value) - F.min(value).over(w)) / (F.max(value).over(w) - F.min(value).over(w) + F.lit(1e-8)))


def softmax(rows: DataFrame, by: list[str], logit: str) -> DataFrame:
    w = Window.partitionBy(*by)
    e = F.exp(F.col(logit) - F.max(logit).over(w))
    return rows.withColumn("__e", e).withColumn("p", F.col("__e") / F.sum("__e").over(w)).drop("__e")


def hash_rank(groups: DataFrame, key: str, seed: str, by: list[str] | None = None) -> DataFrame:
    """Distinct keys with their rank by a seeded hash, and how many there are, of all or of each group.

    Ranks are running counts over ordered ranges: no task sorts all keys.
    """
    by = tuple(by or ())
    g = groups.select(key, *by).distinct().withColumn("h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).withColumn("__one", F.lit(1).cast("long"))
    ranked = running_sums(g, [F.col("h"), F.col(key)], by, rank="__one").drop("__one")
    if by:
        return ranked.join(ranked.groupBy(*by).agg(F.count("*").alias("groups")), list(by))
    return ranked.withColumn("groups", F.lit(ranked.count()).cast("long"))


def group_split(rows: DataFrame, group: str, share: float, seed: str = "0:", rounding: str = "ceil") -> DataFrame:
    """(group, split): whole groups go to val or train; sizes by ceil, or by half-even rounding and at least one."""
    if not 0 <= share < 1:
        raise ValueError(f"a share of {share} leaves nothing to train on")
    g = hash_rank(rows, group, seed)
    size = F.ceil(F.col("groups") * share) if rounding == "ceil" else F.greatest(F.lit(1), F.bround(F.col("groups") * share))
    return g.select(group, F.when(F.col("rank") <= size, "val").otherwise("train").alias("split"))


def group_folds(rows: DataFrame, group: str, k: int) -> DataFrame:
    """(group, n, fold): groups by size, each to the fold that holds least so far; ties to the lower fold.

    The greedy choice depends on all before it, so the counted groups pass through
    one task in order, which holds the loads only: as many rows as there are groups.
    """
    kind = dict(rows.dtypes)[group]
    g = rows.groupBy(group).agg(F.count("*").alias("n")).repartition(1).sortWithinPartitions(F.desc("n"), group)

    def deal(batches):
        load = [0] * k
        for pdf in batches:
            folds = []
            for n in pdf["n"].tolist():
                f = load.index(min(load))
                load[f] += n
                folds.append(f)
            yield pdf.assign(fold=np.array(folds, np.int32))

    return g.mapInPandas(deal, f"`{group}` {kind}, n long, fold int")


def kmeans(rows: DataFrame, k: int, seed: int = 0, vector: str = "v", starts: int = 10) -> DataFrame:
    """``rows`` with their cluster, of the start whose clusters are tightest."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.withColumn("features", array_to_vector(vector)).cache()
    models = [KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster").fit(data) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    data.unpersist()
    return best.transform(data).drop("features")


def pseudo_labels(rows: DataFrame, cluster: str, refs: DataFrame, positive, by: str = "tile") -> DataFrame:
    """``rows`` (by, cluster, v) with y = 1 for the clusters whose mean points most towards the positive reference (label, centroid)."""
    from skyfold.functions.vectors import cosine

    means = centroids(rows.withColumn("__k", F.struct(by, cluster)), "__k").select("__k", F.col("centroid").alias("v"))
    near = nearest(means, refs, "label", lambda c: cosine(F.col("v"), c)).select("__k", (F.col("label") == positive).cast("int").alias("y"))
    return rows.join(near.select(F.col(f"__k.{by}").alias(by), F.col(f"__k.{cluster}").alias(cluster), "y"), [by, cluster])


def prompt_embeddings(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, centroid): the mean of each class's vectors, at unit length."""
    return centroids(rows, by).withColumn("centroid", normalise(F.col("centroid")))


def saliency(patches: DataFrame, by: str) -> DataFrame:
    """``patches`` (by, v, whole) with the min-max cosine to the whole image's vector, and whether it is above the image's mean."""
    from skyfold.functions.vectors import cosine

    s = min_max(patches.withColumn("__c", F.round(cosine(F.col("v"), F.col("whole")), 9)), by, "__c").withColumn("heat", F.round("heat", 6))
    return s.withColumn("foreground", F.col("heat") > F.avg("heat").over(Window.partitionBy(by))).drop("__c")


def seeded_sample(rows: DataFrame, key: str, share: float, seed: str = "0:") -> DataFrame:
    """The keys of a sample without replacement: round(n * share), half to even, by a seeded hash."""
    g = hash_rank(rows, key, seed)
    return g.filter(F.col("rank") <= F.bround(F.col("groups") * share)).select(key)


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """n / (classes * n of the class) of each row."""
    per = rows.groupBy(label).agg(F.count("*").alias("__n"))
    one = per.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k")).first()
    return rows.join(F.broadcast(per), label).withColumn("weight", F.lit(float(one["__all"] or 0)) / (F.lit(float(one["__k"] or 1)) * F.col("__n"))).drop("__n")


def fit_heads(train: DataFrame, label: str, seed: int = 0, names=("logistic", "logistic_strong", "svc", "mlp", "forest")) -> dict:
    """Fitted classifiers over ``features``; all but the perceptron, which takes no weights, weight the data by class."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier

    n = train.count()
    base = {"featuresCol": "features", "labelCol": label}
    make = {
        "logistic": lambda: LogisticRegression(**base, weightCol="weight", regParam=1.0 / max(1, n), standardization=False, maxIter=200),
        "logistic_strong": lambda: LogisticRegression(**base, weightCol="weight", regParam=10.0 / max(1, n), standardization=False, maxIter=200),
        "svc": lambda: LinearSVC(**base, weightCol="weight", regParam=1.0 / max(1, n)),
        "mlp": lambda: MultilayerPerceptronClassifier(**base, layers=[len(train.first()["v"]), 64, 2], maxIter=400, seed=seed),
        "forest": lambda: RandomForestClassifier(**base, weightCol="weight", numTrees=120, minInstancesPerNode=4, seed=seed),
    }
    return {name: make[name]().fit(train) for name in names}


def class_one(model, rows: DataFrame) -> DataFrame:
    """``rows`` with the probability of class 1 as ``p``, or its raw prediction where the model has no probabilities."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows)
    return out.withColumn("p", vector_to_array("probability" if "probability" in out.columns else "rawPrediction")[1]).drop("probability", "rawPrediction", "prediction")


def l2(rows: DataFrame, vector: str = "v") -> DataFrame:
    return rows.withColumn(vector, normalise(F.col(vector)))
