"""The codec selector: split, weights, training, prediction, and what is measured of it."""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytemill.operators.features import feature_rows, with_vector
from bytemill.schema import FEATURES, MissingCodecError


#: Hexadecimal digits that make a range of a split's order: 65,536 ranges a class.
DIGITS = 4


def _split_sizes(n, val: float, test: float):
    """Test and validation sizes of a class of n: at least one each, cut down (validation first) while nothing is left for training."""
    t = F.greatest(F.lit(1), F.bround(n * test, 0).cast("int"))
    v = F.greatest(F.lit(1), F.bround(n * val, 0).cast("int"))
    over = F.greatest(F.lit(0), t + v - n + 1)
    v2 = F.greatest(F.lit(1), v - over)
    t2 = F.greatest(F.lit(1), t - (over - (v - v2)))
    return F.when(n == 1, 0).when(n == 2, 1).otherwise(t2), F.when(n <= 2, 0).otherwise(v2)


def stratified_split(df: DataFrame, label: str, key: str, val: float = 0.15, test: float = 0.15, seed: int = 0) -> DataFrame:
    """df with split (train, val or test), drawn in each class by the order of SHA-256 of seed and key.

    A class of one is trained on, of two gives one row to the test; otherwise val and test get their rounded (half to
    even) shares, at least one row each.

    The order is found by ranges of the first DIGITS digits of the hash: counts per class and range give each range its first place,
    and rows are numbered within a range, so no task holds a class.
    """
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    marked = df.withColumn("_m", mark).withColumn("_b", F.substring("_m", 1, DIGITS))
    counts = marked.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_c")).agg(F.count(F.lit(1)).alias("_k"))
    own = Window.partitionBy("_l")
    places = counts.select("_l", "_c", (F.sum("_k").over(own.orderBy("_c")) - F.col("_k")).alias("_f"), F.sum("_k").over(own).alias("_n"))
    ranked = marked.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_m", key)))
    ranked = ranked.join(places, F.col(label).eqNullSafe(F.col("_l")) & F.col("_b").eqNullSafe(F.col("_c"))).withColumn("_r", F.col("_r") + F.col("_f"))
    t, v = _split_sizes(F.col("_n"), val, test)
    split = F.when(F.col("_r") <= F.col("_n") - t - v, "train").when(F.col("_r") <= F.col("_n") - t, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_n", "_r", "_m", "_b", "_l", "_c", "_f")


def small_classes(df: DataFrame, label: str, least: int = 10) -> DataFrame:
    """Classes with fewer rows than make a split worth something."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight: all rows / (classes * rows of the class)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))
    return n.select(label, "n", (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"))


def accuracy(df: DataFrame, y: str, y_hat: str) -> DataFrame:
    """One row: n, accuracy."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(y) == F.col(y_hat)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, y: str, y_hat: str) -> DataFrame:
    """y, y_hat, n for every pair of labels that occur on either side, zeros included."""
    labels = df.select(F.explode(F.array(F.col(y), F.col(y_hat))).alias("l")).distinct()
    grid = labels.select(F.col("l").alias("y")).join(labels.select(F.col("l").alias("y_hat")), F.lit(True))
    seen = df.groupBy(F.col(y).alias("y"), F.col(y_hat).alias("y_hat")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(seen, ["y", "y_hat"], "left").select("y", "y_hat", F.coalesce("n", F.lit(0)).alias("n"))


def report(df: DataFrame, y: str, y_hat: str) -> DataFrame:
    """label, precision, recall, f1, support for each class, and the rows `macro avg` and `weighted avg`; 0 where a denominator is 0."""
    m = confusion(df, y, y_hat)
    hit = F.when(F.col("y") == F.col("y_hat"), F.col("n")).otherwise(0)
    true = m.groupBy(F.col("y").alias("l")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hit"))
    said = m.groupBy(F.col("y_hat").alias("l")).agg(F.sum("n").alias("said"))
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    each = true.join(said, "l").select(F.col("l").cast("string").alias("label"), safe(F.col("hit"), F.col("said")).alias("precision"), safe(F.col("hit"), F.col("support")).alias("recall"), "support")
    p, r = F.col("precision"), F.col("recall")
    each = each.select("label", "precision", "recall", safe(2 * p * r, p + r).alias("f1"), "support")
    names = ["precision", "recall", "f1"]
    macro = each.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), *names, "support")
    weighted = each.agg(*[safe(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("label"), *names, "support")
    return each.union(macro).union(weighted)


def train(labelled: DataFrame, seed: int = 0, balanced: bool = True, trees: int = 40, depth: int = 10) -> PipelineModel:
    """A random forest over the features; labelled has the feature columns and best_algorithm. Labels are indexed in alphabetical order."""
    lacking = {"length", "entropy", "printable_ratio", "byte_mean", "byte_variance", "hist", "bigram", "best_algorithm"} - set(labelled.columns)
    if lacking:
        raise ValueError(f"dataset lacks {', '.join(sorted(lacking))}")
    rows = with_vector(labelled)
    rows = rows.join(F.broadcast(class_weights(rows, "best_algorithm").drop("n")), "best_algorithm") if balanced else rows.withColumn("weight", F.lit(1.0))
    index = StringIndexer(inputCol="best_algorithm", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=64).fit(index.transform(rows))
    back = IndexToString(inputCol="prediction", outputCol="algorithm", labels=index.labels)
    return PipelineModel([forest, back])


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


@lru_cache(maxsize=4)
def _loaded(path: str, changed: int, size: int) -> PipelineModel:
    return PipelineModel.load(path)


def load(path: str) -> PipelineModel:
    """The model at path, kept until its files change. Paths outside the local file system are kept by name."""
    local = path.removeprefix("file://").removeprefix("file:")
    if not os.path.exists(local):
        return _loaded(path, 0, 0)
    found = [os.stat(os.path.join(d, f)) for d, _, names in os.walk(local) for f in names]
    return _loaded(os.path.realpath(local), max((s.st_mtime_ns for s in found), default=0), sum(s.st_size for s in found))


def predict(chunks: DataFrame, model: PipelineModel) -> DataFrame:
    """chunks with the algorithm that the model picks for each; no shuffle."""
    rest = [c for c in chunks.columns if c not in ("path", "chunk_idx", "length")]
    found = model.transform(with_vector(feature_rows(chunks, keep=rest)))
    return found.select(*chunks.columns, "algorithm")


def compression_ratio(labelled: DataFrame, algorithm: str = "algorithm") -> DataFrame:
    """One row: rows, ratio of the predicted codecs, of zstd throughout, and of the best codec, from the sizes in labelled."""
    sized = [c for c in labelled.columns if c.startswith("size_")]
    lookup = F.create_map(*[x for c in sized for x in (F.lit(c[5:]), F.col(c))])
    size = F.try_element_at(lookup, F.col(algorithm))
    lost = labelled.where(size.isNull()).select(algorithm).distinct().limit(5).collect()
    if lost:
        raise MissingCodecError("the dataset has no sizes for " + ", ".join(sorted(str(r[0]) for r in lost)))
    total, ratio = F.sum("length"), lambda c: F.when(c == 0, float("inf")).otherwise(F.sum("length") / c)
    return labelled.agg(F.count(F.lit(1)).alias("n"), total.alias("original"), ratio(F.sum(size)).alias("predicted"), ratio(F.sum("size_zstd")).alias("always_zstd"), ratio(F.sum("best_size")).alias("ceiling"))


__all__ = ["FEATURES", "accuracy", "class_weights", "compression_ratio", "confusion", "load", "predict", "report", "save", "small_classes", "stratified_split", "train"]
