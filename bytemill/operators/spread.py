"""Work for all cores where the input comes in fewer pieces than there are."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew if it is a narrow plan over fewer partitions than the cluster has cores, such as one small file.

    Larger inputs have more partitions than that and stay as they are, without a shuffle. A plan with an exchange is left
    alone as well: counting its partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
