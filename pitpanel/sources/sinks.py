"""Table and metric sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_run(tables: dict[str, DataFrame], root: str, run_id: str) -> None:
    """Every table of a run under its own folder, partitioned by run; a run id is never reused."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}/run_id={run_id}")


def metric_rows(df: DataFrame, section: str, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Results as long metrics (section, key, metric, value); NaN and missing values become NULL."""
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    clean = [F.when(F.isnan(F.col(m).cast("double")), None).otherwise(F.col(m).cast("double")).alias(m) for m in metrics]
    return df.select(F.lit(section).alias("section"), key.alias("key"), *clean).unpivot(["section", "key"], list(metrics), "metric", "value")


def metrics_json(metrics: DataFrame) -> DataFrame:
    """One JSON document per (section, key), fields in name order."""
    pairs = F.sort_array(F.collect_list(F.struct("metric", F.col("value").alias("value"))))
    return metrics.groupBy("section", "key").agg(F.to_json(F.map_from_entries(pairs), {"ignoreNullFields": "false"}).alias("json"))


def publish(df: DataFrame, path: str, as_of: str) -> None:
    """Replace the as-of copy and the latest copy; other months stay as they are."""
    both = df.withColumn("as_of", F.explode(F.array(F.lit(as_of), F.lit("latest"))))
    both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(path)
