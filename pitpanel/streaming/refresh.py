"""Refresh as a transaction: land, compare, gate, promote or keep, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pitpanel.operators.calendar import Keys
from pitpanel.operators.quality import diff_snapshots, gates

Gate = Callable[[DataFrame], DataFrame]


def promote(before: DataFrame, after: DataFrame, series: Keys, key: str, value: str, jump_limit: float) -> DataFrame:
    """The table after a gated refresh: a series with a hard failure keeps its old rows, every
    other series takes the new ones. ``version`` says which."""
    diffs = diff_snapshots(before, after, series, key, value)
    failed = gates(diffs, after, series, key, value, jump_limit).where("severity = 'hard'").select(*series).distinct()
    new = after.join(failed, list(series), "left_anti").select(*series, key, value, F.lit("new").alias("version"))
    old = before.join(failed, list(series), "left_semi").select(*series, key, value, F.lit("kept").alias("version"))
    return new.unionByName(old)


def partition_gate(group: Keys, checks: dict[str, Column]) -> Gate:
    """A gate on whole groups of a batch: ``checks`` are aggregates that must hold. The groups
    come back with the first failed check (NULL = accepted); one aggregation, any skew."""

    def verdicts(batch: DataFrame) -> DataFrame:
        g = batch.groupBy(*group).agg(*[c.alias(f"_c{i}") for i, c in enumerate(checks.values())])
        failed = F.coalesce(*[F.when(~F.coalesce(F.col(f"_c{i}"), F.lit(False)), F.lit(n)) for i, n in enumerate(checks)])
        return g.select(*group, failed.alias("failed"))

    return verdicts


def judge(rows: DataFrame, gate: Gate, group: Keys) -> DataFrame:
    """Every row with its group's first failed check; a NULL in the group key is a group like others."""
    verdict = gate(rows).select(*[F.col(g).alias(f"_g_{g}") for g in group], "failed")
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    return rows.join(verdict, same).drop(*[f"_g_{g}" for g in group])


def refresh_stream(spark: SparkSession, source: str, schema: StructType, prepare: Callable[[DataFrame], DataFrame], gate: Gate, group: Keys,
                   staging: str, target: str, checkpoint: str, files_per_batch: int = 100, buckets: int = 64) -> None:
    """Stage what has landed since the last run, then judge whole groups and write them to ``target``; then stop.

    Batches only land: how files fall into batches does not matter. Groups live in ``buckets``; the
    buckets that new batches touched are judged again over all their staged rows and replaced, with
    ``failed`` NULL for accepted rows. A batch replayed after a failure overwrites its own staging
    folder, and buckets staged but not judged are judged by the next run."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    marks = f"{checkpoint}-judged"

    def one(batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64(*group), F.lit(buckets))
        prepare(batch).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{staging}/batch_id={batch_id}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    try:
        done = spark.read.parquet(marks).agg(F.max("through")).first()[0]
    except AnalysisException:              # nothing judged so far
        done = -1
    staged = spark.read.parquet(staging)
    new = staged.where(F.col("batch_id") > done)
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]            # ``buckets`` numbers at most
    if touched:
        through = new.agg(F.max("batch_id").alias("through"))
        judged = judge(staged.where(F.col("bucket").isin(touched)).drop("batch_id"), gate, group)
        judged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)
        through.write.mode("append").parquet(marks)


@dataclass(frozen=True)
class Measure:
    """An aggregate of a group that can be put together from parts: ``of`` over rows, ``merge`` (sum, min or max) over parts."""

    of: Column
    merge: str


MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def last_mark(spark: SparkSession, marks: str) -> tuple[int, int, int]:
    """(run, slot, through) of the last run that finished; (-1, 1, -1) before the first."""
    try:
        return tuple(spark.read.parquet(marks).orderBy(F.col("run").desc()).select("run", "slot", "through").first())
    except AnalysisException:
        return -1, 1, -1


def mark(spark: SparkSession, marks: str, run: int, slot: int, through: int) -> None:
    spark.createDataFrame([(run, slot, through)], "run long, slot int, through long").coalesce(1).write.mode("append").parquet(marks)


def refresh_groups(spark: SparkSession, source: str, schema: StructType, prepare: Callable[[DataFrame], DataFrame], measures: dict[str, Measure],
                   checks: dict[str, Column], group: Keys, root: str, files_per_batch: int = 100) -> None:
    """Stage what has landed since the last run and judge the groups from their measures; then stop.

    A batch writes its rows once, and its ``measures`` per group. A run merges the measures of new batches into the
    state (one row per group) and judges anew: it reads new rows and the state, never the rows of earlier batches.
    ``checks`` are conditions on the measures; ``failed`` names the first that does not hold. There are two
    slots for the state; a run writes the one that is not current and marks it only when done, so a run that
    fails leaves the last state and verdicts as they were, and the next run takes up its batches. Batches
    replayed after a failure overwrite their own folders."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def one(batch: DataFrame, batch_id: int) -> None:
        rows = f"{root}/rows/batch_id={batch_id}"
        prepare(batch).write.mode("overwrite").parquet(rows)
        parts = spark.read.parquet(rows).groupBy(*group).agg(*[m.of.alias(n) for n, m in measures.items()])
        parts.write.mode("overwrite").parquet(f"{root}/parts/batch_id={batch_id}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    run, slot, done = last_mark(spark, f"{root}/marks")
    try:
        parts = spark.read.parquet(f"{root}/parts").where(F.col("batch_id") > done)
    except AnalysisException:              # nothing has landed so far
        return
    through = parts.agg(F.max("batch_id")).first()[0]
    if through is None:
        return
    columns = [*group, *measures]
    known = parts.select(*columns)
    if run >= 0:
        known = known.unionByName(spark.read.parquet(f"{root}/state/slot={slot}").select(*columns))
    merged = known.groupBy(*group).agg(*[MERGE[m.merge](n).alias(n) for n, m in measures.items()])
    failed = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])
    merged.withColumn("failed", failed).write.mode("overwrite").parquet(f"{root}/state/slot={1 - slot}")
    mark(spark, f"{root}/marks", run + 1, 1 - slot, through)


def judged_rows(spark: SparkSession, root: str, group: Keys) -> DataFrame:
    """The rows of ``refresh_groups`` that the last finished run knew, each with its group's first failed check."""
    _run, slot, through = last_mark(spark, f"{root}/marks")
    rows = spark.read.parquet(f"{root}/rows").where(F.col("batch_id") <= through).drop("batch_id")
    return judge(rows, lambda _: judged_groups(spark, root).select(*group, "failed"), group)


def judged_groups(spark: SparkSession, root: str) -> DataFrame:
    """One row per group: its measures over all rows so far and its first failed check."""
    return spark.read.parquet(f"{root}/state/slot={last_mark(spark, f'{root}/marks')[1]}")


def current_table(spark: SparkSession, root: str) -> DataFrame | None:
    """What the last promoted refresh wrote; None before the first."""
    run, slot, _through = last_mark(spark, f"{root}/marks")
    return spark.read.parquet(f"{root}/slot={slot}") if run >= 0 else None


def refresh_table(spark: SparkSession, root: str, fetch: Callable[[], DataFrame], gate: Callable[[DataFrame, DataFrame], DataFrame]) -> list:
    """A refresh of a whole table as a transaction: write the candidate beside the current table, gate it, promote it or keep the old one.

    ``gate`` (current, candidate) returns failure rows with ``severity``; the first table is not gated. Hard
    failures, and an error while fetching or writing, leave the current table as it was: it changes by
    one mark, written last. Returns the counts per (severity, gate); a table being read must not be
    refreshed twice meanwhile, as there are two slots."""
    run, slot, _through = last_mark(spark, f"{root}/marks")
    fetch().write.mode("overwrite").parquet(f"{root}/slot={1 - slot}")
    candidate, before = spark.read.parquet(f"{root}/slot={1 - slot}"), current_table(spark, root)
    found = [] if before is None else gate(before, candidate).groupBy("severity", "gate").agg(F.count("*").alias("n")).collect()     # a row per kind of failure
    if not any(r.severity == "hard" for r in found):
        mark(spark, f"{root}/marks", run + 1, 1 - slot, -1)
    return found
