"""Joining two versions or vintages of a series: merge, splice, re-base, chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions.columns import ordered, past, whole
from pitpanel.operators.calendar import Keys


def _known(col: str, month: str) -> Column:
    return F.when(F.col(col).isNotNull(), F.col(month))


def merge_vintages(df: DataFrame, keys: Keys, month: str, a: str, b: str, later_wins: bool = True) -> DataFrame:
    """One series from two vintages: where both have a value, the source that reaches further
    is the later vintage and wins (ties go to ``a``); or the earlier one with later_wins=False."""
    end_a, end_b = F.max(_known(a, month)).over(whole(keys)), F.max(_known(b, month)).over(whole(keys))
    b_newer = end_b.isNotNull() & (end_a.isNull() | (end_b > end_a))
    first_b = b_newer if later_wins else ~b_newer
    d = df.withColumn("newer", F.when(b_newer, "b").otherwise("a"))
    value = F.when(first_b, F.coalesce(b, a)).otherwise(F.coalesce(a, b))
    return d.withColumn("value", value).where("value is not null")


def recent_override(df: DataFrame, keys: Keys, month: str, old: str, new: str, window: int) -> DataFrame:
    """Use the new source only after (end of the old source - window months)."""
    start = F.add_months(F.max(_known(old, month)).over(whole(keys)), -window)
    d = df.withColumn("_start", start)
    recent = F.when(F.col("_start").isNull() | (F.col(month) > F.col("_start")), F.col(new))
    return merge_vintages(d.withColumn("_recent", recent), keys, month, "_recent", old).drop("_start", "_recent")


def patch_rescaled(df: DataFrame, keys: Keys, month: str, base: str, other: str, lookback: int) -> DataFrame:
    """Missing months of ``base`` (and those after its end) from ``other`` times the mean
    base/other ratio of the last ``lookback`` common months before them.

    The ratio is averaged over the common months only, then carried to the gaps."""
    common = F.col(base).isNotNull() & F.col(other).isNotNull()
    d = df.withColumn("_r", F.when(common, F.col(base) / F.col(other)))
    # number the common months, average over the last `lookback` of them, carry forward
    d = d.withColumn("_k", F.sum(F.when(common, 1).otherwise(0)).over(past(keys, month)))
    rows = Window.partitionBy(*keys).orderBy("_k").rangeBetween(-(lookback - 1), 0)
    d = d.withColumn("_mean", F.avg("_r").over(rows))
    start, end = F.min(_known(base, month)).over(whole(keys)), F.max(_known(base, month)).over(whole(keys))
    patch = F.col(base).isNull() & (F.col(month) > start) & (F.col("_k") > 0)
    kind = F.when(patch & F.col(other).isNotNull(), F.when(F.col(month) > end, "extended").otherwise("filled"))
    return (d.withColumn("patch", kind)
            .withColumn("value", F.when(kind.isNotNull(), F.col(other) * F.col("_mean")).otherwise(F.col(base)))
            .drop("_r", "_k", "_mean"))


def splice_back(df: DataFrame, keys: Keys, month: str, primary: str, backfill: str, overlap: int) -> DataFrame:
    """Extend ``primary`` backwards with ``backfill`` at the mean ratio of the first
    ``overlap`` common months. ``spliceable`` is false where there is no common month."""
    common = F.col(primary).isNotNull() & F.col(backfill).isNotNull()
    d = df.withColumn("_k", F.sum(F.when(common, 1).otherwise(0)).over(past(keys, month)))
    used = common & (F.col("_k") <= overlap)
    d = (d.withColumn("ratio", F.avg(F.when(used, F.col(primary) / F.col(backfill))).over(whole(keys)))
         .withColumn("_start", F.min(_known(primary, month)).over(whole(keys))))
    value = F.when(F.col(month) < F.col("_start"), F.col(backfill) * F.col("ratio")).otherwise(F.col(primary))
    return d.withColumn("spliceable", F.col("ratio").isNotNull()).withColumn("value", value).drop("_k", "_start")


def splice_forward(df: DataFrame, keys: Keys, month: str, old: str, new: str) -> DataFrame:
    """Extend ``old`` with ``new`` at their mean ratio over the whole overlap; also the ratio's sd."""
    r = F.when(F.col(old).isNotNull() & F.col(new).isNotNull(), F.col(old) / F.col(new))
    d = (df.withColumn("_r", r).withColumn("ratio", F.avg("_r").over(whole(keys)))
         .withColumn("ratio_sd", F.stddev_pop("_r").over(whole(keys)))
         .withColumn("_end", F.max(_known(old, month)).over(whole(keys))))
    value = F.when(F.col(month) > F.col("_end"), F.col(new) * F.col("ratio")).otherwise(F.col(old))
    return d.withColumn("value", value).drop("_r", "_end")


def rebase(df: DataFrame, keys: Keys, month: str, base: str, value: str, bases: list[str]) -> DataFrame:
    """One series from successive bases (``bases`` newest first): each older base is linked at
    its first month in common with the newer level; link factors multiply along the chain.

    Long in, long out: ``base`` names the base of each row. The ratio of two adjacent bases
    at their first common month is one aggregate; a base without a common month is skipped,
    and so are the bases before it (there is no level to link them to)."""
    rank = F.array_position(F.array(*[F.lit(b) for b in bases]), F.col(base)).cast("int")
    d = df.where(F.col(value).isNotNull()).withColumn("_rank", rank)
    by_month = Window.partitionBy(*keys, month).orderBy("_rank")
    # at a month, the next newer base's value (only if adjacent in rank)
    newer = F.when(F.lag("_rank").over(by_month) == F.col("_rank") - 1, F.lag(value).over(by_month))
    d = d.withColumn("_link", newer / F.col(value))
    links = d.groupBy(*keys, "_rank").agg(
        F.min_by("_link", F.when(F.col("_link").isNotNull(), F.col(month))).alias("_f"), F.min(month).alias("_first"))
    chain = Window.partitionBy(*keys).orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    f = F.when(F.col("_rank") == 1, F.lit(1.0)).otherwise(F.col("_f"))
    broken = F.max(F.when(f.isNull(), 1).otherwise(0)).over(chain)
    links = (links.withColumn("factor", F.when(broken == 0, F.exp(F.sum(F.log(f)).over(chain))))
             .withColumn("_newer_first", F.min("_first").over(
                 Window.partitionBy(*keys).orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)))
             .drop("_f", "_first"))
    joined = d.join(links, [*keys, "_rank"])
    keep = F.col("factor").isNotNull() & (F.col("_newer_first").isNull() | (F.col(month) < F.col("_newer_first")))
    return joined.where(keep).select(*keys, month, base, "factor", (F.col(value) * F.col("factor")).alias(value))


def chain_forward(df: DataFrame, keys: Keys, month: str, level: str, growth: str) -> DataFrame:
    """Continue ``level`` past its end by the period growth of ``growth`` (positive series).

    The product of growth factors is the ratio to the value at the end month, so a gap in
    ``growth`` ends the chain. Needs a complete grid."""
    end = F.max(_known(level, month)).over(whole(keys))
    d = df.withColumn("_end", end)
    after = F.col(month) > F.col("_end")
    step = F.log(F.col(growth) / F.lag(growth).over(ordered(keys, month)))
    d = (d.withColumn("_step", F.when(after, step))
         .withColumn("_gap", F.max(F.when(after & F.col("_step").isNull(), 1).otherwise(0)).over(past(keys, month)))
         .withColumn("_base", F.max(F.when(F.col(month) == F.col("_end"), F.col(level))).over(whole(keys))))
    run = F.sum("_step").over(past(keys, month))
    value = F.when(after, F.when(F.col("_gap") == 0, F.col("_base") * F.exp(run))).otherwise(F.col(level))
    return (d.withColumn("value", value)
            .withColumn("label", F.when(after, "chained").otherwise("level")).drop("_end", "_step", "_gap", "_base"))


def chain_backward(df: DataFrame, keys: Keys, month: str, level: str, growth: str) -> DataFrame:
    """Continue ``level`` before its start by ``growth``'s period changes, until the first gap."""
    start = F.min(_known(level, month)).over(whole(keys))
    d = df.withColumn("_start", start)
    before = F.col(month) < F.col("_start")
    back = ordered(keys, month).rowsBetween(0, Window.unboundedFollowing)
    step = F.log(F.col(growth) / F.lead(growth).over(ordered(keys, month)))
    d = (d.withColumn("_step", F.when(before, step))
         .withColumn("_gap", F.max(F.when(before & F.col("_step").isNull(), 1).otherwise(0)).over(back))
         .withColumn("_base", F.max(F.when(F.col(month) == F.col("_start"), F.col(level))).over(whole(keys))))
    value = F.when(before, F.when(F.col("_gap") == 0, F.col("_base") * F.exp(F.sum("_step").over(back)))).otherwise(F.col(level))
    return (d.withColumn("value", value)
            .withColumn("label", F.when(before, "chained").otherwise("level")).drop("_start", "_step", "_gap", "_base"))


def segments(df: DataFrame, keys: Keys, month: str, label: str) -> DataFrame:
    return df.groupBy(*keys, label).agg(F.min(month).alias("first"), F.max(month).alias("last"), F.count("*").alias("n"))


def year_on_year(keys: Keys, month: str, value: str) -> Column:
    """% change on the same month a year earlier, on a complete grid (a column)."""
    prev = F.lag(value, 12).over(ordered(keys, month))
    return (F.col(value) / prev - 1) * 100


def seam_change(df: DataFrame, keys: Keys, month: str, value: str, seam: str) -> DataFrame:
    """Log change of the joined series across its seam month."""
    step = F.log(F.col(value) / F.lag(value).over(ordered(keys, month)))
    return df.withColumn("seam_change", step).where(F.col(month) == F.col(seam))


def seam_concat(df: DataFrame, keys: Keys, month: str, legacy: str, new: str, scale: Column) -> DataFrame:
    """Legacy values (converted by ``scale``) before the new source's first month, new after."""
    seam = F.min(_known(new, month)).over(whole(keys))
    d = df.withColumn("seam", seam)
    value = F.when(F.col("seam").isNull() | (F.col(month) < F.col("seam")), F.col(legacy) * scale).otherwise(F.col(new))
    return d.withColumn("value", value)


def precedence(df: DataFrame, keys: Keys, month: str, first: str, second: str, extend: str) -> DataFrame:
    """``first`` wins; ``second`` only outside its range: extend is "after" or "before"."""
    hi, lo = F.max(_known(first, month)).over(whole(keys)), F.min(_known(first, month)).over(whole(keys))
    outside = F.col(month) > hi if extend == "after" else F.col(month) < lo
    return df.withColumn("value", F.coalesce(F.col(first), F.when(outside, F.col(second))))
