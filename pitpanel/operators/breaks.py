"""Break tests, likelihood tables, rank statistics and multiple-testing adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions.columns import ordered, whole
from pitpanel.functions.draws import pick
from pitpanel.operators.calendar import Keys
from pitpanel.operators.scan import add_before, by_value, running_extreme


def _ssr(y: str, x: str | None, w) -> Column:
    """Residual sum of squares of y on a constant (and x) over a window."""
    if x is None:
        return F.var_pop(y).over(w) * F.count(y).over(w)
    explained = F.try_divide(F.pow(F.regr_sxy(y, x).over(w), 2), F.regr_sxx(y, x).over(w))          # none where x does not move
    return F.regr_syy(y, x).over(w) - F.coalesce(explained, F.lit(0.0))


def _candidates(df: DataFrame, keys: Keys, time: str, y: str, x: str | None, trim: float) -> DataFrame:
    """Every position with its F statistic, NULL where it is not admissible.

    The left side is a running aggregate, the right side one in descending order; both grow
    row by row, so a series costs one pass in each direction."""
    d = df.dropna(subset=[y] + ([x] if x else []))
    fwd, back = ordered(keys, time), Window.partitionBy(*keys).orderBy(F.col(time).desc())
    k = 2 if x else 1
    d = d.withColumns({"_i": F.row_number().over(fwd) - 1, "n": F.count("*").over(whole(keys)), "_all": _ssr(y, x, whole(keys)),
                       "_left": _ssr(y, x, fwd.rowsBetween(Window.unboundedPreceding, -1)),
                       "_right": _ssr(y, x, back.rowsBetween(Window.unboundedPreceding, 0))})
    inside = (F.col("_i") >= F.floor(F.col("n") * F.lit(trim))) & (F.col("_i") < F.floor(F.col("n") * F.lit(1 - trim)))
    split = F.col("_left") + F.col("_right")
    return d.withColumn("_f", F.when(inside & (F.col("n") > 2 * k), F.try_divide((F.col("_all") - split) / k * (F.col("n") - 2 * k), split)))


def sup_wald(df: DataFrame, keys: Keys, time: str, y: str, x: str | None, trim: float = 0.15) -> DataFrame:
    """Largest break statistic over the trimmed sample and the first row after the break; NULL where no position is admissible."""
    c = _candidates(df, keys, time, y, x, trim)
    return c.groupBy(*keys).agg(F.max("n").alias("n"), F.max("_f").alias("stat"),
                                F.max_by(time, F.when(F.col("_f").isNotNull(), F.struct("_f", -F.col("_i")))).alias("at"))


def _total(rows: Column, f) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda s, r: s + f(r))


def _line(rows: Column) -> tuple[Column, Column]:
    """Constant and slope of y on x over an array of (t, x, y); slope 0 where x does not vary."""
    n = F.size(rows)
    mx, my = _total(rows, lambda r: r["x"]) / n, _total(rows, lambda r: r["y"]) / n
    sxy = _total(rows, lambda r: (r["x"] - mx) * (r["y"] - my))
    sxx = _total(rows, lambda r: (r["x"] - mx) * (r["x"] - mx))
    slope = F.when(sxx > 0, sxy / sxx).otherwise(0.0)
    return my - slope * mx, slope


def _series(df: DataFrame, keys: Keys, time: str, y: str, x: str | None) -> DataFrame:
    """One row per key with its complete rows as a time-ordered array (bounded by the calendar)."""
    d = df.dropna(subset=[y] + ([x] if x else []))
    row = F.struct(F.col(time).alias("t"), (F.col(x) if x else F.lit(0.0)).alias("x"), F.col(y).alias("y"))
    return d.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("rows"))


def _break_test(series: DataFrame, keys: Keys, with_x: bool, reps: int, block: int, seed: int, trim: float) -> DataFrame:
    n = F.size("rows")
    const, slope = _line(F.col("rows"))
    d = series.where(n >= block).withColumn("_c", const).withColumn("_s", slope)
    d = d.withColumn("_res", F.transform("rows", lambda r: r["y"] - F.col("_c") - F.col("_s") * r["x"]))
    d = d.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    # replication 0 is the data itself; row i of the others takes the residual at (start of its
    # block) + i mod block; blocks are drawn by counter, so a retried task draws the same ones
    starts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")),
                         lambda b: pick(seed, "block", n - block + 1, *[F.col(k) for k in keys], F.col("rep"), b))
    d = d.withColumn("_starts", starts)

    def row(r: Column, i: Column) -> Column:
        src = F.get(F.col("_starts"), F.floor(i / block).cast("int")) + i % block
        y = F.col("_c") + F.col("_s") * r["x"] + F.get(F.col("_res"), src.cast("int"))
        return F.struct(r["t"].alias("t"), r["x"].alias("x"), F.when(F.col("rep") == 0, r["y"]).otherwise(y).alias("y"))

    sim = d.select(*keys, "rep", F.inline(F.transform("rows", row)))
    stats = sup_wald(sim, [*keys, "rep"], "t", "y", "x" if with_x else None, trim)
    real = F.max(F.when(F.col("rep") == 0, F.struct("n", "stat", "at")))
    g = stats.groupBy(*keys).agg(real.alias("_r"), F.collect_list(F.when(F.col("rep") > 0, F.col("stat"))).alias("_boot"))
    beyond = F.size(F.filter("_boot", lambda s: s >= F.col("_r.stat")))
    g = g.select(*keys, "_r.*", ((beyond + 1) / F.lit(reps + 1.0)).alias("p"))
    return g.join(series, list(keys))


def break_test(df: DataFrame, keys: Keys, time: str, y: str, x: str | None, reps: int, block: int, seed: int,
               trim: float = 0.15) -> DataFrame:
    """sup-Wald with a moving-block bootstrap p-value, and the fits before and after the break.

    A series travels as one array; the replications are a key, so they spread over the cluster."""
    out = _break_test(_series(df, keys, time, y, x), keys, x is not None, reps, block, seed, trim)
    for name, side in (("before", lambda r: r["t"] < F.col("at")), ("after", lambda r: r["t"] >= F.col("at"))):
        const, slope = _line(F.filter("rows", side))
        out = out.withColumn(f"{name}_const", const)
        if x:
            out = out.withColumn(f"{name}_slope", slope)
    return out.drop("rows")


def sequential_breaks(df: DataFrame, keys: Keys, time: str, y: str, x: str | None, reps: int, block: int, seed: int,
                      at_least: int = 60, level: float = 0.05, trim: float = 0.15) -> DataFrame:
    """Test the whole sample; where significant, test the larger segment too (if long enough)."""
    first = _break_test(_series(df, keys, time, y, x), keys, x is not None, reps, block, seed, trim)
    left, right = F.filter("rows", lambda r: r["t"] < F.col("at")), F.filter("rows", lambda r: r["t"] >= F.col("at"))
    seg = first.where(F.col("p") < level).select(*keys, F.when(F.size(left) >= F.size(right), left).otherwise(right).alias("rows"))
    second = _break_test(seg.where(F.size("rows") >= at_least), keys, x is not None, reps, block, seed + 1, trim)
    cols = [*keys, "n", "stat", "p", "at"]
    return first.select(*cols, F.lit(1).alias("step")).unionByName(second.select(*cols, F.lit(2).alias("step")))


def likelihood_table(fits: DataFrame, keys: Keys, base: str) -> DataFrame:
    """Gaussian log-likelihood, AIC, BIC and the ratio to the base model from (n, k, ssr) rows.

    The error variance counts as a parameter."""
    n = F.col("n")
    d = fits.withColumn("k", F.col("k") + 1).withColumn("loglik", -n / 2 * (F.log(2 * F.pi() * F.col("ssr") / n) + 1))
    ref = F.max(F.when(F.col("model") == base, F.col("loglik"))).over(whole(keys))
    return d.withColumns({"aic": 2 * F.col("k") - 2 * F.col("loglik"), "bic": F.col("k") * F.log(n) - 2 * F.col("loglik"),
                          "lr": 2 * (F.col("loglik") - ref)})


def auc(df: DataFrame, score: str, event: str) -> DataFrame:
    """Area under the ROC curve; ties count one half. One row."""
    v = by_value(df.where(F.col(event).isNotNull()), score, pos=F.count_if(F.col(event) == 1), neg=F.count_if(F.col(event) == 0))
    v = add_before(v, score, ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    pos, neg = F.sum("pos"), F.sum("neg")
    return v.agg(pos.alias("positives"), neg.alias("negatives"),
                 F.when((pos > 0) & (neg > 0), wins / (pos.cast("double") * neg)).alias("auc"))


def holm(df: DataFrame, p: str) -> DataFrame:
    """Step-down adjusted p-values over the whole table (column p_holm)."""
    v = add_before(by_value(df, p, n=F.count("*")), p, ["n"])
    v = v.withColumn("_step", F.least(F.lit(1.0), (F.col("n_total") - F.col("n_before")) * F.col(p)))
    v = running_extreme(v, p, "_step", "p_holm", "max")
    return df.join(v.select(p, "p_holm"), p)


def benjamini_hochberg(df: DataFrame, p: str) -> DataFrame:
    """Step-up adjusted p-values over the whole table (column p_bh)."""
    v = add_before(by_value(df, p, n=F.count("*")), p, ["n"])
    v = v.withColumn("_step", F.col(p) * F.col("n_total") / (F.col("n_before") + F.col("n")))
    v = running_extreme(v, p, "_step", "p_bh", "min").withColumn("p_bh", F.least(F.lit(1.0), F.col("p_bh")))
    return df.join(v.select(p, "p_bh"), p)
