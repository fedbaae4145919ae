"""Gaps against norms: shares and elasticities, adjustments, norms, composites, bands, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitpanel.functions.arrays import with_percentiles
from pitpanel.functions.columns import ordered, past, ratio, whole
from pitpanel.functions.draws import normal, uniform
from pitpanel.operators.asof import asof
from pitpanel.operators.calendar import Keys, trailing_full

Q = "quarter"


def _roll(keys: Keys, c: str, n: int) -> Column:
    return trailing_full(keys, Q, c, n, "sum")


def _carry(keys: Keys, c: str, n: int) -> Column:
    return F.last(c, ignorenulls=True).over(ordered(keys, Q).rowsBetween(-n, 0))


def response(ex: Column, im: Column, inc: Column, eta_x: float | Column, eta_m: float | Column, share: float | Column) -> Column:
    """Balance change (pp of base) per 1% price change: trade volumes plus the income term."""
    return -(eta_x * ex + eta_m * im) / 100 - share * F.coalesce(inc, F.lit(0.0)) / 100


def shares_and_response(q: DataFrame, keys: Keys, window: int, carry: int, eta_x: float, eta_m: float,
                        income_share: float, fallback: float) -> DataFrame:
    """Trailing shares of the base, carried ``carry`` quarters when late, and the response to the
    price; ``response_source`` says whether it was measured, carried or the fallback.

    ``q`` needs ex, im, inc, balance, base per quarter on a complete grid."""
    base = trailing_full(keys, Q, "base", window)
    d = q.withColumn("base_w", base)
    pct = lambda c: _roll(keys, c, window) / F.col("base_w") * 100
    d = d.withColumns({"balance_pct": pct("balance"), "_ex": pct("ex"), "_im": pct("im"), "_inc": pct("inc")})
    d = d.withColumns({"ex_pct": _carry(keys, "_ex", carry), "im_pct": _carry(keys, "_im", carry), "inc_pct": _carry(keys, "_inc", carry)})
    own = response(F.col("ex_pct"), F.col("im_pct"), F.col("inc_pct"), eta_x, eta_m, income_share)
    d = d.withColumn("_own", own)
    source = F.when(F.col("_ex").isNotNull(), "measured").when(F.col("_own").isNotNull(), "carried").otherwise("fallback")
    return (d.withColumn("response_source", source).withColumn("response", F.coalesce("_own", F.lit(fallback)))
            .drop("_ex", "_im", "_inc", "_own"))


def price_adjustment(q: DataFrame, prices: DataFrame, keys: Keys, price: str, window: int, norm_months: int) -> DataFrame:
    """Part of a net bill due to prices above their norm, volumes fixed: net x (1 - norm / paid).

    Paid and norm are trailing means of the monthly price as of the quarter's last month."""
    seen = prices.where(F.col(price).isNotNull())
    means = seen.select(*keys, "ref_month", trailing_full(keys, "ref_month", price, 3 * window).alias("price_paid"),
                        trailing_full(keys, "ref_month", price, norm_months).alias("price_norm"))
    d = asof(q.withColumn("_at", F.add_months(Q, 2)), means, keys, "_at", "ref_month", ["price_paid", "price_norm"]).drop("_at", "fact_time")
    d = d.withColumn("bill_pct", _roll(keys, "bill", window) / F.col("base_w") * 100)
    return d.withColumn("price_adjustment", F.col("bill_pct") * (1 - F.col("price_norm") / F.col("price_paid")))


def cyclical_adjustment(q: DataFrame, keys: Keys, carry: int, coefficient: float) -> DataFrame:
    """Underlying balance: plus the price adjustment, less coefficient x relative cyclical gap.

    Adjustments that are not known count as zero only in the sum."""
    rel = q.withColumn("_rel", F.col("cycle") - F.col("partner_cycle"))
    d = rel.withColumn("relative_cycle", _carry(keys, "_rel", carry)).drop("_rel")
    d = d.withColumn("cyclical", coefficient * F.col("relative_cycle"))
    zero = F.lit(0.0)
    return d.withColumn("underlying", F.col("balance_pct") + F.coalesce("price_adjustment", zero) - F.coalesce("cyclical", zero))


def norms(q: DataFrame, path: DataFrame, keys: Keys, fixed: float, static: float, years: int, carry: int) -> DataFrame:
    """Norm alternatives: the published path as of availability (backcast before it, labelled),
    a fixed and a static one, and the balance that keeps stock/base constant, n g / (1 + g)."""
    d = asof(q, path, keys, "available", "available_norm", ["norm", "norm_se"], first_if_none=True)
    d = d.withColumn("norm_source", F.when(F.col("backcast"), "backcast").otherwise("published")).drop("backcast", "fact_time")
    d = d.withColumn("_n", F.col("stock") / F.col("base"))
    d = d.withColumn("stock_share", _carry(keys, "_n", carry))
    g = F.pow(F.col("base_w") / F.lag("base_w", 4 * years).over(ordered(keys, Q)), 1.0 / years) - 1
    d = d.withColumn("growth", g)
    return d.withColumns({"norm_path": F.col("norm"), "norm_fixed": F.lit(fixed), "norm_static": F.lit(static),
                          "norm_stock": F.col("stock_share") * F.col("growth") / (1 + F.col("growth")) * 100}).drop("_n", "norm")


def gap_per_norm(q: DataFrame, keys: Keys, names: Sequence[str], central: str) -> DataFrame:
    """-(underlying - norm) / response for each norm, the central choice and the fair price."""
    gap = lambda n: -(F.col("underlying") - F.col(f"norm_{n}")) / F.col("response")
    d = q.withColumns({f"gap_{n}": gap(n) for n in names}).withColumn("gap", gap(central))
    return d.withColumn("norm_central", F.col(f"norm_{central}")).withColumn("fair_price", F.col("price") / (1 + F.col("gap") / 100))


def financing_norm(q: DataFrame, keys: Keys, window: int) -> DataFrame:
    """Norm set by stable financing: minus the financing share where positive, zero where not,
    and missing where financing is missing."""
    share = _roll(keys, "financing", window) / F.col("base_w") * 100
    d = q.withColumn("financing_pct", share)
    norm = F.when(F.col("financing_pct").isNull(), None).when(F.col("financing_pct") > 0, -F.col("financing_pct")).otherwise(0.0)
    d = d.withColumn("norm_financing", norm)
    return d.withColumn("gap_financing", -(F.col("underlying") - F.col("norm_financing")) / F.col("response"))


def draw_table(spark: SparkSession, seed: int, draws: int, normals: Sequence[str], uniforms: Sequence[str]) -> DataFrame:
    """One row with an array of ``draws`` values per named stream (size set by the caller)."""
    ids = spark.range(1, draws + 1, numPartitions=1)
    cols = [normal(seed, s, F.col("id")).alias(s) for s in normals] + [uniform(seed, s, F.col("id")).alias(s) for s in uniforms]
    rows = ids.select("id", *cols)
    ordered_rows = F.sort_array(F.collect_list(F.struct("id", *normals, *uniforms)))
    d = rows.agg(ordered_rows.alias("_d"))
    return d.select(*[F.col(f"_d.{s}").alias(s) for s in (*normals, *uniforms)])


def band(q: DataFrame, spark: SparkSession, seed: int, draws: int, eta_x: float, eta_m: float, spread: float,
         levels: Sequence[float], measurement_sd: float = 0.0) -> DataFrame:
    """Percentiles of the gap over the norm's and the elasticities' uncertainty.

    Every row holds its draws in an array; the draw streams are one broadcast row."""
    d = q.join(F.broadcast(draw_table(spark, seed, draws, ["z_norm", "z_balance"], ["u_x", "u_m", "u_share", "u_back"])))
    side = lambda u: 1 - spread + 2 * spread * u

    def one(i: Column) -> Column:
        at = lambda c: F.get(F.col(c), i)
        norm = F.col("norm_central") + F.col("norm_se") * at("z_norm")
        own = response(F.col("ex_pct"), F.col("im_pct"), F.col("inc_pct"), eta_x * side(at("u_x")), eta_m * side(at("u_m")), at("u_share"))
        resp = F.coalesce(own, F.col("response") * side(at("u_back")))
        return -(F.col("underlying") + measurement_sd * at("z_balance") - norm) / resp

    d = d.withColumn("gap_draws", F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), one))
    d = d.drop("z_norm", "z_balance", "u_x", "u_m", "u_share", "u_back")
    return with_percentiles(d, "gap_draws", {f"gap_p{round(100 * p)}": p for p in levels})


def monthly_view(q: DataFrame, months: DataFrame, keys: Keys, price: str, cols: Sequence[str], lo: str, hi: str) -> DataFrame:
    """The latest quarter public at each month: log gap, fair price and its bounds (a larger gap
    means a stronger fair price). ``months`` is (keys, ref_month, price)."""
    facts = q.where(F.col("gap").isNotNull()).withColumn("_rank", F.unix_date(Q))
    d = asof(months.withColumn("_at", F.col("ref_month")), facts, keys, "_at", "available", [Q, "gap", *cols], order="_rank")
    lg = lambda c: F.log(1 + F.col(c) / 100)
    d = d.withColumns({"gap_log": lg("gap"), "gap_log_lo": lg(lo), "gap_log_hi": lg(hi)})
    return d.withColumns({"fair": F.col(price) * F.exp(-F.col("gap_log")), "fair_strong": F.col(price) * F.exp(-F.col("gap_log_hi")),
                          "fair_weak": F.col(price) * F.exp(-F.col("gap_log_lo"))}).drop("_at", "fact_time")


def composite(df: DataFrame, a: str, b: str, wa: float, wb: float, price: str, bands: bool = False) -> DataFrame:
    """Weighted log gap only where both components exist; bounds are joined end to end."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    mix = lambda x, y: F.when(both, (wa * F.col(x) + wb * F.col(y)) / (wa + wb))
    d = df.withColumn("ect", mix(a, b))
    d = d.withColumns({"fair": F.col(price) * F.exp(-F.col("ect")), "misalignment_pct": (F.exp("ect") - 1) * 100})
    if bands:
        d = d.withColumns({"ect_lo": mix(f"{a}_lo", f"{b}_lo"), "ect_hi": mix(f"{a}_hi", f"{b}_hi")})
        d = d.withColumns({"fair_strong": F.col(price) * F.exp(-F.col("ect_hi")), "fair_weak": F.col(price) * F.exp(-F.col("ect_lo"))})
    return d


def composite_fallback(df: DataFrame, a: str, b: str, price: str) -> DataFrame:
    """Mean of two fair levels, or the one available; log gap of the price to it."""
    fair = F.coalesce((F.col(a) + F.col(b)) / 2, F.col(a), F.col(b))
    return df.withColumn("fair", fair).withColumn("gap_log", F.log(F.col(price) / F.col("fair")))


def coefficient_range(history: DataFrame, keys: Keys, time: str, coef: str) -> DataFrame:
    known = history.where(F.col(coef).isNotNull())
    return known.groupBy(*keys).agg(F.min(coef).alias("min"), F.max(coef).alias("max"), F.min(time).alias("first_estimate"),
                                    F.count("*").alias("n_estimates"), F.max_by(coef, time).alias("last"))


def coverage(df: DataFrame, by: Keys, x: str, lo: str, hi: str) -> DataFrame:
    """Share of outcomes inside, below and above a band, and the band's median width in %."""
    d = df.where(F.col(x).isNotNull() & F.col(lo).isNotNull() & F.col(hi).isNotNull())
    share = lambda c: F.avg(c.cast("double"))
    return d.groupBy(*by).agg(
        F.count("*").alias("n"), share((F.col(x) >= F.col(lo)) & (F.col(x) <= F.col(hi))).alias("coverage"),
        share(F.col(x) < F.col(lo)).alias("below"), share(F.col(x) > F.col(hi)).alias("above"),
        F.percentile((F.exp(hi) - F.exp(lo)) * 100, F.lit(0.5)).alias("median_width_pct"))


def conformal_fit(cal: DataFrame, by: Keys, level: float, with_shift: bool) -> DataFrame:
    """Shift and scale of a band from past outcomes (x, lo, mid, hi).

    The score is the distance of the outcome from the shifted centre in half-widths of that
    side; the scale is the ceil((n + 1) level)-th smallest score (an order statistic)."""
    shift = F.avg(F.col("x") - F.col("mid")).over(whole(by)) if with_shift else F.lit(0.0)
    d = cal.withColumn("_shift", shift)
    c = F.col("mid") + F.col("_shift")
    score = F.when(F.col("x") >= c, (F.col("x") - c) / (F.col("hi") - F.col("mid"))).otherwise((c - F.col("x")) / (F.col("mid") - F.col("lo")))
    g = d.withColumn("_s", score).groupBy(*by).agg(F.max("_shift").alias("shift"), F.sort_array(F.collect_list("_s")).alias("_s"))
    n = F.size("_s")
    place = F.least(n, F.ceil((n + 1) * F.lit(level)).cast("int"))
    return g.select(*by, n.alias("n_scores"), "shift", F.element_at("_s", place).alias("scale"))


def apply_calibration(df: DataFrame) -> DataFrame:
    """Band moved by ``shift`` and stretched by ``scale``."""
    c = F.col("mid") + F.col("shift")
    return df.withColumns({"lo_cal": c - F.col("scale") * (F.col("mid") - F.col("lo")), "hi_cal": c + F.col("scale") * (F.col("hi") - F.col("mid"))})


def leave_group_out(df: DataFrame, keys: Keys, group: str, level: float, with_shift: bool) -> DataFrame:
    """Each group (a year) calibrated on all other groups of the data; NULL where there is no other.

    Every row is a calibration row of the other groups: an explode over the list of years, one row
    that the calendar bounds."""
    groups = df.agg(F.collect_set(group).alias("_all"))
    held = df.crossJoin(F.broadcast(groups)).withColumn("_held", F.explode(F.filter("_all", lambda g: g != F.col(group)))).drop("_all")
    fits = conformal_fit(held, [*keys, "_held"], level, with_shift)
    return apply_calibration(df.join(fits.withColumnRenamed("_held", group), [*keys, group], "left"))


def published_calibration(df: DataFrame, months: DataFrame, published: DataFrame, keys: Keys, group: str, level: float,
                          with_shift: bool, min_groups: int) -> DataFrame:
    """Real-time calibration: each month uses only groups published by then (at least
    ``min_groups``); one fit per distinct set of published groups.

    ``published`` is (group, public), a settings table; ``months`` carries the band."""
    w = Window.orderBy("public", group).rowsBetween(Window.unboundedPreceding, 0)          # settings table
    have = df.select(group).distinct()
    sets = (published.join(have, group).withColumn("_set", F.collect_list(group).over(w))
            .withColumn("_size", F.size("_set")).groupBy("public").agg(F.max_by("_set", "_size").alias("_set"), F.max("_size").alias("_size"))
            .where(F.col("_size") >= min_groups))
    members = sets.select("public", F.explode("_set").alias(group))
    fits = conformal_fit(df.join(F.broadcast(members), group), [*keys, "public"], level, with_shift)
    return apply_calibration(asof(months, fits, keys, "ref_month", "public", ["shift", "scale", "n_scores"]))


def adopt(df: DataFrame, cols: dict[str, str], price: str) -> DataFrame:
    """Make another band the headline one: ``cols`` maps headline column -> new column. The old
    values stay as <col>_prev and fill months the new band lacks."""
    d = df.withColumns({f"{c}_prev": F.col(c) for c in cols}).withColumns({c: F.coalesce(n, c) for c, n in cols.items()})
    return d.withColumns({"fair_strong": F.col(price) * F.exp(-F.col("ect_hi")), "fair_weak": F.col(price) * F.exp(-F.col("ect_lo"))})


def probability_positive(draws: str, mid: Column, shift: Column, scale: Column) -> Column:
    """Share of draws above zero after the calibration map mid + shift + scale (draw - mid)."""
    mapped = F.transform(draws, lambda g: mid + shift + scale * (g - mid))
    return F.size(F.filter(mapped, lambda g: g > 0)) / F.size(draws)


Z80 = 2 * 1.2816     # width of a 10-90 band in standard deviations (fixed value)


def inverse_variance_weight(a: str, b: str) -> Column:
    """Weight on the first component from both bands' widths; NULL where not finite (a column)."""
    var = lambda c: F.pow((F.col(f"{c}_hi") - F.col(f"{c}_lo")) / Z80, 2)
    w = (ratio(F.lit(1.0), var(a))) / (ratio(F.lit(1.0), var(a)) + ratio(F.lit(1.0), var(b)))
    return F.when(~F.isnan(w), w)


def what_if(latest: DataFrame, grid: DataFrame, response_col: str = "response") -> DataFrame:
    """Gap and composite of the latest row under every combination of alternative inputs.

    ``grid`` (balance_shift, norm_shift, price_pct) is a settings table."""
    d = latest.crossJoin(F.broadcast(grid))
    gap = -(F.col("underlying") + F.col("balance_shift") - F.col("norm_central") - F.col("norm_shift")) / F.col(response_col)
    d = d.withColumn("scenario_gap", gap).withColumn("scenario_fair", F.col("price") * (1 + F.col("price_pct") / 100) / (1 + F.col("scenario_gap") / 100))
    return d


def combine_draws(df: DataFrame, a: str, b: str, weights: str, picks: str) -> Column:
    """One array of composite draws: draw i mixes a[i] and b[i] with weights[picks[i]]."""
    w = F.transform(picks, lambda j: F.get(F.col(weights), j))
    mixed = F.zip_with(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), w, lambda z, w: w * z["a"] + (1 - w) * z["b"])
    return mixed


def performance_weight(errors: DataFrame, months: DataFrame, keys: Keys, at_least: int) -> DataFrame:
    """Weight on component a from both components' mean squared errors known by each month;
    one half until both have ``at_least`` errors.

    ``errors`` is (keys, known_month, component, se): several rows per month are fine."""
    w = past(keys, "known_month")
    m = errors.groupBy(*keys, "known_month").agg(*[agg(F.when(F.col("component") == c, F.col("se"))).alias(f"_{n}_{c}")
                                                   for c in ("a", "b") for n, agg in (("s", F.sum), ("n", F.count))])
    run = m.select(*keys, "known_month", *[F.sum(f"_{n}_{c}").over(w).alias(f"{n}_{c}") for c in ("a", "b") for n in ("s", "n")])
    d = asof(months.withColumn("_at", F.col("ref_month")), run, keys, "_at", "known_month", ["s_a", "s_b", "n_a", "n_b"])
    ia, ib = F.col("n_a") / F.col("s_a"), F.col("n_b") / F.col("s_b")
    enough = (F.col("n_a") >= at_least) & (F.col("n_b") >= at_least)
    return d.withColumn("weight", F.when(enough, ia / (ia + ib)).otherwise(0.5)).drop("_at", "fact_time", "s_a", "s_b", "n_a", "n_b")
