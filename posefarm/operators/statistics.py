"""Paired statistics between conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posefarm.functions.columns import log_gamma, mix2, two_sided_normal_p
from posefarm.functions.ordering import order_values, with_one, with_order
from posefarm.session import cut


def pair_conditions(metrics: DataFrame, a: str, b: str, value: str, success: str | None = None,
                    key: str = "complex_id") -> DataFrame:
    """Complexes present in both conditions: values a and b, difference d = b - a, flags.

    Rows where either value is NULL or NaN are kept with ``dropped`` set, so they
    can be counted before they are left out.
    """
    cols = [key, F.col(value).alias("v"), *([F.col(success).alias("s")] if success else [])]
    left = metrics.filter(F.col("condition") == a).select(*cols).withColumnsRenamed({"v": "a", "s": "a_ok"})
    right = metrics.filter(F.col("condition") == b).select(*cols).withColumnsRenamed({"v": "b", "s": "b_ok"})
    j = left.join(right, key)
    bad = F.col("a").isNull() | F.col("b").isNull() | F.isnan("a") | F.isnan("b")
    return j.withColumn("d", F.col("b") - F.col("a")).withColumn("dropped", bad)


def binomial_two_sided(less: Column, n: Column) -> Column:
    """min(1, 2 P(X <= less)) for X ~ Binomial(n, 1/2), less <= n/2.

    The terms fall off from the largest one; the sum goes down from it until what
    is left is far below double precision.
    """
    k = less.cast("double")
    total = n.cast("double")
    lead = log_gamma(total + 1) - log_gamma(k + 1) - log_gamma(total - k + 1) - total * F.log(F.lit(2.0))
    steps = F.least(less, F.ceil(F.lit(10.0) * F.sqrt(total) + 100)).cast("int")
    walk = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda s, i: F.struct((s["sum"] + s["term"]).alias("sum"),
                              (s["term"] * (k - i) / (total - k + i + 1)).alias("term")),
        lambda s: s["sum"],
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2.0 * F.exp(lead) * walk))


def mcnemar_exact(pairs: DataFrame, a: str = "a_ok", b: str = "b_ok", keys: Sequence[str] = ()) -> DataFrame:
    """Discordant counts (b01 gained, b10 lost) and the exact two-sided p value."""
    counts = pairs.groupBy(*keys).agg(
        F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("b01"),
        F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("b10"))
    return counts.withColumn("p", binomial_two_sided(F.least("b01", "b10"), F.col("b01") + F.col("b10")))


def wilcoxon_signed_rank(pairs: DataFrame, d: str = "d", keys: Sequence[str] = (), min_n: int = 6,
                         empty_p: float | None = None) -> DataFrame:
    """Signed-rank test with midranks, no tie correction of the variance.

    Zero differences are dropped.  Below ``min_n`` pairs z and p are NULL; with
    ``empty_p`` set, no pairs at all gives that p instead.
    """
    keys = list(keys)
    rows = pairs.select(*keys, F.col(d).alias("_d"))
    alive = rows.filter(F.col("_d").isNotNull() & (F.col("_d") != 0))
    sizes = alive.groupBy(*keys, F.abs("_d").alias("_m")).agg(
        F.count_if(F.col("_d") > 0).alias("_up"), F.count(F.lit(1)).alias("_n"))
    order = with_order(sizes, keys, "_m", rank=None, running={"_upto": "_n"})
    mid = F.col("_upto") - (F.col("_n") - 1) / 2.0
    out = order.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.sum(mid * F.col("_up")).alias("w_plus"),
        F.sum(mid * (F.col("_n") - F.col("_up"))).alias("w_minus"))
    n = F.col("n").cast("double")
    w = F.least("w_plus", "w_minus")
    mu = n * (n + 1) / 4.0
    sigma = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0)
    z = F.when(F.col("n") >= min_n, (F.abs(w - mu) - 0.5) / sigma)
    out = out.withColumn("w", w).withColumn("z", z).withColumn(
        "p", F.when(F.col("z") < 0, 1.0).otherwise(two_sided_normal_p(F.col("z"))))
    if empty_p is not None:
        out = out.withColumn("p", F.when(F.col("n") == 0, float(empty_p)).otherwise(F.col("p")))
    return out


def paired_t(pairs: DataFrame, d: str = "d", keys: Sequence[str] = ()) -> DataFrame:
    """t of the mean difference (NULL below three pairs); p from the normal approximation."""
    s = pairs.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.var_samp(d).alias("_var"))
    t = F.when((F.col("n") >= 3) & (F.col("_var") > 0), F.col("mean") / F.sqrt(F.col("_var") / F.col("n")))
    return s.withColumn("t", t).withColumn("p", two_sided_normal_p(F.col("t"))).drop("_var")


def _resampled(values: DataFrame, columns: Sequence[str], n_boot: int, seed: int, key: str) -> DataFrame:
    """Mean of each column in every resample of the same size.

    Values get a position by key; every (resample, draw) picks a position by hash
    and meets its value in an equi-join.  Both sides spread over positions.
    """
    # One row per complex: written once, since three branches read it.
    numbered = cut(with_order(values.select(key, *columns), [], key, rank="_pos"))
    fan = with_one(numbered.select("_pos"), numbered.agg(F.count(F.lit(1)).alias("_n"))).select(
        "_pos", "_n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("boot"))
    draw = F.pmod(mix2(F.col("boot"), F.col("_pos"), seed), F.col("_n")) + 1
    picks = fan.select("boot", draw.alias("_pos"))
    # Equal picks of a resample collapse to a count before they travel.
    counted = picks.groupBy("boot", "_pos").agg(F.count(F.lit(1)).alias("_c"))
    j = counted.join(numbered.select("_pos", *columns), "_pos")
    return cut(j.groupBy("boot").agg(*[(F.sum(F.col("_c") * F.col(c)) / F.sum("_c")).alias(c) for c in columns]))


def bootstrap_means(pairs: DataFrame, d: str = "d", n_boot: int = 1000, seed: int = 0, key: str = "complex_id") -> DataFrame:
    return _resampled(pairs.filter(F.col(d).isNotNull()), [d], n_boot, seed, key)


def percentile_interval(boots: DataFrame, column: str, n_boot: int) -> DataFrame:
    """Order statistics at int(.025 B) and int(.975 B) of the resampled means."""
    places = {"low": F.lit(int(0.025 * n_boot) + 1), "high": F.lit(int(0.975 * n_boot) + 1)}
    return order_values(boots, [], column, places).drop("n")


def bootstrap_ci(pairs: DataFrame, d: str = "d", n_boot: int = 1000, seed: int = 0, key: str = "complex_id") -> DataFrame:
    """Percentile interval of the mean difference over seeded resamples."""
    return percentile_interval(bootstrap_means(pairs, d, n_boot, seed, key), d, n_boot)


def interaction_cells(decoys: DataFrame, value: str = "value", key: str = "id") -> DataFrame:
    """One row per system with all four cells and the contrast.

    ``decoys``: id, method (base or test), setting (apo or holo), value.
    """
    cell = F.concat_ws("_", "method", "setting")
    wide = decoys.withColumn("_cell", cell).groupBy(key).pivot(
        "_cell", ["base_apo", "base_holo", "test_apo", "test_holo"]).agg(F.max(value)).dropna()
    gain_apo, gain_holo = F.col("test_apo") - F.col("base_apo"), F.col("test_holo") - F.col("base_holo")
    return wide.withColumn("contrast", gain_apo - gain_holo)


def interaction_contrast(decoys: DataFrame, value: str = "value", key: str = "id", n_boot: int = 1000,
                         seed: int = 0) -> DataFrame:
    """Mean contrast, its interval, P(contrast < 0), wins and losses per setting."""
    cells = interaction_cells(decoys, value, key)
    boots = _resampled(cells, ["contrast"], n_boot, seed, key)
    stats = cells.agg(
        F.count(F.lit(1)).alias("n"), F.avg("contrast").alias("contrast"),
        *[F.count_if(F.col(f"test_{s}") > F.col(f"base_{s}")).alias(f"won_{s}") for s in ("apo", "holo")],
        *[F.count_if(F.col(f"test_{s}") < F.col(f"base_{s}")).alias(f"lost_{s}") for s in ("apo", "holo")],
    )
    below = boots.agg(F.avg((F.col("contrast") < 0).cast("int")).alias("p_negative"))
    return with_one(with_one(stats, below), percentile_interval(boots, "contrast", n_boot))


def holm_adjust(tests: DataFrame, p: str = "p", tie: str = "id", monotone: bool = False) -> DataFrame:
    """p * (m - rank) capped at one, rank from 0; ``monotone`` adds the running maximum.

    The table holds one row per test of a family.
    """
    ordered = with_order(tests, [], p, tie, rank="_rank")
    out = with_one(ordered, tests.agg(F.count(F.lit(1)).alias("_m"))).withColumn("p_adj", F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_rank") + 1)))
    if monotone:
        from pyspark.sql import Window
        upto = Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("p_adj", F.max("p_adj").over(upto))
    return out.drop("_rank", "_m")


def seed_summary(runs: DataFrame, keys: Sequence[str] = ("condition",), worst: bool = True) -> DataFrame:
    """Mean and sample deviation over seeds, the worst (largest) or best p, mean wins and losses."""
    pick = F.max if worst else F.min
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seeds"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        pick("p").alias("p"), F.avg("won").alias("won"), F.avg("lost").alias("lost"))


def factor_table(runs: DataFrame, first: str, second: str, value: str = "value") -> DataFrame:
    """Two-factor table with margins; a margin row has NULL in the factor it spans."""
    return runs.cube(first, second).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def pool_invariance(old: DataFrame, new: DataFrame, features: Sequence[str], score: str, key: Sequence[str],
                    positive: Column | None = None) -> DataFrame:
    """Per complex: do two pools hold the same rows, features, top pose, order and AUC?"""
    from posefarm.operators.ranking import auc_midrank

    pos = (F.col("dockq") >= 0.23) if positive is None else positive
    cols = ["complex_id", *key, *features, score, "dockq", "prov"]
    l = old.select(*cols).withColumnsRenamed({c: f"l_{c}" for c in cols if c not in ("complex_id", *key)})
    r = new.select(*cols).withColumnsRenamed({c: f"r_{c}" for c in cols if c not in ("complex_id", *key)})
    j = l.withColumn("_l", F.lit(1)).join(r.withColumn("_r", F.lit(1)), ["complex_id", *key], "full")
    gap = F.greatest(*[F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")) for c in features], F.lit(0.0))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    rows = j.groupBy("complex_id").agg(
        F.count("_l").alias("n_old"), F.count("_r").alias("n_new"), F.count_if(both).alias("shared"),
        F.max(F.when(both, gap)).alias("max_gap"), F.count_if(both & (gap == 0)).alias("identical"),
        F.count_if(F.col("l_dockq") >= 0.23).alias("pos_old"), F.count_if(F.col("r_dockq") >= 0.23).alias("pos_new"),
        F.count_if((F.col("r_dockq") >= 0.23) & (F.col("r_prov") == 0)).alias("pos_new_searched"),
        F.max_by(F.struct(*[f"{k}" for k in key]), F.struct(f"l_{score}", *[-F.col(k) for k in key])).alias("_tl"),
        F.max_by(F.struct(*[f"{k}" for k in key]), F.struct(f"r_{score}", *[-F.col(k) for k in key])).alias("_tr"))
    ro = with_order(old.select("complex_id", *key, score), ["complex_id"], score, list(key), descending=True, rank="_ro")
    rn = with_order(new.select("complex_id", *key, score), ["complex_id"], score, list(key), descending=True, rank="_rn")
    moved = ro.drop(score).join(rn.drop(score), ["complex_id", *key]).groupBy("complex_id").agg(
        F.count_if(F.col("_ro") != F.col("_rn")).alias("moved"))
    ao = auc_midrank(old, score, pos, name="auc_old")
    an = auc_midrank(new, score, pos, name="auc_new")
    out = rows.join(moved, "complex_id").join(ao, "complex_id").join(an, "complex_id")
    return out.withColumn("same_top", (F.col("_tl") == F.col("_tr")).cast("int")).drop("_tl", "_tr")
