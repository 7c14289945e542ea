"""Statistics of experiment tables (arm, seed, metrics): summaries, paired tests, effects."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions.pvalues import p_f, p_normal, p_t
from sitewise.functions.scalars import hash_hex, hash_uniform
from sitewise.operators.joins import salted_join
from sitewise.operators.ordered import exact_quantiles, midranks, running_totals


def summarise(runs: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample SD of every metric and the number of runs, per arm."""
    aggs = [a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"))]
    return runs.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("n_runs"))


def paired_by_seed(runs: DataFrame, arm: str, ref: str, metric: str, seed: str = "seed") -> DataFrame:
    """Every arm against a reference arm over the shared seeds.

    Mean and SD of the differences, paired t, wins, and the Bonferroni level; SD
    and t are null where the arms agree on every seed.
    """
    one = runs.groupBy(arm, seed).agg(F.avg(metric).alias("v"))
    base = one.where(F.col(arm) == ref).select(seed, F.col("v").alias("_ref"))
    d = F.col("v") - F.col("_ref")
    g = (one.where(F.col(arm) != ref).join(base, seed).groupBy(arm).agg(
        F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_sd"), F.max(F.abs(d)).alias("_far"),
        F.sum((d > 0).cast("long")).alias("wins"), F.count(d).alias("n")))
    differs = F.col("_far") > 1e-8
    n_tests = g.agg(F.count(F.lit(1)).alias("k")).scalar()
    return g.select(arm, F.lit(ref).alias("vs"), "mean_diff", F.when(differs, F.col("_sd")).alias("sd_diff"),
                    F.when(differs, F.try_divide(F.col("mean_diff"), F.col("_sd") / F.sqrt("n"))).alias("t"),
                    "wins", "n", (F.lit(0.05) / F.greatest(n_tests, F.lit(1))).alias("bonferroni_alpha"))


def with_paired_p(paired: DataFrame) -> DataFrame:
    p = p_t(F.col("t"), (F.col("n") - 1).cast("double"))
    return (paired.withColumn("paired_p", p)
            .withColumn("sig_uncorrected", F.coalesce(F.col("paired_p") < 0.05, F.lit(False)))
            .withColumn("sig_bonferroni", F.coalesce(F.col("paired_p") < F.col("bonferroni_alpha"), F.lit(False))))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with average ranks for ties, per group: n, rho and its t value."""
    by = list(by)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    # merged to distinct pairs; a value shared by very many pairs is spread by the other one
    pairs = rows.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("c"))
    # ranks average (n + 1) / 2; centred at once, in floating point, so that no sum grows with the cube of n
    centred = F.col("rank") - (F.col("n_total") + F.lit(1.0)) / 2.0
    rx = midranks(rows, x, by).select(*by, x, centred.alias("_rx"))
    ry = midranks(rows, y, by).select(*by, y, centred.alias("_ry"))
    r = salted_join(salted_join(pairs, rx, [*by, x], [y], measure=rows), ry, [*by, y], [x], measure=rows)
    c, a, b = F.col("c"), F.col("_rx"), F.col("_ry")
    n_of = r.groupBy(*by).agg(F.sum(c).alias("n"), F.sum(c * a * a).alias("aa"), F.sum(c * b * b).alias("bb"),
                              F.sum(c * a * b).alias("ab"))
    rho = F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb"))
    out = n_of.select(*by, "n", rho.alias("rho"))
    return out.withColumn("t", F.try_divide(F.col("rho") * F.sqrt(F.col("n") - 2.0),
                                            F.sqrt(1.0 - F.col("rho") * F.col("rho"))))


def spearman_p(corr: DataFrame) -> DataFrame:
    return corr.withColumn("p_value", p_t(F.col("t"), (F.col("n") - 2).cast("double")))


def anova(df: DataFrame, category: str | Sequence[str], metric: str) -> DataFrame:
    """One-way ANOVA F with its degrees of freedom, and eta squared, for one category column or several at once.

    Groups of fewer than two rows count for the grand mean and total only. Several columns are unfolded to
    (parameter, level) and read in one pass; levels are compared as text.
    """
    categories = [category] if isinstance(category, str) else list(category)
    levels = F.array(*[F.struct(F.lit(c).alias("parameter"), F.col(c).cast("string").alias("_level")) for c in categories])
    g = (df.select(metric, F.inline(levels)).where(F.col("_level").isNotNull()).groupBy("parameter", "_level")
         .agg(F.count(metric).alias("n"), F.avg(metric).alias("m"), F.var_pop(metric).alias("v")))
    total = df.agg(F.struct(F.avg(metric).alias("m"), F.count(metric).alias("n"),
                            F.var_pop(metric).alias("v")).alias("t")).scalar()
    big = F.col("n") >= 2
    n, m, v = F.col("n"), F.col("m"), F.col("v")
    s = (g.withColumn("_t", total).groupBy("parameter").agg(
        F.sum(F.when(big, n)).alias("nb"), F.sum(F.when(big, n * m)).alias("sm"),
        F.sum(F.when(big, n * m * m)).alias("smm"), F.sum(F.when(big, n * v)).alias("ssw"),
        F.count(F.when(big, 1)).alias("k"),
        F.sum(F.when(big, n * (m - F.col("_t.m")) * (m - F.col("_t.m")))).alias("ssb_grand"),
        F.max(F.col("_t.n") * F.col("_t.v")).alias("sst"), F.max("m").alias("hi"), F.min("m").alias("lo"),
        F.max_by("_level", F.struct("m", "_level")).alias("best_level")))
    k, nb = F.col("k"), F.col("nb")
    ssb = F.col("smm") - F.col("sm") * F.col("sm") / nb
    enough = k >= 2
    f = F.try_divide(ssb / (k - 1), F.col("ssw") / (nb - k))
    # a column without a level has its row too
    every = df.sparkSession.createDataFrame([(c,) for c in categories], "parameter string")
    return F.broadcast(every).join(s, "parameter", "left").select(
        "parameter", F.when(enough, f).alias("f_value"),
        F.when(enough, k - 1).alias("df1"), F.when(enough, nb - k).alias("df2"),
        F.when(enough, F.try_divide(F.col("ssb_grand"), F.col("sst"))).alias("eta_squared"),
        "best_level", (F.col("hi") - F.col("lo")).alias("spread_of_means"))


def anova_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", p_f("f_value", F.col("df1").cast("double"), F.col("df2").cast("double")))


def parameter_effects(df: DataFrame, categories: Sequence[str], numerics: Sequence[str], metric: str) -> DataFrame:
    """Share of the score's variance each choice explains: eta squared for categories,
    squared rank correlation with the log for positive numbers; largest first."""
    out = anova(df, categories, metric).select("parameter", "eta_squared", "best_level", "spread_of_means") if categories else None
    if numerics:
        # all numbers in one pass: a row for each (parameter, value)
        logs = F.array(*[F.struct(F.lit(f"{c} (log)").alias("parameter"), F.when(F.col(c) > 0, F.log(c)).alias("_log")) for c in numerics])
        every = df.sparkSession.createDataFrame([(f"{c} (log)",) for c in numerics], "parameter string")
        rho = spearman(df.select(metric, F.inline(logs)), "_log", metric, ["parameter"])
        part = F.broadcast(every).join(rho, "parameter", "left").select(
            "parameter", (F.col("rho") * F.col("rho")).alias("eta_squared"),
            F.lit(None).cast("string").alias("best_level"), F.lit(None).cast("double").alias("spread_of_means"))
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.desc_nulls_last("eta_squared"), "parameter")


def _pairs(stats: DataFrame, arm: str, fields: Sequence[str]) -> DataFrame:
    """All unordered pairs (a, b) of arm summaries, a before b.

    Arms fall into chunks by hash; every pair of chunks is a join key, so the pairs spread over the session's
    shuffle width and an arm is copied once per chunk.
    """
    chunks = max(2, math.isqrt(2 * int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    row = F.struct(F.col(arm).alias("arm"), *fields)
    parts = (stats.select(row.alias("_r"), F.pmod(F.xxhash64(arm), F.lit(chunks)).cast("int").alias("_c"))
             .withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))))
    keys = [F.least("_c", "_x").alias("_i"), F.greatest("_c", "_x").alias("_j")]
    left = parts.select(*keys, F.col("_c").alias("_ca"), F.col("_r").alias("a"))
    right = parts.select(*keys, F.col("_c").alias("_cb"), F.col("_r").alias("b"))
    here = (F.least("_ca", "_cb") == F.col("_i")) & (F.greatest("_ca", "_cb") == F.col("_j"))
    return left.join(right, ["_i", "_j"]).where(here & (F.col("a.arm") < F.col("b.arm"))).select("a", "b")


def welch_pairs(df: DataFrame, arm: str, metric: str) -> DataFrame:
    """Welch t, its df and Cohen's d (pooled population variance) for every pair of arms."""
    g = df.groupBy(arm).agg(F.count(metric).alias("n"), F.avg(metric).alias("m"), F.var_samp(metric).alias("v"),
                            F.var_pop(metric).alias("vp"))
    pr = _pairs(g, arm, ["n", "m", "v", "vp"])
    sa, sb = F.col("a.v") / F.col("a.n"), F.col("b.v") / F.col("b.n")
    diff = F.col("a.m") - F.col("b.m")
    n_pairs = pr.agg(F.count(F.lit(1)).alias("k")).scalar()
    pooled = F.sqrt((F.col("a.vp") + F.col("b.vp")) / 2.0)
    return pr.select(
        F.col("a.arm").alias("arm_a"), F.col("b.arm").alias("arm_b"), diff.alias("diff"),
        F.try_divide(diff, F.sqrt(sa + sb)).alias("t"),
        F.try_divide((sa + sb) * (sa + sb), sa * sa / (F.col("a.n") - 1) + sb * sb / (F.col("b.n") - 1)).alias("df"),
        F.when(pooled > 0, diff / pooled).otherwise(0.0).alias("cohens_d"),
        (F.lit(0.05) / F.greatest(n_pairs, F.lit(1))).alias("bonferroni_alpha"))


def welch_pairs_p(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("p_value", p_t("t", "df")).withColumn(
        "sig_bonferroni", F.col("p_value") < F.col("bonferroni_alpha"))


def mann_whitney(df: DataFrame, first: Column, value: str) -> DataFrame:
    """U of the first group and z (ties corrected, continuity corrected)."""
    rows = df.withColumn("_a", first.cast("int"))
    c = running_totals(rows, value, {"a": F.col("_a"), "b": 1 - F.col("_a")})
    t = (F.col("a") + F.col("b")).cast("double")
    s = c.agg(F.sum(F.col("a") * (F.col("b_before") + F.col("b") / 2.0)).alias("u"),
              F.sum(t * t * t - t).alias("ties"), F.max("a_total").alias("na"), F.max("b_total").alias("nb"))
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    n = na + nb
    sd = F.sqrt(na * nb / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    far = F.greatest(F.col("u"), na * nb - F.col("u"))
    return s.select("na", "nb", "u", F.try_divide(far - na * nb / 2.0 - 0.5, sd).alias("z"))


def mann_whitney_p(test: DataFrame) -> DataFrame:
    return test.withColumn("p_value", F.when(F.col("z") < 0, 1.0).otherwise(p_normal("z")))


def capacity_trend(runs: DataFrame, level: str, size: str, metrics: Sequence[str]) -> DataFrame:
    """Model size per level, mean, SD and 95 % half-width of each metric, smallest first."""
    aggs = [F.min(size).alias(size)]
    for m in metrics:
        sd = F.stddev_samp(m)
        aggs += [F.avg(m).alias(m), sd.alias(f"{m}_sd"), (1.96 * sd / F.sqrt(F.count(m))).alias(f"{m}_ci")]
    return runs.groupBy(level).agg(*aggs).orderBy(size, level)


def control_comparison(runs: DataFrame, partition: str, size: str, gain: str) -> DataFrame:
    """Per partition scheme: rank correlation of size and gain, gain at both ends, wins."""
    per_size = runs.groupBy(partition, size).agg(F.avg(gain).alias("_g"))
    ends = per_size.groupBy(partition).agg(F.min_by("_g", size).alias("gain_lowest"),
                                           F.max_by("_g", size).alias("gain_highest"))
    base = runs.groupBy(partition).agg(F.count(F.lit(1)).alias("n_runs"), F.avg(gain).alias("mean_gain"),
                                       F.sum((F.col(gain) > 0).cast("long")).alias("wins"))
    rho = spearman(runs, size, gain, [partition]).select(partition, F.col("rho").alias("rho_gain"))
    return base.join(ends, partition).join(rho, partition)


def control_verdict(runs: DataFrame, partition: str, test: str, control: str, size: str, gain: str) -> DataFrame:
    """Rank correlation of size and gain in two partition schemes, with p, and whether the control weakens it."""
    rho = spearman_p(spearman(runs.where(F.col(partition).isin(test, control)), size, gain, [partition]))

    def of(scheme: str, column: str) -> Column:
        return F.max(F.when(F.col(partition) == scheme, F.col(column)))

    both = rho.agg(of(test, "rho").alias("rho_test"), of(test, "p_value").alias("p_test"),
                   of(control, "rho").alias("rho_control"), of(control, "p_value").alias("p_control"))
    return both.withColumn("weakened", weakened(F.col("rho_test"), F.col("rho_control"), F.col("p_control")))


def weakened(rho_test: Column, rho_control: Column, p_control: Column) -> Column:
    """The relation is weaker in the control: clearly smaller rho, or no longer detectable."""
    return (F.abs(rho_control) < F.abs(rho_test) * 0.6) | (p_control > 0.05)


def generalisation_gap(runs: DataFrame, inside: str, outside: str, rescaled: str, scope: str = "scope",
                       metric: str = "auroc") -> DataFrame:
    """Loss on new data, loss after rescaling it with its own statistics, share recovered."""
    def mean(s: str) -> Column:
        return F.avg(F.when(F.col(scope) == s, F.col(metric)))

    g = runs.agg(mean(inside).alias("i"), mean(outside).alias("o"), mean(rescaled).alias("r"))
    raw, own = F.col("i") - F.col("o"), F.col("i") - F.col("r")
    return g.select(raw.alias("gap_raw"), own.alias("gap_rescaled"), (raw - own).alias("recovered"),
                    ((raw - own) / F.greatest(raw, F.lit(1e-9))).alias("recovered_share"))


def federation_gain(clients: DataFrame, pooled: DataFrame, metric: str = "auprc") -> DataFrame:
    """Per seed: mean client gain of federated over local, and the gap to pooled.

    clients: seed, client, mode ('federated' | 'local'), metric; pooled: seed,
    mode ('federated' | 'pooled'), metric. Clients that lack a mode do not count.
    """
    def side(df: DataFrame, keys: list[str], mode: str) -> DataFrame:
        return df.where(F.col("mode") == mode).select(*keys, F.col(metric).alias(mode))

    k = ["seed", "client"]
    gain = side(clients, k, "federated").join(side(clients, k, "local"), k).groupBy("seed").agg(
        F.avg(F.col("federated") - F.col("local")).alias("fl_gain"), F.count(F.lit(1)).alias("n_clients"),
        F.sum((F.col("federated") > F.col("local")).cast("long")).alias("wins"))
    gap = side(pooled, ["seed"], "federated").join(side(pooled, ["seed"], "pooled"), "seed").select(
        "seed", (F.col("pooled") - F.col("federated")).alias("gap_to_pooled"))
    return gain.join(gap, "seed")


def federated_vs_local(results: DataFrame, metric: str = "auprc") -> DataFrame:
    """Scope by scope: federated beside local-only; scopes without both are left out."""
    fed = results.where(F.col("method") == "federated").select("scope", F.col(metric).alias("federated"))
    loc = results.where(F.col("method") == "local").select("scope", F.col(metric).alias("local_only"))
    return fed.join(loc, "scope").withColumn("diff", F.col("federated") - F.col("local_only"))


def with_tests(results: DataFrame, tests: DataFrame, arm: str = "arm") -> DataFrame:
    """Results with their paired tests; arms without a test (the reference) keep nulls."""
    return results.join(tests, arm, "left")


def score_overview(configs: DataFrame, metric: str, rounds: str) -> DataFrame:
    """Best, median, worst, quartiles and spread of a search; share of runs at the round cap."""
    q = exact_quantiles(configs, metric, {"q25": .25, "median": .5, "q75": .75})
    cap = configs.agg(F.max(rounds).alias("c")).scalar()
    ends = configs.withColumn("_cap", cap).agg(
        F.count(F.lit(1)).alias("n"), F.max(metric).alias("best"), F.min(metric).alias("worst"),
        F.max(rounds).alias("cap"), F.sum((F.col(rounds) >= F.col("_cap")).cast("long")).alias("n_at_cap"))
    row = q.select(F.struct("q25", "median", "q75").alias("q")).scalar()
    return (ends.withColumn("_q", row).select(
        "n", "best", F.col("_q.median").alias("median"), "worst", F.col("_q.q25").alias("q25"),
        F.col("_q.q75").alias("q75"), (F.col("best") - F.col("_q.median")).alias("best_minus_median"),
        "cap", "n_at_cap", (F.col("n_at_cap") > F.col("n") * 0.2).cast("int").alias("cap_binding")))


def top_configs(configs: DataFrame, metric: str, key: str, k: int = 10) -> DataFrame:
    return configs.orderBy(F.desc(metric), key).limit(k)


def robust_rank(runs: DataFrame, config: str, metric: str) -> DataFrame:
    """Configurations by mean minus one population SD over seeds, best first."""
    g = runs.groupBy(config).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("sd"),
                                 F.count(metric).alias("n"))
    return g.withColumn("score", F.col("mean") - F.col("sd")).orderBy(F.desc("score"), config)


def stability_rank(runs: DataFrame, arm: str, metric: str) -> DataFrame:
    """Arms from least to most sensitive to everything else (population SD)."""
    return runs.groupBy(arm).agg(F.stddev_pop(metric).alias("sd"), F.avg(metric).alias("mean")).orderBy("sd", arm)


def sample_configs(ids: DataFrame, key: str, space: Mapping[str, tuple], seed: int = 42,
                   pinned: Mapping[str, tuple[str, str, float]] | None = None) -> DataFrame:
    """One random configuration per id.

    ``space``: name -> ('log', lo, hi) for a log-uniform draw or ('choice', values).
    ``pinned``: name -> (other name, value, default): the knob keeps its draw only
    where the other one has that value. Draws are hashes of (seed, name, id).
    """
    out = ids.select(key)
    for name, spec in space.items():
        u = hash_uniform(f"{seed}-{name}", key)
        if spec[0] == "log":
            lo, hi = math.log(spec[1]), math.log(spec[2])
            value = F.exp(F.lit(lo) + u * (hi - lo))
        else:
            options = F.array(*[F.lit(v) for v in spec[1]])
            value = F.get(options, F.floor(u * len(spec[1])).cast("int"))
        out = out.withColumn(name, value)
    for name, (other, needed, default) in (pinned or {}).items():
        out = out.withColumn(name, F.when(F.col(other) == needed, F.col(name)).otherwise(F.lit(default)))
    return out


def arm_seed_grid(arms: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """One job row per arm and seed."""
    return arms.distinct().withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))


# --- case lists ---------------------------------------------------------------------------

CASE_LISTS = ("highest", "lowest", "died", "survived", "correct", "missed", "false_alarm", "random")


def case_lists(pred: DataFrame, threshold: float, k: int = 40, seed: int = 0, key: str = "id", p: str = "p",
               y: str = "y") -> DataFrame:
    """Named lists of at most ``k`` cases each, highest risk first: (list, key, y, p).

    One scan: a row enters every list it fits, and each task keeps the best k of a list before the shuffle.
    """
    hit, pos, score = F.col(p) >= threshold, F.col(y) == 1, F.col(p).cast("double")
    always = F.lit(True)
    # (which rows, what comes first)
    rules = {"highest": (always, -score), "lowest": (always, score), "died": (pos, -score), "survived": (~pos, -score),
             "correct": (hit == pos, -score), "missed": (~hit & pos, -score), "false_alarm": (hit & ~pos, -score), "random": (always, F.lit(0.0))}
    entries = [F.when(rules[name][0], F.struct(F.lit(name).alias("list"), rules[name][1].alias("_o"))) for name in CASE_LISTS]
    rows = (pred.select(key, y, p, F.explode(F.array_compact(F.array(*entries))).alias("_e"))
            .select("_e.list", F.col("_e._o").alias("_o"), key, y, p)
            .withColumn("_h", F.when(F.col("list") == "random", hash_hex(seed, key))))
    best = Window.partitionBy("list").orderBy("_o", "_h", key)
    return rows.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= k).select("list", key, y, p)
