"""Agreement between raters and significance between systems, from group counts."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cowrie.functions.text import kappa_band


def cohen_kappa(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(n, observed, expected, kappa, band) of two raters' labels, one row per item; kappa is 1 where chance agreement
    is certain, null under two items. Rows with a null label do not count."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    rows = cells.groupBy(F.col("a").alias("label")).agg(F.sum("c").alias("ra"))
    cols = cells.groupBy(F.col("b").alias("label")).agg(F.sum("c").alias("cb"))
    total = cells.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("c"))), F.lit(0)).alias("same")).withColumn("one", F.lit(1))
    chance = rows.join(cols, "label").agg(F.coalesce(F.sum(F.col("ra") * F.col("cb")), F.lit(0)).alias("product")).withColumn("one", F.lit(1))
    out = total.join(chance, "one")
    po, pe = F.col("same") / F.col("n"), F.col("product") / (F.col("n") * F.col("n"))
    kappa = F.when(F.col("n") < 2, None).when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe))
    return out.select(F.col("n"), F.round(F.when(F.col("n") > 0, po), 6).alias("observed"), F.round(F.when(F.col("n") > 0, pe), 6).alias("expected"), F.round(kappa, 6).alias("kappa")).withColumn("band", kappa_band(F.col("kappa")))


def double_annotation_kappa(rows: DataFrame, item: str, slot: str, verdict: str, order: list[str]) -> DataFrame:
    """Cohen's kappa of the last verdicts of slots 1 and 2 on the items that have both."""
    last = F.struct(*[F.col(c) for c in order], F.col(verdict))
    both = rows.groupBy(item).agg(F.max_by(verdict, F.when(F.col(slot) == 1, last)).alias("a"), F.max_by(verdict, F.when(F.col(slot) == 2, last)).alias("b"))
    return cohen_kappa(both)


def fleiss_kappa(ratings: DataFrame, item: list[str], label: str) -> DataFrame:
    """(items, raters, observed, expected, kappa) for each number of ratings per item from two on; every item that is
    rated at least twice is in one row."""
    n = ratings.where(F.col(label).isNotNull()).groupBy(*item, label).agg(F.count("*").alias("c"))
    per = n.groupBy(*item).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("squares")).where("m > 1")
    shares = n.join(per.select(*item, "m"), item).groupBy("m", label).agg(F.sum("c").alias("c"))
    chance = shares.groupBy("m").agg((F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("pe"))
    seen = per.groupBy("m").agg(F.count("*").alias("items"), F.avg((F.col("squares") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).alias("po"))
    out = seen.join(chance, "m")
    return out.select("items", F.col("m").alias("raters"), F.round("po", 6).alias("observed"), F.round("pe", 6).alias("expected"), F.round(F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))


def krippendorff_ordinal(ratings: DataFrame, item: list[str], value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., items, alpha): ordinal Krippendorff alpha; missing ratings are allowed. The distance of two values is
    (values between them, ends counted half) squared, weighted by 1 / (ratings of the item - 1)."""
    by = by or []
    n = ratings.where(F.col(value).isNotNull()).groupBy(*by, *item, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    sizes = n.groupBy(*by, *item).agg(F.sum("c").alias("m")).where("m > 1")
    n = n.join(sizes, [*by, *item])
    w = Window.partitionBy(*by)
    margin = n.groupBy(*by, "v").agg(F.sum("c").alias("nv"))
    margin = margin.select(*by, "v", "nv", (F.sum("nv").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("nv") / 2).alias("mid"), F.sum("nv").over(w).alias("all"))
    # the distance of values is the squared difference of their mid ranks
    at = n.join(margin.select(*by, "v", "mid"), [*by, "v"])
    per = at.groupBy(*by, *item, "m").agg(F.sum(F.col("c") * F.col("mid") * F.col("mid")).alias("s2"), F.sum(F.col("c") * F.col("mid")).alias("s1"))
    # sum over ordered pairs of (x - y)^2 = 2 (m * s2 - s1^2)
    keys = by or ["one"]
    per, margin = (per, margin) if by else (per.withColumn("one", F.lit(1)), margin.withColumn("one", F.lit(1)))
    seen = per.groupBy(*keys).agg(F.count("*").alias("items"), F.sum(2 * (F.col("m") * F.col("s2") - F.col("s1") * F.col("s1")) / (F.col("m") - 1)).alias("apart"))
    exp = margin.groupBy(*keys).agg(F.max("all").alias("all"), F.sum(F.col("nv") * F.col("mid") * F.col("mid")).alias("s2"), F.sum(F.col("nv") * F.col("mid")).alias("s1"))
    both = seen.join(exp, keys)
    de = 2 * (F.col("all") * F.col("s2") - F.col("s1") * F.col("s1")) / (F.col("all") - 1)
    return both.select(*by, "items", F.round(F.when(de == 0, 1.0).otherwise(1 - F.col("apart") / de), 6).alias("alpha"))


def upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-15 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def friedman(scores: DataFrame, block: list[str], system: str, value: str, by: list[str]) -> DataFrame:
    """(by..., blocks, systems, chi2) of systems ranked within blocks, corrected for ties; a block counts if it has
    all systems. Needs three blocks and three systems, else chi2 is null. Scores of a block and system are averaged."""
    mean = scores.where(F.col(value).isNotNull()).groupBy(*by, *block, system).agg(F.avg(value).alias("v"))
    k = mean.groupBy(*by).agg(F.countDistinct(system).alias("k"))
    w = Window.partitionBy(*by, *block)
    ranked = mean.join(k, by).withColumn("here", F.count("*").over(w)).where("here = k")
    ties = Window.partitionBy(*by, *block, "v")
    ranked = ranked.withColumns({"low": F.rank().over(w.orderBy("v")), "t": F.count("*").over(ties)}).withColumn("r", F.col("low") + (F.col("t") - 1) / 2)
    sums = ranked.groupBy(*by, system).agg(F.sum("r").alias("rs")).groupBy(*by).agg(F.sum(F.col("rs") * F.col("rs")).alias("ss"))
    shape = ranked.groupBy(*by).agg((F.count("*") / F.max("k")).cast("long").alias("n"), F.max("k").alias("k"), F.sum(F.col("t") * F.col("t") - 1).alias("tied"))  # sum over rows of t^2 - 1 is sum over ties of t^3 - t
    both = shape.join(sums, by)
    raw = 12 / (F.col("n") * F.col("k") * (F.col("k") + 1)) * F.col("ss") - 3 * F.col("n") * (F.col("k") + 1)
    fix = 1 - F.col("tied") / (F.col("n") * F.col("k") * (F.col("k") * F.col("k") - 1))
    enough = (F.col("n") >= 3) & (F.col("k") >= 3) & (fix > 0)
    return both.select(*by, F.col("n").alias("blocks"), F.col("k").alias("systems"), F.round(F.when(enough, raw / fix), 4).alias("chi2"))


def with_p_value(df: DataFrame, chi2: str = "chi2", systems: str = "systems") -> DataFrame:
    """df with the upper tail of the chi-square distribution with systems - 1 degrees of freedom; df has a row per test."""

    def tail(parts):
        for pdf in parts:
            yield pdf.assign(p_value=[None if c is None or math.isnan(c) else round(upper_gamma((k - 1) / 2, c / 2), 6) for c, k in zip(pdf[chi2], pdf[systems], strict=True)])

    from pyspark.sql import types as T

    return df.mapInPandas(tail, T.StructType([*df.schema.fields, T.StructField("p_value", T.DoubleType())]))


def paired_points(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by..., n, mean_a, mean_b, diff, effect): effect is the mean difference over its sample deviation."""
    d = F.col(b) - F.col(a)
    out = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(d).alias("diff"), F.stddev_samp(d).alias("sd"))
    return out.select(*by, "n", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "diff")], F.round(F.when(F.col("sd") > 0, F.col("diff") / F.col("sd")).otherwise(0.0), 6).alias("effect"))


def resample_shares(sizes: np.ndarray, resamples: int, seed: list[int]) -> np.ndarray:
    """(resamples, blocks): how many of a resample's draws fall into each block of rows; every row is equally likely."""
    return np.random.default_rng(seed).multinomial(int(sizes.sum()), sizes / sizes.sum(), size=resamples)


def block_sums(diffs: np.ndarray, draws: np.ndarray, seed: list[int], chunk: int = 4_000_000) -> np.ndarray:
    """For each resample the sum of draws[k] rows of a block, drawn with replacement; chunked, so that memory does not
    grow with the rows."""
    rng, n, out = np.random.default_rng(seed), len(diffs), np.zeros(len(draws))
    step, at = max(1, chunk // max(1, int(draws.max(initial=1)))), 0
    while at < len(draws):
        some = draws[at : at + step]
        picked = diffs[rng.integers(0, n, size=int(some.sum()))]
        ends = np.cumsum(some)
        total = np.concatenate([[0.0], np.cumsum(picked)])
        out[at : at + step] = total[ends] - total[ends - some]
        at += step
    return out


def paired_bootstrap(pairs: DataFrame, by: str, key: str, a: str, b: str, resamples: int = 1000, level: float = 0.95, seed: int = 42, block: int = 200_000) -> DataFrame:
    """(by, n, diff, ci_low, ci_high, p_value, effect) of b - a for each group: percentile interval and doubled
    one-sided p of resampled means.

    A group's rows are resampled in hash blocks of about `block` rows, each in a task: how many draws of each resample
    fall into a block is drawn first, from one seed for all blocks, so together they are draws with replacement from the
    whole group, whatever its size. Only the sums of the resamples meet."""
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(by, F.col(key).cast("string").alias("_key"), (F.col(b) - F.col(a)).alias("d"))
    points = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg("d").alias("diff"), F.stddev_samp("d").alias("sd"))
    blocked = rows.join(points.select(by, F.ceil(F.col("n") / block).alias("_blocks")), by).withColumn("_block", F.pmod(F.xxhash64("_key"), F.col("_blocks")))
    sizes = blocked.groupBy(by, "_block").agg(F.count("*").alias("s")).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_block", "s"))).alias("_sizes"))  # n / block entries

    def drawn(pdf: pd.DataFrame) -> pd.DataFrame:
        name, mine, sizes = pdf[by].iloc[0], int(pdf["_block"].iloc[0]), pdf["_sizes"].iloc[0]
        at = [x["_block"] for x in sizes].index(mine)
        group = zlib.crc32(str(name).encode())
        draws = resample_shares(np.array([x["s"] for x in sizes], dtype=np.int64), resamples, [seed, group])[:, at]
        sums = block_sums(pdf.sort_values(["_key", "d"])["d"].to_numpy(float), draws, [seed, group, mine])
        return pd.DataFrame({by: name, "r": np.arange(resamples), "s": sums})

    kind = pairs.schema[by].dataType.simpleString()
    sums = blocked.join(sizes, by).groupBy(by, "_block").applyInPandas(drawn, f"{by} {kind}, r long, s double")
    means = sums.groupBy(by, "r").agg(F.sum("s").alias("s")).join(points.select(by, "n"), by).select(by, (F.col("s") / F.col("n")).alias("m"))
    tail = means.groupBy(by).agg(F.percentile("m", (1 - level) / 2).alias("ci_low"), F.percentile("m", (1 + level) / 2).alias("ci_high"), F.avg((F.col("m") <= 0).cast("int")).alias("le"), F.avg((F.col("m") >= 0).cast("int")).alias("ge"))
    p_value = F.least(F.lit(1.0), 2 * F.when(F.col("diff") >= 0, F.col("le")).otherwise(F.col("ge")))
    return points.join(tail, by).select(by, "n", F.round("diff", 6).alias("diff"), F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"), F.round(p_value, 6).alias("p_value"), F.round(F.when(F.col("sd") > 0, F.col("diff") / F.col("sd")).otherwise(0.0), 6).alias("effect"))
