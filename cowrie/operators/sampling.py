"""Samples, splits, blinding and mixtures. Every order is a hash of a seed and a stable key, never a generator's
state, so results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int | str, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def rank_by_hash(df: DataFrame, by: list[str], key: list[str], hashed: Column) -> DataFrame:
    """df with `rank` (from 1) in the order of hash and key, and `size` of each group.

    A group is ranked in 4,096 parts by the hash's first digits, which are counted first, so that a group which holds
    a third of all rows isn't sorted in one task."""
    groups = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(f"_g{i}") for i, c in enumerate(by)]
    names = [f"_g{i}" for i in range(len(by))]
    keyed = df.select("*", hashed.alias("_h"), *groups).withColumn("_b", F.substring("_h", 1, 3))
    counts = keyed.groupBy(*names, "_b").agg(F.count("*").alias("n"))
    over = Window.partitionBy(*names)
    counts = counts.select(*names, "_b", F.coalesce(F.sum("n").over(over.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("n").over(over).alias("size"))
    ranked = keyed.join(counts, [*names, "_b"]).withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy(*names, "_b").orderBy("_h", *key)))
    return ranked.drop("_h", "_b", "_before", *names)


def smallest_by_hash(df: DataFrame, key: str, k: int, seed: int | str) -> DataFrame:
    """The first k rows of all in hash order."""
    ranked = rank_by_hash(df.withColumn("_all", F.lit(1)), ["_all"], [key], hash_order(seed, F.col(key)))
    return ranked.where(F.col("rank") <= k).drop("rank", "size", "_all")


def stratified_sample(df: DataFrame, stratum: str, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Of each stratum the share, half rounded to even and at least one; all for a share of one or more."""
    if fraction >= 1:
        return df
    ranked = rank_by_hash(df, [stratum], [key], hash_order(seed, F.col(key)))
    return ranked.where(F.col("rank") <= F.greatest(F.lit(1), F.bround(F.col("size") * fraction).cast("long"))).drop("rank", "size")


def sample_at_least(df: DataFrame, stratum: str, key: str, least: int, seed: int = 42) -> DataFrame:
    """About `least` rows, spread over strata by their sizes (rounding may give a few less); all if there are fewer."""
    n = df.count()
    return df if n <= least else stratified_sample(df, stratum, key, least / n, seed)


def fixed_per_stratum(df: DataFrame, stratum: str, key: str, k: int, seed: int = 42) -> DataFrame:
    return rank_by_hash(df, [stratum], [key], hash_order(seed, F.col(key))).where(F.col("rank") <= k).drop("rank", "size")


def double_annotation(df: DataFrame, key: str, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """All rows for slot 1, and a hash-chosen share again for slot 2."""
    second = smallest_by_hash(df, key, int(round(df.count() * fraction)), seed)
    return df.withColumn("annotator_slot", F.lit(1)).unionByName(second.withColumn("annotator_slot", F.lit(2)))


def group_split(df: DataFrame, group: str, stratum: str, order: str, shares: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """(group, stratum, split): whole groups to train, val and test; within each stratum the first 80 % of groups in
    hash order, then 10 %, then the rest. A group's stratum is that of its first record."""
    if abs(sum(shares) - 1) > 1e-6:
        raise ValueError(f"shares add up to {sum(shares)}")
    groups = df.groupBy(group).agg(F.min_by(stratum, F.struct(order, stratum)).alias("stratum"))
    ranked = rank_by_hash(groups, ["stratum"], [group], hash_order(seed, F.col(group)))
    train = F.bround(F.col("size") * shares[0])
    split = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + F.bround(F.col("size") * shares[1]), "val").otherwise("test")
    return ranked.select(group, "stratum", split.alias("split"))


def torn_groups(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that lie in more than one split."""
    return df.groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


SLOTS = "ABCDEFGH"


def blinding_map(samples: DataFrame, systems: DataFrame, sample: str = "sample_id", system: str = "system_id", seed: int = 42) -> DataFrame:
    """(sample, slot, system): each sample's systems under letters in an order of its own. At most eight systems."""
    names = [r[0] for r in systems.select(system).distinct().limit(len(SLOTS) + 1).collect()]
    if len(names) > len(SLOTS):
        raise ValueError(f"more than {len(SLOTS)} systems")
    pairs = samples.select(sample).distinct().withColumn(system, F.explode(F.array(*map(F.lit, sorted(names)))))
    order = Window.partitionBy(sample).orderBy(hash_order(seed, F.col(sample), F.col(system)), F.col(system))
    return pairs.withColumn("slot", F.substring(F.lit(SLOTS), F.row_number().over(order), F.lit(1))).select(sample, "slot", system)


def blinded_items(key: DataFrame, generations: DataFrame, sample: str = "sample_id", system: str = "system_id", hypothesis: str = "hypothesis") -> DataFrame:
    """(sample, slot, hypothesis) without the system: each slot's text, looked up by sample and system; a slot whose
    system has no text keeps a null."""
    return key.join(generations.select(sample, system, hypothesis), [sample, system], "left").select(sample, "slot", hypothesis)


def rater_sheets(blinded: DataFrame, raters: int, sample: str = "sample_id", seed: int = 42) -> DataFrame:
    """(rater, position, sample, slot): the blinded items once for each rater in that rater's own order."""
    each = blinded.select(sample, "slot", F.explode(F.sequence(F.lit(1), F.lit(raters))).alias("rater"))
    order = F.md5(F.concat_ws("|", (F.col("rater") + seed).cast("string"), F.col(sample), F.col("slot")))
    return rank_by_hash(each, ["rater"], [sample, "slot"], order).select("rater", F.col("rank").alias("position"), sample, "slot")


def two_way_mix(own: DataFrame, other: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """A mixture in which `own` has the share `ratio`, as large as both sides allow without repeating a row."""
    if ratio <= 0 or ratio >= 1:
        return (other if ratio <= 0 else own).withColumn("side", F.lit("other" if ratio <= 0 else "own"))
    a, b = own.count(), other.count()
    total = min(a / ratio, b / (1 - ratio))
    out = None
    for df, k, side in ((own, round(total * ratio), "own"), (other, round(total * (1 - ratio)), "other")):
        taken = smallest_by_hash(df, key, k, seed).withColumn("side", F.lit(side))
        out = taken if out is None else out.unionByName(taken)
    return out
