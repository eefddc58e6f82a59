"""Problem 9: mixing sources to target weights.

Method: a multivariate-hypergeometric splitting tree. Each source's quota of tokens is cut into blocks of equal
size; the tree divides the vector of block counts between two halves of the output shards, drawing the left
half's counts from the multivariate hypergeometric distribution, down to one shard, so every shard gets exact
counts whose sum is the quota. Each source's blocks are permuted and handed out as disjoint runs, and the
records of a shard are shuffled locally.

Quota: share x total, at most max_repeat x what the source holds; total is the tokens of all records with a
source. A source repeats whole passes over its records before it starts the next one.

Scale: record positions within a source come from a two-level prefix sum over hash buckets, so a source that
holds a third of all rows is spread over all tasks; places within a shard are ranks in 4,096 hash parts, so no task sorts
a shard. The number of shards grows with the tokens (up to MOST_SHARDS); the tree and the block table hold at most
`blocks` rows, or eight per shard, plus one per source.

Defined results: records with a null source are in no mixture and not in the total; null and empty texts weigh
nothing and are in every pass of their source that is drawn at all; sources without a target are left out;
targets without records report zero and are not reachable; empty tables give a report of zeros.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cowrie.operators.sampling import hash_order, rank_by_hash
from cowrie.session import cut, partitions

from .tokens import count_tokens


LEAST_SHARDS, MOST_SHARDS, SHARD_TOKENS = 16, 4096, 100_000_000


def split_tree(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) block counts: rows as even in size as can be, columns summing to counts."""
    counts = np.asarray(counts, dtype=np.int64)
    out = np.zeros((shards, len(counts)), dtype=np.int64)

    def part(low: int, high: int, have: np.ndarray) -> None:
        if high - low == 1:
            out[low] = have
            return
        middle = (low + high) // 2
        size = int(have.sum()) * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(have, size, method="marginals") if size else np.zeros_like(have)
        part(low, middle, left)
        part(middle, high, have - left)

    part(0, shards, counts)
    return out


def deal_blocks(counts: np.ndarray, shards: int, seed: int) -> list[tuple[int, int, int]]:
    """(source index, block, shard): a permutation of each source's blocks dealt by the tree's counts."""
    tree = split_tree(counts, shards, seed)
    rows = []
    for s, n in enumerate(counts):
        order = np.random.default_rng([seed, 7, s]).permutation(int(n))
        shard = np.repeat(np.arange(shards), tree[:, s])
        rows += [(s, int(b), int(k)) for b, k in zip(order, shard, strict=True)]
    return rows


def quotas(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeat, own, total, wanted, quota, reachable), one row per target."""
    own = sized.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("own"))
    total = own.agg(F.sum("own")).first()[0] or 0
    goal = targets.where("source is not null").select("source", "target_share", "max_repeat").dropDuplicates(["source"])
    out = goal.join(own, "source", "left").withColumns({"own": F.coalesce("own", F.lit(0)), "total": F.lit(total)})
    wanted = F.coalesce(F.col("target_share"), F.lit(0.0)) * F.col("total")
    most = F.coalesce(F.col("max_repeat"), F.lit(0)) * F.col("own")
    return out.withColumns({"wanted": wanted, "quota": F.least(F.round(wanted).cast("long"), most.cast("long")), "reachable": wanted <= most})


class Mixture:
    """records: (shard, place, source, key, copy, tokens); report: one row per target source; shards: (shard, source,
    blocks, records, tokens), blocks as the tree dealt them."""

    def __init__(self, records: DataFrame, report: DataFrame, shards: DataFrame) -> None:
        self.records, self.report, self.shards = records, report, shards


def mix_sources(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int | None = None, blocks: int = 4096, seed: int = 42, path: str | None = None) -> Mixture:
    """Combine docs so that each source has its share of all tokens. targets: (source, target_share, max_repeat).
    shards: output shards, by default one for each SHARD_TOKENS tokens."""
    spark = docs.sparkSession
    counted = count_tokens(docs.withColumnRenamed(source, "_source") if source != "source" else docs, key, text, ["source" if source == "source" else "_source"], path)
    sized = cut(counted.toDF("key", "source", "tokens"), "sizes")
    plan = cut(quotas(sized, targets), "quotas")
    goals = plan.orderBy("source").collect()  # one row per target source, a configuration table
    tokens = sum(g["quota"] for g in goals)
    shards = shards or min(MOST_SHARDS, max(LEAST_SHARDS, -(-tokens // SHARD_TOKENS)))
    size = max(1, -(-tokens // max(blocks, 8 * shards)))  # tokens in a block
    counts = np.array([-(-g["quota"] // size) for g in goals], dtype=np.int64)
    dealt = deal_blocks(counts, shards, seed) if goals else []
    table = spark.createDataFrame([(goals[s]["source"], b, k) for s, b, k in dealt], "source string, block long, shard int")  # at most blocks + one per source

    # place of each record on its source's line of tokens, in hash order, by a two-level prefix sum
    n = partitions(sized, 64)
    wide = sized.join(plan.where("quota > 0").select("source", "own", "quota"), "source").withColumn("h", F.xxhash64(F.lit(seed), "key")).withColumn("bucket", F.pmod("h", F.lit(n)))
    sums = wide.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    offset = sums.withColumn("before", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    inner = Window.partitionBy("source", "bucket").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = wide.withColumn("within", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(offset, ["source", "bucket"]).withColumn("start", F.col("before") + F.col("within"))
    # pass c covers [c x own, (c + 1) x own) of the source's quota; a record is drawn if its middle is inside
    passes = F.ceil(F.col("quota") / F.col("own")).cast("int")
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), passes - 1))).withColumn("at", F.col("copy") * F.col("own") + F.col("start"))
    drawn = copies.where("at + tokens / 2 < quota").withColumn("block", F.least(F.floor(F.col("at") / size), F.floor((F.col("quota") - 1) / size)))
    dealt_records = cut(drawn.join(table, ["source", "block"]).select("shard", "source", "block", "key", "copy", "tokens"), "dealt")
    ranked = rank_by_hash(dealt_records, ["shard"], ["key", "copy"], hash_order(seed + 1, F.col("key"), F.col("copy")))
    records = ranked.select("shard", F.col("rank").alias("place"), "source", "key", "copy", "tokens")
    used = dealt_records.groupBy("source").agg(F.sum("tokens").alias("used"), F.count("*").alias("records"), (F.max("copy") + 1).alias("most_copies"))
    held = dealt_records.groupBy("shard", "source").agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"))
    by_shard = table.groupBy("shard", "source").agg(F.count("*").alias("blocks")).join(held, ["shard", "source"], "left").na.fill(0, ["records", "tokens"])
    everything = F.sum("used").over(Window.partitionBy())  # a window over the report's rows
    report = plan.join(used, "source", "left").na.fill(0, ["used", "records", "most_copies"])
    report = report.withColumn("actual_share", F.when(everything > 0, F.round(F.col("used") / everything, 6)).otherwise(0.0))
    report = report.select("source", "target_share", "max_repeat", "own", "wanted", "quota", "used", "records", "most_copies", "actual_share", "reachable")
    return Mixture(records, report, by_shard)
