"""Problem 2: splits that keep related records together.

Method: records are joined into components (a claim, or whatever several key columns connect); within each
stratum the components' weights are balanced by largest differencing into many nearly equal bins (the two
partial partitions with the largest spread are merged, heaviest bin with lightest, until one is left); whole
bins then go to train, val and test by what each still lacks of its target. Of the numbers of bins in CHOICES each
stratum takes the one with which whole bins meet the targets best.

Scale: components are pre-aggregated to (component, weight). A stratum of more than `block` components is cut
into hash blocks, each balanced in its own task; the blocks' bins are balanced again, level by level, so no
task holds more than `block` weights. Nothing but one row per stratum and bin is combined last.

Defined results: records with a null or blank key form no component and are left out; a component's stratum is
its most frequent stratum value, ignoring case and blanks (ties: the first by order; none: "unknown"); records
repeated under one id count once; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cowrie.functions.text import claim_key
from cowrie.session import cut

__all__ = ["claim_key", "connected_components", "split_components"]
SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b): the smallest node of each component.

    Alternating large-star and small-star steps: every step links neighbours to the smallest node they can see,
    so long chains shrink geometrically; each step is one shuffle, with no group collected into a task. The join of a
    hub's edges with its smallest neighbour is skewed; adaptive execution splits it. Rounds that do not suffice are an error."""
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    for _ in range(rounds):
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(small_low.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small, "cc")
        same = new.count() == links.count() and new.exceptAll(links).isEmpty()
        links = new
        if same:
            break
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")), "node", "left").select("node", F.coalesce("low", "node").alias("component"))


def components(records: DataFrame, id_col: str, keys: dict[str, Column]) -> DataFrame:
    """(id, component). With one key the component is the key itself; with several, records that share any of
    them, directly or through others, are joined."""
    if len(keys) == 1:
        (key,) = keys.values()
        return records.select(F.col(f"`{id_col}`").alias("id"), key.alias("component")).where("component is not null")
    tagged = F.array_compact(F.array(*[F.when(k.isNotNull(), F.concat(F.lit(name + "\u0001"), k)) for name, k in sorted(keys.items())]))
    rows = records.select(F.col(f"`{id_col}`").alias("id"), tagged.alias("nodes")).where(F.size("nodes") > 0)
    edges = rows.select(F.element_at("nodes", 1).alias("a"), F.explode("nodes").alias("b")).distinct()
    found = connected_components(edges)
    return rows.select("id", F.element_at("nodes", 1).alias("node")).join(found, "node").select("id", "component")


def largest_differencing(weights: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each weight. Multiway largest differencing: a heap of partial partitions ordered by spread;
    the two of largest spread are merged, the heaviest bin of one with the lightest of the other."""
    n = len(weights)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    parent: list[tuple[int, ...]] = []
    heap: list[tuple[float, int, list[tuple[float, int]]]] = []
    # a node of the merge forest is an item (>= 0) or -1 - k for parent[k]; 0 weights are left out of the tuples
    for i, w in enumerate(weights):
        heap.append((-float(w), i, [(float(w), i)]))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) + len(b) <= bins:  # the lightest bins of one are empty: nothing meets
            merged = a + b
        else:
            merged, free = [], bins - len(a)  # empty bins of a take b's heaviest
            merged += b[:free] + a[: len(a) - (len(b) - free)] if len(b) > free else b + a
            for (wa, na), (wb, nb) in zip(reversed(a[len(a) - (len(b) - free) :]), b[free:], strict=True):
                parent.append((na, nb))
                merged.append((wa + wb, -len(parent)))
        merged.sort(reverse=True)
        if len(merged) == bins:  # what every bin holds needs no balancing
            low = merged[-1][0]
            spread = merged[0][0] - low
        else:
            spread = merged[0][0]
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    out = np.full(n, -1, dtype=np.int64)
    for k, (_, node) in enumerate(heap[0][2]):
        stack = [node]
        while stack:
            x = stack.pop()
            if x >= 0:
                out[x] = k
            else:
                stack.extend(parent[-x - 1])
    return out


def allocate(weights: np.ndarray, shares: dict[str, float]) -> list[str]:
    """Whole bins to splits, heaviest first, each to the split that lacks most of its target."""
    names = list(shares)
    target = np.array([shares[s] for s in names], dtype=float)
    lack = target / target.sum() * weights.sum()
    out = [""] * len(weights)
    for i in np.argsort(-weights, kind="stable"):
        k = int(np.argmax(lack))
        out[i] = names[k]
        lack[k] -= weights[i]
    return out


#: Numbers of bins to choose from: few bins are very even if there are many components, many bins are finer shares.
CHOICES = (10, 20, 50, 100, 200)


def balanced_for(weights: np.ndarray, shares: dict[str, float], choices: tuple[int, ...] = CHOICES) -> np.ndarray:
    """The bin of each weight, with the number of bins at which the splits miss their targets least (of equal ones the
    fewest)."""
    best, found = np.inf, np.zeros(len(weights), dtype=np.int64)
    target = np.array(list(shares.values())) / sum(shares.values()) * weights.sum()
    for bins in choices:
        at = largest_differencing(weights, bins)
        filled = np.unique(at)
        sums = np.bincount(at, weights=weights)[filled]
        given = np.array(allocate(sums, shares))
        missed = max(abs(sums[given == s].sum() - t) for s, t in zip(shares, target, strict=True))
        if missed < best - 1e-9:
            best, found = missed, at
    return found


def _balance(items: DataFrame, bins: int, shares: dict[str, float]) -> DataFrame:
    """items (stratum, block, item, weight, last) with the bin of each item within its stratum and block; a stratum's
    last level chooses its number of bins."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "item"], ascending=[False, True], kind="stable")
        weights = pdf["weight"].to_numpy()
        return pdf.assign(bin=balanced_for(weights, shares) if pdf["last"].iloc[0] else largest_differencing(weights, bins)).drop(columns="last")

    return items.groupBy("stratum", "block").applyInPandas(of, "stratum string, block long, item string, weight long, bin long")


def balanced_bins(weights: DataFrame, shares: dict[str, float], bins: int = 200, block: int = 20_000) -> DataFrame:
    """(stratum, item, weight, bin) from (stratum, item, weight): nearly equal bins within each stratum."""
    block = max(block, 4 * bins)  # so that each level has at most a quarter of the weights of the one below
    level = weights.select("stratum", "item", "weight")
    steps: list[DataFrame] = []
    while True:
        sizes = level.groupBy("stratum").count().select("stratum", F.ceil(F.col("count") / block).alias("blocks"))
        most = sizes.agg(F.max("blocks")).first()[0] or 1
        placed = level.join(sizes, "stratum").select("stratum", F.pmod(F.xxhash64("item"), F.col("blocks")).alias("block"), "item", "weight", (F.col("blocks") <= 1).alias("last"))
        done = cut(_balance(placed, bins, shares), "bins")
        steps.append(done)
        if most <= 1:
            break
        level = done.groupBy("stratum", F.concat_ws(":", "block", "bin").alias("item")).agg(F.sum("weight").alias("weight"))
    out = steps[0].select("stratum", "item", "weight", "block", "bin")
    for up in steps[1:]:
        out = out.withColumn("at", F.concat_ws(":", "block", "bin")).drop("block", "bin").join(up.select("stratum", F.col("item").alias("at"), "block", "bin"), ["stratum", "at"])
    return out.select("stratum", "item", "weight", "bin")


def split_components(records: DataFrame, id_col: str, keys: dict[str, Column], stratum: Column, shipped: Column | None = None, shares: dict[str, float] | None = None, bins: int = 200, block: int = 20_000) -> DataFrame:
    """One row per component: (component, stratum, records, shipped_splits, split).

    shipped_splits are the distinct values of `shipped` among its records (to name torn components)."""
    shares = shares or SHARES
    flat = records.select(
        F.col(f"`{id_col}`").alias("id"),
        *[k.alias(f"_key_{n}") for n, k in keys.items()],
        F.nullif(F.lower(F.trim(stratum)), F.lit("")).alias("_stratum"),
        (shipped if shipped is not None else F.lit(None).cast("string")).alias("_shipped"),
    ).dropDuplicates(["id"])
    if len(keys) == 1:
        (name,) = keys
        tied = flat.withColumn("component", F.col(f"_key_{name}")).where("component is not null")
    else:
        tied = flat.join(components(flat, "id", {n: F.col(f"_key_{n}") for n in keys}), "id")
    by_value = tied.groupBy("component", "_stratum").agg(F.count("*").alias("n"), F.collect_set("_shipped").alias("shipped"))
    whole = cut(
        by_value.groupBy("component").agg(
            F.coalesce(F.min_by("_stratum", F.when(F.col("_stratum").isNotNull(), F.struct(-F.col("n"), F.col("_stratum")))), F.lit("unknown")).alias("stratum"),
            F.sum("n").alias("records"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("shipped")))).alias("shipped_splits"),
        ),
        "components",
    )
    placed = cut(balanced_bins(whole.select("stratum", F.col("component").alias("item"), F.col("records").alias("weight")), shares, bins, block), "placed")

    def give(pdf: pd.DataFrame) -> pd.DataFrame:  # at most `bins` rows of one stratum
        pdf = pdf.sort_values("bin")
        return pdf.assign(split=allocate(pdf["weight"].to_numpy(), shares))[["stratum", "bin", "split"]]

    given = placed.groupBy("stratum", "bin").agg(F.sum("weight").alias("weight")).groupBy("stratum").applyInPandas(give, "stratum string, bin long, split string")
    named = placed.join(given, ["stratum", "bin"]).select(F.col("item").alias("component"), "split")
    return whole.join(named, "component")
