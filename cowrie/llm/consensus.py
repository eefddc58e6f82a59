"""Problem 4: a consensus from several annotators' labels.

Method: iteratively reweighted voting. Each round takes the weighted vote of every item and, for each annotator, the
vote without that annotator (leave-one-out). An annotator's accuracy is the smoothed share of judgements that agree
with the others' vote. What it is above the agreement that the annotator would reach by chance, as always giving the
most frequent label does, is the annotator's skill, and its log odds are the weight in the next round, until no
accuracy moves. Before they count, judgements are read: one that an annotator gives mostly where the others vote for another
label is read as that label, so a shifted or inverted scale speaks for what it means (`read=False` takes them as they
are). There is one weight for each annotator, the one that is reported. Agreement is reported as nominal Krippendorff
alpha, which corrects for chance and allows missing ratings.

Scale: votes are hashed and sorted by item once and kept; a round is one job: a join with one row per annotator, a
window over that layout, and an aggregation with partial sums to one row per annotator. Nothing but annotators is
shuffled, and nothing is collected. Items of many votes are summed, not collected.

Defined results: an annotator's later submission on an item replaces the earlier (ties: later receipt, then
label order); null, unreadable or unknown labels do not count; items without a label have no consensus; ties
between labels go to the graver, that is the later in `labels`; annotators who share no item with others have the
accuracy `trust`; empty tables give empty results; rounds that end unsettled are reported and warned of.
"""

from __future__ import annotations

import functools
import operator
import warnings

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cowrie.session import cut

HARM = ("None", "Low", "Moderate", "Severe")
SCALE = ("1", "2", "3", "4", "5")


def read_harm(harm: Column) -> Column:
    """One of HARM however it is spelled (case, blanks, full stops), else null."""
    plain = F.regexp_replace(F.lower(harm), r"[^a-z]+", "")
    out = F.lit(None).cast("string")
    for level in HARM:
        out = F.when(plain == level.lower(), F.lit(level)).otherwise(out)
    return out


def latest_votes(df: DataFrame, item: list[str], annotator: str, label: Column, at: str, received: str) -> DataFrame:
    """(item columns, annotator, label): each annotator's last submission on each item, if its label is readable."""
    order = Window.partitionBy(*item, annotator).orderBy(F.col(at).desc_nulls_last(), F.col(received).desc_nulls_last(), F.col("_label").desc_nulls_last())
    known = df.select(*item, annotator, at, received, label.alias("_label")).where(functools.reduce(operator.and_, (F.col(c).isNotNull() for c in [*item, annotator])))
    return known.withColumn("_rank", F.row_number().over(order)).where("_rank = 1 and _label is not null").select(*item, F.col(annotator).alias("annotator"), F.col("_label").alias("label"))


def latest_ratings(df: DataFrame, item: list[str], annotator: str, ratings: str, at: str, received: str) -> DataFrame:
    """(item columns, dimension, annotator, label) of the readable values 1 to 5 in a map column."""
    order = Window.partitionBy(*item, annotator).orderBy(F.col(at).desc_nulls_last(), F.col(received).desc_nulls_last(), F.col("_text").desc_nulls_last())
    known = df.select(*item, annotator, at, received, ratings, F.to_json(ratings).alias("_text")).where(functools.reduce(operator.and_, (F.col(c).isNotNull() for c in [*item, annotator])))
    last = known.withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    return last.select(*item, F.col(annotator).alias("annotator"), F.explode(ratings).alias("dimension", "value")).where("value between 1 and 5").select(*item, "dimension", "annotator", F.col("value").cast("string").alias("label"))


def _best(labels: tuple[str, ...], scores: list[Column]) -> Column:
    """The label of the highest score; ties go to the later label. Scores are rounded so that the order of
    addition cannot matter."""
    return F.greatest(*[F.struct(F.round(s, 6).alias("s"), F.lit(k).alias("k"), F.lit(v).alias("v")) for k, (v, s) in enumerate(zip(labels, scores, strict=True))])["v"]


class Consensus:
    """labels: (item..., label, confidence, votes, agreement); annotators: (annotator, votes, accuracy, skill, weight, reads):
    skill is the accuracy corrected for chance, which the weight is made of; reads has, for each label, what the annotator's judgement is read as. rounds, settled: how the rounds ended."""

    def __init__(self, labels: DataFrame, annotators: DataFrame, rounds: int, settled: bool) -> None:
        self.labels, self.annotators, self.rounds, self.settled = labels, annotators, rounds, settled


def _weighed(votes: DataFrame, known: DataFrame | None, labels: tuple[str, ...], trust: float) -> DataFrame:
    """votes (..., annotator, j: number of the label) with `read`, the number of the label it stands for, its weight and
    the annotator's accuracy so far."""
    k = len(labels)
    if known is None:  # all count the same
        return votes.withColumns({"read": F.col("j"), "accuracy": F.lit(trust), "skill": F.lit(trust), "weight": F.lit(1.0)})
    told = votes.join(known.select("annotator", "accuracy", "skill", "reads"), "annotator", "left").withColumns({c: F.coalesce(c, F.lit(trust)) for c in ("accuracy", "skill")})
    right = 1 / k + (1 - 1 / k) * F.col("skill")  # how often a judgement is right if the rest are guesses
    weight = F.ln(right * (k - 1) / (1 - right)) if k > 1 else F.lit(1.0)
    return told.withColumns({"read": F.coalesce(F.get("reads", F.col("j")), F.col("j")), "weight": weight}).drop("reads")


def reweighted_voting(votes: DataFrame, item: list[str], labels: tuple[str, ...] = HARM, rounds: int = 50, tolerance: float = 1e-3, prior: float = 4.0, trust: float = 0.7, read: bool = True) -> Consensus:
    """votes: (item..., annotator, label), one per item and annotator. prior: pseudo-counts of the smoothing, at the
    accuracy `trust`. A label outside `labels` does not count."""
    k = len(labels)
    number = functools.reduce(lambda out, i: F.when(F.col("label") == labels[i], i).otherwise(out), range(k), F.lit(None).cast("int"))
    kept = votes.where(F.col("label").isin(*labels)).select(*item, "annotator", number.alias("j")).repartition(*item).sortWithinPartitions(*item).persist()
    try:
        # every round's columns, built once
        over, ks = Window.partitionBy(*item), range(k)
        mine = [F.when(F.col("read") == c, F.col("weight")).otherwise(0.0) for c in ks]
        rest = ["annotator", "j", "accuracy", F.count("*").over(over).alias("m"), *[(F.sum(mine[c]).over(over) - mine[c]).alias(f"r{c}") for c in ks]]
        voted = ["annotator", "j", "accuracy", F.when(F.col("m") > 1, _best(tuple(ks), [F.col(f"r{c}") for c in ks])).alias("other")]
        seen = [F.max("accuracy").alias("before"), F.count("other").alias("n"), *[F.count(F.when((F.col("j") == j) & (F.col("other") == c), 1)).alias(f"n{j}_{c}") for j in ks for c in ks]]
        # of equal counts the judgement's own label, then the later
        reads = F.array(*[_best(tuple(ks), [F.col(f"n{j}_{c}") + (prior if c == j else 0) for c in ks]) if read else F.lit(j) for j in ks]).alias("reads")
        counts = F.array(*[F.array(*[F.col(f"n{j}_{c}") for c in ks]) for j in ks])
        hits = F.aggregate(F.zip_with(counts, F.col("reads"), lambda row, at: F.get(row, at)), F.lit(0).cast("long"), lambda x, y: x + y)
        given = [sum((F.when(F.get("reads", F.lit(j)) == c, sum((F.col(f"n{j}_{x}") for x in ks), F.lit(0))).otherwise(0) for j in ks), F.lit(0)) for c in ks]
        others = [sum((F.col(f"n{j}_{c}") for j in ks), F.lit(0)) for c in ks]
        chance = sum((x * y for x, y in zip(given, others, strict=True)), F.lit(0)) / F.greatest(F.col("n") * F.col("n"), F.lit(1))
        accuracy = (hits + prior * trust) / (F.col("n") + prior)
        # bounds keep a vote of no skill a vote, should an item have no other
        skill = F.when(chance < 1, F.least(F.greatest((accuracy - chance) / F.when(chance < 1, 1 - chance), F.lit(0.005)), F.lit(0.999))).otherwise(0.005)
        now = ["annotator", "before", accuracy.alias("accuracy"), skill.alias("skill"), "reads"]
        most = F.max(F.abs(F.col("accuracy") - F.col("before"))).alias("most")
        known, settled, used = None, False, 0
        for used in range(1, rounds + 1):
            told = _weighed(kept, known, labels, trust)
            counted = told.select(*rest).select(*voted).groupBy("annotator").agg(*seen).select("*", reads)
            moved = Observation()
            known = cut(counted.select(*now).observe(moved, most), "accuracies")
            change = moved.get["most"]
            settled = change is None or (used > 1 and change < tolerance)
            if settled:
                break
        if not settled:
            warnings.warn(f"reweighted voting has not settled after {used} rounds", stacklevel=2)
        told = _weighed(kept, known, labels, trust)
        totals = told.groupBy(*item).agg(*[F.sum(F.when(F.col("read") == c, F.col("weight")).otherwise(0.0)).alias(f"s{c}") for c in range(k)], *[F.count(F.when(F.col("j") == c, 1)).alias(f"n{c}") for c in range(k)], F.count("*").alias("votes"))
        sums = [F.col(f"s{c}") for c in range(k)]
        top = F.greatest(*sums)
        same = functools.reduce(operator.add, [F.col(f"n{c}") * (F.col(f"n{c}") - 1) for c in range(k)])
        out = totals.select(
            *item,
            _best(labels, sums).alias("label"),
            F.round(1 / functools.reduce(operator.add, [F.exp(s - top) for s in sums]), 6).alias("confidence"),
            "votes",
            F.when(F.col("votes") > 1, F.round(same / (F.col("votes") * (F.col("votes") - 1)), 6)).alias("agreement"),
        )
        names = F.array(*map(F.lit, labels))
        raters = told.groupBy("annotator").agg(F.count("*").alias("votes"), *[F.round(F.max(c), 6).alias(c) for c in ("accuracy", "skill", "weight")])
        raters = raters.join(known.select("annotator", "reads"), "annotator", "left").withColumn("reads", F.transform(F.coalesce("reads", F.array(*map(F.lit, range(k)))), lambda x: F.get(names, x)))
        return Consensus(cut(out, "consensus"), cut(raters, "raters"), used, settled)
    finally:
        kept.unpersist()


def krippendorff_nominal(votes: DataFrame, item: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., items, votes, observed, expected, alpha) over items of two votes or more; alpha is 1 where no
    disagreement can be expected."""
    by = by or []
    counts = votes.groupBy(*by, *[c for c in item if c not in by], "label").agg(F.count("*").alias("n"))
    per = counts.groupBy(*by, *[c for c in item if c not in by]).agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).where("m > 1")
    observed = per.groupBy(*by).agg(F.count("*").alias("items"), F.sum("m").alias("votes"), F.sum((F.col("m") * (F.col("m") - 1) - F.col("same")) / (F.col("m") - 1)).alias("apart"))
    pairable = counts.join(per.select(*by, *[c for c in item if c not in by]), [*by, *[c for c in item if c not in by]])
    margins = pairable.groupBy(*by, "label").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    both = observed.withColumn("_one", F.lit(1)).join(margins.withColumn("_one", F.lit(1)), [*by, "_one"])  # one row for each value of `by`
    do, de = F.col("apart") / F.col("votes"), (F.col("all") * F.col("all") - F.col("squares")) / (F.col("all") * (F.col("all") - 1))
    return both.where("votes > 0").select(*by, "items", "votes", F.round(do, 6).alias("observed"), F.round(de, 6).alias("expected"), F.when(de > 0, F.round(1 - do / de, 6)).otherwise(1.0).alias("alpha"))
