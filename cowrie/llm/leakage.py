"""Problem 6: same or near-same records across splits.

A training and an evaluation record overlap if the sets of 5-character substrings of their texts (accents removed,
lower case, everything but letters and digits as one space) have a Jaccard similarity of at least 0.8.

Method: an exact prefix-filter bipartite join. Grams are ordered from rare to frequent; two sets of that
similarity share one of their first n - ceil(0.8 n) + 1 grams. The prefixes of evaluation texts are the index,
training texts probe it; a meeting is kept if sizes are within the ratio, if the places of the shared gram leave
room for the overlap (so the smaller set's place is within its first ninth), and if a 256-bit parity sketch does
not show more differences than allowed. Each filter loses nothing. What remains is verified on the grams.

Scale: exact copies are folded to one class. Rarity comes from counts in 2^18 hash buckets, a table of fixed size
(any total order is valid for the filter). Grams that very many texts hold are salted: training rows are
spread over salts, evaluation rows sent to each. Meetings are searched in sorted arrays, never listed by key.

Defined results: records whose output is null, blank or a placeholder are no case; a null instruction counts as
empty; splits other than the given ones are ignored; rows repeated for one id count once (unequal ones: the first by
split, source and text); null ids are left out. A class with more than `full` copies on a side is given by that
side's smallest id with every record of the other side, and each of its records with the other side's smallest id;
`members` names the class of every record that has an overlap, so no link is lost.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cowrie.functions.grams import text_key
from cowrie.operators.setjoin import candidates, similarity
from cowrie.session import cut, spread

from .pairs import PLACEHOLDERS, fold


class _Bare(dict):
    """What each character becomes, filled as characters are met: marks nothing, letters and digits themselves, all
    else a blank."""

    def __missing__(self, code: int) -> str | int:
        c = chr(code)
        self[code] = out = "" if unicodedata.category(c) == "Mn" else code if c.isalnum() else " "
        return out


_BARE = _Bare()


def bare(text: str) -> str:
    """No accents, lower case, letters and digits only, one space between words."""
    return " ".join(unicodedata.normalize("NFD", text.lower()).translate(_BARE).split())


def is_empty_output(output: str | None) -> bool:
    """Null, blank or a mere placeholder."""
    return output is None or _is_empty(output, bare(output))


_LONGEST = max(map(len, PLACEHOLDERS))


def _is_empty(output: str, plain: str) -> bool:
    return not plain or len(plain) <= _LONGEST + 2 and fold(output).strip(" .!?-–—…[](){}<>_*'\"") in PLACEHOLDERS


def record_text(instruction: str | None, output: str | None) -> str | None:
    """The text that is compared, or null where the output is empty."""
    if output is None:
        return None
    plain = bare(output)
    return None if _is_empty(output, plain) else f"{bare(instruction or '')} {plain}".strip()


def _texts(df: DataFrame) -> DataFrame:
    """(id, split, source, h1, h2, text) of rows (id, split, source, ask, out) that have a text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = np.array([record_text(a, b) for a, b in zip(pdf["ask"], pdf["out"], strict=True)], dtype=object)
            keep = np.array([t is not None for t in texts], dtype=bool)
            keys = np.array([text_key(t) for t in texts[keep]], dtype=np.int64).reshape(-1, 2)
            yield pdf.loc[keep, ["id", "split", "source"]].assign(h1=keys[:, 0], h2=keys[:, 1], text=texts[keep])

    return spread(df).mapInPandas(run, "id string, split string, source string, h1 long, h2 long, text string")


class Overlaps:
    """links: (a, b, similarity): classes of equal texts, by their smallest id, a one of training and b one of
    evaluation records; members: (class, id, split, source) of the records in these classes."""

    def __init__(self, links: DataFrame, members: DataFrame, train: str) -> None:
        self.links, self.members, self.train = links, members, train

    def pairs(self, full: int = 16) -> DataFrame:
        """(train_id, eval_id, split, source): source of the evaluation record."""
        side = F.col("split") == self.train
        tagged = self.members.withColumn("side", side)
        counts = tagged.groupBy("class", "side").agg(F.count("*").alias("n"), F.min("id").alias("first"))  # a hot class is summed where it lies
        sized = tagged.join(counts, ["class", "side"]).withColumn("low", F.col("id") == F.col("first"))
        t = sized.where("side").select(F.col("class").alias("a"), F.col("id").alias("train_id"), F.col("n").alias("tn"), F.col("low").alias("tl"))
        e = sized.where("not side").select(F.col("class").alias("b"), F.col("id").alias("eval_id"), "split", "source", F.col("n").alias("en"), F.col("low").alias("el"))
        big = f"(tn > {full} or en > {full})"
        return self.links.join(t, "a").join(e, "b").where(f"not {big} or tl or el").select("train_id", "eval_id", "split", "source")

    def membership(self) -> DataFrame:
        """(id, split, source, class, links): every record with an overlap, its class of copies, and the number of
        classes of the other side that are linked to it."""
        side = F.when(F.col("split") == self.train, "train").otherwise("evaluation")
        degree = self.links.select(F.explode(F.array(F.struct(F.col("a").alias("class"), F.lit("train").alias("side")), F.struct(F.col("b").alias("class"), F.lit("evaluation").alias("side")))).alias("x"))
        degree = degree.groupBy("x.class", "x.side").agg(F.count("*").alias("links"))
        return self.members.withColumn("side", side).join(degree, ["class", "side"]).select("id", "split", "source", "class", "links")

    def report(self) -> DataFrame:
        """(split, source, records, pairs): evaluation records that recur in training, and all pairs of them, counted by
        class without being listed."""
        side = F.col("split") == self.train
        copies = self.members.where(side).groupBy(F.col("class").alias("a")).agg(F.count("*").alias("copies"))
        partners = self.links.join(copies, "a").groupBy(F.col("b").alias("class")).agg(F.sum("copies").alias("copies"))
        held = self.members.where(~side).groupBy("class", "split", "source").agg(F.count("*").alias("n"))
        return held.join(partners, "class").groupBy("split", "source").agg(F.sum("n").alias("records"), F.sum(F.col("n") * F.col("copies")).alias("pairs"))


def cross_split_overlaps(df: DataFrame, source: Column, key: str = "id", instruction: str = "instruction", output: str = "output", split: str = "split", train: str = "train", evaluation: tuple[str, ...] = ("val", "test"), threshold: float = 0.8, crowd: int = 50_000) -> Overlaps:
    """Overlaps between training and evaluation records of df."""
    flat = df.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{split}`").alias("split"), source.alias("source"), F.col(f"`{instruction}`").alias("ask"), F.col(f"`{output}`").alias("out"))
    flat = flat.where(F.col("id").isNotNull() & F.col("split").isin(train, *evaluation))
    rows = cut(_texts(flat), "rows")
    records = rows.groupBy("id").agg(F.min(F.struct("split", "source", "h1", "h2")).alias("r")).select("id", "r.*")
    # one text per class; it stands for training rows, evaluation rows or both
    side = F.col("split") == train
    texts = cut(rows.groupBy("h1", "h2").agg(F.min("id").alias("class"), F.first("text").alias("text"), F.max(side.cast("int")).alias("t"), F.max((~side).cast("int")).alias("e")), "texts")
    met = cut(candidates(texts.select(F.col("h1").alias("cls"), F.col("t").alias("l"), F.col("e").alias("r"), "text"), threshold, crowd=crowd), "met")
    # texts that share the first half of their key come along here, and the check tells them apart
    involved = met.select(F.explode(F.array("l", "r")).alias("h1")).distinct()
    held = cut(texts.join(involved, "h1", "left_semi").select("h1", "class", "text", "t", "e"), "held")
    a = held.where("t = 1").select(F.col("h1").alias("l"), F.col("class").alias("a"), F.col("text").alias("x"))
    b = held.where("e = 1").select(F.col("h1").alias("r"), F.col("class").alias("b"), F.col("text").alias("y"))
    links = cut(met.join(a, "l").join(b, "r").withColumn("similarity", similarity()("x", "y")).where(F.col("similarity") >= threshold - 1e-12).select("a", "b", "similarity"), "links")
    near = links.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    near = texts.join(near, "class", "left_semi").select("h1", "h2", "class")
    return Overlaps(links, cut(records.join(near, ["h1", "h2"]).select("class", "id", "split", "source"), "members"), train)
