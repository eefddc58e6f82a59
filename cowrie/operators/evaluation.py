"""Ratings, incidents, error flags, topic weights, retrieval, terms and fertility."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cowrie.functions.metrics import character_ratio, sentence_diacritics
from cowrie.functions.text import content_words, nfc, repeated_bigram, strip_diacritics, token_legality, tokens
from cowrie.session import cut

HARM = ("None", "Low", "Moderate", "Severe")


def mean_ratings(long: DataFrame, by: str, dimension: str, value: str) -> DataFrame:
    """(by, dimension, n, mean) of ratings, three digits."""
    return long.where(F.col(value).isNotNull()).groupBy(by, dimension).agg(F.count("*").alias("n"), F.round(F.avg(value), 3).alias("mean"))


def harm_distribution(df: DataFrame, by: str, harm: str, levels: tuple[str, ...] = HARM) -> DataFrame:
    """One column per level, zero where none; other values do not count."""
    return df.groupBy(by).agg(*[F.sum((F.coalesce(F.col(harm), F.lit("")) == v).cast("long")).alias(v.lower()) for v in levels])


def flagged(df: DataFrame, hyp: str = "hypothesis", ref: str = "reference") -> DataFrame:
    """df with code_switching, omission, disfluency and diacritic_error: few legal words, under half of the reference's
    length, a pair of words said twice, marks that agree on less than 0.7 of the words that align."""
    words = F.size(tokens(F.col(hyp)))
    ref_words = F.size(tokens(F.col(ref)))
    legal = token_legality(nfc(F.coalesce(F.col(hyp), F.lit(""))))
    return df.withColumns(
        {
            "code_switching": (words > 0) & (F.when(legal["tokens"] > 0, legal["legal"] / legal["tokens"]).otherwise(0.0) < 0.85),
            "omission": F.when(ref_words > 0, words / ref_words).otherwise(1.0) < 0.5,
            "disfluency": repeated_bigram(F.col(hyp)),
            "diacritic_error": sentence_diacritics(F.col(hyp), F.col(ref)) < 0.7,
        }
    )


def error_counts(df: DataFrame, by: str, flags: list[str]) -> DataFrame:
    """(by, error, n) of flags that are set; groups without any are left out."""
    long = df.select(by, F.explode(F.array(*[F.struct(F.lit(f).alias("error"), F.col(f).alias("on")) for f in flags])).alias("x"))
    return long.where("x.on").groupBy(by, F.col("x.error").alias("error")).agg(F.count("*").alias("n"))


def error_pivot(df: DataFrame, by: str, flags: list[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.sum(F.coalesce(F.col(f), F.lit(False)).cast("long")).alias(f) for f in flags])


def lowest(df: DataFrame, score: str, tie: list[str], n: int) -> DataFrame:
    """The n lowest scores; ties by key."""
    return df.orderBy(F.col(score).asc_nulls_last(), *tie).limit(n)


def language_consistency(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by..., tokens, legal, consistency): share of all tokens whose spelling is legal; 0 without tokens."""
    t = token_legality(nfc(F.col(text)))
    sums = df.select(*by, t.alias("t")).groupBy(*by).agg(F.coalesce(F.sum("t.tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("t.legal"), F.lit(0)).alias("legal"))
    return sums.withColumn("consistency", F.when(F.col("tokens") > 0, F.round(F.col("legal") / F.col("tokens"), 6)).otherwise(0.0))


# --- terms

def _term_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda w: w != "")


def term_matches(df: DataFrame, terms: DataFrame, key: list[str], text: str, term: str = "term_en") -> DataFrame:
    """(key..., term): terms that occur in a text at word boundaries, ignoring case. Texts' word runs meet the terms in
    an equi-join, whatever the number of terms; the boundary test then settles signs inside terms."""
    clean = terms.where(F.col(term).isNotNull()).select(F.col(term).alias("term")).distinct().withColumn("run", F.array_join(_term_words(F.col("term")), " ")).where("run <> ''")
    longest = clean.agg(F.max(F.size(F.split("run", " ")))).first()[0] or 1
    words = df.select(*key, F.col(text).alias("_text"), _term_words(F.col(text)).alias("_w"))

    def runs_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("_w") - n + 1)
        return F.when(F.size("_w") >= n, F.transform(starts, lambda i: F.array_join(F.slice("_w", i, n), " "))).otherwise(F.array().cast("array<string>"))

    runs = F.array_distinct(F.flatten(F.array(*[runs_of(n) for n in range(1, longest + 1)])))
    met = words.select(*key, "_text", F.explode(runs).alias("run")).join(clean, "run")
    quoted = F.concat(F.lit(r"(?i)\b\Q"), F.col("term"), F.lit(r"\E\b"))
    return met.where(F.regexp_like("_text", quoted)).select(*key, "term")


def term_frequency(df: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """(term, frequency): number of texts that hold the term; terms without any have zero."""
    hits = term_matches(df, terms, [key], text).distinct().groupBy("term").agg(F.count("*").alias("n"))
    return terms.where("term_en is not null").select(F.col("term_en").alias("term")).distinct().join(hits, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("frequency"))


def term_flags(df: DataFrame, terms: DataFrame, key: str, english: str, own: str) -> DataFrame:
    """(key, term, expected): records whose English side holds a term but whose own side lacks its agreed form, marks
    and case aside."""
    folded = lambda c: F.lower(strip_diacritics(c))
    agreed = terms.where(F.trim(F.coalesce("canonical_yo", F.lit(""))) != "").select(F.col("term_en").alias("term"), F.lower(F.trim("canonical_yo")).alias("expected")).distinct()
    said = df.select(key, english, folded(F.coalesce(F.col(own), F.lit(""))).alias("_own"))
    met = term_matches(said, agreed.select(F.col("term").alias("term_en")), [key, "_own"], english).distinct().join(agreed.withColumn("_form", folded(F.col("expected"))), "term")
    return met.where(~F.contains(F.col("_own"), F.col("_form"))).select(key, "term", "expected")


# --- retrieval

def topic_weights(entries: DataFrame, question: str, topic: str) -> DataFrame:
    """(word, topics, idf): idf = ln((topics of all + 1) / (topics with the word + 1)) + 1."""
    n = entries.select(topic).distinct().count()
    words = entries.select(topic, F.explode(content_words(strip_diacritics(F.col(question)))).alias("word")).distinct()
    return words.groupBy("word").agg(F.count("*").alias("topics")).withColumn("idf", F.round(F.log((F.lit(n) + 1.0) / (F.col("topics") + 1)) + 1, 6))


def best_of_block(queries: pd.DataFrame, entries: pd.DataFrame, anchor: float, overlap: float, ratio: float) -> Iterator[tuple]:
    """(q, entry_id, len, score) of the best entry for each query of a block (q, words, idf); entries: (e, words, idf,
    entry_id, len). The character ratio is skipped only where a bound shows that it cannot reach the best score so far
    or its own threshold: twice the common characters, then twice the longest common subsequence, over all characters."""
    places: dict[str, list[int]] = {}
    for k, words in enumerate(entries["words"]):
        for w in words:
            places.setdefault(w, []).append(k)
    at = {w: np.array(ks) for w, ks in places.items()}
    totals = np.array([math.fsum(i) for i in entries["idf"]])
    texts, ids, lens = entries["e"].to_list(), entries["entry_id"].to_list(), entries["len"].to_list()
    sizes = np.array([len(t) for t in texts])
    counts = np.array([_character_counts(t) for t in texts], dtype=np.int16)
    for q, words, idf in zip(queries["q"], queries["words"], queries["idf"], strict=True):
        heavy = [at[w] for w, i in zip(words, idf, strict=True) if i >= anchor and w in at]
        if not heavy:
            continue
        met = np.unique(np.concatenate(heavy))
        common = np.zeros(len(texts))
        for w, i in zip(words, idf, strict=True):
            if w in at:
                common[at[w]] += i
        shared = common[met] / (math.fsum(idf) + totals[met] - common[met])
        most = 2.0 * np.minimum(counts[met], np.array(_character_counts(q), dtype=np.int16)).sum(axis=1) / (len(q) + sizes[met])
        best, found = -1.0, []
        strong = shared >= overlap
        if strong.any():
            best = float(shared[strong].max())
            found = [(float(x), int(k)) for x, k in zip(shared[strong], met[strong], strict=True) if x > best - 1e-9]
        masks: dict[str, int] = {}
        for j, c in enumerate(q):
            masks[c] = masks.get(c, 0) | 1 << j
        for j in np.argsort(-most, kind="stable"):
            if most[j] < best - 1e-9:
                break
            k = int(met[j])
            least = max(best - 1e-9, 0.0 if strong[j] else ratio)
            if most[j] < least - 1e-9 or 2.0 * _subsequence(masks, len(q), texts[k]) / (len(q) + len(texts[k])) < least - 1e-9:
                continue
            alike = character_ratio(q, texts[k])
            score = max(alike, float(shared[j]))
            if (strong[j] or alike >= ratio) and score > best - 1e-9:
                best = max(best, score)
                found.append((score, k))
        if found:
            x, n, e = min((-round(x, 9), -lens[k], ids[k]) for x, k in found)
            yield q, e, -n, -x


def _character_counts(text: str, kinds: int = 64) -> list[int]:
    """Counts of characters by code modulo kinds; codes that fall together only raise the bound."""
    out = [0] * kinds
    for c in text:
        out[ord(c) % kinds] += 1
    return [min(n, 32767) for n in out]


def _subsequence(masks: dict[str, int], n: int, text: str) -> int:
    """Length of the longest common subsequence of a text and one of n characters, given as bits of their places."""
    full = (1 << n) - 1
    v = full
    for c in text:
        if m := masks.get(c):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def best_matches(queries: DataFrame, entries: DataFrame, weights: DataFrame, anchor: float = 2.0, overlap: float = 0.16, ratio: float = 0.55, block: int = 40_000) -> DataFrame:
    """(query_id, entry_id, score): each query's best entry by the larger of weighted word overlap and character
    similarity, if it shares a word of idf >= anchor and one of the two reaches its threshold; ties: the longer answer,
    then the smaller id. Words that no entry has weigh as words of no topic.

    Equal questions are one query, and equal questions of entries one entry, as their scores are the same. Blocks of
    queries meet blocks of entries (at most about `block` rows). queries: (query_id, question); entries: (entry_id, question, answer)."""
    folded = F.regexp_replace(F.lower(strip_diacritics(F.col("question"))), r"(?U)^\s+|\s+$", "")
    asked = cut(queries.select("query_id", folded.alias("q")), "asked")
    q = asked.select("q").where("q <> ''").distinct()
    e = entries.select("entry_id", folded.alias("e"), F.length("answer").cast("long").alias("len")).where("e <> ''")
    e = e.groupBy("e").agg(F.min(F.struct((-F.col("len")).alias("n"), "entry_id")).alias("b")).select("e", "b.entry_id", (-F.col("b.n")).alias("len"))
    every = weights.agg(F.max(F.round(F.exp(F.col("idf") - 1) * (F.col("topics") + 1)))).first()[0] or 1.0  # topics of all, and one
    exact = weights.select("word", (F.log(F.lit(every) / (F.col("topics") + 1)) + 1).alias("idf"))

    def weighed(df: DataFrame, key: str) -> DataFrame:
        words = df.select(key, F.explode(content_words(F.col(key))).alias("word")).join(exact, "word", "left").withColumn("idf", F.coalesce("idf", F.log(F.lit(every)) + 1))
        return words.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("word", "idf"))).alias("w")).select(key, F.col("w.word").alias("words"), F.col("w.idf").alias("idf"))

    q, e = cut(weighed(q, "q"), "queries"), cut(weighed(e, "e").join(e, "e"), "entries")
    n = q.count()
    parts, blocks = max(math.ceil(n / 8_000), min(24, math.ceil(n / 50)), 1), max(math.ceil(e.count() / block), 1)
    left = q.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = e.withColumn("block", F.pmod(F.xxhash64("e"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(best_of_block(a, b, anchor, overlap, ratio)) if len(a) and len(b) else [], columns=["q", "entry_id", "len", "score"])

    near = left.repartition(parts * blocks, "part", "block").groupBy("part", "block").cogroup(right.repartition(parts * blocks, "part", "block").groupBy("part", "block")).applyInPandas(run, "q string, entry_id string, len long, score double")
    best = near.groupBy("q").agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.col("len")).alias("n"), "entry_id")).alias("b"))
    return asked.join(best, "q").select("query_id", F.col("b.entry_id").alias("entry_id"), F.round(-F.col("b.s"), 6).alias("score"))


# --- fertility

def fertility(df: DataFrame, texts: dict[str, str], count: Column | None = None) -> DataFrame:
    """(side, tokens, words, fertility) of tokens per word for each named text column. count: column function of a
    word's number of tokens; by default one for each four characters begun."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("text")) for k, c in texts.items()])).alias("x")).select("x.*")
    words = long.select("side", F.explode(tokens(F.col("text"))).alias("word"))
    return words.groupBy("side").agg(F.sum(F.ceil(F.length("word") / 4) if count is None else count).cast("long").alias("tokens"), F.count("*").alias("words")).withColumn("fertility", F.round(F.col("tokens") / F.col("words"), 4))


def unblinded(ratings: DataFrame, key: DataFrame, on: list[str]) -> DataFrame:
    """ratings with the system behind each slot; a rating whose slot the key lacks is an error, not a loss."""
    lost = ratings.join(key, on, "left_anti")
    if not lost.isEmpty():
        raise KeyError(f"slots without a system: {lost.limit(3).collect()}")
    return ratings.join(key, on)

