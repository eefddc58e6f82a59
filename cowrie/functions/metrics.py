"""Scores of a hypothesis against a reference. Arrow functions return sufficient statistics, so that corpus scores
are sums followed by one formula; sentence scores are columns. Null texts count as empty."""

from __future__ import annotations

import difflib
import functools
import math
import re
import string
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grams import mixed
from .text import bare

CHAR_ORDER, WORD_ORDER, BLEU_ORDER = 6, 2, 4
_PUNCT = set(string.punctuation)


def _grams(seq, n: int) -> Counter:
    return Counter(tuple(seq[i : i + n]) for i in range(len(seq) - n + 1))


#: Pairs whose n-grams are counted together: their number takes fourteen bits of a key, an n-gram's hash the other 50.
TOGETHER = 1 << 14


def _sequences(rows: list[list], codes: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(items as numbers, row of each) of rows of characters (strings) or, with codes, of words."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    if codes is None:
        return np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64), owner
    return np.array([codes.setdefault(w, len(codes)) for r in rows for w in r], dtype=np.uint64), owner


def _counted(items: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(key of row and n-gram, occurrences), by key."""
    h = mixed(items, 41)
    for k in range(1, n):
        h = h[:-1] * np.uint64(0xD1B54A32D192ED03) + mixed(items[k:], 41)
    last = len(items) - n + 1
    whole = owner[:last] == owner[n - 1 :] if last > 0 else np.zeros(0, dtype=bool)
    key = (owner[: len(whole)][whole].astype(np.uint64) << np.uint64(50)) | (mixed(h[: len(whole)][whole], 42) >> np.uint64(14))
    return np.unique(key, return_counts=True)


def _matches(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int, rows: int) -> list[np.ndarray]:
    """(n-grams of a, of b, matches) for each row."""
    (x, nx), (y, ny) = _counted(*a, n), _counted(*b, n)
    at = np.searchsorted(x, y)
    hit = at < len(x)
    hit[hit] = x[at[hit]] == y[hit]
    of = lambda key, w: np.bincount((key >> np.uint64(50)).astype(np.int64), weights=w, minlength=rows).astype(np.int64)
    return [of(x, nx), of(y, ny), of(y[hit], np.minimum(nx[at[hit]], ny[hit]))]


def signature(metric: str) -> str:
    """What a score was computed with, for reports."""
    return {
        "chrf": f"nrefs:1|case:mixed|eff:yes|nc:{CHAR_ORDER}|nw:{WORD_ORDER}|space:no|beta:2",
        "bleu": f"nrefs:1|case:mixed|eff:no|tok:intl|smooth:exp|order:{BLEU_ORDER}",
        "rouge_l": "fmeasure|tok:ascii|stem:no",
        "diacritics": "align:bare words|share of equal marks",
    }[metric]


def all_statistics(hyps: list[str], refs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """chrf_statistics and bleu_statistics of all pairs, one row per pair, by whole-array arithmetic."""
    chrf, bleu = [], []
    for at in range(0, len(hyps), TOGETHER):
        h, r = hyps[at : at + TOGETHER], refs[at : at + TOGETHER]
        n = len(h)
        a, b = (_sequences(["".join(t.split()) for t in side]) for side in (h, r))
        out = [x for k in range(1, CHAR_ORDER + 1) for x in _matches(a, b, k, n)]
        codes: dict[str, int] = {}
        a, b = (_sequences([_edge_punctuation(t) for t in side], codes) for side in (h, r))
        chrf.append(np.stack(out + [x for k in range(1, WORD_ORDER + 1) for x in _matches(a, b, k, n)], axis=1))
        hw, rw = ([_bleu_words(t) for t in side] for side in (h, r))
        a, b = _sequences(hw, codes), _sequences(rw, codes)
        out = [np.array([len(w) for w in hw]), np.array([len(w) for w in rw])]
        for k in range(1, BLEU_ORDER + 1):
            total, _, hits = _matches(a, b, k, n)
            out += [hits, total]
        bleu.append(np.stack(out, axis=1))
    return np.concatenate(chrf or [np.zeros((0, 3 * (CHAR_ORDER + WORD_ORDER)), np.int64)]), np.concatenate(bleu or [np.zeros((0, 2 + 2 * BLEU_ORDER), np.int64)])


def _edge_punctuation(text: str) -> list[str]:
    """Words with one leading or trailing ASCII punctuation mark as a word of its own."""
    out = []
    for w in text.split():
        if len(w) == 1:
            out.append(w)
        elif w[-1] in _PUNCT:
            out += [w[:-1], w[-1]]
        elif w[0] in _PUNCT:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def chrf_statistics(hyp: str, ref: str) -> list[int]:
    """(hypothesis n-grams, reference n-grams, matches) for characters 1..6 and words 1..2."""
    stats = []
    sides = [("".join(hyp.split()), "".join(ref.split()))] * CHAR_ORDER + [(_edge_punctuation(hyp), _edge_punctuation(ref))] * WORD_ORDER
    for (a, b), n in zip(sides, [*range(1, CHAR_ORDER + 1), *range(1, WORD_ORDER + 1)], strict=True):
        x, y = _grams(a, n), _grams(b, n)
        stats += [sum(x.values()), sum(y.values()), sum((x & y).values())]
    return stats


def chrf_score(stats: list[int], beta: float = 2.0) -> float:
    """chrF with word n-grams (chrF++) from summed statistics, 0 to 100: the mean F over orders present on both sides."""
    total, orders = 0.0, 0
    for k in range(0, len(stats), 3):
        h, r, m = stats[k : k + 3]
        if h and r:
            p, q = m / h, m / r
            total += (1 + beta**2) * p * q / (beta**2 * p + q) if m else 0.0
            orders += 1
    return 100 * total / orders if orders else 0.0


def _bleu_words(text: str) -> list[str]:
    """International words: punctuation parted from words, except between digits."""
    text = re.sub(r"([^\w\s.,'-]|_)", r" \1 ", text)
    text = re.sub(r"(?<!\d)([.,])", r" \1 ", text)
    text = re.sub(r"([.,])(?!\d)", r" \1 ", text)
    return text.split()


def bleu_statistics(hyp: str, ref: str) -> list[int]:
    """(lengths of hypothesis and reference, then matches and totals for orders 1..4)."""
    a, b = _bleu_words(hyp), _bleu_words(ref)
    stats = [len(a), len(b)]
    for n in range(1, BLEU_ORDER + 1):
        x, y = _grams(a, n), _grams(b, n)
        stats += [sum((x & y).values()), sum(x.values())]
    return stats


def bleu_score(stats: list[int]) -> float:
    """BLEU of summed statistics with exponential smoothing of empty matches and the brevity penalty."""
    sys_len, ref_len = stats[:2]
    if not sys_len or not stats[2]:
        return 0.0
    logs, smooth, orders = 0.0, 1.0, 0
    for m, t in zip(stats[2::2], stats[3::2], strict=True):
        if not t:
            break
        if not m:
            smooth *= 2
            logs += math.log(1 / (smooth * t))
        else:
            logs += math.log(m / t)
        orders += 1
    if orders < BLEU_ORDER:
        return 0.0
    penalty = 1.0 if sys_len >= ref_len else math.exp(1 - ref_len / sys_len)
    return 100 * penalty * math.exp(logs / orders)


def rouge_l(hyp: str, ref: str, unicode_words: bool = False) -> float:
    """F of the longest common subsequence of words: ASCII letters and digits only by default (which shreds
    accented letters, as the common scorer does), or Unicode words."""
    pattern = r"[^\W_]+" if unicode_words else r"[a-z0-9]+"
    a, b = re.findall(pattern, hyp.lower()), re.findall(pattern, ref.lower())
    if not a or not b:
        return 0.0
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    v = full = (1 << len(a)) - 1
    for w in b:  # one row of the table of common subsequences at a time, as bits
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    lcs = len(a) - v.bit_count()
    p, r = lcs / len(a), lcs / len(b)
    return 2 * p * r / (p + r) if lcs else 0.0


@functools.lru_cache(maxsize=1 << 16)
def _bare_word(word: str) -> str:
    return bare(word).lower()


def diacritic_accuracy(hyp: str, ref: str) -> float:
    """Of the words that align when marks and case are dropped, the share whose marks agree; 0 if none aligns."""
    a, b = unicodedata.normalize("NFC", hyp).split(), unicodedata.normalize("NFC", ref).split()
    match = difflib.SequenceMatcher(None, [_bare_word(w) for w in a], [_bare_word(w) for w in b], autojunk=False)
    same = total = 0
    for block in match.get_matching_blocks():
        total += block.size
        same += sum(a[block.a + i].lower() == b[block.b + i].lower() for i in range(block.size))
    return same / total if total else 0.0


def character_ratio(a: str, b: str, autojunk: bool = True) -> float:
    """Twice the matching characters over all characters. autojunk ignores characters that are frequent in a second
    text of 200 characters or more, as the plain use of the library does."""
    return difflib.SequenceMatcher(None, a, b, autojunk).ratio()


def _pairwise(function, kind: T.DataType, hyp: Column, ref: Column) -> Column:
    def run(h: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([function(a or "", b or "") for a, b in zip(h, r, strict=True)], index=h.index)

    run.__annotations__ = {"h": pd.Series, "r": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)(hyp, ref)


def _filled(texts: pd.Series) -> list[str]:
    return [t or "" for t in texts]


@F.pandas_udf(T.DoubleType())
def _chrf(hyps: pd.Series, refs: pd.Series) -> pd.Series:
    return pd.Series([chrf_score(x) for x in all_statistics(_filled(hyps), _filled(refs))[0].tolist()], dtype=float)


@F.pandas_udf(T.DoubleType())
def _bleu(hyps: pd.Series, refs: pd.Series) -> pd.Series:
    return pd.Series([bleu_score(x) for x in all_statistics(_filled(hyps), _filled(refs))[1].tolist()], dtype=float)


_SCORES = T.StructType([T.StructField("c", T.ArrayType(T.LongType())), T.StructField("b", T.ArrayType(T.LongType())), *[T.StructField(c, T.DoubleType()) for c in ("chrf", "rouge", "dia")]])


@F.pandas_udf(_SCORES)
def _all_scores(hyps: pd.Series, refs: pd.Series) -> pd.DataFrame:
    h, r = _filled(hyps), _filled(refs)
    c, b = all_statistics(h, r)
    pairs = list(zip(h, r, strict=True))
    return pd.DataFrame({"c": list(c), "b": list(b), "chrf": [chrf_score(x) for x in c.tolist()], "rouge": [rouge_l(x, y) for x, y in pairs], "dia": [diacritic_accuracy(x, y) for x, y in pairs]})


def sentence_chrf(hyp: Column, ref: Column) -> Column:
    return _chrf(hyp, ref)


def sentence_bleu(hyp: Column, ref: Column) -> Column:
    return _bleu(hyp, ref)


def sentence_rouge_l(hyp: Column, ref: Column, unicode_words: bool = False) -> Column:
    return _pairwise(functools.partial(rouge_l, unicode_words=unicode_words), T.DoubleType(), hyp, ref)


def sentence_diacritics(hyp: Column, ref: Column) -> Column:
    return _pairwise(diacritic_accuracy, T.DoubleType(), hyp, ref)


def character_similarity(a: Column, b: Column, autojunk: bool = True) -> Column:
    return _pairwise(functools.partial(character_ratio, autojunk=autojunk), T.DoubleType(), a, b)


def corpus_scores(df: DataFrame, by: list[str], hyp: str = "hypothesis", ref: str = "reference") -> DataFrame:
    """(by..., n, corpus_chrf, corpus_bleu, chrf, rouge_l, diacritics): sums of statistics, then the formulas. All
    statistics of a pair come from one pass."""
    stats = df.select(*by, _all_scores(F.col(hyp), F.col(ref)).alias("x")).select(*by, "x.*")
    nc, nb = 3 * (CHAR_ORDER + WORD_ORDER), 2 + 2 * BLEU_ORDER
    sums = stats.groupBy(*by).agg(
        F.count("*").alias("n"), F.array(*[F.sum(F.col("c")[i]) for i in range(nc)]).alias("c"), F.array(*[F.sum(F.col("b")[i]) for i in range(nb)]).alias("b"), F.avg("chrf").alias("chrf"), F.avg("rouge").alias("rouge_l"), F.avg("dia").alias("diacritics")
    )

    def finish(score):
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: score([int(v) for v in x]))

        run.__annotations__ = {"s": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, T.DoubleType())

    return sums.select(*by, "n", F.round(finish(chrf_score)("c"), 4).alias("corpus_chrf"), F.round(finish(bleu_score)("b"), 4).alias("corpus_bleu"), F.round("chrf", 4).alias("chrf"), F.round("rouge_l", 4).alias("rouge_l"), F.round("diacritics", 4).alias("diacritics"))
