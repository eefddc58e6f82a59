"""Problem 7: languages of documents and of their segments.

Method: string-kernel classification. Two segments are as alike as the sets of character n-grams (orders 2 to 4,
presence only, hashed) that they share, normalised; kernel ridge regression, one language against the rest, is
fitted through Nystroem landmarks. As the kernel is a product of presence vectors, landmarks and ridge weights
fold into one matrix (n-gram x language), and a batch of segments is scored by one sparse matrix product.

Training: sentences of a bounded, hash-chosen sample of labelled documents (at most `per_language` documents of
each language expected, 300 by default), each also without accents. Labels are noisy, so the model is fitted twice, the
second time without sentences that a model fitted on the other half calls otherwise. Everything else covers all
rows and whole texts.

Scale: one pass, no shuffle; the model is a matrix of fixed size (dims x languages, 2 MB).

Defined results: null and blank texts have no segments and no language; a segment without letters is "und" with
confidence 0; capitalised words and quoted titles inside a sentence are not evidence; a document's language is
the one of most of its letters (ties: by order).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .confusables import canonical_form

LANGUAGES = ("yo", "en", "ha", "ig", "pcm", "fr")
ORDERS = (2, 3, 4)
_SENTENCE = re.compile(r"[^\s][^\n]*?(?:[.!?…]+[\"”’')\]]*(?=\s)|(?=\n)|\Z)", re.DOTALL)
_LEAD = re.compile(r"^(?:[-–—•*]+|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+")
_NAMES = re.compile(r"(?<=[^\n] )[\"“‘(]?[A-ZÀ-ÖØ-ÞƁ-ƓƘḀ-Ỹ][^\s]*")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences and lines of a text."""
    return [(m.start(), m.end()) for m in _SENTENCE.finditer(text) if m.end() > m.start()]


def _letters_table() -> np.ndarray:
    table = np.full(0x10000, 32, dtype=np.uint32)
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LM":
            table[c] = ord(chr(c).lower()[0])
    table[ord("'")] = table[0x2019] = 39
    table[10] = 10
    return table


class Grams:
    """Presence features of a batch of sentences: `ids`, sorted by sentence, and `starts` of each sentence."""

    table = None

    def __init__(self, batch: list[str], dims: int) -> None:
        if Grams.table is None:
            Grams.table = _letters_table()
        joined = "\n" + "\n".join(s.replace("\n", " ") for s in batch) + "\n"
        joined = _NAMES.sub("", joined)
        codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = Grams.table[np.minimum(codes, 0xFFFF)]
        keep = np.ones(len(codes), dtype=bool)  # runs of blanks count once
        blank = codes == 32
        keep[1:] = ~(blank[1:] & (blank[:-1] | (codes[:-1] == 10)))
        codes = codes[keep]
        line = codes == 10
        owner = np.cumsum(line, dtype=np.int64) - 1
        lines = np.cumsum(line, dtype=np.int32)
        mixed = np.where(line, 32, codes).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        keys = []
        rolled = mixed
        for n in range(2, max(ORDERS) + 1):
            rolled = rolled[:-1] * np.uint64(0xD6E8FEB86659FD93) + mixed[n - 1 :]
            if n not in ORDERS:
                continue
            inside = lines[n - 2 : len(lines) - 1] - lines[: len(lines) - n + 1] if n > 2 else 0  # newlines strictly inside
            ok = inside == 0 if n > 2 else np.ones(len(rolled), dtype=bool)
            if n == 2:
                ok &= ~(line[:-1] & line[1:])
            at = np.flatnonzero(ok)
            h = rolled[at]
            h ^= h >> np.uint64(32)
            h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
            keys.append((owner[at] * dims + (h % np.uint64(dims)).astype(np.int64)))
        flat = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        flat = flat[np.concatenate([[True], flat[1:] != flat[:-1]])] if len(flat) else flat
        sent = flat // dims
        self.ids = (flat - sent * dims).astype(np.int32)
        fit = sent < len(batch)
        self.ids, sent = self.ids[fit], sent[fit]
        self.sizes = np.bincount(sent, minlength=len(batch)).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)

    def product(self, matrix: np.ndarray) -> np.ndarray:
        """Normalised presence vectors times matrix (dims x k): one row per sentence."""
        out = np.zeros((len(self.sizes), matrix.shape[1]), dtype=np.float32)
        some = np.flatnonzero(self.sizes)
        if len(some):
            step = max(16, 8_000_000 // (matrix.shape[1] * max(1, int(self.sizes[some].mean()))))  # some 32 MB at a time
            for at in range(0, len(some), step):
                rows = some[at : at + step]
                low, high = self.starts[rows[0]], self.starts[rows[-1]] + self.sizes[rows[-1]]
                out[rows] = np.add.reduceat(matrix[self.ids[low:high]], self.starts[rows] - low, axis=0)
            out[some] /= np.sqrt(self.sizes[some])[:, None]
        return out


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


class LanguageModel:
    """weights: (dims x languages); slope: of the confidence over the margin of the two best scores."""

    def __init__(self, weights: np.ndarray, languages: tuple[str, ...], slope: float) -> None:
        self.weights, self.languages, self.slope = weights, languages, slope

    def scores(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        grams = Grams(batch, len(self.weights))
        return grams.product(self.weights), grams.sizes

    def classify(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language (-1 without letters) and confidence of each sentence."""
        if not batch:
            return np.zeros(0, np.int64), np.zeros(0)
        s, sizes = self.scores(batch)
        best = s.argmax(axis=1)
        two = np.partition(s, -2, axis=1)
        sure = 1 / (1 + np.exp(-self.slope * (two[:, -1] - two[:, -2])))
        return np.where(sizes > 0, best, -1), np.where(sizes > 0, sure, 0.0)


def _ridge(texts: list[str], labels: np.ndarray, k: int, dims: int, landmarks: int, ridge: float, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    chosen: list[int] = []
    for c in range(k):
        own = np.flatnonzero(labels == c)
        chosen += list(rng.permutation(own)[: landmarks // k])
    z = Grams([texts[i] for i in chosen], dims)
    zt = np.zeros((dims, len(chosen)), dtype=np.float32)
    cols = np.repeat(np.arange(len(chosen)), z.sizes)
    zt[z.ids, cols] = 1 / np.sqrt(np.maximum(z.sizes, 1))[cols]
    kzz = z.product(zt).astype(np.float64)
    values, vectors = np.linalg.eigh((kzz + kzz.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # kernel values to Nystroem features
    weight = 1.0 / np.bincount(labels, minlength=k).clip(1)[labels]  # each language counts alike
    weight *= len(labels) / k
    y = np.where(labels[:, None] == np.arange(k), 1.0, -1.0 / max(1, k - 1))
    a, b = ridge * np.eye(root.shape[1]), np.zeros((root.shape[1], k))
    for at in range(0, len(texts), 1000):  # normal equations by blocks, so memory does not grow with the sample
        phi = Grams(texts[at : at + 1000], dims).product(zt).astype(np.float64) @ root
        weighed = phi * weight[at : at + 1000, None]
        a += weighed.T @ phi
        b += weighed.T @ y[at : at + 1000]
    w = np.linalg.solve(a, b)
    return zt @ (root @ w).astype(np.float32)


def train(texts: list[str], labels: list[str], languages: tuple[str, ...] = LANGUAGES, dims: int = 1 << 16, landmarks: int = 240, ridge: float = 1.0, seed: int = 42) -> LanguageModel:
    """A model of sentences with (noisy) labels; see the module's docstring."""
    code = {c: i for i, c in enumerate(languages)}
    y = np.array([code[c] for c in labels], dtype=np.int64)
    present = len(set(labels))
    if present < 2:
        return LanguageModel(np.zeros((dims, len(languages)), np.float32), languages, 1.0)
    k = len(languages)
    half = np.random.default_rng(seed).permutation(len(texts)) % 2
    said = np.zeros(len(texts), dtype=np.int64)
    margin = np.zeros(len(texts))
    for side in (0, 1):
        own, other = np.flatnonzero(half == side), np.flatnonzero(half != side)
        model = LanguageModel(_ridge([texts[i] for i in other], y[other], k, dims, landmarks, ridge, seed), languages, 1.0)
        s = np.concatenate([model.scores([texts[i] for i in own[at : at + 1000]])[0] for at in range(0, len(own), 1000)] or [np.zeros((0, k), np.float32)])
        said[own] = s.argmax(axis=1)
        two = np.partition(s, -2, axis=1)
        margin[own] = two[:, -1] - two[:, -2]
    right = said == y
    kept = np.flatnonzero(right)
    both = [texts[i] for i in kept]
    bare = [_bare(t) for t in both]
    final = _ridge(both + bare, np.concatenate([y[kept], y[kept]]), k, dims, landmarks, ridge, seed)
    # the slope makes the mean confidence of cleaned held-out sentences 0.98 at their lower quartile of margins
    low = float(np.quantile(margin[right], 0.25)) if right.any() else 1.0
    return LanguageModel(final, languages, float(np.log(0.98 / 0.02) / max(low, 1e-3)))


def training_sentences(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", languages: tuple[str, ...] = LANGUAGES, per_language: int = 300) -> tuple[list[str], list[str]]:
    """Sentences of prose and their documents' labels from a sample of at most about per_language documents each."""
    label = F.lower(F.trim(F.col(lang)))
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), label.alias("l")).where(F.col("l").isin(*languages) & F.col("t").rlike(r"[.!?]\s"))
    counts = {r["l"]: r["count"] for r in known.groupBy("l").count().collect()}  # one row per language
    share = F.lit(0.0)
    for c, n in counts.items():
        share = F.when(F.col("l") == c, F.lit(min(1.0, per_language / n))).otherwise(share)
    scale = 1 << 20
    picked = known.where(F.pmod(F.xxhash64("k"), F.lit(scale)) < share * scale).select("l", "t").toPandas()
    texts, labels = [], []
    for c, t in zip(picked["l"], picked["t"], strict=True):
        t = canonical_form(t)
        for a, b in sentences(t)[:12]:
            s = t[a:b]
            if len(s.split()) >= 5 and s[-1:] in ".!?" and len(s) < 400:
                texts.append(s)
                labels.append(c)
    return texts, labels


def fit_language_model(docs: DataFrame, **options) -> LanguageModel:
    texts, labels = training_sentences(docs, **options)
    return train(texts, labels)


def _segments_of(texts: list[str]) -> tuple[list[str], list[tuple[int, int, int]]]:
    parts, where = [], []
    for i, t in enumerate(texts):
        for a, b in sentences(t):
            s = t[a:b]
            m = _LEAD.match(s)
            s = s[m.end() :] if m else s
            parts.append(s.lower() if s.isupper() else s)  # capitals tell names only beside small letters
            where.append((i, a, b))
    return parts, where


def language_segments(df: DataFrame, model: LanguageModel, columns: list[str], key: str = "id") -> DataFrame:
    """(id, field, segment, start, length, lang, confidence, words) for every sentence or line of the columns."""
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(model)  # dims x languages floats, whatever the data
    names = [*model.languages, "und"]
    keep = [F.col(f"`{key}`").alias("id"), *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)]]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for pdf in parts:
            for i, c in enumerate(columns):
                some = pdf[pdf[f"c{i}"].notna()]
                texts = [canonical_form(t) for t in some[f"c{i}"]]
                segs, where = _segments_of(texts)
                best, sure = m.classify(segs)
                at = np.array(where, dtype=np.int64).reshape(-1, 3)
                ids = some["id"].to_numpy(dtype=object)
                first = np.concatenate([[True], at[1:, 0] != at[:-1, 0]]) if len(at) else np.zeros(0, bool)
                number = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0)) if len(at) else at[:, 0]
                yield pd.DataFrame({"id": ids[at[:, 0]], "field": c, "segment": number, "start": at[:, 1], "length": at[:, 2] - at[:, 1], "lang": np.array(names, dtype=object)[best], "confidence": np.round(sure, 4), "words": np.array([s.count(" ") + 1 for s in segs], dtype=np.int64)})

    return df.select(*keep).mapInPandas(run, "id string, field string, segment long, start long, length long, lang string, confidence double, words long")


def document_languages(segments: DataFrame) -> DataFrame:
    """(id, field, lang, confidence, mixed): the language of most letters; mixed if another has a sure sentence."""
    by = segments.groupBy("id", "field", "lang").agg(F.sum("length").alias("n"), F.sum(F.col("confidence") * F.col("length")).alias("c"), F.max(((F.col("confidence") >= SURE) & (F.col("words") >= LEAST_WORDS)).cast("int")).alias("sure"))
    return by.groupBy("id", "field").agg(
        F.max_by("lang", F.struct(F.col("lang") != "und", F.col("n"), F.col("lang"))).alias("lang"),
        F.round(F.max_by(F.col("c") / F.col("n"), F.struct(F.col("lang") != "und", F.col("n"), F.col("lang"))), 4).alias("confidence"),
        (F.sum("sure") > 1).alias("mixed"),
    )


#: A sentence counts as written in a language from this confidence and this many words on.
SURE, LEAST_WORDS = 0.8, 3


def foreign_languages(segments: DataFrame, home: str = "yo") -> DataFrame:
    """(id, field, lang) for each language other than home in which a whole sentence is surely written."""
    sure = (F.col("confidence") >= SURE) & (F.col("words") >= LEAST_WORDS) & ~F.col("lang").isin(home, "und")
    return segments.where(sure).select("id", "field", "lang").distinct()
