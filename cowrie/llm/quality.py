"""Problem 10: per-document text quality statistics, and prose told from lists, tables and junk.

Method: statistics of each document's words, characters and lines; gradient-boosted trees on them, trained on
documents whose kind simple rules can tell for sure (weak labels), with probabilities calibrated by a
temperature chosen on hand-checked texts and measured on others (quality_holdout.py).

Training: at most about `sample` documents (8,000 by default), chosen by a hash of their key; statistics and
kinds are made for all documents, of their whole texts, in one pass without a shuffle.

Defined results: null, empty and blank texts have zero counts and the kind "blank"; a line is what line feeds
part (carriage returns are dropped); repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cowrie.session import spread

from .quality_holdout import CALIBRATION
from .textstats import STATS, statistics

KINDS = ("prose", "list", "table", "junk")


def weak_label(s: dict[str, float]) -> str | None:
    """The kind of a document by rules that are sure, else None."""
    junk = s["symbol_ratio"] > 0.15 and s["mean_word_length"] < 3 and s["cell_share"] < 0.5 or s["run_length"] > 40 and s["n_chars"] > 80 or s["letter_ratio"] < 0.3 and s["cell_share"] < 0.5 or s["odd_ratio"] > 0.08 or s["code_ratio"] > 0.12 or (s["n_words"] >= 25 and s["repeat_share"] > 0.9 and s["distinct_word_share"] < 0.1 and s["item_share"] + s["short_share"] < 0.5)
    # letters at random: hardly a vowel, consonants in rows, no frequent word of any language
    junk = junk or s["n_words"] >= 8 and s["common_word_share"] < 0.05 and s["vowel_ratio"] < 0.3 and s["cluster_share"] > 0.1
    if junk:
        return "junk"
    if s["cell_share"] >= 0.7:
        return "table"
    if s["item_share"] + s["head_share"] >= 0.7 and s["n_lines"] >= 3:
        return "list"
    if s["short_share"] >= 0.9 and s["n_lines"] >= 5 and s["ended_line_share"] < 0.2:
        return "list"
    if s["long_share"] >= 0.85 and s["odd_ratio"] < 0.02 and s["code_ratio"] < 0.05 and s["letter_ratio"] > 0.7 and s["repeat_share"] < 0.5:
        return "prose"
    return None


class BoostedTrees:
    """Softmax gradient boosting of depth-limited trees on binned features."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32, leaf: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.leaf = rounds, depth, rate, bins, leaf
        self.temperature = 1.0

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (self.depth + 1) - 1
        feature, cutoff, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        node = np.zeros(len(b), np.int64)
        for k in range(size):
            rows = np.flatnonzero(node == k)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[k] = -gs / (hs + self.leaf)
            if k >= 2**self.depth - 1 or len(rows) < 8:
                continue
            best = (1e-6, -1, 0)
            for f in range(b.shape[1]):
                gl = np.bincount(b[rows, f], weights=g[rows], minlength=self.bins).cumsum()[:-1]
                hl = np.bincount(b[rows, f], weights=h[rows], minlength=self.bins).cumsum()[:-1]
                gain = gl**2 / (hl + self.leaf) + (gs - gl) ** 2 / (hs - hl + self.leaf) - gs**2 / (hs + self.leaf)
                c = int(gain.argmax())
                if gain[c] > best[0] + 1e-9:
                    best = (float(gain[c]), f, c)
            if best[1] >= 0:
                feature[k], cutoff[k] = best[1], best[2]
                node[rows] = 2 * k + 1 + (b[rows, best[1]] > best[2])
        return feature, cutoff, value

    def _leaves(self, b: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cutoff, value = tree
        node = np.zeros(len(b), np.int64)
        for _ in range(self.depth):
            f = feature[node]
            go = f >= 0
            node = np.where(go, 2 * node + 1 + (b[np.arange(len(b)), np.maximum(f, 0)] > cutoff[node]), node)
        return value[node]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int) -> "BoostedTrees":
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        b = self.binned(x)
        weight = 1.0 / np.bincount(y, minlength=classes).clip(1)[y]
        weight *= len(y) / weight.sum()
        score = np.zeros((len(y), classes))
        self.trees: list[list] = []
        for _ in range(self.rounds):
            p = _softmax(score)
            row = []
            for c in range(classes):
                tree = self._tree(b, weight * (p[:, c] - (y == c)), weight * p[:, c] * (1 - p[:, c]) + 1e-9)
                score[:, c] += self.rate * self._leaves(b, tree)
                row.append(tree)
            self.trees.append(row)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.zeros((len(x), len(self.trees[0])))
        for row in self.trees:
            for c, tree in enumerate(row):
                out[:, c] += self.rate * self._leaves(b, tree)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        """The temperature of least log loss on checked texts."""
        raw = self.raw(x)
        grid = np.geomspace(0.25, 8, 41)
        loss = [-np.log(_softmax(raw / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.raw(x) / self.temperature)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def checked(texts: list[tuple[str, str]] = CALIBRATION) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and kinds of texts whose kind was checked by hand."""
    return statistics([t for _, t in texts]), np.array([KINDS.index(k) for k, _ in texts])


def fit_quality_model(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 8000) -> BoostedTrees:
    """Trees fitted on the surely labelled of about `sample` documents, calibrated on the checked texts."""
    known = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    n = known.count()
    scale = 1 << 20
    picked = known.where(F.pmod(F.xxhash64("k"), F.lit(scale)) < min(1.0, sample / max(1, n)) * scale)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            stats = statistics(list(pdf["t"]))
            labels = [weak_label(dict(zip(STATS, s, strict=True))) if s[1] or s[0] else None for s in stats]
            keep = [(*s, KINDS.index(c)) for s, c in zip(stats, labels, strict=True) if c and s[2]]
            yield pd.DataFrame(keep, columns=[*STATS, "kind"])

    rows = spread(picked).mapInPandas(run, ", ".join(f"{c} double" for c in STATS) + ", kind long").toPandas()  # at most about `sample` rows of numbers
    hx, hy = checked()
    x, y = rows[list(STATS)].to_numpy(float), rows["kind"].to_numpy(int)
    if len(set(y)) < len(KINDS):  # too little to learn from: the checked texts take part
        x, y = np.concatenate([x.reshape(-1, len(STATS)), hx]), np.concatenate([y, hy])
    order = np.lexsort(x.T)  # the model doesn't depend on the order of rows
    return BoostedTrees().fit(x[order], y[order], len(KINDS)).calibrate(hx, hy)


def text_quality(docs: DataFrame, model: BoostedTrees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, statistics..., kind, confidence) for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred small trees

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for pdf in parts:
            x = statistics(list(pdf["t"]))
            p = m.probabilities(x) if len(x) else np.zeros((0, len(KINDS)))
            best = p.argmax(axis=1)
            blank = x[:, STATS.index("n_lines")] == 0
            out = pd.DataFrame({key: pdf["k"].to_numpy()})
            for i, c in enumerate(STATS):
                out[c] = np.round(x[:, i], 6)
            out["kind"] = np.where(blank, "blank", np.array(KINDS, dtype=object)[best])
            out["confidence"] = np.where(blank, 1.0, np.round(p[np.arange(len(p)), best], 4))
            yield out

    flat = spread(docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")))
    kind = flat.schema["k"].dataType.simpleString()
    return flat.mapInPandas(run, f"`{key}` {kind}, " + ", ".join(f"{c} double" for c in STATS) + ", kind string, confidence double")
