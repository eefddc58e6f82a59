"""Problem 5: near-duplicate records with small edits.

Two texts are near duplicates if their sets of 5-character substrings (trimmed, lower-cased, white space runs as
one space) have a Jaccard similarity of at least 0.8.

Method: a Gray-order hierarchical index (gray_index.py). A fingerprint is 80 minwise bytes and 128 one-bit minwise
hashes of the grams. Each of 20 permutations puts four of the bytes first and turns the bits, so that other bits come
next; the permuted fingerprints are ordered by Gray rank over the whole collection, in ranges. Fingerprints with the
same leading bytes are neighbours there, wherever they are stored: they are a top node, and below it the nodes share
8, 16, 32, 64 and 128 bits. Pairs of nodes are dropped as soon as their accumulated differences exceed what texts of
the threshold's similarity show behind such a mask. What is left is verified exactly, so nothing false is returned.

Recall: a pair of similarity s shares a permutation's top node with probability s^4, and passes its upper nodes with
one of 0.96 at 0.8 and more above; 20 permutations lose about 4e-5 of the pairs at exactly 0.8, 1e-6 at 0.85. The
tests measure it against brute force.

Scale: exact copies are folded to one class by a 128-bit key before anything is compared. Fingerprints travel in
packed blocks of 28 bytes per permutation; the number of ranges grows with the rows. A pattern that very many rows
share is cut into blocks before it is shuffled (if a thousandth of all rows share it) or by the task that meets it,
and pairs of blocks go to different tasks; no row is dropped. Only involved texts are fetched for the check.

Defined results: null and blank texts are no case; texts shorter than five characters are their own only gram;
rows repeated for one id count once; null ids are left out; further columns are ignored. Classes of up to
`full` copies are expanded to all their pairs; a larger class is given as its smallest id paired with each copy,
and other texts are paired with its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cowrie.functions.grams import gram_hashes, gram_set, mixed, plain, text_key
from cowrie.session import cut, partitions, spread

from .gray_index import GrayIndex, difference_budgets, gray_rank

ROWS, BANDS, BITS = 4, 20, 128
BINS = ROWS * BANDS


def _minima(h: np.ndarray, owner: np.ndarray, n: int, bins: int, salt: int) -> np.ndarray:
    """(n, bins): one-permutation minwise values, empty bins filled from others by a fixed probing order."""
    v = mixed(h, salt)
    cell = owner * bins + (v >> np.uint64(40)).astype(np.int64) % bins
    low = np.full(n * bins, 0xFFFFFFFF, dtype=np.uint32)
    key = (cell.astype(np.uint64) << np.uint64(32)) | (v & np.uint64(0xFFFFFFFE))
    key.sort()
    where = (key >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.zeros(0, np.int64)
    low[where[first]] = (key[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    low = low.reshape(n, bins)
    full = low != 0xFFFFFFFF
    some = full.any(axis=1)
    row, col = np.nonzero(~full & some[:, None])
    out, turn = low.copy(), 0
    while len(row):
        turn += 1
        at = (mixed(col.astype(np.uint64) * np.uint64(1000003) + np.uint64(turn), salt + 1) >> np.uint64(33)).astype(np.int64) % bins
        hit = full[row, at]
        out[row[hit], col[hit]] = low[row[hit], at[hit]]
        row, col = row[~hit], col[~hit]
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """(n, 96) bytes: 80 minwise bytes and 128 one-bit minwise hashes of plain texts."""
    h, owner = gram_hashes(texts)
    n = len(texts)
    a = _minima(h, owner, n, BINS, 1)
    b = _minima(h, owner, n, BITS, 3)
    tail = np.packbits((mixed(b.astype(np.uint64), 5) & np.uint64(1)).astype(bool), axis=1)
    return np.concatenate([(mixed(a.astype(np.uint64), 6) & np.uint64(255)).astype(np.uint8), tail], axis=1)


def _patterns(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) 64-bit keys of the masked patterns."""
    words = sig[:, :BINS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    value = (words << (np.arange(ROWS, dtype=np.uint64) * np.uint64(8))).sum(axis=2, dtype=np.uint64)
    return mixed(value + (np.arange(BANDS, dtype=np.uint64) << np.uint64(32)), 8)


def text_signatures(df: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """(field, id, h1, h2, sig) of every text that isn't null or blank."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for i, c in enumerate(columns):
                for at in range(0, len(pdf), 2500):
                    some = pdf.iloc[at : at + 2500]
                    texts, ids = [], []
                    for k, t in zip(some["id"], some[f"c{i}"], strict=True):
                        if t is not None and (p := plain(t)):
                            texts.append(p)
                            ids.append(k)
                    if not texts:
                        continue
                    keys = np.array([text_key(t) for t in texts], dtype=np.int64)
                    yield pd.DataFrame({"field": np.int32(i), "id": ids, "h1": keys[:, 0], "h2": keys[:, 1], "sig": [r.tobytes() for r in fingerprints(texts)]})

    flat = df.select(F.col(f"`{key}`").cast("string").alias("id"), *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)]).where("id is not null")
    return spread(flat).mapInPandas(run, "field int, id string, h1 long, h2 long, sig binary")


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pattern keys with the field mixed in, and the signatures."""
    sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint8).reshape(len(pdf), BINS + BITS // 8)
    return mixed(_patterns(sig) + pdf["field"].to_numpy().astype(np.uint64)[:, None], 9), sig


ENTRY = np.dtype([("key", "<u4"), ("cls", "<i8"), ("bits", "<u8", (2,))])
#: By how many bytes each permutation turns the bits.
_TURNS = np.arange(BANDS) * 7 % (BITS // 8)


def _entries(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit pattern keys, entries without key) of all permutations of all rows, BANDS per row."""
    key, sig = _arrays(pdf)
    row, turn = np.repeat(np.arange(len(pdf)), BANDS), np.tile(_TURNS, len(pdf))
    at = BINS + (np.arange(BITS // 8)[None, :] + turn[:, None]) % (BITS // 8)
    entry = np.empty(len(row), dtype=ENTRY)
    entry["cls"] = pdf["h1"].to_numpy()[row]
    entry["bits"] = sig[row[:, None], at].view(">u8")
    return key.ravel(), entry


def _blocked(key: np.ndarray, entry: np.ndarray, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A crowded pattern's entries, each for every pair of blocks that its own block is in."""
    own = (mixed(entry["cls"].view(np.uint64), 11) % np.uint64(blocks)).astype(np.int64)
    for other in range(blocks):
        low, high = np.minimum(own, other), np.maximum(own, other)
        yield mixed(key + (low * blocks + high).astype(np.uint64), 12), entry


def _packed(key: np.ndarray, entry: np.ndarray, parts: int) -> pd.DataFrame:
    """(part, entries): entries by range of their key's Gray rank, in the order of the ranks."""
    rank = gray_rank(np.zeros_like(key), key)[1]
    part = ((rank >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    entry = entry.copy()
    entry["key"] = (rank & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    order = np.argsort(part, kind="stable")
    entry, part = entry[order], part[order]
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    stop = np.concatenate([edge[1:], [len(part)]]).astype(np.int64)
    return pd.DataFrame({"part": part[edge], "entries": [entry[a:b].tobytes() for a, b in zip(edge, stop, strict=True)]})


def near_entries(entry: np.ndarray, budgets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """((pairs, 2) distinct pairs of classes that the index finds near, comparisons at each level)."""
    order = np.argsort(entry["key"], kind="stable")
    k = entry["key"][order]
    same = np.zeros(len(order), dtype=bool)
    same[1:] = k[1:] == k[:-1]
    same[:-1] |= same[1:]
    entry = entry[order[same]]  # a pattern that one row has pairs nothing
    cls, bits = entry["cls"], entry["bits"]
    index = GrayIndex(entry["key"], np.ascontiguousarray(bits[:, 0]), np.ascontiguousarray(bits[:, 1]))
    found = [np.unique(np.stack([np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y])], axis=1), axis=0) for x, y in index.self_join(budgets)]
    both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return both[both[:, 0] != both[:, 1]], index.compared


def _crowded(sigs: DataFrame, total: int, crowd: int, share: float = 1e-3) -> dict[int, int]:
    """Patterns that hold more than `crowd` rows and a thousandth of all, with their counts. A pattern of that share
    has it in some batch, so each batch reports those alone: at most 1000 x BANDS patterns can qualify."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                k, n = np.unique(_arrays(pdf)[0], return_counts=True)
                some = n >= max(2, share * len(pdf))
                yield pd.DataFrame({"k": k[some].view(np.int64), "n": n[some]})

    found = sigs.select("field", "sig").mapInPandas(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") > max(crowd, share * total))
    return {r["k"]: r["n"] for r in found.collect()}


def candidate_pairs(sigs: DataFrame, threshold: float = 0.8, per_task: int = 250_000, crowd: int = 20_000) -> DataFrame:
    """(a, b): distinct pairs of text classes (h1) that the index finds near. sigs as of text_signatures.

    crowd: rows of one pattern that a task compares at once; more are compared block by block in other tasks."""
    spark = sigs.sparkSession
    total = sigs.count()
    parts = partitions(sigs, -(-total * BANDS // per_task))
    crowded = spark.sparkContext.broadcast(_crowded(sigs, total, crowd))
    budgets = difference_budgets((1 - threshold) / 2)
    classes = sigs.groupBy("field", "h1", "h2").agg(F.min_by("sig", "id").alias("sig")).select("field", "h1", "sig")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def packed(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, entry = _entries(pd.concat(held))
            many = crowded.value
            if many:
                hot = np.isin(key, np.array(list(many), dtype=np.int64).view(np.uint64))
                for k in np.unique(key[hot]):
                    mine = key == k
                    for names, rows in _blocked(key[mine], entry[mine], -(-2 * many[int(k.view(np.int64))] // crowd)):
                        yield _packed(names, rows, parts)
                key, entry = key[~hot], entry[~hot]
            yield _packed(key, entry, parts)

        held, n = [], 0
        for pdf in batches:
            if len(pdf):
                held.append(pdf)
                n += len(pdf)
            if n >= 50_000:
                yield from packed(held)
                held, n = [], 0
        if held:
            yield from packed(held)

    def searched_in(pdf: pd.DataFrame, late: bool) -> pd.DataFrame:
        entry = np.concatenate([np.frombuffer(x, dtype=ENTRY) for x in pdf["entries"]])
        left = []
        if not late:  # patterns too large for this task are passed on
            k, at, n = np.unique(entry["key"], return_inverse=True, return_counts=True)
            for j in np.flatnonzero(n > 2 * crowd):
                rows = entry[at == j]
                left += [(int(n[j]), int(pdf["part"].iloc[0]), rows[i : i + crowd].tobytes()) for i in range(0, len(rows), crowd)]
            entry = entry[(n <= 2 * crowd)[at]]
        both, _ = near_entries(entry, budgets)
        out = pd.DataFrame({"a": both[:, 0], "b": both[:, 1], "n": 0, "part": 0, "entries": None})
        more = pd.DataFrame(left, columns=["n", "part", "entries"]).assign(a=0, b=0)
        return pd.concat([out, more[out.columns]]) if left else out

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        return searched_in(pdf, False)

    def search_late(pdf: pd.DataFrame) -> pd.DataFrame:
        return searched_in(pdf, True)

    def emit_late(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, part, packed in zip(pdf["n"], pdf["part"], pdf["entries"], strict=True):
                entry = np.frombuffer(packed, dtype=ENTRY)
                key = mixed(entry["key"].astype(np.uint64) + (np.uint64(part) << np.uint64(32)), 13)
                for names, rows in _blocked(key, entry, -(-2 * n // crowd)):
                    yield _packed(names, rows, late_parts)

    schema = "a long, b long, n long, part long, entries binary"
    # field is part of the pattern's key; which field a pair belongs to is told by its classes
    blocks = classes.mapInPandas(emit, "part int, entries binary")
    searched = cut(blocks.repartitionById(parts, "part").groupBy("part").applyInPandas(search, schema), "searched")
    rest = searched.where("entries is not null")
    late_parts = partitions(sigs, -(-int(rest.select(F.coalesce(F.sum(F.ceil(F.length("entries") / ENTRY.itemsize) * F.ceil(2 * F.col("n") / crowd)), F.lit(0))).first()[0]) // per_task))
    again = rest.select("n", "part", "entries").mapInPandas(emit_late, "part int, entries binary").repartitionById(late_parts, "part").groupBy("part").applyInPandas(search_late, schema)
    return searched.where("entries is null").unionByName(again).select("a", "b").distinct()


@F.pandas_udf(T.DoubleType())
def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        p, q = gram_set(plain(x)), gram_set(plain(y))
        both = len(p & q)
        out.append(both / (len(p) + len(q) - both))
    return pd.Series(out, dtype="float64")


class NearDuplicates:
    """links: (field, a, b, similarity) between classes (smallest ids), a < b; copies: (field, class, id) of all
    members of classes that have links or copies."""

    def __init__(self, links: DataFrame, members: DataFrame) -> None:
        self.links, self.members = links, members

    def pairs(self, full: int = 16) -> DataFrame:
        """(field, id_a, id_b): see the module's docstring for large classes of copies."""
        counts = self.members.groupBy("field", "class").agg(F.count("*").alias("n"))  # a hot class is summed where it lies
        sized = self.members.join(counts, ["field", "class"])
        shown = sized.where((F.col("n") <= full) | (F.col("id") == F.col("class"))).select("field", "class", "id")
        a = shown.select("field", F.col("class").alias("a"), F.col("id").alias("x"))
        b = shown.select("field", F.col("class").alias("b"), F.col("id").alias("y"))
        across = self.links.join(a, ["field", "a"]).join(b, ["field", "b"]).select("field", "x", "y")
        few = sized.where(f"n between 2 and {full}").select("field", "class", "id")
        inside = few.withColumnRenamed("id", "x").join(few.withColumnRenamed("id", "y"), ["field", "class"]).where("x < y").select("field", "x", "y")
        star = sized.where(f"n > {full} and id <> class").select("field", F.col("class").alias("x"), F.col("id").alias("y"))
        both = across.unionByName(inside).unionByName(star)
        return both.select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicates(df: DataFrame, columns: list[str], key: str = "id", threshold: float = 0.8) -> NearDuplicates:
    """Near duplicates within each column of df."""
    sigs = cut(text_signatures(df, columns, key), "signatures")
    found = cut(candidate_pairs(sigs, threshold), "near")
    ids = sigs.select("field", "id", "h1", "h2")
    wanted = found.select(F.explode(F.array("a", "b")).alias("h1")).distinct()
    copied = ids.groupBy("field", "h1", "h2").agg(F.min("id").alias("class"), F.max("id").alias("high"))
    involved = copied.join(wanted.withColumn("linked", F.lit(True)), "h1", "left").where("linked or class <> high").select("field", "h1", "h2", "class", F.coalesce("linked", F.lit(False)).alias("linked"))
    involved = cut(involved, "classes")
    members = cut(ids.join(involved.drop("linked"), ["field", "h1", "h2"]).select("field", "class", "id").distinct(), "members")
    # texts of linked classes, fetched by their smallest id
    reps = involved.where("linked").select("field", "h1", F.col("class").alias("id"))
    texts = F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"`{c}`").cast("string").alias("text")) for i, c in enumerate(columns)])
    source = df.select(F.col(f"`{key}`").cast("string").alias("id"), *[F.col(f"`{c}`") for c in columns])
    source = source.join(reps.select("id").distinct(), "id", "left_semi").select("id", F.explode(texts).alias("t")).select("id", "t.field", "t.text").where("text is not null")
    held = cut(reps.join(source, ["field", "id"]).dropDuplicates(["field", "id"]), "texts")
    one = held.select(F.col("h1").alias("a"), "field", F.col("id").alias("x"), F.col("text").alias("t"))
    two = held.select(F.col("h1").alias("b"), "field", F.col("id").alias("y"), F.col("text").alias("u"))
    checked = found.join(one, "a").join(two, ["b", "field"]).where("x <> y").withColumn("similarity", _jaccard("t", "u")).where(F.col("similarity") >= threshold - 1e-12)
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("field") + 1)
    links = cut(checked.select(name.alias("field"), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity"), "links")
    return NearDuplicates(links, members.withColumn("field", name))
