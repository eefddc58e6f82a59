"""Exact set-similarity join of texts on character n-grams, and what the pipeline builds on it: near-duplicate pairs
and the removal of later near duplicates.

Prefix filter: grams are ordered from rare to frequent; two sets with a Jaccard similarity of t share one of their
first n - ceil(t n) + 1 grams. Sizes must be within the ratio, the places of the shared gram must leave room for the
overlap (the smaller set's place is then among its first few), and a 256-bit parity sketch may not show more
differences than the sets can have. No filter loses a pair; survivors are verified on their grams.

A set of texts meets itself by classes of grams (`own_candidates`): the hash of a gram puts it in one of k classes, and
as the similarity of two sets is a mean, weighted by size, of that of their classes, one class with a shared gram is at
least as similar as they are. The filters above then hold within the class, where 64 bits of sketch tell texts of any
length apart, so that hardly a pair but the similar ones is found. k follows from the size of the smaller set, by
ranges of sizes; a text takes part in its own range and in those whose sets may be its smaller partners. Ranges are
searched one after the other as far as their entries would take much room, and each shuffle is removed once searched.

Scale: rarity comes from counts in 2^18 hash buckets, a table of fixed size; crowded grams are salted, left rows
spread over salts and right rows sent to each; meetings are searched in sorted arrays and never listed by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cowrie.functions.grams import TOGETHER, distinct_grams, gram_hashes, mixed, plain, similarities, text_key
from cowrie.session import cut, drop, partitions, spread

BUCKETS, CHUNK, BATCH = 1 << 18, 1 << 12, TOGETHER
ENTRY = np.dtype([("key", "<u4"), ("size", "<u4"), ("place", "<u4"), ("left", "<u4"), ("cls", "<i8"), ("bits", "<u8", (4,))])


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def gram_counts(texts: DataFrame, n: int) -> np.ndarray:
    """In how many texts the grams of each bucket occur, summed: BUCKETS numbers."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(BUCKETS, dtype=np.int64)
        for pdf in parts:
            for at in range(0, len(pdf), BATCH):
                sums += np.bincount(_bucket(distinct_grams(list(pdf["text"].iloc[at : at + BATCH]), n)[0]), minlength=BUCKETS)
        for k in range(BUCKETS // CHUNK):
            part = sums[k * CHUNK : (k + 1) * CHUNK]
            if part.any():
                yield pd.DataFrame({"chunk": [k], "sums": [part.tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in pdf["sums"])
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1].to_numpy(), "sums": [total.tobytes()]})

    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in texts.select("text").mapInPandas(count, "chunk int, sums binary").groupBy("chunk").applyInPandas(add, "chunk int, sums binary").collect():  # BUCKETS / CHUNK rows
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["sums"], dtype=np.int64)
    return out


def parity_sketch(h: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """(texts, 4) words: the parity of each text's grams in 256 cells; sets that differ in d grams differ in at most d
    cells."""
    cell = owner * 256 + (mixed(h, 21) >> np.uint64(56)).astype(np.int64)
    odd = (np.bincount(cell, minlength=texts * 256) & 1).astype(bool).reshape(texts, 256)
    return np.packbits(odd, axis=1).view(np.uint64)


def rarity(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each bucket from rare to frequent, bucket at each place)."""
    order = np.argsort(counts, kind="stable")
    rank = np.empty(BUCKETS, dtype=np.uint64)
    rank[order] = np.arange(BUCKETS, dtype=np.uint64)
    return rank, order.astype(np.uint64)


def prefixes(texts: list[str], rank: tuple[np.ndarray, np.ndarray], threshold: float, n: int) -> tuple[np.ndarray, ...]:
    """(gram, text, place) of all prefix grams, the rarest first in each text; sizes and sketches of the texts. At most
    TOGETHER texts: one sort of (text, rarity of the bucket, rest of the hash) both finds the distinct grams and puts
    them in order."""
    h, owner = gram_hashes(texts, n)
    place, bucket = rank
    rest = np.uint64((1 << 36) - 1)
    key = (owner.astype(np.uint64) << np.uint64(54)) | (place[_bucket(h)] << np.uint64(36)) | ((h >> np.uint64(10)) & rest)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    owner = (key >> np.uint64(54)).astype(np.int64)
    h = (bucket[((key >> np.uint64(36)) & np.uint64(BUCKETS - 1)).astype(np.int64)] << np.uint64(46)) | ((key & rest) << np.uint64(10))
    size = np.bincount(owner, minlength=len(texts))
    at = np.arange(len(h)) - (np.cumsum(size) - size)[owner]
    keep = at < (size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1)[owner]
    return h[keep], owner[keep], at[keep], size, parity_sketch(h, owner, len(texts))


def _differences(ours: np.ndarray, theirs: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many cells the sketches of rows x and y differ."""
    cells = np.bitwise_count(ours[x] ^ theirs[y])
    total = cells[:, 0].astype(np.int16)
    for k in range(1, cells.shape[1]):
        total += cells[:, k]
    return total


def meetings(entry: np.ndarray, threshold: float, block: int = 1 << 17) -> np.ndarray:
    """Distinct (right class, left class) of the entries of one task that pass all filters."""
    key, size, place, cls = (np.ascontiguousarray(entry[f]) for f in ("key", "size", "place", "cls"))
    code = (key.astype(np.uint64) << np.uint64(16)) | np.minimum(size, 0xFFFF).astype(np.uint64)
    order = np.argsort(code)
    code, size, place, cls = code[order], size[order].astype(np.int32), place[order].astype(np.int32), cls[order]
    bits = entry["bits"][order]
    left = (entry["left"] == 1)[order]
    share = threshold / (1 + threshold)
    found = []
    for small in (0, 1):  # the smaller set of a pair is on this side; of equal sizes, the right one
        other = np.flatnonzero(left != (small == 1))
        # the shared gram's place leaves the smaller set room for the overlap with sets of up to `most` grams
        s = size.astype(np.int64)
        most = np.minimum(np.floor(s / threshold + 1e-9), np.floor((s - place) / share + 1e-9) - s).astype(np.int64)
        own = np.flatnonzero((left == (small == 1)) & (most >= s + small))
        if not len(own) or not len(other):
            continue
        codes, base = code[other], code[own] & ~np.uint64(0xFFFF)
        low = np.searchsorted(codes, base | np.minimum(s[own] + small, 0xFFFF).astype(np.uint64), side="left")
        high = np.searchsorted(codes, base | np.minimum(most[own], 0xFFFF).astype(np.uint64), side="right")
        some = high > low
        own, low, count = own[some], low[some], (high - low)[some]
        apart = np.minimum(np.floor((1 - 2 * share) * (s[own] + most[own]) + 1e-9), 256).astype(np.int16)  # the most grams, so cells, that such sets differ in
        ours, theirs = bits[own], bits[other]
        edge = np.concatenate([[0], np.cumsum(count)])
        at = 0
        while at < len(own):
            stop = max(at + 1, int(np.searchsorted(edge, edge[at] + block, side="right")) - 1)
            n = count[at:stop]
            x = np.repeat(np.arange(at, stop), n)
            y = np.arange(edge[stop] - edge[at]) + np.repeat(low[at:stop] - (edge[at:stop] - edge[at]), n)
            differ = _differences(ours, theirs, x, y)
            ok = differ <= np.repeat(apart[at:stop], n)
            x, y, differ = own[x[ok]], other[y[ok]], differ[ok]
            sx, sy = size[x].astype(np.int64), size[y].astype(np.int64)
            needed = np.ceil(share * (sx + sy) - 1e-9).astype(np.int64)
            room = np.minimum(sx - place[x], sy - place[y])
            ok = (room >= needed) & (sx >= threshold * sy - 1e-9) & (sx <= sy) & (differ <= sx + sy - 2 * needed)
            a, b = cls[x[ok]], cls[y[ok]]
            found.append(np.unique(np.stack([a, b] if small == 0 else [b, a], axis=1), axis=0))
            at = stop
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


#: Grams in a class of the largest sets of a range, at most; ratio of a range's ends, but for the first, whose sets are all one class; bits that tell classes.
IN_CLASS, WIDTH, CLASS_BITS = 90, 1.3, 12
OWN = [("key", "<u4"), ("size", "<u4"), ("part", "<u4"), ("bits", "<u8"), ("cls", "<i8")]


def size_ranges(largest: int) -> list[tuple[int, int, int]]:
    """(first size, size after the last, k) of the ranges up to the largest size."""
    out, low, high = [], 1, IN_CLASS + 1
    while low <= largest:
        k = 1
        while (high - 1) / k > IN_CLASS and k < 1 << CLASS_BITS:
            k *= 2
        out.append((low, high, k))
        low, high = high, int(high * WIDTH) + 1
    return out


def class_prefixes(h: np.ndarray, owner: np.ndarray, k: int, rank: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """(gram, owner, size of the owner's class, its sketch) of the prefix grams of all classes, given distinct grams
    (distinct_grams) and the place of each bucket. The gram's low bits are its class."""
    shift = np.uint64(64 - 10 - CLASS_BITS)
    key = (owner.astype(np.uint64) << np.uint64(54)) | (((h >> np.uint64(10)) & np.uint64(k - 1)) << shift)
    key |= (rank[_bucket(h)] << np.uint64(24)) | ((h >> np.uint64(10 + CLASS_BITS)) & np.uint64((1 << 24) - 1))
    order = np.argsort(key)
    key, h = key[order], h[order]
    of = key >> shift
    start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(start, len(of)))
    bits = np.bitwise_xor.reduceat(np.uint64(1) << (mixed(h, 21) >> np.uint64(58)), start) if len(of) else np.zeros(0, np.uint64)
    keep = np.arange(len(of)) - np.repeat(start, sizes) < np.repeat(sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1, sizes)
    return h[keep], (key[keep] >> np.uint64(54)).astype(np.int64), np.repeat(sizes, sizes)[keep], np.repeat(bits, sizes)[keep]


#: Columns of entries whose bytes are written plane by plane: their high bytes are mostly zero and are compressed away.
PLANES = ("size", "part")


def packed_column(x: np.ndarray, name: str) -> bytes:
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes() if name in PLANES else x.tobytes()


def unpacked_column(b: bytes, name: str, kind: str) -> np.ndarray:
    if name not in PLANES:
        return np.frombuffer(b, dtype=kind)
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


def own_meetings(entry: dict[str, np.ndarray], threshold: float, below: int, block: int = 1 << 17) -> np.ndarray:
    """Distinct (smaller class, larger class) of the entries of one task that pass all filters, if the smaller set has
    less than `below` grams. entry: arrays by the names of OWN."""
    code = (entry["key"].astype(np.uint64) << np.uint64(32)) | entry["size"].astype(np.uint64)
    order = np.argsort(code)
    code, size, part, bits, cls = code[order], entry["size"][order].astype(np.int64), entry["part"][order].astype(np.int32), entry["bits"][order], entry["cls"][order]
    most = np.floor(size / threshold + 1e-9).astype(np.uint64)
    low = np.arange(1, len(code) + 1)
    count = np.searchsorted(code, (code & ~np.uint64(0xFFFFFFFF)) | most, side="right") - low
    own = np.flatnonzero((size < below) & (count > 0))
    low, count = low[own], count[own]
    edge = np.concatenate([[0], np.cumsum(count)])
    share = threshold / (1 + threshold)
    wide = np.minimum(part[own] / threshold + 1e-9, 1 << 30).astype(np.int64)  # the largest class that such a class is similar to
    apart = np.minimum(np.floor((1 - 2 * share) * (part[own] + wide) + 1e-6), 64).astype(np.uint8)
    ours = bits[own]
    found, at = [np.zeros((0, 2), np.int64)], 0
    while at < len(own):
        stop = max(at + 1, int(np.searchsorted(edge, edge[at] + block, side="right")) - 1)
        n = count[at:stop]
        y = np.arange(edge[stop] - edge[at]) + np.repeat(low[at:stop] - (edge[at:stop] - edge[at]), n)
        differ = np.bitwise_count(np.repeat(ours[at:stop], n) ^ bits[y])
        some = np.flatnonzero(differ <= np.repeat(apart[at:stop], n))
        x, y, differ = own[at + np.searchsorted(edge[at + 1 : stop + 1] - edge[at], some, side="right")], y[some], differ[some]
        sx, sy = part[x], part[y]
        needed = np.ceil(share * (sx + sy) - 1e-9).astype(np.int64)
        ok = (np.minimum(sx, sy) >= threshold * np.maximum(sx, sy) - 1e-9) & (differ <= sx + sy - 2 * needed) & (cls[x] != cls[y])
        x, y = cls[x[ok]], cls[y[ok]]
        found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0))
        at = stop
    return np.unique(np.concatenate(found), axis=0)


def gram_sizes(n: int = 5):
    """Arrow function of a plain text: the number of its distinct grams."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(distinct_grams(list(texts), n)[2], dtype="int64")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.LongType())


def own_candidates(texts: DataFrame, threshold: float, n: int = 5, per_task: int = 400_000, crowd: int = 200_000, room: float = 0.8, least: int = 4_000_000) -> DataFrame:
    """(r, l), r < l: pairs of classes that pass all filters, each once. texts: (cls long, text, size long), of which
    size, the number of distinct grams, is made if it is missing. Ranges are searched together up to `least` entries, or
    `room` bytes of entries for each character of the texts."""
    if "size" not in texts.columns:
        texts = cut(texts.select("cls", "text", gram_sizes(n)("text").alias("size")), "sized")
    top = texts.agg(F.max("size").alias("top"), F.sum(F.length("text")).alias("chars")).first()
    ranges = size_ranges(top["top"] or 0)
    # rows of each range: (its number, sum of sizes, texts); a row takes part while the smallest partner is in the range
    lows = F.array(*[F.lit(a) for a, _, _ in ranges]) if ranges else F.array(F.lit(1))
    highs = F.array(*[F.lit(int((b - 1) / threshold + 1e-9)) for _, b, _ in ranges]) if ranges else F.array(F.lit(0))
    takes = F.filter(F.sequence(F.lit(0), F.lit(max(0, len(ranges) - 1))), lambda i: (F.get(lows, i) <= F.col("size")) & (F.get(highs, i) >= F.col("size")))
    held = {r["i"]: (r["grams"], r["texts"]) for r in texts.select("size", F.explode(takes).alias("i")).groupBy("i").agg(F.sum("size").alias("grams"), F.count("*").alias("texts")).collect()}  # a row a range
    table = gram_counts(texts, n)
    counts = texts.sparkSession.sparkContext.broadcast(table)  # BUCKETS numbers
    jobs, bulk = [], 0
    for i, (low, high, k) in enumerate(ranges):
        if i not in held:
            continue
        entries = int((1 - threshold) * held[i][0] + k * held[i][1])
        if not jobs or bulk + entries > max(least, room * (top["chars"] or 0) / sum(np.dtype(t).itemsize for _, t in OWN)):
            jobs.append([])
            bulk = 0
        bulk += entries
        jobs[-1].append((i, low, high, k, max(1, -(-entries // per_task))))
    found = [cut(_met(texts, counts, job, threshold, n, crowd), "met", free=True) for job in jobs]
    out = texts.sparkSession.createDataFrame([], "r long, l long") if not found else found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out  # a pair is in the range of its smaller set only


def _met(texts: DataFrame, counts, job: list[tuple[int, ...]], threshold: float, n: int, crowd: int) -> DataFrame:
    """Pairs of the ranges (number, first size, size after the last, k, tasks) of one job."""
    firsts = np.cumsum([0, *[tasks for *_, tasks in job]])
    parts = max(partitions(texts), int(firsts[-1]))
    reach = lambda high: int((high - 1) / threshold + 1e-9)

    def packed(pdf: pd.DataFrame, table: np.ndarray, rank: np.ndarray) -> Iterator[pd.DataFrame]:
        h, owner, size = distinct_grams(list(pdf["text"]), n)
        cls = pdf["cls"].to_numpy()
        for (i, low, high, k, tasks), first in zip(job, firsts, strict=False):
            mine = ((size >= low) & (size <= reach(high)))[owner]
            if not mine.any():
                continue
            gram, own, part, bits = class_prefixes(h[mine], owner[mine], k, rank, threshold)
            salts = np.maximum(1, -(-table[_bucket(gram)] // crowd))
            which = np.repeat(np.arange(len(gram)), salts)
            salt = (np.arange(len(which)) - np.repeat(np.cumsum(salts) - salts, salts)).astype(np.uint64)
            drawn = (mixed(cls[own].view(np.uint64), 22) % salts.astype(np.uint64))[which]  # a row is in every pair of salts that has its own
            salt = np.minimum(salt, drawn) * salts[which].astype(np.uint64) + np.maximum(salt, drawn)
            g = mixed(gram[which] + salt * np.uint64(0x9E3779B97F4A7C15), 23 + i)
            target = first + ((g & np.uint64(0xFFFFFFFF)) % np.uint64(tasks)).astype(np.int64)
            key = (g >> np.uint64(32)).astype("<u4")
            order = np.argsort(target, kind="stable")  # a text's entries stay together: what they share is compressed away
            target, which, key = target[order], which[order], key[order]
            columns = {"key": key, "size": size[own[which]], "part": part[which], "bits": bits[which], "cls": cls[own[which]]}
            edge = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            stop = np.append(edge[1:], len(target))
            yield pd.DataFrame({"task": target[edge].astype(np.int32), **{c: [packed_column(np.ascontiguousarray(columns[c][a:b], dtype=t), c) for a, b in zip(edge, stop, strict=True)] for c, t in OWN}})

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = counts.value
        rank = rarity(table)[0]
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                yield from packed(pdf.iloc[at : at + BATCH], table, rank)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(np.searchsorted(firsts, pdf["task"].iloc[0], side="right")) - 1
        entry = {c: np.concatenate([unpacked_column(x, c, t) for x in pdf[c]]) for c, t in OWN}
        both = own_meetings(entry, threshold, job[at][2])
        return pd.DataFrame({"r": both[:, 0], "l": both[:, 1]})

    some = F.lit(False)
    for _, low, high, _, _ in job:
        some = some | F.col("size").between(low, reach(high))
    entries = spread(texts.where(some).select("cls", "text")).mapInPandas(emit, "task int, " + ", ".join(f"{c} binary" for c, _ in OWN))
    return entries.repartitionById(parts, "task").groupBy("task").applyInPandas(search, "r long, l long").distinct()


def candidates(texts: DataFrame, threshold: float, n: int = 5, per_task: int = 400_000, crowd: int = 50_000, itself: bool = False) -> DataFrame:
    """(r, l): distinct pairs of a left and a right class that pass all filters. texts: (cls long, l int, r int, text);
    l and r say on which sides a class is. itself: both sides are all texts (l and r are not needed), r < l."""
    if itself:
        return own_candidates(texts, threshold, n, per_task, crowd)
    rows = texts.count()
    counts = texts.sparkSession.sparkContext.broadcast(gram_counts(texts, n))  # BUCKETS numbers
    parts = partitions(texts, -(-rows * 60 // per_task))

    def packed(pdf: pd.DataFrame, table: np.ndarray, rank: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
        gram, own, place, size, bits = prefixes(list(pdf["text"]), rank, threshold, n)
        salts = np.maximum(1, -(-table[_bucket(gram)] // crowd))
        cls, entries, targets = pdf["cls"].to_numpy(), [], []
        for kind, flag in (("l", 1), ("r", 0)):
            mine = np.flatnonzero(pdf[kind].to_numpy()[own] == 1)
            drawn = mixed(cls[own[mine]].view(np.uint64), 22) % salts[mine].astype(np.uint64)
            if flag:  # a left row is in one salt, a right row in all
                which, salt = mine, drawn
            else:
                which = np.repeat(mine, salts[mine])
                salt = (np.arange(len(which)) - np.repeat(np.cumsum(salts[mine]) - salts[mine], salts[mine])).astype(np.uint64)
            e = np.empty(len(which), dtype=ENTRY)
            g = mixed(gram[which] + salt * np.uint64(0x9E3779B97F4A7C15), 23)
            e["key"], e["size"], e["place"], e["left"] = (g >> np.uint64(32)).astype(np.uint32), size[own[which]], place[which], flag
            e["cls"], e["bits"] = cls[own[which]], bits[own[which]]
            entries.append(e)
            targets.append(((g & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64))
        entry, part = np.concatenate(entries), np.concatenate(targets)
        order = np.argsort(part, kind="stable")
        entry, part = entry[order], part[order]
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        stop = np.concatenate([edge[1:], [len(part)]])
        return pd.DataFrame({"part": part[edge], "entries": [entry[a:b].tobytes() for a, b in zip(edge, stop, strict=True)]})

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = counts.value
        rank = rarity(table)
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                yield packed(pdf.iloc[at : at + BATCH], table, rank)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        both = meetings(np.concatenate([np.frombuffer(x, dtype=ENTRY) for x in pdf["entries"]]), threshold)
        return pd.DataFrame({"r": both[:, 0], "l": both[:, 1]})

    # one task for each part: merged by size, or spread by a hash, they would grow with the input
    return texts.mapInPandas(emit, "part int, entries binary").repartitionById(parts, "part").groupBy("part").applyInPandas(search, "r long, l long").distinct()


def similarity(n: int = 5):
    """Arrow function of two plain texts: the Jaccard similarity of their grams."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(similarities(list(a), list(b), n), dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.DoubleType())


def text_classes(df: DataFrame, key: str, text: str, order: str, texts: bool = True) -> DataFrame:
    """(cls, rest, key, order, text): df's plain texts; equal texts have equal cls and rest, the halves of a 128-bit
    key. Null counts as empty. texts: with the texts themselves."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            flat = [plain(t or "") for t in pdf["text"]]
            keys = np.array([text_key(t) for t in flat], dtype=np.int64).reshape(-1, 2)
            yield pdf[["key", "order"]].assign(**({"text": flat} if texts else {}), cls=keys[:, 0], rest=keys[:, 1])

    flat = spread(df.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(text).alias("text")))
    kinds = dict(flat.dtypes)
    return flat.mapInPandas(run, f"key {kinds['key']}, order {kinds['order']}, {'text string, ' * texts}cls long, rest long")


def near_pairs(df: DataFrame, key: str, text: str, order: str, threshold: float = 0.85, n: int = 5, tidy: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members (class, key, order), links (a, b, similarity) of different classes, a < b). Equal texts are one class,
    named by its first (order, key) as a struct; all blank texts are one class. tidy: the tables of texts and of
    candidates are removed at the end, not when the driver's process ends."""
    keyed = text_classes(df, key, text, order)
    rows = cut(text_classes(df, key, text, order, texts=False), "setjoin")
    # the texts are written once, one of each class
    classes = keyed.groupBy("cls", "rest").agg(F.min(F.struct("order", "key")).alias("class"), F.first("text").alias("text"))
    classes = cut(classes.withColumn("size", gram_sizes(n)("text")), "classes", free=True, codec="zstd")
    members = cut(rows.join(classes.select("cls", "rest", "class"), ["cls", "rest"]).select("class", "key", "order"), "members", free=True)
    drop(rows)
    found = own_candidates(classes.where("text <> ''").select("cls", "text", "size"), threshold, n)
    # texts that share the first half of their key come along here, and the check tells them apart
    involved = found.select(F.explode(F.array("l", "r")).alias("cls")).distinct()
    held = cut(classes.where("text <> ''").join(involved, "cls", "left_semi").select("cls", "class", "text"), "held", free=True)
    a, b = held.select(F.col("cls").alias("l"), F.col("class").alias("x"), F.col("text").alias("t")), held.select(F.col("cls").alias("r"), F.col("class").alias("y"), F.col("text").alias("u"))
    links = found.join(a, "l").join(b, "r").withColumn("similarity", similarity(n)("t", "u")).where(F.col("similarity") >= threshold - 1e-12)
    links = cut(links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity"), "links", free=True)
    if tidy:
        drop(classes, found, held)
    return members, links


def star_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key_a, key_b, similarity), key_a < key_b: linked classes by their first rows, and every copy with the first row
    of its class. With the membership this holds every pair, however many copies a text has."""
    across = links.select(F.col("a.key").alias("x"), F.col("b.key").alias("y"), "similarity")
    inside = members.where(F.col("key") != F.col("class.key")).select(F.col("class.key").alias("x"), F.col("key").alias("y"), F.lit(1.0).alias("similarity"))
    return across.unionByName(inside).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"), "similarity").distinct()


def without_later_duplicates(df: DataFrame, key: str, text: str, order: str, threshold: float = 0.85, n: int = 5) -> DataFrame:
    """df without rows that have an earlier near duplicate (by order, then key). A row is judged by its neighbours, kept
    or not: of a chain A ~ B ~ C with A and C unlike, only A stays. Blank texts are duplicates of each other."""
    members, links = near_pairs(df, key, text, order, threshold, n, tidy=True)
    # a class is named by its first row: it stays if no linked class has an earlier one, and that row alone
    later = links.select(F.col("b").alias("class")).distinct()
    kept = members.where(F.struct("order", "key") == F.col("class")).join(later, "class", "left_anti").select(F.col("key").alias(key))
    return df.join(kept, key, "left_semi")
