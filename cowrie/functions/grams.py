"""Hashed character n-grams of batches of texts, by whole-array arithmetic."""

from __future__ import annotations

import hashlib

import numpy as np

_M = np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(0xD1B54A32D192ED03)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finalising mix of 64-bit values; another function for each salt."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def plain(text: str) -> str:
    """Trimmed, lower-cased, runs of white space as one space."""
    return " ".join(text.lower().split())


def gram_set(text: str, n: int = 5) -> set[str]:
    """The n-grams of a plain text; a shorter text is its own only gram, an empty one has none."""
    return {text[i : i + n] for i in range(len(text) - n + 1)} if len(text) >= n else {text} - {""}


def gram_hashes(texts: list[str], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every n-gram occurrence, number of the text it is in), in the order of the texts."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    count = np.where(size >= n, size - n + 1, 0)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) * _M
    codes ^= codes >> np.uint64(32)
    if len(codes) >= n:
        h = codes
        for k in range(1, n):
            h = h[:-1] * _P + codes[k:]
        keep = np.ones(len(h), dtype=bool)
        ends = np.cumsum(size)
        low = ends - np.minimum(size, n - 1)
        for k in range(n - 1):  # the last n - 1 places of each text start no gram
            at = low + k
            at = at[(at < ends) & (at < len(h))]
            keep[at] = False
        h, owner = mixed(h[keep]), np.repeat(np.arange(len(texts)), count)
    else:
        h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        extra = np.array([int.from_bytes(hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for i in short], dtype=np.uint64)
        h, owner = np.concatenate([h, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    return h, owner


#: Texts whose grams are sorted together: their number takes ten bits of a key, a gram's hash the other 54.
TOGETHER = 1 << 10


def distinct_grams(texts: list[str], n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of 54 bits in the upper part of a word, owner, sizes): each text's distinct grams, sorted by text and
    hash, and their numbers."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for at in range(0, len(texts), TOGETHER):
        h, owner = gram_hashes(texts[at : at + TOGETHER], n)
        key = (owner.astype(np.uint64) << np.uint64(54)) | (h >> np.uint64(10))
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        found.append((key << np.uint64(10), (key >> np.uint64(54)).astype(np.int64) + at))
    h, owner = (np.concatenate(x) for x in zip(*found, strict=True))
    return h, owner, np.bincount(owner, minlength=len(texts))


def similarities(left: list[str], right: list[str], n: int = 5) -> np.ndarray:
    """The Jaccard similarity of the gram sets of each pair of plain texts; 1 if both are empty."""
    out = np.ones(len(left))
    for at in range(0, len(left), TOGETHER):
        x, y = left[at : at + TOGETHER], right[at : at + TOGETHER]
        keys, sizes = [], []
        for side in (x, y):
            h, owner, size = distinct_grams(side, n)
            keys.append((owner.astype(np.uint64) << np.uint64(54)) | (h >> np.uint64(10)))
            sizes.append(size)
        key = np.concatenate(keys)
        key.sort()
        both = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(54)).astype(np.int64), minlength=len(x))
        union = sizes[0] + sizes[1] - both
        np.divide(both, union, out=out[at : at + TOGETHER], where=union > 0)
    return out


def text_key(text: str) -> tuple[int, int]:
    """128 bits that stand for a text, as two signed 64-bit numbers."""
    d = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
