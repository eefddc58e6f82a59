"""Statistics of batches of texts by whole-array arithmetic: characters, words and lines are found in one array of
code points for all texts of a batch, and only lines that may hold cells or items are looked at one by one."""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib

import numpy as np

from cowrie.functions.grams import mixed

from .pairs import WORDS

STATS = (
    "n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "letter_ratio", "upper_ratio", "odd_ratio", "code_ratio",
    "ended_line_share", "common_word_share", "words_per_line", "item_share", "cell_share", "short_share", "long_share", "head_share",
    "distinct_word_share", "top_word_share", "repeat_share", "compressed_ratio", "rule_share", "end_per_word", "run_length", "vowel_ratio", "cluster_share",
)
COMMON = sorted({w for s in WORDS.values() for w in s.split()})
_ITEM = re.compile(r"\s*(?:[-–—•*·▪◦+]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivx]{1,4}[.)])\s+\S")
_KEYWORD = re.compile(r"\b(?:var|let|const|function|return|if|else|def|import|class)\b")
_APART = ("; ", ", ", " · ", " • ", " / ", " - ", " – ")
_CELLS = re.compile(r"\t|\s*\|\s*|;(?=\S)|\",\"|,(?=\S)| {2,}")
_SENTENCE_END = re.compile(r"[.!?]\s")
#: Characters of all texts that are worked on at once.
TOGETHER = 1 << 20

# bits of a character's kind
LETTER, MARK, DIGIT, UPPER, SYMBOL, CONTROL, ODD, BLANK = (1 << k for k in range(8))
SPACE, ALNUM, WORD, JOINER = (1 << k for k in range(8, 12))
CODE, CLOSER, STOP, APART, BULLET = (1 << k for k in range(12, 17))


_GROUPS = (("'’-", JOINER), ("{}();=<>[]", CODE), ("\"'”’»)]", CLOSER), (".!?…", STOP), (";,·•/-–", APART), ("-–—•*·▪◦+(", BULLET))


def _kind(c: str) -> int:
    k = unicodedata.category(c)
    bits = {"L": LETTER, "P": SYMBOL, "S": SYMBOL}.get(k[0], 0) | {"Mn": MARK, "Nd": DIGIT, "Lu": UPPER | LETTER, "Cc": CONTROL, "Co": ODD, "Cn": ODD, "Zs": BLANK}.get(k, 0)
    if c.isspace():
        bits |= SPACE
    if c.isalnum():
        bits |= ALNUM | (0 if c.isdecimal() else WORD | JOINER)
    if 0x300 <= ord(c) < 0x370:
        bits |= JOINER
    for chars, bit in _GROUPS:
        bits |= bit if c in chars else 0
    return bits


class _Characters:
    """(kind bits, lower case, lower-case base letter) of characters, looked up once when they are first met."""

    def __init__(self) -> None:
        self.known = np.zeros(0x110000, dtype=bool)
        self.kind, self.lower, self.base = (np.zeros(0x110000, dtype=np.uint32) for _ in range(3))

    def meet(self, codes: np.ndarray) -> None:
        new = ~self.known[codes]
        for code in np.unique(codes[new]).tolist() if new.any() else ():
            low = chr(code).lower()
            flat = unicodedata.normalize("NFD", low)
            self.kind[code], self.lower[code] = _kind(chr(code)), ord(low[0])
            self.base[code] = ord(flat[0]) if all(0x300 <= ord(c) < 0x370 for c in flat[1:]) else ord(low[0])
            self.known[code] = True


_CHARACTERS = _Characters()


_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _word_hashes(values: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end]; `at` is each value's place, which a word's own hash does not depend on."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_P, int(at[-1]) + 1)[at])])
    return mixed((total[ends] - total[starts]) * _powers(_INVERSE, int(at[-1]) + 1)[at[starts]], 31)


@functools.lru_cache(maxsize=1)
def _common() -> np.ndarray:
    return np.unique(_Batch(COMMON).bare)


def _cells(line: str) -> int:
    return sum(1 for c in _CELLS.split(line.strip().strip("|")) if c.strip())


class _Batch:
    """Characters, words and lines of some texts that are not blank. A line feed is put behind each text."""

    def __init__(self, texts: list[str]) -> None:
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.text = "\n".join(texts) + "\n"
        self.codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.owner = np.repeat(np.arange(len(texts)), self.size + 1)
        _CHARACTERS.meet(self.codes)
        self.kind = _CHARACTERS.kind[self.codes]
        n = len(self.codes)
        place = np.arange(n)
        joiner, letter = (self.kind & JOINER) > 0, (self.kind & WORD) > 0
        begins = joiner.copy()
        begins[1:] &= ~joiner[:-1]
        run = np.maximum.accumulate(np.where(begins, place, 0))
        last = np.maximum.accumulate(np.where(letter, place, -1))
        before = np.concatenate([[-1], last[:-1]])
        self.starts = np.flatnonzero(letter & (before < run))  # the first letter of a run of letters and joiners
        stop = joiner.copy()
        stop[:-1] &= ~joiner[1:]
        stops = np.flatnonzero(stop) + 1
        self.ends = stops[np.searchsorted(stops, self.starts, side="right")] if len(self.starts) else self.starts
        self.words = _word_hashes(mixed(_CHARACTERS.lower[self.codes].astype(np.uint64), 32), place, self.starts, self.ends)
        mark = (self.codes >= 0x300) & (self.codes < 0x370)
        rank = np.cumsum(~mark) - 1
        self.base = _CHARACTERS.base[self.codes]
        self.bare = _word_hashes(np.where(mark, np.uint64(0), mixed(self.base.astype(np.uint64), 32)), np.maximum(rank, 0), self.starts, self.ends)

    def has(self, bits: int) -> np.ndarray:
        return (self.kind & np.uint32(bits)) > 0


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct hashes, count of the most frequent one) of each owner."""
    key = (owner.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    whose = (key[first] >> np.uint64(48)).astype(np.int64)
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, whose, np.diff(np.concatenate([first, [len(key)]])))
    return np.bincount(whose, minlength=n), top


def _some(texts: list[str]) -> np.ndarray:
    b = _Batch(texts)
    n, codes, owner = len(texts), b.codes, b.owner
    ahead = np.concatenate([codes[1:], [10]])
    feed = codes == 10

    def count(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=n).astype(float)

    feeds = count(feed) - 1  # without our own behind each text
    tabs = count(codes == 9)
    chars = b.size.astype(float)
    seen = np.maximum(1, chars - count(b.has(BLANK)) - feeds - tabs)
    letters = count(b.has(LETTER)) + count(b.has(MARK))
    follows = (ahead >= 0x80) & (ahead <= 0xBF)
    broken = (np.isin(codes, [ord(c) for c in "ÂÃÌÍ"]) & follows) | ((codes == ord("á")) & np.isin(ahead, [ord(c) for c in "º»¹"]))
    odd = count(b.has(CONTROL)) - 1 - feeds - tabs + count(b.has(ODD)) + count(codes == 0xFFFD) + 2 * count(broken)
    code = count(b.has(CODE)) + np.array([len(_KEYWORD.findall(t)) - t.count("!==") for t in texts], dtype=float)
    space = b.has(SPACE)
    after = np.concatenate([space[1:], [True]])
    filled = ~space
    filled[1:] &= space[:-1]
    pieces = np.maximum(1, count(filled))
    plain_letter = b.has(WORD)
    consonant = plain_letter & np.isin(b.base, [ord(c) for c in "bcdfghjklmnpqrstvwxz"])
    vowels = count(plain_letter & ~consonant) / np.maximum(1, count(plain_letter))
    cluster = consonant.copy()  # where the fifth consonant in a row stands
    for k in range(1, 5):
        cluster[k:] &= consonant[:-k]
        cluster[:k] = False
    cluster[1:] &= ~cluster[:-1]
    ends = count((codes == ord(".")) & after | (codes == ord("!")) & after | (codes == ord("?")) & after)

    nw = np.bincount(owner[b.starts], minlength=n).astype(float)
    some = np.maximum(1, nw)
    length = np.bincount(owner[b.starts], weights=b.ends - b.starts, minlength=n)
    common = np.bincount(owner[b.starts][np.isin(b.bare, _common())], minlength=n) if n else nw
    distinct, top = _distinct(owner[b.starts], b.words, n)
    w = b.words
    three = mixed(w[:-2] + mixed(w[1:-1] + mixed(w[2:], 33), 34), 35) if len(w) > 2 else w[:0]
    whose = owner[b.starts][: len(three)]
    inside = owner[b.starts][2:] == whose if len(three) else np.zeros(0, bool)
    kinds, _ = _distinct(whose[inside], three[inside], n)
    grams = np.bincount(whose[inside], minlength=n)

    # lines that are not blank, by where their first and last visible characters are
    stops = np.flatnonzero(feed)
    begins = np.concatenate([[0], stops[:-1] + 1])
    visible = np.flatnonzero(~space)
    low, high = np.searchsorted(visible, begins), np.searchsorted(visible, stops) - 1
    used = low <= high
    begins, stops = begins[used], stops[used]
    first, last = visible[low[used]], visible[high[used]]
    line_of = owner[first]
    size = last - first + 1
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    within = lambda s: s[stops] - s[begins]
    started = np.zeros(len(codes), dtype=bool)
    started[b.starts] = True
    own = within(sums(started))
    bare = np.flatnonzero(~b.has(CLOSER))
    end_at = bare[np.maximum(np.searchsorted(bare, last, side="right") - 1, 0)] if len(bare) else first
    stop = b.has(STOP)[end_at] & (end_at >= first) & (end_at <= last)
    rule = within(sums(b.has(ALNUM))) == 0
    bar, tab = codes == ord("|"), codes == 9
    comma = codes == ord(",")
    parting = tab | bar | ((comma | (codes == ord(";"))) & ~after) | ((codes == 32) & (ahead == 32))
    cells = np.ones(len(first), dtype=np.int64)
    for k in np.flatnonzero(within(sums(parting)) > 0):
        cells[k] = _cells(b.text[begins[k] : stops[k]])
    n_lines = np.bincount(line_of, minlength=n).astype(float)
    pair, where, often = np.unique(line_of * (1 << 32) + cells, return_inverse=True, return_counts=True)
    usual = (cells >= 2) & (often[where] >= 3) & (often[where] >= 0.25 * n_lines[line_of])
    prose = stop & (own >= 7) & (within(sums(comma)) > 0) & (within(sums(tab)) == 0) & (within(sums(bar)) == 0)
    cell = ~rule & usual & ~prose
    item = np.zeros(len(first), dtype=bool)
    marks = np.isin(codes, [ord("."), ord(")")])
    near = sums(marks)
    labelled = b.has(ALNUM)[first] & (near[np.minimum(first + 6, len(codes))] - near[first] > 0)
    rows = within(sums(b.has(APART))) >= 5
    for k in np.flatnonzero(~rule & ~cell & (b.has(BULLET)[first] | labelled | rows)):
        line = b.text[begins[k] : stops[k]]
        t = line.strip()
        item[k] = _ITEM.match(line) is not None or (rows[k] and any(t.count(x) >= 5 and own[k] <= 5 * (t.count(x) + 1) for x in _APART) and not _SENTENCE_END.search(t))
    rest = ~rule & ~cell & ~item
    wide = rest & ((own >= 7) | (stop & (own >= 4)))
    narrow = rest & ~wide
    total = np.maximum(1, np.bincount(line_of, weights=size, minlength=n))
    share = lambda mask: np.bincount(line_of[mask], weights=size[mask], minlength=n) / total

    packed = np.array([len(zlib.compress(raw, 1)) / len(raw) for raw in (t.encode("utf-8", "replace") for t in texts)], dtype=float)
    lines = np.maximum(1, n_lines)
    return np.stack(
        [
            chars, nw, n_lines, length / some, count(b.has(SYMBOL)) / seen, count(b.has(DIGIT)) / seen, letters / seen, count(b.has(UPPER)) / np.maximum(1, letters), odd / seen, code / seen,
            np.bincount(line_of[stop], minlength=n) / lines, common / some, nw / lines, share(item), share(cell), share(narrow), share(wide), share(narrow & (codes[last] == ord(":"))),
            distinct / some, top / some, np.where(grams > 0, 1 - kinds / np.maximum(1, grams), 0.0), packed, share(rule), ends / some, seen / pieces, vowels, count(cluster) / some,
        ],
        axis=1,
    )


def statistics(texts: list[str | None]) -> np.ndarray:
    """(texts, STATS): null, empty and blank texts have their number of characters and zeros."""
    out = np.zeros((len(texts), len(STATS)))
    held: list[int] = []
    some: list[str] = []
    chars = 0

    def flush() -> None:
        nonlocal held, some, chars
        if some:
            out[held] = _some(some)
        held, some, chars = [], [], 0

    for i, text in enumerate(texts):
        if not isinstance(text, str) or not text.strip():
            out[i, 0] = len(text) if isinstance(text, str) else 0
            continue
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        held.append(i)
        some.append(text)
        chars += len(text)
        if chars >= TOGETHER or len(some) >= 20_000:
            flush()
    flush()
    return out
