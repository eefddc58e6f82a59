"""Problem 1: one consistent form for text that reads alike but is written with different characters.

Method: the scripts of each token's characters are resolved to sets and intersected. An empty intersection is
a mixed-script token, a set without the text's main script a possible whole-script look-alike; both are
rewritten in the consistent script if every foreign character has a look-alike there. What remains is then
normalised: compatibility forms that look the same, blanks, invisible characters, and composition (NFC).

Defined results: null gives null; empty and blank texts stay as they are; visible differences (tone marks,
under-dots, typographic quotes, superscripts, fractions, emoji with their joiners) stay.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that look like a Latin letter in common typefaces (from the public Unicode confusables data).
LOOK_ALIKE = {
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj"),
    "Cyrillic": ("АВЕЅІЈКМНОРСТХУԚԜҮаеѕіјорсухԁԛԝһѵӏ", "ABESIJKMHOPCTXYQWYaesijopcyxdqwhvl"),
    "Armenian": ("ՕՍցհոսօ", "OUghnuo"),
    "Cherokee": ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
}
# Scripts that writing systems use together, and characters that belong to some scripts only though their
# own property says all (from the public script extensions).
TOGETHER = {"Han": ("Japanese", "Korean", "Bopomofo+"), "Hiragana": ("Japanese",), "Katakana": ("Japanese",), "Hangul": ("Korean",), "Bopomofo": ("Bopomofo+",)}
EXTENSIONS = {"\u30fc": ("Hiragana", "Katakana"), "\uff70": ("Hiragana", "Katakana"), "\u3005": ("Han",), "\u3006": ("Han",), "\u0640": ("Arabic", "Syriac", "Mandaic"), "\u0342": ("Greek",), "\u0345": ("Greek",), "\u0483": ("Cyrillic",), "\u0484": ("Cyrillic",), "\u0487": ("Cyrillic",)}

# Blanks that look like a plain space, and characters that are not seen at all.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
UNSEEN = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
# Hyphens that look like the plain one.
HYPHENS = "\u2010\u2011"
JOINERS = "\u200c\u200d"

_SCRIPT_OF_NAME = {"LATIN": "Latin", "GREEK": "Greek", "CYRILLIC": "Cyrillic", "ARMENIAN": "Armenian", "CHEROKEE": "Cherokee", "CJK": "Han"}
_TO_LATIN = {a: b for old, new in LOOK_ALIKE.values() for a, b in zip(old, new, strict=True)}
_FROM_LATIN = {s: {b: a for a, b in zip(*pair, strict=True)} for s, pair in LOOK_ALIKE.items()}
_EMOJI = "[\u00a9\u00ae\u203c-\u3299\U0001f000-\U0001faff]"
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")
_SELECTOR = re.compile("[\ufe00-\ufe0f]")
#: Text outside these needs nothing but a look at its composition.
_SUSPECT = re.compile(f"[{BLANKS}{UNSEEN}{HYPHENS}\ufe00-\ufe0f\uff01-\uffee\ufb00-\ufb06\u0370-\u058f\u13a0-\u13f5\u1f00-\u1fff\u2c60-\u2c7f\r]")
_KEPT_JOIN = re.compile(f"({_EMOJI}[\U0001f3fb-\U0001f3ff]?\ufe0f?)\u200d(?={_EMOJI})")


@functools.lru_cache(maxsize=4096)
def script_of(char: str) -> str | None:
    """The script that a letter is named for; None for what all scripts share (digits, marks, signs)."""
    kind = unicodedata.category(char)
    if kind[0] != "L" and kind != "Sk":
        return None
    name = unicodedata.name(char, "").split(" ")[0]
    if name in ("FULLWIDTH", "MODIFIER", "MICRO", "FEMININE", "MASCULINE"):
        return "Latin" if name == "FULLWIDTH" else None
    return _SCRIPT_OF_NAME.get(name, name.title() or "Unknown")


@functools.lru_cache(maxsize=4096)
def scripts_of(char: str) -> frozenset[str] | None:
    """All scripts and writing systems that a character may belong to; None for what all share."""
    own = EXTENSIONS.get(char) or ((script_of(char),) if script_of(char) else ())
    return frozenset(s for name in own for s in (name, *TOGETHER.get(name, ()))) or None


def resolved_scripts(token: str) -> frozenset[str] | None:
    """The intersection over the token's characters: None if every character is common, empty if scripts mix."""
    common: frozenset[str] | None = None
    for c in token:
        own = scripts_of(c)
        if own is not None:
            common = own if common is None else common & own
    return common


def _rewritten(token: str, script: str) -> str | None:
    """The token with every foreign letter replaced by its look-alike of the script, or None if one has none."""
    out = []
    for c in token:
        own = scripts_of(c)
        if own is None or script in own:
            out.append(c)
            continue
        latin = _TO_LATIN.get(c, c if "Latin" in own else None)
        new = latin if script == "Latin" else _FROM_LATIN.get(script, {}).get(latin)
        if new is None:
            return None
        out.append(new)
    return "".join(out)


def _main_script(text: str) -> str:
    counts = Counter(s for c in text if (s := script_of(c)))
    return max(sorted(counts), key=counts.__getitem__) if counts else "Latin"


def _consistent(token: str, main: str) -> str:
    scripts = resolved_scripts(token)
    if scripts is None or main in scripts:
        return token
    if scripts:  # one foreign script: a look-alike only if the whole token can be read in the main script
        return _rewritten(token, main) or token
    counts = Counter(s for c in token if (s := script_of(c)))
    for script in sorted(counts, key=lambda s: (s != main, -counts[s], s)):
        if (new := _rewritten(token, script)) is not None:
            return new
    return token


def canonical_form(text: str | None) -> str | None:
    """The consistent form of one text; null for null."""
    if text is None or text.isascii() and "\r" not in text:
        return text
    if not _SUSPECT.search(text):
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    # forms that look the same: full and half width, ligatures
    text = re.sub("[\uff01-\uffee\ufb00-\ufb06]", lambda m: unicodedata.normalize("NFKC", m[0]), text)
    text = text.translate(_PLAIN)
    # joiners and selectors stay where they form an emoji, and joiners in scripts whose letters join
    text = _KEPT_JOIN.sub("\\1\ue000", text)
    text = re.sub(f"({_EMOJI}|[0-9#*])([\ufe0e\ufe0f])", lambda m: m[1] + ("\ue001" if m[2] == "\ufe0f" else "\ue002"), text)
    text = re.sub(f"(?<=[\u0600-\u0dff])[{JOINERS}](?=[\u0600-\u0dff])", lambda m: "\ue003" if m[0] == JOINERS[0] else "\ue000", text)
    text = text.translate(_DROPPED)
    text = _SELECTOR.sub("", text)
    text = text.translate({0xE000: "\u200d", 0xE001: "\ufe0f", 0xE002: "\ufe0e", 0xE003: "\u200c"})
    if re.search("[\u0370-\u058f\u13a0-\u13f5\u1f00-\u1fff]", text):
        text = unicodedata.normalize("NFD", text)
        main = _main_script(text)
        text = _TOKEN.sub(lambda m: m[0] if m[0].isascii() else _consistent(m[0], main), text)
    return unicodedata.normalize("NFC", text)


_PLAIN = {ord(c): " " for c in BLANKS} | {ord(c): "-" for c in HYPHENS}
_DROPPED = {ord(c): None for c in UNSEEN}


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_form, na_action="ignore")


#: Texts that may not be their own form: all others are decided in the JVM.
ODD = r"[^\x00-\x0c\x0e-\x7f]|\r"


def consistent_text(text: Column) -> Column:
    """Column form of canonical_form. Python gets a null instead of a text that is its own form."""
    return F.coalesce(_canonical(F.when(text.rlike(ODD), text)), text)


def with_consistent_text(df: DataFrame, columns: list[str], suffix: str = "_canonical") -> DataFrame:
    """df with, for each column c, c + suffix (the consistent form). Other columns stay as they are; an input
    column that already has such a name is replaced."""
    return df.withColumns({c + suffix: consistent_text(F.col(f"`{c}`")) for c in columns})


def inconsistent_texts(df: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """(key, field) for each text of the columns that differs from its consistent form; each once."""
    long = df.select(
        F.col(f"`{key}`").alias("id"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("text")) for c in columns])).alias("x"),
    ).select("id", "x.field", "x.text")
    odd = long.where(F.col("text").isNotNull() & F.col("text").rlike(ODD))
    return odd.where(_canonical("text") != F.col("text")).select("id", "field").distinct()
