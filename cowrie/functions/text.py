"""Text functions as columns. What the JVM can express stays there; Unicode normal forms, which Spark lacks, are
Arrow functions that skip ASCII. Null in, null out, unless a function says otherwise."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The letters, marks and signs of standard Yoruba spelling, and words kept in their foreign form.
BASES = "abdefghijklmnoprstuwy"
MARKS = "̣̀́̄"
SIGNS = " \t\n\r.,;:!?'‘’\"“”()-–—/%&0123456789$₦£€"
LOANWORDS = (
    "hiv", "aids", "covid", "covid-19", "prep", "art", "cholera", "ocv", "shancol", "gavi, the vaccine alliance", "sludge", "sewerage",
    "septic tank", "drain", "levofloxacin", "pasteurize", "pasteurized", "pasteurise", "pasteurised",
)
# Function words that carry no topic, without accents.
STOPWORDS = tuple(
    "ki kini kilo ta tani ewo bawo nigba nibo ee se ni mo o a won emi oun iwo awa eyin ti ko si naa yi yii na ati tabi bi ba"
    " fun lati to je wa ri le ma maa tun pe n yoo nse loo sinu laarin pelu sugbon yen".split()
)


def bare(text: str) -> str:
    """The text without non-spacing marks, composed."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def _bare(texts: pd.Series) -> pd.Series:
    return texts.map(bare, na_action="ignore")


def nfc(text: Column) -> Column:
    return _nfc(text)


def strip_diacritics(text: Column) -> Column:
    """Without non-spacing marks; case stays."""
    return _bare(text)


def tokens(text: Column) -> Column:
    """White-space separated tokens; empty for null and blank."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def content_words(folded: Column) -> Column:
    """Distinct words of a text without marks, lower-cased, without question marks and function words."""
    return F.array_except(tokens(F.replace(F.lower(folded), F.lit("?"), F.lit(""))), F.array(*map(F.lit, STOPWORDS)))


def sentences(text: Column) -> Column:
    """Parts at white space after a full stop, exclamation or question mark and before an ASCII capital or digit."""
    return F.split(text, r"(?U)(?<=[.!?])\s+(?=[A-Z0-9])")


def _allowed() -> str:
    """All composed letters that decompose into allowed letters and marks, and what is allowed as it stands."""
    found = set(SIGNS) | set(MARKS)
    for base in BASES + BASES.upper():
        found.add(base)
        level = {base}
        for _ in range(3):
            level = {c for s in level for m in MARKS if len(c := unicodedata.normalize("NFC", s + m)) == 1}
            found |= level
    return "".join(sorted(found))


ALLOWED = _allowed()
#: A character class of what the spelling allows, in the syntax that both engines read.
ALLOWED_CLASS = "".join("\\" + c if c in "-]^[\\&" else c for c in ALLOWED if c not in "\t\n\r") + r"\t\n\r"
LOAN_PATTERN = r"(?i)\b(?:" + "|".join(re.escape(w).replace(r"\ ", " ").replace(r"\-", "-") for w in sorted(LOANWORDS, key=lambda w: (-len(w), w))) + r")\b"


def masked(text: Column) -> Column:
    """Accepted foreign words as blanks."""
    return F.regexp_replace(text, LOAN_PATTERN, " ")


def legal_spelling(composed: Column, strict: bool = True, loanwords: bool = True) -> Column:
    """Whether a composed (NFC) text uses only what the spelling allows; lenient: any letter passes."""
    text = masked(composed) if loanwords else composed
    return ~text.rlike(f"[^{ALLOWED_CLASS}]") if strict else ~text.rlike(f"[^{ALLOWED_CLASS}\\p{{L}}\\p{{Mn}}]")


@F.pandas_udf(T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("signs", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]))
def _charset(texts: pd.Series) -> pd.DataFrame:
    loan = re.compile(LOAN_PATTERN)
    ok = set(BASES + BASES.upper() + MARKS + SIGNS)
    signs, places = [], []
    for t in texts:
        flat = unicodedata.normalize("NFD", t or "")
        flat = loan.sub(lambda m: " " * len(m[0]), flat)
        at = [i for i, c in enumerate(flat) if c not in ok]
        places.append(np.array(at, dtype=np.int32))
        signs.append("".join(dict.fromkeys(flat[i] for i in at)))
    return pd.DataFrame({"valid": [not len(p) for p in places], "signs": signs, "positions": places})


def charset_report(text: Column) -> Column:
    """(valid, signs, positions): what is not allowed, and where in the decomposed text. Null counts as empty."""
    return _charset(text)


def token_legality(composed: Column) -> Column:
    """(tokens, legal) of a text: tokens are stripped of outer punctuation; those left empty do not count."""
    outer = r"^[.,;:!?'\"()]+|[.,;:!?'\"()]+$"
    words = F.filter(F.transform(tokens(composed), lambda t: F.regexp_replace(t, outer, "")), lambda t: t != "")
    return F.struct(F.size(words).cast("long").alias("tokens"), F.size(F.filter(words, lambda t: legal_spelling(t))).cast("long").alias("legal"))


def repeated_bigram(text: Column) -> Column:
    """Whether a pair of neighbouring words occurs twice."""
    words = tokens(text)
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws("\u0001", a, b))).otherwise(F.array().cast("array<string>"))
    return F.size(pairs) != F.size(F.array_distinct(pairs))


def keyword_hit(folded: Column, keywords: list[str]) -> Column:
    """Whether a lower-case text without marks holds a keyword: single words as tokens without punctuation,
    phrases as parts of the text."""
    sign = r"[!-/:-@\[-`{-~]"
    words = F.transform(tokens(folded), lambda t: F.regexp_replace(t, sign, ""))
    single = [re.sub(sign, "", k) for k in keywords if " " not in k]
    out = F.arrays_overlap(words, F.array(*map(F.lit, single))) if single else F.lit(False)
    for phrase in (k for k in keywords if " " in k):
        out = out | F.contains(folded, F.lit(phrase))
    return F.coalesce(out, F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _ngrams(texts: pd.Series, n: pd.Series) -> pd.Series:
    out = []
    for t, k in zip(texts, n, strict=True):
        flat = re.sub(r"\s+", " ", (t or "").strip().lower())
        out.append(sorted({flat[i : i + k] for i in range(len(flat) - k + 1)} if len(flat) >= k else {flat} - {""}))
    return pd.Series(out, dtype=object)


def char_ngrams(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams of the trimmed, lower-cased text with single blanks; a shorter text is its own."""
    return _ngrams(text, F.lit(n))


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) != "", text)


def masked_labels(ids: Column, prompt_length: Column) -> Column:
    """Training labels: the prompt's tokens as -100, the rest as they are."""
    k = F.least(prompt_length, F.size(ids))
    return F.concat(F.array_repeat(F.lit(-100), k), F.slice(ids, k + 1, F.greatest(F.size(ids) - k, F.lit(0))))


def kappa_band(kappa: Column) -> Column:
    """Verbal band of an agreement coefficient; each band includes its lower bound."""
    out = F.lit("almost perfect")
    for bound, name in ((0.8, "substantial"), (0.6, "moderate"), (0.4, "fair"), (0.2, "slight"), (0.0, "poor")):
        out = F.when(kappa < bound, F.lit(name)).otherwise(out)
    return F.when(kappa.isNotNull(), out)


def claim_key(claim_id: Column) -> Column:
    """`source-slug-NNN`: lower case, single hyphens, the number with at least three digits; null if blank.
    Case, blanks, separators and leading zeros make no difference."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(claim_id), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")
    digits = F.regexp_replace(F.regexp_extract(flat, r"-(\d+)$", 1), r"^0+(?=\d)", "")
    padded = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    head = F.regexp_replace(flat, r"-\d+$", "")
    return F.nullif(F.when(flat.rlike(r"-\d+$"), F.concat_ws("-", head, padded)).otherwise(flat), F.lit(""))
