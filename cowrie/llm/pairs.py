"""Problem 3: broken prompt and response pairs.

Method: for every defect a few noisy labelling functions vote for, against or not at all. They look at form and grammar
(a first person that negates or limits what it can do, a second person sent to a professional, a sentence that hangs in
the air), at the relation of answer and question, or ask a model: that of the languages, and two
learnt from the records themselves: how answers to questions out of scope read, as these are meant to be declined, and
which words end sentences. An
expectation-maximisation label model estimates each function's reliability and every pair's posterior from how the
votes agree; a pair keeps each defect whose posterior reaches that defect's cutoff.

Training: the model of declining answers is fitted on the counts of words in all answers to questions out of scope and
all others, and the model of sentences' ends on all of the latter; without answers to questions out of scope the former
does not vote. A model holds the words that are so frequent that a few thousand answers would hold some, so that its
size does not follow the data.

Scale: votes are made in one pass; the model is fitted on counts of distinct vote patterns (at most 3 to the
number of functions rows per defect, whatever the data) and applied by looking the pattern up.

Defined results: a null or blank output is `empty`; a null instruction counts as empty text, so nothing copies
it; records repeated under one id count once; a null id is a record of its own kind and is left out; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cowrie.session import cut, spread

from .confusables import canonical_form
from .langid import LanguageModel, _segments_of

DEFECTS = ("empty", "copy", "refusal", "language", "truncated")
FUNCTIONS = {"empty": 3, "copy": 3, "refusal": 4, "language": 3, "truncated": 4}
#: Posterior from which a defect is kept. Validated: every cutoff lies where the label model is at its best on pairs
#: that were labelled by hand and whose wording no function knows (tests/llm).
CUTOFFS = {"empty": 0.5, "copy": 0.5, "refusal": 0.5, "language": 0.5, "truncated": 0.017}

# What stands for a missing answer.
PLACEHOLDERS = frozenset("null none nil na n/a nan tbd tba todo undefined unknown missing blank empty xxx lorem ipsum placeholder pending idahun answer".split())

# Frequent function words, without accents.
WORDS = {
    "yo": "ni ti ati awon lati pe ki won maa naa lori sinu yoo nitori tabi pelu gbodo bi",
    "en": "the of and to in a is that for on are with be as at they have or not from this by should if who you your",
    "fr": "le la les des de du et est une un pour dans qui que sur au aux ce sont vous avez souvent apres",
    "ha": "da ku na ta su ya yana tana ne ce kuma domin saboda wannan mutane zai kada bayan wa a sun kafin cikin sosai mara idan",
    "ig": "na ka nke ga ha maka bu onye ndi nwere n'oge mgbe ihe gi ma otu esi nwere",
    "pcm": "dey go wey dem na no una abi don make for fit e sharp suppose wahala",
}
YORUBA = frozenset(WORDS["yo"].split())
FOREIGN = frozenset(w for c, s in WORDS.items() if c != "yo" for w in s.split()) - YORUBA

# Grammar of a speaker who negates or limits what they can or may do, in folded text (no accents, lower
# case), by language: first persons; negations and limits; abilities, permissions and what a speaker would do with them.
_GRAMMAR = {
    "yo": (r"(?<!\bto )(?<!\bko )mo|mi|emi", r"ko|o|koja|gbodo|kii", r"le|ase|eto|agbara|laaye|dake|lati|idahun|se"),
    "en": (r"i|i'm|me|my", r"not|no|cannot|can't|unable|won't|must|have|decline|refuse|beyond|outside", r"can|able|allowed|made|answer|reply|say|tell|help|give|advise|provide|silent|decline"),
    "fr": (r"je|j'ai|me|moi", r"ne|pas|refuse|regrette|desolee?", r"peux|puis|autorisee?|repondre|dire|aider|conseiller|mesure"),
    "ha": (r"ba zan|ba na|ba ni da|bani da|ban da", r"ba|bani|ban", r"iya|izini|damar|amsa|fada|taimaka"),
    "ig": (r"m|mu", r"enweghi|apughi|agaghi|naghi|ndo", r"ike|aza|ikwu|inye|enye|m"),
    "pcm": (r"i|me|my", r"no|never|not", r"fit|allow|talk|answer|help"),
}
#: Without accents "to mo" and "ko mo" are "clean" and "unclean". "n ko" is a first person only where a clause begins: elsewhere it is a mark of the continuous and a verb.
_I_NOT = re.compile(r"(?:^\W*|[,;:]\W+)n ko\b")
_SAYS = [tuple(re.compile(rf"\b(?:{x})\b") for x in parts) for parts in _GRAMMAR.values()]
# Words for the healers and places that a reader is sent to, and forms of addressing that reader.
_HEALER = re.compile(r"\b(?:dokita|onisegun|noosi|iwosan|doctor|nurse|clinic|hospital|pharmacist|medecin|infirmier|hopital|likita|asibiti|dokta|ogwu)\b")
_READER = re.compile(r"^\W*(?:e|yin|please|kindly|you|abeg|biko|don allah|veuillez)\b|\b(?:jowo|e joo|yin|you|your|vous|votre)\b")
# How a speaker asks for pardon or thanks before declining.
_PARDON = re.compile(r"^\W*(?:\w+\W+){0,2}(?:binu|dakun|jowo|joo|sorry|apologies|apologise|unfortunately|pardon|afraid|thank|thanks|seun|desolee?|regrette|hakuri|ndo)\b")


_ANY_FIRST = re.compile(r"\b(?:mo|mi|emi|n ko|i|i'm|me|my|je|j'ai|moi|m|mu)\b|\bba(?:n|ni| ni| zan| na)\b")


def _declines(sentence: str) -> bool:
    """Whether a folded sentence has a first person, a negation or limit, and an ability or permission of one language."""
    if not _ANY_FIRST.search(sentence):
        return False
    return any(all(p.search(sentence) for p in parts) for parts in _SAYS) or bool(_I_NOT.search(sentence) and _SAYS[0][2].search(sentence))


class DecliningModel:
    """Mean log odds of an answer's words and pairs of words between answers to questions out of scope and others.
    counts: in how many of `yes` answers and of `no` others a feature is."""

    def __init__(self, counts: dict[str | tuple[str, str], tuple[float, float]], yes: float, no: float, smooth: float = 0.5) -> None:
        a, b = yes + 2 * smooth, no + 2 * smooth
        self.weights = {f: math.log((x + smooth) / a) - math.log((y + smooth) / b) for f, (x, y) in counts.items()}
        self.usable = yes >= 20 and no >= 20

    @staticmethod
    def features(words: list[str]) -> set:
        return {*words, *zip(words, words[1:])}

    def score(self, words: list[str]) -> float:
        """Above zero for what reads like declining, given the words of a folded text; zero if nothing is known."""
        if not self.usable:
            return 0.0
        known = [w for w in map(self.weights.get, self.features(words)) if w is not None]
        return math.fsum(known) / len(known) if known else 0.0


class EndingModel:
    """How often each word ends a sentence. counts: how often a word is in a sentence, and ends one."""

    def __init__(self, counts: dict[str, tuple[float, float]]) -> None:
        self.rates = {w: (last + 0.5) / (n + 1) for w, (n, last) in counts.items()}

    def rate(self, word: str) -> float | None:
        return self.rates.get(word)


def _answer_counts(known: DataFrame, most: int = 1 << 19) -> DataFrame:
    """(feature, yes, no, every, last) of rows (e, t): in how many texts with and without e a word, or a pair of words
    with a blank between, is; and, of the texts without e, how often a word is in a sentence and ends one. The last
    sentence of a text, which may be cut, does not count. Tasks sum up to `most` features before they pass them on."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [Counter() for _ in range(4)]

        def summed() -> pd.DataFrame:
            names = list(dict.fromkeys(f for c in sums for f in c))
            out = pd.DataFrame({"feature": np.array([f if isinstance(f, str) else " ".join(f) for f in names], dtype=object), **{k: np.array([c[f] for f in names], dtype=np.int64) for k, c in zip(("yes", "no", "every", "last"), sums, strict=True)}})
            for c in sums:
                c.clear()
            return out

        for pdf in parts:
            for e, text in zip(pdf["e"], pdf["t"], strict=True):
                said = [_words(x) for x in _SENTENCES.split(fold(text))]
                sums[0 if e else 1].update(DecliningModel.features([w for x in said for w in x]))
                if not e:
                    for words in said[:-1]:
                        sums[2].update(words)
                        sums[3].update(words[-1:])
                if len(sums[0]) + len(sums[1]) > most:
                    yield summed()
        if any(sums):
            yield summed()

    return spread(known.select("e", "t")).mapInPandas(count, "feature string, yes long, no long, every long, last long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("yes", "no", "every", "last")])


def fit_answer_models(df: DataFrame, expected: Column | None, output: str = "output", per: tuple[int, int] = (4000, 8000), least: tuple[int, int] = (2, 5)) -> tuple[DecliningModel, EndingModel]:
    """Models of how answers read where `expected` is true (declined on purpose) and of how sentences end, from the
    counts of all answers, given as they are in per[0] answers where it is true and per[1] others on average, so that
    the models' smoothing, and what their scores mean, does not follow the size of the table. They hold features that
    are in least[0] of these, and words that are in sentences of per[1] others least[1] times."""
    known = df.select(F.coalesce(expected, F.lit(False)).alias("e") if expected is not None else F.lit(False).alias("e"), F.col(f"`{output}`").alias("t")).where("t is not null and trim(t) <> ''")
    sizes = {r["e"]: r["count"] for r in known.groupBy("e").count().collect()}
    yes, no = sizes.get(True, 0), sizes.get(False, 0)
    a, b = min(1.0, per[0] / max(1, yes)), min(1.0, per[1] / max(1, no))
    common, placed = F.col("yes") * a + F.col("no") * b >= least[0] - 1e-9, F.col("every") * b >= least[1] - 1e-9
    rows = _answer_counts(known).where(common | placed).withColumns({"common": common, "placed": placed}).collect()  # of bounded number: what `per` answers hold
    split = lambda f: tuple(f.split(" ")) if " " in f else f
    declining = DecliningModel({split(r["feature"]): (r["yes"] * a, r["no"] * b) for r in rows if r["common"]}, yes * a, no * b)
    return declining, EndingModel({r["feature"]: (r["every"] * b, r["last"] * b) for r in rows if r["placed"]})


# Words, without accents, that no Yoruba sentence ends with.
NEVER_LAST = frozenset("ati tabi nitori sugbon amo lati pe ti ki bi ni fun si pelu nipa lori laarin awon kan-n ko-le le maa n yoo gbodo boya tun nigba ninu".split()) | {"to-n"}
_MARKED = re.compile("[^\\W\\d_]*[eosEOS]\u0323[^\\W\\d_]*|[^\\W\\d_]*[aeiouAEIOU][\u0300\u0301]")
_IGBO = re.compile("[ịụṅỊỤṄ]")
_ENDS = re.compile(r"[.!?…][\"'”’»)\]]*$")
_DANGLING = re.compile(r"(?:[,;:–—\-\[(/&“]|\.\.\.|…)$")
_SENTENCES = re.compile(r"(?<=[.!?])\s+")
_ITEM = re.compile(r"^\s*(?:[-–—•*]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+\S")
_TAIL = re.compile(r"[\s‍️\U0001f000-\U0001faff☀-➿]+$")


class _Unmarked(dict):
    """Marks become nothing, the apostrophe plain, filled as characters are met."""

    def __missing__(self, code: int) -> str | int:
        self[code] = out = "" if unicodedata.category(chr(code)) == "Mn" else "'" if code == 0x2019 else code
        return out


_UNMARKED = _Unmarked()


def fold(text: str) -> str:
    """Lower case, no accents, one space between words."""
    return " ".join(unicodedata.normalize("NFD", text.lower()).translate(_UNMARKED).split())


_WORD = re.compile(r"[^\W_]+(?:['-][^\W_]+)*")


def _words(folded: str) -> list[str]:
    return _WORD.findall(folded)


def _vote(yes: bool, no: bool) -> int:
    return 1 if yes else -1 if no else 0


def votes_of(instruction: str | None, output: str | None, foreign_share: float, declining: DecliningModel | None = None, endings: EndingModel | None = None) -> list[int]:
    """The labelling functions' votes (1 for, -1 against, 0 none) in the order of DEFECTS and FUNCTIONS.
    foreign_share: share of the output's letters in sentences that the language model calls not Yoruba; output is in its
    consistent form (confusables.canonical_form)."""
    raw = output or ""
    out, ask = fold(raw), fold(canonical_form(instruction or "") or "")
    words, asked = _words(out), _words(ask)
    letters = sum(map(len, words))
    plain = out.strip(" .!?-–—…[](){}<>_*'\"")
    v = [
        _vote(letters == 0, letters > 0),
        _vote(not plain or plain in PLACEHOLDERS, len(words) >= 3),
        _vote(len(words) <= 1 and letters <= 0.2 * sum(map(len, asked)), len(words) >= 5),
    ]
    known = set(asked)
    inside = sum(w in known for w in words) / len(words) if words else 0.0
    rest = sum(w not in known for w in words)
    pairs = set(zip(asked, asked[1:]))
    runs = list(zip(words, words[1:]))
    kept = sum(p in pairs for p in runs) / len(runs) if runs else inside
    ample = bool(asked) and len(words) >= 3
    v += [_vote(ample and kept >= 0.75, kept <= 0.5), _vote(ample and inside >= 0.85, inside <= 0.7), _vote(ample and rest <= 4 and kept >= 0.6, rest >= 8 or not words)]
    said = [x for x in _SENTENCES.split(out) if x]
    declined = sum(map(_declines, said))
    sent_on = sum(bool(_HEALER.search(x) and _READER.search(x)) for x in said)
    score = declining.score(words) if declining else 0.0
    v += [
        _vote(5 * declined >= len(said) > 0, declined == 0),
        _vote(score > 0.5, score < -0.5),
        _vote(3 * sent_on >= len(said) > 0, sent_on == 0),
        _vote(bool(_PARDON.search(out)), len(said) > 6),
    ]
    yoruba = sum(w in YORUBA for w in words) / len(words) if words else 0.0
    strange = sum(w in FOREIGN for w in words) / len(words) if words else 0.0
    some = len(words) >= 3
    marked = 0.0 if _IGBO.search(raw) else len(_MARKED.findall(unicodedata.normalize("NFD", raw))) / max(1, len(words))
    v += [_vote(some and foreign_share > 0.5, not some or foreign_share < 0.4), _vote(some and yoruba < 0.03 and marked < 0.2, not some or yoruba > 0.08 or marked > 0.4), _vote(some and strange > 0.2 and strange > 2 * yoruba, not some or strange < 0.08 or strange < yoruba)]
    body = _TAIL.sub("", raw)
    bare = body.rstrip("\"'”’»)] ")
    last = body.rsplit("\n", 1)[-1]
    item = bool(_ITEM.match(last)) and "\n" in body
    ended, dangling = bool(_ENDS.search(body)), bool(_DANGLING.search(bare)) and not (item and bare[-1:] not in ",[(")
    final = words[-1] if words else ""
    rate = endings.rate(final) if endings else None
    v += [
        _vote(some and not ended and not item, False),
        _vote(some and dangling, False),
        _vote(some and final in NEVER_LAST, False),
        _vote(some and not item and rate is not None and rate < 0.002, item or (rate is not None and rate > 0.5)),
    ]
    return v


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 20.0) -> tuple[float, np.ndarray]:
    """Share of positives and table[function, class, vote + 1] of a two-class model of conditionally independent
    votes, by expectation-maximisation over distinct patterns. A Beta-like prior of pseudo-counts keeps each
    function better than chance; one that never votes against looks for a sign that many positives lack."""
    n, m = patterns.shape
    start = np.empty((m, 2, 3))
    start[:, 1], start[:, 0] = (0.1, 0.2, 0.7), (0.85, 0.1, 0.05)
    silent = ~(patterns == -1).any(axis=0)
    start[silent, 1], start[silent, 0] = (0.01, 0.59, 0.4), (0.01, 0.97, 0.02)
    table, share = start.copy(), 0.05
    total = counts.sum()
    for _ in range(rounds):
        post = posterior(patterns, share, table)
        new = start * prior
        for j in range(m):
            for vote in range(3):
                hit = patterns[:, j] == vote - 1
                new[j, 1, vote] += (counts[hit] * post[hit]).sum()
                new[j, 0, vote] += (counts[hit] * (1 - post[hit])).sum()
        new /= new.sum(axis=2, keepdims=True)
        old, share = share, float(((counts * post).sum() + 1) / (total + 20))
        done = np.abs(new - table).max() < 1e-7 and abs(old - share) < 1e-9
        table = new
        if done:
            break
    return share, table


def posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    idx = patterns + 1
    m = patterns.shape[1]
    yes = np.log(share) + sum(np.log(table[j, 1, idx[:, j]]) for j in range(m))
    no = np.log(1 - share) + sum(np.log(table[j, 0, idx[:, j]]) for j in range(m))
    return 1 / (1 + np.exp(np.clip(no - yes, -700, 700)))


def label_votes(df: DataFrame, model: LanguageModel, answers: tuple[DecliningModel, EndingModel], id_col: str = "id", instruction: str = "instruction", output: str = "output", keep: list[str] | None = None) -> DataFrame:
    """(id, keep..., one array<int> of votes per defect), one row per id."""
    keep = keep or []
    flat = spread(df.select(F.col(f"`{id_col}`").cast("string").alias("id"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{instruction}`").alias("_ask"), F.col(f"`{output}`").alias("_out")).where("id is not null"))
    held = df.sparkSession.sparkContext.broadcast((model, *answers))  # of fixed size
    kinds = {f.name: f.dataType for f in flat.schema if f.name in keep}
    schema = T.StructType([T.StructField("id", T.StringType()), *[T.StructField(c, kinds[c]) for c in keep], *[T.StructField(d, T.ArrayType(T.ByteType())) for d in DEFECTS]])
    edges = np.cumsum([0, *[FUNCTIONS[d] for d in DEFECTS]])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, told, endings = held.value
        home = m.languages.index("yo")
        for pdf in parts:
            outs = [canonical_form(t) if t is not None else "" for t in pdf["_out"]]
            segs, where = _segments_of(outs)
            best, sure = m.classify(segs)
            n = np.array([b - a for _, a, b in where], dtype=float)
            at = np.array([i for i, _, _ in where], dtype=np.int64)
            away = (best != home) & (best >= 0) & (sure >= 0.6)
            known = np.bincount(at, weights=n * (best >= 0), minlength=len(outs))
            share = np.bincount(at, weights=n * away, minlength=len(outs)) / np.maximum(known, 1)
            votes = np.array([votes_of(a, o, s, told, endings) for a, o, s in zip(pdf["_ask"], outs, share, strict=True)], dtype=np.int8).reshape(len(pdf), -1)
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), **{c: pdf[c].to_numpy() for c in keep}, **{d: list(votes[:, edges[k] : edges[k + 1]]) for k, d in enumerate(DEFECTS)}})

    # repeated ids carry the same texts: one is enough, and which one does not matter for equal rows
    return flat.mapInPandas(run, schema).dropDuplicates(["id"])


def best_cutoffs(posteriors: dict[str, np.ndarray], truth: dict[str, np.ndarray]) -> dict[str, tuple[float, float]]:
    """For each defect the range of cutoffs at which the F measure on labelled pairs is highest."""
    out = {}
    for d, p in posteriors.items():
        edges = np.unique(np.concatenate([[0.0], p, [1.0]]))
        middles, score = (edges[1:] + edges[:-1]) / 2, []
        for c in middles:
            hit = p >= c
            score.append(2 * (hit & truth[d]).sum() / max(1, hit.sum() + truth[d].sum()))
        best = np.flatnonzero(np.array(score) >= max(score) - 1e-12)
        out[d] = (float(edges[best[0]]), float(edges[best[-1] + 1]))
    return out


def pair_defects(df: DataFrame, model: LanguageModel, id_col: str = "id", instruction: str = "instruction", output: str = "output", keep: list[str] | None = None, cutoffs: dict[str, float] | None = None, expected: Column | None = None) -> DataFrame:
    """(id, keep..., p_<defect> for each defect, defects): posteriors and all defects that reach their cutoff, in
    the order of DEFECTS. expected: where an answer is meant to decline."""
    spark, cutoffs = df.sparkSession, cutoffs or CUTOFFS
    votes = cut(label_votes(df, model, fit_answer_models(df, expected, output), id_col, instruction, output, keep), "votes")
    out = votes
    for d in DEFECTS:
        rows = votes.groupBy(d).count().collect()  # at most 3 ** FUNCTIONS[d] rows
        pattern = np.array([list(r[d]) for r in rows], dtype=np.int64).reshape(len(rows), FUNCTIONS[d])
        count = np.array([r["count"] for r in rows], dtype=float)
        share, table = fit_label_model(pattern, count)
        post = posterior(pattern, share, table) if len(rows) else np.zeros(0)
        look = spark.createDataFrame([([int(x) for x in p], round(float(q), 6)) for p, q in zip(pattern, post, strict=True)], T.StructType([T.StructField(d, T.ArrayType(T.ByteType())), T.StructField(f"p_{d}", T.DoubleType())]))
        out = out.join(F.broadcast(look), d, "left")
    kept = F.array_compact(F.array(*[F.when(F.col(f"p_{d}") >= cutoffs[d], F.lit(d)) for d in DEFECTS]))
    return out.select("id", *(keep or []), *[f"p_{d}" for d in DEFECTS], kept.alias("defects"))


def first_defect(defects: Column, expected_refusal: Column) -> Column:
    """The first defect of a record; a refusal is none where one is expected. Null if there is none."""
    return F.try_element_at(F.when(F.coalesce(expected_refusal, F.lit(False)), F.array_remove(defects, "refusal")).otherwise(defects), F.lit(1))
