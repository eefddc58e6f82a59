"""Relational steps on records: keep-first and keep-last, updates, routes, look-ups, gates and validators."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cowrie.functions.text import blank_to_null, charset_report, nfc, strip_diacritics, token_legality


class MissingInputError(FileNotFoundError):
    """An input that a stage needs is not there; says which stage makes it."""

    def __init__(self, path: str, stage: str, hint: str = "") -> None:
        super().__init__(f"{path} is missing; run {stage} first. {hint}".strip())
        self.path, self.stage = path, stage


class GateError(ValueError):
    """Rows that failed a gate; holds up to `shown` of them."""


def keep_one(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by order. Rows with a null key are all kept, as nothing says they are the same."""
    known = functools.reduce(operator.and_, (F.col(k).isNotNull() for k in key))
    ranked = df.withColumn("_rank", F.when(known, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).otherwise(1))
    return ranked.where("_rank = 1").drop("_rank")


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return keep_one(df, key, [F.col(c).asc_nulls_last() for c in order])


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return keep_one(df, key, [F.col(c).desc_nulls_last() for c in order])


def updated(base: DataFrame, edits: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the columns replaced by the edits' values where these are not null or empty; rows without an edit
    stay. edits must hold one row per key (see keep_last)."""
    new = edits.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = base.join(new, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.nullif(F.col(f"_new_{c}"), F.lit("")), F.col(c)))
    return out.drop(*[f"_new_{c}" for c in columns])


def merged_full(left: DataFrame, right: DataFrame, key: str, columns: list[str], flags: list[str]) -> DataFrame:
    """Full outer union of two record sets: left's columns win; flags are false where a side does not have them."""
    a = left.select(F.col(key).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in columns + flags])
    b = right.select(F.col(key).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in columns + flags])
    both = a.join(b, F.col("_a") == F.col("_b"), "full")
    return both.select(
        F.coalesce("_a", "_b").alias(key),
        *[F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in columns],
        *[(F.coalesce(f"_a_{f}", F.lit(False)) | F.coalesce(f"_b_{f}", F.lit(False))).alias(f) for f in flags],
    )


def matched_questions(questions: DataFrame, claims: DataFrame, prefix: str = "elicited-unmatched") -> DataFrame:
    """questions (n, matched_claim_id, ...) with the claim's topic and answer; without a match they are out of scope,
    unclassified and get a claim id of their own."""
    known = claims.select(F.col("claim_id").alias("_claim"), "topic", "answer")
    out = questions.join(known, F.col("matched_claim_id") == F.col("_claim"), "left")
    hit = F.col("_claim").isNotNull()
    return out.select(
        *questions.columns,
        F.when(hit, F.col("_claim")).otherwise(F.format_string(prefix + "-%06d", F.col("n"))).alias("claim_id"),
        F.when(hit, F.col("topic")).otherwise("unclassified").alias("topic"),
        F.when(hit, F.lit("elicited")).otherwise("out_of_scope").alias("question_type"),
        F.col("answer"),
    )


def cached_apply(df: DataFrame, text: str, cache: DataFrame, backend) -> tuple[DataFrame, DataFrame]:
    """(df with `result`, new cache): backend(texts DataFrame(text_hash, text)) -> (text_hash, result) is only given
    distinct texts whose hash the cache lacks; empty texts pass through."""
    hashed = df.withColumn("_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    todo = hashed.where(F.coalesce(F.col(text), F.lit("")) != "").select(F.col("_hash").alias("text_hash"), F.col(text).alias("text")).dropDuplicates(["text_hash"]).join(cache, "text_hash", "left_anti")
    full = cache.unionByName(backend(todo))
    out = hashed.join(full.withColumnRenamed("text_hash", "_hash"), "_hash", "left").withColumn("result", F.when(F.coalesce(F.col(text), F.lit("")) == "", F.lit("")).otherwise(F.col("result")))
    return out.drop("_hash"), full


def missing_keys(needed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys that are needed and not present."""
    return needed.select(key).distinct().join(present.select(key), key, "left_anti")


def complete_items(ratings: DataFrame, item: list[str], unit: str) -> DataFrame:
    """Items that every unit of the table has rated (relational division)."""
    units = ratings.select(unit).distinct().count()
    return ratings.groupBy(*item).agg(F.countDistinct(unit).alias("_n")).where(F.col("_n") == units).drop("_n")


def prefilled(final: Column, draft: Column) -> Column:
    """final, or draft where final is null or empty, or empty."""
    return F.coalesce(F.nullif(final, F.lit("")), draft, F.lit(""))


def joined_text(*parts: Column) -> Column:
    """The parts that are not null or empty, with a space between."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def problems(checks: dict[str, Column]) -> Column:
    """Names of the checks that are true, in order; a null check does not count."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))


#: A text counts as Yoruba from this share of words in its spelling on.
CONSISTENT = 0.5


def _foreign(text: Column) -> Column:
    """Whether a text that is not empty has too few words in legal spelling."""
    t = token_legality(nfc(text))
    return (text != "") & (F.when(t["tokens"] > 0, t["legal"] / t["tokens"]).otherwise(0.0) < CONSISTENT)


def record_problems(kinds: tuple[str, ...], topics: tuple[str, ...]) -> Column:
    """What is wrong with a released record (id, claim_id, instruction, instruction_nodia, output, topic, question_type,
    validated_ling, validated_clin)."""
    texts = ("instruction", "output")
    return problems(
        {
            "id missing": blank_to_null(F.col("id")).isNull(),
            "claim_id missing": blank_to_null(F.col("claim_id")).isNull(),
            "instruction missing": blank_to_null(F.col("instruction")).isNull(),
            "output missing": blank_to_null(F.col("output")).isNull(),
            "question_type unknown": ~F.col("question_type").isin(*kinds),
            "topic unknown": F.col("topic").isNull() | ~F.col("topic").isin(*topics),
            **{f"{c} missing": F.col(c).isNull() for c in ("validated_ling", "validated_clin")},
            "instruction_nodia out of sync": F.col("instruction").isNotNull() & ~F.col("instruction_nodia").eqNullSafe(strip_diacritics(F.col("instruction"))),
            **{f"{c} not composed": nfc(F.col(c)) != F.col(c) for c in texts},
            **{f"{c} not Yoruba": _foreign(F.col(c)) for c in texts},
        }
    )


def text_reports(columns: list[str]) -> Column:
    """(column, valid, signs, positions) of each text column that is not null: what its spelling does not allow."""
    each = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("column"), charset_report(F.col(c)).alias("r"))) for c in columns]
    return F.transform(F.array_compact(F.array(*each)), lambda x: F.struct(x["column"].alias("column"), x["r"]["valid"].alias("valid"), x["r"]["signs"].alias("signs"), x["r"]["positions"].alias("positions")))


def edit_problems() -> Column:
    """What is wrong with an edited row (id, question_yo_final, answer_yo_final)."""
    texts = ("question_yo_final", "answer_yo_final")
    trimmed = lambda c: F.coalesce(blank_to_null(F.col(c)), F.lit(""))
    return problems({**{f"{c} missing": trimmed(c) == "" for c in ("id", *texts)}, **{f"{c} not Yoruba": _foreign(trimmed(c)) for c in texts}})


def released(df: DataFrame) -> DataFrame:
    """Working records as released records: those with a question and an answer, instruction_nodia derived, a missing
    topic or type filled with its default, flags that are not set as false."""
    filled = df.where(blank_to_null(F.col("question_yo_final")).isNotNull() & blank_to_null(F.col("answer_yo_final")).isNotNull())
    text = lambda c, default="": F.coalesce(F.col(c), F.lit(default))
    return filled.select(
        "id", "claim_id", F.col("question_yo_final").alias("instruction"), strip_diacritics(F.col("question_yo_final")).alias("instruction_nodia"), F.lit("").alias("input"), F.col("answer_yo_final").alias("output"),
        text("topic", "unclassified").alias("topic"), text("question_type", "derived").alias("question_type"), text("answer_en").alias("source_en"), text("source_ref").alias("source_ref"),
        *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("validated_ling", "validated_clin")],
    )


#: What a cell of a suggested flag reads until a person has confirmed or cleared it, and what confirms it.
SUGGESTED, CONFIRMED = "SUGGESTED", ("TRUE", "YES", "1", "X")


def unresolved_flags(df: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """(key, flag) of cells that still read as suggested."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.upper(F.trim(F.col(f).cast("string"))).alias("v")) for f in flags])).alias("x"))
    return long.where(F.col("x.v") == SUGGESTED).select(key, "x.flag")


def confirmed_flags(df: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """df with the flag cells as booleans; an error if any is still only suggested."""
    if left := unresolved_flags(df, key, flags).limit(20).collect():
        raise GateError(f"suggested flags that nobody has confirmed or cleared: {left}")
    return df.withColumns({f: F.coalesce(F.upper(F.trim(F.col(f).cast("string"))).isin(*CONFIRMED), F.lit(False)) for f in flags})


def verdict_problems(verdict: Column, reason: Column) -> Column:
    clean = F.lower(F.trim(verdict))
    return problems({"verdict unknown": verdict.isNull() | ~clean.isin("pass", "fail"), "reason missing": (clean == "fail") & blank_to_null(reason).isNull()})


def rating_problems(ratings: Column, dimensions: tuple[str, ...], harm: Column, levels: tuple[str, ...]) -> Column:
    checks = {f"{d} out of range": F.try_element_at(ratings, F.lit(d)).isNull() | ~F.try_element_at(ratings, F.lit(d)).between(1, 5) for d in dimensions}
    return problems({**checks, "harm unknown": harm.isNull() | ~harm.isin(*levels)})


def gate(df: DataFrame, wrong: Column, shown: int = 20, allow: bool = False) -> DataFrame:
    """df if no row has a problem, or with allow the rows that have none; else an error that shows some."""
    flagged = df.withColumn("_wrong", wrong)
    bad = flagged.where(F.size("_wrong") > 0)
    if not allow and (some := bad.limit(shown).collect()):
        raise GateError(f"{bad.count()} rows failed: {some}")
    return flagged.where(F.size("_wrong") == 0).drop("_wrong")


def refusals(df: DataFrame, flag: Column, answer: str, text: str, note: str = "notes") -> DataFrame:
    """Flagged rows get the fixed text as their answer, are out of scope, and a note says so."""
    on = F.coalesce(flag, F.lit(False))
    return df.withColumns(
        {
            answer: F.when(on, F.lit(text)).otherwise(F.col(answer)),
            "question_type": F.when(on, F.lit("out_of_scope")).otherwise(F.col("question_type")),
            note: F.when(on, appended_note(F.col(note), F.lit("rewritten as refusal"))).otherwise(F.col(note)),
        }
    )


def appended_note(old: Column, new: Column) -> Column:
    """The two with a bar between them; no bars or blanks at the ends."""
    return F.regexp_replace(F.concat(F.coalesce(old, F.lit("")), F.lit(" | "), F.coalesce(new, F.lit(""))), r"^[ |]+|[ |]+$", "")
