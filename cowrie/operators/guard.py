"""Rules around an answering backend: scope, boundary, disclaimer, cache, templates. The texts and keyword lists are
parameters; everything is a projection, so it runs the same on a stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cowrie.functions.text import blank_to_null, keyword_hit, strip_diacritics


@dataclass(frozen=True)
class Rules:
    scope: tuple[str, ...]
    boundary: tuple[str, ...]
    out_of_scope_text: str
    boundary_text: str
    disclaimer: str
    failed_text: str = ""


def outcome(question: Column, rules: Rules) -> Column:
    """blank, out_of_scope, clinical_boundary or answered; the scope rule comes first."""
    folded = F.lower(strip_diacritics(question))
    return (
        F.when(blank_to_null(question).isNull(), "blank")
        .when(~keyword_hit(folded, list(rules.scope)), "out_of_scope")
        .when(keyword_hit(folded, list(rules.boundary)), "clinical_boundary")
        .otherwise("answered")
    )


def with_disclaimer(answer: Column, rules: Rules) -> Column:
    return F.concat(F.trim(answer), F.lit("\n\n" + rules.disclaimer))


def guarded(questions: DataFrame, rules: Rules, backend: Callable[[DataFrame], DataFrame], question: str = "question", cache: DataFrame | None = None) -> DataFrame:
    """questions with outcome and response. backend gets only rows that pass (and adds `answer`): a filter keeps the
    others from it, as a CASE would not. An exact hit in cache (question, answer) is served before the rules. A row
    whose answer is null, as its backend failed, gets the rules' text for that, and the disclaimer."""
    rows = questions.withColumn("_asked", F.trim(F.col(question)))
    if cache is not None:
        rows = rows.join(cache.select(F.col("question").alias("_asked"), F.col("answer").alias("_cached")), "_asked", "left")
    else:
        rows = rows.withColumn("_cached", F.lit(None).cast("string"))
    judged = rows.withColumn("outcome", F.when(F.col("_cached").isNotNull(), "cached").otherwise(outcome(F.col(question), rules)))
    fixed = F.when(F.col("outcome") == "cached", F.col("_cached")).when(F.col("outcome") == "out_of_scope", rules.out_of_scope_text).when(F.col("outcome") == "clinical_boundary", rules.boundary_text)
    closed = judged.where("outcome <> 'answered'").withColumn("response", fixed)
    opened = backend(judged.where("outcome = 'answered'")).withColumn("response", with_disclaimer(F.coalesce("answer", F.lit(rules.failed_text)), rules)).drop("answer")
    return closed.unionByName(opened).drop("_asked", "_cached")


def interaction(df: DataFrame, question: str = "question", response: str = "response", seconds: Column | None = None) -> DataFrame:
    """The log row of an exchange: never the text itself, only its hash; seconds: how long it took, kept to a thousandth.
    Blank questions are not logged."""
    return df.where("outcome <> 'blank'").select(
        F.current_timestamp().alias("timestamp_utc"), F.sha2(F.trim(F.col(question)), 256).alias("question_sha256"), F.col("outcome").alias("guardrail_outcome"),
        F.coalesce(F.length(response), F.lit(0)).alias("response_char_len"), F.round(seconds if seconds is not None else F.lit(None).cast("double"), 3).alias("latency_s"), (F.col("outcome") == "cached").alias("served_from_cache"),
    )


def prompt(instruction: Column, system: str, shots: Column | None = None) -> Column:
    """System text, solved examples and the question, in that order."""
    parts = [F.lit(system), *([shots] if shots is not None else []), F.concat(F.lit("Q: "), instruction, F.lit("\nA:"))]
    return F.concat_ws("\n\n", *parts)


def few_shots(train: DataFrame, n: int, order: str = "id") -> str:
    """The first n training examples as one text; n is a handful."""
    rows = train.orderBy(order).limit(n).collect()
    return "\n\n".join(f"Q: {r['instruction']}\nA: {r['output']}" for r in rows)
