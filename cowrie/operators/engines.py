"""Answering engines and systems under one shape: an engine maps a table of questions to the same table with `answer`,
and reports why a row has none. Neural engines are the caller's; rules, retrieval and caches are here."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import best_matches


class AnswerEngine(Protocol):
    def transform(self, questions: DataFrame) -> DataFrame:
        """questions (id, question, ...) with `answer` and `skip_reason`, of which one is null."""


class FunctionEngine:
    """An engine from a column function of the question."""

    def __init__(self, answer: Callable[[Column], Column]) -> None:
        self.answer = answer

    def transform(self, questions: DataFrame) -> DataFrame:
        out = questions.withColumn("answer", self.answer(F.col("question")))
        return out.withColumn("skip_reason", F.when(F.col("answer").isNull(), "no answer"))


class RetrievalEngine:
    """The answer of the most similar known question. entries: (entry_id, question, answer)."""

    def __init__(self, entries: DataFrame, weights: DataFrame) -> None:
        self.entries, self.weights = entries, weights

    def transform(self, questions: DataFrame) -> DataFrame:
        met = best_matches(questions.select(F.col("id").alias("query_id"), "question"), self.entries, self.weights)
        told = met.join(self.entries.select("entry_id", "answer"), "entry_id").select(F.col("query_id").alias("id"), "answer")
        return questions.join(told, "id", "left").withColumn("skip_reason", F.when(F.col("answer").isNull(), "no question is similar enough"))


class MissingEngine:
    """Stands for an engine that is not installed: no answers, and why."""

    def __init__(self, reason: str) -> None:
        self.reason = reason

    def transform(self, questions: DataFrame) -> DataFrame:
        return questions.withColumns({"answer": F.lit(None).cast("string"), "skip_reason": F.lit(self.reason)})


class Systems:
    """Systems to compare, by name."""

    def __init__(self) -> None:
        self.engines: dict[str, AnswerEngine] = {}

    def register(self, name: str, engine: AnswerEngine) -> "Systems":
        if name in self.engines:
            raise ValueError(f"system {name} is registered already")
        self.engines[name] = engine
        return self

    def generations(self, questions: DataFrame, names: list[str] | None = None) -> DataFrame:
        """(system_id, id, question, answer, skip_reason) of all systems, or those named; an unknown name is an error."""
        names = list(self.engines) if names is None else names
        if unknown := [n for n in names if n not in self.engines]:
            raise KeyError(f"unknown systems {unknown}; known are {sorted(self.engines)}")
        out = None
        for n in names:
            one = self.engines[n].transform(questions.select("id", "question")).select(F.lit(n).alias("system_id"), "id", "question", "answer", "skip_reason")
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise ValueError("no systems")
        return out


def with_optional_scores(scores: DataFrame, optional: dict[str, tuple[Callable[[DataFrame], DataFrame] | None, str]]) -> DataFrame:
    """scores (system_id, ...) with a column for each optional score and one for why it was skipped: optional maps a
    name to (function of scores giving (system_id, name), reason if there is no function)."""
    for name, (make, reason) in optional.items():
        if make is None:
            scores = scores.withColumns({name: F.lit(None).cast("double"), f"{name}_skip_reason": F.lit(reason)})
        else:
            scores = scores.join(make(scores).select("system_id", name), "system_id", "left").withColumn(f"{name}_skip_reason", F.when(F.col(name).isNull(), "no score"))
    return scores


def ranked(df: DataFrame, score: str, key: str, best_first: bool = True) -> DataFrame:
    """df of a report with `place`: by score, ties by key, nulls last. For tables of a row per system or setting."""
    from pyspark.sql import Window

    order = F.col(score).desc_nulls_last() if best_first else F.col(score).asc_nulls_last()
    return df.withColumn("place", F.row_number().over(Window.orderBy(order, key)))


def best_setting(df: DataFrame, score: str, key: str) -> DataFrame:
    """The one row of the best score; ties by key."""
    return df.orderBy(F.col(score).desc_nulls_last(), key).limit(1)
