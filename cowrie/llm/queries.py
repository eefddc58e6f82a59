"""Queries of the ten training-data problems, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cowrie.functions.text import claim_key
from cowrie.session import table

from .confusables import inconsistent_texts, with_consistent_text
from .consensus import HARM, SCALE, krippendorff_nominal, latest_ratings, latest_votes, read_harm, reweighted_voting
from .langid import document_languages, fit_language_model, foreign_languages, language_segments
from .leakage import cross_split_overlaps
from .mixing import mix_sources
from .neardup import near_duplicates
from .pairs import first_defect, pair_defects
from .quality import fit_quality_model, text_quality
from .splits import connected_components, split_components
from .tokens import encode_corpus

RESPONSE = ["sample_id", "system_id"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = inconsistent_texts(table(spark, sf_dir, "working_record"), ["question_yo_final", "answer_yo_final"])
    return work.unionByName(inconsistent_texts(table(spark, sf_dir, "final_record"), ["instruction_nodia"]))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, field, form) of every text of the three fields; a null text has a null form."""

    def forms(name: str, columns: list[str]) -> DataFrame:
        once = table(spark, sf_dir, name).select("id", *columns).dropDuplicates(["id"])
        long = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c + "_canonical").alias("form")) for c in columns])
        return with_consistent_text(once, columns).select("id", F.explode(long).alias("x")).select("id", "x.field", "x.form")

    return forms("working_record", ["question_yo_final", "answer_yo_final"]).unionByName(forms("final_record", ["instruction_nodia"]))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_components(table(spark, sf_dir, "final_record"), "id", {"claim": claim_key(F.col("claim_id"))}, F.col("topic"), F.col("split"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).where(F.size("shipped_splits") > 1).select(F.col("component").alias("claim_id"))


def p2_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select(F.col("component").alias("claim_id"), F.col("stratum").alias("topic"), "records", "split")


def p2_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).groupBy(F.col("stratum").alias("topic"), "split").agg(F.sum("records").alias("records"), F.count("*").alias("claims"))


def _defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects(table(spark, sf_dir, "final_record"), fit_language_model(table(spark, sf_dir, "documents")), keep=["question_type"], expected=F.col("question_type") == "out_of_scope")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _defects(spark, sf_dir).select("id", first_defect(F.col("defects"), F.col("question_type") == "out_of_scope").alias("defect"))
    return out.where("defect is not null")


def p3_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _defects(spark, sf_dir)


def _harm_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_votes(table(spark, sf_dir, "unblinded_rating"), RESPONSE, "rater_id", read_harm(F.col("harm")), "submitted_at", "received_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = reweighted_voting(_harm_votes(spark, sf_dir), RESPONSE, HARM).labels
    return labels.where(F.col("label").isin("Moderate", "Severe")).select(*RESPONSE, F.col("label").alias("harm"))


def p4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reweighted_voting(_harm_votes(spark, sf_dir), RESPONSE, HARM).labels


def p4_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, weight and readings of each rater, and in how many rounds they settled."""
    found = reweighted_voting(_harm_votes(spark, sf_dir), RESPONSE, HARM)
    return found.annotators.withColumns({"rounds": F.lit(found.rounds), "settled": F.lit(found.settled)})


def p4_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = latest_ratings(table(spark, sf_dir, "unblinded_rating"), RESPONSE, "rater_id", "ratings", "submitted_at", "received_at")
    return reweighted_voting(votes, [*RESPONSE, "dimension"], SCALE).labels


def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    harm = krippendorff_nominal(_harm_votes(spark, sf_dir), RESPONSE).withColumn("dimension", F.lit("harm"))
    votes = latest_ratings(table(spark, sf_dir, "unblinded_rating"), RESPONSE, "rater_id", "ratings", "submitted_at", "received_at")
    return harm.unionByName(krippendorff_nominal(votes, [*RESPONSE, "dimension"], ["dimension"]))


def _near(spark: SparkSession, sf_dir: str):
    return near_duplicates(table(spark, sf_dir, "working_record"), ["answer_yo_final", "answer_en"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).pairs()


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record and field that has near duplicates: its class of copies, group and number of linked classes."""
    near = _near(spark, sf_dir)
    node = F.concat_ws("\u0001", "field", "x")
    edges = near.links.select(F.concat_ws("\u0001", "field", "a").alias("a"), F.concat_ws("\u0001", "field", "b").alias("b"))
    groups = connected_components(edges).select("node", F.split_part("component", F.lit("\u0001"), F.lit(2)).alias("group"))
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    members = near.members.withColumn("x", F.col("class")).withColumn("node", node)
    out = members.join(groups, "node", "left").join(degree, "node", "left")
    return out.select("field", "id", "class", F.coalesce("group", "class").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


def _overlaps(spark: SparkSession, sf_dir: str):
    return cross_split_overlaps(table(spark, sf_dir, "final_record"), F.split_part(claim_key(F.col("claim_id")), F.lit("-"), F.lit(1)))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).pairs().select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).report()


def p6_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record that has an overlap: its class of copies and the number of classes linked to it."""
    return _overlaps(spark, sf_dir).membership()


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_language_model(table(spark, sf_dir, "documents"))
    return language_segments(table(spark, sf_dir, "working_record"), model, ["answer_yo_mt", "answer_yo_final"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foreign_languages(_segments(spark, sf_dir))


def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("id", "field", "segment", "start", "length", "lang", "confidence").distinct()


def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    segments = language_segments(docs.withColumn("key", F.col("doc_id").cast("string")), fit_language_model(docs), ["text"], "key")
    return document_languages(segments).select(F.col("id").cast("long").alias("doc_id"), "lang", "confidence", "mixed")


def p7_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, field, lang, confidence, mixed) of each answer text of the working records."""
    model = fit_language_model(table(spark, sf_dir, "documents"))
    once = table(spark, sf_dir, "working_record").dropDuplicates(["id"])
    return document_languages(language_segments(once, model, ["answer_yo_mt", "answer_yo_final"]))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def _mixture(spark: SparkSession, sf_dir: str):
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose dealt tokens fall short of what is wanted; whether they could not but fall short is then checked
    exactly, as a reachable source may miss its share by a part of a record."""
    return _mixture(spark, sf_dir).report.where("used < wanted").where("not reachable").select("source")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).report


def p9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, records and tokens of each source in each output shard."""
    return _mixture(spark, sf_dir).shards


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).records


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return text_quality(docs, fit_quality_model(docs))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).where(F.col("kind").isin("list", "table", "junk")).select("doc_id", "kind")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_forms, p2_found, p2_assignment, p2_balance, p3_found, p3_labels, p4_found, p4_labels, p4_raters, p4_ratings, p4_agreement,
            p5_found, p5_groups, p6_found, p6_report, p6_membership, p7_found, p7_segments, p7_documents, p7_answers, p8_ids, p9_found, p9_report, p9_shards, p9_mixture, p10_found, p10_statistics,
        )
    }
