"""The queries of the core operators, over whole tables; sql.py holds the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cowrie.functions import metrics, text
from cowrie.functions.tokenizer import token_count
from cowrie.operators import agreement, engines, evaluation, guard, records, sampling, segment, setjoin
from cowrie.session import scratch, table
from cowrie.sources import io
from cowrie.streaming import interactions

from . import settings as S
from .sql import oracle_sql

__all__ = ["oracle_sql", "queries"]
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def query(f: Query) -> Query:
    _queries[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_queries)


def final(spark: SparkSession, d: str) -> DataFrame:
    """Released records, each once: rows repeated under one id are equal but for their order."""
    return table(spark, d, "final_record").dropDuplicates(["id"])


def keyed(spark: SparkSession, d: str) -> DataFrame:
    """Released records under the one spelling of their claim; records without a claim are left out."""
    return final(spark, d).withColumn("claim_id", text.claim_key(F.col("claim_id"))).where("claim_id is not null")


def working(spark: SparkSession, d: str) -> DataFrame:
    """Working records, the last delivery of each id."""
    return records.keep_last(table(spark, d, "working_record"), ["id"], ["received_at", "updated_at"])


def judgements(spark: SparkSession, d: str) -> DataFrame:
    """The last submission of each rater on each response."""
    return records.keep_last(table(spark, d, "unblinded_rating").withColumn("_r", F.to_json("ratings")), ["sample_id", "system_id", "rater_id"], ["submitted_at", "received_at", "harm", "_r"]).drop("_r")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def tidy(c: str) -> F.Column:
    return F.lower(F.trim(F.col(c)))


# --- composition, funnel, provenance


@query
def q_composition(spark, d):
    return final(spark, d).groupBy("split", F.coalesce(tidy("topic"), F.lit("unknown")).alias("topic"), "question_type").agg(F.count("*").alias("n"))


@query
def q_funnel(spark, d):
    w = working(spark, d)
    steps = {
        "1 records": F.lit(True),
        "2 translated": text.blank_to_null(F.col("answer_yo_mt")).isNotNull(),
        "3 edited": text.blank_to_null(F.col("answer_yo_final")).isNotNull() & text.blank_to_null(F.col("question_yo_final")).isNotNull(),
        "4 language checked": F.col("validated_ling"),
        "5 content checked": F.col("validated_clin"),
        "6 both": F.col("validated_ling") & F.col("validated_clin"),
    }
    one = w.agg(*[F.sum(c.cast("long")).alias(n) for n, c in steps.items()])
    return one.unpivot([], list(steps), "stage", "n")


@query
def q_provenance(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), (F.length("text") == F.col("n_chars")).alias("length_agrees"), text.blank_to_null(F.col("licence")).isNotNull().alias("licensed"))


@query
def q_topic_names(spark, d):
    names = spark.createDataFrame(list(S.TOPIC_NAMES.items()), "topic string, name string")
    rows = final(spark, d).select("id", tidy("topic").alias("topic"))
    return rows.join(F.broadcast(names), "topic", "left").groupBy(F.coalesce("name", "topic", F.lit("unknown")).alias("name")).agg(F.count("*").alias("n"))


@query
def q_next_id(spark, d):
    return table(spark, d, "working_record").agg((F.coalesce(F.max(F.regexp_extract("id", r"(\d+)$", 1).cast("long")), F.lit(0)) + 1).alias("next_id"))


@query
def q_running_ids(spark, d):
    docs = table(spark, d, "documents").select("url", "doc_id")
    return segment.running_ids(docs, ["url", "doc_id"]).select("doc_id", "id")


# --- dedup by key, updates, routes


@query
def q_keep_first(spark, d):
    return records.keep_first(table(spark, d, "working_record"), ["id"], ["received_at", "updated_at"]).select("id", F.unix_micros("received_at").alias("received"), "validated_ling", "validated_clin")


@query
def q_keep_last(spark, d):
    return working(spark, d).select("id", F.unix_micros("received_at").alias("received"), "validated_ling", "validated_clin")


@query
def q_update_merge(spark, d):
    """First deliveries updated by the last ones' texts; post_edited where text differs from the draft."""
    base = records.keep_first(table(spark, d, "working_record"), ["id"], ["received_at", "updated_at"])
    edits = working(spark, d)
    out = records.updated(base, edits, "id", ["question_yo_final", "answer_yo_final", "validation_notes"])
    clean = lambda c: text.nfc(F.trim(F.coalesce(F.col(c), F.lit(""))))
    return out.select("id", "validation_notes", ((clean("question_yo_final") != clean("question_yo_mt")) | (clean("answer_yo_final") != clean("answer_yo_mt"))).alias("post_edited"))


@query
def q_validation_route(spark, d):
    w = working(spark, d)
    verdicts = w.where("question_yo_final is not null").select("id", F.when(F.col("validated_clin") & F.col("validated_ling"), "pass").otherwise("fail").alias("verdict"))
    routed = w.select("id", "question_type", "validation_notes").join(verdicts, "id")
    note = records.appended_note(F.col("validation_notes"), F.concat(F.lit("verdict "), F.col("verdict")))
    return routed.select("id", "verdict", "question_type", note.alias("note"))


@query
def q_discard_rate(spark, d):
    r = q_validation_route(spark, d)
    return r.groupBy("question_type").agg(F.count("*").alias("n"), F.sum((F.col("verdict") == "fail").cast("long")).alias("failed"), F.round(F.avg((F.col("verdict") == "fail").cast("double")), 6).alias("rate"))


@query
def q_merge_checked(spark, d):
    w = working(spark, d)
    a = w.where("validated_clin").select("id", F.col("source_name"), F.col("validated_clin"), F.lit(False).alias("validated_ling"))
    b = w.where("validated_ling").select("id", F.col("source_name"), F.lit(False).alias("validated_clin"), F.col("validated_ling"))
    return records.merged_full(a, b, "id", ["source_name"], ["validated_clin", "validated_ling"])


@query
def q_elicited_join(spark, d):
    w = working(spark, d)
    claims = records.keep_first(w.where("question_type = 'derived'").select("claim_id", F.col("topic"), F.col("answer_en").alias("answer"), "id"), ["claim_id"], ["id"])
    asked = w.where("question_type = 'elicited'").select(F.regexp_extract("id", r"(\d+)$", 1).cast("long").alias("n"), F.col("claim_id").alias("matched_claim_id"))
    return records.matched_questions(asked, claims.select("claim_id", "topic", "answer")).select("n", "claim_id", "topic", "question_type", F.coalesce(F.length("answer"), F.lit(0)).cast("long").alias("answer_length"))


@query
def q_cache_antijoin(spark, d):
    """Texts of the released records whose hash the working records' translations do not hold."""
    cache = table(spark, d, "working_record").where("answer_en is not null").select(F.sha2("answer_en", 256).alias("text_hash")).distinct()
    todo = table(spark, d, "final_record").where("source_en <> ''").select(F.sha2("source_en", 256).alias("text_hash")).distinct()
    return todo.join(cache, "text_hash", "left_anti")


@query
def q_cached_backend(spark, d):
    """Texts of one split are in the cache, with results that the backend would not give; it serves the rest."""
    rows = final(spark, d).select("id", "output", "split")
    cache = rows.where("split = 'val' and output <> ''").select(F.sha2("output", 256).alias("text_hash"), F.concat(F.lit("kept "), F.col("output")).alias("result")).distinct()
    backend = lambda todo: todo.select("text_hash", F.upper("text").alias("result"))
    out, _ = records.cached_apply(rows, "output", cache, backend)
    return out.select("id", F.length("result").cast("long").alias("length"), F.startswith("result", F.lit("kept ")).alias("cached"))


@query
def q_missing_ids(spark, d):
    """Records of val and test that nobody has rated: those of val, and of test what the raters have left out."""
    return records.missing_keys(table(spark, d, "final_record").where("split <> 'train'"), table(spark, d, "unblinded_rating").select(F.col("sample_id").alias("id")).distinct(), "id")


@query
def q_postedit_rows(spark, d):
    w = working(spark, d).where(F.coalesce(F.nullif("question_yo_mt", F.lit("")), F.nullif("answer_yo_mt", F.lit(""))).isNotNull())
    return w.select("id", "topic", records.prefilled(F.col("question_yo_final"), F.col("question_yo_mt")).alias("question"), records.joined_text(F.col("question_yo_mt"), F.col("answer_yo_mt")).alias("draft"))


@query
def q_promotion(spark, d):
    w = working(spark, d)
    done = text.blank_to_null(F.col("answer_yo_final")).isNotNull()
    draft = text.blank_to_null(F.col("answer_yo_mt")).isNotNull()
    return w.select("id", F.when(done, "reviewed").when(draft, "promoted").otherwise("skipped").alias("route")).groupBy("route").agg(F.count("*").alias("n"))


@query
def q_record_problems(spark, d):
    r = final(spark, d).withColumn("topic", F.col("topic")).select(F.explode(records.record_problems(S.KINDS, S.TOPICS)).alias("problem"))
    return r.groupBy("problem").agg(F.count("*").alias("n"))


@query
def q_edit_problems(spark, d):
    """Over the rows that an editor has changed."""
    r = working(spark, d).where("post_edited").select(F.explode(records.edit_problems()).alias("problem"))
    return r.groupBy("problem").agg(F.count("*").alias("n"))


@query
def q_rating_problems(spark, d):
    r = table(spark, d, "unblinded_rating").select(F.explode(records.rating_problems(F.col("ratings"), S.DIMENSIONS, F.col("harm"), evaluation.HARM)).alias("problem"))
    return r.groupBy("problem").agg(F.count("*").alias("n"))


# --- text


@query
def q_strip_diacritics(spark, d):
    return final(spark, d).select("id", text.strip_diacritics(F.col("instruction")).alias("plain"))


@query
def q_charset(spark, d):
    w = working(spark, d).where("answer_yo_mt is not null")
    return w.select("id", text.legal_spelling(text.nfc(F.col("answer_yo_mt"))).alias("legal"))


@query
def q_charset_report(spark, d):
    w = working(spark, d).select("id", text.charset_report(F.col("answer_yo_final")).alias("r"))
    return w.select("id", "r.valid", "r.signs", F.size("r.positions").alias("n"))


@query
def q_language_consistency(spark, d):
    return evaluation.language_consistency(final(spark, d), ["split"], "output")


@query
def q_sentences(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("sentences"))


@query
def q_boilerplate(spark, d):
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.sum(segment.is_boilerplate(F.col("line")).cast("long")).alias("boilerplate"), F.count("*").alias("lines"))


@query
def q_claims(spark, d):
    return segment.exploded_claims(table(spark, d, "documents").where("text is not null"), "doc_id", "text", "source")


@query
def q_classify(spark, d):
    w = working(spark, d).withColumn("name", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in S.TOPIC_NAMES.items() for x in kv]), tidy("topic")), tidy("topic")))
    kind = segment.classify(F.col("answer_en"), F.col("name"), S.CATEGORIES)
    return w.select("id", F.coalesce(kind, F.lit("none")).alias("category"), segment.question_for(kind, F.col("name"), S.CATEGORIES, S.GENERIC).alias("question"))


@query
def q_safety(spark, d):
    both = F.concat(F.coalesce("answer_yo_final", F.lit("")), F.lit(" "), F.coalesce("answer_en", F.lit("")))
    w = working(spark, d).withColumn("unsafe", both.rlike(S.UNSAFE_PATTERN))
    out = records.refusals(w, F.col("unsafe"), "answer_yo_final", S.REFUSAL)
    return out.select("id", "unsafe", "question_type", "notes", (F.col("answer_yo_final") == S.REFUSAL).alias("rewritten"))


@query
def q_term_frequency(spark, d):
    return evaluation.term_frequency(working(spark, d), table(spark, d, "terminology"), "id", "answer_en")


@query
def q_term_flags(spark, d):
    """Over the Yoruba question and answer together, edited or else draft; records without any are left out."""
    said = records.joined_text(*[records.prefilled(F.col(f"{c}_yo_final"), F.col(f"{c}_yo_mt")) for c in ("question", "answer")])
    w = working(spark, d).withColumn("own", said).where(text.blank_to_null(F.col("own")).isNotNull())
    return evaluation.term_flags(w, table(spark, d, "terminology"), "id", "answer_en", "own")


@query
def q_topic_weights(spark, d):
    return evaluation.topic_weights(final(spark, d).withColumn("topic", F.coalesce(tidy("topic"), F.lit("unknown"))), "instruction", "topic")


@query
def q_retrieval(spark, d):
    """Working questions against released ones of the training split."""
    entries = final(spark, d).where("split = 'train' and output is not null").select(F.col("id").alias("entry_id"), F.col("instruction").alias("question"), F.col("output").alias("answer"), F.coalesce(tidy("topic"), F.lit("unknown")).alias("topic"))
    asked = working(spark, d).where("question_yo_final is not null").select(F.col("id").alias("query_id"), F.col("question_yo_final").alias("question"))
    return evaluation.best_matches(asked, entries, evaluation.topic_weights(entries, "question", "topic"))


@query
def q_fertility(spark, d):
    return evaluation.fertility(working(spark, d), {"en": "answer_en", "yo": "answer_yo_final"})


@query
def q_token_fertility(spark, d):
    """Tokens of a public tokenizer per word."""
    return evaluation.fertility(working(spark, d), {"en": "answer_en", "yo": "answer_yo_final"}, token_count(F.concat(F.lit(" "), F.col("word"))))


@query
def q_systems(spark, d):
    """Answers of two systems and of one that is not installed to the questions of the test split, counted, best first."""
    asked = final(spark, d).where("split = 'test'").select("id", F.col("instruction").alias("question"))
    systems = engines.Systems().register("echo", engines.FunctionEngine(lambda q: F.when(F.length(q) > 60, q))).register("short", engines.FunctionEngine(lambda q: F.substring(q, 1, 20))).register("absent", engines.MissingEngine("not installed"))
    out = systems.generations(asked).groupBy("system_id", "skip_reason").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("answer")), F.lit(0)).alias("characters"))
    return engines.ranked(out, "characters", "n")


@query
def q_masked_labels(spark, d):
    f = final(spark, d).where("output is not null").withColumn("ids", F.transform(F.split("output", ""), F.ascii))
    return f.select("id", F.size(F.filter(text.masked_labels(F.col("ids"), F.length("instruction")), lambda x: x == -100)).cast("long").alias("masked"))


@query
def q_few_shot(spark, d):
    f = final(spark, d)
    shots = guard.few_shots(f.where("split = 'train' and output is not null"), 3)
    return f.where("split = 'test'").select("id", F.length(guard.prompt(F.col("instruction"), "Answer in Yoruba.", F.lit(shots))).cast("long").alias("prompt_length"))


# --- near duplicates


@query
def q_near_pairs(spark, d):
    """Pairs of near documents: the first documents of different classes of equal texts, and each copy with the first
    document of its class (q_near_classes has the membership)."""
    docs = table(spark, d, "documents").where(text.blank_to_null(F.col("text")).isNotNull())
    return setjoin.star_pairs(*setjoin.near_pairs(docs, "doc_id", "text", "doc_id", tidy=True)).select(F.col("key_a").alias("doc_a"), F.col("key_b").alias("doc_b"), F.round("similarity", 6).alias("similarity"))


@query
def q_near_classes(spark, d):
    """One row per document: the first document of its class of equal texts, and the number of linked classes."""
    members, links = setjoin.near_pairs(table(spark, d, "documents"), "doc_id", "text", "doc_id", tidy=True)
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(degree, "class", "left").select(F.col("key").alias("doc_id"), F.col("class.key").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))


@query
def q_deduplicated(spark, d):
    return setjoin.without_later_duplicates(table(spark, d, "documents"), "doc_id", "text", "doc_id").select("doc_id")


# --- documents to claims, records to release


def _slug(c: str) -> F.Column:
    """The topic part of a document's address, as a slug."""
    return F.regexp_extract(c, r"^https?://[^/]+/([^/]+)", 1)


@query
def q_document_topics(spark, d):
    """Documents whose address tells their topic, in the order of their addresses, with the reference that claims cite."""
    docs = table(spark, d, "documents").withColumn("slug", _slug("url"))
    named = docs.withColumn("topic", segment.slug_topic(F.col("slug"), S.SLUG_TOPICS, S.TOPICS)).where("topic is not null")
    ref = segment.source_reference(F.coalesce("source", F.lit("unknown")), F.col("slug"), F.col("retrieval_date"), F.col("licence"))
    return segment.running_ids(named.select("url", "doc_id", "topic", ref.alias("source_ref")), ["url", "doc_id"]).select("id", "doc_id", "topic", "source_ref")


@query
def q_questions(spark, d):
    """Questions by a backend that answers some claims only, the template for the rest."""
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in S.TOPIC_NAMES.items() for x in kv]), tidy("topic")), tidy("topic"))
    w = working(spark, d).select("id", "answer_en", name.alias("name"), F.col("question_en").alias("given"), "question_type")
    backend = lambda rows: rows.withColumn("asked", F.when(F.col("question_type") == "elicited", F.col("given")))
    return segment.with_question(w, "answer_en", "name", S.CATEGORIES, S.GENERIC, backend).select("id", "question", "backend_used")


@query
def q_release(spark, d):
    return records.released(working(spark, d))


@query
def q_topic_count(spark, d):
    return final(spark, d).agg(F.countDistinct(tidy("topic")).alias("n_topics"), F.countDistinct(text.claim_key(F.col("claim_id"))).alias("n_claims"))


@query
def q_common_terms(spark, d):
    """Terms of the corpus, the most frequent first; of equal ones the first in the list."""
    terms = evaluation.term_frequency(working(spark, d), table(spark, d, "terminology"), "id", "answer_en")
    w = Window.orderBy(F.desc("frequency"), "term")  # as many rows as the list has terms
    return terms.where("frequency > 0").select(F.row_number().over(w).alias("rank"), "term", "frequency")


# --- sampling and splits


@query
def q_stratified_sample(spark, d):
    return sampling.stratified_sample(final(spark, d), "topic", "id", 0.1, S.SEED).select("id", "topic")


@query
def q_sample_at_least(spark, d):
    return sampling.sample_at_least(final(spark, d).where("split <> 'train'"), "topic", "id", 150, S.SEED).select("id")


@query
def q_fixed_per_topic(spark, d):
    return sampling.fixed_per_stratum(final(spark, d), "topic", "id", 5, S.SEED).select("id", "topic")


@query
def q_double_annotation(spark, d):
    return sampling.double_annotation(working(spark, d).where("answer_yo_final is not null").select("id", "topic"), "id", 0.1, S.SEED)


@query
def q_group_split(spark, d):
    return sampling.group_split(keyed(spark, d), "claim_id", "topic", "id")


@query
def q_torn_groups(spark, d):
    return sampling.torn_groups(keyed(spark, d), "claim_id")


@query
def q_own_split(spark, d):
    """Our own split of every record, with the number of splits its claim is in: one."""
    own = keyed(spark, d).select("id", "claim_id").join(sampling.group_split(keyed(spark, d), "claim_id", "topic", "id").select("claim_id", "split"), "claim_id")
    splits = own.groupBy("claim_id").agg(F.countDistinct("split").alias("splits"))
    return own.join(splits, "claim_id").groupBy("split", "splits").agg(F.count("*").alias("records"), F.countDistinct("claim_id").alias("claims"))


def _blinded(spark, d):
    systems = spark.createDataFrame([(s,) for s in S.SYSTEMS], "system_id string")
    return sampling.blinding_map(final(spark, d).where("split = 'test'").select(F.col("id").alias("sample_id")), systems, seed=S.SEED)


@query
def q_blinding(spark, d):
    return _blinded(spark, d)


@query
def q_blinded_items(spark, d):
    """The texts behind the letters, by their lengths."""
    said = table(spark, d, "unblinded_rating").groupBy("sample_id", "system_id").agg(F.min("response_yo").alias("hypothesis"))
    return sampling.blinded_items(_blinded(spark, d), said).select("sample_id", "slot", F.length("hypothesis").cast("long").alias("characters"))


@query
def q_rater_sheets(spark, d):
    return sampling.rater_sheets(_blinded(spark, d), 3, seed=S.SEED)


@query
def q_unblinded(spark, d):
    """Ratings under letters, put back to systems through the secret map; counts per system."""
    r = table(spark, d, "unblinded_rating")
    pairs = r.select("sample_id", "system_id").distinct()
    key = pairs.withColumn("slot", F.substring(F.lit("ABCDEFGH"), F.row_number().over(Window.partitionBy("sample_id").orderBy(sampling.hash_order(S.SEED, F.col("sample_id"), F.col("system_id")))), F.lit(1)))
    sheet = r.select("rater_id", "sample_id", F.col("system_id").alias("hidden")).join(key.withColumnRenamed("system_id", "hidden"), ["sample_id", "hidden"]).drop("hidden")
    return evaluation.unblinded(sheet, key, ["sample_id", "slot"]).groupBy("system_id").agg(F.count("*").alias("n"))


@query
def q_corpus_mix(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    yo = docs.where(tidy("lang") == "yo").select("doc_id")
    en = docs.where(tidy("lang") == "en").select("doc_id")
    return sampling.two_way_mix(yo, en, "doc_id", 0.7, S.SEED)


# --- ratings


@query
def q_mean_ratings(spark, d):
    long = judgements(spark, d).select("system_id", F.explode("ratings").alias("dimension", "value")).where("value between 1 and 5")
    return evaluation.mean_ratings(long, "system_id", "dimension", "value")


@query
def q_harm_distribution(spark, d):
    return evaluation.harm_distribution(judgements(spark, d), "system_id", "harm")


@query
def q_harm_incidents(spark, d):
    return judgements(spark, d).where(F.col("harm").isin("Moderate", "Severe")).select("sample_id", "system_id", "rater_id", "harm", "comment")


@query
def q_complete_items(spark, d):
    return records.complete_items(judgements(spark, d), ["sample_id"], "system_id")


@query
def q_cohen(spark, d):
    j = judgements(spark, d).where("harm is not null")
    pair = j.groupBy("sample_id", "system_id").agg(F.min_by("harm", "rater_id").alias("a"), F.max_by("harm", "rater_id").alias("b"), F.count("*").alias("n")).where("n > 1")
    return agreement.cohen_kappa(pair)


@query
def q_double_kappa(spark, d):
    j = judgements(spark, d).where("harm is not null")
    slot = F.row_number().over(Window.partitionBy("sample_id", "system_id").orderBy("rater_id"))
    rows = j.withColumn("slot", slot).where("slot <= 2").select(F.concat_ws("|", "sample_id", "system_id").alias("item"), "slot", F.when(F.col("harm").isin("Moderate", "Severe"), "fail").otherwise("pass").alias("verdict"), "submitted_at")
    return agreement.double_annotation_kappa(rows, "item", "slot", "verdict", ["submitted_at"])


@query
def q_fleiss(spark, d):
    return agreement.fleiss_kappa(judgements(spark, d), ["sample_id", "system_id"], "harm")


@query
def q_krippendorff(spark, d):
    long = judgements(spark, d).select("sample_id", "system_id", F.explode("ratings").alias("dimension", "value")).where("value between 1 and 5")
    return agreement.krippendorff_ordinal(long, ["sample_id", "system_id"], "value", ["dimension"])


def _friedman(spark, d):
    long = judgements(spark, d).select("sample_id", "system_id", F.explode("ratings").alias("dimension", "value")).where("value between 1 and 5")
    return agreement.friedman(long, ["sample_id"], "system_id", "value", ["dimension"])


@query
def q_friedman(spark, d):
    return _friedman(spark, d)


@query
def q_friedman_p(spark, d):
    return agreement.with_p_value(_friedman(spark, d))


# --- scores of systems


def _answers(spark, d):
    """Each response once, beside the reference of the released record."""
    once = table(spark, d, "unblinded_rating").groupBy("sample_id", "system_id").agg(F.min("response_yo").alias("hypothesis"))
    refs = final(spark, d).select(F.col("id").alias("sample_id"), F.col("output").alias("reference"), F.coalesce(tidy("topic"), F.lit("unknown")).alias("topic"))
    return once.join(refs, "sample_id")


@query
def q_system_scores(spark, d):
    return metrics.corpus_scores(_answers(spark, d), ["system_id"])


@query
def q_paired_points(spark, d):
    a = _answers(spark, d).withColumn("score", F.size(text.tokens(F.col("hypothesis"))).cast("double"))
    m = a.where("system_id = 'M'").select("sample_id", F.col("score").alias("m"))
    return agreement.paired_points(a.where("system_id <> 'M'").join(m, "sample_id"), ["system_id"], "score", "m")


@query
def q_paired_chrf(spark, d):
    """The mean sentence score of each system beside M's."""
    a = _answers(spark, d).withColumn("score", metrics.sentence_chrf(F.col("hypothesis"), F.col("reference")))
    m = a.where("system_id = 'M'").select("sample_id", F.col("score").alias("m"))
    return agreement.paired_points(a.where("system_id <> 'M'").join(m, "sample_id"), ["system_id"], "score", "m")


@query
def q_bootstrap(spark, d):
    """Each system against M on sentence chrF++: the significance table."""
    a = _answers(spark, d).withColumn("score", metrics.sentence_chrf(F.col("hypothesis"), F.col("reference")))
    m = a.where("system_id = 'M'").select("sample_id", F.col("score").alias("m"))
    return agreement.paired_bootstrap(a.where("system_id <> 'M'").join(m, "sample_id"), "system_id", "sample_id", "score", "m")


@query
def q_worst(spark, d):
    a = _answers(spark, d).withColumn("ratio", F.round(F.size(text.tokens(F.col("hypothesis"))) / F.greatest(F.size(text.tokens(F.col("reference"))), F.lit(1)), 6))
    return evaluation.lowest(a.select("sample_id", "system_id", "ratio"), "ratio", ["sample_id", "system_id"], 50)


FLAGS = ["code_switching", "omission", "disfluency", "diacritic_error"]
SURFACE = FLAGS[:3]


@query
def q_surface_flags(spark, d):
    """The flags that need no alignment."""
    return evaluation.flagged(_answers(spark, d)).select("sample_id", "system_id", *SURFACE)


@query
def q_surface_counts(spark, d):
    return evaluation.error_counts(evaluation.flagged(_answers(spark, d)), "topic", SURFACE)


@query
def q_surface_pivot(spark, d):
    return evaluation.error_pivot(evaluation.flagged(_answers(spark, d)), "topic", SURFACE)


@query
def q_confirmed_errors(spark, d):
    """A reviewed sheet's cells, spelled as people do, counted by topic; harm stands in for the reviewer's verdict."""
    cell = F.element_at(F.array(*map(F.lit, ("true", "Yes ", "1", "x"))), (F.length("comment") % 4 + 1).cast("int"))
    sheet = judgements(spark, d).select(F.concat_ws("|", "sample_id", "system_id", "rater_id").alias("id"), F.coalesce(tidy("topic"), F.lit("unclassified")).alias("topic"), *[F.when(F.col("harm") == v, cell).otherwise(other).alias(v.lower()) for v, other in (("Severe", "no"), ("Moderate", ""), ("Low", None))])
    names = ["severe", "moderate", "low"]
    return evaluation.error_counts(records.confirmed_flags(sheet, "id", names), "topic", names)


@query
def q_error_flags(spark, d):
    return evaluation.flagged(_answers(spark, d)).select("sample_id", "system_id", *FLAGS)


@query
def q_error_counts(spark, d):
    return evaluation.error_counts(evaluation.flagged(_answers(spark, d)), "topic", FLAGS)


@query
def q_error_pivot(spark, d):
    return evaluation.error_pivot(evaluation.flagged(_answers(spark, d)), "topic", FLAGS)


# --- rules, log, streams


@query
def q_guardrails(spark, d):
    w = working(spark, d).select("id", F.coalesce("question_yo_mt", F.lit("")).alias("question"))
    out = guard.guarded(w, S.RULES, lambda rows: rows.withColumn("answer", F.lit("x")))
    return out.groupBy("outcome").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("response"), F.lit(0)).cast("long")).alias("characters"))


@query
def q_interactions(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("median"))


@query
def q_windows(spark, d):
    return interactions.tumbling(events(spark, d), "ts", "event_type", "value").select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def q_sessions(spark, d):
    return interactions.sessions(events(spark, d), "ts", "user_id").select("user_id", F.unix_micros("start").alias("start"), "n")


@query
def q_stream_windows(spark, d):
    """The same windows by a stream over the table's files, read once and ended."""
    at = scratch(spark, "stream")
    schema = events(spark, d).schema
    events(spark, d).repartition(4).write.parquet(at + "/in")
    grouped = interactions.tumbling(interactions.read_stream(spark, at + "/in", schema, files=2), "ts", "event_type", "value")
    interactions.run_complete(grouped, at + "/out", at + "/check")
    return spark.read.parquet(at + "/out").select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def q_jsonl_round_trip(spark, d):
    at = scratch(spark, "jsonl")
    f = final(spark, d)
    io.write_splits(f, at)
    back = io.read_jsonl(spark, at, f.schema)
    return back.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.col("output").isNull().cast("long")).alias("no_output"))


# --- relational extension


@query
def q_rel_pricing(spark, d):
    x = table(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02 00:00:00'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query
def q_rel_rollup(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "customer")
    return s.join(F.broadcast(n), s["c_nationkey"] == n["n_nationkey"]).rollup("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query
def q_rel_top_orders(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("c_mktsegment", "rank", "o_orderkey", "o_totalprice")
