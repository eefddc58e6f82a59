import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cowrie.operators import agreement as A
from cowrie.operators import evaluation as E
from cowrie.operators import guard, records, sampling, segment, setjoin


def test_segmentation(spark):
    text = "Share\nIf you travel\nto these countries, you are at risk of fever. It is caused by a parasite.\n\nThe plan\n, made in 2021, gives a frame for all clinics.\net al., 2020\n(A whole line in brackets stands here.)\nToo short.\nlower case start is not a sentence at all."
    df = spark.createDataFrame([(1, text, "who"), (2, None, "who"), (3, "", None)], "doc_id long, text string, source string")
    rows = segment.exploded_claims(df, "doc_id", "text", "source").orderBy("doc_id", "position").collect()
    assert [r["claim"] for r in rows] == ["If you travel to these countries, you are at risk of fever.", "It is caused by a parasite.", "The plan , made in 2021, gives a frame for all clinics."]
    assert rows[0]["claim_id"] == "who-1-000"
    rules = [segment.Category("a", ("caused",), "Why {topic}?"), segment.Category("b", ("is",), "What is {topic}?", only=("x",))]
    out = df.limit(1).select(segment.classify(F.lit("It IS caused"), F.lit("y"), rules).alias("k")).select("k", segment.question_for(F.col("k"), F.lit("y"), rules, "?")).first()
    assert tuple(out) == ("a", "Why y?")


def test_running_ids_are_dense(spark):
    df = spark.range(1000).withColumn("k", F.md5(F.col("id").cast("string"))).drop("id")
    ids = [r["id"] for r in segment.running_ids(df, ["k"]).orderBy("k").collect()]
    assert ids == [f"rec-{i:06d}" for i in range(1, 1001)]


def test_keep_and_update(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, ""), ("b", 1, "y"), (None, 1, "n"), (None, 2, "n")], "id string, at int, v string")
    assert sorted(r["v"] for r in records.keep_last(df, ["id"], ["at"]).collect()) == ["", "n", "n", "y"]
    edits = spark.createDataFrame([("a", ""), ("b", "z")], "id string, v string")
    assert {(r["id"], r["v"]) for r in records.updated(records.keep_first(df, ["id"], ["at"]), edits, "id", ["v"]).collect()} == {("a", "x"), ("b", "z"), (None, "n")}
    one = records.merged_full(spark.createDataFrame([("a", "l", True)], "id string, s string, f boolean"), spark.createDataFrame([("a", "r", False), ("b", "r", True)], "id string, s string, f boolean"), "id", ["s"], ["f"])
    assert {tuple(r) for r in one.collect()} == {("a", "l", True), ("b", "r", True)}


def test_matched_questions_and_cache(spark):
    claims = spark.createDataFrame([("c", "t", "ans")], "claim_id string, topic string, answer string")
    q = spark.createDataFrame([(1, "c"), (2, "x"), (3, None)], "n long, matched_claim_id string")
    got = {r["n"]: (r["claim_id"], r["question_type"]) for r in records.matched_questions(q, claims).collect()}
    assert got == {1: ("c", "elicited"), 2: ("elicited-unmatched-000002", "out_of_scope"), 3: ("elicited-unmatched-000003", "out_of_scope")}
    seen = []

    def backend(todo):
        seen.append(todo.count())
        return todo.select("text_hash", F.upper("text").alias("result"))

    df = spark.createDataFrame([("hi",), ("hi",), ("",), (None,)], "t string")
    empty = spark.createDataFrame([], "text_hash string, result string")
    out, cache = records.cached_apply(df, "t", empty, backend)
    assert sorted(r["result"] for r in out.collect()) == ["", "", "HI", "HI"]
    records.cached_apply(df, "t", cache, backend)[0].count()
    assert seen == [1, 0]


def test_gates(spark):
    df = spark.createDataFrame([("pass", None), ("fail", ""), ("maybe", "x")], "v string, r string")
    wrong = records.verdict_problems(F.col("v"), F.col("r"))
    assert [r[0] for r in df.select(wrong).collect()] == [[], ["reason missing"], ["verdict unknown"]]
    with pytest.raises(records.GateError):
        records.gate(df, wrong)
    assert records.gate(df, wrong, allow=True).count() == 1
    assert df.select(records.appended_note(F.lit(None).cast("string"), F.lit("n"))).first()[0] == "n"


def test_record_and_edit_problems(spark):
    kind = "id string, claim_id string, instruction string, instruction_nodia string, output string, topic string, question_type string, validated_ling boolean, validated_clin boolean"
    good = ("r", "c", "Kí ni ibà?", "Ki ni iba?", "Ibà ni.", "t", "derived", True, False)
    put = lambda **new: tuple(new.get(k, v) for k, v in zip([c.split()[0] for c in kind.split(", ")], good, strict=True))
    rows = [
        (good, []),
        (put(instruction_nodia="Kí ni ibà?"), ["instruction_nodia out of sync"]),
        (put(instruction_nodia=None), ["instruction_nodia out of sync"]),
        (put(output="Iba\u0300 ni."), ["output not composed"]),
        (put(output="vaccines reduce cholera ni"), []),
        (put(output="vaccines reduce exact ni"), ["output not Yoruba"]),
        (put(output="..."), ["output not Yoruba"]),
        (put(validated_ling=None, output=None), ["output missing", "validated_ling missing"]),
        (put(instruction=None, instruction_nodia=None), ["instruction missing"]),
    ]
    df = spark.createDataFrame([r for r, _ in rows], kind).coalesce(1)
    assert [r[0] for r in df.select(records.record_problems(("derived",), ("t",))).collect()] == [w for _, w in rows]
    edits = spark.createDataFrame([("a", "Kí ni ibà?", "Ibà ni."), ("b", " ", None), (None, "which causes make cholera exactly", "Ibà")], "id string, question_yo_final string, answer_yo_final string").coalesce(1)
    assert [r[0] for r in edits.select(records.edit_problems()).collect()] == [[], ["question_yo_final missing", "answer_yo_final missing"], ["id missing", "question_yo_final not Yoruba"]]


def test_sampling(spark):
    df = spark.range(300).select(F.format_string("r%03d", "id").alias("id"), F.when(F.col("id") < 10, "small").when(F.col("id") < 200, "big").alias("topic"), (F.col("id") % 40).cast("string").alias("g"))
    s = {r["topic"]: r["count"] for r in sampling.stratified_sample(df, "topic", "id", 0.1).groupBy("topic").count().collect()}
    assert s == {"small": 1, "big": 19, None: 10}
    assert {r[0] for r in sampling.stratified_sample(df.repartition(7), "topic", "id", 0.1).select("id").collect()} == {r[0] for r in sampling.stratified_sample(df, "topic", "id", 0.1).select("id").collect()}
    assert sampling.fixed_per_stratum(df, "topic", "id", 3).count() == 9
    assert sampling.double_annotation(df, "id").groupBy("annotator_slot").count().where("annotator_slot = 2").first()["count"] == 30
    split = sampling.group_split(df, "g", "topic", "id")
    assert split.count() == 40 and split.select("g").distinct().count() == 40
    with pytest.raises(ValueError):
        sampling.group_split(df, "g", "topic", "id", (0.5, 0.1, 0.1))
    mix = sampling.two_way_mix(df.limit(100), df.subtract(df.limit(100)).limit(100), "id", 0.7)
    n = {r["side"]: r["count"] for r in mix.groupBy("side").count().collect()}
    assert abs(n["own"] / (n["own"] + n["other"]) - 0.7) < 0.02


def test_blinding(spark):
    samples = spark.createDataFrame([(f"s{i}",) for i in range(20)], "sample_id string")
    systems = spark.createDataFrame([("A1",), ("B1",), ("C1",)], "system_id string")
    rows = sampling.blinding_map(samples, systems).collect()
    assert len(rows) == 60 and all({r["slot"] for r in rows if r["sample_id"] == s} == {"A", "B", "C"} for s in ("s1", "s7"))
    with pytest.raises(ValueError):
        sampling.blinding_map(samples, spark.createDataFrame([(f"x{i}",) for i in range(9)], "system_id string"))
    sheets = sampling.rater_sheets(sampling.blinding_map(samples, systems), 2).collect()
    assert len(sheets) == 120 and sorted(r["position"] for r in sheets if r["rater"] == 1) == list(range(1, 61))


def test_agreement(spark):
    pair = lambda rows: A.cohen_kappa(spark.createDataFrame(rows, "a string, b string")).first()
    assert pair([("x", "x"), ("y", "y"), ("x", "x")])["kappa"] == 1.0
    assert pair([("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")])["kappa"] == 0.0
    assert pair([("x", "x"), ("x", "x")])["kappa"] == 1.0 and pair([("x", "x")])["kappa"] is None and pair([])["n"] == 0
    rows = [(i, r, str(v)) for i, vs in enumerate([(1, 1, 1), (2, 2, 2), (1, 1, 1), (3, 3, 3)]) for r, v in enumerate(vs)]
    f = A.fleiss_kappa(spark.createDataFrame(rows, "item int, rater int, label string"), ["item"], "label").first()
    assert f["kappa"] == 1.0 and f["raters"] == 3
    # a published ordinal example is not at hand: the coincidence formula in plain loops is the check
    rng = np.random.default_rng(1)
    data = [(i, r, int(rng.integers(1, 6))) for i in range(30) for r in range(4) if rng.random() > 0.2]
    got = A.krippendorff_ordinal(spark.createDataFrame(data, "item int, rater int, v int"), ["item"], "v").first()["alpha"]
    assert abs(got - _ordinal(data)) < 1e-5
    same = [(i, r, i % 3) for i in range(6) for r in range(2)]
    assert A.krippendorff_ordinal(spark.createDataFrame(same, "item int, rater int, v int"), ["item"], "v").first()["alpha"] == 1.0


def _ordinal(data):
    items = {}
    for i, _, v in data:
        items.setdefault(i, []).append(v)
    items = {i: v for i, v in items.items() if len(v) > 1}
    values = sorted({v for vs in items.values() for v in vs})
    n = {c: sum(vs.count(c) for vs in items.values()) for c in values}
    dist = lambda c, k: (sum(n[g] for g in values if min(c, k) <= g <= max(c, k)) - (n[c] + n[k]) / 2) ** 2
    total = sum(n.values())
    do = sum(dist(a, b) / (len(vs) - 1) for vs in items.values() for x, a in enumerate(vs) for y, b in enumerate(vs) if x != y)
    de = sum(n[a] * n[b] * dist(a, b) for a in values for b in values if a != b) / (total - 1)
    return 1 - do / de


def test_friedman_and_gamma(spark):
    rows = [(f"b{b}", s, v) for b, vs in enumerate([(1, 2, 3), (1, 2, 3), (1, 3, 2), (1, 2, 3)]) for s, v in zip("xyz", vs, strict=True)]
    df = spark.createDataFrame([("d", *r) for r in rows], "dim string, block string, system string, v int")
    r = A.with_p_value(A.friedman(df, ["block"], "system", "v", ["dim"])).first()
    assert (r["blocks"], r["systems"], r["chi2"]) == (4, 3, 6.5) and abs(r["p_value"] - 0.038774) < 1e-5
    assert abs(A.upper_gamma(0.5, 1.92) - 0.05) < 1e-3


def test_bootstrap(spark):
    df = spark.createDataFrame([("s", i, 10.0, 50.0) for i in range(50)], "system string, id int, a double, b double")
    r = A.paired_bootstrap(df, "system", "id", "a", "b", 200).first()
    assert r["diff"] == 40.0 and r["ci_low"] > 0 and r["p_value"] < 0.05
    noisy = df.withColumn("b", F.col("a") + F.col("id") % 5)
    whole, spread = A.paired_bootstrap(noisy, "system", "id", "a", "b", 300).first(), A.paired_bootstrap(noisy, "system", "id", "a", "b", 300, block=7).first()
    assert whole["diff"] == spread["diff"] and abs(whole["ci_low"] - spread["ci_low"]) < 0.2 and abs(whole["ci_high"] - spread["ci_high"]) < 0.2
    sizes = np.array([3, 10, 1])
    draws = A.resample_shares(sizes, 4000, [1])
    assert (draws.sum(axis=1) == 14).all() and np.allclose(draws.mean(axis=0), sizes, atol=0.15)
    diffs = np.arange(10.0)
    sums = A.block_sums(diffs, draws[:, 1], [2], chunk=50)
    assert abs((sums / draws[:, 1].clip(1)).mean() - 4.5) < 0.05 and sums[draws[:, 1] == 0].sum() == 0


def test_terms(spark):
    df = spark.createDataFrame([("1", "TB is bad. tb again", "iko"), ("2", "art and ART; COVID-19!", ""), ("3", None, None)], "id string, en string, yo string")
    terms = spark.createDataFrame([("TB", "iko"), ("covid-19", "kofidi"), ("none such", "x"), ("art", None)], "term_en string, canonical_yo string")
    assert {(r["term"], r["frequency"]) for r in E.term_frequency(df, terms, "id", "en").collect()} == {("TB", 1), ("covid-19", 1), ("none such", 0), ("art", 1)}
    assert {(r["id"], r["term"]) for r in E.term_flags(df, terms, "id", "en", "yo").collect()} == {("2", "covid-19")}


def test_set_join_against_brute_force(spark):
    from cowrie.functions.grams import gram_set, plain

    rng = np.random.default_rng(3)
    words = [f"w{i}x{i * 7 % 13}" for i in range(60)]
    texts = [" ".join(rng.choice(words, 14)) for _ in range(60)]
    texts += [t.replace(t[5:8], "zz", 1) for t in texts[:20]] + texts[:3] + ["", None, "abc", "ABC "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    members, links = setjoin.near_pairs(df, "id", "t", "id", 0.8)
    cls = {}
    for r in members.collect():
        cls.setdefault(r["class"], []).append(r["key"])
    got = {(min(x, y), max(x, y)) for r in links.collect() for x in cls[r["a"]] for y in cls[r["b"]]} | {(x, y) for ids in cls.values() for x in ids for y in ids if x < y}
    grams = [gram_set(plain(t or "")) for t in texts]
    alike = lambda a, b: (len(a & b) / len(a | b) if a | b else 1.0) >= 0.8
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if alike(grams[i], grams[j])}
    assert got == want
    star = [(r["key_a"], r["key_b"]) for r in setjoin.star_pairs(members, links).collect()]
    assert len(star) == len(set(star)) and set(star) <= want and {c.key for c in cls} | {b for _, b in star} == set(range(len(texts)))
    sided = setjoin.text_classes(df, "id", "t", "id").where("text <> ''").groupBy("cls").agg(F.min("text").alias("text")).persist()
    once = {tuple(r) for r in setjoin.candidates(sided, 0.8, itself=True).collect()}
    salted = {tuple(r) for r in setjoin.candidates(sided, 0.8, itself=True, crowd=2).collect()}
    assert salted == once and once
    kept = {r["id"] for r in setjoin.without_later_duplicates(df, "id", "t", "id", 0.8).collect()}
    assert kept == {j for j in range(len(texts)) if not any((i, j) in want for i in range(j))}


def test_set_join_meets_few_but_similar_texts(spark):
    """Long texts of the same words: hardly a pair is compared in full but the similar ones, at every size."""
    from cowrie.functions.grams import gram_set

    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abdefgiklmnorstuwy"), 6)) for _ in range(600)]
    texts = [" ".join(rng.choice(words, n)) for n in (140, 160, 185, 300) for _ in range(60)]
    texts += [t[: int(len(t) * share)] + t[int(len(t) * share) + 60 :] for t in texts[::12] for share in (0.2, 0.7)] + [t[: int(len(t) * 0.88)] for t in texts[::9]]
    grams = [gram_set(t) for t in texts]
    alike = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(grams[i] & grams[j]) >= 0.85 * len(grams[i] | grams[j])}
    df = spark.createDataFrame(list(enumerate(texts)), "cls long, text string").persist()
    met = [tuple(sorted(r)) for r in setjoin.candidates(df, 0.85, itself=True).collect()]
    assert set(met) >= alike and len(alike) > 60
    assert len(met) == len(set(met)) < 2 * len(alike)
    # the same, however ranges are searched
    alone = {tuple(sorted(r)) for r in setjoin.own_candidates(df, 0.85, per_task=5_000, room=0, least=0).collect()}
    assert alone == set(met)


def test_set_join_writes_each_text_once(spark, monkeypatch):
    """q_near_classes: of what is written, only the table of classes has every text; copies and unlike texts come once or not at all."""
    from cowrie import session

    written = {}

    def cut(df, label="t", **more):
        out = session.cut(df, label, **more)
        written.setdefault(label, []).append(out)
        return out

    monkeypatch.setattr(setjoin, "cut", cut)
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abdefgiklmnorstuwy"), 6)) for _ in range(600)]
    texts = [" ".join(rng.choice(words, 150)) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:10], texts[11][:-9]])], "id int, t string")
    setjoin.near_pairs(df, "id", "t", "id")
    held = {label: sum(out.count() for out in outs) for label, outs in written.items() if any("text" in out.columns for out in outs)}
    assert held["classes"] == 41 and sum(held.values()) - 41 == 2


def test_shuffles_of_a_written_table_are_removed(spark):
    """q_deduplicated: room that a shuffle took is free once its table is written."""
    from cowrie.session import cut

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x for x in str(disk.getAllFiles().mkString("|")).split("|") if "shuffle_" in x}
    before, setting = shuffles(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    out = cut(spark.range(1000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")), "t", free=True)
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and out.agg(F.sum("s")).first()[0] == 499500
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting


def test_set_join_leaves_no_working_tables(spark):
    """q_deduplicated: when its result is there, the tables of texts and of candidates are gone, not kept until the process ends."""
    from cowrie.session import shared_folder

    folder = shared_folder(spark).removeprefix("file://") + "/cowrie"
    tables = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = tables()
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abdefgiklmnorstuwy"), 6)) for _ in range(600)]
    texts = [" ".join(rng.choice(words, 150)) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:10], texts[11][:-9], "", None])], "id int, t string")
    kept = setjoin.without_later_duplicates(df, "id", "t", "id")
    assert {x.rpartition("-")[0] for x in tables() - before} == {"members", "links"}
    assert {r["id"] for r in kept.collect()} == {*range(40), 51}


def test_set_join_entries_are_compressed(spark):
    """q_near_classes: entries take much less room in the shuffle than their bytes, of which most are hashes."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abdefgiklmnorstuwy"), 6)) for _ in range(900)]
    texts = spark.createDataFrame([(int(rng.integers(1 << 62)), " ".join(rng.choice(words, 150))) for _ in range(1500)], "cls long, text string").withColumn("size", setjoin.gram_sizes(5)("text")).repartition(4).persist()
    texts.count()
    counts = spark.sparkContext.broadcast(setjoin.gram_counts(texts, 5))
    top = max(setjoin.distinct_grams([r["text"] for r in texts.collect()], 5)[2])
    number, (low, high, k) = next((i, r) for i, r in enumerate(setjoin.size_ranges(int(top))) if r[1] > top)
    spark.sparkContext.setJobGroup("entries", "entries")
    setjoin._met(texts, counts, [(number, low, high, k, 2)], 0.85, 5, 200_000).collect()
    spark.sparkContext.setJobGroup("rest", "rest")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {i for job in tracker.getJobIdsForGroup("entries") for i in tracker.getJobInfo(job).stageIds}
    written = sum(store.lastStageAttempt(i).shuffleWriteBytes() for i in stages)
    rank = setjoin.rarity(counts.value)[0]
    entries = 0
    for part in np.array_split([r["text"] for r in texts.collect()], 4):
        h, owner, size = setjoin.distinct_grams(list(part), 5)
        mine = ((size >= low) & (size <= int((high - 1) / 0.85 + 1e-9)))[owner]
        entries += len(setjoin.class_prefixes(h[mine], owner[mine], k, rank, 0.85)[0])
    assert entries > 50_000 and 0 < written < 0.6 * entries * sum(np.dtype(t).itemsize for _, t in setjoin.OWN)
    x = np.array([0, 1, 255, 256, 2**31], dtype="<u4")
    assert all((setjoin.unpacked_column(setjoin.packed_column(x, c), c, "<u4") == x).all() for c in ("key", "size"))


def test_guard(spark):
    rules = guard.Rules(("iba", "omi mimu"), ("dose",), "no", "see a doctor", "note")
    asked = []

    def backend(rows):
        asked.append(sorted(r["question"] for r in rows.collect()))
        return rows.withColumn("answer", F.lit(" yes "))

    q = spark.createDataFrame([("ibà ni",), ("iba dose?",), ("weather",), (" ",), (None,), ("cached iba",)], "question string")
    cache = spark.createDataFrame([("cached iba", "kept")], "question string, answer string")
    got = {r["question"]: (r["outcome"], r["response"]) for r in guard.guarded(q, rules, backend, cache=cache).collect()}
    assert got["ibà ni"] == ("answered", "yes\n\nnote") and got["iba dose?"] == ("clinical_boundary", "see a doctor") and got["weather"] == ("out_of_scope", "no")
    assert got[" "][0] == "blank" and got["cached iba"] == ("cached", "kept") and asked == [["ibà ni"]]
    log = guard.interaction(guard.guarded(q, rules, lambda r: r.withColumn("answer", F.lit("a")), cache=cache))
    assert log.count() == 4 and "question" not in log.columns


def test_retrieval(spark):
    entries = spark.createDataFrame([("e1", "kini ami iba", "long answer", "t1"), ("e2", "kini ami atogbe", "b", "t2"), ("e3", "kini ami iko", "c", "t3"), ("e4", "kini ami eje riru", "d", "t4"), ("e5", "bawo omo", "d", "t5")], "entry_id string, question string, answer string, topic string")
    q = spark.createDataFrame([("q1", "Kí ni àmì ibà?"), ("q2", "iresi sise")], "query_id string, question string")
    got = {r["query_id"]: r["entry_id"] for r in E.best_matches(q, entries, E.topic_weights(entries, "question", "topic"), anchor=1.5).collect()}
    assert got == {"q1": "e1"}


def test_retrieval_follows_the_plain_rule(spark):
    import difflib
    import math

    rng = np.random.default_rng(4)
    words = [f"w{i}{'abcdefgh'[i % 8] * (i % 4)}" for i in range(200)]
    ask = lambda k: " ".join(rng.choice(words, k))
    data = [(f"e{i:03d}", ask(int(rng.integers(3, 9))), "x" * int(rng.integers(1, 5)), f"t{i % 9}") for i in range(150)]
    data += [(f"f{i}", data[i][1], "longer answer", "t1") for i in range(9)]
    # the top overlap exceeds 0.29 with e-hi, but e-chars has the higher score by its characters
    data += [("e-hi", "kokoro iba gbona pupo", "a", "u1"), ("e-chars", "kokoro ibaa gbonaa patapat", "b", "u2")]
    asked = [(f"q{i:03d}", ask(int(rng.integers(3, 9)))) for i in range(60)] + [("r", data[3][1] + " unseen"), ("c", "kokoro ibaa gbona patapata"), ("s", " "), ("t", None)]
    entries = spark.createDataFrame(data, "entry_id string, question string, answer string, topic string")
    topics = {}
    for _, t, _, k in data:
        for w in set(t.split()):
            topics.setdefault(w, set()).add(k)
    n = len({k for *_, k in data})
    idf = lambda w: math.log((n + 1) / (len(topics.get(w, ())) + 1)) + 1
    want = {}
    for i, t in asked:
        a, found = set((t or "").split()), []
        for e, u, answer, _ in data:
            b = set(u.split())
            overlap = sum(map(idf, a & b)) / sum(map(idf, a | b))
            ratio = difflib.SequenceMatcher(None, t or "", u).ratio()
            if max(map(idf, a & b), default=0.0) >= 1.5 and (overlap >= 0.16 or ratio >= 0.55):
                found.append((-round(max(overlap, ratio), 9), -len(answer), e))
        if found:
            want[i] = (min(found)[2], round(-min(found)[0], 6))
    for blocks in ({}, {"block": 30}):
        rows = E.best_matches(spark.createDataFrame(asked, "query_id string, question string"), entries, E.topic_weights(entries, "question", "topic"), anchor=1.5, **blocks).collect()
        assert {r["query_id"]: (r["entry_id"], r["score"]) for r in rows} == want
    assert len(want) > 30 and want["c"][0] == "e-chars"


def test_flags_of_wrong_marks(spark):
    from cowrie.plans.catalog import FLAGS

    rows = [("ibà ni àrùn", "ibà ni àrùn", "t"), ("iba ni arun", "ibà ni àrùn", "t"), ("ibà ni arun wa", "ibà ni àrùn wa", "t"), ("omi", "ibà ni", "u"), (None, "ibà", "u")]
    df = E.flagged(spark.createDataFrame(rows, "hypothesis string, reference string, topic string").coalesce(1))
    assert [r[0] for r in df.select("diacritic_error").collect()] == [False, True, False, True, True]
    assert {(r["topic"], r["n"]) for r in E.error_counts(df, "topic", FLAGS).where("error = 'diacritic_error'").collect()} == {("t", 1), ("u", 2)}
    assert {(r["topic"], r["diacritic_error"]) for r in E.error_pivot(df, "topic", FLAGS).collect()} == {("t", 1), ("u", 2)}


def test_term_flags_read_question_draft_and_bare_forms(spark, tmp_path):
    from cowrie.plans.catalog import queries

    at = "2026-01-01 00:00:00"
    rows = [("question", "Kí ni ikọ́?", "x", None, "Bẹ́ẹ̀ ni."), ("draft", None, "x", "", "Ikọ́ ni."), ("bare", "x", None, "IKO ni", None), ("lacks", "x", "ikọ́", "y", "ikọ́"), ("none", None, None, None, None), ("blank", "", None, " ", None)]
    df = spark.createDataFrame([(i, "TB is bad", *r) for i, *r in rows], "id string, answer_en string, question_yo_final string, question_yo_mt string, answer_yo_final string, answer_yo_mt string")
    df.withColumns({c: F.lit(at).cast("timestamp") for c in ("received_at", "updated_at")}).write.parquet(f"{tmp_path}/working_record.parquet")
    spark.createDataFrame([("TB", "ikọ́")], "term_en string, canonical_yo string").write.parquet(f"{tmp_path}/terminology.parquet")
    assert [tuple(r) for r in queries()["q_term_flags"](spark, str(tmp_path)).collect()] == [("lacks", "TB", "ikọ́")]


def test_fleiss_uses_every_number_of_ratings(spark):
    votes = {"a": "xxx", "b": "xyy", "c": "yyy", "d": "xy", "e": "xx", "f": "x", "g": "xxyz"}
    rows = [(i, r, v) for i, vs in votes.items() for r, v in enumerate(vs)] + [("h", 0, None), ("h", 1, None)]
    got = {r["raters"]: r for r in A.fleiss_kappa(spark.createDataFrame(rows, "item string, rater int, label string"), ["item"], "label").collect()}
    assert set(got) == {2, 3, 4} and [got[m]["items"] for m in (2, 3, 4)] == [2, 3, 1]
    for m, row in got.items():
        items = [vs for vs in votes.values() if len(vs) == m]
        po = sum((sum(vs.count(c) ** 2 for c in "xyz") - m) / (m * (m - 1)) for vs in items) / len(items)
        pe = sum(("".join(items).count(c) / (m * len(items))) ** 2 for c in "xyz")
        assert (row["observed"], row["expected"], row["kappa"]) == (round(po, 6), round(pe, 6), round((po - pe) / (1 - pe), 6))


def test_release_gates_and_reports(spark):
    df = spark.createDataFrame([("1", "c", "Ẹ̀?", "a b", None, None, None, None, True, None), ("2", "c", " ", "x", "t", "derived", "e", "r", True, True)], "id string, claim_id string, question_yo_final string, answer_yo_final string, topic string, question_type string, answer_en string, source_ref string, validated_ling boolean, validated_clin boolean")
    (r,) = records.released(df).collect()
    assert (r["id"], r["instruction_nodia"], r["input"], r["topic"], r["question_type"], r["source_en"], r["validated_ling"], r["validated_clin"]) == ("1", "E?", "", "unclassified", "derived", "", True, False)
    sheet = spark.createDataFrame([("1", "yes", " x "), ("2", None, "no"), ("3", "TRUE", "1")], "id string, f string, g string")
    assert {(r["id"], r["f"], r["g"]) for r in records.confirmed_flags(sheet, "id", ["f", "g"]).collect()} == {("1", True, True), ("2", False, False), ("3", True, True)}
    open_ = sheet.withColumn("g", F.when(F.col("id") == "2", " suggested ").otherwise(F.col("g")))
    assert [tuple(r) for r in records.unresolved_flags(open_, "id", ["f", "g"]).collect()] == [("2", "g")]
    with pytest.raises(records.GateError):
        records.confirmed_flags(open_, "id", ["f", "g"])
    (r,) = df.where("id = '1'").select(records.text_reports(["question_yo_final", "topic"]).alias("r")).collect()
    assert [(x["column"], x["valid"]) for x in r["r"]] == [("question_yo_final", True)]


def test_topics_references_questions(spark):
    df = spark.createDataFrame([("malaria", "x is caused by y", "malaria"), ("odd", "nothing", "malaria")], "slug string, claim string, name string")
    topics = {"malaria": "malaria", "gone": "not valid"}
    assert [r[0] for r in df.select(segment.slug_topic(F.col("slug"), topics, ("malaria",))).collect()] == ["malaria", None]
    assert df.select(segment.source_reference(F.lit("s"), F.col("slug"), F.lit("2024-01-01"), F.lit("open"))).first()[0] == "s (malaria), retrieved 2024-01-01, licence: open"
    cats = [segment.Category("causes", ("caused",), "What causes {topic}?")]
    plain = segment.with_question(df, "claim", "name", cats, "What of {topic}?")
    assert [(r["question"], r["backend_used"]) for r in plain.collect()] == [("What causes malaria?", "template"), ("What of malaria?", "template")]
    backend = lambda rows: rows.withColumn("asked", F.when(F.col("slug") == "malaria", " Why? ").otherwise("no question"))
    got = segment.with_question(df, "claim", "name", cats, "What of {topic}?", backend)
    assert [(r["question"], r["backend_used"]) for r in got.collect()] == [("Why?", "model"), ("What of malaria?", "template_fallback")] and "asked" not in got.columns


def test_engines(spark):
    from cowrie.operators import engines as N

    asked = spark.createDataFrame([("1", "abc"), ("2", None)], "id string, question string")
    systems = N.Systems().register("up", N.FunctionEngine(F.upper)).register("no", N.MissingEngine("not installed"))
    got = {(r["system_id"], r["id"]): (r["answer"], r["skip_reason"]) for r in systems.generations(asked).collect()}
    assert got == {("up", "1"): ("ABC", None), ("up", "2"): (None, "no answer"), ("no", "1"): (None, "not installed"), ("no", "2"): (None, "not installed")}
    with pytest.raises(KeyError):
        systems.generations(asked, ["up", "x"])
    with pytest.raises(ValueError):
        systems.register("up", N.MissingEngine("again"))
    scores = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None)], "system_id string, s double")
    more = N.with_optional_scores(scores, {"m": (None, "no package"), "k": (lambda d: d.where("s > 1").select("system_id", F.col("s").alias("k")), "")})
    assert {r["system_id"]: (r["m"], r["m_skip_reason"], r["k"], r["k_skip_reason"]) for r in more.collect()} == {"a": (None, "no package", None, "no score"), "b": (None, "no package", 3.0, None), "c": (None, "no package", None, "no score")}
    assert [r["system_id"] for r in N.ranked(scores, "s", "system_id").orderBy("place").collect()] == ["b", "a", "c"] and N.best_setting(scores, "s", "system_id").first()["system_id"] == "b"


def test_token_counts(spark):
    from cowrie.functions.tokenizer import FOLDER, VOCABULARY, encoder, token_count

    df = spark.createDataFrame([("hello world",), ("",), (None,), ("ọ̀rọ̀",)], "t string")
    one = encoder(f"{FOLDER}/{VOCABULARY}")
    assert [r[0] for r in df.select(token_count(F.col("t"))).collect()] == [len(one.encode_ordinary(t)) if t else 0 for t in ("hello world", "", None, "ọ̀rọ̀")]
