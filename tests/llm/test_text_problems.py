"""Problems 1, 3, 7, 8, 10: text operators, their defined results and edge cases."""

import math
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from cowrie.llm import confusables as C
from cowrie.llm import langid as L
from cowrie.llm import pairs as P
from cowrie.llm import quality as Q
from cowrie.llm import textstats as S
from cowrie.llm import tokens as T
from cowrie.llm.quality_holdout import CALIBRATION, HELD_OUT

PATH = f"{T.FOLDER}/{T.VOCABULARY}"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Báwо ni", "Báwo ni"), ("β-kárótíìnì", "β-kárótíìnì"), ("👩‍⚕️ ok", "👩‍⚕️ ok"), ("ｍｏ１？", "mo1?"), ("a‌b c⁠d﻿", "ab cd"), ("ﬁ", "fi"),
        ("30 °C ½ № ² “x” –", "30 °C ½ № ² “x” –"), ("ẹ̀", "ẹ̀"), ("ẹ̀", "ẹ̀"), ("ò", "ò"), ("Ежедневно", "Ежедневно"), ("Аgbo", "Agbo"), ("", ""), (None, None), ("👍🏾", "👍🏾"), ("a️", "a"),
    ],
)
def test_consistent_form(text, want):
    got = C.canonical_form(text)
    assert got == want and C.canonical_form(got) == got


def test_script_sets():
    assert C.resolved_scripts("日本のテスト") == {"Japanese"} and C.resolved_scripts("アー") >= {"Katakana"} and C.resolved_scripts("日本а") == frozenset()
    assert C.canonical_form("Ꭺgbo ṣe dáadáa") == "Agbo ṣe dáadáa" and C.canonical_form("日本のテスト á") == "日本のテスト á"
    assert C.resolved_scripts("Agbo") == {"Latin"} and C.resolved_scripts("Báwо") == frozenset() and C.resolved_scripts("12") is None


def test_inconsistent_texts(spark):
    df = spark.createDataFrame([("1", "о" * 3 + "a", None), ("1", "о" * 3 + "a", None), ("2", "fine", ""), ("3", "x y", "ẹ̀" * 20000 + "​"), (None, "ok", None)], "id string, a string, field string")
    assert sorted(map(tuple, C.inconsistent_texts(df, ["a", "field"]).collect())) == [("1", "a"), ("3", "a"), ("3", "field")]
    assert C.inconsistent_texts(df.limit(0), ["a"]).count() == 0
    assert C.with_consistent_text(df, ["a"]).columns == ["id", "a", "field", "a_canonical"]


def test_encoding_is_exact(spark):
    texts = ["a" * 3000, " " * 3000 + "x", "don't " * 800, "\n\n  \n" * 700, "a;b " * 50 + "  " * 300 + "ọ̀ " * 400, None, "", "ẹ̀jẹ̀ ríru <|endoftext|>", "a" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    for chunk, overlap in ((300, 40), (64, 16), (8192, 512)):
        got = {r["doc_id"]: r["ids"] for r in T.encode_corpus(df, chunk=chunk, overlap=overlap).collect()}
        assert len(got) == len(texts) and all(got[i] == T.encode(t, PATH) for i, t in enumerate(texts))
    assert got[5] == got[6] == [] and all(T.decode(got[i], PATH) == t for i, t in enumerate(texts) if t)
    again = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "doc_id long, text string")
    assert T.encode_corpus(again).count() == 3 and T.encode_corpus(again.limit(0)).count() == 0
    assert {r["tokens"] for r in T.count_tokens(df, chunk=300, overlap=40).where("doc_id = 2").collect()} == {len(got[2])}


def test_pieces_of_one_text_are_spread(spark):
    text = "ọ̀rọ̀ kan, àti òmíràn. " * 2000
    df = spark.createDataFrame([(None, text)], "doc_id long, text string").withColumn("_row", F.lit(7).cast("long"))
    cut = T.pieces(df, "text", ["doc_id", "_row"], 500, 60).withColumn("task", F.spark_partition_id())
    rows = cut.collect()
    assert len(rows) > 50 and len({r["task"] for r in rows}) == 4
    assert "".join(r["text"] for r in sorted(rows, key=lambda r: r["piece"])) == text
    chunks = T._chunks(df, "text", ["doc_id", "_row"], 500, 60).withColumn("task", F.spark_partition_id())
    assert len({r["task"] for r in chunks.select("task").collect()}) == 4
    assert T.encode_corpus(df.drop("_row"), chunk=500, overlap=60).first()["ids"] == T.encode(text, PATH)


SENTENCES = {
    "yo": ["Ọmọ náà lọ sí ọjà pẹ̀lú ìyá rẹ̀ ní àárọ̀.", "Àwọn olùkọ́ ní ilé ìwé ń kọ́ àwọn ọmọ ní ọ̀rọ̀ ìlera.", "Wọ́n ra ẹja àti ata kí òjò tó bẹ̀rẹ̀.", "Ẹ jẹ́ kí a mu omi tó mọ́ lójoojúmọ́."],
    "en": ["The children went to the market with their mother.", "Teachers at the school tell the pupils about health.", "They bought fish and pepper before the rain began.", "Let us drink clean water every day."],
    "fr": ["Les enfants sont allés au marché avec leur mère.", "Les maîtres parlent de la santé à l'école.", "Ils ont acheté du poisson avant la pluie.", "Buvons de l'eau propre chaque jour."],
    "ha": ["Yara sun tafi kasuwa tare da mahaifiyarsu.", "Malamai suna koya wa yara game da lafiya a makaranta.", "Sun sayi kifi da barkono kafin a fara ruwa.", "Mu sha ruwa mai tsabta kowace rana."],
    "ig": ["Ụmụaka gara ahịa ha na nne ha.", "Ndị nkụzi na-akụziri ụmụ akwụkwọ ihe gbasara ahụike.", "Ha zụtara azụ na ose tupu mmiri ezoo.", "Ka anyị ṅụọ mmiri dị ọcha kwa ụbọchị."],
    "pcm": ["Di pikin dem don go market with dia mama.", "Teacher dey tell pikin dem about health for school.", "Dem don buy fish and pepper before rain start to fall.", "Make we dey drink clean water every day o."],
}


def model():
    texts = [(s, c) for c, ss in SENTENCES.items() for s in ss]
    return L.train([s for s, _ in texts] * 3, [c for _, c in texts] * 3)


def test_language_segments(spark):
    m = model()
    df = spark.createDataFrame([("1", SENTENCES["yo"][0] + " " + SENTENCES["en"][1], "x"), ("2", None, "x"), ("3", "  ", "x"), ("4", "12 – 34", "x"), ("5", SENTENCES["fr"][3] * 900, "x")], "id string, t string, lang string")
    rows = L.language_segments(df, m, ["t"]).orderBy("id", "segment").collect()
    assert [(r["id"], r["segment"], r["lang"]) for r in rows if r["id"] in "14"] == [("1", 0, "yo"), ("1", 1, "en"), ("4", 0, "und")]
    docs = {r["id"]: r["lang"] for r in L.document_languages(L.language_segments(df, m, ["t"])).collect()}
    assert docs["5"] == "fr" and "2" not in docs and "3" not in docs
    assert L.language_segments(df.limit(0), m, ["t"]).count() == 0


def test_held_out_languages():
    m = model()
    best, sure = m.classify([L._bare(s) for s in SENTENCES["yo"]] + ["She went to school with her mother.", "Ils vont à l'école avec la mère."])
    assert [m.languages[i] for i in best] == ["yo"] * 4 + ["en", "fr"] and (sure > 0.5).all()


Q1, Q2 = "Kí ni ibà?", "Báwo ni a ṣe ń dènà àrùn jẹjẹrẹ fún àwọn ọmọdé?"
YO = SENTENCES["yo"]
# pairs labelled by hand, in words that are in none of the labelling functions' tables as a whole
CHECKED = [
    (Q1, None, "empty"), (Q1, " N/A ", "empty"), (Q1, "[ ]", "empty"), (Q1, "…", "empty"), (Q1, "TBD", "empty"),
    ("Kí ni ibà fún àwọn ọmọdé?", "KI NI IBA FUN AWON OMODE", "copy"), ("Kí ni ibà fún àwọn ọmọdé?", "Ìdáhùn: Kí ni ibà fún àwọn ọmọdé?", "copy"), (Q2, Q2, "copy"), (Q2, "“" + L._bare(Q2) + "”", "copy"),
    (Q1, "Mo tọrọ gáfárà, èmi kò lágbára, mi ò le dá yín lóhùn. Ẹ jọ̀wọ́, ẹ rí oníṣègùn ní Ìta.", "refusal"), (Q2, "N kò ní àṣẹ láti sọ nípa èyí. Ẹ jọ̀wọ́, ẹ lọ sí ilé ìwòsàn.", "refusal"),
    (Q1, "Unfortunately I must not advise anyone on this matter. Please visit a hospital near you.", "refusal"), (Q2, "My makers do not let me help with such things, and I cannot tell you more.", "refusal"), (Q1, "Je ne suis pas en mesure de vous aider. Veuillez voir un médecin.", "refusal"),
    (Q1, SENTENCES["en"][0] + " " + SENTENCES["en"][2], "language"), (Q2, SENTENCES["fr"][1] + " " + SENTENCES["fr"][2], "language"), (Q2, SENTENCES["ha"][0] + " " + SENTENCES["ha"][1], "language"),
    (Q1, YO[1] + " Wọ́n ra ẹja àti", "truncated"), (Q1, YO[1] + " Wọ́n ra nítorí.", "truncated"), (Q1, YO[1] + " Wọ́n ra ẹja...", "truncated"), (Q2, YO[0] + " Àwọn olùkọ́ ní ilé ìw", "truncated"), (Q2, YO[2] + " Ẹ jẹ́ kí a mu omi –", "truncated"),
    (Q1, YO[1] + "\n- ẹja\n- ata", None), (Q1, "“" + YO[0] + "” 👍", None), (Q1, L._bare(YO[1]), None), (Q2, "Ó dára kí ẹ lọ bá dókítà. " + YO[3], None), (Q2, "Máa ń kọ́ àwọn ọmọ bí wọ́n ṣe lè fọ ọwọ́. Omi tó mọ́ kò léwu.", None),
]
# answers to questions out of scope, declined on purpose, in yet other words
DECLINED = ["A kì í jẹ́ kí n sọ irú ọ̀rọ̀ bẹ́ẹ̀. Ẹ béèrè lọ́wọ́ dókítà yín.", "Mi ò lè sọ nípa owó oògùn yìí. Ẹ jọ̀wọ́, ẹ lọ sí ilé ìwòsàn.", "I will not say which pills to buy. Please ask a nurse."]


@pytest.fixture(scope="module")
def judged(spark):
    good = [(f"g{i}", "Kí ló yẹ kí a ṣe?", YO[i % 4] + " " + YO[(i + 1) % 4], "derived") for i in range(300)]
    rows = good + [(f"c{i}", a, o, "derived") for i, (a, o, _) in enumerate(CHECKED)] + [("c0", CHECKED[0][0], None, "derived"), (None, "x", "y", None), ("n", None, YO[0], None)]
    rows += [(f"d{i}", "Èló ni oògùn?", DECLINED[i % 3], "out_of_scope") for i in range(24)]
    df = spark.createDataFrame(rows, "id string, instruction string, output string, question_type string").withColumn("defects", F.lit("clash"))
    out = P.pair_defects(df, model(), keep=["question_type"], expected=F.col("question_type") == "out_of_scope")
    return df, {r["id"]: r for r in out.withColumn("d", P.first_defect(F.col("defects"), F.col("question_type") == "out_of_scope")).collect()}


def test_pair_defects(judged):
    df, got = judged
    assert len(got) == 300 + len(CHECKED) + 1 + 24
    assert {i: got[f"c{i}"]["d"] for i in range(len(CHECKED))} == {i: d for i, (_, _, d) in enumerate(CHECKED)}
    assert all(got[f"g{i}"]["d"] is None for i in range(300)) and got["n"]["d"] is None
    assert all("refusal" in got[f"d{i}"]["defects"] and got[f"d{i}"]["d"] != "refusal" for i in range(24) if i % 3 == 1)
    assert P.pair_defects(df.limit(0), model(), expected=F.lit(True)).count() == 0
    assert P.pair_defects(df, model()).where("id = 'c0'").first()["defects"] == ["empty"]


def test_cutoffs_are_the_best_ones(judged):
    """The cutoffs lie in the ranges of the highest F measure on the pairs labelled by hand and sound ones."""
    _, got = judged
    ids = [f"c{i}" for i in range(len(CHECKED))] + [f"g{i}" for i in range(300)]
    want = [d for _, _, d in CHECKED] + [None] * 300
    ranges = P.best_cutoffs({d: np.array([got[i][f"p_{d}"] for i in ids]) for d in P.DEFECTS}, {d: np.array([w == d for w in want]) for d in P.DEFECTS})
    assert all(low <= P.CUTOFFS[d] <= high for d, (low, high) in ranges.items()), ranges


def test_label_model_recovers_planted_rates():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.1
    votes = np.stack([np.where(rng.random(20000) < 0.9, truth, ~truth) for _ in range(4)], axis=1) * 2 - 1
    pattern, inverse, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, table = P.fit_label_model(pattern, count.astype(float))
    found = P.posterior(pattern, share, table)[inverse.ravel()] >= 0.5
    assert abs(share - 0.1) < 0.03 and (found == truth).mean() > 0.97


def test_quality(spark):
    x, y = Q.checked()
    docs = [(i, t) for i, (_, t) in enumerate(CALIBRATION)]
    held = [(500 + i, t) for i, (_, t) in enumerate(HELD_OUT)]
    df = spark.createDataFrame(docs + [(900, None), (901, ""), (902, " \n "), (903, "word. " * 40000), (0, docs[0][1])], "doc_id long, text string").withColumn("kind", F.lit("clash"))
    m = Q.fit_quality_model(df)
    rows = Q.text_quality(df.unionByName(spark.createDataFrame(held, "doc_id long, text string").withColumn("kind", F.lit(""))), m).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs) + len(held) + 5 and all(got[i]["kind"] == "blank" and got[i]["n_words"] == 0 for i in (900, 901, 902))
    assert np.mean([got[i]["kind"] == k for i, (k, _) in enumerate(CALIBRATION)]) >= 0.9 and got[903]["n_words"] == 40000
    assert np.mean([got[500 + i]["kind"] == k for i, (k, _) in enumerate(HELD_OUT)]) >= 0.95
    assert Q.text_quality(df.limit(0), m).count() == 0
    assert (m.probabilities(x).sum(axis=1).round(6) == 1).all() and len(y) == len(docs)


def plain_statistics(text):
    """Some of the statistics by plain loops over one text."""
    lines = [s.strip() for s in text.split("\n") if s.strip()]
    words = re.findall(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f'’-])*", text)
    low = [w.lower() for w in words]
    seen = max(1, len(text) - sum(unicodedata.category(c) == "Zs" or c in "\n\t" for c in text))
    three = list(zip(low, low[1:], low[2:]))
    return {
        "n_chars": len(text), "n_words": len(words), "n_lines": len(lines), "mean_word_length": sum(map(len, words)) / max(1, len(words)), "digit_ratio": sum(c.isdecimal() for c in text) / seen,
        "ended_line_share": sum(re.sub("[\"'”’»)\\]]+$", "", s)[-1:] in tuple(".!?…") for s in lines) / max(1, len(lines)), "distinct_word_share": len(set(low)) / max(1, len(low)),
        "top_word_share": max(map(low.count, set(low)), default=0) / max(1, len(low)), "repeat_share": 1 - len(set(three)) / len(three) if three else 0.0, "run_length": seen / max(1, len(text.split())),
        "symbol_ratio": sum(unicodedata.category(c)[0] in "PS" for c in text) / seen,
    }


def test_statistics_against_plain_loops():
    texts = [t.replace("\r\n", "\n") for _, t in CALIBRATION + HELD_OUT] + ["a'b -c d-\n\n x.”) \ne\u0301e 12,5\t|", "word " * 500, "?", "ọ̀rọ̀ Ọ̀RỌ̀ ọ̀rọ̀"]
    got = S.statistics(texts)
    for text, row in zip(texts, got, strict=True):
        for name, value in plain_statistics(text).items():
            assert abs(row[S.STATS.index(name)] - value) < 1e-9, (name, text)
    assert (S.statistics(texts[::-1]) == got[::-1]).all() and S.statistics([None, "", " "])[:, 0].tolist() == [0, 0, 1]


def test_forms_of_all_three_fields(spark, tmp_path):
    from cowrie.llm.queries import p1_forms

    spark.createDataFrame([("w", "iba\u0300", None), ("w", "iba\u0300", None)], "id string, question_yo_final string, answer_yo_final string").write.parquet(f"{tmp_path}/working_record.parquet")
    spark.createDataFrame([("f", "Ki ni\u00a0iba?"), ("g", None)], "id string, instruction_nodia string").write.parquet(f"{tmp_path}/final_record.parquet")
    want = {("w", "question_yo_final", "ibà"), ("w", "answer_yo_final", None), ("f", "instruction_nodia", "Ki ni iba?"), ("g", "instruction_nodia", None)}
    rows = p1_forms(spark, str(tmp_path)).collect()
    assert len(rows) == 4 and set(map(tuple, rows)) == want


def test_languages_of_answers(spark, tmp_path, monkeypatch):
    from cowrie.llm import queries as Q

    monkeypatch.setattr(Q, "fit_language_model", lambda docs: model())
    yo, en = SENTENCES["yo"], SENTENCES["en"]
    rows = [("1", yo[0] + " " + yo[1], en[1])] * 3 + [("2", None, yo[0] + " " + yo[1] + " " + yo[2] + " " + en[0])]
    spark.createDataFrame(rows, "id string, answer_yo_mt string, answer_yo_final string").write.parquet(f"{tmp_path}/working_record.parquet")
    spark.createDataFrame([(1, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["id"], r["field"]): r["lang"] for r in Q.queries()["p7_answers"](spark, str(tmp_path)).collect()}
    assert got == {("1", "answer_yo_mt"): "yo", ("1", "answer_yo_final"): "en", ("2", "answer_yo_final"): "yo"}


def test_answer_models_count_all_answers(spark):
    declined = [(i, "Mo ko le dahun. E lo ri dokita", True) for i in range(5000)]
    others = [(10_000 + i, f"Omi mimu dara. Ounje naa dara{' gan' if i % 5 == 0 else ''}. O pari{' lana' if i % 4 == 0 else ''}", False) for i in range(11_000)]
    df = spark.createDataFrame([*declined, *others, (1, " ", True), (2, None, False)], "id long, output string, e boolean").repartition(3)
    declining, endings = P.fit_answer_models(df, F.col("e"))
    per = 8000 / 11_000  # counts are given as of 4,000 and 8,000 answers
    weight = lambda yes, no: math.log((yes * 0.8 + 0.5) / 4001) - math.log((no * per + 0.5) / 8001)
    assert declining.weights["dahun"] == pytest.approx(weight(5000, 0), rel=1e-12) and declining.weights["gan"] == pytest.approx(weight(0, 2200), rel=1e-12) and declining.weights["pari", "lana"] == pytest.approx(weight(0, 2750), rel=1e-12)
    assert endings.rate("gan") == pytest.approx((2200 * per + 0.5) / (2200 * per + 1), rel=1e-12) and endings.rate("mimu") == pytest.approx(0.5 / 8001, rel=1e-12)
    assert endings.rate("dara") == pytest.approx((19_800 * per + 0.5) / (22_000 * per + 1), rel=1e-12) and endings.rate("pari") is None
    sums = {r["feature"]: tuple(r)[1:] for r in P._answer_counts(df.where("trim(output) <> ''").select("e", F.col("output").alias("t")), most=3).collect()}  # passed on often
    assert sums["dara gan"] == (0, 2200, 0, 0) and sums["dara"] == (0, 11_000, 22_000, 19_800)
