from pyspark.sql import functions as F

from cowrie.functions import metrics as M
from cowrie.functions import text as X


def one(spark, kind, value, column):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


def test_unicode_forms(spark):
    assert one(spark, "string", "ẹ̀", X.nfc) == "ẹ̀"
    assert one(spark, "string", "Ẹ̀gbọ́n ṣe", X.strip_diacritics) == "Egbon se"
    assert one(spark, "string", None, X.nfc) is None
    assert one(spark, "string", "", X.strip_diacritics) == ""


def test_tokens_and_sentences(spark):
    assert one(spark, "string", "  a b \n c ", X.tokens) == ["a", "b", "c"]
    assert one(spark, "string", None, X.tokens) == []
    assert one(spark, "string", "One. Two? 3! four", X.sentences) == ["One.", "Two?", "3! four"]


def test_ngrams_and_jaccard(spark):
    assert one(spark, "string", "hello", lambda c: X.char_ngrams(c, 3)) == ["ell", "hel", "llo"]
    assert one(spark, "string", "ab", lambda c: X.char_ngrams(c, 3)) == ["ab"]
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [round(r[0], 4) for r in df.select(X.jaccard(F.col("a"), F.col("b"))).collect()] == [0.3333, 1.0, 0.0]


def test_charset(spark):
    legal = lambda t: one(spark, "string", t, X.legal_spelling)
    assert legal("Ẹ̀jẹ̀ ríru, ó dára.") and legal("COVID-19 HIV") and not legal("vaccine")
    r = one(spark, "string", "ac", X.charset_report)
    assert (r["valid"], r["signs"], r["positions"]) == (False, "c", [1])
    t = one(spark, "string", "Ó dára, quick 'ẹ'", X.token_legality)
    assert (t["tokens"], t["legal"]) == (4, 3)


def test_repeats_keywords_labels(spark):
    assert one(spark, "string", "a b c a b", X.repeated_bigram) and not one(spark, "string", "a b c", X.repeated_bigram)
    hit = lambda t: one(spark, "string", t, lambda c: X.keyword_hit(c, ["tb", "omi mimu"]))
    assert hit("mo ni tb?") and hit("omi mimu to mo") and not hit("tbc") and not hit(None)
    df = spark.createDataFrame([([1, 2, 3], 2), ([1], 5), ([], 1)], "ids array<int>, n int")
    assert [r[0] for r in df.select(X.masked_labels(F.col("ids"), F.col("n"))).collect()] == [[-100, -100, 3], [-100], []]
    bands = [one(spark, "double", v, X.kappa_band) for v in (-0.1, 0.0, 0.2, 0.4, 0.6, 0.8, 1.0, None)]
    assert bands == ["poor", "slight", "fair", "moderate", "substantial", "almost perfect", "almost perfect", None]


def test_scores():
    assert M.chrf_score(M.chrf_statistics("kí ni èyí", "kí ni èyí")) == 100.0
    assert M.chrf_score(M.chrf_statistics("", "abc")) == 0.0
    assert abs(M.bleu_score(M.bleu_statistics("the cat sat on the mat", "the cat sat on the mat")) - 100) < 1e-9
    assert M.bleu_score(M.bleu_statistics("", "a b")) == 0.0
    assert M.rouge_l("a b c", "a c") == 2 * (2 / 3) * 1 / (2 / 3 + 1)
    assert M.rouge_l("", "a") == 0.0 and M.rouge_l("ẹ", "ẹ") == 0.0 and M.rouge_l("ẹ", "ẹ", unicode_words=True) == 1.0
    assert M.diacritic_accuracy("ọmọ lọ", "ọmọ lo") == 0.5 and M.diacritic_accuracy("x", "y") == 0.0


def test_signatures_name_the_settings():
    assert "nc:6|nw:2" in M.signature("chrf") and "smooth:exp" in M.signature("bleu") and M.signature("rouge_l") and M.signature("diacritics")


def test_all_statistics_equal_those_of_each_pair():
    pairs = [("kí ni èyí?", "kí ni èyí"), ("", "abc"), ("a", ""), ("", ""), ("the cat sat on the the mat, 3.5 km.", "the cat, the mat: 3,5 km"), ("ab ab ab ab ab", "ab ab"), ("x" * 50, "x" * 30 + "y")]
    c, b = M.all_statistics(*map(list, zip(*pairs, strict=True)))
    assert c.tolist() == [M.chrf_statistics(h, r) for h, r in pairs] and b.tolist() == [M.bleu_statistics(h, r) for h, r in pairs]
    assert [round(M.rouge_l(h, r), 6) for h, r in (("a b c d", "a c d e"), ("a", "b"), ("b a b a", "a b a b"))] == [0.75, 0.0, 0.75]


def test_corpus_scores_sum_statistics(spark):
    df = spark.createDataFrame([("s", "a b c d e", "a b c d e"), ("s", None, "x y"), ("t", "q", "q")], "system string, hypothesis string, reference string")
    rows = {r["system"]: r for r in M.corpus_scores(df, ["system"]).collect()}
    assert rows["s"]["n"] == 2 and rows["s"]["corpus_chrf"] < 100 and rows["t"]["corpus_chrf"] == 100.0
