"""Problems 2, 4, 5, 6, 9: algorithms against brute force, invariants and edge cases."""

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cowrie.functions.grams import gram_set, plain
from cowrie.llm import consensus as K
from cowrie.llm import leakage as O
from cowrie.llm import mixing as M
from cowrie.llm import neardup as N
from cowrie.llm import splits as S
from cowrie.llm.gray_index import MASKS, GrayIndex, difference_budgets, gray_rank


def test_claim_keys(spark):
    given = ["Omiran–Child_Health 7", " omiran-child-health-0007  ", "omiran child health 007", "a-1234", "plain", "", None, "--"]
    df = spark.createDataFrame([(c,) for c in given], "c string")
    assert [r[0] for r in df.select(S.claim_key(F.col("c"))).collect()] == ["omiran-child-health-007"] * 3 + ["a-1234", "plain", None, None, None]


def test_largest_differencing():
    rng = np.random.default_rng(0)
    for n, bins in ((500, 20), (7, 10), (10, 10), (1, 3), (0, 3)):
        w = rng.integers(1, 10, n)
        b = S.largest_differencing(w, bins)
        sums = np.bincount(b, weights=w, minlength=bins) if n else np.zeros(bins)
        assert len(b) == n and sums.sum() == w.sum() and (n == 0 or b.max() < bins)
        if n >= 500:
            assert sums.max() - sums.min() <= 2
    hot = S.largest_differencing(np.array([1000] + [3] * 400), 20)
    assert Counter(hot)[hot[0]] == 1


def test_number_of_bins_is_chosen():
    rng = np.random.default_rng(4)
    for n in (30, 60, 120, 400, 2000):
        w = rng.zipf(1.8, n).clip(1, 60)
        missed = []
        for at in (S.balanced_for(w, S.SHARES), *(S.balanced_for(w, S.SHARES, (k,)) for k in S.CHOICES)):
            sums = np.bincount(at, weights=w)[np.unique(at)]
            given = np.array(S.allocate(sums, S.SHARES))
            missed.append(max(abs(sums[given == k].sum() - v * w.sum()) for k, v in S.SHARES.items()))
        assert missed[0] == min(missed) and missed[0] <= max(1.0, 0.012 * w.sum())
        assert n < 400 or len(np.unique(S.balanced_for(w, S.SHARES))) < n / 2  # bins are merged from components


def test_split_keeps_claims_whole(spark):
    rows = [(f"r{i}", f"s-t-{i // 3}", "T1" if i % 2 else "t1 ", "train" if i % 5 else "val") for i in range(900)] + [(f"h{i}", "hot-t-1", None if i % 7 else "t2", "train") for i in range(500)]
    df = spark.createDataFrame([*rows, rows[0], ("n", None, "t1", "train")], "id string, claim_id string, topic string, split string").withColumn("component", F.lit("clash"))
    for block in (20_000, 100):
        out = S.split_components(df, "id", {"claim": S.claim_key(F.col("claim_id"))}, F.col("topic"), F.col("split"), bins=20, block=block)
        got = {r["component"]: r for r in out.collect()}
        assert len(got) == 301 and sum(r["records"] for r in got.values()) == 1400 and got["hot-t-001"]["stratum"] == "t2" and got["s-t-001"]["stratum"] == "t1"
        share = Counter()
        for r in got.values():
            if r["stratum"] == "t1":
                share[r["split"]] += r["records"]
        assert abs(share["train"] / 900 - 0.8) < 0.03 and abs(share["val"] / 900 - 0.1) < 0.03
    torn = {c for c, r in got.items() if len(r["shipped_splits"]) > 1}
    want = {f"s-t-{i:03d}" for i in range(300) if len({x[3] for x in rows[3 * i : 3 * i + 3]}) > 1}
    assert torn == want
    assert S.split_components(df.limit(0), "id", {"claim": F.col("claim_id")}, F.col("topic")).count() == 0


def test_components_over_several_keys(spark):
    df = spark.createDataFrame([("1", "a", "x"), ("2", "b", "x"), ("3", "b", None), ("4", "c", "y"), ("5", None, None)], "id string, author string, source string")
    got = {r["id"]: r["component"] for r in S.components(df, "id", {"author": F.col("author"), "source": F.col("source")}).collect()}
    assert got["1"] == got["2"] == got["3"] != got["4"] and "5" not in got
    chain = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60)], "a string, b string")
    assert {r["component"] for r in S.connected_components(chain).collect()} == {"000"}


def test_consensus(spark):
    rng = np.random.default_rng(2)
    truth = {i: int(rng.choice(4, p=[0.6, 0.2, 0.12, 0.08])) for i in range(400)}
    rows = []
    for i, t in truth.items():
        for r in rng.choice(9, 5, replace=False):
            v = t if r < 5 and rng.random() < 0.9 else 0 if r == 5 else 3 - t if r == 6 else int(rng.integers(4))
            rows.append((i, f"r{r}", K.HARM[v]))
    votes = spark.createDataFrame(rows, "item int, annotator string, label string")
    c = K.reweighted_voting(votes, ["item"])
    got = {r["item"]: r["label"] for r in c.labels.collect()}
    plain_vote = {i: Counter(v for j, _, v in rows if j == i).most_common(1)[0][0] for i in truth}
    right = lambda d: np.mean([d[i] == K.HARM[t] for i, t in truth.items()])
    assert right(got) > right(plain_vote) + 0.05 and right(got) > 0.9
    raters = {r["annotator"]: r for r in c.annotators.collect()}
    acc = {a: r["accuracy"] for a, r in raters.items()}
    assert c.settled and min(acc[f"r{k}"] for k in range(5)) > 0.75 > acc["r7"] and acc["r6"] > 0.75
    assert raters["r6"]["reads"] == list(K.HARM[::-1]) and raters["r0"]["reads"] == list(K.HARM)
    p = {a: 0.25 + 0.75 * r["skill"] for a, r in raters.items()}
    assert all(abs(r["weight"] - np.log(p[a] * 3 / (1 - p[a]))) < 1e-3 for a, r in raters.items())
    assert raters["r5"]["skill"] < 0.1 < 0.5 < raters["r0"]["skill"]  # who always says the same agrees by chance alone
    literal = K.reweighted_voting(votes, ["item"], read=False)
    worth = {r["annotator"]: r["accuracy"] for r in literal.annotators.collect()}
    assert worth["r6"] < 0.2 and 0.85 < right({r["item"]: r["label"] for r in literal.labels.collect()}) <= right(got) + 0.02
    # the reported weights are those that vote
    sums = {}
    for i, a, v in rows:
        sums.setdefault(i, Counter())[raters[a]["reads"][K.HARM.index(v)]] += raters[a]["weight"]
    assert all(sums[i][got[i]] >= max(sums[i].values()) - 1e-3 for i in truth)
    import warnings

    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        assert not K.reweighted_voting(votes, ["item"], rounds=1).settled and any("not settled" in str(w.message) for w in told)
    one = K.reweighted_voting(spark.createDataFrame([(1, "a", "Low"), (2, "b", "odd")], votes.schema), ["item"])
    assert [tuple(r)[:2] for r in one.labels.collect()] == [(1, "Low")]
    assert K.reweighted_voting(votes.limit(0), ["item"]).labels.count() == 0


def test_latest_votes_and_alpha(spark):
    df = spark.createDataFrame([("s", "r1", " none. ", 1, 1), ("s", "r1", "SEVERE", 2, 1), ("s", "r1", "SEVERE", 2, 2), ("s", "r2", "?", 1, 1), ("s", None, "Low", 1, 1), ("t", "r1", "low\t", 1, 1)], "sample_id string, rater_id string, harm string, at int, got int")
    got = sorted(map(tuple, K.latest_votes(df, ["sample_id"], "rater_id", K.read_harm(F.col("harm")), "at", "got").collect()))
    assert got == [("s", "r1", "Severe"), ("t", "r1", "Low")]
    v = spark.createDataFrame([(i, f"r{j}", x) for i, xs in enumerate(["aa", "ab", "bb", "b"]) for j, x in enumerate(xs)], "item int, annotator string, label string")
    r = K.krippendorff_nominal(v, ["item"]).first()
    assert (r["items"], r["votes"]) == (3, 6) and abs(r["alpha"] - (1 - (2 / 6) / (18 / 30))) < 1e-6


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (40, 2), dtype=np.uint64)
    rows = np.repeat(base, 8, axis=0)
    for k in range(len(rows)):
        for bit in rng.integers(0, 128, rng.integers(0, 12)):
            rows[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    group = rng.integers(0, 5, len(rows))
    code = [(int(h) << 64) | int(x) for h, x in rows]
    apart = lambda i, j, bits: ((code[i] ^ code[j]) >> (128 - bits)).bit_count()
    for budgets in ((8, 16, 20, 20, 20), (3, 4, 7, 12, 29)):
        for block in (7, 1 << 18):
            index = GrayIndex(group, rows[:, 0].copy(), rows[:, 1].copy())
            got = [tuple(sorted(p)) for x, y in index.self_join(budgets, block=block) for p in zip(x.tolist(), y.tolist(), strict=True)]
            want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if group[i] == group[j] and all(apart(i, j, m) <= b for m, b in zip(MASKS, budgets, strict=True))}
            assert len(got) == len(set(got)) and set(got) == want
    codes = np.array([i ^ (i >> 1) for i in range(64)], dtype=np.uint64)
    assert (gray_rank(np.zeros(64, np.uint64), codes)[1] == np.arange(64)).all() and not list(GrayIndex(group[:0], codes[:0], codes[:0]).self_join((3,) * 5))


def test_gray_index_prunes():
    """Whole fingerprints are compared for less than a fifth of the pairs that share a top node, and no near pair is lost."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abdefgijklmnoprstuwy"), rng.integers(3, 9))) for _ in range(60)]
    frames = [" ".join(rng.choice(words, 30)) for _ in range(12)]
    texts = []
    for _ in range(1500):  # texts from few frames: alike, but few of them near
        w = frames[rng.integers(12)].split()
        for k in rng.choice(30, 12, replace=False):
            w[k] = rng.choice(words)
        texts.append(" ".join(w))
    for t in texts[:130]:
        w = t.split()
        w[rng.integers(30)] = rng.choice(words)
        texts.append(" ".join(w))
    texts = sorted(set(texts))
    key, entry = N._entries(pd.DataFrame({"field": 0, "h1": np.arange(len(texts)), "sig": [r.tobytes() for r in N.fingerprints(texts)]}))
    entry["key"] = (key >> np.uint64(32)).astype(np.uint32)
    _, n = np.unique(entry["key"], return_counts=True)
    found, compared = N.near_entries(entry, difference_budgets(0.1))
    pairs = int((n * (n - 1) // 2).sum())
    print(f"pairs within top nodes {pairs}, nodes compared {compared[:-1].tolist()}, whole fingerprints compared {compared[-1]}")
    want = brute(texts)
    assert compared[-1] * 5 <= pairs and len(want) > 100
    assert len(want & {tuple(p) for p in found.tolist()}) >= 0.999 * len(want)


def texts_with_edits(rng, n, copies):
    words = ["".join(rng.choice(list("abdefgijklmnoprstuwy"), rng.integers(3, 9))) for _ in range(400)]
    out = [" ".join(rng.choice(words, rng.integers(12, 45))) for _ in range(n)]
    for t in out[:copies]:
        w = t.split()
        for _ in range(rng.integers(1, 4)):
            w[rng.integers(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


def brute(texts, sides=None):
    grams = [gram_set(plain(t)) if t else set() for t in texts]
    return {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if grams[i] and grams[j] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) - 1e-9 and (sides is None or sides[i] != sides[j])}


def test_near_duplicates_against_brute_force(spark):
    texts = texts_with_edits(np.random.default_rng(7), 250, 150) + ["same text here twice"] * 20 + ["Same  text here TWICE", None, "", "abc", "ABC "]
    ids = [f"d{i:04d}" for i in range(len(texts))]
    df = spark.createDataFrame([*zip(ids, texts, strict=True), (ids[0], texts[0]), (None, texts[0])], "id string, t string").withColumn("field", F.lit("clash"))
    near = N.near_duplicates(df, ["t"])
    got = {(r["id_a"], r["id_b"]) for r in near.pairs(full=1000).collect()}
    assert got == {(ids[i], ids[j]) for i, j in brute(texts)}
    star = {(r["id_a"], r["id_b"]) for r in near.pairs(full=4).collect()}
    same = [ids[i] for i, t in enumerate(texts) if t and plain(t) == "same text here twice"]
    assert star <= got and {(same[0], x) for x in same[1:]} <= star and len([p for p in star if p[0] in same]) == len(same) - 1
    assert N.near_duplicates(df.limit(0), ["t"]).pairs().count() == 0


def test_crowded_patterns_lose_nothing(spark):
    texts = texts_with_edits(np.random.default_rng(8), 60, 60) + [f"a text that very many records share but for its number {i}" for i in range(40)]
    ids = [f"d{i:04d}" for i in range(len(texts))]
    sigs = N.text_signatures(spark.createDataFrame(list(zip(ids, texts, strict=True)), "id string, t string"), ["t"]).persist()
    plainly = {tuple(r) for r in N.candidate_pairs(sigs).collect()}
    early = {tuple(r) for r in N.candidate_pairs(sigs, crowd=4).collect()}
    spared, N._crowded = N._crowded, lambda *_: {}
    try:  # nothing known before the shuffle: the searching tasks pass crowded patterns on
        late = {tuple(r) for r in N.candidate_pairs(sigs, crowd=4).collect()}
    finally:
        N._crowded = spared
    assert plainly == early == late and len(plainly) > 500


def test_overlaps_against_brute_force(spark):
    texts = texts_with_edits(np.random.default_rng(9), 200, 120) + ["one exact copy of a text"] * 6
    rng = np.random.default_rng(1)
    side = [("train", "val", "test")[k] for k in rng.choice(3, len(texts), p=[0.7, 0.15, 0.15])]
    ids = [f"d{i:04d}" for i in range(len(texts))]
    rows = [(i, s, f"src{k % 3}", "", t) for k, (i, s, t) in enumerate(zip(ids, side, texts, strict=True))]
    rows += [("e1", "train", "s", "same ask", " N/A"), ("e2", "test", "s", "same ask", "n/a"), ("o", "other", "s", "", texts[0]), rows[0]]
    df = spark.createDataFrame(rows, "id string, split string, source string, instruction string, output string").withColumn("text", F.lit("clash"))
    want = {(ids[i], ids[j]) for i, j in brute(texts, ["t" if s == "train" else "e" for s in side])}
    for crowd in (50_000, 3):
        got = O.cross_split_overlaps(df, F.col("source"), crowd=crowd)
        assert {tuple(sorted((r["train_id"], r["eval_id"]))) for r in got.pairs(full=1000).collect()} == want
    assert sum(r["pairs"] for r in got.report().collect()) == len(want)
    assert O.cross_split_overlaps(df.limit(0), F.col("source")).pairs().count() == 0


def test_report_counts_all_pairs_of_many_copies(spark):
    text = "one exact copy of a text that many records share"
    rows = [(f"t{i:03d}", "train", "s", "", text) for i in range(40)] + [(f"u{i}", "train", "s", "", text + "s") for i in range(3)]
    rows += [(f"e{i:03d}", ("val", "test")[i % 2], ("x", "y")[i % 3 == 0], "", text) for i in range(30)]
    got = O.cross_split_overlaps(spark.createDataFrame(rows, "id string, split string, source string, instruction string, output string"), F.col("source"))
    want = Counter((s, c) for _, s, c, *_ in rows if s != "train")
    assert {(r["split"], r["source"]): (r["records"], r["pairs"]) for r in got.report().collect()} == {k: (n, n * 43) for k, n in want.items()}


def test_splitting_tree():
    counts = np.array([1000, 7, 0, 333])
    tree = M.split_tree(counts, 13, 1)
    assert (tree.sum(axis=0) == counts).all() and tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 2
    dealt = M.deal_blocks(counts, 13, 1)
    assert len(dealt) == counts.sum() and len({(s, b) for s, b, _ in dealt}) == len(dealt)


def test_mixture(spark):
    docs = [(i, f"w{i} tok tok tok", "big") for i in range(400)] + [(1000 + i, f"w{i} a b c", "small") for i in range(20)] + [(2000 + i, "x y", "tiny") for i in range(2)] + [(3000, None, "big"), (3001, "", "small"), (3002, "no source", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    goal = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 20), ("tiny", 0.05, 2), ("absent", 0.05, 9)], "source string, target_share double, max_repeat int")
    mix = M.mix_sources(df, goal, shards=4, blocks=64)
    rep = {r["source"]: r for r in mix.report.collect()}
    assert not rep["tiny"]["reachable"] and not rep["absent"]["reachable"] and rep["big"]["reachable"] and rep["small"]["reachable"]
    assert abs(rep["small"]["used"] - rep["small"]["quota"]) <= 20 and rep["tiny"]["most_copies"] == 2 and rep["absent"]["used"] == 0
    rows = mix.records.collect()
    assert len({(r["key"], r["copy"]) for r in rows}) == len(rows) and {r["shard"] for r in rows} == {0, 1, 2, 3} and sum(r["tokens"] for r in rows) == sum(r["used"] for r in rep.values())
    # the shards are what the tree dealt, and places run through each of them
    dealt = {(r["shard"], r["source"]): r for r in mix.shards.collect()}
    tree = M.split_tree(np.array([-(-rep[s]["quota"] // max(1, -(-sum(r["quota"] for r in rep.values()) // 64))) for s in sorted(rep)]), 4, 42)
    assert {(k, s): int(n) for k, row in enumerate(tree) for s, n in zip(sorted(rep), row, strict=True) if n} == {k: r["blocks"] for k, r in dealt.items()}
    assert {k: (r["records"], r["tokens"]) for k, r in dealt.items() if r["records"]} == {k: (n, sum(r["tokens"] for r in rows if (r["shard"], r["source"]) == k)) for k, n in Counter((r["shard"], r["source"]) for r in rows).items()}
    for k in range(4):
        assert sorted(r["place"] for r in rows if r["shard"] == k) == list(range(1, sum(r["shard"] == k for r in rows) + 1))
    most = Counter((r["source"], r["key"]) for r in rows)
    assert all(n <= {"big": 1, "small": 20, "tiny": 2}[s] for (s, _), n in most.items()) and abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-5
    assert M.mix_sources(df.limit(0), goal).records.count() == 0
