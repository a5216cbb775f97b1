import itertools

import numpy as np
from pyspark.sql import functions as F

from quire.llm import toxicity
from quire.llm.toxicity import (LENGTHS, SHORT, VOTERS, LabelModel, Linear, Voters, beginnings, learn_lexicon, level, score_toxicity,
                                tokens, train_linear)


def simulate(seed=0, n=6000, twins=True):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < .2).astype(int)
    hit, false = np.array([.8, .7, .6, .5, .7, .4]), np.array([.02, .05, .1, .02, .2, .01])
    x = np.where(y[:, None] == 1, rng.random((n, 6)) < hit, rng.random((n, 6)) < false).astype(int)
    if twins:
        x = np.hstack((x, x[:, [4]]))  # a voter that only repeats another
    return y, (x << np.arange(x.shape[1])).sum(1), x


def test_label_model_recovers_accuracies_and_correlations():
    y, votes, x = simulate()
    pat, count = np.unique(votes, return_counts=True)
    m = LabelModel(voters=7, pairs=3).fit(pat, np.full(len(pat), -1), count.astype(float))
    assert (4, 6) in m.pairs
    q = m.posterior(votes)
    assert ((q > .5) == y).mean() > .95
    for c in (0, 1):  # marginals of the fitted class against the truth
        p = np.exp(m.log_p[c]) @ m.states
        assert np.abs(p - x[y == c].mean(0)).max() < .06


def test_fit_of_one_class_is_exact_without_pairs():
    _, votes, x = simulate(1, 800, twins=False)
    m = LabelModel(voters=6)
    _, log_p = m._fit_class(np.bincount(votes, minlength=64).astype(float), np.zeros(6), 100)
    assert np.abs(np.exp(log_p) @ m.states - x.mean(0)).max() < .01
    assert abs(np.exp(log_p).sum() - 1) < 1e-9


def test_linear_training_against_direct_descent(spark):
    rng = np.random.default_rng(3)
    rows = [([i for i in range(4) if rng.random() < .4], int(rng.integers(0, 8)), float(rng.random()), int(rng.integers(1, 9))) for _ in range(60)]
    df = spark.createDataFrame(rows, "hits array<int>, votes int, q double, n bigint").repartition(5)
    linear = train_linear(df, 4, steps=200)
    h, v, q, n = zip(*rows, strict=True)
    v, q, n = np.array(v), np.array(q), np.array(n)
    x = np.array([[i in hits for i in range(4)] + [v[r] >> k & 1 for k in range(VOTERS)] + [min(len(hits), 5), 1] for r, hits in enumerate(h)], float)
    p = 1 / (1 + np.exp(-x @ linear.theta))
    assert np.abs(p - linear.score(h, v)).max() < 1e-12
    grad = x.T @ (n * (q - p)) - .5 * linear.theta * (np.arange(linear.size) < linear.size - 1)
    assert np.abs(grad).max() < .1
    assert Linear(0).score([[], []], np.array([0, 3])).tolist() == [.5, .5]


def test_a_label_is_a_voter_that_can_be_wrong():
    y, votes, _ = simulate(4)
    rng = np.random.default_rng(4)
    gold = np.where(rng.random(len(y)) < .5, np.where(rng.random(len(y)) < .9, y, 1 - y), -1)
    pat, count = np.unique(np.stack((votes, gold)), axis=1, return_counts=True)
    m = LabelModel(voters=7, pairs=3, gold=.9).fit(pat[0], pat[1], count.astype(float))
    q = m.posterior(votes, gold)
    assert ((q > .5) == y).mean() > ((gold == y) | (gold < 0)).mean() and (m.posterior(votes[:1], np.array([1])) > m.posterior(votes[:1]))


def brute_lexicon(data):
    """Every key and level by itself, over all texts, then thinned over the whole list."""
    from math import log
    p0, found = sum(y for _, y in data) / len(data), []
    has = [(beginnings(t), y) for t, y in data]
    for g in {g for h, _ in has for g in h}:
        for v in (1, 2, 3):
            t = sum(y for h, y in has if h.get(g, 0) >= v)
            n = sum(1 for h, _ in has if h.get(g, 0) >= v)
            if t < 3 or t < .6 * n:
                continue
            e = 2 * (t * log(t / n / p0) + ((n - t) * log((n - t) / n / (1 - p0)) if n > t else 0))
            if e >= 18:
                found.append((-round(e, 9), v, g))
    out = []
    for _, v, g in sorted(found):
        if not any(g == c or g[0] != SHORT and (g.startswith(c) or c.startswith(g)) for c, _ in out):  # short words count whole
            out.append((g, v))
    return out


def test_lexicon_and_scores_against_brute_force(spark, monkeypatch):
    """More entries than a long has bits, short words among them, overlapping families."""
    rng = np.random.default_rng(11)
    marks = ["".join(rng.choice(list("bcdfgklm"), int(rng.integers(2, 9)))) for _ in range(150)]
    plain = ["".join(rng.choice(list("aeiou"), 5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(1600):
        y = int(i % 6 == 0)
        w = list(rng.choice(plain, 25)) + (list(rng.choice(marks, 8)) if y else [])
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    data = [(t, y) for (_, t), (_, y) in zip(rows, labels, strict=True)]
    lex = learn_lexicon(spark.createDataFrame(data, "text string, y int").repartition(5))
    assert lex == brute_lexicon(data) and len(lex) > 64 and any(g.startswith(SHORT) for g, _ in lex)
    v = Voters(lex)
    for t, _ in data[:200]:
        b = beginnings(t)
        assert v.hits(tokens(t)) == [i for i, (g, need) in enumerate(lex) if b.get(g, 0) >= need]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    truth = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    a = {r.doc_id: (r.score, r.predicted, r.held_out) for r in score_toxicity(docs, truth).collect()}
    held = [i for i in a if a[i][2]]
    assert held and all(a[i][1] == labels[i][1] for i in held)
    monkeypatch.setattr(toxicity, "LEARN_TEXTS", 400)  # a bounded sample of the labelled texts
    b = {r.doc_id: (r.score, r.predicted, r.held_out) for r in score_toxicity(docs, truth).collect()}
    assert sum(b[i][1] == labels[i][1] for i in held) >= .9 * len(held)


def test_lexicon_counts_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcde"), 5)) for _ in range(300)]
    data = []
    for i in range(400):
        t = " ".join(rng.choice(words, 20))
        y = int(i % 8 == 0)
        data.append((t + (" Zzqux" + "aeiou"[i % 5] + "!" if y else ""), y))
    lex = learn_lexicon(spark.createDataFrame(data, "text string, y int").repartition(6))
    assert lex and "zzqux".startswith(lex[0][0])
    assert all(not a.startswith(b) for (a, _), (b, _) in itertools.permutations(lex, 2))
    hits, votes = Voters(lex)("the zzquxxx word zzquxyy")
    assert 0 in hits and votes & 1 and Voters(lex)(None) == ([], 0) == Voters(lex)("")
    assert beginnings("Abcdefgh, x abcd") == {"abcd": 3, "abcde": 2, "abcdef": 2, "=x": 2} and VOTERS == 12 and LENGTHS[0] == 4
    assert [level(*x) for x in ((0, 5), (1, 100), (1, 101), (2, 200), (2, 201))] == [0, 2, 1, 3, 1]


def test_a_family_that_clean_texts_hold_by_chance_is_found_by_its_density(spark):
    rng = np.random.default_rng(8)
    data = []
    for i in range(600):
        y = int(i % 10 == 0)
        w = [f"q{v}" for v in rng.integers(0, 9999, 300)]
        for k in range(5 if y else int(rng.random() < .12)):
            w[k * 7] = "famil" + "abcdefgh"[int(rng.integers(8))]
        data.append((" ".join(w), y))
    lex = learn_lexicon(spark.createDataFrame(data, "text string, y int"))
    assert lex[0][1] > 1 and "famil".startswith(lex[0][0][:5])
    v = Voters(lex[:1])
    assert all((0 in v(t)[0]) == bool(y) for t, y in data)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    s = score_toxicity(docs.withColumn("votes", F.lit(1)).withColumn("hits", F.lit("x")), labels)
    assert s.count() == docs.count()
    r = s.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    assert r["score"].between(0, 1).all()
    caught = (r["predicted"] == 1) & (r["toxic"] == 1)
    assert caught.sum() / (r["toxic"] == 1).sum() >= .9 and caught.sum() / (r["predicted"] == 1).sum() >= .9


def test_very_long_text_is_read_whole():
    v = Voters([("curse", 1)])
    assert v("fine words " * 500_000 + "cursed") == ([0], 1)
    assert v("fine words " * 500_000) == ([], 0)


def test_empty_and_null_rows(spark, frame):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    df = frame([(1, "you idiot, you moron"), (4, "fine words"), (None, None), (3, ""), (3, "")])
    r = score_toxicity(df, labels)
    assert r.count() == 5 and r.where("score is null or score < 0 or score > 1").count() == 0
    assert score_toxicity(df, labels.where("false")).count() == 5
    assert score_toxicity(df.where("false"), labels).count() == 0
