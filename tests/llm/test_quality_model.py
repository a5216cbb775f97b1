import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.quality_model import FEATURES, Kernel, isotonic, ridge, score_quality, statistics


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 5))
    z = Kernel(np.zeros(5), np.ones(5), components=20000, bandwidth=2.0)(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 4.0))
    assert np.abs(z @ z.T - want).max() < .05


def test_normal_equations_and_isotonic_against_direct_ones():
    rng = np.random.default_rng(1)
    z = np.hstack((rng.normal(size=(500, 6)), np.ones((500, 1))))
    y = z @ rng.normal(size=7) + rng.normal(size=500)
    m = np.hstack((z, y[:, None]))
    w = ridge(m.T @ m, 0.0)
    assert np.allclose(w, np.linalg.lstsq(z, y, rcond=None)[0], atol=1e-6)
    x = np.arange(200.0)
    t = (rng.random(200) < x / 200).astype(float)
    c, v = isotonic(x, t, np.ones(200))
    assert (np.diff(v) > 0).all() and (np.diff(c) > 0).all() and 0 <= v.min() and v.max() <= 1
    # least squares among monotone fits, by the min-max formula
    cum = np.concatenate(([0], np.cumsum(t)))
    best = [max(min((cum[k] - cum[j]) / (k - j) for k in range(i + 1, 201)) for j in range(i + 1)) for i in range(200)]
    assert sorted({round(b, 9) for b in best}) == [round(b, 9) for b in v]


def test_statistics_of_odd_texts():
    assert statistics(None) == statistics("") == statistics(" \n") == [0.0] * len(FEATURES)
    assert np.isfinite(statistics("x" * 500000 + " \x00 é")).all()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    s = score_quality(docs.withColumn("f", F.lit(1)).withColumn("y", F.lit(2)), labels)
    assert s.count() == docs.count()
    r = s.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    assert r["score"].between(0, 1).all()
    assert (r["predicted"] == r["quality"]).mean() >= .93
    # without the held-out labels nothing changes: they teach nothing
    seen = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    again = score_quality(docs, seen).select("doc_id", F.col("score").alias("again"))
    assert s.join(again, "doc_id").where("abs(score - again) > 1e-9").count() == 0


def test_empty_and_null_rows(spark, frame):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id bigint, quality int")
    df = frame([(1, "good words here."), (2, "&&& ###"), (None, None), (3, ""), (3, "")])
    r = score_quality(df, labels)
    assert r.count() == 5 and r.where("score is null or score < 0 or score > 1").count() == 0
    assert [x.score for x in score_quality(df, labels.where("false")).collect()] == [.5] * 5
    assert score_quality(df.where("false"), labels).count() == 0


def test_scores_against_brute_force(spark, frame):
    """The whole result by direct least squares on the rows, and the min-max form of isotonic regression."""
    import random
    import zlib

    import xxhash

    from quire.llm import quality_model as Q
    rng = random.Random(12)
    def text(good):
        w = [rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(rng.randrange(5, 80))]
        return " ".join(w) + (". Well." if good else " " + "#$|" * rng.randrange(6) + "!!")
    rows = [(i, text(rng.random() < (.85 if i % 2 else .2))) for i in range(420)] + [(500, None), (501, "")]
    labels = [(i, i % 2) for i in range(0, 420) if i % 5]
    got = {r.doc_id: r.score for r in Q.score_quality(frame(rows), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}

    f = np.array([Q.statistics(t) for _, t in rows], np.float32).astype(float)
    y = dict(labels)
    train = [k for k, (i, _) in enumerate(rows) if i in y and zlib.crc32(str(i).encode()) % 3 != 1]
    fold = np.array([xxhash.xxh64_intdigest(int(rows[k][0]).to_bytes(8, "little"), 42) for k in train], np.uint64).view(np.int64) % Q.FOLDS
    target = np.array([y[rows[k][0]] for k in train], float)
    std = f[train].std(0)
    z = np.clip((f - f[train].mean(0)) / np.where(std > 1e-9, std, 1), -6, 6)
    draw = np.random.default_rng(Q.SEED)
    w = draw.normal(size=(f.shape[1], Q.COMPONENTS)) / Q.BANDWIDTH
    x = np.hstack((np.sqrt(2 / Q.COMPONENTS) * np.cos(z @ w + draw.uniform(0, 2 * np.pi, Q.COMPONENTS)), np.ones((len(f), 1))))

    def solve(keep):
        a, b = x[np.array(train)[keep]], target[keep]
        shrink = np.diag([np.sqrt(Q.RIDGE * len(a))] * Q.COMPONENTS + [np.sqrt(1e-9)])
        return np.linalg.lstsq(np.vstack((a, shrink)), np.concatenate((b, np.zeros(len(shrink)))), rcond=None)[0]
    unseen = np.zeros(len(train))
    for k in range(Q.FOLDS):
        unseen[fold == k] = x[np.array(train)[fold == k]] @ solve(fold != k)
    bins = np.round(np.clip(unseen, -1, 2) * Q.GRID)
    at, n = np.unique(bins, return_counts=True)
    mean = np.array([target[bins == b].mean() for b in at])
    avg = lambda i, j: (mean[i:j + 1] * n[i:j + 1]).sum() / n[i:j + 1].sum()
    fit = np.array([max(min(avg(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))])
    centre = np.array([(at[fit == v] * n[fit == v]).sum() / n[fit == v].sum() for v in np.unique(fit)])
    want = np.interp(x @ solve(np.ones(len(train), bool)) * Q.GRID, centre, np.unique(fit))
    assert len(got) == len(rows)
    close = np.abs(want - [got[i] for i, _ in rows])
    assert close.max() < 2e-3 and np.median(close) < 1e-6  # a score on the edge of a calibration bin may fall beside it
