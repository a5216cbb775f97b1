"""Quality classifier: random Fourier features, ridge by normal equations, isotonic scores.

Statistics of a document (no label, language, source or id among them) are standardised and
mapped to random Fourier features, whose inner products approximate a Gaussian kernel. The
normal equations are sums over rows: every partition adds up its own, and Spark adds the
partitions'. They are kept by fold, so the same sums give a model without each fold, and the
isotonic calibration is fitted on scores of rows their model has not seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import code_bucket, materialize, prepare

COMPONENTS = 96
BANDWIDTH = 4.0  # of the Gaussian kernel, on standardised statistics
RIDGE = 1e-3
FOLDS = 5
SEED = 11
GRID = 2048  # calibration bins per unit of score

FEATURES = ("log_words", "mean_length", "longest", "symbols", "pipes", "exclaims", "stops", "commas", "upper", "digits",
            "non_ascii", "log_lines", "line_words", "new_lines", "new_words", "same_next", "new_triples", "top_word")


def statistics(text: str | None) -> list[float]:
    """The statistics named in FEATURES; all 0 for a null or wordless text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(raw)
    share = lambda drop: (size - len(raw.translate(None, drop))) / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        np.log1p(n), sum(map(len, words)) / n, np.log1p(max(map(len, words))),
        share(b"#*$%&<>") ** .5, share(b"|") ** .5, share(b"!") ** .5, share(b".") ** .5, share(b",") ** .5,
        share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789") ** .5, share(bytes(range(128, 256))),
        np.log1p(len(lines)), np.log1p(n / len(lines)), len(set(lines)) / len(lines),
        len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:], words[2:], strict=False))) / max(n - 2, 1), max(Counter(words).values()) / n,
    ]


class Kernel:
    """Standardisation and random Fourier features."""

    def __init__(self, mean, std, components: int = COMPONENTS, bandwidth: float = BANDWIDTH, seed: int = SEED):
        self.mean, self.std = np.asarray(mean, float), np.asarray(std, float)
        self.std[~(self.std > 1e-9)] = 1.0
        rng = np.random.default_rng(seed)
        self.w = rng.normal(size=(len(self.mean), components)) / bandwidth
        self.b = rng.uniform(0, 2 * np.pi, components)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        f = np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)
        return np.hstack((f, np.ones((len(f), 1))))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(float) if len(col) else np.zeros((0, len(FEATURES)))


def _sums(kernel: Kernel):
    """Per fold, the upper triangle of [Z y]'[Z y] over a partition."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = len(kernel.b) + 2
        total = {}
        for pdf in batches:
            z = np.hstack((kernel(_matrix(pdf["f"])), pdf[["y"]].to_numpy(float)))
            for fold in np.unique(pdf["fold"]):
                part = z[(pdf["fold"] == fold).to_numpy()]
                total[fold] = total.get(fold, np.zeros((d, d))) + part.T @ part
        i, j = np.triu_indices(d)
        for fold, m in total.items():
            yield pd.DataFrame({"fold": int(fold), "i": i, "j": j, "v": m[i, j]})
    return run


def ridge(gram: np.ndarray, alpha: float = RIDGE) -> np.ndarray:
    """Weights from [Z y]'[Z y]; the constant (last of Z) is not shrunk."""
    a, rhs = gram[:-1, :-1].copy(), gram[:-1, -1]
    n = a[-1, -1]
    a[np.arange(len(a) - 1), np.arange(len(a) - 1)] += alpha * max(n, 1.0)
    a[-1, -1] += 1e-9
    return np.linalg.solve(a, rhs)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; returns the blocks' centres and values, to interpolate."""
    blocks: list[list[float]] = []  # weight, sum of y, sum of x
    for a, b, w in zip(x, y, weight, strict=True):
        blocks.append([w, b * w, a * w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    w, sy, sx = np.array(blocks).T
    return sx / w, np.clip(sy / w, 0.0, 1.0)


def bin_of(score: np.ndarray) -> np.ndarray:
    return np.round(np.clip(score, -1, 2) * GRID).astype(np.int64)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    @F.pandas_udf("array<float>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    return materialize(docs.select(F.col(f"`{id_col}`").alias("doc_id"), stats(F.col(f"`{text_col}`")).alias("f")), "stats")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", buckets: int = 3, held_out: int = 1, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Rows whose crc32 of the id modulo ``buckets`` is ``held_out`` never teach a label; all
    other labelled rows do. A null or empty text has statistics of 0 and is scored like any
    other; a null id counts as the empty text in crc32. Null labels are no labels; of several
    labels of one id the largest counts. Without any label to learn from every score is 0.5.
    Very long texts are measured whole; equal texts have equal scores, and repeated rows one
    each. Other columns of both tables are not read, whatever their names. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    feats = features(docs, id_col, text_col)
    out = code_bucket(F.col("doc_id"), buckets) == held_out
    y = (labels.select(F.col("doc_id"), F.col(f"`{label_col}`").cast("double").alias("y"))
         .where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y")))
    train = materialize(feats.join(y, "doc_id").where(~out)
                        .select("f", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "train")
    d = len(FEATURES)
    row = train.agg(F.count(F.lit(1)), *[F.avg(F.col("f")[i]) for i in range(d)],
                    *[F.stddev_pop(F.col("f")[i]) for i in range(d)]).first()
    if not row[0]:
        return feats.select("doc_id", out.alias("held_out"), F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"))
    kernel = Kernel(row[1:1 + d], row[1 + d:])
    size = COMPONENTS + 2
    gram = np.zeros((FOLDS, size, size))
    sums = train.mapInPandas(_sums(kernel), "fold int, i int, j int, v double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
    for fold, i, j, v in sums.collect():  # folds x size x size / 2 numbers, whatever the input
        gram[fold, i, j] = gram[fold, j, i] = v
    total = gram.sum(0)
    weights = ridge(total)
    apart = np.stack([ridge(total - g) if (total - g)[-2, -2] else weights for g in gram])

    @F.pandas_udf("bigint")
    def unseen(f: pd.Series, fold: pd.Series) -> pd.Series:
        return pd.Series(bin_of((kernel(_matrix(f)) * apart[fold.to_numpy()]).sum(1)))

    bins = train.select(unseen("f", "fold").alias("b"), "y").groupBy("b").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    curve = np.array(sorted(tuple(r) for r in bins.collect()), float)  # at most 3 * GRID + 1 rows
    centres, values = isotonic(curve[:, 0], curve[:, 1] / curve[:, 2], curve[:, 2])

    @F.pandas_udf("double")
    def score(f: pd.Series) -> pd.Series:
        return pd.Series(np.interp((kernel(_matrix(f)) @ weights) * GRID, centres, values))

    return (feats.select("doc_id", out.alias("held_out"), score("f").alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
