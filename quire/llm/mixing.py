"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; a document's expected number of copies is its
source's target over its source's size. The whole part is taken outright; the fractions
are rounded by pivoting: two fractional documents exchange word mass at random until one
of them is whole, so expectations stay as they were and each exchange keeps the source's
words exactly. Chunks of a source are pivoted on their own and leave one fractional
document each; a reduction tree pairs these residuals, level by level, until one per source
is left and rounded at random. A source's words thus differ from its target by less than
one small document, and no task holds more than a chunk, however large a source is.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import join_groups, materialize, ordered_index, pack_row, prepare, unpack_row, words_array
from quire.operators.ranking import numbered

WEIGHTS = (5.0, 2.0, 1.0)  # by source in code point order, repeating
SHARE = 1.5  # of all words
MOST = 2  # times a source's own words
CHUNK = 8192
FAN_IN = 64
SEED = 17
ALIKE = 4096  # equal rows that are written out in one piece


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source: ``source, source_size, n_docs, target``.

    The targets add up to ``share`` of all words in proportion to the weights, but stop at
    ``most`` times the source's words; the excess goes to the others by weight until none
    is above. Each round is one aggregate over the sources; only its sums reach the driver.
    """
    if not 0 <= share <= most:
        raise ValueError("share must lie between 0 and most")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = ordered_index(per, [F.col("source").isNull(), F.col("source")], "pos")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    per = materialize(per.withColumn("w", w), "sources")
    cap = F.col("source_size") * F.lit(float(most))
    total, weight = per.agg(F.sum("source_size"), F.sum("w")).first()
    level, stopped = (share * float(total) / weight if weight else 0.0), 0
    while total:
        at = cap <= F.lit(level) * F.col("w")
        n, full, rest = per.agg(F.count_if(at), F.sum(F.when(at, cap)), F.sum(F.when(~at, F.col("w")))).first()
        if n == stopped or not rest:
            break
        level, stopped = (share * float(total) - float(full or 0.0)) / float(rest), n
    return per.select("source", "source_size", "n_docs",
                      F.least(cap, F.lit(level) * F.col("w")).cast("double").alias("target"))


def told_apart(rows: DataFrame, alike: int = ALIKE) -> DataFrame:
    """``doc_id, th, source, size`` with ``dup``, the number of each row among those of equal
    ``doc_id, th``, by source.

    Equal rows are counted, not numbered by a window: a row that makes up a third of the table
    is one row a task before the exchange. The counts are written out again in pieces of
    ``alike`` rows, each dealt by itself. A window sees one row for each source.
    """
    before = Window.partitionBy("doc_id", "th").orderBy("source", "size").rowsBetween(Window.unboundedPreceding, -1)
    counted = (rows.groupBy("doc_id", "th", "source", "size").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)) + 1))
    end = F.col("first") + F.col("n") - 1
    pieces = (counted.withColumn("end", end)
              .withColumn("start", F.explode(F.sequence("first", "end", F.lit(alike).cast("bigint"))))
              .repartition("doc_id", "th", "start"))
    dup = F.explode(F.sequence("start", F.least(F.col("start") + F.lit(alike - 1), F.col("end"))))
    return pieces.select("doc_id", "th", "source", "size", dup.alias("dup")).withColumn("dup", F.col("dup").cast("int"))


def pivot(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round the fractions ``p`` to 0 or 1, keeping the sum of ``size * p`` exactly.

    Returns the new values and the index of the one that stayed fractional (-1: none).
    """
    p = p.astype(float).tolist()
    w = size.astype(float).tolist()
    draw = rng.random(len(p)).tolist()
    i = -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if i < 0:
            i = j
            continue
        # mass that i can take from j, and that i can give to j
        room_i, room_j, has_i, has_j = (1 - p[i]) * w[i], (1 - p[j]) * w[j], p[i] * w[i], p[j] * w[j]
        up, down = min(room_i, has_j), min(has_i, room_j)
        if draw[j] * (up + down) < down:
            i_whole, j_whole = room_i <= has_j, has_j <= room_i
            p[i] = 1.0 if i_whole else p[i] + up / w[i]
            p[j] = 0.0 if j_whole else p[j] - up / w[j]
        else:
            i_whole, j_whole = has_i <= room_j, room_j <= has_i
            p[i] = 0.0 if i_whole else p[i] - down / w[i]
            p[j] = 1.0 if j_whole else p[j] + down / w[j]
        i = -1 if i_whole and j_whole else j if i_whole else i
    return np.array(p), i


_LEVEL = "doc_id bigint, th bigint, dup int, source string, size bigint, base int, p double, chunk bigint, done boolean"


def _round(seed: int, level: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # large documents first: the one that is left over is small
        pdf = pdf.sort_values(["size", "tie", "doc_id", "th", "dup"], ascending=[False, True, True, True, True])
        text = "\x00" if key[0] is None else "s" + key[0]
        rng = np.random.default_rng([seed, level, int(key[1]), zlib.crc32(text.encode())])
        p, left = pivot(pdf["size"].to_numpy(), pdf["p"].to_numpy(), rng)
        if left >= 0 and last:
            p[left] = float(rng.random() < p[left])
            left = -1
        done = np.ones(len(pdf), bool)
        if left >= 0:
            done[left] = False
        out = pdf.drop(columns=["tie"]).assign(p=p, done=done, chunk=int(key[1]))
        return out[[c.split()[0] for c in _LEVEL.split(", ")]]
    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, most: int = MOST, chunk: int = CHUNK, fan_in: int = FAN_IN,
        seed: int = SEED) -> DataFrame:
    """One row per input row: ``doc_id, th, dup, source, size, source_size, target, copies, taken``.

    ``size`` counts words (a null or blank text has none), ``copies`` is how often the mix
    takes the document, ``taken = copies * size``. A null source is a
    source of its own, last in order. Rows of equal id and text are told apart by ``dup``.
    The draws depend on ids, texts and ``seed`` alone, so reruns agree; documents of equal
    size are paired in the order of a hash of id, text and ``dup``. Very long texts count whole.
    Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    col = lambda c: F.col(f"`{c}`")
    sizes = materialize(told_apart(
        docs.select(col(id_col).alias("doc_id"), col(source_col).alias("source"), F.xxhash64(col(text_col)).alias("th"),
                    F.size(words_array(col(text_col))).cast("bigint").alias("size"))), "sizes")
    per = materialize(source_targets(sizes, weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    chunks = F.greatest(F.ceil(F.col("n_docs") / chunk), F.lit(1))
    rows = sizes.join(per, sizes["source"].eqNullSafe(per["source"])).drop(per["source"])
    rows = rows.select("doc_id", "th", "dup", "source", "size", F.floor(rate).cast("int").alias("base"),
                       F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0).alias("p"),
                       F.pmod(F.xxhash64("doc_id", "th", "dup"), chunks).cast("bigint").alias("chunk"))
    widest = per.agg(F.max(chunks)).first()[0] or 1
    settled, level = [], 0
    while True:
        last = widest <= 1
        tie = F.xxhash64(F.lit(seed), "doc_id", "th", "dup").alias("tie")
        done = materialize(rows.select("*", tie).groupBy("source", "chunk")
                           .applyInPandas(_round(seed, level, last), _LEVEL), f"level{level}")
        settled.append(done.where("done"))
        if last:
            break
        rows = done.where("not done").drop("done").withColumn("chunk", F.floor(F.col("chunk") / fan_in))
        widest, level = -(-widest // fan_in), level + 1
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    copies = (F.col("base") + F.col("p")).cast("bigint")
    joined = out.join(per.withColumnRenamed("source", "_s"), out["source"].eqNullSafe(F.col("_s")))
    return joined.select("doc_id", "th", "dup", "source", "size", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"))


def _alike(id_: Column, th: Column, source: Column) -> Column:
    """One string for id, text hash and source; a null id or source is a value of its own."""
    text = F.coalesce(F.concat(F.lit("i"), id_.cast("string")), F.lit("-"))
    return F.concat(th.cast("string"), F.lit(":"), F.length(text).cast("string"), F.lit(":"), text,
                    F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("-")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **params) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns as they were.

    Rows of equal id, text and source are taken equally often, or some of them once more than
    the others; which ones these are is not defined. Only rows of the latter kind are numbered,
    over range partitions. A row that makes up a third of the table is joined to its number of
    copies where it lies (`join_groups`). Nulls, empty tables and clashing names as in `mix`.
    """
    m = mix(docs, id_col, text_col, source_col, **params)
    least = F.min("copies")
    groups = materialize(
        m.groupBy(_alike(F.col("doc_id"), F.col("th"), F.col("source")).alias("_key"))
        .agg(F.count(F.lit(1)).alias("_rows"), least.alias("_least"), (F.sum("copies") - F.count(F.lit(1)) * least).alias("_more")), "copies")
    n = groups.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    row = lambda c: F.col("_row").getField(c)
    src = pack_row(docs).withColumn("_key", _alike(row(id_col), F.xxhash64(row(text_col)), row(source_col)))
    even, uneven = groups.where("_more = 0 and _least > 0"), groups.where("_more > 0")
    out = join_groups(src, even, "_key", "_rows", n).select("_row", F.col("_least").alias("_copies"))
    if not uneven.isEmpty():
        some = numbered(join_groups(src, uneven, "_key", "_rows", n).withColumn("_tie", F.rand(SEED)), ["_key"], ["_tie"])
        out = out.unionByName(some.select("_row", (F.col("_least") + (F.col("_index") < F.col("_more")).cast("int")).alias("_copies")))
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return unpack_row(out.where("_copies > 0").withColumn("_copy", copies), docs.columns)
