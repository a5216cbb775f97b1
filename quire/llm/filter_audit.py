"""Interaction audit of five filters by truth-table survival words.

A document fails some of the filters A to E. Its survival word has one bit for each of the 32
subsets of the filters: set if the document survives when that subset is applied. Adding the
words up bit by bit gives the survivors of every subset at once, for each part of the table
and each label; in a task they are added with carry-save adders over whole words (three words
of one weight become a sum and a carry of twice the weight), and Spark adds the counts of the
tasks. Everything asked about an order of filters is a difference of survivor counts, so the
120 orders are worked out on the counts alone, a few rows for each part.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import join_groups, materialize, prepare

FILTERS = "ABCDE"
MIN_WORDS = 50
DISTINCT_PCT = 65
UPPER_PCT = 5
MARKS = b"#$%&*|"
COPY = 1 << FILTERS.index("E")
SUBSETS = 1 << len(FILTERS)
LABELS = ("all", "good", "toxic")  # 0 to 2: every document, quality = 1, toxic = 1
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)

ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
f AS (
  SELECT doc_id, part,
         CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed
  FROM w),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT f.*, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || e.x || g.x AS filter_order
  FROM letters a, letters b, letters c, letters e, letters g
  WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
gone AS (  -- the step at which an order removes a document (6: never)
  SELECT d.*, filter_order, list_min([CASE WHEN contains(failed, substr(filter_order, CAST(i AS INT), 1)) THEN i ELSE 6 END
                                      FOR i IN range(1, 6)]) AS cut_at
  FROM d, orders),
n AS (
  SELECT part, filter_order, step, letter,
         count(*) FILTER (cut_at > step) AS kept, count(*) FILTER (cut_at = step) AS removed,
         count(*) FILTER (contains(failed, letter) AND cut_at < step) AS redundant,
         count(*) FILTER (failed = letter) AS unique_fails,
         count(*) FILTER (cut_at = step AND good) AS good_lost, count(*) FILTER (cut_at = step AND toxic) AS toxic_lost
  FROM gone JOIN steps USING (filter_order) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM n
"""


def text_fails(text: str | None) -> int:
    """Bits of the filters A to D that a text fails; null counts as empty."""
    t = text or ""
    raw = t.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes: parts at space and 0x09-0x0D only
    n = len(words)
    return ((n < MIN_WORDS) | (100 * len(set(words)) < DISTINCT_PCT * n) << 1
            | (100 * len(raw.translate(None, _NOT_UPPER)) > UPPER_PCT * len(t)) << 2
            | (len(raw.translate(None, MARKS)) < len(raw)) << 3)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        keys = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("part"), pa.array([text_fails(t) for t in texts], pa.int32()), pa.array(keys, pa.binary())],
            ["doc_id", "part", "fails", "key"])


def survival_word(fails: np.ndarray) -> np.ndarray:
    """Words of 32 bits: bit s is set where none of the filters in subset s is failed."""
    s = np.arange(SUBSETS, dtype=np.uint32)
    by_mask = np.array([np.bitwise_or.reduce(np.where(s & m, 0, np.uint32(1) << s)) for m in range(SUBSETS)], np.uint32)
    return by_mask[fails]


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the words have each of the 32 bits, by carry-save adders."""
    weight = [words.astype(np.uint32)]  # weight[i]: words whose bits count 2**i
    total, i = np.zeros(32, np.int64), 0
    while i < len(weight):
        cur = weight[i]
        while len(cur) > 2:
            k = len(cur) // 3
            a, b, c = cur[:k], cur[k:2 * k], cur[2 * k:3 * k]
            half = a ^ b
            carry = (a & b) | (half & c)
            cur = np.concatenate((half ^ c, cur[3 * k:]))
            if i + 1 == len(weight):
                weight.append(carry)
            else:
                weight[i + 1] = np.concatenate((weight[i + 1], carry))
        for w in cur:
            total += (w >> np.arange(32, dtype=np.uint32) & 1).astype(np.int64) << i
        i += 1
    return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors of every subset by part and label; each batch by itself."""
    for b in batches:
        word = survival_word(b.column("fails").to_numpy(zero_copy_only=False))
        part = b.column("part").dictionary_encode()
        code = part.indices.to_numpy(zero_copy_only=False)
        flags = [np.ones(len(code), bool), *(b.column(c).to_numpy(zero_copy_only=False) for c in LABELS[1:])]
        out = []
        for label, flag in enumerate(flags):
            rows = np.flatnonzero(flag)
            rows = rows[np.argsort(code[rows], kind="stable")]
            cuts = np.flatnonzero(np.diff(code[rows], prepend=-1, append=-1)) if len(rows) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                out.append((part.dictionary[int(code[rows[lo]])].as_py(), label, positional_popcount(word[rows[lo:hi]]).tolist()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()),
                                              pa.array([o[2] for o in out], pa.list_(pa.int64()))], ["part", "label", "counts"])


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
             good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """``doc_id, part, fails, good, toxic`` for every row: the bits of the failed filters (A
    lowest). Cases as in `audit`."""
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                      F.col(f"`{text_col}`").alias("text"))
    id_type = dict(src.dtypes)["doc_id"]
    judged = materialize(src.mapInArrow(_judge, f"doc_id {id_type}, part string, fails int, key binary"), "judged")
    groups = materialize(judged.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "first")
    marked = join_groups(judged, groups, "key", "copies", judged.count()).select("doc_id", "part", F.when(
        F.col("doc_id") > F.col("first"), F.col("fails").bitwiseOR(F.lit(COPY))).otherwise(F.col("fails")).alias("fails"))
    known = (labels.select(F.col("doc_id").cast(id_type).alias("doc_id"), F.col(f"`{good_col}`").alias("g"), F.col(f"`{toxic_col}`").alias("t"))
             .where("doc_id is not null").groupBy("doc_id").agg((F.max("g") == 1).alias("good"), (F.max("t") == 1).alias("toxic")))
    return marked.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in LABELS[1:]})


def survivors(failed: DataFrame) -> DataFrame:
    """``part, label, counts``: ``counts[s]`` documents survive the subset ``s`` of the filters."""
    prepare(failed.sparkSession)
    parts = failed.select("part", "fails", "good", "toxic").mapInArrow(_count, "part string, label int, counts array<bigint>")
    sums = F.array(*[F.sum(F.get("counts", F.lit(s))) for s in range(SUBSETS)])
    return parts.groupBy("part", "label").agg(sums.alias("counts"))


def orders(counts: dict[int, np.ndarray]) -> list[tuple]:
    """Rows of one part from its survivor counts by label: every order, every step."""
    zero = np.zeros(SUBSETS, np.int64)
    n, good, toxic = (np.asarray(counts.get(i, zero)) for i in range(3))
    k, full = len(FILTERS), SUBSETS - 1
    lost: dict[int, int] = defaultdict(int)  # removed by a filter, over all orders
    for f in range(k):
        for s in range(SUBSETS):
            if not s >> f & 1:
                lost[f] += factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) * int(n[s] - n[s | 1 << f])
    out = []
    for order in permutations(range(k)):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed = int(n[before] - n[after])
            out.append((name, step, int(n[after]), removed, int(n[0] - n[1 << f]) - removed, int(n[full & ~(1 << f)] - n[full]),
                        int(good[before] - good[after]), int(toxic[before] - toxic[after]), lost[f]))
            before = after
    return out


_ROW = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
        "good_lost bigint, toxic_lost bigint, shapley bigint")


def _expand(pdf: pd.DataFrame) -> pd.DataFrame:
    part = pdf["part"].iloc[0]
    rows = orders({int(i): np.asarray(c) for i, c in zip(pdf["label"], pdf["counts"], strict=True)})
    return pd.DataFrame([(part, *r) for r in rows], columns=[c.split()[0] for c in _ROW.split(", ")])


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of the step.

    A null text counts as empty (it fails A), a null part as the empty string. Repeated rows
    count as often as they stand; equal texts of one id are no copies of each other, as no id
    is smaller. A null id is neither smaller nor larger than any and has no label. Of several
    labels of one id the largest counts; other columns of both tables are not read, whatever
    their names. Long texts are judged whole. An empty table has no parts: an empty result.
    """
    # three rows at most for each part
    return survivors(failures(docs, labels, **columns)).groupBy("part").applyInPandas(_expand, _ROW)
