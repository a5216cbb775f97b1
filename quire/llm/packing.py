"""Conflict-constrained best-fit packing of documents into bins of equal capacity.

Open bins are kept in order of what is left in them and carry two bitmaps, one of the
sources and one of the duplicate clusters they hold. A piece goes to the tightest bin that
has room and whose bitmaps do not refuse it: the search starts at the successor of the
piece's size and goes on, block by block, until such a bin is found; if there is none, a
bin is opened. Pieces are taken in decreasing size.

Pieces are dealt by hash to chunks of bounded expected size, and each chunk is packed on
its own, so neither a hot source nor a large cluster of copies meets in one task. The pieces of
bins that stay underfilled are then dealt to fewer chunks and packed again, pass by pass, until
one chunk holds them all or a pass saves next to nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize, prepare, words_array
from quire.llm.simhash import simhash_groups

CAPACITY = 2048  # words in a bin
PER_SOURCE = 2  # pieces of one source that a bin takes at most
CHUNK = 4096  # pieces packed together
FULL = 0.95  # share of the capacity from which a bin is not packed again
GAIN = 0.01  # share of the underfilled bins that a pass must save for another one to follow
BLOCK = 256  # bins that one step of the search looks at


def _bits(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Word and bit of every code in a bitmap, and the number of words (code -1: no bit)."""
    bit = np.where(codes < 0, np.uint64(0), np.uint64(1) << (codes & 63).astype(np.uint64))
    return np.maximum(codes, 0) >> 6, bit, int(codes.max(initial=0) >> 6) + 1


def best_fit(size: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int = CAPACITY,
             per_source: int = PER_SOURCE, block: int = BLOCK) -> np.ndarray:
    """Bin number of every piece, in the given order. ``source`` and ``cluster`` are small
    codes from 0; a bin takes ``per_source`` pieces of a source and one of a cluster (-1: a
    cluster that no other piece here has)."""
    n = len(size)
    bins = np.full(n, -1, np.int64)
    sw, sb, s_words = _bits(source)
    cw, cb, c_words = _bits(cluster)
    s_map = np.zeros((per_source, n, s_words), np.uint64)  # one bitmap for every place a source has
    c_map = np.zeros((n, c_words), np.uint64)
    left, open_ = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)  # residuals ascending, and their bins
    count = made = 0
    for i in range(n):
        at, full, found = int(np.searchsorted(left[:count], size[i])), s_map[per_source - 1], -1
        while at < count:
            ids = open_[at:min(at + block, count)]
            ok = ((full[ids, sw[i]] & sb[i]) | (c_map[ids, cw[i]] & cb[i])) == 0
            j = int(ok.argmax())
            if ok[j]:
                found = at + j
                break
            at += block
        if found < 0:
            b, rest, made = made, capacity - size[i], made + 1
            upto = count
            count += 1
        else:
            b, rest = open_[found], left[found] - size[i]
            upto = found
        bins[i] = b
        for place in s_map:
            if not place[b, sw[i]] & sb[i]:
                place[b, sw[i]] |= sb[i]
                break
        c_map[b, cw[i]] |= cb[i]
        to = int(np.searchsorted(left[:upto], rest))
        left[to + 1:upto + 1] = left[to:upto].copy()
        open_[to + 1:upto + 1] = open_[to:upto].copy()
        left[to], open_[to] = rest, b
        while count and left[0] == 0:  # full bins leave the search
            left[:count - 1] = left[1:count].copy()
            open_[:count - 1] = open_[1:count].copy()
            count -= 1
    return bins


_OUT = ("doc_id bigint, source string, cluster bigint, row bigint, piece int, piece_words bigint, "
        "start bigint, end bigint, bin_id bigint, bin_words bigint")
_WORD = re.compile(r"[^ \t-\r]+")  # as words_array has them


def _tiles(capacity: int):
    """Code points at which a text is cut: its start, and every word after a full piece."""
    @F.pandas_udf("array<bigint>")
    def cuts(texts: pd.Series) -> pd.Series:
        def one(t):
            return t and [0, *(m.start() for i, m in enumerate(_WORD.finditer(t)) if i and i % capacity == 0)]
        return texts.map(one, na_action="ignore")

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [t[a:b] for a, b in zip(c, [*c[1:], None], strict=True)]
                          for t, c in zip(texts, at, strict=True)], dtype=object)
    return cuts, parts


def _pack_chunk(capacity: int, per_source: int, first: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["piece_words", "cluster", "row", "piece"], ascending=[False, True, True, True],
                              ignore_index=True)
        source = pd.factorize(pdf["source"], use_na_sentinel=False)[0].astype(np.int64)
        _, inverse, times = np.unique(pdf["cluster"].to_numpy(), return_inverse=True, return_counts=True)
        code = np.where(times > 1, np.cumsum(times > 1) - 1, -1)  # bits only for clusters that meet here
        bins = best_fit(pdf["piece_words"].to_numpy(), source, code[inverse], capacity, per_source)
        used = np.bincount(bins, weights=pdf["piece_words"]).astype(np.int64)
        pdf["bin_id"] = (first + int(key[0]) << 32) + bins
        pdf["bin_words"] = used[bins]
        return pdf[[c.split()[0] for c in _OUT.split(", ")]]
    return run


def _pack_level(pieces: DataFrame, n: int, chunk: int, capacity: int, per_source: int, level: int, first: int) -> DataFrame:
    deal = F.xxhash64("row", "piece") if level == 0 else F.xxhash64(F.lit(level), F.col("row"), F.col("piece"))
    return materialize(pieces.withColumn("chunk", F.pmod(deal, F.lit(max(1, -(-n // chunk)))))
                       .groupBy("chunk").applyInPandas(_pack_chunk(capacity, per_source, first), _OUT), f"packed{level}")


def _pack_all(pieces: DataFrame, n: int, chunk: int, capacity: int, per_source: int) -> DataFrame:
    """Chunks, then passes over the pieces of underfilled bins; a pass that saves no bin is dropped."""
    packed, level, first, settled = _pack_level(pieces, n, chunk, capacity, per_source, 0, 0), 0, 0, []
    while n > chunk and level < 100:
        level, first = level + 1, first + -(-n // chunk)  # chunks of all passes are numbered on
        rest = F.col("bin_words") < FULL * capacity
        under = packed.where(rest)
        n, before = under.agg(F.count(F.lit(1)), F.count_distinct("bin_id")).first()
        if not n:
            break
        again = _pack_level(under.drop("bin_id", "bin_words"), n, chunk, capacity, per_source, level, first)
        after = again.agg(F.count_distinct("bin_id")).first()[0]
        if after >= before:
            break
        settled.append(packed.where(~rest))
        packed = again
        if before - after < GAIN * before:
            break
    for s in settled:
        packed = packed.unionByName(s)
    return packed


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``doc_id, text_hash, cluster`` of every document: the class of its near copies, as the
    smallest fingerprint of its SimHash component."""
    g = simhash_groups(docs, id_col, text_col, **params)
    return materialize(g.groupBy("doc_id", "text_hash").agg(F.min("root").alias("cluster")), "near-copies")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         cluster: Column | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE,
         chunk: int = CHUNK, texts: bool = True, classes: DataFrame | None = None) -> DataFrame:
    """One row per piece: ``doc_id, source, cluster, row, piece, piece_words, start, end, bin_id,
    bin_words``, and with ``texts`` the piece's ``text``.

    A text of more than ``capacity`` words is cut into pieces of ``capacity`` words and a
    rest; other texts are one piece (number 0). A piece is the code points from ``start`` to
    before ``end``, up to the next piece's first word: the pieces of a row, one after the
    other, are its text. ``cluster`` is the duplicate cluster (the
    text's XXH64 by default: exact copies; with ``classes``, which holds ``doc_id, text_hash,
    cluster`` once for each id and text, the row's class there, else as before); no bin holds two pieces of one cluster or more
    than ``per_source`` of one source (null is a source). A null or blank text is a piece of
    no words with a null bin. ``row`` tells equal rows apart. An empty table gives an empty
    result.
    """
    prepare(docs.sparkSession)
    if capacity < 1 or per_source < 1:
        raise ValueError("capacity and per_source must be positive")
    text = F.col(f"`{text_col}`")
    cuts, parts = _tiles(capacity)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), text.alias("text"),
        (F.xxhash64(text) if cluster is None else cluster).cast("bigint").alias("cluster"),
        F.size(words_array(text)).cast("bigint").alias("words"), F.monotonically_increasing_id().alias("row"))
    # Python sees the texts that are cut, no others
    long = F.when(F.col("words") > capacity, F.col("text"))
    rows = rows.withColumn("n", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint")).withColumn(
        "cuts", F.coalesce(cuts(long), F.array(F.lit(0).cast("bigint"))))
    if classes is not None:
        rows = rows.withColumn("text_hash", F.xxhash64("text"))
    if texts:
        rows = rows.withColumn("texts", F.coalesce(parts(long, F.col("cuts")), F.array("text")))
    # the code of a null cluster: a cluster of its own for every row
    rows = rows.withColumn("cluster", F.coalesce("cluster", F.xxhash64("row"))).drop("text")
    at = F.col("piece")
    pieces = rows.select("*", F.posexplode("cuts").alias("piece", "start")).select(
        "doc_id", "source", "cluster", "row", "piece",
        F.least(F.lit(capacity), F.col("words") - at * F.lit(capacity)).cast("bigint").alias("piece_words"),
        "start", F.coalesce(F.get("cuts", at + 1), F.col("n")).alias("end"), *(["text_hash"] if classes is not None else []),
        *([F.get("texts", at).alias("text")] if texts else []))
    pieces = materialize(pieces, "pieces")
    keys = pieces.drop("text")
    if classes is not None:
        near = classes.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("cluster").alias("_near"))
        joined = keys.join(near, keys["doc_id"].eqNullSafe(near["_id"]) & (keys["text_hash"] == near["_hash"]), "left")
        keys = materialize(joined.withColumn("cluster", F.coalesce("_near", "cluster")).drop("_id", "_hash", "_near"), "classed")
    keys = keys.drop("text_hash")
    packed = _pack_all(keys.where("piece_words > 0"), keys.count(), chunk, capacity, per_source)
    none = keys.where("piece_words = 0").select(
        "*", F.lit(None).cast("bigint").alias("bin_id"), F.lit(None).cast("bigint").alias("bin_words"))
    out = packed.unionByName(none)
    return out.join(pieces.select("row", "piece", "text"), ["row", "piece"]).select(*out.columns, "text") if texts else out


def bins(packed: DataFrame) -> DataFrame:
    """The packed sequences, one row per bin: ``bin_id, bin_words, pieces`` (each with its
    ``doc_id, row, piece, start, end, text``, by row and piece). Takes what `pack` returns
    with texts; wordless texts are in no bin."""
    piece = F.struct("row", "piece", "doc_id", "source", "start", "end", "piece_words", "text")
    return (packed.where("bin_id is not null").groupBy("bin_id")
            .agg(F.first("bin_words").alias("bin_words"), F.sort_array(F.collect_list(piece)).alias("pieces")))
