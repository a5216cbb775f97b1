"""SimHash near-dedup by pigeonhole blocks.

A 64-bit fingerprint is cut into ``blocks`` parts. Two fingerprints that differ in at most
``max_bits`` bits agree on at least ``blocks - max_bits`` parts, so they meet in one of the
tables keyed by that many parts; the Hamming distance is then verified. Equal fingerprints
are one class before any join, links inside a block are reduced to a spanning star before
they leave the task, and a block that holds very many classes is dealt out as pairs of
bounded chunks, so no task sees an unbounded group and no link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize, pack_row, prepare, unpack_row
from quire.llm.components import connected_components

SHINGLE = 4
MAX_BITS = 4
BLOCKS = 6
CHUNK = 4096  # classes of one block that a single work unit takes from either side


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash over word shingles (A-Z lower-cased, XXH64 seed 42)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and spaces only
    if not words:
        return 0
    k = min(shingle, len(words))
    buf = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = len(words) - k + 1
    x64 = xxhash.xxh64_intdigest
    h = np.fromiter((x64(buf[a:b], 42) for a, b in zip(starts[:n].tolist(), (ends[k - 1:] - 1).tolist(), strict=True)),
                    np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        part = np.ascontiguousarray(h[i:i + 8192].astype("<u8")).view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def simhash_udf(shingle: int = SHINGLE):
    @F.pandas_udf("bigint")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle) for t in texts], np.uint64).view(np.int64))
    return fp


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """One mask per table: every choice of ``blocks - max_bits`` parts of the 64 bits."""
    if not max_bits < blocks <= 64:
        raise ValueError("blocks must be more than max_bits, and 64 at most")
    edge = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(blocks)]
    masks = [sum(part[i] for i in c) for c in combinations(range(blocks), blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _stars(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal key (sorted), as (member, smallest linked member)."""
    n = len(fps)
    label = np.arange(n)
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    size = np.diff(cut)

    def join(a, b):
        """Hang the larger root of each link below the smaller one until none differs."""
        nonlocal label
        while True:
            ra, rb = label[a], label[b]
            if (ra == rb).all():
                return
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
            while (label != (up := label[label])).any():
                label = up

    small = np.repeat(size <= 64, size)
    for d in range(1, int(min(size.max(initial=0), 64))):
        near = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:]
                              & (np.bitwise_count(fps[d:] ^ fps[:-d]) <= max_bits))
        if len(near):
            join(near, near + d)
    for g in np.flatnonzero(size > 64):
        lo, hi = cut[g], cut[g + 1]
        for i in range(lo, hi, 128):
            a, b = np.nonzero(np.bitwise_count(fps[i:min(i + 128, hi), None] ^ fps[None, i:hi]) <= max_bits)
            keep = a < b
            if keep.any():
                join(a[keep] + i, b[keep] + i)
    member = np.flatnonzero(label != np.arange(n))
    return fps[member], fps[label[member]]


def _links(max_bits: int):
    def run(batches):
        held = None  # the rows of the last key so far: its group may go on in the next batch
        def out(keys, fps):
            a, b = _stars(keys, fps.view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
        for batch in batches:
            k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(k):
                continue
            if held is not None:
                k, f = np.concatenate((held[0], k)), np.concatenate((held[1], f))
            start = int(np.searchsorted(k, k[-1]))
            held = k[start:], f[start:]
            if start:
                yield out(k[:start], f[:start])
        if held is not None:
            yield out(*held)
    return run


def near_links(classes: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Links ``a, b`` (fingerprints) that connect all classes within ``max_bits`` bits.

    ``classes`` has one bigint column ``fp`` with distinct values. The links are a spanning
    subset: the connected components equal those of all close pairs.
    """
    tables = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m)))
                       for t, m in enumerate(block_masks(blocks, max_bits))])
    keys = materialize(classes.select("fp", F.explode(tables).alias("key")), "blocks")
    # blocks above one chunk; written, so that the join sees its size and can split a hot key
    hot = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk)
                      .select(F.col("key").alias("hot"), F.ceil(F.col("n") / chunk).cast("int").alias("p")), "hot")
    mine = F.pmod(F.xxhash64("fp"), F.col("p")).cast("int")
    units = F.when(F.col("p").isNull(), F.array(F.col("key"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("p") - 1),
                    lambda j: F.xxhash64(F.col("key"), F.least(mine, j), F.greatest(mine, j))))
    dealt = (keys.join(hot, keys["key"] == hot["hot"], "left")
             .select(F.explode(units).alias("unit"), "fp")
             .repartition("unit").sortWithinPartitions("unit"))
    return dealt.mapInArrow(_links(max_bits), "a bigint, b bigint")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   max_bits: int = MAX_BITS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: ``doc_id, text_hash, fp, root, component_id``.

    A null or wordless text has fingerprint zero and links like any other. Rows repeat as
    they come in. A null id stays null; ``component_id`` is the smallest id that is not
    null in the component (null if there is none). An empty table gives an empty result.
    ``text_hash`` (XXH64 of the text) tells rows of equal id apart; ``root`` is the smallest
    fingerprint of the component.
    """
    prepare(docs.sparkSession)
    fps = materialize(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
                      .select("doc_id", F.xxhash64("text").alias("text_hash"),
                              simhash_udf(shingle)("text").alias("fp")), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = connected_components(near_links(classes.select("fp"), max_bits, blocks, chunk))
    member = materialize(classes.join(roots, classes["fp"] == roots["node"], "left")
                         .select("fp", "rep", F.coalesce("root", "fp").alias("root")), "members")
    least = materialize(member.groupBy("root").agg(F.min("rep").alias("component_id")), "ids")
    ids = materialize(member.join(least, "root").select("fp", "root", "component_id"), "class-ids")
    return fps.join(ids, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """Keep one row of each SimHash component, all columns as they were.

    The row with the smallest id stays (nulls last, then the smallest text hash; of fully
    equal rows one).
    """
    rows = simhash_groups(docs, id_col, text_col, **params)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"),
                           F.col("text_hash").alias("c")))
    keep = materialize(rows.groupBy("root").agg(first.alias("f"))
                       .select(F.col("f.b").alias("keep_id"), F.col("f.c").alias("keep_hash")), "keepers")
    packed = pack_row(docs).withColumn("_id", F.col("_row").getField(id_col)).withColumn(
        "_hash", F.xxhash64(F.col("_row").getField(text_col)))
    kept = packed.join(keep, packed["_id"].eqNullSafe(keep["keep_id"]) & (packed["_hash"] == keep["keep_hash"]),
                       "left_semi")
    once = Window.partitionBy("_id", "_hash").orderBy(F.xxhash64("_row"))
    return unpack_row(kept.withColumn("_n", F.row_number().over(once)).where("_n = 1"), docs.columns)
