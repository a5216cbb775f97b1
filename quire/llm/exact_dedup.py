"""Exact dedup by two-pass Bloom filtering, in DataFrame expressions only.

Every text has a SHA-256; from it a block of the filter (32,768 bits) and ``PROBES`` bits of
that block. The first pass counts how many rows hit each bit, with a map-side combine, and
keeps the bits that more than one row hit: a Bloom filter of what may be repeated. The second
pass holds every row against its block. A row with a bit that nobody else hit has no copy and
passes straight through; only the others are shuffled, by their hash, and grouped exactly.

The filter has ``BITS`` bits a row. Its blocks are a table: Spark broadcasts it where its
written size is below the session's limit, and beyond that joins narrow keys (never texts) to
it by block. A hot text is one partial row a task in each aggregation, and its group is joined
from a broadcast table of bounded size (`common.join_groups`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import join_groups, materialize, pack_row, unpack_row

BITS = 16  # of the filter, for each row
PROBES = 3  # bits that a text has in its block
BLOCK = 32768  # bits of a block: what bitmap_construct_agg makes

ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def text_key(text: Column, normalize: Callable[[Column], Column] | None = None) -> Column:
    """SHA-256 of a text (binary, 32 bytes); null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2((normalize(t) if normalize else t).cast("binary"), 256))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key)
    return [F.shiftright(h, 15 * i).bitwiseAND(F.lit(BLOCK - 1)) for i in range(PROBES)]


def repeat_filter(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """First pass over ``keys`` (column ``key``, ``n`` rows): blocks of bits that more than one
    row hit, as ``block, bits``, and the number of blocks. A block without such bits has no row."""
    blocks = max(1, -(-n * BITS // BLOCK))
    hits = keys.select(_block(F.col("key"), blocks).alias("block"), F.explode(F.array_distinct(F.array(*_bits(F.col("key"))))).alias("bit"))
    again = hits.groupBy("block", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return materialize(again.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")), "bloom"), blocks


def probe(rows: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """``rows`` (with ``key``) and ``maybe``: false where no other row has the same key."""
    def hit(bit):  # bit i lies in byte i / 8, at its place i % 8
        byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1
    all_hit = F.lit(True)
    for b in _bits(F.col("key")):
        all_hit = all_hit & hit(b)
    return (rows.withColumn("block", _block(F.col("key"), blocks)).join(bloom, "block", "left")
            .withColumn("maybe", F.coalesce(all_hit, F.lit(False))).drop("block", "bits"))


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         normalize: Callable[[Column], Column] | None = None) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Rows with equal texts after ``normalize`` are a group; the row with the largest id stays.
    A null text counts as empty. A null id is smaller than any other; a group of null ids has
    a null ``keep_id``. Of rows with equal text and equal id (repeated rows) one stays. Long
    texts are hashed whole and never leave the scan. Other columns of ``docs`` are not read,
    whatever their names; an empty table gives an empty result.
    """
    rows = materialize(docs.select(F.col(f"`{id_col}`").alias("id"), text_key(F.col(f"`{text_col}`"), normalize).alias("key"))
                       .withColumn("rid", F.monotonically_increasing_id()), "keys")
    bloom, blocks = repeat_filter(rows, rows.count())
    probed = probe(rows, bloom, blocks)
    sha = F.lower(F.hex("key")).alias("text_sha256")
    alone = probed.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
                                                 F.lit(True).alias("kept"), sha)
    several = materialize(probed.where("maybe").drop("maybe"), "maybe")
    groups = materialize(several.groupBy("key").agg(F.max(F.struct("id", "rid")).alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    return alone.unionByName(
        join_groups(several, groups, "key", "group_size", several.count())
        .select("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), sha))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          normalize: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; cases as in `mark`.

    Whole rows without a copy are never shuffled. Of the others every task sends one row a
    text, the one with its largest id.
    """
    key = text_key(F.col("_row").getField(text_col), normalize)
    src = pack_row(docs)
    keys = materialize(src.select(key.alias("key")), "keys")
    bloom, blocks = repeat_filter(keys, keys.count())
    probed = probe(src.withColumn("key", key), bloom, blocks)
    best = (probed.where("maybe").groupBy("key")
            .agg(F.max_by("_row", F.struct(F.col("_row").getField(id_col).alias("id"))).alias("_row")).select("_row"))
    return unpack_row(probed.where(~F.col("maybe")).select("_row").unionByName(best), docs.columns)
