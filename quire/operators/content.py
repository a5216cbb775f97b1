"""Content ingestion.

Bodies are the volume driver. Everything per response is a row-local expression
(MIME dispatch, charset decode, hash); the only shuffle that carries bodies is the one
that deduplicates new blobs by hash, and it happens after hashes have been filtered
against the existing store on a narrow (hash-only) projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.charset import charset_of, decode_body, lenient
from quire.functions.hashing import content_hash, content_path
from quire.functions.rows import keep_where

# Fixed value: texts longer than this many characters are stored out of line.
INLINE_THRESHOLD = 2000


def content_type_of(header: Column) -> Column:
    """P11 dispatch, first match wins on the lower-cased header."""
    h = F.lower(F.coalesce(header, F.lit("")))
    return (F.when(h.contains("application/pdf"), F.lit("pdf"))
             .when(h.contains("application/json"), F.lit("html"))
             .when(h.contains("text/html"), F.lit("html"))
             .otherwise(F.lit("text")))


def dispatch(responses: DataFrame, header: str = "content_type_header", body: str = "body") -> DataFrame:
    """P11 + P12: (content_type, text, bytes_, reason).

    pdf  -> raw bytes; text is their UTF-8 decoding when valid, else NULL (binary only)
    json -> the ``conteudo`` field as HTML ('' when absent or null); invalid JSON or a
            non-object root is rejected
    html / text -> body decoded by the header's charset

    Staged projections: each row decodes its body at most once, and only JSON bodies
    are parsed.
    """
    h, b = F.lower(F.coalesce(F.col(header), F.lit(""))), F.col(body)
    keep = [c for c in responses.columns if c != body]
    s1 = responses.select(*keep, b.alias("_b"), content_type_of(F.col(header)).alias("content_type"),
                          h.contains("application/pdf").alias("_pdf"),
                          charset_of(F.col(header)).alias("_cs"))
    with lenient(responses.sparkSession):
        s2 = s1.select(*keep, "_b", "content_type", "_pdf",
                       ((~F.col("_pdf")) & (F.col("content_type") == "html")
                        & F.lower(F.coalesce(F.col(header), F.lit(""))).contains("application/json")).alias("_json"),
                       F.when(~F.col("_pdf"), decode_body(F.col("_b"), F.col("_cs"))).alias("_dec"))
    s3 = s2.select(*keep, "_b", "content_type", "_pdf", "_json", "_dec",
                   F.when(F.col("_json"), F.try_parse_json("_dec")).alias("_v"))
    json_ok = F.col("_v").isNotNull() & F.schema_of_variant("_v").startswith("OBJECT")
    conteudo = F.coalesce(F.try_variant_get(F.col("_v"), "$.conteudo", "string"), F.lit(""))
    pdf_text = F.when(F.is_valid_utf8(F.col("_b").cast("string")), F.col("_b").cast("string"))
    text = F.when(F.col("_pdf"), pdf_text).when(F.col("_json"), conteudo).otherwise(F.col("_dec"))
    out = s3.select(*keep, "content_type", text.alias("text"),
                    F.when(F.col("_pdf"), F.col("_b")).alias("_raw"),
                    F.when(F.col("_json") & ~json_ok, F.lit("invalid_json")).alias("reason"))
    # Bytes to store = raw pdf bytes, else the UTF-8 encoding of the text
    return out.withColumn("bytes_", F.when(F.col("_raw").isNotNull(), F.col("_raw"))
                                     .otherwise(F.encode(F.col("text"), "UTF-8"))).drop("_raw")


def split_inline(dispatched: DataFrame, threshold: int = INLINE_THRESHOLD) -> DataFrame:
    """P13 + P14: inline when the text has <= threshold characters; out of line (hash +
    path) when longer or when there is no text (binary)."""
    t, by = F.col("text"), F.col("bytes_")
    blob = t.isNull() | (F.char_length(t) > threshold)
    h = F.when(blob, content_hash(by))
    # one withColumns call: a single analysis instead of one per added column
    return dispatched.withColumns({
        "is_blob": blob,
        "content_size": F.octet_length(by).cast("bigint"),
        "char_length": F.char_length(t).cast("bigint"),
        "content_hash": h,
        "content_path": F.when(blob, content_path(h)),
        "inline_text": F.when(~blob, t),
    })


def new_blobs(split: DataFrame, existing: DataFrame | None = None, key=("municipality", "request_key")) -> DataFrame:
    """K4 + J11: one row per blob hash not yet in ``existing`` (a content table; only its
    hash column is read).

    Copies are collapsed on (hash, one row's key) alone: a partial hash aggregate over two
    narrow columns, anti-joined to the stored hashes. Only the row chosen for a new hash then
    brings its body, by a join on that key (its columns as far as ``split`` has them: a request
    key is unique within its portal); of rows that share key and hash one is taken."""
    blobs = keep_where(split, F.col("is_blob")).select(
        F.xxhash64(*[F.col(k).cast("string") for k in key if k in split.columns], F.col("content_hash")).alias("_row"), "content_hash", "content_size", F.col("bytes_").alias("content"))
    chosen = blobs.groupBy("content_hash").agg(F.min("_row").alias("_row"))
    if existing is not None:
        chosen = chosen.join(existing.select("content_hash"), "content_hash", "left_anti")
    once = Window.partitionBy("content_hash").orderBy("_row")
    return (blobs.join(chosen, ["content_hash", "_row"], "left_semi")
            .withColumn("_n", F.row_number().over(once)).where("_n = 1")
            .select("content_hash", "content", content_path(F.col("content_hash")).alias("content_path"), "content_size")
            .withColumn("created_at", F.current_timestamp()))


def blob_refs(split: DataFrame) -> DataFrame:
    """K7 metadata without bodies: (hash, path, size, number of references). The path
    follows from the hash, so the aggregate's buffers are numbers only."""
    refs = (keep_where(split, F.col("is_blob")).groupBy("content_hash")
            .agg(F.max("content_size").alias("content_size"), F.count(F.lit(1)).alias("n_refs")))
    return refs.select("content_hash", content_path(F.col("content_hash")).alias("content_path"), "content_size", "n_refs")
