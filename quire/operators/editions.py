"""Edition payload parsing.

Input: landed metadata responses ``(municipality, request_key, payload)`` where payload
is the JSON text (or UTF-8 bytes). Output: one row per valid item, plus a reason-coded
rejects frame. Parsing runs per row with VARIANT functions (JVM side, codegen'd); the
type dispatch of the drifting fields uses ``schema_of_variant``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.charset import charset_of, decode_body, lenient
from quire.functions.dates import LENIENT_DATE
from quire.functions.rows import keep_where
from quire.sources.portals import COMPAT_PDF_HOST, PDF_PATH, portals

UNKNOWN_DATE = "unknown"


def _get(v: Column, path: str, typ: str = "variant") -> Column:
    return F.try_variant_get(v, F.lit(path), typ)


def truthy(v: Column, t: Column | None = None) -> Column:
    """Python truthiness of a JSON value (D11): false for missing, null, false, 0, "",
    [] and {}; true otherwise (the string "false" is truthy). ``t`` is the value's
    precomputed ``schema_of_variant``."""
    t = F.schema_of_variant(v) if t is None else t
    return (F.when(v.isNull(), F.lit(False))
             .when(t == "VOID", F.lit(False))
             .when(t == "BOOLEAN", _get(v, "$", "boolean"))
             .when(t == "STRING", F.char_length(_get(v, "$", "string")) > 0)
             .when(t.startswith("ARRAY"), (t != "ARRAY<VOID>") | _get(v, "$[0]").isNotNull())
             .when(t.startswith("OBJECT"), t != "OBJECT<>")
             .otherwise(_get(v, "$", "double") != 0))


def supplement_flag(v: Column, t: Column | None = None) -> Column:
    """null/missing -> false; bool as is; string in {true,1,yes} (any case) -> true;
    integer != 0 -> true; anything else (float, list, object) -> false."""
    t = F.schema_of_variant(v) if t is None else t
    return (F.when(v.isNull() | (t == "VOID"), F.lit(False))
             .when(t == "BOOLEAN", _get(v, "$", "boolean"))
             .when(t == "STRING", F.lower(_get(v, "$", "string")).isin("true", "1", "yes"))
             .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), _get(v, "$", "bigint") != 0)
             .otherwise(F.lit(False)))


def int_field(v: Column, t: Column | None = None) -> Column:
    """P5: missing -> 0; JSON null or not an integer -> NULL (the item is dropped)."""
    t = F.schema_of_variant(v) if t is None else t
    return (F.when(v.isNull(), F.lit(0))
             .when(t == "VOID", F.lit(None).cast("int"))
             .otherwise(_get(v, "$", "int")))


ITEM_FIELDS = {"id": "_id", "suplemento": "_sup", "numero": "_num", "tipo_edicao_id": "_tid",
               "tipo_edicao_nome": "_tname"}
# Items are read as JSON text and parsed one by one, so a bad item (a scalar, a string, null)
# costs nothing but itself; drifting fields are read as VARIANT (type kept); invalid JSON
# lands in the corrupt-record column. Duplicate keys keep the last value.
PAYLOAD_SCHEMA = "struct<erro variant, data variant, itens array<string>, _corrupt string>"
ITEM_SCHEMA = "struct<" + ", ".join(f"{k} variant" for k in ITEM_FIELDS) + ">"
JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def parse_editions(responses: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(items, bad_payloads). ``items`` has one row per item of every usable
    payload with a ``reason`` column (NULL = valid); ``bad_payloads`` has one row per
    payload that yields no items (invalid JSON, not an object, truthy ``erro``, falsy
    ``itens``).

    A binary payload is decoded leniently, by the charset of its ``content_type_header``
    where the frame has one. The JSON is parsed once, each item once more into a struct whose
    drifting fields stay VARIANT; no expression is evaluated twice per row.
    """
    body = F.col(payload)
    is_binary = dict(responses.dtypes)[payload] == "binary"
    keep = [c for c in responses.columns if c not in (payload, "content_type_header")]
    header = F.col("content_type_header") if "content_type_header" in responses.columns else F.lit(None).cast("string")
    with lenient(responses.sparkSession):
        s0 = responses.select(*keep, (decode_body(body, charset_of(header)) if is_binary else body.cast("string")).alias("_payload"))
    s1 = s0.select(*keep, "_payload", F.from_json("_payload", PAYLOAD_SCHEMA, JSON_OPTIONS).alias("_s"))
    s2 = s1.select(*keep, "_payload", F.col("_s._corrupt").alias("_corrupt"), F.col("_s.erro").alias("_erro"),
                   F.schema_of_variant("_s.erro").alias("_erro_t"), F.col("_s.itens").alias("_itens"),
                   F.coalesce(_get(F.col("_s.data"), "$", "string"), F.lit(UNKNOWN_DATE)).alias("_data"))
    root_obj = F.ltrim(F.col("_payload"), F.lit(" \t\r\n\ufeff")).startswith("{")
    preason = (F.when(F.col("_payload").isNull() | ~root_obj, F.lit("not_object"))
                .when(F.col("_corrupt").isNotNull(), F.lit("invalid_json"))
                .when(truthy(F.col("_erro"), F.col("_erro_t")), F.lit("erro"))
                .when(F.coalesce(F.size("_itens"), F.lit(0)) <= 0, F.lit("no_items")))
    s3 = s2.select(*keep, "_payload", "_itens", "_data", preason.alias("_preason"))

    bad_payloads = keep_where(s3, F.col("_preason").isNotNull()).select(
        *keep, F.lit(None).cast("int").alias("item_index"), F.col("_preason").alias("reason"),
        F.col("_payload").alias("payload"))

    # no filter before the explode: Catalyst would push it below the projections and
    # re-evaluate the JSON parse inside the predicate; exploding NULL yields no rows
    usable = F.when(F.col("_preason").isNull(), F.col("_itens"))
    items = s3.select(*keep, "_data", F.posexplode(usable).alias("item_index", "_item"))
    items = items.select(*keep, "_data", "item_index", "_item", F.from_json("_item", ITEM_SCHEMA).alias("item"))
    c = F.col
    is_object = F.coalesce(F.ltrim(c("_item"), F.lit(" \t\r\n")).startswith("{"), F.lit(False))
    i1 = items.select(*keep, "_data", "item_index", "_item", (~is_object).alias("_bad_item"),
                      *[c(f"item.{k}").alias(a) for k, a in ITEM_FIELDS.items()],
                      *[F.schema_of_variant(f"item.{k}").alias(a + "_t") for k, a in ITEM_FIELDS.items()],
                      F.try_to_date("_data", LENIENT_DATE).alias("_date"))
    number = int_field(c("_num"), c("_num_t"))
    type_id = int_field(c("_tid"), c("_tid_t"))
    type_name = (F.when(c("_tname").isNull(), F.lit(""))
                  .when(c("_tname_t") == "VOID", F.lit("None"))
                  .otherwise(_get(c("_tname"), "$", "string")))
    i2 = i1.select(*keep, "item_index", "_item", "_bad_item", "_id", "_id_t", "_data", "_date",
                   _get(c("_id"), "$", "string").alias("edition_id"),
                   number.alias("edition_number"),
                   supplement_flag(c("_sup"), c("_sup_t")).alias("supplement"),
                   type_id.alias("edition_type_id"),
                   type_name.alias("edition_type_name"))
    reason = (F.when(c("_bad_item"), F.lit("item_not_object"))
               .when(c("_id").isNull() | (c("_id_t") == "VOID"), F.lit("missing_id"))
               .when(c("edition_number").isNull(), F.lit("bad_number"))
               .when(c("edition_type_id").isNull(), F.lit("bad_type_id"))
               .when(c("_date").isNull(), F.lit("bad_date")))
    parsed = i2.select(*keep, "item_index", "edition_id", c("_data").alias("publication_date_str"),
                       c("_date").alias("publication_date"), "edition_number", "supplement",
                       "edition_type_id", "edition_type_name", reason.alias("reason"),
                       c("_item").alias("payload"))
    return parsed, bad_payloads


def with_pdf_url(editions: DataFrame, spark, compat: bool = False) -> DataFrame:
    """Per-portal PDF link (D5); ``compat`` reproduces the single fixed host."""
    if compat:
        return editions.withColumn("pdf_url", F.concat(F.lit(COMPAT_PDF_HOST + PDF_PATH),
                                                       F.col("edition_id").cast("string"), F.lit("/")))
    p = portals(spark).select(F.col("name").alias("municipality"), "domain_url")
    return (editions.join(p, "municipality", "left")
                    .withColumn("pdf_url", F.concat(F.col("domain_url"), F.lit(PDF_PATH),
                                                    F.col("edition_id").cast("string"), F.lit("/")))
                    .drop("domain_url"))


def split_valid(parsed: DataFrame, bad_payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(editions, rejects). Item-level faults are isolated: siblings of a bad item stay."""
    good = keep_where(parsed, F.col("reason").isNull()).drop("reason", "payload")
    rejects = keep_where(parsed, F.col("reason").isNotNull()).select(*bad_payloads.columns).unionByName(bad_payloads)
    return good, rejects
