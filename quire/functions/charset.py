"""Decoding response bodies by the charset of their header, without ever failing.

Invalid sequences become U+FFFD, as an HTTP client's ``.text`` gives them. Everything runs
in the JVM: malformed UTF-8 is repaired by ``make_valid_utf8``; UTF-16 is decoded with
Spark's lenient coding action; windows-1252 is ISO-8859-1 with its own characters for the
bytes 0x80-0x9F.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SUPPORTED_CHARSETS = ["us-ascii", "iso-8859-1", "windows-1252", "utf-8", "utf-16be", "utf-16le", "utf-16"]
ALIASES = {"latin-1": "iso-8859-1", "latin1": "iso-8859-1", "cp1252": "windows-1252", "ascii": "us-ascii", "utf8": "utf-8"}
_LENIENT = "spark.sql.legacy.codingErrorAction"
# the bytes 0x80-0x9F that windows-1252 assigns; the five others stay control characters
_CP1252 = [(chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]


@contextmanager
def lenient(spark: SparkSession):
    """Within the block, ``decode`` is analysed to replace malformed input, not to raise."""
    old = spark.conf.get(_LENIENT, "false")
    spark.conf.set(_LENIENT, "true")
    try:
        yield
    finally:
        spark.conf.set(_LENIENT, old)


def charset_of(header: Column) -> Column:
    """The charset named in a content-type header; UTF-8 if none or an unknown one."""
    # one look-up: a chain of conditions would repeat the pattern match in each of its branches
    name = F.lower(F.regexp_extract(F.coalesce(header, F.lit("")), r"(?i)charset=\s*\"?([A-Za-z0-9_\-]+)", 1))
    known = {c: c for c in SUPPORTED_CHARSETS} | ALIASES
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), F.lit("utf-8"))


def decode_body(body: Column, charset: Column) -> Column:
    """Text of a binary body. Analyse the result inside `lenient`."""
    latin = F.decode(body, "ISO-8859-1")
    return (F.when(charset == "iso-8859-1", latin)
             .when(charset == "windows-1252", F.translate(latin, "".join(a for a, _ in _CP1252), "".join(b for _, b in _CP1252)))
             .when(charset == "utf-16be", F.decode(body, "UTF-16BE"))
             .when(charset == "utf-16le", F.decode(body, "UTF-16LE"))
             .when(charset == "utf-16", F.decode(body, "UTF-16"))
             .otherwise(F.make_valid_utf8(body.cast("string"))))
