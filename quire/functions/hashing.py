"""Hash helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTENT_DIR = "content"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def edition_hash(edition_id, publication_date_str, n_articles) -> Column:
    """md5 of '{edition_id}_{publication_date}_{n_articles}'."""
    return F.md5(F.concat_ws("_", _c(edition_id).cast("string"), _c(publication_date_str).cast("string"),
                             _c(n_articles).cast("string")))


def content_hash(body) -> Column:
    """sha256 hex of the body bytes (a string is hashed as its UTF-8 bytes)."""
    return F.sha2(_c(body), 256)


def content_path(h) -> Column:
    """Two-level fan-out path: content/<h0h1>/<h2h3>/<hash>.bin."""
    h = _c(h)
    return F.concat(F.lit(CONTENT_DIR + "/"), F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 2),
                    F.lit("/"), h, F.lit(".bin"))
