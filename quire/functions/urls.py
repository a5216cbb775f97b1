"""URL parts (§2.10): null for a text that is no URL; nothing raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def path(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PATH"))
