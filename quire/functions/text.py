"""String, unit and rounding helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATH_SEPARATOR = "|"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_up(x, digits: int) -> Column:
    """Round half up on the binary value: floor(x * 10^d + 0.5) / 10^d.

    Used instead of ``round`` so results are bit-identical with SQL engines that
    round through a scaled double (no decimal-string detour)."""
    scale = float(10 ** digits)
    return F.floor(_c(x) * scale + 0.5) / scale


def kib(x) -> Column:
    return _c(x) / 1024.0


def mib(x) -> Column:
    return _c(x) / 1024.0 / 1024.0


def gib(x) -> Column:
    return _c(x) / 1024.0 / 1024.0 / 1024.0


def ellipsize(x, limit: int, keep: int) -> Column:
    """Labels of ``limit`` characters or more become their first ``keep`` + '...'."""
    x = _c(x)
    return F.when(F.char_length(x) >= limit, F.concat(F.substring(x, 1, keep), F.lit("..."))).otherwise(x)


def clip(x, n: int) -> Column:
    """Plain prefix of at most n characters (label slicing for display)."""
    return F.substring(_c(x), 1, n)


def path_label(path) -> Column:
    """Array path -> 'a|b|c' label (empty path -> '')."""
    return F.concat_ws(PATH_SEPARATOR, _c(path))


def split_label(label) -> Column:
    """'a|b|c' -> array; '' -> empty array (not ['']), as a native array should."""
    label = _c(label)
    return F.when(label == "", F.array().cast("array<string>")).otherwise(
        F.split(label, r"\|"))


def path_to_json(path) -> Column:
    return F.to_json(_c(path))


def path_from_json(s) -> Column:
    return F.from_json(_c(s), "array<string>")


def blank_if_null(x) -> Column:
    """Null-safe string default (P20)."""
    return F.coalesce(_c(x).cast("string"), F.lit(""))
