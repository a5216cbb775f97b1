"""Scalar helpers: F6 rolling window, P19 path JSON, P21 labels, P25 rounding."""

import datetime as dt

from pyspark.sql import functions as F

from quire.functions.dates import lenient_date, rolling_window
from quire.functions.text import path_from_json, path_label, path_to_json, round_half_up, split_label


def test_rolling_window_rules():
    today = dt.date(2024, 1, 10)
    assert rolling_window(7, today=today) == (dt.date(2024, 1, 4), today)
    assert rolling_window(0, today=today) == (today, today)
    assert rolling_window(7, end=dt.date(2024, 2, 1), today=today) == (dt.date(2024, 1, 26), dt.date(2024, 2, 1))
    assert rolling_window(7, start=dt.date(2023, 12, 1), today=today) == (dt.date(2023, 12, 1), today)


def test_path_label_json_and_dates(spark):
    df = spark.createDataFrame([(["A", "B"], "2024-1-3"), ([], "2024-13-01")], "p array<string>, s string")
    r = df.select(path_label("p").alias("l"), split_label(path_label("p")).alias("back"),
                  path_from_json(path_to_json("p")).alias("rt"), lenient_date("s").alias("d")).collect()
    assert (r[0].l, r[0].back, r[0].rt, r[0].d) == ("A|B", ["A", "B"], ["A", "B"], dt.date(2024, 1, 3))
    assert (r[1].l, r[1].back, r[1].rt, r[1].d) == ("", [], [], None)


def test_round_half_up(spark):
    vals = spark.createDataFrame([(2.5,), (0.125,), (1.0049,)], "x double")
    got = [r.y for r in vals.select(round_half_up(F.col("x"), 0).alias("y")).collect()]
    assert got == [3.0, 0.0, 1.0]
    got2 = [r.y for r in vals.select(round_half_up(F.col("x"), 2).alias("y")).collect()]
    assert got2 == [2.5, 0.13, 1.0]
