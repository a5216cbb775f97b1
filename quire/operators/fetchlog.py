"""Fetch-log triage (F2, F3, F4, A29): the retry rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the retry policy.
MAX_ATTEMPTS = 3
WAIT_MIN_S = 1
WAIT_MAX_S = 10
RETRYABLE_4XX = (408, 429)
TRANSPORT_ERROR = 0   # status used for timeouts / connection errors (no HTTP status)


def is_success(status: Column) -> Column:
    """a usable response."""
    return status.between(200, 299)


def triage(status: Column) -> Column:
    """ok / retry / give_up. 5xx, 408, 429 and transport errors are retried; other
    4xx are not; anything else unexpected is not retried."""
    return (F.when(is_success(status), F.lit("ok"))
             .when(status == TRANSPORT_ERROR, F.lit("retry"))
             .when(status.between(500, 599), F.lit("retry"))
             .when(status.isin(*RETRYABLE_4XX), F.lit("retry"))
             .otherwise(F.lit("give_up")))


def backoff_seconds(attempt: Column) -> Column:
    """exponential wait before the next attempt, clamped to [1, 10] s."""
    return F.least(F.greatest(F.pow(F.lit(2.0), attempt - 1), F.lit(float(WAIT_MIN_S))),
                   F.lit(float(WAIT_MAX_S)))


def retry_schedule(log: DataFrame, status: str = "status") -> DataFrame:
    """F3 + F4: for each retryable failure, one row per attempt 1..MAX_ATTEMPTS with
    the wait before the next attempt (no wait after the last) and whether one follows."""
    r = log.withColumn("action", triage(F.col(status)))
    retry = r.where(F.col("action") == "retry").withColumn(
        "attempt", F.explode(F.sequence(F.lit(1), F.lit(MAX_ATTEMPTS))))
    return (retry.withColumn("next_attempt", F.col("attempt") < MAX_ATTEMPTS)
                 .withColumn("wait_s", F.when(F.col("next_attempt"), backoff_seconds(F.col("attempt")))
                                        .otherwise(F.lit(0.0))))


def success_ratio(log: DataFrame, by: list, status: str = "status") -> DataFrame:
    """Successful / all per group."""
    ok = is_success(F.col(status))
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok")) \
              .withColumn("ratio", F.col("n_ok") / F.col("n"))
