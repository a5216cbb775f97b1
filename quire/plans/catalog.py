"""Registry of named queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import corpus_reports as CR
from quire.plans import hierarchy_reports as HR
from quire.plans import ingest as IN
from quire.plans import lake_checks as LC

QueryFn = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, QueryFn]:
    q: dict[str, QueryFn] = {
        # edition reports
        "corpus_overview": CR.corpus_overview,
        "by_type": CR.by_type,
        "by_year": CR.by_year,
        "by_quarter": CR.by_quarter,
        "by_month": CR.by_month,
        "by_weekday_zero_filled": CR.by_weekday_zero_filled,
        "monthly_series": CR.monthly_series,
        "daily_series": CR.daily_series,
        # article reports
        "articles_overview": CR.articles_overview,
        "by_content_type": CR.by_content_type,
        "type_share": CR.type_share,
        "depth_distribution": CR.depth_distribution,
        "size_histogram": CR.size_histogram,
        "size_histogram_bytes": CR.size_histogram_bytes,
        "top_largest": CR.top_largest,
        # articles x editions
        "articles_per_year": CR.articles_per_year,
        "articles_per_month": CR.articles_per_month,
        "articles_by_type": CR.articles_by_type,
        "supplement_stats": CR.supplement_stats,
        "articles_suffixed_join": CR.articles_suffixed_join,
        "executive_summary": CR.executive_summary,
        "correlation_matrix": CR.correlation_matrix,
        "column_profile": CR.column_profile,
        # hierarchy
        "path_frequency": HR.path_frequency,
        "path_count": HR.path_count,
        "hierarchy_levels": HR.hierarchy_levels,
        "wide_levels": HR.wide_levels,
        "top_per_level": HR.top_per_level,
        "level_pareto": HR.level_pareto,
        "level_pairs": HR.level_pairs,
        "level_pivot": HR.level_pivot,
        "level_pivot_transposed": HR.level_pivot_transposed,
        "level_pivot_share": HR.level_pivot_share,
        # frontier / scans
        "calendar_weekdays": IN.calendar_weekdays,
        "frontier_urls": IN.frontier_urls,
        "rolling_window": IN.rolling_window,
        "scan_projection": IN.scan_projection,
        "union_sources": IN.union_sources,
        "editions_in_range": IN.editions_in_range,
        # fetch log / responses
        "request_response_join": IN.request_response_join,
        "retry_triage": IN.retry_triage,
        "fetch_success_ratio": IN.fetch_success_ratio,
        # parsing
        "json_field_counts": IN.json_field_counts,
        "edition_payloads": IN.edition_payloads,
        "pdf_urls": IN.pdf_urls,
        "nav_links": IN.nav_links,
        "nav_tree_paths": IN.nav_tree_paths,
        # assembly
        "dedupe_keep_deepest": IN.dedupe_keep_deepest,
        "dedupe_stats": IN.dedupe_stats,
        "edition_article_counts": IN.edition_article_counts,
        "orphan_articles": IN.orphan_articles,
        "rejects_summary": IN.rejects_summary,
        "empty_editions": IN.empty_editions,
        # lake tables
        "editions_table": IN.editions_table,
        "articles_table": IN.articles_table,
        "relationships_table": IN.relationships_table,
        "edition_hash": IN.edition_hash,
        "content_split": IN.content_split,
        "content_charsets": IN.content_charsets,
        "content_blobs": IN.content_blobs,
        "content_lookup": IN.content_lookup,
        "summary_metrics": IN.summary_metrics,
        # lake written and read back
        "lake_round_trip": LC.lake_round_trip,
        "blob_append": LC.blob_append,
        "content_bodies": LC.content_bodies,
        "edition_article_chunks": LC.edition_article_chunks,
        "frontier_hosts": LC.frontier_hosts,
        # article query
        "query_articles_filter": IN.query_articles_filter,
        "query_articles_limit": IN.query_articles_limit,
    }
    return q


def oracle_sql() -> dict[str, str]:
    from quire.plans.oracle import SQL
    return {k: v for k, v in SQL.items() if k in queries()}
