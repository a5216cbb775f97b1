"""quire: a Spark-native engine for building and analysing an official-gazette corpus.

Layout
------
sources/    scans: driver-table role views, source portals, landed responses, parquet files
functions/  column-expression helpers (coercion, dates, hashing, text) and the nav-tree UDTF
operators/  corpus transforms: frontier, edition/structure/content parsing, dedupe, assembly,
            hierarchy, fetch-log triage
plans/      report queries (lazy DataFrames), the article query builder, query registry
sinks/      lake writers (editions / articles / relationships / content), stats, migration
streaming/  incremental ingest with Structured Streaming + foreachBatch
"""

__all__ = ["session"]
