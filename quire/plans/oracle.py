"""Equivalent ANSI SQL (DuckDB dialect) for every registered query.

The views ``editions``/``articles``/... below restate ``quire.sources.driver`` in SQL
so each oracle query is independent of the Spark code it checks. Types are cast to
the Spark result types (INTEGER/BIGINT/DOUBLE) so schemas line up.
"""

from __future__ import annotations

# --------------------------------------------------------------------------- role CTEs

EDITIONS = """editions AS (
  SELECT o_orderkey AS edition_id, CAST(o_orderdate AS DATE) AS publication_date,
         CAST(o_custkey AS INTEGER) AS edition_number, o_orderstatus = 'F' AS supplement,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS edition_type_id,
         o_orderpriority AS edition_type_name, o_custkey AS customer_key
  FROM orders)"""

PORTALS = """portals AS (
  SELECT * FROM (VALUES
    (0, 'sp_sao_jose_dos_campos', DATE '2022-08-15', 'https://diariodomunicipio.sjc.sp.gov.br'),
    (1, 'rj_rio_de_janeiro', DATE '2012-05-29', 'https://doweb.rio.rj.gov.br'),
    (2, 'es_associacao_municipios', DATE '2021-01-02', 'https://ioes.dio.es.gov.br'),
    (3, 'ro_jaru', DATE '2022-01-01', 'https://doe.jaru.ro.gov.br'),
    (4, 'ms_corumba', DATE '2012-06-26', 'https://do.corumba.ms.gov.br'))
    AS t(portal_key, name, default_start_date, domain_url))"""

EDITION_MUNI = """edition_muni AS (
  SELECT o_orderkey AS edition_id, p.name AS municipality, p.domain_url
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
       JOIN portals p ON n_regionkey = p.portal_key)"""

ARTICLES_FLAT = """articles_flat AS (
  SELECT l_orderkey * 10 + l_linenumber AS article_id, l_orderkey AS edition_id,
         l_partkey AS identifier, CAST(l_suppkey AS VARCHAR) AS protocol,
         CASE l_returnflag WHEN 'A' THEN 'pdf' WHEN 'N' THEN 'html' WHEN 'R' THEN 'text' END AS content_type,
         CAST(floor(l_extendedprice) AS BIGINT) AS content_size,
         CAST(least(l_linenumber - 1, 3) AS INTEGER) AS depth
  FROM lineitem)"""

ARTICLES = ARTICLES_FLAT + """,
articles AS (
  SELECT a.*, p_name AS title,
         list_slice([p_type, p_brand, p_name], 1, a.depth) AS hierarchy_path
  FROM articles_flat a JOIN part ON a.identifier = p_partkey)"""

COUNTS = """counts AS (SELECT edition_id, count(*) AS n FROM articles_flat GROUP BY edition_id),
editions_c AS (
  SELECT e.*, CAST(coalesce(c.n, 0) AS BIGINT) AS num_articles
  FROM editions e LEFT JOIN counts c USING (edition_id))"""

AE = """ae AS (SELECT a.*, e.publication_date, e.edition_type_name, e.supplement
          FROM articles_flat a LEFT JOIN editions e USING (edition_id))"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def rhu(x: str, digits: int) -> str:
    """Twin of quire.functions.text.round_half_up."""
    s = float(10 ** digits)
    return f"(floor(({x}) * {s} + 0.5) / {s})"


def kib(x: str) -> str:
    return f"(({x}) / 1024.0)"


def gib(x: str) -> str:
    return f"(({x}) / 1024.0 / 1024.0 / 1024.0)"


PATH_LABEL = "array_to_string(hierarchy_path, '|')"

SQL: dict[str, str] = {}

# --------------------------------------------------------------------------- edition reports

SQL["corpus_overview"] = _with(EDITIONS, ARTICLES_FLAT, COUNTS) + f"""
SELECT count(*) AS n_editions, min(publication_date) AS first_date, max(publication_date) AS last_date,
       CAST(sum(CAST(supplement AS BIGINT)) AS BIGINT) AS n_supplements,
       {rhu('avg(CAST(supplement AS DOUBLE)) * 100.0', 1)} AS pct_supplement,
       CAST(sum(num_articles) AS BIGINT) AS n_articles,
       {rhu('avg(num_articles)', 1)} AS mean_articles_per_edition
FROM editions_c"""

SQL["by_type"] = _with(EDITIONS, ARTICLES_FLAT, COUNTS) + """
SELECT edition_type_name, count(*) AS count, avg(num_articles) AS avg_articles,
       CAST(sum(num_articles) AS BIGINT) AS total_articles
FROM editions_c GROUP BY edition_type_name ORDER BY count DESC, edition_type_name"""

SQL["by_year"] = _with(EDITIONS) + """
SELECT CAST(year(publication_date) AS INTEGER) AS year, count(*) AS count
FROM editions GROUP BY 1 ORDER BY 1"""

SQL["by_quarter"] = _with(EDITIONS) + """
SELECT CAST(year(publication_date) AS INTEGER) AS year, CAST(quarter(publication_date) AS INTEGER) AS quarter, count(*) AS count
FROM editions GROUP BY 1, 2"""

SQL["by_month"] = _with(EDITIONS) + """
SELECT CAST(month(publication_date) AS INTEGER) AS month, count(*) AS count
FROM editions GROUP BY 1 ORDER BY 1"""

SQL["by_weekday_zero_filled"] = _with(EDITIONS) + """
, days AS (SELECT * FROM (VALUES (1,'Seg'),(2,'Ter'),(3,'Qua'),(4,'Qui'),(5,'Sex'),(6,'Sáb'),(7,'Dom')) t(weekday, label)),
c AS (SELECT CAST(isodow(publication_date) AS INTEGER) AS weekday, count(*) AS n FROM editions GROUP BY 1)
SELECT CAST(d.weekday AS INTEGER) AS weekday, d.label, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM days d LEFT JOIN c USING (weekday) ORDER BY 1"""

SQL["monthly_series"] = _with(EDITIONS) + """
SELECT CAST(year(publication_date) AS INTEGER) AS year, CAST(month(publication_date) AS INTEGER) AS month,
       count(*) AS count,
       CAST(year(publication_date) AS VARCHAR) || '-' || lpad(CAST(month(publication_date) AS VARCHAR), 2, '0') AS year_month
FROM editions GROUP BY 1, 2, 4 ORDER BY 1, 2"""

SQL["daily_series"] = _with(EDITIONS, ARTICLES_FLAT, AE) + """
SELECT publication_date AS date, count(*) AS count FROM ae
WHERE publication_date IS NOT NULL GROUP BY 1 ORDER BY 1"""

# --------------------------------------------------------------------------- article reports

SQL["articles_overview"] = _with(ARTICLES_FLAT) + f"""
SELECT count(*) AS n_articles, {rhu('avg(depth)', 2)} AS mean_depth, max(depth) AS max_depth,
       {rhu(kib('avg(content_size)'), 1)} AS mean_kb, {rhu(gib('sum(content_size)'), 2)} AS total_gb,
       CAST(sum(content_size) AS BIGINT) AS total_bytes
FROM articles_flat"""

SQL["by_content_type"] = _with(ARTICLES_FLAT) + f"""
SELECT content_type, count(*) AS count, {rhu(kib('avg(content_size)'), 2)} AS avg_size_kb,
       {rhu(gib('sum(content_size)'), 3)} AS total_size_gb
FROM articles_flat GROUP BY content_type ORDER BY count DESC, content_type"""

SQL["type_share"] = _with(ARTICLES_FLAT) + """
SELECT content_type, count(*) AS count, count(*) / (SELECT count(*) FROM articles_flat) AS share
FROM articles_flat GROUP BY content_type ORDER BY count DESC, content_type"""

SQL["depth_distribution"] = _with(ARTICLES_FLAT) + """
SELECT depth, count(*) AS count FROM articles_flat GROUP BY depth ORDER BY depth"""

SQL["size_histogram"] = _with(ARTICLES_FLAT) + """
, v AS (SELECT content_size / 1024.0 AS x FROM articles_flat),
mm AS (SELECT min(x) AS mn, max(x) AS mx FROM v),
b AS (SELECT CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((x - mn) * 50 / (mx - mn)), 49) END AS INTEGER) AS bin
      FROM v, mm)
SELECT bin, mn + bin * ((mx - mn) / 50.0) AS lo, mn + (bin + 1) * ((mx - mn) / 50.0) AS hi, count(*) AS count
FROM b, mm GROUP BY bin, mn, mx ORDER BY bin"""

SQL["size_histogram_bytes"] = _with(ARTICLES_FLAT) + """
, v AS (SELECT CAST(content_size AS DOUBLE) AS x FROM articles_flat),
mm AS (SELECT min(x) AS mn, max(x) AS mx FROM v),
b AS (SELECT CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((x - mn) * 40 / (mx - mn)), 39) END AS INTEGER) AS bin
      FROM v, mm)
SELECT bin, mn + bin * ((mx - mn) / 40.0) AS lo, mn + (bin + 1) * ((mx - mn) / 40.0) AS hi, count(*) AS count
FROM b, mm GROUP BY bin, mn, mx ORDER BY bin"""

SQL["top_largest"] = _with(ARTICLES) + f"""
SELECT article_id, content_size,
       CASE WHEN length(title) >= 40 THEN substr(title, 1, 37) || '...' ELSE title END AS title,
       {rhu('content_size / 1024.0 / 1024.0', 4)} AS size_mb
FROM articles ORDER BY content_size DESC, article_id, identifier, protocol LIMIT 10"""

# --------------------------------------------------------------------------- combined

SQL["articles_per_year"] = _with(EDITIONS, ARTICLES_FLAT, AE) + f"""
SELECT CAST(year(publication_date) AS INTEGER) AS year, count(*) AS num_articles,
       CAST(sum(content_size) AS BIGINT) AS total_size,
       {rhu(gib('sum(content_size)'), 6)} AS total_size_gb
FROM ae GROUP BY 1 ORDER BY 1"""

SQL["articles_per_month"] = _with(EDITIONS, ARTICLES_FLAT, AE) + """
SELECT CAST(month(publication_date) AS INTEGER) AS month, count(*) AS count FROM ae GROUP BY 1 ORDER BY 1"""

SQL["articles_by_type"] = _with(EDITIONS, ARTICLES_FLAT, AE) + """
SELECT edition_type_name, count(*) AS count FROM ae GROUP BY 1 ORDER BY count DESC, edition_type_name"""

SQL["supplement_stats"] = _with(EDITIONS, ARTICLES_FLAT, AE) + f"""
SELECT supplement, count(*) AS num_articles, {rhu(kib('avg(content_size)'), 3)} AS avg_size_kb
FROM ae GROUP BY 1 ORDER BY 1"""

SQL["articles_suffixed_join"] = _with(EDITIONS) + """
SELECT l_orderkey AS edition_id, l_orderkey * 10 + l_linenumber AS article_id,
       CAST(l_shipdate AS DATE) AS publication_date_article,
       e.publication_date AS publication_date_edition, e.edition_type_name
FROM lineitem LEFT JOIN editions e ON l_orderkey = e.edition_id"""

SQL["executive_summary"] = _with(EDITIONS, ARTICLES) + f"""
, wd AS (SELECT isodow(publication_date) AS wd, count(*) AS n FROM editions GROUP BY 1),
ct AS (SELECT content_type, count(*) AS n FROM articles GROUP BY 1),
paths AS (SELECT {PATH_LABEL} AS p, count(*) AS n FROM articles GROUP BY 1),
top3 AS (SELECT list(p ORDER BY n DESC, p) AS top FROM (SELECT * FROM paths ORDER BY n DESC, p LIMIT 3)),
s AS (SELECT (SELECT count(*) FROM editions) AS ne,
             (SELECT count(DISTINCT year(publication_date)) FROM editions) AS ny,
             (SELECT count(*) FROM articles) AS na)
SELECT ne AS n_editions, na AS n_articles, {rhu('ne / ny', 0)} AS editions_per_year,
       {rhu('na / ne', 1)} AS articles_per_edition,
       (['Seg','Ter','Qua','Qui','Sex','Sáb','Dom'])[(SELECT wd FROM wd ORDER BY n DESC, wd LIMIT 1)] AS modal_weekday,
       (SELECT content_type FROM ct ORDER BY n DESC, content_type DESC LIMIT 1) AS dominant_content_type,
       {rhu('(SELECT avg(depth) FROM articles)', 2)} AS mean_depth,
       (SELECT count(*) FROM paths) AS n_distinct_paths,
       (SELECT top FROM top3) AS top_paths
FROM s"""

_CORR_COLS = ["depth", "content_size", "year", "month", "day"]


def _corr_sql() -> str:
    parts = []
    for x in _CORR_COLS:
        for y in _CORR_COLS:
            if x == y:
                v = f"CASE WHEN stddev_pop({x}) > 0 THEN 1.0 END"
            else:
                v = f"CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN corr({x}, {y}) END"
            parts.append(f"SELECT '{x}' AS col_a, '{y}' AS col_b, {rhu(v, 6)} AS corr FROM v")
    return (_with(EDITIONS, ARTICLES_FLAT, AE)
            + ", v AS (SELECT depth, content_size, year(publication_date) AS year, month(publication_date) AS month,"
              " day(publication_date) AS day FROM ae)\n" + "\nUNION ALL\n".join(parts))


SQL["correlation_matrix"] = _corr_sql()

SQL["column_profile"] = _with(ARTICLES) + """
SELECT * FROM (VALUES
  ('article_id', 'bigint', (SELECT count(article_id) FROM articles)),
  ('edition_id', 'bigint', (SELECT count(edition_id) FROM articles)),
  ('identifier', 'bigint', (SELECT count(identifier) FROM articles)),
  ('protocol', 'string', (SELECT count(protocol) FROM articles)),
  ('content_type', 'string', (SELECT count(content_type) FROM articles)),
  ('content_size', 'bigint', (SELECT count(content_size) FROM articles)),
  ('depth', 'int', (SELECT count(depth) FROM articles)),
  ('title', 'string', (SELECT count(title) FROM articles)),
  ('hierarchy_path', 'array<string>', (SELECT count(hierarchy_path) FROM articles))
) t("column", dtype, non_null)"""

# --------------------------------------------------------------------------- hierarchy

LEVELS = """lv AS (
  SELECT article_id, CAST(generate_subscripts(hierarchy_path, 1) - 1 AS INTEGER) AS level,
         unnest(hierarchy_path) AS element
  FROM articles),
lfreq AS (SELECT level, element, count(*) AS count FROM lv GROUP BY level, element)"""

TOP_L1 = """top_l1 AS (SELECT element, count FROM lfreq WHERE level = 1 ORDER BY count DESC, element LIMIT 10),
pairs AS (SELECT hierarchy_path[1] AS level_0, hierarchy_path[2] AS level_1 FROM articles
          WHERE len(hierarchy_path) >= 2),
pc AS (SELECT level_0, level_1, count(*) AS count FROM pairs
       WHERE level_1 IN (SELECT element FROM top_l1) GROUP BY level_0, level_1)"""

SQL["path_frequency"] = _with(ARTICLES) + f"""
, freq AS (SELECT {PATH_LABEL} AS path, count(*) AS count FROM articles GROUP BY 1),
top AS (SELECT * FROM freq ORDER BY count DESC, path LIMIT 20)
SELECT CAST(row_number() OVER (ORDER BY count DESC, path) AS INTEGER) AS rank, path,
       CASE WHEN length(path) >= 80 THEN substr(path, 1, 77) || '...' ELSE path END AS display_path,
       count, CAST(count AS DOUBLE) * 100.0 / (SELECT count(*) FROM articles) AS pct
FROM top"""

SQL["path_count"] = _with(ARTICLES) + f"""
SELECT count(*) AS n_distinct_paths, CAST(sum(c) AS BIGINT) AS n_articles
FROM (SELECT {PATH_LABEL} AS p, count(*) AS c FROM articles GROUP BY 1)"""

SQL["hierarchy_levels"] = _with(ARTICLES, LEVELS) + """
SELECT level, element, count,
       CAST(count AS DOUBLE) * 100.0 / sum(count) OVER (PARTITION BY level) AS pct
FROM lfreq"""

SQL["wide_levels"] = _with(ARTICLES) + """
SELECT article_id, hierarchy_path[1] AS level_1, hierarchy_path[2] AS level_2, hierarchy_path[3] AS level_3
FROM articles WHERE hierarchy_path IS NOT NULL"""

SQL["top_per_level"] = _with(ARTICLES, LEVELS) + """
, s AS (SELECT level, element, count,
               CAST(count AS DOUBLE) * 100.0 / sum(count) OVER (PARTITION BY level) AS pct,
               CAST(row_number() OVER (PARTITION BY level ORDER BY count DESC, element) AS INTEGER) AS rank
        FROM lfreq WHERE level < 5)
SELECT level, rank, substr(element, 1, 60) AS element, count, pct FROM s WHERE rank <= 10"""

SQL["level_pareto"] = _with(ARTICLES, LEVELS) + """
, t AS (SELECT level, sum(count) AS total FROM lfreq GROUP BY level),
top AS (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY f.level ORDER BY f.count DESC, f.element) AS rn
                       FROM lfreq f WHERE f.level <= 1) WHERE rn <= 12)
SELECT top.level, CAST(rn AS INTEGER) AS rank, element, count,
       CAST(count AS DOUBLE) * 100.0 / t.total AS pct,
       CAST(sum(count) OVER (PARTITION BY top.level ORDER BY count DESC, element
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) * 100.0 / t.total AS cum_pct
FROM top JOIN t USING (level)"""

SQL["level_pairs"] = _with(ARTICLES, LEVELS, TOP_L1) + """
SELECT level_0, level_1, count FROM pc"""

FILLED = """
, filled AS (SELECT r.level_0, c.level_1, CAST(coalesce(pc.count, 0) AS BIGINT) AS count
             FROM (SELECT DISTINCT level_0 FROM pc) r CROSS JOIN (SELECT DISTINCT level_1 FROM pc) c
             LEFT JOIN pc ON pc.level_0 = r.level_0 AND pc.level_1 = c.level_1)
"""

SQL["level_pivot"] = _with(ARTICLES, LEVELS, TOP_L1) + FILLED + "SELECT * FROM filled"

SQL["level_pivot_transposed"] = _with(ARTICLES, LEVELS, TOP_L1) + FILLED + """
SELECT level_1, level_0, count,
       CAST(row_number() OVER (PARTITION BY level_1 ORDER BY count DESC, level_0) AS INTEGER) AS rank FROM filled"""

SQL["level_pivot_share"] = _with(ARTICLES, LEVELS, TOP_L1) + FILLED + """
SELECT level_1, level_0, CAST(count AS DOUBLE) / sum(count) OVER (PARTITION BY level_1) AS share FROM filled"""

# --------------------------------------------------------------------------- frontier / scans

_HOLIDAYS = "('01-01', '04-21', '05-01', '09-07', '10-12', '11-02', '11-15', '12-25')"

SQL["calendar_weekdays"] = f"""
WITH b AS (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM b)
SELECT d, CAST(isodow(d) AS INTEGER) AS iso_weekday FROM days
WHERE isodow(d) <= 5 AND strftime(d, '%m-%d') NOT IN {_HOLIDAYS}"""

SQL["frontier_urls"] = _with(EDITIONS, PORTALS, EDITION_MUNI) + """
, eds AS (SELECT e.edition_id, e.publication_date, m.municipality, m.domain_url
          FROM editions e JOIN edition_muni m USING (edition_id)),
ranges AS (SELECT municipality, domain_url, min(publication_date) AS lo, max(publication_date) AS hi
           FROM eds GROUP BY municipality, domain_url),
days AS (SELECT municipality, domain_url, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d
         FROM ranges)
SELECT 'metadata' AS phase, municipality, strftime(d, '%Y-%m-%d') AS request_key,
       domain_url || '/apifront/portal/edicoes/edicoes_from_data/' || strftime(d, '%Y-%m-%d') || '.json' AS url
FROM days WHERE isodow(d) <= 5
UNION ALL
SELECT 'structure', municipality, CAST(edition_id AS VARCHAR),
       domain_url || '/portal/visualizacoes/view_html_diario/' || CAST(edition_id AS VARCHAR) FROM eds
UNION ALL
SELECT * FROM (SELECT DISTINCT 'content', m.municipality, CAST(l_partkey AS VARCHAR),
       m.domain_url || '/apifront/portal/edicoes/publicacoes_ver_conteudo/' || CAST(l_partkey AS VARCHAR)
       FROM lineitem JOIN edition_muni m ON l_orderkey = m.edition_id)"""

SQL["rolling_window"] = _with(EDITIONS) + """
SELECT edition_id, publication_date, edition_type_name FROM editions
WHERE publication_date <= (SELECT max(publication_date) FROM editions)
  AND publication_date >= (SELECT max(publication_date) FROM editions) - 6"""

SQL["scan_projection"] = _with(EDITIONS) + "SELECT edition_id, publication_date FROM editions"

SQL["union_sources"] = """
SELECT 'metadata' AS phase, count(*) AS n_responses, CAST(sum(octet_length(encode(props))) AS BIGINT) AS n_bytes,
       CAST(0 AS BIGINT) AS n_with_url, CAST(0 AS BIGINT) AS n_with_municipality FROM events
UNION ALL
SELECT 'structure', count(*), CAST(sum(octet_length(encode(html))) AS BIGINT), count(url), CAST(0 AS BIGINT) FROM pages
UNION ALL
SELECT 'content', count(*), CAST(sum(octet_length(encode(text))) AS BIGINT), CAST(0 AS BIGINT), count(source)
FROM documents"""

SQL["editions_in_range"] = _with(EDITIONS, ARTICLES_FLAT) + """
, c AS (SELECT edition_id, count(*) AS n FROM articles_flat GROUP BY edition_id)
SELECT e.edition_id, e.publication_date, e.edition_type_name, CAST(coalesce(c.n, 0) AS INTEGER) AS num_articles
FROM editions e LEFT JOIN c USING (edition_id)
WHERE e.publication_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"""

# --------------------------------------------------------------------------- fetch log

FETCH_LOG = """log AS (
  SELECT event_id AS fetch_id, CAST(ts AS DATE) AS day,
         CASE WHEN event_type <> 'error' THEN 200 WHEN value < 10 THEN 503 WHEN value < 20 THEN 429
              WHEN value < 30 THEN 404 WHEN value < 40 THEN 400 ELSE 0 END AS status
  FROM events)"""

SQL["request_response_join"] = _with(PORTALS, EDITION_MUNI) + """
, req AS (SELECT DISTINCT m.municipality, l_partkey AS request_key FROM lineitem JOIN edition_muni m ON l_orderkey = m.edition_id),
resp AS (SELECT p.name AS municipality, doc_id AS request_key, 200 AS status,
                CAST(octet_length(encode(text)) AS BIGINT) AS content_size
         FROM documents JOIN portals p
           ON p.portal_key = coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % (SELECT count(*) FROM portals))
SELECT r.municipality, r.request_key, coalesce(s.status, 404) AS status, s.content_size,
       coalesce(s.status, 404) BETWEEN 200 AND 299 AS ok
FROM req r LEFT JOIN resp s USING (municipality, request_key)"""

SQL["retry_triage"] = _with(FETCH_LOG) + """
, tri AS (SELECT *, CASE WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status = 0 THEN 'retry'
                         WHEN status BETWEEN 500 AND 599 THEN 'retry' WHEN status IN (408, 429) THEN 'retry'
                         ELSE 'give_up' END AS action FROM log)
SELECT fetch_id, status, action, CAST(a AS INTEGER) AS attempt, a < 3 AS next_attempt,
       CASE WHEN a < 3 THEN least(greatest(pow(2.0, a - 1), 1.0), 10.0) ELSE 0.0 END AS wait_s
FROM tri, range(1, 4) r(a) WHERE action = 'retry'"""

SQL["fetch_success_ratio"] = _with(FETCH_LOG) + """
SELECT day, count(*) AS n, count(*) FILTER (WHERE status BETWEEN 200 AND 299) AS n_ok,
       CAST(count(*) FILTER (WHERE status BETWEEN 200 AND 299) AS DOUBLE) / count(*) AS ratio
FROM log GROUP BY day"""

# --------------------------------------------------------------------------- parsing

SQL["json_field_counts"] = """
WITH kv AS (SELECT unnest(json_keys(props)) AS field, props FROM events),
v AS (SELECT field, json_extract_string(props, '$."' || field || '"') AS value FROM kv)
SELECT field, count(*) AS n_payloads, count(DISTINCT value) AS n_distinct,
       min(TRY_CAST(value AS DOUBLE)) AS min_value, max(TRY_CAST(value AS DOUBLE)) AS max_value
FROM v GROUP BY field"""

SQL["edition_payloads"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS edition_id, CAST(o_orderdate AS DATE) AS publication_date,
       CAST(o_custkey AS INTEGER) AS edition_number, o_orderstatus = 'F' AS supplement,
       CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS edition_type_id, o_orderpriority AS edition_type_name
FROM orders"""

SQL["pdf_urls"] = _with(PORTALS, EDITION_MUNI) + """
SELECT edition_id, municipality,
       domain_url || '/apifront/portal/edicoes/pdf_diario/' || CAST(edition_id AS VARCHAR) || '/' AS pdf_url,
       'https://diariodomunicipio.sjc.sp.gov.br/apifront/portal/edicoes/pdf_diario/' || CAST(edition_id AS VARCHAR)
         || '/' AS pdf_url_compat
FROM edition_muni"""

SQL["nav_links"] = """
WITH u AS (SELECT page_id, regexp_extract(html, '(?s)<ul[^>]*>(.*?)</ul>', 1) AS ul FROM pages),
h AS (SELECT page_id, regexp_extract_all(ul, '<a\\s[^>]*href="([^"]*)"', 1) AS hrefs FROM u)
SELECT page_id, CAST(generate_subscripts(hrefs, 1) - 1 AS INTEGER) AS pos, unnest(hrefs) AS href FROM h"""

# --------------------------------------------------------------------------- assembly

SQL["dedupe_keep_deepest"] = _with(ARTICLES) + """
SELECT identifier, article_id, edition_id, depth, hierarchy_path FROM articles
QUALIFY row_number() OVER (PARTITION BY identifier ORDER BY depth DESC, article_id, protocol) = 1"""

SQL["dedupe_stats"] = """
SELECT count(*) AS rows_in, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS rows_out,
       count(*) - (SELECT count(DISTINCT l_partkey) FROM lineitem) AS removed
FROM lineitem"""

SQL["edition_article_counts"] = _with(EDITIONS, ARTICLES_FLAT) + """
, c AS (SELECT edition_id, count(*) AS n FROM articles_flat GROUP BY edition_id)
SELECT e.edition_id, CAST(coalesce(c.n, 0) AS INTEGER) AS num_articles FROM editions e LEFT JOIN c USING (edition_id)"""

SQL["orphan_articles"] = _with(EDITIONS, ARTICLES_FLAT) + """
SELECT a.article_id, a.edition_id FROM articles_flat a
WHERE NOT EXISTS (SELECT 1 FROM editions e WHERE e.edition_id = a.edition_id AND NOT e.supplement)"""

SQL["rejects_summary"] = _with(EDITIONS, ARTICLES_FLAT) + """
, r AS (
  SELECT 'metadata' AS phase, CASE WHEN props IS NULL OR NOT starts_with(ltrim(props), '{') THEN 'not_object' ELSE 'no_items' END AS reason
  FROM events
  UNION ALL
  SELECT 'structure', 'orphan' FROM articles_flat a
  WHERE NOT EXISTS (SELECT 1 FROM editions e WHERE e.edition_id = a.edition_id AND NOT e.supplement)
  UNION ALL
  SELECT 'content', 'missing_content' FROM articles_flat a
  WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = a.identifier))
SELECT phase, reason, count(*) AS n_rejected FROM r GROUP BY phase, reason"""

SQL["nav_tree_paths"] = _with(ARTICLES) + """
SELECT edition_id, CAST(article_id AS VARCHAR) AS article_id, CAST(identifier AS VARCHAR) AS identifier, protocol, title, depth,
       array_to_string(hierarchy_path, '|') AS path FROM articles"""

SQL["content_charsets"] = """
SELECT doc_id AS request_key, CASE WHEN lang = 'de' OR lang NOT IN ('fr', 'es') THEN 'html' ELSE 'text' END AS content_type,
       CAST(length(t) AS BIGINT) AS n_chars, CAST(octet_length(encode(t)) AS BIGINT) AS content_size, sha256(t) AS text_hash
FROM (SELECT doc_id, lang, text || CASE WHEN lang IN ('fr', 'de') THEN chr(65533) ELSE '' END AS t FROM documents)"""

SQL["empty_editions"] = _with(EDITIONS, ARTICLES_FLAT) + """
SELECT e.edition_id, e.publication_date FROM editions e
WHERE NOT EXISTS (SELECT 1 FROM articles_flat a WHERE a.edition_id = e.edition_id)"""

# --------------------------------------------------------------------------- lake tables (ingest pipeline)

CORPUS = _with(EDITIONS, PORTALS, EDITION_MUNI, ARTICLES) + """
, links AS (SELECT a.*, m.municipality FROM articles a JOIN edition_muni m USING (edition_id)),
uniq AS (SELECT * FROM links WHERE identifier IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY municipality, identifier ORDER BY depth DESC, article_id, protocol) = 1),
content AS (
  SELECT doc_id AS request_key,
         CASE lang WHEN 'en' THEN 'html' WHEN 'fr' THEN 'text' WHEN 'de' THEN 'pdf' WHEN 'es' THEN 'html' END
           AS content_type,
         CAST(length(text) AS BIGINT) AS char_length,
         CAST(octet_length(encode(text)) AS BIGINT) AS content_size,
         length(text) > 2000 AS is_blob,
         CASE WHEN length(text) > 2000 THEN sha256(text) END AS content_hash,
         CASE WHEN length(text) > 2000 THEN 'content/' || substr(sha256(text), 1, 2) || '/'
              || substr(sha256(text), 3, 2) || '/' || sha256(text) || '.bin' END AS content_path,
         CASE WHEN length(text) <= 2000 THEN text END AS inline_text
  FROM documents),
arts AS (SELECT u.* EXCLUDE (content_type, content_size), c.content_type, c.content_size, c.content_hash,
                c.content_path, c.inline_text
         FROM uniq u JOIN content c ON u.identifier = c.request_key),
counts2 AS (SELECT edition_id, count(*) AS n FROM arts GROUP BY edition_id),
eds AS (SELECT e.*, m.municipality, m.domain_url, CAST(coalesce(c.n, 0) AS INTEGER) AS total_articles,
               md5(CAST(e.edition_id AS VARCHAR) || '_' || strftime(e.publication_date, '%Y-%m-%d') || '_'
                   || CAST(coalesce(c.n, 0) AS VARCHAR)) AS edition_hash
        FROM editions e JOIN edition_muni m USING (edition_id) LEFT JOIN counts2 c USING (edition_id)),
blobs AS (SELECT content_hash, min(content_path) AS content_path, max(content_size) AS content_size,
                 count(*) AS n_refs FROM content WHERE is_blob GROUP BY content_hash),
art_rows AS (
  SELECT a.municipality, CAST(a.article_id AS VARCHAR) AS article_id, CAST(a.edition_id AS VARCHAR) AS edition_id,
         e.edition_hash, e.publication_date, a.title, CAST(to_json(a.hierarchy_path) AS VARCHAR) AS hierarchy_path_json,
         CAST(a.identifier AS VARCHAR) AS identifier, coalesce(a.protocol, '') AS protocol, a.depth,
         a.content_type, a.content_size, a.content_hash, a.content_path, a.inline_text,
         CAST(year(e.publication_date) AS INTEGER) AS year, CAST(month(e.publication_date) AS INTEGER) AS month,
         CAST(day(e.publication_date) AS INTEGER) AS day
  FROM arts a JOIN eds e USING (edition_id)),
ed_rows AS (
  SELECT municipality, CAST(edition_id AS VARCHAR) AS edition_id, publication_date, edition_number, supplement,
         edition_type_id, edition_type_name,
         domain_url || '/apifront/portal/edicoes/pdf_diario/' || CAST(edition_id AS VARCHAR) || '/' AS pdf_url,
         total_articles, edition_hash, CAST(year(publication_date) AS INTEGER) AS year,
         CAST(month(publication_date) AS INTEGER) AS month, CAST(day(publication_date) AS INTEGER) AS day
  FROM eds)
"""

SQL["editions_table"] = CORPUS + "SELECT * FROM ed_rows"
SQL["articles_table"] = CORPUS + "SELECT * FROM art_rows"
SQL["relationships_table"] = CORPUS + """
SELECT municipality, edition_id, article_id, edition_hash, publication_date, year, month, day FROM art_rows"""
SQL["edition_hash"] = CORPUS + """
SELECT edition_id, total_articles, edition_hash, year, month, day FROM ed_rows"""
SQL["content_split"] = CORPUS + """
SELECT request_key, content_type, char_length, content_size, is_blob, content_hash, content_path FROM content"""
SQL["content_blobs"] = CORPUS + "SELECT * FROM blobs"
SQL["content_lookup"] = CORPUS + """
SELECT a.article_id, a.content_hash, b.content_path, b.content_size
FROM art_rows a JOIN blobs b USING (content_hash)"""
SQL["summary_metrics"] = CORPUS + """
SELECT (SELECT count(*) FROM ed_rows) AS n_editions, (SELECT count(*) FROM art_rows) AS n_articles,
       (SELECT count(*) FROM art_rows) AS n_relationships,
       (SELECT count(*) FROM ed_rows WHERE total_articles = 0) AS n_empty_editions,
       (SELECT count(*) FROM blobs) AS n_blobs, (SELECT CAST(sum(content_size) AS BIGINT) FROM blobs) AS blob_bytes"""

# --------------------------------------------------------------------------- lake written and read back

SQL["lake_round_trip"] = CORPUS + """
, f AS (
  SELECT 'editions' AS "table", municipality, year, regexp_extract(pdf_url, 'https?://([^/]+)', 1) AS host FROM ed_rows
  UNION ALL SELECT 'articles', municipality, year, NULL FROM art_rows
  UNION ALL SELECT 'relationships', municipality, year, NULL FROM art_rows),
g AS (SELECT "table", 'municipality=' || municipality || '/year=' || CAST(year AS VARCHAR) || '/batch_id=b1' AS path, count(*) AS n_rows,
             true AS has_files, max(host) AS host, CAST(count(DISTINCT host) AS INTEGER) AS n_hosts
      FROM f GROUP BY ALL)
SELECT *, CAST(sum(n_rows) OVER (PARTITION BY "table") AS BIGINT) AS table_rows FROM g"""
SQL["blob_append"] = """
WITH b AS (SELECT sha256(text) AS content_hash, lang, CAST(octet_length(encode(text)) AS BIGINT) AS size
           FROM documents WHERE length(text) > 2000)
SELECT content_hash, CASE WHEN bool_or(lang IN ('en', 'fr')) THEN 'b1' ELSE 'b2' END AS batch_id,
       substr(content_hash, 1, 2) AS prefix, max(size) AS content_size, content_hash AS stored_hash
FROM b GROUP BY content_hash"""
SQL["content_bodies"] = CORPUS + """
SELECT article_id, content_hash, content_size AS n_bytes, true AS intact FROM art_rows WHERE content_hash IS NOT NULL"""
SQL["edition_article_chunks"] = _with(ARTICLES_FLAT) + """
, r AS (SELECT *, row_number() OVER (PARTITION BY edition_id ORDER BY article_id, protocol, identifier, depth) - 1 AS n FROM articles_flat)
SELECT edition_id, CAST(n // 4 AS INTEGER) AS chunk, CAST(count(*) AS INTEGER) AS n_articles,
       list(article_id ORDER BY n) AS article_ids, list(identifier ORDER BY n) AS identifiers
FROM r GROUP BY edition_id, n // 4"""
SQL["frontier_hosts"] = f"""
SELECT phase, municipality, regexp_extract(url, 'https?://([^/]+)', 1) AS host,
       regexp_replace(regexp_replace(url, 'https?://[^/]+', ''), '[0-9]+', '#', 'g') AS path_shape, count(*) AS n_requests
FROM ({SQL["frontier_urls"]}) GROUP BY ALL"""

# --------------------------------------------------------------------------- article query

QUERY_BASE = _with(EDITIONS, PORTALS, EDITION_MUNI, ARTICLES_FLAT) + """
, q AS (SELECT a.article_id, a.edition_id, m.municipality, e.publication_date, a.content_type, a.content_size
        FROM articles_flat a JOIN editions e USING (edition_id) JOIN edition_muni m USING (edition_id))
"""

SQL["query_articles_filter"] = QUERY_BASE + """
SELECT * FROM q WHERE municipality = 'rj_rio_de_janeiro'
  AND publication_date >= DATE '1996-01-01' AND publication_date <= DATE '1997-12-31'
  AND content_type IN ('html', 'text')"""

SQL["query_articles_limit"] = SQL["query_articles_filter"] + (
    " ORDER BY article_id, edition_id, content_type, content_size LIMIT 100")
