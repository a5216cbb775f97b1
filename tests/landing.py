"""Test fixture: the driver tables landed as raw responses."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def land_from_driver(spark: SparkSession, d: str, out_dir: str, n_batches: int = 3) -> list[str]:
    """Land the driver tables as raw responses, ``n_batches``
    files, each a complete crawl batch (metadata + structure + content) for the
    editions whose id falls in it. Structure pages are rebuilt as navigation trees."""
    from quire.plans.ingest import edition_payloads_landed
    from quire.sources import driver

    em = driver.edition_municipality(spark, d)
    meta = (edition_payloads_landed(spark, d).join(em, F.col("request_key") == F.col("edition_id"))
            .select("municipality", F.lit("metadata").alias("phase"),
                    F.col("request_key").cast("string").alias("request_key"),
                    F.col("request_key").cast("string").alias("edition_id"),
                    F.lit("application/json").alias("content_type_header"),
                    F.encode("payload", "UTF-8").alias("body"), F.col("request_key").alias("seq")))

    a = driver.articles(spark, d)
    link = F.concat(F.lit('<li><a class="linkMateria" data-materia-id="'), F.col("article_id").cast("string"),
                    F.lit('" identificador="'), F.col("identifier").cast("string"),
                    F.lit('" data-protocolo="'), F.col("protocol"), F.lit('">'), F.col("title"), F.lit("</a></li>"))
    frag = F.aggregate(F.reverse("hierarchy_path"), link,
                       lambda acc, x: F.concat(F.lit('<li><span class="folder">'), x, F.lit("</span><ul>"), acc,
                                               F.lit("</ul></li>")))
    # one page per edition: its links (at most one gazette's worth) in article order
    pages = (a.select("edition_id", "article_id", frag.alias("frag"))
              .groupBy("edition_id")
              .agg(F.array_sort(F.collect_list(F.struct("article_id", "frag"))).alias("fr"))
              .select("edition_id", F.concat(F.lit('<html><body><ul id="tree">'),
                                             F.array_join(F.transform("fr", lambda s: s["frag"]), ""),
                                             F.lit("</ul></body></html>")).alias("html")))
    struct = (pages.join(em, "edition_id")
                   .select("municipality", F.lit("structure").alias("phase"),
                           F.col("edition_id").cast("string").alias("request_key"),
                           F.col("edition_id").cast("string").alias("edition_id"),
                           F.lit("text/html; charset=utf-8").alias("content_type_header"),
                           F.encode("html", "UTF-8").alias("body"), F.col("edition_id").alias("seq")))

    responses = driver.content_responses(spark, d).drop("municipality")
    wanted = a.select("edition_id", "identifier").distinct()
    content = (wanted.join(responses, F.col("identifier") == F.col("request_key"))
                     .join(em, "edition_id")
                     .select("municipality", F.lit("content").alias("phase"),
                             F.col("request_key").cast("string").alias("request_key"),
                             F.col("edition_id").cast("string").alias("edition_id"),
                             "content_type_header", "body", F.col("edition_id").alias("seq")))
    landed = meta.unionByName(struct).unionByName(content).withColumn(
        "_b", F.pmod(F.col("edition_id").cast("bigint"), F.lit(n_batches)))
    paths = []
    for b in range(n_batches):
        p = f"{out_dir}/b{b:04d}"
        (landed.where(F.col("_b") == b).drop("_b")
               .dropDuplicates(["municipality", "phase", "request_key"])
               .coalesce(1).write.mode("overwrite").parquet(p))
        paths.append(p)
    return paths
