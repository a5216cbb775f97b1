def write_documents(spark, folder, rows):
    """A table folder holding only documents.parquet."""
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint") \
        .write.parquet(f"{folder}/documents.parquet")
